"""Document fingerprints: a Merkle tree over sections, paragraphs, clauses and words.

Clauses are cut after punctuation, so an edit moves no other border; their hash is that of their text.  The leaves below, opened only where
clauses differ, are words, each hashed with the two before it in its clause, so a text of any length is compared by the same rule; a section ends at a blank line or after a
paragraph whose hash says so, which again depends on that paragraph alone.  Equal roots mean equal texts.  Where roots differ, the
walk goes down only into branches without an equal partner and finds the edited leaves."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import documents, map_batches

CLAUSE = re.compile(r"[^.,;:!?]+[.,;:!?]*\s*|[.,;:!?]+\s*")
#: A clause without punctuation is cut after so many characters.
LEAF_CHARS = 160
WORD = re.compile(r"\S+\s*|\s+")
#: A section ends after a paragraph whose first hash byte is below this: one in eight.
SECTION_BYTE = 32


@dataclass(slots=True)
class Node:
    """A branch: hash, characters below it, children (none for a leaf; those of a clause follow from its text)."""

    hash: bytes
    chars: int
    children: list[Node] | None = None
    text: str | None = None

    def below(self) -> list[Node] | None:
        if self.children is None and self.text is not None:
            words = WORD.findall(self.text)
            raw = [w.encode("utf-8", "surrogatepass") for w in words]
            self.children = [Node(blake2b(b"\0".join(raw[max(0, i - 2) : i + 1]), digest_size=16).digest(), len(w)) for i, w in enumerate(words)]
        return self.children


def _branch(level: bytes, children: list[Node]) -> Node:
    return Node(blake2b(level + b"".join([c.hash for c in children]), digest_size=16).digest(), sum([c.chars for c in children]), children)


def _paragraph(text: str) -> Node:
    parts = CLAUSE.findall(text)
    if len(text) > LEAF_CHARS:
        parts = [p[i : i + LEAF_CHARS] for p in parts for i in range(0, len(p), LEAF_CHARS)]
    return _branch(b"P", [Node(blake2b(b"L" + p.encode("utf-8", "surrogatepass"), digest_size=16).digest(), len(p), text=p) for p in parts])


def tree(text: str) -> Node:
    """Root over sections over paragraphs (lines) over clauses over words; the empty text has one empty paragraph."""
    sections, open_section = [], []
    for line in text.split("\n"):
        paragraph = _paragraph(line)
        open_section.append(paragraph)
        if not line.strip() or paragraph.hash[0] < SECTION_BYTE:
            sections.append(_branch(b"S", open_section))
            open_section = []
    if open_section:
        sections.append(_branch(b"S", open_section))
    return _branch(b"R", sections)


def _apart(nodes: list[Node], others: list[Node]) -> tuple[int, list[Node], list[Node]]:
    """Characters below equal branches (copies pair off one to one), and the branches left over on each side."""
    left = Counter([n.hash for n in others])
    same, mine = 0, []
    for n in nodes:
        if left.get(n.hash, 0):
            left[n.hash] -= 1
            same += n.chars
        else:
            mine.append(n)
    rest = []
    for n in reversed(others):
        if left[n.hash] > 0:
            left[n.hash] -= 1
            rest.append(n)
    return same, mine, rest[::-1]


def _differing(a: Node, b: Node) -> tuple[int, list[Node], list[Node]]:
    """Common characters and the nodes left over where the walk ends."""
    same, xs, ys = 0, [a], [b]
    while xs and ys and xs[0].below() is not None:
        found, xs, ys = _apart([c for x in xs for c in x.below()], [c for y in ys for c in y.below()])
        same += found
    return same, xs, ys


def compare(a: Node, b: Node) -> tuple[int, list[Node], list[Node]]:
    """Common characters and the leaves that only one of two trees has, reached through differing branches."""
    if a.hash == b.hash:
        return a.chars, [], []
    same, xs, ys = _differing(a, b)
    down = lambda nodes: nodes if not nodes or nodes[0].below() is None else down([c for n in nodes for c in n.below()])
    return same, down(xs), down(ys)


def likeness(a: Node, b: Node) -> float:
    """1 for equal roots only; else the share of characters below equal branches."""
    if a.hash == b.hash:
        return 1.0
    total = a.chars + b.chars
    return min(2 * _differing(a, b)[0] / total, 1 - 1 / (total + 1)) if total else 0.0


def edited(text: str, following: str) -> str:
    """The last quarter replaced by the first characters, as many, of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, sections): root and section hashes of each row; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            trees = [tree(t.as_py()) for t in batch.column(1)]
            yield {"doc_id": batch.column(0), "fingerprint": [t.hash.hex() for t in trees], "sections": [[s.hash.hex() for s in t.children] for t in trees]}

    return map_batches(documents(docs, id_col, text_col), run, "doc_id long, fingerprint string, sections array<string>")


_COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc_id: int | None, text: str, own: Node, following: str, after: Node) -> tuple:
    changed = edited(text, following)
    other = tree(changed)
    return doc_id, len(text), sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own.hash.hex(), other.hash.hex(), likeness(own, other), likeness(own, after)


def edit_comparison(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint against those of its edited text and of the next document by doc_id (after the last: the first).

    Texts are dealt out by ranges of (doc_id, text hash) and read in order, so each is moved once.  Each range keeps its first
    and last text aside; these, two for each range, meet in a second step.  Rows without a doc_id come first, rows with
    equal ones in order of their text's hash; a single document follows itself; no rows give no rows."""
    ordered = documents(docs, id_col, text_col, F.xxhash64(F.col(text_col)).alias("h")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    names = [c.split()[0] for c in _COLUMNS.split(", ")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, held, first = TaskContext.get().partitionId(), None, None
        kept = lambda kind, x: {**{n: [None] for n in names}, "doc_id": [x[0]], "kind": [kind], "part": [part], "text": [x[1]]}
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                now = doc_id, text, tree(text)
                if held is None:
                    first = now
                else:
                    rows.append(_row(*held, text, now[2]))
                held = now
            if rows:
                yield {**dict(zip(names, zip(*rows), strict=True)), "kind": [0] * len(rows), "part": [part] * len(rows), "text": [None] * len(rows)}
        if held is not None:
            yield kept(1, first)
            yield kept(2, held)

    done = stage(map_batches(ordered, walk, f"{_COLUMNS}, kind int, part int, text string"), "merkle")
    # One number for each range, not for each row.
    parts = sorted(r.part for r in done.filter("kind = 1").select("part").collect())
    if not parts:
        return done.select(names)
    before = F.create_map(*[F.lit(x) for pair in zip(parts[1:] + parts[:1], parts, strict=True) for x in pair])
    firsts = done.filter("kind = 1").select(before[F.col("part")].alias("part"), F.col("text").alias("following"))
    borders = done.filter("kind = 2").select("part", "doc_id", "text").join(firsts, "part").select("doc_id", "text", "following")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            rows = [_row(i, t, tree(t), n, tree(n)) for i, t, n in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
            if rows:
                yield dict(zip(names, zip(*rows), strict=True))

    return done.filter("kind = 0").select(names).unionByName(map_batches(borders, close, _COLUMNS))
