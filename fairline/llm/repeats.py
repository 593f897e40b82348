"""Repeated byte strings by run-length indexes.

Every string of ``WIDTH`` bytes belongs to the smallest hash of an 8-byte word in its first third, its anchor.  Equal strings have
equal anchors at equal places, so the bytes after an anchor that all its strings share (the core) bring them together, wherever they stand.
Stretches that are equal as a whole repeat as a whole and are settled by counting.  Different stretches with one core go to an index: a
run-compressed Burrows-Wheeler transform of their text, suffix places kept at both ends of each run.  At a run's end the match with
the neighbour is measured, everywhere else the length follows from the place before, so the matching statistics are streamed
in text order.  A core with very many different stretches is settled string by string through counts of 128-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import stage
from .common import documents, map_batches

WIDTH = 400
WORD = 8
BLOCK_BYTES = 32 << 20
#: Starts looked at together in a long text; text of one index; different stretches of a core that go to an index.
STARTS, INDEX_BYTES, STRETCHES = 1 << 21, 1 << 20, 4_000
TEXT, ANCHOR = 0, 1
SEPARATOR = b"\xff"


def _reach(width: int) -> int:
    """Places for an anchor in a string; the core has width - reach + 1 bytes."""
    return max(1, min(width // 3 + 4, width - WORD + 1))


def _words(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on, as a number."""
    n = len(data) - WORD + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(WORD):
        out = (out << np.uint64(8)) | data[k : k + len(out)]
    return out


def anchors(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start) of each run of strings with one anchor."""
    starts = len(data) - width + 1
    if starts <= 0:
        return (np.zeros(0, np.int64),) * 3
    reach, parts = _reach(width), []
    for at in range(0, starts, STARTS):
        count = min(STARTS, starts - at)
        h = _words(data[at : at + count + reach + WORD - 2]) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while span * 2 <= reach:
            h = np.minimum(h[:-span], h[span:])
            span *= 2
        h = np.minimum(h[:count], h[reach - span : reach - span + count])
        parts.append((h & np.uint64(0xFFFFFF)).astype(np.int64) + at)
    owner = np.concatenate(parts)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    return owner[first], first, np.r_[first[1:], starts] - 1


_PARTS = "kind int, block long, idx int, lo long, size int, core long, whole long, ids binary, sizes binary, text binary"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _block_rows(block: int, ids: list[int | None], texts: list[bytes], width: int) -> Iterator[dict]:
    known, numbers = np.array([i is not None for i in ids], np.int64), np.array([i or 0 for i in ids], np.int64)
    yield {
        "kind": [TEXT], "block": [block], "idx": [0], "lo": [0], "size": [0], "core": [0], "whole": [0], "ids": [np.stack([numbers, known]).tobytes()],
        "sizes": [np.array([len(t) for t in texts], np.int64).tobytes()], "text": [zstandard.compress(b"".join(texts), 3)]}
    core_size, columns = width - _reach(width) + 1, ([], [], [], [], [])
    for k, text in enumerate(texts):
        at, first, last = anchors(np.frombuffer(text, np.uint8), width)
        for a, b, c in zip(at.tolist(), first.tolist(), last.tolist(), strict=True):
            for column, value in zip(columns, (k, b, c - b + width, xxhash.xxh3_64_intdigest(text[a : a + core_size]), xxhash.xxh3_64_intdigest(text[b : c + width], a - b)), strict=True):
                column.append(value)
    if columns[0]:
        n = len(columns[0])
        none = pa.nulls(n, pa.binary())
        yield {
            "kind": np.full(n, ANCHOR), "block": np.full(n, block), "idx": columns[0], "lo": columns[1], "size": columns[2], "core": np.array(columns[3], np.uint64).view(np.int64),
            "whole": np.array(columns[4], np.uint64).view(np.int64), "ids": none, "sizes": none, "text": none}


def _blocks(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        ids, texts, size, n = [], [], 0, 0
        first = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = t.as_py().encode("utf-8", "surrogatepass")
                if texts and size + len(text) > BLOCK_BYTES:
                    yield from _block_rows(first + n, ids, texts, width)
                    ids, texts, size, n = [], [], 0, n + 1
                ids.append(i)
                texts.append(text)
                size += len(text)
        if texts:
            yield from _block_rows(first + n, ids, texts, width)

    return run


def _opened(row: dict) -> tuple[list[int | None], np.ndarray, bytes]:
    numbers, known = np.frombuffer(row["ids"], np.int64).reshape(2, -1)
    ends = np.r_[0, np.cumsum(np.frombuffer(row["sizes"], np.int64))]
    return [int(i) if k else None for i, k in zip(numbers, known, strict=True)], ends, zstandard.decompress(row["text"])


class RunIndex:
    """Run-compressed transform of some strings with the suffix place at each run's first and last row."""

    def __init__(self, strings: list[bytes]):
        self.text = np.frombuffer(SEPARATOR.join([*strings, b""]), np.uint8)
        n = len(self.text)
        sizes = np.array([len(s) for s in strings], np.int64)
        self.starts = np.r_[0, np.cumsum(sizes + 1)[:-1]]
        ends = self.starts + sizes
        #: First place past the string that holds a place.
        self.end = np.repeat(ends, sizes + 1)
        suffixes = self._sorted(self.text)
        before = self.text[suffixes - 1].astype(np.int64)
        before[suffixes == 0] = 256  # nothing stands before the first place
        edge = np.r_[True, before[1:] != before[:-1]]
        self.symbols, self.lengths = before[edge], np.diff(np.r_[np.flatnonzero(edge), n])
        self.heads, self.tails = suffixes[edge], suffixes[np.r_[edge[1:], True]]

    @staticmethod
    def _sorted(text: np.ndarray) -> np.ndarray:
        """Suffix array: ranks by the first eight bytes, then three ranks at once, or two in a text too long for that."""
        n, span = len(text), WORD
        bits = int(n + 1).bit_length()
        parts = 3 if 3 * bits <= 63 else 2
        key = _words(np.r_[text, np.zeros(WORD - 1, np.uint8)])
        while True:
            order = np.argsort(key)
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[True, ordered[1:] != ordered[:-1]])
            if rank[order[-1]] == n:
                return order
            key = rank.copy()
            for k in range(1, parts):
                key <<= bits
                key[: max(n - k * span, 0)] |= rank[k * span :]
            span *= parts

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal bytes from places a and b on."""
        most = len(self.text) - np.maximum(a, b)
        words = _words(np.r_[self.text, np.zeros(WORD, np.uint8)])
        length, rows = np.zeros(len(a), np.int64), np.flatnonzero(most > 0)
        while len(rows):
            diff = words[a[rows] + length[rows]] ^ words[b[rows] + length[rows]]
            same = diff == 0
            last = rows[~same]
            bits = diff[~same]
            equal = np.zeros(len(last), np.int64)
            for k in range(1, WORD):
                equal += bits >> np.uint64(64 - 8 * k) == 0
            length[last] += equal
            rows = rows[same]
            length[rows] += WORD
            rows = rows[length[rows] < most[rows]]
        return np.minimum(length, most)

    def matches(self) -> np.ndarray:
        """For each place the longest string from there on, within its own, that starts elsewhere, too."""
        best = np.zeros(len(self.text), np.int64)
        up = np.r_[0, self._common(self.heads[1:], self.tails[:-1])]
        down = np.r_[up[1:], 0]
        for places, lengths in ((self.heads, up), (self.tails, down)):
            known, value = np.zeros(len(best), np.int64), np.zeros(len(best), np.int64)
            known[places], value[places] = places, lengths
            known = np.maximum.accumulate(known)
            best = np.maximum(best, value[known] - (np.arange(len(best)) - known))
        return np.minimum(best, self.end - np.arange(len(best)))


def repeated(strings: list[bytes], width: int) -> list[tuple[list[int], list[int]]]:
    """For each string the byte ranges covered by strings of ``width`` bytes that start elsewhere, too."""
    if not strings:
        return []
    index = RunIndex(strings)
    hit = index.matches() >= width
    out = []
    for start, text in zip(index.starts.tolist(), strings, strict=True):
        own = np.diff(np.r_[0, hit[start : start + len(text)].astype(np.int8), 0])
        out.append((np.flatnonzero(own > 0).tolist(), (np.flatnonzero(own < 0) - 1 + width).tolist()))
    return out


def _schema(text: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(text))


def _rows(schema: pa.Schema, rows: list[dict]) -> pa.Table:
    return pa.table({f.name: pa.array([r.get(f.name) for r in rows], f.type) for f in schema})


_MARKS = "core long, whole long, begins array<int>, ends array<int>"


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(block, idx, begin, end): repeated ranges, overlapping; and the staged blocks of text."""
    parts = stage(map_batches(documents(docs, id_col, text_col), _blocks(width), _PARTS), "repeats-parts")
    texts = parts.filter(F.col("kind") == TEXT).select("block", "ids", "sizes", "text")
    found = parts.filter(F.col("kind") == ANCHOR).select("block", "idx", "lo", "size", "core", "whole")
    # What is joined below grows with the corpus, so it is joined in one way at every size.
    twice = stage(found.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core"), "repeats-cores")
    hits = stage(found.join(twice.hint("merge"), "core", "left_semi"), "repeats-hits")
    kinds = stage(hits.groupBy("core", "whole").agg(F.count("*").alias("n"), F.min(F.struct("block", "idx", "lo", "size")).alias("r")), "repeats-kinds")
    mixed = kinds.groupBy("core").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    asked = kinds.join(mixed.hint("merge"), "core").select("core", "whole", "n", "kinds", "r.*")
    stretch_schema = _schema("core long, whole long, n long, kinds long, bytes binary")

    def fetch(want: pa.Table, have: pa.Table) -> pa.Table:
        if not want.num_rows:
            return _rows(stretch_schema, [])
        _, ends, text = _opened(have.to_pylist()[0])
        rows = want.select(["core", "whole", "n", "kinds", "idx", "lo", "size"]).to_pylist()
        for r in rows:
            at = int(ends[r["idx"]]) + r["lo"]
            r["bytes"] = text[at : at + r["size"]]
        return _rows(stretch_schema, rows)

    stretches = asked.groupBy("block").cogroup(texts.groupBy("block")).applyInArrow(fetch, "core long, whole long, n long, kinds long, bytes binary")
    stretches = stage(stretches, "repeats-stretches")
    few = stretches.filter(F.col("kinds") <= STRETCHES)
    tasks = max(1, -(-int(few.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0))).first()[0]) // INDEX_BYTES))
    mark_schema = _schema(_MARKS)

    def index(table: pa.Table) -> pa.Table:
        ranges = repeated([b.as_py() for b in table["bytes"]], width)
        rows = [{"core": c, "whole": w, "begins": b, "ends": e} for c, w, n, (b, e) in zip(*(table[x].to_pylist() for x in ("core", "whole", "n")), ranges, strict=True) if n == 1 and b]
        return _rows(mark_schema, rows)

    part = F.pmod(F.xxhash64("core"), F.lit(tasks)).cast("int").alias("task")
    marks = few.select("core", "whole", "n", "bytes", part).groupBy("task").applyInArrow(index, _MARKS)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for r in batch.to_pylist():
                n = len(r["bytes"]) - width + 1
                yield {
                    "core": [r["core"]] * n, "whole": [r["whole"]] * n, "at": list(range(n)), "n": [r["n"]] * n,
                    "h": [xxhash.xxh3_128_digest(r["bytes"][i : i + width]) for i in range(n)]}

    many = map_batches(stretches.filter(F.col("kinds") > STRETCHES).select("core", "whole", "n", "bytes"), each, "core long, whole long, at int, n long, h binary")
    again = many.groupBy("h").agg(F.sum("n").alias("all")).filter("all > 1").select("h")
    single = many.filter("n = 1").join(again, "h", "left_semi").select("core", "whole", F.array("at").alias("begins"), F.array(F.col("at") + width).alias("ends"))
    whole = kinds.filter("n > 1").select("core", "whole", F.array(F.lit(0)).alias("begins"), F.array(F.col("r.size")).alias("ends"))
    marks = marks.unionByName(single).unionByName(whole)
    placed = hits.join(marks.hint("merge"), ["core", "whole"]).select("block", "idx", "lo", F.explode(F.arrays_zip("begins", "ends")).alias("m"))
    return placed.select("block", "idx", (F.col("lo") + F.col("m.begins")).alias("begin"), (F.col("lo") + F.col("m.ends")).alias("end")), texts


def _cut(marks: DataFrame, texts: DataFrame, finish, schema: str) -> DataFrame:
    """``finish(doc_id, text, removed mask)`` for every document, block by block."""
    arrow = _schema(schema)

    def run(want: pa.Table, have: pa.Table) -> pa.Table:
        ids, ends, text = _opened(have.to_pylist()[0])
        data, rows = np.frombuffer(text, np.uint8), []
        idx, begin, end = (want[c].to_numpy() for c in ("idx", "begin", "end"))
        order = np.argsort(idx, kind="stable")
        own = np.searchsorted(idx[order], np.arange(len(ids) + 1))
        for k, i in enumerate(ids):
            part = data[ends[k] : ends[k + 1]]
            edges, marked = np.zeros(len(part) + 1, np.int32), order[own[k] : own[k + 1]]
            np.add.at(edges, begin[marked], 1)
            np.add.at(edges, end[marked], -1)
            rows.append(finish(i, part, np.cumsum(edges[:-1], dtype=np.int32) > 0))
        return _rows(arrow, rows)

    return marks.groupBy("block").cogroup(texts.groupBy("block")).applyInArrow(run, schema)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``docs``.

    A byte goes if a string of ``width`` bytes over it also starts anywhere else, its own document included.  Null and empty texts, and
    those shorter than ``width``, lose nothing; of repeated rows all lose what they share."""

    def finish(doc_id: int | None, data: np.ndarray, gone: np.ndarray) -> dict:
        return {
            "doc_id": doc_id, "n_bytes": len(data), "n_removed": int(gone.sum()), "n_spans": int(np.count_nonzero(np.diff(np.r_[0, gone.astype(np.int8)]) > 0)),
            "kept_sha256": sha256(data[~gone].tobytes()).hexdigest()}

    return _cut(*spans(docs, id_col, text_col, width), finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, kept): the bytes left of each text; a cut may split a character, so they are bytes."""
    return _cut(*spans(docs, id_col, text_col, width), lambda i, data, gone: {"doc_id": i, "kept": data[~gone].tobytes()}, "doc_id long, kept binary")
