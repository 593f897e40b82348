"""BPE encoding by dynamic programming over prefixes.

The encoding of a prefix has one possible last token.  Going through a word once, all vocabulary tokens that end at a position come
from an automaton over the vocabulary; of these the one is kept that starts where a known prefix ends and cannot be merged across that
border.  The back-pointers then give the ids.  Nothing is merged step by step, and a word costs time in proportion to its length."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import documents, map_batches

END = "\x00"
NEVER = 1 << 60
#: Fixed values of the vocabulary's file format: its pre-tokenizer's pattern with Unicode white space spelled out.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
#: Encoded words and tested pairs are kept for later texts of the same worker, up to so many.
WORDS_KEPT = 400_000
PAIRS_KEPT = 1_000_000


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself where printable in Latin-1, else the next free one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, free = [""] * 256, 256
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b], free = chr(free), free + 1
    return letters


class PrefixBpe:
    """Vocabulary with word ends, lower-cased, byte letters; see ``encode``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        suffix = spec["model"]["end_of_word_suffix"]
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.letters = str.maketrans({chr(b): letter for b, letter in enumerate(byte_letters())})
        self.borders = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.word = regex.compile(WORD)
        inner = lambda t: t[: -len(suffix)] + END if t.endswith(suffix) else t
        self.merge: dict[tuple[int, int], int] = {}
        split: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(spec["model"]["merges"]):
            a, b, whole = self.ids[left], self.ids[right], self.ids[left + right]
            self.merge.setdefault((a, b), rank)
            split.setdefault(whole, (rank, a, b))
        self.rights = self._spines(split, 2)
        self.lefts = self._spines(split, 1)
        self.automaton = ahocorasick.Automaton()
        for token, i in sorted(self.ids.items(), key=lambda x: x[1]):
            text = inner(token)
            if i not in split or self._apart_never(split[i]):
                self.automaton.add_word(text, (len(text), i))
        self.automaton.make_automaton()
        self.kept: dict[str, tuple[list[int], str, str]] = {}
        self.tested: dict[int, bool] = {}

    def _spines(self, split: dict[int, tuple[int, int, int]], side: int) -> dict[int, list[tuple[int, int]]]:
        """For each token the nodes of one outer edge of its merge tree, from the letter up, each with the rank of the merge above it."""
        spines = {}
        for token in self.ids.values():
            edge, above, at = [], NEVER, token
            while at in split:
                edge.append((at, above))
                above = split[at][0]
                at = split[at][side]
            edge.append((at, above))
            spines[token] = edge[::-1]
        return spines

    def _apart_never(self, made: tuple[int, int, int]) -> bool:
        """A token is ever emitted only if its two halves meet unmerged until their own merge."""
        rank, a, b = made
        return self.compatible(a, b, rank)

    def compatible(self, left: int, right: int, until: int = NEVER) -> bool:
        """Do two neighbours stay apart (until the merge of rank ``until``)?

        Both merge trees grow letter by letter in order of rank, of equal ranks the left one first.  The pair at the border
        would be merged if its rank came before the next event on either side."""
        edge, other = self.rights[left], self.lefts[right]
        i = j = 0
        while True:
            a, up_a = edge[i]
            b, up_b = other[j]
            pair = self.merge.get((a, b), NEVER)
            if pair < until and pair < up_a and pair <= up_b:
                return False
            if up_a == NEVER and up_b == NEVER:
                return True
            if up_a <= up_b:
                i += 1
            else:
                j += 1

    def encode_word(self, word: str) -> list[int]:
        text = word.encode("utf-8").decode("latin-1").translate(self.letters) + END
        last, back, tested = [-1] * (len(text) + 1), [0] * (len(text) + 1), self.tested
        for at, (length, token) in self.automaton.iter(text):
            if last[at + 1] >= 0:
                continue
            start = at + 1 - length
            if start:
                before = last[start]
                if before < 0:
                    continue
                apart = tested.get(pair := before << 20 | token)
                if apart is None:
                    if len(tested) >= PAIRS_KEPT:
                        tested.clear()
                    apart = tested[pair] = self.compatible(before, token)
                if not apart:
                    continue
            last[at + 1], back[at + 1] = token, start
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at = back[at]
        return ids[::-1]

    def known(self, word: str) -> tuple[list[int], str, str]:
        """Ids, the ids as text and the tokens as text."""
        found = self.kept.get(word)
        if found is None:
            ids = self.encode_word(word)
            found = ids, " ".join(map(str, ids)), " ".join(self.names[i] for i in ids)
            if len(self.kept) >= WORDS_KEPT:
                self.kept.clear()
            if len(word) <= 64:
                self.kept[word] = found
        return found

    def words(self, text: str) -> Iterator[str]:
        """Words after normalisation; special tokens come as they are."""
        for k, part in enumerate(self.borders.split(text) if self.borders else [text]):
            if k % 2:
                yield part
            elif part:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                yield from self.word.findall(part.lower())

    def pieces(self, text: str) -> list[tuple[list[int], str, str]]:
        special, known = self.special, self.known
        return [([special[w]], str(special[w]), w) if w in special else known(w) for w in self.words(text)]

    def encode(self, text: str) -> list[int]:
        return [i for ids, _, _ in self.pieces(text) for i in ids]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary names no decoder, so tokens are joined by spaces, word ends and special tokens included."""
        return " ".join(self.names[i] for i in ids if i in self.names)


@lru_cache(maxsize=2)
def load(path: str) -> PrefixBpe:
    return PrefixBpe(path)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of ``docs``; the vocabulary file must be on every worker.

    Null and empty texts have no tokens and the digests of the empty string.  Repeated rows give repeated results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bpe = load(path)
        for batch in batches:
            counts, ids_digest, text_digest = [], [], []
            for text in batch.column(1):
                found = bpe.pieces(text.as_py())
                counts.append(sum(len(ids) for ids, _, _ in found))
                ids_digest.append(sha256(" ".join([x[1] for x in found]).encode()).hexdigest())
                text_digest.append(sha256(" ".join([x[2] for x in found]).encode()).hexdigest())
            yield {"doc_id": batch.column(0), "n_tokens": counts, "ids_sha256": ids_digest, "decoded_sha256": text_digest}

    return map_batches(documents(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bpe = load(path)
        for batch in batches:
            yield {"doc_id": batch.column(0), "ids": [bpe.encode(t.as_py()) for t in batch.column(1)]}

    return map_batches(documents(docs, id_col, text_col), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from ``encode``'s rows; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bpe = load(path)
        for batch in batches:
            yield {"doc_id": batch.column(0), "text": [bpe.decode(x.as_py() or []) for x in batch.column(1)]}

    return map_batches(encoded.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{ids_col}` as array<int>) ids"), run, "doc_id long, text string")
