"""Phrase collocations by Rabin-Karp fingerprints.

Every task takes its texts apart in numpy: word values and prefix polynomials give a 64-bit fingerprint for each run of words.  Level by
level (words, pairs, then longer runs) fingerprints are counted in the task, shuffled and summed; a run takes part only if its shorter runs
may be frequent, which a bitmap of fixed size tells.  The last pass carries the text and a pointer to the first occurrence of each run whose
fingerprint is frequent, and counts by text: runs that share a fingerprint come apart there, so the counts are exact."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from . import hashing
from .common import documents, map_batches

WIDTH = 4
LEAST = 30
COVER = 80
SCALE = 2_000_000
TOP = 2_000
#: Bytes of text taken apart at a time.
PIECE = 1 << 20
#: Fingerprints a task counts before it hands them over.
HELD = 1 << 22
#: Bits of the bitmap of frequent fingerprints, 2^26: 8 MB whatever the corpus.  A full one only lets more runs through.
BITS = 26
#: Bytes of text whose phrases are counted together in the last pass.
TEXT = 1 << 22
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ENDS = np.zeros(256, bool)
_ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAPS = _ENDS.copy()
_GAPS[list(b" \t")] = True


def _lang(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("und"))


class _Taken:
    """Words and runs of a chunk of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        self.data = data
        self.starts, self.ends = hashing.spans(~_GAPS[data], offsets)
        self.row = np.searchsorted(offsets, self.starts, "right") - 1
        # A word's piece: the texts and the ends of pieces before it.
        self.piece = np.cumsum(_ENDS[data])[self.starts] + self.row if len(self.starts) else self.starts
        self.runs = hashing.Runs(hashing.word_values(data, self.starts, self.ends))
        self.seed = langs[self.row]

    def whole(self, size: int) -> np.ndarray:
        """First words of all runs of ``size`` words inside a piece."""
        first = np.arange(max(len(self.starts) - size + 1, 0))
        return first[self.piece[first] == self.piece[first + size - 1]]

    def values(self, first: np.ndarray, size: int) -> np.ndarray:
        """Fingerprints of runs, different in each language."""
        return hashing.mix(self.runs.values(first, size) ^ self.seed[first])


def _taken(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, int, np.ndarray, _Taken]]:
    """(first row, byte in it, offsets, words) of the chunks of a batch (text, lang seed, ...)."""
    seeds = batch.column(1).to_numpy().view(np.uint64)
    for row, at, data, offsets in hashing.chunks(batch.column(0), size, _ENDS):
        yield row, at, offsets, _Taken(data, offsets, seeds[row : row + len(offsets) - 1])


def _texts(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    lang = _lang(lang_col)
    return documents(docs, id_col, text_col, lang.alias("lang")).select("text", F.xxhash64("lang").alias("seed"), "lang", "doc_id")


def _admitted(taken: _Taken, size: int, bitmap: Broadcast | None, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """(first words, fingerprints) of the runs of ``size`` words whose shorter runs in the bitmap may be frequent."""
    first = taken.whole(size)
    if bitmap is not None and size > 1:
        shorter = min(size - 1, 2)
        whole = taken.whole(shorter)
        may = np.zeros(len(taken.starts) + 1, bool)
        may[whole] = hashing.in_bitmap(bitmap.value, taken.values(whole, shorter) & np.uint64(mask))
        for k in range(size - shorter + 1):
            first = first[may[first + k]]
    return first, taken.values(first, size) & np.uint64(mask)


def fingerprint_counts(texts: DataFrame, sizes: tuple[int, ...], bitmap: Broadcast | None, mask: int) -> DataFrame:
    """(fp, n): occurrences of each fingerprint of the runs of the given sizes."""

    def count(held: list[np.ndarray]) -> dict:
        values, n = np.unique(np.concatenate(held), return_counts=True)
        return {"fp": values.view(np.int64), "n": n}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, size = [], 0
        for batch in batches:
            for *_, taken in _taken(batch, PIECE):
                for words in sizes:
                    held.append(_admitted(taken, words, bitmap, mask)[1])
                    size += len(held[-1])
                if size >= HELD:
                    yield count(held)
                    held, size = [], 0
        if size:
            yield count(held)

    return map_batches(texts.select("text", "seed"), run, "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n"))


def frequent_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: int = LEAST, width: int = WIDTH, mask: int = (1 << 64) - 1) -> DataFrame:
    """(lang, phrase, words, n, doc_id, start): runs of 1 to ``width`` words inside pieces, ``least`` times or more, with the document and
    the byte of an occurrence.  ``mask`` leaves out bits of the fingerprints; the result does not depend on it."""
    spark, texts = docs.sparkSession, _texts(docs, id_col, text_col, lang_col)
    kept, bitmap = None, None
    for level in ((1,), (2,), tuple(range(3, width + 1))):
        sizes = tuple(n for n in level if n <= width)
        if not sizes:
            continue
        counts = fingerprint_counts(texts, sizes, bitmap, mask)
        now = stage(counts.filter(F.col("n") >= least).select("fp"), "phrases-frequent")
        kept = now if kept is None else kept.unionByName(now)
        bitmap = spark.sparkContext.broadcast(hashing.bitmap(kept, "fp", BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row, at, offsets, taken in _taken(batch, TEXT):
                words, ids = _words(taken)
                langs, owners = batch.column(2).slice(row, len(offsets) - 1), batch.column(3).slice(row, len(offsets) - 1)
                base = np.append(at, -offsets[1:-1])
                for size in range(1, width + 1):
                    first, values = _admitted(taken, size, bitmap, mask)
                    may = hashing.in_bitmap(bitmap.value, values)
                    first, n = _counted(first[may], values[may], ids, taken.seed, size)
                    text = [words[i] for i in first.tolist()] if size == 1 else [b" ".join(words[i : i + size]) for i in first.tolist()]
                    place = taken.row[first]
                    yield {
                        "lang": langs.take(pa.array(place)), "phrase": pa.array(text, pa.binary()).cast(pa.string()), "words": np.full(len(first), size), "n": n,
                        "doc_id": owners.take(pa.array(place)), "start": taken.starts[first] + base[place]}
                place, n = np.unique(taken.row, return_counts=True)
                none = [None] * len(place)
                yield {"lang": langs.take(pa.array(place)), "phrase": [""] * len(place), "words": np.zeros(len(place), int), "n": n, "doc_id": none, "start": none}

    rows = map_batches(texts, run, "lang string, phrase string, words int, n long, doc_id long, start long")
    # Both parts of the pointer come from the same row.
    rows = rows.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"), F.first("doc_id").alias("doc_id"), F.first("start").alias("start"))
    return rows.filter((F.col("n") >= least) | (F.col("words") == 0))


def _words(taken: _Taken) -> tuple[list[bytes], np.ndarray]:
    """The words' bytes, A-Z in lower case, and a number for each that equal bytes share."""
    text = taken.data.tobytes().translate(_LOWER)
    words = [text[a:b] for a, b in zip(taken.starts.tolist(), taken.ends.tolist())]
    number: dict[bytes, int] = {}
    return words, np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))


def _counted(first: np.ndarray, values: np.ndarray, words: np.ndarray, seed: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first words, counts) of runs: those of equal fingerprint, language and words are counted together."""
    _, lead, group, n = np.unique(values, return_index=True, return_inverse=True, return_counts=True)
    leader = first[lead][group]
    same = seed[first] == seed[leader]
    for k in range(size):
        same &= words[first + k] == words[leader + k]
    other = first[~same]
    return np.append(first[lead], other), np.append(n if not len(other) else np.bincount(group[same], minlength=len(lead)), np.ones(len(other), np.int64))


def _part(column: str, first: Column, size: Column) -> Column:
    return F.array_join(F.slice(F.split(column, " "), first, size), " ")


def scored(runs: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, k, l, r, score, doc_id, start) for each run of two words or more in ``runs``: its lowest-scoring cut."""
    pair = F.col("words") >= 2
    cuts = runs.filter(pair).withColumnRenamed("n", "a").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"left": _part("phrase", F.lit(1), F.col("k")), "right": _part("phrase", F.col("k") + 1, F.col("words") - F.col("k"))})
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(runs.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    score = F.expr(f"(cast(a as decimal(20, 0)) * {SCALE}) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "phrase", "words", "a", "doc_id", "start").agg(best).select("lang", "phrase", "words", "a", "cut.k", "cut.l", "cut.r", "cut.score", "doc_id", "start")


def covering(runs: DataFrame) -> DataFrame:
    """(lang, phrase, most): for runs inside longer ones, the count of the most frequent longer run."""
    longer = runs.filter(F.col("words") >= 3).withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    return longer.select("lang", _part("phrase", F.col("at"), F.col("size")).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("most"))


def collocations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: int = LEAST, cover: int = COVER, top: int = TOP, width: int = WIDTH, mask: int = (1 << 64) - 1) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, doc_id, start): each language's ``top`` phrases of 2 to ``width`` words.

    ``a`` counts a phrase (``least`` or more), ``l`` and ``r`` the parts of its lowest-scoring cut, ``n`` all words of the language; phrases
    that a longer one covers in ``cover`` of a hundred cases are left out.  (doc_id, start) points to an occurrence, in bytes of the text.
    A null language is ``und``, a null or empty text has no words; ties go by count, then phrase; repeated rows count as often as they
    stand; a table without frequent phrases gives no rows.  Memory grows with the longest piece between two of ``.,;:!?`` or line ends."""
    runs = stage(frequent_runs(docs, id_col, text_col, lang_col, least, width, mask), "phrases-runs")
    total = runs.filter("words = 0").select("lang", F.col("n"))
    runs = runs.filter("words > 0")
    rows = scored(runs).join(covering(runs), ["lang", "phrase"], "left")
    number = lambda c: F.col(c).cast("decimal(20,0)")
    rows = rows.filter(F.col("most").isNull() | (100 * number("most") < cover * number("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = rows.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "doc_id", "start")
