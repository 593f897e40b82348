"""Substring dedup by MinHash banding of paragraphs.

Equal paragraphs become one node first.  Paragraphs that collide in a band meet in a bucket, and buckets with the same members are
looked at once.  In a bucket, paragraphs are compared exactly until those that belong together hang together; pairs that already do are
not compared, so a bucket of n variants gives n links, not n^2.  A large bucket is cut into chunks and every pair of chunks goes to a
task of its own.  Of each component the first occurrence stays.

Passages are the finer unit: runs of ``PASSAGE`` words that also stand in an earlier document, wherever lines begin.  Every run picks one
window of ``SEED`` words by hashes of its own words alone, so equal runs pick equal windows.  Consecutive runs that pick the same window are a
block.  Only windows of several documents go on.  A block that an earlier document has as a whole goes as a whole; where a window has different
blocks, the first document with each block lists its runs one by one, and runs that an earlier document lists go.  Runs are told apart by
64-bit values within equal windows; spans that hang together become one.

A document is a (doc_id, hash of the text), so rows that share a doc_id stay apart; rows alike in both are one document."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import stage
from .common import documents, map_batches, star_components
from .hashing import Runs, chunks, spans, word_values

#: Words of a shingle and of the shortest paragraph that takes part; least Jaccard similarity.
WIDTH, SIMILARITY = 5, 0.8
#: At similarity 0.8 a pair meets in one of eight bands of three rows with probability 0.997; at 0.3 with 0.2.
BANDS, ROWS = 8, 3
#: Paragraphs of a bucket that one task compares.
CHUNK = 2_000
#: Text that is taken apart at a time.
PIECE_BYTES = 1 << 20
#: Words of a passage that is found inside different lines, and of the windows that bring its occurrences together.
PASSAGE, SEED = 50, 25
_rng = np.random.default_rng(11)
_MULTIPLY = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEED_PLACE = _rng.integers(1, 1 << 63, SEED, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Places that keys are counted in before a join, and tasks that the rows of a place far above the mean are dealt to.
SLOTS, SALTS = 1 << 16, 64
_INSIDE = np.ones(256, bool)
_INSIDE[[9, 10, 11, 12, 13, 32]] = False


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def split(text: str) -> list[tuple[int, int, list[bytes]]]:
    """(position, words before it, words) of the paragraphs, lines, with words enough; A-Z in lower case."""
    lines = [line.split() for line in text.encode("utf-8", "surrogatepass").lower().split(b"\n")]
    return [(k, at, w) for k, (at, w) in enumerate(zip(accumulate(map(len, lines), initial=0), lines)) if len(w) >= WIDTH]


def word_hashes(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    return word_values(np.frombuffer(b" ".join(words), np.uint8), np.r_[0, ends[:-1] + 1], ends)


def picks(word: np.ndarray, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, first runs, last runs), all as starts, for texts of so many words: every run of ``PASSAGE`` words of a text picks the window of
    ``SEED`` with the smallest hash, the first of equal ones; the runs that pick a window follow one another."""
    ends = np.cumsum([len(word)] if sizes is None else sizes)
    count, reach = len(word) - PASSAGE + 1, PASSAGE - SEED + 1
    if count <= 0:
        return (np.zeros(0, np.int64),) * 3
    h = np.zeros(len(word) - SEED + 1, np.uint64)
    mixed = _mix(word)
    for k in range(SEED):
        h += mixed[k : len(h) + k] * _SEED_PLACE[k]
    h = _mix(h)
    best = np.arange(len(h))
    span = 1
    while span * 2 <= reach:
        best = np.where(h[best[span:]] < h[best[:-span]], best[span:], best[:-span])
        span *= 2
    left, right = best[:count], best[reach - span : reach - span + count]
    whole = np.arange(count) + PASSAGE <= ends[np.searchsorted(ends, np.arange(count), "right")]
    run = np.flatnonzero(whole)
    window, first, many = np.unique(np.where(h[right] < h[left], right, left)[run], return_index=True, return_counts=True)
    return window, run[first], run[first] + many - 1


def seeds(word: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """Starts of the windows picked in texts of so many words."""
    return picks(word, sizes)[0]


def _pieces(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, as texts in words take many times their size."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)) // PIECE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def shingles(paragraphs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of paragraphs of ``WIDTH`` words or more, and where each paragraph's begin."""
    sizes = np.array([len(p) for p in paragraphs], np.int64)
    word = word_hashes([w for p in paragraphs for w in p])
    hashes = np.zeros(len(word) - WIDTH + 1, np.uint64)
    for k in range(WIDTH):
        hashes += _mix(word[k : len(word) - WIDTH + 1 + k]) * _PLACE[k]
    ends = np.cumsum(sizes)
    inside = np.ones(len(hashes), bool)
    inside[(ends[:-1, None] - np.arange(1, WIDTH)).ravel()] = False
    return _mix(hashes)[inside], np.r_[0, np.cumsum(sizes - WIDTH + 1)[:-1]]


def bands(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Band keys, a row for each paragraph."""
    keys = np.zeros((len(starts), BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        keys[:, k // ROWS] = _mix(keys[:, k // ROWS] ^ np.minimum.reduceat(_mix(hashes * _MULTIPLY[k] + _ADD[k]), starts))
    return keys


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Is the exact Jaccard similarity of two sorted sets high enough?"""
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= SIMILARITY * (len(a) + len(b) - common) - 1e-9


def join_up(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect the same paragraphs as all similar pairs would."""
    groups: list[list[int]] = []
    links = []
    for i, own in enumerate(sets):
        met, apart = [i], []
        for group in groups:
            other = next((j for j in group if similar(own, sets[j])), None)
            if other is None:
                apart.append(group)
            else:
                links.append((other, i))
                met += group
        groups = [*apart, met]
    return links


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, t): t tells rows apart that share a doc_id."""
    return documents(docs, id_col, text_col, _text_key(text_col).alias("t"))


def _text_key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


_UNITS = "doc_id long, t long, pos int, at int, n_words int, ph binary, bands array<long>"


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, t, pos, at, n_words, ph, bands): paragraphs that take part, ``at`` words before them; ph is a 128-bit hash of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in _pieces(batches):
            rows, found = [], []
            for i, text in enumerate(batch.column(1)):
                own = split(text.as_py())
                rows += [i] * len(own)
                found += own
            if found:
                keys = bands(*shingles([w for *_, w in found])).view(np.int64)
                yield {
                    "doc_id": batch.column(0).take(pa.array(rows)), "t": batch.column(2).take(pa.array(rows)), "pos": [k for k, *_ in found], "at": [at for _, at, _ in found], "n_words": [len(w) for *_, w in found], "ph": [xxhash.xxh3_128_digest(b" ".join(w)) for *_, w in found],
                    "bands": pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), keys.ravel())}

    return map_batches(_keyed(docs, id_col, text_col), run, _UNITS)


def _contents(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(ph, shingles binary) of the paragraphs (doc_id, t, places) wanted, one occurrence each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in _pieces(batches, 0):
            hashes, sets = [], []
            for text, places in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                asked = {*places}
                for k, _, w in split(text.as_py()):
                    if k in asked:
                        hashes.append(xxhash.xxh3_128_digest(b" ".join(w)))
                        sets.append(np.unique(shingles([w])[0]).tobytes())
            yield {"ph": hashes, "shingles": sets}

    # Here and below the other side grows with the corpus, so it is joined in one way at every size.
    texts = _keyed(docs, id_col, text_col).join(wanted.hint("merge"), ["doc_id", "t"]).select("text", "places")
    return map_batches(texts, run, "ph binary, shingles binary").groupBy("ph").agg(F.first("shingles").alias("shingles"))


def links(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b): links between hashes of different paragraphs; ``found`` are the staged ``units``."""
    nodes = found.groupBy("ph").agg(F.min(F.struct("doc_id", "t", "pos")).alias("first"), F.first("bands").alias("bands"))
    nodes = stage(nodes, "paragraph-nodes")
    member = F.xxhash64("ph")
    rows = nodes.select(member.alias("m"), F.posexplode("bands").alias("band", "key"))
    buckets = rows.groupBy("band", "key").agg(F.count("*").alias("n"), F.expr("bit_xor(m)").alias("x"), F.expr("sum(cast(m as decimal(20, 0)))").alias("s")).filter("n > 1")
    buckets = stage(buckets.groupBy("n", "x", "s").agg(F.min(F.struct("band", "key")).alias("b")).select("n", "b.band", "b.key"), "paragraph-buckets")
    places = nodes.select("ph", "first", F.posexplode("bands").alias("band", "key")).join(buckets.hint("merge"), ["band", "key"])
    places = stage(places.select("ph", "first", "band", "key", "n"), "paragraph-members")
    wanted = places.filter("first.doc_id is not null").groupBy("first.doc_id", "first.t").agg(F.collect_set("first.pos").alias("places"))
    contents = _contents(docs, wanted, id_col, text_col)
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("ph"), chunks).cast("int")
    tasks = F.transform(F.sequence(F.lit(0), chunks - 1), lambda c: F.struct(F.least(own, c).alias("low"), F.greatest(own, c).alias("high")))
    members = places.select("ph", "band", "key", F.explode(tasks).alias("t")).join(contents.hint("merge"), "ph").select("ph", "shingles", "band", "key", "t.low", "t.high")
    schema = to_arrow_schema(StructType.fromDDL("a binary, b binary"))

    def compare(table: pa.Table) -> pa.Table:
        names = table["ph"].to_pylist()
        pairs = join_up([np.frombuffer(s.as_py(), np.uint64) for s in table["shingles"]])
        return pa.table([pa.array([names[i] for i, _ in pairs], pa.binary()), pa.array([names[j] for _, j in pairs], pa.binary())], schema=schema)

    return members.groupBy("band", "key", "low", "high").applyInArrow(compare, "a binary, b binary")


def _meet(rows: DataFrame, few: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Inner join of staged ``rows`` with ``few``, which has every key once.  Keys are counted in ``SLOTS`` slots; rows of slots far above the
    mean are dealt to ``SALTS`` tasks by the hash of ``by``, so no key stays in one task.  At most ``SLOTS`` numbers are broadcast."""
    slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS))
    counts = rows.groupBy(slot.alias("_slot")).agg(F.count("*").alias("n"))
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / SLOTS
    hot = F.broadcast(counts.filter(F.col("n") > 8 * mean + SALTS).select("_slot", F.lit(True).alias("_hot")))
    one, every = F.lit(0), F.sequence(F.lit(0), F.lit(SALTS - 1))
    dealt = rows.withColumn("_slot", slot).join(hot, "_slot", "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).otherwise(one))
    copies = few.withColumn("_slot", slot).join(hot, "_slot", "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(one))))
    return dealt.drop("_slot", "_hot").join(copies.drop("_slot", "_hot").hint("merge"), [*keys, "_salt"]).drop("_salt")


def _words_in(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, words of each row, values of all words) for rows of a string column, some ``PIECE_BYTES`` at a time."""
    for row, _, data, offsets in chunks(column, PIECE_BYTES):
        starts, ends = spans(_INSIDE[data], offsets)
        yield row, np.diff(np.searchsorted(starts, offsets)), word_values(data, starts, ends)


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, t, start, end, class_doc): words in runs of ``PASSAGE`` that an earlier document has, too; spans may overlap."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row, sizes, word in _words_in(batch.column(1)):
                window, first, last = picks(word, sizes)
                if len(window):
                    runs, ends = Runs(word), np.cumsum(sizes)
                    text = np.searchsorted(ends, window, "right")
                    before, rows = (ends - sizes)[text], pa.array(text + row)
                    # the window's place in the block is part of the block's value
                    block = runs.values(first, last - first + PASSAGE) + (window - first).astype(np.uint64)
                    yield {
                        "doc_id": batch.column(0).take(rows), "t": batch.column(2).take(rows), "first": first - before, "last": last - before,
                        "h": runs.values(window, SEED).view(np.int64), "b": block.view(np.int64)}

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            wanted = batch.column(3)
            for row, sizes, word in _words_in(batch.column(1)):
                runs, at = Runs(word), 0
                for k, size in enumerate(sizes.tolist(), row):
                    own = wanted[k].values
                    first, last, h = (own.field(name).to_numpy() for name in ("first", "last", "h"))
                    many = (last - first + 1).astype(np.int64)
                    start = np.repeat(first - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
                    same = pa.array(np.full(len(start), k))
                    yield {"doc_id": batch.column(0).take(same), "t": batch.column(2).take(same), "start": start, "h": np.repeat(h, many), "r": runs.values(at + start, PASSAGE).view(np.int64)}
                    at += size

    doc = F.struct("doc_id", "t")
    texts = _keyed(docs, id_col, text_col).filter("doc_id is not null")
    found = stage(map_batches(texts, pick, "doc_id long, t long, first int, last int, h long, b long"), "passage-windows")
    shared = found.groupBy("h").agg(F.min(doc).alias("low"), F.max(doc).alias("high"), (F.min("b") < F.max("b")).alias("several")).filter("low < high").select("h", "several")
    near = stage(_meet(found, shared, ["h"], ["doc_id", "t", "first"]), "passage-shared")
    lead = near.groupBy("h", "b").agg(F.min(doc).alias("lead"))
    near = stage(_meet(near, lead, ["h", "b"], ["doc_id", "t", "first"]), "passage-blocks")
    whole = near.filter(doc != F.col("lead")).select("doc_id", "t", F.col("first").alias("start"), (F.col("last") + PASSAGE).alias("end"), F.col("lead.doc_id").alias("class_doc"))
    wanted = near.filter(F.col("several") & (doc == F.col("lead"))).groupBy("doc_id", "t").agg(F.collect_set(F.struct("first", "last", "h")).alias("wanted"))
    texts = texts.join(wanted.hint("merge"), ["doc_id", "t"]).select("doc_id", "text", "t", "wanted")
    runs = stage(map_batches(texts, unfold, "doc_id long, t long, start int, h long, r long"), "passage-runs")
    lead = runs.groupBy("h", "r").agg(F.min(doc).alias("lead"), F.max(doc).alias("high")).filter("lead < high").select("h", "r", "lead")
    part = _meet(runs, lead, ["h", "r"], ["doc_id", "t", "start"]).filter(doc != F.col("lead"))
    return whole.unionByName(part.select("doc_id", "t", "start", (F.col("start") + PASSAGE).alias("end"), F.col("lead.doc_id").alias("class_doc")))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (start, end) in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def rest(spans: list[tuple[int, int]], lines: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What merged spans have outside merged lines, in pieces of ``WIDTH`` words or more."""
    out = []
    for start, end in spans:
        for a, b in [x for x in lines if x[0] < end and x[1] > start] + [(end, end)]:
            if a - start >= WIDTH:
                out.append((start, a))
            start = max(start, b)
    return out


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, t, removed, spans, words, class_docs): what repeats something earlier, a row for each document that has it, and the staged
    ``units``.  ``removed`` are positions of lines, ``spans`` what passages have outside them as (start, end) in words, ``words`` those in either."""
    found = stage(units(docs, id_col, text_col).filter("doc_id is not null"), "paragraph-units")
    group = star_components(links(docs, found, id_col, text_col), "paragraph-links").withColumnRenamed("node", "ph")
    exact = found.groupBy("ph").agg(F.min(F.struct("doc_id", "t", "pos")).alias("first"), F.count("*").alias("n"))
    exact = exact.join(group.hint("merge"), "ph", "left").filter("n > 1 or component is not null").withColumn("component", F.coalesce("component", "ph"))
    lead = exact.groupBy("component").agg(F.min("first").alias("lead"))
    known = stage(exact.join(lead, "component").select("ph", "lead"), "paragraph-leads")
    again = found.select("doc_id", "t", "pos", "at", "n_words", "ph").join(known.hint("merge"), "ph").filter(F.struct("doc_id", "t", "pos") != F.col("lead"))
    again = again.select("doc_id", "t", "pos", F.col("at").alias("start"), (F.col("at") + F.col("n_words")).alias("end"), F.col("lead.doc_id").alias("class_doc")).distinct()
    both = again.unionByName(passages(docs, id_col, text_col).withColumn("pos", F.lit(None).cast("int")))
    span, line = F.struct("start", "end"), F.col("pos").isNotNull()
    gone = both.groupBy("doc_id", "t").agg(
        F.array_sort(F.collect_list("pos")).alias("removed"), F.collect_list(F.when(line, span)).alias("lines"), F.collect_list(F.when(~line, span)).alias("spans"), F.array_sort(F.collect_set("class_doc")).alias("class_docs"))

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out = {"doc_id": batch.column(0), "t": batch.column(1), "removed": batch.column(2), "spans": [], "words": [], "class_docs": batch.column(5)}
            for lines, parts in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                lines, parts = (merged([(x["start"], x["end"]) for x in part]) for part in (lines, parts))
                parts = rest(parts, lines)
                out["spans"].append([{"start": a, "end": b} for a, b in parts])
                out["words"].append(sum(b - a for a, b in lines + parts))
            yield out

    return map_batches(gone, put_together, "doc_id long, t long, removed array<int>, spans array<struct<start: int, end: int>>, words long, class_docs array<long>"), found


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_paragraphs, n_compared, n_removed, words_removed, removed, class_docs, passages.

    ``removed`` lists the positions of lines that go, ``passages`` the words (start:end, counted over the text) in runs of ``PASSAGE`` words or
    more of an earlier document and stand outside those lines, in pieces of ``WIDTH`` words or more; ``words_removed`` counts both, ``class_docs``
    are earlier documents that hold it.  Lines of fewer than ``WIDTH`` words go only as part of such a piece; null and empty texts
    have nothing to remove.  A passage that only its own document repeats stays.  Rows that share doc_id and text are one document, other rows that share a doc_id are several; a row without one is left alone and not
    compared."""
    gone, found = removals(docs, id_col, text_col)
    compared = found.groupBy("doc_id", "t").agg(F.count_distinct("pos").alias("n_compared"))
    rows = _keyed(docs, id_col, text_col).select("doc_id", "t", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_paragraphs"))
    rows = rows.join(compared.hint("merge"), ["doc_id", "t"], "left").join(gone.hint("merge"), ["doc_id", "t"], "left")
    none = F.coalesce(F.size("removed"), F.lit(0))
    parts = F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return rows.select(
        "doc_id", "n_paragraphs", F.coalesce("n_compared", F.lit(0)).cast("long").alias("n_compared"), F.greatest(none, F.lit(0)).cast("long").alias("n_removed"), F.coalesce("words", F.lit(0)).cast("long").alias("words_removed"),
        F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed"), F.coalesce("class_docs", F.expr("cast(array() as array<bigint>)")).alias("class_docs"), F.coalesce(F.array_join(parts, ","), F.lit("")).alias("passages"))


_WORD = re.compile(rb"\S+")


def cut(text: str | None, removed: list[int] | None, spans: list[tuple[int, int]] | None) -> str | None:
    """The text without the lines ``removed`` and the words in ``spans``; lines of which nothing is left go as a whole."""
    if text is None or removed is None:
        return text
    gone, out, at = {*removed}, [], 0
    for k, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
        words = [m.start() for m in _WORD.finditer(line)]
        inside = [(max(a - at, 0), min(b - at, len(words))) for a, b in spans if a < at + len(words) and b > at]
        at += len(words)
        if k in gone or inside == [(0, len(words))]:
            continue
        for a, b in reversed(inside):
            line = line[: words[a]] + line[words[b] :] if b < len(words) else line[: words[a]].rstrip()
        out.append(line)
    return b"\n".join(out).decode("utf-8", "surrogatepass")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated paragraphs and passages cut out of the text, other columns as they are."""
    gone, _ = removals(docs, id_col, text_col)
    gone = gone.select(F.col("doc_id").alias("__doc"), F.col("t").alias("__t"), F.col("removed").alias("__gone"), F.col("spans").alias("__spans"))
    rows = docs.join(gone, (F.col(id_col).cast("long") == F.col("__doc")) & (_text_key(text_col) == F.col("__t")), "left")
    return rows.withColumn(text_col, F.udf(cut, "string", useArrow=False)(F.col(text_col), "__gone", "__spans")).drop("__doc", "__t", "__gone", "__spans")
