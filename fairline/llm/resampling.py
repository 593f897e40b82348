"""Importance resampling towards a target distribution.

A batch's texts are joined with a separator that no UTF-8 text holds; one regex pass over the joined bytes finds all words and the
separators, whose places are the documents' offsets.  Runs that would cross an offset are masked by a binary search, and the CRC-32 of a
run follows from those of its words by shift tables, so a bucket costs a few array operations.  The corpus-wide counts are 10 000
numbers; weights, scores and the draw stay in Spark."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import documents, map_batches

BUCKETS = 10_000
WIDTH = 3
#: Bytes of text taken apart at a time; a longer text is taken alone.
PIECE = 1 << 21
SEPARATOR = b"\xff"
_WORDS = re.compile(rb"[0-9a-z\x80-\xfe]+|\xff")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Words up to so many bytes shift by table.
TABLE = 256


def _shift_tables() -> np.ndarray:
    """[n, k, b]: the CRC register whose k-th byte is b, after n zero bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    tables = np.empty((TABLE + 1, 4, 256), np.uint32)
    tables[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(TABLE):
        tables[n + 1] = (tables[n] >> 8) ^ step[tables[n] & 255]
    return tables


_SHIFT = _shift_tables()


def _append(crc: np.ndarray, tail: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of texts with ``crc`` followed by texts of ``size`` bytes with CRC-32 ``tail``."""
    out = tail.copy()
    for k in range(4):
        out ^= _SHIFT[size, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def features(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words in each text, text of each run, CRC-32 of each run) for all runs of 1 to ``width`` words of the lower-cased texts."""
    found = _WORDS.findall(SEPARATOR.join(texts).translate(_LOWER))
    number: dict[bytes, int] = {SEPARATOR: 0}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, len(found))
    vocabulary = list(number)
    plain = np.array([zlib.crc32(w) for w in vocabulary], np.uint32)
    spaced = np.array([zlib.crc32(b" " + w) for w in vocabulary], np.uint32)
    size = np.array([len(w) + 1 for w in vocabulary], np.int64)
    ends = np.append(np.flatnonzero(ids == 0), len(ids))
    ids, offsets = ids[ids != 0], ends - np.arange(len(ends))
    text = np.searchsorted(offsets, np.arange(len(ids)), "right")
    crc = plain[ids]
    owners, values = [text], [crc]
    for n in range(1, width):
        first = np.arange(max(len(ids) - n, 0))
        first = first[text[first] == text[first + n]]
        last = ids[first + n]
        run = _append(crc[first], spaced[last], np.minimum(size[last], TABLE))
        for i in np.flatnonzero(size[last] > TABLE):
            run[i] = zlib.crc32(b" ".join(vocabulary[w] for w in ids[first[i] : first[i] + n + 1]))
        crc = np.zeros(len(ids), np.uint32)
        crc[first] = run
        owners.append(text[first])
        values.append(run)
    return np.diff(offsets, prepend=0), np.concatenate(owners), np.concatenate(values)


def _pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with the bytes of their texts, some PIECE bytes at a time."""
    for batch in batches:
        row = 0
        while row < batch.num_rows:
            texts, held, start = [], 0, row
            while row < batch.num_rows and (not texts or held < PIECE):
                texts.append(batch.column(column)[row].as_buffer().to_pybytes())
                held += len(texts[-1])
                row += 1
            yield batch.slice(start, row - start), texts


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, width: int = WIDTH) -> DataFrame:
    """(bucket, n): how many features of all texts fall in each bucket; buckets without any have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros(buckets, np.int64)
        for _, texts in _pieces(batches, 0):
            total += np.bincount(features(texts, width)[2] % buckets, minlength=buckets)
        held = np.flatnonzero(total)
        yield {"bucket": held, "n": total[held]}

    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return map_batches(texts, run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_text_col: str = "text", buckets: int = BUCKETS, width: int = WIDTH) -> DataFrame:
    """(bucket, gain) for every bucket: floor(1000 ln) of the smoothed target share over the smoothed share in ``docs``."""
    held = [stage(bucket_counts(t, c, buckets, width), "resample-counts") for t, c in ((docs, text_col), (target, target_text_col))]
    all_n, target_n = (F.lit(float(t.agg(F.sum("n")).first()[0] or 0)) for t in held)
    rows = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    for name, t in zip(("s", "t"), held):
        rows = rows.join(t.withColumnRenamed("n", name), "bucket", "left").fillna(0, [name])
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = ((t + 1) * (all_n + buckets)) / ((s + 1) * (target_n + buckets))
    return rows.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weights(docs: DataFrame, gain: list[int], id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_features, weight) for each row: the sum of the gains of a text's features, none: 0."""
    table = np.array(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for rows, texts in _pieces(batches, 1):
            words, owner, crc = features(texts, width)
            total = np.zeros(len(texts), np.int64)
            np.add.at(total, owner, table[crc % len(table)])
            yield {"doc_id": rows.column(0), "n_words": words, "n_features": np.bincount(owner, minlength=len(texts)), "weight": total}

    return map_batches(documents(docs, id_col, text_col), run, "doc_id long, n_words long, n_features long, weight long")


def noise(key: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u uniform from the first eight hex digits of SHA-256 of ``seed:key``."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(u)))


def ranked(rows: DataFrame, drawn: int, *order: Column) -> DataFrame:
    """The first ``drawn`` rows in an order without ties, and their ``rank``.

    Rows are dealt out by ranges of the order; each range ranks its own rows and adds the sizes of the ranges before."""
    parts = stage(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "resample-ranges")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each range, so this window is as small as the list of partitions.
    held = parts.join(sizes.withColumn("before", before).filter(F.col("before") < drawn), "part")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return held.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= drawn).drop("part", "n", "before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank), a row for each row of ``docs``; rows that are not drawn have no rank.

    Of the N rows with ``least_words`` words or more, the ``percent`` in a hundred (rounded down) with the highest scores are drawn,
    ties to the smaller doc_id (a null one last).  Rows of one doc_id have the same noise; equal rows are drawn one by one.  Null and
    empty texts have no features and weight 0; an empty target, or empty documents, give valid gains and no draw."""
    gain = [r.gain for r in gains(docs, target, text_col, target_text_col, buckets, width).orderBy("bucket").collect()]
    rows = weights(docs, gain, id_col, text_col, width)
    rows = stage(rows.select("*", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), F.monotonically_increasing_id().alias("place")), "resample-scores")
    able = rows.filter(F.col("n_words") >= least_words).select("doc_id", "score", "place")
    drawn = percent * able.count() // 100
    first = ranked(able, drawn, F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("place")).select("place", "rank")
    return rows.join(first, "place", "left").drop("place")
