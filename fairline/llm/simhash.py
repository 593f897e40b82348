"""SimHash near-duplicates by segment bit counts.

A 64-bit fingerprint maps to its 32 two-bit segments' bit counts.  Flipping a bit changes one count by one, so the Manhattan
distance of the count vectors never exceeds the Hamming distance of the fingerprints.  Coordinates are cut into five blocks; vectors
at Manhattan distance two or less agree in at least three blocks, so ten grids, one for each choice of three blocks, bring every such
pair into one cell.  Cells are compared under the Manhattan bound first and then exactly."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import documents, map_batches, star_components

SEED = 42
SEGMENTS = 32
PIECE = 1 << 16


def fingerprint(text: str, width: int = 3) -> int:
    """Bit i is set where more than half of the shingles' XXH64 have it; no words: 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    rest = [words[i:] for i in range(1, width)]
    shingles = list(zip(words, *rest)) if len(words) >= width else [tuple(words)]
    ones = np.zeros(64, np.int64)
    hash_of, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, len(shingles), PIECE):
        hashes = np.fromiter((hash_of(join(s), SEED) for s in shingles[at : at + PIECE]), np.uint64)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp, h): a row for each row of ``docs``, fingerprint and text hash as signed 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64)
            yield {"doc_id": batch.column(0), "fp": fps.view(np.int64), "h": batch.column(2)}

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return map_batches(documents(docs, id_col, text_col, F.xxhash64(text).alias("h")), run, "doc_id long, fp long, h long")


def segment_counts(fp: Column) -> Column:
    """The bit counts of the 32 two-bit segments, each in its own two bits."""
    low = F.lit(0x5555555555555555)
    high = F.shiftrightunsigned(fp, 1)
    both, one = fp.bitwiseAND(high).bitwiseAND(low), fp.bitwiseXOR(high).bitwiseAND(low)
    return F.shiftleft(both, 1).bitwiseOR(one)


def manhattan(a: Column, b: Column) -> Column:
    """Distance of two count vectors packed by ``segment_counts``."""
    part = lambda x, i: F.shiftrightunsigned(x, 2 * i).bitwiseAND(F.lit(3))
    total = F.abs(part(a, 0) - part(b, 0))
    for i in range(1, SEGMENTS):
        total = total + F.abs(part(a, i) - part(b, i))
    return total


def _grids(bits: int) -> list[int]:
    """Masks over the packed counts: ``bits`` + 3 blocks, and all choices of three of them."""
    blocks = bits + 3
    edges = [SEGMENTS * i // blocks for i in range(blocks + 1)]
    block = [sum(3 << (2 * i) for i in range(a, b)) for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(block, 3)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """(a, b): pairs of different fingerprints at ``bits`` differing bits or fewer, from a table with distinct ``fp``."""
    cells = fps.select("fp", segment_counts(F.col("fp")).alias("counts")).select(
        "fp", "counts", F.posexplode(F.array(*[F.col("counts").bitwiseAND(F.lit(m)) for m in _grids(bits)])).alias("grid", "cell"))
    a, b = cells.alias("a"), cells.alias("b")
    same = (F.col("a.grid") == F.col("b.grid")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") < F.col("b.fp"))
    bound = manhattan(F.col("a.counts"), F.col("b.counts")) <= bits
    exact = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= bits
    return a.join(b, same & bound & exact).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 2, width: int = 3) -> DataFrame:
    """(doc_id, h, fp, fingerprint, component, component_id) for each row of ``docs``.

    Equal fingerprints are one node, so copies never meet each other in a join; ``component_id`` is the smallest doc_id reachable
    over links of ``bits`` differing bits or fewer.  Null or wordless texts have fingerprint zero and link like any other;
    repeated rows give repeated results; rows without a doc_id take part but never name a component unless all of it has none."""
    fps = stage(fingerprints(docs, id_col, text_col, width), "simhash")
    nodes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    group = star_components(links(nodes, bits), "simhash-links").withColumnRenamed("node", "fp")
    nodes = nodes.join(group, "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    owner = nodes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = nodes.join(owner, "component").select("fp", "component", "component_id")
    return fps.join(named, "fp").select("doc_id", "h", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 2, width: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns: of each component the one with the smallest doc_id (null last), then text hash.

    Of repeated rows one stays."""
    groups = near_duplicates(docs, id_col, text_col, bits, width)
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("k"))
    kept = stage(first.select(F.col("k.doc_id").alias("__key_id"), F.col("k.h").alias("__key_h")).distinct(), "simhash-kept")
    rows = docs.withColumns({"__key_id": F.col(id_col).cast("long"), "__key_h": F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    rows = rows.alias("a").join(kept.alias("b"), F.col("a.__key_id").eqNullSafe(F.col("b.__key_id")) & (F.col("a.__key_h") == F.col("b.__key_h")), "left_semi")
    place = F.row_number().over(Window.partitionBy("__key_id", "__key_h").orderBy(F.lit(1)))
    return rows.withColumn("__place", place).filter("__place = 1").drop("__key_id", "__key_h", "__place")
