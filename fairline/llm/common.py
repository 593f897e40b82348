"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """(doc_id, text, ...): only the named columns go on, so others may clash; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def lower_ascii(column: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(column, UPPER, LOWER)


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` for functions that yield dicts of equally long columns."""
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in function(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in kind], schema=kind)

    return df.mapInArrow(run, schema)


def star_components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) for edges (a, b): the smallest node reachable, for each node of an edge.

    Alternating large and small stars.  A round replaces every edge by one to the smallest known neighbour, so the number of
    edges never grows and the depth at least halves; rounds are written to the shared folder, nothing is collected."""
    ordered = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = stage(edges.filter(F.col("a") != F.col("b")).select(*ordered).distinct(), name)
    seen = None
    while True:
        sides = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = sides.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = stage(large, name)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.greatest("b", "m").alias("a"), "m").filter("a <> m").unionByName(least.select("a", "m")).withColumnRenamed("m", "b").distinct()
        now = stage(small, name)
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(cast(xxhash64(b, a) as decimal(20, 0)))")).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = state
