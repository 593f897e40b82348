"""Secret scans with corpus-wide ownership frequency.

Regular expressions give candidate spans.  Hashes of the candidate values are counted by distinct repositories and owners over the whole
corpus: a value that many owners hold is a widely copied example, one that stays with few is live-looking.  Long mixed tokens
without a telling key name are added as spans only where the counts call them live-looking.  All of it is DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import documents

#: The base patterns.  Access keys and hex runs are maximal, so their least length can stand in the pattern; an
#: assignment with a short value still uses up its text and is dropped afterwards.
KINDS = ("assign", "access", "hex", "token")
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: The added kind: maximal runs of so many token characters, with a digit, a capital and a small letter.
TOKEN = r"[A-Za-z0-9+/_=-]{24,}"
ASSIGN_CHARS = 6
#: A value held by more owners than this is an example; by no more, live-looking.
OWNERS_MAX = 2
MASK = "[REDACTED]"


def _matches(text: Column, pattern: str, kind: int, group: bool = False) -> Column:
    """Array of (start, end, kind, value) in code points; the pieces between matches give the places."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(2)) if group else found
    gaps = F.split(text, pattern, -1)
    sizes = F.transform(found, lambda m, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("size")))
    begin = F.struct(F.lit(0).alias("end"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))
    placed = F.aggregate(sizes, begin, lambda acc, s: F.struct(
        (acc["end"] + s["gap"] + s["size"]).alias("end"),
        F.concat(acc["spans"], F.array(F.struct((acc["end"] + s["gap"]).alias("start"), (acc["end"] + s["gap"] + s["size"]).alias("end")))).alias("spans")), lambda acc: acc["spans"])
    joined = F.zip_with(placed, values, lambda p, v: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.lit(kind).alias("kind"), v.alias("value")))
    none = F.expr("cast(array() as array<struct<start:int,end:int,kind:int,value:string>>)")
    return F.when(text.rlike(pattern), joined).otherwise(none)


def candidates(text: Column) -> tuple[Column, Column]:
    """Arrays of the base matches and of mixed tokens."""
    assign = F.filter(_matches(text, ASSIGN, 0, group=True), lambda m: F.length(m["value"]) >= ASSIGN_CHARS)
    base = F.concat(assign, _matches(text, ACCESS, 1), _matches(text, HEX, 2))
    mixed = lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Z]") & m["value"].rlike("[a-z]")
    return base, F.filter(_matches(text, TOKEN, 3), mixed)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source", repo_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """(doc_id, text_hash, base, spans): spans are arrays of (start, end, kind, value, owners, repos, live), sorted.

    One row for each distinct (doc_id, text), so repeated rows share theirs; null texts are empty and have none; a null owner is an owner.
    ``base`` are the regular expressions' own spans; ``spans`` also has tokens that are live-looking, those that an access key or hex run covers
    in part among them."""
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit("")) if owner_col else F.lit("")
    repo = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repo_cols]) if repo_cols else F.lit("")
    rows = documents(docs, id_col, text_col, owner.alias("owner"), repo.alias("repo"))
    base, tokens = candidates(F.col("text"))
    rows = rows.select("doc_id", "owner", "repo", F.xxhash64("text").alias("text_hash"), base.alias("base"), tokens.alias("tokens"))
    # An assignment holds the whole value, and what a token has before it is the key's name; a key or hex run may be the middle of a token.
    held = lambda t, b: (b["kind"] == 0) | ((b["start"] <= t["start"]) & (t["end"] <= b["end"]))
    apart = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]) & held(t, b)))
    rows = rows.select("doc_id", "owner", "repo", "text_hash", F.explode(F.concat("base", apart)).alias("m"))
    rows = rows.select("doc_id", "owner", "repo", "text_hash", "m.*", F.sha2(F.col("m.value"), 256).alias("value_hash"))
    found = stage(rows, "secret-candidates")
    holders = found.select("value_hash", "owner", "repo").distinct()
    counts = holders.groupBy("value_hash").agg(F.count_distinct("owner").alias("owners"), F.count("*").alias("repos"))
    known = found.select("doc_id", "text_hash", "start", "end", "kind", "value", "value_hash").distinct().join(counts, "value_hash")
    span = F.struct("start", "end", "kind", "value", "owners", "repos", (F.col("owners") <= OWNERS_MAX).alias("live"))
    kept = known.filter((F.col("kind") < 3) | (F.col("owners") <= OWNERS_MAX))
    spans = kept.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    return spans.select("doc_id", "text_hash", F.filter("spans", lambda s: s["kind"] < 3).alias("base"), "spans")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source", repo_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example."""
    found = scan(docs, id_col, text_col, owner_col, repo_cols).alias("s")
    rows = documents(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_hash")).alias("d")
    rows = rows.join(found, F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.text_hash") == F.col("s.text_hash")), "left")
    none = F.expr("cast(array() as array<struct<start:int,end:int,kind:int,value:string,owners:bigint,repos:bigint,live:boolean>>)")
    rows = rows.select("d.doc_id", F.coalesce("s.base", none).alias("base"), F.coalesce("s.spans", none).alias("spans"))
    count = lambda column, test: F.size(F.filter(column, test)).cast("long")
    of = lambda kind: lambda s: s["kind"] == kind
    return rows.select(
        "doc_id", *[count("base", of(k)).alias(f"n_{KINDS[k]}") for k in range(3)], F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"), count("spans", lambda s: s["live"]).alias("n_live"), count("spans", lambda s: ~s["live"]).alias("n_example"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source", repo_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """``docs`` with every span of ``scan`` replaced by a mark, other columns as they are; overlapping spans become one mark."""
    found = scan(docs, id_col, text_col, owner_col, repo_cols).select(F.col("doc_id").alias("__key_id"), F.col("text_hash").alias("__hash"), F.col("spans").alias("__spans"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # The same join at every size: documents with spans grow with the corpus, so they are never broadcast.
    rows = docs.join(found.hint("merge"), F.col(id_col).cast("long").eqNullSafe(F.col("__key_id")) & (F.xxhash64(text) == F.col("__hash")), "left")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cut = F.aggregate("__spans", begin, lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASK))).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return rows.withColumn(text_col, F.when(F.col("__spans").isNotNull(), cut).otherwise(F.col(text_col))).drop("__key_id", "__hash", "__spans")
