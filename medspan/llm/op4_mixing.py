"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Everything is DataFrame expressions.  Sizes are reduced to sums for each source and hash bucket, so that texts are
never shuffled.  Sources are ranked by a range partitioning with per-partition offsets (no single-task window), and the
water level is found by a few global sums.

A source's quota (its target, rounded) is ``whole`` repetitions of every document plus a remainder, which goes to
its documents in seeded hash order.  To avoid one ordered pass over a hot source, the order is cut into ``BUCKETS``
hash buckets: buckets before the one where the remainder runs out are taken in full, and only that bucket is
ordered row by row.  The last document there is taken in part, so each source meets its quota exactly.  The hash is MD5
of seed, id and text, and buckets are its leading bits, so the order is that of the hash alone, and rows of one id spread over buckets.

``mix`` gives one small row a document; ``mixed`` gives the documents themselves with what is taken of each.  Only rows of a source's last
bucket are moved for the latter, about one in ``BUCKETS``.

Defined results: a null text has size 0; null sources form one group, ranked last; rows with equal ids and sizes are
interchangeable; a text of any length is counted by one pass; an empty table gives an empty result; a source whose size is 0
takes nothing.  Repeated rows are counted each.  ``mix`` carries no other columns; in ``mixed`` result columns replace those of the same name, all others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medspan.llm.common import checkpointed, unused

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096
#: Source tables of up to so many rows are broadcast; larger ones are joined by a shuffle.
MAX_BROADCAST_SOURCES = 20_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with a global 0-based ``rank``, from a range partitioning and one offset for each partition."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    part, seq = unused(rows, "part"), unused(rows, "seq")
    numbered = checkpointed(dealt.withColumns({part: F.spark_partition_id(), seq: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    offsets, before = {}, 0
    for r in numbered.groupBy(part).agg(F.count("*").alias("n")).orderBy(part).collect():
        offsets[r[part]], before = before, before + r["n"]
    if not offsets:
        return numbered.withColumn("rank", F.lit(0).cast("long")).drop(part, seq)
    table = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])
    return numbered.withColumn("rank", F.element_at(table, F.col(part)) + F.col(seq)).drop(part, seq)


def water_fill(totals: DataFrame, cap: float = 3.0) -> DataFrame:
    """``totals`` (source, source_size, weight) with ``target``: shares of the sum by weight, at most ``cap`` times a source.

    The level ``l`` with ``target = min(cap * size, l * weight)`` rises with each round until no further source is clamped;
    a round is one global sum, and rounds are at most the number of sources.
    """
    limit, weight = F.lit(cap) * F.col("source_size"), F.col("weight")
    first = totals.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("w")).first()
    total, level, clamped = float(first["all"] or 0), 0.0, -1
    if first["w"]:
        level = total / first["w"]
    while True:
        over = limit <= F.lit(level) * weight
        r = totals.agg(F.count(F.when(over, 1)).alias("n"), F.coalesce(F.sum(F.when(over, limit)), F.lit(0.0)).alias("held"), F.coalesce(F.sum(F.when(~over, weight)), F.lit(0)).alias("w")).first()
        if r["n"] == clamped or not r["w"]:
            break
        clamped, level = r["n"], (total - r["held"]) / r["w"]
    return totals.withColumn("target", F.least(limit, F.lit(level) * weight).cast("double"))


def place(key: Column, text: Column, seed: str) -> list[Column]:
    """``at``, the place in the seeded order (the first 60 bits of MD5 over seed, id and text), and its leading bits, ``bucket``."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))
    at = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    return [at.alias("at"), F.shiftright(at, 60 - BUCKETS.bit_length() + 1).cast("int").alias("bucket")]


def sized(docs: DataFrame, seed: str, key: str, source: str, text: str) -> DataFrame:
    """(key, source, size, at, bucket) of every document."""
    return docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), *place(F.col(key), F.col(text), seed))


def plan_of(base: DataFrame, weights: tuple[int, ...], cap: int) -> tuple[DataFrame, bool]:
    """(source, source_size, target, whole, rest, edge, before) for each source, and whether the table is small."""
    sums = checkpointed(base.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    totals = ranked(sums.groupBy("source").agg(F.sum("words").alias("source_size")), [F.col("source").asc_nulls_last()])
    totals = totals.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))).drop("rank")
    small = totals.count() <= MAX_BROADCAST_SOURCES
    plan = water_fill(totals, float(cap)).withColumn("quota", F.round("target").cast("long"))
    plan = plan.withColumns({"whole": F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(0).cast("long")})
    plan = plan.withColumn("rest", F.col("quota") - F.col("whole") * F.col("source_size"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")
    edges = with_sources(sums, plan.select("source", "rest"), "source", small).withColumn("before", before)
    edges = edges.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest"))).select("source", F.col("bucket").alias("edge"), "before")
    return checkpointed(with_sources(plan, edges, "source", small, "left").drop("weight", "quota")), small


def with_sources(rows: DataFrame, table: DataFrame, source: str, small: bool, how: str = "inner") -> DataFrame:
    """``rows`` joined to a table of sources, null to null."""
    other = unused(rows, "of_source")
    table = table.withColumnRenamed("source", other)
    table = F.broadcast(table) if small else table
    return rows.join(table, rows[source].eqNullSafe(table[other]), how).drop(other)


def taken_of(rows: DataFrame, size: Column, plan: DataFrame, small: bool) -> DataFrame:
    """``rows`` (with key, source, at, bucket) with ``size``, the columns of ``plan`` and ``taken``; only rows of an edge bucket are shuffled."""
    rows = with_sources(rows, plan, "source", small)
    edge = F.col("bucket") == F.coalesce(F.col("edge"), F.lit(-1))
    sure = rows.where(~edge).withColumn("size", size).withColumn("extra", F.when(F.col("bucket") < F.coalesce(F.col("edge"), F.lit(-1)), F.col("size")).otherwise(0))
    order = Window.partitionBy("source", "bucket").orderBy("at", "key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    split = rows.where(edge).withColumn("size", size).withColumn("upto", F.sum("size").over(order) - F.col("size"))
    split = split.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.col("upto")))).drop("upto")
    done = sure.unionByName(split)
    return done.withColumn("taken", (F.col("whole") * F.col("size") + F.col("extra")).cast("long")).drop("edge", "before", "rest", "extra", "at", "bucket")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = "mix", key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per document: key, source, ``size``, ``source_size``, ``target``, ``taken``, ``whole`` (full repetitions)."""
    base = checkpointed(sized(docs, seed, key, source, text))
    done = taken_of(base, F.col("size"), *plan_of(base, weights, cap))
    return done.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "taken", "whole")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = "mix", key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``taken`` and ``whole``.  Texts are read twice and stay in their tasks."""
    base = sized(docs, seed, key, source, text)
    plan, small = plan_of(base, weights, cap)
    results = ("size", "source_size", "target", "taken", "whole")
    kept = F.struct(*[F.col(c) for c in docs.columns if c.lower() not in results])
    rows = docs.select(kept.alias("row"), F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("own"), *place(F.col(key), F.col(text), seed))
    return taken_of(rows, size_of(F.col("own")), plan, small).select("row.*", *results)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "whole")


#: The same in DuckDB.  The level follows from the order in which sources are clamped: by their limit over their weight.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS spot FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
o AS (SELECT *, 3.0::DOUBLE * source_size AS most, row_number() OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST) AS n FROM s),
k AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
l AS (SELECT coalesce(arg_min(level, n) FILTER (level * weight < most), max(level)) AS level FROM k),
t AS (SELECT source, source_size, CAST(least(most, l.level * weight) AS DOUBLE) AS target FROM k, l),
q AS (SELECT *, CAST(round(target) AS BIGINT) AS quota, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS whole FROM t),
x AS (SELECT d.doc_id, d.source, d.size, q.source_size, q.target, q.whole, q.quota - q.whole * q.source_size AS rest, sum(d.size) OVER (PARTITION BY d.source ORDER BY spot, doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS upto FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - upto)) AS BIGINT) AS taken, source, CAST(whole AS BIGINT) AS whole FROM x
"""
