"""Terminology release files: pipe-delimited UTF-8 text without header or quoting.

Undecodable bytes are dropped from fields.  Rows carry ``line_no``, which follows the file order (file block, then
position), because several rules keep the first row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medspan.functions.textnorm import normalize

#: Positions of the columns that are read, and the least number of columns of a line.
NAME_COLUMNS = {"concept_id": 0, "lat": 1, "ispref": 6, "sab": 11, "tty": 12, "raw_name": 14, "suppress": 16}
NAME_WIDTH = 18
RELATION_COLUMNS = {"src": 0, "rel": 3, "dst": 4, "rela": 7, "sab": 10, "suppress": 14}
RELATION_WIDTH = 16
LANGUAGE, SUPPRESSED = "ENG", ("Y", "O")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a text file; ``line_no`` rises with the position in the file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))
    return lines.withColumn("line_no", F.struct("file", "block", "seq")).select("line_no", F.regexp_replace("value", "\r$|�", "").alias("value"))


def parse(lines: DataFrame, columns: dict[str, int], width: int) -> DataFrame:
    """Split lines at ``|`` and keep the named positions of lines that are wide enough."""
    parts = F.split("value", r"\|", -1)
    return lines.withColumn("parts", parts).where(F.size("parts") >= width).select("line_no", *[F.get("parts", F.lit(i)).alias(name) for name, i in columns.items()])


def kept_names(rows: DataFrame, source: str) -> DataFrame:
    """Names of one source (its abbreviation in the release) and the language that are not suppressed and have letters or digits, with ``norm_text``."""
    cheap = rows.where((F.col("sab") == source) & (F.col("lat") == LANGUAGE) & ~F.col("suppress").isin(*SUPPRESSED))
    return cheap.withColumn("norm_text", normalize(F.col("raw_name"))).where("norm_text <> ''").select("line_no", "concept_id", "ispref", "tty", "raw_name", "norm_text")


def first_concepts(names: DataFrame, most: int | None) -> DataFrame:
    """Names up to the kept row that makes the ``most``-th distinct concept; all of them without a limit."""
    if most is None:
        return names
    firsts = names.groupBy("concept_id").agg(F.min("line_no").alias("first")).orderBy("first").limit(most)
    end = firsts.agg(F.max("first").alias("end"), F.count("*").alias("n"))
    return names.crossJoin(F.broadcast(end)).where((F.col("n") < most) | (F.col("line_no") <= F.col("end"))).drop("end", "n")


def kept_relations(rows: DataFrame, concepts: DataFrame, source: str) -> DataFrame:
    """Relations of one source between two different known concepts."""
    cheap = rows.where((F.col("sab") == source) & ~F.col("suppress").isin(*SUPPRESSED) & (F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
    known = concepts.select("concept_id")
    return cheap.join(known.withColumnRenamed("concept_id", "src"), "src", "left_semi").join(known.withColumnRenamed("concept_id", "dst"), "dst", "left_semi").select("line_no", "src", "dst", "rel", "rela")


def first_relations(kept: DataFrame, lines: DataFrame, most: int | None) -> DataFrame:
    """Kept relations up to the first one whose line number is at least ``most``; lines are counted from 1."""
    if most is None:
        return kept
    # Only this optional cut needs true line numbers: the ``most``-th line ends a bounded top-k.
    edge = lines.select("line_no").orderBy("line_no").limit(most).agg(F.max("line_no").alias("edge"), F.count("*").alias("n"))
    stop = kept.crossJoin(F.broadcast(edge)).where((F.col("n") >= most) & (F.col("line_no") >= F.col("edge"))).agg(F.min("line_no").alias("stop"))
    return kept.crossJoin(F.broadcast(stop)).where(F.col("stop").isNull() | (F.col("line_no") <= F.col("stop"))).drop("stop")


def both_ways(relations: DataFrame) -> DataFrame:
    """Each relation in both directions under the same label, without repeats.

    Repeats are told by the unordered pair, so each relation is held and moved once; the other direction is added behind that.
    """
    src, dst = F.col("src"), F.col("dst")
    kept = src.isNull() | (src <= dst)
    pairs = relations.select(F.when(kept, src).otherwise(dst).alias("src"), F.when(kept, dst).otherwise(src).alias("dst"), "rel", "rela").distinct()
    one, back = F.struct("src", "dst"), F.struct(dst.alias("src"), src.alias("dst"))
    ways = F.when(src.eqNullSafe(dst), F.array(one)).otherwise(F.array(one, back))
    return pairs.select(F.explode(ways).alias("way"), "rel", "rela").select("way.src", "way.dst", "rel", "rela")


def _rank(tty: Column) -> Column:
    from medspan.functions.lexicon import TARGET_TYPES

    start = F.lit(len(TARGET_TYPES))
    return reduce(lambda other, x: F.when(tty == x[1], F.lit(x[0])).otherwise(other), enumerate(TARGET_TYPES), start)


def name_rank() -> Column:
    """Order of the names of a concept: preferred flag, type, length, then file order."""
    return F.struct((F.col("ispref") != "Y").cast("int").alias("pref"), _rank(F.col("tty")).alias("pri"), F.length("raw_name").alias("len"), "line_no")


def preferred_names(names: DataFrame) -> DataFrame:
    """(concept_id, preferred_name)."""
    return names.groupBy("concept_id").agg(F.min_by("raw_name", name_rank()).alias("preferred_name"))


def typed_names(names: DataFrame) -> DataFrame:
    """(concept_id, tty, name): the best name of each type."""
    return names.groupBy("concept_id", "tty").agg(F.min_by("raw_name", name_rank()).alias("name"))


def first_aliases(names: DataFrame, most: int) -> DataFrame:
    """(concept_id, aliases): the first ``most`` distinct normalised names in file order."""
    distinct = names.groupBy("concept_id", "norm_text").agg(F.min("line_no").alias("line_no"))
    ranked = distinct.withColumn("n", F.row_number().over(Window.partitionBy("concept_id").orderBy("line_no"))).where(F.col("n") <= most)
    return ranked.groupBy("concept_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "norm_text"))), lambda x: x["norm_text"]).alias("aliases"))
