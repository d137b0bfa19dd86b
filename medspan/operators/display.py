"""Display of results: merging repeated mentions, and cell texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medspan.functions import lexicon as lx
from medspan.functions.textnorm import strip_space
from medspan.operators.projection import CONCEPT


def deduplicated(rows: DataFrame) -> DataFrame:
    """Mentions of a note merged where text (trimmed, lower-case) and SCD agree.

    ``rows`` has doc_id, mention_no and ``mention`` (see ``plans.annotate``).  The first mention of a group is its base;
    each type keeps the concept of least depth (the earlier on ties), ingredient lists are united by id, and normalised
    texts are joined.  Mentions without text or SCD pass through.  Result order is the first position of each group.
    """
    text = F.lower(strip_space(F.col("mention.mention_text")))
    scd = F.col("mention.type_results.SCD.concept_id")
    alone = (F.coalesce(text, F.lit("")) == "") | F.coalesce(scd, F.lit("")).eqNullSafe("")
    keyed = rows.withColumn("key", F.when(alone, F.struct(F.lit("").alias("text"), F.col("mention_no").cast("string").alias("id"))).otherwise(F.struct(text.alias("text"), scd.alias("id"))))
    kinds = [t for t in lx.TARGET_TYPES if t != "IN"]

    def least(kind: str) -> Column:
        own = F.col(f"mention.type_results.{kind}")
        return F.min_by(own, F.when(own.isNotNull(), F.struct(own["depth"], F.col("mention_no")))).alias(kind)

    merged = keyed.groupBy("doc_id", "key").agg(
        F.min("mention_no").alias("mention_no"),
        F.min_by("mention", "mention_no").alias("base"),
        *[least(k) for k in kinds],
        F.array_sort(F.collect_list(F.struct("mention_no", F.col("mention.type_results.IN").alias("items"), F.col("mention.normalized_text").alias("norm"), F.col("mention.type_results.in_is_list").alias("listed")))).alias("all"),
    )
    items = F.flatten(F.transform("all", lambda x: x["items"]))
    # By id: keep the first of each.
    united = F.aggregate(items, F.array().cast(f"array<{CONCEPT}>"), lambda acc, x: F.when(F.exists(acc, lambda y: y["concept_id"] == x["concept_id"]), acc).otherwise(F.array_append(acc, x)))
    norms = F.array_join(F.array_distinct(F.filter(F.transform("all", lambda x: x["norm"]), lambda n: n != "")), " | ")
    types = F.struct(*kinds, united.alias("IN"), (F.exists("all", lambda x: x["listed"]) | (F.size(united) > 1)).alias("in_is_list"))
    return merged.select("doc_id", "mention_no", F.col("base").withField("normalized_text", norms).withField("type_results", types).alias("mention"), F.size("all").alias("merged"))


def concept_text(concept: Column) -> Column:
    """``name (id)``, or ``-`` where there is no concept."""
    return F.coalesce(F.concat(concept["name"], F.lit(" ("), concept["concept_id"], F.lit(")")), F.lit("-"))


def list_text(concepts: Column) -> Column:
    """Concept texts joined by ``|``, or ``-`` for an empty list."""
    return F.when(F.size(concepts) > 0, F.array_join(F.transform(concepts, concept_text), " | ")).otherwise("-")


def escaped(text: Column) -> Column:
    """Text with the five characters of mark-up replaced."""
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def table_rows(rows: DataFrame) -> DataFrame:
    """One row per mention with a text cell for each type, as a result table shows it."""
    cells = [escaped(list_text(F.col("mention.type_results.IN")) if t == "IN" else concept_text(F.col(f"mention.type_results.{t}"))).alias(t) for t in lx.TARGET_TYPES]
    return rows.select("doc_id", "mention_no", *[escaped(F.col(f"mention.{c}")).alias(c) for c in ("mention_text", "normalized_text")], *cells)
