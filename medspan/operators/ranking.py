"""Choice of the best concept of a mention: vector candidates, exact boost, ingredient overrides, confidence."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from medspan.functions import lexicon as lx
from medspan.functions.textnorm import noisy_py, normalize, strip_context
from medspan.operators.vectors import nearest
from medspan.session import few_rows, has_few_rows, stage
from medspan.sources.index import Index

VARIANT_PENALTY = 0.03


def query_variants(norm: Column, raw_noisy: Column, mention_noisy: Column) -> Column:
    """Ordered distinct query strings: the matched norm, the repaired forms, then each without context words."""
    first = F.array_distinct(F.filter(F.array(norm, raw_noisy, mention_noisy), lambda x: x != ""))
    return F.array_distinct(F.filter(F.concat(first, F.transform(first, strip_context)), lambda x: x != ""))


@F.arrow_udf(DoubleType())
def char_similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """Matching-block ratio of two texts, repaired and without spaces; 0 where either is empty."""
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
        x, y = (re.sub(r"\s+", "", noisy_py(t or "")) for t in (x, y))
        out.append(SequenceMatcher(None, x, y).ratio() if x and y else 0.0)
    return pa.array(out, pa.float64())


def ranked_concepts(mentions: DataFrame, index: Index, top_k: int, exact_boost: float) -> DataFrame:
    """(mention_id, concept_id, score, order): merged candidates of all query variants, exact ones boosted per row.

    Distinct queries are searched once for the whole batch.
    """
    variants = mentions.select("mention_id", "norm_text", F.posexplode("variants").alias("variant", "query"))
    by_vector = penalised(variants.join(nearest(variants, index.vectors, top_k, index.dims), "query"))
    return merged_scores(by_vector, mentions.select("mention_id", F.posexplode("exact_ids").alias("pos", "concept_id")), exact_boost)


def penalised(found: DataFrame) -> DataFrame:
    """(mention_id, concept_id, score, order) of the hits of all query variants; those of a variant other than the matched norm cost a little."""
    adjusted = F.col("score") - F.when(F.col("query") == F.col("norm_text"), 0.0).otherwise(VARIANT_PENALTY)
    return found.select("mention_id", "concept_id", adjusted.alias("score"), F.struct("variant", "rank").alias("order"))


def merged_scores(by_vector: DataFrame, exact: DataFrame, exact_boost: float) -> DataFrame:
    """Best score of each (mention_id, concept_id), plus the boost once for every row of ``exact`` (mention_id, pos, concept_id)."""
    merged = by_vector.groupBy("mention_id", "concept_id").agg(F.max("score").alias("score"), F.min("order").alias("order"))
    exact = exact.groupBy("mention_id", "concept_id").agg((F.count("*") * F.lit(exact_boost)).alias("boost"), F.min("pos").alias("pos"))
    both = merged.join(exact, ["mention_id", "concept_id"], "full")
    late = F.struct(F.lit(1 << 20).alias("variant"), F.coalesce("pos", F.lit(0)).alias("rank"))
    return both.select("mention_id", "concept_id", (F.coalesce("score", F.lit(0.0)) + F.coalesce("boost", F.lit(0.0))).alias("score"), F.coalesce("order", late).alias("order"))


def primary_type() -> Column:
    """Aggregate: the first target type of a concept, else its first type by name."""
    order = F.coalesce(F.array_position(F.array(*[F.lit(t) for t in lx.TARGET_TYPES]), F.col("tty")), F.lit(0))
    return F.min_by("tty", F.struct(F.when(order == 0, 99).otherwise(order), "tty"))


#: What the choice of a mention's concept depends on, beside whether its context has a strength.
CHOICE_INPUTS = ("norm_text", "variants", "exact_ids", "projection_norm")


def choose_best(mentions: DataFrame, index: Index, top_k: int = 40, exact_boost: float = 0.35) -> DataFrame:
    """``chosen`` among the candidates of ``ranked_concepts``; ``mentions`` also has ``variants``.

    Notes repeat themselves: each distinct combination of what is ranked and chosen by (``with_choice``) is ranked and chosen once, and what is
    chosen goes to its mentions.  Candidates, some forty for each query string, are never made, kept or moved by mention.  Where few
    combinations are broadcast, ``mentions`` are not kept once more; staged ones with their ``choice`` are cheap to read again.
    """
    keyed = mentions if "choice" in mentions.columns else with_choice(mentions)
    inputs = [*CHOICE_INPUTS, "has_strength"]
    shapes = stage(keyed.groupBy(F.col("choice").alias("mention_id")).agg(*[F.first(c).alias(c) for c in inputs]))
    made = stage(_chosen(shapes, stage(ranked_concepts(shapes, index, top_k, exact_boost)), index).drop(*inputs).withColumnRenamed("mention_id", "choice"))
    joined = keyed.join(few_rows(made), "choice").drop("choice", "has_strength")
    return joined if has_few_rows(made) else stage(joined)


def with_choice(mentions: DataFrame) -> DataFrame:
    """``mentions`` with ``has_strength`` and ``choice``, a digest of all that the choice of a concept depends on."""
    # JSON marks the borders of lists and fields; it leaves nulls out, but not those within a list.
    return mentions.withColumn("has_strength", strength_signal()).withColumn("choice", F.sha2(F.to_json(F.struct(*CHOICE_INPUTS, "has_strength")), 256))


def strength_signal() -> Column:
    """Whether a mention's context has a strength."""
    return F.col("context").rlike(lx.STRENGTH) | F.col("context").rlike(lx.RATIO_STRENGTH) | F.col("context").rlike(lx.SLASH_RATIO)


def chosen(mentions: DataFrame, ranked: DataFrame, index: Index) -> DataFrame:
    """``mentions`` with best_id, best_score, best_name, best_type, exact_match, selection_reason and the override signals.

    Input: mention_id, norm_text, projection_norm, context, exact_ids; ``ranked`` has (mention_id, concept_id, score, order).
    Mentions without candidates are dropped.
    """
    return _chosen(mentions.withColumn("has_strength", strength_signal()), ranked, index).drop("has_strength")


def _chosen(mentions: DataFrame, ranked: DataFrame, index: Index) -> DataFrame:
    """``chosen`` for mentions with ``has_strength``."""
    top = ranked.groupBy("mention_id").agg(F.min_by(F.struct("concept_id", "score"), F.struct(-F.col("score"), "order", "concept_id")).alias("top"))
    rows = mentions.join(top, "mention_id")
    ingredient = index.names.where("tty = 'IN'").select("concept_id").distinct()
    exact_in = mentions.select("mention_id", F.posexplode("exact_ids").alias("pos", "concept_id")).join(ingredient, "concept_id", "left_semi").groupBy("mention_id").agg(F.min_by("concept_id", "pos").alias("exact_in"))
    first_in = index.aliases.where("tty = 'IN'").groupBy("norm_text").agg(F.min_by("concept_id", "pos").alias("named_in")).withColumnRenamed("norm_text", "key")
    keys = mentions.select("mention_id", F.posexplode(F.array("norm_text", "projection_norm", strip_context(F.col("norm_text")))).alias("n", "key"))
    alias_in = keys.join(first_in, "key").groupBy("mention_id").agg(F.min_by("named_in", "n").alias("alias_in"))
    rows = rows.join(exact_in, "mention_id", "left").join(alias_in, "mention_id", "left")
    weak = ~F.col("has_strength")
    step1 = F.when(weak & F.col("exact_in").isNotNull(), F.col("exact_in")).otherwise(F.col("top.concept_id"))
    rows = rows.withColumns({"after_exact": step1}).withColumns(
        {
            "best_id": F.when(weak & F.col("alias_in").isNotNull(), F.col("alias_in")).otherwise(F.col("after_exact")),
            "exact_override": F.col("after_exact") != F.col("top.concept_id"),
        }
    ).withColumn("alias_override", F.col("best_id") != F.col("after_exact"))
    scores = ranked.select("mention_id", F.col("concept_id").alias("best_id"), F.col("score").alias("own_score"))
    exact_score = ranked.select("mention_id", F.col("concept_id").alias("after_exact"), F.col("score").alias("exact_score"))
    rows = rows.join(scores, ["mention_id", "best_id"], "left").join(exact_score, ["mention_id", "after_exact"], "left")
    rows = rows.withColumn("best_score", F.coalesce("own_score", "exact_score", "top.score"))
    held = F.array_contains("exact_ids", F.col("best_id"))
    reason = F.when(F.col("alias_override"), "no_strength_in_alias_override").when(F.col("exact_override"), "no_strength_in_exact_override").when(held, "embedding_plus_exact").otherwise("embedding_ranked")
    types = index.names.groupBy(F.col("concept_id").alias("best_id")).agg(primary_type().alias("best_type"))
    named = index.concepts.select(F.col("concept_id").alias("best_id"), F.col("preferred_name").alias("best_name"))
    rows = rows.withColumns({"exact_match": held, "selection_reason": reason})
    return rows.join(types, "best_id", "left").join(named, "best_id", "left").withColumn("best_name", F.coalesce("best_name", F.lit(""))).drop("top", "exact_in", "alias_in", "after_exact", "own_score", "exact_score")


def with_similarity(rows: DataFrame) -> DataFrame:
    """``rows`` with ``name_similarity``, computed once for each distinct pair of text and name."""
    pairs = rows.select("norm_text", "best_name").distinct().withColumn("name_similarity", char_similarity(F.col("norm_text"), F.col("best_name")))
    return rows.join(few_rows(stage(pairs)), ["norm_text", "best_name"], "left")


def low_confidence() -> Column:
    """Fallback mentions that only vectors support, with a weak score and an unlike name."""
    fallback = F.col("method").isin("fallback_whole_text", "fallback_chunk") & (F.size("exact_ids") == 0) & (F.size("variants") > 0)
    return fallback & ~F.coalesce(F.col("best_type") == "IN", F.lit(False)) & (F.col("best_score") < 0.75) & (F.col("name_similarity") < 0.86)


def has_brand(rows: DataFrame, index: Index) -> DataFrame:
    """``rows`` with ``brand``: the best concept or an exact type is a brand's, or a bracketed part of the mention names a brand."""
    brands = index.aliases.where("tty = 'BN'").select(F.col("norm_text").alias("part")).distinct()
    texts = rows.select("mention_text").distinct()  # looked up once, and joined to rows that need not be moved for a few
    parts = texts.select("mention_text", F.explode(F.regexp_extract_all("mention_text", F.lit(lx.BRACKETED), F.lit(1))).alias("raw")).select("mention_text", normalize(F.col("raw")).alias("part"))
    named = stage(parts.where("part <> ''").join(brands, "part", "left_semi").select("mention_text").distinct().withColumn("bracketed", F.lit(True)))
    types = F.array(*[F.lit(t) for t in lx.BRAND_TYPES])
    kind = F.coalesce(F.array_contains(types, F.col("best_type")), F.lit(False)) | F.arrays_overlap("exact_types", types)
    return rows.join(few_rows(named), "mention_text", "left").withColumn("brand", kind | F.coalesce("bracketed", F.lit(False))).drop("bracketed")


