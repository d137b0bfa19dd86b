"""Annotation of notes: detection, context, negation, retrieval, projection, suppression, assembly."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medspan.functions import dose
from medspan.functions import lexicon as lx
from medspan.functions.textnorm import noisy, segment_around, strip_context, strip_space
from medspan.operators import mentions as m
from medspan.operators import projection, ranking
from medspan.session import stage
from medspan.sources.index import Index
from medspan.sources.results import result_json, text_notes


@dataclass(frozen=True)
class Options:
    top_k: int = 40
    exact_boost: float = 0.35
    max_graph_depth: int = 3
    max_ngram: int = 8
    max_exact_candidates: int = 25


class Prepared:
    """An index made ready for many calls and threads: the dictionary is read, filtered and broadcast once, for given options.

    Closures are looked up where the index holds them (``build_index`` with a reach depth).  ``release`` frees the broadcasts.
    """

    def __init__(self, index: Index, options: Options | None = None):
        self.index, self.options = index, options or Options()
        self.detector = m.Detector(index.aliases, self.options.max_exact_candidates)

    def release(self) -> None:
        self.detector.release()


def with_context(found: DataFrame) -> DataFrame:
    """Mentions with their repaired text forms, context, query variants and features; negated ones are dropped."""
    start, end = F.col("start") - F.col("line_start"), F.col("end") - F.col("line_start")
    kept = m.with_negation(found).where("not negated").drop("negated")
    wide = F.when(F.length("context_line") >= 4, F.col("context_line")).otherwise(F.col("wide_text"))
    forms = kept.withColumns({"focused": noisy(segment_around(F.col("line_text"), start, end)), "around": noisy(strip_space(wide)), "raw_noisy": noisy(F.col("text")), "surface": noisy(F.col("mention_text"))})
    stripped = strip_context(F.col("raw_noisy"))
    forms = forms.withColumns({"context": F.when(F.length("focused") >= 3, F.col("focused")).otherwise(F.col("around")), "projection_norm": F.when(stripped != "", stripped).otherwise(F.col("norm_text")), "variants": ranking.query_variants(F.col("norm_text"), F.col("raw_noisy"), F.col("surface"))})
    return dose.with_mention_features(dose.with_record(forms, "mention_text")).withColumn("mention_id", F.struct("doc_id", "mention_no"))


def signals() -> Column:
    """Ordered distinct detection signals of a mention."""
    method, exact = F.col("method"), F.size("exact_ids") > 0
    return F.array_distinct(
        F.array_compact(
            F.array(
                F.when(method == "exact_alias_span", "exact_alias").when(method == "token_replacement_alias", "token_replacement").when(method == "dense_line_scan", "dense_line_parser").when(method.isin("fallback_chunk", "fallback_whole_text"), method),
                F.when((method == "token_replacement_alias") | ((method == "dense_line_scan") & exact), "exact_alias"),
                F.when(F.size("variants") > 0, "embeddings"),
                F.when(exact, "exact_alias_boost"),
                F.when(F.col("exact_override"), "no_strength_in_exact_override"),
                F.when(F.col("alias_override"), "no_strength_in_alias_override"),
                F.when(F.col("suppressed"), "ingredient_projection_suppressed"),
                F.when(F.col("suppressed"), "low_confidence_embedding_match"),
            )
        )
    )


def assembled(rows: DataFrame) -> DataFrame:
    """One row per mention: doc_id, mention_no and ``mention``, the nested result."""

    def hit(kind: str) -> Column:
        own = F.try_element_at("projected", F.lit(kind))
        gone = F.col("suppressed") | ~F.col("brand") if kind in lx.BRAND_TYPES else F.col("suppressed")
        return F.when(~gone, own).alias(kind)

    none = F.array().cast(f"array<{projection.CONCEPT}>")
    mention = F.struct(
        "mention_text",
        F.col("text").alias("matched_text"),
        F.struct(F.col("mention_start").alias("start"), F.col("mention_end").alias("end")).alias("span"),
        F.struct("start", "end").alias("matched_span"),
        F.col("norm_text").alias("normalized_text"),
        F.struct(F.col("best_id").alias("concept_id"), F.col("best_name").alias("name"), F.col("best_type").alias("tty"), F.round("best_score", 6).alias("score"), "exact_match").alias("best_match"),
        F.struct(*[hit(t) for t in lx.TARGET_TYPES if t != "IN"], F.when(F.col("suppressed"), none).otherwise(F.col("in_list")).alias("IN"), (F.col("in_is_list") & ~F.col("suppressed")).alias("in_is_list")).alias("type_results"),
        signals().alias("detected_by"),
        F.struct(
            F.col("method").alias("mention_detection_method"),
            "lookup_source",
            "lookup_norm",
            F.when(F.col("method") == "token_replacement_alias", F.struct(F.col("replaced_from").alias("from"), F.col("replaced_to").alias("to"))).alias("token_replacement"),
            F.struct(
                (F.size("variants") > 0).alias("used_embeddings"),
                F.col("variants").alias("embedding_query_variants"),
                F.size("exact_ids").alias("exact_alias_candidate_count"),
                F.col("exact_ids").alias("exact_alias_candidates"),
                F.col("exact_types").alias("exact_alias_types"),
                F.when(F.col("suppressed"), "low_confidence_embedding_suppressed").otherwise(F.col("selection_reason")).alias("selection_reason"),
                F.round("name_similarity", 6).alias("best_name_similarity"),
                F.col("suppressed").alias("ingredient_projection_suppressed"),
            ).alias("ranking"),
        ).alias("detection_trace"),
    )
    return rows.select("doc_id", "mention_no", mention.alias("mention"))


def annotate_mentions(notes: DataFrame, index: Index | Prepared, options: Options | None = None) -> DataFrame:
    """(doc_id, mention_no, mention) for all mentions of ``notes`` (unique doc_id, text).  A ``Prepared`` index brings its options."""
    kept = isinstance(index, Prepared)
    ready = index if kept else Prepared(index, options)
    o, index = ready.options, ready.index
    found = stage(ranking.with_choice(with_context(m.detect_mentions(notes, ready.detector, o.max_ngram))))  # several joins start from the mentions
    if not kept:
        ready.release()
    # What follows is made for distinct mentions and staged; all mentions are staged once, and meet the rest on the way to their notes.
    best = ranking.choose_best(found, index, o.top_k, o.exact_boost)
    rows = projection.project(ranking.with_similarity(ranking.has_brand(best, index)), index, o.max_graph_depth)
    return assembled(rows.withColumn("suppressed", ranking.low_confidence()))


def annotate(notes: DataFrame, index: Index | Prepared, options: Options | None = None) -> DataFrame:
    """One row per note: doc_id, input_text, target_types, mention_count, mentions."""
    rows = annotate_mentions(notes, index, options)
    lists = rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("mention_no", "mention"))), lambda x: x["mention"]).alias("mentions"))
    kept = notes.join(lists, "doc_id", "left")
    count = F.coalesce(F.size("mentions"), F.lit(0))
    return kept.select("doc_id", F.col("text").alias("input_text"), F.array(*[F.lit(t) for t in lx.TARGET_TYPES]).alias("target_types"), F.when(count > 0, count).otherwise(0).alias("mention_count"), F.coalesce("mentions", F.array().cast(lists.schema["mentions"].dataType)).alias("mentions"))


def infer_json(index: Index | Prepared, text: str, options: Options | None = None) -> str:
    """The JSON result of one text, as the command line and the server give it."""
    spark = (index.index if isinstance(index, Prepared) else index).aliases.sparkSession
    return result_json(annotate(text_notes(spark, text), index, options)).first()["value"]
