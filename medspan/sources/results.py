"""Notes in, results out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medspan.functions.lexicon import TARGET_TYPES

RANKING = (
    "used_embeddings", "embedding_query_variants", "exact_alias_candidate_count", "exact_alias_candidates", "exact_alias_types", "selection_reason",
    "best_name_similarity", "ingredient_projection_suppressed",
)


def text_notes(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def file_notes(spark: SparkSession, path: str) -> DataFrame:
    """One note for each text file under ``path``; the id is a hash of the file's path."""
    return spark.read.text(path, wholetext=True).select(F.xxhash64(F.input_file_name()).alias("doc_id"), F.col("value").alias("text"))


def _inner(value: Column) -> Column:
    """JSON text of one value of any type."""
    whole = F.to_json(F.struct(value.alias("x")), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def _extended(struct: Column, *more: Column) -> Column:
    """JSON object text of a struct with further members appended."""
    own = F.to_json(struct, {"ignoreNullFields": "false"})
    return F.concat(F.substring(own, F.lit(1), F.length(own) - 1), *more, F.lit("}"))


def _published(concept: Column) -> Column:
    """A concept under the field names that consumers of the terminology know."""
    return F.when(concept.isNotNull(), F.struct(concept["concept_id"].alias("rxcui"), concept["name"].alias("name"), concept["depth"].alias("depth")))


def _mention_json(m: Column) -> Column:
    types, best, trace = m["type_results"], m["best_match"], m["detection_trace"]
    items = F.transform(types["IN"], _published)
    listed = types["in_is_list"]
    ingredient = F.when(listed, _inner(items)).otherwise(_inner(F.get(items, F.lit(0))))
    all_in = F.when(listed, F.concat(F.lit(',"IN_ALL":'), _inner(items))).otherwise("")
    results = _extended(F.struct(*[_published(types[t]).alias(t) for t in TARGET_TYPES if t != "IN"]), F.lit(',"IN":'), ingredient, all_in)
    ranking = trace["ranking"]
    renamed = [ranking[c].alias("exact_alias_ttys" if c == "exact_alias_types" else c) for c in RANKING]
    whole = F.struct(
        *[m[c].alias(c) for c in ("mention_text", "matched_text", "span", "matched_span", "normalized_text")],
        F.struct(best["concept_id"].alias("rxcui"), *[best[c].alias(c) for c in ("name", "tty", "score", "exact_match")]).alias("best_match"),
        m["detected_by"].alias("detected_by"),
        F.struct(*[trace[c].alias(c) for c in ("mention_detection_method", "lookup_source", "lookup_norm", "token_replacement")], F.struct(*renamed).alias("ranking")).alias("detection_trace"),
    )
    return _extended(whole, F.lit(',"tty_results":'), results)


def result_json(results: DataFrame) -> DataFrame:
    """(doc_id, value): one JSON document per note.  ``IN`` is null, an object, or for combinations a list (also ``IN_ALL``)."""
    parts = F.array_join(F.transform("mentions", _mention_json), ",")
    head = F.to_json(F.struct("input_text", F.col("target_types").alias("target_ttys"), "mention_count"), {"ignoreNullFields": "false"})
    return results.select("doc_id", F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"mentions":['), parts, F.lit("]}")).alias("value"))


def write_json(results: DataFrame, path: str) -> None:
    result_json(results).select("value").write.mode("overwrite").text(path)
