"""The index: terminology tables built from the release files, kept as Parquet.

Tables: ``concepts`` (concept_id, preferred_name), ``names`` (concept_id, tty, name and its features), ``aliases``
(norm_text, concept_id, raw_text, tty, pos), ``edges`` (src, dst, rel, rela), ``ingredients`` (concept_id, ingredients),
``vectors`` (concept_id, vec), and ``metadata`` (one JSON row); with a reach depth also ``reach`` (seed, target, node, depth).

Tables are bucketed and sorted by their look-up key, so joins on it shuffle the other side alone.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medspan.functions import dose
from medspan.functions.lexicon import TARGET_TYPES
from medspan.functions.textnorm import normalize, words
from medspan.operators.graph import closure, ingredient_sets, relation_table
from medspan.operators.vectors import embed
from medspan.session import qualified, remove
from medspan.sources import release

DIMS, MAX_ALIASES, BUCKETS = 256, 8, 16


@dataclass
class Index:
    concepts: DataFrame
    names: DataFrame
    aliases: DataFrame
    edges: DataFrame
    ingredients: DataFrame
    vectors: DataFrame
    dims: int = DIMS
    #: (seed, target, node, depth) of all concepts for closures of ``reach_depth``, where it was built.
    reach: DataFrame | None = None
    reach_depth: int = 0


TABLES = ["concepts", "names", "aliases", "edges", "ingredients", "vectors"]
LOOKUP_KEY = {"aliases": "norm_text", "edges": "src", "reach": "seed"}


def with_name_features(names: DataFrame) -> DataFrame:
    """``names`` with what scoring needs of a candidate name, computed once for each name."""
    normed = names.withColumn("name_norm", normalize(F.col("name")))
    made = normed.withColumns({"name_words": F.array_distinct(words(F.col("name_norm"))), "flags": dose.form_flags(F.col("name_norm")), "sigs": dose.strength_signatures(F.col("name")), "mg": dose.strengths_mg(F.col("name"))})
    return made.withColumn("flag_bits", dose.form_bits(F.col("flags")))


def alias_table(names: DataFrame) -> DataFrame:
    """(norm_text, concept_id, tty, raw_text, pos): distinct (name, concept, type), numbered within a name in file order."""
    order = Window.partitionBy("norm_text").orderBy("line_no")
    rows = names.groupBy("norm_text", "concept_id", "tty").agg(F.min_by("raw_name", "line_no").alias("raw_text"), F.min("line_no").alias("line_no"))
    return rows.withColumn("pos", F.row_number().over(order)).drop("line_no")


def make_index(names: DataFrame, relations: DataFrame, dims: int = DIMS, max_aliases: int = MAX_ALIASES) -> Index:
    """Index tables of kept names (see ``release.kept_names``) and kept relations."""
    first = release.first_aliases(names, max_aliases)
    concepts = release.preferred_names(names).join(first, "concept_id")
    concepts = concepts.select("concept_id", F.coalesce(F.when(F.col("preferred_name") != "", F.col("preferred_name")), F.get("aliases", F.lit(0)), "concept_id").alias("preferred_name"), "aliases")
    typed = with_name_features(release.typed_names(names))
    edges = release.both_ways(relations)
    text = F.array_join("aliases", " ")
    vectors = concepts.select("concept_id", embed(F.when(text != "", text).otherwise(normalize(F.col("preferred_name"))), dims).alias("vec"))
    return Index(concepts.drop("aliases"), typed, alias_table(names), edges, ingredient_sets(concepts, typed, edges), vectors, dims)


def build_index(spark: SparkSession, names_file: str, relations_file: str, out_dir: str, source: str, dims: int = DIMS, max_aliases: int = MAX_ALIASES, max_concepts: int | None = None, max_relation_lines: int | None = None, reach_depth: int = 0, buckets: int = BUCKETS) -> dict:
    """Read the two release files (rows of ``source``), write the index tables under ``out_dir``, return the metadata.

    Concepts and edges are written first and read back, so the files are scanned once for each.  With a ``reach_depth``, the closures
    of all concepts are built as a table, for annotation to look up.
    """
    name_lines, relation_lines = release.read_lines(spark, names_file), release.read_lines(spark, relations_file)
    names = release.first_concepts(release.kept_names(release.parse(name_lines, release.NAME_COLUMNS, release.NAME_WIDTH), source), max_concepts)
    names.write.mode("overwrite").parquet(f"{out_dir}/kept_names")
    names = spark.read.parquet(f"{out_dir}/kept_names")
    known = names.select("concept_id").distinct()
    kept = release.kept_relations(release.parse(relation_lines, release.RELATION_COLUMNS, release.RELATION_WIDTH), known, source)
    release.first_relations(kept, relation_lines, max_relation_lines).write.mode("overwrite").parquet(f"{out_dir}/kept_relations")
    index = make_index(names, spark.read.parquet(f"{out_dir}/kept_relations"), dims, max_aliases)
    for table in TABLES:
        _write(getattr(index, table), f"{out_dir}/{table}", _key(table), buckets)
    made = Index(**{t: _read(spark, f"{out_dir}/{t}", _key(t), buckets) for t in TABLES}, dims=dims)
    if reach_depth:
        _write(all_reach(made, reach_depth), f"{out_dir}/reach", _key("reach"), buckets)
    metadata = {
        "created_at_utc": datetime.now(timezone.utc).isoformat(),
        "names_file": names_file,
        "concept_count": made.concepts.count(),
        "edge_count_directed": made.edges.count(),
        "embedding_dims": dims,
        "max_aliases_per_concept": max_aliases,
        "target_types": list(TARGET_TYPES),
        "buckets": buckets,
        "reach_depth": reach_depth,
    }
    spark.createDataFrame([(json.dumps(metadata),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out_dir}/metadata")
    return metadata


def all_reach(index: Index, depth: int) -> DataFrame:
    """(seed, target, node, depth): every concept's closure for every target type, nodes of that type alone."""
    typed = index.names.select(F.col("concept_id").alias("node"), F.col("tty").alias("target")).where(F.col("target").isin(*TARGET_TYPES))
    seeds = index.concepts.select(F.col("concept_id").alias("seed")).crossJoin(F.broadcast(typed.select("target").distinct()))  # at most nine types
    return closure(seeds, index.edges, relation_table(index.edges.sparkSession), depth, typed)


def _key(table: str) -> str:
    return LOOKUP_KEY.get(table, "concept_id")


def _write(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Files of a table, bucketed and sorted by ``key``; only the files stay."""
    name = f"medspan_{uuid.uuid4().hex}"
    remove(df.sparkSession, path)
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", qualified(df.sparkSession, path)).format("parquet").saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")


def _read(spark: SparkSession, path: str, key: str, buckets: int) -> DataFrame:
    """A bucketed table by its files.  Its catalogue entry belongs to the session and carries how it is bucketed."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
    name = f"medspan_{uuid.uuid4().hex}"
    where = qualified(spark, path).replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{where}'")
    return spark.table(name)


def load_index(spark: SparkSession, path: str) -> Index:
    """The tables of an index; its vectors must cover its concepts."""
    metadata = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    read = lambda t: _read(spark, f"{path}/{t}", _key(t), metadata["buckets"])
    depth = metadata["reach_depth"]
    index = Index(**{t: read(t) for t in TABLES}, dims=metadata["embedding_dims"], reach=read("reach") if depth else None, reach_depth=depth)
    n, m = index.vectors.count(), index.concepts.count()
    if n != m:
        raise ValueError(f"the index has {n} vectors for {m} concepts")
    return index
