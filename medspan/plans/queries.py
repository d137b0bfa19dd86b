"""Queries of the driver contract: every operator over whole driver tables, with DuckDB SQL where SQL can express it.

The driver's tables hold no drug vocabulary, so adapters turn them into the operators' inputs: ``part`` into a
terminology and notes, customers to regions into a graph, ``benchmark`` into a gazetteer.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from medspan.functions import dose, textnorm
from medspan.functions import lexicon as lx
from medspan.operators import display, graph, mentions, projection, ranking, vectors
from medspan.plans.annotate import annotate, signals
from medspan.session import dealt, remove, shared_folder, spread, stage
from medspan.sources import release
from medspan.sources.index import Index, alias_table, build_index, load_index, make_index

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(column: str) -> Column:
    return F.col(column).cast("string")


# --- SQL building blocks --------------------------------------------------------------------------------------------
def sql_norm(x: str) -> str:
    return rf"trim(regexp_replace(lower(regexp_replace(strip_accents({x}), '[^\x00-\x7F]+', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"


def sql_words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


# --- text ------------------------------------------------------------------------------------------------------------
@query(f"SELECT doc_id, {sql_norm('text')} AS norm FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", textnorm.normalize(F.col("text")).alias("norm"))


@query()
def noisy_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", textnorm.noisy(F.col("text")).alias("norm"))


@query(f"SELECT doc_id, array_to_string(list_filter({sql_words(sql_norm('text'))}, lambda w: NOT list_contains({sql_list(lx.CONTEXT_WORDS)}, w)), ' ') AS stripped FROM documents")
def strip_context_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    normed = spread(table(spark, sf_dir, "documents")).select("doc_id", textnorm.normalize(F.col("text")).alias("norm"))
    return normed.select("doc_id", textnorm.strip_context(F.col("norm")).alias("stripped"))


@query(
    rf"""
WITH parts AS (
  SELECT doc_id, unnest(p) AS token, generate_subscripts(p, 1) - 1 AS part
  FROM (SELECT doc_id, string_split(regexp_replace(text, '({lx.TOKEN})', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS p FROM documents)
), placed AS (SELECT *, sum(length(token)) OVER (PARTITION BY doc_id ORDER BY part) AS e FROM parts)
SELECT doc_id, CAST((part - 1) // 2 AS INTEGER) AS pos, token, CAST(e - length(token) AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end" FROM placed WHERE part % 2 = 1
"""
)
def tokenize_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = mentions.note_lines(spread(table(spark, sf_dir, "documents"))).select("doc_id", "line_no", F.explode("tokens").alias("t"))
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("t.start")) - 1
    return lines.select("doc_id", pos.cast("int").alias("pos"), "t.token", F.col("t.start").cast("long").alias("start"), F.col("t.end").cast("long").alias("end"))


@query(
    r"""
WITH l AS (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) - 1 AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
placed AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS e FROM l)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(e - length(line) AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end" FROM placed
"""
)
def line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.note_lines(spread(table(spark, sf_dir, "documents")), with_tokens=False).select("doc_id", "line_no", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def no_aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "norm_text string, concept_id string, raw_text string, tty string, pos int")


#: White space and digits as Python knows them, for RE2.
_SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_LETTER_FORMS = {x: [x, x.upper(), *[f for f, t in zip(lx.CONFUSABLE_FROM, lx.CONFUSABLE_TO, strict=True) if t.lower() == x]] for x in "abcdefghijklmnopqrstuvwxyz"}
_CASELESS = {"i": ["ı", "İ"], "s": ["ſ"]}  # what else may equal a letter where case is ignored


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{_SPACES}]+|[{_SPACES}]+$', '', 'g')"


def sql_quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_map(pairs: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{sql_quoted(k)}: {sql_quoted(v)}" for k, v in pairs.items()) + "}"


def sql_dense_terms(forms: Callable[[str], list[str]]) -> str:
    """Pattern of the dense list, longest first; each letter in any of its forms."""
    return "|".join("".join(f"[{''.join(forms(c))}]" for c in term) for term in sorted(lx.DENSE_LINE_TERMS, key=len, reverse=True))


_ANY_FORM = sql_dense_terms(lambda c: _LETTER_FORMS[c] + _CASELESS.get(c, []))
_LOW_FORM = sql_dense_terms(lambda c: [c, *_CASELESS.get(c, [])])
_LOOKALIKES = f"{sql_quoted(lx.CONFUSABLE_FROM)}, {sql_quoted(lx.CONFUSABLE_TO)}"
_REPLACED = sql_map(lx.TOKEN_REPLACEMENTS)
_SPELLED = r"\b([a-z] ){2,}[a-z]\b"


def sql_dense_segments(notes: str) -> str:
    """CTEs up to ``segments`` (note, no, line, start, text): the segments of dense lines of ``notes`` (note, text), before brackets are left out."""
    one_from, one_to, many = textnorm.decompositions()
    pair = "w || raw[i + 1]"
    return rf"""
lines AS (SELECT note, unnest(p) AS line, generate_subscripts(p, 1) AS no FROM (SELECT note, string_split(text, chr(10)) AS p FROM {notes} WHERE regexp_matches(text, '[A-Za-z0-9]'))),
wide AS MATERIALIZED (SELECT *, translate(line, {_LOOKALIKES}) AS alike, regexp_extract_all(line, '[^{_SPACES}]+') AS parts FROM lines WHERE length({sql_trim('line')}) >= 70 AND regexp_matches(line, '{_ANY_FORM}')),
folded AS (SELECT *, array_to_string(list_transform(regexp_extract_all(translate(alike, {sql_quoted(one_from)}, {sql_quoted(one_to)}), '(?s).'), lambda c: CASE WHEN ord(c) < 128 THEN c ELSE coalesce({sql_map(many)}[c], '') END), '') AS plain FROM wide),
normed AS (SELECT *, array_to_string(regexp_extract_all(lower(plain), '[a-z0-9]+'), ' ') AS norm FROM folded),
cut AS (SELECT *, regexp_split_to_array(norm, '{_SPELLED}') AS rest, regexp_extract_all(norm, '{_SPELLED}') AS spelled FROM normed),
joined AS (SELECT *, array_to_string(list_transform(rest, lambda x, i: x || coalesce(replace(spelled[i], ' ', ''), '')), '') AS whole FROM cut),
parted AS (SELECT *, regexp_replace(regexp_replace(whole, '([a-z])([0-9])', '\1 \2', 'g'), '([0-9])([a-z])', '\1 \2', 'g') AS apart FROM joined),
units AS (SELECT *, string_split(regexp_replace(regexp_replace(regexp_replace(apart, '\b([0-9]+) *m *c *g\b', '\1 mcg', 'g'), '\b([0-9]+) *m *g\b', '\1 mg', 'g'), '\b([0-9]+) *m *l\b', '\1 ml', 'g'), ' ') AS raw FROM parted),
zeros AS (SELECT *, list_transform(raw, lambda w: CASE WHEN regexp_full_match(w, '[0-9o]+({lx.UNIT})?') THEN replace(w, 'o', '0') ELSE w END) AS own FROM units),
flagged AS (SELECT *, array_to_string(list_transform(own, lambda w, i: CASE WHEN i < len(raw) AND {_REPLACED}[w] IS NULL AND regexp_full_match(w, '[a-z]{{2,6}}') AND regexp_full_match(raw[i + 1], '[a-z]{{2,8}}')
  AND NOT list_contains({sql_list(lx.CONTEXT_WORDS)}, w) AND NOT list_contains({sql_list(lx.CONTEXT_WORDS)}, raw[i + 1]) AND (length({pair}) >= 7 OR {_REPLACED}[{pair}] IS NOT NULL) THEN '1' ELSE '0' END), '') AS flags FROM zeros),
marked AS (SELECT *, regexp_replace(flags, '1.', 'JS', 'g') AS marks FROM flagged),
repaired AS (SELECT *, array_to_string(list_filter(list_transform(own, lambda w, i: CASE substring(marks, i, 1) WHEN 'J' THEN coalesce({_REPLACED}[{pair}], {pair}) WHEN '0' THEN coalesce({_REPLACED}[w], w) END), lambda w: w IS NOT NULL), ' ') AS fixed FROM marked),
dense AS (SELECT note, no, line, lower(replace(alike, 'İ', 'i' || chr(775))) AS low FROM repaired WHERE length(fixed) >= 50 AND len(regexp_extract_all(fixed, '{sql_dense_terms(lambda c: [c])}')) >= 2
  AND (len(parts) <= 4 OR len(list_filter(parts, lambda w: regexp_matches(w, '[A-Za-z]') AND regexp_matches(w, '\p{{Nd}}'))) >= 2 OR len(list_filter(parts, lambda w: length(w) >= 12)) >= 3)),
named AS (SELECT *, list_transform(regexp_split_to_array(low, '{_LOW_FORM}'), lambda x: length(x)) AS gaps, list_transform(regexp_extract_all(low, '{_LOW_FORM}'), lambda x: length(x)) AS sizes FROM dense),
starts AS (SELECT *, list_transform(sizes, lambda x, i: CAST(list_sum(gaps[:i]) + list_sum(sizes[:i]) - x AS BIGINT)) AS begins FROM named),
hits AS (SELECT note, no, line, unnest(begins) AS "start", unnest(list_append(begins[2:], length(line))) AS after FROM starts WHERE len(begins) > 0),
segments AS MATERIALIZED (SELECT * FROM (SELECT note, no, line, "start", trim(substring(line, "start" + 1, greatest(after - "start", 0)), ' ,;') AS text FROM hits) WHERE length(text) >= 3)"""


@query(
    rf"""
WITH notes AS (SELECT doc_id, text, regexp_matches(text, '{_ANY_FORM}') AS naming FROM documents),
held AS MATERIALIZED (SELECT row_number() OVER () AS note, doc_id, text FROM notes WHERE naming),
{sql_dense_segments('held')},
wrapped AS (SELECT *, count(*) OVER (PARTITION BY note, no) > 1 AND "start" > 0 AND substring(line, "start", 1) IN ('(', '[') AND substring(line, "start" + length(text) + 1, 1) IN (')', ']') AS dropped FROM segments),
other AS (SELECT doc_id, text FROM notes WHERE NOT naming UNION ALL SELECT doc_id, text FROM held WHERE note NOT IN (SELECT note FROM segments)),
c AS (SELECT doc_id, text, regexp_matches(text, '[A-Za-z0-9]') AS telling, list_filter(list_transform(regexp_split_to_array(text, '[;\n]+'), lambda x: {sql_trim('x')}), lambda x: x <> '') AS p FROM other),
k AS (SELECT doc_id, CASE WHEN telling AND len(p) > 1 THEN p ELSE [{sql_trim('text')}] END AS p, CASE WHEN NOT telling THEN 'unknown' WHEN len(p) > 1 THEN 'fallback_chunk' ELSE 'fallback_whole_text' END AS method FROM c WHERE {sql_trim('text')} <> '')
SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS mention_no, unnest(p) AS text, method FROM k
UNION ALL
SELECT doc_id, CAST(row_number() OVER (PARTITION BY note ORDER BY no, "start") - 1 AS INTEGER), w.text, 'dense_line_scan' FROM wrapped w JOIN held USING (note) WHERE NOT dropped
"""
)
def fallback_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes in which a dictionary finds nothing: their dense lines' segments, else their chunks, else the whole text; without letters or digits, the bare text."""
    notes = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mentions.detect_mentions(notes, no_aliases(spark)).select("doc_id", F.col("mention_no").cast("int").alias("mention_no"), "text", "method")


@query()
def token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").select("p_partkey", textnorm.normalize(F.concat_ws(" ", "p_name", "p_type")).alias("norm"))
    after = n.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("norm").alias("norm_after"))
    words = lambda c: F.array_distinct(textnorm.words(F.col(c)))
    return n.join(after, "p_partkey").select("p_partkey", F.round(projection.word_jaccard(words("norm"), words("norm_after")), 6).alias("jaccard"))


ORACLE_SQL["token_jaccard"] = f"""
WITH n AS (SELECT p_partkey, list_distinct({sql_words(sql_norm("p_name || ' ' || p_type"))}) AS w FROM part)
SELECT a.p_partkey, CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0 ELSE round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) END AS jaccard
FROM n a JOIN n b ON b.p_partkey = a.p_partkey + 1
"""

_SHORT = sorted(lx.TOKEN_REPLACEMENTS)
_SHORT_OF = f"({sql_list(_SHORT)})[p_partkey % {len(_SHORT)} + 1]"
_WHOLE_OF = f"({sql_list([lx.TOKEN_REPLACEMENTS[k] for k in _SHORT])})[p_partkey % {len(_SHORT)} + 1]"


@query(f"""SELECT p_partkey AS doc_id, upper({_SHORT_OF}) AS text, 0 AS "start", {_WHOLE_OF} AS norm_text, 'exact_alias_span' AS method, 'noisy_norm' AS lookup_source, {_WHOLE_OF} AS concept_id FROM part""")
def token_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shorthand, with a dictionary of the whole names: the repaired form of a token is what is found."""
    short = F.get(F.array(*[F.lit(x) for x in _SHORT]), (F.col("p_partkey") % len(_SHORT)).cast("int"))
    notes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.upper(short).alias("text"))
    known = spark.createDataFrame([(x, x, x, "IN", 1) for x in sorted(set(lx.TOKEN_REPLACEMENTS.values()))], no_aliases(spark).schema)
    found = mentions.detect_mentions(notes, known)
    return found.select("doc_id", "text", "start", "norm_text", "method", "lookup_source", F.get("exact_ids", F.lit(0)).alias("concept_id"))


# --- terminology from parts --------------------------------------------------------------------------------------------
_CELLS = {0: "CAST(p_partkey AS VARCHAR)", 1: "CASE WHEN p_size % 7 = 0 THEN 'SPA' ELSE 'ENG' END", 6: "CASE WHEN p_size % 2 = 0 THEN 'Y' ELSE 'N' END", 11: "CASE WHEN p_size % 5 = 0 THEN 'OTHER' ELSE 'TERMS' END", 12: "'SCD'", 14: "p_name || ' ' || p_size || ' mg'", 16: "CASE WHEN p_size % 11 = 0 THEN 'O' ELSE 'N' END"}
_LINE = " || '|' || ".join(_CELLS.get(i, "''") for i in range(18)) + " || '|'"


@query(
    f"""
WITH l AS (SELECT p_partkey AS line_no, string_split({_LINE}, '|') AS c FROM part)
SELECT line_no, c[1] AS concept_id, c[13] AS tty, c[15] AS raw_name, {sql_norm('c[15]')} AS norm_text FROM l
WHERE len(c) >= 18 AND c[12] = 'TERMS' AND c[2] = 'ENG' AND c[17] NOT IN ('Y', 'O') AND {sql_norm('c[15]')} <> ''
"""
)
def release_parse_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line_no"), F.expr(_LINE.replace("VARCHAR", "STRING")).alias("value"))
    return release.kept_names(release.parse(lines, release.NAME_COLUMNS, release.NAME_WIDTH), "TERMS").select("line_no", "concept_id", "tty", "raw_name", "norm_text")


def brand_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of brands: parts are rows in key order, types rotate over the part size."""
    kinds = F.array(*[F.lit(t) for t in ("SBD", "SCD", "BN", "IN", "PSN")])
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("line_no"),
        F.col("p_brand").alias("concept_id"),
        F.when(F.col("p_size") % 3 == 0, "Y").otherwise("N").alias("ispref"),
        F.get(kinds, F.col("p_size") % 5).alias("tty"),
        F.col("p_name").alias("raw_name"),
        textnorm.normalize(F.col("p_name")).alias("norm_text"),
    )


_RANKED = """(CASE WHEN p_size % 3 = 0 THEN 0 ELSE 1 END), (CASE p_size % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 4 WHEN 3 THEN 6 ELSE 9 END), length(p_name), p_partkey"""
_TYPE = "(['SBD','SCD','BN','IN','PSN'])[p_size % 5 + 1]"


@query(f"SELECT concept_id, preferred_name FROM (SELECT p_brand AS concept_id, p_name AS preferred_name, row_number() OVER (PARTITION BY p_brand ORDER BY {_RANKED}) AS n FROM part) WHERE n = 1")
def preferred_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return release.preferred_names(brand_names(spark, sf_dir))


@query(f"SELECT concept_id, tty, name FROM (SELECT p_brand AS concept_id, {_TYPE} AS tty, p_name AS name, row_number() OVER (PARTITION BY p_brand, p_size % 5 ORDER BY {_RANKED}) AS n FROM part) WHERE n = 1")
def typed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return release.typed_names(brand_names(spark, sf_dir))


@query(
    f"""
WITH d AS (SELECT p_brand AS concept_id, {sql_norm('p_name')} AS a, min(p_partkey) AS k FROM part GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY k) AS n FROM d)
SELECT concept_id, string_agg(a, '|' ORDER BY n) AS aliases FROM r WHERE n <= 8 GROUP BY concept_id
"""
)
def first_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = release.first_aliases(brand_names(spark, sf_dir).withColumn("line_no", F.struct("line_no")), 8)
    return made.select("concept_id", F.array_join("aliases", "|").alias("aliases"))


@query("SELECT p_partkey AS line_no, p_brand AS concept_id FROM part WHERE p_partkey <= (SELECT max(f) FROM (SELECT min(p_partkey) AS f FROM part GROUP BY p_brand ORDER BY f LIMIT 10))")
def concept_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return release.first_concepts(brand_names(spark, sf_dir), 10).select("line_no", "concept_id")


@query()
def primary_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = brand_names(spark, sf_dir).select(F.concat_ws(" ", "concept_id", "raw_name").alias("concept_id"), "tty")
    return names.groupBy("concept_id").agg(ranking.primary_type().alias("primary_type"))


ORACLE_SQL["primary_type"] = f"SELECT concept_id, tty AS primary_type FROM (SELECT p_brand || ' ' || p_name AS concept_id, {_TYPE} AS tty, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY CASE p_size % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 5 WHEN 3 THEN 7 ELSE 99 END) AS n FROM part) WHERE n = 1"


# --- graph -------------------------------------------------------------------------------------------------------------
def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations part - supplier - nation - region under terminology relation names."""
    t = lambda n: table(spark, sf_dir, n)
    rows = [
        dealt(t("lineitem").select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey").distinct().select(F.concat(F.lit("p"), _text("l_partkey")).alias("src"), F.concat(F.lit("s"), _text("l_suppkey")).alias("dst"), F.lit("has_ingredient").alias("rela")),
        t("supplier").select(F.concat(F.lit("s"), _text("s_suppkey")).alias("src"), F.concat(F.lit("n"), _text("s_nationkey")).alias("dst"), F.lit("consists_of").alias("rela")),
        t("nation").select(F.concat(F.lit("n"), _text("n_nationkey")).alias("src"), F.concat(F.lit("r"), _text("n_regionkey")).alias("dst"), F.lit("contains").alias("rela")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).withColumn("rel", F.lit("RO"))


_EDGES = """e1 AS (
  SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, 'has_ingredient' AS rela FROM lineitem
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'consists_of' FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'contains' FROM nation
), e AS (SELECT src, dst, rela FROM e1 UNION SELECT dst, src, rela FROM e1)"""


@query(f"WITH {_EDGES} SELECT src, dst, rela FROM e")
def edge_symmetrize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return release.both_ways(supply_edges(spark, sf_dir)).select("src", "dst", "rela")


@query(
    """
SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst, 'part_of' AS rela FROM orders
WHERE o_orderstatus <> 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)
"""
)
def semi_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("line_no"), F.concat(F.lit("o"), _text("o_orderkey")).alias("src"), F.concat(F.lit("c"), _text("o_custkey")).alias("dst"), F.lit("RO").alias("rel"), F.lit("part_of").alias("rela"), F.lit("TERMS").alias("sab"), F.when(F.col("o_orderstatus") == "F", "Y").otherwise("N").alias("suppress")
    )
    customers = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.concat(F.lit("c"), _text("c_custkey")).alias("concept_id"))
    orders = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.concat(F.lit("o"), _text("l_orderkey")).alias("concept_id")).distinct()
    return release.kept_relations(rows, customers.unionByName(orders), "TERMS").select("src", "dst", "rela")


@query(f"WITH {_EDGES} SELECT DISTINCT src, dst FROM e WHERE rela IN ('contains', 'contained_in', 'consists_of', 'constitutes')")
def neighbors_by_rela(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbors(release.both_ways(supply_edges(spark, sf_dir)), lx.relations("contains consists"))


@query(
    f"""
WITH RECURSIVE {_EDGES}, targets(target, rels) AS (VALUES {", ".join(f"('{t}', {sql_list(r)})" for t, r in lx.TARGET_RELATIONS.items())}),
walk(seed, target, node, depth) AS (
  SELECT 'r' || r_regionkey, target, 'r' || r_regionkey, 0 FROM region, targets
  UNION SELECT w.seed, w.target, e.dst, w.depth + 1 FROM walk w JOIN e ON e.src = w.node JOIN targets t ON t.target = w.target AND list_contains(t.rels, e.rela) WHERE w.depth < 3
) SELECT seed, target, node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY ALL
"""
)
def closure_min_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = stage(release.both_ways(supply_edges(spark, sf_dir)).select("src", "dst", "rela"))  # as the index holds them: made once
    targets = spark.createDataFrame([(t,) for t in lx.TARGET_RELATIONS], "target string")
    seeds = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), _text("r_regionkey")).alias("seed")).crossJoin(targets)
    return graph.closure(seeds, edges, graph.relation_table(spark), 3).select("seed", "target", "node", F.col("depth").cast("int").alias("depth"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One product for each name and size, with the brand and kind of its first part."""
    first = table(spark, sf_dir, "part").groupBy("p_name", "p_size").agg(F.min_by("p_brand", "p_partkey").alias("brand"), F.min_by("p_type", "p_partkey").alias("kind"), F.min("p_partkey").alias("n"))
    return first.withColumn("product", F.concat_ws(" ", "p_name", F.concat(_text("p_size"), F.lit(" mg")), "kind"))


def part_terms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(names, relations) of a terminology made from parts: ingredients, brands, and products of both."""
    made = products(spark, sf_dir)
    ingredient, brand, product = F.concat(F.lit("i:"), "p_name"), F.concat(F.lit("b:"), "brand"), F.concat(F.lit("s:"), "product")
    names = None
    for k, (concept, tty, name) in enumerate([(ingredient, "IN", F.col("p_name")), (brand, "BN", F.col("brand")), (product, "SCD", F.col("product"))]):
        rows = made.groupBy(concept.alias("concept_id"), name.alias("raw_name")).agg(F.struct(F.lit(k).alias("k"), F.min("n").alias("n")).alias("line_no")).withColumns({"tty": F.lit(tty), "ispref": F.lit("Y")})
        names = rows if names is None else names.unionByName(rows)
    names = names.withColumn("norm_text", textnorm.normalize(F.col("raw_name"))).where("norm_text <> ''")
    links = made.select(product.alias("src"), F.explode(F.array(F.struct(F.lit("has_ingredient").alias("rela"), ingredient.alias("dst")), F.struct(F.lit("has_tradename").alias("rela"), brand.alias("dst")))).alias("e"))
    return names, links.select("src", "e.dst", F.lit("RO").alias("rel"), "e.rela").distinct()


@query(
    """
WITH p AS (SELECT 'i:' || p_name AS i, 'b:' || arg_min(p_brand, p_partkey) AS b, 's:' || p_name || ' ' || p_size || ' mg ' || arg_min(p_type, p_partkey) AS s FROM part GROUP BY p_name, p_size),
f AS (SELECT i AS concept_id, i AS found FROM p UNION SELECT s, i FROM p UNION SELECT b, i FROM p)
SELECT concept_id, string_agg(found, '|' ORDER BY found) AS ingredients FROM f GROUP BY concept_id
"""
)
def ingredient_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, relations = part_terms(spark, sf_dir)
    concepts = names.select("concept_id").distinct()
    made = graph.ingredient_sets(concepts, names, release.both_ways(relations))
    return made.select("concept_id", F.array_join("ingredients", "|").alias("ingredients"))


# --- matching and context ----------------------------------------------------------------------------------------------
_HIT = "STRUCT(i BIGINT, n BIGINT)"


@query(
    rf"""
WITH a AS (SELECT DISTINCT array_to_string(w[1:1 + conv_id % 8], ' ') AS norm FROM (SELECT conv_id, {sql_words(sql_norm('text'))} AS w FROM conversations WHERE turn = 0) WHERE len(w) > 0),
l AS (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS no, p FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
b AS (SELECT doc_id, no, line, length(array_to_string(p[1:no - 1], chr(10))) + CASE WHEN no > 1 THEN 1 ELSE 0 END AS lead_ FROM l),
q AS (SELECT doc_id, no, line, lead_, unnest(p) AS token, generate_subscripts(p, 1) - 1 AS part FROM (SELECT *, string_split(regexp_replace(line, '({lx.TOKEN})', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS p FROM b)),
e AS (SELECT *, sum(length(token)) OVER (PARTITION BY doc_id, no ORDER BY part) AS e FROM q),
t AS (SELECT doc_id, no, line, lead_, e - length(token) AS s, e, row_number() OVER (PARTITION BY doc_id, no ORDER BY part) AS i FROM e WHERE part % 2 = 1),
s AS (SELECT x.doc_id, x.no, x.lead_, x.i, y.i - x.i + 1 AS n, x.s, y.e, substr(x.line, CAST(x.s + 1 AS BIGINT), CAST(y.e - x.s AS BIGINT)) AS span FROM t x JOIN t y ON y.doc_id = x.doc_id AND y.no = x.no AND y.i BETWEEN x.i AND x.i + 7),
h AS (SELECT *, {sql_norm('span')} AS norm FROM s WHERE n = 1 OR NOT contains(span, ',') OR contains(lower(span), ' and ') OR contains(lower(span), ' with ') OR contains(span, '/') OR contains(span, '+')),
w AS (SELECT *, {sql_words('norm')} AS w FROM h WHERE norm <> '' AND norm NOT IN {tuple(lx.NON_DRUG_TERMS)}),
v AS (SELECT *, list_filter(w, lambda x: NOT list_contains({sql_list([*lx.CONTEXT_WORDS, *lx.STRENGTH_UNITS])}, x) AND regexp_matches(x, '[a-z]')) AS names, list_filter(w, lambda x: NOT list_contains({sql_list(lx.CONTEXT_WORDS)}, x)) AS stripped FROM w),
u AS (SELECT * EXCLUDE (norm), unnest(p) AS norm, generate_subscripts(p, 1) AS rank FROM (SELECT *, [norm, array_to_string(stripped, ' '), array_to_string(names, ' '), CASE WHEN len(names) BETWEEN 2 AND 3 THEN array_to_string(list_sort(names), ' ') END] AS p FROM v)),
k AS (SELECT doc_id, no, lead_, i, n, s, e, arg_min(norm, rank) AS norm FROM u JOIN a USING (norm) GROUP BY ALL),
f AS (SELECT doc_id, no, list_reduce(list(struct_pack(kept := []::{_HIT}[], i := i, n := n) ORDER BY n DESC, i),
  lambda y, x: CASE WHEN len(list_filter(y.kept, lambda z: z.i < x.i + x.n AND x.i < z.i + z.n)) > 0 THEN y ELSE struct_pack(kept := list_append(y.kept, struct_pack(i := x.i, n := x.n)), i := x.i, n := x.n) END,
  struct_pack(kept := []::{_HIT}[], i := 0::BIGINT, n := 0::BIGINT)).kept AS kept FROM k GROUP BY doc_id, no)
SELECT k.doc_id, CAST(lead_ + s AS INTEGER) AS "start", CAST(lead_ + e AS INTEGER) AS "end", norm AS norm_text, n AS words FROM k JOIN f ON f.doc_id = k.doc_id AND f.no = k.no WHERE list_contains(kept, struct_pack(i := k.i, n := k.n))
"""
)
def gazetteer_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against a dictionary of 1 to 8 words: how the conversations begin."""
    first = table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", textnorm.words(textnorm.normalize(F.col("text"))).alias("w"))
    names = first.select(F.col("conv_id").alias("line_no"), F.concat(F.lit("c"), _text("conv_id")).alias("concept_id"), F.lit("BN").alias("tty"), F.array_join(F.slice("w", 1, (F.col("conv_id") % 8 + 1).cast("int")), " ").alias("norm_text")).where("norm_text <> ''")
    found = mentions.detect_mentions(table(spark, sf_dir, "documents").select("doc_id", "text"), alias_table(names.withColumn("raw_name", F.col("norm_text"))), only=["start", "end", "norm_text", "tokens"], methods=["exact_alias_span"])
    return found.select("doc_id", "start", "end", "norm_text", F.col("tokens").cast("long").alias("words"))


@query(
    f"""
WITH d AS (SELECT {sql_norm('p_name')} AS norm_text, p_brand AS concept_id, {_TYPE} AS tty, min(p_partkey) AS k FROM part GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY norm_text ORDER BY k) AS n FROM d)
SELECT norm_text, string_agg(concept_id || ':' || tty, '|' ORDER BY n) AS rows FROM r WHERE n <= 25 GROUP BY norm_text
"""
)
def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a look-up of each name returns: its first 25 concepts and types in file order."""
    rows = mentions.dictionary(alias_table(brand_names(spark, sf_dir)), 25)
    return rows.select("norm_text", F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["concept_id"], r["tty"])), "|").alias("rows"))


_LEFT, _RIGHT = "'Seen today; plan: she continues '", "' ' || p_size || ' mg PO BID but rests, plus walks. Review soon!'"


def span_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with a known span: the part's name within a fixed sentence."""
    line = F.expr(f"{_LEFT} || p_name || {_RIGHT}")
    return table(spark, sf_dir, "part").select("p_partkey", line.alias("line"), F.lit(len(_LEFT) - 2).alias("start"), (F.lit(len(_LEFT) - 2) + F.length("p_name")).alias("end"))


@query(
    rf"SELECT p_partkey, {sql_strip(rf"regexp_extract({_LEFT}, '[^.;:!?,]*$') || p_name || regexp_extract({_RIGHT}, '^[^.;:!?,]*')")} AS clause FROM part"
)
def clause_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_notes(spark, sf_dir).select("p_partkey", textnorm.clause_around(F.col("line"), F.col("start"), F.col("end")).alias("clause"))


def _sql_segments() -> str:
    left, right = _LEFT, _RIGHT
    for mark in lx.SEGMENT_BREAKS:
        left = rf"regexp_extract({left}, '(?is)^(?:.*{mark})?(.*)$', 1)"
        right = rf"regexp_extract({right}, '(?is)^(.*?)(?:{mark}.*)?$', 1)"
    return sql_strip(f"{left} || p_name || {right}")


@query(f"SELECT p_partkey, {_sql_segments()} AS segment FROM part")
def focused_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_notes(spark, sf_dir).select("p_partkey", textnorm.segment_around(F.col("line"), F.col("start"), F.col("end")).alias("segment"))


_NEGATED = "CASE l_linenumber % 4 WHEN 0 THEN 'Patient denies taking ' WHEN 1 THEN 'Continue ' WHEN 2 THEN 'No fever but ' ELSE 'Yesterday ' END"
_AFTER = "CASE l_linenumber % 4 WHEN 3 THEN ' was held overnight' ELSE ' daily' END"


@query(
    rf"""
WITH n AS (SELECT l_orderkey, l_linenumber, {_NEGATED} || p_name || {_AFTER} AS line, {sql_norm('p_name')} AS norm FROM lineitem JOIN part ON p_partkey = l_partkey),
c AS (SELECT *, {sql_norm('line')} AS clause, string_split(norm, ' ')[1] AS anchor FROM n),
m AS (SELECT *, regexp_extract(clause, '\b(?:{lx.NEGATION_CUES})\b(?:\s+\w+){{0,8}}\s+\b' || anchor || '\b') AS cue FROM c)
SELECT l_orderkey, l_linenumber, (cue <> '' AND NOT regexp_matches(cue, '{lx.NEGATION_BREAKS}')) OR regexp_matches(clause, '\b' || anchor || '\b(?:\s+\w+){{0,6}}\s+\b(?:{lx.LATE_NEGATIONS})\b') AS negated FROM m
"""
)
def negation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("norm", textnorm.normalize(F.col("p_name")))
    lines = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")).join(part, F.col("p_partkey") == F.col("l_partkey"))
    rows = lines.select("l_orderkey", "l_linenumber", F.expr(f"{_NEGATED} || p_name || {_AFTER}").alias("line_text"), F.expr(f"length({_NEGATED})").alias("start"), F.expr(f"length({_NEGATED}) + length(p_name)").alias("end"), F.lit(0).alias("line_start"), F.col("norm").alias("norm_text"))
    return mentions.with_negation(rows).select("l_orderkey", "l_linenumber", "negated")


# --- dose and form -------------------------------------------------------------------------------------------------------
_DOSE_NAME = "p_name || ' ' || (p_size / 2.0) || ' MG ' || p_size || ' mcg ' || p_type"
_SINGLE = lx.SINGLE_STRENGTH


@query(
    rf"""
WITH s AS (SELECT p_partkey, p_size, lower(p_name || ' ' || printf('%.1f', p_size / 2.0) || ' MG ' || p_size || ' mcg ' || p_type) AS low FROM part),
v AS (SELECT p_partkey, list_transform(list_zip(regexp_extract_all(low, '{_SINGLE}', 1), regexp_extract_all(low, '{_SINGLE}', 2)), lambda x: CASE x[2] WHEN 'mg' THEN CAST(x[1] AS DOUBLE) WHEN 'mcg' THEN CAST(x[1] AS DOUBLE) / 1000.0 WHEN 'g' THEN CAST(x[1] AS DOUBLE) * 1000.0 END) AS mg FROM s)
SELECT p_partkey, array_to_string(list_transform(list_sort(list_distinct(list_transform(list_filter(mg, lambda y: y IS NOT NULL), lambda y: round(y, 6)))), lambda y: printf('%.6f', y)), '|') AS mg FROM v
"""
)
def strength_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.col("p_name"), F.lit(" "), F.format_string("%.1f", F.col("p_size") / 2.0), F.lit(" MG "), _text("p_size"), F.lit(" mcg "), F.col("p_type"))
    rows = table(spark, sf_dir, "part").select("p_partkey", dose.strengths_mg(name).alias("mg"))
    return rows.select("p_partkey", F.array_join(F.transform("mg", lambda v: F.format_string("%.6f", v)), "|").alias("mg"))


_FORM_TEXTS = ("oral tablet", "metered dose inhaler hfa", "solution for injection iv", "24 hr capsule xr", "eye drops", "patch er")


def _sql_form_tests(norm: str) -> list[str]:
    return [f"CASE WHEN {' OR '.join(f"contains(' ' || {norm} || ' ', ' {h} ')" for h in hints)} THEN '{form}' END" for form, hints in lx.FORM_HINTS.items()]


def _sql_form_list(norm: str) -> str:
    return f"[{', '.join(_sql_form_tests(norm))}]"


def _sql_forms(norm: str) -> str:
    tests = _sql_form_tests(norm)
    tests.append(f"CASE WHEN contains(' ' || {norm} || ' ', ' oral ') THEN 'oral' END")
    return f"array_to_string(list_filter([{', '.join(tests)}], lambda x: x IS NOT NULL), '|')"


@query(f"WITH n AS (SELECT p_partkey, {sql_norm(f"p_name || ' ' || ({sql_list(_FORM_TEXTS)})[p_size % 6 + 1]")} AS norm FROM part) SELECT p_partkey, {_sql_forms('norm')} AS forms FROM n")
def form_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", "p_name", F.get(F.array(*[F.lit(x) for x in _FORM_TEXTS]), F.col("p_size") % 6))
    return table(spark, sf_dir, "part").select("p_partkey", textnorm.normalize(text).alias("norm")).select("p_partkey", F.array_join(dose.form_flags(F.col("norm")), "|").alias("forms"))


@query(
    """
WITH v AS (SELECT p_partkey, [p_size * 1.0, p_size * 2.0, 500.0] AS a, [p_size * 1.05, p_size * 2.2, 497.0] AS b FROM part)
SELECT p_partkey, CAST(len(list_filter(a, lambda e: len(list_filter(b, lambda x: abs(x - e) <= greatest(0.005, abs(e) * 0.06))) > 0)) AS INTEGER) AS overlap FROM v
"""
)
def strength_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array(size, size * 2.0, F.lit(500.0)).alias("a"), F.array(size * 1.05, size * 2.2, F.lit(497.0)).alias("b"))
    return rows.select("p_partkey", dose.overlap_count(F.col("a"), F.col("b")).alias("overlap"))


_RECORD = "CASE p_size % 3 WHEN 0 THEN 'MED|' || p_name || '|' || p_size || ' mg|PO|daily|active' WHEN 1 THEN 'RXE|1|' || p_name || '^' || p_size || ' mg^IV^cont' ELSE 'note|' || p_name END"


@query(
    f"""
WITH r AS (SELECT p_partkey, {_RECORD} AS t FROM part), s AS (SELECT p_partkey, t, string_split(t, '|') AS p, string_split(string_split(t, '|')[-1], '^') AS q FROM r)
SELECT p_partkey, lower(t) LIKE 'med|%' OR lower(t) LIKE 'rxe|%' AS structured,
  CASE WHEN lower(t) LIKE 'med|%' THEN p[2] WHEN lower(t) LIKE 'rxe|%' THEN q[1] END AS record_name,
  CASE WHEN lower(t) LIKE 'med|%' THEN lower(p[4]) WHEN lower(t) LIKE 'rxe|%' THEN lower(q[3]) ELSE '' END AS record_route,
  CASE WHEN lower(t) LIKE 'med|%' THEN lower(p[5]) WHEN lower(t) LIKE 'rxe|%' THEN lower(q[4]) ELSE '' END AS record_schedule
FROM s
"""
)
def med_record_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_RECORD).alias("t"))
    return dose.with_record(rows, "t").select("p_partkey", "structured", "record_name", "record_route", "record_schedule")


_FORM_OF = f"({sql_list(_FORM_TEXTS)})[p_size % 6 + 1]"
_MENTION = f"""CASE p_size % 5 WHEN 0 THEN p_name || ' ' || p_size || ' mg ' || {_FORM_OF} || ' PO daily'
  WHEN 1 THEN 'MED|' || p_name || '|' || p_size || ' mg|IV|q8h|active' WHEN 2 THEN p_name || ' ' || p_size || '/' || (p_size * 2) || ' 5 mcg/kg/hr drip'
  WHEN 3 THEN p_name || '+' || p_brand || ' ' || p_size || ' 0.5 units' ELSE p_name || ' ' || p_size || ' 25 PO nightly' END"""
_PLAIN_STRENGTH = rf"\b{lx.NUMBER}\s*(?:{lx.UNIT})\b"  # what the texts hold has no rate behind it


def _sql_found(text: str, pattern: str, group: int) -> str:
    return f"regexp_extract_all({text}, '{pattern}', {group})"


def _sql_distinct(values: str) -> str:
    """Distinct values in order of their first place."""
    return f"list_filter({values}, lambda x, i: list_position({values}, x) = i)"


def _sql_numbers(text: str) -> str:
    return f"list_filter(list_transform({_sql_found(text, lx.BARE_NUMBER, 0)}, lambda x: CAST(x AS DOUBLE)), lambda x: x > 0 AND x <= 1500)"


def _sql_key(value: str, unit: str) -> str:
    return f"CASE WHEN {value} = floor({value}) THEN CAST(CAST({value} AS BIGINT) AS VARCHAR) ELSE printf('%.6g', {value}) END || {unit}"


_PAIRS = "list_concat(" + ", ".join(f"list_zip({_sql_found('c', p, v)}, {_sql_found('c', p, u)})" for p, v, u in ((lx.RATIO_STRENGTH, 1, 3), (lx.RATIO_STRENGTH, 2, 3), (lx.SINGLE_STRENGTH, 1, 2))) + ")"


@query(
    rf"""
WITH t AS (SELECT p_partkey, {_MENTION} AS m, {sql_norm('p_name')} AS n, p_size % 5 = 1 AS structured FROM part),
c AS (SELECT *, {sql_norm('m')} AS c, CASE WHEN structured THEN 'iv' ELSE '' END AS route, CASE WHEN structured THEN 'q8h' ELSE '' END AS sched FROM t),
r AS (SELECT *, regexp_matches(c, '{lx.INFUSION_RATE}') AS rate FROM c),
f AS (SELECT *, regexp_matches(c, '\b(?:iv|ivp|ivpb|intravenous)\b') OR route = 'iv' OR rate AS iv, regexp_matches(c, '\b(?:po|oral)\b') AS oral, regexp_matches(c, '{lx.CONTINUOUS}') OR rate AS continuous,
  regexp_matches(c, '{lx.SCHEDULE}') AS schedule, list_filter({_sql_form_list('c')}, lambda x: x IS NOT NULL) AS held FROM r),
g AS (SELECT *, CASE WHEN (route = 'iv' OR rate) AND NOT list_contains(held, 'injection') THEN list_append(held, 'injection') ELSE held END AS forms,
  list_transform({_PAIRS}, lambda x: struct_pack(v := CAST(x[1] AS DOUBLE), u := CASE WHEN x[2] LIKE 'unit%' THEN 'unit' ELSE x[2] END)) AS pairs FROM f),
k AS (SELECT *, flatten(list_transform(pairs, lambda x: list_filter([{_sql_key('x.v', 'x.u')}, CASE x.u WHEN 'mg' THEN {_sql_key('(x.v * 1000.0)', "'mcg'")} WHEN 'mcg' THEN {_sql_key('(x.v / 1000.0)', "'mg'")} END], lambda y: y IS NOT NULL))) AS sigs FROM g)
SELECT p_partkey, structured, iv, oral, continuous, schedule, array_to_string(forms, '|') AS forms,
  array_to_string({_sql_distinct(f"list_transform({_sql_found('c', _PLAIN_STRENGTH, 0)}, lambda x: trim(x))")}, '|') AS strength_tokens, array_to_string(list_sort(list_distinct(sigs)), '|') AS strength_sigs,
  contains(CASE WHEN structured THEN '' ELSE m END, '+') OR regexp_matches(lower(CASE WHEN structured THEN '' ELSE m END), '\b[a-z]{{3,}}\s*[-/]\s*[a-z]{{3,}}\b') AS combo,
  array_to_string(list_transform(list_zip({_sql_found('lower(m)', lx.SLASH_RATIO, 1)}, {_sql_found('lower(m)', lx.SLASH_RATIO, 2)}), lambda x: x[1] || '/' || x[2]), '|') AS ratios,
  array_to_string(list_transform(list_sort(list_distinct({_sql_numbers('c')})), lambda x: printf('%.6f', x)), '|') AS numbers,
  regexp_matches(c, '{_PLAIN_STRENGTH}') OR regexp_matches(c, '{lx.RATIO_STRENGTH}') OR regexp_matches(c, '{lx.UNITS_PER_KG_HOUR}')
    OR (NOT iv AND NOT continuous AND NOT regexp_matches(c, '\b(?:kg|hr|h|min|sec)\b') AND len({_sql_numbers('c')}) > 0 AND (schedule OR oral OR list_has_any(forms, ['tablet', 'capsule', 'er', 'ec', 'xl24', 'oral']))) AS dose_signal
FROM k
"""
)
def mention_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.get(F.array(*[F.lit(x) for x in _FORM_TEXTS]), F.col("p_size") % 6)
    text = F.expr(_MENTION.replace(_FORM_OF, "form_text"))
    rows = table(spark, sf_dir, "part").withColumn("form_text", form).select("p_partkey", text.alias("mention_text"), textnorm.normalize(F.col("p_name")).alias("projection_norm"))
    rows = rows.withColumn("context", textnorm.normalize(F.col("mention_text"))).withColumn("surface", F.col("context"))
    made = dose.with_mention_features(dose.with_record(rows, "mention_text"))
    joined = {c: F.array_join(c, "|") for c in ("forms", "strength_tokens", "strength_sigs")}
    ratios = F.array_join(F.transform("ratios", lambda p: F.format_string("%.0f/%.0f", p["a"], p["b"])), "|")
    numbers = F.array_join(F.transform("numbers", lambda v: F.format_string("%.6f", v)), "|")
    return made.withColumns(joined | {"ratios": ratios, "numbers": numbers}).select("p_partkey", "structured", "iv", "oral", "continuous", "schedule", "forms", "strength_tokens", "strength_sigs", "combo", "ratios", "numbers", "dose_signal")


# --- retrieval, scores, projection -----------------------------------------------------------------------------------------
@query()
def gram_hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", textnorm.normalize(F.concat_ws(" ", "p_name", "p_type")).alias("norm"))
    return rows.select("p_partkey", vectors.embed(F.col("norm"), 256).alias("vec"))


@query(
    """
WITH s AS (SELECT q.vec_id AS query, v.vec_id AS concept_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS s FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, CAST(concept_id AS VARCHAR)) AS rank FROM s)
SELECT CAST(query AS VARCHAR) AS query, CAST(concept_id AS VARCHAR) AS concept_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 40
"""
)
def topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 nearest of all vectors for the stated query set: every vector whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").select(_text("vec_id").alias("id"), "vec_id", F.col("embedding").alias("vec"))
    queries = rows.where("vec_id % 50 = 0").select(F.col("id").alias("query"), "vec")
    return vectors.nearest_vectors(queries, rows.select(F.col("id").alias("concept_id"), "vec"), 40).select("query", "concept_id", "rank")


_VARIANT = "CASE WHEN l_linenumber % 2 = 0 THEN 0.0 ELSE 0.03 END"


@query(
    f"""
WITH c AS (SELECT l_orderkey AS mention_id, CAST(l_suppkey AS VARCHAR) AS concept_id, max(l_discount - {_VARIANT}) AS v FROM lineitem GROUP BY ALL),
e AS (SELECT l_orderkey AS mention_id, CAST(l_suppkey AS VARCHAR) AS concept_id, count(*) * 0.35 AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT mention_id, concept_id, round(v + coalesce(b, 0.0), 6) AS score FROM c LEFT JOIN e USING (mention_id, concept_id)
"""
)
def variant_merge_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mention_id"), _text("l_suppkey").alias("concept_id"), F.expr(f"l_discount - {_VARIANT}").alias("score"), F.struct(F.col("l_linenumber").alias("variant"), F.lit(1).alias("rank")).alias("order"), "l_returnflag", F.col("l_linenumber").alias("pos"))
    made = ranking.merged_scores(rows.drop("l_returnflag", "pos"), rows.where("l_returnflag = 'R'").select("mention_id", "pos", "concept_id"), 0.35)
    return made.select("mention_id", "concept_id", F.round("score", 6).alias("score"))


@query(
    """
WITH s AS (SELECT p_brand AS mention_id, p_type AS target, CAST(p_partkey AS VARCHAR) AS node, p_size AS depth, round(p_retailprice - 1200.0, 2) / 100.0 AS score FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY mention_id, target ORDER BY score DESC, depth, node) AS n FROM s)
SELECT mention_id, target, node, depth FROM r WHERE n = 1 AND score >= -2.5
"""
)
def best_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("mention_id"), F.col("p_type").alias("target"), _text("p_partkey").alias("node"), F.col("p_size").alias("depth"), (F.round(F.col("p_retailprice") - 1200.0, 2) / 100.0).alias("score"), F.col("p_name").alias("name"), F.array().cast("array<double>").alias("mg")
    )
    return projection.best_by_type(rows).select("mention_id", "target", F.col("hit.concept_id").alias("node"), F.col("hit.depth").alias("depth"))


_KIND = "CASE WHEN p_size = 3 AND p_type = 'SMALL' THEN 'IN' WHEN p_size % 2 = 0 THEN 'SCD' ELSE 'BN' END"
_CONTEXT = "CASE p_size % 4 WHEN 0 THEN '20 mg daily' WHEN 1 THEN '10 / 20' ELSE 'po daily' END"
_OTHER = "'Brand#' || (p_size % 25 + 1)"


@query(
    f"""
WITH n AS (SELECT p_brand AS concept, {_KIND} AS tty, {sql_norm('p_name')} AS norm, p_name, p_partkey FROM part),
kind AS (SELECT concept, arg_min(tty, CASE tty WHEN 'SCD' THEN 2 WHEN 'BN' THEN 5 ELSE 7 END) AS best_type FROM n GROUP BY concept),
pref AS (SELECT concept, arg_min(p_name, (CASE tty WHEN 'SCD' THEN 1 WHEN 'BN' THEN 4 ELSE 6 END, length(p_name), p_partkey)) AS best_name FROM n GROUP BY concept),
named AS (SELECT norm, arg_min(concept, p_partkey) AS concept FROM n WHERE tty = 'IN' GROUP BY norm),
m AS (SELECT p_partkey, p_size, {sql_norm('p_name')} AS norm, p_size % 4 IN (0, 1) AS strong, CASE WHEN p_size % 3 = 0 THEN [p_brand, {_OTHER}] ELSE []::VARCHAR[] END AS exact FROM part),
c AS (SELECT p_partkey, k, 'Brand#' || ((p_partkey * 7 + k * 5 + p_size) % 25 + 1) AS concept, round(((p_partkey * 13 + k * 29) % 17) / 17.0, 6) AS score FROM part, range(3) r(k)),
top AS (SELECT p_partkey, arg_min(concept, (-score, k)) AS top, max(score) AS top_score FROM c GROUP BY p_partkey),
o AS (SELECT m.*, top, top_score, (SELECT arg_min(e, i) FROM (SELECT unnest(exact) AS e, generate_subscripts(exact, 1) AS i) WHERE e IN (SELECT concept FROM n WHERE tty = 'IN')) AS exact_in, named.concept AS alias_in FROM m JOIN top USING (p_partkey) LEFT JOIN named USING (norm)),
p AS (SELECT *, CASE WHEN NOT strong AND exact_in IS NOT NULL THEN exact_in ELSE top END AS step FROM o),
b AS (SELECT *, CASE WHEN NOT strong AND alias_in IS NOT NULL THEN alias_in ELSE step END AS best FROM p)
SELECT b.p_partkey, best AS best_id, coalesce(x.score, y.score, top_score) AS best_score, best_name, best_type, list_contains(exact, best) AS exact_match, step <> top AS exact_override, best <> step AS alias_override,
  CASE WHEN best <> step THEN 'no_strength_in_alias_override' WHEN step <> top THEN 'no_strength_in_exact_override' WHEN list_contains(exact, best) THEN 'embedding_plus_exact' ELSE 'embedding_ranked' END AS selection_reason
FROM b LEFT JOIN c x ON x.p_partkey = b.p_partkey AND x.concept = best LEFT JOIN c y ON y.p_partkey = b.p_partkey AND y.concept = step LEFT JOIN kind ON kind.concept = best LEFT JOIN pref ON pref.concept = best
"""
)
def best_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The choice among ranked candidates: best score, overrides by ingredients, reasons."""
    part = table(spark, sf_dir, "part")
    names = part.select(F.col("p_partkey").alias("line_no"), F.col("p_brand").alias("concept_id"), F.lit("Y").alias("ispref"), F.expr(_KIND).alias("tty"), F.col("p_name").alias("raw_name"), textnorm.normalize(F.col("p_name")).alias("norm_text"))
    names = stage(names)
    index = Index(stage(release.preferred_names(names)), stage(release.typed_names(names)), stage(alias_table(names)), names, names, names)  # few rows, whatever the names
    none = F.array().cast("array<string>")
    found = part.select(F.col("p_partkey").alias("mention_id"), textnorm.normalize(F.col("p_name")).alias("norm_text"), F.expr(_CONTEXT).alias("context"), F.when(F.col("p_size") % 3 == 0, F.array("p_brand", F.expr(_OTHER))).otherwise(none).alias("exact_ids"))
    found = found.withColumn("projection_norm", textnorm.strip_context(F.col("norm_text")))
    k = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")
    ranked = part.select(F.col("p_partkey").alias("mention_id"), "p_size", k).select("mention_id", F.expr("'Brand#' || ((mention_id * 7 + k * 5 + p_size) % 25 + 1)").alias("concept_id"), F.expr("round(((mention_id * 13 + k * 29) % 17) / 17.0D, 6)").alias("score"), F.struct(F.col("k").alias("variant"), F.lit(1).alias("rank")).alias("order"))
    made = ranking.chosen(found, stage(ranked), index)
    return made.select(F.col("mention_id").alias("p_partkey"), "best_id", "best_score", "best_name", "best_type", "exact_match", "exact_override", "alias_override", "selection_reason")


_BITS = dose.FORM_BITS


def _sql_close(values: str, e: str) -> str:
    return f"len(list_filter({values}, lambda z: abs(z - {e}) <= greatest(0.005, abs({e}) * 0.06))) > 0"


def _sql_count(wanted: str, values: str) -> str:
    return f"len(list_filter({wanted}, lambda y: {_sql_close(values, 'y')}))"


def _sql_has(column: str, *kinds: str) -> str:
    return f"({column} & {sum(_BITS[k] for k in kinds)}) <> 0"


#: The score of a candidate term by term, as its rules are stated: (condition, points).
_TERMS = [
    ("true", "1.8 * CASE WHEN len(list_intersect(pw, nw)) = 0 THEN 0.0 ELSE len(list_intersect(pw, nw)) / (len(pw) + len(nw) - len(list_intersect(pw, nw))) END - 0.45 * depth"),
    ("len(tokens) > 0", "CASE WHEN len(list_filter(tokens, lambda x: contains(name, x))) > 0 THEN 1.8 * len(list_filter(tokens, lambda x: contains(name, x))) ELSE -0.6 END"),
    ("len(sigs) > 0", "CASE WHEN len(csigs) = 0 THEN -0.8 WHEN len(list_intersect(sigs, csigs)) > 0 THEN 2.2 * len(list_intersect(sigs, csigs)) ELSE -1.4 END"),
    ("len(ratios) > 0 AND len(mg) >= 2", f"CASE WHEN len(list_filter(ratios, lambda x: (({_sql_close('mg', 'x.a')}) AND ({_sql_close('mg', 'x.b')})) OR (x.a >= 10 AND x.b >= 10 AND ({_sql_close('mg', '(x.a / 1000.0)')}) AND ({_sql_close('mg', '(x.b / 1000.0)')})))) > 0 THEN 3.4 ELSE -1.3 END"),
    ("len(numbers) > 0 AND len(mg) > 0", f"CASE WHEN {_sql_count('numbers', 'mg')} > 0 THEN 1.25 * least({_sql_count('numbers', 'mg')}, 2) WHEN len(ratios) = 0 THEN -0.4 ELSE 0 END"),
    ("coalesce(len(preferred), 0) > 0", f"CASE WHEN len(mg) = 0 THEN -0.5 WHEN {_sql_count('preferred', 'mg')} > 0 THEN 2.0 * least({_sql_count('preferred', 'mg')}, 2) ELSE -2.2 END"),
    ("hints <> 0", "CASE WHEN bit_count(hints & flags) > 0 THEN 1.2 * bit_count(hints & flags) ELSE -0.9 END"),
    (f"{_sql_has('hints', 'inhaler')} AND {_sql_has('flags', 'tablet', 'capsule', 'oral', 'injection')}", "-2.4"),
    (f"{_sql_has('hints', 'inhaler')} AND {_sql_has('flags', 'inhaler')}", "2.4"),
    (f"{_sql_has('hints', 'inhaler')} AND NOT {_sql_has('flags', 'inhaler')}", "-3.2"),
    (f"{_sql_has('hints', 'inhaler')} AND {_sql_has('flags', 'solution')} AND NOT {_sql_has('flags', 'inhaler')}", "-2.2"),
    (f"{_sql_has('hints', 'dry_powder')} AND {_sql_has('flags', 'dry_powder')}", "0.8"),
    (f"{_sql_has('hints', 'injection')} AND {_sql_has('flags', 'tablet', 'capsule', 'oral', 'inhaler')}", "-2.4"),
    (f"{_sql_has('hints', 'tablet', 'capsule')} AND {_sql_has('flags', 'inhaler')}", "-2.0"),
    (f"schedule AND {_sql_has('flags', 'injection')} AND NOT {_sql_has('hints', 'injection')}", "-2.4"),
    (f"schedule AND {_sql_has('flags', 'oral', 'tablet', 'capsule', 'dr', 'er')}", "0.6"),
    (f"iv AND routed AND {_sql_has('flags', 'injection')}", "3.2"),
    (f"iv AND routed AND NOT {_sql_has('flags', 'injection')}", "-4.6"),
    (f"iv AND routed AND {_sql_has('flags', 'patch', 'sublingual')}", "-3.5"),
    (f"oral AND routed AND {_sql_has('flags', 'oral', 'tablet', 'capsule', 'dr', 'er')}", "0.9"),
    (f"oral AND routed AND {_sql_has('flags', 'injection')}", "-3.2"),
    (f"oral AND routed AND {_sql_has('flags', 'tablet')}", "0.9"),
    (f"oral AND routed AND {_sql_has('flags', 'capsule')} AND NOT {_sql_has('hints', 'capsule')}", "-1.1"),
    (f"continuous AND iv AND routed AND {_sql_has('flags', 'injection')}", "0.9"),
    (f"continuous AND iv AND routed AND {_sql_has('flags', 'patch', 'sublingual')}", "-2.8"),
    (f"contains(name, 'dry powder') AND NOT {_sql_has('hints', 'dry_powder')}", "-1.8"),
    (f"{_sql_has('flags', 'solution')} AND NOT {_sql_has('hints', 'solution', 'inhaler', 'injection')}", "-0.9"),
    (f"contains(' ' || name || ' ', ' granules ') AND NOT {_sql_has('hints', 'suspension')}", "-0.8"),
    ("len(anchors) > 0", "CASE WHEN len(found) = 0 THEN -0.4 WHEN list_sort(found) = list_sort(anchors) THEN 2.4 WHEN list_has_all(found, anchors) THEN 0.3 + CASE WHEN combined THEN 0 ELSE -4.0 END WHEN list_has_any(found, anchors) THEN 0.1 + CASE WHEN NOT combined AND len(found) > len(anchors) THEN -3.2 ELSE 0 END ELSE -3.0 END"),
    ("len(anchors) > 0 AND len(found) > len(anchors)", "-1.6 * (len(found) - len(anchors))"),
    ("len(anchors) > 0 AND len(found) > len(anchors) AND NOT combined", "-2.0"),
    ("target IN ('GPCK', 'BPCK') AND NOT contains(' ' || name || ' ', ' pack ')", "-1.0"),
]
_TAIL = "CASE c.p_partkey % 5 WHEN 0 THEN ' dry powder' WHEN 1 THEN ' granules' WHEN 2 THEN ' pack' WHEN 3 THEN ' 5 ml' ELSE '' END"


@query(
    f"""
WITH j AS (SELECT m.p_partkey AS k, m.p_size AS s, m.p_name || ' ' || m.p_type AS mtext, c.p_partkey AS n, CASE WHEN c.p_partkey % 2 = 0 THEN m.p_size ELSE c.p_size END AS t, c.p_name || ' ' || c.p_type AS ctext, {_TAIL} AS tail FROM part m JOIN part c ON c.p_partkey IN (m.p_partkey + 1, m.p_partkey + 7, m.p_partkey + 18)),
f AS (SELECT k, n, ({sql_list(lx.TARGET_TYPES)})[n % 9 + 1] AS target, t % 4 AS depth, {sql_norm("ctext || ' ' || t || ' mg' || tail")} AS name, list_distinct({sql_words(sql_norm('mtext'))}) AS pw,
  CASE s % 3 WHEN 0 THEN [s || ' mg'] WHEN 1 THEN []::VARCHAR[] ELSE [s || ' mg', '5 ml'] END AS tokens, CASE WHEN s % 4 = 0 THEN []::VARCHAR[] ELSE [s || 'mg', (s * 1000) || 'mcg'] END AS sigs,
  CASE s % 5 WHEN 0 THEN [struct_pack(a := s * 1.0::DOUBLE, b := s * 2.0::DOUBLE)] WHEN 1 THEN [struct_pack(a := s * 1000.0::DOUBLE, b := s * 2000.0::DOUBLE)] ELSE []::STRUCT(a DOUBLE, b DOUBLE)[] END AS ratios,
  CASE WHEN s % 6 = 0 THEN []::DOUBLE[] ELSE [s * 1.0::DOUBLE, 500.0::DOUBLE] END AS numbers, CASE s % 7 WHEN 0 THEN NULL WHEN 1 THEN []::DOUBLE[] ELSE [s * 1.0::DOUBLE, s * 2.0::DOUBLE] END AS preferred,
  (k * 7919 % 524288) & (k * 104729 % 524288) AS hints, (n * 6271 % 524288) & (n * 15485863 % 524288) AS flags, k % 2 = 0 AS combo, k % 3 = 0 AS structured, k % 4 = 1 AS iv, k % 5 < 2 AS oral, k % 6 < 2 AS continuous, k % 7 < 3 AS schedule,
  ['a', 'b', 'c'][1:k % 4] AS anchors, CASE WHEN t % 4 = 1 THEN []::VARCHAR[] ELSE [t || 'mg'] END AS csigs, CASE WHEN t % 3 = 0 THEN []::DOUBLE[] ELSE [t * 1.0::DOUBLE, t * 2.0::DOUBLE] END AS mg,
  CASE n % 5 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['a'] WHEN 2 THEN ['a', 'b'] WHEN 3 THEN ['b', 'c', 'd'] ELSE ['d'] END AS found FROM j),
g AS (SELECT *, list_distinct({sql_words('name')}) AS nw, combo OR len(anchors) > 1 AS combined, target IN ('SBD', 'SCD', 'GPCK', 'BPCK', 'BN', 'SCDC') AS routed FROM f)
SELECT k AS p_partkey, n AS candidate, target, round(CASE WHEN target = 'MIN' AND ((structured AND NOT combo) OR NOT combined) THEN -1000.0 ELSE {" + ".join(f"CASE WHEN {when} THEN {points} ELSE 0 END" for when, points in _TERMS)} END, 6) + 0.0 AS score FROM g
"""
)
def candidate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scorer over mentions and candidates whose features take all values."""
    part = table(spark, sf_dir, "part")
    m, c = part.alias("m"), part.alias("c")
    ahead = m.select("*", F.explode(F.array(*[F.col("m.p_partkey") + x for x in (1, 7, 18)])).alias("n"))
    j = ahead.join(c, F.col("n") == F.col("c.p_partkey")).select(
        F.col("m.p_partkey").alias("k"), F.col("m.p_size").alias("s"), "n", F.when(F.col("n") % 2 == 0, F.col("m.p_size")).otherwise(F.col("c.p_size")).alias("t"), F.concat_ws(" ", "m.p_name", "m.p_type").alias("mtext"), F.concat_ws(" ", "c.p_name", "c.p_type").alias("ctext"), F.expr(_TAIL).alias("tail")
    )
    k, s, n, t = (F.col(x) for x in "ksnt")
    strings, doubles = (F.array().cast(f"array<{x}>") for x in ("string", "double"))
    sd, td = s.cast("double"), t.cast("double")
    pair = lambda x: F.array(F.struct((sd * x).alias("a"), (sd * 2 * x).alias("b")))
    rows = j.select(
        "k", "n", F.get(F.array(*[F.lit(x) for x in lx.TARGET_TYPES]), (n % 9).cast("int")).alias("target"), (t % 4).alias("depth"), textnorm.normalize(F.concat("ctext", F.lit(" "), t.cast("string"), F.lit(" mg"), "tail")).alias("name_norm"), F.array_distinct(textnorm.words(textnorm.normalize(F.col("mtext")))).alias("projection_words"),
        F.when(s % 3 == 0, F.array(F.concat(s.cast("string"), F.lit(" mg")))).when(s % 3 == 1, strings).otherwise(F.array(F.concat(s.cast("string"), F.lit(" mg")), F.lit("5 ml"))).alias("strength_tokens"),
        F.when(s % 4 == 0, strings).otherwise(F.array(F.concat(s.cast("string"), F.lit("mg")), F.concat((s * 1000).cast("string"), F.lit("mcg")))).alias("strength_sigs"),
        F.when(s % 5 == 0, pair(1.0)).when(s % 5 == 1, pair(1000.0)).otherwise(F.array().cast("array<struct<a:double,b:double>>")).alias("ratios"),
        F.when(s % 6 == 0, doubles).otherwise(F.array(sd, F.lit(500.0))).alias("numbers"), F.when(s % 7 == 0, F.lit(None)).when(s % 7 == 1, doubles).otherwise(F.array(sd, sd * 2)).alias("preferred"),
        (k * 7919 % 524288).bitwiseAND(k * 104729 % 524288).cast("int").alias("form_bits"), (n * 6271 % 524288).bitwiseAND(n * 15485863 % 524288).cast("int").alias("flag_bits"),
        (k % 2 == 0).alias("combo"), (k % 3 == 0).alias("structured"), (k % 4 == 1).alias("iv"), (k % 5 < 2).alias("oral"), (k % 6 < 2).alias("continuous"), (k % 7 < 3).alias("schedule"),
        F.slice(F.array(*[F.lit(x) for x in "abc"]), F.lit(1), (k % 4).cast("int")).alias("anchors"), F.when(t % 4 == 1, strings).otherwise(F.array(F.concat(t.cast("string"), F.lit("mg")))).alias("sigs"), F.when(t % 3 == 0, doubles).otherwise(F.array(td, td * 2)).alias("mg"),
        F.get(F.array(strings, *[F.array(*[F.lit(y) for y in x]) for x in ("a", "ab", "bcd", "d")]), (n % 5).cast("int")).alias("found"),
    )
    rows = rows.withColumn("name_words", F.array_distinct(textnorm.words(F.col("name_norm"))))
    return rows.select(F.col("k").alias("p_partkey"), F.col("n").alias("candidate"), "target", F.round(projection.score(F.col("preferred")), 6).alias("score"))


_A, _B = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
_ANCHORS = "CASE p_size % 5 WHEN 1 THEN {0}'i:' || a{1} WHEN 2 THEN {0}'i:' || a, 'i:' || b{1} WHEN 3 THEN {0}'i:zzz'{1} WHEN 4 THEN {0}'i:' || b{1} ELSE {2} END"
_PARTS_OF = "CASE length(a) % 3 WHEN 1 THEN {0}'i:' || a{1} WHEN 2 THEN {0}'i:' || a, 'i:' || b{1} ELSE {2} END"


@query(
    f"""
WITH m AS (SELECT p_partkey, p_size, {_A} AS a, {_B} AS b FROM part),
w AS (SELECT DISTINCT unnest([a, b]) AS word FROM m),
x AS (SELECT *, {_ANCHORS.format('[', ']', '[]::VARCHAR[]')} AS anchors, {_PARTS_OF.format('[', ']', '[]::VARCHAR[]')} AS parts FROM m),
l AS (SELECT *, CASE WHEN p_size % 2 = 1 THEN list_distinct(list_concat(parts, CASE WHEN len(parts) < 2 THEN ['i:' || a, 'i:' || b] ELSE [] END)) WHEN len(anchors) > 1 THEN anchors ELSE [] END AS listed FROM x),
n AS (SELECT p_partkey, string_agg('i:' || word, '|' ORDER BY lower(upper(word)), word) AS ids FROM (SELECT p_partkey, unnest(listed) AS id FROM l) JOIN w ON id = 'i:' || word WHERE length(word) <> 4 GROUP BY p_partkey)
SELECT p_partkey, ids IS NOT NULL AS in_is_list, coalesce(ids, CASE WHEN p_size % 3 = 0 THEN 'i:' || b WHEN len(anchors) = 1 AND anchors[1] IN (SELECT 'i:' || word FROM w WHERE length(word) <> 4) THEN anchors[1] ELSE '' END) AS ids
FROM l LEFT JOIN n USING (p_partkey)
"""
)
def ingredient_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ingredient projection: own, inferred, or lists of combinations; words of part names stand for ingredients."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("mention_id"), "p_size", F.expr(_A).alias("a"), F.expr(_B).alias("b"))
    none = "cast(array() AS array<string>)"
    word = rows.select(F.explode(F.array("a", "b")).alias("word")).distinct()
    names = word.where(F.length("word") != 4).select(F.concat(F.lit("i:"), "word").alias("concept_id"), F.lit("IN").alias("tty"), F.upper("word").alias("name"))
    aliases = word.select(F.col("word").alias("norm_text"), F.concat(F.lit("i:"), "word").alias("concept_id"), F.lit("IN").alias("tty"), F.lit(1).alias("pos"))
    combined = F.concat(F.lit("m:"), "a", F.lit(":"), "b")
    ingredients = rows.select(combined.alias("concept_id"), F.expr(_PARTS_OF.format("array(", ")", none)).alias("ingredients")).distinct()
    concept = lambda i, n: F.struct(i.alias("concept_id"), n.alias("name"), F.lit(2).alias("depth"))
    entries = F.array_compact(F.array(F.when(F.col("p_size") % 2 == 1, F.struct(F.lit("MIN").alias("k"), concept(combined, F.concat("a", F.lit(" and "), "b", F.lit(" 5"))).alias("v"))), F.when(F.col("p_size") % 3 == 0, F.struct(F.lit("IN").alias("k"), concept(F.concat(F.lit("i:"), "b"), F.lit("own")).alias("v")))))
    rows = rows.select("mention_id", F.map_from_entries(entries).alias("projected"), F.expr(_ANCHORS.format("array(", ")", none)).alias("anchors"))
    made = projection.with_ingredients(rows, Index(names, names, aliases, names, ingredients, names))
    return made.select(F.col("mention_id").alias("p_partkey"), "in_is_list", F.array_join(F.transform("in_list", lambda x: x["concept_id"]), "|").alias("ids"))


_FOUND = {1: "a", 2: "ab", 3: "b"}


@query(
    f"""
WITH p AS (SELECT *, CAST(substr(p_brand, 7) AS INTEGER) AS brand, CASE p_partkey % 4 {" ".join(f"WHEN {k} THEN {sql_list(v)}" for k, v in _FOUND.items())} ELSE []::VARCHAR[] END AS found FROM part),
m AS (SELECT p_partkey, brand, p_size AS s, found AS anchors, CASE WHEN p_size % 3 = 0 THEN []::DOUBLE[] ELSE [p_size * 1.0::DOUBLE, 7.0::DOUBLE] END AS scd, CASE p_size % 4 WHEN 0 THEN []::DOUBLE[] WHEN 1 THEN [p_size * 1.0::DOUBLE] ELSE [9999.0::DOUBLE] END AS own FROM p),
o AS (SELECT *, len(scd) > 0 AND len(own) > 0 AND {_sql_count('scd', 'own')} = 0 AS off FROM m),
c AS (SELECT 'c:' || p_partkey AS node, brand, p_name AS name, found, [p_size * 1.0::DOUBLE, p_size * 2.0::DOUBLE] AS mg FROM p WHERE p_type = 'SMALL'),
r AS (SELECT o.p_partkey, c.node, {_sql_count('scd', 'mg')} AS overlap, abs(o.brand - c.brand) + 1 AS depth, length(name) AS len,
  CASE WHEN len(anchors) = 0 THEN 0 WHEN list_sort(anchors) = list_sort(found) THEN 0 WHEN list_has_all(found, anchors) THEN 1 WHEN list_has_any(found, anchors) THEN 2 ELSE 3 END AS penalty
  FROM o JOIN c ON abs(o.brand - c.brand) <= 2 WHERE off),
b AS (SELECT p_partkey, arg_min(node, (-overlap, penalty, depth, len, node)) AS node FROM r WHERE overlap > 0 GROUP BY p_partkey)
SELECT o.p_partkey, CASE WHEN off THEN b.node ELSE 'first' END AS concept_id FROM o LEFT JOIN b USING (p_partkey) WHERE NOT off OR b.node IS NOT NULL
"""
)
def strength_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components whose strengths miss the drug's: the best-aligned near one; brands in a row stand for drugs."""
    part = table(spark, sf_dir, "part").withColumn("brand", F.substring("p_brand", 7, 10).cast("int"))
    strings, doubles = (F.array().cast(f"array<{x}>") for x in ("string", "double"))
    found = strings
    for k, v in _FOUND.items():
        found = F.when(F.col("p_partkey") % 4 == k, F.array(*[F.lit(x) for x in v])).otherwise(found)
    size, drug, node = F.col("p_size").cast("double"), F.concat(F.lit("d:"), _text("brand")), F.concat(F.lit("c:"), _text("p_partkey"))
    base = part.select(F.col("p_partkey").alias("mention_id"), found.alias("anchors"))
    scd = part.select(F.col("p_partkey").alias("mention_id"), F.when(F.col("p_size") % 3 == 0, doubles).otherwise(F.array(size, F.lit(7.0))).alias("scd_mg"), drug.alias("scd_id"))
    own = F.when(F.col("p_size") % 4 == 0, doubles).when(F.col("p_size") % 4 == 1, F.array(size)).otherwise(F.array(F.lit(9999.0)))
    scdc = part.select(F.col("p_partkey").alias("mention_id"), F.lit("SCDC").alias("target"), F.struct(F.lit("first").alias("concept_id"), F.lit("x").alias("name"), F.lit(1).alias("depth")).alias("hit"), own.alias("mg"))
    small = part.where("p_type = 'SMALL'")
    names = small.select(node.alias("concept_id"), F.lit("SCDC").alias("tty"), F.col("p_name").alias("name"), F.array(size, size * 2).alias("mg"))
    links = small.select(drug.alias("src"), node.alias("dst"), F.lit("consists_of").alias("rela"))
    row = part.select("brand").distinct().select(drug.alias("src"), F.concat(F.lit("d:"), (F.col("brand") + 1).cast("string")).alias("dst"), F.lit("form_of").alias("rela"))
    edges = release.both_ways(links.unionByName(row).withColumn("rel", F.lit("RO")))
    ingredients = small.where("p_partkey % 4 <> 0").select(node.alias("concept_id"), found.alias("ingredients"))
    made = projection.realigned(scdc, scd, base, Index(names, names, names, stage(edges), ingredients, names), 3)
    return made.select(F.col("mention_id").alias("p_partkey"), F.col("hit.concept_id").alias("concept_id"))


_LINK = {0: "CAST(p_partkey AS VARCHAR)", 3: "'RO'", 4: "CAST((p_partkey * 7 + 3) % 500 AS VARCHAR)", 7: "CASE WHEN p_size % 2 = 0 THEN 'has_ingredient' ELSE 'consists_of' END", 10: "CASE WHEN p_size % 13 = 0 THEN 'OTHER' ELSE 'TERMS' END", 14: "CASE WHEN p_size % 9 = 0 THEN 'Y' ELSE '' END"}
_LINK_LINE = " || '|' || ".join(_LINK.get(i, "''") for i in range(16)) + " || '|'"


def _sql_index(concepts: str, links: str) -> str:
    return f"""
WITH n AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS id, p_name || ' ' || p_size || ' mg' AS name FROM part WHERE p_size % 5 <> 0 AND p_size % 7 <> 0 AND p_size % 11 <> 0),
c AS (SELECT * FROM n {concepts}),
r AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS src, CAST((p_partkey * 7 + 3) % 500 AS VARCHAR) AS dst, CASE WHEN p_size % 2 = 0 THEN 'has_ingredient' ELSE 'consists_of' END AS rela FROM part WHERE p_size % 13 <> 0 AND p_size % 9 <> 0),
g AS (SELECT * FROM r WHERE src <> dst AND src IN (SELECT id FROM c) AND dst IN (SELECT id FROM c)),
h AS (SELECT * FROM g {links}),
e AS (SELECT src, dst, rela FROM h UNION SELECT dst, src, rela FROM h)
SELECT id AS concept_id, name AS preferred_name, 'SCD' AS tty, {sql_norm('name')} AS alias, 16 AS dims, (SELECT count(*) FROM e WHERE src = id) AS edges FROM c
"""


def _built(spark: SparkSession, sf_dir: str, *caps: int) -> DataFrame:
    """Release files written, built into an index and read back; the folder is removed once its rows are kept."""
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    part = table(spark, sf_dir, "part").orderBy("p_partkey").coalesce(1)  # a release file is one file, whose line order counts
    for name, line in (("names", _LINE), ("relations", _LINK_LINE)):
        part.select(F.expr(line.replace("VARCHAR", "STRING"))).write.text(f"{folder}/{name}")
    build_index(spark, f"{folder}/names", f"{folder}/relations", f"{folder}/index", "TERMS", 16, 8, *caps)
    made = load_index(spark, f"{folder}/index")
    edges = made.edges.groupBy(F.col("src").alias("concept_id")).agg(F.count("*").alias("edges"))
    rows = made.concepts.join(made.names.select("concept_id", "tty"), "concept_id").join(made.aliases.select("concept_id", F.col("norm_text").alias("alias")), "concept_id").join(made.vectors.select("concept_id", F.size("vec").alias("dims")), "concept_id")
    kept = stage(rows.join(edges, "concept_id", "left").select("concept_id", "preferred_name", "tty", "alias", "dims", F.coalesce("edges", F.lit(0)).alias("edges")))
    remove(spark, folder)
    return kept


@query(_sql_index("WHERE k <= coalesce((SELECT max(k) FROM (SELECT k FROM n ORDER BY k LIMIT 300) HAVING count(*) = 300), (SELECT max(k) FROM n))", "WHERE k <= coalesce((SELECT min(k) FROM g WHERE k >= 99), (SELECT max(k) FROM g))"))
def index_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of the release with both row caps."""
    return _built(spark, sf_dir, 300, 100)


@query(_sql_index("", ""))
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of the whole release."""
    return _built(spark, sf_dir)


_QUERY_NORM = sql_norm("p_name || ' ' || p_size || ' mg po daily tablet'")


@query(
    f"""
WITH n AS (SELECT p_partkey, {_QUERY_NORM} AS a, {sql_norm('p_name')} AS b FROM part), f AS (SELECT p_partkey, CASE WHEN a = b THEN [a] ELSE [a, b] END AS v FROM n),
g AS (SELECT p_partkey, list_concat(v, list_transform(v, lambda t: array_to_string(list_filter({sql_words('t')}, lambda w: NOT list_contains({sql_list(lx.CONTEXT_WORDS)}, w)), ' '))) AS v FROM f)
SELECT p_partkey, array_to_string(list_filter(v, lambda x, i: x <> '' AND list_position(v, x) = i), '|') AS variants FROM g
"""
)
def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.concat_ws(" ", "p_name", _text("p_size"), F.lit("mg po daily tablet"))
    rows = table(spark, sf_dir, "part").select("p_partkey", textnorm.normalize(whole).alias("a"), textnorm.normalize(F.col("p_name")).alias("b"))
    return rows.select("p_partkey", F.array_join(ranking.query_variants(F.col("a"), F.col("b"), F.col("b")), "|").alias("variants"))


@query(
    f"""
WITH m AS (SELECT p_partkey, p_name || CASE p_size % 3 WHEN 0 THEN ' (' || p_brand || ')' WHEN 1 THEN ' [generic] 20 mg' ELSE '' END AS t, p_size FROM part), b AS (SELECT DISTINCT {sql_norm('p_brand')} AS part FROM part),
x AS (SELECT p_partkey, {sql_norm('c')} AS part FROM (SELECT p_partkey, unnest(regexp_extract_all(t, '[\\(\\[]([^)\\]]{{2,60}})[\\)\\]]', 1)) AS c FROM m))
SELECT p_partkey, p_size % 10 = 7 OR p_partkey IN (SELECT p_partkey FROM x WHERE part IN (SELECT part FROM b)) AS brand FROM m
"""
)
def brand_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    text = F.expr("p_name || CASE p_size % 3 WHEN 0 THEN ' (' || p_brand || ')' WHEN 1 THEN ' [generic] 20 mg' ELSE '' END")
    rows = part.select(F.col("p_partkey").alias("mention_id"), text.alias("mention_text"), F.when(F.col("p_size") % 10 == 7, "SBD").otherwise("IN").alias("best_type"), F.array().cast("array<string>").alias("exact_types"))
    aliases = part.select(textnorm.normalize(F.col("p_brand")).alias("norm_text"), F.lit("BN").alias("tty")).distinct()
    empty = Index(*[aliases] * 6)
    return ranking.has_brand(rows, empty).select(F.col("mention_id").alias("p_partkey"), "brand")


@query(
    """
WITH m AS (SELECT p_partkey, p_size, CASE p_size % 3 WHEN 0 THEN 'fallback_chunk' WHEN 1 THEN 'fallback_whole_text' ELSE 'exact_alias_span' END AS method, p_size / 50.0 AS score, p_retailprice / 2000.0 AS sim FROM part)
SELECT p_partkey, method LIKE 'fallback%' AND p_size % 4 <> 0 AND score < 0.75 AND sim < 0.86 AS suppressed FROM m
"""
)
def confidence_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.expr("CASE p_size % 3 WHEN 0 THEN 'fallback_chunk' WHEN 1 THEN 'fallback_whole_text' ELSE 'exact_alias_span' END").alias("method"),
        F.array().cast("array<string>").alias("exact_ids"),
        F.array("p_name").alias("variants"),
        F.when(F.col("p_size") % 4 == 0, "IN").otherwise("SCD").alias("best_type"),
        (F.col("p_size") / 50.0).alias("best_score"),
        (F.col("p_retailprice") / 2000.0).alias("name_similarity"),
    )
    return rows.select("p_partkey", ranking.low_confidence().alias("suppressed"))


@query(
    """
SELECT p_partkey, array_to_string(list_filter([
  CASE p_size % 4 WHEN 0 THEN 'exact_alias' WHEN 1 THEN 'token_replacement' WHEN 2 THEN 'dense_line_parser' ELSE 'fallback_chunk' END,
  CASE WHEN p_size % 4 IN (1, 2) THEN 'exact_alias' END, 'embeddings', 'exact_alias_boost',
  CASE WHEN p_size % 5 = 0 THEN 'no_strength_in_exact_override' END, CASE WHEN p_size % 7 = 0 THEN 'no_strength_in_alias_override' END,
  CASE WHEN p_size % 6 = 0 THEN 'ingredient_projection_suppressed' END, CASE WHEN p_size % 6 = 0 THEN 'low_confidence_embedding_match' END], lambda x: x IS NOT NULL), '|') AS detected_by FROM part
"""
)
def detection_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = F.array(*[F.lit(x) for x in ("exact_alias_span", "token_replacement_alias", "dense_line_scan", "fallback_chunk")])
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.get(methods, size % 4).alias("method"), F.array("p_name").alias("exact_ids"), F.array("p_name").alias("variants"), (size % 5 == 0).alias("exact_override"), (size % 7 == 0).alias("alias_override"), (size % 6 == 0).alias("suppressed"))
    return rows.select("p_partkey", F.array_join(signals(), "|").alias("detected_by"))


@query(
    """
WITH m AS (SELECT p_brand AS doc_id, p_partkey AS no, lower(p_name) AS t, p_type AS scd, p_size % 4 AS depth, p_name AS sbd FROM part)
SELECT doc_id, min(no) AS mention_no, t AS mention_text, scd, CAST(count(*) AS INTEGER) AS merged, arg_min(no, (depth, no)) AS sbd FROM m GROUP BY doc_id, t, scd
"""
)
def display_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    concept = lambda i, d: F.struct(i.alias("concept_id"), F.lit("x").alias("name"), d.cast("int").alias("depth"))
    none = F.lit(None).cast(projection.CONCEPT)
    types = [(concept(F.col("p_type"), F.lit(0)) if t == "SCD" else concept(_text("p_partkey"), F.col("p_size") % 4) if t == "SBD" else none).alias(t) for t in lx.TARGET_TYPES if t != "IN"]
    result = F.struct(*types, F.array().cast(f"array<{projection.CONCEPT}>").alias("IN"), F.lit(False).alias("in_is_list"))
    mention = F.struct(F.col("p_name").alias("mention_text"), F.lower("p_name").alias("normalized_text"), result.alias("type_results"))
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("mention_no"), mention.alias("mention"))
    made = display.deduplicated(rows)
    return made.select("doc_id", "mention_no", F.lower("mention.mention_text").alias("mention_text"), F.col("mention.type_results.SCD.concept_id").alias("scd"), "merged", F.col("mention.type_results.SBD.concept_id").cast("long").alias("sbd"))


_XML = """'<med><name value="' || p_name || '"/><when value="2020-01-0' || (p_size % 9 + 1) || '"/><state value=''active''/><id value="12"/><dose value="' || p_type || '"/></med>'"""


@query(
    f"""
WITH v AS (SELECT p_partkey, list_filter(regexp_extract_all({_XML}, 'value="(.*?)"', 1), lambda x: regexp_matches(x, '[A-Za-z]')) AS vs FROM part)
SELECT p_partkey, CASE WHEN length(vs[2]) > length(vs[1]) THEN vs[2] ELSE vs[1] END AS shown FROM v
"""
)
def xml_value_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.arrow_udf(StringType())
    def shown(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else mentions.display_text(t) for t in texts.to_pylist()], pa.string())

    return table(spark, sf_dir, "part").select("p_partkey", shown(F.expr(_XML.replace("''active''", "\\'active\\'"))).alias("shown"))


# --- whole plans -----------------------------------------------------------------------------------------------------------
def part_index(spark: SparkSession, sf_dir: str) -> Index:
    names, relations = part_terms(spark, sf_dir)
    index = make_index(stage(names), stage(relations))
    return Index(**{t: stage(getattr(index, t)) for t in ("concepts", "names", "aliases", "edges", "ingredients", "vectors")}, dims=index.dims)


def part_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One note for each part: an order line, a denial, or a record."""
    text = """CASE p_size % 4 WHEN 0 THEN 'Patient denies ' || p_name || '.' WHEN 1 THEN 'Start ' || p_name || ' ' || p_size || ' mg ' || p_type || ' PO BID\\nreview later'
      WHEN 2 THEN 'MED|' || p_name || '|' || p_size || ' mg|PO|daily|active' ELSE p_name || ' (' || p_brand || ') daily; rest' END"""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(text).alias("text"))


@query()
def detect_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, _ = part_terms(spark, sf_dir)
    aliases = make_index(stage(names), spark.createDataFrame([], "src string, dst string, rel string, rela string")).aliases
    return mentions.detect_mentions(part_notes(spark, sf_dir), aliases).select("doc_id", "mention_no", "text", "norm_text", "start", "end", "method", "lookup_source")


@query()
def annotate_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate(part_notes(spark, sf_dir), part_index(spark, sf_dir))
