"""Queries of the driver contract that hold single rules of detection, projection and results against DuckDB SQL.

Notes and terminologies are made from ``part``, so that each rule decides some rows one way and some the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medspan.functions import lexicon as lx
from medspan.functions import textnorm
from medspan.operators import display, mentions, projection, ranking
from medspan.plans.annotate import Options, assembled, with_context
from medspan.plans.queries import query, sql_list, sql_norm, table
from medspan.session import stage
from medspan.sources.index import Index, alias_table, make_index, with_name_features
from medspan.sources.results import result_json


def _rotated(values, by: str) -> str:
    """SQL (both dialects) for one of ``values`` by a whole number."""
    return f"CASE {by} % {len(values)} {' '.join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))} END"


def _notes(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(text).alias("text"))


def _known(part: DataFrame, *words: str) -> DataFrame:
    """Aliases: the names and types of all parts, and further words, each as an ingredient."""
    own = part.select(F.explode(F.array("p_name", "p_type")).alias("raw_name"), F.col("p_partkey").alias("line_no"))
    if words:
        own = own.unionByName(part.sparkSession.createDataFrame([(w, -1 - i) for i, w in enumerate(words)], "raw_name string, line_no bigint"))
    own = own.select("raw_name", "line_no", textnorm.normalize(F.col("raw_name")).alias("norm_text"))
    return alias_table(own.withColumns({"concept_id": F.concat(F.lit("i:"), "norm_text"), "tty": F.lit("IN")}))


# --- detection ---------------------------------------------------------------------------------------------------------
_LF = "chr(10)"
_BRACKETED = f"CASE p_size % 4 WHEN 0 THEN p_name || ' [' || p_type || ']; rest' WHEN 1 THEN p_name || {_LF} || '(' || p_type || ')' WHEN 2 THEN '(' || p_type || ') ' || p_name ELSE p_name || ' (see ' || p_type || ')' END"


@query(
    f"""
WITH m AS (
  SELECT p_partkey AS doc_id, p_name AS text, CASE WHEN p_size % 4 = 2 THEN length(p_type) + 3 ELSE 0 END AS s FROM part
  UNION ALL SELECT p_partkey, p_type, length(p_name) + CASE WHEN p_size % 4 = 1 THEN 2 ELSE 6 END FROM part WHERE p_size % 4 IN (1, 3))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS mention_no, text, CAST(s AS INTEGER) AS "start", CAST(s + length(text) AS INTEGER) AS "end" FROM m
"""
)
def bracket_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mention exactly in brackets goes where its line has another one, and stays alone on its line."""
    found = mentions.detect_mentions(_notes(spark, sf_dir, _BRACKETED), _known(table(spark, sf_dir, "part")))
    return found.select("doc_id", "mention_no", "text", "start", "end")


_DRUGS = "CASE WHEN p_size % 3 = 0 THEN 'SCD' WHEN p_size % 3 = 1 THEN 'DF' ELSE 'SCDF' END"
_SHARED = "CASE WHEN p_partkey % 20 = 0 THEN 'lactate' WHEN p_partkey % 20 = 1 THEN 'sugar pill' ELSE p_name || ' ' || p_partkey % 97 END"


@query(
    f"""
WITH n AS (SELECT p_partkey AS k, {_SHARED} AS text, CAST(p_size AS VARCHAR) AS id, {_DRUGS} AS tty FROM part),
d AS (SELECT text, id, tty, min(k) AS k FROM n GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY k) AS nth FROM d),
u AS (SELECT text, string_agg(id, '|' ORDER BY nth) AS ids, string_agg(DISTINCT tty, '|' ORDER BY tty) AS types, bool_or(tty = 'SCD') AS usable FROM r WHERE nth <= 3 GROUP BY text)
SELECT k AS doc_id, n.text, CASE WHEN ok THEN 'exact_alias_span' ELSE 'fallback_whole_text' END AS method, CASE WHEN ok THEN ids ELSE '' END AS ids, CASE WHEN ok THEN types ELSE '' END AS types
FROM (SELECT n.*, ids, types, usable AND n.text NOT IN {tuple(lx.NON_DRUG_TERMS)} AS ok FROM n JOIN u ON u.text = n.text) n
"""
)
def non_drug_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that are no drug, and names whose first rows (here 3 at most) all have types that are no drug's, are not found."""
    part = table(spark, sf_dir, "part")
    names = part.select(F.col("p_partkey").alias("line_no"), F.expr(_SHARED).alias("raw_name"), F.col("p_size").cast("string").alias("concept_id"), F.expr(_DRUGS).alias("tty"))
    found = mentions.detect_mentions(_notes(spark, sf_dir, _SHARED), alias_table(names.withColumn("norm_text", textnorm.normalize(F.col("raw_name")))), max_exact=3)
    return found.select("doc_id", "text", "method", F.array_join("exact_ids", "|").alias("ids"), F.array_join("exact_types", "|").alias("types"))


_TERMS = sorted(lx.DENSE_LINE_TERMS)
_FIRST, _SECOND = _rotated(_TERMS, "p_partkey"), _rotated(_TERMS, "(p_partkey * 7 + 5)")
_PLAIN = ["glyburide", "metformin", "propofol", "prednisone", "heparin"]
_RUN = "upper({0}) || 'sulphateqz' || p_size || 'xquantities'"
_BEFORE, _AFTER = "CASE WHEN p_size % 3 = 0 THEN 'aa bb cc ' ELSE '' END", "CASE WHEN p_size % 2 = 0 THEN ' ' || repeat('w', 30) ELSE '' END"
_DENSE = f"CASE WHEN p_size % 5 = 0 THEN 'was told about ' || {_rotated(_PLAIN, 'p_partkey')} || ' then ' || {_rotated(_PLAIN, '(p_partkey + 1)')} || ' again by some of those near here' ELSE {_BEFORE} || {_RUN.format(_FIRST)} || ' ' || {_RUN.format(_SECOND)} || {_AFTER} END"
_CORES = ["metoprolol", "vancomycin", "norepinephrine", "dexmedetomidine"]


@query(
    f"""
WITH m AS (SELECT p_partkey AS doc_id, p_size AS s, {_FIRST} AS a, {_SECOND} AS b, {_BEFORE} AS pre, {_AFTER} AS post, {_RUN.format(_FIRST)} AS one, {_RUN.format(_SECOND)} AS two FROM part WHERE p_size % 5 <> 0),
t AS (SELECT doc_id, 1 AS no, a AS term, one AS text, length(pre) AS "start", one AS alone, pre || one || ' ' || two || post AS line, (a = 'lisinopril')::INT + (b = 'lisinopril')::INT AS held, s FROM m
  UNION ALL SELECT doc_id, 2, b, two || post, length(pre) + length(one) + 1, two, pre || one || ' ' || two || post, (a = 'lisinopril')::INT + (b = 'lisinopril')::INT, s FROM m),
g AS (SELECT *, regexp_replace(regexp_replace(lower(text), '([a-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([a-z])', '\\1 \\2', 'g') AS repaired,
  regexp_replace(regexp_replace(lower(line), '([a-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([a-z])', '\\1 \\2', 'g') AS repaired_line,
  CASE term WHEN 'vanc' THEN 'vancomycin' WHEN 'dex' THEN 'dexmedetomidine' WHEN 'norepi' THEN 'norepinephrine' ELSE term END AS core FROM t)
SELECT doc_id, text, CAST("start" AS INTEGER) AS "start", repaired AS norm_text, 'dense_line_scan' AS method, CASE WHEN core IN {tuple(_CORES)} THEN 'dense_core_norm' ELSE 'dense_segment_norm' END AS lookup_source,
  CASE WHEN core IN {tuple(_CORES)} THEN core ELSE repaired END AS lookup_norm, CASE WHEN core IN {tuple(_CORES)} THEN 'd:' || core ELSE '' END AS ids
FROM g WHERE length(line) >= 70 AND length(repaired_line) >= 50 AND held < 2 AND NOT (term = 'lisinopril' AND text = alone)
UNION ALL
SELECT doc_id, alone, "start", 'lisinoprilsulphateqz ' || s || ' xquantities', 'exact_alias_span', 'noisy_norm', 'lisinoprilsulphateqz ' || s || ' xquantities', 'd:' || s FROM g WHERE term = 'lisinopril'
"""
)
def dense_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense lines and lines that just are none: segments from one known name to the next, unless two mentions were found or a span is taken."""
    size = table(spark, sf_dir, "part").select("p_size").distinct()
    whole = size.select(F.expr("'lisinoprilsulphateqz ' || p_size || ' xquantities'").alias("norm_text"), F.expr("'d:' || p_size").alias("concept_id"), F.col("p_size").cast("bigint").alias("line_no"))
    cores = spark.createDataFrame([(c, f"d:{c}", 1000 + i) for i, c in enumerate(_CORES)], "norm_text string, concept_id string, line_no bigint")
    names = whole.unionByName(cores).withColumns({"raw_name": F.col("norm_text"), "tty": F.lit("IN")})
    found = mentions.detect_mentions(_notes(spark, sf_dir, _DENSE), alias_table(names)).where("not startswith(method, 'fallback')")
    return found.select("doc_id", "text", "start", "norm_text", "method", "lookup_source", "lookup_norm", F.array_join("exact_ids", "|").alias("ids"))


_SHOWN = f"CASE p_size % 5 WHEN 0 THEN 'Consultation; afterwards ' || p_name || ' continuously: observation' WHEN 1 THEN p_name || '; ' || p_name WHEN 2 THEN 'Documented yesterday.' || {_LF} || 'zo' || {_LF} || 'Documented afterwards, everything considered' WHEN 3 THEN 'observation' || {_LF} || '  zo. observation ' ELSE 'observation!' || {_LF} || {_LF} || ' ' || p_name || ' ' END"
_JOINED = "CASE WHEN length(split_part(p_name, ' ', 1)) < 7 AND length(split_part(p_name, ' ', 2)) < 9 AND length(p_name) > 7 THEN replace(p_name, ' ', '') ELSE p_name END"


@query(
    f"""
WITH p AS (SELECT p_partkey AS doc_id, p_size % 5 AS c, p_name AS n, length(p_name) AS l, {_JOINED} AS j FROM part)
SELECT doc_id, 0 AS mention_no, CASE c WHEN 0 THEN 'afterwards ' || n || ' continuously' WHEN 2 THEN 'zo' WHEN 3 THEN 'zo' ELSE n END AS mention_text,
  CAST(CASE c WHEN 0 THEN 14 WHEN 1 THEN 0 WHEN 2 THEN 22 WHEN 3 THEN 14 ELSE 15 END AS INTEGER) AS mention_start,
  CASE c WHEN 0 THEN 'afterwards ' || j || ' continuously' WHEN 1 THEN j WHEN 2 THEN 'documented yesterday zo documented afterwards everything consi' WHEN 3 THEN 'zo observation' ELSE j END AS context FROM p
UNION ALL SELECT doc_id, 1, n, 0, j FROM p WHERE c = 1
"""
)
def shown_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mention shows (its clause, placed where the line first has it) and its context: segment, else line, else a window of the note."""
    found = with_context(mentions.detect_mentions(_notes(spark, sf_dir, _SHOWN), _known(table(spark, sf_dir, "part"), "zo")))
    return found.select("doc_id", "mention_no", "mention_text", "mention_start", "context")


# --- ranking and projection ----------------------------------------------------------------------------------------------
@query(
    f"""
WITH v AS (SELECT p_partkey, {sql_norm('p_name')} AS norm, p_partkey % 3 = 0 AS own, p_retailprice / 2000.0 AS score FROM part)
SELECT norm AS mention_id, CAST(p_partkey AS VARCHAR) AS concept_id, round(score - CASE WHEN own THEN 0 ELSE 0.03 END, 6) AS score FROM v
"""
)
def variant_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of query variants other than the mention's own norm cost a little."""
    part = table(spark, sf_dir, "part").withColumn("norm_text", textnorm.normalize(F.col("p_name")))
    found = part.select(F.col("norm_text").alias("mention_id"), "norm_text", F.when(F.col("p_partkey") % 3 == 0, F.col("norm_text")).otherwise(F.concat("norm_text", F.lit(" daily"))).alias("query"), F.lit(0).alias("variant"), F.lit(1).alias("rank"), F.col("p_partkey").cast("string").alias("concept_id"), (F.col("p_retailprice") / 2000.0).alias("score"))
    return ranking.penalised(found).select("mention_id", "concept_id", F.round("score", 6).alias("score"))


@query(
    """
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'alias ' || p_size WHEN p_size % 4 = 1 THEN 'alias ' || p_partkey ELSE p_name END AS preferred_name FROM part
"""
)
def preferred_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A concept without a preferred name takes its first alias in file order."""
    part = table(spark, sf_dir, "part")
    name = F.when(F.col("p_size") % 4 < 2, "").otherwise(F.col("p_name"))
    first = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("alias "), "p_size")).otherwise(F.concat(F.lit("alias "), "p_partkey"))
    rows = part.select("p_partkey", name.alias("raw_name"), F.posexplode(F.array(first, F.lit("another alias"))).alias("n", "norm_text"))
    names = rows.select(F.col("p_partkey").cast("string").alias("concept_id"), "raw_name", "norm_text", F.lit("SCD").alias("tty"), F.lit("N").alias("ispref"), (F.col("p_partkey") * 2 + F.col("n")).alias("line_no"))
    made = make_index(names, spark.createDataFrame([], "src string, dst string, rel string, rela string"), dims=16)
    return made.concepts.select(F.col("concept_id").cast("bigint").alias("p_partkey"), "preferred_name")


@query(
    """
WITH p AS (SELECT p_partkey, p_size AS s, p_size % 3 <> 0 AS branded, p_size % 5 <> 0 AS drug, p_size % 4 = 1 AS unlike, p_size % 7 = 0 AS bare FROM part),
c AS (SELECT *, CASE WHEN branded THEN s END AS sbd, CASE WHEN NOT drug THEN NULL WHEN branded AND NOT unlike THEN s ELSE s + 1000 END AS scd FROM p),
w AS (SELECT *, coalesce(scd, sbd) AS wanted, CASE WHEN s % 2 = 0 THEN s ELSE s + 1000 END AS first FROM c)
SELECT p_partkey, CASE WHEN bare OR NOT branded THEN '' ELSE 'b:' || p_partkey END AS sbd, CASE WHEN bare OR NOT drug THEN '' WHEN scd = s THEN 'c2:' || p_partkey ELSE 'c1:' || p_partkey END AS scd,
  CASE WHEN bare THEN '' WHEN wanted IS NULL OR wanted = first THEN 'd1:' || p_partkey ELSE 'd2:' || p_partkey END AS scdc, 'n:' || p_partkey AS bn FROM w
"""
)
def projection_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products follow the strength of the branded one, components that of the product, else of the branded one; ingredients without a dose
    are not projected to any of the three."""
    part = table(spark, sf_dir, "part")
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    far = size + 1000

    def one(kind: str, tty: str, mg: Column, when: Column) -> Column:
        name = F.concat_ws(" ", "p_name", mg.cast("string"), F.lit("mg")) if tty != "BN" else F.col("p_name")
        return F.when(when, F.struct(F.concat(F.lit(f"{kind}:"), key).alias("concept_id"), F.lit(tty).alias("tty"), name.alias("name")))

    always = F.lit(True)
    drug = size % 5 != 0
    made = F.array(
        one("b", "SBD", size, size % 3 != 0), one("c1", "SCD", far, drug), one("c2", "SCD", size, drug & (size % 4 != 1)),
        one("d1", "SCDC", F.when(size % 2 == 0, size).otherwise(far), always), one("d2", "SCDC", F.when(size % 2 == 0, far).otherwise(size), always), one("n", "BN", size, always),
    )
    rows = part.select(F.concat(F.lit("s:"), key).alias("seed"), F.explode(F.array_compact(made)).alias("c")).select("seed", "c.*")
    names = stage(with_name_features(rows.drop("seed")))
    relation = F.expr("CASE tty " + " ".join(f"WHEN '{t}' THEN '{lx.TARGET_RELATIONS[t][0]}'" for t in ("SBD", "SCD", "SCDC", "BN")) + " END")
    edges = rows.select(F.col("seed").alias("src"), F.col("concept_id").alias("dst"), F.lit("RO").alias("rel"), relation.alias("rela"))
    ingredients = names.select("concept_id", F.array().cast("array<string>").alias("ingredients"))
    index = Index(names, names, names, stage(edges), ingredients, names)
    strings, doubles, no = F.array().cast("array<string>"), F.array().cast("array<double>"), F.lit(False)
    bare = size % 7 == 0
    base = part.select(
        F.col("p_partkey").alias("mention_id"), F.concat(F.lit("s:"), key).alias("best_id"), F.array_distinct(textnorm.words(textnorm.normalize(F.col("p_name")))).alias("projection_words"),
        strings.alias("anchors"), strings.alias("strength_tokens"), strings.alias("strength_sigs"), F.array().cast("array<struct<a:double,b:double>>").alias("ratios"), doubles.alias("numbers"), F.lit(0).alias("form_bits"),
        *[no.alias(c) for c in ("combo", "structured", "iv", "oral", "continuous", "schedule")], (~bare).alias("dose_signal"), bare.alias("seed_is_ingredient"),
    )
    best = projection.best_of_types(base, index, Options().max_graph_depth)
    hit = lambda t: F.coalesce(F.try_element_at("projected", F.lit(t))["concept_id"], F.lit("")).alias(t.lower())
    return best.select(F.col("mention_id").alias("p_partkey"), hit("SBD"), hit("SCD"), hit("SCDC"), hit("BN"))


# --- results ----------------------------------------------------------------------------------------------------------------


def _result_rows(part: DataFrame) -> DataFrame:
    """Mentions with all that ``assembled`` reads, their fields from the part's columns."""
    key = F.col("p_partkey").cast("string")
    concept = lambda kind, d: F.struct(F.concat(F.lit(kind), key).alias("concept_id"), F.concat(F.lit(f"{kind} & "), "p_name").alias("name"), F.lit(d).alias("depth"))
    size = F.col("p_size")
    items = F.slice(F.array(concept("i", 0), concept("j", 1)), F.lit(1), size % 3)
    projected = F.map_from_entries(F.array_compact(F.array(F.when(size % 2 == 0, F.struct(F.lit("SCD"), concept("c", 1))), F.struct(F.lit("SBD"), concept("b", 2)))))
    replaced = size % 4 == 0
    return part.select(
        F.col("p_partkey").alias("doc_id"), F.lit(0).alias("mention_no"), F.concat(F.lit('"'), "p_name", F.lit("\" <b> 'x'")).alias("mention_text"), F.col("p_name").alias("text"), F.lit(0).alias("mention_start"), (F.length("p_name") + 10).alias("mention_end"),
        F.lit(1).alias("start"), (F.length("p_name") + 1).alias("end"), F.lower("p_name").alias("norm_text"), key.alias("best_id"), F.col("p_name").alias("best_name"), F.lit("SCD").alias("best_type"), (size / 64.0).alias("best_score"), (size % 2 == 0).alias("exact_match"),
        projected.alias("projected"), (size % 5 != 0).alias("brand"), (size % 7 == 0).alias("suppressed"), items.alias("in_list"), (size % 3 == 2).alias("in_is_list"),
        F.when(replaced, "token_replacement_alias").otherwise("exact_alias_span").alias("method"), F.lit("surface_norm").alias("lookup_source"), F.lower("p_name").alias("lookup_norm"), F.when(replaced, "asa").alias("replaced_from"), F.when(replaced, "aspirin").alias("replaced_to"),
        F.array(F.lower("p_name")).alias("variants"), F.array(key).alias("exact_ids"), F.array(F.lit("IN"), F.lit("SCD")).alias("exact_types"), F.lit(False).alias("exact_override"), F.lit(False).alias("alias_override"), F.lit("embedding_plus_exact").alias("selection_reason"), (size / 128.0).alias("name_similarity"),
    )


def _sql_concept(kind: str, depth: int) -> str:
    """A concept as JSON text."""
    return f"""'{{"rxcui":"{kind}' || p_partkey || '","name":"{kind} & ' || p_name || '","depth":{depth}}}'"""


_SQL_IN = f"""CASE WHEN p_size % 7 = 0 THEN '"IN":null' WHEN p_size % 3 = 0 THEN '"IN":null' WHEN p_size % 3 = 1 THEN '"IN":' || {_sql_concept('i', 0)} ELSE '"IN":[' || {_sql_concept('i', 0)} || ',' || {_sql_concept('j', 1)} || '],"IN_ALL":[' || {_sql_concept('i', 0)} || ',' || {_sql_concept('j', 1)} || ']' END"""
_SQL_TYPES = " || ',' || ".join(
    {
        "SCD": f"""'"SCD":' || CASE WHEN p_size % 7 = 0 OR p_size % 2 = 1 THEN 'null' ELSE {_sql_concept('c', 1)} END""",
        "SBD": f"""'"SBD":' || CASE WHEN p_size % 7 = 0 OR p_size % 5 = 0 THEN 'null' ELSE {_sql_concept('b', 2)} END""",
    }.get(t, f"""'"{t}":null'""")
    for t in lx.TARGET_TYPES
    if t != "IN"
)


def _sql_bool(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 'true' ELSE 'false' END"


@query(
    f"""
SELECT p_partkey AS doc_id, '{{"input_text":"' || p_name || '","target_ttys":[{",".join(f'"{t}"' for t in lx.TARGET_TYPES)}],"mention_count":1,"mentions":[{{"mention_text":"\\"' || p_name || '\\" <b> ''x''","matched_text":"' || p_name
  || '","span":{{"start":0,"end":' || (length(p_name) + 10) || '}},"matched_span":{{"start":1,"end":' || (length(p_name) + 1) || '}},"normalized_text":"' || lower(p_name) || '","best_match":{{"rxcui":"' || p_partkey || '","name":"' || p_name
  || '","tty":"SCD","score":' || round(p_size / 64.0, 6) || ',"exact_match":' || {_sql_bool('p_size % 2 = 0')} || '}},"detected_by":[' || CASE WHEN p_size % 4 = 0 THEN '"token_replacement",' ELSE '' END || '"exact_alias","embeddings","exact_alias_boost"'
  || CASE WHEN p_size % 7 = 0 THEN ',"ingredient_projection_suppressed","low_confidence_embedding_match"' ELSE '' END || '],"detection_trace":{{"mention_detection_method":"' || CASE WHEN p_size % 4 = 0 THEN 'token_replacement_alias' ELSE 'exact_alias_span' END
  || '","lookup_source":"surface_norm","lookup_norm":"' || lower(p_name) || '","token_replacement":' || CASE WHEN p_size % 4 = 0 THEN '{{"from":"asa","to":"aspirin"}}' ELSE 'null' END
  || ',"ranking":{{"used_embeddings":true,"embedding_query_variants":["' || lower(p_name) || '"],"exact_alias_candidate_count":1,"exact_alias_candidates":["' || p_partkey || '"],"exact_alias_ttys":["IN","SCD"],"selection_reason":"'
  || CASE WHEN p_size % 7 = 0 THEN 'low_confidence_embedding_suppressed' ELSE 'embedding_plus_exact' END || '","best_name_similarity":' || round(p_size / 128.0, 6) || ',"ingredient_projection_suppressed":' || {_sql_bool('p_size % 7 = 0')}
  || '}}}},"tty_results":{{' || {_SQL_TYPES} || ',' || {_SQL_IN} || '}}}}]}}' AS value FROM part
"""
)
def result_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON results: published names, nulls kept, and the three forms of the ingredient projection."""
    part = table(spark, sf_dir, "part")
    rows = assembled(_result_rows(part)).join(part.select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("input_text")), "doc_id")
    types = F.array(*[F.lit(t) for t in lx.TARGET_TYPES])
    return result_json(rows.select("doc_id", "input_text", types.alias("target_types"), F.lit(1).alias("mention_count"), F.array("mention").alias("mentions")))


def _sql_cell(kind: str) -> str:
    return f"'{kind} &amp; ' || p_name || ' ({kind}' || p_partkey || ')'"


@query(
    f"""
SELECT p_partkey AS doc_id, '&quot;' || p_name || '&quot; &lt;b&gt; &#39;x&#39;' AS mention_text, lower(p_name) AS normalized_text, CASE WHEN p_size % 7 = 0 OR p_size % 2 = 1 THEN '-' ELSE {_sql_cell('c')} END AS "SCD",
  CASE WHEN p_size % 7 = 0 OR p_size % 5 = 0 THEN '-' ELSE {_sql_cell('b')} END AS "SBD", CASE WHEN p_size % 7 = 0 OR p_size % 3 = 0 THEN '-' WHEN p_size % 3 = 1 THEN {_sql_cell('i')} ELSE {_sql_cell('i')} || ' | ' || {_sql_cell('j')} END AS "IN", '-' AS "MIN" FROM part
"""
)
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the result table: names with ids, lists, dashes, and marks of mark-up replaced."""
    shown = display.table_rows(assembled(_result_rows(table(spark, sf_dir, "part"))))
    return shown.select("doc_id", "mention_text", "normalized_text", "SCD", "SBD", "IN", "MIN")
