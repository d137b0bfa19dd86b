"""Document fingerprints: a Merkle tree over sections, paragraphs and phrases.

A text is cut into sections at empty lines (``\\n\\n``), sections into paragraphs at ``\\n``, paragraphs into phrases
that end at punctuation before white space, or after ``PHRASE`` code points.  Cuts are lossless, so the root hash
tests equality of texts.  Nodes are SHA-256 over their children's digests, with a letter for the level.  The
fingerprint is ``root:tree``, where the tree keeps the first ``TAG`` hex digits of every node: a section is its digest and its paragraphs
(``section=paragraph|paragraph``), a paragraph its digest and its phrases (``paragraph phrase phrase``), sections are joined by ``/``.

``locate_edits`` descends only into branches that differ: equal roots end it, sections of one are matched to equal ones of the other wherever they
stand, then paragraphs of what is left, so an inserted paragraph is one edit.  ``likeness`` is 1 for equal roots, else the
share of common phrases.

All of it is DataFrame expressions.  Neighbours by ascending id are found with one shuffle of the texts by range of (id, text hash):
range limits come from a bounded sample, and the first row of each range is also sent to the range before it.

Defined results: a null text counts as empty.  The order is id (nulls first), then text hash, so repeated ids have a
defined next row and one id may fill several ranges; rows equal in both are interchangeable.  With one row, that row is its own next.
A phrase is bounded, so texts of any length are cut in one pass.  Empty tables give empty results.  Other columns are not carried,
so none can clash.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medspan.llm.common import unused

PHRASE = 192
TAG = 8
#: Where a phrase may end within a paragraph, and pieces of at most ``PHRASE`` code points.
BREAK, PIECE = r"(?<=[.!?,;:|])(?=[\x20\x09-\x0D])", rf"(?s).{{1,{PHRASE}}}"
ROWS_PER_RANGE = 1024
MAX_RANGES = 1 << 14
#: Sampled rows for each range limit.
SAMPLED = 16
GROUP = 128
MAX_PHRASES = 1 << 30


def tree_of(text: Column) -> Column:
    """Array of sections (``d`` digest, ``p`` paragraphs (``d`` digest, ``l`` phrase digests))."""

    def paragraph(p: Column) -> Column:
        pieces = F.flatten(F.transform(F.split(p, BREAK, -1), lambda x: F.regexp_extract_all(x, F.lit(PIECE), F.lit(0))))
        return F.transform(pieces, lambda x: F.sha2(x, 256))

    def digested(level: str, digests: Column) -> Column:
        return F.sha2(F.concat(F.lit(level), F.array_join(digests, "")), 256)

    lines = F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), paragraph))
    paragraphs = F.transform(lines, lambda s: F.transform(s, lambda l: F.struct(digested("P", l).alias("d"), l.alias("l"))))
    return F.transform(paragraphs, lambda s: F.struct(digested("S", F.transform(s, lambda p: p["d"])).alias("d"), s.alias("p")))


def fingerprint_of(tree: Column) -> Column:
    """``root:tree`` of a tree of digests."""
    tag = lambda d: F.substring(d, 1, TAG)
    root = F.sha2(F.concat(F.lit("R"), F.array_join(F.transform(tree, lambda s: s["d"]), "")), 256)
    paragraph = lambda p: F.array_join(F.concat(F.array(tag(p["d"])), F.transform(p["l"], tag)), " ")
    section = lambda s: F.concat(tag(s["d"]), F.lit("="), F.array_join(F.transform(s["p"], paragraph), "|"))
    return F.concat(root, F.lit(":"), F.array_join(F.transform(tree, section), "/"))


def with_fingerprint(rows: DataFrame, text: str, out: str) -> DataFrame:
    tree = unused(rows, "tree")
    return rows.withColumn(tree, tree_of(F.col(text))).withColumn(out, fingerprint_of(F.col(tree))).drop(tree)


def leaves(fingerprint: Column) -> Column:
    """The distinct phrase tags of a fingerprint."""
    paragraphs = F.split(F.substring_index(fingerprint, ":", -1), "[|/]", -1)
    phrases = F.flatten(F.transform(paragraphs, lambda p: F.slice(F.split(F.substring_index(p, "=", -1), " ", -1), 2, MAX_PHRASES)))
    return F.array_distinct(phrases)


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots, else twice the common leaves over the sum of both."""
    x, y = leaves(a), leaves(b)
    share = 2.0 * F.size(F.array_intersect(x, y)) / F.greatest(F.size(x) + F.size(y), F.lit(1))
    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), 1.0).otherwise(share)


def locate_edits(a: Column, b: Column) -> Column:
    """Array of (section, paragraph) of ``a`` that ``b`` does not hold; positions count from 0.

    Sections that ``b`` holds as a whole are passed over by their digests; of the others, so are paragraphs that a differing section of ``b`` holds.
    """

    def sections(f: Column) -> Column:
        return F.split(F.substring_index(f, ":", -1), "/", -1)

    def digest(section: Column) -> Column:
        return F.substring_index(section, "=", 1)

    def paragraphs(section: Column) -> Column:
        return F.transform(F.split(F.substring_index(section, "=", -1), r"\|", -1), lambda p: F.substring_index(p, " ", 1))

    own, theirs = sections(a), sections(b)
    known = F.transform(theirs, digest)
    mine = F.transform(own, digest)
    rest = F.flatten(F.transform(F.filter(theirs, lambda s: ~F.array_contains(mine, digest(s))), paragraphs))
    kind = "array<struct<section:int,paragraph:int>>"

    def differing(section: Column, at: Column) -> Column:
        marked = F.transform(paragraphs(section), lambda p, i: F.when(~F.array_contains(rest, p), F.struct(at.cast("int").alias("section"), i.cast("int").alias("paragraph"))))
        return F.when(F.array_contains(known, digest(section)), F.array().cast(kind)).otherwise(F.array_compact(marked))

    same = F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1)
    return F.when(same, F.array().cast(kind)).otherwise(F.flatten(F.transform(own, differing)))


def _range_of(key: Column, tie: Column, bounds: list[tuple[int, int]]) -> Column:
    """Number of bounds not above (key, tie): two steps over literal arrays, so at most about 2 * GROUP comparisons."""
    if not bounds:
        return F.lit(0)
    pairs = [{"k": k, "t": t} for k, t in bounds]
    groups = [pairs[i : i + GROUP] for i in range(0, len(pairs), GROUP)]
    below = lambda table: F.coalesce(F.size(F.filter(table, lambda x: (x["k"] < key) | ((x["k"] == key) & (x["t"] <= tie)))), F.lit(0))
    literal = lambda xs, kind: F.from_json(F.lit(json.dumps(xs)), kind)
    pair = "struct<k:bigint,t:bigint>"
    if len(groups) == 1:
        return below(literal(groups[0], f"array<{pair}>"))
    group = F.greatest(below(literal([g[0] for g in groups], f"array<{pair}>")), F.lit(1))
    return (group - 1) * GROUP + below(F.element_at(literal(groups, f"array<array<{pair}>>"), group))


def with_next(docs: DataFrame, key: str, columns: list[str], tie: str, prepare=lambda rows: rows) -> DataFrame:
    """``docs`` with ``next``, a struct of ``columns`` of the row after it by ascending integer ``key`` and ``tie`` (after the last: the first).

    ``prepare`` adds columns after the rows are dealt, so they are not shuffled.
    """
    first_key = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))  # nulls first
    ids = docs.select(first_key.alias("key"), F.col(tie).alias("tie"))
    n = ids.count()
    ranges = max(1, min(MAX_RANGES, -(-n // ROWS_PER_RANGE)))
    bounds: list[tuple[int, int]] = []
    if ranges > 1:  # about SAMPLED rows a range, whatever the table
        share = int(min(1.0, SAMPLED * ranges / n) * (1 << 30))
        sample = ids.where(F.pmod(F.xxhash64("key", "tie"), F.lit(1 << 30)) < share).distinct()
        rows = sorted((r["key"], r["tie"]) for r in sample.collect())
        bounds = sorted({rows[len(rows) * i // ranges] for i in range(1, ranges)}) if rows else []
    part = _range_of(F.col("key"), F.col("tie"), bounds).cast("int")
    heads = {r["part"]: r["first"] for r in ids.groupBy(part.alias("part")).agg(F.min(F.struct("key", "tie")).alias("first")).collect()}
    present = sorted(heads)
    before = {p: present[i - 1] for i, p in enumerate(present)}
    every = range(len(bounds) + 1)
    heads_of = F.from_json(F.lit(json.dumps([{"k": heads[p]["key"], "t": heads[p]["tie"]} if p in heads else None for p in every])), "array<struct<k:bigint,t:bigint>>")
    back = F.from_json(F.lit(json.dumps([before.get(p, 0) for p in every])), "array<int>")
    own_key, part_name, place = unused(docs, "range_key"), unused(docs, "range_part"), unused(docs, "range_place")
    rows = docs.withColumn(own_key, first_key).withColumn(part_name, _range_of(F.col(own_key), F.col(tie), bounds).cast("int"))
    head = F.get(heads_of, F.col(part_name))
    is_head = (F.col(own_key) == head["k"]) & (F.col(tie) == head["t"])
    stay = F.struct(F.col(part_name).alias("range"), F.lit(0).alias("guest"))
    places = F.when(is_head, F.array(stay, F.struct(F.get(back, F.col(part_name)).alias("range"), F.lit(1).alias("guest")))).otherwise(F.array(stay))
    sent = rows.withColumn(place, F.explode(places)).withColumn(part_name, F.col(f"{place}.range")).withColumn(place, F.col(f"{place}.guest"))
    dealt = prepare(sent.repartition(part_name))
    order = Window.partitionBy(part_name).orderBy(F.col(place), F.col(own_key), F.col(tie))
    return dealt.withColumn("next", F.lead(F.struct(*columns)).over(order)).where(F.col(place) == 0).drop(own_key, part_name, place)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, ``text``, ``fingerprint``, ``edited`` text, ``edited_fingerprint``, and the next row's ``next_fingerprint``."""
    base = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    placed = with_next(base, "id", ["text", "fingerprint"], "tie", lambda rows: with_fingerprint(rows, "text", "fingerprint"))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = placed.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next.text"), F.lit(1), cut)))
    return with_fingerprint(edited, "edited", "edited_fingerprint").select(F.col("id").alias(key), "text", "fingerprint", "edited", "edited_fingerprint", F.col("next.fingerprint").alias("next_fingerprint"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = fingerprints(docs)
    return made.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        F.size(locate_edits(F.col("edited_fingerprint"), F.col("fingerprint"))).cast("long").alias("edited_paragraphs"),
    )


def _sql_tree(text: str) -> str:
    """DuckDB: sections of paragraphs of phrase digests."""
    pieces = rf"regexp_extract_all(x, '(?s).{{1,{PHRASE}}}')"
    phrases = rf"flatten(list_transform(string_split(regexp_replace(q, '([.!?,;:|])([\x20\x09-\x0D])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: {pieces}))"
    return rf"list_transform(string_split({text}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda q: list_transform({phrases}, lambda y: sha256(y))))"


def _sql_print(tree: str) -> str:
    paragraph = "sha256('P' || array_to_string(l, ''))"
    section = "sha256('S' || array_to_string(list_transform(p, lambda l: " + paragraph + "), ''))"
    shown = f"array_to_string(list_transform(list_concat([{paragraph}], l), lambda y: substr(y, 1, {TAG})), ' ')"
    tags = f"array_to_string(list_transform({tree}, lambda p: substr({section}, 1, {TAG}) || '=' || array_to_string(list_transform(p, lambda l: {shown}), '|')), '/')"
    return f"sha256('R' || array_to_string(list_transform({tree}, lambda p: {section}), '')) || ':' || {tags}"


def _sql_leaves(tree: str) -> str:
    return f"list_distinct(list_transform(flatten(flatten({tree})), lambda y: substr(y, 1, {TAG})))"


def _sql_near(a: str, b: str) -> str:
    x, y = _sql_leaves(f"{a}_tree"), _sql_leaves(f"{b}_tree")
    return f"CASE WHEN split_part({a}, ':', 1) = split_part({b}, ':', 1) THEN 1.0 ELSE 2.0 * len(list_intersect({x}, {y})) / greatest(len({x}) + len({y}), 1) END"


#: The same in DuckDB, for tables with unique ids.
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first(t) OVER (ORDER BY doc_id)) AS u FROM d),
e AS (SELECT *, substr(t, 1, length(t) - length(t) // 4) || substr(u, 1, length(t) // 4) AS v FROM n),
r AS (SELECT *, {_sql_tree('t')} AS f_tree, {_sql_tree('v')} AS g_tree, {_sql_tree('u')} AS h_tree FROM e),
p AS (SELECT *, {_sql_print('f_tree')} AS f, {_sql_print('g_tree')} AS g, {_sql_print('h_tree')} AS h FROM r),
k AS (SELECT *, list_transform(string_split(split_part(f, ':', 2), '/'), lambda s: split_part(s, '=', 1)) AS own, string_split(split_part(f, ':', 2), '/') AS own_parts, string_split(split_part(g, ':', 2), '/') AS new_parts FROM p),
m AS (SELECT *, list_filter(new_parts, lambda s: NOT list_contains(own, split_part(s, '=', 1))) AS added, list_filter(own_parts, lambda s: NOT list_contains(list_transform(new_parts, lambda z: split_part(z, '=', 1)), split_part(s, '=', 1))) AS gone FROM k)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(v) AS edited_sha256, f AS fingerprint, g AS edited_fingerprint, CAST({_sql_near('f', 'g')} AS DOUBLE) AS near_edited, CAST({_sql_near('f', 'h')} AS DOUBLE) AS near_next,
  CAST(CASE WHEN split_part(f, ':', 1) = split_part(g, ':', 1) THEN 0 ELSE len(list_filter(flatten(list_transform(added, lambda s: list_transform(string_split(split_part(s, '=', 2), '|'), lambda q: split_part(q, ' ', 1)))), lambda x: NOT list_contains(flatten(list_transform(gone, lambda s: list_transform(string_split(split_part(s, '=', 2), '|'), lambda q: split_part(q, ' ', 1)))), x))) END AS BIGINT) AS edited_paragraphs
FROM m
"""
