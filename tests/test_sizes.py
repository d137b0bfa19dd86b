"""Steps whose work must not grow with the product or square of what repeats itself."""

from __future__ import annotations

import tracemalloc
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from medspan.operators import graph, mentions, projection, vectors
from medspan.session import DEALT_BYTES, dealt, stage
from medspan.sources import release
from medspan.sources.index import Index


def join_rows(df) -> int:
    """The most rows that a join of ``df``'s own plan puts out, once it has run; staged parts count apart."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    left, most = [execution.executedPlan()], 0
    while left:
        node = left.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            left.append(node.plan())
        else:
            if "Join" in name and node.metrics().contains("numOutputRows"):
                most = max(most, node.metrics().apply("numOutputRows").value())
            left += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_alignment_is_made_once_for_what_is_alike(spark):
    """400 mentions of one drug near 400 components of equal strength and length of name."""
    n = spark.range(400)
    node = F.concat(F.lit("c:"), F.lpad(F.col("id").cast("string"), 3, "0"))
    doubles = lambda *x: F.array(*[F.col("id") * 0.0 + v for v in x])
    hit = F.struct(F.lit("first").alias("concept_id"), F.lit("x").alias("name"), F.lit(1).alias("depth"))
    base = n.select(F.col("id").alias("mention_id"), F.array().cast("array<string>").alias("anchors"))
    scd = n.select(F.col("id").alias("mention_id"), doubles(5, 7).alias("scd_mg"), F.lit("d:1").alias("scd_id"))
    scdc = n.select(F.col("id").alias("mention_id"), F.lit("SCDC").alias("target"), hit.alias("hit"), doubles(9999).alias("mg"))
    names = n.select(node.alias("concept_id"), F.lit("SCDC").alias("tty"), F.concat(F.lit("name "), node).alias("name"), doubles(5, 10).alias("mg"))
    edges = release.both_ways(n.select(F.lit("d:1").alias("src"), node.alias("dst"), F.lit("RO").alias("rel"), F.lit("consists_of").alias("rela")))
    ingredients = n.select(node.alias("concept_id"), F.array(F.lit("a")).alias("ingredients"))
    scdc, scd, base = (stage(x) for x in (scdc, scd, base))
    made = projection.realigned(scdc, scd, base, Index(names, names, names, edges, ingredients, names), 3)
    assert {(r.mention_id, r.hit.concept_id, r.hit.name, r.hit.depth) for r in made.collect()} == {(i, "c:000", "name c:000", 1) for i in range(400)}
    assert join_rows(made) <= 2000


def test_staged_tables_of_many_rows_are_not_broadcast(spark):
    joined = lambda n: spark.range(1_000_000).join(stage(spark.range(n)), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in joined(1_000)
    assert "Broadcast" not in joined(60_000)


def test_lines_and_mentions_are_made_piece_by_piece(spark):
    """Notes beyond one piece in one task, null ones between; no Arrow function makes all that a batch of rows holds at once."""
    texts = {i: None if i % 7 == 0 else f"note {i} aspirin 20 mg; \nline {'word ' * (i % 90)}\n" for i in range(2000)}
    notes = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").coalesce(1)
    lines = mentions.note_lines(notes)
    want = [(i, n, at, at + len(x), [(m[0], at + m.start(), at + m.end()) for m in mentions.tokens_of(x)]) for i, t in texts.items() if t is not None for n, (at, x) in enumerate(mentions.lines_of(t))]
    assert sorted((r.doc_id, r.line_no, r.start, r.end, [tuple(t) for t in r.tokens]) for r in lines.collect()) == want
    known = spark.createDataFrame([("aspirin", "1", "aspirin", "IN", 1)], "norm_text string, concept_id string, raw_text string, tty string, pos int")
    found = [mentions.detect_mentions(notes, known, max_broadcast_bytes=most) for most in (1 << 20, 0)]
    plain = {(i, m["text"], m["start"]) for i, t in texts.items() if t is not None for m in mentions.detect(t, lambda key: [("1", "IN")] if key == "aspirin" else [])}
    for rows in found:
        assert {(r.doc_id, r.text, r.start) for r in rows.collect()} == plain
    for made in (lines, *found):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "ArrowEvalPython" not in plan


def test_a_search_holds_one_block_and_few_scores():
    """A full block of the default size: what its scores take at once stays below what the block itself may."""
    n = vectors.MAX_MATRIX_BYTES // (4 * 64)
    matrix = np.random.default_rng(5).standard_normal((n, 64)).astype(np.float32)
    tracemalloc.start()
    block = vectors.Block([f"{i:07d}" for i in range(n)], [matrix[: n // 2], matrix[n // 2 :]])
    row, at, _ = block.best(matrix[: block.step], 40)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
    assert len(row) == 40 * block.step and set(np.arange(block.step)) == {r for r, a in zip(row, at, strict=True) if r == a}


def test_both_ways_holds_each_relation_once(spark):
    """Repeats, inverse rows, loops and nulls; no distinct gets both directions of a relation."""
    rows = [("a", "b", "RO", "x"), ("b", "a", "RO", "x"), ("a", "b", "RO", "x"), ("a", "b", "RO", "y"), ("c", "c", "RO", "x"), (None, "a", "RO", "x"), ("a", None, "RO", "x"), (None, None, "RO", "x"), ("b", "c", None, None)]
    made = release.both_ways(spark.createDataFrame(rows, "src string, dst string, rel string, rela string"))
    assert Counter(map(tuple, made.collect())) == Counter({*rows, *[(b, a, *r) for a, b, *r in rows]})
    assert "Union" not in made._jdf.queryExecution().executedPlan().toString()


def test_partitions_grow_with_a_table(spark):
    """Ten times the rows: ten times the partitions, so that none grows; few rows stay as they are."""
    parts = [dealt(spark.range(n * DEALT_BYTES // 8), "id").rdd.getNumPartitions() for n in (1, 10, 100)]
    assert parts == [spark.sparkContext.defaultParallelism, 10, 100]


def test_targets_of_a_closure_share_its_walk(spark, monkeypatch):
    """20 targets that allow the same: their walk joins each edge once, whatever number of bits is walked at once."""
    pairs = [(f"a{i}", f"b{j}") for i in range(10) for j in range(30)]
    edges = stage(spark.createDataFrame([("top", f"a{i}", "isa") for i in range(10)] + [(a, b, "isa") for a, b in pairs] + [("b0", "top", "isa")], "src string, dst string, rela string"))
    allowed = graph.relation_table(spark, {f"t{k}": ["isa"] if k else ["other", "isa"] for k in range(20)})
    seeds = spark.createDataFrame([("top", f"t{k}") for k in range(20)] + [("top", "unknown")], "seed string, target string")
    want = {("top", f"t{k}", n, d) for k in range(20) for n, d in [("top", 0), *[(f"a{i}", 1) for i in range(10)], *[(f"b{j}", 2) for j in range(30)]]} | {("top", "unknown", "top", 0)}
    made = graph.closure(seeds, edges, allowed, 2)
    assert Counter(map(tuple, made.collect())) == Counter(want)
    assert join_rows(made) <= 311  # the edges
    for name, value in (("MASK_BITS", 7), ("MAX_BROADCAST_FRONTIER", 0), ("HUB_EDGES", 3)):
        monkeypatch.setattr(graph, name, value)
    assert Counter(map(tuple, graph.closure(seeds, edges, allowed, 3).collect())) == Counter(want)
