"""Relation graph: neighbours, bounded closure by target type, ingredient sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medspan.functions import lexicon as lx
from medspan.session import stage

#: Edges of a node beyond which it is cut into slots, and the most such nodes that are broadcast.
HUB_EDGES, MAX_BROADCAST_HUBS = 500, 100_000
#: Rows of a frontier up to which it is broadcast, so that the edges are not moved.
MAX_BROADCAST_FRONTIER = 100_000
#: Targets that are walked at once, as bits of a signed 64-bit number.
MASK_BITS = 62


def neighbors(edges: DataFrame, relations: list[str]) -> DataFrame:
    """(src, dst): distinct neighbours of all nodes over the given relations."""
    return edges.where(F.col("rela").isin(relations)).select("src", "dst").distinct()


def relation_table(spark: SparkSession, targets: dict[str, list[str]] | None = None) -> DataFrame:
    """(target, rela): allowed relations by target type; a few dozen rows."""
    rows = [(t, r) for t, names in (targets or lx.TARGET_RELATIONS).items() for r in names]
    return spark.createDataFrame(rows, "target string, rela string")


def closure(seeds: DataFrame, edges: DataFrame, allowed: DataFrame, max_depth: int = 3, wanted: DataFrame | None = None) -> DataFrame:
    """(seed, target, node, depth): least number of hops from each seed over the relations its target allows.

    ``seeds`` has (seed, target).  Breadth first: a hop expands only nodes that no earlier hop reached, so each (seed, target, node) is
    expanded once, at its least depth.  Most targets allow the same relations and reach the same nodes, so a walk goes from (seed, node)
    with the targets as bits of one number, and an edge has those that allow it; rows by target are made of what was reached.  ``allowed`` is
    a constant table.  With ``wanted`` (node, target), only such nodes are returned.

    A hub (a dose form, a common ingredient) meets all seeds that reach it with all its edges, which no skew join sees coming, as its
    rows are few before the join.  Its edges are cut into slots of about ``HUB_EDGES``, and the rows that reach it go to each slot.  A
    frontier of few rows is broadcast instead, and no edge is moved.
    """
    key = ["seed", "target", "node"]
    start = stage(seeds.select("seed", "target").distinct())
    reached = start.select("seed", "target", F.col("seed").alias("node"), F.lit(0).alias("depth"))
    rows = allowed.select("target", "rela").distinct().collect() if max_depth else []
    targets = sorted({r.target for r in rows})
    for at in range(0, len(targets), MASK_BITS):
        of = {t: i for i, t in enumerate(targets[at : at + MASK_BITS])}
        reached = reached.unionByName(_walk(start, edges, of, [(r.target, r.rela) for r in rows if r.target in of], max_depth))
    return reached if wanted is None else reached.join(wanted, ["node", "target"], "left_semi").select(*key, "depth")


def _walk(start: DataFrame, edges: DataFrame, of: dict[str, int], allowed: list[tuple[str, str]], max_depth: int) -> DataFrame:
    """(seed, target, node, depth) from depth 1 on; ``of`` has the bit of each target."""
    session = start.sparkSession
    bits = session.createDataFrame([(t, 1 << i) for t, i in of.items()], "target string, mask bigint")
    masks: dict[str, int] = {}
    for target, rela in allowed:
        masks[rela] = masks.get(rela, 0) | 1 << of[target]
    none = F.lit(0).cast("bigint")
    links = edges.join(F.broadcast(session.createDataFrame(list(masks.items()), "rela string, allow bigint")), "rela").select(F.col("src").alias("node"), "dst", "allow")
    frontier = stage(start.join(F.broadcast(bits), "target").groupBy("seed").agg(F.bit_or("mask").alias("mask")).select("seed", F.col("seed").alias("node"), "mask"))
    known = frontier.select("seed", "node", none.alias("mask"), F.col("mask").alias("had"))
    found = slotted = None
    for depth in range(1, max_depth + 1):
        if frontier.limit(MAX_BROADCAST_FRONTIER + 1).count() <= MAX_BROADCAST_FRONTIER:
            met = links.join(F.broadcast(frontier), "node")
        else:
            slotted = slotted or _slotted(links)
            met = slotted(frontier)
        hop = met.select("seed", F.col("dst").alias("node"), F.col("mask").bitwiseAND(F.col("allow")).alias("mask"), none.alias("had")).where("mask <> 0")
        both = hop.unionByName(known).groupBy("seed", "node").agg(F.bit_or("mask").alias("mask"), F.bit_or("had").alias("had"))
        new = both.select("seed", "node", F.expr("mask & ~had").alias("mask")).where("mask <> 0")
        if depth < max_depth:
            frontier = new = stage(new)
            known = known.unionByName(new.select("seed", "node", none.alias("mask"), F.col("mask").alias("had")))
        own = F.array_compact(F.array(*[F.when(F.getbit("mask", F.lit(i)) == 1, F.lit(t)) for t, i in of.items()]))
        made = new.select("seed", F.explode(own).alias("target"), "node", F.lit(depth).alias("depth"))
        found = made if found is None else found.unionByName(made)
    return found


def _slotted(links: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """The join of a frontier with ``links`` on the node, and for hubs on a slot."""
    hubs = stage(links.groupBy("node").agg(F.ceil(F.count("*") / F.lit(HUB_EDGES)).cast("int").alias("slots")).where("slots > 1"))
    seen = hubs.limit(MAX_BROADCAST_HUBS + 1).count()
    if not seen:
        return lambda frontier: frontier.join(links, "node")
    hubs = F.broadcast(hubs) if seen <= MAX_BROADCAST_HUBS else hubs
    slots = F.coalesce("slots", F.lit(1))
    cut = links.join(hubs, "node", "left").withColumn("slot", F.pmod(F.xxhash64("dst"), slots).cast("int")).drop("slots")
    dealt = lambda frontier: frontier.join(hubs, "node", "left").withColumn("slot", F.explode(F.sequence(F.lit(0), slots - 1))).drop("slots")
    return lambda frontier: dealt(frontier).join(cut, ["node", "slot"])


def candidates(reach: DataFrame, names: DataFrame) -> DataFrame:
    """Reached nodes that have a name of the target type."""
    typed = names.withColumnRenamed("concept_id", "node").withColumnRenamed("tty", "target")
    return reach.join(typed, ["node", "target"])


def ingredient_sets(concepts: DataFrame, names: DataFrame, edges: DataFrame) -> DataFrame:
    """(concept_id, ingredients): sorted ingredient ids of every concept, empty where none is found.

    Stages, the first that finds any wins: the concept itself if it is an ingredient; ingredients among its direct
    neighbours; among the direct neighbours of its bridge neighbours; among those of a second hop from bridge
    neighbours that are products or brands.
    """
    ingredient = names.where("tty = 'IN'").select(F.col("concept_id").alias("dst")).distinct()
    product = names.where(F.col("tty").isin(*lx.SECOND_HOP_TYPES)).select(F.col("concept_id").alias("via")).distinct()

    direct = neighbors(edges, lx.DIRECT_INGREDIENT_RELATIONS).join(ingredient, "dst", "left_semi").select("src", F.col("dst").alias("found"))
    bridge = neighbors(edges, lx.BRIDGE_RELATIONS).select(F.col("src").alias("concept_id"), F.col("dst").alias("via"))
    second = neighbors(edges, lx.SECOND_HOP_RELATIONS).select(F.col("src").alias("via"), F.col("dst").alias("far"))
    own = ingredient.select(F.col("dst").alias("concept_id"), F.col("dst").alias("found"), F.lit(0).alias("stage"))
    one = direct.select(F.col("src").alias("concept_id"), "found", F.lit(1).alias("stage"))
    two = bridge.join(direct.withColumnRenamed("src", "via"), "via").select("concept_id", "found", F.lit(2).alias("stage"))
    far = bridge.join(product, "via", "left_semi").join(second, "via").select("concept_id", "far").distinct()
    three = far.join(direct.withColumnRenamed("src", "far"), "far").select("concept_id", "found", F.lit(3).alias("stage"))
    found = own.unionByName(one).unionByName(two).unionByName(three)
    by_stage = found.groupBy("concept_id", "stage").agg(F.array_sort(F.collect_set("found")).alias("ingredients"))
    best = by_stage.groupBy("concept_id").agg(F.min_by("ingredients", "stage").alias("ingredients"))
    return concepts.select("concept_id").join(best, "concept_id", "left").select("concept_id", F.coalesce("ingredients", F.array().cast("array<string>")).alias("ingredients"))
