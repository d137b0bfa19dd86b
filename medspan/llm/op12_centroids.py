"""Centroid clustering: Lloyd rounds over integer vectors, nearest centroids by partial-distance search.

1. ``integer_vectors``: vectors with exactly ``dims`` components, none null or not finite, as floor(``scale`` * x).  They are written
   once, as Arrow lists, and every round reads those.
2. The first ``k`` centroids are the vectors with the smallest SHA-256 of ``<seed>:<id>``: a top-k, so only ``k`` rows reach the driver.
3. ``nearest``: dimensions are taken in the order of their variance over all vectors, the largest first, ``STEP`` at a time.  The
   centroid that leads after the first step is finished for a bound; each other one is dropped as soon as its partial sum
   is strictly above the vector's best, and survivors finish all dimensions.  Partial sums only grow, so no nearest centroid
   is lost, and equal distances survive to be settled by the smaller number.
4. Each task adds up its vectors by centroid; Spark adds those sums by (centroid, dimension), and ``k * dims`` numbers reach the driver.
   Centroids are broadcast with each round's function; their size does not depend on the data.

Arithmetic is exact: 64-bit integers while every component is below ``NARROW``, else Python's own.  Sums travel in limbs of 32 bits.

Defined results: an id may be null or repeated; every kept row is a vector of its own.  Null ids come last in the choice of first
centroids, and equal hashes are ordered by the components.  With fewer than ``k`` kept vectors there are as many centroids; with none the result is
empty.  Equal vectors get equal clusters.  A distance or inertia above 2**63 - 1 is given as that.  ``clustered`` returns the
columns listed there and no others, whatever the input's are called.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medspan.llm.common import checkpointed

DIMS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Dimensions that are added up between two looks at the bounds.
STEP = 8
#: Components of smaller magnitude keep all sums of squares of 64 differences within 64 bits.
NARROW = 1 << 27
LIMB = 32
VECTORS_AT_ONCE = 4096
LARGEST = (1 << 63) - 1


@dataclass
class Clustering:
    """``assigned`` (id, cluster, distance) and the final ``centroids``."""

    assigned: DataFrame
    centroids: list[tuple[int, ...]]


def integer_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(id, narrow, wide): the kept vectors; ``narrow`` holds the integers, or where those are too large ``wide`` their digits."""

    def cut(batches):
        for batch in batches:
            lists = batch.column("vector")
            values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
            first, size = lists.offsets.to_numpy().astype(np.int64), np.asarray(lists.value_lengths().fill_null(-1))
            fit = np.flatnonzero(size == dims)
            for lo in range(0, len(fit), VECTORS_AT_ONCE):
                own = fit[lo : lo + VECTORS_AT_ONCE]
                x = values[first[own][:, None] + np.arange(dims)]
                whole = np.isfinite(x).all(1)
                own, x = own[whole], x[whole]
                small = (np.abs(x) < NARROW // scale).all(1)
                v = np.floor(scale * np.where(small[:, None], x, 0)).astype(np.int64)
                narrow = [a if s else None for a, s in zip(v, small, strict=True)]
                wide = [None if s else [str(floor(Fraction(float(c)) * scale)) for c in a] for a, s in zip(x, small, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(own)), pa.array(narrow, pa.list_(pa.int64())), pa.array(wide, pa.list_(pa.string()))], ["id", "narrow", "wide"])

    wanted = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    return wanted.mapInArrow(cut, "id bigint, narrow array<bigint>, wide array<string>")


def _matrices(batch: pa.RecordBatch, dims: int):
    """Yield (rows, matrix) of a batch, some thousand vectors at a time: 64-bit ones, then those of Python integers."""
    lists = batch.column("narrow")
    held = np.flatnonzero(np.asarray(lists.is_valid()))
    flat = lists.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    for lo in range(0, len(held), VECTORS_AT_ONCE):
        yield held[lo : lo + VECTORS_AT_ONCE], flat[lo : lo + VECTORS_AT_ONCE]
    rest = np.flatnonzero(np.asarray(batch.column("wide").is_valid()))
    for lo in range(0, len(rest), VECTORS_AT_ONCE):
        own = rest[lo : lo + VECTORS_AT_ONCE]
        yield own, np.array([[int(c) for c in batch.column("wide")[int(i)].as_py()] for i in own], dtype=object)


def nearest(vectors: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance) of each vector, and how many (vector, centroid, dimension) differences were computed.

    ``order`` lists the dimensions, the most telling first.  On equal distances the smaller centroid number wins.
    """
    n, k, d = len(vectors), len(centroids), len(order)
    v, c = vectors[:, order], centroids[:, order]
    square = lambda rows, own, a, b: ((v[rows, a:b] - c[own, a:b]) ** 2).sum(1)
    row, own = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    part = square(row, own, 0, step)
    lead = part.reshape(n, k).argmin(1)
    best, best_of = part.reshape(n, k)[np.arange(n), lead] + square(np.arange(n), lead, step, d), lead
    done = n * k * min(step, d) + n * max(d - step, 0)
    open_ = own != np.repeat(lead, k)
    row, own, part = row[open_], own[open_], part[open_]
    for a in range(step, d + step, step):
        alive = part <= best[row]
        row, own, part = row[alive], own[alive], part[alive]
        if a >= d or not len(row):
            break
        part = part + square(row, own, a, a + step)
        done += len(row) * (min(a + step, d) - a)
    # Survivors are whole distances at or below their vector's bound: the least one, then the smaller number.
    finals = np.lexsort((own, part, row)) if part.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], part[i], own[i])), dtype=np.int64)
    row, own, part = row[finals], own[finals], part[finals]
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else row
    row, own, part = row[first], own[first], part[first]
    better = (part < best[row]) | ((part == best[row]) & (own < best_of[row]))
    best[row[better]], best_of[row[better]] = part[better], own[better]
    return best_of, best, done


def _array(centroids: list[tuple[int, ...]]) -> np.ndarray:
    small = all(-NARROW < x < NARROW for c in centroids for x in c)
    return np.array(centroids, dtype=np.int64 if small else object).reshape(len(centroids), -1)


def _assignments(batch: pa.RecordBatch, centroids: np.ndarray, order: np.ndarray):
    """Yield (rows, vectors, centroid of each, distance of each)."""
    for rows, vectors in _matrices(batch, len(order)):
        both = object if object in (vectors.dtype, centroids.dtype) else np.int64
        own, distance, _ = nearest(vectors.astype(both), centroids.astype(both), order)
        yield rows, vectors, own, distance


def _limbs(value: int):
    """(limb number, digit) of an integer in base 2**32; the last digit carries the sign."""
    at = 0
    while not -(1 << 62) < value < 1 << 62:
        yield at, value & ((1 << LIMB) - 1)
        value, at = value >> LIMB, at + 1
    yield at, value


def _summed(batches, label, dims: int):
    """Rows (cluster, dim, limb, part) of the sums of each label's vectors; dimension ``dims`` counts them."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for vectors, own in label(batch):
            for c in np.unique(own).tolist():
                some = vectors[own == c]
                sums = np.append(some.sum(0).astype(object), len(some))
                total[c] = total[c] + sums if c in total else sums
    rows = [(c, d, at, digit) for c, sums in total.items() for d, value in enumerate(sums.tolist()) for at, digit in _limbs(value)]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["cluster", "dim", "limb", "part"])


def _gathered(parts: DataFrame) -> dict[int, dict[int, int]]:
    """{cluster: {dimension: sum}}: the limbs added up by Spark, joined here; as many rows as there are centroids times dimensions."""
    out: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("cluster", "dim", "limb").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part")).collect():
        own = out.setdefault(r["cluster"], {})
        own[r["dim"]] = own.get(r["dim"], 0) + (int(r["part"]) << (LIMB * r["limb"]))
    return out


SUMS = "cluster int, dim int, limb int, part bigint"


def variance_order(vectors: DataFrame, dims: int) -> np.ndarray:
    """Dimensions by falling variance over all 64-bit vectors (it decides only how soon bounds bite)."""

    def squares(batches):
        def label(batch):
            for _, v in _matrices(batch, dims):
                if v.dtype != object:
                    yield np.concatenate([v, v * v], axis=1), np.zeros(len(v), np.int64)

        yield from _summed(batches, label, 2 * dims)

    sums = _gathered(vectors.mapInArrow(squares, SUMS)).get(0)
    if not sums:
        return np.arange(dims)
    n = sums[2 * dims]
    return np.array(sorted(range(dims), key=lambda d: (-(n * sums[dims + d] - sums[d] ** 2), d)))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[tuple[int, ...]]:
    """The ``k`` vectors with the smallest SHA-256 of ``<seed>:<id>``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    found = vectors.orderBy(digest.asc_nulls_last(), "narrow", "wide").limit(k).select("narrow", "wide").collect()
    return [tuple(r["narrow"] or map(int, r["wide"])) for r in found]


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, seed: int = SEED) -> Clustering:
    """Lloyd rounds over ``integer_vectors``; an empty centroid stays where it is."""
    vectors = checkpointed(vectors)
    centroids = first_centroids(vectors, k, seed)
    if not centroids:
        return Clustering(vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), [])
    order = variance_order(vectors, dims)
    for _ in range(rounds):
        now = _array(centroids)

        def sums(batches, now=now):
            yield from _summed(batches, lambda batch: ((v, own) for _, v, own, _ in _assignments(batch, now, order)), dims)

        moved = _gathered(vectors.mapInArrow(sums, SUMS))
        new = [tuple(moved[c][d] // moved[c][dims] for d in range(dims)) if c in moved else old for c, old in enumerate(centroids)]
        if new == centroids:  # further rounds would change nothing
            break
        centroids = new
    final = _array(centroids)

    def assign(batches):
        for batch in batches:
            for rows, _, own, distance in _assignments(batch, final, order):
                capped = [min(int(x), LARGEST) for x in distance] if distance.dtype == object else distance
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), pa.array(own, pa.int32()), pa.array(capped, pa.int64())], ["id", "cluster", "distance"])

    return Clustering(vectors.mapInArrow(assign, "id bigint, cluster int, distance bigint"), centroids)


def clustered(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """key, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` of every kept vector."""
    found = cluster(integer_vectors(rows, key, vector, dims, scale), k, rounds, dims, seed)
    assigned = checkpointed(found.assigned)
    cut = lambda x: F.least(x, F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()  # a row for each centroid
    total = sum(int(r["own"]) for r in sums)
    own = {r["cluster"]: r["own"] for r in sums}
    digests = [(c, min(int(own.get(c, 0)), LARGEST), min(total, LARGEST), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(found.centroids)]
    named = rows.sparkSession.createDataFrame(digests, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(named), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    floored = "(s - ((s % n) + n) % n) // n"
    parts = [
        f"kept AS (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS})",
        f"v AS MATERIALIZED (SELECT rid, i AS dim, CAST(floor({SCALE} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(1, {DIMS + 1}) AS r(i))",
        f"first AS (SELECT rid, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS c FROM kept ORDER BY c LIMIT {CENTROIDS})",
        "c0 AS MATERIALIZED (SELECT c, dim, x FROM first JOIN v USING (rid))",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"d{i} AS (SELECT rid, c, sum((v.x - c{i}.x) * (v.x - c{i}.x)) AS d FROM v JOIN c{i} USING (dim) GROUP BY rid, c)")
        parts.append(f"a{i} AS MATERIALIZED (SELECT rid, c, d FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY d, c) AS r FROM d{i}) WHERE r = 1)")
        if i < ROUNDS:
            parts.append(f"m{i} AS (SELECT c, dim, sum(x) AS s, count(*) AS n FROM a{i} JOIN v USING (rid) GROUP BY c, dim)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c, dim, CAST(coalesce({floored}, x) AS BIGINT) AS x FROM c{i} LEFT JOIN m{i} USING (c, dim))")
    end = f"a{ROUNDS}"
    parts.append(f"h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY dim)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)")
    return "WITH " + ",\n".join(parts) + (
        f"\nSELECT vec_id, CAST({end}.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY {end}.c) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM {end} JOIN kept USING (rid) JOIN h ON h.c = {end}.c"
    )


ORACLE_SQL = _oracle()
