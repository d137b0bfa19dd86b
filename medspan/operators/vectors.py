"""Hashed character n-gram vectors and nearest concepts."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medspan.session import stage

#: A task holds a block of the concept matrix of at most so many bytes, and searches it for a slice of so many queries.
MAX_MATRIX_BYTES, SLICE_QUERIES = 16 << 20, 50_000
#: Scores that a task makes at once: so many queries against its whole block.
MAX_SCORES = 1 << 21


def gram_slot(gram: str, dims: int) -> tuple[int, float]:
    """Index and sign of one n-gram: BLAKE2b, 64 bits, little-endian."""
    h = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "little")
    return h % dims, -1.0 if h >> 63 else 1.0


def embed_text(text: str, dims: int, known: dict[str, tuple[int, float]]) -> np.ndarray:
    """Unit vector of the signed counts of all 3- to 5-grams of a padded text; zeros for an empty one."""
    out = np.zeros(dims, dtype=np.float64)
    if text:
        padded = f" {text} "
        for n in (3, 4, 5):
            for i in range(len(padded) - n + 1):
                gram = padded[i : i + n]
                slot = known.get(gram)
                if slot is None:
                    if len(known) > 500_000:
                        known.clear()
                    slot = known[gram] = gram_slot(gram, dims)
                out[slot[0]] += slot[1]
        norm = np.linalg.norm(out)
        out = out / norm if norm > 0 else out
    return out.astype(np.float32)


def embed(text: Column, dims: int = 256) -> Column:
    """``array<float>`` vector of a normalised text (null: zeros)."""

    @F.arrow_udf("array<float>")
    def vectors(texts: pa.Array) -> pa.Array:
        known: dict[str, tuple[int, float]] = {}
        return pa.array([embed_text(t or "", dims, known) for t in texts.to_pylist()], pa.list_(pa.float32()))

    return vectors(text)


def nearest(queries: DataFrame, concepts: DataFrame, top_k: int = 40, dims: int = 256, max_matrix_bytes: int = MAX_MATRIX_BYTES) -> DataFrame:
    """(query, concept_id, score, rank): the ``top_k`` most similar concepts of each distinct non-empty query.

    ``queries`` has (query), ``concepts`` (concept_id, vec).
    Order: score (rounded to 6 places) descending, then id.
    """
    texts = queries.where("query is not null and query <> ''").select("query").distinct()
    return nearest_vectors(texts.withColumn("vec", embed(F.col("query"), dims)), concepts, top_k, max_matrix_bytes)


def _matrix(vectors: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of an Arrow list column as a matrix, from its buffer."""
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dims)


class Block:
    """Some concepts' ids, in order, and vectors."""

    def __init__(self, ids: list[str], vectors: list[np.ndarray]):
        order = np.array(sorted(range(len(ids)), key=ids.__getitem__))
        self.ids = pa.array([ids[i] for i in order], pa.string())
        matrix = np.nan_to_num(np.concatenate(vectors)[order], nan=-1.0, posinf=1.0, neginf=-1.0)
        self.wide = np.ascontiguousarray(matrix.T, dtype=np.float64)
        #: Queries that are scored at once.
        self.step = max(1, MAX_SCORES // len(ids))

    def best(self, queries: np.ndarray, top_k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, place in the block, score) of the ``top_k`` most similar concepts; ids are in order, so a stable sort settles ties."""
        scores = queries.astype(np.float64) @ self.wide
        np.round(scores, 6, out=scores)
        k = min(top_k, scores.shape[1])
        edge = np.partition(scores, -k, axis=1)[:, -k]
        row, at = np.nonzero(scores >= edge[:, None])
        value = scores[row, at]
        order = np.lexsort((at, -value, row))
        row, at, value = row[order], at[order], value[order]
        first = np.searchsorted(row, row)
        kept = np.arange(len(row)) - first < k
        return row[kept], at[kept], value[kept]


def nearest_vectors(queries: DataFrame, concepts: DataFrame, top_k: int, max_matrix_bytes: int = MAX_MATRIX_BYTES, slice_queries: int = SLICE_QUERIES) -> DataFrame:
    """``nearest`` for queries that come with their vectors: (query, vec), of the concepts' width.

    A block product: concepts are dealt to blocks, queries to slices, and each (block, slice) is a cell with the rows of both.  A cell's
    concepts are read first and held, its queries stream past them, so a task's memory is one block, and no vector
    passes the driver.  The best of each block meet in the window's group limit, which also cuts them before the shuffle.
    """
    queries = stage(queries.select("query", "vec"))  # counted, then dealt
    seen = concepts.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dims")).first()
    dims = seen["dims"] or 1
    blocks = max(1, -(-seen["n"] // max(1, max_matrix_bytes // (4 * dims))))
    slices = max(1, -(-queries.count() // slice_queries))
    cores = queries.sparkSession.sparkContext.defaultParallelism
    slices = max(slices, min(cores // blocks, slices * cores)) if seen["n"] else slices
    block, part = F.pmod(F.xxhash64("concept_id"), F.lit(blocks)), F.pmod(F.xxhash64("query"), F.lit(slices))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = concepts.withColumns({"block": block, "part": every(slices)}).select("block", "part", F.lit(0).alias("kind"), F.col("concept_id").alias("name"), "vec")
    asked = queries.withColumns({"part": part, "block": every(blocks)}).select("block", "part", F.lit(1).alias("kind"), F.col("query").alias("name"), "vec")

    def search(batches):
        cell, ids, vectors, own = None, [], [], None
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("block", "part", "kind")], axis=1)
            matrix = _matrix(batch.column("vec"), dims)
            edges = np.flatnonzero(np.append(True, (place[1:] != place[:-1]).any(1))).tolist() + [len(place)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if tuple(place[lo, :2]) != cell:
                    cell, ids, vectors, own = tuple(place[lo, :2]), [], [], None
                names = batch.column("name").slice(lo, hi - lo)
                if place[lo, 2] == 0:
                    ids += names.to_pylist()
                    vectors.append(matrix[lo:hi].copy())
                    continue
                if own is None and ids:
                    own = Block(ids, vectors)
                    vectors = []
                for at in range(0, hi - lo, own.step) if own else ():
                    row, near, value = own.best(matrix[lo + at : min(lo + at + own.step, hi)], top_k)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(row + at)), own.ids.take(pa.array(near)), pa.array(value)], ["query", "concept_id", "score"])

    dealt = held.unionByName(asked).repartition("block", "part").sortWithinPartitions("block", "part", "kind")
    found = dealt.mapInArrow(search, "query string, concept_id string, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "concept_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
