"""Quality classifier: importance resampling with hashed n-gram models, sampled by Gumbel top-k.

Two generative models over hashed word unigrams and bigrams are compared: the target model, counted on labelled good
rows, and the raw model, counted on every document.  A document's log importance weight is the sum over its n-grams
of ``log p_target - log p_raw``; adding Gumbel noise and keeping the k largest keys samples k documents without
replacement in proportion to the weights.

Only per-bucket counts (``BUCKETS`` rows) reach the driver, from all documents.  The target model is fitted on a
bounded sample of labelled rows: at most about ``max_target_rows``, chosen by hash.  k is the share of fit rows among all
labels, times the number of documents; the k-th largest key is found exactly by counting keys in ever finer ranges.

Defined results: a null or empty text has no n-gram, weight 0 and only its noise.  Noise depends on the id and the
seed; rows with equal ids and texts have equal keys, and all rows with the k-th key are selected.  Without good
labels the two models are equal and the sample is uniform.  Long texts are read in blocks.  Empty tables give empty results.  No
other columns are carried, so none can clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medspan.llm.common import checkpointed, shingle_hashes, word_blocks

BUCKETS = 1 << 14
RANGES = 4096


def _grams(texts: pa.Array):
    """(row, bucket) of each word and word pair, in blocks."""
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    for doc, h, _, _, fresh in word_blocks(texts, overlap=1):
        pair, at = shingle_hashes(doc, h, 2)
        yield doc[fresh:], (h[fresh:] >> shift).astype(np.int64)
        yield doc[at], (pair >> shift).astype(np.int64)


def count_models(docs: DataFrame, good: DataFrame, key: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket over the ``good`` ids (a bounded table) and over all documents."""
    marked = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(good.select(F.col("id"), F.lit(True).alias("good"))), "id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))

    def count(batches):
        total = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            good_row = batch.column("good").to_numpy(zero_copy_only=False)
            for row, bucket in _grams(batch.column("text")):
                total[1] += np.bincount(bucket, minlength=BUCKETS)
                total[0] += np.bincount(bucket[good_row[row]], minlength=BUCKETS)
        at = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[0][at]), pa.array(total[1][at])], ["bucket", "target", "raw"])

    found = marked.mapInArrow(count, "bucket int, target bigint, raw bigint").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toPandas()
    out = np.zeros((2, BUCKETS), dtype=np.int64)
    out[0][found["bucket"]], out[1][found["bucket"]] = found["target"], found["raw"]
    return out[0], out[1]


def log_ratios(target: np.ndarray, raw: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + smoothing) / (target.sum() + smoothing * BUCKETS)) - np.log((raw + smoothing) / (raw.sum() + smoothing * BUCKETS))


def weigh(docs: DataFrame, ratios: np.ndarray, key: str, text: str) -> DataFrame:
    """(key, ``n_grams``, ``log_weight``) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    @F.arrow_udf("struct<n_grams:bigint,log_weight:double>")
    def weight(texts: pa.Array) -> pa.Array:
        n, total = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
        for row, bucket in _grams(texts):
            n += np.bincount(row, minlength=len(texts))
            total += np.bincount(row, weights=shared.value[bucket], minlength=len(texts))
        return pa.StructArray.from_arrays([pa.array(n), pa.array(total)], ["n_grams", "log_weight"])

    return docs.select(F.col(key), weight(F.col(text)).alias("w")).select(key, "w.n_grams", "w.log_weight")


def kth_largest(rows: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of an integer column, by counting in ever finer ranges; None if k is 0 or there is no row."""
    ends = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n")).first()
    if not k or not ends["n"]:
        return None
    lo, hi, k = ends["lo"], ends["hi"], min(k, ends["n"])
    while lo < hi:
        step = -(-(hi - lo + 1) // RANGES)
        place = F.expr(f"({column} - {lo}L) div {step}L")
        counts = rows.where(F.col(column).between(lo, hi)).groupBy(place.alias("at")).agg(F.count("*").alias("n")).collect()
        for r in sorted(counts, key=lambda r: -r["at"]):
            if r["n"] >= k:
                lo, hi = lo + r["at"] * step, min(hi, lo + (r["at"] + 1) * step - 1)
                break
            k -= r["n"]
    return lo


def resample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", good: str = "quality = 1 AND coalesce(toxic, 0) = 0", fit: str = "quality = 1", share: float | None = None, max_target_rows: int = 20_000, seed: str = "gumbel") -> DataFrame:
    """One row per document: key, ``n_grams``, ``log_weight``, ``gumbel_key``, ``selected``.

    ``share`` of the documents is selected; by default the share of labels for which ``fit`` holds.
    """
    ids = labels.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.expr(good).alias("good"), F.expr(fit).alias("fit")).groupBy("id").agg(F.min(F.coalesce("good", F.lit(False))).alias("good"), F.min(F.coalesce("fit", F.lit(False))).alias("fit"))
    seen = ids.agg(F.count("*").alias("n"), F.count(F.when(F.col("good"), 1)).alias("good"), F.count(F.when(F.col("fit"), 1)).alias("fit")).first()
    limit = int(min(1.0, max_target_rows / max(1, seen["good"])) * (1 << 30))
    sample = ids.where(F.col("good") & (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < limit)).select("id")
    ratios = log_ratios(*count_models(docs, sample, key, text))
    uniform = (F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit("u")), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    keyed = checkpointed(weigh(docs, ratios, key, text).withColumn("gumbel", F.round((F.col("log_weight") - F.log(-F.log(uniform))) * 1e6).cast("long")))
    wanted = (seen["fit"] / seen["n"] if seen["n"] else 1.0) if share is None else share
    edge = kth_largest(keyed, "gumbel", round(wanted * keyed.count()))
    return keyed.select(key, "n_grams", "log_weight", (F.col("gumbel") / 1e6).alias("gumbel_key"), (F.col("gumbel") >= edge if edge is not None else F.lit(False)).alias("selected"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return resample(docs, labels)
