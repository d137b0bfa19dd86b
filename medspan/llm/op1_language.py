"""Language identification: multinomial naive Bayes over hashed character n-grams.

``train`` counts hashed character bigrams and trigrams per language on a bounded, hash-ordered sample of labelled
rows; ``identify`` broadcasts the log-probability matrix (languages x bins) and scores whole texts in Arrow batches, as sparse rows of
bin indices summed with numpy.  A matrix of more than ``BLOCK_LANGUAGES`` languages comes in blocks that meet the texts one after
another, so no task and no driver holds more than one; what a text has reached so far (best language, mass of all) is carried along.

``fit`` tells how well a text suits the language chosen: the mean log-probability of its n-grams above that of a model that
knows no language (all bins equally likely).  The posterior cannot tell that, since it only compares learned languages.  ``accepted``
rejects what has no letter, no clear best language, or a ``fit`` under ``MIN_FIT``: unlearned scripts and letter junk lie far below, and
texts of a learned language that consist mostly of numbers stay above.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and fit 0; with no labelled row at all every
text is ``und``, and ``accepted`` then keeps every row, as nothing can be judged.  Ties go to the language first in code-point order.
Texts of any length are read in blocks.  Empty tables give empty results, repeated rows are each scored, and the columns of the
input are kept (``lang_pred``, ``score`` and ``fit`` are replaced).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medspan.llm.common import checkpointed, unused

BINS = 1 << 15
BLOCK = 1 << 18
UNDETERMINED = "und"
#: Languages of a block of the matrix (256 KiB each).
BLOCK_LANGUAGES = 256
#: Labels whose sampling shares are broadcast (one short row each); more are joined by a shuffle.
MAX_BROADCAST_LABELS = 100_000
MIN_FIT = -2.0
STATE = "struct<lang:string,total:double,prior:double,mass:double,grams:bigint>"


@dataclass(frozen=True)
class Block:
    langs: list[str]
    log_prior: np.ndarray
    #: One row per language; the last column stands for positions that are no n-gram and holds zeros.
    log_prob: np.ndarray


@dataclass(frozen=True)
class LanguageModel:
    """Languages in code-point order with their priors, and the counts (lang, bin, n) of their n-grams."""

    langs: list[str]
    log_prior: np.ndarray
    counts: DataFrame | None
    smoothing: float
    at_once: int

    def blocks(self) -> Iterator[Block]:
        """The matrix, ``at_once`` languages at a time."""
        for at in range(0, len(self.langs), self.at_once):
            langs = self.langs[at : at + self.at_once]
            counts = self.counts.where(F.col("lang").between(langs[0], langs[-1])).toPandas()
            table = np.zeros((len(langs), BINS + 1))
            for i, name in enumerate(langs):
                own = counts[counts["lang"] == name]
                table[i, own["bin"].to_numpy()] = own["n"].to_numpy()
            log_prob = np.zeros_like(table)
            log_prob[:, :BINS] = np.log((table[:, :BINS] + self.smoothing) / (table[:, :BINS].sum(1, keepdims=True) + self.smoothing * BINS))
            yield Block(langs, self.log_prior[at : at + self.at_once], log_prob)


def _blocks(texts: list[str | None], block: int = BLOCK):
    """Yield (rows, starts, bigram bins, trigram bins): n-grams of lower-cased texts, framed by NUL, in blocks.

    A text longer than a block comes in pieces, so memory is bounded by the block and not by the text.
    """
    rows: list[int] = []
    pieces: list[str] = []
    counts: list[int] = []
    size = 0
    for row, text in enumerate(texts):
        if not text:
            continue
        framed = f"\0{text.lower()}\0"
        for at in range(0, len(framed), block):
            piece = framed[at : at + block + 2]
            rows.append(row)
            pieces.append(piece)
            counts.append(min(block, len(framed) - at))
            size += len(piece)
            if size >= block:
                yield _grams(rows, pieces, counts)
                rows, pieces, counts, size = [], [], [], 0
    if rows:
        yield _grams(rows, pieces, counts)


def _grams(rows, pieces, counts):
    lengths = np.array([len(p) for p in pieces])
    c = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    left = np.repeat(starts + np.array(counts), lengths) - np.arange(len(c))  # n-gram starts left in this piece
    room = np.repeat(starts + lengths, lengths) - np.arange(len(c))  # characters left in this piece
    a, b, d = c, np.append(c[1:], 0).astype(np.uint32), np.append(c[2:], [0, 0]).astype(np.uint32)
    two = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA6B))
    three = (two * np.uint32(0xC2B2AE35)) ^ (d * np.uint32(0x27D4EB2F))
    shift = np.uint32(32 - BINS.bit_length() + 1)
    two = ((two * np.uint32(0x165667B1)) >> shift).astype(np.int64)
    three = ((three * np.uint32(0x165667B1)) >> shift).astype(np.int64)
    two[(left <= 0) | (room < 2)] = BINS
    three[(left <= 0) | (room < 3)] = BINS
    return np.array(rows), starts, two, three


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_rows_per_lang: int = 3000, smoothing: float = 0.5, at_once: int = BLOCK_LANGUAGES) -> LanguageModel:
    """Fit the model on at most about ``max_rows_per_lang`` rows of each language, chosen by a hash of ``key``.

    The bound is a documented parameter: beyond it more rows do not move the matrix.  Rows with a null text or
    language are left out, of the priors too.  Any number of languages is learned: one row a label reaches the driver, and counts
    per (language, bin) a block of ``at_once`` languages at a time.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.col(key), F.lit("language")), F.lit(1 << 30)).alias("at"))
    found = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not found:
        return LanguageModel([], np.zeros(0), None, smoothing, at_once)
    share = spark.createDataFrame([(k, int(min(1.0, max_rows_per_lang / n) * (1 << 30))) for k, n in found.items()], "lang string, share bigint")
    share = F.broadcast(share) if len(found) <= MAX_BROADCAST_LABELS else share
    sample = rows.join(share, "lang").where("at < share").select("lang", "text").repartition(8 * -(-len(found) // at_once))

    def counted(total):
        for name, have in total.items():
            at = np.flatnonzero(have[:BINS])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(have[at], pa.int64())], ["lang", "bin", "n"])

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for at, starts, two, three in _blocks(batch.column("text").to_pylist(), BLOCK):
                ends = np.append(starts[1:], len(two))
                for row, lo, hi in zip(at, starts, ends, strict=True):
                    if len(total) >= at_once and langs[row] not in total:  # so many languages are held at most
                        yield from counted(total)
                        total = {}
                    have = total.setdefault(langs[row], np.zeros(BINS + 1, np.int64))
                    have += np.bincount(two[lo:hi], minlength=BINS + 1)
                    have += np.bincount(three[lo:hi], minlength=BINS + 1)
        yield from counted(total)

    counts = checkpointed(sample.mapInArrow(count, "lang string, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n")))
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    total = sum(found[x] for x in langs) or 1
    return LanguageModel(langs, np.log(np.array([found[x] / total for x in langs])), counts, smoothing, at_once)


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def score_block(texts: list[str | None], block: Block, before: pa.StructArray | None = None) -> pa.StructArray:
    """Each text's best language of this block and the ones ``before``: with its log-probability (``total``), its prior, the log of
    the summed probabilities of all languages (``mass``), and the number of n-grams.  A text without a letter has no language."""
    n = len(texts)
    total, grams = np.tile(block.log_prior, (n, 1)), np.zeros(n, np.int64)
    for at, starts, two, three in _blocks(texts):
        np.add.at(grams, at, np.add.reduceat((two < BINS).astype(np.int64) + (three < BINS), starts))
        for j in range(len(block.langs)):
            table = block.log_prob[j]
            np.add.at(total[:, j], at, np.add.reduceat(table[two] + table[three], starts))
    top = total.argmax(1)
    best, prior = total.max(1), block.log_prior[top]
    mass = best + np.log(np.exp(total - best[:, None]).sum(1))
    langs = [block.langs[i] if _has_letter(t) else None for i, t in zip(top.tolist(), texts, strict=True)]
    if before is not None:
        held = {k: before.field(k).to_numpy(zero_copy_only=False) for k in ("total", "prior", "mass")}
        keep = held["total"] >= best
        langs = [a if k else b for k, a, b in zip(keep.tolist(), before.field("lang").to_pylist(), langs, strict=True)]
        best, prior, mass = np.where(keep, held["total"], best), np.where(keep, held["prior"], prior), np.logaddexp(held["mass"], mass)
    return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(best), pa.array(prior), pa.array(mass), pa.array(grams)], ["lang", "total", "prior", "mass", "grams"])


def scorer(shared) -> Callable:
    """``score_block`` of a broadcast block as a function of columns: texts, and what came before (null: nothing)."""

    @F.arrow_udf(STATE)
    def language(texts: pa.Array, before: pa.Array) -> pa.Array:
        return score_block(texts.to_pylist(), shared.value, before if before.null_count < len(before) else None)

    return language


def judged(docs: DataFrame, model: LanguageModel, text: str, made: str) -> DataFrame:
    """``docs`` with the struct ``made`` of ``lang_pred``, ``score`` and ``fit``."""
    state = F.lit(None).cast(STATE)
    for i, block in enumerate(model.blocks()):
        language = scorer(docs.sparkSession.sparkContext.broadcast(block))
        if i:  # what came before is computed and kept, so that tasks hold one block of the matrix
            docs, state = checkpointed(docs), F.col(made)
        docs = docs.withColumn(made, language(F.col(text), state))
    if not model.langs:
        docs = docs.withColumn(made, state)
    own, known = F.col(made), F.col(f"{made}.lang").isNotNull()
    score, fit = F.least(F.exp(own["total"] - own["mass"]), F.lit(1.0)), (own["total"] - own["prior"]) / F.greatest(own["grams"], F.lit(1)) + F.lit(math.log(BINS))
    return docs.withColumn(made, F.struct(F.coalesce(own["lang"], F.lit(UNDETERMINED)).alias("lang_pred"), F.when(known, score).otherwise(0.0).alias("score"), F.when(known, fit).otherwise(0.0).alias("fit")))


def held_out(key: Column) -> Column:
    """Whether a row is kept from training: crc32 of its key as text, modulo 3, is 1.  A null key is held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``fit`` of every whole text."""
    made = unused(docs, "language")
    found = judged(docs, model, text, made)
    return found.withColumns({c: F.col(f"{made}.{c}") for c in ("lang_pred", "score", "fit")}).drop(made)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "fit")


def accepted(docs: DataFrame, model: LanguageModel, min_score: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose language cannot be told: ``und``, a score under ``min_score``, or a ``fit`` under ``MIN_FIT``."""
    if not model.langs:
        return docs
    made = unused(docs, "language")
    found = judged(docs, model, text, made)
    return found.where((F.col(f"{made}.lang_pred") != UNDETERMINED) & (F.col(f"{made}.score") >= min_score) & (F.col(f"{made}.fit") >= MIN_FIT)).drop(made)
