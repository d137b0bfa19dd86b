"""Benchmark decontamination: n-gram seeds join passages to test items, Smith-Waterman scores the copies.

1. Items are cut into words (letters and digits, lower-cased); every ``SEED``-gram of an item is a seed of it.
2. All documents are counted for these n-grams and words.  A seed that stands out of its item as common, or that many
   items share, is bound to the item's rare words (``item_keys``); every other seed is a key by itself.
3. Documents are searched for keys: seeds, and common seeds with a rare word of the same item around them.  Keys that
   stand close together make a passage, widened by the longest alignment that can pass; a passage is kept as word
   hashes with byte offsets and the keys it holds.
4. Keys join passages to items (in place where the benchmark is broadcast), and each (passage, item) pair is aligned, many at a time: 2 for a match,
   -1 for a mismatch or a gap.  The score is the share of the item's own full score.  Pairs whose passage holds too few of
   the item's words for a passing score are not aligned: each match needs its word in the passage, so this loses nothing.

A copy passes with ``min_score`` of its item's full score, or, as an excerpt of a long item, with that of ``EXCERPT`` matching words.
No copy is lost by the keys: a passing alignment matches that many of the item's words, so it matches one
of any set of words that covers more than the rest.  What is required is one intact ``SEED``-gram in the alignment.

The filters that documents are searched with are bit sets of fixed size (``FILTER_BITS``), exact hashes where there
are few; the join decides.  Texts are never moved: only counts and scores are, and with a large benchmark passages around keys.

Defined results: null and empty texts and items under ``SEED`` words match nothing.  The best passage of each (document, item)
is kept; on ties the first.  Repeated rows give one result.  Long texts are read in blocks that overlap by the reach of an
alignment.  Empty tables give empty results.  ``contaminated`` carries no other columns; ``clean`` returns the input's own,
whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medspan.llm.common import checkpointed, mix, shingle_hashes, unused, word_blocks

SEED = 3
FILTER_BITS = 1 << 24
#: Seeds that are also sent as exact hashes; words and keys of a benchmark that is broadcast (a larger one meets passages by shuffles).
MAX_EXACT_SEEDS = 500_000
MAX_BROADCAST_WORDS = 1_000_000
#: A seed is common if it occurs more often than this and far more often than its item's median seed, or in more items than this.
FEW, FAR = 64, 4
MATCH, MISMATCH, GAP = 2, -1, -1
#: So many matching words are a copy however long the item is.
EXCERPT = 25
CELLS_AT_ONCE = 1 << 19
#: Marks of rows to drop that are broadcast; more are joined by a shuffle.
MAX_BROADCAST_MARKS = 1_000_000
PAIR_NAMES = ["doc_id", "item_id", "score", "start_byte", "end_byte"]
PAIRS = "doc_id bigint, item_id bigint, score double, start_byte bigint, end_byte bigint"
PAIRS_AT_ONCE = 1024


def item_words(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, words) of the items with at least ``SEED`` words; words as hashes."""

    def cut(batches):
        for batch in batches:
            ids, n = batch.column("item_id"), batch.num_rows
            words: list[list[np.ndarray]] = [[] for _ in range(n)]
            for doc, h, _, _, fresh in word_blocks(batch.column("text"), letters=True):
                rows, at = np.unique(doc[fresh:], return_index=True)
                for row, own in zip(rows.tolist(), np.split(h[fresh:], at[1:]), strict=False):
                    words[row].append(own)
            kept = [i for i in range(n) if sum(map(len, words[i])) >= SEED]
            lists = pa.array([np.concatenate(words[i]).view(np.int64) for i in kept], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(kept, pa.int64())), lists], ["item_id", "words"])

    return items.select(F.col(item).cast("long").alias("item_id"), F.col(text).alias("text")).mapInArrow(cut, "item_id bigint, words array<bigint>")


def item_grams(words: DataFrame) -> DataFrame:
    """(row, item_id, width, pos, seed) of every n-gram (``width`` SEED) and every word (``width`` 1) of every item row."""

    def grams(batches):
        for batch in batches:
            for row, item, own in zip(batch.column("row").to_pylist(), batch.column("item_id").to_pylist(), batch.column("words"), strict=True):
                h = own.values.to_numpy().view(np.uint64)
                g, at = shingle_hashes(np.zeros(len(h), np.int64), h, SEED)
                n, pos = len(g) + len(h), np.concatenate([at, np.arange(len(h))])
                width, seed = np.repeat([SEED, 1], [len(g), len(h)]), np.concatenate([g, h]).view(np.int64)
                columns = [pa.array([row] * n, pa.int64()), pa.array([item] * n, pa.int64()), pa.array(width, pa.int32()), pa.array(pos, pa.int32()), pa.array(seed)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "item_id", "width", "pos", "seed"])

    return words.select("row", "item_id", "words").mapInArrow(grams, "row bigint, item_id bigint, width int, pos int, seed bigint")


def needed(n_words, min_score: float):
    """Words that an alignment with an item of ``n_words`` has to match to pass (a number or an array)."""
    return np.minimum(np.ceil(min_score * n_words - 1e-9), EXCERPT)


def bound(seed: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a seed together with a word."""
    return mix(seed * np.uint64(0xD6E8FEB86659FD93) + word)


class SeedFilter:
    """Membership of hashes: a bit set of fixed size, and the exact sorted hashes where their number is bounded."""

    def __init__(self, seeds: DataFrame, n: int):
        bits = np.zeros(FILTER_BITS, dtype=bool)
        slots = seeds.select(F.col("seed").bitwiseAND(F.lit(FILTER_BITS - 1)).cast("int").alias("slot")).distinct()
        bits[slots.toPandas()["slot"].to_numpy(dtype=np.int64)] = True  # at most FILTER_BITS rows, whatever the benchmark
        self.bits = np.packbits(bits)
        self.exact = np.sort(seeds.select("seed").distinct().toPandas()["seed"].to_numpy(dtype=np.int64).view(np.uint64)) if n <= MAX_EXACT_SEEDS else None

    def positions(self, g: np.ndarray) -> np.ndarray:
        slot = (g & np.uint64(FILTER_BITS - 1)).astype(np.int64)
        at = np.flatnonzero((self.bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1)
        if self.exact is not None and len(at):
            found = np.searchsorted(self.exact, g[at])
            at = at[self.exact[np.minimum(found, len(self.exact) - 1)] == g[at]]
        return at


def corpus_counts(docs: DataFrame, held, text: str) -> DataFrame:
    """(seed, n): occurrences of the filtered n-grams and words over all documents."""

    def count(batches):
        for batch in batches:
            found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
            for doc, h, _, _, fresh in word_blocks(batch.column("text"), overlap=SEED - 1, letters=True):
                g, _at = shingle_hashes(doc, h, SEED)
                own = h[fresh:]
                found += [np.unique(x[held.value.positions(x)], return_counts=True) for x in (g, own)]
            seed, at = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
            n = np.zeros(len(seed), np.int64)
            np.add.at(n, at, np.concatenate([x for _, x in found]))
            yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(n)], ["seed", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(count, "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("n"))


def item_keys(grams: DataFrame, counts: DataFrame, min_score: float) -> DataFrame:
    """(item_id, key, seed, word): every n-gram of every item, the common ones bound to each of the item's rare words.

    ``seed`` and ``word`` are null where the n-gram is the key itself.  The rare words are the item's rarest ones that
    together cover so many of its words that an alignment without them cannot pass.  Items are short next to memory.
    """

    def cut(batches):
        for batch in batches:
            out: list[tuple] = [(np.zeros(0, np.int64),) + (np.zeros(0, np.uint64),) * 3 + (np.zeros(0, bool),)]
            for item, own in zip(batch.column("item_id").to_pylist(), batch.column("grams"), strict=True):
                if item is None:
                    continue
                width, seed, n, items = (own.values.field(k).to_numpy() for k in ("width", "seed", "n", "own"))
                seed = seed.view(np.uint64)
                gram, at, _ = np.unique(seed[width == SEED], return_index=True, return_counts=True)
                often, shared = n[width == SEED], items[width == SEED][at]
                middle, often = np.sort(often)[(len(often) - 1) // 2], often[at]
                common = (often > FEW) & ((often > FAR * middle) | (shared > FEW))
                keys, none = gram[~common], np.zeros((~common).sum(), np.uint64)
                out.append((np.full(len(keys), item), keys, none, none, np.ones(len(keys), bool)))
                if common.any():
                    word, at, times = np.unique(seed[width == 1], return_index=True, return_counts=True)
                    order = np.argsort(n[width == 1][at], kind="stable")
                    total = int(times.sum())
                    least = total - int(needed(total, min_score)) + 1
                    rare = word[order[: int(np.searchsorted(np.cumsum(times[order]), least)) + 1]]
                    a, b = np.repeat(gram[common], len(rare)), np.tile(rare, common.sum())
                    out.append((np.full(len(a), item), bound(a, b), a, b, np.zeros(len(a), bool)))
            item, key, seed, word, alone = (np.concatenate([x[k] for x in out]) for k in range(5))
            halves = [pa.array(x.view(np.int64), mask=alone) for x in (seed, word)]
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(key.view(np.int64)), *halves], ["item_id", "key", "seed", "word"])

    own = grams.groupBy("seed").agg(F.count("*").alias("own"))
    rated = grams.join(own, "seed").join(counts, "seed", "left").withColumn("n", F.coalesce("n", F.lit(0)) + F.col("own"))
    rows = rated.groupBy("row", "item_id").agg(F.sort_array(F.collect_list(F.struct("width", "pos", "seed", "n", "own"))).alias("grams"))
    return rows.select("item_id", "grams").mapInArrow(cut, "item_id bigint, key bigint, seed bigint, word bigint")


def bound_hits(doc: np.ndarray, h: np.ndarray, g: np.ndarray, at: np.ndarray, keys: SeedFilter, halves: SeedFilter, reach: int):
    """Yield (position, key) arrays of common seeds with a rare word of the same item within ``reach``."""
    seeds = halves.positions(g)
    if not len(seeds):
        return
    words, pos = halves.positions(h), at[seeds]
    lo = np.searchsorted(words, np.maximum(pos - reach, np.searchsorted(doc, doc[pos], side="left")))
    hi = np.searchsorted(words, np.minimum(pos + SEED + reach, np.searchsorted(doc, doc[pos], side="right")))
    total, i = np.concatenate([[0], np.cumsum(hi - lo)]), 0
    while i < len(pos):
        j = max(i + 1, int(np.searchsorted(total, total[i] + CELLS_AT_ONCE, side="right")) - 1)
        n = hi[i:j] - lo[i:j]
        one = np.repeat(np.arange(i, j), n)
        word = words[np.arange(n.sum()) - np.repeat(total[i:j] - total[i], n) + lo[one]]
        key = bound(g[seeds[one]], h[word])
        hit = keys.positions(key)
        yield pos[one[hit]], key[hit]
        i = j


def cut_passages(texts: pa.Array, keys: SeedFilter, halves: SeedFilter, reach: int):
    """Yield (row, words, first, last, keys) of the passages around keys of each text, as word hashes with the byte range of each word."""
    for doc, h, s, e, _ in word_blocks(texts, overlap=2 * reach, letters=True):
        g, at = shingle_hashes(doc, h, SEED)
        hit = keys.positions(g)
        hits = [(at[hit], g[hit]), *bound_hits(doc, h, g, at, keys, halves, reach)]
        pos, held = (np.concatenate([x[k] for x in hits]) for k in (0, 1))
        if not len(pos):
            continue
        order = np.argsort(pos, kind="stable")
        pos, held = pos[order], held[order]
        limits = np.searchsorted(doc, doc[pos], side="left"), np.searchsorted(doc, doc[pos], side="right")
        new = np.flatnonzero((np.diff(pos) > reach) | (np.diff(doc[pos]) != 0)) + 1
        for lo, hi in zip(np.append(0, new).tolist(), np.append(new, len(pos)).tolist(), strict=True):
            a, b = max(limits[0][lo], pos[lo] - reach), min(limits[1][hi - 1], pos[hi - 1] + SEED + reach)
            yield int(doc[pos[lo]]), *(x[a:b].copy() for x in (h, s, e)), np.unique(held[lo:hi])  # copies: a view would hold its whole block


def passages(docs: DataFrame, held, reach: int, key: str, text: str) -> DataFrame:
    """(doc_id, words, first, last, keys): ``cut_passages`` of all documents."""

    def cut(batches):
        for batch in batches:
            keys, halves = held.value
            out = [(row, h.view(np.int64), s, e, k.view(np.int64)) for row, h, s, e, k in cut_passages(batch.column("text"), keys, halves, reach)]
            big = pa.list_(pa.int64())
            columns = [batch.column("doc_id").take(pa.array([x[0] for x in out], pa.int64())), *(pa.array([x[k] for x in out], big) for k in (1, 2, 3, 4))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "words", "first", "last", "keys"])

    wanted = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return wanted.mapInArrow(cut, "doc_id bigint, words array<bigint>, first array<bigint>, last array<bigint>, keys array<bigint>")


class ItemTable:
    """The items of a bounded benchmark: which items a key belongs to, and their words."""

    def __init__(self, keys: DataFrame, words: DataFrame):
        pairs = keys.where("item_id is not null").select("key", "item_id").distinct().toArrow()
        key, item = (pairs.column(c).to_numpy() for c in ("key", "item_id"))
        order = np.lexsort((item, key))
        self.keys, self.items = key[order], item[order]
        rows = words.where("item_id is not null").select("item_id", "words").toArrow()
        self.words: dict[int, list[np.ndarray]] = {}
        for i, own in zip(rows.column("item_id").to_pylist(), rows.column("words"), strict=True):
            self.words.setdefault(i, []).append(own.values.to_numpy().view(np.uint64).copy())

    def of(self, keys: np.ndarray) -> list[int]:
        lo, hi = (np.searchsorted(self.keys, keys.view(np.int64), side=side) for side in ("left", "right"))
        return np.unique(np.concatenate([self.items[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)] or [self.items[:0]])).tolist()


def scores_in_place(docs: DataFrame, held, reach: int, key: str, text: str, min_score: float) -> DataFrame:
    """Passages cut and aligned in one pass, for a benchmark that is broadcast: no passage leaves its task."""

    def run(batches):
        for batch in batches:
            keys, halves, table = held.value
            found: list[tuple] = []
            for row, h, s, e, own in cut_passages(batch.column("text"), keys, halves, reach):
                found += [(row, item, words, h, s, e) for item in table.of(own) for words in table.words[item]]
                if len(found) >= PAIRS_AT_ONCE:
                    yield _scored_batch(batch, found, min_score)
                    found = []
            yield _scored_batch(batch, found, min_score)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PAIRS)


def _scored_batch(batch: pa.RecordBatch, found: list[tuple], min_score: float) -> pa.RecordBatch:
    score, lo, hi, passed = scored([x[2] for x in found], [x[3] for x in found], [x[4] for x in found], [x[5] for x in found], min_score)
    ids = batch.column("doc_id").take(pa.array([x[0] for x in found], pa.int64()))
    made = pa.RecordBatch.from_arrays([ids, pa.array([x[1] for x in found], pa.int64()), pa.array(score), pa.array(lo), pa.array(hi)], PAIR_NAMES)
    return made.filter(pa.array(passed))


def align(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment score of each pair, and the first and last (exclusive) text word of it.

    All pairs advance together by item word.  Cells hold ``score * 2**32 + start``, so the start of the best path
    travels with its score, and gaps within a row are one running maximum.
    """
    n, m, w = len(items), max(map(len, items)), max(map(len, texts))
    a, b = np.zeros((n, m), dtype=np.uint64), np.full((n, w), 1, dtype=np.uint64)
    for i, (x, y) in enumerate(zip(items, texts, strict=True)):
        a[i, : len(x)], b[i, : len(y)] = x, y
    unit = np.int64(1) << np.int64(32)
    start = np.arange(w + 1, dtype=np.int64)
    ramp = start * (-GAP * unit)
    row = np.broadcast_to(start, (n, w + 1)).copy()
    best, best_end = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i in range(m):
        real = a[:, i : i + 1] != 0
        step = np.where((b == a[:, i : i + 1]) & real, MATCH * unit, MISMATCH * unit)
        new = np.empty_like(row)
        new[:, 0] = 0
        new[:, 1:] = np.maximum(np.maximum(row[:, :-1] + step, row[:, 1:] + GAP * unit), start[1:])
        row = np.maximum.accumulate(new + ramp, axis=1) - ramp
        at = row.argmax(1)
        top = row[np.arange(n), at]
        better = (top >> np.int64(32)) > (best >> np.int64(32))
        best, best_end = np.where(better, top, best), np.where(better, at, best_end)
    return best >> np.int64(32), best & np.int64(0xFFFFFFFF), best_end


def scored(items: list[np.ndarray], texts: list[np.ndarray], first: list[np.ndarray], last: list[np.ndarray], min_score: float):
    """Score, byte range and whether it passes of each (item, passage) pair; pairs that share too few words are not aligned."""
    n = len(items)
    score, lo, hi, passed = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, dtype=bool)
    if not n:
        return score, lo, hi, passed
    sizes, length = np.array([len(x) for x in items]), np.array([len(x) for x in texts])
    row = np.repeat(np.arange(n), sizes)
    # Words of both sides under the number of their pair: what an alignment could match at most.
    tag = lambda words, of: mix(np.concatenate(words) + of.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    shared = np.bincount(row, weights=np.isin(tag(items, row), tag(texts, np.repeat(np.arange(n), length))), minlength=n)
    able = np.flatnonzero(shared >= needed(sizes, min_score))
    order, at = able[np.argsort(length[able], kind="stable")], 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * length[order[end]] <= CELLS_AT_ONCE:
            end += 1
        some = order[at:end].tolist()
        for i, p, f, e in zip(some, *align([items[i] for i in some], [texts[i] for i in some]), strict=True):
            score[i] = p / (MATCH * sizes[i])
            passed[i] = p >= min(min_score * MATCH * sizes[i] - 1e-9, MATCH * EXCERPT)
            if e > f:
                lo[i], hi[i] = first[i][f], last[i][e - 1]
        at = end
    return score, lo, hi, passed


def score_pairs(pairs: DataFrame, min_score: float) -> DataFrame:
    """(doc_id, item_id, score, start_byte, end_byte) of the (doc_id, item_id, words, first, last, item_words) rows that pass."""

    def run(batches):
        for batch in batches:
            lists = {c: [x.values.to_numpy() for x in batch.column(c)] for c in ("item_words", "words", "first", "last")}
            hashes = [[x.view(np.uint64) for x in lists[c]] for c in ("item_words", "words")]
            score, lo, hi, passed = scored(*hashes, lists["first"], lists["last"], min_score)
            made = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("item_id"), pa.array(score), pa.array(lo), pa.array(hi)], PAIR_NAMES)
            yield made.filter(pa.array(passed))

    return pairs.select("doc_id", "item_id", "words", "first", "last", "item_words").mapInArrow(run, PAIRS)


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", min_score: float = 0.5) -> DataFrame:
    """(doc_id, item_id, score, start_byte, end_byte) of every document that holds a copy of an item, edited or not."""
    context = docs.sparkSession.sparkContext
    words = checkpointed(item_words(items, item, item_text).withColumn("row", F.monotonically_increasing_id()))
    seen = words.agg(F.coalesce(F.max(F.size("words")), F.lit(0)).alias("longest"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("words")).first()
    grams = checkpointed(item_grams(words))
    counts = corpus_counts(docs, context.broadcast(SeedFilter(grams, 2 * seen["words"])), text)
    keys = checkpointed(item_keys(grams, counts, min_score))
    n_keys = keys.count()
    halves = keys.where("seed is not null").select(F.explode(F.array("seed", "word")).alias("seed")).distinct()
    filters = SeedFilter(keys.select(F.col("key").alias("seed")), n_keys), SeedFilter(halves, halves.count())
    # All words of an item and as many gaps as a passing score allows.
    reach = seen["longest"] + math.ceil(MATCH * seen["longest"] * (1 - min(max(min_score, 0), 1))) + SEED
    if max(seen["words"], n_keys) <= MAX_BROADCAST_WORDS:
        passing = scores_in_place(docs, context.broadcast((*filters, ItemTable(keys, words))), reach, key, text, min_score)
    else:
        found = checkpointed(passages(docs, context.broadcast(filters), reach, key, text).withColumn("passage", F.monotonically_increasing_id()))
        pairs = found.select("passage", F.explode("keys").alias("key")).join(keys.select("item_id", "key"), "key").select("passage", "item_id").distinct()
        passing = score_pairs(found.drop("keys").join(pairs, "passage").join(words.select("item_id", F.col("words").alias("item_words")), "item_id"), min_score)
    best = passing.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("score", "start_byte", "end_byte"), F.struct("score", -F.col("start_byte"), -F.col("end_byte"))).alias("best"))
    return best.select("doc_id", "item_id", F.round("best.score", 6).alias("score"), "best.start_byte", "best.end_byte")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contaminated(docs, items)


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a copy of an item.

    Rows are told apart by a hash of key and text, so rows that share a key, or have none, are judged each by itself.  The
    marks of the rows to drop are broadcast where they are few enough; then texts are not moved.
    """
    mark = unused(docs, "mark")
    marked = docs.withColumn(mark, F.xxhash64(F.col(key), F.col(text)))
    hit = checkpointed(contaminated(marked, items, mark, text).select(F.col("doc_id").alias(mark)).distinct())
    hit = F.broadcast(hit) if hit.count() <= MAX_BROADCAST_MARKS else hit
    return marked.join(hit, mark, "left_anti").select(*docs.columns)
