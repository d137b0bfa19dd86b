"""Ranked lexical search: compressed postings in shards, a document-at-a-time heap merge, one global merge.

1. ``build_index`` cuts documents into terms and writes shards of about ``SHARD_BYTES`` of text.  A shard numbers its documents by
   document id and holds one row for each of its terms: gaps of document numbers and occurrences, both as variable-length bytes; and one row of
   its document ids and lengths.  All terms of all documents are indexed; counts are exact, by term text, not by hash.
2. ``search`` takes from the index the postings of the items' terms, adds up document frequencies, and gathers each shard's postings in
   one task.  A shard is of bounded size, so no term, however common, makes a task large.
3. In a shard each item's posting lists stand in a heap by their next document.  The merge takes the least one, opens a window of
   ``WINDOW`` documents there, pops every list that has postings in it, adds their parts to the documents of the window and pushes the
   lists back at their next document; ranges without postings are never visited.  Documents of a window that beat the worst of the
   item's bounded result heap (score, then smaller document number) enter it.
4. Each task's best rows of an item are cut to ``k`` before they are shuffled by item, and there again (a window function's
   group limit): the global merge.

Items are taken in blocks of at most ``MAX_ITEM_TERMS`` (item, term) pairs (a single larger item is a block of its own), which bounds what is
broadcast; every block meets all shards.

Defined results: null and empty texts, and texts without a term, are in no count and are never found.  Long texts are counted in blocks.
Rows that share an id are documents of their own and keep separate ranks.  A null id ranks after all others of its score.  Items that share an id (or
have none) are one item with the terms of all; an item without terms has no rows.  Empty tables give empty results.  Extra columns of either table are
not read.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medspan.llm.common import buffers, checkpointed

TOP = 10
SHARD_BYTES = 32 << 20
TEXT_BLOCK = 1 << 20
WINDOW = 8192
#: (item, term) pairs of a block of items, and terms that are sent to the postings by broadcast; more meet them by a shuffle.
MAX_ITEM_TERMS, MAX_BROADCAST_TERMS = 1_000_000, 200_000
#: Bytes of terms as themselves, A-Z lower-cased, all others as spaces.
_CUT = bytes((x + 32 if 65 <= x <= 90 else x) if x >= 128 or chr(x).isalnum() else 32 for x in range(256))
INDEX = "shard bigint, term string, n bigint, total bigint, docs binary, counts binary"
HITS = "item_id bigint, doc_id bigint, score bigint"
_NO_FIELDS = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("total", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary())])


def term_counts(text: bytes) -> Counter:
    """Terms of a UTF-8 text with their occurrences."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        end = min(at + TEXT_BLOCK, len(text))
        while end < len(text) and _CUT[text[end]] != 32:
            end += 1
        found.update(text[at:end].translate(_CUT).split())
        at = end
    return found


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned integers as bytes of seven bits, low ones first, the last of each under 128; and the end of each."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), dtype=np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1) << np.uint64(7 * k)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        own = np.flatnonzero(size > k)
        digit = (values[own] >> np.uint64(7 * k)) & np.uint64(127)
        out[(ends - size)[own] + k] = digit.astype(np.uint8) | ((size[own] > k + 1).astype(np.uint8) << 7)
    return out, ends


def unpacked(raw: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(raw < 128)
    if not len(ends):
        return np.zeros(0, dtype=np.uint64)
    starts = np.append(0, ends[:-1] + 1)
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


class ShardBuilder:
    """Collects documents and turns them into the rows of one shard."""

    def __init__(self):
        self.vocabulary: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.terms: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        found = term_counts(text)
        self.bytes += len(text)
        if found:
            self.ids.append(doc_id)
            self.lengths.append(found.total())
            self.terms.append(np.fromiter(map(self.vocabulary.__getitem__, found), np.int64, len(found)))
            self.counts.append(np.fromiter(found.values(), np.int64, len(found)))

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        """The document row, then a row for each term in byte order."""
        if not self.ids:
            return
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        known = np.array([self.ids[i] for i in order if self.ids[i] is not None], dtype=np.int64)
        lengths = np.array(self.lengths, dtype=np.int64)
        ids = known.view(np.uint64)
        gaps = np.append(ids[:1], ids[1:] - ids[:-1])  # modulo 2**64: the first is the id itself
        cells = [pa.array(x) for x in ([shard], [None], [len(order)], [int(lengths.sum())], [packed(gaps)[0].tobytes()], [packed(lengths[order])[0].tobytes()])]
        yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(cells, _NO_FIELDS.types, strict=True)], schema=_NO_FIELDS)
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.arange(len(order))
        words = sorted(self.vocabulary)
        rank = np.empty(len(words), dtype=np.int64)
        rank[[self.vocabulary[w] for w in words]] = np.arange(len(words))
        doc = np.repeat(number, [len(x) for x in self.terms])
        term, times = rank[np.concatenate(self.terms)], np.concatenate(self.counts)
        sort = np.lexsort((doc, term))
        doc, term, times = doc[sort], term[sort], times[sort]
        starts = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        stops = np.append(starts[1:], len(term))
        gap = np.append(0, np.diff(doc))
        gap[starts] = doc[starts]
        columns = [_cells(*packed(x), stops) for x in (gap, times)]
        total = np.add.reduceat(times, starts)
        n = len(words)
        made = pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array([w.decode() for w in words], pa.string()), pa.array(stops - starts), pa.array(total), *columns], schema=_NO_FIELDS)
        for at in range(0, n, 1 << 15):
            yield made.slice(at, 1 << 15)


def _cells(raw: np.ndarray, ends: np.ndarray, stops: np.ndarray) -> pa.Array:
    """Packed values as one binary cell for each group of them."""
    offsets = np.append(0, ends[stops - 1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(stops), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``INDEX`` rows of all documents; a row without a term holds a shard's documents.  It can be stored and searched again."""

    def build(batches):
        shard, made = ShardBuilder(), 0
        task = TaskContext.get().partitionId() << 32
        for batch in batches:
            raw, off = buffers(batch.column("text"))
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                shard.add(doc_id, raw[a:b].tobytes())
                if shard.bytes >= shard_bytes:
                    yield from shard.rows(task + made)
                    shard, made = ShardBuilder(), made + 1
        yield from shard.rows(task + made)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(build, INDEX)


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item_id, term), each pair once."""

    def cut(batches):
        for batch in batches:
            raw, off = buffers(batch.column("text"))
            found = [list(term_counts(raw[a:b].tobytes())) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            ids = batch.column("item_id").take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found])))
            yield pa.RecordBatch.from_arrays([ids, pa.array([t.decode() for x in found for t in x], pa.string())], ["item_id", "term"])

    return items.select(F.col(key).cast("long").alias("item_id"), F.col(text).alias("text")).mapInArrow(cut, "item_id bigint, term string").distinct()


def weight(n_docs: Column, df: Column) -> Column:
    return F.floor(1000 * F.log((2 * n_docs + 2).cast("double") / (2 * df + 1)))


@dataclass
class Items:
    """A block of items: term numbers by term text, the weight of each, and each item's term numbers."""

    numbers: dict[str, int]
    weights: np.ndarray
    ids: list[int | None]
    terms: list[np.ndarray]
    n_docs: int
    n_terms: int


def merged(lists: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[int, int]]:
    """(score, document number) of the ``k`` best documents of (document numbers, parts) lists, in no order."""
    cursors = [(int(docs[0]), i, 0) for i, (docs, _) in enumerate(lists) if len(docs)]
    heapq.heapify(cursors)
    best: list[tuple[int, int]] = []  # the worst first: least score, then largest document number
    while cursors:
        lo = cursors[0][0]
        hi = lo + WINDOW
        scores = np.zeros(WINDOW, dtype=np.int64)
        while cursors and cursors[0][0] < hi:
            _, i, at = cursors[0]
            docs, parts = lists[i]
            end = at + int(np.searchsorted(docs[at:], hi))
            scores[docs[at:end] - lo] += parts[at:end]
            if end < len(docs):
                heapq.heapreplace(cursors, (int(docs[end]), i, end))
            else:
                heapq.heappop(cursors)
        found = np.flatnonzero(scores > (best[0][0] if len(best) == k else 0))
        if len(found) > k:
            found = found[scores[found] >= np.partition(scores[found], -k)[-k]]
        for o in found.tolist():
            hit = (int(scores[o]), -(lo + o))
            if len(best) < k:
                heapq.heappush(best, hit)
            elif hit > best[0]:
                heapq.heapreplace(best, hit)
    return [(score, -doc) for score, doc in best]


def shard_hits(doc_row: tuple, terms: list[str], sizes: list[int], docs: list[bytes], counts: list[bytes], items: Items, k: int) -> Iterator[tuple]:
    """(item_id, doc_id, score) of a shard's best documents for each item; ``terms`` are those of the items that the shard holds."""
    n, ids, lengths = doc_row
    known = np.cumsum(unpacked(np.frombuffer(ids, np.uint8)), dtype=np.uint64).view(np.int64).tolist()
    known += [None] * (n - len(known))
    lengths = unpacked(np.frombuffer(lengths, np.uint8)).astype(np.int64)
    wide = int(lengths.max()) * 90 * items.n_docs >= 1 << 63
    m = 10 + (90 * (lengths.astype(object) if wide else lengths) * items.n_docs // items.n_terms).astype(np.int64)
    gap, times = (unpacked(np.frombuffer(b"".join(x), np.uint8)).astype(np.int64) for x in (docs, counts))
    size = np.array(sizes)
    starts = np.cumsum(size) - size
    doc = np.cumsum(gap)
    doc -= np.repeat(doc[starts] - gap[starts], size)
    number = np.array([items.numbers[t] for t in terms])
    parts = np.repeat(items.weights[number], size) * (1_000_000_000 * times // (1000 * times + 8 * m[doc]))
    where = {t: (a, b) for t, a, b in zip(number.tolist(), starts.tolist(), (starts + size).tolist(), strict=True)}
    for item_id, own in zip(items.ids, items.terms, strict=True):
        held = [where[t] for t in own.tolist() if t in where]
        for score, at in merged([(doc[a:b], parts[a:b]) for a, b in held], k):
            yield item_id, known[at], score


def _block(index: DataFrame, pairs: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``HITS`` of one block of items: the best of each task, then the best of all."""
    context = index.sparkSession.sparkContext
    terms = pairs.select("term").distinct()
    postings = index.where("term is not null").join(F.broadcast(terms) if terms.count() <= MAX_BROADCAST_TERMS else terms, "term").select(*index.columns)
    postings = checkpointed(postings)
    rated = postings.groupBy("term").agg(F.sum("n").alias("df")).select("term", weight(F.lit(n_docs), F.col("df")).alias("w")).toArrow()  # as many rows as the block has terms
    numbers = {t: i for i, t in enumerate(rated.column("term").to_pylist())}
    own: dict[int | None, list[int]] = {}
    held = pairs.toArrow()
    for item, term in zip(held.column("item_id").to_pylist(), held.column("term").to_pylist(), strict=True):
        if term in numbers:
            own.setdefault(item, []).append(numbers[term])
    shared = context.broadcast(Items(numbers, rated.column("w").to_numpy().astype(np.int64), list(own), [np.sort(np.array(x)) for x in own.values()], n_docs, n_terms))

    def run(batches):
        items, shard, doc_row = shared.value, None, None
        held: tuple[list, ...] = ([], [], [], [])

        def answered():
            found = list(shard_hits(doc_row, *held, items, k)) if held[0] else []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.int64()) for i in range(3)], ["item_id", "doc_id", "score"])

        for batch in batches:
            for own, term, n, docs, counts in zip(*(batch.column(c).to_pylist() for c in ("shard", "term", "n", "docs", "counts")), strict=True):
                if own != shard:
                    if shard is not None:
                        yield answered()
                    shard, held = own, ([], [], [], [])
                if term is None:
                    doc_row = n, docs, counts
                else:
                    for x, y in zip(held, (term, n, docs, counts), strict=True):
                        x.append(y)
        if shard is not None:
            yield answered()

    dealt = postings.unionByName(index.where("term is null")).select("shard", "term", "n", "docs", "counts")
    hits = dealt.repartition("shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first()).mapInArrow(run, HITS)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: DataFrame, items: DataFrame, k: int = TOP, key: str = "item_id", text: str = "text", max_item_terms: int = MAX_ITEM_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item.  ``index`` is stored, or cut from its lineage."""
    seen = index.where("term is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("docs"), F.coalesce(F.sum("total"), F.lit(0)).alias("terms")).first()
    pairs = checkpointed(item_terms(items, key, text))
    blocks = max(1, -(-pairs.count() // max_item_terms))
    some = lambda b: pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else pairs
    hits = [_block(index, some(b), seen["docs"], seen["terms"], k) for b in range(blocks)]
    return reduce(DataFrame.unionByName, hits).select(F.col("item_id").alias(key), "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = checkpointed(build_index(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = f"""
WITH cut AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS terms FROM documents),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(terms) AS term FROM cut) GROUP BY rid, term),
docs AS (SELECT rid, doc_id, len(terms) AS n FROM cut WHERE len(terms) > 0),
seen AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM benchmark),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), seen),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM items JOIN weights USING (term) JOIN tf USING (term) JOIN docs USING (rid), seen GROUP BY item_id, rid, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= {TOP}
"""
