"""N-gram Jaccard join with set-relation skipping, and the components of its links.

Documents are sets of ``SHINGLE``-word shingles; two sets link when ``PERCENT`` * union <= 100 * intersection.  Equal sets are one set with
one ``mark``, however many documents hold it.

1. ``prints``: one pass over the texts gives each document's mark and size and the signatures of its set.  Sets of like size fall into a
   class; linked sets of a class (or of it and the next) differ in at most ``allowed`` shingles, so of more segments of the
   hash range than that, one at least holds the same shingles in both and gives both the same signature.  Each task sends a signature once and
   links its own sets that share it, so a signature arrives at most once from each task, however many sets hold it.
2. Sets that share a signature, directly or through others, form a cell: every link lies within one.  Only sets of cells
   are read again.  A cell of more than ``CELL`` shingles is cut by set size into pieces, and each two pieces whose sizes can link are a cell
   of their own (equal sizes by a hash): exact, and no task holds more than some pieces.
3. ``joined`` searches a cell, by the relations of its sets:
   * the index lists of a shingle are sorted by blocks of the position at which sets hold it, then by size.  Position and size bound the
     overlap of a pair, so for each list and block only one range of sizes is read, and blocks whose range is empty are skipped;
   * once a set's answers are computed, at a threshold relaxed by a slack, those of every set that differs from it by no more than the slack
     are derived: its overlaps change only by the lists of the shingles in which the two sets differ.  A set whose answers could
     only repeat known connections is not looked at.
4. The links found span each component of a cell; ``components`` joins them over all cells.

Shingles and sets are told apart by 64-bit hashes: of n sets, two different ones share a mark with a probability of n**2 / 2**65.

Defined results: null texts and texts without a word have the empty set (size 0), linked with nothing, also not with each other; their
component is their own id.  Fewer words than a shingle are one shingle, which no longer text holds.  Long texts are read in blocks, whole.  A component's id is its smallest
non-null id, null if all are (2**63 - 1 counts as null).  Repeated rows and ids are documents of their own.  Empty tables give empty results.  The result holds
key, ``n_shingles`` and ``component_id``, whatever the input's columns are called.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medspan.llm.common import checkpointed, mix, shingle_hashes, word_blocks
from medspan.llm.op10_simhash import components, merge_labels

SHINGLE, PERCENT = 3, 90
#: Sizes of a class lie within this ratio; segments beyond those that differences can touch.
RATIO, SPARE = 1.2, 1
#: Shingles of a piece of a large cell; small cells are searched together up to as many.
CELL = 1 << 20
#: Signatures that a task holds before it sends them.
SIGNATURES_AT_ONCE = 1 << 22
#: Chosen rows that are broadcast to the second pass over the texts; more meet it by a shuffle.
MAX_BROADCAST = 1_000_000
NO_ID = (1 << 63) - 1
POSITIONS = 8
_SEED = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)
PRINTS = "kind int, id bigint, row bigint, n bigint, a bigint, b bigint"
DOCUMENT, SIGNATURE, LINK = 0, 1, 2


def shingle_sets(texts: pa.Array):
    """Yield (rows, offsets, values): the distinct shingle hashes of some texts, sorted in each; texts without a word are left out."""
    row, words, grams = -1, [], []

    def close():
        held = np.concatenate(words)
        own = np.concatenate(grams) if grams and sum(map(len, grams)) else _whole(held)
        values = np.unique(own)
        return np.array([row]), np.array([0, len(values)]), values

    for doc, h, _, _, fresh in word_blocks(texts, overlap=SHINGLE - 1):
        if not len(doc):
            continue
        g, at = shingle_hashes(doc, h, SHINGLE)
        if doc[0] == doc[-1]:  # one text, perhaps a part of it
            if doc[0] != row:
                if row >= 0:
                    yield close()
                row, words, grams = int(doc[0]), [], []
            words.append(h[fresh:] if sum(map(len, words)) < SHINGLE else h[:0])
            grams.append(g)
            continue
        if row >= 0:
            yield close()
        row, words, grams = -1, [], []
        of = doc[at]
        new = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        size = np.diff(np.append(new, len(doc)))
        short = np.flatnonzero(size < SHINGLE)
        of = np.concatenate([of, doc[new[short]]])
        g = np.concatenate([g, *(_whole(h[new[i] : new[i] + size[i]]) for i in short.tolist())])
        order = np.lexsort((g, of))
        of, g = of[order], g[order]
        keep = np.append(True, (of[1:] != of[:-1]) | (g[1:] != g[:-1]))
        of, g = of[keep], g[keep]
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        yield of[first], np.append(first, len(of)), g
    if row >= 0:
        yield close()


def _whole(words: np.ndarray) -> np.ndarray:
    """The one shingle of a text of fewer words than a shingle has."""
    total = np.array([len(words)], dtype=np.uint64)
    for x in words:
        total = mix(total * _SEED + x)
    return total


@lru_cache(maxsize=8)
def classes(largest: int) -> tuple[np.ndarray, np.ndarray]:
    """(first sizes of the classes, segments of each).  Sets under the first size link only with equal ones."""
    at, lows, segments = -(-PERCENT // (100 - PERCENT)), [], []
    while True:
        high = max(at, int(at * RATIO))
        lows.append(at)
        segments.append(allowed(high) + 1 + SPARE)
        if at > largest:
            return np.array(lows), np.array(segments)
        at = high + 1


def allowed(size: int | np.ndarray):
    """The most shingles in which a set of ``size`` and a linked one that is no smaller can differ."""
    return size * (100 - PERCENT) // PERCENT


def largest_partner(size: np.ndarray) -> np.ndarray:
    return size * 100 // PERCENT


def signatures(offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature) of sets of sorted hashes: one for each segment that holds a shingle.

    Linked sets agree on ``1 + SPARE`` segments at least; up to ``SPARE`` of these may be empty in both, so empty segments
    give a signature only in sets that have more of them.
    """
    size = np.diff(offsets)
    lows, segments = classes(int(size.max()) if len(size) else 0)
    own = np.searchsorted(lows, size, side="right") - 1
    highs = np.append(lows[1:] - 1, 0)
    each = np.flatnonzero(own >= 0)
    below = each[(own[each] > 0) & (size[each] <= largest_partner(highs[own[each] - 1]))]
    rows, kind = np.concatenate([each, below]), np.concatenate([own[each], own[below] - 1])
    if not len(rows):
        return rows, np.zeros(0, np.uint64)
    length, m = size[rows], segments[kind]
    starts = np.cumsum(length) - length
    at = np.arange(int(length.sum())) - np.repeat(starts - offsets[rows], length)
    g = values[at]
    segment = ((g >> np.uint64(32)) * np.repeat(m, length).astype(np.uint64)) >> np.uint64(32)
    entry = np.repeat(np.arange(len(rows)), length)
    first = np.flatnonzero(np.append(True, (segment[1:] != segment[:-1]) | (entry[1:] != entry[:-1])))
    total = np.add.reduceat(mix(g ^ _ODD), first)
    tag = lambda k, s: mix((k.astype(np.uint64) << np.uint64(40)) + s)
    of, made = entry[first], mix(total + tag(kind[entry[first]], segment[first]) * _SEED)
    gaps = np.flatnonzero(m - np.bincount(of, minlength=len(rows)) > SPARE)
    more = [np.setdiff1d(np.arange(m[e], dtype=np.uint64), segment[first][of == e]) for e in gaps.tolist()]
    empty = [mix(tag(np.full(len(s), kind[e]), s) * _SEED) for e, s in zip(gaps.tolist(), more, strict=True)]
    of = np.concatenate([of, np.repeat(gaps, [len(s) for s in more])])
    return rows[of], np.concatenate([made, *empty])


def marks_of(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    if len(offsets) < 2:
        return np.zeros(0, np.int64)
    return mix(np.add.reduceat(mix(values * _SEED), offsets[:-1]) + np.diff(offsets).astype(np.uint64) * _ODD).view(np.int64)


def _batch(kind: int, length: int, **columns) -> pa.RecordBatch:
    held = {"kind": pa.array(np.full(length, kind, np.int32))} | {c: pa.array(x) if isinstance(x, np.ndarray) else x for c, x in columns.items()}
    names = ["kind", "id", "row", "n", "a", "b"]
    return pa.RecordBatch.from_arrays([held.get(c, pa.nulls(length, pa.int64())) for c in names], names)


def _combined(signature: np.ndarray, mark: np.ndarray):
    """Each signature once with the least mark that holds it, and links of that mark with the others."""
    order = np.lexsort((mark, signature))
    signature, mark = signature[order], mark[order]
    new = np.append(True, signature[1:] != signature[:-1])
    first = np.flatnonzero(new)
    yield _batch(SIGNATURE, len(first), a=signature[first].view(np.int64), b=mark[first])
    least = np.repeat(mark[first], np.diff(np.append(first, len(mark))))
    far = np.flatnonzero(least != mark)
    links = np.unique(np.stack([least[far], mark[far]], axis=1), axis=0) if len(far) else np.zeros((0, 2), np.int64)
    yield _batch(LINK, len(links), a=np.ascontiguousarray(links[:, 0]), b=np.ascontiguousarray(links[:, 1]))


def prints(docs: DataFrame) -> DataFrame:
    """``PRINTS`` of (id, row, text): a row for each document (a: its mark), signatures (a, with b a mark), links of marks (a, b)."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            n, mark, full = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)
            for rows, offsets, values in shingle_sets(batch.column("text")):
                n[rows], mark[rows], full[rows] = np.diff(offsets), marks_of(offsets, values), True
                of, signature = signatures(offsets, values)
                held.append((signature, mark[rows[of]]))
            yield _batch(DOCUMENT, batch.num_rows, id=batch.column("id"), row=batch.column("row"), n=n, a=pa.array(mark, mask=~full))
            if sum(len(x) for x, _ in held) > SIGNATURES_AT_ONCE:
                yield from _combined(*map(np.concatenate, zip(*held, strict=True)))
                held = []
        if held:
            yield from _combined(*map(np.concatenate, zip(*held, strict=True)))

    return docs.select("id", "row", "text").mapInArrow(run, PRINTS)


def shared_signatures(found: DataFrame) -> DataFrame:
    """Links (a, b) of marks along the rows of each signature, read in the order of signatures: one row is held."""

    def chain(batches):
        last = None
        for batch in batches:
            signature, mark = (batch.column(c).to_numpy() for c in ("a", "b"))
            if not len(mark):
                continue
            if last is not None:
                signature, mark = np.append(last[0], signature), np.append(last[1], mark)
            same = np.flatnonzero((signature[1:] == signature[:-1]) & (mark[1:] != mark[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(mark[same]), pa.array(mark[same + 1])], ["a", "b"])
            last = signature[-1:], mark[-1:]

    rows = found.where(F.col("kind") == SIGNATURE).select("a", "b")
    return rows.repartition("a").sortWithinPartitions("a").mapInArrow(chain, "a bigint, b bigint")


def with_cells(members: DataFrame, cell: int = CELL) -> DataFrame:
    """``members`` (root, mark, n, ...) with the ``cell`` that each is searched in: its root's, or all pairs of pieces of a large one."""
    size = checkpointed(members.groupBy("root", "n").agg(F.count("*").alias("sets")))
    hot = checkpointed(size.groupBy("root").agg(F.sum(F.col("n") * F.col("sets")).alias("all")).where(F.col("all") > cell).select("root"))
    if hot.isEmpty():
        return members.withColumn("cell", F.xxhash64("root"))
    before = F.coalesce(F.sum(F.col("n") * F.col("sets")).over(Window.partitionBy("root").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    strata = size.join(hot, "root").withColumns({"slices": F.ceil(F.col("n") * F.col("sets") / cell), "bucket": F.floor(before / cell)})
    strata = checkpointed(strata.withColumn("own", F.when(F.col("slices") > 1, F.col("n")).otherwise(0)).select("root", "n", "bucket", "own", "slices"))
    cut = strata.withColumn("slice", F.explode(F.sequence(F.lit(0), F.greatest(F.col("slices"), F.lit(1)).cast("int") - 1)))
    pieces = cut.groupBy("root", F.struct("bucket", "own", "slice").alias("piece")).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    one, two = (pieces.select("root", *[F.col(c).alias(f"{c}{k}") for c in ("piece", "low", "high")]) for k in (1, 2))
    ordered = F.struct("low1", "piece1") < F.struct("low2", "piece2")
    pairs = one.join(two, "root").where(ordered & (F.col("low2") * PERCENT <= F.col("high1") * 100)).withColumn("cell", F.xxhash64("root", "piece1", "piece2"))
    of = pairs.select("root", F.explode(F.array("piece1", "piece2")).alias("piece"), "cell")
    alone = pieces.join(of, ["root", "piece"], "left_anti").select("root", "piece", F.xxhash64("root", "piece").alias("cell"))
    of = checkpointed(of.unionByName(alone))
    dealt = members.join(strata, ["root", "n"]).withColumn("piece", F.struct("bucket", "own", F.pmod(F.xxhash64("mark"), F.greatest(F.col("slices"), F.lit(1))).cast("int").alias("slice")))
    dealt = dealt.join(of, ["root", "piece"]).select(*members.columns, "cell")
    return dealt.unionByName(members.join(hot, "root", "left_anti").select(*members.columns, F.xxhash64("root").alias("cell")))


def _ranges(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """All numbers of the half-open ranges, one after the other."""
    size = stops - starts
    return np.arange(int(size.sum())) + np.repeat(starts - (np.cumsum(size) - size), size)


class Cell:
    """Sets of a cell under local shingle numbers, rare ones first; sets are numbered by size."""

    def __init__(self, sets: list[np.ndarray]):
        self.place = np.argsort([len(s) for s in sets], kind="stable")
        sets = [sets[i] for i in self.place.tolist()]
        self.size = np.array([len(s) for s in sets])
        self.start = np.append(0, np.cumsum(self.size))
        row = np.repeat(np.arange(len(sets)), self.size)
        _, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(often), dtype=np.int64)
        rank[np.argsort(often, kind="stable")] = np.arange(len(often))
        token = rank[token]
        often = np.sort(often)
        order = np.lexsort((token, row))
        self.token = token[order]  # by set, rare ones first
        #: Sets that hold what most hold come first as leaders.
        self.eager = np.argsort(-np.add.reduceat(often[self.token].astype(np.float64), self.start[:-1]) / self.size, kind="stable")
        shared = often > 1
        position = np.arange(len(self.token)) - self.start[row]
        self.prefix = self.size - -(-8 * self.size // 10) + 1
        indexed = np.flatnonzero((position < self.prefix[row]) & shared[self.token])
        self.step = max(POSITIONS, -(-int(self.prefix.max()) // 255))
        self.blocks = int(self.prefix.max() - 1) // self.step + 1
        #: Index lists: shingle, block of positions, set (so: size).
        self.key = np.sort((self.token[indexed] << np.int64(34)) | (position[indexed] // self.step << np.int64(26)) | row[indexed])
        self.shared = shared
        self.lists: tuple[np.ndarray, np.ndarray] | None = None
        self.flag = np.zeros(len(often), dtype=np.int8)

    def own(self, x: int) -> np.ndarray:
        return self.token[self.start[x] : self.start[x + 1]]

    def answers(self, x: int, slack: int) -> tuple[np.ndarray, np.ndarray]:
        """(sets, overlaps) of all that may share 9/19 of both sizes less 10/19 of the slack with ``x``: links of ``x`` and of sets that near to it."""
        n, tokens = int(self.size[x]), self.own(x)[: self.prefix[x]]
        at = np.flatnonzero(self.shared[tokens])
        block = np.arange(self.blocks)
        low = np.searchsorted(self.size, -((10 * slack - 9 * n - 19 * self.step * block) // 10), side="left")
        high = np.searchsorted(self.size, (10 * n - 19 * at + 10 * slack) // 9, side="right")
        i, b = np.nonzero(low[None, :] < high[:, None])  # all other blocks are skipped
        head = (tokens[at[i]] << np.int64(34)) | (block[b] << np.int64(26))
        found = np.unique(self.key[_ranges(np.searchsorted(self.key, head | low[b]), np.searchsorted(self.key, head | high[i]))] & np.int64((1 << 26) - 1))
        found = found[found != x]
        if not len(found):
            return found, found
        self.flag[self.own(x)] = 1
        held = self.flag[self.token[_ranges(self.start[found], self.start[found + 1])]]
        overlap = np.add.reduceat(held, np.cumsum(self.size[found]) - self.size[found], dtype=np.int64)
        self.flag[self.own(x)] = 0
        return found, overlap

    def derived(self, x: int, y: int, overlap: np.ndarray) -> np.ndarray:
        """Overlaps of ``y`` with all sets, from those of ``x``: only lists of shingles in which the two differ are read."""
        if self.lists is None:
            order = np.argsort(self.token, kind="stable")
            self.lists = np.searchsorted(self.token[order], np.arange(len(self.flag) + 1)), np.searchsorted(self.start, order, side="right") - 1
        heads, rows = self.lists
        out = overlap.copy()
        for tokens, sign in ((np.setdiff1d(self.own(y), self.own(x), assume_unique=True), 1), (np.setdiff1d(self.own(x), self.own(y), assume_unique=True), -1)):
            out += sign * np.bincount(rows[_ranges(heads[tokens], heads[tokens + 1])], minlength=len(out))
        return out


def joined(sets: list[np.ndarray]) -> np.ndarray:
    """A label for each set, equal for sets that links join."""
    cell, n = Cell(sets), len(sets)
    label, done = np.arange(n), np.zeros(n, dtype=bool)
    linked = lambda y, z, overlap: (100 + PERCENT) * overlap >= PERCENT * (cell.size[y] + cell.size[z])
    for x in cell.eager.tolist():
        if done[x]:
            continue
        done[x] = True
        slack = int(cell.size[x]) // 10
        found, overlap = cell.answers(x, slack)
        if not len(found):
            continue
        own = found[linked(x, found, overlap)]
        label = merge_labels(label, np.full(len(own), x), own)
        near = found[(cell.size[x] + cell.size[found] - 2 * overlap <= slack) & ~done[found]]
        done[near] = True
        known = np.zeros(n, dtype=np.int64)
        known[found], known[x] = overlap, cell.size[x]
        for y in near.tolist():
            open_ = found[label[found] != label[y]]
            open_ = open_[linked(y, open_, known[open_] + cell.size[y] - known[y])]  # what y holds beyond x might all lie in them
            if len(open_):
                more = open_[linked(y, open_, cell.derived(x, y, known)[open_])]
                label = merge_labels(label, np.full(len(more), y), more)
    out = np.empty(n, dtype=np.int64)
    out[cell.place] = label
    return out


def links(members: DataFrame) -> DataFrame:
    """Links (a, b) of marks that span the components of each cell of (cell, mark, grams)."""

    def spanned(marks: list[int], grams: list[bytes]) -> pa.RecordBatch:
        mark, at = np.unique(np.array(marks), return_index=True)
        label = joined([np.frombuffer(grams[i], np.uint64) for i in at.tolist()]) if len(mark) > 1 else np.zeros(len(mark))
        order = np.argsort(label, kind="stable")
        same = np.flatnonzero(label[order][1:] == label[order][:-1])
        return pa.RecordBatch.from_arrays([pa.array(mark[order[same]]), pa.array(mark[order[same + 1]])], ["a", "b"])

    def run(batches):
        cell, marks, grams, size = None, [], [], 0
        for batch in batches:
            for own, mark, held in zip(batch.column("cell").to_pylist(), batch.column("mark").to_pylist(), batch.column("grams").to_pylist(), strict=True):
                if own != cell and size > CELL:
                    yield spanned(marks, grams)
                    marks, grams, size = [], [], 0
                cell = own
                marks.append(mark)
                grams.append(held)
                size += len(held) // 8
        if marks:
            yield spanned(marks, grams)

    return members.select("cell", "mark", "grams").repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a bigint, b bigint").distinct()


def sets_of(docs: DataFrame) -> DataFrame:
    """(root, mark, n, grams) of (root, mark, text); a task gives each mark once."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            marks = batch.column("mark").to_pylist()
            for rows, offsets, values in shingle_sets(batch.column("text")):
                new = [k for k, i in enumerate(rows.tolist()) if marks[i] not in seen and not seen.add(marks[i])]
                at, grams = pa.array(rows[new], pa.int64()), pa.array([values[offsets[k] : offsets[k + 1]].tobytes() for k in new], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("root").take(at), batch.column("mark").take(at), pa.array(np.diff(offsets)[new], pa.int64()), grams], ["root", "mark", "n", "grams"])

    return docs.select("root", "mark", "text").mapInArrow(run, "root bigint, mark bigint, n bigint, grams binary")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ``n_shingles``, ``component_id`` of every document."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(key), F.col(text)).alias("row"), F.col(text).alias("text"))
    found = checkpointed(prints(rows))
    documents = found.where(F.col("kind") == DOCUMENT)
    distinct = checkpointed(documents.where("n > 0").groupBy(F.col("a").alias("mark")).agg(F.min("row").alias("row"), F.coalesce(F.min("id"), F.lit(NO_ID)).alias("least"), F.first("n").alias("n")))
    near = components(shared_signatures(found).unionByName(found.where(F.col("kind") == LINK).select("a", "b")))
    roots = checkpointed(near.unionByName(near.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "mark"))
    chosen = checkpointed(distinct.join(roots, "mark").select("row", "mark", "root"))
    read = rows.join(F.broadcast(chosen) if chosen.count() <= MAX_BROADCAST else chosen, "row").select("root", "mark", "text")
    members = checkpointed(sets_of(read))
    ends = distinct.select("mark", F.struct("least", "mark").alias("node"))
    edges = links(with_cells(members)).join(ends.select(F.col("mark").alias("a"), F.col("node").alias("x")), "a").join(ends.select(F.col("mark").alias("b"), F.col("node").alias("y")), "b")
    rooted = components(edges.select(F.col("x").alias("a"), F.col("y").alias("b")))
    named = ends.join(rooted, "node", "left").select("mark", F.coalesce("root", "node")["least"].alias("least"))
    out = documents.select("id", "n", F.col("a").alias("mark")).join(named, "mark", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.nullif("least", F.lit(NO_ID)))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE cut AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
),
sets AS MATERIALIZED (
  SELECT DISTINCT rid, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM cut
),
sizes AS MATERIALIZED (SELECT rid, count(*) AS n FROM sets GROUP BY rid),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.rid AS a, y.rid AS b, count(*) AS common FROM sets x JOIN sets y ON x.shingle = y.shingle AND x.rid < y.rid GROUP BY x.rid, y.rid) p
  JOIN sizes sa ON sa.rid = a JOIN sizes sb ON sb.rid = b WHERE 100 * common >= 90 * (sa.n + sb.n - common)
),
reach(rid, other) AS (SELECT rid, rid FROM cut UNION SELECT rid, CASE WHEN a = other THEN b ELSE a END FROM reach JOIN links ON a = other OR b = other)
SELECT cut.doc_id, coalesce(n, 0) AS n_shingles, min(o.doc_id) AS component_id
FROM cut LEFT JOIN sizes USING (rid) JOIN reach USING (rid) JOIN cut o ON o.rid = other GROUP BY cut.rid, cut.doc_id, n
"""
