"""SimHash near-duplicates: a Gray-order hierarchical index over fingerprints, and components of its links.

1. ``fingerprint_column``: 64-bit SimHash of 4-word shingles (XXH64, seed 42) of whole texts, in Arrow batches.
   ``wide_print_columns``: four independent 64-bit SimHashes of 5-word shingles, whose 256 bits also tell how alike two texts are.
2. ``links``: distinct fingerprints are routed to cells by block keys: the 64 bits are cut into ``b`` blocks, and
   two fingerprints within ``d`` bits agree on at least ``b - d`` blocks, so every link meets in a cell of some choice
   of ``b - d`` blocks.  ``b`` grows with the number of fingerprints, so a cell's expected size stays bounded, and a cell
   that turns out hot is cut further by blocks of its remaining bits, by the same rule.
3. In a cell, ``GrayIndex`` sorts the fingerprints by Gray rank, groups neighbours into nodes of ``FANOUT``, keeps
   the bits that all members share in the node as a masked pattern (each level stores only the bits that its parent
   does not), and searches all fingerprints of the cell level by level, adding up differences and pruning a whole
   group once they exceed ``d``.  Groups that already hang together with the query are pruned too: components need
   a spanning set of links, not all pairs.  A cell's links are emitted as chains, so no fingerprint gets many.
4. ``components``: large-star and small-star rounds over the links, each written to the shared folder, until nothing changes.  Nodes are ordered by
   document id and the root of a component is its smallest node, so nothing is gathered by component afterwards.

A fingerprint occurs once in the search however many copies its text has, and a cell of near copies costs about its
number of distinct fingerprints, so hot groups do not multiply.

``near_duplicates`` answers the contract (4 words, 4 bits).  ``one_of_each``, for corpora, links two texts when one of their first
``ROUTE_WORDS`` fingerprints differs by at most ``ROUTE_DISTANCE`` bits and all 256 bits by at most ``ALIKE_BITS``: 256 * acos(c) / pi
bits are expected at the cosine c = 2j / (1 + j) of two texts with Jaccard similarity j, 39 at 0.8; the bound lies one standard error above.

Defined results: null and empty texts have fingerprint zero, linked like any other.  Texts of any length are read in
blocks.  Repeated rows share a component, and ``one_of_each`` keeps one of them.  A component's id is its smallest non-null id; it is
null if all its ids are (an id of 2**63 - 1 counts as null).  Equal smallest ids are told apart by a hash of the text.
Empty tables give empty results.  ``near_duplicates`` carries no other columns; ``one_of_each`` returns the input's own, whatever
their names.
"""

from __future__ import annotations

import uuid
from itertools import combinations, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medspan.llm.common import buffers, checkpointed, mix, shingle_hashes, unused, word_blocks
from medspan.session import MAX_BROADCAST_ROWS, remove, shared_folder

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: For corpora: words of a shingle, how many of the four fingerprints are searched, and by how many bits of one of those, and
#: of all four, two like texts may differ.
WIDE_SHINGLE, ROUTE_WORDS, ROUTE_DISTANCE, ALIKE_BITS = 5, 3, 8, 44
WIDE = ("fp", "w1", "w2", "w3")
FANOUT = 16
#: Fingerprints of a cell that are searched together, and the most (query, member) pairs that may be held for them.
QUERIES_AT_ONCE, PAIRS_AT_ONCE = 256, 1 << 18
#: Expected fingerprints in a cell that the choice of blocks aims at.
CELL, WIDE_CELL = 512, 8192
#: A cell with more fingerprints is cut further; a node with more links is joined by broadcast.
HOT_CELL, HUB = 1 << 20, 100_000
#: In how many fingerprints one is looked at to find hot cells, and the most hot cells, hubs and marks that are broadcast.
HOT_SAMPLE, MAX_BROADCAST = 64, 1_000_000
NO_ID = (1 << 63) - 1
TEXT_BLOCK = 1 << 20
UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes) -> int:
    """SimHash of one UTF-8 text, read in blocks."""
    digest, total, n = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64), 0
    carry: list[bytes] = []
    for words, last in _word_lists(text):
        words = carry + words
        if n == 0 and last and 0 < len(words) < SHINGLE:
            return digest(b" ".join(words), SEED)
        line = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        m = len(words) - SHINGLE + 1
        if m > 0:
            starts = np.append(0, ends[: m - 1] + 1).tolist()
            hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)], dtype=">u8")
            for at in range(0, m, 1 << 14):
                total += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.uint32)
            n += m
        carry = words[-(SHINGLE - 1) :] if m > 0 else words
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big") if n else 0


def _word_lists(text: bytes):
    """(words, is_last) of blocks cut at white space."""
    low, at = text.translate(UPPER), 0
    while True:
        end = at + TEXT_BLOCK
        while end < len(low) and low[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield low[at:end].split(), end >= len(low)
        if end >= len(low):
            return
        at = end


def fingerprint_column(text: Column) -> Column:
    """Signed 64-bit fingerprint of a text column; null texts give 0."""

    @F.arrow_udf("bigint")
    def simhash(texts: pa.Array) -> pa.Array:
        raw, off = buffers(texts)
        return pa.array([fingerprint(raw[a:b].tobytes()) for a, b in zip(off[:-1], off[1:], strict=True)], pa.uint64()).view(pa.int64())

    return simhash(text)


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray order."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def wide_prints(texts: pa.Array, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """Four 64-bit SimHashes of each text; shingles by rolling word hashes (fewer words: the whole sequence; none: zero)."""
    rows = len(texts)
    total, n = np.zeros((rows, 64 * len(WIDE)), dtype=np.int32), np.zeros(rows, dtype=np.int64)
    seeds = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
    few: dict[int, np.ndarray] = {}
    for doc, h, _, _, fresh in word_blocks(texts, overlap=shingle - 1):
        g, at = shingle_hashes(doc, h, shingle)
        row = doc[at]
        held = np.unique(doc)
        for d in held[~np.isin(held, row)].tolist():
            few[d] = np.append(few.get(d, h[:0]), h[fresh:][doc[fresh:] == d])[: shingle - 1]
        edges = np.append(np.flatnonzero(np.diff(row, prepend=-1)), len(row))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            n[row[lo]] += hi - lo
            for a in range(lo, hi, 1 << 13):
                total[row[lo]] += _bits(g[a : min(a + (1 << 13), hi)], seeds).sum(0, dtype=np.uint32)
    for d, own in few.items():
        if not n[d] and len(own):
            whole = np.array([len(own)], dtype=np.uint64)
            for x in own:
                whole = mix(whole * seeds[0] + x)
            n[d], total[d] = 1, _bits(whole, seeds)[0]
    return np.packbits(total > n[:, None] // 2, axis=1).view(">u8").astype(np.uint64)


def _bits(g: np.ndarray, seeds: list[np.uint64]) -> np.ndarray:
    words = np.stack([mix((g ^ seed) * seed) for seed in seeds], axis=1)
    return np.unpackbits(words.astype(">u8").view(np.uint8).reshape(len(g), -1), axis=1)


def wide_print_columns(text: Column) -> Column:
    """Struct of the signed values ``WIDE`` of a text column; null texts give zeros."""

    @F.arrow_udf("struct<" + ",".join(f"{c}:bigint" for c in WIDE) + ">")
    def prints(texts: pa.Array) -> pa.Array:
        made = wide_prints(texts).view(np.int64)
        return pa.StructArray.from_arrays([pa.array(made[:, k]) for k in range(len(WIDE))], list(WIDE))

    return prints(text)


class GrayIndex:
    """Hierarchy over 64-bit codes in Gray order; nodes of one level are ``FANOUT`` neighbours of the level below.

    ``order`` sorts the given codes; positions are those of the sorted ``codes``.
    """

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes = codes[self.order]
        every, some = [self.codes], [self.codes]  # AND and OR of the members
        while len(every[-1]) > 1:
            at = np.arange(0, len(every[-1]), FANOUT)
            every.append(np.bitwise_and.reduceat(every[-1], at))
            some.append(np.bitwise_or.reduceat(some[-1], at))
        shared = [~(a ^ o) for a, o in zip(every, some, strict=True)]
        #: From the root down to the parents of the codes: shared bits that the parent does not hold yet, and their values.
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        above = np.zeros(1, dtype=np.uint64)
        for level in range(len(every) - 1, 0, -1):
            parent = np.repeat(above, FANOUT)[: len(every[level])] if level < len(every) - 1 else above
            self.levels.append((shared[level] & ~parent, every[level] & shared[level] & ~parent))
            above = shared[level]
        short = -len(self.codes) % FANOUT
        self.groups = np.append(self.codes, np.zeros(short, np.uint64)).reshape(-1, FANOUT)

    def pairs(self, queries: np.ndarray, distance: int, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query position, member position) of all members within ``distance`` of the queried members, or, with
        ``label``, of those whose label differs from the query's."""
        same = self._same(label) if label is not None else None
        q, node = np.arange(len(queries)), np.zeros(len(queries), dtype=np.int64)
        acc = np.zeros(len(queries), dtype=np.uint8)
        for depth, (mask, value) in enumerate(self.levels):
            if depth:
                width = len(mask)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                q, acc = np.repeat(q, FANOUT), np.repeat(acc, FANOUT)
                real = node < width
                q, node, acc = q[real], node[real], acc[real]
            if same is not None:
                new = same[depth][node] != label[queries[q]]
                q, node, acc = q[new], node[new], acc[new]
            acc = acc + np.bitwise_count((self.codes[queries[q]] & mask[node]) ^ value[node])
            near = acc <= distance
            q, node, acc = q[near], node[near], acc[near]
        # The last level whole groups at a time: a code's own bits are all that is left, so the full difference decides.
        row, member = np.nonzero(np.bitwise_count(self.groups[node] ^ self.codes[queries[q]][:, None]) <= distance)
        a, b = queries[q[row]], node[row] * FANOUT + member
        real = b < len(self.codes)
        a, b = a[real], b[real]
        if label is not None:
            new = label[a] != label[b]
            a, b = a[new], b[new]
        return a, b

    def _same(self, label: np.ndarray) -> list[np.ndarray]:
        """For each level from the root: the label that all members of a node share, or -1."""
        low, high, out = label, label, []
        while len(low) > 1:
            at = np.arange(0, len(low), FANOUT)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            out.append(np.where(low == high, low, -1))
        return out[::-1]

    def labels(self, distance: int, alike=None) -> np.ndarray:
        """Component of each code under links of at most ``distance`` bits, as the position of its first member.

        ``alike`` (positions, positions) confirms links; without it all of them hold.
        """
        n = len(self.codes)
        at = np.arange(n)
        chain = np.flatnonzero(np.bitwise_count(self.codes[1:] ^ self.codes[:-1]) <= distance)
        chain = chain[alike(chain, chain + 1)] if alike is not None else chain
        label = merge_labels(at, chain, chain + 1)
        step = max(1, min(QUERIES_AT_ONCE, PAIRS_AT_ONCE // max(n, 1)))
        for lo in range(0, n, step):
            a, b = self.pairs(at[lo : lo + step], distance, label)
            if alike is not None and len(a):
                held = alike(a, b)
                a, b = a[held], b[held]
            if len(a):
                label = merge_labels(label, a, b)
        return label


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest label over components after links a-b are added."""
    label = label.copy()
    while True:
        x, y = label[a], label[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        open_ = low != high
        if not open_.any():
            return label
        a, b = a[open_], b[open_]
        np.minimum.at(label, high[open_], low[open_])
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further


def block_choices(n: int, distance: int = DISTANCE, cell: int = CELL) -> list[int]:
    """Masks of the block choices for ``n`` fingerprints: each keeps ``b - distance`` of ``b`` blocks of the 64 bits."""
    for b in range(distance + 1, 2 * distance + 1):
        if n <= cell << (64 * (b - distance) // b):
            break
    edges = [64 * i // b for i in range(b + 1)]
    blocks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(choice) for choice in combinations(blocks, b - distance)]


def finer(mask: int, distance: int) -> list[int]:
    """Masks that cut a cell further: two members within ``distance`` bits agree on one of ``distance + 1`` blocks of its free bits."""
    free = [b for b in range(64) if not mask >> b & 1]
    edges = [len(free) * i // (distance + 1) for i in range(distance + 2)]
    return [mask | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(edges, edges[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _literal(masks: list[int]) -> Column:
    return F.from_json(F.lit(str([_signed(m) for m in masks])), "array<bigint>")


def routes(prints: DataFrame, n: int, distance: int, cell: int, words: int = 1) -> DataFrame:
    """``prints`` with ``choice`` and ``key``, once for each cell of a row.

    With ``words`` above 1, each of the first words of ``WIDE`` takes the place of ``fp`` in turn, in cells of its own.

    Hot cells are found on every ``HOT_SAMPLE``-th fingerprint by hash and cut by ``finer``, which loses no link, so the
    sample decides only the size of cells.  Their number is bounded by the rows over the least size of a hot cell.
    """
    masks = block_choices(n, distance, cell) * words
    hot_cell = max(HOT_CELL, n * len(masks) // MAX_BROADCAST)
    own = prints.columns
    if words > 1:
        turned = [F.struct(*[F.col(WIDE[(k + w) % len(WIDE)]).alias(c) for k, c in enumerate(WIDE)]) for w in range(words)]
        prints = prints.select("mark", F.posexplode(F.array(*turned)).alias("word", "turn")).select("mark", "turn.*", "word")
    else:
        prints = prints.withColumn("word", F.lit(0))
    each = F.posexplode(_literal(masks[: len(masks) // words])).alias("choice", "mask")
    rows = prints.select("*", each).select(*own, (F.col("word") * (len(masks) // words) + F.col("choice")).alias("choice"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    while max(m.bit_count() for m in masks) < 40:
        few = rows.where(F.pmod(F.xxhash64("fp"), F.lit(HOT_SAMPLE)) == 0)
        hot = checkpointed(few.groupBy("choice", "key").agg(F.count("*").alias("n")).where(F.col("n") * HOT_SAMPLE > hot_cell).select("choice", "key"))
        if hot.isEmpty():
            break
        cut = [x for m in masks for x in finer(m, distance)]
        marked = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), ["choice", "key"], "left")
        parts = F.sequence(F.lit(0), F.lit(distance))
        split = marked.where("hot").withColumn("part", F.explode(parts)).withColumn("choice", F.col("choice") * (distance + 1) + F.col("part"))
        split = split.withColumns({"key": F.col("fp").bitwiseAND(F.element_at(_literal(cut), F.col("choice") + 1)), "choice": F.col("choice") + len(masks)})
        rows = marked.where("hot is null").select(*own, "choice", "key").unionByName(split.select(*own, "choice", "key"))
        masks = masks + cut
    return rows


def links(prints: DataFrame, n: int, distance: int = DISTANCE, cell: int = CELL, alike_bits: int | None = None, words: int = 1) -> DataFrame:
    """Links (a, b), a < b, that join distinct fingerprints into components: a chain through each component of each cell.

    ``prints`` has (mark, fp), or with ``alike_bits`` (mark, *WIDE); marks are unique and name the ends of the links.
    """
    names = ("choice", "key", "mark", *(WIDE if alike_bits is not None else ("fp",)))
    dealt = routes(prints, n, distance, cell, words).select(*names).repartition("choice", "key").sortWithinPartitions("choice", "key")

    def search(batches):
        for rows, starts in _whole_cells(batches, names):
            mark, codes = rows[2], [x.view(np.uint64) for x in rows[3:]]
            for a, b in _cells(codes, starts, len(mark), distance, alike_bits):
                if len(a):
                    x, y = mark[a], mark[b]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return dealt.mapInArrow(search, "a bigint, b bigint").distinct()


def _whole_cells(batches, names):
    """(columns, starts of cells) of rows sorted by cell, whole cells at a time; an open cell is held in pieces."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if not len(rows[0]):
            continue
        new = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1
        if held and (held[-1][0][-1] != rows[0][0] or held[-1][1][-1] != rows[1][0]):
            new = np.append(0, new)
        if not len(new):
            held.append(rows)
            continue
        before, last = sum(len(x[0]) for x in held), int(new[-1])
        yield [np.concatenate([*(x[k] for x in held), rows[k][:last]]) for k in range(len(rows))], np.append(0, new[:-1] + before)
        held = [[x[last:] for x in rows]]
    if held:
        yield [np.concatenate([x[k] for x in held]) for k in range(len(held[0]))], np.array([0])


def _cells(codes: list[np.ndarray], starts: np.ndarray, end: int, distance: int, alike_bits: int | None):
    """Positions (a, b) of the links of each cell."""
    stops = np.append(starts[1:], end)
    size = stops - starts

    def confirm(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return sum((np.bitwise_count(x[a] ^ x[b]) for x in codes[1:]), np.bitwise_count(codes[0][a] ^ codes[0][b]).astype(np.int16)) <= alike_bits

    # Cells of two, the most frequent, in one pass.
    two = starts[size == 2]
    two = two[np.bitwise_count(codes[0][two] ^ codes[0][two + 1]) <= distance]
    yield (two, two + 1) if alike_bits is None else tuple(x[confirm(two, two + 1)] for x in (two, two + 1))
    for lo, hi in zip(starts[size > 2], stops[size > 2], strict=True):
        index = GrayIndex(codes[0][lo:hi])
        place = index.order + lo
        label = index.labels(distance, None if alike_bits is None else lambda a, b, place=place: confirm(place[a], place[b]))
        order = np.argsort(label, kind="stable")
        chained = np.flatnonzero(label[order][1:] == label[order][:-1])
        yield place[order[chained]], place[order[chained + 1]]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots; the root is the smallest node of the component.

    Alternates large-star and small-star rounds; each keeps connectivity, and the edges end as stars around the roots.  The
    links of a hub, of which there are few, meet its least neighbour by broadcast, all others by a shuffle.
    """
    a, b = F.col("a"), F.col("b")
    session = edges.sparkSession
    folder = f"{shared_folder(session)}/stars-{uuid.uuid4().hex}"

    def kept(made: DataFrame, turn: int) -> DataFrame:
        """``made`` from a file: a checkpoint would keep the estimate of its joins, and each round raises that to the fourth power."""
        made.write.parquet(f"{folder}/{turn}")
        return session.read.schema(made.schema).parquet(f"{folder}/{turn}")

    try:
        stars = kept(edges.where(a != b).select(F.when(a < b, b).otherwise(a).alias("u"), F.when(a < b, a).otherwise(b).alias("v")).distinct(), 0)  # v < u
        seen = None
        for turn in count(1):
            both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = checkpointed(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.when(F.col("m") < F.col("u"), F.col("m")).otherwise(F.col("u")).alias("m"), "n"))
            size = least.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
            both = both.hint("merge") if size["rows"] > MAX_BROADCAST_ROWS else both
            hub = max(HUB, size["rows"] // MAX_BROADCAST)
            met = both.join(least.where(F.col("n") <= hub).select("u", "m"), "u")
            if size["most"] > hub:
                hubs = F.broadcast(least.where(F.col("n") > hub).select("u", "m"))
                met = both.join(hubs, "u").unionByName(both.join(hubs, "u", "left_anti").join(least.where(F.col("n") <= hub).select("u", "m"), "u"))
            large = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            down = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(down, "u")
            stars = kept(small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct(), turn)
            remove(session, f"{folder}/{turn - 1}")
            state = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
            if state == seen:
                return checkpointed(stars.select(F.col("u").alias("node"), F.col("v").alias("root")))
            seen = state
    finally:
        remove(session, folder)


def _linked(distinct: DataFrame, found: DataFrame) -> DataFrame:
    """(node, root) of the components of ``found`` (a, b), marks of ``distinct`` (mark, node)."""
    ends = distinct.select("mark", "node")
    one = found.join(ends.select(F.col("mark").alias("a"), F.col("node").alias("x")), "a")
    return components(one.join(ends.select(F.col("mark").alias("b"), F.col("node").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per document: key, ``fingerprint`` (16 hex digits), ``component_id``, and ``fp`` (the signed value)."""
    prints = checkpointed(docs.select(F.col(key).alias("id"), fingerprint_column(F.col(text)).alias("fp")))
    least = F.coalesce(F.min(F.col("id").cast("long")), F.lit(NO_ID))
    distinct = checkpointed(prints.groupBy("fp").agg(least.alias("least")).select(F.col("fp").alias("mark"), "fp", F.struct("least", "fp").alias("node")))
    rooted = _linked(distinct, links(distinct.select("mark", "fp"), distinct.count(), distance))
    named = distinct.join(rooted, "node", "left").select("fp", F.coalesce("root", "node")["least"].alias("component_id"))
    named = named.select("fp", F.nullif("component_id", F.lit(NO_ID)).alias("component_id"))
    return prints.join(named, "fp").select(F.col("id").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "fp")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = ROUTE_DISTANCE, alike_bits: int = ALIKE_BITS) -> DataFrame:
    """``docs`` with one row for each component of like texts: the one with the smallest key (nulls last), then text hash.

    Rows are told apart by hashes of key and text.  Texts are not moved where the rows to drop (or to keep) are few enough
    to be broadcast, else once; repeated rows leave one.
    """
    k, i = unused(docs, "mark"), unused(docs, "own_id")
    marked = docs.withColumns({k: F.xxhash64(F.col(key), F.col(text)), i: F.coalesce(F.col(key).cast("long"), F.lit(NO_ID))})
    small = checkpointed(marked.select(F.col(i).alias("id"), F.col(k).alias("k"), wide_print_columns(F.col(text)).alias("p")).select("id", "k", "p.*"))
    rows = checkpointed(small.groupBy("id", "k").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in WIDE]))
    first = rows.groupBy(*WIDE).agg(F.min(F.struct("id", "k")).alias("node"))
    distinct = checkpointed(first.select(F.xxhash64(*WIDE).alias("mark"), *WIDE, "node"))
    found = links(distinct.select("mark", *WIDE), distinct.count(), distance, WIDE_CELL, alike_bits, ROUTE_WORDS)
    rooted = _linked(distinct, found)
    kept = checkpointed(distinct.join(rooted, "node", "left_anti").select("node.*"))
    seen = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("n") > 1, 1)).alias("repeated")).first()
    n_kept = kept.count()
    name = {"k": k, "id": i}
    if min(n_kept, seen["n"] - n_kept) > MAX_BROADCAST or seen["repeated"] > MAX_BROADCAST:
        left = marked.join(kept.withColumnsRenamed(name), [k, i], "left_semi")
        return left.dropDuplicates([k, i]).select(*docs.columns)
    if n_kept <= seen["n"] - n_kept:
        left = marked.join(F.broadcast(kept.withColumnsRenamed(name)), [k, i], "left_semi")
    else:
        left = marked.join(F.broadcast(rows.select("id", "k").join(kept, ["id", "k"], "left_anti").withColumnsRenamed(name)), [k, i], "left_anti")
    if seen["repeated"]:
        again = F.broadcast(checkpointed(rows.where("n > 1").select("id", "k").withColumnsRenamed(name)))
        left = left.join(again, [k, i], "left_anti").unionByName(left.join(again, [k, i], "left_semi").dropDuplicates([k, i]))
    return left.select(*docs.columns)
