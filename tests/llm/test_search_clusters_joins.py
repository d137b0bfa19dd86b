"""Search, clustering and the Jaccard join against plain versions, and their results on special rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from medspan.llm import op10_simhash, op11_search, op12_centroids, op13_jaccard
from medspan.session import BEYOND, estimated_bytes

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id bigint, text string, doc_id bigint, rank int"


def plain_search(docs, items, k=10):
    held = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted: dict = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, terms in wanted.items():
        scored = []
        for i, c in held:
            m = 10 + 90 * c.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=lambda r: (str(r[0]), r[1]))


def found_in(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=lambda r: (str(r[0]), r[1]))


def test_search_equals_a_plain_ranking(spark, docs, edge_rows):
    texts = [(r[0], r[1]) for r in edge_rows]
    items = [(1, "House by the river, under GREEN leaves"), (2, "schön über das Haus Über"), (3, None), (4, "  .,; "), (5, "nowhere zzz"), (1, "many people"), (None, "the"), (9, "é" * 50), (10, "same text of the house")]
    table = spark.createDataFrame([(i, t, 3, 1) for i, t in items], ITEMS)
    expected = plain_search(texts, items)
    for shard_bytes in (op11_search.SHARD_BYTES, 2_000):  # one shard for each task, and several
        index = op11_search.build_index(docs, shard_bytes=shard_bytes).cache()
        assert found_in(op11_search.search(index, table)) == expected
    assert found_in(op11_search.search(index, table, max_item_terms=4)) == expected  # items in blocks
    assert index.where("term = 'house'").agg({"n": "sum"}).first()[0] == sum("house" in TERM.findall((t or "").translate(LOWER)) for _, t in texts)


def test_search_without_broadcast_of_terms_and_with_narrow_windows(spark, docs, edge_rows, monkeypatch):
    monkeypatch.setattr(op11_search, "MAX_BROADCAST_TERMS", 0)
    items = [(1, "the house and the river"), (2, "viele leute")]
    index = op11_search.build_index(docs).cache()
    assert found_in(op11_search.search(index, spark.createDataFrame([(i, t, 3, 1) for i, t in items], ITEMS))) == plain_search([(r[0], r[1]) for r in edge_rows], items)


def test_heap_merge_keeps_the_best_and_settles_ties(monkeypatch):
    monkeypatch.setattr(op11_search, "WINDOW", 4)
    rng = random.Random(5)
    for _ in range(50):
        total, lists = Counter(), []
        for _ in range(rng.randrange(1, 6)):
            at = sorted(rng.sample(range(60), rng.randrange(1, 30)))
            parts = [rng.randrange(1, 4) for _ in at]
            lists.append((np.array(at), np.array(parts)))
            total.update(dict(zip(at, parts, strict=True)))
        expected = sorted(((s, d) for d, s in total.items()), key=lambda x: (-x[0], x[1]))[:5]
        assert sorted(op11_search.merged(lists, 5), key=lambda x: (-x[0], x[1])) == expected


def test_postings_survive_packing():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**35, 2**63, 2**64 - 1], dtype=np.uint64)
    raw, ends = op11_search.packed(values)
    assert op11_search.unpacked(raw).tolist() == values.tolist()
    assert ends[-1] == len(raw)
    assert len(op11_search.unpacked(raw[:0])) == 0


def test_search_of_nothing(spark, docs, no_docs):
    items = spark.createDataFrame([(1, "the house", 3, 1)], ITEMS)
    assert op11_search.search(op11_search.build_index(no_docs), items).count() == 0
    assert op11_search.search(op11_search.build_index(docs).cache(), items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert op11_search.search(op11_search.build_index(docs).cache(), items.limit(0)).count() == 0


VECTORS = "vec_id bigint, embedding array<float>, cluster int, distance string, id int"


def plain_clusters(rows, k=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    dist = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((dist(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            some = [v for (_, v), c in zip(kept, own, strict=True) if c == j]
            centroids[j] = [sum(x) // len(some) for x in zip(*some, strict=True)] if some else centroids[j]
    final = [(i, *near(v)) for i, v in kept]
    whole = sum(d for _, d, _ in final)
    cap = 2**63 - 1
    sums = Counter()
    for _, d, c in final:
        sums[c] += min(d, cap)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, min(d, cap), min(sums[c], cap), min(whole, cap), digest[c]) for i, d, c in final), key=str)


def vectors_of(n, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 0.4, (5, 64))
    return [(i, [float(x) for x in (middle[i % 5] + rng.normal(0, 0.1 + 0.2 * (i % 3), 64)).astype(np.float32)]) for i in range(n)]


@pytest.mark.parametrize("kind", ["plain", "special", "huge", "few"])
def test_clusters_equal_a_plain_version(spark, kind):
    rows = vectors_of(5 if kind == "few" else 150, 4)
    if kind == "special":
        rows += [(500, None), (501, []), (502, [0.5] * 63), (503, [0.5] * 65), (504, [None] + [0.5] * 63), (505, [float("nan")] + [0.5] * 63), (506, [float("inf")] + [0.5] * 63)]
        rows += [(None, rows[3][1]), (7, rows[7][1]), (7, rows[8][1]), (900, rows[9][1]), (901, [0.0] * 64), (902, [-0.00048828125] * 64)]
    if kind == "huge":
        rows += [(600, [float(np.float32(1e30))] * 64), (601, [float(np.float32(-3e38))] + [0.5] * 63), (602, [200_000.0] * 64), (603, [131_072.5, -131_073.5] * 32)]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], VECTORS).repartition(3)
    own = sorted((tuple(r) for r in op12_centroids.clustered(df).collect()), key=str)
    assert own == plain_clusters(rows)


def test_partial_distances_find_the_nearest_and_save_work():
    rng = np.random.default_rng(1)
    centroids = rng.integers(-300, 300, (8, 64))
    centroids[5] = centroids[2]  # equal centroids: the smaller number
    vectors = centroids[rng.integers(0, 8, 400)] + rng.integers(-40, 40, (400, 64))
    vectors[0] = (centroids[0] + centroids[1]) // 2
    own, distance, done = op12_centroids.nearest(vectors, centroids, np.arange(64))
    whole = ((vectors[:, None, :] - centroids[None]) ** 2).sum(2)
    assert own.tolist() == whole.argmin(1).tolist()
    assert distance.tolist() == whole.min(1).tolist()
    assert done < 0.5 * whole.size * 64


def test_no_vectors(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert op12_centroids.clustered(empty).collect() == []
    assert op12_centroids.clustered(empty).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < 3:
        return {tuple(words)} if words else set()
    return set(zip(words, words[1:], words[2:], strict=False))


def plain_components(rows):
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least: dict = {}
    for i, (own, _) in enumerate(rows):
        if own is not None:
            least[root(i)] = min(least.get(root(i), own), own)
    return sorted(((own, len(s), least.get(root(i))) for i, ((own, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


def near_copies(seed):
    """Texts around the border of a similarity of 0.9: copies of copies, prefixes, a shared passage, and strangers."""
    rng = random.Random(seed)
    rows, at = [], 0
    passage = [f"p{i}" for i in range(60)]
    for size in (4, 9, 12, 13, 20, 33, 60, 150, 400):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for n in range(14):
            words = edited(rng, base, rng.randrange(0, max(2, size // 30)))
            words = words[rng.randrange(0, 1 + size // 25) :] + (passage if n % 5 == 0 else [])
            rows.append((at, " ".join(words) if n % 3 else "\n".join(words).upper()))
            at += rng.randrange(1, 3)
    return rows


def of_join(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_join_equals_all_pairs(spark, docs, edge_rows):
    from conftest import SCHEMA, row

    own = near_copies(3) + [(r[0], r[1]) for r in edge_rows]
    df = spark.createDataFrame([row(i, t) for i, t in own], SCHEMA).repartition(3)
    assert of_join(op13_jaccard.near_duplicates(df)) == plain_components(own)


def test_join_with_cells_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(op13_jaccard, "CELL", 400)
    monkeypatch.setattr(op13_jaccard, "MAX_BROADCAST", 0)
    own = near_copies(8)
    df = spark.createDataFrame(own, "doc_id bigint, text string").repartition(3)
    assert of_join(op13_jaccard.near_duplicates(df)) == plain_components(own)


def test_answers_derived_from_a_like_set_equal_all_pairs():
    rng = random.Random(11)
    for size in (10, 40, 300):
        base = [rng.getrandbits(64) for _ in range(size)]
        sets = []
        for n in range(60):
            own = set(base)
            for _ in range(rng.randrange(0, 1 + size // 8)):
                own.discard(rng.choice(base))
            own |= {rng.getrandbits(64) for _ in range(rng.randrange(0, 1 + size // 20))}
            sets.append(np.array(sorted(own if n % 4 else {rng.getrandbits(64) for _ in range(size)}), dtype=np.uint64))
        label = op13_jaccard.joined(sets)
        parent = list(range(60))
        for i in range(60):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = parent[i], parent[j]
                    parent = [b if p == a else p for p in parent]
        assert len({*zip(label.tolist(), parent, strict=True)}) == len(set(parent)) == len(set(label.tolist()))


def test_linked_sets_share_a_signature():
    rng = random.Random(2)
    for size in [*range(9, 40), 57, 100, 333]:
        for _ in range(20):
            whole = [rng.getrandbits(64) for _ in range(size)]
            off = rng.randrange(0, size // 10 + 1)
            a = whole[: size - off] if rng.random() < 0.5 else whole
            drop = size // 10 - off if len(a) < size else size // 10
            b = whole[drop:]
            sets = [np.array(sorted(set(x)), dtype=np.uint64) for x in (a, b)]
            both = len(np.intersect1d(*sets))
            assert 100 * both >= 90 * (len(sets[0]) + len(sets[1]) - both)
            of, signature = op13_jaccard.signatures(np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]), np.concatenate(sets))
            assert set(signature[of == 0].tolist()) & set(signature[of == 1].tolist())


def test_sets_of_long_texts_and_short_ones():
    texts = ["a b c a b c", None, "", "One", "one two", " ".join(f"w{i % 5000}" for i in range(200_000)), "x y z", "a b c A B C"]
    found = {}
    for rows, offsets, values in op13_jaccard.shingle_sets(pa.array(texts)):
        for k, r in enumerate(rows.tolist()):
            assert r not in found
            found[r] = values[offsets[k] : offsets[k + 1]]
    assert {r: len(v) for r, v in found.items()} == {i: len(plain_set(t)) for i, t in enumerate(texts) if t}
    assert found[0].tolist() == found[7].tolist()


def test_join_of_nothing(no_docs):
    out = op13_jaccard.near_duplicates(no_docs)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert out.collect() == []


def test_components_of_a_long_chain(spark):
    """Many rounds of joins, whose estimates must not build on one another."""
    order = list(range(3000))
    random.Random(5).shuffle(order)
    edges = spark.createDataFrame(list(zip(order[:-1], order[1:], strict=True)), "a bigint, b bigint")
    rooted = op10_simhash.components(edges)
    assert {(r.node, r.root) for r in rooted.collect()} == {(n, 0) for n in range(1, 3000)}
    assert estimated_bytes(rooted) < 1 << 30


def test_an_estimate_of_many_joins_is_a_number(spark):
    rows = spark.range(1 << 40).selectExpr("id + 1 AS id")
    for _ in range(8):
        rows = rows.crossJoin(rows.withColumnRenamed("id", "other")).select("id")
    assert estimated_bytes(rows) == BEYOND
