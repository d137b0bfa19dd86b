"""Mixing, fingerprints, resampling, decontamination, near-duplicates and the pipeline against plain versions."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from medspan.llm import op4_mixing as mixing
from medspan.llm import op5_merkle as merkle
from medspan.llm import op6_quality as quality
from medspan.llm import op8_decontaminate as leaks
from medspan.llm import op10_simhash as simhash
from medspan.llm.common import mix, word_hashes


def plain_targets(sizes: dict, cap=3):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > cap * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / w for s in free}
        fixed |= {s: cap * sizes[s] for s in over}


def test_mixing(spark, docs, no_docs, edge_rows):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(edge_rows) and sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(docs.repartition(5)).collect()))
    sizes, taken = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = plain_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    by_id = {(r.doc_id, r.size) for r in rows}
    assert by_id == {(x[0], len((x[1] or "").split())) for x in edge_rows}
    assert mixing.mix(no_docs).count() == 0
    whole = mixing.mixed(docs.withColumn("Size", F.lit("own")))
    assert whole.columns == [*docs.columns, "size", "source_size", "target", "taken", "whole"]
    small = lambda r: repr((r.doc_id, r.source, r.size, r.source_size, r.target, r.taken, r.whole))
    found = whole.collect()
    assert sorted(map(small, found)) == sorted(map(small, rows)) and sorted(repr(tuple(r)[:9]) for r in found) == sorted(map(repr, edge_rows))
    assert mixing.mixed(no_docs).count() == 0


def test_mixing_of_more_sources_than_are_broadcast(spark, docs, monkeypatch):
    want = sorted(map(repr, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 0)
    assert sorted(map(repr, mixing.mix(docs).collect())) == want


def test_water_fill_clamps_several_sources(spark):
    sizes = {f"s{i:02d}": v for i, v in enumerate([10, 10_000, 20, 15_000, 1, 9_000, 0])}
    totals = spark.createDataFrame([(s, v, (1, 2, 3)[i % 3]) for i, (s, v) in enumerate(sizes.items())], "source string, source_size long, weight int")
    got = {r.source: r.target for r in mixing.water_fill(totals).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_merkle(spark, docs, no_docs, edge_rows):
    out = merkle.fingerprints(docs).collect()
    assert len(out) == len(edge_rows)
    texts = {r.text for r in out}
    assert len({r.fingerprint for r in out}) == len(texts)
    ordered = sorted(((x[0], x[1] or "") for x in edge_rows), key=lambda x: (x[0] is not None, x[0] or 0))
    ids = [x[0] for x in ordered]
    for r in out:
        if r.doc_id is not None and ids.count(r.doc_id) == 1:
            i = ids.index(r.doc_id)
            after = ordered[(i + 1) % len(ordered)]
            if after[0] is not None and ids.count(after[0]) == 1:
                cut = len(r.text) // 4
                assert r.edited == r.text[: len(r.text) - cut] + after[1][:cut]
    assert merkle.fingerprints(no_docs).count() == 0
    one = merkle.fingerprints(docs.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].next_fingerprint == one[0].fingerprint


def plain_print(text):
    """The fingerprint with plain loops."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    sections = []
    for section in text.split("\n\n"):
        lines = []
        for line in section.split("\n"):
            phrases, own = [], ""
            for i, c in enumerate(line):
                own += c
                if (c in ".!?,;:|" and i + 1 < len(line) and line[i + 1] in " \t\n\x0b\x0c\r") or i + 1 == len(line):
                    phrases += [own[k : k + merkle.PHRASE] for k in range(0, len(own), merkle.PHRASE)]
                    own = ""
            digests = [sha(x) for x in phrases]
            lines.append((sha("P" + "".join(digests)), digests))
        sections.append((sha("S" + "".join(d for d, _ in lines)), lines))
    tree = "/".join(f"{d[:8]}=" + "|".join(" ".join([p[:8], *(x[:8] for x in leaves)]) for p, leaves in lines) for d, lines in sections)
    return sha("R" + "".join(d for d, _ in sections)) + ":" + tree


def plain_near(a, b):
    if a.split(":")[0] == b.split(":")[0]:
        return 1.0
    x, y = ({t for p in f.split(":")[1].replace("/", "|").split("|") for t in p.split("=")[-1].split(" ")[1:]} for f in (a, b))
    return 2.0 * len(x & y) / max(1, len(x) + len(y))


def test_merkle_equals_plain_trees(spark, docs):
    for r in merkle.fingerprints(docs).withColumn("near", merkle.likeness(F.col("fingerprint"), F.col("edited_fingerprint"))).collect():
        assert r.fingerprint == plain_print(r.text) and r.edited_fingerprint == plain_print(r.edited)
        assert r.near == pytest.approx(plain_near(r.fingerprint, r.edited_fingerprint))


def test_merkle_splits_a_repeated_id(spark, monkeypatch):
    monkeypatch.setattr(merkle, "ROWS_PER_RANGE", 4)
    texts = [(7 if i % 3 else None, f"text {i}") for i in range(90)]
    rows = spark.createDataFrame(texts, "doc_id long, text string").withColumn("tie", F.xxhash64("text"))
    seen = {r.text: (r.doc_id, r.tie) for r in rows.collect()}
    order = sorted(seen, key=lambda t: (seen[t][0] is not None, seen[t][0] or 0, seen[t][1]))
    dealt = merkle.with_next(rows, "doc_id", ["text"], "tie", lambda x: x.withColumn("task", F.spark_partition_id()))
    got = dealt.collect()
    assert {r.text: r.next.text for r in got} == dict(zip(order, order[1:] + order[:1], strict=True))


def test_merkle_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(merkle, "ROWS_PER_RANGE", 3)
    monkeypatch.setattr(merkle, "GROUP", 4)
    ids = random.Random(1).sample(range(-500, 10**12), 120)
    rows = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").withColumn("tie", F.lit(0))
    got = {r.doc_id: r.next.text for r in merkle.with_next(rows, "doc_id", ["text", "doc_id"], "tie").collect()}
    order = sorted(ids)
    assert got == {a: f"text {b}" for a, b in zip(order, order[1:] + order[:1], strict=True)}


def test_merkle_likeness_and_edits(spark):
    base = "First part. It has two.\nSecond line, here.\n\nNew section. End."
    pairs = [(base, base), (base, base.replace("Second", "Changed")), (base, ""), ("", ""), (base, "Nothing alike at all")]
    rows = spark.createDataFrame(pairs, "a string, b string")
    rows = merkle.with_fingerprint(merkle.with_fingerprint(rows, "a", "fa"), "b", "fb")
    got = rows.select(merkle.likeness(F.col("fa"), F.col("fb")).alias("l"), merkle.locate_edits(F.col("fa"), F.col("fb")).alias("e")).collect()
    assert [r.l == 1.0 for r in got] == [True, False, False, True, False]
    assert 0.5 < got[1].l < 1 and got[4].l == 0.0
    assert [tuple(x) for x in got[1].e] == [(0, 1)] and got[0].e == []
    lines = [f"Line {i}, of a text." for i in range(12)]
    longer = "\n".join([*lines[:3], "One more.", *lines[3:]])
    rows = spark.createDataFrame([(longer, "\n".join(lines)), ("A.\n\n" + longer, longer)], "a string, b string")
    rows = merkle.with_fingerprint(merkle.with_fingerprint(rows, "a", "fa"), "b", "fb")
    assert [[tuple(x) for x in r.e] for r in rows.select(merkle.locate_edits(F.col("fa"), F.col("fb")).alias("e")).collect()] == [[(0, 3)], [(0, 0)]]


def test_resampling(spark, docs, no_docs, edge_rows):
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(40)] + [(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    out = quality.resample(docs, labels).collect()
    assert len(out) == len(edge_rows) and sorted(map(repr, out)) == sorted(map(repr, quality.resample(docs.repartition(4), labels).collect()))
    assert all(r.n_grams == 0 and r.log_weight == 0 for r in out if r.doc_id in (50, 51))
    picked = [r.gumbel_key for r in out if r.selected]
    assert picked and min(picked) > max(r.gumbel_key for r in out if not r.selected)
    assert quality.resample(no_docs, labels).count() == 0
    assert quality.resample(docs, labels.limit(0)).where("log_weight <> 0").count() == 0


def test_kth_largest(spark):
    rng = random.Random(4)
    for values in ([rng.randint(-(10**9), 10**9) for _ in range(500)], [5] * 30, [1, 2, 2, 2, 3]):
        rows = spark.createDataFrame([(v,) for v in values], "v long")
        for k in (1, 2, len(values) // 2, len(values)):
            assert quality.kth_largest(rows, "v", k) == sorted(values, reverse=True)[k - 1]


def test_resampling_equals_plain_models(spark):
    rng = random.Random(14)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words[:20] if i % 2 else words) for _ in range(rng.randint(0, 30))) for i in range(80)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(500, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.resample(rows, labels).collect()}
    shift = 64 - quality.BUCKETS.bit_length() + 1
    hash_of = {w: int(word_hashes(np.frombuffer(w.encode(), dtype=np.uint8))[0][0]) for w in words}

    def buckets(text):
        own = [hash_of[w] for w in text.split()]
        pairs = [(a * 0xD6E8FEB86659FD93 + b) % 2**64 for a, b in zip(own, own[1:], strict=False)]
        return [x >> shift for x in own] + [int(mix(np.array([p], dtype=np.uint64))[0]) >> shift for p in pairs]

    target, raw = {}, {}
    for i, t in enumerate(texts):
        for b in buckets(t):
            raw[b] = raw.get(b, 0) + 1
            if i < 40 and i % 2:
                target[b] = target.get(b, 0) + 1
    n, m = sum(target.values()) + quality.BUCKETS, sum(raw.values()) + quality.BUCKETS
    for i, t in enumerate(texts):
        want = sum(math.log((target.get(b, 0) + 1) / n) - math.log((raw.get(b, 0) + 1) / m) for b in buckets(t))
        assert out[i].log_weight == pytest.approx(want, abs=1e-6) and out[i].n_grams == len(buckets(t))
    order = sorted(out.values(), key=lambda r: -r.gumbel_key)
    assert {r.doc_id for r in out.values() if r.selected} == {r.doc_id for r in order[: round(0.5 * len(out))]}


def plain_score(item, text):
    best = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item):
        for j, b in enumerate(text):
            best[i + 1][j + 1] = max(0, best[i][j] + (2 if a == b else -1), best[i][j + 1] - 1, best[i + 1][j] - 1)
    return max(map(max, best))


def test_alignment_equals_plain_smith_waterman():
    rng = np.random.default_rng(3)
    items = [rng.integers(2, 9, rng.integers(1, 14)).astype(np.uint64) for _ in range(80)]
    texts = [rng.integers(2, 9, rng.integers(1, 25)).astype(np.uint64) for _ in range(80)]
    points, first, last = leaks.align(items, texts)
    for x, y, p, f, e in zip(items, texts, points, first, last, strict=True):
        assert p == plain_score(x, y)
        assert p == 0 or plain_score(x, y[f:e]) == p


def test_decontamination(spark, docs, no_docs):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    items = [[word() for _ in range(n)] for n in (15, 30, 45)]
    fill = lambda n: [word() for _ in range(n)]
    edited = [w if i % 6 else word() for i, w in enumerate(items[1])]
    texts = {
        1: fill(20) + items[0] + fill(20), 2: fill(5) + edited + fill(50), 3: fill(100), 4: [w.upper() + "!!" for w in items[2]], 5: items[0] + fill(3) + items[2],
        6: items[1][:3] + fill(40), 7: fill(70_000) + items[1] + fill(70_000),
    }
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()] + [(8, None), (9, ""), (None, " ".join(items[2])), (5, " ".join(texts[5]))], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(7, None), (8, "two words")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.contaminated(rows, bench).collect()}
    assert got == {(1, 0), (2, 1), (4, 2), (5, 0), (5, 2), (7, 1), (None, 2)}
    assert {r.doc_id for r in leaks.clean(rows, bench).collect()} == {3, 6, 8, 9}
    assert leaks.contaminated(docs, bench).count() == 0 and leaks.contaminated(no_docs, bench).count() == 0 and leaks.contaminated(rows, bench.limit(0)).count() == 0


def test_decontamination_without_exact_seeds(spark, monkeypatch):
    """A benchmark of more seeds than are sent as hashes: the bit set alone thins, the join decides."""
    rng = random.Random(12)
    items = [[f"w{rng.randrange(400)}" for _ in range(rng.randint(8, 30))] for _ in range(40)]
    texts = [[f"w{rng.randrange(400)}" for _ in range(40)] + (items[i % 40] if i % 3 else []) for i in range(60)]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    want = sorted(map(tuple, leaks.contaminated(rows, bench).collect()))
    monkeypatch.setattr(leaks, "MAX_EXACT_SEEDS", 0)
    assert sorted(map(tuple, leaks.contaminated(rows, bench).collect())) == want and len(want) >= 40


def test_decontamination_finds_edited_copies_singly_and_in_thousands(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    fourth = lambda own: [w if (i + 1) % 4 else word() for i, w in enumerate(own)]
    items = [[word() for _ in range(20)] for _ in range(4)]
    # its only intact 3-gram in document 9000 is one that thousands of clean documents hold as well
    items[2][9:12] = ["of", "all", "the"]
    items += [[*(word() for _ in range(15)), "of", "all", "the"] for _ in range(leaks.FEW + 1)]
    lone = [w if i in (9, 10, 11) or i % 3 else word() for i, w in enumerate(items[2])]
    texts = [(0, fourth(items[0]))] + [(i, fourth(items[1]) + [word() for _ in range(5)]) for i in range(1, 3001)]
    texts += [(i, [word(), "of", "all", "the", word(), word()]) for i in range(3001, 6001)] + [(9000, lone), (9001, fourth(items[3]) + [word() for _ in range(300)])]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in leaks.contaminated(rows, bench).collect()}
    want = {(i, k): plain_score(items[k], t) / 40 for i, t in texts for k in ((0,) if i == 0 else (1,) if i <= 3000 else (2,) if i == 9000 else (3,) if i == 9001 else ())}
    assert min(want.values()) >= 0.5 and got == pytest.approx(want)


@pytest.mark.parametrize("broadcast", [0, leaks.MAX_BROADCAST_WORDS])
def test_decontamination_equals_all_pairs_and_finds_excerpts(spark, monkeypatch, broadcast):
    monkeypatch.setattr(leaks, "MAX_BROADCAST_WORDS", broadcast)
    monkeypatch.setattr(leaks, "PAIRS_AT_ONCE", 50)
    rng = random.Random(31)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(60)]  # many shared 3-grams
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(8, 70))] for _ in range(25)]
    texts = []
    for _ in range(120):
        own = list(rng.choice(items))
        at = rng.randrange(len(own))
        own = own[at : at + rng.randint(3, 40)]
        texts.append([w for w in own if rng.random() > 0.1] + [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))])
    grams = lambda t: {tuple(t[i : i + 3]) for i in range(len(t) - 2)}
    want, near = {}, set()
    for d, t in enumerate(texts):
        for k, item in enumerate(items):
            points = plain_score(item, t)
            if points >= min(len(item), 2 * leaks.EXCERPT):
                (near.add((d, k)) if not grams(item) & grams(t) else want.update({(d, k): points / (2 * len(item))}))
    assert any(s < 0.5 for s in want.values()) and not near  # a copy without an intact 3-gram is the stated limit
    rows = spark.createDataFrame([(i, " ".join(t), "x") for i, t in enumerate(texts)], "doc_id long, text string, mark string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in leaks.contaminated(rows, bench).collect()}
    assert got == pytest.approx(want, abs=1e-6)
    for limit in (0, 100):
        monkeypatch.setattr(leaks, "MAX_BROADCAST_MARKS", limit)
        left = leaks.clean(rows, bench)
        assert left.columns == rows.columns and {r.doc_id for r in left.collect()} == set(range(120)) - {d for d, _ in want}


def test_decontamination_judges_rows_that_share_a_key_each_by_itself(spark):
    item = "one quick brown fox jumps over the lazy dog near the old river bank"
    texts = [(None, item), (None, "a clean text without an id"), (None, None), (5, "first " + item), (5, "a clean text with the same id"), (5, None), (6, "a clean text without an id")]
    rows = spark.createDataFrame([(i, t, "kept") for i, t in texts], "doc_id long, text string, more string")
    left = leaks.clean(rows, spark.createDataFrame([(0, item)], "item_id long, text string"))
    assert left.columns == rows.columns
    assert sorted(map(repr, left.collect())) == sorted(repr(r) for r in rows.collect() if item not in (r.text or ""))


def plain_simhash(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    runs = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    bits = [sum(xxhash.xxh64_intdigest(r, 42) >> b & 1 for r in runs) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(runs))


def plain_components(prints):
    label = {p: p for p in prints}

    def root(p):
        while label[p] != p:
            p = label[p]
        return p

    for p in prints:
        for q in prints:
            if (p ^ q).bit_count() <= 4 and root(p) != root(q):
                label[max(root(p), root(q))] = min(root(p), root(q))
    return {p: root(p) for p in prints}


def test_simhash(spark, docs, no_docs, edge_rows, monkeypatch):
    monkeypatch.setattr(simhash, "TEXT_BLOCK", 50_000)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(edge_rows)
    prints = {x[0]: plain_simhash(x[1]) for x in edge_rows if x[0] is not None}
    root = plain_components(set(prints.values()) | {plain_simhash("no id the house")})
    for r in rows:
        if r.doc_id is not None:
            assert r.fingerprint == f"{prints[r.doc_id]:016x}"
            assert r.component_id == min(i for i, p in prints.items() if root[p] == root[prints[r.doc_id]])
    assert simhash.near_duplicates(no_docs).count() == 0


def test_simhash_of_rows_without_an_id(spark):
    texts = [(None, "one two three four five six"), (7, "one two three four five six"), (5, "one two three four five six"), (None, "quite another text that stands alone here"), (None, None), (None, "")]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(rows).collect()), key=str)
    root = plain_components({plain_simhash(t) for _, t in texts})
    least = {}
    for i, t in texts:
        if i is not None:
            least[root[plain_simhash(t)]] = min(i, least.get(root[plain_simhash(t)], i))
    assert got == sorted(((i, f"{plain_simhash(t):016x}", least.get(root[plain_simhash(t)])) for i, t in texts), key=str)


def plain_wide(texts):
    """Components of texts by the links that ``one_of_each`` is to use, over all pairs; as sets of positions."""
    prints = simhash.wide_prints(pa.array(texts, pa.string()))
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            bits = [int(x ^ y).bit_count() for x, y in zip(prints[i], prints[j], strict=True)]
            if min(bits[: simhash.ROUTE_WORDS]) <= simhash.ROUTE_DISTANCE and sum(bits) <= simhash.ALIKE_BITS and label[i] != label[j]:
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    return label


@pytest.mark.parametrize("limit", [0, simhash.MAX_BROADCAST])
def test_one_of_each(spark, docs, no_docs, edge_rows, monkeypatch, limit):
    monkeypatch.setattr(simhash, "MAX_BROADCAST", limit or 1)
    monkeypatch.setattr(simhash, "HUB", 2)  # every way of joining
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    groups: dict = {}
    for row, g in zip(edge_rows, plain_wide([x[1] for x in edge_rows]), strict=True):
        groups.setdefault(g, []).append(row)
    want = sorted((x for g in groups.values() for x in [min(g, key=lambda r: (r[0] is None, r[0] or 0))]), key=repr)
    got = sorted((tuple(r) for r in kept.collect()), key=repr)
    assert [x[0] for x in got] == [x[0] for x in want]
    assert simhash.one_of_each(no_docs).count() == 0


def test_one_of_each_finds_edited_copies_and_keeps_others(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7)))
    texts, sources = [], []
    for g in range(60):
        own = [word() for _ in range(400)]
        texts.append(own)
        sources.append(g)
        for _ in range(5):
            copy = list(own)
            for at in rng.sample(range(400), 4):  # similarity of about 0.9
                copy[at] = word()
            texts.append(copy)
            sources.append(g)
    rows = spark.createDataFrame([(i, " ".join(t), "x") for i, t in enumerate(texts)], "doc_id long, text string, mark string")
    left = [r.doc_id for r in simhash.one_of_each(rows).collect()]
    assert {sources[i] for i in left} == set(range(60))
    caught = 1 - (len(left) - 60) / 300
    assert caught > 0.95 and all(r.mark == "x" for r in simhash.one_of_each(rows).collect())


def test_wide_prints_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "bc", "def", "Ü"]) for _ in range(n)) for n in (0, 1, 3, 4, 5, 6, 50, 5000)] + [None]
    whole = simhash.wide_prints(pa.array(texts))
    assert not whole[0].any() and not whole[-1].any() and len({tuple(x) for x in whole.tolist()}) == 8
    from medspan.llm import common

    monkeypatch.setattr(common, "BLOCK_BYTES", 700)
    assert (simhash.wide_prints(pa.array(texts)) == whole).all()
    assert (simhash.wide_prints(pa.array([texts[-2].upper().replace("Ü", "Ü")])) == whole[-2]).all()


def test_gray_index_and_routing_lose_no_component(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centers = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    codes = set(map(int, centers)) | {0}
    for c in centers[:40]:
        at = int(c)
        for _ in range(rng.integers(1, 60)):
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                at ^= 1 << int(b)
            codes.add(at)
    codes = np.array(sorted(codes), dtype=np.uint64)
    want = plain_components(list(map(int, codes)))
    index = simhash.GrayIndex(codes)
    assert (np.diff(simhash.gray_rank(index.codes).astype(object)) > 0).all()
    q, m = index.pairs(np.arange(len(codes)), 4)
    near = np.bitwise_count(index.codes[:, None] ^ index.codes[None, :]) <= 4
    assert set(zip(q.tolist(), m.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True))
    label = index.labels(4)
    assert len(set(label.tolist())) == len(set(want.values()))
    frame = spark.createDataFrame([(int(c.view(np.int64)),) * 2 for c in codes], "mark long, fp long")
    for n, hot in ((len(codes), 1 << 20), (len(codes), 20), (10**8, 1 << 20), (10**10, 1 << 20), (10**13, 1 << 20)):  # each number of blocks, and hot cells
        monkeypatch.setattr(simhash, "HOT_CELL", hot)
        monkeypatch.setattr(simhash, "HOT_SAMPLE", 1 if hot == 20 else 64)
        found = {r.node: r.root for r in simhash.components(simhash.links(frame, n)).collect()}
        groups: dict = {}
        for c in codes:
            key = int(c.view(np.int64))
            groups.setdefault(found.get(key, key), set()).add(int(c))
        assert sorted(map(min, groups.values())) == sorted(set(want.values()))
