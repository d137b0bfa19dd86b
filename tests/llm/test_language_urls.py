from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from conftest import prose
from pyspark.sql import functions as F

from medspan.llm import op1_language as lang
from medspan.llm import op2_urls as urls


def test_language(spark, docs, no_docs, edge_rows):
    model = lang.train(docs.where(~lang.held_out(F.col("doc_id"))))
    assert model.langs == ["de", "en"]
    out = lang.identify(docs, model)
    assert out.columns == [*docs.columns, "lang_pred", "fit"]
    rows = out.collect()
    assert len(rows) == len(edge_rows)
    for r in rows:
        if r.text is None or not any(map(str.isalpha, r.text)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in model.langs and 0 <= r.score <= 1
            if r.doc_id is not None and r.doc_id < 40:
                assert r.lang_pred == r.lang
    kept = lang.accepted(docs, model)
    assert kept.columns == docs.columns and kept.where("score = 0.25").count() == kept.count() == len([r for r in rows if r.lang_pred != "und" and r.score >= 0.5 and r.fit >= lang.MIN_FIT])
    assert kept.where("doc_id < 40").count() == 40
    empty = lang.train(no_docs)
    assert {r.lang_pred for r in lang.identify(docs, empty).collect()} == {"und"} and lang.accepted(docs, empty).count() == len(edge_rows)
    assert lang.identify(no_docs, model).count() == 0


def scores(spark, texts, model):
    """lang_pred, score and fit of texts, as lists in their order."""
    found = lang.identify(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), model).orderBy("i").collect()
    return [r.lang_pred for r in found], [r.score for r in found], [r.fit for r in found]


def plain_scores(train_rows, texts):
    """Naive Bayes with a plain loop over n-grams; the bin of an n-gram as the operator computes it, character by character."""

    def bins(text):
        cut, framed, out = 32 - lang.BINS.bit_length() + 1, [ord(c) for c in f"\0{text.lower()}\0"], []
        wrap = lambda x: x & 0xFFFFFFFF
        for i in range(len(framed) - 1):
            two = wrap(framed[i] * 0x9E3779B1) ^ wrap(framed[i + 1] * 0x85EBCA6B)
            out.append(wrap(two * 0x165667B1) >> cut)
            if i + 2 < len(framed):
                out.append(wrap((wrap(two * 0xC2B2AE35) ^ wrap(framed[i + 2] * 0x27D4EB2F)) * 0x165667B1) >> cut)
        return out

    counts, rows = {}, {}
    for text, label in train_rows:
        rows[label] = rows.get(label, 0) + 1
        for b in bins(text) if text else ():
            counts.setdefault(label, {})[b] = counts.setdefault(label, {}).get(b, 0) + 1
    out = []
    for text in texts:
        if not text or not any(map(str.isalpha, text)):
            out.append(("und", 0.0, 0.0))
            continue
        log, grams = {}, bins(text)
        for label in sorted(counts):
            total = sum(counts[label].values()) + 0.5 * lang.BINS
            log[label] = math.log(rows[label] / sum(rows.values())) + sum(math.log((counts[label].get(b, 0) + 0.5) / total) for b in grams)
        best = max(sorted(log), key=log.get)
        out.append((best, 1 / sum(math.exp(v - log[best]) for v in log.values()), (log[best] - math.log(rows[best] / sum(rows.values()))) / len(grams) + math.log(lang.BINS)))
    return out


def test_scores_equal_plain_naive_bayes(spark):
    rng = random.Random(12)
    rows = [(i, prose(rng, "en" if i % 3 else "de", rng.randint(1, 12)), "en" if i % 3 else "de") for i in range(60)] + [(90, None, "en"), (91, "x", None), (92, "", "de")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang.train(frame)
    texts = [t for _, t, _ in rows] + ["Über das Haus", "zzz", "12", "qxj zkv wqx", "日本語のテキスト"]
    want = plain_scores([(t, k) for _, t, k in rows if k is not None and t is not None], texts)
    best, score, fit = scores(spark, texts, model)
    assert best == [w[0] for w in want]
    assert np.allclose(score, [w[1] for w in want]) and np.allclose(fit, [w[2] for w in want])
    assert max(fit[texts.index(t)] for t in ("日本語のテキスト", "qxj zkv wqx")) + 1 < min(f for f, (i, t, k) in zip(fit, rows, strict=False) if k and t and len(t) > 20)


def test_languages_in_blocks(spark):
    """Seven languages in blocks of two and three score as in one block, ties going to the first; texts without a letter have none."""
    rng, names = random.Random(5), ["aa", "b", "bb", "de", "en", "x", "z"]
    words = {n: ["".join(rng.choice("abcdefghijklmnop" if n != "z" else "abcdeöüß日本") for _ in range(rng.randint(2, 9))) for _ in range(30)] for n in names}
    rows = [(i, " ".join(rng.choices(words[n], k=rng.randint(3, 40))), n) for i, n in enumerate(names * 12)] + [(900 + i, "same text twice", n) for i, n in enumerate(("p", "q"))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = [t for _, t, _ in rows] + [None, "", "12 34", "Über das Haus"]
    whole = scores(spark, texts, lang.train(frame))
    assert whole[0] == [w[0] for w in plain_scores([(t, k) for _, t, k in rows], texts)] and whole[0][-4:-1] == ["und"] * 3
    assert whole[0][texts.index("same text twice")] == "p"
    for at_once in (2, 3):
        model = lang.train(frame, at_once=at_once)
        assert len(list(model.blocks())) == -(-len(model.langs) // at_once) and max(len(b.langs) for b in model.blocks()) == at_once
        cut = scores(spark, texts, model)
        assert cut[0] == whole[0] and np.allclose(cut[1], whole[1]) and np.allclose(cut[2], whole[2])
        assert lang.accepted(frame, model).count() == lang.accepted(frame, lang.train(frame)).count()


def test_more_labels_than_a_block_holds(spark):
    rows = spark.range(lang.BLOCK_LANGUAGES + 40).selectExpr("id AS doc_id", "concat('text', id, ' of ', id * 7919) AS text", "cast(id AS string) AS lang")
    model = lang.train(rows)
    assert model.langs == sorted(map(str, range(lang.BLOCK_LANGUAGES + 40)))
    assert lang.identify(rows, model).where("lang_pred = lang").count() == lang.BLOCK_LANGUAGES + 40


def test_scores_do_not_depend_on_blocks_of_text(spark, docs):
    model = lang.train(docs)
    texts = ["the house over the river", None, "haus und fluss", "x" * 700_000 + " the house"]
    block = next(model.blocks())
    whole = lang.score_block(texts, block).to_pylist()
    assert [lang.score_block([t], block).to_pylist()[0]["lang"] for t in texts] == [w["lang"] for w in whole]
    assert sum(len(two) - (two == lang.BINS).sum() for _, _, two, _ in lang._blocks(texts, 64)) == sum(len(t) + 1 for t in texts if t)


def test_held_out_is_crc32(spark):
    rows = spark.range(200).select("id", lang.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)


def _host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


def _rule(host, path):
    fits = [(len(h + p), h + p, a) for a, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


def test_url_filter(spark):
    given = [
        None, "", "no scheme", "http://Example.ORG/es/x", "http://example.org/en/17?q#f", "http://a.example.org/en/2", "https://x.com/fr/a://b", "https://x.com/de/", "https://com/de/", "http://org", "http://notorg/x",
        "ftp://ÄB.Com/de/q", "http://free-casino-bonus.example.net/en/1", "http://library.example.net/en/1", "http://x.net?u=http://y.org/z", "http://x.net#/a", "http://x.net", "http://x.net", "http://" + "a" * 20_000 + ".net/" + "b" * 1000,
    ]
    weights, intercept = urls.train(urls.seed_table(spark))
    pages = spark.createDataFrame([(i, u, "own", "own") for i, u in enumerate(given)], "page_id long, url string, host string, verdict string")
    for r in urls.judge(pages, weights, intercept).collect():
        assert (r.host, r.path) == _host_path(r.url), r.url
        rule = _rule(r.host, r.path)
        assert r.rule == (rule[0] if rule else None)
        assert r.verdict == (rule[1] if rule else "block" if r.score >= 0.8 else "allow")
    by_url = {r.url: r.verdict for r in urls.judge(pages, weights, intercept).collect()}
    assert by_url["http://free-casino-bonus.example.net/en/1"] == "block" and by_url["http://library.example.net/en/1"] == "allow"
    assert urls.judge(pages.limit(0), weights, intercept).count() == 0
    clash = pages.selectExpr("page_id", "url AS host", "'b' AS bins", "'h' AS hit", "'a' AS address")
    own = urls.judge(clash, weights, intercept, url="host")
    assert own.columns == [*clash.columns, "path", "score", "rule", "verdict"] and {(r.bins, r.hit, r.address) for r in own.collect()} == {("b", "h", "a")}


def plain_bins(host, path):
    def hashed(part, gram):
        first = xxhash.xxh64(part.encode(), seed=42).intdigest()
        value = xxhash.xxh64(gram.encode(), seed=first).intdigest()
        return (value - (1 << 64) if value >> 63 else value) % urls.BINS

    zero = str.maketrans("123456789", "0" * 9)
    named = host.rsplit(".", 1)[0] if "." in host else host
    texts = {"host": f"^{named}$".translate(zero), "path": f"{path}$".translate(zero)}
    return {hashed(part, t[i : i + n]) for part, t in texts.items() for n in urls.ORDERS for i in range(len(t) - n + 1)}


def test_url_scores_equal_a_plain_model(spark):
    weights, intercept = urls.train(urls.seed_table(spark))
    given = [*urls.UNWANTED_URLS[:20], *urls.ORDINARY_URLS[:20], "", "http://x", "http://Ünï.example/ä?q"]
    pages = spark.createDataFrame([(u,) for u in given], "url string")
    for r in urls.judge(pages, weights, intercept, rules=[]).collect():
        bins = plain_bins(*_host_path(r.url))
        want = 1 / (1 + math.exp(-(sum(weights[b] for b in bins) / max(1, len(bins)) ** 0.5 + intercept)))
        assert r.score == pytest.approx(want, abs=2e-6), r.url


def test_urls_held_out_of_training_are_told_apart(spark):
    rows, right = urls.seed_rows(), 0
    for fold in range(4):
        known = [r for i, r in enumerate(rows) if i % 4 != fold]
        model = urls.train(spark.createDataFrame(known, "url string, label int"))
        held = spark.createDataFrame([r for i, r in enumerate(rows) if i % 4 == fold], "url string, label int")
        right += urls.judge(held, *model, rules=[], threshold=0.5).where("(verdict = 'block') = (label = 1)").count()
    print("held-out accuracy", right / len(rows))
    assert right / len(rows) > 0.9


def test_long_rule_lists_are_looked_up_by_host(spark, monkeypatch):
    """Rules by join, broadcast and shuffled, against the literal expression; ties, subdomains and rows that share a url."""
    rng = random.Random(6)
    hosts = ["com", "org", "a.com", "b.a.com", "x.org", "news.x.org", "co.uk", "y.co.uk", "very.long.host.name.example"]
    rules = sorted({(rng.choice(["allow", "block"]), rng.choice(hosts), rng.choice(["", "/", "/a", "/a/b", "/a/b/c", "/c"])) for _ in range(60)})
    urls_ = [f"http://{rng.choice(['', 'www.', 'B.', 'x'])}{rng.choice(hosts)}{rng.choice(['', '/', '/a', '/a/b/c?x', '/c#y', '/d'])}" for _ in range(300)] + [None, "", "no address", "http://", "http://.com/a", "http://com./a"]
    pages = spark.createDataFrame([(i % 250, u) for i, u in enumerate(urls_)], "page_id long, url string")
    weights = [0.0] * urls.BINS
    results = []
    for literal, broadcast in ((10_000, 0), (0, 10_000), (0, 0)):
        monkeypatch.setattr(urls, "LITERAL_RULES", literal)
        monkeypatch.setattr(urls, "BROADCAST_RULES", broadcast)
        results.append(sorted(map(str, urls.judge(pages, weights, 0.0, rules).collect())))
    assert results[0] == results[1] == results[2] and len(results[0]) == len(urls_)
