"""Secrets, personal data and token counts against plain versions of their contracts."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from medspan.llm import op3_secrets as secrets
from medspan.llm import op7_tokens as tokens
from medspan.llm import op9_pii as pii

SECRET_PATTERNS = [("assign", r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+")]
PII_PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def _luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def _passes(kind, m):
    digits = re.sub("[^0-9]", "", m[0])
    if kind == "assign":
        return len(m[2]) >= 8
    if kind == "access":
        return len(m[0]) >= 16
    if kind == "hex":
        return len(m[0]) >= 32
    if kind == "ip":
        return all(int(p) <= 255 for p in m[0].split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and _luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def plain_spans(text, patterns):
    found = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(patterns) for m in re.finditer(p, text or "") if _passes(kind, m)]
    return [(patterns[k][0], s, e) for s, k, e in sorted(found)]


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def noise(rng, pieces):
    return "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))


SECRET_PIECES = ["token", "Secret", "api_key", "APIKEY", "ſecret", "paſſword", "passwd", '"', "'", " ", ":", "=", "é", "AKIA", "ABCDEF123456", "AKIA0", "0a1b2c3d4e5f", "deadbeefdeadbeef", "deadbeefdeadbeef01", "xYz+/=._-", "a", "Z9", "\n", "hello_world_name"]
PII_PIECES = ["a.b", "_d", "@", "mail", ".com", ".", "-", "+1", "+", "(555)", " ", "555", "1234", "4111111111111111", "192.168", ".0", ".1", "256", "007", "é", "x", "\n", "555-1234", "Mr. ", "James Smith"]


def check_spans(spark, column, patterns, kinds, texts, counts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    for r in frame.select("text", column(F.col("text")).alias("r")).collect():
        want = plain_spans(r.text, patterns)
        assert r.r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest(), repr(r.text)
        assert [r.r[c] for c in counts] == [sum(k == kind for k, _, _ in want) for kind in kinds[: len(counts)]]
        got = [s.split(":") for s in r.r.spans.split(",") if s]
        base = [tuple(s) for s in got if s[0] in kinds[: len(counts)]]
        assert base == [(k, str(s), str(e)) for k, s, e in want]
        for kind, s, e in got:
            if kind not in kinds[: len(counts)]:
                assert all(int(e) <= bs or be <= int(s) for _, bs, be in want)


def test_secrets_match_plain_patterns(spark, docs, no_docs):
    rng = random.Random(5)
    texts = [noise(rng, SECRET_PIECES) for _ in range(600)] + [None, "", "token=" + "a" * 300_000, "f" * 200_000 + "é" + "0" * 40]
    check_spans(spark, lambda c: secrets.secret_column(spark, c), SECRET_PATTERNS, secrets.KINDS, texts, ("n_assign", "n_access", "n_hex"))
    assert secrets.find_secrets(docs).count() == docs.count()
    assert secrets.find_secrets(no_docs).count() == 0


def test_markov_models_tell_random_from_names():
    tables = secrets.train(secrets.labelled_samples())
    held = secrets.labelled_samples(seed=99, per_kind=300)
    long = [(t, k) for t, k in held if len(t) >= secrets.MIN_TOKEN]
    right = [secrets.is_random(t.encode(), tables) == (k != "ordinary") for t, k in long]
    assert sum(right) / len(right) > 0.97


def test_pii_matches_plain_patterns(spark, docs, no_docs):
    rng = random.Random(6)
    texts = [noise(rng, PII_PIECES) for _ in range(600)]
    texts += [None, "", "a" * 3000 + " x@y.zz", "1" * 3000, "1." * 1000, "+1" + " " * 1000, "x@y.z_w@v.u", "call (555) 123-4567 now", "reach joe [at] mail [dot] com", "mail a@b.cc, ip 10.0.0.1, card 4111 1111 1111 1111, tel +1 (555) 010-9999"] * 3
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = pii.learn(frame)
    check_spans(spark, lambda c: pii.pii_column(spark, c, model), PII_PATTERNS, pii.KINDS, texts, ("n_email", "n_ip", "n_card", "n_phone"))
    assert pii.find_pii(docs, pii.learn(docs)).count() == docs.count()
    assert pii.find_pii(no_docs, pii.learn(no_docs)).count() == 0
    clean = pii.redacted(frame, model)
    assert clean.columns == frame.columns
    for r in clean.collect():
        assert (r.text is None) == (texts[r.doc_id] is None)
        if r.text is not None and len(r.text) < 1000 and not plain_spans(texts[r.doc_id], PII_PATTERNS):
            continue
        if r.text is not None and len(r.text) < 200:
            assert not plain_spans(r.text, PII_PATTERNS[:1])


def test_random_keys_within_longer_runs_are_found():
    tables = secrets.train(secrets.labelled_samples())
    rng = random.Random(3)
    found = 0
    for _ in range(100):
        key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(28))
        text = f"see reset/confirm/account/{key} and administration_service_request_handler_name={key}".encode()
        got = [(text[s:e]).decode() for a, b in ((4, 54), (59, len(text))) for s, e in secrets.random_spans(text, a, b, tables, secrets.MIN_TOKEN)]
        found += sum(key in g for g in got)
    assert found >= 190
    ordinary = b"international_organization_understanding/administration/responsibilities/communications"
    assert secrets.random_spans(ordinary, 0, len(ordinary), tables, secrets.MIN_TOKEN) == []


def test_spans_answer_overlaps_and_gaps():
    from medspan.llm.common import Spans

    rng = random.Random(7)
    for _ in range(300):
        spans = [(a, a + rng.randint(1, 9)) for a in (rng.randint(0, 60) for _ in range(rng.randint(0, 6)))]
        lo = rng.randint(0, 60)
        hi = lo + rng.randint(1, 20)
        held = Spans(spans)
        assert held.meets(lo, hi) == any(s < hi and lo < e for s, e in spans)
        free = [i for i in range(lo, hi) if not any(s <= i < e for s, e in spans)]
        assert [i for a, b in held.gaps(lo, hi) for i in range(a, b)] == free


def test_scans_take_linear_time_on_megabytes_of_matches():
    import time

    import numpy as np

    model, tables = pii.SpanModel(np.ones(pii.FEATURES), 1.0), secrets.train(secrets.labelled_samples())
    for unit in ("mail a@b.cc or 555-123-4567, ", "10.0.0.1 Dr Smith "):
        text = (unit * (1_000_000 // len(unit))).encode()
        began = time.time()
        base, added = pii.spans_of(text, sum(map(str.isdigit, unit)) * (len(text) // len(unit)), model)
        assert base and added and time.time() - began < 8
    began = time.time()
    got = secrets.scan(pa.array(["token=abcdefgh12 qZ7xK2mW9pL4vT8nB3rY6sJ5 " * 25_000]), tables)
    assert got[0]["n_assign"].as_py() == 25_000 and got[0]["spans"].as_py().count("random") > 20_000 and time.time() - began < 8


def test_names_are_whole_words_in_any_language():
    for text, want in ((b"Dr M\xc3\xbcller went", b"Dr M\xc3\xbcller"), ("Señora Gonzáles-Ñúñez dijo".encode(), "Señora Gonzáles-Ñúñez".encode()), (b"Mme D'Arc " + b"x", b"Mme D'Arc"), (b"Mr " + b"A" + b"b" * 50 + b"!", b"Mr A" + b"b" * 50)):
        assert [text[s:e] for k, s, e, _ in pii.matches(text, 0) if k == 7] == [want]


def test_other_vocabularies_are_refused(tmp_path):
    import json

    import pytest

    spec = json.load(open(tokens.default_path(), encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"byte_fallback": True}}):
        with pytest.raises(ValueError, match="byte-level"):
            tokens.check(spec | change)


def test_pii_takes_linear_time_on_any_text():
    import time

    began = time.time()
    for text in ("a" * 2_000_000 + " x@y.zz", "1" * 2_000_000, "1." * 300_000, "+1" + " " * 1_000_000, "a." * 500_000 + "@b"):
        pii.matches(text.encode(), sum(map(str.isdigit, text[:2000])))
    assert time.time() - began < 30


def test_redaction_merges_overlaps():
    assert pii.redact_text(b"ab 12345 cd", [(3, 2, 8), (5, 1, 7)]) == b"ab [CARD] cd"
    assert pii.redact_text(b"abc", []) == b"abc"


def test_em_finds_the_reliable_labeler():
    import numpy as np

    rng = random.Random(1)
    rows = {}
    for _ in range(4000):
        y = rng.random() < 0.4
        votes = tuple(2 if (y if rng.random() < p else not y) else 1 for p in (0.95, 0.8, 0.8, 0.6))
        rows.setdefault(votes, [0, 0])[y] += 1
    table = np.array(list(rows))
    n = np.array([sum(v) for v in rows.values()], dtype=float)
    post = pii.em(table, n)
    right = sum(v[int(p >= 0.5)] for v, p in zip(rows.values(), post, strict=True)) / n.sum()
    assert right > 0.93


def test_token_counts_equal_the_library(spark, docs, no_docs):
    from tokenizers import Tokenizer

    path = tokens.default_path()
    library = Tokenizer.from_file(path)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    rows = tokens.count_tokens(docs, path).collect()
    for r in rows:
        text = r.text or ""
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (count(text), len(text.encode()), count(text) > tokens.LIMIT)
        assert count(text[: r.fit_chars]) <= tokens.LIMIT
    assert tokens.count_tokens(no_docs, path).count() == 0
    made, rng = tokens.PrefixCounter(path), random.Random(2)
    pieces = [*"abcdeé\n\t  '’sreld09!?_-ñ中\u0558\U0001f600<|>", "'re", "'ll", "<|endoftext|>", "  ", "the ", " and", "ing", "\U0001e030"]
    for _ in range(400):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 22)))
        assert made.count(text, 3)[0] == count(text)
        assert list(made.all_prefixes(text)) == [(p, count(text[:p])) for p in range(len(text) + 1)], repr(text)
    long = "word " * 300_000 + "x" * 50_000
    assert made.count(long, 1024)[0] == count(long)
    letters = "".join(rng.choice(string.ascii_lowercase) for _ in range(3000))
    assert made.at_prefix(letters, 1500) == count(letters[:1500])


def test_short_random_strings_are_told_from_ordinary_ones():
    """Held-out strings of 12 to 19 characters: nine in ten random ones and more are found, and no ordinary one is."""
    tables = secrets.train(secrets.labelled_samples())
    held = secrets.labelled_samples(seed=99, per_kind=400)
    for n in range(12, 20):
        found = [secrets.is_random(t[:n].encode(), tables) for t, k in held if k != "ordinary"]
        assert sum(found) > 0.9 * len(found)
        assert not any(secrets.is_random(t[:n].encode(), tables) for t, k in held if k == "ordinary" and len(t) >= n)
    text = b"see reset/confirm/qZ7xK2mW9pL4vT8n/next and user_name_of_account"
    assert [text[a:b] for a, b in secrets.random_spans(text, 4, 39, tables, secrets.MIN_TOKEN)] == [b"qZ7xK2mW9pL4vT8n"]


def _plain_candidates(text):
    """(kind, start, end, valid) by plain patterns; ASCII texts."""
    loose = [(k, re.compile(p.pattern.decode("latin-1"))) for k, p in ((4, pii.LOCAL_PHONE), (5, pii.IDENTITY), (6, pii.HIDDEN_EMAIL), (7, pii.TITLED), (7, pii.NAMED))]
    out = [(k, m.start(), m.end(), _passes(name, m)) for k, (name, p) in enumerate(PII_PATTERNS) for m in re.finditer(p, text) if name != "card" or len(re.sub("[^0-9]", "", m[0])) >= 14]
    return out + [(k, m.start(), m.end(), True) for k, p in loose for m in p.finditer(text)]


def _touching(text, i):
    if not 0 <= i < len(text) or text[i].isspace():
        return "space"
    return "digit" if text[i].isdigit() else "letter" if text[i].isalpha() else "mark"


def _plain_votes(text, kind, start, end, valid):
    """Each labeler: None, False or True."""
    own, before = text[start:end], text[max(0, start - 40) : start]
    digits = re.sub("[^0-9]", "", own)
    domain = re.split("[^a-z]+", own.lower())[-1].encode() in pii.TOP_DOMAINS
    known = any(n.decode() in own for n in pii.GIVEN_NAMES)
    near, far = (re.search(p.pattern.decode(), before) for p in (pii.TRIGGERS, pii.COUNTER_TRIGGERS))
    dull = len(set(digits)) <= 2 or own[:2] == "0." or own[:4] == "127."
    return (
        valid if kind < 4 else None,
        domain if kind in (0, 6) else True if kind == 7 and known else None,
        True if near else False if far else None,
        not {_touching(text, start - 1), _touching(text, end)} & {"digit", "letter"},
        None if not digits else False if dull else True if set(own) & set(" ().-") else None,
    )


def _plain_features(text, kind, start, end):
    own, words = text[start:end], re.findall("[a-z]+", text[max(0, start - 40) : start].lower())[-3:]
    digits, marks = sum(map(str.isdigit, own)), sum(not c.isalnum() for c in own)
    side = ["space", "digit", "letter", "mark"]
    fixed = {kind, 8 + min(7, len(own) // 4), 16 + min(4, 5 * digits // len(own)), 21 + min(4, marks), 26 + side.index(_touching(text, start - 1)), 31 + side.index(_touching(text, end))}
    return frozenset(fixed | {36 + zlib.crc32(w.encode()) % (pii.FEATURES - 36) for w in words})


def _plain_posteriors(patterns):
    """EM over counts of vote patterns, labelers independent given the truth."""
    post = {v: min(0.95, max(0.05, 0.5 + 0.2 * (v.count(True) - 1.5 * v.count(False)))) for v in patterns}
    for _ in range(60):
        prior = sum(n * post[v] for v, n in patterns.items()) / sum(patterns.values())
        mass = {}
        for v, n in patterns.items():
            for k, vote in enumerate(v):
                for truth, w in ((True, n * post[v]), (False, n * (1 - post[v]))):
                    mass[k, vote, truth] = mass.get((k, vote, truth), 0.0) + w
        rate = lambda k, vote, truth: (mass.get((k, vote, truth), 0.0) + 1) / (sum(mass.get((k, x, truth), 0.0) for x in (None, False, True)) + 3)  # noqa: E731, B023
        made = {}
        for v in patterns:
            yes, no = math.log(prior + 1e-9), math.log(1 - prior + 1e-9)
            for k, vote in enumerate(v):
                yes, no = yes + math.log(rate(k, vote, True)), no + math.log(rate(k, vote, False))
            made[v] = 1 / (1 + math.exp(no - yes))
        post = made
    return post


def _plain_classifier(rows):
    """Logistic regression by gradient steps on (features, target, weight)."""
    weights, bias, total = [0.0] * pii.FEATURES, 0.0, sum(n for _, _, n in rows)
    for step in range(300):
        rate, slope, shift = 2.0 / (1 + step / 100), [1e-4 * w for w in weights], 0.0
        for features, target, n in rows:
            off = n * (1 / (1 + math.exp(-bias - sum(weights[f] for f in features))) - target) / total
            shift += off
            for f in features:
                slope[f] += off
        weights, bias = [w - rate * s for w, s in zip(weights, slope, strict=True)], bias - rate * shift
    return weights, bias


def test_added_spans_equal_a_plain_learner(spark):
    """Votes, reliabilities, classifier and added spans against plain loops, on notes where some loose candidates are right and some not."""
    rng = random.Random(77)
    digits = lambda *sizes, sep="-": sep.join("".join(rng.choices(string.digits, k=n)) for n in sizes)
    makers = [
        lambda: f"call {digits(3, 3, 4, sep=rng.choice('-. '))}", lambda: f"order {digits(3, 3, 4)}", lambda: f"version {digits(3, 2, 4)}", lambda: f"ssn {digits(3, 2, 4)}",
        lambda: f"mail anna{digits(2)}@mail.{rng.choice(['com', 'org', 'qqq'])}", lambda: f"write to joe (at) host{digits(1)} (dot) {rng.choice(['com', 'zzz'])}", lambda: f"from {rng.choice(['Dr. Karen Hill', 'Mr Stone', 'Linda Smith'])},",
        lambda: f"chapter {rng.choice(['Dr No', 'Prof Xav'])}", lambda: f"server {digits(2, 2, 1, 2, sep='.')}", lambda: f"version {rng.randint(300, 999)}.{digits(1, 1, 1, sep='.')}", lambda: f"phone +{digits(2, 4, 6, sep=' ')}", lambda: f"item +{digits(1, 2)}", lambda: f"card {digits(4, 4, 4, 4, sep=' ')}",
    ]
    texts = ["; ".join(rng.choice(["nothing here", "we went on", *(m() for m in rng.sample(makers, 4))]) for _ in range(rng.randint(1, 5))) + "." for _ in range(400)]
    found = [(t, c, _plain_votes(t, *c), _plain_features(t, *c[:3])) for t in texts for c in _plain_candidates(t)]
    post = _plain_posteriors(Counter(v for _, _, v, _ in found))
    weights, bias = _plain_classifier([(f, post[v], n) for (v, f), n in Counter((v, f) for _, _, v, f in found).items()])
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.learn(frame)
    assert abs(model.bias - bias) < 1e-6 and max(abs(a - b) for a, b in zip(model.weights, weights, strict=True)) < 1e-6
    got = {r.doc_id: r.spans for r in pii.find_pii(frame, model).collect()}
    taken = dropped = 0
    for i, text in enumerate(texts):
        own = [(c, f) for t, c, _, f in ((t, c, _plain_votes(t, *c), _plain_features(t, *c[:3])) for t in (text,) for c in _plain_candidates(text))]
        base = [(s, k, e) for (k, s, e, valid), _ in own if k < 4 and valid]
        loose = {(s, k, e): bias + sum(weights[x] for x in f) > 0 for (k, s, e, _), f in own if k >= 4 and not any(s < b[2] and b[0] < e for b in base)}
        taken, dropped = taken + sum(loose.values()), dropped + sum(not x for x in loose.values())
        assert got[i] == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(base + [x for x, yes in loose.items() if yes])), text
    assert taken > 50 and dropped > 20
