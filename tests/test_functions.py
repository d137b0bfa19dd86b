from __future__ import annotations

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from medspan.functions import dose, textnorm
from medspan.functions import lexicon as lx
from medspan.operators import mentions, projection, ranking, vectors

NORMS = [("Lipitor™ 20 mg", "lipitortm 20 mg"), ("875–125 mg", "875125 mg"), ("5 µg", "5 g"), ("2.5 mg/5 ml", "2 5 mg 5 ml"), ("heiß", "hei"), ("½ ﬁ Ⅷ Ａ", "12 fi viii a"), ("ασ", "a"), ("", ""), (None, None)]


def column(spark, values, expression, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r.x for r in frame.select("i", expression.alias("x")).orderBy("i").collect()]


def test_normalize(spark):
    assert column(spark, [a for a, _ in NORMS], textnorm.normalize(F.col("t"))) == [b for _, b in NORMS]
    assert [textnorm.normalize_py(a) for a, _ in NORMS if a is not None] == [b for _, b in NORMS if b is not None]


def test_normalize_agrees_with_unicode_tables(spark):
    chars = [chr(c) for c in range(128, 0x2FFF) if unicodedata.decomposition(chr(c))]
    lines = ["a".join(chars[i : i + 40]) for i in range(0, len(chars), 40)]
    assert column(spark, lines, textnorm.normalize(F.col("t"))) == [textnorm.normalize_py(x) for x in lines]


@pytest.mark.parametrize(
    ("text", "want"),
    [("m e t f o r m i n 500mg", "metformin 500 mg"), ("sodium chloride", "sodiumchloride"), ("losrtan 5omg", "losartan 5 0mg"), ("hctz 12.5", "hydrochlorothiazide 12 5"), ("5 m c g", "5 mcg"), ("take po daily", "take po daily"), ("lipi tor x", "lipitor x"), ("", "")],
)
def test_noisy(text, want):
    assert textnorm.noisy_py(text) == want


def test_context_and_jaccard(spark):
    assert column(spark, ["metformin po bid", "po", ""], textnorm.strip_context(F.col("t"))) == ["metformin", "", ""]
    distinct = lambda c: F.array_distinct(textnorm.words(c))
    assert column(spark, ["a b c", "", "x"], projection.word_jaccard(distinct(F.col("t")), distinct(F.lit("b c d")))) == [0.5, 0.0, 0.0]
    line = "x. amlodipine 2.5 mg but not now"
    assert column(spark, [line], textnorm.clause_around(F.col("t"), F.lit(3), F.lit(13))) == ["amlodipine 2"]
    assert column(spark, [line], textnorm.segment_around(F.col("t"), F.lit(3), F.lit(13))) == ["x. amlodipine 2.5 mg"]


def test_doses(spark):
    t = F.col("t")
    assert column(spark, ["metformin 1 G / x 500 MCG", "none", None], dose.strengths_mg(t)) == [[0.5, 1000.0], [], None]
    values = [500.0, 0.0125, 0.004, 2.5, 1.23456789, 0.00002, 1234567.5]
    assert column(spark, values, dose.canonical_number(t), "double") == [f"{v:.6g}" if v != int(v) else str(int(v)) for v in values]
    assert set(column(spark, ["2 5 mg"], dose.strength_signatures(t))[0]) == {"2mg", "2000mcg", "5mg", "5000mcg"}
    assert column(spark, ["10 mg/dl", "10 mg po"], dose.strength_tokens(t)) == [[], ["10 mg"]]
    assert column(spark, [106.0, 107.0], dose.close(F.array(F.lit(100.0)), t), "double") == [True, False]
    assert column(spark, ["24 hr oral capsule", "plain"], dose.form_flags(t)) == [["capsule", "xl24", "er", "oral"], []]


def test_records(spark):
    rows = spark.createDataFrame([(0, "MED|Aspirin|81 mg|PO|daily|active"), (1, "RXE|1|Aspirin^81 mg^PO^daily"), (2, "MED|Aspirin"), (3, None)], "i int, t string")
    got = [tuple(r) for r in dose.with_record(rows, "t").orderBy("i").select("structured", "record_name", "record_route", "record_schedule", "record_status").collect()]
    assert got == [(True, "Aspirin", "po", "daily", "active"), (True, "Aspirin", "po", "daily", ""), (False, None, "", "", ""), (False, None, "", "", "")]


def test_display_text_and_spans():
    assert mentions.display_text('<a value="active"/><b value="2020-01-01"/><c value="Metformin &amp; more"/>') == "Metformin & more"
    assert mentions.display_text(" plain ") == "plain"
    assert not mentions.span_allowed("a, b") and mentions.span_allowed("a, b and c")
    assert [m[0] for m in mentions._TOKEN.finditer("10mg/5ml 2.5/10 5%")] == ["10mg/5ml", "2.5", "10", "5"]


def test_negation(spark):
    rows = [("Patient denies metformin.", "metformin", True), ("no aspirin but metformin daily", "metformin", False), ("metformin was held", "metformin", True), ("med|metformin was held", "metformin", False), ("denies asa", "aspirin", False)]
    frame = spark.createDataFrame([(i, t, t.find(a) if a in t else 7, n) for i, (t, a, n) in enumerate(rows)], "i int, line_text string, start int, want boolean")
    frame = frame.withColumns({"end": F.col("start") + 3, "line_start": F.lit(0), "norm_text": F.element_at(F.array(*[F.lit(a) for _, a, _ in rows]), F.col("i") + 1)})
    got = mentions.with_negation(frame).orderBy("i").collect()
    assert [r.negated for r in got] == [n for *_, n in rows]


def test_similarity_of_pairs_equals_the_plain_ratio(spark):
    from difflib import SequenceMatcher

    rng = random.Random(2)
    texts = ["", "metformin 500 mg", "metformin hydrochloride", *("".join(rng.choice("abcdef 12") for _ in range(rng.choice([5, 40, 260]))) for _ in range(40))]
    pairs = [(rng.choice(texts), rng.choice(texts)) for _ in range(200)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, norm_text string, best_name string")
    got = {r.i: r.name_similarity for r in ranking.with_similarity(rows).collect()}
    for i, pair in enumerate(pairs):
        x, y = (textnorm.noisy_py(t).replace(" ", "") for t in pair)
        assert got[i] == (SequenceMatcher(None, x, y).ratio() if x and y else 0.0)


def test_negation_by_places_equals_the_patterns(spark):
    rng = random.Random(3)
    vocabulary = "no denies not taking on off hold held stopped allergic to aspirin aspirin but though x y z 81 mg w v u".split()

    def plain(clause):
        cue = re.search(rf"\b(?:{lx.NEGATION_CUES})\b(?:\s+\w+){{0,8}}\s+\baspirin\b", clause)
        if cue and not re.search(lx.NEGATION_BREAKS, cue[0]):
            return True
        return bool(re.search(rf"\baspirin\b(?:\s+\w+){{0,6}}\s+\b(?:{lx.LATE_NEGATIONS})\b", clause))

    clauses = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 22))) for _ in range(4000)]
    got = column(spark, clauses, mentions.negated_words(textnorm.words(F.col("t")), F.lit("aspirin")))
    assert [bool(g) for g in got] == [plain(c) for c in clauses]
    assert sum(map(plain, clauses)) > 500


def test_repair_equals_its_plain_twin(spark):
    rng = random.Random(8)
    parts = "metformin aspirin asa hctz lipi tor sodium chloride po er of the 500 5omg 10mg m e t c g mc l mg café naïve x oo o omg - / Losrtan and é amx clv pill with river house ﬁn".split()
    texts = [None, "", "  ", *(" ".join(rng.choice(parts) for _ in range(rng.randint(0, 16))) for _ in range(4000)), " ".join(rng.choice(parts) for _ in range(20_000))]
    assert column(spark, texts, textnorm.noisy(F.col("t"))) == [None if t is None else textnorm.noisy_py(t) for t in texts]


def test_vectors(spark):
    import hashlib

    import numpy as np

    grams = [f" {w} "[i : i + n] for w in ["metformin"] for n in (3, 4, 5) for i in range(len(w) + 3 - n)]
    plain = np.zeros(256)
    for g in grams:
        h = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little")
        plain[h % 256] += -1 if h & (1 << 63) else 1
    got = column(spark, ["metformin", "", None], vectors.embed(F.col("t"), 256))
    assert np.allclose(got[0], plain / np.linalg.norm(plain), atol=1e-6) and abs(np.linalg.norm(got[0]) - 1) < 1e-6
    assert not any(got[1]) and not any(got[2])
    concepts = spark.createDataFrame([(str(i), [float(i % 5), 1.0]) for i in range(40)], "concept_id string, vec array<float>")
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query string, vec array<float>")
    whole = [tuple(r) for r in vectors.nearest_vectors(queries, concepts, 7).orderBy("rank").collect()]
    assert whole == [tuple(r) for r in vectors.nearest_vectors(queries, concepts, 7, max_matrix_bytes=80).orderBy("rank").collect()]
    assert [r[1] for r in whole] == sorted(str(i) for i in range(4, 40, 5))[:7]


def test_similarity_and_variants(spark):
    assert column(spark, ["lisinopril"], ranking.char_similarity(F.col("t"), F.lit("lisinopril")))[0] == 1.0
    assert column(spark, ["metformin po"], ranking.query_variants(F.col("t"), F.col("t"), F.lit("x"))) == [["metformin po", "x", "metformin"]]
    assert len(lx.CONTEXT_WORDS) == 42 and len(lx.CONFUSABLE_FROM) == len(lx.CONFUSABLE_TO) == 32
