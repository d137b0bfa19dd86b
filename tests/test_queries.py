"""Driver queries against DuckDB on the smallest tables."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import re
import unicodedata

import duckdb
import numpy as np
import pytest

from medspan.functions import lexicon as lx
from medspan.functions import textnorm
from medspan.operators import mentions
from medspan.plans import queries as q
from medspan.plans import rule_queries  # noqa: F401  (adds to q.QUERIES)

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")


@pytest.fixture(scope="module")
def db():
    made = duckdb.connect()
    for t in TABLES:
        made.sql(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return made


def cells(frame, columns):
    return sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    got, want = q.QUERIES[name](spark, SF_DIR).toPandas(), db.sql(q.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got, sorted(got.columns)) == cells(want, sorted(got.columns))


LONG = "abcdefghijklmn opqrstuvwxyzab cdefghijklmnop qrstuvwxyzabcd"
ODD_NOTES = {
    "metoprololsuccinate25 " + LONG + " lisinoprilxx": [("metoprololsuccinate25 " + LONG, "dense_line_scan"), ("lisinoprilxx", "dense_line_scan")],
    "one; two\nm e t o p r o l o l 5mg " + LONG + " (vanc) heparin": [("vanc)", "dense_line_scan"), ("heparin", "dense_line_scan")],  # the first name is one by repair alone
    "L\u0130S\u0130NOPRIL li\u017finopril f\u0435ntanyl dex " + LONG: [("\u017finopril f\u0435", "dense_line_scan"), ("ntanyl de", "dense_line_scan"), ("x " + LONG, "dense_line_scan")],  # places are those after lower-casing, which makes two of a character
    "xx-yy va nc omycins, va nc omycins " + LONG: [("xx-yy va nc omycins, va nc omycins " + LONG, "fallback_whole_text")],  # names by repair alone
    "dexvanc; of few words": [("dexvanc", "fallback_chunk"), ("of few words", "fallback_chunk")],
    "\u3000one\xa0;\x1ctwo\x85\n\x0b": [("one", "fallback_chunk"), ("two", "fallback_chunk")],
    "\xa0\u65e5\u672c; \u2026 ": [("\u65e5\u672c; \u2026", "unknown")],
    ";;\n": [(";;", "unknown")],
    "\u2003\n": [], "": [], None: [],
}


def test_notes_without_a_dictionary_equal_sql(spark, tmp_path):
    rows = list(enumerate(ODD_NOTES))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, q.QUERIES["fallback_chunks"](spark, str(tmp_path)).collect()))
    assert got == [(i, n, *m) for i, text in rows for n, m in enumerate(ODD_NOTES[text])]
    own = duckdb.connect()
    own.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(own.sql(q.ORACLE_SQL["fallback_chunks"]).fetchall()) == got


def plain_noisy(text):
    """The repair of noisy text, word by word."""
    words = re.sub("[^a-z0-9]+", " ", unicodedata.normalize("NFKD", text.translate(str.maketrans(lx.CONFUSABLE_FROM, lx.CONFUSABLE_TO))).encode("ascii", "ignore").decode().lower()).split()
    spelled = []
    for single, run in itertools.groupby(words, lambda w: len(w) == 1 and w.isalpha()):
        run = list(run)
        spelled += ["".join(run)] if single and len(run) >= 3 else run
    parts, whole, i = [p for w in spelled for p in re.findall("[a-z]+|[0-9]+", w)], [], 0
    while i < len(parts):
        whole.append(parts[i])
        i += 1
        if whole[-1].isdigit():
            for n in (3, 2, 1):
                if "".join(parts[i : i + n]) in ("mg", "mcg", "ml") and len(parts[i : i + n]) == n:
                    whole.append("".join(parts[i : i + n]))
                    i += n
                    break
    out, i = [], 0
    while i < len(whole):
        w, after = whole[i], whole[i + 1] if i + 1 < len(whole) else ""
        if set(w) <= set("0123456789o") or (set(w) - set("0123456789o") and re.sub("(units?|mcg|mg|ml|meq|g)$", "", w) != w and set(re.sub("(units?|mcg|mg|ml|meq|g)$", "", w)) <= set("0123456789o") and re.sub("(units?|mcg|mg|ml|meq|g)$", "", w)):
            w = w.replace("o", "0")
        known = lx.TOKEN_REPLACEMENTS.get(w)
        pair = w + after
        if known is None and w.isalpha() and after.isalpha() and w not in lx.CONTEXT_WORDS and after not in lx.CONTEXT_WORDS and 1 < len(w) < 7 and 1 < len(after) < 9 and (pair in lx.TOKEN_REPLACEMENTS or len(pair) > 6):
            known, i = lx.TOKEN_REPLACEMENTS.get(pair, pair), i + 1
        out.append(known or w)
        i += 1
    return " ".join(out)


def test_noisy_equals_plain_repair(spark):
    texts = {r.doc_id: r.text for r in q.table(spark, SF_DIR, "documents").select("doc_id", "text").collect()}
    got = {r.doc_id: r.norm for r in q.QUERIES["noisy_normalize"](spark, SF_DIR).collect()}
    assert got == {i: plain_noisy(t) for i, t in texts.items()}
    rng = random.Random(23)
    pieces = ["m", "e", "t", "mg", "m g", "m c g", "ml", "500", "5o", "o", "omg", "losrtan", "lipi", "tor", "asa", "hctz", "sodium", "chloride", "po", "er", "café", "½", "x", "unit", "units", "10mg", "amx", "clv"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) + rng.choice([" ", " ", "", "-"]) for _ in range(rng.randint(0, 12)))
        assert textnorm.noisy_py(text) == plain_noisy(text), text


def test_vectors_equal_plain_counts(spark):
    got = {r.p_partkey: r.vec for r in q.QUERIES["gram_hash_embed"](spark, SF_DIR).collect()}
    for r in q.table(spark, SF_DIR, "part").select("p_partkey", "p_name", "p_type").collect():
        padded, plain = f" {r.p_name} {r.p_type} ".lower(), np.zeros(256)
        for n in (3, 4, 5):
            for i in range(len(padded) - n + 1):
                h = int.from_bytes(hashlib.blake2b(padded[i : i + n].encode(), digest_size=8).digest(), "little")
                plain[h % 256] += -1 if h >> 63 else 1
        assert np.allclose(got[r.p_partkey], plain / np.linalg.norm(plain), atol=1e-6)


def test_mentions_equal_a_plain_dictionary(spark):
    """Every note alone, with the dictionary as a dict and every span looked up."""
    names, _ = q.part_terms(spark, SF_DIR)
    rows: dict = {}
    for r in names.orderBy("line_no").collect():
        rows.setdefault(r.norm_text, []).append((r.concept_id, r.tty))
    got = [tuple(r) for r in q.QUERIES["detect_mentions"](spark, SF_DIR).collect()]
    want = []
    for note in q.part_notes(spark, SF_DIR).collect():
        for i, m in enumerate(mentions.detect(note.text, lambda key: rows.get(key, []))):
            want.append((note.doc_id, i, m["text"], m["norm_text"], m["start"], m["end"], m["method"], m["lookup_source"]))
    assert sorted(got) == sorted(want)


def test_entry(spark):
    import __spark_entry__

    assert set(q.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
