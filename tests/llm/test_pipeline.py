"""The pipeline against plain versions of its stages, and on special rows."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib

import pytest
from conftest import prose
from test_corpus import plain_score, plain_targets, plain_wide
from test_language_urls import plain_scores
from test_scans import PII_PATTERNS, plain_spans

import corpus_pipeline
from medspan.llm import op1_language as lang
from medspan.llm import op8_decontaminate as leaks

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def write(spark, folder, rows, items):
    made = [(i, t, k, s, None if t is None else len(t)) for i, t, k, s in rows]
    spark.createDataFrame(made, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return made


def plain_leak(text, items):
    words = re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+", text.lower())
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    return any(grams(words) & grams(item) and plain_score(item, words) >= min(len(item), 2 * leaks.EXCERPT) for item in items)


def plain_redacted(text):
    out, at = "", 0
    spans = [(s, e, k) for k, s, e in plain_spans(text, PII_PATTERNS)]
    merged = []
    for s, e, k in sorted(spans, key=lambda x: (x[0], [n for n, _ in PII_PATTERNS].index(x[2]))):
        if merged and s < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]), merged[-1][2])
        else:
            merged.append((s, e, k))
    for s, e, k in merged:
        out, at = out + text[at:s] + f"[{k.upper()}]", e
    return out + text[at:]


def plain_run(rows, items):
    known = [(t, k) for i, t, k, _, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1 and i is not None and t is not None and k is not None]
    judged = plain_scores(known, [r[1] for r in rows])
    rows = [r for r, (best, score, fit) in zip(rows, judged, strict=True) if best != "und" and score >= 0.5 and fit >= lang.MIN_FIT]
    groups = {}
    for r, g in zip(rows, plain_wide([r[1] for r in rows]), strict=True):
        groups.setdefault(g, []).append(r)
    rows = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    rows = [r for r in rows if not plain_leak(r[1], items)]
    rows = [(i, plain_redacted(t), k, s, len(plain_redacted(t))) for i, t, k, s, _ in rows]
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1]))
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r)
    out = []
    for source, target in plain_targets(sizes).items():
        quota = int(target + 0.5)
        whole, left = divmod(quota, sizes[source]) if sizes[source] else (0, 0)
        own = sorted((r for r in rows if r[3] == source), key=lambda r: hashlib.md5(f"mix:{'' if r[0] is None else r[0]}:{r[1]}".encode()).hexdigest()[:15])
        for r in own:
            part = min(size(r), left)
            left -= part
            out.append((*r, size(r), sizes[source], whole * size(r) + part, whole))
    return out


def test_pipeline_equals_plain_stages(spark, tmp_path):
    rng = random.Random(41)
    items = [[f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{i}" for i in range(n)] for n in (12, 30, 60)]
    rows = []
    for i in range(45):
        kind = "de" if i % 3 == 0 else "en"
        text = prose(rng, kind, rng.randint(30, 90))
        rows.append((i, text, kind if i % 5 else None, rng.choice(["a", "b", "c", None])))
        if i % 6 == 1:
            rows.append((100 + i, text + " further", kind, "a"))  # a near copy
        if i % 7 == 2:
            rows.append((200 + i, prose(rng, kind, 20) + " " + " ".join(items[i % 3][: 9 if i % 3 == 0 else 28]) + " " + prose(rng, kind, 20), kind, "b"))
        if i % 7 == 3:
            rows.append((300 + i, f"mail x{i}@host.org or +1 (555) 010-99{i:02d} and 10.0.0.{i}, " + prose(rng, kind, 30), kind, "c"))
    rows += [(500, None, "en", "a"), (501, "", "en", "a"), (502, "12 34 !!", "en", "b"), (None, prose(rng, "en", 40), "en", "a"), (503, "日本語のテキストです、これは学んだ言語ではありません", None, "a")]
    rows += [rows[0], (504, rows[1][1], "en", "c")]
    made = write(spark, tmp_path, rows, [(i, " ".join(t)) for i, t in enumerate(items)] + [(9, None)])
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "taken", "whole"]
    want = plain_run(made, items)
    assert sorted(map(repr, map(tuple, got.drop("target").collect()))) == sorted(map(repr, want))
    assert 0 < len(want) < len(rows) - 10 and any("[EMAIL]" in w[1] for w in want)


def test_pipeline_leaves_only_its_result(spark, tmp_path):
    write(spark, tmp_path, [(1, "the house and the river", "en", "a")], [(0, "one two three four")])
    folder = corpus_pipeline.run(spark, str(tmp_path)).inputFiles()[0].removeprefix("file://")
    assert os.listdir(os.path.dirname(os.path.dirname(folder))) == ["4-mix"]


def test_empty_table(spark, tmp_path):
    write(spark, tmp_path, [], [(0, "one two three four")])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_unlabelled_documents_stay(spark, tmp_path):
    write(spark, tmp_path, [(i, f"text number {'abcdefgh'[i]} of the house and {'qrstuvwx'[i]} rivers", None, "a") for i in range(8)], [(0, "one two three four")])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 8


@pytest.mark.parametrize("at", range(4))
def test_stages_keep_columns_of_any_name(spark, docs, edge_rows, tmp_path, at):
    spark.createDataFrame([(0, "same text of the house and river with many people over there")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    more = docs.selectExpr("*", "'m' AS mark", "1 AS own_id", "'l' AS language", "'p' AS pii")
    name, stage = corpus_pipeline.STAGES[at]
    left = stage(spark, more, str(tmp_path))
    ids = sorted(r.doc_id for r in left.select("doc_id").collect() if r.doc_id is not None)
    before = sorted(r[0] for r in edge_rows if r[0] is not None)
    assert left.columns == more.columns and {tuple(r) for r in left.select("mark", "own_id", "language", "pii").collect()} == {("m", 1, "l", "p")}
    if name == "language":
        assert set(before) - set(ids) == {50, 51, 52}
    if name == "near_duplicates":
        assert 61 not in ids and ids.count(60) == 1
    if name == "decontaminate":
        assert set(before) - set(ids) == {60, 61}
    if name == "pii":
        assert before == ids
