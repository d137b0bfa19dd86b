from __future__ import annotations

import json
import os
import random
import threading
import urllib.error
import urllib.request
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

import mini
import plain_notes
from medspan import serve, session
from medspan.__main__ import main
from medspan.functions import lexicon as lx
from medspan.operators import display, graph, mentions, projection, ranking, scan, vectors
from medspan.plans import annotate as annotate_plan
from medspan.plans.annotate import Prepared, annotate, annotate_mentions
from medspan.session import spread
from medspan.sources import release
from medspan.sources.index import build_index, load_index
from medspan.sources.results import result_json
from medspan.streaming.annotate import annotate_stream

NOTES = [
    (1, "Patient takes metformin 500 mg BID"),
    (2, "Metformin 1000 mg PO BID\nAtorvastatin (Lipitor) 20 mg PO nightly\n\nPatient denies aspirin."),
    (3, "nothing here"), (4, "   "), (5, None),
    (6, "hydrochlorothiazide 12.5 MG / lisinopril 10 MG tablet"), (7, "no drug; at all"),
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("release")
    names, relations = mini.write_release(folder)
    made = build_index(spark, names, relations, f"{folder}/index", mini.SOURCE)
    assert made["concept_count"] == 20 and made["edge_count_directed"] == 2 * len(mini.RELATIONS)
    return load_index(spark, f"{folder}/index")


@pytest.fixture(scope="module")
def notes(spark):
    return spark.createDataFrame(NOTES, "doc_id long, text string")


@pytest.fixture(scope="module")
def results(notes, index):
    return {r.doc_id: r.asDict(True) for r in annotate(notes, index).collect()}


def types(m):
    return {k: (v["concept_id"] if isinstance(v, dict) else [x["concept_id"] for x in v]) for k, v in m["type_results"].items() if v and k != "in_is_list"}


def test_names_and_relations(index):
    names = {(r.concept_id, r.tty): r.name for r in index.names.collect()}
    assert ("902", "IN") in names and not any(c in {x[0] for x in names} for c in ("901", "903", "904", "905", "906"))
    assert names["300", "PSN"] == "metformin 500 MG Oral Tablet"
    assert {r.concept_id for r in index.aliases.where("norm_text = 'acetylsalicylic acid'").collect()} == {"104"}
    edges = {(r.src, r.dst, r.rela) for r in index.edges.collect()}
    assert ("100", "200", "has_ingredient") in edges and all((b, a, r) in edges for a, b, r in edges)


def test_ingredients(index):
    sets = {r.concept_id: r.ingredients for r in index.ingredients.collect()}
    assert sets["300"] == ["100"] and sets["303"] == ["101", "103"] and sets["130"] == ["101", "103"] and sets["110"] == ["102"] and sets["400"] == []


def test_ingredients_need_bridge_links(index):
    cut = index.edges.where("not (src = '303' and dst in ('203', '204')) and not (dst = '303' and src in ('203', '204'))")
    assert graph.ingredient_sets(index.concepts, index.names, cut).where("concept_id = '303'").first().ingredients == []


def test_closure(spark, index):
    seeds = spark.createDataFrame([("100", "SCD")], "seed string, target string")
    reach = graph.candidates(graph.closure(seeds, index.edges, graph.relation_table(spark), 3), index.names)
    assert {(r.node, r.depth) for r in reach.collect()} == {("300", 2), ("301", 2)}


def test_closure_over_hubs(spark, monkeypatch):
    rng = random.Random(5)
    pairs = {(f"n{rng.randint(0, 8)}", f"m{rng.randint(0, 120)}") for _ in range(400)}
    rows = [(a, b, rng.choice(["isa", "form_of", "other"])) for a, b in sorted(pairs)]
    edges = spark.createDataFrame(rows + [(b, a, r) for a, b, r in rows], "src string, dst string, rela string")
    seeds = spark.createDataFrame([(f"m{i}", t) for i in range(0, 120, 7) for t in ("SCD", "IN")], "seed string, target string")
    allowed = graph.relation_table(spark, {"SCD": ["isa", "form_of"], "IN": ["form_of"]})
    plain = {tuple(r) for r in graph.closure(seeds, edges, allowed, 3).collect()}
    for most in (graph.MAX_BROADCAST_HUBS, 1):
        monkeypatch.setattr(graph, "HUB_EDGES", 3)
        monkeypatch.setattr(graph, "MAX_BROADCAST_HUBS", most)
        assert {tuple(r) for r in graph.closure(seeds, edges, allowed, 3).collect()} == plain and len(plain) > 500


def test_row_caps(spark):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(["a", "b", "a", "c", "b"])], "line_no long, concept_id string")
    assert [r.line_no for r in release.first_concepts(rows, 2).orderBy("line_no").collect()] == [0, 1]
    kept = spark.createDataFrame([(1,), (4,), (6,)], "line_no long")
    lines = spark.range(10).withColumnRenamed("id", "line_no")
    assert [r.line_no for r in release.first_relations(kept, lines, 4).orderBy("line_no").collect()] == [1, 4]


def test_single_mention(results):
    (m,) = results[1]["mentions"]
    assert m["best_match"]["concept_id"] == "200" and m["best_match"]["score"] == pytest.approx(1.35) and m["best_match"]["exact_match"]
    assert types(m) == {"SCD": "300", "SCDC": "200", "IN": ["100"]}
    assert m["detected_by"] == ["exact_alias", "embeddings", "exact_alias_boost"]


def test_brand_evidence_negation_and_lines(results):
    first, second, third = results[2]["mentions"]
    assert first["matched_text"] == "Metformin 1000 mg PO BID" and first["best_match"]["concept_id"] == "201"
    assert types(second) == {"SBD": "310", "SCD": "302", "BN": "110", "SCDC": "202", "PIN": "120", "IN": ["102"]}
    assert third["best_match"]["concept_id"] == "110"


def test_combination_and_fallbacks(results):
    (m,) = results[6]["mentions"]
    assert m["type_results"]["in_is_list"] and types(m)["MIN"] == "130" and types(m)["IN"] == ["103", "101"]
    assert [results[i]["mention_count"] for i in (3, 4, 5)] == [1, 0, 0]
    assert results[3]["mentions"][0]["detection_trace"]["mention_detection_method"] == "fallback_whole_text"
    assert {m["detection_trace"]["mention_detection_method"] for m in results[7]["mentions"]} == {"fallback_chunk"}


def test_shuffled_dictionary_gives_the_same_mentions(notes, index):
    small = mentions.detect_mentions(notes, index.aliases).orderBy("doc_id", "mention_no").collect()
    assert small == mentions.detect_mentions(notes, index.aliases, max_broadcast_bytes=0).orderBy("doc_id", "mention_no").collect()


def test_json_and_display(spark, index, notes):
    found = {r.doc_id: json.loads(r.value) for r in result_json(annotate(notes.where("doc_id in (1, 4, 6)"), index)).collect()}
    first = found[1]["mentions"][0]
    assert first["tty_results"]["IN"] == {"rxcui": "100", "name": "metformin", "depth": 1} and found[4]["mentions"] == []
    assert set(first) == set("mention_text matched_text span matched_span normalized_text best_match tty_results detected_by detection_trace".split())
    assert set(first["best_match"]) == set("rxcui name tty score exact_match".split()) and set(first["tty_results"]) == set(lx.TARGET_TYPES)
    assert set(first["detection_trace"]["ranking"]) == set("used_embeddings embedding_query_variants exact_alias_candidate_count exact_alias_candidates exact_alias_ttys selection_reason best_name_similarity ingredient_projection_suppressed".split())
    assert set(found[1]) == {"input_text", "target_ttys", "mention_count", "mentions"} and first["tty_results"]["BN"] is None
    assert [x["rxcui"] for x in found[6]["mentions"][0]["tty_results"]["IN_ALL"]] == ["103", "101"]
    twice = spark.createDataFrame([(1, "metformin 500 mg tablet\nMetformin 500 MG tablet\naspirin 81 mg")], "doc_id long, text string")
    rows = display.deduplicated(annotate_mentions(twice, index))
    assert sorted(r.merged for r in rows.collect()) == [1, 2]
    assert {r.IN for r in display.table_rows(rows).collect()} == {"metformin (100)", "aspirin (104)"}


WORDS = ["metformin", "aspirin", "asa", "hctz", "lipi", "tor", "sodium", "chloride", "po", "er", "of", "the", "500", "5omg", "10mg", "m", "e", "t", "café", "naïve", "x", "oo", "-", "/", ",", ".", "Losrtan", "and", "mg", "omg", "é", "amx", "clv", "pill"]


DENSE = "metformin500mgBID,lisinopril10mgdaily,atorvastatin20mgnightly;metoprolol25mgBID"
SIGNS = [" ", " ", " ", " ", "", "\n", ", ", " / ", "+", ".", "-", "_", "“", "ﬁ", ";"]


def random_text(rng, n=14):
    return "".join(rng.choice(WORDS) + rng.choice(SIGNS) for _ in range(rng.randint(1, n))) + (DENSE[: rng.randint(0, 90)] if rng.random() < 0.1 else "")


def random_table(rng, texts):
    """A dictionary of what look-ups of some spans may ask for."""
    whole = [k for text in texts for i in range(0, len(text), 3) for k, _ in mentions.lookup_keys(text[i : i + rng.randint(1, 30)])]
    return {k: [(k, rng.choice(["IN", "BN", "DF"]))] for k in rng.sample(whole, min(len(whole), rng.randint(0, 5)))}


def test_scan_loses_no_mention():
    """Detection over the spans that the scan of a batch leaves, and over all spans, with dictionaries made of what repairs can produce."""
    rng = random.Random(17)
    for _ in range(400):
        texts = [random_text(rng) for _ in range(rng.randint(1, 6))]
        table = random_table(rng, texts)
        lookup = lambda key, table=table: table.get(key, [])
        for text, note in zip(texts, scan.scan(texts, scan.KeyFilter.of(list(table))), strict=True):
            assert mentions.detect(text, lookup, 8, note) == mentions.detect(text, lookup), (text, table)
            assert {k for k in mentions.needed_keys(text, mentions.all_spans(text, 8)) if k in table} == {k for k in mentions.needed_keys(text, note) if k in table}


def test_detection_equals_a_plain_detector(spark):
    """Random notes with dense lines, brackets, shorthands and types that are no drug's, against every span looked up note by note."""
    rng = random.Random(23)
    texts = []
    for _ in range(500):
        parts = [random_text(rng, 8) for _ in range(rng.randint(1, 3))]
        if rng.random() < 0.3:
            parts.append(rng.choice(["metformin (asa) 500 mg", "(aspirin)", "[sodium chloride] po", "aspirin; metformin, held", "sugar pill", "water"]))
        if rng.random() < 0.2:
            parts.append(DENSE + rng.choice(["", " po", ", propofol", " x"]))
        texts.append("\n".join(parts))
    texts += ["", "  ", "...", "\n\n", "one", "a;b\n;c"]
    table = {}
    for text in texts[::7]:
        for key, rows in random_table(rng, [text]).items():
            table.setdefault(key, []).extend([(f"{i}{k}", t) for i, (k, t) in enumerate(rows * rng.randint(1, 2))])
    table |= {"metformin": [("m", "IN"), ("f", "DF")], "aspirin": [("a", "IN")], "sodium chloride": [("n", "DF")], "water": [("w", "IN")], "mg po": [("d", "SCDF")]}
    rows = [(key, c, key, t, i + 1) for key, own in table.items() for i, (c, t) in enumerate(own)]
    aliases = spark.createDataFrame(rows, "norm_text string, concept_id string, raw_text string, tty string, pos int")
    notes = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: plain_notes.detected(t, table) for i, t in enumerate(texts)}
    for limit in (mentions.MAX_BROADCAST_BYTES, 0):
        got: dict = {i: [] for i in want}
        for r in mentions.detect_mentions(notes, aliases, max_broadcast_bytes=limit).orderBy("doc_id", "mention_no").collect():
            got[r.doc_id].append(r)
        for i, own in want.items():
            assert [(r.text, r.norm_text, r.start, r.end, r.exact_ids, r.exact_types, r.method, r.lookup_source) for r in got[i]] == [(m["text"], m["norm"], m["start"], m["end"], m["ids"], m["types"], m["method"], m["source"]) for m in own], (texts[i], own)
            for r, m in zip(got[i], own, strict=True):
                lo, hi = plain_notes.bounds(texts[i], r.start, r.end)
                assert (r.line_text, r.line_start) == (texts[i][lo:hi], lo)
                if m["method"] in ("exact_alias_span", "dense_line_scan") and plain_notes.shown(texts[i], m):
                    assert r.mention_text == plain_notes.shown(texts[i], m), texts[i]
    methods = {m["method"] for own in want.values() for m in own}
    assert methods == {"exact_alias_span", "dense_line_scan", "fallback_chunk", "fallback_whole_text", "unknown"}


def test_scan_cuts_tokens_as_the_pattern_does():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("ab1é .+/%_-,\n") for _ in range(rng.randint(0, 30)))
        batch = scan.Batch(["x", text])
        assert [(a - 2, b - 2) for a, b in zip(batch.start.tolist(), batch.end.tolist(), strict=True)][1:] == [m.span() for m in mentions._TOKEN.finditer(text)]


def test_scan_leaves_few_spans():
    rng = random.Random(9)
    text = " ".join(rng.choice(["the", "house", "and", "river", "walked", "with", "für", "schöne", "está", "a", "of", "12"]) for _ in range(4000)) + " takes metformin 500 mg po"
    note = scan.scan([text], scan.KeyFilter.of(["metformin", "metformin 500 mg", "aspirin"]))[0]
    assert [text[a:b] for spans in note.lines.values() for _, _, a, b in spans if text[a:b] in ("metformin", "metformin 500 mg")] == ["metformin 500 mg", "metformin"]
    assert sum(map(len, note.lines.values())) < 100  # of 32,000


FOLDED = ["o", "ó", "oo", "óó", "ciónos", "nó", "ñci", "a", "b", "é", "po", "mg", "5", "of", "metfor", "min", "miné", "lisi", "nopril", "oretionos", "daily", "0", "o5", "ASA", "as", "subcuta", "neous", "K", "½"]


def test_scan_looks_up_little_but_what_is_known():
    """A dictionary of many words that occur everywhere, alone and in threes, beside torn words and letters that fold: spans left are keys, nearly all."""
    rng = random.Random(6)
    words = ["thera", "ciónos", "ofretiono", "estion", "in", "nde", "ó", "le", "réal"]
    names = {w.replace("ó", "o").replace("é", "e") for w in words if len(w) > 2} | {"thera in nde", "inestion", "le nde thera", "estion le estion in"}
    text = "\n".join(" ".join(rng.choice(words) for _ in range(40)) for _ in range(100))
    note = scan.scan([text], scan.KeyFilter.of(sorted(names)))[0]
    spans = [text[a:b] for own in note.lines.values() for _, _, a, b in own]
    known = [s for s in spans if any(k in names for k, _ in mentions.lookup_keys(s))]
    assert len(known) > 1000 and len(spans) < 1.1 * len(known)


def test_fields_of_many_notes_equal_detection():
    """Fields made for a batch at once equal the mentions of each note, dictionary by dictionary: dense lines, brackets, shorthands, letters that fold."""
    rng = random.Random(31)
    names = list(mentions.OWN_FIELDS)
    for _ in range(150):
        texts = [random_text(rng, 6) + " ".join(rng.choice(FOLDED) for _ in range(rng.randint(0, 12))) + rng.choice(["", "", "\nMetformin (asa) [aspirin]"]) for _ in range(rng.randint(1, 5))] + ["", "..."]
        whole = sorted({k for t in texts for a in range(0, len(t), 2) for k, _ in mentions.lookup_keys(t[a : a + rng.randint(1, 30)])} | {"metformin", "aspirin"})
        table = {k: [(k, rng.choice(["IN", "BN", "DF"])), (k + "2", None)][: rng.randint(1, 2)] for k in rng.sample(whole, min(len(whole), rng.choice([2, 10, 40])))}
        lookup = lambda key, table=table: table.get(key, [])
        known = mentions.Known(lookup)
        found, number = mentions.chosen(scan.scanned(texts, scan.KeyFilter.of(list(table)), 8), known)
        for methods in (mentions.METHODS, ["exact_alias_span"], ["dense_line_scan", "unknown"]):
            made = mentions.own_fields(found, number, known, names, methods, lookup, 8).to_pylist()
            for k, text in enumerate(texts):
                want = [{n: len(mentions.tokens_of(m["text"])) if n == "tokens" else m[n] for n in names} for m in mentions.detect(text, lookup) if m["method"] in methods]
                assert sorted(map(str, ({n: r[n] for n in names} for r in made if r["row"] == k))) == sorted(map(str, want)), (text, table)


def test_only_some_fields_of_mentions(spark):
    notes = spark.createDataFrame([(i, f"aspirin {i} mg\nmetformin (asa) 5, aspirin" if i % 3 else "nothing here") for i in range(40)] + [(99, None)], "doc_id long, text string")
    aliases = spark.createDataFrame([(x, x, x, "IN", 1) for x in ("aspirin", "aspirin 7 mg", "metformin")], "norm_text string, concept_id string, raw_text string, tty string, pos int")
    for limit in (mentions.MAX_BROADCAST_BYTES, 0):
        whole = mentions.detect_mentions(notes, aliases, max_broadcast_bytes=limit)
        some = mentions.detect_mentions(notes, aliases, max_broadcast_bytes=limit, only=["text", "start", "norm_text"], methods=["exact_alias_span"])
        assert some.columns == ["doc_id", "text", "start", "norm_text"]
        assert sorted(map(tuple, some.collect())) == sorted(map(tuple, whole.where("method = 'exact_alias_span'").select(some.columns).collect()))


def test_no_token_is_left_for_the_replacement_pass():
    """Repair replaces each shorthand itself, so no repaired token is a shorthand: that pass never finds one, here as before."""
    rng = random.Random(1)
    short = list(lx.TOKEN_REPLACEMENTS)
    for _ in range(3000):
        token = "".join(rng.choice([rng.choice(short), rng.choice("abo05"), "-", "/", "."]) for _ in range(rng.randint(1, 4)))
        for m in mentions._TOKEN.finditer(token):
            assert mentions.noisy_py(m[0]) not in lx.TOKEN_REPLACEMENTS


def found(text, *names):
    rows = {n: [(n, "IN")] for n in names}
    note = scan.scan([text], scan.KeyFilter.of(list(names)))[0]
    return [(m["text"], m["start"], m["method"], m["lookup_source"], m["mention_text"]) for m in mentions.detect(text, lambda key: rows.get(key, []), 8, note)]


def test_dense_lines_are_cut_at_known_names():
    line = DENSE
    want = [("metformin500mgBID", 0, "dense_core_norm"), ("lisinopril10mgdaily", 18, "dense_segment_norm"), ("atorvastatin20mgnightly", 38, "dense_segment_norm"), ("metoprolol25mgBID", 62, "dense_segment_norm")]
    assert [(t, s, source) for t, s, method, source, _ in found(line, "metformin") if method == "dense_line_scan"] == want
    assert [m[4] for m in found("Plan:\n" + line, "metformin")] == [t for t, *_ in want]
    assert not mentions.is_dense(line[:69]) and not mentions.is_dense("a long line of plain words " * 4)


def test_names_in_brackets_give_way_on_shared_lines():
    assert [m[0] for m in found("aspirin (bayer) x", "aspirin", "bayer")] == ["aspirin"]
    assert [m[0] for m in found("x (bayer) x", "aspirin", "bayer")] == ["bayer"]


def test_shown_text_is_the_clause():
    assert [m[::4] for m in found("Plan; take aspirin 81 mg daily, rest", "aspirin")] == [("take aspirin 81 mg daily", "take aspirin 81 mg daily")]
    assert [m[4] for m in found("on aspirin: stop", "aspirin")] == ["on aspirin"]


def test_server(index, results, monkeypatch):
    made = []
    begin = mentions.Detector.__init__
    monkeypatch.setattr(mentions.Detector, "__init__", lambda self, *args: made.append(1) or begin(self, *args))
    running = serve.server(index, "somewhere", port=0)
    thread = threading.Thread(target=running.serve_forever)
    thread.start()
    url = f"http://127.0.0.1:{running.server_port}"

    def ask(body):
        try:
            with urllib.request.urlopen(urllib.request.Request(f"{url}/api/infer", body)) as reply:
                return reply.status, json.load(reply)
        except urllib.error.HTTPError as error:
            return error.code, json.load(error)

    assert json.load(urllib.request.urlopen(f"{url}/health")) == {"ok": True, "index_dir": "somewhere"}
    assert ask(b"[]")[0] == 400 and ask(b'{"text": " "}')[0] == 400 and ask(b"\xff")[0] == 400
    with ThreadPoolExecutor(3) as pool:  # side by side, over one dictionary
        got = list(pool.map(ask, [json.dumps({"text": NOTES[0][1]}).encode()] * 3))
    assert {status for status, _ in got} == {200} and made == [1]
    assert all(g["mention_count"] == 1 and g["mentions"][0]["best_match"]["rxcui"] == results[1]["mentions"][0]["best_match"]["concept_id"] for _, g in got)
    monkeypatch.setattr(serve, "infer_json", lambda *_: 1 / 0)
    assert ask(b'{"text": "x"}') == (500, {"error": "ZeroDivisionError: division by zero"})
    running.shutdown()
    thread.join()
    running.server_close()


def test_prepared_index_serves_many_calls(spark, index, notes, results):
    ready = Prepared(index)
    tracker = spark.sparkContext.statusTracker()
    for group in ("first", "second"):
        spark.sparkContext.setJobGroup(group, group)
        got = {r.doc_id: r.asDict(True) for r in annotate(notes, ready).collect()}
        assert got == results
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("second")) <= len(tracker.getJobIdsForGroup("first"))
    ready.release()


def test_repeated_notes_are_kept_once(spark, index, notes, results, monkeypatch):
    """40 times the notes: of the staged tables only that of the mentions grows; candidates are made for distinct mentions."""
    text = {i: t for i, t in NOTES}
    sizes: list[list[int]] = []
    keep = ranking.stage
    for module in (annotate_plan, projection, ranking, graph, vectors):
        monkeypatch.setattr(module, "stage", lambda df: (made := keep(df), sizes[-1].append(made.count()))[0])
    for copies in (1, 40):
        sizes.append([])
        many = spark.createDataFrame([(i + 100 * k, t) for k in range(copies) for i, t in text.items()], "doc_id long, text string")
        got = {r.doc_id: r.asDict(True) for r in annotate(many, index).collect()}
        assert got == {i + 100 * k: r | {"doc_id": i + 100 * k} for k in range(copies) for i, r in results.items()}
    found = sum(r["mention_count"] for r in results.values())
    grown = [(a, b) for a, b in zip(*sizes, strict=True) if a != b]
    assert len(grown) == 1 and grown[0][0] >= found and grown[0][1] == 40 * grown[0][0]


def test_many_distinct_mentions_are_joined_by_shuffles(notes, index, results, monkeypatch):
    monkeypatch.setattr(session, "MAX_BROADCAST_ROWS", 0)
    monkeypatch.setattr(projection, "MAX_BROADCAST_SHAPES", 0)
    assert {r.doc_id: r.asDict(True) for r in annotate(notes, index).collect()} == results


def test_index_with_reach_gives_the_same(spark, index, notes, results, tmp_path):
    names, relations = mini.write_release(tmp_path)
    build_index(spark, names, relations, f"{tmp_path}/index", mini.SOURCE, reach_depth=3)
    known = load_index(spark, f"{tmp_path}/index")
    assert known.reach_depth == 3 and known.reach.count() > 0
    assert {r.doc_id: r.asDict(True) for r in annotate(notes, known).collect()} == results


def test_lookups_do_not_shuffle_the_index(spark, index):
    asked = spark.createDataFrame([(f"x{i}", f"c{i}") for i in range(50)], "norm_text string, src string").repartition(3)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for table, key in ((index.aliases, "norm_text"), (index.edges, "src")):
            plan = asked.join(table, key)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("hashpartitioning") == 1 and "Bucketed: true" in plan, plan  # of the asking side
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_nearest_in_blocks_and_slices(spark):
    rng = np.random.default_rng(5)
    concepts = [(f"c{i:03}", [float(x) for x in rng.integers(-3, 4, 8)]) for i in range(90)]
    asked = [(f"q{i}", concepts[i][1]) for i in range(0, 90, 3)]
    one, two = spark.createDataFrame(concepts, "concept_id string, vec array<float>"), spark.createDataFrame(asked, "query string, vec array<float>")
    want = []
    for name, vec in asked:
        scored = sorted((-round(float(np.dot(vec, v)), 6), c) for c, v in concepts)[:7]
        want += [(name, c, -s, i + 1) for i, (s, c) in enumerate(scored)]
    for size, part in ((64 << 20, 50_000), (500, 4)):
        got = vectors.nearest_vectors(two, one, 7, size, part).select("query", "concept_id", "score", "rank").collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert vectors.nearest_vectors(two, one.limit(0), 7).count() == 0 and vectors.nearest_vectors(two.limit(0), one, 7).count() == 0


def test_mentions_with_different_features_are_projected_apart(spark, index, monkeypatch):
    """Lists that hashes of columns would run together, and a seed whose mentions are dealt to several slots."""
    monkeypatch.setattr(projection, "SLOT_MENTIONS", 2)
    shape = "ratios array<struct<a:double,b:double>>, numbers array<double>"
    rows = spark.createDataFrame([(1, [(5.0, 10.0)], []), (2, [], [5.0, 10.0])], f"id int, {shape}")
    made = rows.select(F.sha2(F.to_json(F.struct("ratios", "numbers")), 256)).distinct()
    assert rows.select(F.xxhash64("ratios", "numbers")).distinct().count() == 1 and made.count() == 2
    many = spark.createDataFrame([(i, f"metformin {500 * (i % 7)} mg tablet daily") for i in range(30)], "doc_id long, text string")
    got = {r.doc_id: r.mentions[0].type_results.SCD for r in annotate(many, index).collect()}
    alone = {r.doc_id: r.mentions[0].type_results.SCD for r in annotate(many.where("doc_id < 7"), index).collect()}
    assert all(got[i] == alone[i % 7] for i in range(30))


def test_small_scans_are_dealt_without_a_job(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/t")
    scanned = spark.read.parquet(f"{tmp_path}/t")
    seen = spark.sparkContext.accumulator(0)
    rows = scanned.select(F.udf(lambda x: seen.add(1) or x, "long")("id").alias("id"))
    dealt = spread(rows)
    assert seen.value == 0
    dealt.collect()
    assert seen.value == 100 and dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_command_line_takes_a_folder(spark, tmp_path, capsys, monkeypatch):
    names, relations = mini.write_release(tmp_path)
    os.rename(names, tmp_path / "XCONSO.RRF")
    os.rename(relations, tmp_path / "XREL.RRF")
    main(["build-index", "--rrf-dir", str(tmp_path), "--source", mini.SOURCE, "--out-dir", f"{tmp_path}/index"])
    assert json.loads(capsys.readouterr().out)["concept_count"] == 20
    main(["infer", "--index-dir", f"{tmp_path}/index", "--text", NOTES[0][1]])
    assert json.loads(capsys.readouterr().out)["mentions"][0]["best_match"]["rxcui"] == "200"


def test_stream(spark, index, tmp_path):
    spark.createDataFrame(NOTES[:2], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
    annotate_stream(stream, index, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("doc_id", "mention_count").collect()
    assert {(r.doc_id, r.mention_count) for r in got} == {(1, 1), (2, 3)}
