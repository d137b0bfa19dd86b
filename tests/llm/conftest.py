from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fp string, id bigint, words string"
WORDS = {"en": "the of and house river over under green walks with from this that many people".split(), "de": "der die und haus fluss über unter grün geht mit von dies dass viele leute schön".split()}


def prose(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(rng.choice(WORDS[lang]) + (rng.choice(["", "", ".", ",", "\n"]) if i % 7 == 6 else "") for i in range(n))


def row(doc_id, text, lang="en", source="a"):
    """A document with further columns whose names operators might use themselves."""
    return (doc_id, text, lang, source, None if text is None else len(text), 0.25, "own", 7, "mine")


@pytest.fixture(scope="session")
def edge_rows():
    rng = random.Random(3)
    rows = [row(i, prose(rng, "en" if i % 3 else "de", 60), "en" if i % 3 else "de", "abc"[i % 3]) for i in range(40)]
    rows += [row(50, None), row(51, ""), row(52, "1234 !!"), row(53, "é" * 50, None, None), row(None, "no id the house", "en", None), row(None, None, None, None)]
    rows += [row(60, "same text of the house and river with many people over there"), row(60, "same text of the house and river with many people over there"), row(61, "same text of the house and river with many people over there")]
    rows += [row(70, prose(rng, "en", 250_000))]  # over a megabyte
    return rows


@pytest.fixture(scope="session")
def docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
