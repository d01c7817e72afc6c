"""Tokens, types and stems."""

import random

import pytest

from lexigrove.functions import analysis, stemmer
from lexigrove.functions.stemmer import stem, stem_terms
from lexigrove.plans.parser import English
from lexigrove.queries import stems
from tests.conftest import rows


def docs(spark, *texts, fmt="txt"):
    data = [(i, "t", t, fmt) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, title string, content string, format string")


def types_of(spark, text, fmt="txt"):
    return [(r["term"], r["position"]) for r in analysis.types(docs(spark, text, fmt=fmt)).collect()]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Hello, world!", ["hello", "world"]),
        ("\"'Please remove all single and double quotes.'\"", ["please", "remove", "all", "single", "and", "double", "quotes"]),
        ("192.168.1.1", ["192.168.1.1"]),
        ("Hello?", ["hello"]),
        ("Hewlett-Packard-Computing", ["hewlett", "packard", "computing", "hewlettpackardcomputing"]),
        ("niño último café", ["nio", "ltimo", "caf"]),
        ("O'Neil", ["oneil"]),
        ("a-a", ["a", "a", "aa"]),
        ("-dog", ["", "dog", "dog"]),
        ("—", [""]),
        ("-", ["", "", ""]),
        ("foo-bar!", ["foo", "bar", "foobar"]),
        ("", []),
        (" \x1c \t ", []),
    ],
)
def test_types(spark, text, expected):
    assert [t for t, _ in types_of(spark, text)] == expected
    assert [t for types in English(False).words(text) for t in types] == expected


def test_positions_and_formats(spark):
    assert types_of(spark, "foo\nbar baz") == [("foo", 1), ("bar", 2), ("baz", 3)]
    assert [p for _, p in types_of(spark, "foo\nbar baz", "json")] == [1, 2]
    assert types_of(spark, "a b\x85c", "xml") == [("a", 1), ("b", 2), ("c", 3)]
    assert types_of(spark, "tab\there") == [("tab\there", 1)]
    assert types_of(spark, "a-b — c") == [("a", 1), ("b", 1), ("ab", 1), ("", 2), ("c", 3)]


def test_null_and_long(spark):
    found = analysis.types(docs(spark, None, "", "x " * 50000))
    assert found.count() == 50000


@pytest.mark.parametrize(
    ("word", "expected"),
    [
        ("running", "run"),
        ("runner", "runner"),
        ("caresses", "caress"),
        ("ties", "tie"),
        ("cries", "cri"),
        ("gas", "gas"),
        ("gaps", "gap"),
        ("kiwis", "kiwi"),
        ("hopping", "hop"),
        ("hoping", "hope"),
        ("luxuriated", "luxuri"),
        ("agreed", "agre"),
        ("consigned", "consign"),
        ("knightly", "knight"),
        ("generously", "generous"),
        ("national", "nation"),
        ("relational", "relat"),
        ("happy", "happi"),
        ("by", "by"),
        ("say", "say"),
        ("skies", "sky"),
        ("news", "news"),
        ("proceed", "proceed"),
        ("adjustment", "adjust"),
        ("adoption", "adopt"),
        ("controll", "control"),
        ("", ""),
    ],
)
def test_stem(word, expected):
    assert stem(word) == expected


def test_stem_terms_joins_back(spark):
    table = spark.createDataFrame([(1, 1, "running"), (1, 2, ""), (2, 1, "runs")], "doc_id long, position int, term string")
    assert rows(stem_terms(table), "doc_id", "position", "term") == [(1, 1, "run"), (1, 2, ""), (2, 1, "run")]


def test_spanish_and_language(spark):
    found = analysis.spanish_types(docs(spark, "El niño 3 come pan2, ¡sí!"))
    assert rows(found, "position", "term") == [(1, "el"), (2, "niño"), (4, "come"), (7, "sí")] or [t for _, t in rows(found, "position", "term")] == ["el", "niño", "come", "sí"]
    lemmas = spark.createDataFrame([("come", "comer")], "form string, lemma string")
    assert ("comer",) in rows(analysis.lemmatize(found, lemmas), "term")
    named = docs(spark, "el perro de la casa", "the dog of the house", None).select(analysis.language_name(analysis.F.col("content")).alias("l"))
    assert [r[0] for r in named.collect()] == ["spanish", "english", "english"]


def test_stems_equal_the_steps_in_sql():
    duckdb = pytest.importorskip("duckdb")
    random.seed(7)
    letters = ["b", "c", "d", "e", "g", "i", "k", "l", "ll", "m", "n", "o", "r", "s", "ss", "t", "tt", "u", "w", "x", "y", "a", "gener", "commun", "yy", "1"]
    endings = ["", *stemmer._STEP_2, *stemmer._STEP_3, *stemmer._STEP_4, "ative", "ogi", "logi", "li", "ion", "sion", "tion", "ed", "edly", "ing", "ingly", "eed", "eedly", "s", "es", "ies", "ied", "sses", "us", "y", "e", "le", "ll", "ating", "bled", "izing"]
    words = {"".join(random.choices(letters, k=random.randrange(6))) + random.choice(endings) + random.choice(["", "", "s", "ly", "ed", "e"]) for _ in range(40000)}
    words |= set(stemmer._IRREGULAR) | stemmer._KEPT_AFTER_1A | {"", "y", "outings", "innings", "proceeds", "skying", "generations", "arsenals"}
    known = duckdb.sql(f"WITH raw AS (SELECT unnest($words) AS term), {stems.TABLES} SELECT term, stem FROM stems", params={"words": sorted(words)}).fetchall()
    assert len(known) == len(words)
    assert [(w, s, stemmer.stem(w)) for w, s in known if stemmer.stem(w) != s] == []
