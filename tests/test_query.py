"""Parser, evaluator and ranker against small brute-force versions."""

import math
import random

import pytest

from lexigrove.operators import index as ix
from lexigrove.operators import ranking, spelling
from lexigrove.plans.ast import AndQuery, NotQuery, OrQuery, PhraseLiteral, TermLiteral
from lexigrove.plans.compiler import Compiler
from lexigrove.plans.parser import English, QueryParseError, Spanish, analyzer, parse, ranked_terms
from tests.conftest import rows

PLAIN = English(False)
FIXTURE = [(1, "red fox runs"), (2, "red dog"), (5, "fox red"), (9, "red red fox")]


def documents(spark, data):
    return spark.createDataFrame([(i, f"t{i}", t, "txt", "extra") for i, t in data], "doc_id long, title string, content string, format string, term string")


def compiler(spark, data, strict=False):
    docs = documents(spark, data)
    return Compiler(ix.postings(ix.occurrences(docs)), docs, strict)


def test_shapes():
    assert parse("cat dog") == AndQuery((TermLiteral("cat"), TermLiteral("dog")))
    assert parse("cat + dog") == OrQuery((TermLiteral("cat"), TermLiteral("dog")))
    assert parse("cat -dog") == AndQuery((TermLiteral("cat"), NotQuery(TermLiteral("dog"))))
    mixed = parse('cat dog + mouse "quick fox"', PLAIN)
    assert isinstance(mixed, OrQuery) and all(isinstance(c, AndQuery) and len(c.components) == 2 for c in mixed.components)
    assert str(mixed) == '(cat AND dog OR mouse AND "quick fox")'
    assert str(parse("-dog")) == "NOT (dog)"


def test_default_corner_cases():
    assert parse("dog ") == TermLiteral("dog") == parse("dog +") == parse("--dog") == parse('"dog"')
    assert parse("- dog") == NotQuery(TermLiteral("dog"))
    assert parse("well-known", PLAIN) == TermLiteral("wellknown")
    assert parse('"a + b"', PLAIN) == PhraseLiteral((TermLiteral("a"), TermLiteral(""), TermLiteral("b")))
    for bad in ("", "+", '"open', "-"):
        with pytest.raises(QueryParseError):
            parse(bad)


def test_strict_corner_cases():
    for bad in ("dog ", "dog +", "c++", ""):
        with pytest.raises(QueryParseError):
            parse(bad, PLAIN, strict=True)
    with pytest.raises(QueryParseError):
        parse('"a + b"', PLAIN, strict=True)
    assert parse("well-known", PLAIN, strict=True) == TermLiteral("well known wellknown")
    assert parse("--dog", PLAIN, strict=True) == NotQuery(NotQuery(TermLiteral("dog")))
    assert ranked_terms("Running-DOG  cat", strict=True) == ["running-dog", "cat"]
    assert ranked_terms("Running dogs, & cats") == ["run", "dog", "cat"]


def test_languages():
    assert isinstance(analyzer("spanish"), Spanish)
    with pytest.raises(ValueError):
        analyzer("klingon")
    assert analyzer("spanish").joined("El niño come") == "el niño come"


@pytest.mark.parametrize(
    ("query", "default", "strict"),
    [
        ("red fox", {1, 5, 9}, {1, 5, 9}),
        ("dog + fox", {1, 2, 5, 9}, {1, 2, 5, 9}),
        ('"red fox"', {1, 9}, {1, 9}),
        ("red -dog", {1, 5, 9}, {1}),
        ("red -zzz", {1, 2, 5, 9}, set()),
        ("-dog", {1, 5, 9}, {2}),
        ('red -"red fox"', {2, 5}, set()),
        ("red &", set(), set()),
        ('-dog -"red fox"', {5}, None),
    ],
)
def test_evaluator(spark, query, default, strict):
    assert {r[0] for r in compiler(spark, FIXTURE).docs(parse(query, PLAIN)).collect()} == default
    if strict is not None:
        assert {r[0] for r in compiler(spark, FIXTURE, True).docs(parse(query, PLAIN, True)).collect()} == strict


def test_positions(spark):
    plan = compiler(spark, FIXTURE)
    assert rows(plan.matched(parse('"red fox"', PLAIN))) == [(1, [2]), (9, [3])]
    assert rows(plan.matched(parse("dog + red", PLAIN))) == [(1, [1]), (2, [2]), (5, [2]), (9, [1, 2])]
    assert rows(plan.matched(parse("red -dog", PLAIN))) == [(1, [1]), (5, [2]), (9, [1, 2])]


def holds(node, words):
    if isinstance(node, TermLiteral):
        return node.term in words
    if isinstance(node, PhraseLiteral):
        n = len(node.terms)
        return any([t.term for t in node.terms] == words[i : i + n] for i in range(len(words)))
    if isinstance(node, NotQuery):
        return not holds(node.component, words)
    return (all if isinstance(node, AndQuery) else any)(holds(c, words) for c in node.components)


def test_random_queries(spark):
    random.seed(11)
    data = [(i, " ".join(random.choices("abcd", k=random.randrange(0, 6)))) for i in range(40)]
    plan = compiler(spark, data)
    for _ in range(12):
        parts = []
        for _ in range(random.randrange(1, 3)):
            literals = [random.choice(["", "-"]) + random.choice(["a", "b", '"a b"', '"b c a"', "z"]) for _ in range(random.randrange(1, 4))]
            parts.append(" ".join(literals))
        tree = parse(" + ".join(parts), PLAIN)
        assert {r[0] for r in plan.docs(tree).collect()} == {i for i, t in data if holds(tree, t.split())}, str(tree)


def test_matches(spark):
    table = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (3, [])], "i int, w array<string>")
    hits = lambda q: {r[0] for r in table.where(parse(q, PLAIN).matches(table["w"])).collect()}
    assert hits("a") == {1} and hits("-a") == {2, 3} and hits('"b a"') == {1} and hits("a + b") == {1, 2}


def test_rank_formulas(spark):
    data = [(1, "a a b"), (2, "a c"), (3, "b b b c"), (4, ""), (6, None), (7, "a c")]
    docs = documents(spark, data)
    occ = ix.occurrences(docs)
    stats = ix.doc_stats(docs, ix.term_frequencies(occ))
    posted, corpus = ix.postings(occ), ix.corpus_stats(stats)
    tfs = {i: {w: (t or "").split().count(w) for w in set((t or "").split())} for i, t in data}
    n, average = len(data), sum(sum(v.values()) for v in tfs.values()) / len(data)
    weighed = ix.weighed(posted)
    for mode in ranking.MODES:
        terms = ["a", "b", "a", "zzz"]
        expected = {}
        for term in terms:
            df = sum(term in v for v in tfs.values())
            for i, v in tfs.items():
                if term in v:
                    if mode == "bm25":
                        s = max(0.1, math.log((n - df + 0.5) / (df + 0.5))) * 2.2 * v[term] / (1.2 * (0.25 + 0.75 * sum(v.values()) / average) + v[term])
                    else:
                        s = math.log(1 + n / df) * (1 + math.log(v[term])) / math.sqrt(sum((1 + math.log(x)) ** 2 for x in v.values()))
                    expected[i] = expected.get(i, 0) + s
        found = ranking.page(ranking.rank(terms, weighed, corpus, mode)).collect()
        assert {r["doc_id"]: r["score"] for r in found} == pytest.approx(expected, abs=1e-6)
        assert [r["doc_id"] for r in found] == [i for i, _ in sorted(expected.items(), key=lambda x: (-round(x[1], 6), 1 if x[0] == 3 else 0, x[0]))]
    assert ranking.rank([], weighed, corpus).count() == 0
    assert ranking.rank(["zzz"], weighed, corpus).count() == 0
    with pytest.raises(ranking.UnknownTermError):
        ranking.rank(["zzz"], weighed, corpus, "tfidf", strict=True)


def test_spelling(spark):
    terms = spark.createDataFrame([("kitten",), ("sitting",), ("mitten",), ("x",)], "term string")
    assert rows(spelling.distances(terms, ["sitting"]), "term", "distance") == [("kitten", 3), ("mitten", 3), ("sitting", 0), ("x", 7)]
    assert [r["term"] for r in spelling.suggest(terms, ["bitten"], 2).orderBy("rank").collect()] == ["kitten", "mitten"]
    assert spelling.correct(terms, "bitten, x siting!").first()[0] == "kitten x sitting"
    assert spelling.correct(terms.limit(0), "Bitten").first()[0] == "Bitten"
