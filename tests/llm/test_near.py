"""Near-duplicates against all pairs."""

import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lexigrove.llm import near as near_module
from lexigrove.llm.near import NearDuplicates, connected
from tests.conftest import rows

SCHEMA = "doc_id long, title string, body string, rep long, g long, words string"


def grams(title, body):
    words = re.findall(r"[^\W_]+", ((title or "") + "\n" + (body or "")).lower())
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


def brute(data):
    sets = {i: grams(t, b) for i, t, b in data if i is not None}
    return sorted(((a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 3), key=repr)


def near(spark, data):
    df = spark.createDataFrame([(i, t, b, 1, 2, "clash") for i, t, b in data], SCHEMA).repartition(4)
    return NearDuplicates(df, "doc_id", ["title", "body"])


def edited(words, times):
    words = list(words)
    for _ in range(times):
        at = random.randrange(len(words))
        kind = random.random()
        words[at : at + 1] = [] if kind < 0.3 else ["x" + str(random.random())] if kind < 0.6 else [words[at], "and"]
    return " ".join(words)


def test_edits_copies_and_edges(spark):
    random.seed(9)
    vocabulary = [f"w{n}" for n in range(60)]
    data, n = [], 0
    for _ in range(25):
        base = [random.choice(vocabulary) for _ in range(random.choice([4, 8, 20, 60, 300]))]
        for _ in range(random.randrange(1, 6)):
            data.append((n, random.choice([None, "", "The Title"]), edited(base, random.randrange(0, 4))))
            n += 1
    data += [(1000 + k, "Same Title", "the same body again, and again") for k in range(60)]
    data += [(2000, None, None), (2001, "", ""), (2002, "one two", None), (2003, "One TWO!", ""), (2004, "one two three", None), (2005, "ONE", "two... three"), (None, "one two three", "")]
    data += data[:10]
    found = near(spark, data)
    assert rows(found.document_pairs()) == brute(data)
    links = {r["doc_id"]: (r["group_id"], r["n_links"]) for r in found.groups().collect()}
    assert links[1005] == (1000, 59) and links[2000][1] <= 1
    for a, b in brute(data):
        assert links[a][0] == links[b][0]


def test_versions_are_classes_not_pairs(spark):
    random.seed(3)
    base = [f"w{random.randrange(5000)}" for _ in range(300)]
    data = [(n, None, edited(base, random.choice([1, 2, 6, 14]))) for n in range(120)]
    other = base[:150] + [f"v{random.randrange(5000)}" for _ in range(60)]
    data += [(500 + n, None, edited(other, random.choice([1, 3, 9]))) for n in range(40)]
    data += [(900 + n, None, edited(base, 1)) for n in range(3)] * 2
    found = near(spark, data)
    pairs = brute(data)
    assert rows(found.document_pairs()) == pairs
    links = {r["doc_id"]: (r["group_id"], r["n_links"]) for r in found.groups().collect()}
    counts = {}
    for a, b in pairs:
        for x in (a, b):
            counts[x] = counts.get(x, 0) + 1
        assert links[a][0] == links[b][0]
    assert {i: n for i, (_, n) in links.items() if n} == counts
    assert found.classes.count() > 80 and found.cross.count() < len(pairs) / 2


def test_by_shuffle(spark, monkeypatch):
    random.seed(5)
    monkeypatch.setattr(near_module, "BROADCAST_BYTES", 0)
    data = [(n, "t", edited([f"w{n % 7 * 50 + k}" for k in range(40)], n % 4)) for n in range(60)]
    data += [(100 + n, "t", data[3][2]) for n in range(5)]
    assert rows(near(spark, data).document_pairs()) == brute(data)


def test_empty(spark):
    found = near(spark, [])
    assert rows(found.document_pairs()) == [] and rows(found.groups()) == []


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(st.lists(st.sampled_from("abcde"), max_size=9), max_size=12))
def test_small_alphabets(spark, texts):
    data = [(i, None, " ".join(t)) for i, t in enumerate(texts)]
    assert rows(near(spark, data).document_pairs()) == brute(data)


def test_connected(spark):
    chain = [(n, n + 1) for n in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    edges = spark.createDataFrame(chain, "a long, b long")
    found = dict(rows(connected(edges)))
    assert all(found[n] == 0 for n in range(41)) and found[100] == found[95] == found[90] == 90
