"""Per-key results of heavy keys against plain counting."""

import random
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lexigrove.operators.ranges import heavy_key_counts, keys_with_share
from tests.conftest import rows

SCHEMA = "term string, doc_id long, token_pos int, key string, doc long, part int"


def brute(data):
    n, docs, positions = defaultdict(int), defaultdict(set), defaultdict(set)
    for term, doc, pos in data:
        n[term] += 1
        if doc is not None:
            docs[term].add(doc)
            if pos is not None:
                positions[term].add((doc, pos))
    return sorted(((t, n[t], len(docs[t]), len(positions[t])) for t in n), key=repr)


def run(spark, data):
    table = [(t, d, p, "clash", 7, 9) for t, d, p in data]
    df = spark.createDataFrame(table, SCHEMA).repartition(5)
    return heavy_key_counts(df, "term", "doc_id", "token_pos")


def test_heavy_key_is_cut_and_stitched(spark):
    random.seed(3)
    data = [("the", random.randrange(40), random.randrange(30)) for _ in range(4000)]
    data += [(random.choice(["a", "b", "", None, "zebra"]), random.choice([1, 2, None]), random.choice([0, 1, None])) for _ in range(600)]
    data += [("same", 5, 5)] * 1500
    out = run(spark, data)
    assert rows(out) == brute(data)
    assert rows(keys_with_share(out, "term", 2, 100)) == sorted((t,) for t, n, *_ in brute(data) if t is not None and n * 50 >= len(data))


def test_one_document_spans_several_partitions(spark):
    data = [("x", 1, p % 3) for p in range(2000)]
    assert rows(run(spark, data)) == [("x", 2000, 1, 3)]


def test_empty_table(spark):
    out = run(spark, [])
    assert rows(out) == []
    assert rows(keys_with_share(out, "term", 2, 100)) == []


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(data=st.lists(st.tuples(st.sampled_from(["a", "b", "", None]), st.sampled_from([1, 2, 3, None]), st.sampled_from([0, 1, None])), max_size=60))
def test_any_rows(spark, data):
    assert rows(run(spark, data)) == brute(data)
