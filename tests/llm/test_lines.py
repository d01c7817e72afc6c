"""Repeated lines against counting, and the bitmaps against sets."""

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigrove.llm import bitmaps
from lexigrove.llm.lines import RepeatedLines
from tests.conftest import rows

SCHEMA = "doc_id long, site string, body string, line_key string, way int, need int"


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 65535), max_size=300), st.sets(st.integers(0, 65535), max_size=300), st.integers(0, 65000), st.integers(0, 500))
def test_bitmaps(a, b, begin, length):
    a = a | set(range(begin, min(65536, begin + length)))
    x, y = (bitmaps.encode(np.array(sorted(s), dtype=np.int64)) for s in (a, b))
    both = bitmaps.union([x, y])
    assert set(bitmaps.decode(both).tolist()) == a | b and bitmaps.cardinality(both) == len(a | b)
    assert bitmaps.cardinality(x) == len(a)
    asked = [*list(a)[:5], *list(b)[:5], 0, 65535, begin, begin + length]
    for container, ids in ((both, a | b), (y, b), (x, a)):
        assert bitmaps.among(container, np.array(asked)).tolist() == [n in ids for n in asked]


def test_bitmaps_are_compressed():
    assert bitmaps.encode(np.arange(65536))[:1] == b"r" and len(bitmaps.encode(np.arange(65536))) == 5
    assert bitmaps.encode(np.array([5]))[:1] == b"a"
    dense = bitmaps.encode(np.arange(0, 65536, 2))
    assert dense[:1] == b"b" and len(dense) == 8193 and bitmaps.cardinality(dense) == 32768


def norm(line):
    return " ".join(line.split()).lower()


def brute(data):
    docs = {}
    for i, site, body in data:
        if i is not None and site is not None:
            docs[i] = (site, body)
    sites, where = {}, {}
    for i, (site, body) in docs.items():
        sites[site] = sites.get(site, 0) + 1
        for line in (body or "").split("\n"):
            if re.search(r"[^\W_]", line):
                where.setdefault((site, norm(line)), set()).add(i)
    bad = {k for k, v in where.items() if len(v) >= 5 and len(v) * 10 >= sites[k[0]]}
    return sorted(((i, n) for i, (site, body) in docs.items() for n, line in enumerate((body or "").split("\n"), 1) if (site, norm(line)) in bad), key=repr), bad


def repeated(spark, data):
    df = spark.createDataFrame([(i, s, b, "clash", 1, 2) for i, s, b in data], SCHEMA).repartition(4)
    return RepeatedLines(df, "doc_id", "site", "body")


def test_lines(spark):
    random.seed(4)
    legal = ["All rights reserved.", " all  RIGHTS\treserved.\r", " All rights reserved. "]
    data = []
    for n in range(300):
        site = random.choice(["a"] * 6 + ["b", "c", None])
        lines = [f"text {random.randrange(400)}", random.choice([*legal, "Share this", "—", ""]), random.choice(["x", "Share  THIS", "once " + str(n)])]
        data.append((n * 70000 if n % 7 == 0 else n, site, random.choice(["\n".join(lines)] * 9 + [None])))
    data += data[:20]
    data += [(None, "a", "All rights reserved."), (777777, "z", "only\nonly\nonly\nonly\nonly\nonly"), (777778, "a", "long " * 30000 + "\nShare this")]
    found = repeated(spark, data)
    expected, bad = brute(data)
    assert rows(found.found()) == expected
    assert sorted(r[:2] for r in rows(found.by_site())) == sorted(bad)
    bodies = {i: body for i, _, body in rows(found.cleaned())}
    gone = set(expected)
    for i, _, body in data:
        if i is not None:
            kept = None if body is None else "\n".join(x for n, x in enumerate(body.split("\n"), 1) if (i, n) not in gone)
            assert bodies[i] == kept


def test_bodies_with_one_id(spark):
    data = [(n, "s", f"Same line\nown {n}") for n in range(1, 8)]
    data += [(1, "z", "first line\nkept line"), (2, None, "Same line"), (3, "s", "other\nSame line"), (8, "s", None), (8, "s", None)]
    cleaned = rows(repeated(spark, data).cleaned())
    assert cleaned == sorted([(n, "s", f"own {n}") for n in range(1, 8)] + [(1, "z", "first line\nkept line"), (2, None, "Same line"), (3, "s", "other"), (8, "s", None)], key=repr)


def test_lines_are_looked_up_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        data = [(n * 9000, "s", "Same line\nSAME  line\n" + ("twice" if n % 2 else "x" + str(n))) for n in range(30)]
        assert rows(repeated(spark, data).found()) == brute(data)[0]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty(spark):
    found = repeated(spark, [])
    assert rows(found.found()) == [] and rows(found.by_site()) == [] and rows(found.cleaned()) == []
