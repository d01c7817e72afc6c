"""Shares, caps and repeatability of mixtures."""

import os

import pytest

from lexigrove.llm.mixture import Mixture
from lexigrove.llm.tokenizer import DEFAULT_VOCABULARY
from tests.conftest import rows

pytestmark = pytest.mark.skipif(not os.path.exists(DEFAULT_VOCABULARY), reason="no vocabulary")


def documents(spark, data):
    return spark.createDataFrame([(i, s, t, 3) for i, s, t in data], "doc_id long, source string, text string, copies int")


def targets(spark, data):
    return spark.createDataFrame(data, "source string, target_share double, max_repeats int")


def test_shares(spark):
    data = [(n, [" Big", "big ", "BIG"][n % 3], "one two three four") for n in range(4000)]
    data += [(10000 + n, "small", "one two three four five") for n in range(1000)]
    data += [(20000 + n, "tiny", "word") for n in range(10)]
    data += [(30000, None, "x"), (30001, "zero", "x y"), (30002, "unlisted", "x"), (30003, "big", None), (30004, "big", ""), (30005, "", "x")]
    wanted = [("big", 0.5, 1), ("Small ", 0.4, 4), ("tiny", 0.1, 3), ("zero", 0.0, 5), ("absent", 0.0, 2), (None, 0.1, 1)]
    mixture = Mixture(documents(spark, data).repartition(4), targets(spark, wanted))
    copies = {r["doc_id"]: (r["source"], r["copies"]) for r in mixture.counts().collect()}
    assert all(c <= {"big": 1, "small": 4, "tiny": 3}[s] for s, c in copies.values())
    assert not {30000, 30001, 30002, 30003, 30004, 30005} & set(copies)
    assert all(copies[20000 + n] == ("tiny", 3) for n in range(10))
    report = {r["source"]: r for r in mixture.report().collect()}
    assert sum(r["share"] for r in report.values()) == pytest.approx(1)
    assert report["tiny"]["share"] < 0.01 and report["zero"]["mixed_tokens"] == 0 and report["absent"]["n_docs"] == 0
    assert report["big"]["share"] / report["small"]["share"] == pytest.approx(0.5 / 0.4, rel=0.05)
    assert mixture.rows().count() == sum(c for _, c in copies.values())
    again = Mixture(documents(spark, data).repartition(2), targets(spark, wanted))
    assert rows(again.counts()) == rows(mixture.counts())
    assert rows(Mixture(documents(spark, data), targets(spark, wanted), seed=1).counts()) != rows(mixture.counts())


def test_empty(spark):
    mixture = Mixture(documents(spark, []), targets(spark, [("a", 1.0, 2)]))
    assert mixture.rows().count() == 0 and mixture.report().first()["share"] == 0
    none = Mixture(documents(spark, [(1, "a", "x")]), targets(spark, []))
    assert none.rows().count() == 0 and none.report().count() == 0
    odd = Mixture(documents(spark, [(1, "a", "x")]), targets(spark, [("a", None, None), ("A", 1.0, 2)]))
    assert odd.report().count() == 1 and odd.rows().count() == 1
