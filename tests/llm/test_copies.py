"""Formatting copies against grouping by canonical keys."""

import json
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from lexigrove.llm import copies
from tests.conftest import rows

SCHEMA = "file_id long, site string, raw_json string, key string, id long, run_id long"


def canon(text):
    return re.sub(r"[\W_]+", "", (text or "").lower())


def brute(data):
    sets = defaultdict(set)
    for i, raw in data:
        try:
            o = json.loads(raw)
        except (TypeError, ValueError):
            continue
        key = canon(o.get("title")), canon(o.get("body"))
        if i is not None and any(key):
            sets[key].add(i)
    return sorted((min(s), i) for s in sets.values() for i in s)


def assign(spark, data, parts=6):
    df = spark.createDataFrame([(i, "s", raw, "clash", 1, 2) for i, raw in data], SCHEMA).repartition(parts)
    return copies.assign_representatives(df, "file_id", copies.file_key("raw_json"))


def spelled(title, body, k):
    title, body = (title.upper(), body) if k % 2 else (title, re.sub(" ", "  \t", body))
    members = [("title", title), ("body", body), ("slug", f"x{k}")]
    random.shuffle(members)
    return json.dumps(dict(members), ensure_ascii=bool(k % 3), indent=k % 4 or None)


def test_hot_set_spans_partitions(spark):
    random.seed(5)
    data = [(n, spelled("Árbol – uno", "Hello, World! 1.", n)) for n in range(700)]
    data += [(1000 + n, spelled(f"t{n % 90}", "b", n)) for n in range(400)]
    data += data[:50]
    data += [(9001, None), (9002, ""), (9003, '{"title": "cut'), (9004, '{"title": null, "body": "!!"}'), (9005, '{"slug": "x"}'), (None, '{"title": "t1", "body": "b"}'), (9006, '{"body": "b"}'), (9007, '{"title": "", "body": "B."}')]
    data += [(9010, json.dumps({"title": "long", "body": "y " * 200000})), (9011, json.dumps({"title": "LONG", "body": "y" * 200000}))]
    random.shuffle(data)
    found = assign(spark, data)
    assert rows(found, "keep_id", "id") == sorted(brute(data), key=repr)
    assert dict(rows(copies.collapse(found), "keep_id", "n_copies"))[0] == 700
    assert (9006, 9007) in rows(copies.copies(found), "keep_id", "copy_id")


def test_one_key_only(spark):
    found = assign(spark, [(n, '{"title": "Same"}') for n in range(500)], 3)
    assert {r["keep_id"] for r in found.collect()} == {0} and found.count() == 500


def test_accents_count_and_title_is_not_body(spark):
    data = [(1, '{"title": "ola"}'), (2, '{"title": "olá"}'), (3, '{"body": "ola"}'), (4, '{"title": "ol", "body": "a"}')]
    assert rows(copies.copies(assign(spark, data))) == []


def test_metadata(spark):
    data = [(3, "A b", 5), (1, "a-B!", 5), (2, "ab", 6), (4, "—", 5), (5, None, 5), (6, "ab", None), (7, "AB", 6), (7, "AB", 6)]
    df = spark.createDataFrame(data, "doc_id long, title string, doc_length long")
    found = copies.assign_representatives(df, "doc_id", copies.metadata_key("title", "doc_length"))
    assert rows(copies.copies(found)) == [(1, 3), (2, 7)]


def test_empty(spark):
    assert assign(spark, []).count() == 0
    df = spark.createDataFrame([], SCHEMA)
    assert copies.assign_representatives(df, "file_id", F.lit("k")).count() == 0


def test_collapsed_and_kept_records(spark):
    data = [(1, "A b", 3), (2, "a-B", 3), (3, "...", 3), (3, "...", 3), (4, None, 1), (5, "x", None), (None, "a b", 3), (2, "a-B", 3)]
    df = spark.createDataFrame(data, "doc_id long, title string, doc_length long")
    members = copies.assign_representatives(df, "doc_id", copies.metadata_key("title", "doc_length"))
    found = copies.collapse(members, df, "doc_id")
    assert rows(found) == [(1, 2), (3, 1), (4, 1), (5, 1)]
    assert rows(copies.records(found, df, "doc_id", ["title", "doc_length"])) == [(1, 2, "A b", 3), (3, 1, "...", 3), (4, 1, None, 1), (5, 1, "x", None)]
    assert rows(copies.collapse(members.limit(0), df.limit(0), "doc_id")) == []
