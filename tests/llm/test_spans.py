"""Shared spans against all 200-character windows."""

import random

import numpy as np
from pyspark.sql import functions as F

from lexigrove.llm import spans
from lexigrove.llm.queries import LLM_QUERIES
from tests.conftest import rows

SCHEMA = "doc_id long, text string, tid long, h long, pos int"


def brute(data, span):
    where = {}
    texts = {i: t for i, t in data if i is not None and t is not None}
    for i, text in texts.items():
        for at in range(len(text) - span + 1):
            where.setdefault(text[at : at + span], set()).add(i)
    pairs = {(a, b) for v in where.values() if len(v) > 1 for a in v for b in v if a < b}
    shared = {}
    for i, text in texts.items():
        marked = np.zeros(len(text), bool)
        for at in range(len(text) - span + 1):
            if len(where[text[at : at + span]]) > 1:
                marked[at : at + span] = True
        shared[i] = int(marked.sum())
    return sorted(pairs, key=repr), shared


def check(spark, data, monkeypatch=None, hot=None):
    if hot is not None:
        monkeypatch.setattr(spans, "HOT_TEXTS", hot)
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in data], SCHEMA).repartition(4)
    found = spans.SharedSpans(df, "doc_id", "text")
    pairs, shared = brute(data, 200)
    assert rows(found.document_pairs()) == pairs
    extent = {r["doc_id"]: r["n_shared"] for r in found.shared_extent().collect()}
    assert extent == {i: n for i, n in shared.items() if len(dict((x, t) for x, t in data)[i]) >= 200}
    return found


def noise(n, alphabet="abcdefgh ñé🙂"):
    return "".join(random.choices(alphabet, k=n))


def built():
    random.seed(8)
    data = [(n, noise(random.randrange(100, 900))) for n in range(40)]
    for n in range(14):
        passage = noise(random.choice([150, 199, 200, 201, 250, 700]))
        for k in random.sample(range(40), 2):
            i, text = data[k]
            at = random.randrange(len(text))
            data[k] = (i, text[:at] + passage + text[at:])
    hot = noise(230)
    decoy = noise(199)
    data += [(100 + n, noise(50) + hot + noise(60)) for n in range(12)]
    data += [(200 + n, noise(50) + decoy + noise(60)) for n in range(12)]
    data += [(300 + n, data[5][1]) for n in range(5)]
    data += [(400, "-" * 2500), (401, "x" + "-" * 600), (402, "-" * 199), (403, "ab" * 400), (404, "ab" * 300 + "c")]
    data += [(500, None), (501, ""), (502, "short"), (None, data[5][1]), (300, data[5][1])]
    return data


def test_all_pairs(spark):
    found = check(spark, built())
    long = found.text_pairs()
    assert long.where("longest < 200 OR exact_chars < longest OR a_end - a_start < longest").count() == 0


def test_hot_seeds_by_windows(spark, monkeypatch):
    check(spark, built(), monkeypatch, 3)


def test_results_do_not_depend_on_hot_seeds(spark, monkeypatch):
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in built()], SCHEMA).repartition(4)
    found = []
    for hot in (1, 10_000):
        monkeypatch.setattr(spans, "HOT_TEXTS", hot)
        one = spans.SharedSpans(df, "doc_id", "text")
        passages = rows(one.passages().where("longest >= 200"), "a", "b", "a_start", "a_end", "b_start", "b_end", "n_seeds", "exact_chars", "longest")
        found.append((passages, rows(one.document_pairs()), rows(one.text_pairs().select(*sorted(one.text_pairs().columns))), rows(one.shared_stretches())))
        one.close()
    assert found[0] == found[1] and found[0][0] and found[0][2]


def test_texts_with_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(spans, "_text_hash", lambda text: F.pmod(F.xxhash64(text), F.lit(7)))
    check(spark, built())


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(spans, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in built()], SCHEMA)
        found = spans.SharedSpans(df, "doc_id", "text").document_pairs()
        assert rows(found) == brute(built(), 200)[0]
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_aligned_passages_and_their_texts(spark):
    random.seed(12)
    first, second, twice = noise(300), noise(320), noise(400)
    data = [
        (1, noise(150) + first + "changed" + second + noise(90)),
        (2, noise(40) + first + "other word" + second + noise(10)),
        (4, noise(70) + twice + noise(1500) + twice + noise(30)),
        (5, noise(20) + twice + noise(60)),
        (6, "y" + "ab" * 400),
        (7, "ab" * 300 + "z"),
    ]
    data.append((3, data[0][1]))
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in data], SCHEMA).repartition(3)
    assert {"p8_aligned", "p8_texts"} <= set(LLM_QUERIES)
    found = spans.SharedSpans(df, "doc_id", "text")
    texts = dict(data)
    passages = {}
    for r in found.text_pairs().collect():
        sides = sorted([(r["doc_id_a"], r["a_start"], r["a_end"], r["copies_a"]), (r["doc_id_b"], r["b_start"], r["b_end"], r["copies_b"])])
        passages.setdefault((sides[0][0], sides[1][0]), []).append((*sides[0][1:], *sides[1][1:], r["longest"], r["exact_chars"]))
    assert set(passages) == {(1, 2), (4, 5), (6, 7)}
    (one,) = passages[1, 2]
    assert one[2] == 2 and one[5] == 1 and 320 <= one[6] < 325 and one[7] >= 620
    assert texts[1][one[0] : one[1]].endswith(second) and first + "changed" in texts[1][one[0] : one[1]]
    assert first + "other word" + second in texts[2][one[3] : one[4]]
    assert len(passages[4, 5]) == 2 and all(twice in texts[4][p[0] : p[1]] and twice in texts[5][p[3] : p[4]] for p in passages[4, 5])
    assert max(p[6] for p in passages[6, 7]) == 600
    assert rows(found.classes(), "doc_id", "text_doc_id") == [(1, 1), (2, 2), (3, 1), (4, 4), (5, 5), (6, 6), (7, 7)]


def test_extents_do_not_depend_on_hot_seeds(spark, monkeypatch):
    random.seed(24)
    edge, middle = noise(170), noise(320)
    data = [(n, noise(60) + edge + f"changed {n}" + middle + noise(90), 1, 2, 3) for n in range(4)]
    data.append((9, noise(80) + edge + noise(80), 1, 2, 3))
    df = spark.createDataFrame(data, SCHEMA)
    found = []
    for hot in (24, 2):
        monkeypatch.setattr(spans, "HOT_TEXTS", hot)
        found.append(rows(spans.SharedSpans(df, "doc_id", "text").text_pairs()))
    assert len(found[0]) == 6 and found[0] == found[1]
    assert all(r[5] >= 490 for r in found[0])


def test_long_text_in_blocks(spark, monkeypatch):
    random.seed(1)
    monkeypatch.setattr(spans, "_BLOCK", 1 << 18)
    passage = noise(220)
    text = noise((1 << 18) - 110) + passage + noise(5000)
    df = spark.createDataFrame([(1, text, 1, 2, 3), (2, noise(300) + passage, 1, 2, 3)], SCHEMA)
    assert rows(spans.SharedSpans(df, "doc_id", "text").document_pairs()) == [(1, 2)]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    found = spans.SharedSpans(df, "doc_id", "text")
    assert rows(found.document_pairs()) == [] and rows(found.shared_extent()) == [] and rows(found.text_pairs()) == []


def test_chain_is_collinear():
    seeds = sorted([(0, 0, 0, 0), (120, 125, 0, 0), (240, 250, 0, 0), (130, 900, 0, 0), (5000, 5000, 0, 0)])
    chains = spans.chain(seeds, 100)
    assert [0, 1, 3] in [c for c in chains] or [seeds[i] for i in chains[0]] == [(0, 0, 0, 0), (120, 125, 0, 0), (240, 250, 0, 0)]
    assert sorted(i for c in chains for i in c) == list(range(5))


def test_chain_equals_quadratic_search():
    random.seed(6)
    for _ in range(30):
        seeds = sorted({(random.randrange(0, 600, 20), random.randrange(0, 600, 20), 0, 0) for _ in range(15)})
        best = []
        for i, (a, b, *_) in enumerate(seeds):
            steps = [best[j] + min(100, a - seeds[j][0], b - seeds[j][1]) - spans.GAP_COST * (a + b - seeds[j][0] - seeds[j][1]) for j in range(i) if seeds[j][0] < a and seeds[j][1] < b and a - seeds[j][0] <= 500 and b - seeds[j][1] <= 500]
            best.append(max([100, *steps]))
        first = spans.chain(seeds, 100)[0]
        assert all(seeds[x][0] < seeds[y][0] and seeds[x][1] < seeds[y][1] for x, y in zip(first, first[1:]))


def test_chain_scores_equal_quadratic_search():
    random.seed(16)
    bests = []
    for n, most, step in [(15, 600, 20), (60, 900, 7), (80, 4000, 11), (200, 400, 3)] * 15:
        seeds = sorted({(random.randrange(0, most, step), random.randrange(0, most, step), 0, 0) for _ in range(n)})
        best = []
        for i, (a, b, *_) in enumerate(seeds):
            steps = [best[j] + min(100, a - seeds[j][0], b - seeds[j][1]) - spans.GAP_COST * (a + b - seeds[j][0] - seeds[j][1]) for j in range(i) if seeds[j][0] < a and seeds[j][1] < b and a - seeds[j][0] <= 500 and b - seeds[j][1] <= 500]
            best.append(max([100, *steps]))
        first = spans.chain(seeds, 100)[0]
        steps = [(seeds[y][0] - seeds[x][0], seeds[y][1] - seeds[x][1]) for x, y in zip(first, first[1:])]
        assert abs(100 + sum(min(100, a, b) - spans.GAP_COST * (a + b) for a, b in steps) - max(best)) < 1e-6
        bests.append((seeds, best))
    for seeds, best in bests:
        score, before = spans._best_steps(seeds, 100)
        assert np.allclose(score, best)
        for i, j in enumerate(before):
            own = 100 if j < 0 else score[j] + min(100, seeds[i][0] - seeds[j][0], seeds[i][1] - seeds[j][1]) - spans.GAP_COST * (seeds[i][0] + seeds[i][1] - seeds[j][0] - seeds[j][1])
            assert abs(own - score[i]) < 1e-6


def test_second_place_of_a_passage_is_one_chain():
    seeds = [(p, p, 0, 0) for p in range(0, 3000, 70)] + [(4000 + p, p, 0, 0) for p in range(2030, 2900, 60)]
    assert sorted(map(len, spans.chain(seeds, 100))) == [15, 43]


def test_chain_skips_no_seed_of_a_diagonal():
    random.seed(5)
    for _ in range(50):
        at = sorted(random.sample(range(2000), 60))
        assert spans.chain([(p + 9, p, 0, 0) for p in at], 100) == [list(range(60))]


def test_minimizers_cover_every_window():
    random.seed(3)
    for text in (noise(900), "a" * 900, "abc" * 300):
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at, _ = spans.minimizers(points, np.array([len(text)]), 100, 200)
        for begin in range(len(text) - 199):
            assert ((at >= begin) & (at <= begin + 100)).any()
