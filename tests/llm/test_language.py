"""Language models on held-out samples and built documents."""

import os
import random

import duckdb
import numpy as np
import pytest

from lexigrove.llm import language as lg
from tests.conftest import rows

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def samples():
    return duckdb.sql(f"SELECT lang, sample_text FROM '{DATA}/language_samples.parquet' ORDER BY lang, sample_id").fetchall()


def test_held_out_accuracy(samples):
    fit, held = samples[::2], samples[1::2]
    identifier = lg.Identifier(fit)
    found = identifier.segments([t for _, t in held])
    right = sum(len(f) == 1 and f[0][1] == lang for f, (lang, _) in zip(found, held))
    assert right / len(held) >= 0.98
    bare = identifier.segments([lg.plain(t).upper() for _, t in held])
    assert sum(f[0][1] == lang for f, (lang, _) in zip(bare, held)) / len(held) >= 0.97


def test_probabilities_sum_to_one(samples):
    models = lg.Models(samples[::10], order=3)
    lang = models.langs[0]
    words = [w for x, t in samples[::10] if x == lang for w in lg._WORD.findall(t.lower())]
    probs, weights = models._probabilities(models._counts(lg.Counter(words)))
    for context in ["", "t", "th"]:
        total = sum(models._chain(probs, weights, context + c) for c in {g[-1] for g in probs})
        assert 0.9 < total <= 1.0001


def test_vectors_agree_with_definition(samples):
    models = lg.Models(samples[::6])
    words = ["the", "xqz", "niño", "über", "a"]
    scores = models.score(words)
    probs = []
    for lang in models.langs:
        own = [w for x, t in samples[::6] if x == lang for w in lg._WORD.findall(t.lower())]
        probs.append(models._probabilities(models._counts(lg.Counter(own + [p for w in own if (p := lg.plain(w)) != w]))))
    for i, word in enumerate(words):
        marked = lg._MARK * 4 + word + lg._MARK
        for j, (p, w) in enumerate(probs):
            known = {g for q, _ in probs for g in q if len(g) == 1}
            if all(c in known for c in word):
                expected = sum(np.log(models._chain(p, w, marked[k - 4 : k + 1])) for k in range(4, len(marked)))
                assert scores[i, j] == pytest.approx(expected, rel=1e-6)


def test_mixed_documents(samples):
    random.seed(2)
    identifier = lg.Identifier(samples[::2])
    held: dict = {}
    for lang, text in samples[1::2]:
        held.setdefault(lang, []).append(text)
    right = 0
    for _ in range(60):
        langs = random.sample(sorted(held), 2)
        text = "\n".join(random.choice(held[x]) for x in langs)
        right += [s[1] for s in identifier.segments([text])[0]] == langs
    assert right >= 57


def test_short_stretches_fall_to_their_neighbours():
    path = np.array([0] * 10 + [1] * 7 + [0] * 3 + [2] * 9)
    assert lg.Identifier.runs(path) == [[0, 0, 20], [2, 20, 29]]
    assert lg.Identifier.runs(np.array([1] * 3)) == [[1, 0, 3]]
    assert lg.Identifier.runs(np.array([1] * 3 + [0] * 8)) == [[0, 0, 11]]


def test_rejection(samples):
    found = lg.Identifier(samples).segments(["zxqj wvkq jjxz qqzx kkwv zzxq jxkw vvqz qzkx wwjx"])[0]
    assert len(found) == 1 and found[0][0] is None and found[0][1] is not None


def test_confidence_is_calibrated(samples):
    identifier = lg.Identifier(samples[::2])
    for length in (1, 2, 4, 8):
        found = [identifier.confidences(lang, text, length) for lang, text in samples[1::2]]
        confidence, right = (np.concatenate(x) for x in zip(*found))
        bins = np.minimum((confidence * 10).astype(int), 9)
        error = sum(abs(confidence[bins == i].mean() - right[bins == i].mean()) * (bins == i).sum() for i in set(bins)) / len(bins)
        print(length, len(bins), "accuracy", right.mean().round(4), "confidence", confidence.mean().round(4), "error", error.round(4), [(i, int((bins == i).sum()), confidence[bins == i].mean().round(2), right[bins == i].mean().round(2)) for i in sorted(set(bins))])
        assert error < 0.06


def test_foreign_text_is_rejected(samples):
    identifier = lg.Identifier(samples)
    held = lg.Identifier(samples[::2])
    foreign = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki",
        "Minden emberi lény szabadon születik és egyenlő méltósága és joga van az emberek ésszel",
        "Все люди рождаются свободными и равными в своём достоинстве и правах они наделены разумом",
    ]
    assert [s[0] for f in identifier.segments(foreign) for s in f].count(None) >= 3
    assert all(s[0] is not None for f in held.segments([t for _, t in samples[1::2]]) for s in f)


def test_labels_of_samples(spark, samples):
    names = {"en": "English", "de": "ger", "es": "es-MX"}
    data = [(i, names.get(lang, lang), t, 1) for i, (lang, t) in enumerate(samples)]
    model = lg.train(spark.createDataFrame(data, "sample_id long, lang string, sample_text string, extra int"))
    assert lg.pickle.loads(model).langs == sorted({lang for lang, _ in samples})


def test_rejected_segments_are_cases(spark, samples):
    table = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(samples)], "sample_id long, lang string, sample_text string")
    df = spark.createDataFrame([(3, "zxqj wvkq jjxz qqzx kkwv zzxq jxkw vvqz qzkx wwjx", "en")], "doc_id long, body string, lang_label string")
    assert rows(lg.wrong_labels(lg.identify(df, "doc_id", "body", "lang_label", table), "doc_id")) == [(3, 1, "und")]


def test_tables(spark, samples):
    table = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(samples)], "sample_id long, lang string, sample_text string")
    english, spanish = ([t for x, t in samples if x == lang] for lang in ("en", "es"))
    data = [
        (1, english[0], "EN-us", 5),
        (2, english[1], None, 5),
        (3, english[2], "Spanish", 5),
        (4, english[3] + "\n" + spanish[3], "eng", 5),
        (5, None, None, 5),
        (6, "", "xx", 5),
        (7, "two words", "und", 5),
        (8, "12 13 14 15 16 17 18 19 20", "en", 5),
        (2, english[1], None, 5),
        (9, spanish[4] * 300, "spa", 5),
        (10, spanish[5], "unknown", 5),
    ]
    df = spark.createDataFrame(data, "doc_id long, body string, lang_label string, segments int").repartition(3)
    found = lg.identify(df, "doc_id", "body", "lang_label", table)
    assert rows(lg.wrong_labels(found, "doc_id")) == sorted([(2, 1, "en"), (3, 1, "en"), (4, 1, "en"), (4, 2, "es"), (10, 1, "es")], key=repr)
    table = {(r["doc_id"], r["seg_no"]): r for r in lg.document_languages(found, "doc_id").collect()}
    assert table[1, 1]["label_lang"] == "en" and table[1, 1]["confidence"] > 0.9
    assert (5, None) in table and table[5, None]["doc_lang"] is None
    assert lg.identify(df.limit(0), "doc_id", "body", "lang_label", spark.createDataFrame([], "sample_id long, lang string, sample_text string")).count() == 0


def test_document_language_by_all_its_words(spark, samples):
    english, spanish = (" ".join(t for x, t in samples if x == lang).split() for lang in ("en", "es"))
    data = [
        (1, "\n".join(" ".join(w) for w in (english[:30], spanish[:50], english[30:60])), "en"),
        (2, " ".join(english[:60]), "en"),
        (3, "zxqj wvkq jjxz qqzx kkwv zzxq jxkw vvqz qzkx wwjx", "en"),
    ]
    df = spark.createDataFrame(data, "doc_id long, body string, lang_label string")
    table = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(samples)], "sample_id long, lang string, sample_text string")
    found = lg.document_languages(lg.identify(df, "doc_id", "body", "lang_label", table), "doc_id").collect()
    assert [r["lang"] for r in sorted(found, key=lambda r: (r["doc_id"], r["seg_no"]))] == ["en", "es", "en", "en", None]
    main = {r["doc_id"]: (r["doc_lang"], r["doc_confidence"]) for r in found}
    assert main[1][0] == "en" and 0 < main[1][1] < main[2][1] <= 1
    assert main[2][0] == "en" and main[2][1] > 0.9 and main[3] == (None, None)
