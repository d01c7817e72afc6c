"""Index tables, files, the engine and streams."""

import json

import pytest
from pyspark.sql import functions as F

from lexigrove.finder import Finder
from lexigrove.operators import index as ix
from lexigrove.sources.files import Corpus, merged_postings, read_xml
from lexigrove.streaming.ingest import compact, index_stream, streamed_index, term_counts
from tests.conftest import rows

TEI = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><title>Hi</title><p>a <b>bold</b> tail</p></TEI>'


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "doc1.json").write_text(json.dumps({"title": "test", "body": "This is a test json document."}))
    (tmp_path / "deep/doc2.txt").write_text("This is a test text document.\nRunning foxes")
    (tmp_path / "doc3.xml").write_text(TEI)
    (tmp_path / "doc4.csv").write_text("ignored")
    (tmp_path / "doc5.json").write_text('{"body": null}')
    return tmp_path


def test_directory(spark, folder):
    corpus = Corpus.from_directory(spark, str(folder))
    assert len(corpus) == 4
    found = {r["title"]: r for r in corpus.documents.collect()}
    assert found["test"]["content"] == "This is a test json document."
    assert found["doc2"]["content"].startswith("This is a test text document.")
    assert found["Hi"]["content"] == "Hi\na \nbold"
    assert found[""]["content"] == ""
    assert sorted(r["doc_id"] for r in found.values()) == [0, 1, 2, 3]
    assert corpus.get(0).count() == 1 and corpus.get(999).count() == 0
    assert "test (ID" in " ".join(r["display"] for r in corpus.display().collect())
    assert len(Corpus.from_directory(spark, str(folder), [".txt"])) == 1
    assert len(Corpus.from_directory(spark, str(folder), predicate=~F.col("path").contains("deep"))) == 3
    with pytest.raises(ValueError):
        Corpus.from_directory(spark, str(folder), ["csv"])


def test_added_format(spark, folder):
    reader = lambda raw: raw.select("path", F.lit("csv").alias("title"), F.col("value").alias("content"))
    assert len(Corpus.from_directory(spark, str(folder), readers={"csv": reader})) == 5


def test_xml_titles():
    tei = "http://www.tei-c.org/ns/1.0"
    assert read_xml(f'<a xmlns="{tei}"><head><title>x</title></head></a>')[0] == "x"
    assert read_xml("<a><title>no namespace</title> </a>") == ("", "no namespace", None)
    assert read_xml(f'<a xmlns="{tei}"><head><title/></head><title> </title></a>')[0] == " "
    assert read_xml(f'<a xmlns="{tei}"><x><title>deep</title></x>lost<b>kept<i/>lost</b></a>') == ("", "deep\nkept", None)
    assert read_xml("<a><b>cut")[:2] == ("", "") and "line 1" in read_xml("<a><b>cut")[2]
    assert read_xml("")[2]


def test_malformed_files_are_reported(spark, folder):
    (folder / "bad.xml").write_text("<a>open")
    (folder / "bad.json").write_text('{"title": "x", "body": "cut o')
    (folder / "empty.txt").write_text("")
    corpus = Corpus.from_directory(spark, str(folder))
    assert len(corpus) == 6  # not the file of no bytes
    problems = rows(corpus.problems(), "problem")
    assert len(problems) == 2 and problems[0] == ("json: not one whole object",) and problems[1][0].startswith("xml: ")
    assert corpus.documents.where("problem IS NOT NULL AND (content <> '' OR title <> '')").count() == 0


def documents(spark):
    data = [(1, "one", "cat dog cat-", "txt"), (2, None, "dog", "txt"), (3, "three", None, "txt")]
    return spark.createDataFrame(data, "doc_id long, title string, content string, format string")


def test_tables(spark):
    docs = documents(spark)
    index = ix.Index.build(docs, stemmed=False)
    assert rows(index.postings, "term", "doc_id", "tf", "positions") == [("cat", 1, 3, [1, 3, 3]), ("dog", 1, 1, [2]), ("dog", 2, 1, [1])]
    assert rows(index.term_stats) == [("cat", 1, 3), ("dog", 2, 2)]
    lengths = {r["doc_id"]: r for r in index.doc_stats.collect()}
    assert [lengths[i]["doc_length"] for i in (1, 2, 3)] == [5, 1, 0]
    assert lengths[3]["l_d"] == 0.0 and lengths[1]["l_d_tf"] == pytest.approx((9 + 1 + 1) ** 0.5)
    assert tuple(index.corpus_stats.first()) == (3, 6, 2.0)
    empty = ix.Index.build(docs.limit(0))
    assert tuple(empty.corpus_stats.first()) == (0, 0, 0.0) and empty.postings.count() == 0


def test_gaps(spark):
    table = spark.createDataFrame([([1, 3, 3, 10],), ([7],), ([],)], "p array<int>")
    assert [r[0] for r in table.select(ix.gaps(F.col("p"))).collect()] == [[1, 2, 0, 7], [7], []]


def test_posting_lists(spark, monkeypatch):
    posted = [("a", 3, 2, [1, 5]), ("a", 70000, 1, [2]), ("a", 70001, 3, [4, 4, 9]), ("a", 400000, 1, [8]), ("b", 1, 1, [6])]
    df = spark.createDataFrame(posted, "term string, doc_id long, tf long, positions array<int>").repartition(3)
    assert rows(ix.with_gaps(df), "term", "doc_id", "doc_gap", "gaps") == sorted([("a", 3, 3, [1, 4]), ("a", 70000, 69997, [2]), ("a", 70001, 1, [4, 0, 5]), ("a", 400000, 329999, [8]), ("b", 1, 1, [6])], key=repr)
    assert rows(ix.decode(ix.encode(df))) == sorted(posted, key=repr)
    foreign = spark.createDataFrame([("x", 10, [2, 3], [1, 2], [7, 1, 1]), ("y", 0, [], [], []), ("z", 0, [5], [1], [4])], "term string, begun long, doc_gaps array<long>, tfs array<int>, pos_gaps array<int>")
    monkeypatch.setattr(ix, "_DECODED", 2)
    assert rows(ix.decode(foreign)) == [("x", 12, 1, [7]), ("x", 15, 2, [1, 2]), ("z", 5, 1, [4])]
    assert ix.decode(ix.encode(df.limit(0))).count() == 0


def test_merged_blocks_and_text(spark, tmp_path):
    blocks = spark.createDataFrame([("a", 1, [3, 5]), ("a", 1, [1]), ("b", 2, [2])], "term string, doc_id long, positions array<int>")
    assert rows(ix.merge_blocks(blocks)) == [("a", 1, 3, [1, 3, 5]), ("b", 2, 1, [2])]
    (tmp_path / "m.txt").write_text("cat: 1,[0, 2];2,['4']\ndog: 2,[1]\n")
    assert rows(merged_postings(spark, str(tmp_path / "m.txt"))) == [("cat", 1, 2, [0, 2]), ("cat", 2, 1, [4]), ("dog", 2, 1, [1])]


def test_engine(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    with pytest.raises(FileNotFoundError):
        Finder.load(spark, path)
    Finder.create(Corpus.from_directory(spark, str(folder)), path)
    engine = Finder.load(spark, path)
    assert engine.search("test document").count() == 2
    assert rows(engine.search("fox run"), "title", "score") == [("doc2", 0.0)]
    assert engine.search('"running foxes"', "boolean").count() == 1
    best = engine.search("running test", "bm25", 1).collect()
    assert [r["title"] for r in best] == ["doc2"] and best[0]["score"] > 0
    assert engine.page("test", 1).count() == 0
    assert "Score:" in Finder.rendered(engine.search("fox", "tfidf")).first()["line"]
    assert engine.suggest("tset").count() == 5
    assert engine.correct("tets").first()[0] in ("test", "text")
    assert [r[0] for r in engine.index.vocabulary().collect()] == sorted(r[0] for r in engine.index.vocabulary().collect())
    assert rows(engine.index.term_postings("fox", positions=False)) == rows(engine.index.term_postings("fox").select("doc_id"))
    with pytest.raises(ValueError):
        engine.search("x", "magic")
    Finder.create(Corpus.from_table(documents(spark), content="content"), path)
    assert Finder.load(spark, path).search("dog").count() == 2
    hyphens = spark.createDataFrame([(1, "x", "cat- - dog", "txt")], documents(spark).schema)
    built, stored = ix.Index.build(hyphens, False), ix.Index.create(hyphens, path, False)
    for name in ("postings", "term_stats", "doc_stats", "corpus_stats"):
        assert rows(getattr(built, name)) == rows(getattr(stored, name).select(*getattr(built, name).columns))
    engine = Finder.create(Corpus.from_directory(spark, str(folder)), path)
    plan = engine.index.term_postings("fox", False)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,fox)" in plan.split("PushedFilters")[1] and "positions" not in plan.split("ReadSchema")[1]


def test_ranked_search_reads_no_whole_table(spark, folder, tmp_path_factory):
    finder = Finder.create(Corpus.from_directory(spark, str(folder)), str(tmp_path_factory.mktemp("index") / "i"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = finder.search("test document", "bm25", 15)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scans = plan.split("FileScan")[1:]
    assert len(scans) == 1 and "doc_stats" in scans[0] and "In(doc_id" in scans[0].split("PushedFilters")[1]
    assert "SortMergeJoin" not in plan
    ranked = finder.index.postings
    from lexigrove.operators import ranking

    plan = ranking.rank(["test"], ranked, finder.index.corpus_stats)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "EqualTo(term,test)" in plan and "positions" not in plan.split("ReadSchema")[1]


def test_stream(spark, tmp_path):
    documents(spark).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(documents(spark).schema).parquet(str(tmp_path / "in"))
    index_stream(stream(), str(tmp_path / "out"), str(tmp_path / "cp"), stemmed=False).awaitTermination()
    more = spark.createDataFrame([(9, "nine", "dog bird", "txt")], documents(spark).schema)
    more.write.mode("append").parquet(str(tmp_path / "in"))
    index_stream(stream(), str(tmp_path / "out"), str(tmp_path / "cp"), stemmed=False).awaitTermination()
    index = streamed_index(spark, str(tmp_path / "out"), stemmed=False)
    assert rows(index.term_stats) == [("bird", 1, 1), ("cat", 1, 3), ("dog", 3, 3)]
    assert index.corpus_stats.first()["n_docs"] == 4
    whole = compact(spark, str(tmp_path / "out"), str(tmp_path / "whole"), stemmed=False)
    for name in ("postings", "term_stats", "doc_stats", "corpus_stats"):
        columns = getattr(whole, name).columns
        assert rows(getattr(whole, name)) == rows(getattr(index, name).select(*columns))
    assert Finder(whole).search("dog", "bm25", 2).count() == 2


def test_stream_counts(spark, tmp_path):
    data = spark.sql("SELECT timestamp'2024-01-01 00:01:00' AS at, 'Dog dog, cat' AS content")
    data.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    query = term_counts(stream, "at").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows(spark.table("counted"), "term", "n") == [("cat", 1), ("dog", 2)]
