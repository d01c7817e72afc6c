"""Index a corpus, load an index, search and suggest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.functions.analysis import language_name
from lexigrove.operators import ranking, spelling
from lexigrove.operators.index import Index
from lexigrove.plans.ast import Node
from lexigrove.plans.compiler import Compiler
from lexigrove.plans.parser import analyzer, parse, ranked_terms
from lexigrove.sources.files import Corpus

PAGE = 15
#: Rows of a result up to which titles are fetched by id.
MOST_FETCHED = 1000
MODES = ("boolean", *ranking.MODES)


class Finder:
    """Searches over one index.

    ``strict`` keeps the habits of the original system where they differ from
    what a query seems to ask; see the parser, the compiler and the ranker.
    """

    def __init__(self, index: Index, language: str = "english", strict: bool = False) -> None:
        self.index, self.strict = index, strict
        self.words = analyzer(language, index.stemmed)

    @staticmethod
    def create(corpus: Corpus, path: str, stemmed: bool = True, language: str = "english", strict: bool = False) -> Finder:
        """Build the index of a corpus at ``path``, replacing one that is there."""
        return Finder(Index.create(corpus.documents, path, stemmed), language, strict)

    @staticmethod
    def load(spark: SparkSession, path: str, language: str = "english", strict: bool = False) -> Finder:
        """Open an index that was built before."""
        return Finder(Index.load(spark, path), language, strict)

    def parse(self, query: str) -> Node:
        """The query as a tree; ``str()`` of it shows how it was read."""
        return parse(query, self.words, self.strict)

    def search(self, query: str, mode: str = "boolean", limit: int | None = None, offset: int = 0) -> DataFrame:
        """``(doc_id, title, score)``: all matches, or a page of them.

        Boolean results have the score 0 and come by id; ranked ones best first.
        """
        if mode not in MODES:
            raise ValueError(f"unknown mode: {mode}")
        index = self.index
        if mode == "boolean" or self.strict:
            tree = self.parse(query)  # strict ranked searches fail for what the Boolean parser can't read
        if mode == "boolean":
            found = Compiler(index.postings, index.doc_stats, self.strict).docs(tree).select("doc_id", F.lit(0.0).alias("score"))
            rows = found.orderBy("doc_id")
            rows = rows.offset(offset) if offset else rows
            rows = rows.limit(limit) if limit is not None else rows
            return self.titled(rows, limit).orderBy("doc_id")
        terms = ranked_terms(query, self.words, self.strict)
        ranked = ranking.rank(terms, index.postings, index.corpus_stats, mode, self.strict)
        return self.titled(ranking.page(ranked, limit, offset), limit).orderBy(F.desc("score"), "first_term", "doc_id").drop("first_term")

    def page(self, query: str, number: int = 0, mode: str = "bm25") -> DataFrame:
        """One page of results, from 0."""
        return self.search(query, mode, PAGE, number * PAGE)

    def titled(self, rows: DataFrame, limit: int | None = None) -> DataFrame:
        """Rows with the documents' titles; unknown ones say so.

        A page of up to ``MOST_FETCHED`` rows is made at once, and its ids become a
        filter at the scan of the documents' table, which is sorted by id; longer
        results are joined.
        """
        titles = self.index.doc_stats.select("doc_id", "title")
        if limit is not None and limit <= MOST_FETCHED:
            page = rows.collect()  # as many rows as the caller's limit
            titles = F.broadcast(titles.where(F.col("doc_id").isin([r["doc_id"] for r in page])))
            rows = rows.sparkSession.createDataFrame(page, rows.schema)
        return rows.join(titles, "doc_id", "left").withColumn("title", F.coalesce("title", F.lit("Title not found")))

    @staticmethod
    def rendered(results: DataFrame) -> DataFrame:
        """Results as lines of text; a score above 0 is shown to three places."""
        line = F.format_string("Document ID# %d - %s", "doc_id", "title")
        return results.select("doc_id", F.when(F.col("score") > 0, F.concat(line, F.format_string(" - Score: %.3f", "score"))).otherwise(line).alias("line"))

    def suggest(self, word: str, most: int = spelling.SUGGESTIONS) -> DataFrame:
        """Nearest terms of the vocabulary."""
        return spelling.suggest(self.index.term_stats.select("term"), [word], most)

    def correct(self, query: str) -> DataFrame:
        """The query with each word's nearest term."""
        return spelling.correct(self.index.term_stats.select("term"), query)

    @staticmethod
    def detect_language(documents: DataFrame) -> DataFrame:
        """``(doc_id, language)`` of documents: english or spanish."""
        return documents.select("doc_id", language_name(F.col("content")).alias("language"))
