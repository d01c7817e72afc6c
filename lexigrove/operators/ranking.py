"""Ranked retrieval: log-weighted tf-idf with Euclidean lengths, and Okapi BM25."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
LEAST_IDF = 0.1
MODES = ("tfidf", "bm25")


class UnknownTermError(ZeroDivisionError):
    """A term of a strict tf-idf query stands in no document."""


def rank(terms: list[str], postings: DataFrame, corpus_stats: DataFrame, mode: str = "bm25", strict: bool = False) -> DataFrame:
    """``(doc_id, score, first_term)`` of every document with one of the terms; a repeated term counts again.

    The query's terms are a list on the driver, so they become a filter at the
    scan and a literal map; document frequencies come from the same filtered
    postings, and the documents' lengths stand in the postings' rows, so nothing
    is joined: one scan and one aggregation by document.  Unknown terms add nothing; with ``strict`` tf-idf raises for them.
    ``first_term`` is the index of the first term that a document has, for ties.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    spark = postings.sparkSession
    distinct = list(dict.fromkeys(terms))
    if not distinct:
        return spark.createDataFrame([], "doc_id long, score double, first_term int")
    hits = postings.where(F.col("term").isin(distinct)).select("term", "doc_id", "tf", "doc_length", "l_d")
    found = {r["term"]: r["df"] for r in hits.groupBy("term").agg(F.count("*").alias("df")).collect()}  # one row for each term of the query
    if strict and mode == "tfidf" and len(found) < len(distinct):
        raise UnknownTermError("a term stands in no document")
    if not found:
        return spark.createDataFrame([], "doc_id long, score double, first_term int")
    total = corpus_stats.first()
    n_docs, average = total["n_docs"], total["avg_doc_length"]
    known = list(found)

    def by_term(values: list) -> object:
        return F.element_at(F.create_map(*(F.lit(x) for pair in zip(known, values) for x in pair)), F.col("term"))

    df = by_term([float(found[t]) for t in known])
    times = by_term([terms.count(t) for t in known])
    first = by_term([terms.index(t) for t in known])
    tf, n = F.col("tf"), F.lit(float(n_docs))
    if mode == "bm25":
        query = F.greatest(F.lit(LEAST_IDF), F.log((n - df + 0.5) / (df + 0.5)))
        share = query * ((K1 + 1) * tf / (K1 * ((1 - B) + B * F.col("doc_length") / F.lit(average)) + tf))
    else:
        share = F.log(1 + n / df) * (1 + F.log(tf)) / F.col("l_d")
    return hits.groupBy("doc_id").agg(F.sum(share * times).alias("score"), F.min(first).alias("first_term"))


def page(ranked: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Best first; ties by the first matching term, then by document; scores count to six places."""
    rows = ranked.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "first_term", "doc_id")
    rows = rows.offset(offset) if offset else rows
    return rows.limit(limit) if limit is not None else rows
