"""Spelling suggestions by edit distance to the vocabulary."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SUGGESTIONS = 5


def distances(vocabulary: DataFrame, words: list[str]) -> DataFrame:
    """``(word, term, distance)`` of each word of a query to each term of ``vocabulary(term)``.

    The words are a short literal list, gone through for each term as it is
    scanned; nothing is joined.
    """
    literal = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    return vocabulary.select("term", F.explode(literal).alias("word")).select("word", "term", F.levenshtein("word", "term").alias("distance"))


def suggest(vocabulary: DataFrame, words: list[str], most: int = SUGGESTIONS) -> DataFrame:
    """``(word, rank, term, distance)``: the nearest terms of each word; ties in the terms' order.

    The limit is applied on each partition before the shuffle, so a word never
    draws the whole vocabulary into one task.
    """
    nearest = Window.partitionBy("word").orderBy("distance", "term")
    ranked = distances(vocabulary, list(dict.fromkeys(words))).withColumn("rank", F.row_number().over(nearest))
    return ranked.where(F.col("rank") <= most).select("word", "rank", "term", "distance")


def correct(vocabulary: DataFrame, query: str) -> DataFrame:
    """``corrected``: the query with each word's nearest term, in one row; words stay where there are no terms."""
    words = re.sub(r"[^a-zA-Z\s]", "", query).split()
    best = suggest(vocabulary, words, 1).select("word", "term")
    placed = vocabulary.sparkSession.createDataFrame(list(enumerate(words)), "nth int, word string")
    rows = placed.join(best, "word", "left").select("nth", F.coalesce("term", "word").alias("term"))
    listed = F.array_sort(F.collect_list(F.struct("nth", "term")))  # as many as the query has words
    return rows.agg(F.array_join(F.transform(listed, lambda s: s["term"]), " ").alias("corrected"))
