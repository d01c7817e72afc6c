"""Queries of problem 2: per-key results without imbalance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.operators.ranges import heavy_key_counts, keys_with_share
from lexigrove.session import table


def p2_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, documents and positions of each term."""
    return heavy_key_counts(table(spark, sf_dir, "term_positions"), "term", "doc_id", "token_pos")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that hold at least 2 % of all rows."""
    return keys_with_share(p2_term_counts(spark, sf_dir), "term", 2, 100).select(F.col("term"))


QUERIES = {"p2_term_counts": p2_term_counts, "p2_found": p2_found}

SQL = {
    "p2_term_counts": """
        SELECT term, count(*) AS n_rows, count(DISTINCT doc_id) AS n_docs,
               count(DISTINCT CASE WHEN doc_id IS NOT NULL AND token_pos IS NOT NULL THEN struct_pack(d := doc_id, p := token_pos) END) AS n_positions
        FROM term_positions GROUP BY term""",
    "p2_found": """
        SELECT term FROM term_positions WHERE term IS NOT NULL GROUP BY term
        HAVING count(*) * 50 >= (SELECT count(*) FROM term_positions)""",
}
