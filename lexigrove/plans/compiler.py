"""Query trees as DataFrame plans over postings.

Terms become filters that reach the scan, AND semi joins (one aggregation where
all components are terms), NOT anti joins, OR a union, and a phrase a chain of
joins on the document with shifted positions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.plans.ast import AndQuery, NotQuery, Node, OrQuery, PhraseLiteral, TermLiteral, has_phrase


def _continued(ends: Column, following: Column) -> Column:
    """Positions right after one of ``ends`` that are among ``following``."""
    return F.filter(F.transform(ends, lambda p: p + 1), lambda p: F.array_contains(following, p))


class Compiler:
    """Plans of one index's queries.

    ``documents`` holds every ``doc_id`` and is only read for a NOT that has
    nothing to subtract from.  With ``strict`` the original's habits hold: a NOT
    that isn't subtracted from anything passes its component through, AND NOT
    loses documents from the last one of the right side on, and a phrase that
    stands under NOT only is empty.
    """

    def __init__(self, postings: DataFrame, documents: DataFrame, strict: bool = False) -> None:
        self.postings, self.documents, self.strict = postings, documents.select("doc_id"), strict
        self.blind = False

    def docs(self, node: Node) -> DataFrame:
        """``doc_id`` of the documents that match."""
        self.blind = self.strict and has_phrase(node) and not has_phrase(node, through_not=False)
        return self._docs(node)

    def matched(self, node: Node) -> DataFrame:
        """``(doc_id, positions)``: the first matching component's positions; for a phrase its last word's."""
        self.blind = False
        return self._rows(node)

    def _docs(self, node: Node) -> DataFrame:
        if isinstance(node, TermLiteral):
            return self.postings.where(F.col("term") == node.term).select("doc_id")
        if isinstance(node, PhraseLiteral):
            return self._phrase(node).select("doc_id")
        if isinstance(node, NotQuery):
            inner = self._docs(node.component)
            return inner if self.strict else self.documents.join(inner, "doc_id", "left_anti")
        if isinstance(node, OrQuery):
            return reduce(DataFrame.unionByName, map(self._docs, node.components)).distinct()
        assert isinstance(node, AndQuery)
        return self._and(node)

    def _and(self, node: AndQuery) -> DataFrame:
        if self.strict:
            out = self._docs(node.components[0])
            for part in node.components[1:]:
                out = out.join(self._docs(part), "doc_id", "left_semi") if part.positive else self._without_strict(out, self._docs(part))
            return out
        terms = list(dict.fromkeys(p.term for p in node.components if isinstance(p, TermLiteral)))
        keep = [p for p in node.components if p.positive and not isinstance(p, TermLiteral)]
        drop = [p for p in node.components if not p.positive]
        parts = [self._all_terms(terms)] if terms else []
        parts += map(self._docs, keep)
        out = reduce(lambda a, b: a.join(b, "doc_id", "left_semi"), parts) if parts else self.documents
        return reduce(lambda a, p: a.join(self._docs(p.component), "doc_id", "left_anti"), drop, out)

    def _all_terms(self, terms: list[str]) -> DataFrame:
        """Documents that hold all the terms: one scan and one aggregation instead of a join for each."""
        rows = self.postings.where(F.col("term").isin(terms))
        if len(terms) == 1:
            return rows.select("doc_id")
        return rows.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") == len(terms)).select("doc_id")

    @staticmethod
    def _without_strict(left: DataFrame, right: DataFrame) -> DataFrame:
        """Left documents that aren't in ``right``, as far as its last one."""
        last = right.agg(F.max("doc_id").alias("last"))  # one row
        return left.join(right, "doc_id", "left_anti").join(F.broadcast(last), F.col("doc_id") < F.col("last")).select("doc_id")

    def _phrase(self, node: PhraseLiteral) -> DataFrame:
        """``(doc_id, positions)`` of the phrase's last word."""
        if self.blind or not all(isinstance(t, TermLiteral) for t in node.terms):
            return self.postings.where("false").select("doc_id", "positions")
        lists = [self.postings.where(F.col("term") == t.term).select("doc_id", F.col("positions").alias(f"p{i}")) for i, t in enumerate(node.terms)]
        rows = reduce(lambda a, b: a.join(b, "doc_id"), lists)
        at = F.col("p0")
        for i in range(1, len(lists)):
            at = _continued(at, F.col(f"p{i}"))
        return rows.select("doc_id", at.alias("positions")).where(F.size("positions") > 0)

    def _rows(self, node: Node) -> DataFrame:
        if isinstance(node, TermLiteral):
            return self.postings.where(F.col("term") == node.term).select("doc_id", "positions")
        if isinstance(node, PhraseLiteral):
            return self._phrase(node)
        if isinstance(node, OrQuery):
            tagged = [self._rows(c).withColumn("nth", F.lit(i)) for i, c in enumerate(node.components)]
            return reduce(DataFrame.unionByName, tagged).groupBy("doc_id").agg(F.min_by("positions", "nth").alias("positions"))
        if isinstance(node, NotQuery):
            return self._docs(node).withColumn("positions", F.array().cast("array<int>"))
        first = node.parts()[0]
        rows = self._rows(first) if first.positive else self._docs(first).withColumn("positions", F.array().cast("array<int>"))
        return rows.join(self._docs(node), "doc_id", "left_semi")
