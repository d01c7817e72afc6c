"""Problem 5: lines repeated across the documents of one site.

Each way a line is written has a compressed bitmap of its documents within the
site, one container for each block of 65,536 ids.  The bitmaps of the ways that
agree after trimming, single spaces and lower case are united, their exact
cardinalities are held against the threshold, and lines are deleted where their
document's bit is set: lines and containers meet sorted by site, line and block,
so a container is sent and decoded once and its lines are tested together.

Ids are gathered by block before anything is joined, so a line of a huge site is
as many rows as it has blocks.  Only lines with as many rows as the threshold asks
documents get containers; the others can't reach it.  A site's lines above a tenth
of its documents are at most ten times its average number of lines per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from lexigrove.llm import bitmaps
from lexigrove.llm.text import plain_line
from lexigrove.operators.ranges import changed, flat
from lexigrove.session import release, stage

LEAST_DOCUMENTS = 5
#: A line is excessive in one of this many documents of a site, or more.
ONE_OF = 10


@F.pandas_udf(BinaryType())
def _container(low: pd.Series) -> pd.Series:
    return low.map(bitmaps.encode)


@F.pandas_udf(BinaryType())
def _united(containers: pd.Series) -> pd.Series:
    return containers.map(lambda c: bitmaps.union([bytes(x) for x in c]))


@F.pandas_udf(LongType())
def _cardinality(container: pd.Series) -> pd.Series:
    return container.map(bitmaps.cardinality)


_PLACE = ("site", "line_key", "block")
_HIT = "site string, line_key binary, doc_id long, body_key long, line_no int"


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by place, a place's container before its lines: the lines whose document's bit is set."""
    last: list = [None] * len(_PLACE)
    container: bytes | None = None
    first = True
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = [flat(batch, c) for c in _PLACE]
        new = np.zeros(n, bool)
        for key, before in zip(keys, last):
            new |= changed(key, before, first)
        first, last = False, [key[n - 1].as_py() for key in keys]
        held = ~flat(batch, "docs").is_null().to_numpy(zero_copy_only=False)
        low = flat(batch, "low").to_numpy(zero_copy_only=False)
        begins = np.flatnonzero(new)
        bounds = np.append(begins, n)
        keep = []
        if container is not None and bounds[0]:
            keep.append(np.flatnonzero(bitmaps.among(container, low[: bounds[0]])))
        docs = flat(batch, "docs")
        for i in np.flatnonzero(held[begins]):
            lo, hi = bounds[i] + 1, bounds[i + 1]
            keep.append(lo + np.flatnonzero(bitmaps.among(docs[int(bounds[i])].as_py(), low[lo:hi])))
        if len(begins):
            container = docs[int(begins[-1])].as_py()
        if keep and sum(map(len, keep)):
            at = pa.array(np.concatenate(keep))
            yield pa.RecordBatch.from_arrays([flat(batch, c).take(at) for c in ("site", "line_key", "doc_id", "body_key", "line_no")], names=["site", "line_key", "doc_id", "body_key", "line_no"])


class RepeatedLines:
    """Lines that stand in too many documents of their site.

    A line is excessive if it stands in at least ``least`` documents of the site
    and in at least one of ``one_of`` of them, documents with a null body
    included.  Lines stand between line feeds and count from 1; those without a
    letter or digit, and documents without a site or an id, take no part.  A
    repeated id counts once for each site.  Lines are compared by a 128-bit digest.
    Where one id has several sites or bodies, each body is a document of its own
    when lines are deleted.

    ``excessive``: ``(site, line_key, block, docs)`` with a bitmap's container for
    each block of ids.
    """

    def __init__(self, df: DataFrame, id_col: str, site_col: str, body_col: str, least: int = LEAST_DOCUMENTS, one_of: int = ONE_OF) -> None:
        bodies = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(site_col).alias("site"), F.col(body_col).alias("body"))
        self.bodies = bodies.withColumn("body_key", F.xxhash64("body"))
        taken = self.bodies.where("doc_id IS NOT NULL AND site IS NOT NULL")
        sites = taken.select("site", "doc_id").distinct().groupBy("site").agg(F.count("*").alias("n_docs"))
        need = sites.select("site", F.greatest(F.lit(least), F.floor((F.col("n_docs") + (one_of - 1)) / one_of)).cast("long").alias("need"))
        self.need = stage(need, "need")
        # Tested as they stand, since the normalized line would be made twice, for the test and for its key.
        lines = taken.select("site", "doc_id", "body_key", F.posexplode(F.split("body", "\n", -1)).alias("at", "line")).where(F.col("line").rlike(r"[\p{L}\p{N}]"))
        lines = lines.select("site", "doc_id", "body_key", (F.col("at") + 1).alias("line_no"), F.unhex(F.md5(plain_line(F.col("line")))).alias("line_key"), F.xxhash64("line").alias("way"))
        block, low = F.shiftright("doc_id", bitmaps.BLOCK_BITS), F.col("doc_id").bitwiseAND(F.lit((1 << bitmaps.BLOCK_BITS) - 1)).cast("int")
        self.lines = stage(lines.withColumn("block", block).withColumn("low", low), "lines")
        ways = stage(self.lines.groupBy("site", "line_key", "way", "block").agg(F.collect_set("low").alias("low")), "ways")
        often = ways.groupBy("site", "line_key").agg(F.sum(F.size("low")).alias("n_rows")).join(self.need, "site").where("n_rows >= need").select("site", "line_key")
        held = ways.join(often, ["site", "line_key"]).select("site", "line_key", "block", _container("low").alias("docs"))
        whole = held.groupBy("site", "line_key", "block").agg(F.collect_list("docs").alias("docs")).select("site", "line_key", "block", _united("docs").alias("docs"))
        self.whole = stage(whole, "bitmaps")
        release(ways)
        counted = self.whole.select("site", "line_key", _cardinality("docs").alias("n")).groupBy("site", "line_key").agg(F.sum("n").alias("n_docs")).join(self.need, "site").where("n_docs >= need").select("site", "line_key", "n_docs")
        self.counted = stage(counted, "counted")
        self.excessive = self.whole.join(self.counted.select("site", "line_key"), ["site", "line_key"])

    def _hits(self) -> DataFrame:
        """The excessive lines of each body, by looking all lines up in the bitmaps."""
        none = F.lit(None)
        containers = self.excessive.select(*_PLACE, "docs", *(none.cast(t).alias(c) for c, t in (("low", "int"), ("doc_id", "long"), ("body_key", "long"), ("line_no", "int"))))
        lines = self.lines.select(*_PLACE, none.cast("binary").alias("docs"), "low", "doc_id", "body_key", "line_no")
        placed = containers.unionByName(lines).repartition(*_PLACE).sortWithinPartitions(*_PLACE, F.col("docs").isNull())
        return placed.mapInArrow(_looked_up, _HIT)

    def found(self) -> DataFrame:
        """``(doc_id, line_no)`` of each line to delete: its document's bit is set in the line's bitmap."""
        return self._hits().select("doc_id", "line_no").distinct()

    def by_site(self) -> DataFrame:
        """``(site, line, n_docs)`` of each excessive line, normalized."""
        first = self._hits().groupBy("site", "line_key").agg(F.min(F.struct("doc_id", "body_key", "line_no")).alias("at")).join(self.counted, ["site", "line_key"])
        first = first.select("site", "n_docs", F.col("at.doc_id").alias("doc_id"), F.col("at.body_key").alias("body_key"), F.col("at.line_no").alias("line_no"))
        line = plain_line(F.element_at(F.split("body", "\n", -1), F.col("line_no")))
        return first.join(self.bodies, ["doc_id", "site", "body_key"]).select("site", line.alias("line"), "n_docs").distinct()

    def cleaned(self) -> DataFrame:
        """``(doc_id, site, body)``: each distinct body of a document and site without its excessive lines, null where it was null.

        Bodies are shuffled once, by their keys, which also tell repeated rows.
        """
        keys = ["doc_id", "site", "body_key"]
        drop = self._hits().groupBy(*keys).agg(F.collect_set("line_no").alias("gone"))
        rows = self.bodies.dropDuplicates(keys).join(drop, keys, "left")
        kept = F.filter(F.split("body", "\n", -1), lambda line, i: ~F.array_contains("gone", (i + 1).cast("int")))
        return rows.select("doc_id", "site", F.when(F.col("gone").isNull(), F.col("body")).otherwise(F.array_join(kept, "\n")).alias("body"))

    def close(self) -> None:
        """Delete the staged tables."""
        release(self.need, self.lines, self.whole, self.counted)
