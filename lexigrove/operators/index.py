"""The positional inverted index as tables: build, encode, save and load.

One row for each term and document keeps posting lists splittable; a term that
stands in every document is many rows, never one array.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrove.functions.analysis import types
from lexigrove.functions.stemmer import stem_terms
from lexigrove.session import release, stage

_DECODED = 1 << 16


def documents_view(df: DataFrame, doc_id: str = "doc_id", content: str = "text", fmt: str | None = "doc_format", title: str | None = "title") -> DataFrame:
    """``(doc_id, title, content, format)`` from any table; a missing format is ``txt``."""
    kind = F.coalesce(F.col(fmt), F.lit("txt")) if fmt else F.lit("txt")
    name = F.col(title) if title else F.lit(None).cast("string")
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), name.alias("title"), F.col(content).alias("content"), kind.alias("format"))


def occurrences(documents: DataFrame, stemmed: bool = False) -> DataFrame:
    """``(doc_id, position, term)``: every type of every token, empty ones included."""
    rows = types(documents)
    return stem_terms(rows) if stemmed else rows


def postings(rows: DataFrame, with_empty: bool = False) -> DataFrame:
    """``(term, doc_id, tf, positions)`` of all terms, the empty one only on demand; positions ascend, repeats stay."""
    full = (rows if with_empty else rows.where("term <> ''")).groupBy("term", "doc_id")
    return full.agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"))


def term_frequencies(rows: DataFrame) -> DataFrame:
    """``(doc_id, term, tf)``, the empty term included."""
    return rows.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def term_stats(posted: DataFrame) -> DataFrame:
    """``(term, df, cf)``: documents and occurrences of each term."""
    return posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def doc_stats(documents: DataFrame, frequencies: DataFrame) -> DataFrame:
    """``(doc_id, title, doc_length, l_d, l_d_tf)`` of every document from ``(doc_id, term, tf)``; those without a token have zeros.

    ``l_d`` is the Euclidean length of the log-weighted term frequencies,
    ``l_d_tf`` that of the plain ones; both count the empty term.
    """
    weight = F.pow(1 + F.log("tf"), 2)
    by_doc = frequencies.groupBy("doc_id").agg(F.sum("tf").alias("doc_length"), F.sqrt(F.sum(weight)).alias("l_d"), F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("l_d_tf"))
    zero = {"doc_length": 0, "l_d": 0.0, "l_d_tf": 0.0}
    return documents.select("doc_id", "title").join(by_doc, "doc_id", "left").fillna(zero)


def corpus_stats(stats: DataFrame) -> DataFrame:
    """``(n_docs, total_tokens, avg_doc_length)`` in one row; zeros for an empty corpus."""
    row = stats.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("doc_length"), F.lit(0)).alias("total_tokens"))
    average = F.when(F.col("n_docs") > 0, F.col("total_tokens") / F.col("n_docs")).otherwise(0.0)
    return row.select("n_docs", "total_tokens", average.alias("avg_doc_length"))


def weighed(posted: DataFrame) -> DataFrame:
    """Postings with their document's ``doc_length`` and ``l_d``, so that ranking joins nothing.

    ``posted`` has all terms, the empty one included.  Where its rows are hashed on
    ``doc_id`` already, as after :func:`table_postings`, nothing is shuffled.
    """
    by_doc = Window.partitionBy("doc_id")
    log_weight = F.pow(1 + F.log("tf"), 2)
    return posted.withColumn("doc_length", F.sum("tf").over(by_doc)).withColumn("l_d", F.sqrt(F.sum(log_weight).over(by_doc)))


def table_postings(documents: DataFrame, stemmed: bool) -> DataFrame:
    """Weighed postings of all terms: texts are shuffled once by document, not their many occurrences."""
    spark = documents.sparkSession
    # A number of partitions of its own, as small shuffled texts would be put together, and they are heavy once exploded.
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = occurrences(documents.repartition(n, "doc_id"), stemmed)
    full = rows.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"))
    return weighed(full.select("term", "doc_id", "tf", "positions"))


def gaps(numbers: Column) -> Column:
    """An ascending array as its first number and the differences."""
    before = F.slice(F.concat(F.array(F.lit(0)), numbers), 1, F.size(numbers))
    return F.zip_with(numbers, before, lambda x, y: x - y)


#: Documents whose ids agree but for so many low bits are one block of an encoded posting list.
BLOCK_BITS = 16


def with_gaps(posted: DataFrame) -> DataFrame:
    """``(term, block, doc_id, doc_gap, tf, gaps)``: document ids and positions as differences.

    The first document of a term has its id as gap.  Differences are taken within
    blocks of ids, and a block's first one from the last id of the term's block
    before, which one row for each term and block tells: no task gets a frequent
    term's whole list.  A document id comes once for a term.
    """
    rows = posted.select("term", F.shiftright("doc_id", BLOCK_BITS).alias("block"), "doc_id", F.col("tf").cast("int").alias("tf"), gaps(F.col("positions")).alias("gaps"))
    ends = rows.groupBy("term", "block").agg(F.max("doc_id").alias("end"))
    begun = ends.select("term", "block", F.coalesce(F.lag("end").over(Window.partitionBy("term").orderBy("block")), F.lit(0)).alias("begun"))
    before = F.coalesce(F.lag("doc_id").over(Window.partitionBy("term", "block").orderBy("doc_id")), F.col("begun"))
    return rows.join(begun, ["term", "block"]).select("term", "block", "doc_id", (F.col("doc_id") - before).alias("doc_gap"), "tf", "gaps", "begun")


def encode(posted: DataFrame) -> DataFrame:
    """Postings as one row for each term and block: ``(term, block, begun, doc_gaps, tfs, pos_gaps)``.

    ``begun`` is the last id before the block, ``pos_gaps`` holds the position gaps
    of all its documents one after the other, ``tfs`` how many each has.
    """
    one = F.struct("doc_id", "doc_gap", "tf", "gaps")
    lists = with_gaps(posted).groupBy("term", "block").agg(F.min("begun").alias("begun"), F.sort_array(F.collect_list(one)).alias("l"))
    return lists.select("term", "block", "begun", F.col("l.doc_gap").alias("doc_gaps"), F.col("l.tf").alias("tfs"), F.flatten(F.col("l.gaps")).alias("pos_gaps"))


def running(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Running sums that begin anew after each of ``sizes`` values."""
    sums = np.cumsum(values, dtype=np.int64)
    ends = np.cumsum(sizes)
    base = np.concatenate([[0], sums])[ends - sizes]
    return sums - np.repeat(base, sizes)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        docs, tfs, positions = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_gaps", "tfs", "pos_gaps"))
        per_row = docs.value_lengths().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(batch.num_rows), per_row)
        begun = batch.column(batch.schema.get_field_index("begun")).to_numpy(zero_copy_only=False)
        ids = running(docs.flatten().to_numpy(zero_copy_only=False), per_row) + begun[row]
        sizes = tfs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        places = running(positions.flatten().to_numpy(zero_copy_only=False), sizes).astype(np.int32)
        terms = batch.column(batch.schema.get_field_index("term")).take(pa.array(row))
        for lo in range(0, len(row), _DECODED):
            hi = min(lo + _DECODED, len(row))
            first, last = int(sizes[:lo].sum()), int(sizes[:hi].sum())
            offsets = np.concatenate([[0], np.cumsum(sizes[lo:hi])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(places[first:last]))
            yield pa.RecordBatch.from_arrays([terms.slice(lo, hi - lo), pa.array(ids[lo:hi]), pa.array(sizes[lo:hi]), lists], names=["term", "doc_id", "tf", "positions"])


def decode(encoded: DataFrame) -> DataFrame:
    """The postings of rows as :func:`encode` makes them, from whatever source; whole batches are summed at once."""
    return encoded.select("term", "begun", "doc_gaps", "tfs", "pos_gaps").mapInArrow(_decoded, "term string, doc_id long, tf long, positions array<int>")


def merge_blocks(blocks: DataFrame) -> DataFrame:
    """Postings of several blocks merged: positions of one term and document united in order, repeats kept.

    Null terms, documents and positions, and documents without a position, are left
    out; the empty term is a term.
    """
    rows = blocks.where("term IS NOT NULL AND doc_id IS NOT NULL").groupBy("term", "doc_id").agg(F.flatten(F.collect_list("positions")).alias("positions"))
    kept = F.filter("positions", lambda p: p.isNotNull())
    return rows.select("term", "doc_id", F.sort_array(kept).alias("positions")).where(F.size("positions") > 0).select("term", "doc_id", F.size("positions").cast("long").alias("tf"), "positions")


@dataclass(frozen=True)
class Index:
    """The tables of one index."""

    postings: DataFrame
    term_stats: DataFrame
    doc_stats: DataFrame
    corpus_stats: DataFrame
    stemmed: bool = True
    path: str | None = field(default=None)

    @staticmethod
    def build(documents: DataFrame, stemmed: bool = True) -> Index:
        """Index of ``documents(doc_id, title, content, format)``; nothing runs yet."""
        full = table_postings(documents, stemmed)
        posted, stats = full.where("term <> ''"), doc_stats(documents, full.select("doc_id", "term", "tf"))
        return Index(posted, term_stats(posted), stats, corpus_stats(stats), stemmed)

    @staticmethod
    def create(documents: DataFrame, path: str, stemmed: bool = True) -> Index:
        """Write the index of ``documents`` to ``path``, replacing one that is there, and open it.

        Texts are gone through once: all other tables come from the written
        postings, of which only the columns they need are read.  Postings are
        ranged and sorted by term, and documents by id, so what is asked for lies in
        few row groups and a scan skips the rest by their statistics.  The empty term's rows are
        written too, for the documents' lengths, and left out when the index is
        opened.
        """
        return Index.write(table_postings(documents, stemmed), documents, path, stemmed)

    @staticmethod
    def write(full: DataFrame, documents: DataFrame, path: str, stemmed: bool) -> Index:
        """Write weighed postings of all terms, and the tables that follow from them and ``documents(doc_id, title)``."""
        spark = documents.sparkSession
        once = stage(full, "postings")  # the ranges' quantiles are sampled in a pass of their own
        once.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        release(once)
        written = spark.read.parquet(f"{path}/postings").select("term", "doc_id", "tf")
        terms = term_stats(written.where("term <> ''"))
        terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/term_stats")
        doc_stats(documents, written).repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").parquet(f"{path}/doc_stats")
        corpus_stats(spark.read.parquet(f"{path}/doc_stats")).withColumn("stemmed", F.lit(stemmed)).coalesce(1).write.mode("overwrite").parquet(f"{path}/corpus_stats")
        return Index.load(spark, path)

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        """Whether all tables of an index are there and complete."""
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        files = [jvm.org.apache.hadoop.fs.Path(f"{path}/{t}/_SUCCESS") for t in ("postings", "term_stats", "doc_stats", "corpus_stats")]
        return all(f.getFileSystem(conf).exists(f) for f in files)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        """Open a saved index."""
        if not Index.exists(spark, path):
            raise FileNotFoundError(f"no complete index at {path}")
        tables = {t: spark.read.parquet(f"{path}/{t}") for t in ("postings", "term_stats", "doc_stats", "corpus_stats")}
        stemmed = tables["corpus_stats"].select("stemmed").first()["stemmed"]
        return Index(tables["postings"].where("term <> ''"), tables["term_stats"], tables["doc_stats"], tables["corpus_stats"].drop("stemmed"), stemmed, path)

    def vocabulary(self) -> DataFrame:
        """Distinct terms in order."""
        return self.term_stats.select("term").orderBy("term")

    def term_postings(self, term: str, positions: bool = True) -> DataFrame:
        """Postings of one term; without positions their column isn't read."""
        rows = self.postings.where(F.col("term") == term)
        return rows.select("doc_id", "positions") if positions else rows.select("doc_id")
