"""Problem 3: near-duplicate documents by a blocked sparse matrix product.

Rows of the incidence matrix are documents, columns are n-grams of words.  The
product of the matrix with its transpose holds the overlap of every pair, but
only entries above a bound that follows from the two sizes matter.  Columns are
ordered from rare to frequent; a pair above the bound must meet in the columns
at the beginning of both rows, fewer of the smaller row than of the larger one, so
only that block is multiplied.  Each entry of it is tested at once against the size-derived bounds, with a parity sketch of
the row as an upper bound of the overlap.  What is left is accumulated over the
whole rows, masked to these entries.

Documents with the same words are one row; they come back at the end.  Versions
of one document are a class first: rows so near to one leader that the triangle
inequality of the Jaccard distance makes all of them near each other.  Entries
within a class need no product, so thousands of versions cost as many
comparisons with their leader, and only entries between classes are multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.llm.text import words_text
from lexigrove.operators.ranges import flat
from lexigrove.session import release, stage

NGRAM = 3
#: Similarity as a fraction, so that the bounds are exact.
SIMILARITY = (3, 5)
#: Bytes up to which a staged table is broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 80 << 20
#: Bytes of a row of longs in a broadcast relation, whose pages and index double when they grow, at most.
_ROW_BYTES = 128
_WORDS = 8  # longs in a sketch
_SKETCH = [f"s{w}" for w in range(_WORDS)]
_ROUNDS = 60
_DOCUMENTS = 512
_MOST_WORDS = 300_000
_SEEN = 1 << 20
#: Members up to which a class's rows are multiplied like any others; which pairs are found doesn't depend on it.
_SMALL_CLASS = 32
_LEAST = [f"m{i}" for i in range(3)]  # a row's least hashes


def _small(df: DataFrame) -> DataFrame | None:
    """A staged table of few longs a row marked for broadcast, or None if it is too large for that."""
    return F.broadcast(df) if df.count() * _ROW_BYTES <= BROADCAST_BYTES else None


def _mixed(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    v = (v ^ (v >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return v ^ (v >> np.uint64(32))


_MATRIX = f"doc_id long, d1 long, d2 long, row long, n int, grams array<long>, {', '.join(f'{m} long' for m in _LEAST)}"


def _matrix(n: int):
    """Rows of the incidence matrix: each text's 128-bit digest and the distinct hashes of its n-grams.

    ``row`` numbers the rows that have n-grams.  A text that the task has met before
    has a digest only.
    """

    def grams_of(split: list[list[str]], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(w) for w in split])
        if len(known) > _MOST_WORDS:
            known.clear()
        for word in set(chain.from_iterable(split)).difference(known):
            known[word] = xxhash.xxh64_intdigest(word)
        words = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.uint64, int(sizes.sum()))
        begins = np.cumsum(sizes) - sizes
        runs = np.maximum(sizes - (n - 1), 0)
        doc = np.repeat(np.arange(len(sizes)), runs)
        at = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(begins, runs)
        grams = _mixed(words[at])
        for k in range(1, n):
            grams = _mixed(grams * np.uint64(0x9FB21C651E98DF25) + words[at + k])
        order = np.lexsort((grams, doc))
        grams, doc = grams[order], doc[order]
        fresh = np.ones(len(grams), bool)
        fresh[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
        grams, doc = grams[fresh], doc[fresh]
        return grams, np.bincount(doc, minlength=len(sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        seen: set[int] = set()
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, texts = flat(batch, "doc_id"), flat(batch, "words")
            for lo in range(0, batch.num_rows, _DOCUMENTS):
                own = texts.slice(lo, _DOCUMENTS).to_pylist()
                digests = [xxhash.xxh3_128_intdigest(t) for t in own]
                if len(seen) > _SEEN:
                    seen.clear()
                first = np.array([d not in seen and not seen.add(d) for d in digests])
                split = [t.split(" ") if f else [] for t, f in zip(own, first)]
                grams, counts = grams_of(split, known)
                has = counts > 0
                begins = (np.cumsum(counts) - counts)[has]
                numbers = number + np.cumsum(has) - 1
                number += int(has.sum())
                least = []
                for i in range(len(_LEAST)):
                    hashes = np.full(len(own), 0, np.uint64)
                    if len(begins):
                        hashes[has] = np.minimum.reduceat(_mixed(grams ^ np.uint64(i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)), begins)
                    least.append(pa.array(hashes.view(np.int64), mask=~has))
                halves = np.array([(d >> 64, d & 0xFFFFFFFFFFFFFFFF) for d in digests], np.uint64).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(grams.view(np.int64)))
                sizes = pa.array(counts.astype(np.int32), mask=~first)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, len(own)), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(numbers.astype(np.int64), mask=~has), sizes, lists, *least], names=["doc_id", "d1", "d2", "row", "n", "grams", *_LEAST])

    return run


def _heads(p: int, q: int):
    """Of each row, whose cells come together, the columns at the beginning in which a partner must be met.

    That are the first ``n - ceil(p n / q) + 1`` of all columns by rising
    frequency, for partners of at least its size the first ``short`` of them, ``n -
    ceil(2 p n / (p + q)) + 1`` of all; the ``alone`` columns that no other row has
    come first and are left out.  With them the parity sketch of the row's other columns: how many of
    them fall on each bit, odd or even.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def emit(cells: list[np.ndarray]) -> pa.RecordBatch:
            rep, n, g, df = cells
            order = np.lexsort((g, df, rep))
            rep, n, g = rep[order], n[order], g[order]
            begins = np.flatnonzero(np.concatenate([[True], rep[1:] != rep[:-1]]))
            sizes = np.diff(np.append(begins, len(rep)))
            row = np.repeat(np.arange(len(begins)), sizes)
            bits = g.view(np.uint64)
            sketch = np.zeros((len(begins), _WORDS), np.uint64)
            np.bitwise_xor.at(sketch, (row, (bits >> np.uint64(6) & np.uint64(_WORDS - 1)).astype(np.int64)), np.uint64(1) << (bits & np.uint64(63)))
            n, alone = n[begins], n[begins] - sizes
            heads = np.clip(n - (n * p + q - 1) // q + 1 - alone, 0, sizes)
            short = np.clip(n - (2 * p * n + p + q - 1) // (p + q) + 1 - alone, 0, heads)
            take = np.arange(len(rep)) - begins[row] < heads[row]
            met = heads > 0
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(heads[met])]).astype(np.int32)), pa.array(g[take]))
            parities = [pa.array(np.ascontiguousarray(sketch[met, w]).view(np.int64)) for w in range(_WORDS)]
            return pa.RecordBatch.from_arrays([pa.array(rep[begins][met]), pa.array(n[met].astype(np.int32)), pa.array(alone[met].astype(np.int32)), pa.array(short[met].astype(np.int32)), *parities, lists], names=["rep", "n", "alone", "short", *_SKETCH, "head"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cells = [flat(batch, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("rep", "n", "g", "df")]
            if kept:
                cells = [np.concatenate([a, b]) for a, b in zip(kept, cells)]
            last = np.flatnonzero(cells[0] != cells[0][-1])
            cut = last[-1] + 1 if len(last) else 0  # the last row may go on in the next batch
            kept = [c[cut:] for c in cells]
            if cut:
                yield emit([c[:cut] for c in cells])
        if kept:
            yield emit(kept)

    return run


class NearDuplicates:
    """Groups and pairs of documents whose n-gram sets have at least the given Jaccard similarity.

    ``members``: ``(doc_id, rep, size, n)`` for each distinct document; documents with
    equal words have one ``rep``, their smallest id.  ``classes``: ``(rep, cls)`` of
    representatives that are all near each other, by their leader; those that have no
    such class are left out.  ``cross``: ``(a, b)`` of near representatives of different
    classes, ``a < b``.  Title and body are joined with a line feed; null is empty.
    Documents with fewer words than an n-gram has are alone.  A repeated id counts
    once for each text it has; null ids are left out.
    """

    def __init__(self, df: DataFrame, id_col: str, columns: list[str], n: int = NGRAM, similarity: tuple[int, int] = SIMILARITY) -> None:
        self.n, (self.p, self.q) = n, similarity
        text = F.concat_ws("\n", *(F.coalesce(F.col(c), F.lit("")) for c in columns))
        base = df.select(F.col(id_col).cast("long").alias("doc_id"), words_text(text).alias("words")).where("doc_id IS NOT NULL")
        rows = stage(base.mapInArrow(_matrix(n), _MATRIX), "rows")
        keyed = rows.groupBy("d1", "d2", "doc_id").agg(F.min("row").alias("row"), F.max("n").alias("n"))
        texts = stage(keyed.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.min("row").alias("row"), F.max("n").alias("n")), "texts")
        self.members = stage(keyed.select("d1", "d2", "doc_id").join(texts.select("d1", "d2", "rep", "size", "n"), ["d1", "d2"]).select("doc_id", "rep", "size", "n"), "members")
        kept = texts.where("row IS NOT NULL").select("row", "rep")
        one = _small(kept)
        matrix = rows.join(one if one is not None else kept, "row").select("rep", "n", "grams", *_LEAST)
        self.matrix = matrix if one is not None else stage(matrix, "matrix")
        self.classes = stage(self._classes(), "classes")
        self.cross = stage(self._cross(), "cross")
        release(rows, texts, self.matrix)

    def _least(self, size_a: Column, size_b: Column) -> Column:
        """Overlap that two rows of these sizes need: ceil(p (a + b) / (p + q))."""
        total = (size_a + size_b) * self.p
        return F.floor((total + (self.p + self.q - 1)) / (self.p + self.q))

    def _accumulated(self, pairs: DataFrame, p: int, q: int) -> DataFrame:
        """Those of the staged pairs ``(a, b, na, nb)`` whose whole rows have a similarity of at least ``p / q``."""
        first, second = pairs, pairs.select("b").distinct()
        if _small(pairs) is not None:
            first, second = F.broadcast(pairs), F.broadcast(second)
        left = self.matrix.select(F.col("rep").alias("a"), F.col("grams").alias("ga")).join(first, "a")
        right = self.matrix.select(F.col("rep").alias("b"), F.col("grams").alias("gb")).join(second, "b", "left_semi")
        overlap = F.size(F.array_intersect("ga", "gb"))
        return left.join(right, "b").where(overlap * q >= (F.col("na") + F.col("nb") - overlap) * p).select("a", "b")

    def _classes(self) -> DataFrame:
        """``(rep, cls)``: rows within half the allowed distance of a leader, and the leader itself.

        Rows that agree in one of their least hashes have the first of them as leader,
        and are compared with it if they agree in another one too, as near ones mostly
        do.  A leader is no member of another class.
        Who is missed here is found by the product.
        """
        p, q = self.p + self.q, 2 * self.q
        named = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(m).alias("m")) for i, m in enumerate(_LEAST)))).alias("at")
        placed = stage(self.matrix.select("rep", "n", *_LEAST, named).select("rep", "n", *_LEAST, "at.i", "at.m"), "placed")
        leaders = placed.groupBy("i", "m").agg(F.min(F.struct("rep", "n", *_LEAST)).alias("l"), F.count("*").alias("c")).where("c > 1").select("i", F.col("m"), "l")
        agreed = reduce(lambda x, y: x + y, ((F.col(m) == F.col(f"l.{m}")).cast("int") for m in _LEAST))
        asked = placed.join(leaders, ["i", "m"]).where((F.col("rep") != F.col("l.rep")) & (agreed > 1)).select(F.col("rep").alias("a"), F.col("l.rep").alias("b"), F.col("n").alias("na"), F.col("l.n").alias("nb"))
        asked = stage(asked.where((F.col("na") * q >= F.col("nb") * p) & (F.col("nb") * q >= F.col("na") * p)).distinct(), "asked")
        edges = stage(self._accumulated(asked, p, q), "edges")
        members = edges.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_anti").groupBy("a").agg(F.min("b").alias("cls"))
        found = stage(members.select(F.col("a").alias("rep"), "cls"), "found")
        release(placed, asked, edges)
        return found.unionByName(found.select(F.col("cls").alias("rep"), "cls").distinct())

    def _cross(self) -> DataFrame:
        parities = ", ".join(f"{c} long" for c in _SKETCH)
        counted = self.matrix.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").cast("int").alias("df"))
        columns = stage(counted.where("df > 1"), "columns")
        cells, small = self.matrix.select("rep", "n", F.explode("grams").alias("g")), _small(columns)
        # A broadcast leaves a row's cells together as they are read; after a shuffle they are brought together again.
        shared = cells.join(small, "g") if small is not None else cells.join(columns, "g").repartition("rep").sortWithinPartitions("rep")
        heads = shared.select("rep", "n", "g", "df").mapInArrow(_heads(self.p, self.q), f"rep long, n int, alone int, short int, {parities}, head array<long>")
        counts = self.classes.groupBy("cls").agg(F.count("*").alias("of_class"))
        classes = stage(self.classes.join(counts, "cls").select("rep", "cls", (F.col("of_class") > _SMALL_CLASS).alias("large")), "classes")
        few = _small(classes)
        heads = stage(heads.join(few if few is not None else classes, "rep", "left"), "heads")
        facts = ["rep", "n", "alone", *_SKETCH, "cls"]

        def side(df: DataFrame, name: str, *keys: str) -> DataFrame:
            return df.select(*keys, *(F.col(c).alias(f"{name}_{c}") for c in facts))

        apart = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in _SKETCH), F.col("a_alone") + F.col("b_alone"))
        na, nb = F.col("a_n"), F.col("b_n")
        bound = (na * self.q >= nb * self.p) & (nb * self.q >= na * self.p) & (na + nb - apart >= 2 * self._least(na, nb))
        usual, large = heads.where("large IS NULL OR NOT large"), heads.where("large")
        # The smaller row of a pair, of equal ones that of the lower id, is met in its first few columns.
        small = side(usual.withColumn("g", F.explode(F.slice("head", 1, F.col("short")))), "a", "g")
        all_columns = side(usual.withColumn("g", F.explode("head")), "b", "g")
        ordered = (na < nb) | ((na == nb) & (F.col("a_rep") < F.col("b_rep")))
        met = [small.join(all_columns, "g").where(ordered & F.coalesce(F.col("a_cls") != F.col("b_cls"), F.lit(True)) & bound)]
        if not classes.where("large").isEmpty():
            # Rows of large classes meet the others by column, and each other by class:
            # classes that meet in a column are taken apart once, however many columns they share.
            cells = large.withColumn("g", F.explode("head"))
            met.append(side(cells, "a", "g").join(all_columns, "g").where(bound))
            of_class = cells.select("g", "cls").distinct()
            met_classes = of_class.withColumnRenamed("cls", "x").join(of_class.withColumnRenamed("cls", "y"), "g").where("x < y").select("x", "y").distinct()
            a, b = side(large, "a"), side(large, "b")
            met.append(met_classes.join(a, F.col("x") == F.col("a_cls")).join(b, F.col("y") == F.col("b_cls")).where(bound))
        lower = F.col("a_rep") < F.col("b_rep")
        pair = [F.least("a_rep", "b_rep").alias("a"), F.greatest("a_rep", "b_rep").alias("b"), F.when(lower, na).otherwise(nb).alias("na"), F.when(lower, nb).otherwise(na).alias("nb")]
        pairs = stage(reduce(DataFrame.unionByName, (m.select(*pair) for m in met)).distinct(), "met")
        release(columns, heads, classes)
        return self._accumulated(pairs, self.p, self.q)

    def document_pairs(self) -> DataFrame:
        """``(doc_id_a, doc_id_b)`` of all documents that are near each other, equal ones included."""
        members = self.members.where("n > 0").select("doc_id", "rep")
        x, y = (members.select(F.col("doc_id").alias(d), F.col("rep").alias(r)) for d, r in (("x", "a"), ("y", "b")))
        across = self.cross.join(x, "a").join(y, "b").select("x", "y")
        # Documents of one class, or with equal words, are near each other.
        several = self.members.where("n > 0").join(self.classes, "rep", "left").where("size > 1 OR cls IS NOT NULL").select("doc_id", F.coalesce("cls", "rep").alias("cls"))
        within = several.select("cls", F.col("doc_id").alias("x")).join(several.select("cls", F.col("doc_id").alias("y")), "cls").where("x < y").select("x", "y")
        return across.unionByName(within).where("x <> y").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()

    def groups(self) -> DataFrame:
        """``(doc_id, group_id, n_links)``: the connected group of each document and its number of near documents.

        ``group_id`` is the smallest id of the group.  ``n_links`` counts other
        documents near it, those with equal words included.  A class is linked by its
        leader and counted as a whole; its pairs aren't made.
        """
        sizes = self.members.groupBy("rep").agg(F.max("size").alias("size"))
        linked = self.cross.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(self.cross.select(F.col("b").alias("rep"), F.col("a").alias("other")))
        links = linked.join(sizes.withColumnRenamed("rep", "other"), "other").groupBy("rep").agg(F.sum("size").alias("links"))
        whole = self.classes.join(sizes, "rep").groupBy("cls").agg(F.sum("size").alias("whole"))
        own = self.classes.join(whole, "cls").select("rep", "whole")
        roots = connected(self.cross.unionByName(self.classes.select(F.col("rep").alias("a"), F.col("cls").alias("b"))))
        rows = self.members.join(links, "rep", "left").join(own, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        others = F.when(F.col("n") > 0, F.coalesce("whole", "size") + F.coalesce("links", F.lit(0)) - 1).otherwise(0)
        return rows.select("doc_id", F.when(F.col("n") > 0, F.coalesce("root", "rep")).otherwise(F.col("doc_id")).alias("group_id"), others.alias("n_links"))

    def close(self) -> None:
        """Delete the staged tables, once the results are written or collected."""
        release(self.members, self.classes, self.cross)


def _checksum(edges: DataFrame) -> tuple:
    """What distinct edges have in common only if they are the same: their number and two sums of their hashes."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(h.cast("decimal(20,0)")), F.bit_xor(h)).first())


def connected(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of an edge: the smallest node of its component.

    Alternates linking larger neighbours and smaller ones to the smallest
    neighbour, which ends after about log rounds; each round is a staged table.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    sums = _checksum(now)
    for _ in range(_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("x"), "m").where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v"))
        after = stage(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, sums = sums, _checksum(after)
        release(now)
        now = after
        if sums == before:
            break
    else:
        raise RuntimeError("the components didn't settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
