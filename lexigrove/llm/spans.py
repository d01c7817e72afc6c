"""Problem 8: long exact spans shared between texts.

Seeds are the least-hashed k-mers of each window, so that any run of ``span``
characters that two texts share holds a seed of both.  Seeds that stand in more
than one text are looked up again with the text around them, paired, extended to
exact runs, and chained per pair of texts: trees over the positions in the
second text, which hold the seeds within the longest gap only, give each seed its
best predecessor under a linear gap cost.
Chains are then aligned into passages with their exact and their whole extent.

Equal texts are one text throughout (by 128 bits of hashes); their documents come
back at the end.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.operators.ranges import flat
from lexigrove.session import release, stage

SPAN = 200
KMER = 100
#: Seeds in more texts than this are paired by the span-long windows around them; results don't depend on it.
HOT_TEXTS = 24
#: Bytes up to which a table of text ids is broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20
GAP_COST = 0.05
MOST_GAP = 400
_BLOCK = 1 << 18
_SEEN = 1 << 20

#: Bytes of a broadcast row of a text and of each of its seeds, at most.
_TEXT_BYTES, _SEED_BYTES = 160, 48

_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(_BLOCK * 2 - 1)


def _mix(v: np.ndarray) -> np.ndarray:
    v = v ^ (v >> np.uint64(31))
    v = v * np.uint64(0x7FB5D329728EA185)
    v = v ^ (v >> np.uint64(27))
    v = v * np.uint64(0x81DADEF4BC2DD44D)
    return v ^ (v >> np.uint64(33))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown when needed."""

    def __init__(self) -> None:
        self.n = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, _BLOCK)
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.n - 1, b, np.uint64)])) for b in (_BASE, inverse))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def kmer_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-mer of an array of code points."""
    n = len(points)
    up, down = _POWERS.upto(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_mix(points.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return _mix((sums[k:] - sums[:-k]) * down[: n - k + 1])


def minimizers(points: np.ndarray, lengths: np.ndarray, k: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the seeds of texts laid end to end, each at least ``span`` long.

    Of every window of ``span - k + 1`` k-mers the least hash is taken, the last
    one of equals.  Where one k-mer repeats at every position, only each
    window-th of the run can be a seed, so such runs don't flood the seeds.
    """
    w = span - k + 1
    hashes = kmer_hashes(points, k)
    n = len(hashes)
    at = np.arange(n)
    same = np.zeros(n, bool)
    same[1:] = hashes[1:] == hashes[:-1]
    begun = np.maximum.accumulate(np.where(same, 0, at))
    order = (hashes & ~_LOW) | (_LOW - at.astype(np.uint64))
    order[(at - begun) % w != 0] = np.uint64(0xFFFFFFFFFFFFFFFF)
    padded = np.full(-(-n // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = order
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - w + 1], ahead[w - 1 : n])
    ends = np.cumsum(lengths)
    inside = np.zeros(n - w + 1, np.int32)  # windows that lie within one text
    begins = ends - lengths
    np.add.at(inside, begins, 1)
    stops = ends - span + 1
    np.add.at(inside, stops[stops < len(inside)], -1)
    chosen = (_LOW - (least[np.cumsum(inside) > 0] & _LOW)).astype(np.int64)
    chosen = np.unique(chosen)
    return chosen, hashes[chosen]


def _seeds(span: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def block(ids: list[int], texts: list[str]) -> pa.RecordBatch:
            points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            lengths = np.array([len(t) for t in texts])
            at, hashes = minimizers(points, lengths, k, span)
            ends = np.cumsum(lengths)
            text = np.searchsorted(ends, at, side="right")
            return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.array(ids, np.int64)[text]), pa.array((at - (ends - lengths)[text]).astype(np.int32))], names=["h", "tid", "pos"])

        for batch in batches:
            ids, texts, size = [], [], 0
            for tid, text in zip(flat(batch, "tid").to_pylist(), flat(batch, "text").to_pylist()):
                if tid in seen or len(text) < span:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(tid)
                if len(text) > _BLOCK:  # in overlapping blocks, so that no window is lost
                    for lo in range(0, len(text), _BLOCK - span):
                        part = text[lo : lo + _BLOCK]
                        if len(part) >= span:
                            out = block([tid], [part])
                            yield out.set_column(2, "pos", pa.array(out.column(2).to_numpy() + np.int32(lo), pa.int32()))
                    continue
                if size + len(text) > _BLOCK:
                    yield block(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(tid)
                texts.append(text)
                size += len(text)
            if ids:
                yield block(ids, texts)

    return run


def _surroundings(reach: int, k: int):
    """Cut each seed of a text out with ``reach`` characters to either side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tid, text, at in zip(*(flat(batch, n).to_pylist() for n in ("tid", "text", "at"))):
                for lo in range(0, len(at), 8192):
                    cut = [(tid, s["h"], p := s["pos"], text[max(0, p - reach) : p], text[p : p + k], text[p + k : p + k + reach]) for s in at[lo : lo + 8192]]
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cut), kinds)], names=["tid", "h", "pos", "left", "seed", "right"])

    return run


def _text_hash(text: Column) -> Column:
    return F.xxhash64(text, F.char_length(text))


_MATCH = "a long, b long, pa int, pb int, l int, r int"


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    if a == b:
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact extent of each pair of seeds to the left and right; pairs whose seeds differ are dropped."""
    for batch in batches:
        c = {n: flat(batch, n) for n in batch.schema.names}
        la, lb, sa, sb, ra, rb = (c[n].to_pylist() for n in ("la", "lb", "sa", "sb", "ra", "rb"))
        keep = np.array([x == y for x, y in zip(sa, sb)], bool)
        left = np.array([_common(x[::-1], y[::-1]) for x, y in zip(la, lb)], np.int32)
        right = np.array([_common(x, y) for x, y in zip(ra, rb)], np.int32)
        kept = pa.array(np.flatnonzero(keep))
        yield pa.RecordBatch.from_arrays([*(c[n].take(kept) for n in ("a", "b", "pa", "pb")), pa.array(left[keep]), pa.array(right[keep])], names=["a", "b", "pa", "pb", "l", "r"])


_NONE = (-(1 << 60), -1)


class _Reach:
    """Greatest value over a range of ranks of the seeds put in and not dropped yet, with who holds it.

    Seeds are dropped in the order in which they were put.
    """

    def __init__(self, n: int) -> None:
        self.n = n
        self.best = [_NONE] * (2 * n)
        self.held: list[deque] = [deque() for _ in range(n)]

    def put(self, i: int, value: int, who: int) -> None:
        held = self.held[i]
        while held and held[-1][0] <= value:
            held.pop()
        held.append((value, who))
        if len(held) == 1:
            self._raise(i, held[0])

    def drop(self, i: int, who: int) -> None:
        held = self.held[i]
        if held and held[0][1] == who:
            held.popleft()
            self._raise(i, held[0] if held else _NONE)

    def _raise(self, i: int, value: tuple[int, int]) -> None:
        best = self.best
        i += self.n
        best[i] = value
        while i > 1:
            i >>= 1
            value = max(best[2 * i], best[2 * i + 1])
            if best[i] == value:
                break
            best[i] = value

    def over(self, lo: int, hi: int) -> tuple[int, int]:
        best, out = self.best, _NONE
        lo, hi = lo + self.n, hi + self.n
        while lo < hi:
            if lo & 1:
                out = max(out, best[lo])
                lo += 1
            if hi & 1:
                hi -= 1
                out = max(out, best[hi])
            lo, hi = lo >> 1, hi >> 1
        return out


def _best_steps(seeds: list[tuple[int, int, int, int]], k: int) -> tuple[list[float], list[int]]:
    """Best score of a chain that ends with each seed, and the seed before it or -1.

    Earlier seeds that don't overlap bring k characters, others the smaller of
    their distances; which of the two holds is told by tree.  Only those that
    overlap in both texts are looked at one by one.  Of equal steps the one from the
    last seed is taken, so none is skipped; sums are whole units of ``GAP_COST``, so
    equal ones compare as equal.
    """
    unit = round(1 / GAP_COST)
    bs = sorted({s[1] for s in seeds})
    rank, reach = {p: i for i, p in enumerate(bs)}, MOST_GAP + k
    apart, beside, above, level = (_Reach(len(bs)) for _ in range(4))
    close: list[deque] = [deque() for _ in bs]
    score, before, worth = [], [], []
    i = fresh = old = 0
    while i < len(seeds):
        a = seeds[i][0]
        while fresh < i and a - seeds[fresh][0] >= k:
            at = rank[seeds[fresh][1]]
            above.drop(at, fresh)
            level.drop(at, fresh)
            close[at].popleft()
            apart.put(at, worth[fresh], fresh)
            beside.put(at, worth[fresh] - unit * seeds[fresh][1], fresh)
            fresh += 1
        while old < fresh and a - seeds[old][0] > reach:
            at = rank[seeds[old][1]]
            apart.drop(at, old)
            beside.drop(at, old)
            old += 1
        j = i
        while j < len(seeds) and seeds[j][0] == a:
            b = seeds[j][1]
            lo, mid, hi = bisect_left(bs, b - reach), bisect_right(bs, b - k), rank[b]
            (v1, w1), (v2, w2), (v3, w3) = apart.over(lo, mid), beside.over(mid, hi), above.over(lo, mid)
            value, who = max((v1 + unit * k, w1), (v2 + unit * b, w2), (v3 + unit * a, w3))
            for r in range(hi - 1, mid - 1, -1):
                if above.best[above.n + r][0] + unit * a < value or level.best[level.n + r][0] + unit * (b - bs[r]) < value:
                    continue
                for x in close[r]:
                    value, who = max((value, who), (worth[x] + unit * min(a - seeds[x][0], b - bs[r]), x))
            value -= a + b
            score.append(max(unit * k, value))
            before.append(who if value > unit * k else -1)
            j += 1
        for x in range(i, j):
            at = rank[seeds[x][1]]
            worth.append(score[x] + a + seeds[x][1])
            above.put(at, worth[x] - unit * a, x)
            level.put(at, worth[x], x)
            close[at].append(x)
        i = j
    return [s / unit for s in score], before


def chain(seeds: list[tuple[int, int, int, int]], k: int) -> list[list[int]]:
    """Collinear chains of seeds ``(pa, pb, left, right)`` sorted by ``(pa, pb)``, best first.

    A seed is worth its k characters; going on from an earlier one costs
    ``GAP_COST`` for each character between them in either text.  Each seed takes
    the best of those within ``MOST_GAP`` characters; where no step brings more than
    it costs, it begins a new chain.
    """
    score, before = _best_steps(seeds, k)
    chains, used = [], [False] * len(seeds)
    for end in sorted(range(len(seeds)), key=lambda x: (-score[x], x)):
        path, x = [], end
        while x >= 0 and not used[x]:
            used[x] = True
            path.append(x)
            x = before[x]
        if path:
            chains.append(path[::-1])
    return chains


def align(seeds: list[tuple[int, int, int, int]], path: list[int], k: int) -> tuple[int, int, int, int, int, int]:
    """Extent of a chain in both texts, its exactly equal characters, and its longest exact run."""
    runs: dict[int, list[list[int]]] = {}
    for x in path:
        a, b, left, right = seeds[x]
        own = runs.setdefault(b - a, [])
        if own and a - left <= own[-1][1]:
            own[-1][1] = max(own[-1][1], a + k + right)
        else:
            own.append([a - left, a + k + right])
    spans = sorted((lo, hi, d) for d, own in runs.items() for lo, hi in own)
    exact, reached = 0, -1
    for lo, hi, _ in spans:
        exact += max(0, hi - max(lo, reached))
        reached = max(reached, hi)
    return (min(s[0] for s in spans), max(s[1] for s in spans), min(s[0] + s[2] for s in spans), max(s[1] + s[2] for s in spans), exact, max(s[1] - s[0] for s in spans))


_PASSAGE = "a long, b long, a_start int, a_end int, b_start int, b_end int, n_seeds int, exact_chars int, longest int"


def _passages(k: int):
    def emit(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 2 + [pa.int32()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["a", "b", "a_start", "a_end", "b_start", "b_end", "n_seeds", "exact_chars", "longest"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(flat(batch, n).to_pylist() for n in ("a", "b", "pa", "pb", "l", "r")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (a, b), own in groupby(rows(batches), key=lambda r: r[:2]):
            seeds = [r[2:] for r in own]
            for path in chain(seeds, k):
                extent = align(seeds, path, k)
                out.append((a, b, *extent[:4], len(path), *extent[4:]))
            if len(out) >= 4096:
                yield emit(out)
                out = []
        if out:
            yield emit(out)

    return run


def _occurrences(apart: int):
    """Every place of both seeds of a match, where a text has the same surroundings several times.

    Places up to ``apart`` from the one before belong to one periodic stretch, and
    two such stretches are laid beside each other from their beginnings;
    all stretches of one text go with all of the other.
    """

    def stretches(places: list[int] | None, only: int) -> list[list[int]]:
        out: list[list[int]] = []
        for p in sorted(places or [only]):
            if out and p - out[-1][-1] <= apart:
                out[-1].append(p)
            else:
                out.append([p])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, at, bt, left, right, more_a, more_b in zip(*(flat(batch, n).to_pylist() for n in ("a", "b", "pa", "pb", "l", "r", "more_a", "more_b"))):
                if more_a is None and more_b is None:
                    rows.append((a, b, at, bt, left, right))
                else:
                    rows += [(a, b, x, y, left, right) for xs in stretches(more_a, at) for ys in stretches(more_b, bt) for x, y in zip(xs, ys)]
                if len(rows) >= 8192:
                    yield _matches(rows)
                    rows = []
            if rows:
                yield _matches(rows)

    return run


def _matches(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 2 + [pa.int32()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["a", "b", "pa", "pb", "l", "r"])


class SharedSpans:
    """Passages that texts share, found once and read by each result.

    ``members``: ``(doc_id, tid, n)`` of each document whose text has at least
    ``span`` characters; equal texts have one ``tid``.  ``around``: each seed that
    stands in several texts, with the text around it.  What each text shares is
    told by its own windows, so it takes no pairs of the texts of a hot seed; only
    :meth:`document_pairs` and :meth:`text_pairs` make those.
    Null, empty and shorter texts share nothing.  Rows whose id is null are left
    out; a repeated id with equal text counts once.  Other columns are ignored.
    """

    def __init__(self, df: DataFrame, id_col: str, text_col: str, span: int = SPAN, k: int = KMER) -> None:
        self.span, self.k = span, k
        texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL").where(F.char_length("text") >= span)
        tid, check = _text_hash(F.col("text")), F.xxhash64(F.lit(span), F.col("text"))
        found = stage(texts.select("doc_id", tid.alias("tid"), check.alias("check"), F.char_length("text").alias("n")).distinct(), "members")
        self._found = found
        # Different texts with one 64-bit hash, of which even 10**10 texts have but a few, are told apart by the second.
        clash = [r["tid"] for r in found.groupBy("tid").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo <> hi").select("tid").collect()]

        def apart(tid: Column, check: Column) -> Column:
            return F.when(tid.isin(clash), F.xxhash64(check, tid)).otherwise(tid) if clash else tid

        self.texts = texts.withColumn("tid", apart(tid, check))
        self.members = found.select("doc_id", apart(F.col("tid"), F.col("check")).alias("tid"), "n")
        seeds = stage(self.texts.select("tid", "text").mapInArrow(_seeds(span, k), "h long, tid long, pos int"), "seeds")
        shared = seeds.groupBy("h").agg(F.min("tid").alias("lo"), F.max("tid").alias("hi")).where("lo <> hi").select("h")
        matched = stage(seeds.join(shared, "h").distinct(), "matched")
        release(seeds)
        self.around = stage(self._around(matched), "around")
        release(matched)
        heat = self.around.groupBy("h").agg((F.count("*") > HOT_TEXTS).alias("hot"))
        rows = self.around.drop("places").join(heat, "h")
        self.hot = rows.where("hot")
        self.cold = stage(self._cold(rows.where("not hot")), "cold")

    def _around(self, matched: DataFrame) -> DataFrame:
        """Each matched seed with the text around it, once for each text and surrounding."""
        first = self.members.groupBy("tid").agg(F.min("doc_id").alias("doc_id"))
        at = matched.groupBy("tid").agg(F.collect_list(F.struct("h", "pos")).alias("at"))
        wanted = at.join(first, "tid")
        size = matched.count() * (_SEED_BYTES + _TEXT_BYTES)  # there are no more texts than seeds
        side = F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted
        rows = self.texts.join(side, ["tid", "doc_id"]).select("tid", "text", "at")
        cut = rows.mapInArrow(_surroundings(self.span - self.k, self.k), "tid long, h long, pos int, left string, seed string, right string")
        return cut.groupBy("tid", "h", "left", "seed", "right").agg(F.min("pos").alias("pos"), F.array_distinct(F.collect_list("pos")).alias("places"))

    @staticmethod
    def _sides(rows: DataFrame) -> list[DataFrame]:
        return [rows.select("h", F.col("tid").alias(t), F.col("pos").alias(f"p{t}"), F.col("left").alias(f"l{t}"), F.col("seed").alias(f"s{t}"), F.col("right").alias(f"r{t}")) for t in "ab"]

    def _cold(self, rows: DataFrame) -> DataFrame:
        """Pairs of the few texts of a seed, extended character by character."""
        a, b = self._sides(rows)
        return a.join(b, "h").where("a < b").drop("h").mapInArrow(_extend, _MATCH)

    def _of_pairs(self) -> DataFrame:
        """All matches of the pairs of texts that share a run of ``span``, whether a seed is hot or not."""
        pairs = stage(self._long().select("a", "b").unionByName(self._hot_pairs().select("a", "b")).distinct(), "pairs")
        a, b = self._sides(self.hot)
        hot = pairs.join(a, "a").join(b, ["b", "h"]).drop("h").mapInArrow(_extend, _MATCH)
        return self.cold.join(pairs, ["a", "b"], "left_semi").unionByName(hot)

    def _windows(self) -> DataFrame:
        """``(h, o, win, tid, pos, after, before)``: the span-long windows around each hot seed, by hash.

        A common run that holds the seed is one of these windows, cut at the same
        distance ``o`` before the seed in both texts.
        """
        reach, whole = self.span - self.k, F.concat("left", "seed", "right")
        lead = F.char_length("left")
        cut = F.transform(F.sequence(F.lit(0), F.lit(reach)), lambda o: F.when((o <= lead) & (lead - o + self.span <= F.char_length(whole)), F.xxhash64(F.substring(whole, lead - o + 1, F.lit(self.span)))))
        # The outer form, as the inner one has the optimizer cut windows of all seeds to test whether there are any.
        one = self.hot.select("h", "tid", "pos", cut.alias("cut")).select("h", "tid", "pos", "cut", F.posexplode_outer("cut").alias("o", "win")).where("win IS NOT NULL")
        return one.select("h", "o", "win", "tid", "pos", F.get("cut", F.col("o") + 1).alias("after"), F.get("cut", F.col("o") - 1).alias("before"))

    def _hot_pairs(self) -> DataFrame:
        """Pairs of the many texts of a seed that share one of the windows around it.

        The windows that two texts share are neighbours; only the last and the first of
        them make a row.  Where all texts that share a window share the next one too,
        no pair's last window is here, and none's first where all share the one before:
        such classes aren't joined, so a passage of many texts meets each pair about
        twice, not once for each window.
        """
        key, one = ["h", "o", "win"], self._windows()

        def ends(side: str) -> Column:
            return (F.count(side) < F.count("*")) | (F.min(side) != F.max(side))

        edges = one.groupBy(*key).agg((F.min("tid") != F.max("tid")).alias("several"), ends("after").alias("last"), ends("before").alias("begin"))
        one = one.join(edges.where(F.col("several") & (F.col("last") | F.col("begin"))).select(*key), key)
        a, b = (one.select(*key, F.col("tid").alias(s), F.col("pos").alias(f"p{s}"), F.col("after").alias(f"after_{s}"), F.col("before").alias(f"before_{s}")) for s in "ab")
        last = ~F.coalesce(F.col("after_a") == F.col("after_b"), F.lit(False))
        begin = ~F.coalesce(F.col("before_a") == F.col("before_b"), F.lit(False))
        pairs = a.join(b, key).where((F.col("a") < F.col("b")) & (last | begin))
        return pairs.groupBy("a", "b", "pa", "pb").agg(F.max("o").cast("int").alias("l"), (F.lit(self.span - self.k) - F.min("o")).cast("int").alias("r"))

    def _long(self) -> DataFrame:
        """Matches of the seeds in few texts that lie within an exact run of ``span``: what the windows show of the others."""
        return self.cold.where(F.col("l") + F.col("r") + self.k >= self.span)

    def _extents(self) -> DataFrame:
        """``(tid, pos, l, r)``: how far to either side of a seed a text is shared with any other."""
        long = self._long()
        sides = [long.select(F.col(t).alias("tid"), F.col(p).alias("pos"), "l", "r") for t, p in (("a", "pa"), ("b", "pb"))]
        one = self._windows().select("h", "o", "win", "tid", "pos")
        several = one.groupBy("h", "o", "win").agg(F.min("tid").alias("lo"), F.max("tid").alias("hi")).where("lo <> hi").select("h", "o", "win")
        hot = one.join(several, ["h", "o", "win"]).select("tid", "pos", F.col("o").alias("l"), (F.lit(self.span - self.k) - F.col("o")).alias("r"))
        # All of a seed's shared windows hold the seed, so together they are one stretch.
        return sides[0].unionByName(sides[1]).unionByName(hot).groupBy("tid", "pos").agg(F.max("l").alias("l"), F.max("r").alias("r"))

    def _chained(self, matches: DataFrame) -> DataFrame:
        near = matches.distinct().repartition("a", "b").sortWithinPartitions("a", "b", "pa", "pb")
        return near.mapInArrow(_passages(self.k), _PASSAGE)

    def passages(self) -> DataFrame:
        """One row for each chain of a pair of texts: its extent in both, its exact characters and longest exact run.

        Chained are the seeds within exact runs of ``span``, of those with the same
        surroundings in one text only the first: enough to tell which texts share such a
        run.  The extents across small changes are those of :meth:`text_pairs`.
        """
        return self._chained(self._long().unionByName(self._hot_pairs()))

    def _everywhere(self, matches: DataFrame) -> DataFrame:
        """Matches at all places of their seeds."""
        several = self.around.where(F.size("places") > 1)
        more_a, more_b = (several.select(F.col("tid").alias(t), F.col("pos").alias(f"p{t}"), F.col("places").alias(f"more_{t}")) for t in "ab")
        return matches.join(more_a, ["a", "pa"], "left").join(more_b, ["b", "pb"], "left").mapInArrow(_occurrences(self.span), _MATCH)

    def document_pairs(self) -> DataFrame:
        """``(doc_id_a, doc_id_b)``: documents that share a run of at least ``span`` characters."""
        pairs = self.passages().where(F.col("longest") >= self.span).select("a", "b").distinct()
        members = self.members.select("doc_id", "tid")
        x, y = (members.select(F.col("doc_id").alias(d), F.col("tid").alias(t)) for d, t in (("x", "a"), ("y", "b")))
        across = pairs.join(x, "a").join(y, "b").select("x", "y")
        several = members.groupBy("tid").agg(F.count("*").alias("c")).where("c > 1").select("tid")
        equal = members.join(several, "tid")
        within = equal.select("tid", F.col("doc_id").alias("x")).join(equal.select("tid", F.col("doc_id").alias("y")), "tid").where("x < y").select("x", "y")
        return across.unionByName(within).where("x <> y").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()

    def text_pairs(self) -> DataFrame:
        """Passages with an exact run of at least ``span``, with one document and the number of documents of each text.

        Passages that a text has several times are reported at each of their places.
        Their extents don't depend on how many other texts have the same seeds.
        The other documents of a text are told by :meth:`classes`.
        """
        first = self.members.groupBy("tid").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"))
        a = first.select(F.col("tid").alias("a"), F.col("doc").alias("doc_id_a"), F.col("copies").alias("copies_a"))
        b = first.select(F.col("tid").alias("b"), F.col("doc").alias("doc_id_b"), F.col("copies").alias("copies_b"))
        found = self._chained(self._everywhere(self._of_pairs()))
        return found.where(F.col("longest") >= self.span).join(a, "a").join(b, "b").drop("a", "b")

    def classes(self) -> DataFrame:
        """``(doc_id, text_doc_id)``: the document that stands for each member's text in :meth:`text_pairs`."""
        first = self.members.groupBy("tid").agg(F.min("doc_id").alias("text_doc_id"))
        return self.members.join(first, "tid").select("doc_id", "text_doc_id")

    def shared_stretches(self) -> DataFrame:
        """``(doc_id, begin, end)``: the parts of each document's text that stand in runs shared with other documents.

        Runs that touch or overlap are one stretch; a text that another document
        has as a whole is one stretch.
        """
        spots = self.around.select("tid", "pos", "places").distinct()
        spans = self._extents().join(spots, ["tid", "pos"]).select("tid", F.explode("places").alias("p"), "l", "r")
        spans = spans.select("tid", (F.col("p") - F.col("l")).alias("lo"), (F.col("p") + self.k + F.col("r")).alias("hi")).distinct()
        by_text = Window.partitionBy("tid").orderBy("lo", "hi")
        reached = F.max("hi").over(by_text.rowsBetween(Window.unboundedPreceding, -1))
        parted = spans.withColumn("fresh", F.coalesce((F.col("lo") > reached).cast("int"), F.lit(1)))
        placed = parted.withColumn("stretch", F.sum("fresh").over(by_text))
        merged = placed.groupBy("tid", "stretch").agg(F.min("lo").alias("begin"), F.max("hi").alias("end")).drop("stretch")
        copied = self.members.groupBy("tid").agg(F.count("*").alias("copies"), F.max("n").alias("n"))
        whole = copied.where("copies > 1").select("tid", F.lit(0).alias("begin"), F.col("n").alias("end"))
        single = merged.join(copied.where("copies = 1").select("tid"), "tid", "left_semi")
        return self.members.select("doc_id", "tid").join(whole.unionByName(single), "tid").select("doc_id", "begin", "end")

    def shared_extent(self) -> DataFrame:
        """``(doc_id, n_chars, n_shared)`` of each member: how many of its characters stand in shared runs."""
        sums = self.shared_stretches().groupBy("doc_id").agg(F.sum(F.col("end") - F.col("begin")).alias("n_shared"))
        return self.members.join(sums, "doc_id", "left").select("doc_id", F.col("n").cast("long").alias("n_chars"), F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"))

    def close(self) -> None:
        """Delete the staged tables, once the results are written or collected."""
        release(self._found, self.around, self.cold)
