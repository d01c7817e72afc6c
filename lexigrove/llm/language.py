"""Problem 4: language of documents and of the segments of mixed ones.

One interpolated Kneser-Ney character model per language is trained on the
labelled samples.  All models share sorted arrays of n-gram hashes with a row of
log-probabilities per language, so a lookup is one binary search.  Each distinct
word of a batch is scored once, in all languages; a document's words then go
through a best path that pays for each change of language.  Stretches shorter
than ``MIN_WORDS`` fall to what is around them.  A segment's language has the
lowest cross-entropy per character; segments whose cross-entropy lies above what
held-out text of the language has are rejected.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.operators.ranges import flat

ORDER = 5
MIN_WORDS = 8
#: Nats that a change of language costs at the end of a sentence or line, and within one.
SWITCH = 8.0
SWITCH_WITHIN = 14.0
#: Labelled samples used of each language, at most (the least hashes of their ids).
MOST_SAMPLES = 2000
#: Labelled documents added to the training text, at most (the least hashes of their ids).
MOST_DOCUMENTS = 3000
#: One sample of so many is held out for the rejection bound and the confidence.
HELD_OUT = 5
#: Words of the held-out pieces that the confidence is fitted on.
PIECES = (1, 2, 4, MIN_WORDS)
_BREAK = re.compile(r"[.!?\n\r]")
_WORD = re.compile(r"[^\W_]+")
_MARK = "\x02"
_DISCOUNT = 0.75
_FLOOR = 1e-7

# Three-letter codes (both ISO 639-2 forms) and English names of languages by two-letter code.
NAMES = {
    "en": ["eng", "english"],
    "es": ["spa", "spanish"],
    "de": ["deu", "ger", "german"],
    "fr": ["fra", "fre", "french"],
    "pt": ["por", "portuguese"],
    "it": ["ita", "italian"],
    "nl": ["nld", "dut", "dutch"],
    "ca": ["cat", "catalan"],
    "gl": ["glg", "galician"],
    "pl": ["pol", "polish"],
    "ru": ["rus", "russian"],
    "sv": ["swe", "swedish"],
    "da": ["dan", "danish"],
    "ja": ["jpn", "japanese"],
    "zh": ["zho", "chi", "chinese"],
}


def label_language(label: Column) -> Column:
    """Two-letter code that a label names, or null: a code with or without a region, or an English name, in any case."""
    name = F.lower(F.regexp_extract(F.trim(label), r"^([A-Za-z]+)(?:[-_][A-Za-z0-9]+)*$", 1))
    known = F.create_map(*(F.lit(x) for code, names in NAMES.items() for n in (code, *names) for x in (n, code)))
    return F.element_at(known, name)


def plain(word: str) -> str:
    """A word without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def _hash(text: str) -> int:
    value = 1469598103934665603
    for c in text:
        value = ((value ^ ord(c)) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return value


class Models:
    """Interpolated Kneser-Ney character models of several languages in sorted hash arrays.

    Training words stand between marks and count with and without their accents.
    ``tables[n]``: sorted hashes of the n-grams that any language has seen, and
    for each the log-probability of its last character in every language;
    ``weights[n]``: the same for contexts, with the log weight given to the
    shorter context.  What a language hasn't seen backs off.
    """

    def __init__(self, samples: list[tuple[str, str]], order: int = ORDER) -> None:
        self.order = order
        self.langs = sorted({lang for lang, _ in samples})
        self.alphabet = 1 + len({c for _, text in samples for c in text.lower()})
        seen: list[dict[str, Counter]] = []
        for lang in self.langs:
            words = [w for x, text in samples if x == lang for w in _WORD.findall(text.lower())]
            seen.append(self._counts(Counter(words + [p for w in words if (p := plain(w)) != w])))
        self.tables, self.weights = {}, {}
        probs = [self._probabilities(c) for c in seen]
        for n in range(1, order + 1):
            grams = sorted({g for p, _ in probs for g in p if len(g) == n}, key=_hash)
            values = np.full((len(grams), len(self.langs)), np.nan)
            for j, (p, w) in enumerate(probs):
                for i, g in enumerate(grams):
                    values[i, j] = np.log(self._chain(p, w, g))
            self.tables[n] = (np.array([_hash(g) for g in grams], np.uint64), values)
            contexts = sorted({c for _, w in probs for c in w if len(c) == n}, key=_hash)
            back = np.zeros((len(contexts), len(self.langs)))
            for j, (_, w) in enumerate(probs):
                back[:, j] = [np.log(w.get(c, 1.0)) for c in contexts]
            self.weights[n] = (np.array([_hash(c) for c in contexts], np.uint64), back)
        # The empty context's weight lies within the unigrams; a character that none has seen has the same floor everywhere.
        self.unseen = np.log(np.array([max(w.get("", _FLOOR), _FLOOR) / self.alphabet / 50 for _, w in probs]))

    def _counts(self, words: Counter) -> dict[str, Counter]:
        """Counts of the highest order, and continuation counts of the lower ones, by context."""
        top: dict[str, Counter] = defaultdict(Counter)
        for word, times in words.items():
            marked = _MARK * (self.order - 1) + word + _MARK
            for i in range(self.order - 1, len(marked)):
                top[marked[i - self.order + 1 : i]][marked[i]] += times
        levels = {self.order: top}
        for n in range(self.order - 1, 0, -1):
            lower: dict[str, Counter] = defaultdict(Counter)
            for context, following in levels[n + 1].items():
                for c in following:
                    lower[context[1:]][c] += 1
            levels[n] = lower
        return {context: following for level in levels.values() for context, following in level.items()}

    def _probabilities(self, counts: dict[str, Counter]) -> tuple[dict[str, float], dict[str, float]]:
        """Interpolated probability of each n-gram seen, and each context's weight for the shorter one."""
        probs: dict[str, float] = {}
        weights: dict[str, float] = {}
        for context in sorted(counts, key=len):
            following = counts[context]
            total = sum(following.values())
            weight = _DISCOUNT * len(following) / total
            weights[context] = weight
            for c, n in following.items():
                shorter = probs[context[1:] + c] if context else 1.0 / self.alphabet
                probs[context + c] = (n - _DISCOUNT) / total + weight * shorter
        return probs, weights

    def _chain(self, probs: dict[str, float], weights: dict[str, float], gram: str) -> float:
        """Probability of the last character after the others, by backing off."""
        weight = 1.0
        while gram not in probs:
            if len(gram) == 1:
                return weight * weights[""] / self.alphabet / 10
            weight *= weights.get(gram[:-1], 1.0)
            gram = gram[1:]
        return weight * probs[gram]

    def score(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word in each language."""
        marks = self.order - 1
        text = "".join(_MARK * marks + w + _MARK for w in words)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        lengths = np.array([len(w) + 1 for w in words])
        ends = np.cumsum(lengths + marks)
        word_of = np.repeat(np.arange(len(words)), lengths)
        at = np.arange(len(word_of)) + marks * (word_of + 1)
        prime, start = np.uint64(1099511628211), np.uint64(1469598103934665603)
        out = np.zeros((len(at), len(self.langs)))
        left = np.arange(len(at))
        for n in range(self.order, 0, -1):
            if not len(left):
                break
            here = at[left]
            context = np.full(len(left), start)
            for k in range(n - 1, 0, -1):
                context = (context ^ points[here - k]) * prime
            gram = (context ^ points[here]) * prime
            keys, values = self.tables[n]
            found = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
            hit = keys[found] == gram
            out[left[hit]] += values[found[hit]]
            left, context = left[~hit], context[~hit]
            if n > 1:
                keys, values = self.weights[n - 1]
                found = np.minimum(np.searchsorted(keys, context), len(keys) - 1)
                known = keys[found] == context
                out[left[known]] += values[found[known]]
        out[left] += self.unseen
        return np.add.reduceat(out, ends - lengths - marks * np.arange(1, len(words) + 1), axis=0) if len(words) else np.zeros((0, len(self.langs)))


def _pieces(rows: np.ndarray, length: int) -> np.ndarray:
    """Sums over each ``length`` rows; what is left at the end is dropped."""
    n = len(rows) // length
    return rows[: n * length].reshape(n, length, *rows.shape[1:]).sum(axis=1)


class Identifier:
    """Models with their bounds for rejection, fitted on held-out samples.

    The bound of a language lies six standard deviations above the mean
    cross-entropy per character of its held-out pieces of ``MIN_WORDS`` words, and a
    quarter above the greatest at least.  The confidence of a segment is the share of
    its language by the likelihoods of its words, tempered so that held-out pieces
    of one word to ``MIN_WORDS`` are as probable as can be: neighbouring words say
    less together than each for itself.
    """

    def __init__(self, samples: list[tuple[str, str]]) -> None:
        by_lang: dict[str, list[str]] = defaultdict(list)
        for lang, text in samples:
            by_lang[lang].append(text)
        fit = [(lang, t) for lang, own in by_lang.items() for i, t in enumerate(own) if i % HELD_OUT or len(own) < HELD_OUT]
        held = [(lang, t) for lang, own in by_lang.items() for i, t in enumerate(own) if not i % HELD_OUT and len(own) >= HELD_OUT]
        trial = Models(fit)
        entropies: dict[str, list[np.ndarray]] = defaultdict(list)
        pieces: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for lang, text in held:
            words, own = _WORD.findall(text.lower()), trial.langs.index(lang)
            scores, sizes = trial.score(words), np.array([len(w) + 1 for w in words])
            for length in PIECES:
                part = _pieces(scores, length)
                pieces[length].append((own, part))
                if length == MIN_WORDS:
                    entropies[lang].append(-part[:, own] / _pieces(sizes, length))
        seen = {lang: np.concatenate(own) for lang, own in entropies.items() if sum(map(len, own))}
        self.models = Models(samples)
        self.langs = self.models.langs
        self.bounds = np.array([max(1.25 * x.max(), x.mean() + 6 * x.std()) if (x := seen.get(lang)) is not None else 12.0 for lang in self.langs])
        self.temper = self._fit_temper(pieces)

    @staticmethod
    def _fit_temper(pieces: dict[int, list[tuple[int, np.ndarray]]]) -> float:
        """The temper of least mean surprise, every length counting alike."""
        by_length = []
        for own in pieces.values():
            scores = np.concatenate([part for _, part in own]) if own else np.zeros((0, 1))
            if len(scores):
                scores = scores - scores.max(axis=1, keepdims=True)
                by_length.append((scores, scores[np.arange(len(scores)), np.repeat([i for i, _ in own], [len(part) for _, part in own])]))
        if not by_length:
            return 0.5
        tempers = np.geomspace(0.02, 2, 50)
        surprise = [sum((np.log(np.exp(t * scores).sum(axis=1)) - t * right).mean() for scores, right in by_length) for t in tempers]
        return float(tempers[int(np.argmin(surprise))])

    def confidences(self, lang: str, text: str, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Confidence of each piece of so many words of a text, and whether its nearest language is the right one."""
        part = _pieces(self.models.score(_WORD.findall(text.lower())), length)
        return self.shares(part).max(axis=1), part.argmax(axis=1) == self.langs.index(lang)

    def shares(self, scores: np.ndarray) -> np.ndarray:
        """Each language's share by tempered scores."""
        share = np.exp(self.temper * (scores - scores.max(axis=-1, keepdims=True)))
        return share / share.sum(axis=-1, keepdims=True)

    def words(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray, list[list[tuple[int, int]]]]:
        """Word numbers of each text, the cost of a change before each, the distinct words' scores and lengths, and each word's place."""
        known: dict[str, int] = {}
        numbers, costs, places = [], [], []
        for text in texts:
            found = [(m.group(), m.span()) for m in _WORD.finditer(text)]
            numbers.append(np.array([known.setdefault(w.lower(), len(known)) for w, _ in found], np.int64))
            place = [p for _, p in found]
            begins = np.array([b for b, _ in place], np.int64)
            ends = np.array([0, *(e for _, e in place)], np.int64)[:-1]
            breaks = np.array([m.start() for m in _BREAK.finditer(text)] + [len(text) + 1])
            fresh = breaks[np.searchsorted(breaks, ends)] < begins
            costs.append(np.where(fresh, SWITCH, SWITCH_WITHIN))
            places.append(place)
        distinct = list(known)
        scores = self.models.score(distinct)
        letters = np.array([any(c.isalpha() for c in w) for w in distinct], bool)
        scores[~letters] = 0.0  # figures say nothing
        return numbers, costs, scores, np.where(letters, [len(w) + 1 for w in distinct], 0), places

    def paths(self, rows: list[np.ndarray], costs: list[np.ndarray], scores: np.ndarray) -> list[np.ndarray]:
        """Best language of each word of many texts at once."""
        order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
        n_langs, longest = len(self.langs), len(rows[order[0]]) if rows else 0
        grid = np.full((longest, len(rows)), -1)
        cost = np.zeros((longest, len(rows)))
        for column, i in enumerate(order):
            grid[: len(rows[i]), column] = rows[i]
            cost[: len(rows[i]), column] = costs[i]
        live = (grid >= 0).sum(axis=1)
        best = np.zeros((len(rows), n_langs))
        backs = []
        for t in range(longest):
            m = live[t]
            top = best[:m].argmax(axis=1)
            jump = best[np.arange(m), top] - cost[t, :m]
            stay = best[:m] >= jump[:, None]
            backs.append(np.where(stay, np.arange(n_langs), top[:, None]).astype(np.int8))
            best[:m] = np.where(stay, best[:m], jump[:, None]) + scores[grid[t, :m]]
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(rows)
        state = best.argmax(axis=1)
        lines = np.zeros((longest, len(rows)), np.int8)
        for t in range(longest - 1, -1, -1):
            m = live[t]
            lines[t, :m] = state[:m]
            state[:m] = backs[t][np.arange(m), state[:m]]
        for column, i in enumerate(order):
            out[i] = lines[: len(rows[i]), column]
        return out

    @staticmethod
    def runs(path: np.ndarray) -> list[list[int]]:
        """Stretches ``[language, begin, end]`` of at least ``MIN_WORDS`` words; shorter ones fall to their neighbours.

        Those within one language go first, then the shortest; between two
        languages the longer neighbour takes them.
        """
        cuts = np.flatnonzero(np.diff(path)) + 1
        begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(path)]])
        runs = [[int(path[b]), int(b), int(e)] for b, e in zip(begins, ends)]
        while len(runs) > 1:
            short = [i for i, (_, b, e) in enumerate(runs) if e - b < MIN_WORDS]
            if not short:
                break
            within = {i for i in short if 0 < i < len(runs) - 1 and runs[i - 1][0] == runs[i + 1][0]}
            i = min(short, key=lambda j: (j not in within, runs[j][2] - runs[j][1]))
            _, begin, end = runs.pop(i)
            if i in within:
                runs[i - 1][2] = runs.pop(i)[2]
            elif i and (i == len(runs) or runs[i - 1][2] - runs[i - 1][1] >= runs[i][2] - runs[i][1]):
                runs[i - 1][2] = end
            else:
                runs[i][1] = begin
        return runs

    def segments(self, texts: list[str]) -> list[list[tuple[str | None, str, int, int, int, float, float]]]:
        """For each text: ``(language or None, nearest language, begin, end, words, confidence, cross-entropy)``."""
        return [found for _, _, found in self.documents(texts)]

    def documents(self, texts: list[str]) -> list[tuple[str | None, float | None, list[tuple[str | None, str, int, int, int, float, float]]]]:
        """For each text its language, its confidence and its segments.

        The language is that of most words over all segments that aren't rejected,
        the earliest of equals; the confidence is the expected share of the words
        that are in it.
        """
        numbers, costs, scores, sizes, places = self.words(texts)
        out = []
        for row, path, place, text in zip(numbers, self.paths(numbers, costs, scores), places, texts):
            parts: list[list] = []  # nearest language, begin, end, scores, characters
            for _, begin, end in self.runs(path) if len(row) else []:
                part, chars = scores[row[begin:end]].sum(axis=0), int(sizes[row[begin:end]].sum())
                if not chars:
                    continue
                own = int(part.argmax())
                if parts and parts[-1][0] == own:
                    parts[-1][2:] = [end, parts[-1][3] + part, parts[-1][4] + chars]
                else:
                    parts.append([own, begin, end, part, chars])
            found, shares = [], []
            for i, (own, begin, end, part, chars) in enumerate(parts):
                entropy = -part / chars
                shares.append(self.shares(part))
                sure = entropy[own] <= self.bounds[own]
                from_, to = place[begin][0] if i else 0, len(text) if i + 1 == len(parts) else place[end - 1][1]
                found.append((self.langs[own] if sure else None, self.langs[own], from_, to, end - begin, float(shares[-1][own]), float(entropy[own])))
            counts: Counter = Counter()
            for lang, *_, n_words, _, _ in found:
                if lang is not None:
                    counts[lang] += n_words
            if not counts:
                out.append((None, None, found))
                continue
            main = max(counts, key=counts.__getitem__)
            sizes_of = np.array([f[4] for f in found])
            certain = np.array([share[self.langs.index(main)] for share in shares])
            out.append((main, float((sizes_of * certain).sum() / sizes_of.sum()), found))
        return out


def train(samples: DataFrame, documents: DataFrame | None = None) -> bytes:
    """A pickled :class:`Identifier` from ``(sample_id, lang, sample_text)``.

    Rows of ``documents`` (``id, label, text``) are added where a first model,
    trained on the samples alone, finds one segment in the language that the label
    names: so their sites' own phrases are known too.  Both tables are read up to
    their documented bounds; nulls are left out.
    """
    named = F.coalesce(label_language(F.col("lang")), F.lower(F.trim("lang")))
    chosen = samples.where("lang IS NOT NULL AND sample_text IS NOT NULL").select(named.alias("lang"), "sample_text", "sample_id")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("sample_id"), "sample_id", "sample_text"))
    rows = chosen.withColumn("nth", nth).where(F.col("nth") <= MOST_SAMPLES).orderBy("lang", "nth").collect()
    labelled = [(r["lang"], r["sample_text"]) for r in rows]
    first = Identifier(labelled)
    if documents is None or not first.langs:
        return pickle.dumps(first)
    chosen = documents.select("id", label_language(F.col("label")).alias("lang"), "text").where("lang IS NOT NULL AND text IS NOT NULL")
    drawn = chosen.orderBy(F.xxhash64("id"), "id", "text").limit(MOST_DOCUMENTS).collect()
    drawn = list(dict.fromkeys((r["lang"], r["text"]) for r in drawn))
    found = first.segments([text for _, text in drawn])
    agreed = [(lang, text) for (lang, text), f in zip(drawn, found) if f and all(s[1] == lang or s[4] < 2 * MIN_WORDS for s in f) and sum(s[4] for s in f if s[1] == lang) > 4 * MIN_WORDS and len(f) <= 3]
    return pickle.dumps(Identifier(labelled + agreed))


_KEPT: dict[int, Identifier] = {}
_SEGMENTS = "`{id}` {kind}, label string, n_words int, doc_lang string, doc_confidence double, segments array<struct<seg_no: int, lang: string, nearest: string, from_char: int, to_char: int, n_words: int, confidence: double, cross_entropy: double>>"
_TEXTS = 512


def identify(df: DataFrame, id_col: str, text_col: str, label_col: str, samples: DataFrame) -> DataFrame:
    """Each distinct row's words, language and segments: ``(id_col, label, n_words, doc_lang, doc_confidence, segments)``.

    ``lang`` of a segment is null where it is rejected; ``nearest`` is the
    language of lowest cross-entropy even then.  Characters count from 0, a
    segment ends before ``to_char``.  Null, empty and wordless texts have no
    segments.  Rows that agree in id, text and label count once; other columns
    are ignored.  Without samples nothing has a language.
    """
    model = train(samples, df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(text_col).alias("text")))
    shared = df.sparkSession.sparkContext.broadcast(model)  # its size follows the bounded samples
    kind = df.schema[id_col].dataType.simpleString()
    schema = _SEGMENTS.format(id=id_col, kind=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value)
        if key not in _KEPT:
            _KEPT.clear()
            _KEPT[key] = pickle.loads(shared.value)
        identifier = _KEPT[key]
        for batch in batches:
            texts = flat(batch, "text")
            for lo in range(0, batch.num_rows, _TEXTS):
                own = [t or "" for t in texts.slice(lo, _TEXTS).to_pylist()]
                found = identifier.documents(own) if identifier.langs else [(None, None, []) for _ in own]
                words = [len(_WORD.findall(t)) for t in own]
                rows = [[dict(zip(("seg_no", "lang", "nearest", "from_char", "to_char", "n_words", "confidence", "cross_entropy"), (i + 1, *s))) for i, s in enumerate(f)] for *_, f in found]
                mains = [pa.array([d[i] for d in found], kind) for i, kind in ((0, pa.string()), (1, pa.float64()))]
                kinds = pa.list_(pa.struct([("seg_no", pa.int32()), ("lang", pa.string()), ("nearest", pa.string()), ("from_char", pa.int32()), ("to_char", pa.int32()), ("n_words", pa.int32()), ("confidence", pa.float64()), ("cross_entropy", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(own)), batch.column(1).slice(lo, len(own)), pa.array(words, pa.int32()), *mains, pa.array(rows, kinds)], names=[id_col, "label", "n_words", "doc_lang", "doc_confidence", "segments"])

    # Repeated rows are dropped after the scan, so that texts don't go through a shuffle.
    return df.select(F.col(id_col), F.col(label_col).alias("label"), F.col(text_col).alias("text")).mapInArrow(run, schema).distinct()


#: Language of a rejected segment, by the standard's code for what can't be determined.
REJECTED = "und"


def wrong_labels(found: DataFrame, id_col: str) -> DataFrame:
    """``(id_col, seg_no, lang)`` of documents whose label names no language or another one, or that have several segments.

    A segment that no language accepts has the language ``und``, which no label names.
    """
    named = label_language(F.col("label"))
    first = F.coalesce(F.element_at("segments", 1)["lang"], F.lit(REJECTED))
    case = (F.size("segments") > 1) | named.isNull() | (named != first)
    rows = found.where((F.col("n_words") >= MIN_WORDS) & (F.size("segments") > 0)).where(case)
    return rows.select(id_col, F.explode("segments").alias("s")).select(id_col, F.col("s.seg_no").alias("seg_no"), F.coalesce("s.lang", F.lit(REJECTED)).alias("lang")).distinct()


def document_languages(found: DataFrame, id_col: str) -> DataFrame:
    """One row for each segment with its confidence; documents without words have one row without a segment.

    ``doc_lang`` is the language of most words of the document, summed over its
    segments, ``doc_confidence`` its confidence, and ``label_lang`` the one that
    the label names.
    """
    rows = found.select(id_col, label_language(F.col("label")).alias("label_lang"), "doc_lang", F.round("doc_confidence", 6).alias("doc_confidence"), F.col("n_words").alias("doc_words"), F.explode_outer("segments").alias("s"))
    return rows.select(id_col, "label_lang", "doc_lang", "doc_confidence", "doc_words", "s.seg_no", "s.lang", "s.from_char", "s.to_char", "s.n_words", F.round("s.confidence", 6).alias("confidence"))
