"""Byte-level BPE as a lazily determinised finite-state transducer.

The merges of a public vocabulary are compiled into a trie of token bytes and a
relation of token pairs that may stand side by side.  Read as a transducer it is
nondeterministic: at every byte a token may end and another begin.  For each
prefix of the input exactly one path is the merges' own result, so the set of
live paths is small.  States of the determinised machine are such sets with the
tokens not yet emitted; what all live paths share is emitted at once, so the
lookahead is bounded by the longest token.  States and transitions are made
when first needed and kept.
"""

from __future__ import annotations

import base64
import gc
import re
import sys
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.operators.ranges import flat

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_MOST_STATES = 150_000
_MOST_WORDS = 250_000
_UNMADE = 32
_DOCUMENTS = 256


def read_vocabulary(path: str = DEFAULT_VOCABULARY) -> bytes:
    """The vocabulary file's bytes; its size is fixed, so they can go to every executor."""
    with open(path, "rb") as f:
        return f.read()


def _ranges(kinds: str) -> str:
    """A character class's inner part for the general categories that begin with one of ``kinds``."""
    out, begin = [], None
    for point in range(sys.maxunicode + 2):
        inside = point <= sys.maxunicode and unicodedata.category(chr(point))[0] in kinds
        if inside and begin is None:
            begin = point
        elif not inside and begin is not None:
            out.append(f"\\U{begin:08x}-\\U{point - 1:08x}")
            begin = None
    return "".join(out)


@cache
def _pieces() -> re.Pattern:
    """The published pre-tokenizer pattern of the vocabulary, with its classes spelled out."""
    letter, number = _ranges("L"), _ranges("N")
    # Unicode's White_Space and the pattern's alternatives.
    space = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    # Letters come first, for speed: no other alternative can begin as they do.
    return re.compile(rf" ?[{letter}]+| ?[{number}]+|'(?:[stmd]|re|ve|ll)| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


class _State:
    __slots__ = ("paths", "to")

    def __init__(self, paths: tuple) -> None:
        self.paths, self.to = paths, {}


class Transducer:
    """Encoder of one vocabulary; a process keeps one and its states."""

    def __init__(self, vocabulary: bytes) -> None:
        pairs = (line.split() for line in vocabulary.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.child: dict[int, int] = {}  # node << 8 | byte -> node
        self.ends: dict[int, int] = {}  # node -> token
        nodes = 1
        for token, rank in self.ranks.items():
            node = 0
            for byte in token:
                edge = node << 8 | byte
                if edge not in self.child:
                    self.child[edge] = nodes
                    nodes += 1
                node = self.child[edge]
            self.ends[node] = rank
        self.beside: dict[tuple[int, int], bool] = {}
        self.spines: dict[int, list[tuple[bytes, int]] | None] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.forget()

    def forget(self) -> None:
        """Drop all states made so far; they come back when needed."""
        self.start = _State(((0, (), -1),))
        self.states = {self.start.paths: self.start}

    def merged(self, raw: bytes, below: int = sys.maxsize) -> list[bytes]:
        """Parts of a few bytes after merging the lowest-ranked pair again and again, with ranks under ``below``."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b, below) for a, b in zip(parts, parts[1:])]
            low = min(ranks)
            if low >= below:
                break
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def spine(self, token: int, side: int) -> list[tuple[bytes, int]] | None:
        """What stands at one end of a token while it is built, from a byte on, each with the rank that ends it.

        ``side`` is 0 for the left end, -1 for the right one; None for a token
        that the merges never build.
        """
        key = token * 2 - side
        if key not in self.spines:
            raw, rank, out = self.tokens[token], sys.maxsize, []
            while out is not None:
                out.append((raw, rank))
                if len(raw) == 1:
                    break
                rank = self.ranks[raw]
                parts = self.merged(raw, rank)
                if len(parts) != 2:
                    out = None
                else:
                    raw = parts[side]
            self.spines[key] = out and out[::-1]
        return self.spines[key]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the merges leave ``left`` and ``right`` side by side as they are.

        They do unless, while both are built, a pair across the border is merged
        before one of its parts is used up on its own side.  Of equal ranks the
        merge further left comes first.
        """
        beginning = self.spine(right, 0)
        if left < 0 or beginning is None:
            return beginning is not None
        known = self.beside.get((left, right))
        if known is None:
            if len(self.beside) > 2 * _MOST_STATES:
                self.beside.clear()
            ending, get = self.spine(left, -1), self.ranks.get
            i = j = 0
            known = ending is not None
            while known:
                (x, x_ends), (y, y_ends) = ending[i], beginning[j]
                rank = get(x + y)
                if rank is not None and rank < x_ends and rank <= y_ends:
                    known = False
                elif x_ends <= y_ends and i + 1 < len(ending):
                    i += 1
                elif j + 1 < len(beginning):
                    j += 1
                else:
                    break
            self.beside[left, right] = known
        return known

    def advance(self, paths: tuple | list, byte: int) -> tuple[list, tuple[int, ...]]:
        """Live paths after one more byte, and the tokens that this byte settles."""
        after, ended, child, ends = [], None, self.child, self.ends
        for node, waiting, last in paths:
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            after.append((node, waiting, last))
            if ended is None and (token := ends.get(node)) is not None and self.may_follow(last, token):
                ended = (0, (*waiting, token), token)
        if ended is None:
            raise ValueError("the vocabulary can't spell this byte")
        after.append(ended)
        shared = after[0][1]
        if shared:
            for _, waiting, _ in after:
                while shared and waiting[: len(shared)] != shared:
                    shared = shared[:-1]
            if shared:
                after = [(node, waiting[len(shared) :], last) for node, waiting, last in after]
        return after, shared

    def state(self, paths: tuple | list) -> _State:
        """The state of a set of live paths."""
        key = tuple(paths)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = _State(key)
        return found

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Tokens of one piece of text, byte by byte.

        Where a transition is missing it is made, and the machine runs on without
        making states for a while: only what comes again is worth one.
        """
        raw, state, out, i = piece.encode(), self.start, [], 0
        while i < len(raw):
            move = state.to.get(raw[i])
            i += 1
            if move is not None:
                state, settled = move
                out += settled
                continue
            paths, settled = self.advance(state.paths, raw[i - 1])
            made = self.state(paths)
            state.to[raw[i - 1]] = made, settled
            out += settled
            stop = min(len(raw), i + _UNMADE)
            while i < stop:
                paths, settled = self.advance(paths, raw[i])
                out += settled
                i += 1
            if i == len(raw):
                return (*out, *paths[-1][1])
            state = self.state(paths)
        return (*out, *state.paths[-1][1])

    def encode(self, text: str) -> list[tuple[int, ...]]:
        """Tokens of each piece of a text, in order."""
        pieces, words = _pieces().findall(text), self.words
        if len(self.states) > _MOST_STATES:
            self.forget()
            gc.collect()
        if len(words) > _MOST_WORDS:
            words.clear()
        new = set(pieces).difference(words)
        for piece in new:
            words[piece] = self.encode_piece(piece)
        out = list(map(words.__getitem__, pieces))
        for piece in new:
            if len(piece) > 60:
                del words[piece]
        return out


class Utf8Stream:
    """Incremental decoder: bytes of a character may be spread over tokens.

    A state is the bytes still waiting for the rest of their character; a token
    read in a state gives the next state and text.  Bytes that can't go on become
    U+FFFD, as the standard's maximal-subpart practice has it.
    """

    def __init__(self, tokens: dict[int, bytes]) -> None:
        self.tokens, self.moves = tokens, {}

    @staticmethod
    def _wait(raw: bytes) -> int:
        """How many bytes at the end are the valid beginning of a longer character."""
        for back in range(1, min(3, len(raw)) + 1):
            lead = raw[-back]
            if lead >= 0xC2:
                width = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4 if lead < 0xF5 else 0
                if back >= width:
                    return 0
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
                return back if back == 1 or low <= raw[1 - back or len(raw)] <= high else 0
            if lead < 0x80 or lead >= 0xC0:
                return 0
        return 0

    def decode(self, ids: list[int]) -> str:
        """Text of a list of ids."""
        out, waiting = [], b""
        for token in ids:
            move = self.moves.get((waiting, token))
            if move is None:
                raw = waiting + self.tokens[token]
                cut = len(raw) - self._wait(raw)
                if len(self.moves) > 4 * _MOST_STATES:
                    self.moves.clear()
                move = self.moves[waiting, token] = (raw[cut:], raw[:cut].decode(errors="replace"))
            waiting, text = move
            out.append(text)
        if waiting:
            out.append(waiting.decode(errors="replace"))
        return "".join(out)


_KEPT: dict[int, Transducer] = {}


def transducer(vocabulary: bytes) -> Transducer:
    """This process's transducer of a vocabulary."""
    key = hash(vocabulary)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Transducer(vocabulary)
    return _KEPT[key]


@contextmanager
def _uncollected() -> Iterator[None]:
    """Without the collector's passes over the many states, none of which is garbage before ``forget``."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str | None]]]:
    column = batch.column(batch.num_columns - 1)
    for lo in range(0, batch.num_rows, _DOCUMENTS):
        yield lo, column.slice(lo, _DOCUMENTS).to_pylist()


def encode_texts(df: DataFrame, id_col: str, text_col: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(id_col, ids)``: the ids of each row's whole text, without special tokens.

    An empty and a null text have the ids ``[]``.  Strings that look like special
    tokens are ordinary text.  Repeated rows stay; other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(shared.value)
        for batch in batches:
            for lo, texts in _texts(batch):
                flat_ids, sizes = [], [0]
                with _uncollected():
                    for text in texts:
                        if text:
                            flat_ids.extend(chain.from_iterable(machine.encode(text)))
                        sizes.append(len(flat_ids))
                ids = pa.ListArray.from_arrays(pa.array(np.array(sizes, np.int32)), pa.array(np.array(flat_ids, np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), ids], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, text_col: str, out_col: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The other columns and ``out_col``, the number of tokens of the text; 0 for empty and null."""
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    others = [c for c in df.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(shared.value)
        for batch in batches:
            n = []
            for _, texts in _texts(batch):
                with _uncollected():
                    n += [sum(map(len, machine.encode(text))) if text else 0 for text in texts]
            kept = [batch.column(i) for i in range(len(others))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64())], names=[*others, out_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text_col)
    return df.select(*(F.col(c) for c in others), F.col(text_col)).mapInArrow(run, f"{schema}, `{out_col}` long")


def decode_ids(df: DataFrame, id_col: str, ids_col: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(id_col, text)``: the text of each list of ids; null for null, empty for ``[]``."""
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Utf8Stream(transducer(shared.value).tokens)
        for batch in batches:
            ids = flat(batch, "ids")
            for lo in range(0, batch.num_rows, _DOCUMENTS):
                lists = ids.slice(lo, _DOCUMENTS).to_pylist()
                texts = [None if x is None else stream.decode(x) for x in lists]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(ids_col).alias("ids")).mapInArrow(run, f"`{id_col}` {kind}, text string")
