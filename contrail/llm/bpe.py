"""Byte-level BPE: whole texts to token ids with byte offsets, and back.

Pre-tokens are cut without a regular expression. Every code point gets a class from
an array; a small automaton says where pre-tokens start. Its transitions are
functions from state to state, and composing functions is associative: the input is
cut into equal strips, the strips are composed side by side, their functions are
scanned by doubling, and a second pass from the now known entry states marks the
starts. Each distinct slice is merged once and kept in a bounded cache.

Null texts count as empty and give no tokens. Texts of any length are encoded whole.
Repeated rows are encoded alike; other columns are passed on by the caller.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from array import array
from functools import cache, cached_property
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from contrail.llm.text import blobs, free_name, slabs

SLAB_BYTES = 1_000_000
CACHED_PIECES = 200_000
LOCKSTEP_LENGTH = 32
LOCKSTEP_ROWS = 20_000
NO_PAIR = 1 << 40

# White space, and letters and numbers newer than the tables of
# Python's unicodedata, as the tokenizer's pattern knows them.
WHITE = [(0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
         (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
NEW_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
               (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
               (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
               (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
               (0x1E5F0, 0x1E5F0)]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
               (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]

# symbols: what the automaton reads, a code point's class and what follows it
LETTER, NUMBER, OTHER, WHITE_INNER, BLANK_LAST, WHITE_LAST, SHORT_1, SHORT_2, BREAK = range(9)
# states: what the current pre-token is
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, BLANK, ONE_LEFT, TWO_LEFT = range(8)
STATES = 8


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a pre-token starts here", both indexed by symbol * STATES + state."""
    goes_on = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, WHITE_INNER: IN_WHITE}
    step = np.zeros((9, STATES), np.uint8)
    starts = np.zeros((9, STATES), bool)
    for state in range(STATES):
        for symbol in range(9):
            if symbol == BREAK:
                move = CLOSED, False
            elif state == TWO_LEFT:
                move = ONE_LEFT, False
            elif state == ONE_LEFT:
                move = CLOSED, False
            elif symbol in (SHORT_1, SHORT_2):
                # an apostrophe opens 's, 'll and the like only where a pre-token starts
                inside = state in (IN_OTHERS, BLANK)
                move = (IN_OTHERS, False) if inside else (ONE_LEFT if symbol == SHORT_1 else TWO_LEFT, True)
            elif symbol == BLANK_LAST:
                move = BLANK, True
            elif symbol == WHITE_LAST:
                move = CLOSED, True
            else:
                joined = state == goes_on[symbol] or (state == BLANK and symbol != WHITE_INNER)
                move = goes_on[symbol], not joined
            step[symbol, state], starts[symbol, state] = move
    return step.ravel(), starts.ravel()


NEXT, STARTS = _automaton()


@cache
def codepoint_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or WHITE_INNER for every code point."""
    classes = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            classes[code] = LETTER
        elif kind == "N":
            classes[code] = NUMBER
    for ranges, value in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER), (WHITE, WHITE_INNER)):
        for first, last in ranges:
            classes[first : last + 1] = value
    return classes


def _symbols(codes: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Classes with the look-ahead folded in; ``breaks`` are the separators between texts."""
    symbols = codepoint_classes()[codes]
    symbols[breaks] = BREAK
    follows = np.append(symbols[1:], BREAK)
    last = (symbols == WHITE_INNER) & (follows != WHITE_INNER) & (follows != BREAK)
    symbols[last] = np.where(codes[last] == 0x20, BLANK_LAST, WHITE_LAST)
    quotes = np.flatnonzero((codes == 0x27) & (symbols != BREAK))
    if len(quotes):
        # a separator is never a letter: its symbol is BREAK, not LETTER
        padded = np.append(np.where(symbols == BREAK, 0, codes), [0, 0])
        one, two = padded[quotes + 1], padded[quotes + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        longer = np.zeros(len(quotes), bool)
        for pair in ("re", "ve", "ll"):
            longer |= (one == ord(pair[0])) & (two == ord(pair[1]))
        symbols[quotes[short]] = SHORT_1
        symbols[quotes[longer & ~short]] = SHORT_2
    return symbols


def piece_starts(symbols: np.ndarray) -> np.ndarray:
    """Positions where pre-tokens start, by a scan over transition functions."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    length = max(64, int(n**0.5))
    strips = -(-n // length)
    padded = np.full(strips * length, BREAK, np.uint8)
    padded[:n] = symbols
    columns = np.ascontiguousarray(padded.reshape(strips, length).T).astype(np.int16) * STATES
    # each strip as one function of the state it is entered in
    function = np.tile(np.arange(STATES, dtype=np.uint8), (strips, 1))
    for column in columns:
        function = NEXT[column[:, None] + function]
    # inclusive scan of the functions by doubling: later after earlier
    reach = 1
    while reach < strips:
        function[reach:] = np.take_along_axis(function[reach:], function[:-reach].astype(np.intp), 1)
        reach *= 2
    state = np.zeros(strips, np.uint8)
    state[1:] = function[:-1, CLOSED]
    marks = np.empty((length, strips), bool)
    for at, column in enumerate(columns):
        index = column + state
        marks[at] = STARTS[index]
        state = NEXT[index]
    return np.flatnonzero(marks.T.ravel()[:n])


def cut(texts: list[bytes]) -> list[list[bytes]]:
    """The pre-tokens of each text, as slices of its bytes."""
    joined = b"\0".join(texts)
    raw = np.frombuffer(joined, np.uint8)
    codes = np.frombuffer(joined.decode("utf-8").encode("utf-32-le"), "<u4")
    at_byte = np.flatnonzero((raw & 0xC0) != 0x80)
    ends = np.cumsum([len(text) + 1 for text in texts]) - 1
    breaks = np.searchsorted(at_byte, ends[:-1])
    starts = at_byte[piece_starts(_symbols(codes, breaks))]
    firsts = np.searchsorted(starts, np.append(0, ends[:-1] + 1)).tolist() + [len(starts)]
    cuts, pieces = starts.tolist(), []
    for number, end in enumerate(ends.tolist()):
        own = cuts[firsts[number] : firsts[number + 1]]
        pieces.append([joined[a:b] for a, b in zip(own, [*own[1:], end])])
    return pieces


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: the lowest-ranked pair first, the leftmost of equals.

    A heap of pairs over a linked list, so a very long pre-token costs n log n.
    """
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    ends = list(range(1, n + 1))  # end of the part that starts here; 0 once it is merged away
    before = list(range(-1, n - 1))
    heap = []
    for at in range(n - 1):
        rank = ranks.get(piece[at : at + 2])
        if rank is not None:
            heap.append((rank, at, at + 2))
    heapq.heapify(heap)
    while heap:
        _, at, end = heapq.heappop(heap)
        middle = ends[at]
        if not middle or middle >= n or ends[middle] != end:
            continue
        ends[at], ends[middle] = end, 0
        if end < n:
            before[end] = at
            rank = ranks.get(piece[at : ends[end]])
            if rank is not None:
                heapq.heappush(heap, (rank, at, ends[end]))
        left = before[at]
        if left >= 0:
            rank = ranks.get(piece[left:end])
            if rank is not None:
                heapq.heappush(heap, (rank, left, end))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : ends[at]]])
        at = ends[at]
    return ids


class Pieces:
    """Pre-token to its ids as little-endian 32-bit integers, kept up to a bound."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.known: dict[bytes, bytes] = {}
        # pairs of ids that merge, sorted by one key; the id of what they merge to is its rank
        keys, merged = array("q"), array("q")
        for token, rank in ranks.items():
            for at in range(1, len(token)):
                left, right = ranks.get(token[:at]), ranks.get(token[at:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(rank)
        order = np.argsort(keys)
        self.keys, self.merged = np.array(keys)[order], np.array(merged)[order]
        self.bytes = np.array([ranks[bytes([value])] for value in range(256)], np.int64) if ranks else None

    def admit(self, pieces: set[bytes]) -> None:
        """Merge the pieces that are not known yet, those of one length side by side."""
        if len(self.known) >= CACHED_PIECES:
            self.known.clear()
        by_length: dict[int, list[bytes]] = {}
        for piece in pieces.difference(self.known):
            by_length.setdefault(len(piece), []).append(piece)
        for length, group in by_length.items():
            if length > LOCKSTEP_LENGTH or len(group) < 4:
                for piece in group:
                    ids = merge(piece, self.ranks)
                    self.known[piece] = pack(f"<{len(ids)}I", *ids)
            else:
                for start in range(0, len(group), LOCKSTEP_ROWS):
                    self._merge_alike(group[start : start + LOCKSTEP_ROWS], length)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        if not len(self.keys):
            return np.full(key.shape, NO_PAIR)
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, self.merged[place], NO_PAIR)

    def _merge_alike(self, group: list[bytes], length: int) -> None:
        """Pair merging of many pieces of one length, a merge of every piece at a time."""
        raw = np.frombuffer(b"".join(group), np.uint8).reshape(-1, length)
        ids = self.bytes[raw]
        rows = np.arange(len(group))
        for row, piece in enumerate(group):
            whole = self.ranks.get(piece)
            if whole is not None:
                self.known[piece] = pack("<I", whole)
                rows[row] = -1
        rows = rows[rows >= 0]
        ids = ids[rows]
        rank = self._rank(ids[:, :-1], ids[:, 1:])
        while len(rows):
            width = ids.shape[1]
            at = rank.argmin(1) if width > 1 else np.zeros(len(rows), np.int64)
            best = rank[np.arange(len(rows)), at] if width > 1 else np.full(len(rows), NO_PAIR)
            done = best == NO_PAIR
            if done.any():
                packed = ids[done].astype("<u4").tobytes()
                for number, row in enumerate(rows[done].tolist()):
                    self.known[group[row]] = packed[number * width * 4 : (number + 1) * width * 4]
                live = ~done
                rows, ids, rank, at, best = rows[live], ids[live], rank[live], at[live], best[live]
                if not len(rows):
                    break
            every = np.arange(len(rows))
            ids[every, at] = best
            columns = np.arange(width - 1)
            ids = np.take_along_axis(ids, columns + (columns > at[:, None]), 1)
            columns = columns[:-1]
            rank = np.take_along_axis(rank, columns + (columns >= at[:, None]), 1)
            for side, there in ((at - 1, at > 0), (at, at < width - 2)):
                who, where = every[there], side[there]
                rank[who, where] = self._rank(ids[who, where], ids[who, where + 1])


class Vocabulary:
    """Ranks of a ``.tiktoken`` file, with the token bytes laid end to end for decoding."""

    def __init__(self, content: bytes):
        pairs = (line.split() for line in content.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        size = max(self.ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(token) for token in tokens], np.int64)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.content = np.frombuffer(b"".join(tokens), np.uint8)

    @cached_property
    def pieces(self) -> Pieces:
        """Only encoding needs the pair table."""
        return Pieces(self.ranks)

    def encode(self, texts: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        """Packed ids and packed byte offsets of each text."""
        ids, offsets = [], []
        for start, stop in slabs(texts, SLAB_BYTES):
            cuts = cut(texts[start:stop])
            self.pieces.admit({piece for pieces in cuts for piece in pieces})
            look_up = self.pieces.known.__getitem__
            for pieces in cuts:
                packed = b"".join(map(look_up, pieces))
                lengths = self.lengths[np.frombuffer(packed, "<u4")]
                ids.append(packed)
                offsets.append((np.cumsum(lengths) - lengths).astype("<u4").tobytes())
        return ids, offsets

    def decode(self, packed: bytes, offsets: bytes) -> bytes:
        """The bytes of packed ids, each token written at its offset."""
        ids, at = np.frombuffer(packed, "<u4"), np.frombuffer(offsets, "<u4").astype(np.int64)
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        total = int(at[-1] + lengths[-1])
        source = np.repeat(self.places[ids] - at, lengths) + np.arange(total)
        return self.content[source].tobytes()


_loaded: dict[bytes, Vocabulary] = {}


def vocabulary(content: bytes) -> Vocabulary:
    """One vocabulary per Python worker."""
    key = hashlib.sha256(content).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(content)
    return _loaded[key]


def load(spark: SparkSession, path: str) -> Broadcast:
    """The rank file as a broadcast; its size does not depend on the data."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(text: str | Column, ranks: Broadcast, decoded: bool = False) -> Column:
    """A text column as packed token ids and the byte offset of each token (32 bits, little endian).

    With ``decoded`` the same task also turns ids and offsets back into bytes.
    """
    names = ["token_ids", "token_offsets", *(["decoded"] if decoded else [])]

    @F.arrow_udf("struct<" + ", ".join(f"{name}: binary" for name in names) + ">")
    def run(column: pa.Array) -> pa.Array:
        vocab = vocabulary(ranks.value)
        parts = list(vocab.encode(blobs(column)))
        if decoded:
            parts.append([vocab.decode(a, b) for a, b in zip(*parts)])
        return pa.StructArray.from_arrays([pa.array(part, pa.binary()) for part in parts], names)

    return run.asNondeterministic()(text)


def decode(token_ids: str | Column, token_offsets: str | Column, ranks: Broadcast) -> Column:
    """Packed token ids and offsets back to the text's bytes."""

    @F.arrow_udf("binary")
    def run(ids: pa.Array, offsets: pa.Array) -> pa.Array:
        vocab = vocabulary(ranks.value)
        return pa.array([vocab.decode(a, b) for a, b in zip(blobs(ids), blobs(offsets))], pa.binary())

    return run.asNondeterministic()(token_ids, token_offsets)


def encode_documents(docs: DataFrame, ranks: Broadcast, text: str = "text", decoded: bool = True) -> DataFrame:
    """The documents with ``token_ids``, ``token_offsets`` and, on request, ``decoded`` bytes.

    Columns of these names in the input are replaced.
    """
    names = {"token_ids", "token_offsets", "decoded"}
    quoted = lambda name: F.col("`" + name.replace("`", "``") + "`")
    kept = [quoted(name) for name in docs.columns if name.lower() not in names]
    own = free_name(docs, "_coded")
    coded = docs.select(*kept, encode(F.col(text), ranks, decoded).alias(own))
    return coded.select(*[quoted(c) for c in coded.columns if c != own], f"{own}.*")
