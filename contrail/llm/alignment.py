"""Alignment of two tokenizers over a corpus: groups of tokens that end together, and how often ids are linked.

A is a byte-level BPE, B a SentencePiece model with byte fallback; both encode the text behind one
space. Where a token of each ends at the same byte, the two are linked, and these places cut
the tokens into groups. A pair of ids counts how many links of the corpus it holds; a link is best
if no other partner of its B id counts more.

External spill counting. Tasks cut texts into stretches that neither tokenizer merges across
(before a space or line feed behind a character that is not white space, checked against B's
pieces), encode each distinct stretch once and collect records (pair, document). About a million
records make a chunk, which is spilled as zstd runs to the shared folder: one run per radix digit of
the B id, its pairs in B-major order, and the chunk's records in the same order. Runs of a digit meet in one
task, where heaps merge them sixteen at a time, so every pair is counted once, and the order gives
each B id's highest count in the same pass. The counted digit is then laid beside its runs again and streams the
counts back chunk by chunk, where they are added up per document. Only pairs move between tasks, once per chunk
and not once per document: however often a pair or an id occurs, a task reads at most one entry per chunk and pair.

A null, empty or not decodable text, and one whose tokens do not give back space + text on both sides, has no
tokens: zeros and an empty digest column. Documents keep their rows, repeated ones too, ids of any
type. Texts of any length are read in slices; nothing but the stretches' cache grows, and that is bounded.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from contrail.llm.text import blobs
from contrail.session import written

CHUNK_RECORDS = 1_000_000
FAN = 16  # runs that are merged at once
BLOCK = 8192  # pairs of a run that are unpacked at once
SLICE = 1 << 20  # characters of a text that are read at once
CACHE_STRETCHES, CACHE_BYTES, CACHE_PAIRS = 500_000, 64_000_000, 1_000_000
DOCS, RECORDS = -2, -1  # parts of a chunk beside its digits
B_SHIFT = 32

_STRETCH = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
_PLAIN = re.compile(r" \S+")
JOINED = 500  # plain stretches that are encoded by one call
_CUT = re.compile(r"\S(?=[ \n])")


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """The text in parts that end where stretches may end."""
    start = 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size - 1)
        if cut is None:
            break
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:]


def _byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers by the content of their files."""

    def __init__(self, a_json: bytes, b_model: bytes, pattern: str):
        held = json.loads(a_json)
        special = {x["content"] for x in held["added_tokens"]}
        letters = _byte_letters()
        self.a_bytes = {
            i: bytes(letters[c] for c in entry) for entry, i in held["model"]["vocab"].items() if entry not in special
        }
        ranks = {entry: i for i, entry in self.a_bytes.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in held["model"]["merges"]]
        merged = [held["model"]["vocab"]["".join(pair)] for pair in pairs]
        if merged != sorted(merged) or len(merged) + 256 != len(ranks):
            raise ValueError("the merges of A must be in the order of its ids")
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        inside = [not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)) for i in range(len(names))]
        if any(re.search(r"\n|[^\s▁][▁ ]", name) for name, plain in zip(names, inside) if plain):
            raise ValueError("pieces of B reach over a space or line feed")
        self.b_bytes = [
            bytes([int(name[1:-1], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode() if inside[i] else b""
            for i, name in enumerate(names)
        ]
        self.a_feed = ranks[b"\n"]
        self.a_size = [len(self.a_bytes.get(i, b"")) for i in range(max(self.a_bytes) + 1)]
        self.b_size = [len(entry) for entry in self.b_bytes]
        self.b_feed = self.b.piece_to_id("<0x0A>")
        self.b_start = [self.b.piece_to_id("▁"), self.b_feed]

    def _encoded(self, stretches: list[str]) -> Iterator[tuple[list[int], list[int]] | None]:
        # nothing of B merges with a line feed, so behind one there is no added space to care for
        found = self.b.encode(["\n" + s for s in stretches], num_threads=1)
        for stretch, b in zip(stretches, found):
            a, fits = self.a.encode_ordinary(stretch), b[:2] == self.b_start
            yield (a, b[2:]) if fits and self._spell(a, b[2:], stretch) else None

    def _spell(self, a: list[int], b: list[int], text: str) -> bool:
        """Whether the bytes of both sides are the text's."""
        whole = text.encode()
        return b"".join([self.a_bytes[i] for i in a]) == whole == b"".join([self.b_bytes[i] for i in b])

    def _joined(self, stretches: list[str]) -> Iterator[tuple[list[int], list[int]] | None]:
        """Stretches of one space and one word, with line feeds between them that stay tokens of their own."""
        text = "\n".join(stretches) + "\n"
        a, b = self.a.encode_ordinary(text), self.b.encode("\n" + text)[2:]
        if not self._spell(a, b, text):
            yield from self._encoded(stretches)
            return
        at_a = at_b = 0
        for _ in stretches:
            to_a, to_b = a.index(self.a_feed, at_a), b.index(self.b_feed, at_b)
            yield a[at_a:to_a], b[at_b:to_b]
            at_a, at_b = to_a + 1, to_b + 1

    def encode(self, stretches: list[str]) -> Iterator[tuple[str, tuple[list[int], list[int]] | None]]:
        """Every stretch with its ids of A and B; None where their bytes are not the stretch's. Plain ones come first."""
        plain = [s for s in stretches if _PLAIN.fullmatch(s)]
        for at in range(0, len(plain), JOINED):
            yield from zip(plain[at : at + JOINED], self._joined(plain[at : at + JOINED]))
        others = [s for s in stretches if not _PLAIN.fullmatch(s)]
        yield from zip(others, self._encoded(others))

    def groups(self, a: list[int], b: list[int]) -> tuple[bytes, list[int]]:
        """The ids between places where tokens of both sides end, as text, and the pairs that end there."""
        a_size, b_size = self.a_size, self.b_size
        texts, keys = [], []
        at_a = at_b = i = j = 0
        a_end, b_end = a_size[a[0]], b_size[b[0]]
        while True:
            if a_end == b_end:
                i, j = i + 1, j + 1
                if i - at_a == 1 and j - at_b == 1:
                    texts.append(f"{a[at_a]}|{b[at_b]}")
                else:
                    texts.append(f"{','.join(map(str, a[at_a:i]))}|{','.join(map(str, b[at_b:j]))}")
                keys.append(b[j - 1] << B_SHIFT | a[i - 1])
                if i == len(a):
                    return ";".join(texts).encode(), keys
                at_a, at_b = i, j
                a_end, b_end = a_end + a_size[a[i]], b_end + b_size[b[j]]
            elif a_end < b_end:
                i += 1
                a_end += a_size[a[i]]
            else:
                j += 1
                b_end += b_size[b[j]]


_loaded: dict[int, Tokenizers] = {}


def _tokenizers(files: Broadcast) -> Tokenizers:
    """Built once in a worker process."""
    content = files.value
    key = hash(content)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Tokenizers(*content)
    return _loaded[key]


# runs: blocks of (keys, counts) in key order, each a zstd frame


def _packed(*columns: np.ndarray) -> bytes:
    """Integer columns of one length: first as differences, bytes of equal weight together."""
    size = np.array([len(columns[0])], "<i8").tobytes()
    parts = [np.diff(columns[0], prepend=0), *columns[1:]]
    body = b"".join(np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in parts)
    return zstandard.ZstdCompressor(level=1).compress(size + body)


def _unpacked(frame: bytes, columns: int) -> list[np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(frame)
    size = int(np.frombuffer(body, "<i8", 1)[0])
    raw = np.frombuffer(body, np.uint8, offset=8).reshape(columns, 8, size)
    out = [np.ascontiguousarray(part.T).view("<i8").ravel() for part in raw]
    return [np.cumsum(out[0]), *out[1:]]


def pack_run(blocks: Iterable[tuple[np.ndarray, ...]]) -> bytes:
    out = []
    for columns in blocks:
        for at in range(0, len(columns[0]), BLOCK):
            frame = _packed(*[c[at : at + BLOCK] for c in columns])
            out += [len(frame).to_bytes(4, "little"), frame]
    return b"".join(out)


def run_blocks(run: bytes, columns: int = 2) -> Iterator[list[np.ndarray]]:
    at = 0
    while at < len(run):
        size = int.from_bytes(run[at : at + 4], "little")
        yield _unpacked(run[at + 4 : at + 4 + size], columns)
        at += 4 + size


def merge_runs(runs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Counted pairs of all runs in key order.

    A heap tells which run's open block ends first: up to that key every run is open, so what
    they hold up to there is final.
    """
    readers = [run_blocks(run) for run in runs]
    blocks: dict[int, list[np.ndarray]] = {}
    heap: list[tuple[int, int]] = []

    def open_next(which: int) -> None:
        block = next(readers[which], None)
        if block is None:
            blocks.pop(which, None)
        else:
            blocks[which] = block
            heapq.heappush(heap, (int(block[0][-1]), which))

    for which in range(len(runs)):
        open_next(which)
    while heap:
        bound = heap[0][0]
        keys, counts = [], []
        for which, (key, count) in blocks.items():
            upto = int(np.searchsorted(key, bound, "right"))
            keys.append(key[:upto])
            counts.append(count[:upto])
            blocks[which] = [key[upto:], count[upto:]]
        merged, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(merged), np.int64)
        np.add.at(total, place, np.concatenate(counts))
        yield merged, total
        while heap and heap[0][0] == bound:
            open_next(heapq.heappop(heap)[1])


def with_best(blocks: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Adds whether a pair's count is the highest of its B id; the ids come one after the other."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def told(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        side = keys >> B_SHIFT
        starts = np.flatnonzero(np.diff(side, prepend=-1))
        sizes = np.diff(np.append(starts, len(side)))
        most = np.repeat(np.maximum.reduceat(counts, starts), sizes)
        return keys, counts, (counts == most).astype(np.int64)

    for more_keys, more_counts in blocks:
        keys, counts = np.concatenate([keys, more_keys]), np.concatenate([counts, more_counts])
        # the last id may go on
        whole = int(np.searchsorted(keys >> B_SHIFT, keys[-1] >> B_SHIFT)) if len(keys) else 0
        if whole:
            yield told(keys[:whole], counts[:whole])
            keys, counts = keys[whole:], counts[whole:]
    if len(keys):
        yield told(keys, counts)


class Merger:
    """Runs as they come: sixteen of a level become one of the next, so few are held."""

    def __init__(self, fan: int = FAN):
        self.fan, self.levels = fan, [[]]

    def add(self, run: bytes) -> None:
        level = 0
        self.levels[0].append(run)
        while len(self.levels[level]) == self.fan:
            merged = pack_run(merge_runs(self.levels[level]))
            self.levels[level] = []
            level += 1
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(merged)

    def counted(self) -> bytes:
        return pack_run(with_best(merge_runs([run for level in self.levels for run in level])))


class _Grown:
    """A numpy column that grows."""

    def __init__(self):
        self.size, self.values = 0, np.zeros(1024, np.int64)

    def extend(self, values: Sequence[int]) -> None:
        while self.size + len(values) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        self.values[self.size : self.size + len(values)] = values
        self.size += len(values)


class Chunk:
    """Documents and records of a task until they are spilled."""

    def __init__(self, tools: Tokenizers, digits: int, id_type: pa.DataType):
        self.tools, self.digits, self.id_type = tools, digits, id_type
        self.pairs: dict[int, int] = {}  # numbers of pairs, as stretches and records hold them
        self._forget()
        self._begin()

    def _forget(self) -> None:
        """An empty cache of stretches."""
        self.known: dict[str, int] = {}
        self.texts: list[bytes] = []
        self.cached = 0
        self.sizes = [_Grown() for _ in range(4)]  # tokens of A, of B, groups, first pair
        self.linked = _Grown()
        self.bad: set[int] = set()

    def _begin(self) -> None:
        self.docs: list[tuple] = []
        self.seen: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.waiting = 0
        self.records: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def _learn(self, stretches: list[str]) -> None:
        rows, linked, first, groups, pairs = [], [], self.linked.size, self.tools.groups, self.pairs
        for stretch, ids in self.tools.encode(stretches):
            self.known[stretch] = len(self.texts)
            if ids is None:
                self.bad.add(len(self.texts))
                ids, text, keys = ([], []), b"", []
            else:
                text, keys = groups(*ids)
            rows.append((len(ids[0]), len(ids[1]), len(keys), first + len(linked)))
            linked += [pairs.setdefault(key, len(pairs)) for key in keys]
            self.texts.append(text)
            self.cached += len(text) + len(stretch)
        self.linked.extend(linked)
        for column, values in zip(self.sizes, zip(*rows)):
            column.extend(values)

    def add(self, doc_id, body: bytes) -> None:
        try:
            text = body.decode()
        except UnicodeDecodeError:
            text = ""
        digest, totals, mine = hashlib.sha256(), np.zeros(3, np.int64), []
        for part in slices(" " + text) if text else ():
            found = _STRETCH.findall(part)
            new = [stretch for stretch in set(found) if stretch not in self.known]
            if new:
                self._learn(new)
            numbers = list(map(self.known.__getitem__, found))
            if self.bad and not self.bad.isdisjoint(numbers):
                mine = None
                break
            digest.update((b";" if totals[0] else b"") + b";".join(map(self.texts.__getitem__, numbers)))
            kinds, times = np.unique(np.array(numbers), return_counts=True)
            totals += [int((column.values[kinds] * times).sum()) for column in self.sizes[:3]]
            mine.append((kinds, times))
            if self.cached > CACHE_BYTES or len(self.texts) > CACHE_STRETCHES:
                # numbers are about to be reused: what this document has so far becomes records
                self._drain(extra=mine)
                mine = []
                self._forget()
        if mine is None or not totals[0]:
            self._drop_current()
            self.docs.append((doc_id, 0, 0, 0, ""))
        else:
            for kinds, times in mine:
                self.seen.append((kinds, times, len(self.docs)))
                self.waiting += len(kinds)
            self.docs.append((doc_id, *totals.tolist(), digest.hexdigest()))
        if self.waiting > CHUNK_RECORDS // 2:
            self._drain()
        if self.cached > CACHE_BYTES or len(self.texts) > CACHE_STRETCHES:
            self._drain()
            self._forget()

    def _drop_current(self) -> None:
        """Forget records of the document that turned out to have no tokens."""
        here = len(self.docs)
        self.records = [tuple(c[r[1] != here] for c in r) for r in self.records]

    def _drain(self, extra: list | None = None) -> None:
        """Stretches of documents become records (pair, document, times)."""
        seen = self.seen + [(kinds, times, len(self.docs)) for kinds, times in extra or []]
        self.seen, self.waiting = [], 0
        if not seen:
            return
        kinds = np.concatenate([k for k, _, _ in seen])
        times = np.concatenate([t for _, t, _ in seen])
        docs = np.repeat([d for _, _, d in seen], [len(k) for k, _, _ in seen])
        links, first = self.sizes[2].values[kinds], self.sizes[3].values[kinds]
        ends = np.cumsum(links)
        place = np.arange(int(ends[-1])) - np.repeat(ends - links - first, links)
        self.records.append(
            _summed(self.linked.values[place], np.repeat(docs, links), np.repeat(times, links))
        )
        self.held += len(self.records[-1][0])
        if self.held > 2 * CHUNK_RECORDS:
            self._compact()

    def _compact(self) -> None:
        self.records = [_summed(*[np.concatenate(c) for c in zip(*self.records)])]
        self.held = len(self.records[0][0])

    def full(self) -> bool:
        return self.held + self.waiting >= CHUNK_RECORDS

    def spilled(self) -> Iterator[tuple[int, bytes]]:
        """(part, body): the documents, the records, and a run per digit; the chunk is empty afterwards."""
        self._drain()
        names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
        kinds = [self.id_type, pa.int64(), pa.int64(), pa.int64(), pa.string()]
        columns = zip(*self.docs) if self.docs else [()] * 5
        batch = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as stream:
            stream.write_batch(batch)
        yield DOCS, zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())
        if self.records:
            self._compact()
            pair, doc, times = self.records[0]
            keys = np.fromiter(self.pairs.keys(), np.int64, len(self.pairs))
            present = np.unique(pair)
            digit = (keys[present] >> B_SHIFT) & (self.digits - 1)
            order = present[np.lexsort((keys[present], digit))]
            rank = np.zeros(len(keys), np.int64)
            rank[order] = np.arange(len(order))
            sequence = np.lexsort((doc, rank[pair]))
            ranks, doc, times = rank[pair][sequence], doc[sequence], times[sequence]
            yield RECORDS, pack_run([(ranks, doc, times)])
            counts = np.zeros(len(order), np.int64)
            np.add.at(counts, ranks, times)
            digit = (keys[order] >> B_SHIFT) & (self.digits - 1)
            starts = np.flatnonzero(np.diff(digit, prepend=-1))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
                yield int(digit[a]), pack_run([(keys[order[a:b]], counts[a:b])])
        if len(self.pairs) > CACHE_PAIRS:
            self._forget()
            self.pairs = {}
        self._begin()


def _summed(pair: np.ndarray, doc: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One record per pair and document."""
    if not len(pair):
        return pair.astype(np.int64), doc.astype(np.int64), times.astype(np.int64)
    order = np.lexsort((doc, pair))
    pair, doc, times = pair[order], doc[order], times[order]
    starts = np.flatnonzero((np.diff(pair, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
    return pair[starts], doc[starts], np.add.reduceat(times, starts)


RUN_SCHEMA = "chunk long, part int, body binary"
_FIELDS = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("body", pa.binary())])


def _row(chunk: int, part: int, body: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((chunk, part, body), _FIELDS)], schema=_FIELDS)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in batches:
        for row in zip(*[batch.column(name).to_pylist() for name in ("chunk", "part", "body")]):
            yield row


def spill(docs: DataFrame, files: Broadcast, digits: int) -> DataFrame:
    """The chunks of all documents, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, number = None, TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column("doc_id")
            chunk = chunk or Chunk(_tokenizers(files), digits, ids.type)
            for doc_id, body in zip(ids.to_pylist(), blobs(batch.column("text"))):
                chunk.add(doc_id, body)
                if chunk.full():
                    yield from (_row(number, *part) for part in chunk.spilled())
                    number += 1
        if chunk and chunk.docs:
            yield from (_row(number, *part) for part in chunk.spilled())

    return docs.mapInArrow(run, RUN_SCHEMA)


def count_pairs(runs: DataFrame) -> DataFrame:
    """One counted run per digit, as a row of chunk -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digit, merger = None, Merger()
        for _, part, body in _rows(batches):
            if part != digit:
                if digit is not None:
                    yield _row(-1, digit, merger.counted())
                digit, merger = part, Merger()
            merger.add(body)
        if digit is not None:
            yield _row(-1, digit, merger.counted())

    ordered = runs.filter(F.col("part") >= 0).repartition("part").sortWithinPartitions("part", "chunk")
    return ordered.mapInArrow(run, RUN_SCHEMA)


def counts_for_chunks(runs: DataFrame, counted: DataFrame) -> DataFrame:
    """For each run the counts of its pairs, and which are best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = counts = best = np.zeros(0, np.int64)
        for chunk, part, body in _rows(batches):
            if chunk < 0:  # the counted run comes before the others of its digit
                keys, counts, best = (np.concatenate(c) for c in zip(*run_blocks(body, 3)))
                continue
            own = np.concatenate([block[0] for block in run_blocks(body)])
            at = np.searchsorted(keys, own)
            yield _row(chunk, part, pack_run([(counts[at], best[at])]))

    both = runs.filter(F.col("part") >= 0).unionByName(counted)
    return both.repartition("part").sortWithinPartitions("part", "chunk").mapInArrow(run, RUN_SCHEMA)


def _document_rows(parts: DataFrame, schema: str) -> DataFrame:
    """Documents with what the counts of their links add up to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = None
        ranks = doc = times = total = best = np.zeros(0, np.int64)
        done = 0

        def told() -> pa.RecordBatch:
            column = lambda name: docs.column(name).combine_chunks()
            arrays = [
                column("doc_id"), column("n_a"), column("n_b"), column("n_groups"), column("n_groups"),
                pa.array(best), pa.array(total), column("groups_sha256"),
            ]
            return pa.RecordBatch.from_arrays(arrays, NAMES)

        for _, part, body in _rows(batches):
            if part == DOCS:
                if docs is not None:
                    yield told()
                docs = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(body)).read_all()
                total, best = np.zeros(docs.num_rows, np.int64), np.zeros(docs.num_rows, np.int64)
                done = 0
            elif part == RECORDS:
                ranks, doc, times = (np.concatenate(c) for c in zip(*run_blocks(body, 3)))
            else:
                # the digits follow each other as the records do
                counts, highest = (np.concatenate(c) for c in zip(*run_blocks(body)))
                a, b = np.searchsorted(ranks, [done, done + len(counts)])
                own = ranks[a:b] - done
                np.add.at(total, doc[a:b], counts[own] * times[a:b])
                np.add.at(best, doc[a:b], highest[own] * times[a:b])
                done += len(counts)
        if docs is not None:
            yield told()

    return parts.repartition("chunk").sortWithinPartitions("chunk", "part").mapInArrow(run, schema)


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def load(spark: SparkSession, a_json: str, b_model: str, pattern: str) -> Broadcast:
    """The tokenizer files, two MB together, for all tasks."""
    with open(a_json, "rb") as a, open(b_model, "rb") as b:
        return spark.sparkContext.broadcast((a.read(), b.read(), pattern))


def radix(spark: SparkSession) -> int:
    """Digits: a power of two, at least as many as shuffles have partitions."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(4096, max(16, 1 << (partitions - 1).bit_length()))


def align(docs: DataFrame, files: Broadcast, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its tokens, groups and links, how many links are best, the sum of the links' counts and the groups' digest."""
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    runs = written(spill(given, files, radix(docs.sparkSession)), "alignment-runs")
    counted = written(count_pairs(runs), "alignment-counted")
    back = counts_for_chunks(runs, counted)
    kind = given.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{name} long" for name in NAMES[1:-1]) + ", groups_sha256 string"
    return _document_rows(runs.filter(F.col("part") < 0).unionByName(back), schema)
