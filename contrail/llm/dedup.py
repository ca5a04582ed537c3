"""Removal of repeated byte strings from a corpus, by suffix arrays over small pieces.

A byte goes when it lies in a string of ``length`` bytes (a window) that also starts
earlier: in a smaller document, or at an earlier place of its own. One suffix array over
everything would pass through one machine, so the windows are dealt first. Each window
chooses an anchor, the leftmost of its grams with the least hash. That depends on the
window's bytes alone, so equal windows choose equal anchors and meet under one key.
Windows in a row mostly share their anchor; the bytes they cover are its context.

* Contexts that are equal as a whole are told by their hashes: all but the first are
  repeats. This is done in each task before anything is shuffled, and once more for all.
* Keys whose contexts differ need the suffix array. The bytes of the contexts are cut
  from the texts, trimmed to what agrees with some other context around the anchor, and
  sorted by suffix (:mod:`contrail.llm.suffixes`). Neighbours that share their first
  ``length`` bytes are one window; all but its first place are repeats.
* A key may have contexts without number, such as at the end of a passage that every
  document goes on from differently. Keys above ``KEY_CONTEXTS`` contexts, and keys
  that a sample shows to be common, are dealt anew by single windows, which spreads
  them and lets equal ones combine early. Nothing is dropped or capped.

Repeats told by hashes rest on 128 bits: contexts meet by a polynomial hash of the anchor, and are held
equal by XXH3 of all their bytes. Among n different contexts of one anchor two agree on the latter
with a chance of about n * n / 2**65: one in a million for six million contexts of one anchor.
Ids are whole numbers, or strings of them; others are an error of the cast.

Null texts count as empty. A document without an id stands behind all others. Rows with
the same id are one document for the order; equal rows share their result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from contrail.llm.suffixes import suffix_array
from contrail.llm.text import blobs
from contrail.session import written

LENGTH = 100
GRAM = 40
KEY_CONTEXTS = 4096
SAMPLE = 16  # one document in so many shows which keys are common
COMMON = 2000  # contexts of a key in the sample
CHUNK = 1 << 22  # windows that are looked at together
SORT_BYTES = 1 << 15
PART_BYTES = 1 << 24  # text for each partition of the windows; a bucket is a quarter of one
LAST_ID = (1 << 63) - 1

RECORD = np.dtype([("key", "<u8"), ("ctx", "<u8"), ("doc", "<u4"), ("start", "<u4"), ("wins", "<u2"), ("at", "<u2")])
NEED = np.dtype([("key", "<u8"), ("start", "<u4"), ("wins", "<u2"), ("at", "<u2"), ("single", "<u2")])
PIECE = np.dtype([("key", "<u8"), ("id", "<i8"), ("th", "<i8"), ("start", "<u4"), ("size", "<u4"), ("at", "<u2"), ("single", "<u2")])
SPAN = np.dtype([("start", "<u4"), ("end", "<u4")])

# Fixed values of the rolling hash: an odd base with its inverse modulo 2**64, a seed for the byte table.
BASE = 0x9E3779B97F4A7C15
BYTES = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, factor in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            run = np.full(size, np.uint64(factor))
            run[0] = 1
            _powers[name] = np.cumprod(run)
    return _powers["up"][:n], _powers["down"][:n]


def gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the gram at every place."""
    n = len(text)
    up, down = _power(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTES[text] * up, out=sums[1:])
    found = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    found ^= found >> np.uint64(31)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    return found ^ found >> np.uint64(29)


def anchors(text: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: its hash, the first window, how many, the anchor behind the first window."""
    hashes = gram_hashes(text, gram)
    reach, n = length - gram + 1, len(hashes)
    # least (hash, place) of every window by running minima from both ends of blocks
    keys = hashes & ~np.uint64((1 << 24) - 1) | np.arange(n, dtype=np.uint64)
    blocks = np.full(-(-n // reach) * reach, np.uint64((1 << 64) - 1))
    blocks[:n] = keys
    blocks = blocks.reshape(-1, reach)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    windows = n - reach + 1
    least = np.minimum(behind[:windows], ahead[reach - 1 : reach - 1 + windows])
    chosen = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    firsts = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    wins = np.diff(np.concatenate([firsts, [windows]]))
    return hashes[chosen[firsts]], firsts, wins, chosen[firsts] - firsts


def _contexts(text: bytes, length: int, gram: int) -> np.ndarray:
    """The records of one text; long texts go chunk by chunk."""
    parts = []
    for low in range(0, max(0, len(text) - length + 1), CHUNK):
        piece = text[low : low + CHUNK + length - 1]
        keys, firsts, wins, at = anchors(np.frombuffer(piece, np.uint8), length, gram)
        ends = (firsts + wins + length - 1).tolist()
        digest = xxhash.xxh3_64_intdigest
        out = np.zeros(len(keys), RECORD)
        out["key"], out["start"], out["wins"], out["at"] = keys, firsts + low, wins, at
        out["ctx"] = [digest(piece[a:b]) for a, b in zip(firsts.tolist(), ends)]
        parts.append(out)
    return np.concatenate(parts) if parts else np.zeros(0, RECORD)


def _single_windows(records: np.ndarray, text: bytes, length: int) -> np.ndarray:
    """Every window of some contexts as a context of its own, keyed by its bytes."""
    out = np.repeat(records, records["wins"])
    firsts = np.cumsum(records["wins"]) - records["wins"]
    out["start"] += (np.arange(len(out)) - np.repeat(firsts, records["wins"])).astype("<u4")
    out["key"] = [xxhash.xxh3_64_intdigest(text[a : a + length], 1) for a in out["start"].tolist()]
    out["ctx"] = [xxhash.xxh3_64_intdigest(text[a : a + length], 2) for a in out["start"].tolist()]
    out["wins"], out["at"] = 1, 0
    return out


def _repeats(keys: list[np.ndarray], order: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort by keys, then by ``order``: the permutation, class starts, and which rows come strictly after the first."""
    by = np.lexsort([*reversed(order), *reversed(keys)])
    new = np.ones(len(by), bool)
    if len(by):
        new[1:] = False
        for key in keys:
            new[1:] |= key[by[1:]] != key[by[:-1]]
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(by) else by
    later = np.zeros(len(by), bool)
    for part in order:
        later |= part[by] != part[by[head]]
    return by, new, later


def _by_document(ids: np.ndarray, ths: np.ndarray, payload: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Payload rows put together by document."""
    order = np.lexsort((ths, ids))
    ids, ths, payload = ids[order], ths[order], payload[order]
    cuts = np.flatnonzero((np.diff(ids) != 0) | (np.diff(ths) != 0)) + 1
    bounds = [0, *cuts.tolist(), len(ids)]
    for a, b in zip(bounds, bounds[1:]):
        if b > a:
            yield int(ids[a]), int(ths[a]), payload[a:b].tobytes()


def _spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), SPAN)
    out["start"], out["end"] = starts, ends
    return out


def merged(spans: np.ndarray) -> np.ndarray:
    """Overlapping and touching spans as one, sorted."""
    spans = spans[np.lexsort((spans["end"], spans["start"]))]
    if not len(spans):
        return spans
    reach = np.maximum.accumulate(spans["end"])
    new = np.concatenate([[True], spans["start"][1:] > reach[:-1]])
    lasts = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(spans) - 1]])
    return _spans(spans["start"][new], reach[lasts])


DEALT = "bucket long, ids binary, ths binary, records binary, spans binary, span_docs binary"


def _deal(docs: DataFrame, length: int, gram: int, buckets: int, common: Broadcast) -> DataFrame:
    """Contexts of all documents, repeats inside a batch already told, as packed rows by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.frombuffer(common.value, "<u8")
        for batch in batches:
            texts = blobs(batch.column("text"))
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            ths = batch.column("th").to_numpy(zero_copy_only=False)
            parts = []
            for number, text in enumerate(texts):
                records = _contexts(text, length, gram)
                if len(hot) and len(records):
                    is_hot = np.isin(records["key"], hot)
                    if is_hot.any():
                        single = _single_windows(records[is_hot], text, length)
                        records = np.concatenate([records[~is_hot], single])
                records["doc"] = number
                parts.append(records)
            records = np.concatenate(parts) if parts else np.zeros(0, RECORD)
            if not len(records):
                continue
            order = [ids[records["doc"]], records["start"]]
            by, new, later = _repeats([records["key"], records["ctx"]], order)
            records = records[by]
            gone, records = records[later], records[~later]
            bucket = ((records["key"] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            records, bucket = records[by], bucket[by]
            names, starts = np.unique(bucket, return_index=True)
            rows = []
            for name, a, b in zip(names.tolist(), starts.tolist(), [*starts[1:].tolist(), len(records)]):
                own = records[a:b].copy()
                docs_of, own["doc"] = np.unique(own["doc"], return_inverse=True)
                rows.append((name, ids[docs_of].tobytes(), ths[docs_of].tobytes(), own.tobytes(), None, None))
            if len(gone):
                spans = _spans(gone["start"], gone["start"] + gone["wins"] + length - 1)
                found = []
                for number in np.unique(gone["doc"]).tolist():
                    found.append((number, merged(spans[gone["doc"] == number])))
                owners = np.concatenate([np.full(len(s), number, "<u4") for number, s in found])
                docs_of, owners = np.unique(owners, return_inverse=True)
                content = np.concatenate([s for _, s in found]).tobytes()
                rows.append(
                    (int(ths[0]) % buckets, ids[docs_of].tobytes(), ths[docs_of].tobytes(), None, content, owners.astype("<u4").tobytes())
                )
            yield _batch(rows, DEALT)

    return docs.mapInArrow(run, DEALT)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
    fields = [field.split() for field in schema.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(column), kinds[kind]) for column, (_, kind) in zip(columns, fields)], [name for name, _ in fields]
    )


FOUND = "id long, th long, spans binary, needs binary"


def _classes(dealt: DataFrame, length: int, most: int) -> DataFrame:
    """By bucket: spans of contexts seen before, and the contexts whose bytes are needed."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts, ids, ths, out = [], [], [], []
        for row in rows.itertuples(index=False):
            own_ids, own_ths = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.ths, "<i8")
            if row.records is not None:
                records = np.frombuffer(row.records, RECORD)
                parts.append(records)
                ids.append(own_ids[records["doc"]])
                ths.append(own_ths[records["doc"]])
            else:
                owners = np.frombuffer(row.span_docs, "<u4")
                spans = np.frombuffer(row.spans, SPAN)
                for one, th, content in _by_document(own_ids[owners], own_ths[owners], spans):
                    out.append((one, th, content, None))
        if parts:
            records, ids, ths = np.concatenate(parts), np.concatenate(ids), np.concatenate(ths)
            by, new, later = _repeats([records["key"], records["ctx"]], [ids, records["start"]])
            records, ids, ths = records[by], ids[by], ths[by]
            gone = records[later]
            spans = _spans(gone["start"], gone["start"] + gone["wins"] + length - 1)
            for one, th, content in _by_document(ids[later], ths[later], spans):
                out.append((one, th, merged(np.frombuffer(content, SPAN)).tobytes(), None))
            # keys with more than one context: their first places go on to the suffix array
            fresh = np.concatenate([[True], records["key"][1:] != records["key"][:-1]])
            key_of = np.cumsum(fresh) - 1
            contexts = np.bincount(key_of[new])[key_of]
            wanted = ~later & (contexts > 1)
            needs = np.zeros(int(wanted.sum()), NEED)
            for name in ("key", "start", "wins", "at"):
                needs[name] = records[name][wanted]
            needs["single"] = contexts[wanted] > most
            for one, th, content in _by_document(ids[wanted], ths[wanted], needs):
                out.append((one, th, None, content))
        return pd.DataFrame(out, columns=["id", "th", "spans", "needs"])

    return dealt.groupBy("bucket").applyInPandas(run, FOUND)


CUT = "bucket long, heads binary, bodies binary"


def _cut(needed: DataFrame, length: int, buckets: int) -> DataFrame:
    """The bytes of needed contexts, as packed rows by bucket of their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads: dict[int, list[bytes]] = {}
            bodies: dict[int, list[bytes]] = {}
            columns = [batch.column(name) for name in ("id", "th", "needs")]
            for one, th, lists, text in zip(*(c.to_pylist() for c in columns), blobs(batch.column("text"))):
                needs = np.frombuffer(b"".join(lists), NEED)
                single = needs[needs["single"] > 0]
                if len(single):
                    records = np.zeros(len(single), RECORD)
                    records["start"], records["wins"] = single["start"], single["wins"]
                    windows = _single_windows(records, text, length)
                    spread = np.zeros(len(windows), NEED)
                    spread["key"], spread["start"], spread["wins"], spread["single"] = windows["key"], windows["start"], 1, 1
                    needs = np.concatenate([needs[needs["single"] == 0], spread])
                pieces = np.zeros(len(needs), PIECE)
                pieces["id"], pieces["th"] = one, th
                for name in ("key", "start", "at", "single"):
                    pieces[name] = needs[name]
                pieces["size"] = needs["wins"].astype("<u4") + length - 1
                places = ((needs["key"] >> np.uint64(20)) % np.uint64(buckets)).tolist()
                starts, sizes = pieces["start"].tolist(), pieces["size"].tolist()
                for number, bucket in enumerate(places):
                    heads.setdefault(bucket, []).append(pieces[number : number + 1].tobytes())
                    bodies.setdefault(bucket, []).append(text[starts[number] : starts[number] + sizes[number]])
            yield _batch([(b, b"".join(heads[b]), b"".join(bodies[b])) for b in heads], CUT)

    return needed.select("id", "th", "needs", "text").mapInArrow(run, CUT)


def _agreement(parts: list[bytes]) -> list[int]:
    """For each string, how many first bytes it shares with some other one of the list."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    shared = [0] * (len(parts) + 1)
    for number, (a, b) in enumerate(zip(order, order[1:]), 1):
        left, right = parts[a], parts[b]
        most = min(len(left), len(right))
        if left[:most] == right[:most]:
            shared[number] = most
        else:
            low, high = 0, most  # left[:low] agrees, left[:high] does not
            while high - low > 1:
                middle = (low + high) // 2
                if left[:middle] == right[:middle]:
                    low = middle
                else:
                    high = middle
            shared[number] = low
    out = [0] * len(parts)
    for number, at in enumerate(order):
        out[at] = max(shared[number], shared[number + 1] if number + 1 < len(parts) else 0)
    return out


def trimmed(bodies: list[bytes], ats: list[int], length: int) -> list[tuple[int, int, int]]:
    """(which, from, to) of the contexts that can share a window, cut to what agrees around the anchor."""
    right = _agreement([body[at:] for body, at in zip(bodies, ats)])
    left = _agreement([body[:at][::-1] for body, at in zip(bodies, ats)])
    return [
        (number, at - before, at + behind)
        for number, (at, before, behind) in enumerate(zip(ats, left, right))
        if before + behind >= length
    ]


def repeated_windows(bodies: list[bytes], places: list[tuple], length: int) -> list[tuple[int, int]]:
    """(which, offset) of windows that stand at an earlier place too; ``places`` order the bodies' starts.

    A place is (id, start) of a body's first byte.
    """
    joined = b"".join(bodies)
    owner, offset, first = [-1] * len(joined), [0] * len(joined), 0
    for number, body in enumerate(bodies):
        for at in range(len(body) - length + 1):
            owner[first + at], offset[first + at] = number, at
        first += len(body)
    gone: list[tuple[int, int]] = []
    run: list[int] = []

    def close() -> None:
        if len(run) > 1:
            stand = [(places[owner[s]][0], places[owner[s]][1] + offset[s]) for s in run]
            least = min(stand)
            gone.extend((owner[s], offset[s]) for s, place in zip(run, stand) if place > least)

    for suffix in suffix_array(joined):
        if owner[suffix] < 0:
            continue
        if run and joined[suffix : suffix + length] != joined[run[-1] : run[-1] + length]:
            close()
            run = []
        run.append(suffix)
    close()
    return gone


SORTED = "id long, th long, spans binary"


def _sorted(cut: DataFrame, length: int) -> DataFrame:
    """By bucket: spans of the windows that the suffix arrays show to be repeats."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame([], columns=["id", "th", "spans"])
        heads = np.concatenate([np.frombuffer(head, PIECE) for head in rows["heads"]])
        bodies = b"".join(rows["bodies"])
        ends = np.cumsum(heads["size"].astype(np.int64))
        starts = ends - heads["size"]
        found: list[tuple[int, int, int]] = []  # record, offset, how many windows
        # single windows: equal ones are told by their bytes
        seen: dict[bytes, tuple] = {}
        singles = np.flatnonzero(heads["single"])
        order = singles[np.lexsort((heads["start"][singles], heads["id"][singles]))]
        for number in order.tolist():
            body = bodies[starts[number] : ends[number]]
            place = int(heads["id"][number]), int(heads["start"][number])
            if seen.setdefault(body, place) < place:
                found.append((number, 0, 1))
        whole = np.flatnonzero(heads["single"] == 0)
        whole = whole[np.argsort(heads["key"][whole], kind="stable")]
        cuts = np.flatnonzero(np.diff(heads["key"][whole])) + 1
        held: list[tuple[int, int, bytes]] = []
        size = 0

        def sort_held() -> None:
            places = [(int(heads["id"][n]), int(heads["start"][n]) + a) for n, a, _ in held]
            for which, offset in repeated_windows([body for _, _, body in held], places, length):
                found.append((held[which][0], held[which][1] + offset, 1))

        for group in np.split(whole, cuts):
            numbers = group.tolist()
            own = [bodies[starts[n] : ends[n]] for n in numbers]
            for which, a, b in trimmed(own, heads["at"][group].tolist(), length):
                held.append((numbers[which], a, own[which][a:b]))
                size += b - a
            if size >= SORT_BYTES:  # keys never meet, so any of them may be sorted together
                sort_held()
                held, size = [], 0
        sort_held()
        out = []
        if found:
            which, offset, wins = np.array(found, np.int64).T
            first = heads["start"][which] + offset
            spans = _spans(first, first + wins + length - 1)
            for one, th, content in _by_document(heads["id"][which], heads["th"][which], spans):
                out.append((one, th, merged(np.frombuffer(content, SPAN)).tobytes()))
        return pd.DataFrame(out, columns=["id", "th", "spans"])

    return cut.groupBy("bucket").applyInPandas(run, SORTED)


def common_keys(docs: DataFrame, length: int, gram: int, sample: int, common: int) -> Broadcast:
    """Keys that the sample shows in ``common`` documents or more, a bounded number.

    They only choose how windows are dealt, never what is found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = blobs(batch.column("text"))
            keys = [np.unique(_contexts(text, length, gram)["key"]) for text in texts]
            keys, counts = np.unique(np.concatenate(keys) if keys else np.zeros(0, "<u8"), return_counts=True)
            several = counts > 1  # a common key comes more than once in most batches
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[several].view(np.int64)), pa.array(counts[several])], ["key", "n"]
            )

    drawn = docs.filter(F.pmod(F.xxhash64("id", "th"), F.lit(sample)) == 0).select("text")
    counted = drawn.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    rows = counted.filter(F.col("n") >= common).orderBy(F.desc("n")).limit(1_000_000).select("key").collect()
    keys = np.sort(np.array([row["key"] for row in rows], np.int64).view("<u8"))
    return docs.sparkSession.sparkContext.broadcast(keys.tobytes())


def _kept(text: Column, lists: Column) -> Column:
    """Bytes that remain, with the removed runs."""
    longs = pa.list_(pa.int64())

    @F.arrow_udf("struct<kept: binary, starts: array<long>, ends: array<long>>")
    def run(texts: pa.Array, lists: pa.Array) -> pa.Array:
        kept, starts, ends = [], [], []
        for text, content in zip(blobs(texts), lists.to_pylist()):
            spans = merged(np.frombuffer(b"".join(content or []), SPAN))
            firsts, lasts = spans["start"].tolist(), spans["end"].tolist()
            kept.append(b"".join(text[a:b] for a, b in zip([0, *lasts], [*firsts, len(text)])))
            starts.append(firsts)
            ends.append(lasts)
        return pa.StructArray.from_arrays(
            [pa.array(kept, pa.binary()), pa.array(starts, longs), pa.array(ends, longs)], ["kept", "starts", "ends"]
        )

    return run.asNondeterministic()(text, lists)


def remove_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    key_contexts: int = KEY_CONTEXTS,
    sample: int = SAMPLE,
    common: int = COMMON,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """One row per document: id, n_bytes, what is ``kept`` of its bytes, and the removed runs (starts, ends)."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    # buckets are held whole, so their number grows with the data
    size = docs.agg(F.sum(F.octet_length(body).cast("long"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    buckets = 4 * parts
    keyed = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(body).alias("th"), body.alias("text")
    )
    hot = common_keys(keyed, length, gram, sample, common)
    dealt = _deal(keyed, length, gram, buckets, hot).repartition(parts, "bucket")
    found = written(_classes(dealt, length, key_contexts), "repeats")
    # one exchange of the texts serves both joins
    placed = keyed.repartition(parts, "id", "th")
    needs = found.filter("needs is not null").groupBy("id", "th").agg(F.collect_list("needs").alias("needs"))
    needed = placed.join(needs.hint("shuffle_hash"), ["id", "th"])
    cut = _cut(needed, length, buckets).repartition(parts, "bucket")
    spans = found.filter("spans is not null").select("id", "th", "spans").unionByName(_sorted(cut, length))
    spans = spans.groupBy("id", "th").agg(F.collect_list("spans").alias("spans"))
    joined = placed.join(spans.hint("shuffle_hash"), ["id", "th"], "left")
    result = joined.select("id", F.octet_length("text").cast("long").alias("n_bytes"), _kept(F.col("text"), F.col("spans")).alias("k"))
    return result.select(
        F.when(F.col("id") != LAST_ID, F.col("id")).alias("doc_id"), "n_bytes", "k.kept", "k.starts", "k.ends"
    )
