"""Removal of long byte strings that also start earlier in the corpus, exactly, by suffix arrays.

A corpus-wide suffix array has one row per byte. Here only suffixes that can begin a repeat are sorted:

1. Anchors: in every stretch of 100 bytes the 36 bytes with the smallest hash are an anchor. Equal
   stretches have equal anchors at equal places, so a repeat always shares an anchor.
2. Anchors go to buckets by hash, in packets. Anchors with equal surroundings (64 bytes before, 100
   from the anchor on) are a class; all but the first of a class are covered by the first. Classes
   are combined in each task first, so that a passage on a third of all rows sends one per task.
3. Anchors that belong to several classes are the ends of repeats. Only for these the surroundings are
   fetched. Per bucket, an enhanced suffix array of them is scanned with a stack for common-prefix intervals;
   all places of an interval but the first are covered. The groups of places are not given out.
4. The covered stretches of a document are united and cut out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .interpolated_lm import pack, planes, unpack, unplanes
from .suffix_array import later_members
from .text import mix, slices

LENGTH, ANCHOR = 100, 36
SPAN = LENGTH - ANCHOR  # an anchor stands at most this far from the start of its stretch
CONTEXT = SPAN + LENGTH
PIECE = 1 << 17
GAP = 256
ANCHORS_AT_ONCE, ANCHORS_PER_BUCKET = 120_000, 200_000
ENDS_PER_BUCKET = 20_000
ROWS_SORTED = 40_000
BYTES_AT_ONCE = 2 << 20
NO_ID = -(1 << 63)

_DRAW = np.random.default_rng(20)
BYTES = _DRAW.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FACTORS = {n: np.uint64(int(_DRAW.integers(0, 1 << 62)) * 2 + 1) for n in (1, 2, 4, 8, 16, 32)}


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """The smallest or largest (``pick``) of each ``width`` values in a row."""
    size = 1
    while size * 2 <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def string_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the 32 bytes, and of the ANCHOR bytes, from each byte on (shorter arrays at the end)."""
    hashed, four, size = BYTES[data], None, 1
    while size < 32:
        hashed = hashed[:-size] * FACTORS[size] + hashed[size:]
        size *= 2
        four = hashed if size == 4 else four
    n = len(data) - ANCHOR + 1
    return hashed, mix(hashed[:n] * FACTORS[4] + four[32 : 32 + n])


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place, anchor hash, hash of the surroundings) of every anchor of the texts of LENGTH bytes or more."""
    found = []
    group: list[tuple[int, int, int, bytes]] = []
    held = 0

    def flush() -> None:
        nonlocal group, held
        if group:
            found.append(_anchors(group))
        group, held = [], 0

    for number, text in enumerate(texts):
        if len(text) < LENGTH:
            continue
        for a in range(0, len(text), PIECE):  # long texts in pieces that overlap by more than anything looks at
            low = max(0, a - GAP)
            piece = text[low : a + PIECE + GAP]
            group.append((number, low, a, piece))
            held += len(piece)
            if held >= PIECE:
                flush()
    flush()
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    number, place, h, c = (np.concatenate(x) for x in zip(*found))
    sizes = np.array([len(t) for t in texts])
    left, right = np.minimum(place, SPAN), np.minimum(sizes[number] - place, LENGTH)
    return number, place, h, mix(c + (left * 1000 + right).astype(np.uint64))


def _anchors(group: list[tuple[int, int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    blank = bytes(GAP)
    data = np.frombuffer(blank + blank.join(piece for *_, piece in group) + blank, np.uint8)
    sizes = np.array([len(piece) for *_, piece in group])
    starts = GAP + np.cumsum(sizes + GAP) - (sizes + GAP)
    h32, h = string_hashes(data)
    low = sliding(h, SPAN + 1, np.minimum)
    # stretches that reach out of their piece select nothing
    inside = np.zeros(len(low) + 1, np.int64)
    enough = sizes >= LENGTH
    np.add.at(inside, starts[enough], 1)
    np.add.at(inside, (starts + sizes - LENGTH + 1)[enough], -1)
    low[np.cumsum(inside)[:-1] == 0] = 0
    pad = np.zeros(SPAN, np.uint64)
    high = sliding(np.concatenate([pad, low, pad]), SPAN + 1, np.maximum)
    at = np.flatnonzero(h == high[: len(h)])
    piece = np.searchsorted(starts, at, "right") - 1
    offsets, firsts = np.array([g[1] for g in group]), np.array([g[2] for g in group])
    place = at - starts[piece] + offsets[piece]
    own = (place >= firsts[piece]) & (place < firsts[piece] + PIECE)
    at, piece, place = at[own], piece[own], place[own]
    c = h[at]
    for k, step in enumerate((-64, -32, 36, 68)):
        c = mix(c * np.uint64(0x9E3779B97F4A7C15) + h32[at + step] + np.uint64(k))
    # an anchor is a smallest hash: mixed again, its high bits deal out evenly
    return np.array([g[0] for g in group])[piece], place, mix(h[at]), c


def first_of_class(hashes: np.ndarray, contexts: np.ndarray, *place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by (hash, surroundings, place), and whether each row in that order is the first of its class."""
    order = np.lexsort((*place[::-1], contexts, hashes))
    h, c = hashes[order], contexts[order]
    new = np.ones(len(order), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    return order, new


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _packets(buckets: int):
    """Documents (hi, lo, text) to packets of anchors by bucket, and (bucket -1) the places that another of their task covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def write() -> Iterator[pa.RecordBatch]:
            hi, lo, place, h, c = (np.concatenate(x) for x in zip(*held))
            order, new = first_of_class(h, c, hi, lo, place)
            kept, rest = order[new], order[~new]
            bucket = ((h[kept] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = [(-1, rest)] if len(rest) else []
            rows += [(b, kept[cuts[b] : cuts[b + 1]]) for b in range(buckets) if cuts[b + 1] > cuts[b]]
            for b, own in rows:
                columns = [pack((hi[own].view(np.uint64)) ^ np.uint64(1 << 63)) if (hi[own] < 0).any() else b"\0" + pack(hi[own].astype(np.uint64)), pack(lo[own].astype(np.uint64)), pack(place[own].astype(np.uint64))]
                columns += [planes(h[own], 8) if b >= 0 else b"", planes(c[own] >> np.uint64(8), 7) if b >= 0 else b""]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), *[pa.array([x], pa.binary()) for x in columns]], names=["bucket", "hi", "lo", "place", "hashes", "contexts"])

        for batch in slices(batches, BYTES_AT_ONCE):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
            number, place, h, c = anchors(texts)
            if len(number):
                held.append((batch.column(0).to_numpy()[number], batch.column(1).to_numpy()[number], place, h, c))
                n += len(number)
            if n >= ANCHORS_AT_ONCE:
                yield from write()
                held, n = [], 0
        if held:
            yield from write()

    return run


def _unpack_id(data: bytes) -> np.ndarray:
    if data[0]:
        return (unpack(data) ^ np.uint64(1 << 63)).view(np.int64)
    return unpack(data[1:]).astype(np.int64)


MARKS = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("place", pa.int64()), ("ends", pa.bool_())])


def _mark_bucket(packets: pa.Table) -> pa.Table:
    """The places of a bucket that are covered by the first of their class, and (ends) the first places of anchors with several classes."""
    rows = packets.to_pylist()
    hi, lo = np.concatenate([_unpack_id(r["hi"]) for r in rows]), np.concatenate([unpack(r["lo"]) for r in rows]).astype(np.int64)
    place = np.concatenate([unpack(r["place"]) for r in rows]).astype(np.int64)
    h, c = np.concatenate([unplanes(r["hashes"], 8) for r in rows]), np.concatenate([unplanes(r["contexts"], 7) for r in rows])
    order, new = first_of_class(h, c, hi, lo, place)
    h = h[order]
    firsts = np.flatnonzero(new)
    same = np.zeros(len(firsts), bool)
    if len(firsts) > 1:
        equal = h[firsts[1:]] == h[firsts[:-1]]
        same[1:] |= equal
        same[:-1] |= equal
    ends = np.zeros(len(order), bool)
    ends[firsts[same]] = True
    out = np.flatnonzero(~new | ends)
    at = order[out]
    return pa.table([pa.array(hi[at]), pa.array(lo[at]), pa.array(place[at]), pa.array(ends[out])], schema=MARKS)


def _local_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            hi, lo, place = _unpack_id(r["hi"]), unpack(r["lo"]).astype(np.int64), unpack(r["place"]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), pa.array(place), pa.array(np.zeros(len(hi), bool))], schema=MARKS)


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, hi, lo, place, size, context) for the places of each document that are ends."""
    open_ = zstandard.ZstdDecompressor()
    for batch in slices(batches, BYTES_AT_ONCE):
        out: list[tuple] = []
        for r in batch.to_pylist():
            text = open_.decompress(r["packed"])
            for place in r["ends"]:
                left = text[max(0, place - SPAN) : place]
                out.append((r["hi"], r["lo"], place, len(text), left.rjust(SPAN, b"\0") + text[place : place + LENGTH].ljust(LENGTH, b"\0")))
        if out:
            flat = np.frombuffer(b"".join(x[4] for x in out), np.uint8).reshape(-1, CONTEXT)
            weights = mix(np.arange(1, ANCHOR + 1, dtype=np.uint64))
            key = mix((flat[:, SPAN : SPAN + ANCHOR].astype(np.uint64) * weights).sum(1, dtype=np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(_signed(key)), *[pa.array([x[k] for x in out], pa.int64()) for k in range(4)], pa.array([x[4] for x in out], pa.binary())],
                names=["anchor", "hi", "lo", "place", "size", "context"],
            )


COVERS = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])


def _nearest(key: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each row the longest common prefix with any other row of the same key."""
    order = np.lexsort((np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), key))
    out = np.zeros(len(rows), np.int64)
    for a in range(1, len(rows), 1 << 16):
        b = min(len(rows), a + (1 << 16))
        x, y = order[a - 1 : b - 1], order[a:b]
        same = rows[x] == rows[y]
        common = np.where(same.all(1), rows.shape[1], same.argmin(1)) * (key[x] == key[y])
        np.maximum.at(out, x, common)
        np.maximum.at(out, y, common)
    return out


def cover(key: np.ndarray, hi: np.ndarray, lo: np.ndarray, place: np.ndarray, size: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, end) of the stretches of surroundings that repeat an earlier place of the same anchor, by maximal repeats."""
    right, left = _nearest(key, context[:, SPAN:]), _nearest(key, context[:, SPAN - 1 :: -1])
    # a repeat that starts d bytes before the anchor needs d equal bytes before it and LENGTH - d from it on
    nearest, furthest = np.maximum(0, LENGTH - right), np.minimum(np.minimum(left, place), SPAN)
    nearest = np.maximum(nearest, LENGTH - (size - place))
    several = np.maximum(0, furthest - nearest + 1)
    rows = np.flatnonzero(several)
    by_key = rows[np.lexsort((place[rows], lo[rows], hi[rows], key[rows]))]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    padded = np.concatenate([context.ravel(), np.zeros(CONTEXT, np.uint8)])
    views = np.lib.stride_tricks.sliding_window_view(padded, CONTEXT)
    totals = np.cumsum(several[by_key])
    group_ends = np.flatnonzero(np.concatenate([key[by_key][1:] != key[by_key][:-1], [True]])) + 1 if len(by_key) else np.zeros(0, np.int64)
    at = 0
    while at < len(by_key):
        done = totals[at - 1] if at else 0
        stop = group_ends[max(np.searchsorted(totals[group_ends - 1], done + ROWS_SORTED, "right") - 1, np.searchsorted(group_ends, at, "right"))]
        own = by_key[at:stop]
        at = stop
        row = np.repeat(own, several[own])
        distance = nearest[row] + np.arange(len(row)) - np.repeat(np.cumsum(several[own]) - several[own], several[own])
        # equal stretches have their anchor at the same distance: a very large group is sorted by distance
        parts = [np.flatnonzero(distance == d) for d in np.unique(distance)] if len(row) > 3 * ROWS_SORTED else [slice(None)]
        for part in parts:
            r, d = row[part], distance[part]
            strings = views[r * CONTEXT + SPAN - d].copy()
            lengths = np.minimum(LENGTH + d, size[r] - place[r] + d)
            strings[np.arange(CONTEXT)[None, :] >= lengths[:, None]] = 0
            before = np.where((d < SPAN) & (d < place[r]), context[r, np.maximum(SPAN - 1 - d, 0)].astype(np.int64), -1)
            begin = place[r] - d
            # places in the corpus as numbers in order; one place can be reached from several anchors
            by_place = np.lexsort((begin, lo[r], hi[r]))
            step = np.ones(len(r), np.int64)
            a, b = by_place[:-1], by_place[1:]
            step[1:] = (hi[r[a]] != hi[r[b]]) | (lo[r[a]] != lo[r[b]]) | (begin[a] != begin[b])
            rank = np.empty(len(r), np.int64)
            rank[by_place] = np.cumsum(step)
            members, length = later_members(strings, lengths, before, rank, LENGTH)
            out.append((r[members], begin[members], begin[members] + length))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, first, last = (np.concatenate(x) for x in zip(*out))
    # unite what overlaps within the surroundings of one anchor
    order = np.lexsort((first, rows))
    rows, first, last = rows[order], first[order], last[order]
    far = np.int64(1) << 40
    reach = np.maximum.accumulate(rows * far + last)
    new = np.ones(len(rows), bool)
    new[1:] = rows[1:] * far + first[1:] > reach[:-1]
    starts = np.flatnonzero(new)
    ends = np.concatenate([starts[1:], [len(rows)]]) - 1
    return rows[starts], first[starts], reach[ends] - rows[ends] * far


def _cover_bucket(table: pa.Table) -> pa.Table:
    key, hi, lo, place, size = (table[c].to_numpy() for c in ("anchor", "hi", "lo", "place", "size"))
    context = np.frombuffer(b"".join(table["context"].to_pylist()), np.uint8).reshape(-1, CONTEXT)
    row, first, last = cover(key, hi, lo, place, size, context)
    return pa.table([pa.array(hi[row]), pa.array(lo[row]), pa.array(first), pa.array(last)], schema=COVERS)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hi, lo, n_bytes, n_removed, n_spans, kept) of documents with the starts and ends of covered stretches."""
    open_ = zstandard.ZstdDecompressor()
    for batch in slices(batches, BYTES_AT_ONCE):
        out = []
        for hi, lo, packed, firsts, lasts in zip(*(batch.column(k).to_pylist() for k in range(5))):
            text = open_.decompress(packed)
            gone = spans = 0
            if firsts:
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, np.maximum(np.array(firsts), 0), 1)
                np.add.at(edge, np.minimum(np.array(lasts), len(text)), -1)
                removed = np.cumsum(edge)[:-1] > 0
                gone, spans = int(removed.sum()), int((removed & ~np.concatenate([[False], removed[:-1]])).sum())
                kept = np.frombuffer(text, np.uint8)[~removed].tobytes()
            else:
                kept = text
            out.append((hi, lo, len(text), gone, spans, kept))
        types = [pa.int64()] * 5 + [pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=["hi", "lo", "n_bytes", "n_removed", "n_spans", "kept"])


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    close = zstandard.ZstdCompressor(level=1)
    for batch in slices(batches, BYTES_AT_ONCE):
        packed = [close.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["hi", "lo", "packed"])


def _numbered(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(hi, lo, text): the id as a number, and a number for rows that share it (by their texts' hashes)."""
    rows = docs.select(F.coalesce(F.col(id_column).cast("bigint"), F.lit(NO_ID)).alias("hi"), F.col(text_column).cast("string").alias("text"))
    shared = materialize(rows.groupBy("hi").agg(F.count("*").alias("n")).where("n > 1").select("hi"))
    single = rows.select("hi", F.lit(0).cast("bigint").alias("lo"), "text")
    if shared.isEmpty():
        return single
    again = rows.join(shared, "hi", "left_semi")
    order = Window.partitionBy("hi").orderBy(F.xxhash64("text"), "text")
    numbered = again.select("hi", (F.row_number().over(order) - 1).cast("bigint").alias("lo"), "text")
    return single.join(shared, "hi", "left_anti").unionByName(materialize(numbered))


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id_column, n_bytes, n_removed, n_spans, kept), a row per document.

    Texts are UTF-8 bytes; a null text is empty. Every byte covered by a string of LENGTH bytes that also
    starts earlier (in a smaller id, or earlier in the same document; overlaps count) is removed; strings are
    judged on the input. ``kept`` (binary) holds the other bytes. Shorter texts stay whole. A null id
    comes before all others. Rows that share an id are documents in the order of their texts' hashes.
    Other columns are ignored. An empty table gives an empty result.
    """
    texts = _numbered(docs, id_column, text_column)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, math.ceil(total / 30 / ANCHORS_PER_BUCKET))
    packets = materialize(texts.mapInArrow(_packets(buckets), "bucket bigint, hi binary, lo binary, place binary, hashes binary, contexts binary"))
    names = "hi bigint, lo bigint, place bigint, ends boolean"
    found = packets.where("bucket >= 0").groupBy("bucket").applyInArrow(_mark_bucket, names)
    marks = materialize(found.unionByName(packets.where("bucket < 0").mapInArrow(_local_marks, names)))
    packed = texts.mapInArrow(_pack_texts, "hi bigint, lo bigint, packed binary")
    ends = marks.where("ends").groupBy("hi", "lo").agg(F.collect_list("place").alias("ends"))
    contexts = packed.join(ends, ["hi", "lo"]).mapInArrow(_surroundings, "anchor bigint, hi bigint, lo bigint, place bigint, size bigint, context binary")
    n = max(8, math.ceil(marks.where("ends").count() / ENDS_PER_BUCKET))
    covers = contexts.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(n)).alias("part")).applyInArrow(_cover_bucket, "hi bigint, lo bigint, first bigint, last bigint")
    whole = marks.where("not ends").select("hi", "lo", (F.col("place") - SPAN).alias("first"), (F.col("place") + LENGTH).alias("last"))
    stretches = covers.unionByName(whole).groupBy("hi", "lo").agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))
    out = packed.join(stretches, ["hi", "lo"], "left").select("hi", "lo", "packed", "firsts", "lasts")
    out = out.mapInArrow(_cut, "hi bigint, lo bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return out.select(F.nullif("hi", F.lit(NO_ID)).alias(id_column), "n_bytes", "n_removed", "n_spans", "kept")
