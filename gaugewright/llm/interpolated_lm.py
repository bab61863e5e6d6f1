"""Language-model scores by deleted interpolation of n-gram estimates.

p_k(w | h) = lambda * c(h, w) / c(h) + (1 - lambda) * p_{k-1}(w | shorter h), down to a uniform
distribution over the known tokens and one unknown. The weight depends on the order and on the
bucket (power of two) of c(h); expectation-maximisation finds it on held-out counts: the training
documents of a small fold, predicted from counts of the others. Scores use the counts of all
training documents.

N-grams are hashed to 64 bits. Documents are read once into blocks of a bounded number of tokens.
Each block asks for the counts of its distinct n-grams, in packets by hash bucket; a bucket adds
up all blocks' own counts and answers each packet in its order. Packets, not rows, are shuffled, and no
count table is ever in one place.

An n-gram that stands in one block only needs no asking: that block's count is the count. So blocks first
send the leading bits of their n-grams of two tokens and more, as sorted numbers of some 14 bits each, and
learn which of them another block may have too. Leading bits that are equal by chance cost a request, never a
count. Shuffle files and tables of a step go when the next step's input is written.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .text import mix, slices

ORDER = 3
BLOCK_TOKENS = 500_000
BUCKET_GRAMS = 1_200_000
#: The leading bits tell this many times as many n-grams apart, as a power of two, as the tokens can make.
SPARE_BITS = 4
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
HEADER = struct.Struct("<QIQB")
#: One training document in this many is held out for the weights.
HELD_OUT = 40
ROUNDS = 30
#: The weight of an order's estimate where there is nothing held out to learn it from.
PRIOR = 0.5
BUCKETS = 40
CELL = 0.02
END, BEGIN = np.uint64(0x1D8AF066E1B2C3D5), np.uint64(0x53C5CA59F0A1B7E3)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _places(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


PLACES = _places(4096)


def token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens of the texts, an end after each, and the number of tokens of each text (its end counted)."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    flat = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    space = IS_SPACE[flat]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
    lengths = ends - starts
    letters = LOWER[flat[~space]].astype(np.uint64) + np.uint64(1)
    if len(starts):
        first = np.cumsum(lengths) - lengths
        place = np.arange(len(letters)) - np.repeat(first, lengths)
        places = PLACES if lengths.max() <= len(PLACES) else _places(int(lengths.max()))
        words = mix(np.add.reduceat(letters * places[place], first) + lengths.astype(np.uint64))
    else:
        words = np.zeros(0, np.uint64)
    borders = np.cumsum([len(r) + 1 for r in raw])
    counts = np.searchsorted(starts, borders) - np.concatenate([[0], np.searchsorted(starts, borders)[:-1]])
    out = np.full(len(words) + len(texts), END, np.uint64)
    is_end = np.zeros(len(out), bool)
    is_end[np.cumsum(counts + 1) - 1] = True
    out[~is_end] = words
    return out, counts + 1


def gram_hashes(tokens: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """Per order n the hash of the n-gram that ends at each token. One begin stands before a text; an n-gram that would reach further is 0."""
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(tokens)) - np.repeat(first, sizes)
    out = [tokens]
    for n in range(2, order + 1):
        before = np.empty_like(tokens)
        before[1:] = out[-1][:-1]
        before[place == 0] = BEGIN if n == 2 else 0
        gram = mix(before * np.uint64(0x9E3779B97F4A7C15) + tokens + np.uint64(n))
        gram[before == 0] = 0
        out.append(gram)
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct numbers in order. Sorted: ``np.unique`` would hash them, which takes some twenty times as long for hashes."""
    ordered = np.sort(values)
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)]]


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes in order, and the place of each value among them.

    Sorts the leading bits with the index in the place of the others, as plain numbers sort several times faster than their
    indexes. Different hashes with the same leading bits may then stand out of order; if any do, the indexes are sorted.
    """
    low = np.uint64(len(values).bit_length())
    keys = (values >> low << low) | np.arange(len(values), dtype=np.uint64)
    keys.sort()
    order = (keys & np.uint64((1 << int(low)) - 1)).astype(np.int64)
    ordered = values[order]
    if (ordered[1:] < ordered[:-1]).any():
        order = np.argsort(values)
        ordered = values[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)]
    places = np.empty(len(values), np.int64)
    places[order] = np.cumsum(new) - 1
    return ordered[new], places


@dataclass
class Request:
    """The distinct n-grams of a block in order of (bucket, hash), and for each token's n-gram its place among them."""

    hashes: np.ndarray
    cuts: np.ndarray
    places: list[np.ndarray]
    counts: np.ndarray


def request(tokens: np.ndarray, sizes: np.ndarray, order: int, buckets: int, learns: np.ndarray) -> Request:
    """``learns``: whether each token's text is one to learn from; counts are over those."""
    grams = gram_hashes(tokens, sizes, order)
    flat = np.concatenate(grams)
    hashes, inverse = numbered(flat)
    counts = np.bincount(inverse, np.tile(learns, order), len(hashes)).astype(np.int64)
    # the bucket is the hash's high part, so that order by hash is order by bucket
    cuts = np.searchsorted(bucket_of(hashes, buckets), np.arange(buckets + 1))
    return Request(hashes, cuts, np.split(inverse, order), counts)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def planes(values: np.ndarray, width: int) -> bytes:
    """Numbers as byte planes, which compress well."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(data: bytes, width: int) -> np.ndarray:
    parts = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((parts.shape[1], 8), np.uint8)
    out[:, :width] = parts.T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _width(values: np.ndarray) -> int:
    return max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)


def pack(values: np.ndarray) -> bytes:
    width = _width(values)
    return bytes([width]) + planes(values, width)


def unpack(data: bytes) -> np.ndarray:
    return unplanes(data[1:], data[0])


def pack_sorted(values: np.ndarray) -> bytes:
    """Numbers in order: the low bits of each, and the high ones as steps in a row of bits (Elias-Fano)."""
    rest, n = values - values[0], len(values)
    width = max(0, (int(rest[-1]) // n).bit_length() - 1)
    high = (rest >> np.uint64(width)).astype(np.int64)
    steps = np.zeros(int(high[-1]) + n, np.uint8)
    steps[high + np.arange(n)] = 1
    low = np.unpackbits(rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : (width + 7) // 8], axis=1, bitorder="little")[:, :width]
    return HEADER.pack(int(values[0]), n, int(high[-1]), width) + np.packbits(steps).tobytes() + np.packbits(low).tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    first, n, last, width = HEADER.unpack_from(data)
    cut = HEADER.size + (last + n + 7) // 8
    high = np.flatnonzero(np.unpackbits(np.frombuffer(data[HEADER.size : cut], np.uint8), count=last + n)) - np.arange(n)
    low = np.zeros((n, 8), np.uint8)
    low[:, : (width + 7) // 8] = np.packbits(np.unpackbits(np.frombuffer(data[cut:], np.uint8), count=n * width).reshape(n, width), axis=1, bitorder="little")
    return np.uint64(first) + (high.astype(np.uint64) << np.uint64(width)) + low.reshape(-1).view("<u8").astype(np.uint64)


@dataclass
class Weights:
    """lambda by order (2 and up: by bucket of the context's count; 1: one for all), with N and V."""

    tokens: int
    distinct: int
    by_order: list[np.ndarray]


def bucket_of_count(counts: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else the number of bits of its count."""
    return np.minimum(np.frexp(counts.astype(np.float64))[1] * (counts > 0), BUCKETS - 1)


def _blocks(docs: DataFrame, key: str) -> DataFrame:
    """(block, held, ids, learns, sizes, vocabulary, stream): the documents as blocks of token numbers, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[bool, list] = {False: [], True: []}
        tokens_of = {False: 0, True: 0}

        def write(held: bool) -> pa.RecordBatch:
            ids, learns, tokens, sizes = (list(x) for x in zip(*waiting[held]))
            waiting[held], tokens_of[held] = [], 0
            tokens, sizes = np.concatenate(tokens), np.array(sizes)
            words, numbers, counts = np.unique(tokens, return_inverse=True, return_counts=True)
            rank = np.empty(len(words), np.int64)
            by_count = np.argsort(-counts, kind="stable")
            rank[by_count] = np.arange(len(words))
            name = f"{ids[0]}:{len(ids)}:{int(mix(tokens).sum() if len(tokens) else 0)}:{held}"
            columns = [pa.array([name]), pa.array([held]), pa.array([ids], pa.list_(id_type)), pa.array([np.array(learns, np.uint8).tobytes()], pa.binary()), pa.array([pack(sizes)], pa.binary())]
            columns += [pa.array([planes(words[by_count], 8)], pa.binary()), pa.array([pack(rank[numbers])], pa.binary()), pa.array([len(tokens)], pa.int64())]
            columns += [pa.array([int(sizes[np.array(learns, bool)].sum())], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["block", "held", "ids", "learns", "sizes", "vocabulary", "stream", "tokens", "learned"])

        id_type = None
        for batch in slices(batches, 2 << 20):
            id_type = batch.schema.field(0).type
            tokens, sizes = token_hashes([t or "" for t in batch.column(1).to_pylist()])
            at = 0
            for one, size, learns, held in zip(batch.column(0).to_pylist(), sizes.tolist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                held = bool(held and learns)
                waiting[held].append((one, bool(learns), tokens[at : at + size], size))
                tokens_of[held] += size
                at += size
                if tokens_of[held] >= BLOCK_TOKENS:
                    yield write(held)
        for held in (False, True):
            if waiting[held]:
                yield write(held)

    return docs.mapInArrow(
        run, f"block string, held boolean, ids array<{key}>, learns binary, sizes binary, vocabulary binary, stream binary, tokens bigint, learned bigint"
    )


def _load(learns: bytes, sizes: bytes, vocabulary: bytes, stream: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own, words = unpack(sizes).astype(np.int64), unplanes(vocabulary, 8)
    return words[unpack(stream).astype(np.int64)], own, np.frombuffer(learns, np.uint8).astype(bool)


def _stored(df: DataFrame) -> DataFrame:
    """``materialize``, after which the shuffle files behind it go at once: nothing reads them again."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return materialize(df)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def _drop(table: DataFrame) -> None:
    """Deletes the files of a table that ``materialize`` wrote."""
    spark = table.sparkSession
    for file in table.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


SHARED = "array<struct<bucket:bigint,n:bigint,flags:binary>>"


def _shared(blocks: DataFrame, order: int, buckets: int, shift: int) -> DataFrame:
    """(block, shared): for the distinct n-grams of a block of two tokens and more, in order, whether another block may have them."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens, sizes, _ = _load(row["learns"], row["sizes"], row["vocabulary"], row["stream"])
                hashes = distinct(np.concatenate(gram_hashes(tokens, sizes, order)[1:]))
                cuts = np.searchsorted(bucket_of(hashes, buckets), np.arange(buckets + 1))
                leading = hashes >> np.uint64(shift)
                found = [(b, leading[cuts[b] : cuts[b + 1]]) for b in range(buckets) if cuts[b + 1] > cuts[b]]
                for part in range(0, len(found), 64):
                    own = found[part : part + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in own], pa.int64()), pa.array([row["block"]] * len(own)), pa.array([pack_sorted(x) for _, x in own], pa.binary())], names=["bucket", "block", "leading"])

    def answer(packets: pd.DataFrame) -> pd.DataFrame:
        leading = [unpack_sorted(x) for x in packets["leading"]]
        known = np.sort(np.concatenate(leading))
        several = np.append(distinct(known[1:][known[1:] == known[:-1]]), np.uint64(0xFFFFFFFFFFFFFFFF))
        flags = [np.packbits(several[np.searchsorted(several[:-1], x)] == x).tobytes() for x in leading]
        return pd.DataFrame({"block": packets["block"], "bucket": packets["bucket"], "n": [len(x) for x in leading], "flags": flags})

    asked = blocks.select("block", "learns", "sizes", "vocabulary", "stream").mapInArrow(ask, "bucket bigint, block string, leading binary")
    return asked.groupBy("bucket").applyInPandas(answer, "block string, bucket bigint, n bigint, flags binary")


def _asked(r: Request, shared: list[dict] | None) -> np.ndarray:
    """Which n-grams of a block are asked for: tokens, and what another block may have too."""
    out = np.zeros(len(r.hashes), bool)
    if shared:
        longer = np.zeros(len(r.hashes), bool)
        longer[np.concatenate(r.places[1:])] = True
        flags = np.concatenate([np.unpackbits(np.frombuffer(x["flags"], np.uint8), count=x["n"]) for x in shared])
        out[np.flatnonzero(longer)[flags > 0]] = True
    out[r.places[0]] = True
    return out


def _answers(blocks: DataFrame, order: int, buckets: int) -> DataFrame:
    """(block, packets): for each block the counts of the n-grams it asks for, and one row without a block per bucket with the number of distinct tokens known."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens, sizes, learns = _load(row["learns"], row["sizes"], row["vocabulary"], row["stream"])
                r = request(tokens, sizes, order, buckets, np.repeat(learns, sizes))
                single = np.zeros(len(r.hashes), np.int64)
                single[r.places[0]] = 1
                asked = _asked(r, row["shared"])
                hashes, counts, single = r.hashes[asked], r.counts[asked], single[asked]
                cuts = np.searchsorted(bucket_of(hashes, buckets), np.arange(buckets + 1))
                found = [(b, cuts[b], cuts[b + 1]) for b in range(buckets) if cuts[b + 1] > cuts[b]]
                for part in range(0, len(found), 64):
                    own = found[part : part + 64]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([b for b, _, _ in own], pa.int64()), pa.array([row["block"]] * len(own)), pa.array([row["held"]] * len(own)),
                            pa.array([planes(hashes[x:y], 8) for _, x, y in own], pa.binary()), pa.array([pack(counts[x:y]) for _, x, y in own], pa.binary()),
                            pa.array([pack(single[x:y]) for _, x, y in own], pa.binary()),
                        ],
                        names=["bucket", "block", "held", "hashes", "counts", "single"],
                    )

    def answer(packets: pd.DataFrame) -> pd.DataFrame:
        hashes = [unplanes(x, 8) for x in packets["hashes"]]
        counts = [unpack(x) for x in packets["counts"]]
        single = np.concatenate([unpack(x) for x in packets["single"]]) > 0
        known, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        own = np.concatenate(counts).astype(np.float64)
        total = np.bincount(inverse, own, len(known))
        held = np.repeat(packets["held"].to_numpy(), [len(h) for h in hashes])
        core = total - np.bincount(inverse, own * held, len(known))
        is_token = np.zeros(len(known), bool)
        is_token[inverse[single]] = True
        out, at = [], 0
        for held, h in zip(packets["held"], hashes):
            mine = inverse[at : at + len(h)]
            at += len(h)
            out.append((pack(total[mine].astype(np.int64)), pack(core[mine].astype(np.int64)) if held else None))
        result = pd.DataFrame({"bucket": packets["bucket"], "block": packets["block"], "total": [x for x, _ in out], "core": [x for _, x in out], "distinct": 0, "core_distinct": 0})
        result.loc[len(result)] = [packets["bucket"].iat[0], None, None, None, int((is_token & (total > 0)).sum()), int((is_token & (core > 0)).sum())]
        return result

    asked = blocks.select("block", "held", "learns", "sizes", "vocabulary", "stream", "shared").mapInArrow(ask, "bucket bigint, block string, held boolean, hashes binary, counts binary, single binary")
    return asked.groupBy("bucket").applyInPandas(answer, "bucket bigint, block string, total binary, core binary, distinct bigint, core_distinct bigint")


def _estimates(r: Request, counts: np.ndarray, order: int, n: int, tokens: np.ndarray, sizes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per order the relative frequency of each token after its context, and the bucket of the context."""
    first = np.cumsum(sizes) - sizes
    starts = np.zeros(len(tokens), bool)
    starts[first] = True
    at_end = np.flatnonzero(r.hashes == END)
    texts = counts[at_end[0]] if len(at_end) else 0  # the begin is seen as often as the end
    own = [counts[p] * (g != 0) for p, g in zip(r.places, [r.hashes[p] for p in r.places])]
    estimates, buckets = [own[0] / max(1, n)], [np.ones(len(tokens), np.int64)]
    for k in range(1, order):
        context = np.empty(len(tokens), np.float64)
        context[1:] = own[k - 1][:-1]
        context[starts] = texts if k == 1 else 0
        estimates.append(own[k] / np.maximum(context, 1))
        buckets.append(bucket_of_count(context))
    return estimates, buckets


def _mixed(estimates: list[np.ndarray], buckets: list[np.ndarray], weights: Weights, upto: int) -> np.ndarray:
    p = np.full(len(estimates[0]), 1.0 / (weights.distinct + 1))
    for k in range(upto):
        share = weights.by_order[k][buckets[k]]
        p = share * estimates[k] + (1 - share) * p
    return p


def learn_weights(cells: list[tuple[int, float, int]]) -> np.ndarray:
    """EM for one order: cells are (bucket, log10 of the ratio of this order's estimate to the lower order's probability, tokens).

    A bucket without tokens has the weight of the nearest lower one with some, else of the nearest higher one, else PRIOR.
    Bucket 0, a context never seen, has no estimate and so no weight.
    """
    out = np.zeros(BUCKETS)
    by_bucket: dict[int, list[tuple[float, int]]] = {}
    for bucket, ratio, n in cells:
        by_bucket.setdefault(bucket, []).append((ratio, n))
    for bucket, rows in by_bucket.items():
        ratio, n = 10.0 ** np.array([r for r, _ in rows]), np.array([c for _, c in rows], np.float64)
        ratio[ratio < 1e-29] = 0.0
        share = 0.5
        for _ in range(ROUNDS):
            share = float((n * share * ratio / (share * ratio + 1 - share)).sum() / n.sum())
            share = min(max(share, 1e-6), 1 - 1e-6)
        out[bucket] = share if bucket else 0.0
    learned = sorted(b for b in by_bucket if b)
    for bucket in range(1, BUCKETS):
        if bucket not in by_bucket:
            lower = [b for b in learned if b < bucket]
            out[bucket] = out[lower[-1]] if lower else out[learned[0]] if learned else PRIOR
    return out


def score(
    docs: DataFrame, learns: Column, order: int = ORDER, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id_column, n_tokens, n_known, train_tokens, base_score, score), a row per row of ``docs``.

    ``learns`` says which rows the model learns from (null: no). Tokens are runs of anything but
    ASCII white space, A-Z in lower case, and an end after every text; a null text counts as empty.
    ``base_score`` adds log10((c + 1) / (N + V + 1)) over the tokens, ``score`` is the model's log10
    probability. Without held-out rows each order's estimate weighs PRIOR. Repeated rows and null ids are kept one by one. Other columns are ignored. Without
    training rows all tokens are unknown and equally likely. An empty table gives an empty result.
    """
    key = docs.schema[id_column].dataType.simpleString()
    plain = docs.select(
        F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), F.coalesce(learns, F.lit(False)).alias("learns"),
        (F.pmod(F.xxhash64(F.lit(17), F.col(id_column)), F.lit(HELD_OUT)) == 0).alias("held"),
    )
    blocks = materialize(_blocks(plain, key))
    totals = blocks.agg(F.sum("tokens"), F.sum("learned"), F.sum(F.when(F.col("held"), F.col("learned")))).first()
    tokens, learned, held = (x or 0 for x in totals)
    buckets = max(8, math.ceil(tokens * order / BUCKET_GRAMS))
    if order > 1:
        shift = max(0, 64 - SPARE_BITS - math.ceil(math.log2(max(2, tokens * (order - 1)))))
        flags = _stored(_shared(blocks, order, buckets, shift))
        per_block = flags.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "flags"))).alias("shared"))
        plain_blocks, blocks = blocks, _stored(blocks.join(per_block, "block", "left"))
        _drop(plain_blocks)
        _drop(flags)
    else:
        blocks = blocks.withColumn("shared", F.lit(None).cast(SHARED))
    answered = _stored(_answers(blocks, order, buckets))
    known = answered.agg(F.sum("distinct"), F.sum("core_distinct")).first()
    by_block = answered.where(F.col("block").isNotNull()).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "total", "core"))).alias("packets"))

    def estimates(row: dict, which: str, n: int):
        own, sizes, own_learns = _load(row["learns"], row["sizes"], row["vocabulary"], row["stream"])
        r = request(own, sizes, order, buckets, np.repeat(own_learns, sizes))
        # a block's own counts are all there are of what it did not ask for; held-out ones are none of the others'
        counts = r.counts.astype(np.float64) if which == "total" else np.zeros(len(r.counts))
        counts[_asked(r, row["shared"])] = np.concatenate([unpack(p[which]) for p in row["packets"]])
        return r, counts, *_estimates(r, counts, order, n, own, sizes), sizes

    core = Weights(learned - held, known[1] or 0, [])
    trained = blocks.where("held").join(by_block, "block")

    def held_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, _, found, bucket, _ = estimates(row, "core", core.tokens)
                for part in range(0, len(found[0]), 100_000):
                    cut = slice(part, part + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(f[cut]) for f in found] + [pa.array(b[cut], pa.int32()) for b in bucket], names=[f"e{k}" for k in range(order)] + [f"b{k}" for k in range(order)])

    schema = ", ".join([f"e{k} double" for k in range(order)] + [f"b{k} int" for k in range(order)])
    samples = _stored(trained.mapInArrow(held_out, schema))
    lower: Column = F.lit(1.0 / (core.distinct + 1))
    for k in range(order):
        ratio = F.greatest(F.round(F.log10(F.greatest(F.col(f"e{k}") / lower, F.lit(1e-30))) / CELL) * CELL, F.lit(-30.0))
        cells = samples.groupBy(F.col(f"b{k}").alias("b"), ratio.alias("r")).agg(F.count("*").alias("n")).collect()  # at most buckets x cells rows
        # held-out tokens say nothing about a model of no tokens
        core.by_order.append(learn_weights([(x["b"], x["r"], x["n"]) for x in cells] if core.tokens else []))
        table = F.array(*[F.lit(float(x)) for x in core.by_order[k]])
        share = F.get(table, F.col(f"b{k}"))
        lower = share * F.col(f"e{k}") + (1 - share) * lower
    weights = Weights(learned, known[0] or 0, core.by_order if learned else [np.zeros(BUCKETS)] * order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                r, counts, found, bucket, sizes = estimates(row, "total", weights.tokens)
                c = counts[r.places[0]]
                starts = np.cumsum(sizes) - sizes
                base = np.add.reduceat(np.log10((c + 1) / (weights.tokens + weights.distinct + 1)), starts)
                full = np.add.reduceat(np.log10(_mixed(found, bucket, weights, order)), starts)
                seen = np.add.reduceat((c > 0).astype(np.int64), starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], id_type(batch)), pa.array(sizes, pa.int64()), pa.array(seen), pa.array([weights.tokens] * len(sizes), pa.int64()), pa.array(base), pa.array(full)],
                    names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    def id_type(batch: pa.RecordBatch) -> pa.DataType:
        return batch.schema.field(batch.schema.get_field_index("ids")).type.value_type

    out = blocks.join(by_block, "block").mapInArrow(run, f"id {key}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.withColumnRenamed("id", id_column)
