"""Encoding texts with a byte-pair piece model, and decoding them again, on Spark.

A text is cut where no piece can cross: before a run of spaces, and around line ends. Each cut is
encoded by a prefix table. For every prefix of the cut the table holds the one piece that ends the
encoding of that prefix. An Aho-Corasick automaton lists the pieces ending at a position; the right
one is the piece that is compatible with the last piece of the prefix before it. Two neighbouring
pieces are compatible if no merge across their border would have come before the merges that made
them. Walking the table backwards gives the ids. Time is linear in the text.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import slices

SPACE = "▁"
UNITS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
NEVER = 1 << 60
CACHED_UNITS, CACHED_LENGTH = 300_000, 48


@dataclass
class Pieces:
    """A byte-pair model's pieces, their merge ranks (low merges first) and its control ids."""

    texts: list[str]
    ranks: list[int]
    is_text: list[bool]
    byte_ids: list[int]
    begin: int
    end: int
    dummy_prefix: bool = True
    control: frozenset[int] = frozenset()
    built: Codec | None = None

    def codec(self) -> Codec:
        """The codec of these pieces, built once per process."""
        if self.built is None:
            self.built = Codec(self)
        return self.built

    @classmethod
    def load(cls, path: str) -> Pieces:
        """Reads the vocabulary of a sentencepiece BPE model with identity normalisation and byte fallback."""
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec, normal = model.trainer_spec, model.normalizer_spec
        if spec.model_type != 2 or not spec.byte_fallback or normal.name != "identity" or normal.remove_extra_whitespaces:
            raise ValueError("only BPE models with byte fallback and identity normalisation are supported")
        kinds = [piece.type for piece in model.pieces]
        if any(kind not in (1, 2, 3, 6) for kind in kinds):
            raise ValueError("user-defined and unused pieces are not supported")
        order = {score: rank for rank, score in enumerate(sorted({p.score for p in model.pieces if p.type == 1}, reverse=True))}
        byte_ids = [-1] * 256
        for i, piece in enumerate(model.pieces):
            if piece.type == 6:
                byte_ids[int(piece.piece[3:5], 16)] = i
        texts = [p.piece for p in model.pieces]
        for i, piece in enumerate(texts):
            if kinds[i] == 1 and (SPACE in piece.lstrip(SPACE) or "\n" in piece):
                raise ValueError(f"piece {piece!r} crosses a place where texts are cut")
        return cls(
            texts, [order.get(p.score, NEVER) for p in model.pieces], [k == 1 for k in kinds], byte_ids,
            spec.bos_id, spec.eos_id, normal.add_dummy_prefix, frozenset(i for i, k in enumerate(kinds) if k in (2, 3)),
        )


@dataclass
class Codec:
    """Encodes and decodes single texts; one is kept per Python worker."""

    pieces: Pieces
    ids: dict[str, int] = field(init=False)
    left: list[list[tuple[int, int]]] = field(init=False)
    right: list[list[tuple[int, int]]] = field(init=False)

    def __post_init__(self) -> None:
        p = self.pieces
        self.ids = {t: i for i, t in enumerate(p.texts) if p.is_text[i]}
        self.bytes = [t.replace(SPACE, " ").encode() if p.is_text[i] else b"" for i, t in enumerate(p.texts)]
        for value, i in enumerate(p.byte_ids):
            if i >= 0:
                self.bytes[i] = bytes([value])
        self.cache: dict[str, bytes] = {}
        self.good: dict[int, bool] = {}
        parts: dict[int, tuple[int, int]] = {}
        whole = set()
        for text, i in self.ids.items():
            made = self.merged(text)
            if len(made[0]) == 1:
                whole.add(i)
                if made[1]:
                    parts[i] = made[1]
        self.left, self.right = [[] for _ in p.texts], [[] for _ in p.texts]
        for i in whole:
            self.left[i], self.right[i] = self._border(i, parts, 0), self._border(i, parts, 1)
        self.automaton = ahocorasick.Automaton()
        for i in whole:
            if not (set(p.texts[i]) == {SPACE} and len(p.texts[i]) > 1):
                self.automaton.add_word(p.texts[i], (len(p.texts[i]), i))
        self.automaton.make_automaton()
        self.space = self.ids.get(SPACE)

    def _border(self, i: int, parts: dict[int, tuple[int, int]], side: int) -> list[tuple[int, int]]:
        """The pieces that stand at a side of piece i while it is built, each with the rank of the merge that ends it."""
        border, ends = [], NEVER
        while True:
            border.append((i, ends))
            if i not in parts:
                return border
            ends, i = self.pieces.ranks[i], parts[i][side]

    def merged(self, text: str) -> tuple[list[str], tuple[int, int] | None]:
        """Plain merging of a short text: its parts, and the last merge made (by ids)."""
        parts, last = list(text), None
        while len(parts) > 1:
            rank, at = min((self.pieces.ranks[self.ids[a + b]] if a + b in self.ids else NEVER, k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == NEVER:
                break
            last = (self.ids.get(parts[at], -1), self.ids.get(parts[at + 1], -1))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, last

    def compatible(self, a: int, b: int) -> bool:
        """Whether piece b can follow piece a: no merge across the border comes before the merges inside."""
        key = a << 32 | b
        known = self.good.get(key)
        if known is None:
            known, texts, ranks = True, self.pieces.texts, self.pieces.ranks
            for x, x_ends in self.right[a]:
                for y, y_ends in self.left[b]:
                    z = self.ids.get(texts[x] + texts[y])
                    if z is not None and ranks[z] < x_ends and ranks[z] <= y_ends:
                        known = False
            if len(self.good) > 4_000_000:
                self.good.clear()
            self.good[key] = known
        return known

    def spaces(self, n: int) -> list[int]:
        """The pieces of n spaces alone: equal scores merge from the left."""
        if n == 1:
            return [self.space]
        alive, size, after, before = [True] * n, [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(at: int) -> None:
            if at >= 0 and after[at] < n:
                z = self.ids.get(SPACE * (size[at] + size[after[at]])) if size[at] + size[after[at]] <= 64 else None
                if z is not None:
                    heapq.heappush(heap, (self.pieces.ranks[z], at, size[at], size[after[at]]))

        for at in range(n - 1):
            offer(at)
        while heap:
            _, at, own, other = heapq.heappop(heap)
            if not alive[at] or size[at] != own or after[at] >= n or size[after[at]] != other:
                continue
            gone = after[at]
            alive[gone], size[at], after[at] = False, own + other, after[gone]
            if after[at] < n:
                before[after[at]] = at
            offer(before[at])
            offer(at)
        return [self.ids[SPACE * size[at]] for at in range(n) if alive[at]]

    def word(self, text: str) -> list[int]:
        """The ids of a cut with at most one leading space, by the prefix table."""
        n = len(text)
        last, length = [-1] * (n + 1), [1] * (n + 1)  # -1: a character that is no piece
        ends: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for at, piece in self.automaton.iter(text):
            ends[at].append(piece)
        for at in range(n):
            for size, i in ends[at]:
                before = last[at + 1 - size]
                if at + 1 == size or before < 0 or self.compatible(before, i):
                    last[at + 1], length[at + 1] = i, size
                    break
        out: list[int] = []
        while n:
            if last[n] < 0:
                out.extend(self.pieces.byte_ids[b] for b in reversed(text[n - 1].encode("utf-8", "replace")))
            else:
                out.append(last[n])
            n -= length[n]
        return out[::-1]

    def unit(self, text: str) -> bytes:
        run = len(text) - len(text.lstrip(SPACE))
        if run < 2:
            ids = self.word(text)
        elif run == len(text):
            ids = self.spaces(run)
        else:
            ids = self.word(text[run - 1 :])
            bare = ids[0] == self.space
            ids = self.spaces(run - 1 + bare) + ids[bare:]
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str, begin_and_end: bool = True) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        p, cache, out = self.pieces, self.cache, []
        if text:
            text = text.replace(" ", SPACE)
            for unit in UNITS.findall(SPACE + text if p.dummy_prefix else text):
                ids = cache.get(unit)
                if ids is None:
                    ids = self.unit(unit)
                    if len(unit) <= CACHED_LENGTH:
                        if len(cache) >= CACHED_UNITS:
                            cache.clear()
                        cache[unit] = ids
                out.append(ids)
        if begin_and_end:
            out.insert(0, p.begin.to_bytes(4, "little"))
            out.append(p.end.to_bytes(4, "little"))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids; control pieces give nothing, broken bytes U+FFFD, the leading space goes."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        out = b"".join(map(self.bytes.__getitem__, numbers))
        first = next((i for i in numbers if i not in self.pieces.control), None)
        if self.pieces.dummy_prefix and first is not None and self.pieces.texts[first].startswith(SPACE):
            out = out[1:]
        return out.decode("utf-8", "replace")



def encode_decode(df: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text", begin_and_end: bool = True) -> DataFrame:
    """Per row: id_column, ids (binary, little-endian unsigned 32-bit), n_tokens, decoded.

    A null text counts as empty. An empty text has only the begin and end ids. Rows with repeated or
    null ids are kept one by one; other columns are ignored, whatever their names. An empty table
    gives an empty result.
    """
    spark, pieces = df.sparkSession, Pieces.load(model_path)
    shared = spark.sparkContext.broadcast(pieces)  # the vocabulary: its size does not depend on the data
    key = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value.codec()
        for batch in slices(batches):
            ids = [codec.encode(text or "", begin_and_end) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([codec.decode(x) for x in ids], pa.string())],
                names=["id", "ids", "n_tokens", "decoded"],
            )

    plain = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return plain.mapInArrow(run, f"id {key}, ids binary, n_tokens bigint, decoded string").withColumnRenamed("id", id_column)
