"""Encoding texts with a byte-level byte-pair vocabulary, and decoding them again, on Spark.

A text is cut into the vocabulary's words (its pattern), and each word is cut again at forced
boundaries: between two bytes that stand side by side inside no token of the vocabulary. Every merge
makes a token, so none can ever cross such a place, and what lies on its two sides is merged
independently. The fragments are encoded one by one, remembered, and put together in order.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import slices

# Characters that became letters or numbers after Unicode 16, whose classes the vocabulary's library uses.
NEWER = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE "
    "11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 "
    "18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 "
    "1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
# The endings that the pattern of byte-level vocabularies keeps apart.
ENDINGS = "s t re ve m ll d"
CACHED, CACHED_LENGTH = 400_000, 48
PLAIN_MERGING = 64
NEVER = 1 << 60


def newer_letters() -> str:
    return "".join("-".join(f"\\U{int(end, 16):08X}" for end in span.split("-")) for span in NEWER.split())


def word_pattern(without: str = "") -> str:
    """The words of a text; characters of the class ``without`` are neither letters nor numbers.

    Endings, then letters, numbers or other signs with at most one leading space, then white space (its last character goes to a word that follows).
    """
    letter, number, other = r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]"
    if without:
        letter, number, other = f"[{letter}--[{without}]]", f"[{number}--[{without}]]", f"[{other}||[{without}]]"
    return "|".join([f"'(?:{'|'.join(ENDINGS.split())})", f" ?{letter}+", f" ?{number}+", f" ?{other}+", r"\s+(?!\S)", r"\s+"])


def byte_signs() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


@dataclass
class Vocabulary:
    """Tokens as bytes, merges by rank, and special tokens of a byte-level BPE vocabulary."""

    tokens: dict[int, bytes]
    ranks: dict[tuple[int, int], int]  # of a pair's merge; low ranks merge first
    made: list[int]  # the token that the merge of a rank makes
    special: dict[str, int]
    built: Codec | None = None

    def codec(self) -> Codec:
        """The codec, built once per process."""
        if self.built is None:
            self.built = Codec(self)
        return self.built

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Reads a tokenizer file. Other models, normalisers or cutting rules than byte-level BPE's are refused."""
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        plain = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
        if model["type"] != "BPE" or any(model.get(name) for name in plain) or spec["normalizer"] or spec["post_processor"]:
            raise ValueError("only plain byte-level BPE vocabularies are supported")
        if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or (spec["decoder"] or {}).get("type") != "ByteLevel":
            raise ValueError("only the byte-level way of cutting texts is supported")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with options are not supported")
        signs, ids = byte_signs(), model["vocab"]
        tokens = {i: bytes(signs[c] for c in sign) for sign, i in ids.items() if all(c in signs for c in sign)}
        if {t for t in tokens.values() if len(t) == 1} != {bytes([b]) for b in range(256)}:
            raise ValueError("the vocabulary lacks tokens for single bytes")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ranks = {(ids[a], ids[b]): rank for rank, (a, b) in enumerate(pairs)}
        return cls(tokens, ranks, [ids[a + b] for a, b in pairs], {t["content"]: t["id"] for t in spec["added_tokens"]})


class Remembered(dict):
    """Ids by word; those of words not seen yet are made, and kept if the word is short."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word):
        ids = self.make(word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED:
                self.clear()
            self[word] = ids
        return ids


@dataclass
class Codec:
    """Encodes and decodes single texts; one is kept per Python worker."""

    vocabulary: Vocabulary
    inside: bytearray = field(init=False)

    def __post_init__(self) -> None:
        v = self.vocabulary
        #: inside[256 * a + b]: byte b follows byte a inside some token
        self.inside = bytearray(1 << 16)
        for token in v.tokens.values():
            for a, b in zip(token, token[1:]):
                self.inside[a << 8 | b] = 1
        self.single = {t[0]: i for i, t in v.tokens.items() if len(t) == 1}
        self.plain_words, self.all_words = regex.compile(word_pattern(), regex.V1), regex.compile(word_pattern(newer_letters()), regex.V1)
        self.newer = re.compile(f"[{newer_letters()}]")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(v.special, key=len, reverse=True))) + ")") if v.special else None
        self.of_word = Remembered(self.word)
        self.of_fragment = Remembered(self.fragment)

    @cached_property
    def bytes_of(self) -> list[bytes]:
        v = self.vocabulary
        known = v.tokens | {i: text.encode() for text, i in v.special.items()}
        return [known.get(i, b"") for i in range(max(known) + 1)]

    def cuts(self, word: bytes) -> list[int]:
        """The forced boundaries of a word: places whose two bytes stand side by side in no token."""
        inside = self.inside
        return [at for at, (a, b) in enumerate(zip(word, word[1:]), 1) if not inside[a << 8 | b]]

    def word(self, text: str) -> bytes:
        own = text.encode()
        ends = [0, *self.cuts(own), len(own)]
        return b"".join(self.of_fragment[own[a:b]] for a, b in zip(ends, ends[1:]))

    def fragment(self, own: bytes) -> bytes:
        """Merges of a fragment: always the pair of lowest rank, the leftmost of equals."""
        ids = [self.single[b] for b in own]
        ids = self._plain(ids) if len(ids) <= PLAIN_MERGING else self._queued(ids)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _plain(self, ids: list[int]) -> list[int]:
        rank_of, made = self.vocabulary.ranks.get, self.vocabulary.made
        ranks = [rank_of(pair, NEVER) for pair in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) != NEVER:
            at = ranks.index(low)
            ids[at] = made[low]
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank_of((ids[at - 1], ids[at]), NEVER)
            if at < len(ranks):
                ranks[at] = rank_of((ids[at], ids[at + 1]), NEVER)
        return ids

    def _queued(self, ids: list[int]) -> list[int]:
        """The same for a long fragment, with a queue of possible merges: n log n."""
        rank_of, made, n = self.vocabulary.ranks.get, self.vocabulary.made, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[int, int, int, int]] = []

        def offer(at: int) -> None:
            if at >= 0 and after[at] < n:
                rank = rank_of((ids[at], ids[after[at]]))
                if rank is not None:
                    heapq.heappush(queue, (rank, at, ids[at], ids[after[at]]))

        for at in range(n - 1):
            offer(at)
        while queue:
            rank, at, left, right = heapq.heappop(queue)
            if ids[at] != left or after[at] >= n or ids[after[at]] != right:
                continue
            gone = after[at]
            ids[at], ids[gone], after[at] = made[rank], -1, after[gone]
            if after[at] < n:
                before[after[at]] = at
            offer(before[at])
            offer(at)
        return [i for i in ids if i >= 0]

    def words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")  # no newer characters, and much faster than looking for them
            return self.plain_words.findall(text)
        except UnicodeEncodeError:
            return (self.all_words if self.newer.search(text) else self.plain_words).findall(text)

    def encode(self, text: str, special_as_text: bool = False) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if self.specials is None or special_as_text:
            return b"".join(map(self.of_word.__getitem__, self.words(text)))
        parts = self.specials.split(text)
        out = [b"".join(map(self.of_word.__getitem__, self.words(part))) for part in parts[::2]]
        for k, name in enumerate(parts[1::2]):
            out[k] += self.vocabulary.special[name].to_bytes(4, "little")
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included; broken bytes give U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode_decode(df: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text", special_as_text: bool = False) -> DataFrame:
    """Per row: id_column, ids (binary, little-endian unsigned 32-bit), n_tokens, decoded.

    Names of special tokens in a text become their ids, or plain text with ``special_as_text``. A
    null text counts as empty and has no ids. Whole texts are encoded, whatever their length, in
    time that grows with the length times its logarithm at most. Rows with repeated or null ids are
    kept one by one; other columns are ignored, whatever their names. An empty table gives an empty
    result. Equal ranks don't occur; of equal pairs the leftmost merges first, as in the library.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary.load(vocabulary_path))  # its size does not depend on the data
    key = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value.codec()
        for batch in slices(batches):
            ids = [codec.encode(text or "", special_as_text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([codec.decode(x) for x in ids], pa.string())],
                names=["id", "ids", "n_tokens", "decoded"],
            )

    plain = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return plain.mapInArrow(run, f"id {key}, ids binary, n_tokens bigint, decoded string").withColumnRenamed("id", id_column)
