"""Words of a corpus, and the words one edit away from each, by an index of grams of variable length.

The gram dictionary is a tree over the words' substrings, cut back by frequency: a gram that begins
at more than a threshold of places is too common to tell words apart and is extended by one
character, up to a longest length. A word is taken apart into the gram at each of its positions, less
those that lie within an earlier one. A word's bound is the most grams that one edit anywhere can
touch, or can cause to be covered by another gram. Two words one edit apart share all grams but those,
at the same place or one further, so one of the rarest (bound + 1) grams of each is shared. Words meet
in the lists of these grams, split by place and word length, and each meeting is verified.

Words whose every gram may be touched by one edit also meet among themselves by pairs of characters,
of which an edit touches two at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .words import each

RUN = "[A-Za-zÀ-ÿ]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST, LONGEST = 2, 4
#: A gram that begins at more places than this is extended (twice as many, and so on, while the dictionary exceeds its size).
LEAST_COMMON = 32
DICTIONARY = 100_000
PAIRS_TOUCHED = 2
VARIABLE, PLAIN = 0, 1


def misspelt_words(df: DataFrame, one_in: int = 199, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, n): the letter runs of all texts and how often they occur, capitals A to Z made small.

    Where ``one_in`` divides the crc32 of ``id:run``, the run loses the character at that number
    modulo its length. A null text has no runs; a null id counts as an empty text.
    """
    runs = F.regexp_extract_all(F.coalesce(F.col(text_column).cast("string"), F.lit("")), F.lit(RUN), F.lit(0))
    found = each(df.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), runs.alias("runs")), "id", "runs", "run")
    low = found.select("id", F.translate("run", CAPITALS, SMALL).alias("run"))
    hashed = low.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    cut = F.overlay("run", F.lit(""), (F.col("h") % F.char_length("run") + 1).cast("int"), F.lit(1))
    word = F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class Dictionary:
    """The common grams with their counts. Those below the longest length are extended; every other gram is a leaf."""

    common: dict[str, int]
    longest: int = LONGEST
    inner: set[str] = field(init=False)
    tails: set[str] = field(init=False)

    def __post_init__(self) -> None:
        self.inner = {g for g in self.common if len(g) < self.longest}
        #: what an extended gram can end with, after at least one other character
        self.tails = {g[k:] for g in self.inner for k in range(1, len(g))} | ({""} if self.inner else set())

    def grams(self, word: str) -> list[tuple[int, int]]:
        """(start, end) of the word's grams: the leaf at each position, unless it lies within an earlier one."""
        out, reached, n = [], 0, len(word)
        for start in range(n - SHORTEST + 1):
            end = start + SHORTEST
            while end < n and word[start:end] in self.inner:
                end += 1
            if end > reached:
                out.append((start, end))
                reached = end
        return out

    def touched(self, word: str, grams: list[tuple[int, int]]) -> int:
        """The most grams of the word that one inserted, deleted or replaced character can change, cover or cut."""
        n, tails, most, first = len(word), self.tails, 0, 0
        for at in range(n + 1):
            while first < len(grams) and grams[first][1] < at:
                first += 1
            changed = inserted = 0
            for start, end in grams[first : first + 2 * self.longest + 2]:  # no gram further on is reached from here
                if start > at:
                    changed += word[at + 1 : end - 1] in tails  # a gram over the changed place may now cover this one
                elif at < end:
                    changed += 1
                if start >= at:
                    inserted += word[at : end - 1] in tails
                elif at < end or (end == n and word[start:end] in self.inner):  # split, or no longer cut by the word's end
                    inserted += 1
            most = max(most, inserted, changed if at < n else 0)
        return most

    def order(self, gram: str) -> tuple[int, int, str]:
        """Rare grams first, the same way for all words."""
        return (self.common.get(gram, 0), zlib.crc32(gram.encode()), gram)

    def index(self, word: str) -> Iterator[tuple[int, str, int]]:
        """(kind, gram, start): what the word is listed under."""
        grams = self.grams(word)
        touched = self.touched(word, grams)
        for start, end in sorted(grams, key=lambda g: (*self.order(word[g[0] : g[1]]), g[0]))[: touched + 1]:
            yield VARIABLE, word[start:end], start
        if touched >= len(grams):
            pairs = sorted(range(len(word) - 1), key=lambda k: (*self.order(word[k : k + 2]), k))
            for start in pairs[: PAIRS_TOUCHED + 1]:
                yield PLAIN, word[start : start + 2], start


def _substrings(word: Column, size: int) -> Column:
    """All substrings of a length; none of a shorter word."""
    starts = F.sequence(F.lit(1), F.char_length(word) - (size - 1))
    return F.when(F.char_length(word) >= size, F.transform(starts, lambda i: F.substr(word, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def dictionary(words: DataFrame, size: int = DICTIONARY, longest: int = LONGEST) -> Dictionary:
    """The gram dictionary of a table of different words: at most ``size`` common grams, so that it fits every task."""
    places = [_substrings(F.col("word"), q) for q in range(SHORTEST, longest + 1)]
    counts = words.select(F.explode(F.concat(*places)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LEAST_COMMON)
    counts = materialize(counts)
    doublings = counts.groupBy(F.floor(F.log2(F.col("n") - 1)).cast("int").alias("e")).count().collect()  # 64 rows at most
    least = LEAST_COMMON
    while sum(r["count"] for r in doublings if 2**r.e >= least) > size:
        least *= 2
    return Dictionary({r.gram: r.n for r in counts.where(F.col("n") > least).collect()}, longest)


def near_pairs(words: DataFrame, grams: Dictionary) -> DataFrame:
    """(a, a_n, b, b_n), once each: words that differ by one inserted, deleted or replaced character. ``words`` has (word, n), words once each."""
    shared = words.sparkSession.sparkContext.broadcast(grams)  # bounded by the dictionary's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value.index
        for batch in batches:
            own = batch.column(0).to_pylist()
            rows = [(at, *entry) for at, word in enumerate(own) for entry in index(word)]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at), batch.column(1).take(at), pa.array([len(own[r[0]]) for r in rows], pa.int32()),
                    pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.int32()),
                ],
                names=["word", "n", "size", "kind", "gram", "place"],
            )

    entries = materialize(words.select("word", "n").mapInArrow(run, "word string, n bigint, size int, kind int, gram string, place int"))
    # a word meets words of its own length at the same place, and longer ones at the same place or one further
    meetings = F.array(*[F.struct((F.col("size") + longer).alias("size"), (F.col("place") + later).alias("place")) for longer, later in ((0, 0), (1, 0), (1, 1))])
    asked = entries.select("kind", "gram", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("size").alias("a_size"), F.explode(meetings).alias("m"))
    asked = asked.select("kind", "gram", "a", "a_n", "a_size", "m.size", "m.place")
    held = entries.select("kind", "gram", "size", "place", F.col("word").alias("b"), F.col("n").alias("b_n"))
    meets = (asked["kind"] == held["kind"]) & (asked["gram"] == held["gram"]) & (asked["size"] == held["size"]) & (asked["place"] == held["place"])
    once = (F.col("a_size") < held["size"]) | (F.col("a") < F.col("b"))
    return asked.join(held, meets & once & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n").distinct()


def variants(words: DataFrame, ratio: int = 5, min_size: int = 6, min_n: int = 5, size: int = DICTIONARY, longest: int = LONGEST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words (word, n) of ``min_size`` characters and ``min_n`` occurrences or more.

    ``n_near`` counts the words one edit away. ``form`` is the one of these with the largest n (the
    smallest in code-point order of equals), if it has ``ratio`` times the word's n or more, else
    null; ``root`` follows forms to the last. Rows with a null word or n are left out and repeated
    words are added up. No words give no rows. Words of any length are compared whole; other columns
    are ignored. ``min_size`` is 4 at least: shorter words may share no two characters.
    """
    if min_size < 4 or ratio < 2:
        raise ValueError("words of 4 characters or more, and forms at least twice as common, are asked for")
    kept = words.where(F.char_length("word") >= min_size).groupBy("word").agg(F.sum("n").cast("bigint").alias("n")).where(F.col("n") >= min_n)
    kept = materialize(kept)
    pairs = materialize(near_pairs(kept, dictionary(kept, size, longest)))
    links = pairs.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n"))
    links = links.unionByName(pairs.select(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    best = links.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("low"), "other")).alias("best"))
    good = -F.col("best.low") >= F.col("n") * ratio
    near = materialize(best.select("word", "n_near", F.when(good, F.col("best.other")).alias("form"), F.when(good, -F.col("best.low")).alias("form_n")))
    root = roots(near.where(F.col("form").isNotNull()).select("word", "form"))
    out = kept.join(near, "word", "left").join(root, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of forms, by doubling. Each step is at least twice as common, so chains are short and end."""
    up = forms.select("word", F.col("form").alias("root"))
    while True:
        above = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = materialize(up.join(above, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        up = further.select("word", "root")
        if further.where("moved").isEmpty():
            return up
