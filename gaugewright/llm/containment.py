"""Short test items inside long documents: MinHash containment search, partitioned by item size.

Items are partitioned by the power of two of their number of distinct shingles. An item's sketch is
its lowest shingle hashes (bottom-k MinHash), with one k per partition: one more than the shingles
that the largest item of the partition may miss. So a document that contains an item to the asked
degree holds at least one hash of its sketch, and no such pair is lost. The partition also bounds
the documents: those too small for its smallest item are not looked at. Candidates are verified
by the exact share of the item's shingles that the document contains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .words import SHINGLE, each, shingle_hashes, shingles, small, words

THRESHOLD = 0.8


def item_sketches(items: DataFrame, threshold: float, size: int, item_id: str, item_text: str) -> DataFrame:
    """(item, least, hash): the sketch of each item, and the least number of shingles of a document for its partition."""
    found = items.select(F.col(item_id).alias("item"), words(F.col(item_text)).alias("found"))
    hashes = found.where(F.size("found") > 0).select("item", F.array_sort(F.array_distinct(shingle_hashes(F.col("found"), size))).alias("hashes"))
    sized = hashes.withColumn("smallest", F.pow(F.lit(2.0), F.floor(F.log2(F.size("hashes").cast("double")) + 1e-9)).cast("bigint"))
    missing = F.floor((F.col("smallest") * 2 - 1) * (1.0 - threshold) + 1e-9).cast("int")
    return sized.select(
        "item", F.ceil(F.col("smallest") * threshold - 1e-9).cast("bigint").alias("least"), F.explode(F.slice("hashes", 1, missing + 1)).alias("hash")
    )


def contained_items(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE,
    id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(id_column, item_id, n_shingles, n_found, containment): the items of which a document holds at least the share ``threshold``.

    A shingle is ``size`` words; a text with fewer words has one shingle, all its words, so that a
    shorter item is found only in a text of just these words. Items and documents without words,
    and null texts, match nothing. Rows with the same id are searched together and give one row per
    item; null ids give no rows. Other columns are ignored. Empty tables give an empty result.
    """
    items = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("body")).where(F.col("item").isNotNull())
    docs = docs.select(F.col(id_column).alias("doc"), F.col(text_column).alias("text")).where(F.col("doc").isNotNull())
    sketches = small(materialize(item_sketches(items, threshold, size, "item", "body").distinct()))
    hashed = docs.select("doc", words(F.col("text")).alias("found")).select(
        "doc", F.greatest(F.size("found") - size + 1, F.lit(1)).alias("n"), F.explode(shingle_hashes(F.col("found"), size)).alias("hash")
    )
    pairs = materialize(hashed.join(sketches, "hash").where(F.col("n") >= F.col("least")).select("doc", "item").distinct())
    wanted = small(pairs.select("doc").distinct())
    body = docs.join(wanted, "doc", "left_semi").select("doc", words(F.col("text")).alias("found")).select("doc", shingles(F.col("found"), size).alias("own"))
    sets = items.select("item", words(F.col("body")).alias("found")).select("item", shingles(F.col("found"), size).alias("shingles"))
    asked = materialize(each(sets, "item", "shingles", "shingle").distinct())
    # the candidates' shingles that are of any item, then of the item of a candidate pair
    held = each(body, "doc", "own", "shingle").join(small(asked), "shingle").distinct()
    counts = held.join(pairs, ["doc", "item"], "left_semi").groupBy("doc", "item").agg(F.count("*").alias("n_found"))
    found = counts.join(asked.groupBy("item").agg(F.count("*").alias("n_shingles")), "item")
    share = F.col("n_found") / F.col("n_shingles")
    return found.where(share >= threshold - 1e-12).select(
        F.col("doc").alias(id_column), F.col("item").alias(item_id), F.col("n_shingles").cast("bigint"), F.col("n_found").cast("bigint"), share.alias("containment")
    )
