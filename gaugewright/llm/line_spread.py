"""Removal of lines that stand on many sites, by distinct-site sketches.

Every line is a pair of 64-bit hashes. Per line, a HyperLogLog sketch of its sites is built in each
task and merged in the aggregation, so a line on a third of all rows costs one sketch per task. The
estimate decides lines far from the threshold; for lines near it the distinct sites are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .words import small

MIN_SITES = 10
LOG_BUCKETS = 10
#: Half-width of the band of exact counts, in standard errors of the sketch.
BAND = 5.0
BITS = 63


def _lines(docs: DataFrame, id_column: str, text_column: str, site_column: str) -> DataFrame:
    """(id, version, site, pos, h1, h2): the lines that have more than spaces."""
    text = F.col(text_column).cast("string")
    rows = docs.select(
        F.col(id_column).alias("id"), F.xxhash64(text).alias("version"), F.col(site_column).cast("string").alias("site"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")
    ).select("id", "version", "site", "pos", F.trim("line").alias("line"))
    return rows.where(F.col("line") != "").select("id", "version", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), F.col("line")).alias("h2"))


def spread_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", site_column: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2, first): the lines on at least ``min_sites`` distinct sites, and where each stands first (id, version, pos)."""
    lines = _lines(docs, id_column, text_column, site_column)
    margin = BAND * 1.04 / (1 << LOG_BUCKETS) ** 0.5
    seen = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LOG_BUCKETS)).alias("sketch"), F.min(F.struct("id", "version", "pos")).alias("first"))
    likely = materialize(
        seen.select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - margin) - 1)
    )
    near = likely.where(F.col("sites") <= min_sites * (1 + margin) + 1)
    exact = (
        lines.join(small(near.select("h1", "h2")), ["h1", "h2"]).groupBy("h1", "h2", "site").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2").agg(F.count("site").alias("sites")).where(F.col("sites") >= min_sites)
    )
    sure = likely.where(F.col("sites") > min_sites * (1 + margin) + 1)
    return sure.select("h1", "h2", "first").unionByName(near.join(exact.select("h1", "h2"), ["h1", "h2"]).select("h1", "h2", "first"))


def remove_spread_lines(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", site_column: str = "source", min_sites: int = MIN_SITES
) -> DataFrame:
    """The documents with lines of many sites removed but for their first place, and two more columns: ``n_lines`` and ``n_removed``.

    Lines are cut at line feeds and compared without leading and trailing spaces; blank lines always
    stay. The first place of a line is the smallest (id, text hash, line number), so no line leaves
    the corpus altogether. A null site counts as no site. A null text stays null with no lines; an
    empty text has one blank line. Rows with the same id and text get the same result; a null id
    sorts first. Other columns are carried along; columns named ``n_lines`` or ``n_removed`` are
    replaced. An empty table gives an empty table.
    """
    spread = small(materialize(spread_lines(docs, id_column, text_column, site_column, min_sites)))
    here = F.struct("id", "version", "pos")
    hits = _lines(docs, id_column, text_column, site_column).join(spread, ["h1", "h2"]).where(~here.eqNullSafe(F.col("first")))
    masks = (
        hits.groupBy("id", "version", F.floor(F.col("pos") / BITS).cast("int").alias("block"))
        .agg(F.bit_or(F.shiftleft(F.lit(1).cast("bigint"), 0) * F.pow(F.lit(2.0), F.col("pos") % BITS).cast("bigint")).alias("mask"))
        .groupBy("id", "version").agg(F.map_from_entries(F.collect_list(F.struct("block", "mask"))).alias("by_block"), F.max("block").alias("top"))
    )
    dense = masks.select(
        F.col("id").alias("_id"), F.col("version").alias("_version"),
        F.transform(F.sequence(F.lit(0), F.col("top")), lambda b: F.coalesce(F.element_at("by_block", b), F.lit(0).cast("bigint"))).alias("_masks"),
    )
    text = F.col(text_column).cast("string")
    keyed = docs.drop("n_lines", "n_removed").withColumn("_v", F.xxhash64(text))
    joined = keyed.join(dense, F.col(id_column).eqNullSafe(F.col("_id")) & (F.col("_v") == F.col("_version")), "left")

    def stays(_: Column, i: Column) -> Column:
        mask = F.coalesce(F.get("_masks", F.floor(i / BITS).cast("int")), F.lit(0).cast("bigint"))
        return mask.bitwiseAND(F.pow(F.lit(2.0), i % BITS).cast("bigint")) == 0

    kept = F.filter(F.split(text, "\n", -1), stays)
    out = joined.withColumn("n_lines", F.coalesce(F.size(F.split(text, "\n", -1)).cast("bigint"), F.lit(0).cast("bigint")))
    out = out.withColumn("n_lines", F.when(text.isNull(), F.lit(0).cast("bigint")).otherwise(F.col("n_lines")))
    removed = F.aggregate("_masks", F.lit(0), lambda total, mask: total + F.bit_count(mask))
    out = out.withColumn("n_removed", F.coalesce(removed, F.lit(0)).cast("bigint"))
    out = out.withColumn(text_column, F.when(F.col("_masks").isNull(), text).otherwise(F.array_join(kept, "\n")))
    return out.select(*[c for c in docs.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")
