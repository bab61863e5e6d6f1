"""A corpus pipeline over documents: each stage works on all that its predecessor kept.

Documents without a recognisable language go, then lines that stand on many sites, then all but one of each group of near
duplicates, then documents that hold benchmark items; what is left is encoded into tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewright.llm import containment, jaccard_join, language_id, line_spread
from gaugewright.llm import queries as llm
from gaugewright.plans.materialize import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A document whose best language contains less than this share of its n-grams is in no language that was learned.
LEAST_SHARE = 0.2


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """The documents with columns of the given names renamed, and the expressions that give all columns back."""
    moved = {c: f"__own_{c}" for c in docs.columns if c in names}
    return docs.withColumnsRenamed(moved), [F.col(moved.get(c, c)).alias(c) for c in docs.columns]


def _rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a number for every row, and that column's name.

    So rows with a null id, and different texts under one id, are told apart and each is judged. An id that stands once is
    its row's number. Only the other rows, if there are any, are stored, with numbers below all ids.
    """
    name = next(n for n in (f"row_{k}" for k in range(len(docs.columns) + 1)) if n not in docs.columns)
    own = docs.withColumn(name, F.col("doc_id").cast("bigint"))
    counted = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    shared = materialize(counted.where((F.col("n") > 1) | F.col("doc_id").isNull()).select("doc_id"))
    if shared.isEmpty():
        return own, name
    least = docs.agg(F.coalesce(F.min(F.col("doc_id").cast("bigint")), F.lit(0)).alias("least")).first()["least"]
    ids = shared.where(F.col("doc_id").isNotNull())
    several = docs.where(F.col("doc_id").isNull()).unionByName(docs.join(ids, "doc_id", "left_semi").select(*docs.columns))
    stored = materialize(several.withColumn(name, F.lit(least - 1) - F.monotonically_increasing_id()))
    once = own.where(F.col("doc_id").isNotNull()).join(ids, "doc_id", "left_anti")
    return once.select(*stored.columns).unionByName(stored), name


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language learned from the labelled ones. Null texts and texts without a letter go.

    Rows are judged one by one: null ids, repeated rows and very long texts like all others, the whole text each time. An
    empty table, or one without a labelled row, gives an empty table. Columns of any name come out as they went in.
    """
    own, columns = _aside(docs, "lang_pred", "score")
    found = language_id.identify(own, language_id.train(docs))
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select(*columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines of many sites but for their first place. Documents of which nothing but white space is left go; ``n_chars`` follows the text.

    Null texts stay; rows with the same id and text get the same result; an empty table stays empty. Columns of any name come out as they went in.
    """
    own, columns = _aside(docs, "n_lines", "n_removed")
    cleaned = line_spread.remove_spread_lines(own)
    emptied = (F.col("n_removed") > 0) & (F.trim(F.translate("text", "\n\r\t", "   ")) == "")
    cleaned = cleaned.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return cleaned.select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: that with the smallest id, a null id last.

    Every row is compared, also those with a null or shared id; of repeated rows one stays. Texts without words link with
    nothing and stay. An empty table stays empty.
    """
    rows, name = _rows(docs)
    linked = jaccard_join.near_duplicates(rows, id_column=name).where("n_links > 0").select(name, "group_id")
    ids = rows.select(F.col(name).alias("row"), F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(name).alias("row")).alias("rank"))
    ranked = materialize(linked.select(F.col(name).alias("row"), "group_id").join(ids, "row"))
    first = ranked.groupBy("group_id").agg(F.min("rank")["row"].alias("first"))
    gone = ranked.join(first, "group_id").where(F.col("row") != F.col("first")).select(F.col("row").alias("gone_row"))
    return rows.join(gone, F.col(name) == F.col("gone_row"), "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that contain a benchmark item, whatever their id. Null texts and texts without words stay; an empty table stays empty."""
    rows, name = _rows(docs)
    found = containment.contained_items(rows, llm.read(spark, sf_dir, "benchmark"), id_column=name).select(F.col(name).alias("gone_row")).distinct()
    return rows.join(found, F.col(name) == F.col("gone_row"), "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document is encoded and decoded; one row of digests each. ``sentencepiece_codec.encode_decode`` gives the ids and texts themselves.

    Repeated rows and null ids have rows of their own, a null text that of an empty one; an empty table gives no rows; other columns are ignored.
    """
    return llm.token_digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", languages), ("line dedup", lines), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("tokens", tokens)
]

#: SQL expresses neither the language filter of the first stage nor the encoding of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. Each result but the last is written to the shared folder and read again."""
    docs = llm.read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
