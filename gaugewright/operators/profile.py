"""Column profiles: completeness, distinct values, statistics, value distributions.

Two jobs:

1. aggregates with the type evidence and the moments of every column (one row per column out);
2. the value histogram: (column, value) -> count. Rows are combined on the map side, so a value
   held by a third of all rows costs one record per task. Distinct counts, quartiles and top
   values all come from the histogram.

Long texts travel as their first characters plus a SHA-256 digest, so a record stays small
while the counts stay those of the whole texts.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import number_of, percent, plain_number, rounded
from .quantiles import RANGE, in_ranges, order_statistics
from .semantics import (
    ColumnEvidence,
    column_evidence,
    declared_columns,
    kind_of,
    named,
    normalize_missing,
    present,
    present_sql,
    quoted,
)

# Columns counted by one histogram.
COLUMNS_PER_HISTOGRAM = 32

LONGEST_VALUE, KEPT_CHARACTERS = 100, 97
TOP_VALUES = 10
QUARTILES = (0.25, 0.5, 0.75)

STATISTICS = [
    "min", "max", "mean", "median", "stddev", "variance", "q1", "q3", "iqr", "skewness", "kurtosis",
]
STATISTICS_TYPE = "struct<" + ",".join(f"`{s}`:double" for s in STATISTICS) + ">"
DISTRIBUTION_TYPE = "array<struct<value:string,count:bigint,percentage:double>>"
TYPE_LABELS = {
    "INTEGER": "LongType",
    "DECIMAL/CONTINUOUS_NUMERIC": "DoubleType",
    "BOOLEAN": "BooleanType",
    "DATE": "DateType",
    "TIMESTAMP": "TimestampType",
}


class EmptyTableError(ValueError):
    """The table holds no rows."""


def completeness(df: DataFrame) -> DataFrame:
    """Rows, filled and missing cells per column, from one aggregate."""
    fields = df.schema.fields
    counts = [
        F.count(present(f.name, kind_of(f.dataType))).alias(f"n_{i}") for i, f in enumerate(fields)
    ]
    one_row = df.agg(F.count(F.lit(1)).alias("total_rows"), *counts)
    per_column = F.explode(
        F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.col(f"n_{i}").alias("n")) for i, f in enumerate(fields)])
    )
    missing = F.col("total_rows") - F.col("c.n")
    return one_row.select("total_rows", per_column.alias("c")).select(
        F.col("c.column_name").alias("column_name"),
        "total_rows",
        F.col("c.n").alias("non_null_count"),
        missing.alias("missing_count"),
        percent(missing, F.col("total_rows")).alias("missing_percentage"),
    )


# Key columns of the histogram, by storage class of the profiled column.
KEYS = {
    "integer": ["int_value"],
    "float": ["double_value"],
    "numeric_text": ["double_value", "text_value", "text_digest"],
    "text": ["text_value", "text_digest"],
}
KEY_TYPES = {"int_value": "bigint", "double_value": "double", "text_value": "string", "text_digest": "binary"}


def _storage_class(e: ColumnEvidence) -> str:
    if e.kind in ("integer", "float"):
        return e.kind
    return "numeric_text" if e.kind == "decimal" or e.is_numeric_text else "text"


def _key_columns(e: ColumnEvidence, names: list[str]) -> list[str]:
    """SQL text of the key columns of one profiled column."""
    c = present_sql(e.name, e.kind)
    text = f"initcap(CAST({c} AS STRING))" if e.kind == "boolean" else f"CAST({c} AS STRING)"
    is_long = f"length({c}) > {LONGEST_VALUE}"
    made = {
        "int_value": c,
        "double_value": e.double_sql(),
        "text_value": f"CASE WHEN {is_long} THEN concat(left({c}, {KEPT_CHARACTERS}), '...') ELSE {c} END",
        "text_digest": f"CASE WHEN {is_long} THEN unhex(sha2({c}, 256)) END",
    }
    if e.kind != "string":
        made |= {"text_value": text, "text_digest": "NULL"}
    return [f"CAST({made[n]} AS {KEY_TYPES[n]})" for n in names]


@dataclass(frozen=True)
class Histogram:
    """(position, key columns, count) for every filled value of some columns of one storage class."""

    storage_class: str
    positions: list[int]
    counts: DataFrame

    @property
    def keys(self) -> list[str]:
        return KEYS[self.storage_class]


def histograms_of(df: DataFrame, evidence: list[ColumnEvidence], classes: list[str] | None = None) -> list[Histogram]:
    """The values of a table with their counts, a group of columns at a time; of some storage classes only if these are named.

    Each group reads only its columns, and its keys are no wider than its storage class needs.
    """
    found = []
    for storage_class in classes or KEYS:
        names = KEYS[storage_class]
        every = [e for e in evidence if e.kind != "complex" and _storage_class(e) == storage_class]
        for start in range(0, len(every), COLUMNS_PER_HISTOGRAM):
            members = every[start : start + COLUMNS_PER_HISTOGRAM]
            fields = ["position", *names]
            values = [x for e in members for x in (str(e.position), *_key_columns(e, names))]
            long = df.selectExpr(f"stack({len(members)}, {', '.join(values)}) AS ({', '.join(fields)})")
            counts = long.filter(F.col(names[0]).isNotNull()).groupBy(*fields).agg(F.count(F.lit(1)).alias("count"))
            found.append(Histogram(storage_class, [e.position for e in members], counts))
    return found


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def value_histogram(df: DataFrame) -> DataFrame:
    """(position, int_value, double_value, text_value, text_digest, count) for every filled value."""
    evidence, _ = column_evidence(df)
    return _union(
        [
            h.counts.select(
                "position",
                *[(F.col(n) if n in h.keys else F.lit(None).cast(t)).alias(n) for n, t in KEY_TYPES.items()],
                "count",
            )
            for h in histograms_of(df, evidence)
        ]
    )


def top_values(histograms: list[Histogram], k: int = TOP_VALUES) -> DataFrame:
    """The k most frequent values per column; ties go to the smaller value.

    The rank filter becomes a group limit before the shuffle, so each task sends at most k rows a column.
    """
    parts = []
    for h in histograms:
        text = {"integer": F.col(h.keys[0]).cast("string"), "float": plain_number(F.col(h.keys[0]))}
        order = Window.partitionBy("position").orderBy(F.desc("count"), *h.keys)
        parts.append(
            h.counts.withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= k)
            .select(
                "position", "rank", text.get(h.storage_class, F.col("text_value")).alias("value"), "count",
                (F.col("text_digest") if "text_digest" in h.keys else F.lit(None).cast("binary")).alias("digest"),
            )
        )
    return _union(parts)


def distinct_values(histograms: list[Histogram]) -> DataFrame:
    """(position, unique_count).

    Reading the counts, all positive, keeps them in the plan, so the histogram's shuffle is shared
    with the other results taken from it.
    """
    unique = F.count_if(F.col("count") > 0).alias("unique_count")
    return _union([h.counts.groupBy("position").agg(unique) for h in histograms])


def distribution(df: DataFrame, k: int = TOP_VALUES) -> DataFrame:
    """Long table of the top-k values of every column with their share of all rows."""
    clean = normalize_missing(df)
    evidence, _ = column_evidence(clean)
    names = df.sparkSession.createDataFrame(
        [(e.position, e.name, e.semantic_category, e.total) for e in evidence],
        "position int, column_name string, category string, total_rows bigint",
    )
    histograms = histograms_of(clean, evidence)
    if not histograms:
        return df.sparkSession.createDataFrame(
            [], "column_name string, category string, rank int, value string, count bigint, percentage double"
        )
    return (
        top_values(histograms, k)
        .join(F.broadcast(names), "position")
        .select(
            "column_name", "category", "rank", "value", "count",
            percent(F.col("count"), F.col("total_rows")).alias("percentage"),
        )
    )


def mode(df: DataFrame) -> DataFrame:
    """Most frequent value per column, whole, however long. Ties go to the smaller value.

    Long texts are counted by their digests; the winners' texts are read afterwards, all in one pass.
    """
    clean = normalize_missing(df)
    columns = declared_columns(clean)
    schema = "column_name string, mode string, count bigint"
    histograms = histograms_of(clean, columns)
    if not histograms:
        return df.sparkSession.createDataFrame([], schema)
    best = {r["position"]: r for r in top_values(histograms, 1).collect()}  # one row per column
    long = {i: bytes(r["digest"]) for i, r in best.items() if r["digest"] is not None}
    whole = {}
    if long:
        texts = []
        for i, digest in long.items():
            c = F.col(named(clean.columns[i]))
            texts.append(F.any_value(F.when(F.unhex(F.sha2(c, 256)) == F.lit(digest), c), True).alias(f"t{i}"))
        whole = clean.agg(*texts).first().asDict()
    rows = [(e.name, whole.get(f"t{e.position}", best[e.position]["value"]), best[e.position]["count"]) for e in columns if e.position in best]
    return df.sparkSession.createDataFrame(rows, schema)


def unique_counts(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct filled values per column: exact from the histogram, or sketched in one pass. NULL for complex columns."""
    clean = normalize_missing(df)
    spark = df.sparkSession
    if approximate:
        return profile(df, approximate=True).select("column_name", "unique_count")
    columns = declared_columns(clean)
    names = spark.createDataFrame(
        [(e.position, e.name, e.kind == "complex") for e in columns], "position int, column_name string, is_complex boolean"
    )
    histograms = histograms_of(clean, columns)
    if not histograms:
        return names.select("column_name", F.lit(None).cast("bigint").alias("unique_count"))
    counted = F.coalesce("unique_count", F.lit(0).cast("bigint"))
    return names.join(distinct_values(histograms), "position", "left").select(
        "column_name", F.when(~F.col("is_complex"), counted).alias("unique_count")
    )


# --- moments -----------------------------------------------------------------------------------------


def sample_skewness(population_skew: float | None, n: int) -> float:
    """Bias-corrected skewness from the population one; 0 where it is undefined."""
    if population_skew is None or n <= 2:
        return 0.0
    return population_skew * math.sqrt(n * (n - 1)) / (n - 2)


def sample_kurtosis(population_kurtosis: float | None, n: int) -> float:
    """Bias-corrected excess kurtosis from the population one; 0 where it is undefined."""
    if population_kurtosis is None or n <= 3:
        return 0.0
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * population_kurtosis + 6)


@dataclass(frozen=True)
class Moments:
    n: int
    min: float
    max: float
    mean: float
    variance: float
    skewness: float
    kurtosis: float


def _moments(values: dict, n: int) -> Moments | None:
    if n == 0:
        return None
    return Moments(
        n=n,
        min=values["low"],
        max=values["high"],
        mean=values["mean"],
        variance=values["variance"] if n > 1 else 0.0,
        skewness=sample_skewness(values.get("skew"), n),
        kurtosis=sample_kurtosis(values.get("kurt"), n),
    )


def scan(df: DataFrame) -> tuple[list[ColumnEvidence], dict[int, Moments]]:
    """First job: evidence and moments of every column. ``df`` has its missing tokens removed."""
    evidence, facts = column_evidence(df, moments=True)
    moments = {e.position: _moments(facts.get(e.position, {}), e.filled) for e in evidence if e.has_statistics}
    return evidence, {i: m for i, m in moments.items() if m is not None}


# --- quartiles ---------------------------------------------------------------------------------------


def _quartiles(
    histograms: list[Histogram], moments: dict[int, Moments]
) -> DataFrame | None:
    """(position, quartiles), exact and linearly interpolated, from histograms stored by ranges of value."""
    if not moments:
        return None
    ranks = []
    for i, m in moments.items():
        at = [(m.n - 1) * q for q in QUARTILES]
        ranks.append((i, [math.floor(x) for x in at], [math.ceil(x) for x in at], [x - math.floor(x) for x in at]))
    values = _union(
        [
            h.counts.filter(F.col("position").isin([i for i in h.positions if i in moments])).select(
                F.col("position").alias("key"), F.col(h.keys[0]).cast("double").alias("value"), "count", RANGE
            )
            for h in histograms
            if any(i in moments for i in h.positions)
        ]
    )
    picked = order_statistics(values, [(i, rank) for i, low, high, _ in ranks for rank in (*low, *high)])
    # six values per column at most
    by_rank = picked.groupBy(F.col("key").alias("position")).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    places = values.sparkSession.createDataFrame(ranks, "position int, low array<bigint>, high array<bigint>, part array<double>")
    low, high = (lambda i, side=side: F.element_at("at", F.get(side, F.lit(i))) for side in ("low", "high"))
    between = [low(i) + (high(i) - low(i)) * F.get("part", F.lit(i)) for i in range(len(QUARTILES))]
    return by_rank.join(F.broadcast(places), "position").select("position", F.array(*between).alias("quartiles"))


def profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: type, completeness, distinct values, statistics and top values.

    Exact by default. ``approximate`` reads the table once and takes distinct counts, quartiles and top values
    from sketches of fixed size (``sketches`` keeps and merges them); it shuffles no values. Statistics are doubles, rounded to four
    places for display; whole numbers beyond 2^53 lose their last digits in them.
    """
    return full_profile(df, approximate).drop("raw")


def full_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """``profile`` with a column ``raw`` of the statistics as they were computed, for further use."""
    if approximate:
        from . import sketches

        return sketches.profile_of(sketches.states(df))
    clean = normalize_missing(df)
    spark = df.sparkSession
    with ThreadPoolExecutor(max_workers=3) as pool:
        # histograms of integers and floats don't wait for the evidence: their columns follow from the schema
        early = [pool.submit(_ranged, h) for h in histograms_of(clean, declared_columns(clean), ["integer", "float"])]
        evidence, moments = scan(clean)
        if not evidence or evidence[0].total == 0:
            raise EmptyTableError("table contains no data rows")
        late = [pool.submit(_ranged, h) if any(i in moments for i in h.positions) else h for h in histograms_of(clean, evidence, ["numeric_text", "text"])]
        histograms = [h if isinstance(h, Histogram) else h.result() for h in (*early, *late)]

    result = spark.createDataFrame(
        [
            (
                e.position, e.name, type_label(e), e.physical_type, e.semantic_category, e.total, e.filled, e.missing,
                e.kind == "complex", *_moment_fields(moments.get(e.position)),
            )
            for e in evidence
        ],
        "position int, column_name string, spark_type string, physical_type string, category string, "
        "total_rows bigint, non_null_count bigint, missing_count bigint, is_complex boolean, "
        "min double, max double, mean double, variance double, skewness double, kurtosis double",
    )
    top = F.sort_array(F.collect_list(F.struct("rank", "value", "count"))).alias("top")
    # One row per column on every side.
    parts = {
        "unique_count": distinct_values(histograms) if histograms else None,
        "quartiles": _quartiles(histograms, moments),
        "top": top_values(histograms).groupBy("position").agg(top) if histograms else None,
    }
    types = {"unique_count": "bigint", "quartiles": "array<double>", "top": "array<struct<rank:int,value:string,count:bigint>>"}
    for name, part in parts.items():
        result = result.join(part, "position", "left") if part is not None else result.withColumn(name, F.lit(None).cast(types[name]))
    return result.select(*_profile_columns())


def _ranged(h: Histogram) -> Histogram:
    """A histogram of numbers, stored by ranges of value: its ranks are asked for besides its values."""
    return replace(h, counts=in_ranges(h.counts, "position", h.keys[0]))


def type_label(e: ColumnEvidence) -> str:
    return TYPE_LABELS.get(e.physical_type, "StringType")


def _moment_fields(m: Moments | None) -> tuple:
    return (m.min, m.max, m.mean, m.variance, m.skewness, m.kurtosis) if m else (None,) * 6


def _profile_columns() -> list[Column]:
    quartile = [F.get("quartiles", F.lit(i)) for i in range(3)]
    statistics = F.struct(
        F.col("min").alias("min"),
        F.col("max").alias("max"),
        rounded(F.col("mean"), 4).alias("mean"),
        rounded(quartile[1], 4).alias("median"),
        rounded(F.sqrt("variance"), 4).alias("stddev"),
        rounded(F.col("variance"), 4).alias("variance"),
        rounded(quartile[0], 4).alias("q1"),
        rounded(quartile[2], 4).alias("q3"),
        rounded(quartile[2] - quartile[0], 4).alias("iqr"),
        rounded(F.col("skewness"), 4).alias("skewness"),
        rounded(F.col("kurtosis"), 4).alias("kurtosis"),
    )
    share = percent(F.col("missing_count"), F.col("total_rows"))
    top = F.transform(
        F.coalesce("top", F.array().cast("array<struct<rank:int,value:string,count:bigint>>")),
        lambda t: F.struct(
            t["value"].alias("value"),
            t["count"].alias("count"),
            percent(t["count"], F.col("total_rows")).alias("percentage"),
        ),
    )
    raw = F.struct(
        F.col("mean").alias("mean"), quartile[1].alias("median"), quartile[0].alias("q1"), quartile[2].alias("q3"),
        F.col("skewness").alias("skewness"),
    )
    return [
        F.col("position"), F.col("column_name"), F.col("spark_type"), F.col("physical_type"), F.col("category"),
        F.col("total_rows"), F.col("non_null_count"), F.col("missing_count"),
        share.alias("missing_percentage"),
        F.when(~F.col("is_complex"), F.coalesce("unique_count", F.lit(0).cast("bigint"))).alias("unique_count"),
        F.when(F.col("mean").isNotNull(), statistics).alias("statistics"),
        top.alias("distribution"),
        F.when(F.col("mean").isNotNull(), raw).alias("raw"),
    ]


def numeric_stats(df: DataFrame) -> DataFrame:
    """The statistics of the numeric columns, one column each."""
    return (
        profile(df)
        .filter(F.col("statistics").isNotNull())
        .select("column_name", *[F.col(f"statistics.{s}").alias(s) for s in STATISTICS])
    )


def shape(df: DataFrame) -> DataFrame:
    """Outliers outside 1.5 IQR of the quartiles, skew direction and severity, per numeric column.

    The fences, from unrounded quartiles, go back into a second aggregate as literals (two numbers per column).
    """
    clean = normalize_missing(df)
    stats = [
        r.asDict() | {"low": r["q1"] - 1.5 * (r["q3"] - r["q1"]), "high": r["q3"] + 1.5 * (r["q3"] - r["q1"])}
        for r in full_profile(df).filter("raw IS NOT NULL").select("position", "column_name", "raw.*").orderBy("position").collect()
    ]
    spark = df.sparkSession
    schema = (
        "column_name string, lower_fence double, upper_fence double, outlier_count bigint, "
        "skew_direction string, skew_severity string, shape string"
    )
    if not stats:
        return spark.createDataFrame([], schema)
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    counts = []
    for s in stats:
        c = quoted(s["column_name"])
        kind = kinds[s["column_name"]]
        x = number_of(c) if kind == "string" else present(s["column_name"], kind).cast("double")
        counts.append(F.count_if((x < s["low"]) | (x > s["high"])).alias(f"o_{s['position']}"))
    found = clean.agg(*counts).first().asDict()
    rows = []
    for s in stats:
        skew = round(s["skewness"], 4)
        size = abs(skew)
        rows.append(
            (
                s["column_name"],
                s["low"],
                s["high"],
                found[f"o_{s['position']}"],
                "right" if skew > 0 else "left" if skew < 0 else "none",
                "low" if size < 0.5 else "moderate" if size <= 1.0 else "high",
                "symmetric" if size < 0.5 else "right-skewed" if skew > 0 else "left-skewed",
            )
        )
    return spark.createDataFrame(rows, schema)
