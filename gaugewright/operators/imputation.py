"""Recommending and applying imputation."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_HALF_EVEN, Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import fixed_values as V
from ..plans.materialize import materialize
from .profile import LONGEST_VALUE, full_profile
from .semantics import kind_of, named, normalize_missing, present

NUMERIC = ["NUMERICAL_DISCRETE", "NUMERICAL_CONTINUOUS"]
BY_MODE = ["CATEGORICAL_NOMINAL", "CATEGORICAL_ORDINAL", "BOOLEAN"]
DATES = ["DATE", "TIMESTAMP"]
SKEW_LIMIT = 1.0


def recommend(profiles: DataFrame, bulk: bool = False) -> DataFrame:
    """Add the recommended method and its reason to column profiles.

    With ``bulk``, date columns with missing values get no method: a person has to choose one.
    """
    skew = F.abs(F.coalesce(F.col("statistics.skewness"), F.lit(0.0)))
    numeric, by_mode = F.col("category").isin(NUMERIC), F.col("category").isin(BY_MODE)
    complete = F.col("missing_count") == 0
    method = F.when(complete, F.lit(V.METHOD_NONE))
    reason = F.when(complete, F.lit(V.REASON_NONE))
    if bulk:
        method = method.when(F.col("category").isin(DATES), F.lit(V.METHOD_DATE))
        reason = reason.when(F.col("category").isin(DATES), F.lit(None).cast("string"))
    method = (
        method.when(numeric & (skew > SKEW_LIMIT), F.lit(V.METHOD_MEDIAN))
        .when(numeric, F.lit(V.METHOD_MEAN))
        .when(by_mode, F.lit(V.METHOD_MODE))
        .otherwise(F.lit(V.METHOD_CONSTANT))
    )
    reason = (
        reason.when(numeric & (skew > SKEW_LIMIT), F.format_string(V.REASON_MEDIAN, skew))
        .when(numeric, F.lit(V.REASON_MEAN))
        .when(by_mode, F.lit(V.REASON_MODE))
        .otherwise(F.lit(V.REASON_CONSTANT))
    )
    return profiles.withColumns({"recommended_method": method, "reason": reason})


def mode_value(df: DataFrame, column: str) -> Any:
    """Most frequent filled value of a column (the smallest on ties), whole, however long.

    Long texts are counted by their digest, and the winner's text is read afterwards.
    """
    kind = kind_of(df.schema[column].dataType)
    value = df.select(present(column, kind).alias("value")).filter(F.col("value").isNotNull())
    is_long = F.length("value") > LONGEST_VALUE if kind == "string" else F.lit(False)
    digest = F.when(is_long, F.sha2("value", 256)) if kind == "string" else F.lit(None).cast("string")
    counted = (
        value.select(F.when(~is_long, F.col("value")).alias("short"), digest.alias("digest"))
        .groupBy("short", "digest")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    best = counted.orderBy(F.desc("count"), F.col("short").asc_nulls_last(), "digest").first()
    if best is None:
        return None
    if best["digest"] is None:
        return best["short"]
    return value.filter(is_long & (digest == best["digest"])).first()["value"]


def _in_type(number: float, dtype: T.DataType) -> Column:
    """A number as a literal of a column's type, rounded half to even where the type asks for it."""
    if isinstance(dtype, (T.IntegralType, T.DecimalType)):
        places = dtype.scale if isinstance(dtype, T.DecimalType) else 0
        exact = Decimal(repr(number)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_EVEN)
        return F.lit(str(exact)).cast(dtype)
    return F.lit(number).cast(dtype)


def apply_imputation(
    df: DataFrame,
    columns: list[str],
    methods: dict[str, str] | None = None,
    constants: dict[str, Any] | None = None,
    flag: bool = False,
) -> DataFrame:
    """Fill the missing values of ``columns``.

    A method is mean, median, mode or constant; where none is given, the recommended one applies.
    A fill value is one literal per column, so nothing is joined. A column keeps its type: a mean or
    median is unrounded in a column of floats, and in whole numbers and decimals rounded half to even
    to what the type can hold. Values that are not missing stay exactly as they are. A column without
    any value has no mean, median or mode: it takes its constant where one is given and stays empty otherwise.
    """
    clean = normalize_missing(df)
    stats = {
        r["column_name"]: r
        for r in recommend(full_profile(clean.select([F.col(named(c)) for c in columns])))
        .select("column_name", "missing_count", "non_null_count", "recommended_method", "raw")
        .collect()
    }
    fills: dict[str, Column] = {}
    for name in columns:
        found = stats[name]
        method = (methods or {}).get(name) or {
            V.METHOD_MEAN: "mean", V.METHOD_MEDIAN: "median", V.METHOD_MODE: "mode", V.METHOD_CONSTANT: "constant",
        }.get(found["recommended_method"])
        if found["missing_count"] == 0 or method is None:
            continue
        dtype = df.schema[name].dataType
        value = present(name, kind_of(dtype))
        if found["non_null_count"] == 0 and method != "constant":
            if name not in (constants or {}):
                continue
            method = "constant"
        if method in ("mean", "median"):
            if found["raw"] is None:
                raise ValueError(f"column {name} has no {method}")
            fills[name] = F.coalesce(value, _in_type(found["raw"][method], dtype))
        elif method == "mode":
            fills[name] = F.coalesce(value, F.lit(mode_value(clean, name)).cast(dtype))
        elif name in (constants or {}):
            fills[name] = F.coalesce(value, F.lit(constants[name]).cast(dtype))
    out = [fills.get(c, F.col(named(c))).alias(c) for c in df.columns]
    if flag:
        out += [
            present(c, kind_of(df.schema[c].dataType)).isNull().alias(f"{c}_was_missing") for c in columns if c in fills
        ]
    return clean.select(out)


@dataclass(frozen=True)
class DateRule:
    """How to fill a date column: the smallest or largest date, a constant, or the last value before it."""

    method: str
    constant: Any = None
    partition_by: tuple[str, ...] = ()
    order_by: tuple[str, ...] = ()


def apply_date_rules(df: DataFrame, rules: dict[str, DateRule]) -> DataFrame:
    """Fill date columns by rule. Carrying a value forward needs a key to partition by."""
    extremes = [
        getattr(F, rule.method)(named(c)).alias(c) for c, rule in rules.items() if rule.method in ("min", "max")
    ]
    found = df.agg(*extremes).first().asDict() if extremes else {}
    out = df
    for name, rule in rules.items():
        c = F.col(named(name))
        if rule.method in ("min", "max"):
            fill = F.lit(found[name])
        elif rule.method == "constant":
            fill = F.lit(rule.constant)
        elif rule.method == "forward":
            if not (rule.partition_by and rule.order_by):
                raise ValueError("carrying values forward needs partition_by and order_by")
            out = carry_forward(out, name, rule.partition_by, rule.order_by)
            continue
        else:
            raise ValueError(f"unknown date rule {rule.method}")
        out = out.withColumn(name, F.coalesce(c, fill.cast(df.schema[name].dataType)))
    return out


CARRY_BUCKETS = 256


def carry_forward(df: DataFrame, column: str, keys: tuple[str, ...], order_by: tuple[str, ...]) -> DataFrame:
    """Fill missing values with the last one before them, per key in the given order; nulls come first.

    The table is dealt out by ranges of (keys, order) with sampled bounds, so a key that holds a
    large share of the rows is cut into several ranges, whatever the type or spread of its order.
    Values are carried within a range, and a key's last value of each range over to the ones after it.
    """
    by = [F.col(named(c)) for c in (*keys, *order_by)]
    # stored, since ranges are sampled anew by every job
    marked = materialize(
        df.repartitionByRange(CARRY_BUCKETS, *by).withColumn("__range", F.spark_partition_id())
    )
    value = F.col(named(column))
    group = [*[F.col(named(k)) for k in keys], F.col("__range")]
    order = [F.col(named(c)) for c in order_by]
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct(*order)
    lasts = marked.groupBy(*group).agg(F.max_by(value, F.when(value.isNotNull(), place)).alias("__last"))
    before = Window.partitionBy(*[F.col(named(k)) for k in keys]).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(
        *[F.col(named(k)).alias(f"__key_{i}") for i, k in enumerate(keys)], F.col("__range").alias("__at"),
        F.last("__last", ignorenulls=True).over(before).alias("__carried"),
    ).filter("__carried IS NOT NULL")
    same = F.col("__range") == F.col("__at")
    for i, k in enumerate(keys):
        same = same & F.col(named(k)).eqNullSafe(F.col(f"__key_{i}"))
    filled = marked.withColumn("__inside", F.last(value, ignorenulls=True).over(inside)).join(carried, same, "left")
    return filled.select(
        *[
            F.coalesce(value, "__inside", "__carried").alias(c) if c == column else F.col(named(c))
            for c in df.columns
        ]
    )
