"""Mergeable profiles: what a part of a table adds to its profile, in rows of bounded size.

``states`` reads a part once and gives one row per column: counts, the rules that all values meet, the
moments as central sums, and sketches of the ranks (KLL), of the distinct values (HyperLogLog) and of
the frequent values. ``merge`` adds such rows up, so a table that grows by a day is profiled by reading
that day. ``profile_of`` turns rows into a profile.

Counts, types, smallest and largest values and moments are those of the whole table. Distinct counts
are within about 2 % (exact up to a few dozen values), quartiles within 0.2 % of the ranks, and top
values are exact while a column has fewer than three quarters of TRACKED values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from ..functions.text import plain_number
from .profile import KEPT_CHARACTERS, LONGEST_VALUE, QUARTILES, TOP_VALUES, EmptyTableError, _moment_fields, _moments, _profile_columns, type_label
from .semantics import EVIDENCE, MOMENTS, cells, evidence_of, kind_of, normalize_missing

#: Values followed by a frequent-value sketch, and the precision of the rank and distinct sketches.
TRACKED, RANK_K, DISTINCT_K = 10_000, 2_000, 14
KEYS = ["column_name", "kind"]
EXACT = {
    "position": "min(position)", "total": "sum(total)", "filled": "sum(filled)", "flags": "bit_and(flags)", "zero_one": "bool_and(zero_one)",
    "whole": "bool_and(whole)", "bits": "bit_or(bits)", "numbers": "sum(numbers)", "low": "min(low)", "high": "max(high)",
}
SKETCHES = {"ranks": "kll_merge_agg_double(ranks)", "items": "hll_union_agg(items)", "frequent": f"approx_top_k_combine(frequent, {TRACKED})"}


PART = "__part"
#: A day and a column as one number: the column in the low bits. No day is -2^31 - 1, which no date has.
CELL_KEY, COLUMN_BITS, NO_DAY = "__key", 20, -(1 << 31) - 1


def states(df: DataFrame, part: Column | None = None) -> DataFrame:
    """One row per column of a part of a table, from one scan. No rows, or no columns, give no rows.

    ``part`` (a day, a source) gives the states of every part in the same scan, with a column ``part``. Many parts are sorted
    before they are combined; parts that are dates are sorted as numbers, several times faster than texts.
    """
    clean = normalize_missing(df)
    kinds = [(i, f.name, kind_of(f.dataType)) for i, f in enumerate(clean.schema.fields)]
    names = df.sparkSession.createDataFrame(kinds, "position int, column_name string, kind string")
    bits = EVIDENCE["bits"].removeprefix("bit_count(").removesuffix(")")
    made = EVIDENCE | MOMENTS | {
        "bits": bits, "numbers": "count(x)", "ranks": f"kll_sketch_agg_double(x, {RANK_K})",
        "items": f"hll_sketch_agg(xxhash64(item), {DISTINCT_K}) FILTER (WHERE item IS NOT NULL)",
        "frequent": f"approx_top_k_accumulate(item, {TRACKED}) FILTER (WHERE item IS NOT NULL)",
    }
    by = [PART] if part is not None else []
    # cells in order of their parts lie together when they are combined
    own = clean.withColumn(PART, part).sortWithinPartitions(PART) if by else clean
    every = cells(own, items=(LONGEST_VALUE, KEPT_CHARACTERS), part=PART if by else None)
    combined = [F.expr(a).alias(n) for n, a in made.items()]
    if by and isinstance(own.schema[PART].dataType, DateType) and len(kinds) < 1 << COLUMN_BITS:
        day, column = F.coalesce(F.unix_date(PART).cast("bigint"), F.lit(NO_DAY)), F.col(CELL_KEY).bitwiseAND(F.lit((1 << COLUMN_BITS) - 1))
        found = every.withColumn(CELL_KEY, F.shiftleft(day, COLUMN_BITS).bitwiseOR(F.col("position").cast("bigint"))).groupBy(CELL_KEY).agg(*combined)
        day = F.shiftright(CELL_KEY, COLUMN_BITS)
        found = found.withColumns({"position": column.cast("int"), PART: F.when(day != NO_DAY, F.date_from_unix_date(day.cast("int")))})
    else:
        found = every.groupBy(*by, "position").agg(*combined)
    n, spread = F.col("numbers"), F.col("variance") * (F.col("numbers") - 1)
    m2 = F.when(n > 1, spread).when(n == 1, 0.0)
    scaled = F.sqrt(m2 / n)
    out = found.join(F.broadcast(names), "position").withColumns(
        {"m2": m2, "m3": F.coalesce("skew", F.when(n > 0, 0.0)) * n * scaled**3, "m4": F.coalesce(F.col("kurt") + 3.0, F.when(n > 0, 0.0)) * n * scaled**4}
    )
    return out.select(*[F.col(PART).alias("part") for _ in by], *KEYS, *EXACT, "mean", "m2", "m3", "m4", *SKETCHES)


def merge(*parts: DataFrame) -> DataFrame:
    """The states of all parts together. Columns are matched by name and storage class.

    The mean comes first; the central sums of each part are then moved to it, so that no large squares cancel out.
    """
    rows = reduce(DataFrame.unionByName, parts)
    means = rows.groupBy(*KEYS).agg((F.sum(F.col("numbers") * F.col("mean")) / F.sum("numbers")).alias("__mean"))
    n, off = F.col("numbers"), F.col("mean") - F.col("__mean")
    m2, m3, m4 = F.col("m2"), F.col("m3"), F.col("m4")
    moved = {
        "m2": m2 + n * off**2, "m3": m3 + 3.0 * off * m2 + n * off**3, "m4": m4 + 4.0 * off * m3 + 6.0 * off**2 * m2 + n * off**4,
    }
    sums = [F.sum(c).alias(name) for name, c in moved.items()]
    exact, sketched = ([F.expr(a).alias(name) for name, a in made.items()] for made in (EXACT, SKETCHES))
    # a row per part and column on one side, a row per column on the other
    merged = rows.join(means, KEYS).groupBy(*KEYS, F.col("__mean").alias("mean")).agg(*exact, *sums, *sketched)
    return merged.select(*KEYS, *EXACT, "mean", "m2", "m3", "m4", *SKETCHES)


def profile_of(state: DataFrame) -> DataFrame:
    """The profile that states stand for: the columns of ``profile``, unique counts, quartiles and top values estimated."""
    spark = state.sparkSession
    numbers = F.col("numbers")
    estimates = {
        "unique_count": F.expr("hll_sketch_estimate(items)"), "bit_count": F.bit_count("bits"),
        "quartiles": F.when(numbers > 0, F.expr(f"kll_sketch_get_quantile_double(ranks, array({', '.join(f'{q}D' for q in QUARTILES)}))")),
        "top": _top(F.col("kind")),
        "variance": F.when(numbers > 1, F.col("m2") / (numbers - 1)),
        "skew": F.when(F.col("m2") > 0, F.sqrt(numbers.cast("double")) * F.col("m3") / F.col("m2") ** 1.5),
        "kurt": F.when(F.col("m2") > 0, numbers * F.col("m4") / F.col("m2") ** 2 - 3.0),
    }
    rows = [r.asDict() for r in state.withColumns(estimates).drop(*SKETCHES, "bits").orderBy("position").collect()]  # one per column, without sketches
    if not rows or not rows[0]["total"]:
        raise EmptyTableError("table contains no data rows")
    made = []
    for r in rows:
        few = r["unique_count"] if r["bit_count"] is not None and r["bit_count"] <= 10 else None
        e = evidence_of(r["position"], r["column_name"], r["kind"], r, few if r["kind"] in ("decimal", "float", "string") else None)
        m = _moments(r, e.filled) if e.has_statistics else None
        made.append(
            (
                e.position, e.name, type_label(e), e.physical_type, e.semantic_category, e.total, e.filled, e.missing, e.kind == "complex", *_moment_fields(m),
                r["unique_count"], r["quartiles"] if m else None, r["top"],
            )
        )
    schema = (
        "position int, column_name string, spark_type string, physical_type string, category string, total_rows bigint, non_null_count bigint, "
        "missing_count bigint, is_complex boolean, min double, max double, mean double, variance double, skewness double, kurtosis double, "
        "unique_count bigint, quartiles array<double>, top array<struct<rank:int,value:string,count:bigint>>"
    )
    return spark.createDataFrame(made, schema).select(*_profile_columns())


def _top(kind: Column) -> Column:
    """(rank, value, count) of the most frequent values, ties by value; the digest at the end of a shortened text goes."""
    found = F.expr(f"approx_top_k_estimate(frequent, {TOP_VALUES})")
    shown = lambda v: F.when(kind == "float", plain_number(v.cast("double"))).otherwise(F.left(v, F.lit(LONGEST_VALUE)))
    ordered = F.sort_array(F.transform(found, lambda t: F.struct((-t["count"]).alias("n"), shown(t["item"]).alias("value"))))
    return F.transform(ordered, lambda t, i: F.struct((i + 1).cast("int").alias("rank"), t["value"].alias("value"), (-t["n"]).alias("count")))


def add_part(df: DataFrame, folder: str, table: str, part: str) -> None:
    """Stores the states of a part of a table; a part that is given again replaces its own."""
    states(df).coalesce(1).write.mode("overwrite").parquet(f"{folder}/states/table={table}/part={part}")


def stored_profile(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The profile of all stored parts of a table, without reading the table."""
    return profile_of(merge(spark.read.parquet(f"{folder}/states/table={table}").drop("part")))
