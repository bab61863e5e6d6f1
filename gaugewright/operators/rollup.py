"""Table-level roll-ups of column profiles, issues and duplicates.

Inputs are already one row per column, so these are all small. ``profiles`` may be anything that has
the columns a roll-up reads: for missing cells and duplicates the result of ``completeness`` will do,
for category counts that of ``semantic_category``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import percent
from .imputation import BY_MODE


def _issue_counts(issues: DataFrame) -> DataFrame:
    return issues.agg(
        F.count_if(F.col("severity") != "INFO").alias("inconsistencies"),
        F.count_if(F.col("severity") == "INFO").alias("potential_anomalies"),
    )


def table_summary(profiles: DataFrame, issues: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Rows, columns, missing cells, duplicates, issues and anomalies of a table."""
    cells = profiles.agg(
        F.max("total_rows").alias("total_rows"),
        F.count(F.lit(1)).alias("total_columns"),
        F.sum("missing_count").alias("missing_cells"),
        F.sum("total_rows").alias("cells"),
    )
    # One row each, so the cross joins stay one row.
    return (
        cells.crossJoin(duplicates)
        .crossJoin(_issue_counts(issues))
        .select(
            "total_rows", "total_columns", "missing_cells",
            percent(F.col("missing_cells"), F.col("cells")).alias("missing_percentage"),
            F.col("duplicate_extra_record_count").alias("duplicate_extra_records"),
            F.col("duplicate_group_count").alias("duplicate_groups"),
            percent(F.col("duplicate_extra_record_count"), F.col("total_rows")).alias("duplicate_percentage"),
            "inconsistencies", "potential_anomalies",
        )
    )


def missing_by_column(profiles: DataFrame) -> DataFrame:
    return profiles.select("column_name", "missing_percentage", "missing_count")


def quality_overview(profiles: DataFrame, issues: DataFrame) -> DataFrame:
    """Complete and missing cells, issues and anomalies, one labelled row each."""
    cells = profiles.agg(F.sum("total_rows").alias("cells"), F.sum("missing_count").alias("missing"))
    one_row = cells.crossJoin(_issue_counts(issues))
    return one_row.select(
        F.inline(
            F.array(
                _labelled("Complete Data Cells", F.greatest(F.lit(0), F.col("cells") - F.col("missing"))),
                _labelled("Missing Cells", F.col("missing")),
                _labelled("Confirmed Inconsistencies", F.col("inconsistencies")),
                _labelled("Potential Anomalies", F.col("potential_anomalies")),
            )
        )
    )


def _labelled(label: str, value) -> Column:
    return F.struct(F.lit(label).alias("label"), value.cast("bigint").alias("value"))


def unique_vs_duplicate(profiles: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Rows without a copy before them, and the other rows."""
    rows = profiles.agg(F.max("total_rows").alias("total_rows")).crossJoin(duplicates)
    extra = F.col("duplicate_extra_record_count")
    return rows.select(
        F.inline(
            F.array(
                _labelled("Unique Records", F.greatest(F.lit(0), F.col("total_rows") - extra)),
                _labelled("Duplicate Extra Records", extra),
            )
        )
    )


def category_counts(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("category").agg(F.count(F.lit(1)).alias("column_count"))


def numeric_summary(profiles: DataFrame) -> DataFrame:
    return profiles.filter(F.col("statistics").isNotNull() | F.col("category").startswith("NUMERICAL")).select(
        "column_name", *[F.col(f"statistics.{s}").alias(s) for s in ("mean", "median", "stddev", "min", "max")]
    )


def categorical_summary(profiles: DataFrame, columns: int = 5, values: int = 5) -> DataFrame:
    """Top values of the first categorical columns."""
    first = Window.partitionBy(F.lit(1)).orderBy("position")  # one row per column of the table
    picked = (
        profiles.filter(F.col("category").isin(BY_MODE))
        .withColumn("nth", F.row_number().over(first))
        .filter(F.col("nth") <= columns)
    )
    return picked.select("column_name", F.posexplode(F.slice("distribution", 1, values)).alias("rank", "v")).select(
        "column_name", (F.col("rank") + 1).alias("rank"), F.col("v.value").alias("value"), F.col("v.count").alias("count")
    )


def imputation_table(recommended: DataFrame) -> DataFrame:
    return recommended.select("column_name", "missing_count", "missing_percentage", "recommended_method", "reason")


def dataset_summary(recommended: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: columns with missing values, missing cells, column lists ('NONE' where empty)."""

    def listed(df: DataFrame, alias: str, count_alias: str | None = None) -> DataFrame:
        # At most one entry per column of the table.
        names = F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("position", "column_name"))), lambda s: s["column_name"]), ", ")
        out = [F.when(F.count(F.lit(1)) > 0, names).otherwise(F.lit("NONE")).alias(alias)]
        if count_alias:
            out.append(F.count_distinct("column_name").alias(count_alias))
        return df.agg(*out)

    totals = recommended.agg(
        F.count_if(F.col("missing_count") > 0).alias("columns_with_missing"),
        F.sum("missing_count").alias("total_missing_cells"),
    )
    dates = recommended.filter(F.col("category").isin("DATE", "TIMESTAMP") & (F.col("missing_count") > 0))
    return (
        totals.crossJoin(listed(recommended, "columns"))
        .crossJoin(listed(recommended.filter(F.col("category") == "COMPLEX"), "skipped_columns"))
        .crossJoin(listed(dates, "date_warning_columns"))
        .crossJoin(listed(issues.filter(F.col("severity") != "INFO"), "inconsistent_columns", "inconsistent_count"))
        .crossJoin(listed(issues.filter(F.col("severity") == "INFO"), "anomaly_columns", "anomaly_count"))
    )


def distribution_rows(profiles: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Long table of top values of categorical columns."""
    return (
        profiles.filter(F.col("category").isin(categories or BY_MODE))
        .select("column_name", "category", F.explode("distribution").alias("v"))
        .select("column_name", "category", "v.value", "v.count", "v.percentage")
    )


def run_totals(runs: DataFrame) -> DataFrame:
    """Tables profiled and failed in a run log; a table that succeeded in a later run counts as profiled."""
    tables = runs.groupBy("table_key", "version", "row_limit").agg(F.bool_or(F.col("error").isNull()).alias("done"))
    return tables.agg(
        F.count_if("done").alias("tables_profiled"), F.count_if(~F.col("done")).alias("tables_failed")
    )
