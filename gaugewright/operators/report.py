"""All roll-ups of one table at once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import rollup as R
from .imputation import recommend
from .profile import profile
from .quality import affected_columns, duplicates, quality_issues


def _held(df: DataFrame) -> DataFrame:
    """The rows of a result with a few rows per column of the profiled table, computed once."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def table_report(df: DataFrame) -> dict[str, DataFrame]:
    """Profile, issues, duplicates and every roll-up of a table, by name.

    The table is read for the profile, the issues and the duplicates; roll-ups work on their results,
    which have one row per column, at most three per column, and one.
    """
    profiles = _held(recommend(profile(df)))
    issues = _held(quality_issues(df))
    copies = _held(duplicates(df))
    return {
        "profiles": profiles,
        "issues": issues,
        "duplicates": copies,
        "summary": R.table_summary(profiles, issues, copies),
        "missing_by_column": R.missing_by_column(profiles),
        "quality_overview": R.quality_overview(profiles, issues),
        "unique_vs_duplicate": R.unique_vs_duplicate(profiles, copies),
        "category_counts": R.category_counts(profiles),
        "numeric_summary": R.numeric_summary(profiles),
        "categorical_summary": R.categorical_summary(profiles),
        "imputation": R.imputation_table(profiles),
        "dataset_summary": R.dataset_summary(profiles, issues),
        "distribution": R.distribution_rows(profiles),
        "affected_columns": affected_columns(issues),
    }
