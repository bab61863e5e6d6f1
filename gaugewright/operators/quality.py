"""Quality issues and duplicate records.

Issues are found on the raw table, before missing tokens are removed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.fixed_values import AUDIT_COLUMNS, ISSUE_TEXTS
from ..functions.text import BLANK_PATTERN, NUMBER_PATTERN, WHITE_SPACE_SQL, percent
from .semantics import aggregate, is_identifier_name, kind_of, named, normalize_missing, present, present_sql

EXAMPLES = 5
TESTS_PER_BRANCH = 8

_OUTER_SPACE = ", ".join(f"'{WHITE_SPACE_SQL[i:i + 6]}'" for i in range(0, len(WHITE_SPACE_SQL), 6))


@dataclass(frozen=True)
class IssueTest:
    """An issue a column can have, as SQL text."""

    position: int
    issue: str
    offends: str  # test on a row
    example: str  # offending value as text
    unless: str = "bool_or(false)"  # aggregate test that rules the issue out


def issue_tests(df: DataFrame) -> list[IssueTest]:
    """The issues to look for, from names and declared types."""
    tests = []
    for i, field in enumerate(df.schema.fields):
        c, kind = named(field.name), kind_of(field.dataType)
        if is_identifier_name(field.name):
            missing = f"({present_sql(field.name, kind)}) IS NULL"
            if kind == "string":
                missing += f" OR {c} RLIKE r'{BLANK_PATTERN}'"
            tests.append(IssueTest(i, "IDENTIFIER_NULL", missing, c if kind == "string" else "CAST(NULL AS STRING)"))
        if kind == "string":
            outer = f"substring({c}, 1, 1) IN ({_OUTER_SPACE}) OR right({c}, 1) IN ({_OUTER_SPACE})"
            tests.append(IssueTest(i, "LEADING_TRAILING_SPACES", outer, c))
            numeric = f"{c} RLIKE r'{NUMBER_PATTERN}'"
            stripped = f"btrim({c}, '{WHITE_SPACE_SQL}')"
            # Mixed only where some, not all, values are numeric.
            tests.append(IssueTest(i, "MIXED_NUMERIC_TEXT", numeric, stripped, f"count({c}) = count_if({numeric})"))
    return tests


_NO_ISSUES = (
    "position int, column_name string, issue_type string, severity string, affected_count bigint, "
    "affected_percentage double, message string, examples array<string>, recommendation string"
)


def _affected(df: DataFrame, tests: list[IssueTest]) -> dict[int, tuple[int, int]]:
    """(offending rows, all rows) per test that found an issue, from aggregates over the whole table."""
    branches = []
    for start in range(0, len(tests), TESTS_PER_BRANCH):
        members = list(enumerate(tests))[start : start + TESTS_PER_BRANCH]
        aggregates, structs = ["count(*) AS total"], []
        for k, t in members:
            aggregates += [f"count_if({t.offends}) AS n_{k}", f"{t.unless} AS x_{k}"]
            structs.append(f"struct({k} AS test, n_{k} AS affected, x_{k} AS excluded)")
        branches.append(aggregate(df, aggregates).selectExpr("total", f"inline(array({', '.join(structs)}))"))
    counts = reduce(DataFrame.unionByName, branches).filter("affected > 0 AND NOT coalesce(excluded, false)")
    return {r["test"]: (r["affected"], r["total"]) for r in counts.collect()}


def quality_issues(df: DataFrame) -> DataFrame:
    """One row per column and issue: blank identifiers, outer white space, numbers mixed with text.

    Counts come first, at most three per column. Examples are the smallest offending values; only
    columns with an issue are read for them, and a task sends at most five values per issue.
    """
    spark = df.sparkSession
    tests = issue_tests(df)
    affected = _affected(df, tests) if tests else {}
    if not affected:
        return spark.createDataFrame([], _NO_ISSUES)

    rows = []
    for k, (count, total) in affected.items():
        t = tests[k]
        severity, message, recommendation = ISSUE_TEXTS[t.issue]
        rows.append((k, t.position, df.columns[t.position], t.issue, severity, count, total, message, recommendation))
    issues = spark.createDataFrame(
        rows,
        "test int, position int, column_name string, issue_type string, severity string, affected_count bigint, "
        "total bigint, message string, recommendation string",
    )

    found = [(k, tests[k]) for k in affected]
    offenders = ", ".join(
        f"CASE WHEN {t.offends} THEN struct({k} AS test, {t.example} AS value) END" for k, t in found
    )
    smallest = Window.partitionBy("test").orderBy("value")
    examples = (
        df.filter(" OR ".join(f"({t.offends})" for _, t in found))
        .selectExpr(f"inline(filter(array({offenders}), x -> x.value IS NOT NULL))")
        .withColumn("rank", F.row_number().over(smallest))
        .filter(F.col("rank") <= EXAMPLES)
        .groupBy("test")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]).alias("examples"))
    )
    return issues.join(examples, "test", "left").select(
        "position", "column_name", "issue_type", "severity", "affected_count",
        percent(F.col("affected_count"), F.col("total")).alias("affected_percentage"),
        "message", F.coalesce("examples", F.array(F.lit("NULL"))).alias("examples"), "recommendation",
    )


def identifier_null(df: DataFrame) -> DataFrame:
    """Identifier columns with NULL or blank values."""
    return _of_type(df, "IDENTIFIER_NULL")


def leading_trailing_spaces(df: DataFrame) -> DataFrame:
    """String columns with white space at either end of a value."""
    return _of_type(df, "LEADING_TRAILING_SPACES")


def mixed_numeric_text(df: DataFrame) -> DataFrame:
    """String columns in which some values are numbers and some are not."""
    return _of_type(df, "MIXED_NUMERIC_TEXT")


def _of_type(df: DataFrame, issue: str) -> DataFrame:
    needed = [f.name for f in df.schema.fields if kind_of(f.dataType) == "string" or is_identifier_name(f.name)]
    return quality_issues(df.select([F.col(named(n)) for n in needed])).filter(F.col("issue_type") == issue)


def affected_columns(issues: DataFrame) -> DataFrame:
    """Columns with confirmed issues and with potential anomalies."""
    kind = F.when(F.col("severity") == "INFO", F.lit("anomaly")).otherwise(F.lit("issue"))
    return issues.select("column_name", kind.alias("kind")).distinct()


def missing_report(df: DataFrame) -> DataFrame:
    """Missing cells and their share per column."""
    from .profile import completeness

    return completeness(df).select("column_name", "missing_count", "missing_percentage")


def duplicate_subset(columns: list[str]) -> tuple[list[str], list[str]]:
    """Columns compared for duplicates, and the audit columns left out (none if all are audit columns)."""
    audit = [c for c in columns if c.lower() in AUDIT_COLUMNS]
    subset = [c for c in columns if c not in audit] or list(columns)
    return subset, audit


_NESTED = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}
HASHES = ["__h1", "__h2"]


def _row_hashes(df: DataFrame) -> list[Column]:
    """128 bits that are equal when rows are: two hashes of the typed cells, each with the set of cells that are null.

    Nulls leave a hash as it is, so their places are hashed besides. Nested cells are hashed as JSON with whole microseconds.
    """
    cells = []
    for field in df.schema.fields:
        kind = kind_of(field.dataType)
        value = present(field.name, kind)
        cells.append(value + F.lit(0.0) if kind == "float" else F.to_json(F.struct(value.alias("c")), _NESTED) if kind == "complex" else value)
    nulls = F.concat(*[F.when(present(f.name, kind_of(f.dataType)).isNull(), F.lit("1")).otherwise(F.lit("0")) for f in df.schema.fields])
    return [F.xxhash64(F.lit(seed), nulls, *order).alias(name) for name, seed, order in zip(HASHES, (1, 2), (cells, cells[::-1]))]


def _group_sizes(df: DataFrame) -> DataFrame:
    """(hashes, row_count) of the rows that occur more than once; only the hashes are shuffled."""
    counts = df.select(*_row_hashes(df)).groupBy(*HASHES).agg(F.count(F.lit(1)).alias("row_count"))
    return counts.filter(F.col("row_count") > 1)


def duplicate_groups(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Groups of equal rows: ``group_key``, one whole row of the group, and ``row_count``. NULLs are equal.

    Sizes are counted over 128-bit hashes; the rows themselves are then read for the groups found.
    """
    subset = columns or duplicate_subset(df.columns)[0]
    clean = normalize_missing(df.select([F.col(named(c)) for c in subset]))
    shown = clean.select(*_row_hashes(clean), F.struct(*[present(f.name, kind_of(f.dataType)).alias(f.name) for f in clean.schema.fields]).alias("__row"))
    one = shown.join(_group_sizes(clean), HASHES).groupBy(*HASHES, "row_count").agg(F.first("__row").alias("__row"))
    key = F.concat(*[F.lpad(F.hex(h), 16, "0") for h in HASHES])
    return one.select(key.alias("group_key"), *[F.col("__row")[c].alias(c) for c in subset], "row_count")


def duplicates(df: DataFrame) -> DataFrame:
    """One row: number of groups of equal rows, rows beyond the first of each group, audit columns."""
    subset, audit = duplicate_subset(df.columns)
    return _group_sizes(normalize_missing(df.select([F.col(named(c)) for c in subset]))).agg(
        F.count(F.lit(1)).alias("duplicate_group_count"),
        F.coalesce(F.sum(F.col("row_count") - 1), F.lit(0)).cast("bigint").alias("duplicate_extra_record_count"),
        F.lit(", ".join(audit)).alias("audit_columns"),
    )
