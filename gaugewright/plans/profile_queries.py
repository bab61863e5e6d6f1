"""Queries of the profiler: typing, quality, statistics, imputation and roll-ups."""

from __future__ import annotations

import uuid
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed_values import (
    BOOLEAN_WORDS,
    DATE_FORMS,
    DATETIME_FORMS,
    MISSING_TOKENS,
    NUMBER_FORMS,
    ORDINAL_WORDS,
    WHITE_SPACE,
)
from ..functions.text import rounded
from ..operators import imputation as I
from ..operators import profile as P
from ..operators import quality as Q
from ..operators import rollup as R
from ..operators import semantics as S
from ..operators import sketches as K
from ..sources.bulk import TableKey, cached_profile, collect_all, profile_many
from ..sources.readers import read_file, read_table
from ..sources.writers import write_output
from .facts import VIEWS, derived, source
from .materialize import materialize, shared_folder
from .registry import pct, query, rnd

SPACE_SQL = "(" + " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE) + ")"
TOKENS_SQL = "(" + ", ".join(f"'{t}'" for t in MISSING_TOKENS) + ")"

LINEITEM_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]
LINEITEM = [*LINEITEM_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]
ORDERS_MISSING = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate"]
ORDERS_TEXT = {"o_orderstatus", "o_orderpriority"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return derived(spark, folder, name) if name in VIEWS else source(spark, folder, name)


def clean(column: str, is_text: bool) -> str:
    """SQL text of a column with missing tokens removed."""
    return f"CASE WHEN {column} IN {TOKENS_SQL} THEN NULL ELSE {column} END" if is_text else column


def union_of(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


# --- completeness, distinct values, statistics --------------------------------------------------------


def _completeness_sql(name: str, columns: list[str], text: set[str]) -> str:
    return union_of(
        [
            f"SELECT '{c}' AS column_name, count(*) AS total_rows, count({clean(c, c in text)}) AS non_null_count,"
            f" count(*) - count({clean(c, c in text)}) AS missing_count,"
            f" {pct(f'count(*) - count({clean(c, c in text)})', 'count(*)')} AS missing_percentage FROM {name}"
            for c in columns
        ]
    )


@query("profile_completeness", "D1", _completeness_sql("orders_missing", ORDERS_MISSING, ORDERS_TEXT))
def profile_completeness(spark, folder):
    return P.completeness(S.normalize_missing(table(spark, folder, "orders_missing")))


@query("impute_check", "C7", union_of([
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count, {pct(f'count(*) - count({c})', 'count(*)')} AS missing_percentage FROM labelled_documents"
    for c in ["lang", "source", "n_chars", "quality", "toxic"]
]))
def impute_check(spark, folder):
    return Q.missing_report(table(spark, folder, "labelled_documents"))


@query("profile_unique", "D2", union_of([
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS unique_count FROM lineitem" for c in LINEITEM
]))
def profile_unique(spark, folder):
    return P.unique_counts(source(spark, folder, "lineitem"))


def _stats_sql(name: str, columns: list[str]) -> str:
    def q(c: str, p: float) -> str:
        return f"quantile_cont(CAST({c} AS DOUBLE), {p})"

    return union_of(
        [
            f"SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,"
            f" {rnd(f'avg(CAST({c} AS DOUBLE))', 4)} AS mean, {rnd(q(c, 0.5), 4)} AS median,"
            f" {rnd(f'coalesce(stddev_samp({c}), 0)', 4)} AS stddev, {rnd(q(c, 0.25), 4)} AS q1, {rnd(q(c, 0.75), 4)} AS q3,"
            f" {rnd(f'{q(c, 0.75)} - {q(c, 0.25)}', 4)} AS iqr FROM {name}"
            for c in columns
        ]
    )


STATS_SHOWN = ["column_name", "min", "max", "mean", "median", "stddev", "q1", "q3", "iqr"]


@query("profile_numeric_stats", "D3 D5 D6", _stats_sql("lineitem", LINEITEM_NUMBERS))
def profile_numeric_stats(spark, folder):
    return P.numeric_stats(source(spark, folder, "lineitem")).select(STATS_SHOWN)


@query("profile_numeric_stats_missing", "B1 D3", _stats_sql("orders_missing", ["o_orderkey", "o_totalprice"]))
def profile_numeric_stats_missing(spark, folder):
    return P.numeric_stats(table(spark, folder, "orders_missing")).select(STATS_SHOWN)


@query("profile_shape", "D3 D3a", union_of([
    f"SELECT '{c}' AS column_name, {rnd(f'coalesce(var_samp({c}), 0)', 4)} AS variance, {rnd(f'coalesce(skewness({c}), 0)', 4)} AS skewness,"
    f" {rnd(f'coalesce(kurtosis({c}), 0)', 4)} AS kurtosis FROM {t}"
    for t, c in [("lineitem", "l_linenumber"), ("lineitem", "l_quantity"), ("lineitem", "l_discount"), ("lineitem", "l_tax"), ("part", "p_size"), ("part", "p_retailprice")]
]))
def profile_shape(spark, folder):
    shown = ["column_name", "variance", "skewness", "kurtosis"]
    lines = source(spark, folder, "lineitem").select("l_linenumber", "l_quantity", "l_discount", "l_tax")
    parts = source(spark, folder, "part").select("p_size", "p_retailprice")
    return P.numeric_stats(lines).select(shown).unionByName(P.numeric_stats(parts).select(shown))


_MERGED = {"l_linenumber": True, "l_quantity": True, "l_discount": True, "l_tax": True, "l_returnflag": False, "l_linestatus": False}


def _merged_sql() -> str:
    """The whole table's figures, which the parts' states must add up to."""
    parts = []
    for c, number in _MERGED.items():
        figures = f"min({c}) AS min, max({c}) AS max, {rnd(f'avg({c})', 4)} AS mean, {rnd(f'var_samp({c})', 4)} AS variance, {rnd(f'skewness({c})', 4)} AS skewness, {rnd(f'kurtosis({c})', 4)} AS kurtosis"
        none = ", ".join(f"NULL AS {f}" for f in ("min", "max", "mean", "variance", "skewness", "kurtosis"))
        most = f"(SELECT count(*) FROM lineitem GROUP BY {c} ORDER BY 1 DESC LIMIT 1)"
        parts.append(f"SELECT '{c}' AS column_name, count(*) AS total_rows, count({c}) AS non_null_count, count(DISTINCT {c}) AS unique_count, {most} AS top_count, {figures if number else none} FROM lineitem")
    return union_of(parts)


@query("profile_merged", "A7 D2 D3 D4", _merged_sql())
def profile_merged(spark, folder):
    """The profile of lineitem from the states of its months, merged: one scan, and no table row is read twice."""
    lines = source(spark, folder, "lineitem")
    # stored, since merging reads the states twice: for the means, then for the rest
    months = materialize(K.states(lines.select(*_MERGED, "l_shipdate"), F.trunc("l_shipdate", "month")).drop("part"))
    found = K.profile_of(K.merge(months)).filter(F.col("column_name").isin(list(_MERGED)))
    figures = [F.col(f"statistics.{f}").alias(f) for f in ("min", "max", "mean", "variance", "skewness", "kurtosis")]
    return found.select("column_name", "total_rows", "non_null_count", "unique_count", F.col("distribution")[0]["count"].alias("top_count"), *figures)


def _outlier_sql(name: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        q1, q3 = (f"quantile_cont(CAST({c} AS DOUBLE), {p})" for p in (0.25, 0.75))
        fences = f"SELECT {q1} - 1.5 * ({q3} - {q1}) AS low, {q3} + 1.5 * ({q3} - {q1}) AS high, {rnd(f'coalesce(skewness({c}), 0)', 4)} AS g FROM {name}"
        parts.append(
            f"SELECT '{c}' AS column_name, {rnd('max(low)', 12)} AS lower_fence, {rnd('max(high)', 12)} AS upper_fence, CAST(count(*) FILTER (WHERE {c} < low OR {c} > high) AS BIGINT) AS outlier_count,"
            f" max(CASE WHEN g > 0 THEN 'right' WHEN g < 0 THEN 'left' ELSE 'none' END) AS skew_direction,"
            f" max(CASE WHEN abs(g) < 0.5 THEN 'low' WHEN abs(g) <= 1.0 THEN 'moderate' ELSE 'high' END) AS skew_severity,"
            f" max(CASE WHEN abs(g) < 0.5 THEN 'symmetric' WHEN g > 0 THEN 'right-skewed' ELSE 'left-skewed' END) AS shape"
            f" FROM {name}, ({fences}) f"
        )
    return union_of(parts)


def _outliers(df: DataFrame) -> DataFrame:
    found = P.shape(df)
    return found.withColumns({c: rounded(F.col(c), 12) for c in ("lower_fence", "upper_fence")})


@query("profile_outliers", "D8", _outlier_sql("events", ["event_id", "user_id", "value"]))
def profile_outliers(spark, folder):
    return _outliers(source(spark, folder, "events"))


_SMALL = "(SELECT l_extendedprice / 1e6 AS price, l_quantity / 1e6 AS quantity FROM lineitem) t"


@query("profile_outliers_small", "D8", _outlier_sql(_SMALL, ["price", "quantity"]))
def profile_outliers_small(spark, folder):
    """Numbers far below the places shown."""
    return _outliers(source(spark, folder, "lineitem").select((F.col("l_extendedprice") / 1e6).alias("price"), (F.col("l_quantity") / 1e6).alias("quantity")))


# --- distributions ------------------------------------------------------------------------------------


def _distribution_sql(name: str, columns: dict[str, str], k: int = 10) -> str:
    """Top-k values; the value of a column is its text form, cut as shown, and the tie-break its own order."""
    parts = []
    for c, kind in columns.items():
        shown = f"CASE WHEN length({c}) > 100 THEN left({c}, 97) || '...' ELSE {c} END" if kind == "text" else f"CAST({c} AS VARCHAR)"
        tie = "value" if kind == "text" else "v"
        parts.append(
            f"SELECT * FROM (SELECT '{c}' AS column_name, CAST(row_number() OVER (ORDER BY n DESC, {tie}) AS INTEGER) AS rank, value, n AS count,"
            f" {pct('n', 'total')} AS percentage FROM (SELECT {c} AS v, {shown} AS value, count(*) AS n FROM {name} WHERE {c} IS NOT NULL GROUP BY {c}) g,"
            f" (SELECT count(*) AS total FROM {name}) t) r WHERE rank <= {k}"
        )
    return union_of(parts)


DISTRIBUTION = ["column_name", "rank", "value", "count", "percentage"]


@query("profile_distribution_top10", "D0 D4", _distribution_sql(
    "lineitem", {c: "text" if c in ("l_returnflag", "l_linestatus") else "time" if c == "l_shipdate" else "number" for c in LINEITEM}
))
def profile_distribution_top10(spark, folder):
    return P.distribution(source(spark, folder, "lineitem")).select(DISTRIBUTION)


@query("profile_distribution_text", "D4", _distribution_sql("documents", {"text": "text", "lang": "text", "source": "text", "n_chars": "number"}))
def profile_distribution_text(spark, folder):
    return P.distribution(source(spark, folder, "documents").drop("doc_id")).select(DISTRIBUTION)


_EVENT_MODES = _distribution_sql("events", {"event_id": "number", "ts": "time", "user_id": "number", "event_type": "text", "value": "number", "props": "text"}, 1)


@query("profile_mode", "D7", f"SELECT column_name, value AS mode, count FROM ({_EVENT_MODES}) m")
def profile_mode(spark, folder):
    return P.mode(source(spark, folder, "events"))


@query("profile_mode_long", "D7", "SELECT 'text' AS column_name, text AS mode, count(*) AS count FROM documents GROUP BY text ORDER BY count(*) DESC, CASE WHEN length(text) > 100 THEN left(text, 97) || '...' ELSE text END, sha256(text) LIMIT 1")
def profile_mode_long(spark, folder):
    """A mode of texts of any length is the whole text."""
    return P.mode(source(spark, folder, "documents").select("text"))


TYPED_TEXT = {"row_id": "number", "d": "text", "num": "text", "flag": "text", "tier": "text", "nominal": "text"}


@query("distribution_typed_strings", "B6 D4", _distribution_sql("typed_strings", TYPED_TEXT).replace("ORDER BY n DESC, value) AS INTEGER) AS rank, value, n AS count, (round_even(CAST(CAST(n AS DOUBLE) / CAST(greatest(total, 1) AS DOUBLE) * 100.0 AS DOUBLE) * 1e2, 0) / 1e2) AS percentage FROM (SELECT num AS v", "ORDER BY n DESC, TRY_CAST(value AS DOUBLE), value) AS INTEGER) AS rank, value, n AS count, (round_even(CAST(CAST(n AS DOUBLE) / CAST(greatest(total, 1) AS DOUBLE) * 100.0 AS DOUBLE) * 1e2, 0) / 1e2) AS percentage FROM (SELECT num AS v"))
def distribution_typed_strings(spark, folder):
    """Top values of a table with a text column of numbers."""
    return P.distribution(table(spark, folder, "typed_strings")).select(DISTRIBUTION)


@query("profile_typed_strings", "B6 D6", _stats_sql("(SELECT *, CAST(num AS DOUBLE) AS x FROM typed_strings) t", ["row_id", "x"]).replace("'x' AS column_name", "'num' AS column_name"))
def profile_typed_strings(spark, folder):
    return P.numeric_stats(table(spark, folder, "typed_strings")).select(STATS_SHOWN)


@query("profile_value_histogram", "D0", union_of([
    "SELECT 0 AS position, CAST(l_linenumber AS BIGINT) AS int_value, CAST(NULL AS DOUBLE) AS double_value, CAST(NULL AS VARCHAR) AS text_value, count(*) AS count FROM lineitem GROUP BY l_linenumber",
    "SELECT 1, NULL, l_tax, NULL, count(*) FROM lineitem GROUP BY l_tax",
    "SELECT 2, NULL, NULL, l_returnflag, count(*) FROM lineitem GROUP BY l_returnflag",
]))
def profile_value_histogram(spark, folder):
    df = source(spark, folder, "lineitem").select("l_linenumber", "l_tax", "l_returnflag")
    return P.value_histogram(df).drop("text_digest")


# --- typing -------------------------------------------------------------------------------------------

def _text_type_sql(name: str, c: str, is_identifier: bool) -> tuple[str, str]:
    """(physical type, category) expressions for a string column, from the type rules."""
    booleans = "(" + ", ".join(f"'{w}'" for w in BOOLEAN_WORDS) + ")"
    stripped = f"trim({c}, {SPACE_SQL})"

    def matches(forms: list[str], end: str) -> str:
        return f"bool_and(regexp_matches({stripped}, '^(?:{'|'.join(forms)}){end}'))"

    ordinal = " OR ".join(
        f"bool_and(lower({c}) IN (" + ", ".join(f"'{w}'" for w in words) + "))" for words in ORDINAL_WORDS.values()
    )
    number = f"bool_and(regexp_matches({stripped}, '^(?:{'|'.join(NUMBER_FORMS)})$'))"
    whole = f"bool_and(TRY_CAST({stripped} AS DOUBLE) % 1 = 0)"
    few = f"count(DISTINCT TRY_CAST({stripped} AS DOUBLE)) <= 10"
    head = "WHEN true THEN 'IDENTIFIER' " if is_identifier else ""
    category = (
        f"CASE {head}WHEN count({c}) = 0 THEN 'CATEGORICAL_NOMINAL' WHEN bool_and({c} IN {booleans}) THEN 'BOOLEAN'"
        f" WHEN {matches(DATE_FORMS, '$')} THEN 'DATE' WHEN {matches(DATETIME_FORMS, '')} THEN 'TIMESTAMP'"
        f" WHEN {number} AND {whole} AND {few} THEN 'NUMERICAL_DISCRETE' WHEN {number} THEN 'NUMERICAL_CONTINUOUS'"
        f" WHEN {ordinal} THEN 'CATEGORICAL_ORDINAL' ELSE 'CATEGORICAL_NOMINAL' END"
    )
    physical = (
        f"CASE WHEN {category} LIKE 'NUMERICAL%' AND {whole} THEN 'INTEGER'"
        f" WHEN {category} LIKE 'NUMERICAL%' THEN 'DECIMAL/CONTINUOUS_NUMERIC' ELSE 'STRING' END"
    )
    return physical, category


def _number_type_sql(c: str, declared: str, is_identifier: bool) -> tuple[str, str]:
    whole = "true" if declared == "integer" else f"coalesce(bool_and({c} % 1 = 0), false)"
    physical = f"CASE WHEN {whole} THEN 'INTEGER' ELSE 'DECIMAL/CONTINUOUS_NUMERIC' END"
    head = "WHEN true THEN 'IDENTIFIER' " if is_identifier else ""
    category = (
        f"CASE {head}WHEN bool_and({c} IN (0, 1)) THEN 'BOOLEAN' WHEN {whole} OR count(DISTINCT {c}) <= 10 THEN 'NUMERICAL_DISCRETE'"
        " ELSE 'NUMERICAL_CONTINUOUS' END"
    )
    return physical, category


def _column_type_sql(name: str, c: str, declared: str) -> tuple[str, str]:
    """(physical type, category) of a column given as a declared class, with '!' for names of identifiers."""
    is_identifier, declared = declared.startswith("!"), declared.lstrip("!")
    if declared == "text":
        return _text_type_sql(name, c, is_identifier)
    if declared == "time":
        return ("CASE WHEN count(*) >= 0 THEN 'TIMESTAMP' END",) * 2
    return _number_type_sql(c, declared, is_identifier)


def _types_sql(tables: dict[str, dict[str, str]]) -> str:
    """The types of all columns of some tables."""
    parts = []
    for name, columns in tables.items():
        for c, declared in columns.items():
            physical, category = _column_type_sql(name, c, declared)
            parts.append(f"SELECT '{name}' AS table_name, '{c}' AS column_name, {physical} AS physical_type, {category} AS category FROM {name}")
    return union_of(parts)


TYPED = {
    "typed_strings": {"row_id": "!integer", "d": "text", "num": "text", "flag": "text", "tier": "text", "nominal": "text"},
    "customer": {"c_custkey": "integer", "c_name": "text", "c_nationkey": "integer", "c_acctbal": "float", "c_mktsegment": "text"},
    "events": {"event_id": "!integer", "ts": "time", "user_id": "!integer", "event_type": "text", "value": "float", "props": "text"},
    "lineitem": {
        "l_orderkey": "integer", "l_partkey": "integer", "l_suppkey": "integer", "l_linenumber": "integer", "l_quantity": "float",
        "l_extendedprice": "float", "l_discount": "float", "l_tax": "float", "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "time",
    },
}


_LABELS = "CASE {0} WHEN 'INTEGER' THEN 'LongType' WHEN 'DECIMAL/CONTINUOUS_NUMERIC' THEN 'DoubleType' WHEN 'TIMESTAMP' THEN 'TimestampType' ELSE 'StringType' END"


def _profile_sql(name: str, columns: dict[str, str], figures: bool) -> str:
    """A whole profile, column by column."""
    parts = []
    for i, (c, declared) in enumerate(columns.items()):
        physical, category = _column_type_sql(name, c, declared)
        missing = f"count(*) - count({c})"
        shown = (
            f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column_name, {_LABELS.format(physical)} AS spark_type, {physical} AS physical_type,"
            f" {category} AS category, count(*) AS total_rows, count({c}) AS non_null_count, {missing} AS missing_count,"
            f" {pct(missing, 'count(*)')} AS missing_percentage, count(DISTINCT {c}) AS unique_count"
        )
        if figures:
            number = declared.lstrip("!") in ("integer", "float")
            mean = rnd(f"avg(CAST({c} AS DOUBLE))", 4) if number else "CAST(NULL AS DOUBLE)"
            median = rnd(f"quantile_cont(CAST({c} AS DOUBLE), 0.5)", 4) if number else "CAST(NULL AS DOUBLE)"
            shown += (
                f", {mean} AS mean, {median} AS median, (SELECT CAST({c} AS VARCHAR) FROM {name} GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode,"
                " 'None (Complete)' AS recommended_method"
            )
        parts.append(f"{shown} FROM {name}")
    return union_of(parts)


DOCUMENTS = {"doc_id": "!integer", "text": "text", "lang": "text", "source": "text", "n_chars": "integer"}


@query("profile_table", "D6 E1", _profile_sql("lineitem", TYPED["lineitem"], True))
def profile_table(spark, folder):
    """The whole profile of the largest table, flattened."""
    p = I.recommend(P.profile(source(spark, folder, "lineitem")))
    return p.select(
        "position", "column_name", "spark_type", "physical_type", "category", "total_rows", "non_null_count",
        "missing_count", "missing_percentage", "unique_count",
        F.col("statistics.mean").alias("mean"), F.col("statistics.median").alias("median"),
        F.get("distribution", F.lit(0))["value"].alias("mode"), "recommended_method",
    )


@query("profile_documents", "D6 B9", _profile_sql("documents", DOCUMENTS, False))
def profile_documents(spark, folder):
    return P.profile(source(spark, folder, "documents")).drop("statistics", "distribution")


@query("semantic_category", "B2 B3 B4 B5 B6 B7 B8 B9", _types_sql(TYPED))
def semantic_category(spark, folder):
    tables = {name: table(spark, folder, name) for name in TYPED}
    return S.semantic_categories(tables).drop("position")


@query("physical_type", "B3 D5", "SELECT column_name, CASE physical_type WHEN 'INTEGER' THEN 'LongType' WHEN 'DECIMAL/CONTINUOUS_NUMERIC' THEN 'DoubleType' WHEN 'TIMESTAMP' THEN 'TimestampType' ELSE 'StringType' END AS spark_type FROM ("
       + _types_sql({"lineitem": TYPED["lineitem"]}) + ") t")
def physical_type(spark, folder):
    return P.profile(source(spark, folder, "lineitem")).select("column_name", "spark_type")


@query("normalize_missing", "B1", f"SELECT o_orderkey, {clean('o_orderstatus', True)} AS o_orderstatus, o_totalprice, {clean('o_orderpriority', True)} AS o_orderpriority FROM orders_missing")
def normalize_missing(spark, folder):
    return S.normalize_missing(table(spark, folder, "orders_missing").drop("o_orderdate"))


# --- quality ------------------------------------------------------------------------------------------


def _issue(column: str, issue: str, severity: str, test: str, example: str) -> str:
    return (
        f"SELECT '{column}' AS column_name, '{issue}' AS issue_type, '{severity}' AS severity, n AS affected_count,"
        f" {pct('n', 'total')} AS affected_percentage,"
        f" coalesce((SELECT string_agg(e, '|' ORDER BY e) FROM (SELECT {example} AS e FROM dirty_customer WHERE {test} AND {example} IS NOT NULL ORDER BY e LIMIT 5) x), 'NULL') AS examples"
        f" FROM (SELECT count(*) FILTER (WHERE {test}) AS n, count(*) AS total FROM dirty_customer) c WHERE n > 0"
    )


_STRIP = {c: f"trim({c}, {SPACE_SQL})" for c in ("c_name", "mixed")}
_ID_SQL = _issue("cust_id", "IDENTIFIER_NULL", "ERROR", "cust_id IS NULL", "CAST(NULL AS VARCHAR)")
_SPACE_SQL = _issue("c_name", "LEADING_TRAILING_SPACES", "WARNING", f"c_name <> {_STRIP['c_name']}", "c_name")
_MIXED_SQL = _issue(
    "mixed", "MIXED_NUMERIC_TEXT", "INFO", f"regexp_matches({_STRIP['mixed']}, '^(?:{'|'.join(NUMBER_FORMS)})$')", _STRIP["mixed"]
)


def _shown(issues: DataFrame) -> DataFrame:
    return issues.select(
        "column_name", "issue_type", "severity", "affected_count", "affected_percentage",
        F.array_join("examples", "|").alias("examples"),
    )


@query("quality_identifier_null", "C1 C4", _ID_SQL)
def quality_identifier_null(spark, folder):
    return _shown(Q.identifier_null(table(spark, folder, "dirty_customer")))


@query("quality_spaces", "C2 C4", _SPACE_SQL)
def quality_spaces(spark, folder):
    return _shown(Q.leading_trailing_spaces(table(spark, folder, "dirty_customer")))


@query("quality_mixed_numeric", "C3 C4", _MIXED_SQL)
def quality_mixed_numeric(spark, folder):
    return _shown(Q.mixed_numeric_text(table(spark, folder, "dirty_customer")))


@query("quality_issues", "C1 C2 C3 C4", union_of([_ID_SQL, _SPACE_SQL, _MIXED_SQL]))
def quality_issues(spark, folder):
    return _shown(Q.quality_issues(table(spark, folder, "dirty_customer")))


@query("quality_affected_columns", "C6", f"SELECT column_name, CASE severity WHEN 'INFO' THEN 'anomaly' ELSE 'issue' END AS kind FROM ({union_of([_ID_SQL, _SPACE_SQL, _MIXED_SQL])}) i")
def quality_affected_columns(spark, folder):
    return Q.affected_columns(Q.quality_issues(table(spark, folder, "dirty_customer")))


_DOC_GROUPS = "SELECT text, lang, source, n_chars, count(*) AS row_count FROM documents GROUP BY text, lang, source, n_chars HAVING count(*) > 1"
_TEXT_GROUPS = "SELECT text, count(*) AS row_count FROM documents GROUP BY text HAVING count(*) > 1"


def _summary(groups: str, audit: str = "") -> str:
    return f"SELECT count(*) AS duplicate_group_count, CAST(coalesce(sum(row_count - 1), 0) AS BIGINT) AS duplicate_extra_record_count, '{audit}' AS audit_columns FROM ({groups}) g"


@query("duplicate_summary", "C5", _summary(_TEXT_GROUPS))
def duplicate_summary(spark, folder):
    return Q.duplicates(source(spark, folder, "documents").select("text"))


@query("duplicate_summary_rows", "C5", _summary(f"SELECT count(*) AS row_count FROM lineitem GROUP BY {', '.join(LINEITEM)} HAVING count(*) > 1"))
def duplicate_summary_rows(spark, folder):
    return Q.duplicates(source(spark, folder, "lineitem"))


@query("duplicate_summary_audit", "C5", _summary("SELECT count(*) AS row_count FROM typed_strings GROUP BY d, flag, tier, nominal HAVING count(*) > 1", "row_id"))
def duplicate_summary_audit(spark, folder):
    return Q.duplicates(table(spark, folder, "typed_strings").drop("num"))


@query("duplicate_groups", "C5", _TEXT_GROUPS)
def duplicate_groups(spark, folder):
    return Q.duplicate_groups(source(spark, folder, "documents"), ["text"]).drop("group_key")


@query("duplicate_groups_projection", "C5", "SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def duplicate_groups_projection(spark, folder):
    return Q.duplicate_groups(source(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"]).drop("group_key")


# --- imputation ---------------------------------------------------------------------------------------

_RECOMMENDED = f"""
SELECT 'o_orderkey' AS column_name, CAST(0 AS BIGINT) AS missing_count, 'None (Complete)' AS recommended_method FROM (SELECT 1) x
UNION ALL SELECT 'o_orderstatus', count(*) - count({clean('o_orderstatus', True)}), 'Mode Imputation' FROM orders_missing
UNION ALL SELECT 'o_totalprice', count(*) - count(o_totalprice), CASE WHEN abs(skewness(o_totalprice)) > 1.0 THEN 'Median Imputation' ELSE 'Mean Imputation' END FROM orders_missing
UNION ALL SELECT 'o_orderpriority', count(*) - count({clean('o_orderpriority', True)}), 'Mode Imputation' FROM orders_missing
UNION ALL SELECT 'o_orderdate', count(*) - count(o_orderdate), 'Constant / Flag Imputation' FROM orders_missing"""


@query("impute_recommend", "E1", _RECOMMENDED)
def impute_recommend(spark, folder):
    return I.recommend(P.profile(table(spark, folder, "orders_missing"))).select(
        "column_name", "missing_count", "recommended_method"
    )


@query("impute_recommend_bulk", "E3", _RECOMMENDED.replace("'Constant / Flag Imputation'", "'DATE_METHOD_SELECTION_REQUIRED'"))
def impute_recommend_bulk(spark, folder):
    return I.recommend(P.profile(table(spark, folder, "orders_missing")), bulk=True).select(
        "column_name", "missing_count", "recommended_method"
    )


def _fill_sql(fill: str) -> str:
    return f"SELECT o_orderkey, coalesce(o_totalprice, fill) AS o_totalprice, o_totalprice IS NULL AS o_totalprice_was_missing FROM orders_missing, (SELECT {fill} AS fill FROM orders_missing) f"


def _filled(spark, folder, method: str) -> DataFrame:
    df = table(spark, folder, "orders_missing").select("o_orderkey", "o_totalprice")
    return I.apply_imputation(df, ["o_totalprice"], {"o_totalprice": method}, flag=True)


@query("impute_apply_mean", "E2", _fill_sql("avg(o_totalprice)"))
def impute_apply_mean(spark, folder):
    return _filled(spark, folder, "mean")


@query("impute_apply_median", "E2", _fill_sql("quantile_cont(o_totalprice, 0.5)"))
def impute_apply_median(spark, folder):
    return _filled(spark, folder, "median")


@query("impute_apply_small", "E2", "SELECT o_orderkey, coalesce(o_totalprice / 1e9, fill) AS x FROM orders_missing, (SELECT quantile_cont(o_totalprice / 1e9, 0.5) AS fill FROM orders_missing) f")
def impute_apply_small(spark, folder):
    """The fill of small numbers is not rounded."""
    df = table(spark, folder, "orders_missing").select("o_orderkey", (F.col("o_totalprice") / 1e9).alias("x"))
    return I.apply_imputation(df, ["x"], {"x": "median"})


@query("impute_apply_whole", "E2", """
SELECT o_orderkey, coalesce(n, fill) AS n FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 > 0 THEN o_orderkey + 9007199254740993 END AS n FROM orders) t,
 (SELECT CAST(round_even(quantile_cont(CAST(CASE WHEN o_orderkey % 10 > 0 THEN o_orderkey + 9007199254740993 END AS DOUBLE), 0.5), 0) AS BIGINT) AS fill FROM orders) f""")
def impute_apply_whole(spark, folder):
    """Whole numbers beyond 2^53 that are not missing stay as they are."""
    n = F.when(F.col("o_orderkey") % 10 > 0, F.col("o_orderkey") + F.lit(9007199254740993))
    return I.apply_imputation(source(spark, folder, "orders").select("o_orderkey", n.alias("n")), ["n"], {"n": "median"})


@query("impute_apply_mode", "E2", f"""
SELECT o_orderkey, coalesce({clean('o_orderpriority', True)}, m.p) AS o_orderpriority FROM orders_missing,
 (SELECT {clean('o_orderpriority', True)} AS p FROM orders_missing WHERE {clean('o_orderpriority', True)} IS NOT NULL
 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) m""")
def impute_apply_mode(spark, folder):
    df = table(spark, folder, "orders_missing").select("o_orderkey", "o_orderpriority")
    return I.apply_imputation(df, ["o_orderpriority"])


@query("impute_date_rules", "E4", """
SELECT o_orderkey, strftime(coalesce(o_orderdate, (SELECT min(o_orderdate) FROM orders_missing)), '%Y-%m-%d') AS o_orderdate FROM orders_missing""")
def impute_date_rules(spark, folder):
    df = table(spark, folder, "orders_missing").select("o_orderkey", "o_orderdate")
    filled = I.apply_date_rules(df, {"o_orderdate": I.DateRule("min")})
    return filled.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query("impute_date_forward", "E4", """
SELECT o_orderkey, strftime(coalesce(o_orderdate, last_value(o_orderdate IGNORE NULLS) OVER
 (PARTITION BY o_orderkey // 100 ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)), '%Y-%m-%d') AS o_orderdate FROM orders_missing""")
def impute_date_forward(spark, folder):
    df = table(spark, folder, "orders_missing").select(
        "o_orderkey", "o_orderdate", F.floor(F.col("o_orderkey") / 100).alias("block")
    )
    rule = I.DateRule("forward", partition_by=("block",), order_by=("o_orderkey",))
    return I.apply_date_rules(df, {"o_orderdate": rule}).select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate")
    )


# --- roll-ups -----------------------------------------------------------------------------------------

CUSTOMER = ["cust_id", "c_name", "mixed", "c_acctbal"]
_MISSING_CELLS = " + ".join(f"(count(*) - count({c}))" for c in CUSTOMER)
_DUPS = "SELECT count(*) AS row_count FROM dirty_customer GROUP BY cust_id, c_name, mixed, c_acctbal HAVING count(*) > 1"


def _inputs(spark, folder, name="dirty_customer"):
    df = table(spark, folder, name)
    return df, P.completeness(S.normalize_missing(df))


@query("rollup_table_summary", "F1", f"""
SELECT total_rows, CAST(4 AS BIGINT) AS total_columns, missing_cells, {pct('missing_cells', 'total_rows * 4')} AS missing_percentage,
 extra AS duplicate_extra_records, groups AS duplicate_groups, {pct('extra', 'total_rows')} AS duplicate_percentage,
 CAST(2 AS BIGINT) AS inconsistencies, CAST(1 AS BIGINT) AS potential_anomalies
 FROM (SELECT count(*) AS total_rows, {_MISSING_CELLS} AS missing_cells FROM dirty_customer) a,
 (SELECT count(*) AS groups, CAST(coalesce(sum(row_count - 1), 0) AS BIGINT) AS extra FROM ({_DUPS}) g) b""")
def rollup_table_summary(spark, folder):
    df, profiles = _inputs(spark, folder)
    return R.table_summary(profiles, Q.quality_issues(df), Q.duplicates(df))


_ORDERS_COMPLETE = _completeness_sql("orders_missing", ORDERS_MISSING, ORDERS_TEXT)


@query("rollup_missing", "F2", f"SELECT column_name, missing_percentage, missing_count FROM ({_ORDERS_COMPLETE}) c")
def rollup_missing(spark, folder):
    return R.missing_by_column(_inputs(spark, folder, "orders_missing")[1])


@query("rollup_quality", "F3", f"""
SELECT 'Complete Data Cells' AS label, count(*) * 4 - ({_MISSING_CELLS}) AS value FROM dirty_customer
UNION ALL SELECT 'Missing Cells', {_MISSING_CELLS} FROM dirty_customer
UNION ALL SELECT 'Confirmed Inconsistencies', count(*) FROM ({_ID_SQL} UNION ALL {_SPACE_SQL}) i
UNION ALL SELECT 'Potential Anomalies', count(*) FROM ({_MIXED_SQL}) j""")
def rollup_quality(spark, folder):
    df, profiles = _inputs(spark, folder)
    return R.quality_overview(profiles, Q.quality_issues(df))


@query("rollup_dups", "F4", f"""
SELECT 'Unique Records' AS label, (SELECT count(*) FROM documents) - extra AS value FROM (SELECT CAST(coalesce(sum(row_count - 1), 0) AS BIGINT) AS extra FROM ({_TEXT_GROUPS}) g) d
UNION ALL SELECT 'Duplicate Extra Records', extra FROM (SELECT CAST(coalesce(sum(row_count - 1), 0) AS BIGINT) AS extra FROM ({_TEXT_GROUPS}) g) d""")
def rollup_dups(spark, folder):
    texts = source(spark, folder, "documents").select("text")
    return R.unique_vs_duplicate(P.completeness(texts), Q.duplicates(texts))


@query("rollup_categories", "F5", f"SELECT category, count(*) AS column_count FROM ({_types_sql({'lineitem': TYPED['lineitem']})}) t GROUP BY category")
def rollup_categories(spark, folder):
    return R.category_counts(S.semantic_category(source(spark, folder, "lineitem")))


@query("rollup_numeric", "F6", f"SELECT column_name, mean, median, stddev, min, max FROM ({_stats_sql('lineitem', LINEITEM_NUMBERS)}) s")
def rollup_numeric(spark, folder):
    return R.numeric_summary(P.profile(source(spark, folder, "lineitem")))


_CATEGORICAL = {"lang": "text", "source": "text", "quality": "number", "toxic": "number"}


@query("rollup_categorical", "F7", f"SELECT column_name, rank, value, count FROM ({_distribution_sql('labelled_documents', _CATEGORICAL, 5)}) d")
def rollup_categorical(spark, folder):
    return R.categorical_summary(P.profile(table(spark, folder, "labelled_documents")))


@query("rollup_imputation", "F8", f"SELECT column_name, missing_count, recommended_method FROM ({_RECOMMENDED}) r")
def rollup_imputation(spark, folder):
    return R.imputation_table(I.recommend(P.profile(table(spark, folder, "orders_missing")))).select(
        "column_name", "missing_count", "recommended_method"
    )


_ORDER_MISSES = [f"(count(*) - count({clean(c, c in ORDERS_TEXT)}))" for c in ORDERS_MISSING]


@query("rollup_dataset", "F9", f"""
SELECT CAST(4 AS BIGINT) AS columns_with_missing, {' + '.join(_ORDER_MISSES)} AS total_missing_cells,
 '{', '.join(ORDERS_MISSING)}' AS columns, 'NONE' AS skipped_columns, 'o_orderdate' AS date_warning_columns,
 'NONE' AS inconsistent_columns, CAST(0 AS BIGINT) AS inconsistent_count, 'NONE' AS anomaly_columns, CAST(0 AS BIGINT) AS anomaly_count FROM orders_missing""")
def rollup_dataset(spark, folder):
    df = table(spark, folder, "orders_missing")
    return R.dataset_summary(I.recommend(P.profile(df)), Q.quality_issues(df))


@query("rollup_distribution", "F10", f"SELECT column_name, value, count, percentage FROM ({_distribution_sql('labelled_documents', _CATEGORICAL)}) d")
def rollup_distribution(spark, folder):
    return R.distribution_rows(P.profile(table(spark, folder, "labelled_documents"))).drop("category")


_PROFILED = ["orders_missing", "dirty_customer"]
_CELLS = {"orders_missing": [clean(c, c in ORDERS_TEXT) for c in ORDERS_MISSING], "dirty_customer": CUSTOMER}


def _runs(spark, folder) -> tuple[str, DataFrame]:
    """The folder and the run log of a bulk run over two tables and one empty selection of a third, which fails."""
    tables = {TableKey(name): partial(table, spark, folder, name) for name in _PROFILED}
    tables[TableKey("no_rows")] = lambda: source(spark, folder, "supplier").filter("s_suppkey IS NULL")
    place = f"{shared_folder(spark)}/bulk-{uuid.uuid4().hex}"
    return place, profile_many(spark, tables, place)


_RUN_ROWS = union_of([
    f"SELECT '{name}' AS table_key, count(*) AS row_count, CAST({len(cells)} AS BIGINT) AS column_count, CAST({' + '.join(f'(count(*) - count({c}))' for c in cells)} AS BIGINT) AS missing_cells, false AS failed FROM {name}"
    for name, cells in _CELLS.items()
] + ["SELECT 'no_rows', NULL, NULL, NULL, count(*) = 0 FROM supplier WHERE s_suppkey IS NULL"])


@query("bulk_runs", "A3 A8", _RUN_ROWS)
def bulk_runs(spark, folder):
    """The log of the run, with each table's figures."""
    log = _runs(spark, folder)[1]
    return log.select("table_key", "row_count", "column_count", "missing_cells", F.col("error").isNotNull().alias("failed"))


@query("rollup_runs", "F11", f"SELECT count(*) FILTER (NOT failed) AS tables_profiled, count(*) FILTER (failed) AS tables_failed FROM ({_RUN_ROWS}) r")
def rollup_runs(spark, folder):
    return R.run_totals(_runs(spark, folder)[1])


@query("bulk_stored_profile", "A7", _completeness_sql("orders_missing", ORDERS_MISSING, ORDERS_TEXT))
def bulk_stored_profile(spark, folder):
    """A profile read back from where the run stored it."""
    place, _ = _runs(spark, folder)
    found = cached_profile(spark, TableKey("orders_missing"), place)
    return found.select("column_name", "total_rows", "non_null_count", "missing_count", "missing_percentage")


@query("bulk_collected_reports", "R11", f"SELECT 'completeness' AS report, column_name, missing_count FROM ({_ORDERS_COMPLETE}) a UNION ALL SELECT 'labelled', column_name, missing_count FROM ({union_of([f'SELECT {chr(39)}{c}{chr(39)} AS column_name, count(*) - count({c}) AS missing_count FROM labelled_documents' for c in ['lang', 'source', 'n_chars', 'quality', 'toxic']])}) b")
def bulk_collected_reports(spark, folder):
    """Two reports written by one run, a third one failing, and read back."""
    place = f"{shared_folder(spark)}/reports-{uuid.uuid4().hex}"
    reports = {
        "completeness": lambda: P.completeness(S.normalize_missing(table(spark, folder, "orders_missing"))),
        "labelled": lambda: Q.missing_report(table(spark, folder, "labelled_documents")),
        "broken": lambda: source(spark, folder, "orders").select("no_such_column"),
    }
    log = collect_all(spark, reports, place)
    done = [r["report"] for r in log.filter("error IS NULL").collect()]
    parts = [spark.read.parquet(f"{place}/{name}").select(F.lit(name).alias("report"), "column_name", "missing_count") for name in sorted(done)]
    return reduce(DataFrame.unionByName, parts)


def _written(form: str):
    @query(f"file_{form}", "A2 A5", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
    def run(spark, folder):
        """A table written as a file and read back."""
        df = source(spark, folder, "customer")
        path = write_output(df, f"{shared_folder(spark)}/files-{uuid.uuid4().hex}/customer.{form}")
        back = read_file(spark, path)
        return back.select(*[F.col(f.name).cast(f.dataType) for f in df.schema.fields])

    return run


for _form in ("csv", "json", "parquet"):
    _written(_form)


@query("catalogue_table", "A1", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def catalogue_table(spark, folder):
    """A table read by its name in the catalogue."""
    source(spark, folder, "supplier").createOrReplaceTempView("catalogue_supplier")
    return read_table(spark, "catalogue_supplier", limit=0)
