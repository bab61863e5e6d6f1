"""Missing-value tokens and the semantic type of each column.

All evidence for typing a table comes from aggregates over the whole table: no head samples,
so the answer does not depend on row order. One scan turns every row into a cell per column, and one
aggregate by column combines the cells in each task before the shuffle. One row per column comes back
to the driver, whatever the table's size; the type rules then run on those rows.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed_values import (
    BOOLEAN_WORDS,
    DATE_FORMS,
    DATETIME_FORMS,
    IDENTIFIER_ENDINGS,
    IDENTIFIER_NAMES,
    MISSING_TOKENS,
    ORDINAL_WORDS,
)
from ..functions.text import NUMBER_PATTERN, SPACE_CLASS, number_sql, text_start, whole_text

# The rules only ask whether a column has more than DISCRETE_LIMIT distinct values.
DISCRETE_LIMIT = 10

_BOOLEAN_BIT, _DATE_BIT, _DATETIME_BIT, _NUMBER_BIT = 1, 2, 4, 8
_FIRST_VOCABULARY_BIT = 16
_ORDINAL_MASK = sum(_FIRST_VOCABULARY_BIT << i for i in range(len(ORDINAL_WORDS)))


def is_identifier_name(name: str) -> bool:
    """True for names that by convention hold a key."""
    lowered = name.lower()
    return lowered in IDENTIFIER_NAMES or lowered.endswith(tuple(IDENTIFIER_ENDINGS))


def kind_of(dtype: T.DataType) -> str:
    """Storage class of a declared type."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, (T.FractionalType,)):
        return "decimal" if isinstance(dtype, T.DecimalType) else "float"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(dtype, T.DateType):
        return "date"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    return "complex"


def named(name: str) -> str:
    """A column name as SQL text."""
    return "`" + name.replace("`", "``") + "`"


def quoted(name: str) -> Column:
    return F.col(named(name))


def present_sql(name: str, kind: str) -> str:
    """SQL text of the value, or NULL where it counts as missing (NULL, and NaN in floats)."""
    c = named(name)
    return f"CASE WHEN NOT isnan({c}) THEN {c} END" if kind == "float" else c


def present(name: str, kind: str) -> Column:
    return F.expr(present_sql(name, kind))


def word_list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def normalize_missing(df: DataFrame) -> DataFrame:
    """Replace missing-value tokens in string columns by NULL. Exact match, no trimming."""
    tokens = word_list(MISSING_TOKENS)
    return df.selectExpr(
        *[
            f"CASE WHEN {named(f.name)} NOT IN {tokens} THEN {named(f.name)} END AS {named(f.name)}"
            if kind_of(f.dataType) == "string"
            else named(f.name)
            for f in df.schema.fields
        ]
    )


@dataclass(frozen=True)
class ColumnEvidence:
    """What one pass over the table tells about a column."""

    position: int
    name: str
    kind: str
    total: int
    filled: int
    flags: int
    all_whole: bool
    all_zero_one: bool
    exact_distinct: int | None = None

    @property
    def missing(self) -> int:
        return self.total - self.filled

    @property
    def is_numeric_text(self) -> bool:
        return self.kind == "string" and self.filled > 0 and self.flags & _NUMBER_BIT != 0

    @property
    def is_few(self) -> bool:
        return self.exact_distinct is not None and self.exact_distinct <= DISCRETE_LIMIT

    @property
    def physical_type(self) -> str:
        """BOOLEAN, INTEGER, DECIMAL/CONTINUOUS_NUMERIC, TIMESTAMP, DATE, STRING or COMPLEX."""
        if self.kind in ("decimal", "float"):
            return "INTEGER" if self.filled and self.all_whole else "DECIMAL/CONTINUOUS_NUMERIC"
        if self.kind == "string" and self.semantic_category.startswith("NUMERICAL"):
            return "INTEGER" if self.all_whole else "DECIMAL/CONTINUOUS_NUMERIC"
        return self.kind.upper()

    @property
    def semantic_category(self) -> str:
        """First rule that fits, in the fixed order of precedence."""
        has_values = self.filled > 0
        if is_identifier_name(self.name):
            return "IDENTIFIER"
        if self.kind == "boolean" or (has_values and self.all_zero_one):
            return "BOOLEAN"
        if self.kind == "timestamp":
            return "TIMESTAMP"
        if self.kind == "date":
            return "DATE"
        if self.kind == "complex":
            return "COMPLEX"
        if self.kind != "string":
            whole = self.kind == "integer" or (has_values and self.all_whole)
            return "NUMERICAL_DISCRETE" if whole or not has_values or self.is_few else "NUMERICAL_CONTINUOUS"
        if not has_values:
            return "CATEGORICAL_NOMINAL"
        if self.flags & _BOOLEAN_BIT:
            return "BOOLEAN"
        if self.flags & _DATE_BIT:
            return "DATE"
        if self.flags & _DATETIME_BIT:
            return "TIMESTAMP"
        if self.flags & _NUMBER_BIT:
            return "NUMERICAL_DISCRETE" if self.all_whole and self.is_few else "NUMERICAL_CONTINUOUS"
        if self.flags & _ORDINAL_MASK:
            return "CATEGORICAL_ORDINAL"
        return "CATEGORICAL_NOMINAL"

    @property
    def has_statistics(self) -> bool:
        """Columns that get min, max, mean, quartiles and so on."""
        return self.semantic_category.startswith("NUMERICAL") or self.physical_type in (
            "INTEGER",
            "DECIMAL/CONTINUOUS_NUMERIC",
        )

    def double_sql(self) -> str:
        """SQL text of the column as a double, for statistics."""
        if self.kind == "string":
            return number_sql(named(self.name))
        return f"CAST({present_sql(self.name, self.kind)} AS DOUBLE)"

    def as_double(self) -> Column:
        return F.expr(self.double_sql())


_STARTS_LIKE_A_NUMBER = rf"^{SPACE_CLASS}*[+\-.\diI]"


def _text_flags(c: str) -> str:
    """One bit per rule a text meets; bit_and over a column leaves the rules all texts meet.

    Cheap tests come first: the patterns run only on texts that start like a number or a date,
    the vocabularies only on texts no longer than their longest word.
    """

    def bit(test: str, value: int) -> str:
        return f"(CASE WHEN {test} THEN {value} ELSE 0 END)"

    forms = " | ".join(
        [
            bit(f"{c} RLIKE r'{whole_text(DATE_FORMS)}'", _DATE_BIT),
            bit(f"{c} RLIKE r'{text_start(DATETIME_FORMS)}'", _DATETIME_BIT),
            bit(f"{c} RLIKE r'{NUMBER_PATTERN}'", _NUMBER_BIT),
        ]
    )
    every_word = sorted({word for words in ORDINAL_WORDS.values() for word in words})
    vocabularies = " | ".join(
        bit(f"lower({c}) IN {word_list(words)}", _FIRST_VOCABULARY_BIT << i)
        for i, words in enumerate(ORDINAL_WORDS.values())
    )
    longest = max(len(word) for word in every_word)
    return (
        f"CASE WHEN {c} IS NOT NULL THEN {bit(f'{c} IN {word_list(BOOLEAN_WORDS)}', _BOOLEAN_BIT)}"
        rf" | (CASE WHEN {c} RLIKE r'{_STARTS_LIKE_A_NUMBER}' THEN {forms} ELSE 0 END)"
        f" | (CASE WHEN length({c}) <= {longest} AND lower({c}) IN {word_list(every_word)}"
        f" THEN {vocabularies} ELSE 0 END) END"
    )


def aggregate(df: DataFrame, aggregates: list[str]) -> DataFrame:
    """One row of aggregates given as SQL text."""
    return df.agg(*[F.expr(a) for a in aggregates])


#: Aggregates by column over cells. ``bits`` sets one bit of 64 per value by its hash: more bits than a limit prove more values.
EVIDENCE = {
    "total": "count(1)", "filled": "count_if(present)", "flags": "bit_and(flags)", "zero_one": "bool_and(x IN (0D, 1D))",
    "whole": "bool_and(coalesce(whole, x - rint(x) = 0D))",
    "bits": "bit_count(bit_or(CASE WHEN x IS NOT NULL THEN shiftleft(1L, CAST(xxhash64(x + 0D) & 63L AS INT)) END))",
}
MOMENTS = {"low": "min(x)", "high": "max(x)", "mean": "avg(x)", "variance": "var_samp(x)", "skew": "skewness(x)", "kurt": "kurtosis(x)"}


def cells(df: DataFrame, items: tuple[int, int] | None = None, part: str | None = None) -> DataFrame:
    """(position, present, x, whole, flags): every cell of a table, from one scan.

    ``x`` is the value as a number if it is one or reads as one, ``flags`` the rules a text meets; ``whole`` is set where
    the number as a double may hide decimal places. Rows are turned into cells first and cells are judged afterwards,
    so that the compiled code doesn't grow with the number of columns. ``items`` (longest text, characters kept) asks for
    the value as a text besides: a longer one as its first characters and a digest of the whole. The last column is not a
    cell but kept beside the cells where it is named as ``part``.
    """
    values = []
    fields = df.schema.fields[:-1] if part else df.schema.fields
    kept = [named(part)] if part else []
    for i, field in enumerate(fields):
        kind = kind_of(field.dataType)
        c = present_sql(field.name, kind)
        number = f"CAST({c} AS DOUBLE)" if kind in ("integer", "decimal", "float") else "NULL"
        values += [str(i), f"{c} IS NOT NULL", number, f"({c}) % 1 = 0" if kind == "decimal" else "NULL", c if kind == "string" else "NULL"]
        if items:
            other = f"initcap(CAST({c} AS STRING))" if kind == "boolean" else f"CAST({c} + 0 AS STRING)" if kind == "float" else f"CAST({c} AS STRING)"
            values.append("NULL" if kind in ("string", "complex") else other)
    typed = ["CAST(NULL AS INT)", "CAST(NULL AS BOOLEAN)", "CAST(NULL AS DOUBLE)", "CAST(NULL AS BOOLEAN)", "CAST(NULL AS STRING)"]
    names = "position, present, number, whole, text"
    if items:
        typed, names = [*typed, "CAST(NULL AS STRING)"], f"{names}, other"
    turned = df.selectExpr(*kept, f"stack({len(fields) + 1}, {', '.join(typed + values)}) AS ({names})").filter("position IS NOT NULL")
    x = f"CASE WHEN text IS NULL THEN number WHEN text RLIKE r'{_STARTS_LIKE_A_NUMBER}' THEN {number_sql('text')} END"
    judged = ["position", "present", f"{x} AS x", "whole", f"{_text_flags('text')} AS flags"]
    if items:
        longest, first = items
        judged.append(f"CASE WHEN length(text) > {longest} THEN concat(left(text, {first}), '...', sha2(text, 256)) ELSE coalesce(text, other) END AS item")
    return turned.selectExpr(*kept, *judged)


def evidence_of(position: int, name: str, kind: str, values: dict, few: int | None = None) -> ColumnEvidence:
    """The evidence that the aggregates of a column's cells give."""
    return ColumnEvidence(
        position, name, kind, values.get("total") or 0, values.get("filled") or 0, values.get("flags") or 0,
        kind == "integer" if values.get("whole") is None else values["whole"], bool(values.get("zero_one")), few,
    )


def column_evidence(df: DataFrame, moments: bool = False) -> tuple[list[ColumnEvidence], dict[int, dict]]:
    """Evidence for every column and its raw aggregates; ``moments`` adds those of numbers and numeric texts.

    One scan; a second one, over these columns alone, counts the values of decimal numbers and numeric texts of which the
    first did not prove that there are more than DISCRETE_LIMIT.
    """
    if not df.columns:
        return [], {}
    wanted = EVIDENCE | (MOMENTS if moments else {})
    facts = {r["position"]: r.asDict() for r in cells(df).groupBy("position").agg(*[F.expr(a).alias(n) for n, a in wanted.items()]).collect()}
    found = [evidence_of(i, f.name, kind_of(f.dataType), facts.get(i, {})) for i, f in enumerate(df.schema.fields)]
    few = [e for e in found if e.filled and (e.is_numeric_text or e.kind in ("decimal", "float")) and facts[e.position]["bits"] <= DISCRETE_LIMIT]
    if few:
        values = ", ".join(f"{e.position}, {e.double_sql()} + 0D" for e in few)
        counted = df.selectExpr(f"stack({len(few)}, {values}) AS (position, x)").groupBy("position").agg(F.count_distinct("x").alias("n")).collect()
        exact = {r["position"]: r["n"] for r in counted}
        found = [replace(e, exact_distinct=exact.get(e.position)) for e in found]
    return found, facts


def declared_columns(df: DataFrame) -> list[ColumnEvidence]:
    """Columns by declared type alone, without reading the table."""
    return [
        ColumnEvidence(i, f.name, kind_of(f.dataType), 0, 0, 0, False, False) for i, f in enumerate(df.schema.fields)
    ]


def semantic_category(df: DataFrame) -> DataFrame:
    """One row per column: name, storage type class and semantic category (after missing tokens are removed)."""
    found, _ = column_evidence(normalize_missing(df))
    rows = [(e.position, e.name, e.physical_type, e.semantic_category) for e in found]
    return df.sparkSession.createDataFrame(
        rows, "position int, column_name string, physical_type string, category string"
    )


def semantic_categories(tables: dict[str, DataFrame], threads: int = 4) -> DataFrame:
    """``semantic_category`` of several tables, their jobs submitted side by side."""
    with ThreadPoolExecutor(max_workers=threads) as pool:
        found = list(pool.map(semantic_category, tables.values()))
    named_parts = [part.select(F.lit(n).alias("table_name"), "*") for n, part in zip(tables, found)]
    return reduce(DataFrame.unionByName, named_parts)


def identifier_names(df: DataFrame) -> DataFrame:
    """One row per column: is its name that of an identifier? Looks at the schema only."""
    rows = [(name, is_identifier_name(name)) for name in df.columns]
    return df.sparkSession.createDataFrame(rows, "column_name string, is_identifier boolean")
