"""Text, size and number formatting expressions (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import NUMBER_FORMS, WHITE_SPACE

SPACE_CLASS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITE_SPACE) + "]"


WHITE_SPACE_SQL = "".join(f"\\u{ord(c):04x}" for c in WHITE_SPACE)


def whole_text(forms: list[str]) -> str:
    """Pattern for texts that are one of ``forms`` once surrounding white space is ignored."""
    return rf"^{SPACE_CLASS}*(?:{'|'.join(forms)}){SPACE_CLASS}*\z"


def text_start(forms: list[str]) -> str:
    """Pattern for texts that begin with one of ``forms`` after leading white space."""
    return rf"^{SPACE_CLASS}*(?:{'|'.join(forms)})"


NUMBER_PATTERN = whole_text(NUMBER_FORMS)
BLANK_PATTERN = rf"^{SPACE_CLASS}*\z"


def strip(c: Column) -> Column:
    """Remove all Unicode white space at both ends (``trim`` alone removes spaces only)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def has_outer_space(c: Column) -> Column:
    """True where stripping would change the text; looks at the first and last character only."""
    ends = list(WHITE_SPACE)
    return F.substring(c, 1, 1).isin(ends) | F.right(c, F.lit(1)).isin(ends)


def number_sql(c: str) -> str:
    """SQL text turning a text into a double, NULL where it does not read as a number.

    The pattern keeps out texts the cast alone would take ('1d', '1f', 'NaN').
    """
    return f"CASE WHEN {c} RLIKE r'{NUMBER_PATTERN}' THEN try_cast(btrim({c}, '{WHITE_SPACE_SQL}') AS DOUBLE) END"


def number_of(c: Column) -> Column:
    """``number_sql`` for a column."""
    return F.when(c.rlike(NUMBER_PATTERN), strip(c).try_cast("double"))


def rounded(c: Column, digits: int) -> Column:
    """Round a double half to even at ``digits`` places, staying in double arithmetic."""
    scale = F.lit(float(10**digits))
    return F.rint(c.cast("double") * scale) / scale


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / max(1, whole), rounded."""
    return rounded(part.cast("double") / F.greatest(whole, F.lit(1)).cast("double") * F.lit(100.0), digits)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double; NULL where whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def cut(c: Column, longest: int, keep: int | None = None) -> Column:
    """Shorten texts longer than ``longest`` to ``keep`` characters and add '...'."""
    kept = longest if keep is None else keep
    return F.when(F.length(c) > longest, F.concat(F.left(c, F.lit(kept)), F.lit("..."))).otherwise(c)


def clean_label(c: Column, longest: int = 35) -> Column:
    """One-line label: no outer quotes or spaces, single spaces inside, shortened; empty gives 'N/A'."""
    bare = F.btrim(c, F.lit(WHITE_SPACE + "'\""))
    label = F.btrim(F.regexp_replace(bare, SPACE_CLASS + "+", " "))
    return F.when(c.isNull() | (c == ""), F.lit("N/A")).otherwise(cut(label, longest))


def fixed(c: Column, digits: int, suffix: str = "") -> Column:
    """A number with a fixed count of decimals, rounded half to even."""
    return F.format_string(f"%.{digits}f{suffix.replace('%', '%%')}", rounded(c, digits))


def plain_number(d: Column) -> Column:
    """A double as text, without an exponent up to 1e16."""
    plain = F.regexp_replace(d.cast("decimal(38,6)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when((F.abs(d) >= 1e7) & (F.abs(d) < 1e16), plain).otherwise(d.cast("string"))


def format_size(size: Column) -> Column:
    """Bytes as text in steps of 1024 from B to PB; NULL gives '-'."""
    value = size.cast("double")
    text = fixed(value / F.lit(float(1024**5)), 2, " PB")
    for power, unit in reversed(list(enumerate(["KB", "MB", "GB", "TB"], start=1))):
        text = F.when(
            value < F.lit(float(1024 ** (power + 1))),
            fixed(value / F.lit(float(1024**power)), 2, f" {unit}"),
        ).otherwise(text)
    text = F.when(value < 1024.0, F.format_string("%d B", value.cast("long"))).otherwise(text)
    return F.when(value.isNull(), F.lit("-")).otherwise(text)


def format_numeric(c: Column) -> Column:
    """Two decimals for decimal texts, with a trailing unit kept; NULL or '' gives '-'."""
    number = F.regexp_extract(c, r"^(-?\d+\.\d+)\s*", 1)
    unit = F.regexp_extract(c, r"^-?\d+\.\d+\s*([A-Za-z%]+.*)\z", 1)
    shown = fixed(number.try_cast("double"), 2)
    return (
        F.when(c.isNull() | (c == ""), F.lit("-"))
        .when(c.rlike(r"^-?\d+\.\d+\z"), shown)
        .when(unit != "", F.concat_ws(" ", shown, unit))
        .otherwise(c)
    )


def parse_size_mb(c: Column) -> Column:
    """First number and unit of a size text, in MB; MB when no unit, 0 when there is no number."""
    pattern = r"(?i)([\d.]+)\s*(GB|MB|KB|TB|Bytes|B)?"
    number = F.regexp_extract(c, pattern, 1).try_cast("double")
    unit = F.upper(F.regexp_extract(c, pattern, 2))
    factor = (
        F.when(unit == "GB", F.lit(1024.0))
        .when(unit == "TB", F.lit(1024.0 * 1024.0))
        .when(unit == "KB", F.lit(1.0 / 1024.0))
        .when(unit.isin("BYTES", "B"), F.lit(1.0 / (1024.0 * 1024.0)))
        .otherwise(F.lit(1.0))
    )
    return F.coalesce(number * factor, F.lit(0.0))


def digits_only(c: Column) -> Column:
    """The digits of a text as a number; 0 when it has none."""
    return F.coalesce(F.regexp_replace(c, r"\D", "").try_cast("bigint"), F.lit(0).cast("bigint"))


def coerce_number(c: Column) -> Column:
    """Text as a number, 0.0 when it is not one."""
    return F.coalesce(number_of(c), F.lit(0.0))


def short_count(c: Column) -> Column:
    """Counts with an M or K suffix from a million and a thousand up."""
    value = c.cast("double")
    return (
        F.when(value >= 1e6, F.concat(plain_number(rounded(value / 1e6, 2)), F.lit("M")))
        .when(value >= 1e3, F.concat(plain_number(rounded(value / 1e3, 1)), F.lit("K")))
        .otherwise(F.format_string("%d", value.cast("bigint")))
    )


def thousands(c: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(c.cast("double").cast("bigint"), 0)


def in_unit(size: Column, power: int, digits: int = 2) -> Column:
    """Bytes in KB (1), MB (2), GB (3) or TB (4), rounded."""
    return rounded(size.cast("double") / F.lit(float(1024**power)), digits)


def size_text(size: Column) -> Column:
    """Bytes in MB, or GB from 1024 MB up, with two decimals."""
    megabytes = size.cast("double") / F.lit(float(1024**2))
    return F.when(
        megabytes >= 1024.0, fixed(megabytes / F.lit(1024.0), 2, " GB")
    ).otherwise(fixed(megabytes, 2, " MB"))


def footprint_text(size: Column) -> Column:
    """Bytes in MB, or GB from 1024 MB up, rounded to two decimals without trailing zeros."""
    megabytes = size.cast("double") / F.lit(float(1024**2))
    return (
        F.when(megabytes >= 1024.0, F.concat(plain_number(rounded(megabytes / F.lit(1024.0), 2)), F.lit(" GB")))
        .when(megabytes > 0, F.concat(plain_number(rounded(megabytes, 2)), F.lit(" MB")))
        .otherwise(F.lit("0.00 MB"))
    )


def pages_to_mb(pages: Column, page_kb: int = 8) -> Column:
    """Pages of ``page_kb`` KB as MB."""
    return rounded(pages.cast("double") * F.lit(float(page_kb)) / F.lit(1024.0), 2)


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from ``start`` to ``end``."""
    return F.timestamp_diff("SECOND", start, end)


def bare_definition(ddl: Column) -> Column:
    """An index definition without UNIQUE and without its own name, for comparing definitions."""
    return F.regexp_replace(
        F.regexp_replace(ddl, r"(?i)^CREATE\s+UNIQUE\s+INDEX", "CREATE INDEX"),
        r"(?i)^CREATE\s+INDEX\s+\S+\s+ON",
        "CREATE INDEX ON",
    )


def title_word(c: Column) -> Column:
    """First letter upper case, the rest lower case."""
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substr(c, F.lit(2))))
