"""Keys of the facts, and lists of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SERVER = ["server"]
DATABASE = ["server", "database_name"]
TABLE = [*DATABASE, "schema_name", "table_name"]


def ordered_set(order: str, item: str) -> Column:
    """Aggregate: distinct items in the order of another column, for groups bounded by nature.

    An index or a key has a few dozen columns at most; copies of a row vanish before the shuffle.
    """
    return F.sort_array(F.collect_set(F.struct(F.col(order).alias("o"), F.col(item).alias("i"))))


def joined(pairs: Column, separator: str = ", ") -> Column:
    """The items of an ``ordered_set`` as one text."""
    return F.array_join(F.transform(pairs, lambda p: p["i"]), separator)
