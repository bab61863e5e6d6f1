"""Tasks that compare the members of groups in blocks of bounded size.

A group of up to ``block`` members is one task. A larger one is cut into blocks by a hash of the
member, and every two blocks meet in one task, so that no task grows with its group and each pair
of members is compared once. Pairs are never written: a task returns, per member, its links and
the smallest member that links in the task reach.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Link = Callable[[pd.DataFrame, pd.DataFrame], Iterator[tuple[np.ndarray, np.ndarray]]]


def block_tasks(members: DataFrame, sizes: DataFrame, group: list[str], member: str, block: int) -> DataFrame:
    """``members`` with ``task`` (a hash of group and two block numbers) and ``side`` (0 or 1; -1 where a block meets itself).

    ``sizes`` has a row per group with its ``members``; members of groups without a row are left out.
    """
    joined = members.join(sizes, group).withColumn("_blocks", F.ceil(F.col("members") / block).cast("int"))
    own = F.pmod(F.xxhash64(F.lit(3), F.col(member)), F.col("_blocks")).cast("int")
    spread = joined.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    side = F.when(F.col("_own") == F.col("_other"), -1).when(F.col("_own") < F.col("_other"), 0).otherwise(1)
    task = F.struct(*group, low.alias("i"), high.alias("j"))
    return spread.withColumn("task", task).withColumn("side", side.cast("int")).drop("_blocks", "_own", "_other", "members")


def chosen_partitions(rows: int, rows_per_partition: int, least: int) -> int:
    return max(least, math.ceil(rows / rows_per_partition))


def per_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tables of one task each, from batches sorted by the column ``task_key``."""
    kept: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        keys = batch["task_key"].to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts = [0, *cuts.tolist(), len(batch)]
        for a, b in zip(starts, starts[1:]):
            part = batch.iloc[a:b]
            if kept and kept[-1]["task_key"].iat[0] != part["task_key"].iat[0]:
                yield pd.concat(kept) if len(kept) > 1 else kept[0]
                kept = []
            kept.append(part)
    if kept:
        yield pd.concat(kept) if len(kept) > 1 else kept[0]


def smallest_reached(alike: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each member the smallest id that links within the task reach, itself included."""
    names = np.sort(ids)
    low = np.searchsorted(names, ids)
    linked = alike | np.eye(len(ids), dtype=bool)
    while True:
        near = np.where(linked, low[None, :], len(ids)).min(1)
        if (near == low).all():
            return names[low]
        low = near


def key_of(task: Column) -> Column:
    """One text per task, to sort by."""
    return F.to_json(task)
