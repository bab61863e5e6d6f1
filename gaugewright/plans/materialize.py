"""Writing an intermediate table that several jobs read.

On a cluster the table goes to the shared folder named by ``spark.checkpoint.dir``, so it
survives the loss of executors. Only where that setting is absent and the master is local
(tests) is a temporary folder used, which goes with the process.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="gaugewright-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
        return folder
    raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def materialize(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and return it as a table read from there.

    With ``by`` the table is bucketed by these columns, so that grouping or joining it by them, or by more, shuffles none of its rows.
    """
    spark, name = df.sparkSession, f"gaugewright-{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    if not by:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = name.replace("-", "_")
    df.repartition(buckets, *by).write.format("parquet").option("path", path).bucketBy(buckets, *by).sortBy(*by).saveAsTable(table)
    return spark.table(table)
