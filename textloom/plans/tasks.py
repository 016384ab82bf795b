"""How inputs are dealt to tasks, and where intermediate tables lie."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = "2000"  # rows that Arrow hands over at once
MOST_ROWS = 1 << 18  # rows that a function over texts holds before it hands them on


def spread(rows: DataFrame) -> DataFrame:
    """Rows of few files over as many tasks as there are cores; inputs of more files stay as they lie.

    Where the session has Spark's own batch size of 10,000 rows, it is lowered: texts are long.
    """
    if rows.sparkSession.conf.get(BATCH) == "10000":
        rows.sparkSession.conf.set(BATCH, BATCH_ROWS)
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= n else rows.repartition(n)


def new_folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one that the session names, or a local one in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        found = tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{found.rstrip('/')}/textloom-{label}-{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """A table that is used more than once, computed once: written to the shared folder and read back."""
    path = new_folder(rows.sparkSession, "table")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
