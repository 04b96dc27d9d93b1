"""Written tables: they cut lineage, are evaluated once, and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a local master gets a temporary folder; a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/netexp-work"
    return f"{base.rstrip('/')}/graph-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The table written and read again: a loop's lineage ends here, and lost executors cost nothing."""
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")
