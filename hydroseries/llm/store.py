"""Where a lineage is cut: tables in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


class Store:
    """Intermediate tables below the session's ``spark.checkpoint.dir``, written once and read back.

    They survive lost executors. Unlike a checkpoint, a table that is read back brings none of
    the constraints of the plan that made it, so that plans of a loop stay small. Only where the
    setting is missing, as in a test on one machine, a temporary folder is used.
    """

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        sc = self.spark.sparkContext
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(self.spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-"))
        self.folder = f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"
        self.made = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.folder}/{self.made}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
