"""Tables written to the folder that all executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """``df`` written under spark.checkpoint.dir and read again; it goes when the session ends.

    A local session without the setting gets a temporary folder; on a cluster that is an error.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="vozmark-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    file.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(file)
    return spark.read.schema(df.schema).parquet(path)
