"""Tables cut out of the lineage.

An intermediate result that several jobs read is written as Parquet into the shared folder that the session
names in ``spark.checkpoint.dir`` and read back, so a lost executor costs one task and never a whole plan.
Every staged table has a fresh name; ``drop_staged`` deletes what a session has staged.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDER = f"quillcount-{uuid.uuid4().hex[:12]}"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in local mode without that setting, a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = spark.sparkContext.getCheckpointDir()
        if not root:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillcount-"))
            root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{_FOLDER}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back with the same schema."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Delete every table this process has staged; frames that read them end here."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
