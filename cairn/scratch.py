"""Tables that a job keeps for itself, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set, a session with a local master gets a folder of its own; on a cluster that is an error, since
    executors would write to disks that nobody else reads."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the cluster shares")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cairn-shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, tag: str = "kept") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Cuts the lineage and survives lost executors: later reads come from files, not from
    executors' memory."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`written` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
