"""Tables written between the stages of a plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir.

    Where the session names none, a cluster's warehouse serves; on one machine, as in
    tests, a temporary folder, which the session then keeps.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.conf.get("spark.master", "local")
    if not root and master.startswith("local") and not master.startswith("local-cluster"):
        root = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root or spark.conf.get('spark.sql.warehouse.dir')}/foliate-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    Later stages then do not repeat earlier ones, and a lost executor costs no more than
    its own tasks.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt over all cores by their keys, three tasks a core.

    For rows that are cheap to read and dear to work on; the number is given, as by their
    bytes adaptive plans would gather them into few tasks again.
    """
    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more, wherever Spark stores them.

    Call it only when all that came of them has been written in turn: later jobs, and
    tasks of lost executors, would miss the files.
    """
    for t in tables:
        spark = t.sparkSession
        for folder in {f.rpartition("/")[0].rpartition("/")[0] for f in t.inputFiles()}:
            if "/foliate-" in folder:  # folders of shared_dir hold one table each
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
