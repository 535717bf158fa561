"""Sessions and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("shelfmark")
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names, which all executors share.

    Where nothing is set, a folder of this machine becomes the setting if all tasks run on it, as in tests; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: executors of a cluster share no folder of one machine")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="shelfmark-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/shelfmark-{uuid.uuid4().hex}"


def parts_of(rows: DataFrame, each: int) -> int:
    """How many partitions hold ``rows`` at ``each`` rows a partition. A number given to ``repartition`` stands; one that is left to Spark follows bytes as shuffled, however many rows are made of them in the same stage."""
    return 1 + rows.count() // each


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it is computed once and its lineage ends there."""
    path = scratch_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_settled(df: DataFrame) -> None:
    """Delete a settled table that no plan reads any more."""
    spark = df.sparkSession
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        if "/shelfmark-" in f:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
