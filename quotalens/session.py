"""Session defaults.  A cluster's own settings always win over these."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Observation, SparkSession, functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

# Tables of more rows are not taken for small ones when their files have fewer bytes than this.
FEW_ROWS, SMALL_FILE = 1_000_000, 200_000_000
# Written tables of at most this many rows are statistics that fit beside every task.
SENT_ROWS = 100_000


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("quotalens")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for driver and executors; a local session without one gets its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp"))
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def checkpointed(df):
    """Cut lineage: write the rows once as Parquet in the folder the cluster names, and go on from there."""
    spark = df.sparkSession
    void = [f.name for f in df.schema if f.dataType.typeName() == "void"]
    if not df.columns or len(void) == len(df.columns):
        shared_folder(spark)
        return df.checkpoint(eager=True)
    path, seen = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}", Observation()
    kept = df.drop(*void)
    kept.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(kept.schema).parquet(path)
    if seen.get["rows"] > FEW_ROWS:
        size = int(str(back._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size < SMALL_FILE:
            # Rows so alike that their files are small would be broadcast for their files' size.
            back = back.hint("merge")
    return back.select(*[F.lit(None).alias(c) if c in void else F.col(f"`{c}`") for c in df.columns]) if void else back


def partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df, key):
    """The rows moved once to the tasks of ``key``; a grouping by it and more columns then moves nothing."""
    return df.repartition(partitions(df.sparkSession), key)


def bucketed(df, key):
    """Like :func:`checkpointed` for rows dealt by ``key``: written in buckets, so later steps by that key move no row again."""
    spark, name = df.sparkSession, f"table_{uuid.uuid4().hex}"
    (df.write.format("parquet").option("compression", "zstd").option("path", f"{shared_folder(spark)}/{name}")
     .bucketBy(partitions(spark), key).saveAsTable(name))
    return spark.table(name)


def sent(written):
    """A written table for a join: sent to the rows if it is short, as the merge hint of a long written table would move those instead."""
    return F.broadcast(written) if written.count() <= SENT_ROWS else written
