"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split hot join keys even where the join feeds an operator on the same keys.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # Streaming state on disk, with its changes in the checkpoint, instead of on the heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

MEGABYTE = 1024 * 1024

# Folders of sessions on one machine that name none, by application.
_own_folders: dict[str, str] = {}

def session(name: str = "pipekit", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's settings; `conf` entries win over them."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def sized(input_bytes: int) -> dict[str, str]:
    """Settings for jobs that read and shuffle about `input_bytes`.

    Scans aim at no more than some 100,000 tasks. Shuffles start with about one partition per
    gigabyte, 20,000 at most; adaptive execution then joins the small ones.
    """
    scan = min(max(128 * MEGABYTE, input_bytes // 100_000), 1024 * MEGABYTE)
    shuffle = min(max(200, input_bytes // (1024 * MEGABYTE)), 20_000)
    return {
        "spark.sql.files.maxPartitionBytes": str(scan),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(shuffle),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * MEGABYTE),
    }


def tune(spark: SparkSession) -> SparkSession:
    """Apply the library's settings to a session somebody else made."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`.

    Only a session on one machine (`local`) without the setting gets one, a temporary folder of
    its own. On a cluster a missing setting is an error, because a machine-local folder is lost
    with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        context = spark.sparkContext
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        if context.applicationId not in _own_folders:
            _own_folders[context.applicationId] = Path(tempfile.mkdtemp(prefix="pipekit-")).as_uri()
        configured = _own_folders[context.applicationId]
    return configured.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    return f"{scratch_dir(spark)}/pipekit-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession) -> bool:
    """Delete what this application wrote to the shared folder; call it when nothing reads it."""
    jvm, hadoop = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/pipekit-{spark.sparkContext.applicationId}")
    return folder.getFileSystem(hadoop).delete(folder, True)


def saved(df: DataFrame, label: str = "table") -> DataFrame:
    """Write `df` once as parquet in the shared folder and read it back, cutting its lineage."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
