"""Session helpers: a local session for tests/bench, and cluster-safe settings."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every tidemark job relies on. UTC keeps any timestamp rendering stable;
# all interval arithmetic is done on integer epoch microseconds anyway.
CORE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tidemark") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for k, v in CORE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_core_conf(spark: SparkSession) -> None:
    """Runtime-settable SQL confs; safe to call on a session someone else built."""
    for k, v in CORE_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # pragma: no cover - some confs are static on some deployments
            pass


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint directory; set a scratch one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is respected
    as-is. Only a bare local session (tests) gets a fresh scratch directory.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="tidemark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def materialize(df):
    """Stage boundary: reliable checkpoint into ``spark.checkpoint.dir``.

    Cuts lineage (later plans start from the written files, so a lost executor
    does not replay the upstream stages) and keeps downstream plans small.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_STAGES: list[str] = []  # folders of the stages that were written as files, in their order


def staged(df):
    """Stage boundary like :func:`materialize`, as compressed columns: a fraction of the disk for sorted rows, and later
    reads take only the columns they use. The shuffles behind it are deleted as soon as it is written, the folder by
    :func:`drop_stages` or at the end of the session. Every column can be null to those who read it."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.set(key, before)
    _STAGES.append(folder)
    return spark.read.schema(df.schema).parquet(folder)


def drop_stages(spark: SparkSession, since: int, *needed) -> None:
    """Delete the stages written after the first ``since`` ones, without those that the frames ``needed`` read."""
    read = {f.split("/")[-2] for df in needed for f in df.inputFiles()}
    for folder in _STAGES[since:]:
        if folder.split("/")[-1] not in read:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            _STAGES.remove(folder)


def stages_written() -> int:
    return len(_STAGES)
