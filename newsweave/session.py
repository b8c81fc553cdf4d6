"""Session helpers: building a local session for tests/bench, table reads,
size-checked broadcast and reliable (non-local) checkpointing."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Upper bound for a side we are willing to ship to every executor.
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def build_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "newsweave") -> SparkSession:
    """Session for tests and the bench. A cluster deployment passes its own
    configuration through spark-submit; only unset values are filled here."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("NEWSWEAVE_DRIVER_MEM", "16g"))
        .config("spark.sql.ansi.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared ``spark.checkpoint.dir``. Only a local master may
    leave it unset and gets a fresh scratch folder; on a cluster a folder of
    one machine would lose tables, so that is an error."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not conf_dir:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is unset on {master}: name a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="newsweave-ckpt-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(conf_dir)
    return spark.sparkContext.getCheckpointDir() or conf_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def table_version(spark: SparkSession, sf_dir: str, names: list[str]) -> tuple:
    """Path, size and time of every file of the tables: changes whenever the
    data under a path does."""
    out = []
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        out += sorted((str(s.getPath()), s.getLen(), s.getModificationTime()) for s in fs.listStatus(path))
    return tuple(out)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimized plan (no job is run)."""
    try:
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        if isinstance(size, int):  # py4j already converted the number
            return min(size, 1 << 62)
        # still a JVM number: compare its bit length there
        if size.bitLength() > 62:
            return 1 << 62
        return int(size.longValue())
    except Exception:  # pragma: no cover - stats unavailable
        return 1 << 62


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint only behind a size check; otherwise the join shuffles
    (and AQE may still convert it at runtime from real statistics)."""
    if estimated_bytes(df) <= max_bytes:
        return F.broadcast(df)
    return df


def batches_of(iterator: Iterator, n_bytes: int = 32 << 20) -> Iterator:
    """Arrow batches cut so that none holds many more bytes than ``n_bytes``
    (but at least one row)."""
    for batch in iterator:
        n = batch.num_rows
        if n == 0:
            continue
        step = max(1, min(n, int(n * n_bytes / max(1, batch.nbytes))))
        for i in range(0, n, step):
            yield batch.slice(i, step)


def checkpoint(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage by writing a table into the shared checkpoint folder and
    reading it back. Survives the loss of executors (unlike a local
    checkpoint), and the read-back plan carries real file-size statistics,
    so later broadcast and AQE decisions see true sizes instead of compounded
    join estimates."""
    path = shared_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a written table under the shared checkpoint folder
    (the cluster-wide ``spark.checkpoint.dir``)."""
    import uuid
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{uuid.uuid4().hex}"


_TABLES: dict[tuple, DataFrame] = {}


def materialised(spark: SparkSession, sf_dir: str, name: str, sources: list[str], build,
                 partition_by: list[str] | None = None) -> DataFrame:
    """A derived table written once to the shared folder for each state of its
    source tables (files, sizes, times): new data under a path is a new
    table."""
    key = (spark.sparkContext.applicationId, name, table_version(spark, sf_dir, sources))
    if key not in _TABLES:
        path = shared_path(spark, name)
        build().write.partitionBy(*(partition_by or [])).parquet(path)
        _TABLES[key] = spark.read.parquet(path)
    return _TABLES[key]
