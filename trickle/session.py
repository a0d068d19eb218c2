"""Spark session defaults and the shared working folder.

Everything the library writes (rendered change feeds, routed tables, stream
checkpoints, sink output) goes below the folder the cluster names in
``spark.checkpoint.dir``. On a cluster that is shared storage; only when it is
unset (local tests) do we create one of our own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

STATE_STORE_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def build_session(
    master: str = "local[8]",
    shuffle_partitions: int = 8,
    app_name: str = "trickle",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Session used by tests, bench and examples.

    On a cluster, pass the cluster master and size ``shuffle_partitions`` to the
    data (roughly total shuffle bytes / 128 MB); AQE coalesces small partitions
    and splits skewed join partitions at runtime.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # split a skewed join partition even where that costs one more shuffle
        # downstream (join 2 of the changelog feeds a grouping on its key)
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.streaming.stateStore.providerClass", STATE_STORE_PROVIDER)
        # checkpointed intermediate results are removed once no longer referenced
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_settings(
    input_bytes: int, total_cores: int, most_partitions: int = 200_000
) -> dict[str, str]:
    """Sizes for a cluster run over ``input_bytes`` of change-log text.

    Text splits of 1 GB (100 TB -> ~100k scan tasks) keep the number of map
    tasks, and with it the map x reduce shuffle-block count, manageable.
    Shuffles start from about one partition per 512 MB of input, at least
    three per core and at most ``most_partitions``: a lineitem change reaches the shuffle
    as a ~40-byte partial aggregate, so a reducer sees ~200 MB. AQE then
    coalesces towards 256 MB partitions and splits skewed ones, so every
    partition fits an executor's memory.
    """
    mb = 1 << 20
    shuffle = max(3 * total_cores, min(most_partitions, input_bytes // (512 * mb)))
    return {
        "spark.sql.files.maxPartitionBytes": str(1024 * mb),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(shuffle),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * mb),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * mb),
    }


def shared_dir(spark: SparkSession) -> str:
    """Root of the shared working folder, from ``spark.checkpoint.dir``.

    Falls back to the SparkContext's checkpoint dir, and only when neither is
    set and the master is local creates one (tests on one machine). On a
    cluster executors could not see such a folder, so that is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(
                f"master {master} needs spark.checkpoint.dir: a folder all executors share"
            )
        d = tempfile.mkdtemp(prefix="trickle-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


_folder: ContextVar[str | None] = ContextVar("scratch_folder", default=None)


@contextmanager
def scratch_folder(path: str) -> Iterator[str]:
    """Within this context (of one thread) everything written on the way goes
    below ``path``, a shared folder which the caller removes afterwards."""
    token = _folder.set(path.rstrip("/"))
    try:
        yield path
    finally:
        _folder.reset(token)


def scratch_path(spark: SparkSession, *parts: str, unique: bool = False) -> str:
    """A path below the shared folder (or ``scratch_folder``); ``unique``
    appends a fresh id."""
    segs = [_folder.get() or f"{shared_dir(spark)}/trickle", *parts]
    if unique:
        segs.append(uuid.uuid4().hex[:12])
    return "/".join(segs)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back:
    cuts the lineage with files that outlive a lost executor."""
    path = scratch_path(df.sparkSession, "written", name, unique=True)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, if it is there."""
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file; readers see the old text or the new one, or for
    a moment none."""
    fs, p = _hadoop(spark, path)
    _, new = _hadoop(spark, f"{path}.{uuid.uuid4().hex[:8]}.tmp")
    out = fs.create(new, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(new, p):
        raise OSError(f"could not write {path}")


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if it is not there."""
    fs, p = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
