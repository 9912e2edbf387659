"""Sessions, table access and durable intermediate results."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "corvina") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a scan would leave most of them idle (fewer files than half the cores, of a bounded size).

    Larger inputs are read in enough parts and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) * 2 < cores and _bytes(df) < SPREAD_BYTES else df


#: A table of more bytes is split by the scan itself.
SPREAD_BYTES = 512_000_000


def _bytes(df: DataFrame) -> int:
    """Bytes of the files of a table."""
    spark = df.sparkSession
    total = 0
    for name in df.inputFiles():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return total


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where that is unset a temporary one is used if all of Spark runs in this process; on a cluster
    it is an error, as every executor would write its own part of a table to its own machine.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-corvina-")
        spark.conf.set(CHECKPOINT_CONF, named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small or medium result; survives the loss of executors."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it again.

    Cuts lineage as a checkpoint does, but is columnar, so later reads prune columns. The
    table is removed when the driver ends.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder that is removed when the driver ends."""
    path = f"{shared_folder(spark)}/corvina-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


_STORED: dict[tuple, str] = {}


def stored(name: str, inputs: list[DataFrame], build: Callable[[str], None]) -> str:
    """The folder of what ``build`` derives from tables, kept for the later queries of an application.

    It is built by its first user, and again once the files of the tables are not the same.
    """
    spark = inputs[0].sparkSession
    key = (spark.sparkContext.applicationId, name, *(tuple(sorted(i.inputFiles())) for i in inputs))
    if key not in _STORED:
        path = new_folder(spark)
        build(path)
        _STORED[key] = path
    return _STORED[key]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may have ended first
        pass
