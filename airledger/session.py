"""Session settings and tables written between the steps of a plan."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("airledger")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`.

    Only where neither the session nor the context names one (a session on one machine,
    as in tests), a temporary folder is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return context._jsc.sc().getCheckpointDir().get().rstrip("/")
    if not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="airledger-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    context.setCheckpointDir(made)
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Folders written in this process and not yet removed.
_WRITTEN: set[str] = set()


def write_between(df: DataFrame, label: str) -> DataFrame:
    """`df`, written once into the shared folder and read again.

    It cuts the lineage: what follows may read it several times, and a lost executor costs
    no recomputation of what came before. The files stay until `forget`, `forget_all` or the
    end of the shared folder, since the frames that read them may run at any time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)
    _WRITTEN.discard(path)


def forget(*frames: DataFrame) -> None:
    """Removes the files of frames that `write_between` returned and that nothing reads any more."""
    for df in frames:
        _remove(df.sparkSession, df._written)


def forget_all(spark: SparkSession) -> None:
    """Removes all files written between steps in this process; every result must have been used."""
    for path in list(_WRITTEN):
        _remove(spark, path)
