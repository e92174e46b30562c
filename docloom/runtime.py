"""Session set-up, the shared work folder, and partition helpers used by the operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "docloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for (UTC, AQE, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    return b.config(map=base | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset (tests, one machine) a temporary folder is made and set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = jsc.get() if jsc.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder. It goes when the driver's JVM ends, or with :func:`clean_up`."""
    path = f"{shared_dir(spark)}/docloom/{name}-{uuid.uuid4().hex}"
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)
    _FOLDERS.append(path)
    return path


_FOLDERS: list[str] = []


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def clean_up(spark: SparkSession) -> int:
    """Delete all work folders made so far; for long sessions, once the results that read them have been used. Gives their number."""
    n = len(_FOLDERS)
    while _FOLDERS:
        fs, p = _fs(spark, _FOLDERS.pop())
        fs.delete(p, True)
    return n


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    The files go when the driver's JVM ends, or with :func:`clean_up`.
    """
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys, most: int = 64 << 20) -> DataFrame:
    """Repartition ``df`` if it reads fewer files than half the cores, and less than ``most`` bytes a core.

    A scan of one or two small files would leave most cores idle in a CPU-heavy Python stage. Larger inputs have
    enough splits and are not shuffled. Nothing is run to find out.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = len(df.inputFiles())
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if not files or files * 2 > cores or size > most * cores:
        return df
    return df.repartition(cores, *keys) if keys else df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
