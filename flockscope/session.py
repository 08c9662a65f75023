"""Spark session helpers.

Every job in the library pins the session time zone to UTC (day keys are
computed in the session zone) and relies on AQE for partition coalescing and
skew-join splitting. Lineage is cut with ``DataFrame.checkpoint()`` into the
shared folder named by ``spark.checkpoint.dir``; a folder is only set here when
the session has none (tests, local runs).
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: dict = {}

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "flockscope", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare_session(spark)
    return spark


def prepare_session(spark: SparkSession) -> None:
    """Apply the settings the operators depend on to an existing session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, creating a scratch one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared (HDFS/object store)
    folder and is used as is. Only when nothing is configured (local runs,
    tests) is a fresh scratch folder made.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="flockscope-ckpt-", dir=os.environ.get("FLOCKSCOPE_SCRATCH", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return conf_dir


def ship_package(spark: SparkSession) -> None:
    """Send the package's modules to the Python workers, once per application.

    Tasks import the functions they run, and a worker need not have the
    repository on its path.
    """
    sc = spark.sparkContext
    if _SHIPPED.get("app") == sc.applicationId:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.TemporaryDirectory()  # the driver serves the file from here until Python ends
    path = os.path.join(folder.name, f"{os.path.basename(root)}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _SHIPPED.update(app=sc.applicationId, folder=folder)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to ``spark.sql.shuffle.partitions`` partitions, which adaptive coalescing leaves alone.

    Coalescing makes about one partition per core, so that what a task sorts or
    hashes grows with the input; dealt this way it falls with that setting.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss), never a local one.

    The frame is cached first so writing the checkpoint does not recompute it;
    the cache is released once the checkpoint files exist.
    """
    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out


class Stored:
    """``df`` written as Parquet below the shared checkpoint folder, until it is dropped.

    With a ``key`` the table is bucketed by it, so that tables with the same number
    of buckets are joined by the key without a shuffle.
    """

    def __init__(self, df: DataFrame, key: str | None = None, buckets: int = 1):
        self._spark, name = df.sparkSession, f"stored_{uuid.uuid4().hex}"
        self._path = f"{ensure_checkpoint_dir(self._spark).rstrip('/')}/{name}"
        self._name = name if key else None
        if key:
            df.write.format("parquet").bucketBy(buckets, key).option("path", self._path).saveAsTable(name)
            self.df = self._spark.table(name)
        else:
            df.write.parquet(self._path)
            self.df = self._spark.read.schema(df.schema).parquet(self._path)

    def drop(self) -> None:
        if self._name:
            self._spark.sql(f"DROP TABLE IF EXISTS {self._name}")
        path = self._spark._jvm.org.apache.hadoop.fs.Path(self._path)
        path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)
