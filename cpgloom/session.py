"""Session construction and the folder used to cut lineage."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "cpgloom", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    b = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("CPGLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.adaptive.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``; only where neither that
    setting nor a checkpoint folder exists (local tests) is a folder of this machine used."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="cpgloom-checkpoint-")
    sc.setCheckpointDir(shared)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder; survives the loss of executors.

    A checkpointed plan still carries the constraints inferred for its columns, and those double with
    every join of an iteration; only its rows are kept here."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    kept = df.checkpoint(eager=True)
    rows = kept._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, kept._jdf.schema(), False), spark)


def keep(df: DataFrame) -> DataFrame:
    """``df`` as a written table in the shared checkpoint folder, for wide or large intermediate results:
    columns are compressed and read one by one. Removed when the driver's process ends."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
    except Exception:  # noqa: BLE001  the session has ended; the folder is the cluster's to clean
        pass


#: Fixed: how a plan shows a shuffle, which a broadcast or a column's name does not.
_SHUFFLE = re.compile(r"(?<!\w)Exchange (?:hashpartitioning|rangepartitioning|RoundRobinPartitioning|SinglePartition)")
#: Tasks per core that work in Python should have at least.
TASKS_PER_CORE = 4


def spread(df: DataFrame) -> DataFrame:
    """Give work that is heavy per byte at least a few tasks per core. A table that is scanned by as many
    tasks anyway (any large one) is left where it lies; only a compact one, whose few splits would
    keep most cores idle, is dealt out round robin, so no key can pile up."""
    if _SHUFFLE.search(df._jdf.queryExecution().executedPlan().toString()):
        return df  # shuffled already; counting its tasks would run that shuffle
    want = TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)
