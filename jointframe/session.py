"""Session set-up, table access and durable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "jointframe", memory: str = "8g") -> SparkSession:
    """A local session for tests and benches. On a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> None:
    """Runtime settings the operators count on; safe to call again."""
    # Times without zone become instants in streams and epochs; pin the zone.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # A join whose big side has a hot key is split even if that costs one more shuffle later.
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    # The JVM never compiles methods above 8,000 bytes of code; such stages run faster as smaller functions.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by the cluster; make one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


#: Folders of the tables that ``durable`` has written in this process.
_WRITTEN: list[str] = []


def discard_tables(spark: SparkSession) -> int:
    """Delete the tables written by ``durable`` so far; how many there were."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = len(_WRITTEN)
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)
    return found


def new_folder(spark: SparkSession) -> str:
    """The name of a new folder in the shared checkpoint folder; ``discard_tables`` deletes it."""
    ensure_checkpoint_dir(spark)
    _WRITTEN.append(f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


#: Lets Spark delete the shuffles of a query when it ends.
_ENDED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, ended: bool = False) -> DataFrame:
    """Write the rows to a new table in the shared checkpoint folder and read on from there.

    Unlike ``checkpoint()`` this evaluates the plan once, keeps the rows
    columnar and gives the planner real sizes. Lineage ends here, so a lost
    executor costs the work since the last cut. ``discard_tables`` removes the
    tables when no result that reads them is needed any more. With ``ended`` the
    shuffles behind the table are deleted with the write instead of whenever
    the driver collects its garbage.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/durable-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    before = spark.conf.get(_ENDED)
    spark.conf.set(_ENDED, str(ended or before == "true").lower())
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_ENDED, before)
    return spark.read.schema(df.schema).parquet(path)


class Tables:
    """Lazy access to the parquet tables of one directory: ``t.lineitem``."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory.rstrip("/")
        prepare(spark)

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")
