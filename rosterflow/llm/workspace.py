"""Tables that cut lineage, kept in the folder that driver and executors share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a folder of this machine only where it is all there is."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return str(current.get()).rstrip("/")
    if not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="rosterflow-"))
    return str(sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


#: Spark's switch for removing a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """Writes intermediate tables to the shared folder and reads them back.

    A reread table has no lineage: losing an executor never repeats the work
    behind it, so the shuffle files behind it go as soon as it is written.
    ``drop`` removes tables that no later result reads.
    """

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[str, DataFrame]] = {}

    def settle(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        # holding the frame keeps its id from being given to another
        self.paths[id(out)] = path, out
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            held = self.paths.pop(id(df), None)
            if held is not None:
                jvm = self.spark._jvm
                p = jvm.org.apache.hadoop.fs.Path(held[0])
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


#: Rows that a Python worker gets at once; texts are long, so fewer than Spark's default.
ROWS_AT_ONCE = 1000


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once, unless the session bounds it closer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= ROWS_AT_ONCE:
        spark.conf.set(name, ROWS_AT_ONCE)


def apart(stem: str, names: list[str]) -> str:
    """A column name that is in none of ``names``."""
    while stem.lower() in {n.lower() for n in names}:
        stem += "_"
    return stem


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str, of: int, remainder: int):
    """True where crc32(doc_id as text) mod ``of`` equals ``remainder``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % of == remainder, F.lit(False))
