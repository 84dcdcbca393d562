"""The folder that driver and executors share.

``spark.checkpoint.dir`` names it.  Only where that is unset and the master is local (tests, a notebook
on one machine) is a folder of our own made and set.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import vocabulary


def shared_dir(spark: SparkSession) -> str:
    """Path of the shared folder; also makes ``checkpoint()`` usable."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        have = sc._jsc.sc().getCheckpointDir()
        if not have.isDefined() and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = have.get() if have.isDefined() else tempfile.mkdtemp(prefix="tidegauge-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str = "stage", **options: int | str) -> DataFrame:
    """The same rows, written as Parquet (with the writer's ``options``) to the shared folder and read back.

    Cuts the lineage: what was written survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Python workers serve many stages and keep what their allocators don't return: with these, large
#: arrays and Arrow batches go back to the system when freed.
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(1 << 24), "ARROW_DEFAULT_MEMORY_POOL": "system"}


#: Rows of an Arrow batch, where the caller leaves Spark's 10,000: a batch of whole texts is held on
#: both sides of the socket.
BATCH_ROWS = "2000"


def lean_workers(spark: SparkSession) -> None:
    """Have Python workers started from now on return freed memory, and batches of texts be small;
    settings of the caller stay."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    for name, value in WORKER_MEMORY.items():
        spark.sparkContext.environment.setdefault(name, value)


def give_back(vocabularies: bool = True) -> None:
    """In a worker: what tasks before have left behind goes back to the system, unless told otherwise
    vocabularies included (a later task that needs one reads it again)."""
    if vocabularies:
        vocabulary.cache_clear()
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Bytes of an Arrow batch, where the caller leaves Spark's 64 MB: rows that hold whole sets or blocks of
#: members are large however few they are.
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """Have Arrow batches bounded by BATCH_BYTES; a setting of the caller stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, BATCH_BYTES)


#: Rows of a group from which its columns are broadcast to its rows instead of joined by shuffle; with
#: more than HOT_GROUPS times as many rows in all, in proportion. So at most HOT_GROUPS are broadcast.
HOT_ROWS, HOT_GROUPS = 10_000, 1_000_000


def hot_rows(rows: DataFrame) -> int:
    """Rows from which a group of this table is hot."""
    return max(HOT_ROWS, rows.count() // HOT_GROUPS)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their group's columns, among them ``hot``. Hot groups, at most HOT_GROUPS of them,
    are broadcast, so that no task gets all rows of one; all others are joined by shuffle."""
    if groups.where("hot").isEmpty():
        return rows.join(groups, keys)
    hot = F.broadcast(groups.where("hot"))
    rest = rows.join(F.broadcast(groups.where("hot").select(*keys)), keys, "left_anti").join(groups.where("not hot"), keys)
    return rows.join(hot, keys).unionByName(rest)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the table doesn't have yet (Spark's names don't tell case apart)."""
    taken, name = {c.lower() for c in df.columns}, f"_{wanted}"
    while name.lower() in taken:
        name = "_" + name
    return name


def put_file(spark: SparkSession, data: bytes, name: str) -> str:
    """Write bytes to the shared folder through Hadoop's file system and have Spark hand the file
    to each executor; the result is the name to give to ``SparkFiles.get`` there."""
    jvm = spark.sparkContext._jvm
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}.bin"
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(hpath, True)
    try:
        for i in range(0, len(data), 1 << 20):
            out.write(bytearray(data[i : i + (1 << 20)]))
    finally:
        out.close()
    spark.sparkContext.addFile(str(fs.makeQualified(hpath).toString()))
    return path.rsplit("/", 1)[1]
