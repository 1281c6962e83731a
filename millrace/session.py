"""Session building, table access, and materialisation in shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def build_session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tested under.

    Sizes (shuffle partitions, scan splits) are left to the caller or cluster;
    AQE coalesces and splits shuffle partitions at run time.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A local master without the setting (tests) gets a temporary folder; any
    other master without it is an error, since executors would not share it.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = os.path.join(tempfile.gettempdir(), f"millrace-{os.getpid()}")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d.rstrip("/")


#: Folders of the tables written by this process and not removed yet.
_written: list[str] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Survives lost executors and cuts the lineage. What is read back has the
    size of its files as its estimate, so that a loop's plans don't grow from
    step to step, as they do behind ``checkpoint()``, which keeps the estimate of
    the plan it replaces.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage and estimates of iterated state."""
    return materialise(df, "cut")


def mark() -> int:
    """A place in the list of written tables, for ``sweep``."""
    return len(_written)


def sweep(spark: SparkSession, *keep: DataFrame, since: int = 0) -> int:
    """Remove the tables that this process wrote after ``since``, but for those that ``keep`` reads; returns their number.

    For the owner of a finished result: nothing else that was derived from the
    removed tables can be computed afterwards.
    """
    plain = lambda path: path.split(":", 1)[-1].lstrip("/")
    used = {plain(os.path.dirname(f)) for df in keep for f in df.inputFiles()}
    gone = [p for p in _written[since:] if plain(p) not in used]
    for path in gone:
        remove(spark, path)
        _written.remove(path)
    return len(gone)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there, through Hadoop's file systems."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
