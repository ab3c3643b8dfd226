"""Tables that cut lineage: written to the folder all executors share, then read again.

The folder is ``spark.checkpoint.dir`` of the session. Only where that is unset and all executors run on this
machine (tests, a laptop) is a local folder made and set; a cluster without the setting is refused. Unlike a local
checkpoint, such a table outlives any executor. Operators in rounds drop the tables of rounds that are over.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI; sets one for this session where none is set."""
    found = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="notegrain-")
    atexit.register(shutil.rmtree, made, True)
    spark.conf.set(_SETTING, f"file://{made}")
    return f"file://{made}"


def _drop(spark: SparkSession, folder: str) -> None:
    """Removes this process's tables when it ends, as far as that is still possible."""
    if folder.startswith("file:"):
        shutil.rmtree("/" + folder.removeprefix("file:").lstrip("/"), True)
        return
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is gone; the folder's own retention applies
        pass


_MINE: dict[str, str] = {}


def own_dir(spark: SparkSession) -> str:
    """This process's folder in the shared folder; removed when the process ends."""
    base = shared_dir(spark)
    if base not in _MINE:
        _MINE[base] = f"{base}/notegrain/{uuid.uuid4().hex}"
        atexit.register(_drop, spark, _MINE[base])
    return _MINE[base]


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` as a Parquet table in the shared folder, computed once."""
    spark = df.sparkSession
    at = f"{own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    made = spark.read.schema(df.schema).parquet(at)
    made._written_at = at
    return made


def dropped(*tables: DataFrame) -> None:
    """Removes written tables that nothing will read again."""
    for t in tables:
        _drop(t.sparkSession, t._written_at)


def released(spark: SparkSession) -> None:
    """Lets go of the shuffle files of plans that nothing refers to any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
