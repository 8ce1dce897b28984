"""Where intermediate tables live, and how small sides of joins are chosen.

Executors can disappear at any time, so intermediate results are written as
Parquet into the folder that the cluster names in ``spark.checkpoint.dir``;
nothing here depends on blocks held by one executor.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_LIMIT = 32 << 20
_written: list[tuple[SparkSession, str]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_of(df: DataFrame, rows: int) -> int:
    """How many parts of about ``rows`` rows ``df`` (a table) makes: a part stays small whatever
    the input. A small table is spread over the cores, if there's enough for each."""
    n = df.count()
    return max(1, -(-n // rows), min(df.sparkSession.sparkContext.defaultParallelism, n // 1000))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder; a local one only for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
    if chosen.isDefined():
        return chosen.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="palimpsest-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop_path(spark, path)
    return fs.exists(p)


def _remove_written() -> None:
    for spark, path in _written:
        try:
            p, fs = _hadoop_path(spark, path)
            fs.delete(p, True)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            return


atexit.register(_remove_written)


def stash_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/palimpsest-{uuid.uuid4().hex}/{label}"
    _written.append((spark, path.rpartition("/")[0]))
    return path


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    path = stash_path(df.sparkSession, label)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stash_path = path
    return back


def discard(df: DataFrame) -> None:
    """Remove a stashed table that nothing reads any more: what came of it is stashed too."""
    p, fs = _hadoop_path(df.sparkSession, df.stash_path.rpartition("/")[0])
    fs.delete(p, True)
    _written[:] = [(s, path) for s, path in _written if not df.stash_path.startswith(f"{path}/")]


def stashed_bytes(df: DataFrame) -> int:
    p, fs = _hadoop_path(df.sparkSession, df.stash_path)
    return fs.getContentSummary(p).getLength()


def row_width(kind: T.DataType) -> int:
    """Bytes of a value in memory, where its type tells; texts and lists count as short ones."""
    if isinstance(kind, T.StructType):
        return 8 + sum(row_width(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return 24 + row_width(kind.elementType)
    if isinstance(kind, T.MapType):
        return 48 + row_width(kind.keyType) + row_width(kind.valueType)
    return 24 if isinstance(kind, (T.StringType, T.BinaryType, T.DecimalType)) else 8


def small_side(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``df`` (a stashed table) with a broadcast hint if it fits ``limit`` both by its
    files, taken at four times their compressed size, and by its rows, taken at the width of
    their types; else as it is, so that the join shuffles."""
    if 4 * stashed_bytes(df) > limit:
        return df
    if not hasattr(df, "stash_rows"):
        df.stash_rows = df.count()
    return F.broadcast(df) if df.stash_rows * (16 + row_width(df.schema)) <= limit else df
