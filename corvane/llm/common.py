"""What the operators of this subpackage share: shared storage, size-checked broadcasts, text access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest measured size in bytes of what is sent to every executor. Beyond it the operators shuffle instead.
BROADCAST_BYTES = 32 << 20

#: ASCII capitals and their lower-case forms, for functions that must leave other letters alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir. A temporary one is set only in local mode, where it is unset."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="corvane-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that lost executors cost no recomputation.

    Spark deletes such files when nothing refers to them any more if spark.cleaner.referenceTracking.cleanCheckpoints is on.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _bytes(c: Column, t: T.DataType) -> Column:
    """Bytes of a value, from above: 16 for what has a fixed size or describes a length."""
    if isinstance(t, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(t, T.ArrayType) and not isinstance(t.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
        return F.greatest(F.size(c), F.lit(0)) * 16 + 16
    if isinstance(t, T.ArrayType):
        return F.coalesce(F.aggregate(c, F.lit(16).cast("long"), lambda n, x: n + _bytes(x, t.elementType)), F.lit(16))
    if isinstance(t, T.StructType):
        return sum((_bytes(c[f.name], f.dataType) for f in t.fields), F.lit(16))
    return F.coalesce(F.length(F.to_json(c)) * 4, F.lit(0)) + 16 if isinstance(t, T.MapType) else F.lit(16)


def size_of(df: DataFrame) -> int:
    """Bytes that the rows of df take, measured."""
    own = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16)).cast("long")
    return df.agg(F.sum(own)).first()[0] or 0


def small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """df with a broadcast hint if its measured bytes are within limit (BROADCAST_BYTES), else df for a shuffled join. Pass a materialised df."""
    return F.broadcast(df) if size_of(df) <= (BROADCAST_BYTES if limit is None else limit) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(name: str = "text") -> Column:
    """UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def drop_present(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names (whatever their case), which an operator is about to add."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet under the shared folder and read again."""
    return store(df)[0]


def store(df: DataFrame) -> tuple[DataFrame, str]:
    """stored() and its path, which delete() takes."""
    path = f"{checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a stored table, in any file system that Spark reaches."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Tables:
    """Tables stored for one step, deleted when it ends without an error: by then what it returns must be materialised."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame) -> DataFrame:
        out, path = store(df)
        self.paths.append(path)
        return out

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, error: object, *_: object) -> None:
        if error is None:
            for path in self.paths:
                delete(self.spark, path)


def hidden(df: DataFrame, keep: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    """df with all columns outside of keep under private names, and the names by which they go: an operator that adds columns meets none of them."""
    away = {c: f"__own{i}" for i, c in enumerate(df.columns) if c not in keep}
    return df.select(*[F.col(f"`{c}`").alias(away.get(c, c)) for c in df.columns]), away
