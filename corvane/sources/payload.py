"""Index of payload fields: bitmaps of ids by field and value, intersected before points are read.

Ids lie in ranges of SPAN. For every field, value, file of points and range there is a row with the ids that have the value:
their offsets if they are few, else a bitmap. A filter takes the rows of each of its conditions, which statistics of the
index's row groups prune, unites them by condition and intersects them by file and range. What is left names the files to
read and the ids in them. Numbers are indexed as doubles and ranges with their ends, so that nothing is missed; the filter
itself is applied again to the points that were read and decides.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import storage

#: Ids of a range: the bits of Spark's bitmaps. Offsets beyond which a bitmap takes less.
SPAN, SPARSE = 1 << 15, 2048

KEY = ("field", "value", "num", "file", "bucket")
ENTRY = "struct<field:string,value:string,num:double>"


def _plain(kind: T.DataType) -> T.DataType:
    return kind.elementType if isinstance(kind, T.ArrayType) else kind


def _is_text(kind: T.DataType) -> bool:
    return isinstance(_plain(kind), (T.StringType, T.BooleanType))


def check(schema: T.StructType, fields: list[str]) -> None:
    """ValueError for a field of a type that can't be indexed: neither texts, booleans, numbers nor lists of them."""
    for f in fields:
        if not _is_text(schema[f].dataType) and not isinstance(_plain(schema[f].dataType), T.NumericType):
            raise ValueError(f"no index of {f}, a {schema[f].dataType.simpleString()}")


def _entries(schema: T.StructType, fields: list[str]) -> Column:
    def entry(f: str, x: Column) -> Column:
        text = _is_text(schema[f].dataType)
        value, num = (x.cast("string"), F.lit(None).cast("double")) if text else (F.lit(None).cast("string"), x.cast("double"))
        return F.struct(F.lit(f).alias("field"), value.alias("value"), num.alias("num"))

    def listed(f: str) -> Column:
        c = F.col(f"`{f}`")
        return F.transform(c, lambda x: entry(f, x)) if isinstance(schema[f].dataType, T.ArrayType) else F.array(entry(f, c))

    none = F.array().cast(f"array<{ENTRY}>")
    return F.concat(none, *[F.coalesce(listed(f).cast(f"array<{ENTRY}>"), none) for f in fields])


def write(spark: SparkSession, folder: str, fields: list[str]) -> None:
    """The index of a folder's stored points, for those of the fields that they have. A value's ids in one range are the most that a task collects."""
    points = spark.read.parquet(f"{folder}/points")
    have = [f for f in fields if f in points.columns]
    check(points.schema, have)
    each = points.select(F.col("_metadata.file_name").alias("file"), "id", F.explode(_entries(points.schema, have)).alias("e")).select("e.*", "file", "id")
    each = each.filter("value IS NOT NULL OR num IS NOT NULL").withColumn("bucket", F.floor(F.col("id") / SPAN)).withColumn("offset", F.pmod("id", F.lit(SPAN)).cast("int"))
    each.groupBy(*KEY).agg(F.array_sort(F.collect_set("offset")).alias("offsets")).write.parquet(f"{folder}/.lists")
    lists = spark.read.parquet(f"{folder}/.lists")
    few = lists.filter(F.size("offsets") <= SPARSE).withColumn("bits", F.lit(None).cast("binary"))
    many = lists.filter(F.size("offsets") > SPARSE).select(*KEY, F.explode("offsets").alias("o")).groupBy(*KEY).agg(F.bitmap_construct_agg("o").alias("bits"))
    both = few.unionByName(many, allowMissingColumns=True)
    both.repartitionByRange("field", "value", "num", "bucket").sortWithinPartitions("field", "value", "num", "bucket").write.parquet(f"{folder}/payload")
    storage.delete(spark, f"{folder}/.lists")


def _condition(field: str, kind: T.DataType, asked: Any) -> Column | None:
    """The index's rows of a condition; None if the index can't tell: another type than the field's, a range of a list, one without ends."""
    text, own = _is_text(kind), F.col("field") == field
    fits = lambda v: isinstance(v, bool) if isinstance(_plain(kind), T.BooleanType) else isinstance(v, str) if text else isinstance(v, (int, float)) and not isinstance(v, bool)
    put = lambda v: F.lit(str(v).lower() if isinstance(v, bool) else v) if text else F.lit(float(v))
    at = F.col("value" if text else "num")
    if isinstance(asked, dict):
        ends = [(k, v) for k, v in asked.items() if k in ("gt", "gte", "lt", "lte") and v is not None]
        if isinstance(kind, T.ArrayType) or isinstance(_plain(kind), T.BooleanType) or not ends or not all(fits(v) for _, v in ends):
            return None
        return reduce(lambda a, b: a & b, [at >= put(v) if k[0] == "g" else at <= put(v) for k, v in ends], own)
    values = asked if isinstance(asked, list) else [asked]
    if not values or not all(map(fits, values)):
        return None
    return own & reduce(lambda a, b: a | b, [at == put(v) for v in values])


def conditions(schema: T.StructType, fields: list[str], filters: dict[str, Any], aliases: dict[str, str]) -> list[Column]:
    """The conditions of a filter that the index answers."""
    named = [(aliases.get(n, n), v) for n, v in filters.items()]
    found = [_condition(f, schema[f].dataType, v) for f, v in named if f in fields and f in schema.names]
    return [c for c in found if c is not None]


def matching(index: DataFrame, asked: list[Column]) -> DataFrame:
    """(file, bucket, bits) of the ids that meet all conditions."""
    each = reduce(DataFrame.unionByName, [index.filter(c).select(F.lit(i).alias("c"), "file", "bucket", "offsets", "bits") for i, c in enumerate(asked)])
    by = ("c", "file", "bucket")
    few = each.filter("bits IS NULL").select(*by, F.explode("offsets").alias("o")).groupBy(*by).agg(F.bitmap_construct_agg("o").alias("bits"))
    any_ = each.filter("bits IS NOT NULL").select(*by, "bits").unionByName(few).groupBy(*by).agg(F.bitmap_or_agg("bits").alias("bits"))
    all_ = any_.groupBy("file", "bucket").agg(F.count("*").alias("n"), F.bitmap_and_agg("bits").alias("bits"))
    return all_.filter((F.col("n") == len(asked)) & (F.bitmap_count("bits") > 0)).select("file", "bucket", "bits")


def ids(matched: DataFrame) -> DataFrame:
    """The ids of bitmaps: bytes that aren't 0, then their bits."""
    at = F.explode(F.sequence(F.lit(0), F.lit(SPAN // 8 - 1))).alias("at")
    some = matched.select("bucket", "bits", at).select("bucket", "at", F.hex(F.substring("bits", F.col("at") + 1, F.lit(1))).alias("h")).filter("h <> '00'")
    byte = some.select("bucket", "at", F.conv("h", 16, 10).cast("int").alias("byte"), F.explode(F.array(*map(F.lit, range(8)))).alias("bit"))
    return byte.filter(F.getbit("byte", F.col("bit")) == 1).select((F.col("bucket") * SPAN + F.col("at") * 8 + F.col("bit")).alias("id"))


def read(spark: SparkSession, folder: str, asked: list[Column], listed: int, sent: int) -> DataFrame | None:
    """A folder's points that meet the conditions, from the files that hold some. Up to `listed` ids are literals of the scan, up to `sent` a broadcast. None if there are none."""
    matched = matching(spark.read.parquet(f"{folder}/payload"), asked)
    files = matched.groupBy("file").agg(F.sum(F.bitmap_count("bits")).alias("n")).collect()  # a row a file
    if not files:
        return None
    points, n, found = spark.read.parquet(*sorted(f"{folder}/points/{f['file']}" for f in files)), sum(f["n"] for f in files), ids(matched)
    if n <= listed:
        return points.filter(F.col("id").isin([r["id"] for r in found.collect()]))
    return points.join(F.broadcast(found) if n <= sent else found, "id", "left_semi")
