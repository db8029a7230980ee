"""Versions, promotion, merges and exports of tables in folders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed


def promote(spark: SparkSession, root: str, version: str, expected: int) -> None:
    """Makes a version the current one, if it holds as many rows as expected.

    The pointer is a small numbered file that is written under another name
    and renamed to a name that nobody had: readers take the one with the
    highest number, so they see the old version or the new one at any time,
    and a crash between leaves the old one. Of two writers at once one fails.
    """
    found = spark.read.parquet(f"{root}/{version}").count()
    if found != expected:
        raise ValueError(f"version {version} has {found} rows, not {expected}")
    path, fs = _paths(spark, root)
    number = max(_pointers(spark, root), default=0) + 1
    written = path(f"_next.{uuid.uuid4().hex}")
    out = fs.create(written, False)
    out.write(bytearray(version.encode()))
    out.close()
    if fs.exists(path(f"current.{number}")) or not fs.rename(written, path(f"current.{number}")):
        raise OSError(f"another version of {root} was promoted at the same time")


def _paths(spark: SparkSession, root: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{root}/{name}" if name else root)
    return path, path("").getFileSystem(conf)


def _pointers(spark: SparkSession, root: str) -> list[int]:
    path, fs = _paths(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(path(""))]
    return [int(n.removeprefix("current.")) for n in names if n.startswith("current.") and n.removeprefix("current.").isdigit()]


def current(spark: SparkSession, root: str) -> DataFrame:
    """The promoted version."""
    version = spark.read.text(f"{root}/current.{max(_pointers(spark, root))}").head()[0]
    return spark.read.option("mergeSchema", "true").parquet(f"{root}/{version}")


def merged(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows over base rows by key; values that are null in a new row keep the base's, and columns may be added on either side."""
    names = list(dict.fromkeys([*base.columns, *new.columns]))
    rest = [c for c in names if c not in keys]
    b = base.select(*keys, F.struct(*[F.col(c) if c in base.columns else F.lit(None).cast(new.schema[c].dataType).alias(c) for c in rest]).alias("_b"))
    n = new.select(*keys, F.struct(*[F.col(c) if c in new.columns else F.lit(None).cast(base.schema[c].dataType).alias(c) for c in rest]).alias("_n"))
    return b.join(n, keys, "full").select(*keys, *[F.coalesce(f"_n.{c}", f"_b.{c}").alias(c) for c in rest])


def training_set(records: DataFrame, path: str, verdict: str) -> dict[str, int]:
    """Writes the verified records as JSON lines; returns how many records each verdict has, one row a verdict."""
    records.where(F.col(verdict) == "verified").drop(verdict).write.mode("overwrite").json(path)
    return {r[0]: r[1] for r in records.groupBy(verdict).count().collect()}



def replace_files(points: DataFrame, files: DataFrame, root: str, buckets: int = 64) -> None:
    """Puts the points of some files into a store: all former points of these files go, others stay.

    points are rows (collection, file, ordinal, …); files (collection, file)
    are those to replace, also such as have no points any more. The store lies
    in folders by collection and bucket of the file, and only folders of the
    given files are written, by dynamic partition overwrite: their other
    files' points are read, written beside and moved in at the commit. A point's id
    is a hash of its place, so the same call again changes nothing; of points
    of one place, the one with the least contents stays. The points that stay
    are checkpointed first, as a folder cannot be read while it is replaced.
    """
    spark = points.sparkSession
    names = [c for c in points.columns if c not in ("collection", "file", "ordinal")]
    place = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64("collection", "file"), F.lit(buckets)).cast("int"))
    key = F.substring(F.sha2(F.concat_ws("\x1f", "collection", "file", F.col("ordinal").cast("string")), 256), 1, 32)
    new = points.join(files.select("collection", "file").distinct(), ["collection", "file"], "left_semi")
    new = place(new.groupBy("collection", "file", "ordinal").agg(F.min(F.struct(*names)).alias("_r")).select("collection", "file", "ordinal", "_r.*").withColumn("point_id", key))
    touched = place(files.select("collection", "file").distinct())
    columns = [c for c in new.columns if c not in ("collection", "bucket")] + ["collection", "bucket"]
    rows = new.select(*columns)
    path, fs = _paths(spark, root)
    if fs.exists(path("")):
        store = spark.read.schema(rows.schema).parquet(root)
        folders = touched.select("collection", "bucket").distinct()
        stay = checkpointed(store.join(folders, ["collection", "bucket"], "left_semi").join(touched.select("collection", "file"), ["collection", "file"], "left_anti").select(*columns))
        rows = rows.unionByName(stay)
        emptied = folders.join(rows.select("collection", "bucket").distinct(), ["collection", "bucket"], "left_anti")
        gone = [(r[0], r[1]) for r in emptied.join(store.select("collection", "bucket").distinct(), ["collection", "bucket"]).collect()]  # at most a row a folder
    else:
        gone = []
    rows.repartition("collection", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection", "bucket").parquet(root)
    for collection, bucket in gone:  # a folder that is left without points is not written, so it is deleted
        escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(collection)
        fs.delete(path(f"collection={escaped}/bucket={bucket}"), True)


def stored_points(spark: SparkSession, root: str) -> DataFrame:
    """All points of a store."""
    return spark.read.parquet(root)
