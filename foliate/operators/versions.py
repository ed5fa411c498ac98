"""Tables that are upserted by key: buckets of keys in immutable versions, and a pointer that readers follow.

An upsert writes the buckets that it touched to a data folder of its own, each as a folder of
Parquet files; a version's manifest names for every bucket the data folder that holds it.  An upsert reads and rewrites the
touched buckets alone, and is seen at once when its manifest has been written; readers of an
earlier manifest keep their files until `vacuum`.  Two writers that start from the same
version cannot both write the next manifest: the later one fails, harms nothing, and may run
again.  `vacuum` must not run while another upsert does.

Only Spark reads and writes the folder, so it may lie in any store.  What the driver holds is
one row per bucket.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliate.operators.curate import first_by

#: A row per bucket and one, of bucket -1, that stands in every manifest.
MANIFEST = "bucket int, held_by string, writer string"


@dataclass(frozen=True)
class Versions:
    """folder; keys: the columns that a row is found by; buckets: fixed when the table is made."""

    folder: str
    keys: tuple[str, ...]
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def version(self, spark: SparkSession) -> int:
        """The newest version, or -1."""
        try:
            found = spark.read.schema(f"{MANIFEST}, version long").parquet(f"{self.folder}/manifest").agg(F.max("version")).first()[0]
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return -1
        return -1 if found is None else found

    def manifest(self, spark: SparkSession, version: int) -> dict[int, str]:
        rows = spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest/version={version}").collect()
        writer = min(r["writer"] for r in rows)  # of two that wrote at the same moment one counts, for all readers the same
        return {r["bucket"]: r["held_by"] for r in rows if r["writer"] == writer}

    def files(self, spark: SparkSession, version: int | None = None, buckets: set[int] | None = None) -> list[str]:
        """Folders of the buckets that a version consists of."""
        at = self.version(spark) if version is None else version
        held = self.manifest(spark, at) if at >= 0 else {}
        return [f"{self.folder}/data/{v}/_bucket={b}" for b, v in sorted(held.items()) if b >= 0 and (buckets is None or b in buckets)]

    def read(self, spark: SparkSession, schema: T.StructType | str, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The rows of the newest or of a given version."""
        paths = self.files(spark, version, buckets)
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def upsert(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], schema: T.StructType | str | None = None) -> int:
        """Write the next version: merge(old rows of the touched buckets, new rows); its number.

        Without `schema` the table's rows look like `new`.  merge must keep rows in the bucket
        of their key.  No new rows make no new version.
        """
        spark = new.sparkSession
        at = self.version(spark)
        touched = {r["b"] for r in new.select(self.bucket().alias("b")).distinct().collect()}  # as many as buckets at most
        if not touched:
            return at
        old = self.read(spark, schema or new.schema, at, touched)
        merged = merge(old, new).withColumn("_bucket", self.bucket())
        after = at + 1
        own = f"{after:08d}-{uuid.uuid4().hex}"
        # one task, and so one file, a bucket
        merged.repartition(min(len(touched), self.buckets), "_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/data/{own}")
        left = {r["_bucket"] for r in spark.read.schema("_bucket int").parquet(f"{self.folder}/data/{own}").distinct().collect()}
        held = {b: v for b, v in (self.manifest(spark, at) if at >= 0 else {}).items() if b not in touched} | dict.fromkeys(left, own)
        told = [(b, v, own) for b, v in sorted((held | {-1: own}).items())]
        spark.createDataFrame(told, MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{self.folder}/manifest/version={after}")
        if self.manifest(spark, after)[-1] != own:
            raise RuntimeError(f"version {after} already exists: another writer was first")
        return after

    def vacuum(self, spark: SparkSession, keep: int = 1) -> list[str]:
        """Delete data of versions that none of the newest `keep` manifests names; the folders deleted."""
        at = self.version(spark)
        named = {v for k in range(max(0, at - keep + 1), at + 1) for v in self.manifest(spark, k).values()}
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/data")
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        gone = [s.getPath() for s in (store.listStatus(path) if store.exists(path) else []) if s.getPath().getName() not in named]
        for p in gone:
            store.delete(p, True)
        return sorted(p.getName() for p in gone)


def newest(keys: tuple[str, ...], *order: Column) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge in which new rows take the place of old ones; of several new rows of a key the first by `order`."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        return first_by(both, list(keys), [F.desc("_new"), *order]).drop("_new")

    return merge
