"""Tables in folders by one column, of which a change rewrites only the folders that it touches.

A change reads the version of the table, writes what stays of the touched folders aside, and then takes the next version:
a marker file that only one writer can create. If another one took it meanwhile, the change raises ``Conflict`` and nothing is
changed; the caller reads again. The taker overwrites the touched folders (dynamic partition overwrite) and removes those
of which nothing stays. Appending adds files and takes a version as well, so a change never loses rows that came meanwhile.

Folders that a change touches are listed on the driver: as many as there are collections in it, not rows. Readers may see a
change in part while it runs. A file system must create files exclusively (HDFS and local ones do; object stores need a
connector that does).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomwork.session import staged


class Conflict(RuntimeError):
    """Another writer changed the table meanwhile."""


@dataclass
class Store:
    spark: SparkSession
    path: str
    by: str
    schema: StructType

    def _at(self, *names: str):
        jvm = self.spark._jvm
        found = jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()), found

    def version(self) -> int:
        """The number of changes so far."""
        files, folder = self._at("versions")
        return max((int(f.getPath().getName()) for f in files.listStatus(folder)), default=0) if files.exists(folder) else 0

    def _take(self, version: int) -> None:
        files, marker = self._at("versions", f"{version:012d}")
        try:
            files.create(marker, False).close()
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName() or "already exists" in str(e.java_exception):
                raise Conflict(f"version {version} of {self.path} is taken") from e
            raise

    def read(self) -> DataFrame:
        files, folder = self._at("rows")
        if not files.exists(folder):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def append(self, rows: DataFrame) -> int:
        new = self.version() + 1
        self._take(new)
        rows.select(*self.schema.names).write.mode("append").partitionBy(self.by).parquet(f"{self.path}/rows")
        return new

    def delete(self, keys: DataFrame, expected: int | None = None) -> int:
        """Remove the rows that agree with a row of ``keys`` in all its columns. ``expected``: the version the caller has read."""
        return self._change(keys, None, expected)

    def delete_where(self, gone: Column, expected: int | None = None) -> int:
        """Remove the rows for which ``gone`` holds: a filter, so that no rows are shuffled to a few keys."""
        version = self._expected(expected)
        held, gone = self.read(), F.coalesce(gone, F.lit(False))
        return self._rewrite(held.filter(gone).select(self.by), lambda inside: held.filter(inside & ~gone), version)

    def replace(self, rows: DataFrame, keys: list[str], expected: int | None = None) -> int:
        """Put ``rows`` in the place of those with the same keys; a row may move to another folder."""
        return self._change(rows.select(*keys), rows, expected)

    def _expected(self, expected: int | None) -> int:
        version = self.version()
        if expected is not None and expected != version:
            raise Conflict(f"{self.path} is at version {version}, not {expected}")
        return version

    def _change(self, keys: DataFrame, rows: DataFrame | None, expected: int | None) -> int:
        version = self._expected(expected)
        keys = keys.distinct()
        held = self.read()
        same = [held[c].eqNullSafe(keys[c]) for c in keys.columns]
        folders = held.join(keys, same, "left_semi").select(self.by)
        folders = folders if rows is None else folders.unionByName(rows.select(self.by))

        def stay(inside: Column) -> DataFrame:
            kept = held.filter(inside).join(keys, same, "left_anti")
            return kept if rows is None else kept.unionByName(rows.select(*self.schema.names))

        return self._rewrite(folders, stay, version)

    def _rewrite(self, folders: DataFrame, stay: Callable[[Column], DataFrame], version: int) -> int:
        """Write the ``folders`` anew with the rows that ``stay`` gives of them."""
        touched = [r[0] for r in folders.distinct().collect()]
        if not touched:
            return version
        inside = F.col(self.by).isin([t for t in touched if t is not None])
        inside = inside | F.col(self.by).isNull() if None in touched else inside
        kept = staged(stay(inside), "store")
        left = {r[0] for r in kept.select(self.by).distinct().collect()}
        self._take(version + 1)
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.by).parquet(f"{self.path}/rows")
        name = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
        for gone in set(touched) - left:
            files, folder = self._at("rows", name(self.by, None if gone is None else str(gone)))
            files.delete(folder, True)
        return version + 1


def delete_cascade(stores: list[Store], keys: DataFrame) -> None:
    """Remove what agrees with ``keys`` from a table and from those that depend on it, the dependent ones first."""
    for store in reversed(stores):
        store.delete(keys)


def updated(documents: Store, updates: DataFrame) -> DataFrame:
    """Apply updates (user_id, collection, doc_id, expected_hash, content) to documents; (doc_id, status) of each.

    ``missing``: there is no such document; ``stale``: it has another content than the caller knew; ``duplicate``: another
    document of the collection, or an update with a smaller doc_id, has this content; ``updated``, also where nothing
    changes. The table is not touched where none is updated.
    """
    version = documents.version()
    # A struct is equal to another one also where both have nulls.
    place, columns = F.struct("user_id", "collection").alias("place"), ["user_id", "collection", "doc_id"]
    held = documents.read().select(place, "doc_id", "content_hash")
    asked = updates.select("*", place, F.sha2("content", 256).alias("new_hash")).join(held, ["place", "doc_id"], "left")
    wanted = asked.filter("content_hash = expected_hash").groupBy("place", "new_hash").agg(F.min("doc_id").alias("first"))
    had = held.groupBy("place", F.col("content_hash").alias("new_hash")).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    judged = asked.join(wanted, ["place", "new_hash"], "left").join(had, ["place", "new_hash"], "left")
    taken = (F.col("least") != F.col("doc_id")) | (F.col("most") != F.col("doc_id")) | (F.col("first") < F.col("doc_id"))
    status = (
        F.when(F.col("content_hash").isNull(), "missing")
        .when(F.col("content_hash") != F.col("expected_hash"), "stale")
        .when(F.col("content_hash") == F.col("new_hash"), "updated")
        .when(F.coalesce(taken, F.col("first") < F.col("doc_id")), "duplicate")
        .otherwise("updated")
    )
    judged = staged(judged.withColumn("status", status), "updates")
    rows = judged.filter("status = 'updated'").select(*columns, "content", F.col("new_hash").alias("content_hash"))
    documents.replace(rows, columns, expected=version)
    return judged.select("doc_id", "status")
