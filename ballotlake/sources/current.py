"""Tables that are kept up by key, as buckets of Parquet files and a manifest that names the ones in force.

Keys are dealt to a fixed number of buckets. An upsert rewrites only the buckets that its rows touch, into a folder of its
own, and then puts a new manifest in place by one rename, which fails if another writer was first. Readers take the
newest manifest when they plan, so they see the table before or after an upsert and never a part of it.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one where that is unset and all tasks run on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="ballotlake-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name under the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: it is computed once and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class _Folder:
    """Small files of the driver in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._jvm, self._root = jvm, path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        at = self._path(f"{self._root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self._root}/{name}"))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Write a file whole or not at all; False if it is there already."""
        to = self._path(f"{self._root}/{name}")
        draft = self._path(f"{self._root}/drafts/{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        self._fs.mkdirs(to.getParent())
        if not self._fs.exists(to) and self._fs.rename(draft, to):
            return True
        self._fs.delete(draft, False)
        return False

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self._root}/{name}"), True)


class Current:
    """The table at path, with one row a key. buckets holds from the first upsert on; later ones use the table's own."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 32):
        self.spark, self.path, self.keys, self._buckets = spark, path.rstrip("/"), list(keys), buckets
        self._folder = _Folder(spark, self.path)

    def _manifest(self) -> dict:
        """The newest manifest: its number, the schema, for each bucket the folder that holds it, and applied tags."""
        names = self._folder.names("manifests")
        if not names:
            return {"version": 0, "schema": None, "buckets": self._buckets, "held": {}, "tags": {}}
        return json.loads(self._folder.read(f"manifests/{names[-1]}"))

    def _rows(self, manifest: dict, buckets: Sequence[str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        folders = [f"{self.path}/data/{manifest['held'][b]}/bucket_={b}" for b in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame | None:
        """All rows as of now, or None before the first upsert. Later upserts do not change what this frame reads."""
        manifest = self._manifest()
        return self._rows(manifest, sorted(manifest["held"])) if manifest["schema"] else None

    def applied(self, stream: str) -> int:
        """The last batch of this stream that is in the table, -1 for none."""
        return self._manifest()["tags"].get(stream, -1)

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def upsert(self, rows: DataFrame, order: Column | None = None, sticky: Sequence[str] = (), keep: Sequence[str] = (), add: Sequence[str] = (), tag: tuple[str, int] | None = None) -> bool:
        """Put rows in by key: False, and nothing done, if this tag (stream, batch number) or a later one is in already.

        Of several rows of a key the one with the greatest order counts (old ones too, if order is given; without it new
        rows replace old ones). Of each key, columns in sticky hold the greatest value ever seen, those in keep the one
        first stored, and those in add the sum of the old value and all new ones. Rows whose key holds a null are a
        key of their own. Two writers at once: the slower one starts over from what the faster left.
        """
        while True:
            manifest = self._manifest()
            if tag is not None and manifest["tags"].get(tag[0], -1) >= tag[1]:
                return False
            bucket, count = "bucket_", manifest["buckets"]
            new = rows.withColumns({bucket: self._bucket(count), "age_": F.lit(1), "order_": order if order is not None else F.lit(0)})
            names = [c for c in rows.columns if c not in self.keys]
            merged = new
            if manifest["schema"]:
                touched = [str(r[0]) for r in new.select(bucket).distinct().collect()]  # at most as many as buckets
                old = self._rows(manifest, [b for b in touched if b in manifest["held"]])
                merged = new.unionByName(old.withColumns({bucket: self._bucket(count), "age_": F.lit(0), "order_": order if order is not None else F.lit(0)}))
            rank = F.struct("order_", "age_") if order is not None else F.struct("age_", "order_")

            def chosen(c: str) -> Column:
                if c in add:
                    return F.sum(c)
                if c in sticky:
                    return F.max(c)
                return F.min_by(F.struct(c), F.struct("age_", "order_"))[c] if c in keep else F.max_by(F.struct(c), rank)[c]

            # dealt by bucket first, so that grouping by bucket and key needs no second shuffle
            merged = merged.repartition(count, bucket).groupBy(bucket, *self.keys).agg(*(chosen(c).cast(rows.schema[c].dataType).alias(c) for c in names))
            folder = uuid.uuid4().hex
            merged.select(bucket, *rows.columns).write.partitionBy(bucket).parquet(f"{self.path}/data/{folder}")
            held = {n.removeprefix(f"{bucket}="): folder for n in self._folder.names(f"data/{folder}") if n.startswith(f"{bucket}=")}
            manifest |= {"version": manifest["version"] + 1, "schema": json.dumps(rows.schema.jsonValue()), "held": manifest["held"] | held}
            if tag is not None:
                manifest["tags"] = manifest["tags"] | {tag[0]: tag[1]}
            if self._folder.put(f"manifests/{manifest['version']:012d}", json.dumps(manifest)):
                return True
            self._folder.drop(f"data/{folder}")

    def vacuum(self, keep: int = 10) -> None:
        """Remove manifests but the newest, and data that none of those names. Readers of older manifests then fail."""
        names = self._folder.names("manifests")
        for name in names[:-keep]:
            self._folder.drop(f"manifests/{name}")
        used = {f for n in names[-keep:] for f in json.loads(self._folder.read(f"manifests/{n}"))["held"].values()}
        for folder in self._folder.names("data"):
            if folder not in used:
                self._folder.drop(f"data/{folder}")
