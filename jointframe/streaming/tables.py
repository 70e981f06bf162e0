"""Keyed tables that micro-batches keep up to date, in place of state inside the stream."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jointframe.session import durable

BUCKET = "_bucket"


class KeyedTable:
    """Rows in buckets of their key, with versions and a pointer.

    A batch writes a new version that holds only the buckets its keys fall
    into, and then a pointer file that names the versions of every bucket.
    Readers follow the newest pointer, so they see a batch whole or not at all,
    and what a failed attempt left behind is written over by the next one. The
    pointer carries the batch's number: a batch that comes again changes
    nothing. Versions that neither of the last two pointers names are deleted.

    ``replace`` gives buckets new content; ``append`` adds rows to them and
    rewrites a bucket once it has gathered ``most`` versions, so either costs
    what the batch touches. Only bucket and version numbers reach the driver.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: Sequence[str], buckets: int = 16, most: int = 16):
        self.spark, self.folder, self.keys, self.buckets, self.most = spark, folder, list(keys), buckets, most
        self.schema = T.StructType.fromDDL(schema)
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    # -- files ------------------------------------------------------------------------------

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self._conf)

    def _versions(self, kind: str) -> list[int]:
        fs, path = self._fs(), self._path(kind)
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path)) if fs.exists(path) else []

    def _load(self, number: int) -> dict[int, list[int]]:
        stream = self._fs().open(self._path(f"pointer/{number}"))
        try:
            return {int(b): v for b, v in json.loads(bytes(stream.readAllBytes())).items()}
        finally:
            stream.close()

    def pointer(self) -> tuple[int, dict[int, list[int]]]:
        """(last batch or -1, versions of each bucket)."""
        last = max(self._versions("pointer"), default=-1)
        return last, self._load(last) if last >= 0 else {}

    def _switch(self, batch: int, versions: dict[int, list[int]]) -> None:
        fs, draft = self._fs(), self._path(f"draft-{batch}")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(versions).encode()))
        stream.close()
        self._fs().mkdirs(self._path("pointer"))
        fs.rename(draft, self._path(f"pointer/{batch}"))
        *old, before = [n for n in self._versions("pointer") if n < batch] or [batch]
        used = {v for n in {before, batch} for vs in self._load(n).values() for v in vs}
        for n in old:
            fs.delete(self._path(f"pointer/{n}"), False)
        for v in self._versions("data"):
            if v not in used:
                fs.delete(self._path(f"data/{v}"), True)

    # -- rows -------------------------------------------------------------------------------

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that the rows' keys fall into."""
        return [r[0] for r in rows.select(self.bucket()).distinct().collect()]

    def read(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows, or those of some buckets; other buckets are not read."""
        _, versions = self.pointer()
        chosen = versions if buckets is None else {b: versions.get(b, []) for b in buckets}
        paths = [f"{self.folder}/data/{v}/{BUCKET}={b}" for b, vs in sorted(chosen.items()) for v in vs]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _write(self, batch: int, rows: DataFrame) -> list[int]:
        """The buckets in which the version has rows."""
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema], self.bucket().alias(BUCKET))
        target = f"{self.folder}/data/{batch}"
        # Few files a bucket: small partitions are put together, large ones split.
        rows.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(target)
        return [int(n.split("=")[1]) for s in self._fs().listStatus(self._path(f"data/{batch}")) if (n := s.getPath().getName()).startswith(BUCKET)]

    def done(self, batch: int) -> bool:
        return self.pointer()[0] >= batch

    def replace(self, batch: int, buckets: Iterable[int], rows: DataFrame) -> None:
        """Give the buckets the rows as their new content."""
        last, versions = self.pointer()
        if last < batch:
            have = self._write(batch, rows)
            self._switch(batch, {**{b: v for b, v in versions.items() if b not in set(buckets)}, **{b: [batch] for b in have}})

    def update(self, batch: int, rows: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> None:
        """Put rows, one a key, into the buckets of their keys; ``merge`` makes one row a key of old and new ones."""
        last, versions = self.pointer()
        if last < batch and not versions:
            self.replace(batch, [], rows)
        elif last < batch:
            new = durable(rows)
            touched = self.touched(new)
            self.replace(batch, touched, merge(self.read(touched).unionByName(new)))

    def append(self, batch: int, rows: DataFrame) -> None:
        """Add rows whose keys are not in the table."""
        last, versions = self.pointer()
        if last < batch:
            full = [b for b, v in versions.items() if len(v) >= self.most]
            have = self._write(batch, rows.unionByName(self.read(full)) if full else rows)
            kept = {b: v for b, v in versions.items() if b not in full}
            self._switch(batch, {**kept, **{b: [*kept.get(b, []), batch] for b in have}})
