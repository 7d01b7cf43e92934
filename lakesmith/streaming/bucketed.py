"""A keyed state table of which a batch rewrites only the buckets it touches (I4, M2).

Rows live in buckets by the hash of their key.  A *version* is one manifest file: for every bucket, the
folder that holds it.  A batch reads its buckets through the manifest, writes their new content into a
folder of the next version and then switches by renaming that version's manifest into place.  Until the
rename the old version stays whole, whatever the batch has written; folders of untouched buckets are
carried over by name and never opened.

    <path>/v=3-5f0c21aa/_bucket=17/part-….parquet
    <path>/manifests/00000003.json

The manifest holds one entry a bucket (a number fixed when the state is created), the last batch that was
folded in — a batch that comes again changes nothing — and the next free id.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "_bucket"


@dataclass
class Version:
    """What one manifest file says."""

    number: int
    n_buckets: int
    last_batch: int = -1
    next_id: int = 1
    folders: dict[str, str] = field(default_factory=dict)


class _Store:
    """The few file operations a manifest needs, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(path).getFileSystem(self._conf)

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, file: str) -> str:
        stream = self.fs.open(self._path(file))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, file: str, text: str) -> None:
        """Write beside ``file``, then rename: readers see the whole file or none."""
        draft = f"{file}.draft"
        stream = self.fs.create(self._path(draft), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.fs.exists(self._path(file)) or not self.fs.rename(self._path(draft), self._path(file)):
            raise RuntimeError(f"version {file} exists already: another writer was faster")


class BucketedState:
    """A table at ``path`` keyed by column ``key``, in ``n_buckets`` buckets (of a new state; an existing one
    keeps its number).  One writer at a time; a second one fails at the switch and changes nothing."""

    def __init__(self, spark: SparkSession, path: str, key: str, n_buckets: int = 64):
        self.spark, self.path, self.key, self._n = spark, path.rstrip("/"), key, n_buckets
        self._store = _Store(spark, path)

    def version(self) -> Version | None:
        """The current version; None before the first batch."""
        found = [n for n in self._store.names(f"{self.path}/manifests") if n.endswith(".json")]
        return Version(**json.loads(self._store.read(f"{self.path}/manifests/{found[-1]}"))) if found else None

    def _bucket(self, n_buckets: int):
        return F.pmod(F.xxhash64(self.key), F.lit(n_buckets)).cast("int")

    def read(self, buckets: list[int] | None = None, version: Version | None = None) -> DataFrame | None:
        """The rows of all (or some) buckets of the current (or a given) version; None if there are none."""
        version = version or self.version()
        if version is None:
            return None
        wanted = version.folders if buckets is None else {str(b): version.folders[str(b)] for b in buckets if str(b) in version.folders}
        if not wanted:
            return None
        paths = [f"{self.path}/{folder}/{BUCKET}={b}" for b, folder in wanted.items()]
        return self.spark.read.option("mergeSchema", "true").parquet(*paths)

    def merge(self, batch: DataFrame, batch_id: int, fold: Callable[[DataFrame | None, DataFrame, int], DataFrame],
              id_col: str | None = None, before_switch: Callable[[], None] | None = None) -> Version:
        """Fold ``batch`` into the buckets of its keys and switch to the result.

        ``fold(old, batch, next_id)`` gives the new content of the touched buckets from their old content
        (None if they hold nothing) and the batch; every key it returns must come from the two.  Rows of
        null key are left out.  ``before_switch`` runs after the data is written (tests stop there)."""
        now = self.version() or Version(0, self._n)
        if batch_id <= now.last_batch:
            return now
        rows = batch.where(F.col(self.key).isNotNull())
        touched = [r[0] for r in rows.select(self._bucket(now.n_buckets)).distinct().collect()]  # at most n_buckets
        new = Version(now.number + 1, now.n_buckets, batch_id, now.next_id, dict(now.folders))
        if touched:
            folder = f"v={new.number}-{uuid.uuid4().hex[:8]}"  # of this attempt alone
            content = fold(self.read(touched, now) if now.folders else None, rows, now.next_id)
            (content.withColumn(BUCKET, self._bucket(now.n_buckets)).repartition(BUCKET)
             .write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}"))
            new.folders.update({str(b): folder for b in touched})
            if id_col:
                top = self.read(touched, new).agg(F.max(id_col)).first()[0]
                new.next_id = max(now.next_id, (top or 0) + 1)
        if before_switch:
            before_switch()
        self._store.publish(f"{self.path}/manifests/{new.number:08d}.json", json.dumps(asdict(new)))
        return new

    def at(self, number: int) -> DataFrame | None:
        """The rows of an earlier version (its folders stay until they are removed from outside)."""
        return self.read(version=Version(**json.loads(self._store.read(f"{self.path}/manifests/{number:08d}.json"))))
