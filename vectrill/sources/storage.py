"""Versioned storage: immutable Parquet segments and one manifest a generation, committed by exclusive create.

Layout under a collection's folder: ``_manifest/<generation>.json``, ``segments/<uuid>``, ``deletes/<uuid>`` and
``codes/<uuid>``. All file access goes through Hadoop's FileSystem, so the root may be any path that Spark can open.
A reader pins one manifest, which is its snapshot. A writer writes its files first and then creates the next manifest;
if that one exists by then, another writer won, and the write is worked out again on the new state.
"""

from __future__ import annotations

import random
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CollectionNotFoundError, CorruptedMetadataError, WriteConflictError
from ..schema import ROW, Manifest

KEEP_MANIFESTS = 20
STALE_CLAIM_S = 60
#: Files younger than this may belong to a write that hasn't been committed yet.
YOUNG_S = 24 * 3600


def checkpointed(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the checkpoint folder, or on one machine a temporary one."""
    sc = spark.sparkContext
    there = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if there is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        there = tempfile.mkdtemp(prefix="vectrill-")
        sc.setCheckpointDir(there)
    return there


class Files:
    """The few file operations that the catalog needs, over Hadoop's FileSystem."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root
        self.fs = self._path(root).getFileSystem(self.conf)

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(path))]

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a new file whole; False if it exists. The rename is what makes it visible, so no reader sees a part."""
        target, temporary = self._path(path), self._path(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(temporary, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            # An empty claim, created exclusively, decides between writers; local renames would silently overwrite.
            claim = self._path(f"{path}.claim")
            try:
                self.fs.create(claim, False).close()
            except Exception as e:
                if "already exists" not in str(e) and "FileAlreadyExists" not in str(e):
                    raise
                self._break_claim(claim, target)
                return False
            return bool(self.fs.rename(temporary, target))
        finally:
            self.fs.delete(temporary, False)

    def _break_claim(self, claim, target) -> None:
        """Take away the claim of a writer that died between claiming and renaming."""
        try:
            age = time.time() - self.fs.getFileStatus(claim).getModificationTime() / 1000
            if age > STALE_CLAIM_S and not self.fs.exists(target):
                self.fs.delete(claim, False)
        except Exception as e:
            if "FileNotFound" not in str(e) and "does not exist" not in str(e):
                raise

    def age(self, path: str) -> float:
        """Seconds since the newest change of an entry or of what it holds directly."""
        top = self.fs.getFileStatus(self._path(path))
        times = [top.getModificationTime(), *(x.getModificationTime() for x in self.fs.listStatus(self._path(path)))]
        return time.time() - max(times) / 1000

    def delete(self, path: str) -> bool:
        return self.fs.delete(self._path(path), True)

    def size(self, path: str) -> int:
        return self.fs.getContentSummary(self._path(path)).getLength() if self.exists(path) else 0


class Store:
    """Manifests and data of one collection."""

    def __init__(self, spark: SparkSession, path: str, lock_timeout: float = 30.0):
        self.spark, self.path, self.lock_timeout = spark, path.rstrip("/"), lock_timeout
        self.files = Files(spark, self.path)

    def generations(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(f"{self.path}/_manifest") if n.endswith(".json") and n[:-5].isdigit())

    def exists(self) -> bool:
        return bool(self.generations())

    def load(self) -> Manifest:
        for _ in range(20):
            found = self.generations()
            if not found:
                raise CollectionNotFoundError(f"stale handle: there is no collection at {self.path}")
            try:
                return Manifest.load(self.files.read(f"{self.path}/_manifest/{found[-1]}.json"))
            except CorruptedMetadataError:
                raise
            except Exception:  # vacuumed between listing and reading
                time.sleep(0.05)
        raise CorruptedMetadataError(f"the latest manifest of {self.path} can't be read")

    def commit(self, manifest: Manifest) -> bool:
        return self.files.create(f"{self.path}/_manifest/{manifest.store_gen}.json", manifest.dump())

    def update(self, change: Callable[[Manifest], Manifest | None], guard: Callable[[Manifest], None] | None = None) -> Manifest:
        """Commit ``change(current)``; on a conflict, back off and work it out again from the new state.

        ``change`` returns None for nothing to do, and is free to raise; nothing is visible until the commit.
        """
        deadline, pause = time.monotonic() + self.lock_timeout, 0.05
        while True:
            current = self.load()
            if guard:
                guard(current)
            new = change(current)
            if new is None:
                return current
            # A file that somebody took away meanwhile must not be committed; the write is worked out again.
            if all(self.files.exists(p) for p in self._paths(new) - self._paths(current)) and self.commit(new):
                return new
            if time.monotonic() > deadline:
                raise WriteConflictError(f"could not commit to {self.path} within {self.lock_timeout} s: other writers came first")
            time.sleep(pause * random.uniform(0.5, 1.5))
            pause = min(1.0, pause * 2)

    def new_path(self, kind: str) -> str:
        return f"{self.path}/{kind}/{uuid.uuid4().hex}"

    def write(self, df: DataFrame, kind: str) -> str:
        path = self.new_path(kind)
        df.write.parquet(path)
        return path

    @staticmethod
    def _paths(manifest: Manifest) -> set[str]:
        return {p for p, _ in manifest.segments} | {p for p, _ in manifest.deletes} | set(manifest.codes.values())

    def _stamped(self, entries: list, schema, columns: list[str], stamp: str) -> DataFrame:
        """All entries ``[path, generation]`` in one scan, with their generation; the manifest bounds their number."""
        paths, stamps = [e[0] for e in entries], {e[0].rsplit("/", 1)[1]: e[1] for e in entries}
        rows = self.spark.read.schema(schema).parquet(*paths)
        rows = rows.select(*columns, F.regexp_extract(F.col("_metadata.file_path"), "/([0-9a-f]{32})/[^/]*$", 1).alias("_entry"))
        known = self.spark.createDataFrame(list(stamps.items()), f"_entry string, {stamp} long")
        return rows.join(F.broadcast(known), "_entry").drop("_entry")

    def _live(self, manifest: Manifest, entries: list, schema, columns: list[str]) -> DataFrame:
        """Without deletes this is a plain scan: filters and columns reach Parquet."""
        if not manifest.deletes:
            return self.spark.read.schema(schema).parquet(*[p for p, _ in entries]).select(*columns)
        rows = self._stamped(entries, schema, columns, "_gen")
        gone = self._stamped(manifest.deletes, "uid long", ["uid"], "before").groupBy("uid").agg(F.max("before").alias("before"))
        hidden = (rows["uid"] == gone["uid"]) & (rows["_gen"] < gone["before"])
        return rows.join(gone, hidden, "left_anti").select(*columns)

    def rows(self, manifest: Manifest) -> DataFrame:
        """Live rows of a generation."""
        if not manifest.segments:
            return self.spark.createDataFrame([], ROW)
        return self._live(manifest, manifest.segments, ROW, ROW.names)

    def codes(self, manifest: Manifest) -> DataFrame | None:
        """Live codes (uid, code, angle) of a generation; None if some segment has none yet. Codes written without angles
        have nulls there."""
        if not manifest.segments or not all(p in manifest.codes for p, _ in manifest.segments):
            return None
        return self._live(manifest, [[manifest.codes[p], g] for p, g in manifest.segments], "uid long, code binary, angle double", ["uid", "code", "angle"])

    def vacuum(self, keep: int = KEEP_MANIFESTS, older_than: float = YOUNG_S) -> int:
        """Remove files that none of the last ``keep`` generations refers to; the number of removed entries.

        Files younger than ``older_than`` seconds stay: a writer under way may be about to commit them.
        """
        found = self.generations()
        live: set[str] = set()
        for g in found[-keep:]:
            live |= self._paths(Manifest.load(self.files.read(f"{self.path}/_manifest/{g}.json")))
        removed = 0
        for kind in ("segments", "deletes", "codes"):
            for name in self.files.names(f"{self.path}/{kind}"):
                path = f"{self.path}/{kind}/{name}"
                if path not in live and (older_than <= 0 or self.files.age(path) >= older_than):
                    removed += self.files.delete(path)
        for g in found[:-keep]:
            removed += self.files.delete(f"{self.path}/_manifest/{g}.json")
            self.files.delete(f"{self.path}/_manifest/{g}.json.claim")
        return removed
