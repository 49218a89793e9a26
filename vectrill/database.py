"""Databases: a folder whose subfolders are collections."""

from __future__ import annotations

import os
import re

from pyspark.sql import SparkSession

from .collection import Collection
from .errors import CollectionNotFoundError
from .schema import check_name
from .sources.storage import Files, Store

_URI = re.compile(r"[a-zA-Z][a-zA-Z0-9+.-]*:")


class Database:
    """A handle; making one reads nothing. A plain path is made absolute at once, so a later change of the working
    folder can't move it; a URI is taken as it is."""

    def __init__(self, path: str, spark: SparkSession | None = None):
        path = os.fspath(path)
        self.path = path.rstrip("/") if _URI.match(path) else os.path.abspath(path)
        self._spark = spark
        self._open: dict[str, tuple[Collection, dict]] = {}

    @property
    def spark(self) -> SparkSession:
        if self._spark is None:
            self._spark = SparkSession.builder.getOrCreate()
        return self._spark

    def collection(self, name: str, *, dim=None, bit_width=None, metric=None, embedder=None, create: bool = True, lock_timeout: float = 30.0) -> Collection:
        """Open or create a collection; one handle a name. Asking an open handle for other options is an error."""
        check_name(name)
        asked = {"dim": dim, "bit_width": bit_width, "metric": metric, "embedder": embedder}
        if name in self._open:
            handle, options = self._open[name]
            if Store(self.spark, handle.path).exists():
                there = options | {"dim": options["dim"] or handle.dim, "bit_width": options["bit_width"] or handle.bit_width, "metric": options["metric"] or "cosine", "embedder": handle.embedder}
                for key, value in asked.items():
                    same = value is there[key] if key == "embedder" else value == there[key]
                    if value is not None and there[key] is not None and not same:
                        raise ValueError(f"collection {name!r} is already open with different options: {key}")
                if embedder is not None:
                    handle.embedder = embedder
                return handle
            del self._open[name]
        handle = Collection(self.spark, f"{self.path}/{name}", dim=dim, bit_width=bit_width, metric=metric, embedder=embedder, create=create, lock_timeout=lock_timeout)
        self._open[name] = (handle, asked)
        return handle

    def list_collections(self) -> list[str]:
        files = Files(self.spark, self.path)
        return sorted(n for n in files.names(self.path) if files.exists(f"{self.path}/{n}/_manifest"))

    def ensure_collection(self, name: str) -> None:
        if not Store(self.spark, f"{self.path}/{check_name(name)}").exists():
            raise CollectionNotFoundError(f"no collection {name!r}")

    def delete_collection(self, name: str) -> None:
        """Manifests go first, so readers see the collection vanish at once; then its data."""
        self.ensure_collection(name)
        self._open.pop(name, None)
        files = Files(self.spark, self.path)
        files.delete(f"{self.path}/{name}/_manifest")
        files.delete(f"{self.path}/{name}")

    def close(self) -> None:
        """Flush every open collection; errors are gathered into one."""
        failed = []
        for name, (handle, _) in list(self._open.items()):
            try:
                handle.close()
            except CollectionNotFoundError:
                pass
            except Exception as e:
                failed.append(f"{name}: {e}")
        self._open.clear()
        if failed:
            raise RuntimeError("closing failed for " + "; ".join(failed))

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def connect(path: str, spark: SparkSession | None = None) -> Database:
    return Database(path, spark)
