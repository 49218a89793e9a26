"""Collections: insert, change, find and re-embed rows of (id, document, metadata, vector)."""

from __future__ import annotations

import dataclasses
import json
import logging
import time
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .errors import CollectionNotFoundError, DimensionMismatchError, WriteConflictError
from .functions.numbering import number_rows
from .functions.vectors import is_finite, l2_normalize, normalize
from .operators import embed, quantize, search
from .operators.filters import by_ids, compile_filters, compile_where
from .schema import Manifest
from .sources.storage import Store, checkpointed

log = logging.getLogger(__name__)
_DEFAULT_QUERY = ("documents", "metadatas", "distances")
#: Re-embedding with a progress callback works in at most this many steps.
PROGRESS_STEPS = 20
#: Segments below this size are merged by ``flush`` once there are that many of them.
SMALL_BYTES = 64 << 20
SMALL_SEGMENTS = 32


@dataclass
class QueryResult:
    ids: list
    distances: list
    documents: list
    metadatas: list
    vectors: list | None = None


@dataclass
class GetResult:
    ids: list
    documents: list
    metadatas: list
    vectors: list | None = None


@dataclass
class HealthResult:
    ok: bool
    quick_check: str
    store_gen: int
    index_gen: int
    coherent: bool
    doc_count: int
    store_bytes: int


@dataclass
class ReembedReport:
    total_docs: int
    old_dim: int | None
    new_dim: int | None
    skipped: int
    elapsed_seconds: float


def _plain(metadata: str | None) -> dict:
    return json.loads(metadata) if metadata else {}


def _dump(metadata) -> str:
    return metadata if isinstance(metadata, str) else json.dumps(metadata or {}, ensure_ascii=False)


class Collection:
    """A handle on one collection. It holds no state but the path: every call reads the latest manifest, which is then
    the snapshot that the call works on.

    Small batches come as lists, tables of any size as DataFrames (``add_frame`` and ``upsert_frame``); results come as
    lists, or lazily as DataFrames (``frame``, ``query_frame``).
    """

    def __init__(self, spark: SparkSession, path: str, *, dim=None, bit_width=None, metric=None, embedder=None, create=True, lock_timeout: float = 30.0):
        self.spark, self.path, self.embedder = spark, path.rstrip("/"), embedder
        self.name = self.path.rsplit("/", 1)[-1]
        self._store = Store(spark, path, lock_timeout)
        schema.check_metric(schema.METRIC if metric is None else metric)
        if dim is not None:
            schema.check_dim(dim)
        if bit_width is not None and dim is not None:
            schema.check_bit_width(bit_width)
        if not self._store.exists():
            if not create:
                raise CollectionNotFoundError(f"no collection {self.name!r}")
            first = Manifest(dim=dim, bit_width=schema.DEFAULT_BIT_WIDTH if bit_width is None else bit_width, embedder_identity=embed.identity_of(embedder))
            if dim is not None:
                schema.check_bit_width(first.bit_width)
            self._store.commit(first)
        now = self._store.load()
        for what, asked, there in (("dim", dim, now.dim), ("bit_width", bit_width, now.bit_width)):
            if asked is not None and there is not None and asked != there:
                raise (DimensionMismatchError if what == "dim" else ValueError)(f"collection {self.name!r} has {what} {there}, not {asked}")

    # ---- what is there -----------------------------------------------------------------------------------------

    @property
    def dim(self) -> int | None:
        return self._store.load().dim

    @property
    def bit_width(self) -> int:
        return self._store.load().bit_width

    @property
    def store_gen(self) -> int:
        return self._store.load().store_gen

    @property
    def embedder_identity(self) -> str | None:
        return self._store.load().embedder_identity

    @property
    def lock_timeout(self) -> float:
        return self._store.lock_timeout

    def meta_get(self, key: str, default=None):
        value = getattr(self._store.load(), key, None)
        return default if value is None else value

    def frame(self, where=None, where_document=None, ids=None) -> DataFrame:
        """Live rows (uid, id, document, metadata, vector) of the latest generation that pass the filters; lazy."""
        return self._rows(self._store.load(), where, where_document, ids)

    def _rows(self, manifest: Manifest, where=None, where_document=None, ids=None) -> DataFrame:
        condition = compile_filters(where, where_document)
        rows = self._store.rows(manifest)
        rows = rows if condition is None else rows.where(condition)
        return rows if ids is None else by_ids(rows, list(ids))

    def count(self) -> int:
        return self._store.rows(self._store.load()).count()

    def get(self, *, ids=None, where=None, where_document=None, limit=None, offset=None, include=None) -> GetResult:
        """Rows in the order they were first added. ``offset`` counts only together with ``limit``."""
        include = ("documents", "metadatas") if include is None else tuple(include)
        rows = self.frame(where, where_document, ids).orderBy("uid")
        if limit is not None:
            rows = rows.offset(int(offset or 0)).limit(int(limit))
        wanted = {"documents": "document", "metadatas": "metadata", "vectors": "vector"}
        found = rows.select("uid", "id", *[c for n, c in wanted.items() if n in include]).collect()
        return GetResult(
            ids=[r["id"] for r in found],
            documents=[(r["document"] or "") if "documents" in include else None for r in found],
            metadatas=[_plain(r["metadata"]) if "metadatas" in include else {} for r in found],
            vectors=[list(r["vector"]) for r in found] if "vectors" in include else None,
        )

    # ---- nearest neighbours ------------------------------------------------------------------------------------

    def query(self, *, text=None, vector=None, k: int = 10, where=None, where_document=None, include=None, approximate: bool = False) -> QueryResult:
        """The ``k`` nearest rows to one text or vector, among those that pass the filters, nearest first."""
        if (text is None) == (vector is None):
            raise ValueError("give exactly one of text and vector")
        now = self._store.load()
        if text is not None:
            embed.check_identity(now.embedder_identity, self.embedder, now.next_uid > 0)
            vector = embed.run(self.embedder, [text], now.dim)[0]
        return self._answer(now, [vector], k, where, where_document, include, approximate)[0]

    def query_batch(self, *, vectors, k: int = 10, where=None, where_document=None, include=None, approximate: bool = False) -> list[QueryResult]:
        """``query`` for many vectors in one job; the result has one entry a vector, also from an empty collection."""
        return self._answer(self._store.load(), list(vectors), k, where, where_document, include, approximate)

    def _answer(self, now: Manifest, vectors, k, where, where_document, include, approximate) -> list[QueryResult]:
        queries = [schema.check_vector(v, now.dim, "query vector", allow_zero=False) for v in vectors]
        include = _DEFAULT_QUERY if include is None else tuple(include)
        rows = self._rows(now, where, where_document)
        out = [QueryResult([], [], [], [], [] if "vectors" in include else None) for _ in queries]
        if not queries or k <= 0 or not now.segments:
            return out
        hits = self._search(now, rows, np.array(queries), k, approximate, where is None and where_document is None)
        names = {"documents": "document", "metadatas": "metadata", "vectors": "vector"}
        # Rank on uid and vector alone, then fetch the wide columns for the few that are left.
        few = F.broadcast(hits) if len(queries) * k <= 100_000 else hits
        found = rows.select("uid", "id", *[c for n, c in names.items() if n in include]).join(few, "uid").orderBy("query_id", "rank").collect()
        for r in found:
            q = out[r["query_id"]]
            q.ids.append(r["id"])
            if "distances" in include:
                q.distances.append(r["distance"])
            if "documents" in include:
                q.documents.append(r["document"] or "")
            if "metadatas" in include:
                q.metadatas.append(_plain(r["metadata"]))
            if "vectors" in include:
                q.vectors.append(list(r["vector"]))
        return out

    def _search(self, now: Manifest, rows: DataFrame, queries: np.ndarray, k: int, approximate: bool, whole: bool) -> DataFrame:
        if not approximate:
            return search.knn(rows, queries, k)
        coded = self._store.codes(now)
        if coded is not None and not whole:
            coded = coded.join(rows.select("uid"), "uid", "left_semi")
        return quantize.knn_quantized(rows, queries, k, now.bit_width, coded=coded)

    def query_frame(self, vectors, k: int = 10, where=None, where_document=None, approximate: bool = False) -> DataFrame:
        """``query_id, rank, id, distance, document, metadata, vector``, lazily; ``vectors`` is a matrix or, for exact
        search, a DataFrame (query_id, vector) of any size."""
        now = self._store.load()
        rows = self._rows(now, where, where_document)
        if isinstance(vectors, DataFrame):
            if approximate:
                raise ValueError("approximate search takes a matrix of queries")
            hits = search.knn_join(rows, vectors, k)
        else:
            hits = self._search(now, rows, np.atleast_2d(np.asarray(vectors, np.float64)), k, approximate, where is None and where_document is None)
        return hits.join(rows, "uid").select("query_id", "rank", "id", "distance", "document", "metadata", "vector")

    def candidate_pairs(self, threshold: float = 0.15, k: int = 6) -> DataFrame:
        """Near-duplicate pairs ``a, b, distance`` by id, with the ``title`` and ``type`` of each side's metadata."""
        rows = self.frame()
        pairs = search.candidate_pairs(rows, threshold, k, "id")
        value = F.try_parse_json("metadata")
        titles = rows.select("id", *[F.coalesce(F.try_variant_get(value, f"$.{x}", "string"), F.lit("")).alias(x) for x in ("title", "type")])
        for side in ("a", "b"):
            pairs = pairs.join(titles.select(F.col("id").alias(side), F.col("title").alias(f"{side}_title"), F.col("type").alias(f"{side}_type")), side)
        return pairs.select("a", "b", "distance", "a_title", "b_title", "a_type", "b_type").orderBy("distance", "a", "b")

    # ---- changes -----------------------------------------------------------------------------------------------

    def add(self, *, ids, documents=None, metadatas=None, vectors=None) -> None:
        """Insert new rows; an id that is there already, or twice in the batch, is a ``ValueError`` and nothing is
        written. Without ``vectors`` the documents are embedded."""
        self._write(ids, documents, metadatas, vectors, upsert=False)

    def upsert(self, *, ids, documents=None, metadatas=None, vectors=None) -> None:
        """Insert rows or replace them whole (document, metadata and vector); a replaced row keeps its place."""
        self._write(ids, documents, metadatas, vectors, upsert=True)

    def _write(self, ids, documents, metadatas, vectors, upsert: bool) -> None:
        ids = list(ids)
        for what, values in (("documents", documents), ("metadatas", metadatas), ("vectors", vectors)):
            if values is not None and len(values) != len(ids):
                raise ValueError(f"{what} has {len(values)} entries for {len(ids)} ids")
        if not ids:
            return
        if any(not isinstance(i, str) for i in ids):
            raise ValueError("ids must be strings")
        if len(set(ids)) != len(ids):
            raise ValueError("an id occurs twice in the batch")
        if vectors is None and documents is None:
            raise ValueError("give documents or vectors")
        now = self._store.load()
        if vectors is not None:
            if self.embedder is not None:
                log.warning("vectors were given although the collection has an embedder; they are stored as they are")
            width = now.dim or len(np.asarray(vectors[0], np.float32).ravel())
            rows = np.array([schema.check_vector(v, width) for v in vectors], np.float32)
        else:
            embed.check_identity(now.embedder_identity, self.embedder, now.next_uid > 0)
            rows = embed.run(self.embedder, [d or "" for d in documents], now.dim)
        dim = schema.check_dim(int(rows.shape[1]))
        rows = l2_normalize(rows)
        documents = [d or "" for d in documents] if documents is not None else [""] * len(ids)
        metadatas = [_dump(m) for m in metadatas] if metadatas is not None else ["{}"] * len(ids)

        def guard(current: Manifest) -> None:
            if vectors is None:
                embed.check_identity(current.embedder_identity, self.embedder, current.next_uid > 0)

        def change(current: Manifest) -> Manifest:
            if current.dim is not None and current.dim != dim:
                raise DimensionMismatchError(f"vectors have width {dim}, the collection has {current.dim}")
            schema.check_bit_width(current.bit_width)
            there = {r["id"]: r["uid"] for r in by_ids(self._store.rows(current).select("uid", "id"), ids).collect()}
            if there and not upsert:
                raise ValueError(f"ids that exist already: {sorted(there)[:5]}")
            uid, uids = current.next_uid, []
            for i in ids:
                uids.append(there.get(i, uid))
                uid += i not in there
            data = list(zip(uids, ids, documents, metadatas, rows.tolist(), strict=True))
            segment = self._store.write(self.spark.createDataFrame(data, schema.ROW), "segments")
            gone = self.spark.createDataFrame([(u,) for u in there.values()], "uid long") if there else None
            identity = current.embedder_identity
            if identity is None and vectors is None:
                identity = embed.identity_of(self.embedder)
            return self._next(current, segment, gone, dim=dim, next_uid=uid, embedder_identity=identity)

        self._store.update(change, guard)

    def _next(self, current: Manifest, segment: str | None, gone: DataFrame | None, **fields) -> Manifest:
        """The next generation: one more segment, and one more set of deletes that hides older rows."""
        gen = current.store_gen + 1
        segments = [*current.segments, *([[segment, gen]] if segment else [])]
        deletes = [*current.deletes, *([[self._store.write(gone.select("uid"), "deletes"), gen]] if gone is not None else [])]
        return dataclasses.replace(current, store_gen=gen, segments=segments, deletes=deletes, **fields)

    def add_frame(self, df: DataFrame, order: str | None = None) -> None:
        """``add`` for a DataFrame (id, vector, and if there document, metadata) of any size; nothing is collected."""
        self._write_frame(df, order, upsert=False)

    def upsert_frame(self, df: DataFrame, order: str | None = None) -> None:
        """``upsert`` for a DataFrame; of an id that occurs twice the last row in ``order`` counts."""
        self._write_frame(df, order, upsert=True)

    def _write_frame(self, df: DataFrame, order: str | None, upsert: bool) -> None:
        now = self._store.load()
        df = df.withColumn("document", F.coalesce("document", F.lit("")) if "document" in df.columns else F.lit(""))
        df = df.withColumn("metadata", F.coalesce("metadata", F.lit("{}")) if "metadata" in df.columns else F.lit("{}"))
        df = df.withColumn("_order", F.col(order) if order else F.col("id"))
        if "vector" not in df.columns:
            embed.check_identity(now.embedder_identity, self.embedder, now.next_uid > 0)
            first = df.select("document").first()
            if first is None:
                return
            width = now.dim or int(embed.run(self.embedder, [first[0]]).shape[1])
            df = embed.embed_frame(df, self.embedder, width)
        df = checkpointed(df.select("_order", "id", "document", "metadata", F.col("vector").cast("array<float>").alias("vector")))
        n, ids, low, high, good = df.agg(
            F.count(F.lit(1)), F.count_distinct("id"), F.min(F.size("vector")), F.max(F.size("vector")), F.coalesce(F.bool_and(is_finite("vector") & F.col("id").isNotNull()), F.lit(True))
        ).first()
        if not n:
            return
        if not good or low != high or low < 1:
            raise (ValueError if not good else DimensionMismatchError)("every row needs an id and a finite vector of one width")
        dim = schema.check_dim(low)
        if n != ids and not upsert:
            raise ValueError("an id occurs twice in the batch")
        if n != ids:
            last = df.groupBy("id").agg(F.max_by(F.struct("document", "metadata", "vector", "_order"), F.struct("_order", "document", "metadata")).alias("r"))
            df = last.select("id", "r.*")
        df = df.withColumn("vector", normalize("vector").cast("array<float>"))

        def change(current: Manifest) -> Manifest:
            if current.dim is not None and current.dim != dim:
                raise DimensionMismatchError(f"vectors have width {dim}, the collection has {current.dim}")
            # One join tells rows that are there from new ones; both are then read from its checkpoint.
            known = self._store.rows(current).select("uid", "id")
            split = checkpointed(df.join(known, "id", "left"))
            old = split.where("uid is not null")
            replaced = bool(old.limit(1).count())
            if not upsert and replaced:
                raise ValueError("some ids exist already")
            new = number_rows(split.where("uid is null").drop("uid"), ["_order", "id"], current.next_uid, "uid")
            data = new.select(*schema.ROW.names)
            segment = self._store.write(data.unionByName(old.select(*schema.ROW.names)) if replaced else data, "segments")
            return self._next(current, segment, old.select("uid") if replaced else None, dim=dim, next_uid=current.next_uid + new.count())

        self._store.update(change)

    def delete(self, *, ids=None, where=None) -> None:
        """Delete rows with one of ``ids`` that pass ``where``. **Without either, or with an empty filter alone, every
        row goes**; an empty list of ids deletes nothing."""
        if ids is not None and not list(ids):
            return
        compile_where(where)

        def change(current: Manifest) -> Manifest | None:
            gone = checkpointed(self._rows(current, where, None, ids).select("uid"))
            return self._next(current, None, gone) if gone.limit(1).count() else None

        self._store.update(change)

    def clear(self) -> None:
        """Delete every row; configuration and the numbering of rows go on."""

        def change(current: Manifest) -> Manifest | None:
            if not current.segments or not self._store.rows(current).limit(1).count():
                return None
            return dataclasses.replace(current, store_gen=current.store_gen + 1, segments=[], deletes=[], codes={})

        self._store.update(change)

    def update_metadata(self, *, ids, metadatas) -> None:
        """Replace (not merge) the metadata of rows; an unknown id is a ``ValueError`` and nothing changes."""
        self._replace(ids, [_dump(m) for m in metadatas], "metadata")

    def update_documents(self, *, ids, documents) -> None:
        """Replace the texts of rows; vectors stay as they are."""
        self._replace(ids, [d or "" for d in documents], "document")

    def _replace(self, ids, values: list[str], column: str) -> None:
        ids = list(ids)
        if len(ids) != len(values):
            raise ValueError(f"{len(values)} values for {len(ids)} ids")
        if not ids:
            return
        self.update_frame(self.spark.createDataFrame(list(dict(zip(ids, values, strict=True)).items()), f"id string, {column} string"))

    def update_frame(self, df: DataFrame) -> None:
        """Replace metadata, documents or both of the rows of a DataFrame (id, and ``metadata`` or ``document``) of any
        size; ids must be unique and known, or nothing changes."""
        columns = [c for c in ("document", "metadata") if c in df.columns]
        if not columns:
            raise ValueError("give a document or metadata column")
        new = checkpointed(df.select("id", *[F.coalesce(F.col(c), F.lit("" if c == "document" else "{}")).alias(f"new_{c}") for c in columns]))
        total, ids = new.agg(F.count(F.lit(1)), F.count_distinct("id")).first()
        if total != ids:
            raise ValueError("an id occurs twice, or is null")
        if not total:
            return

        def change(current: Manifest) -> Manifest:
            joined = checkpointed(new.join(self._store.rows(current), "id", "left"))
            unknown = [r[0] for r in joined.where("uid is null").select("id").limit(5).collect()]
            if unknown:
                raise ValueError(f"unknown ids: {unknown}")
            changed = joined.withColumns({c: F.col(f"new_{c}") for c in columns}).select(*schema.ROW.names)
            return self._next(current, self._store.write(changed, "segments"), joined)

        self._store.update(change)

    def reembed(self, embedder, *, dim: int | None = None, bit_width: int | None = None, batch_size: int = 256, on_progress=None, skip_empty: str = "error") -> ReembedReport:
        """Compute every vector anew from its document, with another embedder, width or bit width.

        Rows without text raise (``error``), keep their old vector (``keep``, only at the same width) or go (``drop``).
        Batches run on the executors. With ``on_progress`` the rows are worked through in up to 20 ranges of row numbers,
        a job and a segment each; ``on_progress(done, total)`` is called on the driver before the first and after each,
        and may raise to stop: nothing is committed then, and what was written is removed. Rows written meanwhile make
        the commit fail instead of being missed.
        """
        if skip_empty not in ("error", "keep", "drop"):
            raise ValueError("skip_empty must be error, keep or drop")
        start, now = time.monotonic(), self._store.load()
        if bit_width is not None:
            schema.check_bit_width(bit_width)
        rows = self._store.rows(now)
        empty = F.coalesce(F.col("document"), F.lit("")) == ""
        total, blank = rows.agg(F.count(F.lit(1)), F.count_if(empty)).first()
        if not total:
            return ReembedReport(0, now.dim, now.dim, 0, time.monotonic() - start)
        if blank and skip_empty == "error":
            raise ValueError(f"{blank} rows have no document")
        sample = rows.where(~empty).orderBy("uid").select("document").first()
        width = dim or (int(embed.run(embedder, [sample[0]]).shape[1]) if sample else now.dim)
        schema.check_dim(width)
        if blank and skip_empty == "keep" and width != now.dim:
            raise ValueError("rows without a document can't keep a vector of another width")
        steps = min(PROGRESS_STEPS, -(-total // batch_size)) if on_progress else 1
        span = max(1, -(-now.next_uid // steps))
        ranges = rows.groupBy(F.expr(f"uid div {span}").alias("step")).agg(F.count(F.lit(1)).alias("n")).collect() if steps > 1 else [(0, total)]
        segments, done = [], 0
        try:
            if on_progress:
                on_progress(0, total)
            for step, n in sorted(ranges):
                part = rows if steps == 1 else rows.where(F.col("uid").between(step * span, (step + 1) * span - 1))
                new = embed.embed_frame(part.where(~empty), embedder, width, batch_size).select(*schema.ROW.names)
                if blank and skip_empty == "keep":
                    new = new.unionByName(part.where(empty).withColumn("vector", normalize("vector").cast("array<float>")))
                segments.append(self._store.new_path("segments"))
                new.write.parquet(segments[-1])
                done += n
                if on_progress:
                    on_progress(done, total)
        except BaseException:
            for path in segments:
                self._store.files.delete(path)
            raise
        gen = now.store_gen + 1
        after = dataclasses.replace(
            now, dim=width, bit_width=bit_width or now.bit_width, embedder_identity=embed.identity_of(embedder), store_gen=gen, segments=[[p, gen] for p in segments], deletes=[], codes={}
        )
        if self._store.load().store_gen != now.store_gen or not self._store.commit(after):
            raise WriteConflictError("the collection changed during re-embedding; nothing was committed")
        self.embedder = embedder
        return ReembedReport(total, now.dim, width, blank, time.monotonic() - start)

    # ---- upkeep ------------------------------------------------------------------------------------------------

    def flush(self) -> None:
        """Merge small segments if there are many, write the codes of segments that have none yet, and record that the
        index is as new as the rows."""

        def change(current: Manifest) -> Manifest | None:
            current = self._merged(current)
            missing = [p for p, _ in current.segments if p not in current.codes]
            if not missing and current.index_gen == current.store_gen:
                return None
            codes = {p: c for p, c in current.codes.items() if any(p == s for s, _ in current.segments)}
            for p in missing:
                codes[p] = self._store.write(quantize.codes(self.spark.read.schema(schema.ROW).parquet(p), current.bit_width), "codes")
            return dataclasses.replace(current, store_gen=current.store_gen + 1, index_gen=current.store_gen + 1, codes=codes)

        self._store.update(change)

    def _merged(self, current: Manifest) -> Manifest:
        """``current`` with its small segments as one, if they are many; large ones are never rewritten.

        The merged segment is of the next generation and holds live rows only, so earlier deletes don't concern it; a
        delete that is older than every segment left is dropped.
        """
        if len(current.segments) < SMALL_SEGMENTS:
            return current
        small = [e for e in current.segments if self._store.files.size(e[0]) < SMALL_BYTES]
        if len(small) < SMALL_SEGMENTS:
            return current
        merged = self._store.write(self._store.rows(dataclasses.replace(current, segments=small)), "segments")
        segments = [*(e for e in current.segments if e not in small), [merged, current.store_gen + 1]]
        deletes = [d for d in current.deletes if any(g < d[1] for _, g in segments)]
        return dataclasses.replace(current, segments=segments, deletes=deletes)

    def compact(self) -> None:
        """Rewrite live rows into one segment, so that reads no longer subtract deletes."""

        def change(current: Manifest) -> Manifest | None:
            if len(current.segments) < 2 and not current.deletes:
                return None
            gen = current.store_gen + 1
            segment = self._store.write(self._store.rows(current), "segments")
            return dataclasses.replace(current, store_gen=gen, segments=[[segment, gen]], deletes=[], codes={})

        self._store.update(change)

    def vacuum(self, keep: int = 20, older_than: float | None = None) -> int:
        """Remove files that the last ``keep`` generations don't use and that are older than ``older_than`` seconds
        (a day, so that writes under way keep theirs)."""
        return self._store.vacuum(keep) if older_than is None else self._store.vacuum(keep, older_than)

    def health(self) -> HealthResult:
        """One aggregate over the rows: count, unique ids and uids, widths; and whether the index is up to date."""
        now = self._store.load()
        rows = self._store.rows(now)
        n, ids, uids, low, high, top, nulls = rows.agg(
            F.count(F.lit(1)), F.count_distinct("id"), F.count_distinct("uid"), F.min(F.size("vector")), F.max(F.size("vector")), F.max("uid"), F.count_if(F.col("vector").isNull() | F.col("id").isNull())
        ).first()
        faults = []
        if n and (low != high or low != now.dim):
            faults.append(f"vector widths {low} to {high}, expected {now.dim}")
        if ids != n or uids != n:
            faults.append("ids are not unique")
        if nulls:
            faults.append(f"{nulls} rows without id or vector")
        if n and top >= now.next_uid:
            faults.append("a row number is beyond the counter")
        coherent = now.index_gen == now.store_gen and all(p in now.codes for p, _ in now.segments) and self._codes_match(now)
        return HealthResult(not faults, "ok" if not faults else "; ".join(faults), now.store_gen, now.index_gen, coherent, n, self._store.files.size(self.path))

    def _codes_match(self, now: Manifest) -> bool:
        """Whether the stored codes belong to the rows: the same uids, each with a code of the right length."""
        codes = self._store.codes(now)
        if codes is None:
            return not now.segments
        size = (1 << (now.dim - 1).bit_length()) * now.bit_width // 8
        uids = [F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("uid")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("uid").cast("decimal(20,0)")), F.lit(0))]
        *mine, whole = codes.agg(*uids, F.coalesce(F.bool_and(F.octet_length("code") == size), F.lit(True))).first()
        return bool(whole) and mine == list(self._store.rows(now).agg(*uids).first())

    def fingerprint(self) -> DataFrame:
        return quantize.fingerprint(self.frame())

    def close(self) -> None:
        self.flush()

    def __enter__(self) -> Collection:
        return self

    def __exit__(self, kind, value, trace) -> None:
        try:
            self.flush()
        except Exception:
            if kind is None:
                raise
            log.exception("flush failed while another error was on its way")
