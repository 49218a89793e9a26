"""Embedding functions: their identity, and running them on the driver or over a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from ..errors import DimensionMismatchError, EmbedderIdentityMismatchError, EmbedderMismatchError, EmbedderRequiredError

UNKNOWN = "unknown"


def identity_of(embedder) -> str | None:
    """``_embedder_identity`` (text, callable or property), else ``__name__``, else ``module.Class``; None without one."""
    if embedder is None:
        return None
    named = getattr(embedder, "_embedder_identity", None)
    if callable(named):
        named = named()
    if isinstance(named, str) and named:
        return named
    name = getattr(embedder, "__name__", None)
    if isinstance(name, str) and name:
        return name
    kind = type(embedder)
    return f"{kind.__module__}.{kind.__qualname__}" if kind.__qualname__ else UNKNOWN


def check_identity(stored: str | None, embedder, has_rows: bool) -> None:
    """Refuse text work whose vectors wouldn't be comparable with those that are stored."""
    if embedder is None:
        raise EmbedderRequiredError("text was given, but the collection has no embedder")
    if stored is None:
        if has_rows:
            raise EmbedderMismatchError("the collection has rows but no embedder identity; re-embed it first")
        return
    mine = identity_of(embedder)
    if mine != stored:
        raise EmbedderIdentityMismatchError(f"the collection was embedded by {stored!r}, this embedder is {mine!r}")


def run(embedder: Callable, texts: list[str], dim: int | None = None) -> np.ndarray:
    """One call; the result must have a row for each text, all finite and of one width."""
    out = np.asarray(embedder(list(texts)), np.float32)
    if out.ndim == 1:
        out = out[None, :]
    if out.ndim != 2 or len(out) != len(texts):
        raise ValueError(f"the embedder returned {out.shape} for {len(texts)} texts")
    if dim is not None and out.shape[1] != dim:
        raise DimensionMismatchError(f"the embedder returned width {out.shape[1]}, expected {dim}")
    if not np.isfinite(out).all():
        raise ValueError("the embedder returned a component that is not finite")
    return out


def embed_frame(df: DataFrame, embedder: Callable, dim: int, batch_size: int = 256, text_col: str = "document") -> DataFrame:
    """``df`` with ``vector`` replaced by normalised embeddings of ``text_col``, a batch at a time on the executors.

    The embedder must be picklable. Batches don't cross partitions.
    """
    import pyarrow as pa

    from ..functions.vectors import l2_normalize

    rest = [c for c in df.columns if c != "vector"]
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)

    def work(batches):
        for b in batches:
            for i in range(0, b.num_rows, batch_size):
                part = b.slice(i, batch_size)
                texts = [t or "" for t in part.column(text_col).to_pylist()]
                out = l2_normalize(run(embedder, texts, dim))
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, dim), pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], vectors], [*rest, "vector"])

    return df.select(*rest).mapInArrow(work, f"{fields}, vector array<float>")
