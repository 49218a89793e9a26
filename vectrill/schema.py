"""Row schema, limits, validators, and the manifest that describes one generation of a collection."""

from __future__ import annotations

import json
import math
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

from .errors import CorruptedMetadataError, DimensionMismatchError

ROW = T.StructType(
    [
        T.StructField("uid", T.LongType(), False),
        T.StructField("id", T.StringType(), False),
        T.StructField("document", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("vector", T.ArrayType(T.FloatType(), False)),
    ]
)
SCHEMA_VERSION = 1
DEFAULT_BIT_WIDTH = 4
BIT_WIDTHS = (2, 3, 4)
MAX_DIM = 16_384
METRIC = "cosine"
#: Squares of smaller norms aren't told apart from zero in single precision.
MIN_NORM = 1.1920929e-07
_NAME = re.compile(r"[A-Za-z0-9_-]{1,128}")


def check_name(name: str) -> str:
    """Collection names are 1 to 128 of ``A-Z a-z 0-9 _ -``; checked before any file is touched."""
    if not isinstance(name, str) or not _NAME.fullmatch(name):
        raise ValueError(f"invalid collection name: {name!r}")
    return name


def check_dim(dim: int) -> int:
    if isinstance(dim, bool) or not isinstance(dim, int) or dim <= 0 or dim % 8 or dim > MAX_DIM:
        raise DimensionMismatchError(f"dim must be a positive multiple of 8 up to {MAX_DIM}, got {dim!r}")
    return dim


def check_bit_width(bits: int) -> int:
    if bits not in BIT_WIDTHS:
        raise ValueError(f"bit_width must be one of {BIT_WIDTHS}, got {bits!r}")
    return bits


def check_metric(metric: str) -> str:
    if metric != METRIC:
        raise ValueError(f"only the cosine metric is supported, got {metric!r}")
    return metric


def check_vector(vector, dim: int | None, what: str = "vector", allow_zero: bool = True) -> list[float]:
    """A flat list of finite floats of the right width; a query vector must not be zero either."""
    shape = getattr(vector, "shape", None)
    if shape is not None and len(shape) == 2 and shape[0] == 1:
        vector = vector[0]
    elif shape is None and len(vector) == 1 and hasattr(vector[0], "__len__"):
        vector = vector[0]
    try:
        out = [float(x) for x in vector]
    except TypeError:
        raise ValueError(f"{what} must be one row of numbers") from None
    if dim is not None and len(out) != dim:
        raise DimensionMismatchError(f"{what} has {len(out)} components, the collection has {dim}")
    if not all(map(math.isfinite, out)):
        raise ValueError(f"{what} has a component that is not finite")
    if not allow_zero and math.sqrt(sum(x * x for x in out)) < MIN_NORM:
        raise ValueError(f"{what} is zero")
    return out


@dataclass(frozen=True)
class Manifest:
    """One committed generation. ``segments`` hold rows and ``deletes`` hold uids; each entry is ``[path, generation]``.

    A delete hides rows of its uid in segments of earlier generations, so an upsert is one new segment and one delete,
    and no write touches data that is there.
    """

    dim: int | None = None
    bit_width: int = DEFAULT_BIT_WIDTH
    metric: str = METRIC
    next_uid: int = 0
    store_gen: int = 0
    index_gen: int = -1
    embedder_identity: str | None = None
    segments: list = field(default_factory=list)
    deletes: list = field(default_factory=list)
    codes: dict = field(default_factory=dict)
    schema_version: int = SCHEMA_VERSION

    def dump(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def load(text: str) -> Manifest:
        try:
            raw = json.loads(text)
            m = Manifest(**{k: raw[k] for k in Manifest.__dataclass_fields__ if k in raw})
        except (ValueError, TypeError) as e:
            raise CorruptedMetadataError(f"unreadable manifest: {e}") from None
        for key in ("next_uid", "store_gen", "bit_width", "schema_version"):
            if isinstance(getattr(m, key), bool) or not isinstance(getattr(m, key), int):
                raise CorruptedMetadataError(f"manifest field {key} is not an integer: {getattr(m, key)!r}")
        if m.schema_version > SCHEMA_VERSION:
            raise CorruptedMetadataError(f"schema version {m.schema_version} is newer than {SCHEMA_VERSION}")
        if m.dim is None and m.next_uid > 0:
            raise CorruptedMetadataError("dim is missing from a collection that has had rows")
        if m.dim is not None and (isinstance(m.dim, bool) or not isinstance(m.dim, int)):
            raise CorruptedMetadataError(f"manifest field dim is not an integer: {m.dim!r}")
        return m
