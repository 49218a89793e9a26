"""The filter language on metadata JSON and document text, compiled to Column predicates.

Values compare in storage-class order: missing and null match nothing, numbers (booleans count as 0 and 1) come before
text, and text compares by bytes; lists and objects count as their compact JSON text. A value's own type decides, so
the text ``"2020"`` is never equal to the number 2020. Validation is complete before a Spark job is started.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import UnsupportedFilterError

MAX_DEPTH = 10
MAX_LIST = 900
_COMPARISONS = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte")
_MEMBERSHIP = ("$in", "$nin")
#: A path is names joined by dots, each with any number of indexes.
_PATH = re.compile(r"[^.\[\]'\"$*]+(\[\d+\])*(\.[^.\[\]'\"$*]+(\[\d+\])*)*")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class _Field:
    """The value at a path: ``num`` or ``txt`` is set, or neither for a missing or null value."""

    def __init__(self, metadata: Column, key: str):
        if not isinstance(key, str) or not key:
            raise UnsupportedFilterError(f"a field name must be a non-empty string, got {key!r}")
        if not _PATH.fullmatch(key):
            raise UnsupportedFilterError(f"{key!r} is not a path of names (a.b) and indexes (l[0])")
        parsed = F.try_parse_json(metadata)
        path = "$." + key
        value = F.try_variant_get(parsed, path, "variant")
        self.kind = F.schema_of_variant(value)
        number = self.kind.isin("BIGINT", "DOUBLE", "FLOAT") | self.kind.startswith("DECIMAL")
        self.num = F.when(self.kind == "BOOLEAN", F.try_variant_get(parsed, path, "boolean").cast("double")).when(number, F.try_variant_get(parsed, path, "double"))
        self.whole = F.when(self.kind == "BIGINT", F.try_variant_get(parsed, path, "bigint"))
        nested = self.kind.startswith("ARRAY") | self.kind.startswith("OBJECT")
        self.txt = F.when(self.kind == "STRING", F.try_variant_get(parsed, path, "string")).when(nested, F.to_json(value))

    def compare(self, op: str, operand) -> Column:
        """The predicate, null where the value is missing."""
        operand = _storage(operand)
        if operand is None:
            return F.lit(False)
        act = _ACTS[op]
        if isinstance(operand, str):
            own, other = act(self.txt, F.lit(operand)), self.num.isNotNull()
            rest = {"$ne": other, "$lt": other, "$lte": other}.get(op, F.lit(False))
        else:
            own = act(self.num, F.lit(float(operand)))
            if isinstance(operand, int):
                # Doubles can't tell integers from 2**53 on apart.
                own = F.when(self.whole.isNotNull(), act(self.whole, F.lit(operand).cast("bigint"))).otherwise(own)
            other = self.txt.isNotNull()
            rest = {"$ne": other, "$gt": other, "$gte": other}.get(op, F.lit(False))
        return F.coalesce(own, F.lit(False)) | rest

    def present(self) -> Column:
        return self.num.isNotNull() | self.txt.isNotNull()


_ACTS: dict[str, Callable[[Column, Column], Column]] = {
    "$eq": lambda a, b: a == b,
    "$ne": lambda a, b: a != b,
    "$gt": lambda a, b: a > b,
    "$gte": lambda a, b: a >= b,
    "$lt": lambda a, b: a < b,
    "$lte": lambda a, b: a <= b,
}


def _storage(value):
    """The operand as a number, a text or None."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, int):
        return value if -(1 << 63) <= value < 1 << 63 else float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, list | tuple | dict):
        return json.dumps(value, separators=(",", ":"), ensure_ascii=False, sort_keys=True)
    raise UnsupportedFilterError(f"unsupported operand: {value!r}")


def _field_predicate(metadata: Column, key: str, spec) -> Column:
    if key.startswith("$"):
        raise UnsupportedFilterError(f"unknown operator {key!r}")
    if not isinstance(spec, Mapping):
        return _Field(metadata, key).compare("$eq", spec)
    if len(spec) != 1:
        raise UnsupportedFilterError(f"the predicate of {key!r} must have exactly one operator, it has {len(spec)}")
    ((op, operand),) = spec.items()
    if op in _COMPARISONS:
        return _Field(metadata, key).compare(op, operand)
    if op in _MEMBERSHIP:
        if not isinstance(operand, list | tuple) or not operand:
            raise UnsupportedFilterError(f"{op} of {key!r} needs a non-empty list")
        if len(operand) > MAX_LIST:
            raise UnsupportedFilterError(f"{op} of {key!r} has {len(operand)} items, which exceeds maximum {MAX_LIST}")
        return _member(_Field(metadata, key), op, operand)
    raise UnsupportedFilterError(f"unknown operator {op!r} of {key!r}")


def _member(value: _Field, op: str, operand) -> Column:
    items = [_storage(x) for x in operand]
    texts = [x for x in items if isinstance(x, str)]
    numbers = [x for x in items if x is not None and not isinstance(x, str)]
    tests = []
    if texts:
        tests.append(F.coalesce(value.txt.isin(texts), F.lit(False)))
    if numbers:
        whole = [x for x in numbers if isinstance(x, int)]
        own = value.num.isin([float(x) for x in numbers])
        if whole:
            part = [x for x in numbers if not isinstance(x, int)]
            exact = value.whole.isin(whole) | (value.num.isin(part) if part else F.lit(False))
            own = F.when(value.whole.isNotNull(), exact).otherwise(own)
        tests.append(F.coalesce(own, F.lit(False)))
    anyone = functools.reduce(lambda a, b: a | b, tests, F.lit(False))
    if op == "$in":
        return anyone
    return F.lit(False) if None in items else value.present() & ~anyone


def compile_where(where: Mapping | None, metadata: str | Column = "metadata", _depth: int = 0) -> Column | None:
    """The predicate of a ``where`` mapping on a JSON text column, or None for no restriction.

    Bare values and ``$eq $ne $gt $gte $lt $lte $in $nin`` on fields (``a.b`` descends, ``l[0]`` indexes), ``$and`` and
    ``$or`` of non-empty lists, several fields joined by AND. Empty clauses of a list are dropped.
    """
    column = F.col(metadata) if isinstance(metadata, str) else metadata
    if _depth > MAX_DEPTH:
        raise UnsupportedFilterError(f"filter nesting exceeds the maximum depth of {MAX_DEPTH}")
    if where is None:
        return None
    if not isinstance(where, Mapping):
        raise UnsupportedFilterError(f"a filter must be a mapping, got {type(where).__name__}")
    if not where:
        return None
    for op, join in (("$and", lambda a, b: a & b), ("$or", lambda a, b: a | b)):
        if op in where:
            clauses = where[op]
            if len(where) != 1:
                raise UnsupportedFilterError(f"{op} can't have siblings")
            if not isinstance(clauses, list | tuple) or not clauses:
                raise UnsupportedFilterError(f"{op} needs a non-empty list")
            parts = [p for c in clauses if (p := compile_where(c, column, _depth + 1)) is not None]
            return functools.reduce(join, parts) if parts else None
    return functools.reduce(lambda a, b: a & b, [_field_predicate(column, k, v) for k, v in where.items()])


def ascii_fold(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def compile_where_document(where_document: Mapping | None, document: str | Column = "document") -> Column | None:
    """``{"$contains": text}``: a literal substring, blind to the case of A-Z only."""
    column = F.col(document) if isinstance(document, str) else document
    if where_document is None or where_document == {}:
        return None
    if not isinstance(where_document, Mapping) or set(where_document) != {"$contains"}:
        raise UnsupportedFilterError("a document filter must be {'$contains': text}")
    needle = where_document["$contains"]
    if not isinstance(needle, str):
        raise UnsupportedFilterError("$contains needs a string")
    folded = needle.translate(str.maketrans(_UPPER, _LOWER))
    return F.coalesce(F.contains(ascii_fold(column), F.lit(folded)), F.lit(False))


def compile_filters(where=None, where_document=None, metadata="metadata", document="document") -> Column | None:
    """Both filters joined by AND."""
    parts = [p for p in (compile_where(where, metadata), compile_where_document(where_document, document)) if p is not None]
    return functools.reduce(lambda a, b: a & b, parts) if parts else None


def by_ids(df, ids: list[str], column: str = "id"):
    """Rows with one of the ids: a literal list while it is short, a semi join beyond."""
    ids = list(dict.fromkeys(ids))
    if len(ids) <= 1000:
        return df.where(F.col(column).isin(ids))
    wanted = df.sparkSession.createDataFrame([(i,) for i in ids], f"{column} string")
    return df.join(wanted, column, "left_semi")
