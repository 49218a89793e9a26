"""The filter language against SQLite, whose storage-class order it follows."""

import json
import sqlite3

import pytest

from vectrill import UnsupportedFilterError, compile_filters, compile_where, compile_where_document

VALUES = [2020, "2020", "abc", None, 2020.0, 2021.5, True, 1, False, [1, 2], {"e": 1}, "é", -3, 1000.0, "", "Z", "a", 2**53, 2**53 + 1, 2**63 - 1]
OPERANDS = [2020, "2020", 2020.5, "abc", True, 0, "Z", "", 2**53, 2**53 + 1, -3.0, [1, 2]]
SIGNS = {"$eq": "=", "$ne": "!=", "$gt": ">", "$gte": ">=", "$lt": "<", "$lte": "<="}


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, json.dumps({"y": v}, separators=(",", ":"), ensure_ascii=False)) for i, v in enumerate(VALUES)] + [(100, "{}"), (101, ""), (102, "not json")]
    return spark.createDataFrame(data, "uid long, metadata string").coalesce(1).cache()


@pytest.fixture(scope="module")
def sqlite():
    db = sqlite3.connect(":memory:")
    db.execute("create table t (uid integer, metadata text)")
    db.executemany("insert into t values (?, ?)", [(i, json.dumps({"y": v}, separators=(",", ":"), ensure_ascii=False)) for i, v in enumerate(VALUES)] + [(100, "{}")])
    return db


def operand(x):
    return json.dumps(x, separators=(",", ":")) if isinstance(x, list) else x


def test_comparisons_match_sqlite(rows, sqlite):
    cases = [(op, x) for op in SIGNS for x in OPERANDS]
    flags = rows.select("uid", *[compile_where({"y": {op: x}}).alias(f"c{n}") for n, (op, x) in enumerate(cases)]).collect()
    for n, (op, x) in enumerate(cases):
        want = {r[0] for r in sqlite.execute(f"select uid from t where json_extract(metadata, '$.y') {SIGNS[op]} ?", (operand(x),))}
        assert {r["uid"] for r in flags if r[f"c{n}"]} == want, (op, x)


@pytest.mark.parametrize("items", [[2020, "abc"], [1, True], ["2020"], [2020.0, None], [2**53 + 1]])
def test_membership_matches_sqlite(rows, sqlite, items):
    marks = ",".join("?" * len(items))
    for op, word in (("$in", "in"), ("$nin", "not in")):
        want = {r[0] for r in sqlite.execute(f"select uid from t where json_extract(metadata, '$.y') {word} ({marks})", items)}
        assert {r.uid for r in rows.where(compile_where({"y": {op: items}})).collect()} == want, (op, items)


def test_logic_paths_and_empty_clauses(spark):
    data = [(1, '{"a":{"b":1},"l":[5,6]}'), (2, '{"a":{"b":2},"l":[7]}'), (3, '{"a":3}')]
    df = spark.createDataFrame(data, "uid long, metadata string")

    def ids(where):
        c = compile_where(where)
        return [r.uid for r in (df if c is None else df.where(c)).orderBy("uid").collect()]

    assert ids({"a.b": 2}) == [2]
    assert ids({"l[0]": {"$gte": 6}}) == [2]
    assert ids({"$or": [{}, {"a.b": 1}]}) == [1]
    assert ids({"$and": [{}, {}]}) == [1, 2, 3]
    assert ids({"$and": [{"a.b": {"$gt": 0}}, {"$or": [{"l[0]": 5}, {"l[0]": 7}]}]}) == [1, 2]
    assert ids({"a.b": 1, "l[1]": 6}) == [1]
    assert ids({"a": None}) == []
    assert ids(None) == ids({}) == [1, 2, 3]


@pytest.mark.parametrize(
    "bad",
    [{"a": {"$regex": "x"}}, {"$not": {}}, {"a": {"$contains": "x"}}, {"a": {"$gt": 1, "$lt": 5}}, {"a": {}}, {"$and": []}, {"$or": [{"a": 1}], "b": 2}, {"a": {"$in": []}}, {"a": {"$in": list(range(901))}}, [1], {"a": {"$in": 3}}],
)
def test_bad_filters(bad):
    with pytest.raises(UnsupportedFilterError):
        compile_where(bad)


def test_depth_limit(spark):
    nested = {"a": 1}
    for _ in range(10):
        nested = {"$and": [nested]}
    assert compile_where(nested) is not None
    with pytest.raises(UnsupportedFilterError, match="depth"):
        compile_where({"$and": [nested]})


def test_document_contains(spark):
    texts = ["Fox", "fox", "ÉCOLE", "école", "100%", "a_b", "back\\slash", None]
    df = spark.createDataFrame(list(enumerate(texts)), "uid long, document string")

    def ids(needle):
        return [r.uid for r in df.where(compile_where_document({"$contains": needle})).orderBy("uid").collect()]

    assert ids("FOX") == [0, 1]
    assert ids("école") == [3] and ids("cole") == [2, 3]
    assert ids("%") == [4] and ids("_") == [5] and ids("\\") == [6]
    for bad in ({"$not_contains": "x"}, {"$contains": 3}, "x", {"$contains": "a", "b": 1}):
        with pytest.raises(UnsupportedFilterError):
            compile_where_document(bad)
    assert compile_filters(None, None) is None


@pytest.mark.parametrize("key", ["a..b", "a.", ".a", "l[0", "[", "l[x]", "a[0]b", "a$", "*"])
def test_bad_paths_are_rejected_at_once(key):
    with pytest.raises(UnsupportedFilterError):
        compile_where({key: 1})
