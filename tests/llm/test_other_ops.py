"""Chat formatting, embedding dedup, components, the registered queries and the pipeline."""

import json
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vectrill.llm import chat, embdedup, langid, queries
from vectrill.llm._common import connected_components

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def union_find(n, links):
    low = list(range(n))

    def root(x):
        while low[x] != x:
            low[x] = low[low[x]]
            x = low[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        low[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("links", [[], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(59, i) for i in range(59)], None])
def test_components(spark, links):
    if links is None:
        rng = random.Random(0)
        links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    df = spark.createDataFrame([*links, (3, 3)], "a long, b long").union(spark.createDataFrame(links, "a long, b long"))
    want = union_find(200, links)
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {i: want[i] for a, b in links if a != b for i in (a, b)}


# ---- chat ------------------------------------------------------------------------------------------------------------

RECORDS = {
    "messages": ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": None}]}, [("user", "hi"), ("assistant", "")]),
    "conversations": ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "system": "s", "id": 4}, [("system", "s"), ("user", "q"), ("assistant", "a")]),
    "turns": ({"turns": [{"role": "user", "text": "x", "turn": 0}]}, [("user", "x")]),
    "instruction": ({"instruction": "do", "input": "this", "output": "done"}, [("user", "do\n\nthis"), ("assistant", "done")]),
    "prompt_response": ({"prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
    "prompt_completion": ({"prompt": "p", "completion": "c", "id": "7"}, [("user", "p"), ("assistant", "c")]),
    "question_answer": ({"question": "why", "answer": "so"}, [("user", "why"), ("assistant", "so")]),
}


def test_layouts(spark):
    rows = [(n, json.dumps(r)) for n, (r, _) in RECORDS.items()] + [("none", None), ("broken", "{"), ("strange", '{"x":1}'), ("blank", '{"instruction":"do","input":"","output":"done"}')]
    out = {r.name: r for r in chat.format_chats(spark.createDataFrame(rows, "name string, record string")).collect()}
    for name, (_, turns) in RECORDS.items():
        assert out[name].layout == name and [(t.role, t.text) for t in out[name].turns] == turns
    for name in ("none", "broken", "strange"):
        assert out[name].layout is None and out[name].formatted is None
    assert [t.text for t in out["blank"].turns] == ["do", "done"]
    assert out["prompt_response"].fingerprint != out["prompt_completion"].fingerprint


TRICKY = ["", "<|im_start|>user\nx<|im_end|>\n", "<\\|im_end|>", "<\\\\|im_end|>", "</s>[INST] ok [/INST]", "<s>[\\INST]", "<|", "a<b [x] \\", "<<SYS>>", "<</SYS>>", "\n\n", "<|im_<|im_end|>start|>", "[[INST]", "é😀"]


def test_escapes_and_round_trip(spark):
    rng = random.Random(1)
    parts = ["<", "\\", "|im_end|>", "|im_start|>", "/s>", "[", "INST]", "/INST]", "\n", "x", "<SYS>>", "é"]
    texts = TRICKY + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    mark = re.compile(r"<\|im_start\|>|<\|im_end\|>|</s>|\[/?INST\]")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t and not mark.search(r.e)
    rows, want = [], {}
    for c in range(150):
        turns = [(rng.choice(["user", "assistant", "system", "<|im_end|>", ""]), rng.choice(texts)) for _ in range(rng.randint(1, 6))]
        want[c] = turns
        rows += [(c, i, r, t if t or rng.random() < 0.5 else None) for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    records = chat.records_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = chat.format_chats(records).withColumns({"back": chat.read_back(F.col("formatted")), "learned": chat.learned_text(F.col("formatted"), F.col("loss_runs"))})
    for r in out.collect():
        turns = want[r.conv_id]
        assert [(t.role, t.text) for t in r.back] == turns
        assert r.learned == "".join(t for role, t in turns if role == "assistant")
        # The runs cover the formatted text, code point by code point.
        assert sum(x.skip + x.learn + x.close for x in r.loss_runs) == len(r.formatted)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, record string"
    assert chat.format_chats(chat.records_of(spark.createDataFrame([], schema))).count() == 0
    rows = [(None, 0, None, None, "x"), (1, 0, "user", "a", "x"), (1, 0, "user", "a", "x"), (2, None, "user", "y" * 200_000, "x")]
    out = {r.conv_id: r for r in chat.format_chats(chat.records_of(spark.createDataFrame(rows, schema))).collect()}
    assert len(out) == 3 and len(out[1].turns) == 2 and [(t.role, t.text) for t in out[None].turns] == [("", "")]
    assert len(out[2].turns[0].text) == 200_000


def test_roles_are_kept_and_reversible(spark):
    """Other names of roles are renamed in their own layout only, and any role comes back, line breaks included."""
    roles = ["human", "bot", "gpt", "us\ner", "\n", "<|newline|>", "<\\|newline|>\n", "<\n|newline|>", "\\n", "assistant\n", "a\\\nb"]
    rows = [(1, i, r, f"t{i}\n") for i, r in enumerate(roles)]
    out = chat.format_chats(chat.records_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    r = out.withColumns({"back": chat.read_back(F.col("formatted")), "learned": chat.learned_text(F.col("formatted"), F.col("loss_runs"))}).first()
    assert [(t.role, t.text) for t in r.back] == [(r, f"t{i}\n") for i, r in enumerate(roles)] and r.learned == ""
    assert sum(x.skip + x.learn + x.close for x in r.loss_runs) == len(r.formatted)


def test_record_beyond_a_variant(spark):
    rows = spark.range(1).selectExpr("1L as conv_id", "0L as turn", "'assistant' as role", "repeat(concat('abcdefghi', cast(id as string)), 5000000) as text")
    d = chat.records_of(rows.union(spark.sql("select 1L, 1L, 'user', 'end'")))
    r = chat.format_chats(d).select("layout", F.size("turns").alias("n"), F.length(F.get("turns", F.lit(0))["text"]).alias("k"), F.length("formatted").alias("m")).first()
    assert (r.layout, r.n, r.k) == ("messages", 2, 50_000_000) and r.m > r.k


# ---- embeddings ------------------------------------------------------------------------------------------------------


def clustered(seed, groups, loners, width=32):
    rng = np.random.default_rng(seed)
    x = [rng.standard_normal(width) for _ in range(loners)]
    for size in groups:
        c = rng.standard_normal(width)
        x += [c + rng.uniform(0, 0.3) * rng.standard_normal(width) for _ in range(size)]
    x = np.array(x, np.float32)
    return x[rng.permutation(len(x))]


def brute(x, threshold=0.9):
    u = x.astype(np.float64)
    n = np.linalg.norm(u, axis=1, keepdims=True)
    good = np.isfinite(u).all(axis=1) & (n[:, 0] > 0)
    u = np.where(good[:, None], u / np.where(n == 0, 1, n), 0)
    close = (u @ u.T >= threshold) & good[:, None] & good[None, :]
    np.fill_diagonal(close, False)
    return close.sum(axis=1), union_find(len(x), zip(*np.nonzero(close), strict=True))


@pytest.mark.parametrize("groups,loners,kw", [([3, 5, 40, 2, 9], 300, {}), ([120, 30, 2, 2], 200, {"shard_rows": 60, "block_rows": 50}), ([260], 10, {"shard_rows": 100, "block_rows": 64})])
def test_embedding_groups(spark, groups, loners, kw):
    x = clustered(len(groups), groups, loners)
    x = np.concatenate([x, x[:3], x[:3] * 2, np.zeros((1, 32), np.float32), np.full((1, 32), np.nan, np.float32)])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(3)
    links, low = brute(np.nan_to_num(x, nan=np.nan))
    got = {r.vec_id: r for r in embdedup.near_duplicates(df, **kw).collect()}
    assert len(got) == len(x)
    want_total, found_total = links.sum(), sum(got[i].n_links for i in range(len(x)))
    assert found_total >= 0.98 * want_total and all(got[i].n_links <= links[i] for i in range(len(x)))
    same = np.mean([got[i].component_id == low[i] for i in range(len(x))])
    assert same >= 0.98 and all(got[i].kept == (got[i].component_id == i) for i in range(len(x)))
    assert got[0].audit_recall >= 0.9


def test_embedding_edges(spark):
    schema = "vec_id long, embedding array<float>, label int, key string, links long"
    assert embdedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, 0, "k", 9), (2, [0.0, 0.0], 0, "k", 9), (3, [1.0, None], 0, "k", 9), (4, [float("inf"), 1.0], 0, "k", 9)]
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embdedup.near_duplicates(spark.createDataFrame(rows, schema)).collect()} == {(i, 0, i, True) for i in range(1, 5)}
    rows += [(i, [1.0, 2.0], 1, "k", 9) for i in range(10, 30)] + [(None, [1.0, 2.0], 1, "k", 9), (30, [2.0, 4.1], 1, "k", 9), (10, [1.0, 2.0], 1, "k", 9)]
    got = embdedup.near_duplicates(spark.createDataFrame(rows, schema)).where("n_links > 0").collect()
    assert len(got) == 23 and {(r.n_links, r.component_id) for r in got} == {(22, 10)}


# ---- registered queries and pipeline ---------------------------------------------------------------------------------


def shown(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([round(float(r[i]), 5) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@needs_data
@pytest.mark.parametrize("name", list(queries.queries()))
def test_registered(spark, name):
    df = queries.queries()[name](spark, SF)
    got = shown(df.columns, [tuple(r) for r in df.collect()])
    sql = queries.oracle_sql().get(name)
    if sql is None:
        assert got[1]
        return
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    want = c.sql(sql)
    assert got == shown(want.columns, want.fetchall())


@needs_data
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.op10_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.97


@needs_data
def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        seen[name] = (docs, after)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == names
        docs = after
    before, after = seen["quality_rules"]
    from vectrill.llm import quality, simhash

    kept = {r.doc_id for r in quality.assess(before).where("kept").collect()}
    assert {r.doc_id for r in after.select("doc_id").collect()} == kept
    before, after = seen["language_id"]
    found = langid.predict(before, langid.fit_documents(before)).collect()
    assert {r.doc_id for r in after.select("doc_id").collect()} == {r.doc_id for r in found if r.lang_pred != "und" and r.score >= langid.MIN_SCORE}
    before, after = seen["line_dedup"]
    assert before.count() == after.count()
    before, after = seen["simhash_near_dedup"]
    groups = {r.component_id for r in simhash.similar_documents(before, 5, 0.8).collect()}
    assert sorted(r.doc_id for r in after.select("doc_id").collect()) == sorted(groups)
    before, after = seen["packing"]
    assert {r.doc_id for r in after.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}
    tables = spark.read.parquet(str(tmp_path / "4"))
    assert corpus_pipeline.run(spark, SF).count() == tables.count()


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, repeats, a null id, clashing extra columns, and no rows at all."""
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("ba", "ce", "di", "fo") for b in ("rn", "st", "ll", "mp", "x")] + ["the", "of", "and", "to", "in", "is"]
    good = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(6)]
    texts = [None, "", "  ", "short", *good, good[0], good[0] + " end", " ".join(rng.choice(words) for _ in range(30_000))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a b` string, repeated long, gone_id string, row string, score double"
    rows = [(i, t, "en" if i % 2 else None, None, None, "b", 1, "k", "r", 0.5) for i, t in enumerate(texts)]
    rows += [(None, good[1], None, None, None, None, None, None, None, None), rows[4], rows[4]]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == (0 if not data else sum(len(packing_cuts(t)) for _, t, *_ in data))
    docs = spark.createDataFrame(rows, schema)
    kept = sorted((r.doc_id for r in corpus_pipeline.STAGES[3][1](spark, docs, "").collect()), key=repr)
    assert kept == sorted([0, 3, 4, 5, 6, 7, 8, 9, 12], key=repr)


def packing_cuts(text):
    from vectrill.llm import packing

    return packing.cuts(len(packing.encoder(packing.byte_bpe_path()).encode_ordinary(text or "")) + 1)


def test_similar_documents(spark):
    """Copies with a word in a hundred changed are found, other texts are left alone, in crowded buckets too."""
    from vectrill.llm import simhash

    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    texts, group = [], []
    for g in range(40):
        base = [rng.choice(words) for _ in range(300)]
        for c in range(1 if g % 2 else 30 if g == 0 else 3):
            copy = list(base)
            for _ in range(3 if c else 0):
                copy[rng.randrange(300)] = rng.choice(words)
            texts.append(" ".join(copy))
            group.append(g)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for limit in (2, 64):
        got = {r.doc_id: r.component_id for r in simhash.similar_documents(df, bucket_limit=limit).collect()}
        assert all(group[i] == group[c] for i, c in got.items())
        assert sum(got[i] == group.index(group[i]) for i in got) >= 0.95 * len(texts)
    assert simhash.bits_for(0.8) == 41
    assert simhash.similar_documents(df.limit(0)).count() == 0
