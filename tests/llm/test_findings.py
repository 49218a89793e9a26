"""Tests that hold the operators to the whole job: each would have failed before its fix."""

import random

import pytest

from vectrill.llm import langid, linededup, quality, simhash


def jaccard(a, b):
    cut = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    x, y = cut(a), cut(b)
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("limit", [1, 8, 1000])
def test_similar_pairs_are_found_exactly(spark, limit):
    """Pairs just at and just below 0.8: all of the former are linked, none of the latter; also among many copies."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    texts, want = [], []
    for g in range(160):
        base = [rng.choice(words) for _ in range(184)]
        copy = list(base)
        for i in range(4 if g % 2 else 5):  # five shingles each
            copy[20 + 30 * i] = "x"
        texts += [" ".join(base), " ".join(copy)]
        want += [2 * g, 2 * g if jaccard(texts[-2], texts[-1]) >= 0.8 else 2 * g + 1]
    assert len(set(want)) == 240
    base = [rng.choice(words) for _ in range(184)]
    for c in range(30):
        copy = list(base)
        copy[5 * c + 10] = "y"
        texts.append(" ".join(copy))
        want.append(320)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(df, bucket_limit=limit).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_language_stage_rejects_gibberish(spark):
    """Prose of the learned languages stays, short or long; random letters and another language go."""
    rng = random.Random(5)
    known = {"en": "the cat and the dog are in this house with that thing which they have found there".split(), "de": "der hund und die katze sind nicht in dem haus weil sie noch auf einen freund warten".split()}
    rows = [(i, " ".join(rng.choices(known[lang], k=60 + 40 * (i % 5))), lang) for i in range(400) for lang in [("en", "de")[i % 2]]]
    rows.append((400, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(100)), None))
    rows.append((401, " ".join("".join(rng.choices("0123456789abcdef", k=16)) for _ in range(100)), "en"))
    rows.append((402, " ".join(rng.choices("kiedy przyszedł wieczór wszyscy mieszkańcy wyszli przed swoje domy żeby zobaczyć księżyc".split(), k=100)), None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in langid.language_stage(spark, docs, "").collect()) == list(range(400))


def test_line_stage_keeps_texts_with_many_copies(spark):
    """Ten copies of a text keep their lines; a line of ten different texts goes, from copies too."""
    rows = [(i, "shared\nown line\nanother") for i in range(25)] + [(100 + i, f"shared\ntext {i}") for i in range(9)] + [(200 + i, f"few\nline {i}") for i in range(9)]
    rows += [(3, rows[3][1]), (None, rows[3][1]), (300, None), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for sent in (None, 0):
        got = linededup.line_dedup_stage(spark, docs, "") if sent is None else linededup.dedup_lines(docs, once_a_text=True, index_bytes=0).withColumnRenamed("kept_text", "text")
        got = sorted((r.text for r in got.collect()), key=str)
        assert got == sorted(["own line\nanother"] * 27 + [f"text {i}" for i in range(9)] + [f"few\nline {i}" for i in range(9)] + ["", ""])


def test_simhash_stage_tells_texts_of_one_id_apart(spark):
    """Rows that share an id but not a text are different documents; copies go whatever their ids."""
    rng = random.Random(6)
    a, b, c = (" ".join(f"{x}{rng.randrange(300)}" for _ in range(90)) for x in "abc")
    cases = [
        ([(1, a), (1, b), (2, c)], [(1, a), (1, b), (2, c)]),
        ([(5, a), (5, b), (2, a)], [(2, a), (5, b)]),
        ([(1, a), (1, a + " end"), (None, a), (3, b), (3, b), (None, c), (None, c)], None),
    ]
    for rows, want in cases:
        got = [(r.doc_id, r.text) for r in simhash.simhash_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
        if want is None:
            assert len(got) == 3 and sorted((i is None, i) for i, _ in got) == [(False, 1), (False, 3), (True, None)]
        else:
            assert sorted(got) == sorted(want)


@pytest.mark.parametrize("limit", [2, 8])
def test_similar_rows_against_brute_force(spark, limit, monkeypatch):
    """Pairs at all similarities from 0.6 up, a passage that every other text holds, and chains: the groups are those of
    all pairs at 0.8 or more, neither more nor less."""
    rng = random.Random(11)
    monkeypatch.setattr(simhash, "COMMON", 20)
    words = [f"w{i}" for i in range(800)]
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for g in range(90):
        base = [rng.choice(words) for _ in range(rng.choice([30, 90, 200, 400]))]
        if g % 2:
            base[10:10] = passage
        texts.append(" ".join(base))
        for _ in range(g % 4):
            copy = list(base)
            for _ in range(max(1, round(len(base) * rng.uniform(0, 0.05)))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    low = list(range(len(texts)))
    near = 0
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if len(x & y) >= 0.8 * len(x | y):
                near += 1
                a, b = low[i], low[j]
                low = [min(a, b) if x in (a, b) else x for x in low]
    assert near > 50
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(df, bucket_limit=limit).collect()}
    assert [got[i] for i in range(len(texts))] == low


def test_common_shingles_come_last(spark):
    h = simhash.shingles(" ".join(f"w{i}" for i in range(104)))
    common = h[:30]
    first = simhash.first_shingles(h, 0.8, common)
    assert len(first) == 21 and not set(first.tolist()) & set(common.tolist())
    assert simhash.first_shingles(h, 0.8).tolist() == h[:21].tolist()
    assert simhash.first_shingles(h[:30], 0.8, common).tolist() == h[:7].tolist()


@pytest.mark.parametrize("sent", [linededup.INDEX_BYTES, 0])
def test_fingerprints_turn_lines_away(spark, sent, monkeypatch):
    """The index holds shared lines only; without its fingerprints, other lines that reach a slot would go too."""
    rows = [(i, "\n".join([f"shared {i % 4}", *(f"own {i} {k}" for k in range(50))])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = linededup.dedup_lines(docs, index_bytes=sent).agg({"n_dropped": "sum", "n_lines": "sum"}).first()
    assert got["sum(n_dropped)"] == 60 and got["sum(n_lines)"] == 60 * 51
    hashes = linededup._hashes([line.encode() for _, t in rows for line in t.split("\n")])
    index = linededup.fetched(linededup.line_index(linededup.line_counts(docs, 1, 1), 10), 1 << 20)[0]
    assert len(index.counts) == 4 and sorted(index.counts) == [15] * 4
    assert (linededup.probe({0: index}, hashes, 1) > 0).sum() == 60
    assert (index.slots(hashes[:, 0], hashes[:, 1]) >= 0).sum() > 60


def test_simhash_blocks_find_near_copies_by_themselves(spark, monkeypatch):
    """The stage's pairs come through fingerprints, blocks and a Hamming check, also where no shingle is filed; the exact
    check of the sets follows."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(500)]
    base = [[rng.choice(words) for _ in range(2000)] for _ in range(12)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:-1], "end"]) for b in base]
    hashes = [simhash.shingles(t) for t in texts]
    first = [int(simhash.wide_fingerprint(h)[0]) for h in hashes]
    near = {(i, j) for i in range(24) for j in range(i) if (first[i] ^ first[j]).bit_count() <= simhash.NEAR_BITS}
    assert len(near) >= 10
    odd = [(100, 5), (101, 5), (102, 4), (103, 7), (104, -1)]  # equal and near fingerprints, and one far away
    got = simhash.block_pairs(spark.createDataFrame(odd, "node long, f0 long")).collect()
    assert {(r.a, r.b) for r in got} >= {(100, 101)} and not any(104 in (r.a, r.b) for r in got)
    joined = {100}
    for _ in odd:
        joined |= {x for r in got if {r.a, r.b} & joined for x in (r.a, r.b)}
    assert joined == {100, 101, 102, 103}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(simhash, "first_shingles", lambda hashes, similarity, common=None: hashes[:0])
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()}
    assert all(got[i] == got[j] for i, j in near) and all(got[i] % 12 == i % 12 for i in got)


def test_quality_references_count_every_labelled_row(spark):
    """More rows of a language than a sample takes: shares are those of all of them, also in the verdicts."""
    rows = [(i, " ".join(["the"] * (2 if i < 700 else 1) + [f"w{j}" for j in range(i % 40, i % 40 + 60)]), "en") for i in range(1400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    total = 1400 * 60 + 1400 + 700
    assert quality.fit(docs, common_words=200).words["en"]["the"] == 2100 / total
    assert quality.fit(docs, quality.SAMPLE, 200).words["en"]["the"] != 2100 / total
    whole = {r.doc_id: r.word_jsd for r in quality.assess(docs, quality.fit(docs)).where("doc_id % 100 = 0").collect()}
    assert {r.doc_id: r.word_jsd for r in quality.assess(docs).where("doc_id % 100 = 0").collect()} == whole
