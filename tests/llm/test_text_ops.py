"""Operators on texts against brute force on small fixtures."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

from vectrill.llm import bpe, langid, linededup, lmscore, packing, quality, sharding, simhash

WORDS = "the of and to a in is that it for was on alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def table(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], schema)


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty and blank texts, repeated rows, a null id, one very long text, and columns with clashing names."""
    rng = random.Random(3)
    texts = [None, "", " \n\t ", "Hello, World!", "éÉ ß Ж 漢字 x", prose(rng, 60), prose(rng, 60), "same line\nother\n\nsame line \n SAME LINE"]
    rows = [(i, t, "en", "s", 1, "x", 5, "y", 2) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "no id here", None, None, None, None, None, None, None), (99, prose(rng, 20_000), "en", "s", 1, "x", 5, "y", 2)]
    return spark.createDataFrame(rows, DOCS + ", block string, n_words long, fp string, shard long").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- quality rules ---------------------------------------------------------------------------------------------------


def split_words(text):
    return [w.decode() for w in (text or "").encode().split()]


def base(text):
    text = text or ""
    words = split_words(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if split_words(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_counts(spark, odd):
    rng = random.Random(1)
    texts = ["a b c a b c", "a a a a", "# * <x> |", "l\nl\n \n \nl", prose(rng, 400), None, "", "x"] + [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) for _ in range(40)]
    for df in (table(spark, texts), odd):
        for r in quality.assess(df).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(r.row.text), r.row.text
            assert not (r.base_failed and r.kept)


def test_quality_verdict(spark, empty):
    """References come from labelled rows; held-out prose of each language stays, junk goes, other scripts are judged by
    their characters."""
    rng = random.Random(2)
    common = {"en": "the of and to in is that it for was".split(), "de": "der die und von zu das mit sich auf ist".split()}

    def text(lang, n):
        return " ".join(rng.choice(common[lang] * 2 + [f"{lang}rd{rng.choice('abcdefgh')}{rng.choice('klmnop')}" for _ in range(20)]) for _ in range(n))

    rows = [(i, text(lang, 80 + i), lang) for i in range(60) for lang in [("en", "de")[i % 2]]]
    references = quality.fit(spark.createDataFrame([*rows, (None, text("en", 90), "en"), (99, None, "en"), (98, "few words", "fr")], "doc_id long, text string, lang string"), common_words=10)
    assert list(references.words) == ["de", "en"] and references.words["en"]["the"] > 0.03 > references.words["en"]["der"] == 0.0
    assert all(abs(sum(c.values()) - 1) < 1e-9 for c in references.classes.values())
    held = [text(("en", "de")[i % 2], 60 + 10 * i) for i in range(20)]
    symbols = " ".join(f"{rng.choice(common['en'])}###" for i in range(120))
    bars = " | ".join(rng.choice([*common["en"], "word", "wort"]) for _ in range(150))
    few = " ".join(rng.choice(["the", "qz", "vv", "pq", "mj", "kw", "xx", "ww"]) + rng.choice("abcdef") * rng.randint(0, 1) for _ in range(300))
    other = " ".join("".join(rng.choice("абвгдежзиклмно") for _ in range(5)) for _ in range(100))
    texts = [*held, symbols, bars, few, other, "short"]
    got = {r.doc_id: r for r in quality.assess(table(spark, texts), references).collect()}
    assert [got[i].kept for i in range(len(texts))] == [True] * 20 + [False, False, False, True, False]
    assert [got[i].language for i in range(20)] == ["en", "de"] * 10
    assert got[20].char_jsd > quality.MAX_CHAR_JSD and got[22].word_jsd > 0.15 and got[24].char_jsd is None
    assert got[23].language is None and got[23].word_jsd is None and got[23].char_jsd < quality.MAX_CHAR_JSD
    assert all(got[i].char_jsd < 0.01 and got[i].word_jsd < 0.12 for i in range(20))
    assert quality.assess(empty).count() == 0 and quality.quality_stage(spark, empty, "").columns == empty.columns
    docs = spark.createDataFrame([*rows, (100, symbols, "en"), (101, bars, None), (102, held[0], None)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in quality.quality_stage(spark, docs, "").collect()}
    assert not kept & {100, 101} and len(kept & {*range(60)}) >= 40
    assert quality.fit(docs, sample=0).words == {} and quality.sampled(docs, 1000).count() == 61


def test_divergence(spark):
    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    got = spark.range(1).select(quality.jensen_shannon([F.lit(x) for x in p], [F.lit(x) for x in q])).first()[0]
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    want = sum(x * np.log2(x / y) / 2 for s in (p, q) for x, y in zip(s, m, strict=True) if x > 0)
    assert abs(got - want) < 1e-12


def test_quality_is_native(spark, odd):
    plan = quality.assess(odd, quality.References({"en": {"the": 0.5}}, {"en": dict.fromkeys(quality.CLASSES, 0.2)}))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.replace("Exchange RoundRobin", "")


# ---- SimHash ---------------------------------------------------------------------------------------------------------


def brute_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, linked):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


@pytest.mark.parametrize("limit", [1, 4, 32])
def test_simhash_groups(spark, limit):
    rng = random.Random(5)
    texts = [None, "", "  ", "one", "ONE", "one two", "one two three"]
    for _ in range(12):
        words = prose(rng, rng.randint(30, 200)).split()
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 9)):
            copy = list(words)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    want = [brute_fingerprint(t) for t in texts]
    low = components(range(len(texts)), [(a, b) for a in range(len(texts)) for b in range(a) if (want[a] ^ want[b]).bit_count() <= 2])
    got = simhash.near_duplicates(table(spark, texts), bucket_limit=limit).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{want[i]:016x}", low[i]) for i in range(len(texts))}
    assert len(set(low.values())) < len(texts)


@pytest.mark.parametrize("bits,blocks,limit", [(2, 5, 3), (4, 7, 3), (4, 7, 64)])
def test_close_pairs_join_the_same_groups(spark, bits, blocks, limit):
    rng = random.Random(bits)
    values = set()
    for _ in range(6):
        seed = rng.getrandbits(64)
        for _ in range(12):
            x = seed
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
            values.add(x - (1 << 64) if x >> 63 else x)
    links = simhash.close_pairs(spark.createDataFrame([(v,) for v in values], "fp long"), bits, blocks, limit)
    mask = (1 << 64) - 1
    exact = [(a, b) for a in values for b in values if a < b and ((a ^ b) & mask).bit_count() <= bits]
    found = [(r.a, r.b) for r in links.collect()]
    assert components(values, found) == components(values, exact)
    assert all(((a ^ b) & mask).bit_count() <= bits for a, b in found)


def test_simhash_edges(spark, odd, empty):
    got = simhash.near_duplicates(odd)
    assert got.count() == odd.count() and simhash.near_duplicates(empty).count() == 0
    by = {r.doc_id: r.component_id for r in got.collect()}
    assert by[0] == by[1] == by[2] == 0 and by[5] == 5 and by[None] is None
    kept = [r.doc_id for r in simhash.simhash_stage(spark, odd.select("doc_id", "text", "lang", "source", "n_chars"), "").collect()]
    assert sorted(kept, key=repr) == sorted([0, 3, 4, 5, 6, 7, 99, None], key=repr)


# ---- line dedup ------------------------------------------------------------------------------------------------------


def brute_lines(texts, least, chars=1):
    key = lambda line: linededup.line_key(line.encode())
    split = [(t or "").split("\n") for t in texts]
    df = Counter(k for lines in split for k in {key(x) for x in lines})
    out = []
    for lines in split:
        stay = [x for x in lines if not (len(key(x).decode()) >= chars and df[key(x)] >= least)]
        out.append((len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest(), "\n".join(stay)))
    return out


def test_line_dedup(spark, odd, empty):
    rng = random.Random(7)
    pool = [prose(rng, rng.randint(1, 5)) for _ in range(60)] + ["", " ", "x", "É", "é"]
    texts = [None, ""] + ["\n".join(rng.choice(pool) + rng.choice(["", " ", "\t"]) for _ in range(rng.randint(1, 30))) for _ in range(120)]
    texts = [t.upper() if t and rng.random() < 0.2 else t for t in texts]
    for least, chars, sent in ((10, 1, 1 << 20), (10, 1, 0), (3, 2, 0), (2, 1, 1 << 20)):
        got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256, r.kept_text) for r in linededup.dedup_lines(table(spark, texts), least, chars, n_shards=5, index_bytes=sent).collect()}
        assert got == dict(enumerate(brute_lines(texts, least, chars)))
    assert linededup.dedup_lines(empty).count() == 0
    out = linededup.dedup_lines(odd, min_docs=3, keep=("block",))
    assert out.count() == odd.count() and "keep_block" in out.columns
    # Three rows repeat one text, so its line is in three documents.
    assert {r.n_dropped for r in out.where("doc_id = 5").collect()} == {1}
    stage = linededup.line_dedup_stage(spark, odd, "")
    assert stage.columns == odd.columns and stage.count() == odd.count()


def test_line_index():
    rng = np.random.default_rng(0)
    low, high = rng.integers(0, 2**63, 5000).astype(np.uint64), rng.integers(0, 2**63, 5000).astype(np.uint64)
    index = linededup.LineIndex(low, high, np.arange(5000))
    assert sorted(index.slots(low, high)) == list(range(5000)) and (index.probe(low, high) == np.arange(5000)).all()
    assert (index.probe(low + np.uint64(1), high + np.uint64(1 << 40)) == 0).mean() > 0.99
    none = linededup.LineIndex(low[:0], high[:0], np.zeros(0, np.int64))
    assert (none.probe(low, high) == 0).all()


# ---- LM scores -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores(spark, odd, empty, order):
    rng = random.Random(9)
    texts = [None, "", "solo", *(prose(rng, rng.randint(1, 40)) for _ in range(60))]
    grams = Counter()
    split = [split_words((t or "").lower()) for t in texts]
    for w in split:
        for n in range(1, order + 1):
            grams.update((n, *w[i : i + n]) for i in range(len(w) - n + 1))
    total = sum(c for g, c in grams.items() if g[0] == 1)

    def one(words, i):
        most = min(order, i + 1)
        for n in range(most, 1, -1):
            g = (n, *words[i - n + 1 : i + 1])
            if grams[g] >= 2:
                return np.log(grams[g] / grams[(n - 1, *g[1:-1])]) + (most - n) * np.log(0.4)
        return np.log(grams[1, words[i]] / total) + (most - 1) * np.log(0.4)

    got = {r.doc_id: (r.n_words, r.score) for r in lmscore.score(table(spark, texts), order, n_shards=4, n_blocks=5).collect()}
    for i, w in enumerate(split):
        assert got[i][0] == len(w)
        assert got[i][1] is None if not w else got[i][1] == pytest.approx(np.mean([one(w, k) for k in range(len(w))]), abs=1e-9)
    assert lmscore.score(empty).count() == 0 and lmscore.score(odd).count() == odd.count()


# ---- sharding --------------------------------------------------------------------------------------------------------


def test_sharding(spark, odd, empty):
    rng = random.Random(11)
    hot = prose(rng, 30)
    texts = [hot] * 400 + [prose(rng, rng.randint(1, 90)) for _ in range(800)] + [None]
    got = sharding.shard(table(spark, texts), 8, part_bytes=4096).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    sizes, slots, groups = Counter(), {}, {}
    for r in got:
        text = texts[r.doc_id] or ""
        assert r.size == len(text.encode()) + 16 and r.text_crc32 == zlib.crc32(text.encode()) and r.law == "bytes" and r.grown_shard is None
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        groups.setdefault(text, set()).add(r.shard)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 0.02 * sum(sizes.values()) / 8 + 2 * max(r.size for r in got)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(max(s) - min(s) == len(s) - 1 for s in groups.values())
    small = [t for i in range(900) for t in [prose(random.Random(i), 12)] * 3]
    groups = {}
    sizes = Counter()
    for r in sharding.shard(table(spark, small), 12).collect():
        groups.setdefault(small[r.doc_id], set()).add(r.shard)
        sizes[r.shard] += r.size
    assert all(len(g) == 1 for g in groups.values()) and max(sizes.values()) < 1.04 * min(sizes.values())
    for df in (odd, empty):
        out = sharding.shard(df, 4).collect()
        assert len(out) == df.count()
        assert all(sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out))) for s in range(4))
    assert sharding.shard(odd, 4, keep_text=True).where("text is null").count() == 1


# ---- BPE and packing -------------------------------------------------------------------------------------------------

ALPHABET = "aAbBé ÉßİΣσ'’sStTlL\n\t\r\x0b\x1c\x85​ 　中文字1２٣½#$%<|>/ẃﬁǅé한글😀👍🏽"


def fuzz(seed, n):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [*texts, "", "<|endoftext|>a<|startoftext|>B <|ENDOFTEXT|>", "a" * 3001, "aaaa bbbb " * 3, "ΑΣ ΑΣΑ", "it's I'LL we'Re"]


def test_bpe_equals_library(spark, odd, empty):
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(bpe.word_bpe_path())
    texts = [*fuzz(1, 600), None, *(prose(random.Random(i), 50) for i in range(20))]
    for r in bpe.encode(table(spark, texts), bpe.word_bpe_path()).collect():
        want = reference.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        decoded = reference.decode(want, skip_special_tokens=False)
        assert (r.ids, r.n_tokens, r.decoded) == (want, len(want), decoded)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode(odd, bpe.word_bpe_path(), with_ids=False).count() == odd.count() and bpe.encode(empty, bpe.word_bpe_path()).count() == 0


def test_bpe_memo_can_be_forgotten(monkeypatch):
    table_ = bpe.WordBpe(bpe.word_bpe_path())
    first = [x.tolist() for x in table_.encode_batch(["one two", "three one"])]
    monkeypatch.setattr(bpe, "MEMO_WORDS", 1)
    assert [x.tolist() for x in table_.encode_batch(["one two", "three one"])] == first


def test_packing(spark, odd, empty):
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(packing.byte_bpe_path())
    texts = [*fuzz(2, 200), None, prose(random.Random(1), 9000)]
    pieces = {}
    got = packing.pack(table(spark, texts).repartition(3), packing.byte_bpe_path()).collect()
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        want = [*reference.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted(pieces[i], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in own) == np.array(want, "<u4").tobytes()
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own[:-1])]).tolist()
        assert all(r.doc_tokens == len(want) and r.offset == 0 and r.length.bit_count() == 1 and r.length <= 2048 and 1 << r.bucket == r.length and r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in own)
    assert len({r.sequence_id for r in got}) == len(got)
    assert packing.pack(empty, packing.byte_bpe_path()).count() == 0
    assert packing.pack(odd, packing.byte_bpe_path(), with_ids=False).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
    assert packing.cuts(5000) == [2048, 2048, 512, 256, 128, 8] and packing.cuts(1) == [1]


# ---- language ID -----------------------------------------------------------------------------------------------------


def brute_profile(counts, k):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]]


def gram_counts(text):
    out = Counter()
    for word, n in langid.word_counts(text).items():
        for code in langid.grams(word).tolist():
            out[code] += n
    return out


def test_language_id(spark, odd, empty):
    samples = {"en": "the cat and the dog are in the house with this thing", "de": "der hund und die katze sind nicht in dem haus", "fr": "le chien et la chatte sont dans une maison avec les enfants"}
    rows = [(i, " ".join(random.Random(i).choices(samples[x].split(), k=30)), x) for i in range(60) for x in [list(samples)[i % 3]]]
    df = spark.createDataFrame([*rows, (60, None, "en"), (61, "123 !", "en"), (62, "le chien", None)], "doc_id long, text string, lang string")
    profiles = langid.fit(df, 50)
    for lang in samples:
        counts = Counter()
        for _, t, x in rows:
            if x == lang:
                counts += gram_counts(t)
        want = brute_profile(counts, 50)
        # the letters of the row without letters change nothing
        assert profiles[lang].tolist() == want
    for r in langid.predict(df, profiles, 50).collect():
        text = {i: t for i, t, _ in rows}.get(r.doc_id, {62: "le chien"}.get(r.doc_id))
        own = brute_profile(gram_counts(text), 50) if text else []
        if not own:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        away = {x: sum(min(abs(i - profiles[x].tolist().index(g)), 50) if g in profiles[x] else 50 for i, g in enumerate(own)) for x in sorted(profiles)}
        best = min(away, key=lambda x: (away[x], x))
        assert r.lang_pred == best and r.score == pytest.approx(1 - away[best] / (50 * len(own)))
    assert langid.fit(empty) == {} and langid.predict(empty, profiles).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, {}).collect()} == {"und"}
    stage = langid.language_stage(spark, odd, "")
    assert stage.columns == odd.columns and sorted(r.doc_id for r in stage.where("doc_id < 3").collect()) == []
    assert langid.language_stage(spark, empty, "").count() == 0


def test_held_out(spark):
    df = spark.createDataFrame([Row(doc_id=i) for i in range(200)])
    for r in df.select("doc_id", langid.held_out(df["doc_id"]).alias("h")).collect():
        assert r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
