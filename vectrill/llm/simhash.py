"""SimHash near-duplicate groups: pigeonhole blocks, a join on blocks, and a Hamming check.

A 64-bit fingerprint is cut into ``n_blocks`` blocks. Two fingerprints that differ in at most ``max_bits`` bits agree
on at least ``n_blocks - max_bits`` whole blocks, so each fingerprint is filed once for every choice of that many
blocks and close pairs meet in a bucket. Equal fingerprints are collapsed first. A bucket of up to ``bucket_limit``
fingerprints is joined with itself; the members of larger ones are linked through the points half the distance away
that they share, which is just as exact and grows with the members instead of their pairs.
"""

from __future__ import annotations

import itertools

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, connected_components, cut, id_and, only

BITS = 64


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """Majority of the bits of the XXH64 hashes (seed 42) of a text's word shingles, repeats included.

    A bit is set if over half the hashes set it. Words are runs of anything but ASCII white space, A-Z lower-cased; a
    text of fewer words than a shingle has one shingle, a text without words has fingerprint 0.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(shingle_words, len(words))
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    hashes = np.fromiter((digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 4096):
        ones += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint's 64 bits as a signed long) of every row."""

    def batch(b):
        import pyarrow as pa

        values = np.array([fingerprint(t.as_py(), shingle_words) for t in b.column("text")], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return arrow_map(only(docs, doc_id=id_col, text=text_col), batch, id_and(docs, id_col, "fp long"))


def _masks(n_blocks: int, shared: int) -> list[int]:
    cuts = [BITS * i // n_blocks for i in range(n_blocks + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(cuts)]
    return [sum(choice) for choice in itertools.combinations(blocks, shared)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def close_pairs(fps: DataFrame, max_bits: int = 2, n_blocks: int = 5, bucket_limit: int = 32) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (``fps``: one column ``fp``) that join the same groups as all pairs
    at ``max_bits`` or fewer differing bits; ``max_bits`` is even."""
    if max_bits % 2 or not 0 < max_bits < n_blocks:
        raise ValueError("max_bits must be even, positive and less than n_blocks")
    masks = [_signed(m) for m in _masks(n_blocks, n_blocks - max_bits)]
    filed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "key"))
    sizes = filed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    filed = cut(filed.join(sizes, ["choice", "key"]))
    small = filed.where(F.col("n") <= bucket_limit)
    pairs = (
        small.select("choice", "key", F.col("fp").alias("a"))
        .join(small.select("choice", "key", F.col("fp").alias("b")), ["choice", "key"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
        .select("a", "b")
    )
    # Two points at most 2r apart share a point within r of both, and points within r of one point are at most 2r apart.
    flips = [_signed(sum(1 << i for i in c)) for r in range(max_bits // 2 + 1) for c in itertools.combinations(range(BITS), r)]
    crowded = filed.where(F.col("n") > bucket_limit).select("fp").distinct()
    balls = crowded.select("fp", F.explode(F.transform(F.array(*[F.lit(x) for x in flips]), lambda x: x.bitwiseXOR(F.col("fp")))).alias("centre"))
    lowest = balls.groupBy("centre").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").select("centre", "low")
    shared = balls.join(lowest, "centre").where("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b"))
    return pairs.union(shared).distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = 3, max_bits: int = 2, n_blocks: int = 5, bucket_limit: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of near copies: ``doc_id, fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable by links).

    Fingerprints link at ``max_bits`` or fewer differing bits; rows with equal fingerprints are linked, texts without
    words (null, empty, white space) among them. One row comes back for each row of the input. A null id never is a
    ``component_id`` unless a group has no other; repeated rows share a group. An empty table gives an empty table.
    """
    marked = cut(fingerprints(docs, shingle_words, id_col, text_col))
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("low_id"))
    distinct = cut(distinct)
    parts = connected_components(close_pairs(distinct.select("fp"), max_bits, n_blocks, bucket_limit))
    rooted = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low_id", F.coalesce("component", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low_id").alias("component_id"))
    ids = rooted.join(lowest, "root").select("fp", "component_id")
    return marked.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Wide fingerprints: four longs; the first is a SimHash of 64 bits by itself.
WORDS = 4
#: First fingerprints this close meet through blocks, whatever shingles they are filed under.
NEAR_BITS = 2
#: Pairs whose bits differ by this many deviations more than expected are not looked at further.
DEVIATIONS = 6
#: Size of the bitmap of the nodes whose sets are asked for.
ASKED_BITS = 1 << 24
#: Texts with fewer shingles are compared whatever their bits, as the expectation holds for many shingles only.
MIN_SHINGLES = 64
#: Shingles that so many rows file under come last in the order; of these, at most ``MOST_COMMON`` (any order is exact).
COMMON = 64
MOST_COMMON = 100_000


def bits_for(similarity: float, deviations: float = 0.5, n: int = WORDS * BITS) -> int:
    """Differing bits of ``n`` to be expected at a Jaccard similarity of shingles, and some deviations (half a one).

    Sets of similarity s and equal size have cosine 2s / (1 + s), others more; a bit differs with the angle's share of a
    half turn.
    """
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(n * share + deviations * np.sqrt(n * share * (1 - share)))


def shingles(text: str | None, shingle_words: int = 5) -> np.ndarray:
    """The distinct XXH64 hashes of a text's word shingles, in order."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    k = min(shingle_words, len(words))
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = len(words) - k + 1
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """Majority of the bits of four hashes of each distinct shingle: ``WORDS`` unsigned longs."""
    ones = np.zeros(WORDS * BITS, np.int64)
    for i in range(0, len(hashes), 4096):
        h = hashes[i : i + 4096]
        wide = np.stack([h, *(_spread(h, n) for n in range(1, WORDS))], axis=1)
        ones += np.unpackbits(wide.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def _spread(h: np.ndarray, n: int) -> np.ndarray:
    """A further hash from the first, by splitmix64's finaliser."""
    with np.errstate(over="ignore"):
        x = h + np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _node(hashes: np.ndarray) -> int:
    """One number for a set of shingles."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), 11)


def first_shingles(hashes: np.ndarray, similarity: float, common: np.ndarray | None = None) -> np.ndarray:
    """The first shingles of a set in an order of all shingles, of which any two sets that are ``similarity`` alike
    share one: the shingles in ``common`` (sorted) come last, others by their hash."""
    n = len(hashes)
    most = n - int(np.ceil(similarity * n - 1e-9)) + 1
    if common is None or not len(common):
        return hashes[:most]
    often = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
    return np.concatenate([hashes[~often], hashes[often]])[:most]


def _near(f: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float, max_bits: int) -> np.ndarray:
    """Which of the points ``a`` and ``b`` (places, broadcast) may be similar, by sizes and fingerprints."""
    low, high = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
    away = np.bitwise_count(f[a] ^ f[b]).sum(axis=-1, dtype=np.int64)
    return (low >= similarity * high - 1e-9) & ((low < MIN_SHINGLES) | (away <= max_bits))


def _buckets(p, nodes: np.ndarray):
    """For each bucket of ``p`` (key, node), the places of its members in ``nodes`` (sorted)."""
    p = p.sort_values(["key", "node"])
    keys, at = p["key"].to_numpy(), np.searchsorted(nodes, p["node"].to_numpy())
    return np.split(at, np.nonzero(keys[1:] != keys[:-1])[0] + 1) if len(keys) else []


def _words(q) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return q["node"].to_numpy(), q["n"].to_numpy(), np.stack([q[f"f{i}"].to_numpy() for i in range(WORDS)], axis=1).view(np.uint64)


def _suspects(p, similarity: float, max_bits: int) -> np.ndarray:
    """Nodes of a bin that may be similar to another member of one of their buckets."""
    nodes, n, f = _words(p.drop_duplicates("node").sort_values("node"))
    found = np.zeros(len(nodes), bool)
    for members in _buckets(p, nodes):
        for a in members:
            if not found[a]:
                near = members[_near(f, n, a, members, similarity, max_bits)]
                if len(near) > 1:
                    found[near] = True
    return nodes[found]


def _group_links(p, q, similarity: float, max_bits: int):
    """Spanning links over the crowded buckets of a bin (or between two blocks of a large one): ``p`` has the buckets'
    members, ``q`` the points with their whole sets. Members that aren't linked yet are compared by these, each pair once."""
    import pandas as pd

    q = q.sort_values("node")
    nodes, n, f = _words(q)
    sets = [np.asarray(x, np.int64).view(np.uint64) for x in q["shingles"]]
    labels, own = np.arange(len(nodes)), q["own"].to_numpy()
    across = len(q) > 0 and q["i"].iloc[0] != q["j"].iloc[0]
    tried = np.eye(len(nodes), dtype=bool)
    for members in _buckets(p[p["node"].isin(nodes)], nodes):
        # Whoever isn't in the largest group so far is compared with everybody else.
        groups, times = np.unique(labels[members], return_counts=True)
        for a in members[labels[members] != groups[np.argmax(times)]]:
            rest = members[(labels[members] != labels[a]) & ~tried[a, members]]
            if across:
                rest = rest[own[rest] != own[a]]
            rest = rest[_near(f, n, a, rest, similarity, max_bits)]
            while len(rest):
                some = rest[:64]
                tried[a, some] = tried[some, a] = True
                flat = np.concatenate([sets[b] for b in some])
                place = np.minimum(np.searchsorted(sets[a], flat), n[a] - 1)
                common = np.add.reduceat((sets[a][place] == flat).astype(np.int64), np.cumsum(n[some]) - n[some])
                hits = some[common >= similarity * (n[a] + n[some] - common) - 1e-9]
                if len(hits):
                    labels[np.isin(labels, labels[hits])] = labels[a]
                rest = rest[64:]
                rest = rest[labels[rest] != labels[a]]
    linked = labels != np.arange(len(nodes))
    return pd.DataFrame({"a": nodes[linked], "b": nodes[labels[linked]]})


def block_pairs(points: DataFrame, max_bits: int = NEAR_BITS, n_blocks: int = 5, bucket_limit: int = 32) -> DataFrame:
    """Pairs ``a, b`` of ``points`` (node, f0) whose fingerprints ``f0`` link by ``close_pairs``: blocks, a join on them and a
    Hamming check. Nodes of one fingerprint are linked with the lowest of them, which stands for the fingerprint."""
    lowest = cut(points.groupBy(F.col("f0").alias("fp")).agg(F.min("node").alias("low")))
    near = close_pairs(lowest.select("fp"), max_bits, n_blocks, bucket_limit)
    ends = near.join(lowest.toDF("a", "low_a"), "a").join(lowest.toDF("b", "low_b"), "b").select(F.least("low_a", "low_b").alias("a"), F.greatest("low_a", "low_b").alias("b"))
    same = points.select("node", F.col("f0").alias("fp")).join(lowest, "fp").where("node > low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    return ends.union(same)


def similar_links(points: DataFrame, filed: DataFrame, sets_of, similarity: float, bucket_limit: int = 8, block_rows: int = 1000, bin_rows: int = 2000) -> DataFrame:
    """Links ``a, b`` that join the same groups as all pairs of points whose Jaccard similarity is ``similarity`` or more.

    Candidates are the pairs that SimHash finds (``block_pairs``) and, as no choice of blocks is sure to be shared by pairs whose
    fingerprints differ in more bits, those that share a first shingle. ``points`` has ``node``, ``n`` (size of its set) and ``f0`` to ``f3``; ``filed`` has ``key, node``, the first
    shingles of each set (repeats allowed); ``sets_of(nodes)`` gives ``node, shingles`` for the nodes that are asked for. Whoever shares a bucket and is near
    enough by size and fingerprint is compared by the whole sets. Buckets of up to ``bucket_limit``
    are joined with themselves. Crowded ones go to bins by their lowest member, so that copies that share many buckets
    meet once (the largest in pairs of blocks), and give only spanning links; sets are fetched for those only that are
    near somebody. How a bucket is worked through depends on its size, what is linked doesn't.
    """
    max_bits = bits_for(similarity, DEVIATIONS)
    shared = filed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    held = cut(filed.join(shared, "key").dropDuplicates(["key", "node"]).select("key", "node"))
    sizes = held.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("leader"))
    held = held.join(sizes, "key")
    small = held.where(F.col("members") <= bucket_limit).select("key", "node")
    pairs = small.join(small.select("key", F.col("node").alias("b")), "key").where("node < b").select(F.col("node").alias("a"), "b")
    pairs = pairs.union(block_pairs(points)).distinct()
    f = [F.col(f"f{i}") for i in range(WORDS)]
    left = points.select(F.col("node").alias("a"), F.col("n").alias("n_a"), *[x.alias(f"l{i}") for i, x in enumerate(f)])
    right = points.select(F.col("node").alias("b"), F.col("n").alias("n_b"), *[x.alias(f"r{i}") for i, x in enumerate(f)])
    away = sum((F.bit_count(F.col(f"l{i}").bitwiseXOR(F.col(f"r{i}"))) for i in range(1, WORDS)), F.bit_count(F.col("l0").bitwiseXOR(F.col("r0"))))
    near = (F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9) & ((F.least("n_a", "n_b") < MIN_SHINGLES) | (away <= max_bits))
    pairs = cut(pairs.join(left, "a").join(right, "b").where(near).select("a", "b", "n_a", "n_b"))

    crowd = held.where(F.col("members") > bucket_limit)
    leaders = crowd.groupBy("leader").agg(F.max("members").alias("most"))
    bins = crowd.count() // bin_rows + 1
    crowd = crowd.join(leaders.select("leader", F.ceil(F.col("most") / block_rows).cast("int").alias("parts")), "leader")
    crowd = crowd.withColumn("own", F.pmod(F.xxhash64("node"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    bin_ = F.when(F.col("parts") == 1, F.struct(F.lit(0).alias("large"), F.pmod(F.xxhash64("leader"), F.lit(bins)).alias("bin"))).otherwise(F.struct(F.lit(1).alias("large"), F.col("leader").alias("bin")))
    crowd = crowd.select(bin_.alias("at"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "node")
    crowd = cut(crowd.select("at.large", "at.bin", "i", "j", "own", "key", "node").join(points.select("node", "n", *f), "node"))
    where = ("large", "bin", "i", "j")

    def suspects(p):
        found = _suspects(p, similarity, max_bits)
        return p.drop_duplicates("node").loc[lambda x: x["node"].isin(found), ["large", "bin", "i", "j", "own", "node"]]

    asked_in = cut(crowd.groupBy(*where).applyInPandas(suspects, "large int, bin long, i int, j int, own int, node long"))
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(asked_in.select("node")).distinct()
    sets = cut(sets_of(asked))
    x, y = sets.select(F.col("node").alias("a"), F.col("shingles").alias("s_a")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("s_b"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "n_a", "n_b", F.size(F.array_intersect("s_a", "s_b")).alias("common"))
    links = both.where(F.col("common") >= similarity * (F.col("n_a") + F.col("n_b") - F.col("common")) - 1e-9).select("a", "b")
    known = asked_in.join(sets, "node").join(points.select("node", "n", *f), "node")
    left = crowd.select(*where, "key", "node").join(asked_in.drop("own"), [*where, "node"], "left_semi")
    spanning = left.groupBy(*where).cogroup(known.groupBy(*where)).applyInPandas(lambda p, q: _group_links(p, q, similarity, max_bits), "a long, b long")
    return links.union(spanning).distinct()


def similar_rows(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, bucket_limit: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, mark`` (hash of the text) and ``root`` of every row: rows of one root are linked, directly or through
    others, by a Jaccard similarity of their shingle sets of ``similarity`` or more.

    Candidates come from SimHash: 64-bit fingerprints, blocks, a join on these and a Hamming check. It can be sure only of
    pairs that differ in ``NEAR_BITS`` or fewer bits, while 0.8 means about ten; there is an exact way for the rest:
    every such pair shares one of the first shingles of either set in any order of the shingles, so filing under these
    loses none. Shingles that many rows file under in the order of hashes come last in the order used, so that a
    passage found everywhere crowds no bucket. 256-bit fingerprints with ``DEVIATIONS`` to spare sift the pairs that
    meet, and each link is confirmed by the whole sets. Sets are named by 64-bit hashes; texts with equal sets are
    linked, those without words (null, empty, white space) among them. An empty table gives an empty table.
    """
    import pyarrow as pa

    names = [f"f{i}" for i in range(WORDS)]
    texts = only(docs, text=text_col)

    def node_array(each):
        return np.array([_node(h) for h in each], np.uint64).view(np.int64)

    def mark(b):
        each = [shingles(t.as_py(), shingle_words) for t in b.column("text")]
        bits = np.array([wide_fingerprint(h) for h in each]).reshape(-1, WORDS).view(np.int64)
        first = pa.array([first_shingles(h, similarity).view(np.int64) for h in each], pa.list_(pa.int64()))
        columns = [b.column("doc_id"), b.column("mark"), pa.array(node_array(each)), pa.array([len(h) for h in each], pa.int32()), *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(WORDS)), first]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "node", "n", *names, "first"])

    def file(batches, common):
        from ._common import slices

        seen: set[int] = set()  # a task files a set once, so copies of a text don't crowd its buckets
        for b in (s for x in batches for s in slices(x)):
            each = [shingles(t.as_py(), shingle_words) for t in b.column("text")]
            rows = [(first_shingles(h, similarity, common), node) for h, node in zip(each, node_array(each).tolist(), strict=True) if node not in seen and not seen.add(node)]
            keys = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.uint64)
            nodes = np.repeat(np.array([r[1] for r in rows], np.int64), [len(r[0]) for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(nodes)], ["key", "node"])

    def whole(b, asked):
        each = [shingles(t.as_py(), shingle_words) for t in b.column("text")]
        nodes = node_array(each)
        slots = nodes & (ASKED_BITS - 1)
        some = np.nonzero(asked[slots >> 6] >> (slots & 63) & 1)[0]
        nodes, each = nodes[some], [each[i] for i in some]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([h.view(np.int64) for h in each], pa.list_(pa.int64()))], ["node", "shingles"])

    def sets_of(nodes):
        # A bitmap of bounded size keeps most sets that nobody asks for from the shuffle; the join below is exact.
        slot = nodes.select(F.col("node").bitwiseAND(F.lit(ASKED_BITS - 1)).alias("slot"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(F.lit(63)).cast("int"))
        found = slot.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toPandas()
        asked = np.zeros(ASKED_BITS >> 6, np.int64)
        asked[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
        rows = arrow_map(texts, whole, "node long, shingles array<long>", asked)
        return rows.join(nodes, "node", "left_semi").dropDuplicates(["node"])

    source = only(docs, doc_id=id_col, text=text_col).withColumn("mark", text_mark(F.col("text")))
    marked = cut(arrow_map(source, mark, id_and(docs, id_col, f"mark long, node long, n int, {', '.join(f'{n} long' for n in names)}, first array<long>")))
    often = marked.select(F.explode("first").alias("key")).groupBy("key").count().where(F.col("count") >= COMMON)
    common = np.sort(often.orderBy(F.desc("count"), "key").limit(MOST_COMMON).select("key").toArrow().column("key").to_numpy().view(np.uint64))
    filed = texts.mapInArrow(lambda batches: file(batches, common), "key long, node long")
    points = cut(marked.select("node", "n", *names).dropDuplicates(["node"]))
    parts = connected_components(similar_links(points, filed, sets_of, similarity, bucket_limit))
    rows = marked.select("doc_id", "mark", "node").join(parts, "node", "left")
    return rows.select("doc_id", "mark", F.coalesce("component", "node").alias("root"))


def text_mark(text):
    """Hash of a text; a null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def similar_documents(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, bucket_limit: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``similar_rows`` with the groups named by the smallest id: ``doc_id, component_id`` for each row.

    A null id never is a ``component_id`` unless a group has no other; repeated rows share a group; rows of one id and
    different texts may be in different groups. An empty table gives an empty table.
    """
    rows = cut(similar_rows(docs, shingle_words, similarity, bucket_limit, id_col, text_col))
    lowest = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(lowest, "root").select("doc_id", "component_id")


def simhash_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies on shingles of five words, one row stays.

    It is the one of the smallest id (a null is above all others), of the smallest hash of the text if that id is there
    with several texts of the group, and one of the rows that are equal in both. Rows of one id whose texts aren't
    alike are different documents and all stay.
    """
    rows = cut(similar_rows(docs, shingle_words=5, similarity=0.8))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("mark"))
    stays = rows.groupBy("root").agg(F.min(order).alias("first"))
    named = rows.groupBy("doc_id", "mark").agg(F.min("root").alias("root"), F.count(F.lit(1)).alias("times")).join(stays, "root")
    first = F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark"))
    leave = named.select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark"), first.alias("repeated"), "times").where("not repeated or times > 1")
    carried = docs.select(F.struct("*").alias("row"), docs["doc_id"].alias("own_id"), text_mark(docs["text"]).alias("own_mark"))
    found = carried.join(cut(leave), F.col("own_id").eqNullSafe(F.col("gone_id")) & (F.col("own_mark") == F.col("gone_mark")), "left")
    again = found.where("repeated").dropDuplicates(["own_id", "own_mark"])
    return found.where("repeated is null").select("row.*").union(again.select("row.*"))
