"""Line dedup over the whole corpus with a sharded minimal perfect hash.

Every task sends the 128-bit hashes of the distinct lines of some of its documents, with the number of documents that
hold each, to hash shards. A shard adds them up and builds a minimal perfect hash over the distinct hashes of the lines
that enough documents share; the hash indexes two compact arrays (32-bit fingerprints and document counts). Documents then probe
these arrays with all their line hashes; the fingerprints turn away lines that the index doesn't hold. Lines themselves
are never joined and texts are never shuffled, unless the arrays of all shards together are too large to be sent to every
task: then documents are dealt into blocks, whose hashes go to the shards and are probed there.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from ._blocks import ask, in_blocks
from ._common import SPACE_BYTES, arrow_map, cut, id_and, parts_for, slices

SHARD_BYTES = 24 << 20
#: Index arrays of up to this size are sent to every task.
INDEX_BYTES = 48 << 20
#: Distinct lines that a task holds before it sends them off.
HELD_KEYS = 200_000
_GAMMA = 1.6


def line_key(line: bytes) -> bytes:
    """A line's key: white space stripped at both ends, A-Z lower-cased."""
    return line.strip(SPACE_BYTES).lower()


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    """splitmix64's finaliser; an independent position for each level."""
    with np.errstate(over="ignore"):
        x = h + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _spot(low: np.ndarray, high: np.ndarray, level: int, size: int) -> np.ndarray:
    """A key's position at a level. Both halves are mixed anew, so keys that meet at one level part at the next."""
    return (_mix(_mix(low, level) ^ high, level) % np.uint64(size)).astype(np.int64)


class LineIndex:
    """Minimal perfect hash over distinct 128-bit keys, with a fingerprint and a count for each slot.

    Cascading bit arrays: at each level the keys whose position nobody else takes are placed there and the others go
    on. A key's slot is the rank of its bit. Probes with a key that was never added are caught by the fingerprint.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, counts: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        left, base = np.arange(len(low)), 0
        while len(left):
            size = max(64, int(_GAMMA * len(left)) + 63 & ~63)
            at = _spot(low[left], high[left], len(self.levels), size)
            times = np.bincount(at, minlength=size)
            words = np.packbits(times == 1, bitorder="little").view(np.uint64)
            ranks = base + np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.levels.append((size, words, ranks))
            base = int(ranks[-1])
            left = left[times[at] != 1]
        slots = self.slots(low, high)
        self.fingerprints = np.zeros(base, np.uint32)
        self.counts = np.zeros(base, np.int64)
        self.fingerprints[slots] = (high >> np.uint64(32)).astype(np.uint32)
        self.counts[slots] = counts

    def slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for one that reaches no set bit."""
        out, left = np.full(len(low), -1, np.int64), np.arange(len(low))
        for n, (size, words, ranks) in enumerate(self.levels):
            at = _spot(low[left], high[left], n, size)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (ranks[at >> 6] + np.bitwise_count(below))[hit]
            left = left[~hit]
        return out

    def probe(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Count of each key, 0 for one that isn't held."""
        slots = self.slots(low, high)
        if not len(self.counts):
            return np.zeros(len(low), np.int64)
        known = (slots >= 0) & (self.fingerprints[slots] == (high >> np.uint64(32)).astype(np.uint32))
        return np.where(known, self.counts[slots], 0)


def _digest(key: bytes) -> int:
    return xxhash.xxh3_128_intdigest(key)


def _unpack(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(buffer, np.uint64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def wanted(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)


def _hashes(keys) -> np.ndarray:
    """128-bit hashes of line keys as rows of two unsigned longs, low half first."""
    mask = (1 << 64) - 1
    each = [_digest(k) for k in keys]
    return np.array([(h & mask, h >> 64) for h in each], np.uint64).reshape(-1, 2)


def _by_shard(keys: np.ndarray, shards: int):
    """For each shard that keys fall into: its number and the places of its keys."""
    shard = (keys[:, 1] % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.nonzero(np.diff(shard[order]))[0] + 1
    for rows in np.split(order, cuts) if len(order) else []:
        yield int(shard[rows[0]]), rows


def _added_up(keys: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their numbers."""
    order = np.lexsort((keys[:, 0], keys[:, 1]))
    keys, numbers = keys[order], numbers[order]
    starts = np.nonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))[0]
    return keys[starts], np.add.reduceat(numbers.astype(np.int64), starts)


def line_counts(texts: DataFrame, shards: int, min_chars: int) -> DataFrame:
    """``shard, keys, numbers``: packed hashes of lines and in how many rows of ``texts`` (text) each is found, summed
    within a task."""
    import pyarrow as pa

    def send(batches):
        counts: Counter = Counter()

        def flush():
            hashes = _hashes(counts)
            numbers = np.fromiter(counts.values(), np.int32, len(counts))
            rows = [(s, hashes[at].tobytes(), numbers[at].tobytes()) for s, at in _by_shard(hashes, shards)]
            counts.clear()
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["shard", "keys", "numbers"])

        for b in (x for y in batches for x in slices(y)):
            for text in b.column("text"):
                counts.update({k for x in (text.as_py() or "").encode().split(b"\n") if wanted(k := line_key(x), min_chars)})
                if len(counts) >= HELD_KEYS:
                    yield flush()
        yield flush()

    return texts.select("text").mapInArrow(send, "shard int, keys binary, numbers binary")


def line_index(counts: DataFrame, min_docs: int) -> DataFrame:
    """``shard, index`` (a pickled ``LineIndex`` over the lines that at least ``min_docs`` documents hold)."""
    import pyarrow as pa

    def build(table):
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint64).reshape(-1, 2)
        numbers = np.frombuffer(b"".join(table.column("numbers").to_pylist()), np.int32)
        keys, numbers = _added_up(keys, numbers)
        hot = numbers >= min_docs
        made = [pickle.dumps(LineIndex(keys[hot, 0], keys[hot, 1], numbers[hot]))] if hot.any() else []
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()][: len(made)], pa.int32()), "index": pa.array(made, pa.binary())})

    return cut(counts.groupBy("shard").applyInArrow(build, "shard int, index binary"))


def fetched(index: DataFrame, most: int) -> dict[int, LineIndex] | None:
    """The shards of an index, or None if they are larger than ``most`` bytes together."""
    from pyspark.sql import functions as F

    if (index.agg(F.sum(F.octet_length("index").cast("long"))).first()[0] or 0) > most:
        return None
    return {r["shard"]: pickle.loads(r["index"]) for r in index.collect()}


def probe(parts: dict[int, LineIndex], hashes: np.ndarray, shards: int) -> np.ndarray:
    """The count of each line hash, 0 where the index doesn't hold it."""
    out = np.zeros(len(hashes), np.int64)
    for s, rows in _by_shard(hashes, shards):
        if s in parts:
            out[rows] = parts[s].probe(hashes[rows, 0], hashes[rows, 1])
    return out


def _counted_once(texts: DataFrame, shards: int, min_docs: int, min_chars: int, most: int) -> DataFrame:
    """Like ``line_counts``, with rows of equal text counted as one. Only lines that enough rows hold are paired with
    the texts they are in (all lines, if the index of those is too large)."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    parts = fetched(line_index(line_counts(texts, shards, min_chars), min_docs), most)

    def pair(b, parts):
        lines, owners = [], []
        for text, mark in zip(b.column("text"), b.column("mark").to_pylist(), strict=True):
            own = {k for x in (text.as_py() or "").encode().split(b"\n") if wanted(k := line_key(x), min_chars)}
            lines += own
            owners += [mark] * len(own)
        hashes = _hashes(lines)
        some = np.nonzero(probe(parts, hashes, shards))[0] if parts is not None else np.arange(len(lines))
        columns = [pa.array(hashes[some, i].view(np.int64)) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.array(owners, np.int64)[some], pa.int64())], ["low", "high", "mark"])

    marked = texts.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
    found = arrow_map(marked, pair, "low long, high long, mark long", parts).distinct().groupBy("low", "high").agg(F.count(F.lit(1)).alias("n"))

    def pack(batches):
        for b in batches:
            hashes = np.stack([b.column(c).to_numpy().view(np.uint64) for c in ("low", "high")], axis=1)
            numbers = b.column("n").to_numpy().astype(np.int32)
            rows = [(s, hashes[at].tobytes(), numbers[at].tobytes()) for s, at in _by_shard(hashes, shards)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["shard", "keys", "numbers"])

    return found.mapInArrow(pack, "shard int, keys binary, numbers binary")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_text: bool = True, n_shards: int | None = None, index_bytes: int = INDEX_BYTES, once_a_text: bool = False) -> DataFrame:
    r"""Drop every line whose key is at least ``min_chars`` code points and found in at least ``min_docs`` documents.

    Returns ``doc_id, n_lines, n_dropped, kept_sha256``, ``kept_text`` if ``with_text`` and, as ``keep_<name>``, the columns named in ``keep``. Texts are split
    at ``\n``; a null or empty text is one empty line; the other lines stay in order, joined by ``\n``. Each row counts
    as a document whatever its id, so repeated rows count each time; with ``once_a_text``, rows of equal text count as one. Null ids are carried along. An empty table gives an empty table;
    columns that aren't named are ignored, whatever their names.
    """
    import pyarrow as pa

    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), *[docs[f"`{c}`"].alias(f"keep_{c}") for c in keep])
    shards = n_shards or parts_for(docs.select(id_col, text_col), SHARD_BYTES)
    counts = _counted_once(source, shards, min_docs, min_chars, index_bytes) if once_a_text else line_counts(source, shards, min_chars)
    index = line_index(counts, min_docs)
    parts = fetched(index, index_bytes)
    schema = id_and(docs, id_col, "n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * with_text)
    for c in keep:
        schema = schema.add(f"keep_{c}", docs.schema[c].dataType)

    def rewritten(columns, gone: set[bytes]) -> dict:
        """The result's columns for rows whose lines with a key in ``gone`` go."""
        total, dropped, texts, digests = [], [], [], []
        for text in columns("text"):
            lines = (text.as_py() or "").encode().split(b"\n")
            stay = [x for x in lines if line_key(x) not in gone]
            joined = b"\n".join(stay)
            total.append(len(lines))
            dropped.append(len(lines) - len(stay))
            if with_text:
                texts.append(joined.decode())
            digests.append(hashlib.sha256(joined).hexdigest())
        out = {"doc_id": columns("doc_id"), "n_lines": pa.array(total, pa.int64()), "n_dropped": pa.array(dropped, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return out | ({"kept_text": pa.array(texts, pa.string())} if with_text else {}) | {f"keep_{c}": columns(f"keep_{c}") for c in keep}

    def keys_of(column) -> list[bytes]:
        return [k for k in {line_key(x) for t in column for x in (t.as_py() or "").encode().split(b"\n")} if wanted(k, min_chars)]

    if parts is not None:

        def drop(b, parts):
            keys = keys_of(b.column("text"))
            hot = probe(parts, _hashes(keys), shards) >= min_docs
            out = rewritten(b.column, {keys[i] for i in np.nonzero(hot)[0]})
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

        return arrow_map(source, drop, schema, parts)

    def request(table):
        hashes = _hashes(keys_of(table.column("text")))
        for s, rows in _by_shard(hashes, shards):
            yield s, hashes[rows].tobytes(), None

    def answer(table, own):
        index = {s: pickle.loads(x) for s, x in zip(own.column("shard").to_pylist(), own.column("index").to_pylist(), strict=True)}
        out_blocks, out = [], []
        for block, shard, buffer in zip(*(table.column(c).to_pylist() for c in ("block", "shard", "keys")), strict=True):
            hashes = np.frombuffer(buffer, np.uint64).reshape(-1, 2)
            hot = probe(index, hashes, shards) >= min_docs if shard in index else np.zeros(0, bool)
            if hot.any():
                out_blocks.append(block)
                out.append(hashes[hot].tobytes())
        return pa.table({"block": pa.array(out_blocks, pa.int32()), "hot": pa.array(out, pa.binary())})

    def finish(left, right):
        hot = set(map(bytes, (h for x in right.column("hot").to_pylist() for h in np.frombuffer(x, "V16"))))
        keys = keys_of(left.column("text"))
        return pa.table(rewritten(left.column, {k for k, h in zip(keys, _hashes(keys), strict=True) if h.tobytes() in hot}))

    return ask(in_blocks(source), request, answer, "hot binary", finish, schema, index)


def line_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with lines found in ten different texts or more taken out; no document goes.

    Copies of a text count once, or a text with ten copies would lose all of them; near-dedup leaves one.
    """
    from pyspark.sql import functions as F

    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = dedup_lines(docs, keep=rest, once_a_text=True)
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*[columns.get(c, F.col(f"`keep_{c}`" if c in rest else c)).alias(c) for c in docs.columns])
