"""Stupid-backoff language-model scores (Brants et al., 2007), computed relationally.

N-gram counts of the whole corpus live in tables partitioned by a hash of the n-gram. Documents are exploded into
n-grams, which are grouped in blocks of documents, counted and joined to the counts in their hash partition, and brought
back and summed for each document. It is the plan explode, group, join, sum with packed columns: the rows of a block that
go to one hash partition travel as one row of sorted hashes, since a row for each n-gram would not fit the disk.
"""

from __future__ import annotations

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame

from ._blocks import ask, in_blocks
from ._common import id_and, only, parts_for

SHARD_BYTES = 6 << 20
BLOCK_BYTES = 11 << 20
BACKOFF = 0.4
#: The key under which a block sends its number of words; its count is the size of the corpus.
_ALL = np.uint64(0x5D1C3E0F9A7B2468)


def _roll(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from those of its beginning and its last word; the order of words matters."""
    with np.errstate(over="ignore"):
        x = (left ^ (left >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + right
        return (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


class _Memo(dict):
    """Hashes of words, worked out once each."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word, 7) | 1
        return value


def ngrams(texts, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the n-grams that end at each word, for n from 1 (0 where a text has no such n-gram yet), and the
    number of words of each text. ``texts`` yields strings or None."""
    known = _Memo()
    each = []
    for text in texts:
        words = (text or "").encode().lower().split()
        each.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    one = np.concatenate(each) if each else np.zeros(0, np.uint64)
    place = np.arange(len(one)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = [one]
    for n in range(2, order + 1):
        longer = np.zeros(len(one), np.uint64)
        if len(one) >= n:
            longer[1:] = _roll(out[-1][:-1], one[1:]) | np.uint64(1)
            longer[place < n - 1] = 0
        out.append(longer)
    return out, sizes


def _distinct(grams: list[np.ndarray], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of all orders and that of the corpus size, how often each occurs, and where each n-gram's key is
    (the orders end to end; an n-gram that isn't there has the first place, which is never read)."""
    flat = np.concatenate([*grams, np.array([0, _ALL], np.uint64)])
    order = np.argsort(flat).astype(np.int32)
    flat = flat[order]
    first = np.append(True, flat[1:] != flat[:-1])
    keys = flat[first]
    counts = np.diff(np.nonzero(first)[0], append=len(flat))
    at = np.empty(len(flat), np.int32)
    at[order] = np.cumsum(first, dtype=np.int32) - 1
    counts[at[-1]] = words
    return keys[1:], np.maximum(at - 1, 0), counts[1:]


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes, lowest bytes first: planes of small numbers shrink to nothing."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), 1)


def unpack(buffer: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(buffer), np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted unsigned longs as their differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(buffer: bytes) -> np.ndarray:
    return np.cumsum(unpack(buffer, np.uint64), dtype=np.uint64)


def score(docs: DataFrame, order: int = 3, min_count: int = 2, backoff: float = BACKOFF, id_col: str = "doc_id", text_col: str = "text", n_shards: int | None = None, n_blocks: int | None = None) -> DataFrame:
    """``doc_id, n_words, score``: the mean over a text's words of the natural log of their stupid-backoff score.

    S(w | history) is count(history w) / count(history) for the longest history of up to ``order - 1`` words whose
    n-gram is found at least ``min_count`` times, times ``backoff`` for every word dropped from the longest that the
    text has there; without a history it is count(w) / all words. Counts are over all rows, repeated ones included. As
    the scored documents are the counted ones, an n-gram of count 1 is the very occurrence that is scored: it says nothing
    about the text and nothing would ever back off if it counted, hence ``min_count`` 2.
    Words are runs of anything but ASCII white space, A-Z lower-cased. A text without words (null, empty) has a null
    score. Null ids are carried along; an empty table gives an empty table.
    """
    import pyarrow as pa

    shards = n_shards or parts_for(docs.select(id_col, text_col), SHARD_BYTES)
    blocks = in_blocks(only(docs, doc_id=id_col, text=text_col), BLOCK_BYTES, n_blocks)

    def by_shard(keys):
        """The shards that sorted keys go to, and the ranges of their keys."""
        shard = ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
        starts = np.nonzero(np.append(True, shard[1:] != shard[:-1]))[0]
        return zip(shard[starts].tolist(), starts.tolist(), np.append(starts[1:], len(keys)).tolist(), strict=True)

    def request(table):
        grams, sizes = ngrams((t.as_py() for t in table.column("text")), order)
        keys, _, counts = _distinct(grams, int(sizes.sum()))
        for shard, a, b in by_shard(keys):
            yield shard, pack_sorted(keys[a:b]), pack(counts[a:b].astype(np.int32))

    def answer(table):
        asked = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
        own = [unpack(x, np.int32) for x in table.column("extra").to_pylist()]
        keys, at = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(at, np.concatenate(own), len(keys)).astype(np.int64)
        ends = np.cumsum([len(x) for x in asked])
        # What other blocks have is sent back: nothing, mostly.
        out = [pack(total[at[e - len(x) : e]] - n) for x, n, e in zip(asked, own, ends, strict=True)]
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "counts": pa.array(out, pa.binary())})

    def finish(left, right):
        grams, sizes = ngrams((t.as_py() for t in left.column("text")), order)
        keys, at, totals = _distinct(grams, int(sizes.sum()))
        replies = dict(zip(right.column("shard").to_pylist(), right.column("counts").to_pylist(), strict=True))
        for shard, a, b in by_shard(keys):
            totals[a:b] += unpack(replies[shard], np.int64)
        everything = totals[at[-1]]
        if len(grams[0]) == 0:
            sums = np.zeros(len(sizes))
        else:
            n_all = len(grams[0])
            counts = [np.where(g != 0, totals[at[i * n_all : (i + 1) * n_all]], 0) for i, g in enumerate(grams)]
            logs = np.log(counts[0] / everything)
            for n in range(2, order + 1):
                has = grams[n - 1] != 0
                before = np.append(1, counts[n - 2][:-1])
                seen = has & (counts[n - 1] >= min_count)
                logs = np.where(seen, np.log(np.maximum(counts[n - 1], 1) / np.maximum(before, 1)), np.where(has, logs + np.log(backoff), logs))
            ends = np.cumsum(sizes)
            run = np.concatenate([[0.0], np.cumsum(logs)])
            sums = run[ends] - run[ends - sizes]
        mean = [float(s / n) if n else None for s, n in zip(sums.tolist(), sizes.tolist(), strict=True)]
        return pa.table({"doc_id": left.column("doc_id"), "n_words": pa.array(sizes, pa.int64()), "score": pa.array(mean, pa.float64())})

    return ask(blocks, request, answer, "shard int, counts binary", finish, id_and(docs, id_col, "n_words long, score double"))
