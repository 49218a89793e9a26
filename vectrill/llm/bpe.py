"""BPE encoding and decoding with batched numpy merge rounds.

The symbols of all new words of a batch lie in one flat array. A round looks up every neighbouring pair by binary
search over the sorted pair keys, finds each word's lowest rank, merges that pair's occurrences in all words at once,
and lets words without a mergeable pair go. Words are encoded once a task: a bounded memo maps them to their ids.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame

from ._common import arrow_map, id_and, only
from .packing import byte_characters

_NONE = np.iinfo(np.int64).max
MEMO_WORDS = 400_000
_tables: dict = {}


class WordBpe:
    """A byte-level BPE vocabulary whose words end in a suffix, as a ``tokenizer.json`` describes it."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.tokens = {i: t for t, i in (vocab | self.special).items()}
        letters = byte_characters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        self.width = np.int64(max(vocab.values()) + 1)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        keys = np.array([int(a * self.width + b) for a, b, _ in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([c for _, _, c in pairs], np.int64)
        # A symbol made by several merges might bring up a pair of a lower rank halfway; then one pair is merged a round.
        made: dict[int, int] = {}
        for r, (_, _, c) in enumerate(pairs):
            made[c] = max(r, made.get(c, -1))
        needs = np.array([max(made.get(a, -1), made.get(b, -1)) for a, b, _ in pairs], np.int64)
        self.ordered = bool((needs < np.arange(len(pairs))).all())
        self.memo: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.memo.clear()
        self.flat, self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words end to end, and how many each word has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(lengths)
        symbols[ends - 1] = self.last[raw[ends - 1]]
        owner = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_owner = [], []
        while len(symbols):
            key = symbols[:-1] * self.width + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = (self.keys[at] == key) & (owner[:-1] == owner[1:])
            rank = np.append(np.where(found, self.ranks[at], _NONE), _NONE)
            starts = np.nonzero(np.append(True, owner[1:] != owner[:-1]))[0]
            sizes = np.diff(np.append(starts, len(owner)))
            lowest = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            over = lowest == _NONE
            if over.any():
                done_symbols.append(symbols[over])
                done_owner.append(owner[over])
                go = ~over
                symbols, owner, rank, lowest = symbols[go], owner[go], rank[go], lowest[go]
                if not len(symbols):
                    break
            take = rank == lowest
            if self.ordered:
                # Of a run of overlapping matches every other one counts, from the left.
                spot = np.arange(len(take))
                run = spot - np.maximum.accumulate(np.where(take, -1, spot)) - 1
                take &= (run % 2 == 0) | ~self._overlaps(symbols)
            else:
                first = np.zeros(len(take), bool)
                hits = np.nonzero(take)[0]
                first[hits[np.append(True, owner[hits][1:] != owner[hits][:-1])]] = True
                take = first
            where = np.nonzero(take)[0]
            symbols[where] = self.merged[rank[where]]
            stay = np.ones(len(symbols), bool)
            stay[where + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        if not done_owner:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.bincount(owner, minlength=len(words))

    @staticmethod
    def _overlaps(symbols: np.ndarray) -> np.ndarray:
        """Whether the pair at a place overlaps an equal pair before or after it: only pairs of twice the same symbol."""
        return np.append(symbols[:-1] == symbols[1:], False)

    def words(self, text: str) -> list[str]:
        """Pre-tokens: canonical composition, characters lower-cased one by one, white space dropped."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")
        return self.pattern.findall(text.lower())

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.memo) > MEMO_WORDS:
            self._forget()
        parts: list[list] = []
        new: dict[str, int] = {}
        for text in texts:
            if "<|" in text:
                pieces = [p if p in self.special else self.words(p) for p in self.at_special.split(text)]
            else:
                pieces = [self.words(text)]
            parts.append(pieces)
            for p in pieces:
                if not isinstance(p, str):
                    for w in p:
                        if w not in self.memo and w not in new:
                            new[w] = len(self.memo) + len(new)
        if new:
            ids, counts = self.merge([w.encode() for w in new])
            begin = len(self.flat) + np.cumsum(counts) - counts
            self.flat, self.begin, self.count = np.concatenate([self.flat, ids]), np.concatenate([self.begin, begin]), np.concatenate([self.count, counts])
            self.memo |= new
        return [np.concatenate([np.array([self.special[p]]) if isinstance(p, str) else self._ids(p) for p in pieces]) for pieces in parts]

    def _ids(self, words: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        count = self.count[at]
        total = int(count.sum())
        shift = np.repeat(self.begin[at] - np.cumsum(count) + count, count)
        return self.flat[shift + np.arange(total)]

    def decode(self, ids: np.ndarray) -> str:
        """The tokens joined by spaces: what a ``tokenizer.json`` without a decoder asks for; unknown ids are skipped."""
        names = self.tokens
        return " ".join([names[i] for i in ids.tolist() if i in names])


def table(path: str) -> WordBpe:
    if path not in _tables:
        _tables[path] = WordBpe(path)
    return _tables[path]


def encode(docs: DataFrame, tokenizer_path: str, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if ``with_ids``, ``ids`` and ``decoded``.

    Null and empty texts have no ids and decode to an empty text. The strings of special tokens become those tokens.
    Null ids, repeated rows and other columns change nothing; an empty table gives an empty table.
    """

    def batch(b, path):
        import pyarrow as pa

        bpe = table(path)
        ids = bpe.encode_batch([t.as_py() or "" for t in b.column("text")])
        decoded = [bpe.decode(x) for x in ids]
        columns = {
            "doc_id": b.column("doc_id"),
            "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
        }
        if with_ids:
            columns |= {"ids": pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
        yield pa.RecordBatch.from_pydict(columns)

    schema = id_and(docs, id_col, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids)
    return arrow_map(only(docs, doc_id=id_col, text=text_col), batch, schema, tokenizer_path)


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
