"""Packing by power-of-two decomposition: every piece is a training sequence of one document.

A document of n tokens is cut into pieces of the maximum length and then into the powers of two of the remainder's
binary form, longest first. Pieces of one length form a bucket, so a batch of ``tokens_per_batch / length`` sequences
from one bucket is rectangular without padding, and no sequence crosses documents.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, id_and, only

MAX_TOKENS = 2048
END = "<|endoftext|>"
_encoders: dict = {}


def encoder(path: str):
    """tiktoken's engine with the vocabulary, pattern and special tokens of a byte-level BPE ``tokenizer.json``.

    It gives the ids of ``tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` at a fifth of
    the time, the strings of special tokens included; tests compare the two.
    """
    if path not in _encoders:
        import json

        import public_tokenizers
        import tiktoken

        spec = json.loads(open(path, encoding="utf-8").read())
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        to_byte = {c: b for b, c in enumerate(byte_characters())}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        _encoders[path] = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[path]


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if it is printable
    Latin-1, else the next one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def cuts(n: int, most: int = MAX_TOKENS) -> list[int]:
    """Piece lengths of a document of ``n`` tokens: full ones, then the set bits of the rest, longest first."""
    full, rest = divmod(n, most)
    return [most] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, end_id: int = 1, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket`` and, if
    ``with_ids``, ``ids`` (little-endian unsigned 32-bit).

    ``max_tokens`` is a power of two. ``sequence_id`` is unique and rises within a partition; it comes from the
    partition and the place in it, so a retried task gives the same ids. ``offset`` is 0: a sequence is one piece.
    ``bucket`` is the length's power of two, made to be written with ``partitionBy("bucket")``. A null or empty text is a
    document of one token, ``end_id``. Repeated rows and null ids are packed like others; an empty table gives none.
    """
    if max_tokens & (max_tokens - 1) or max_tokens < 1:
        raise ValueError("max_tokens must be a power of two")

    def batch(b, path):
        import pyarrow as pa

        encode = encoder(path)
        special = encode.special_tokens_set
        row, start, length, crc, total, ids = [], [], [], [], [], []
        for i, text in enumerate(b.column("text")):
            text = text.as_py() or ""
            tokens = encode.encode(text, allowed_special="all") if any(s in text for s in special) else encode.encode_ordinary(text)
            tokens.append(end_id)
            flat, at = np.array(tokens, "<u4").tobytes(), 0
            for n in cuts(len(tokens), max_tokens):
                piece = flat[4 * at : 4 * (at + n)]
                row.append(i)
                start.append(at)
                length.append(n)
                crc.append(zlib.crc32(piece))
                total.append(len(tokens))
                if with_ids:
                    ids.append(piece)
                at += n
        columns = [b.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        if with_ids:
            columns.append(pa.array(ids, pa.binary()))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names)

    schema = id_and(docs, id_col, "start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)
    pieces = arrow_map(only(docs, doc_id=id_col, text=text_col), batch, schema, tokenizer_path)
    pieces = pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return pieces.withColumn("bucket", F.log2("length").cast("int"))


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the training sequences, one row each, with their token ids."""
    return pack(docs, byte_bpe_path())
