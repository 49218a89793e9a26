"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent letter n-grams in order; a document's is made the same way, and
the language whose profile has the document's n-grams least out of place wins. Words are runs of letters, lower-cased
and padded by a space on either side; n-grams of up to three characters are packed exactly into one 63-bit number.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, cut, id_and, only

PROFILE_SIZE = 300
MIN_SCORE = 0.05
#: Labelled texts of a language and length from which a limit of its own is learned.
MIN_LABELLED = 50
UNKNOWN = "und"
_LETTERS = regex.compile(r"\p{L}+")


def word_counts(text: str | None) -> Counter:
    return Counter(_LETTERS.findall((text or "").lower()))


def grams(word: str) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams of the padded word, without the lone space."""
    return _gram_codes([word])[0]


def _gram_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The grams of all words end to end, and how many each word has: words stand in one line with a space between, so
    every pair of neighbours is some word's, and every three whose middle is a letter."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    letter = c != 32
    ends = np.cumsum(~letter) - 1
    one = np.nonzero(letter)[0]
    three = one - 1
    codes = np.concatenate([c[one], c[:-1] << 21 | c[1:], c[three] << 42 | c[one] << 21 | c[three + 2]])
    owner = np.concatenate([ends[one], ends[:-1], ends[one]])
    order = np.argsort(owner, kind="stable")
    return codes[order], np.bincount(owner, minlength=len(words))


def _gram_table(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes in order, and for each word its grams' places in them (flat, with bounds)."""
    import pandas as pd

    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    flat, sizes = _gram_codes(words)
    places, codes = pd.factorize(flat)
    order = np.argsort(codes)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return codes[order], rank[places], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def fit(labelled: DataFrame, profile_size: int = PROFILE_SIZE) -> dict[str, np.ndarray]:
    """Profiles (codes, most frequent first, ties by code) from all rows of ``labelled`` (``text``, ``lang``).

    The driver receives ``profile_size`` codes a language.
    """

    def batch(b):
        import pyarrow as pa

        by: dict[str, Counter] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
            by.setdefault(lang, Counter()).update(word_counts(text.as_py()))
        langs, codes, numbers = [], [], []
        for lang, words in by.items():
            table, places, bounds = _gram_table(list(words))
            times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), np.diff(bounds))
            codes.append(table)
            numbers.append(np.bincount(places, times, len(table)).astype(np.int64))
            langs += [lang] * len(table)
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (codes, numbers)]
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(flat[0]), pa.array(flat[1])], ["lang", "code", "n"])

    rows = labelled.where("lang is not null and text is not null").select("lang", "text")
    counts = cut(arrow_map(rows, batch, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")))
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    return {x: np.array([r[0] for r in counts.where(F.col("lang") == x).orderBy(F.desc("n"), "code").limit(profile_size).select("code").collect()], np.int64) for x in langs}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], profile_size: int = PROFILE_SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text.

    A document's ``profile_size`` most frequent n-grams are compared; one that a profile lacks is out of place by
    ``profile_size``. ``score`` is 1 for a document that matches a profile exactly, 0 for one that shares nothing. Ties
    go to the language first in order. A text that is null or has no letter is ``und`` with score 0, and so is every
    text if no profile was learned. Repeated rows and null ids are judged like others; an empty table gives none.
    """
    langs = [x for x in sorted(profiles) if len(profiles[x])]
    ranked = [(codes[order := np.argsort(codes)], order) for codes in (profiles[x] for x in langs)]

    def batch(b, langs, ranked):
        import pyarrow as pa

        each = [word_counts(t.as_py()) for t in b.column("text")]
        words = {w: i for i, w in enumerate({w for c in each for w in c})}
        codes, places, bounds = _gram_table(list(words))
        ranks = np.full((len(langs), len(codes)), -1, np.int64)
        for i, (known, order) in enumerate(ranked):
            at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            ranks[i] = np.where(known[at] == codes, order[at], -1)
        found, scores = [], []
        for counter in each:
            if not counter or not langs:
                found.append(UNKNOWN)
                scores.append(0.0)
                continue
            at = np.fromiter(map(words.__getitem__, counter), np.int64, len(counter))
            size = bounds[at + 1] - bounds[at]
            flat = places[np.repeat(bounds[at] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
            times = np.bincount(flat, np.repeat(np.fromiter(counter.values(), np.int64, len(counter)), size), len(codes))
            some = np.nonzero(times)[0]
            top = some[np.argsort(-times[some], kind="stable")[:profile_size]]
            rank = ranks[:, top]
            away = np.where(rank < 0, profile_size, np.minimum(np.abs(rank - np.arange(len(top))), profile_size)).sum(axis=1)
            best = int(np.argmin(away))
            found.append(langs[best])
            scores.append(1.0 - float(away[best]) / (profile_size * len(top)))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return arrow_map(only(docs, doc_id=id_col, text=text_col), batch, id_and(docs, id_col, "lang_pred string, score double"), langs, ranked)


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text leaves 0 divided by 5 (a null id counts as an empty text, and is held out)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_documents(docs: DataFrame) -> dict[str, np.ndarray]:
    return fit(docs.where(~held_out(docs["doc_id"])).select("text", "lang"))


def language_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without letters, or too far from every language's profile, go.

    Profiles are learned from the stage's own labelled input, and so are the limits (see ``limits``). Where no row names a
    language, nothing can be learned: only documents without letters go then.
    """
    profiles = fit_documents(docs)
    langs = [x for x in sorted(profiles) if len(profiles[x])]
    if not langs:
        return docs.where(F.regexp_like("text", F.lit(r"\p{L}")))
    carried = docs.select(F.struct("*").alias("row"), F.col("text"))
    marked = cut(predict_rows(carried, profiles).withColumn("size", _size(F.col("row")["text"])))
    low = F.lit(MIN_SCORE)
    for (lang, size), limit in limits(marked.select(F.col("row")["lang"].alias("lang"), "lang_pred", "size", "score")).items():
        same = F.col("lang_pred") == lang
        low = F.when(same if size is None else same & (F.col("size") == size), F.lit(limit)).otherwise(low)
    return marked.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= low)).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def _size(text) -> F.Column:
    """Length class: scores grow with the length of a text."""
    return F.floor(F.log2(F.length(text) + F.lit(1))).cast("int")


def limits(scored: DataFrame) -> dict[tuple[str, int | None], float]:
    """Lowest scores of each language (size None, first) and of its length classes, from all labelled rows of
    ``scored`` (``lang, lang_pred, size, score``) whose label was found.

    A limit lies below the lowest hundredth by twice the way from the median to the lowest tenth, so that ordinary texts
    stay. A class with few labelled rows has the language's lowest limit, a language with few has ``MIN_SCORE``. The
    driver receives a row for each class.
    """
    known = scored.where("lang = lang_pred").rollup("lang", "size").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("score", [0.01, 0.1, 0.5], 10_000).alias("q"))
    found = {(r.lang, r.size): max(MIN_SCORE, r.q[0] - 2 * (r.q[2] - r.q[1])) for r in known.where("lang is not null").collect() if r.n >= MIN_LABELLED}
    lowest = {lang: min(x for (other, _), x in found.items() if other == lang) for lang, _ in found}
    return {(lang, None): x for lang, x in sorted(lowest.items())} | {k: x for k, x in found.items() if k[1] is not None}


def predict_rows(carried: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """Like ``predict`` for rows kept in a struct ``row``: it takes the place of the id."""
    return predict(carried.withColumnRenamed("row", "doc_id"), profiles).withColumnRenamed("doc_id", "row")
