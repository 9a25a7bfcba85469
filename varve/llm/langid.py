"""Language identification: multinomial naive Bayes over hashed character n-grams.

The fit counts n-grams in the tasks, sums them by (language, bucket) and leaves a matrix whose size is set by the
number of buckets and languages. It is broadcast, and a batch is scored as a sparse document-by-bucket count matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.tables import columns_or_null
from varve.llm.words import slices
from varve.session import stage

UNKNOWN = "und"
BUCKETS = 1 << 14
ORDERS = 3
#: A text is read in parts of this many characters, so memory does not follow its length.
PART = 1 << 18
_LETTER = regex.compile(r"\p{L}")
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """By code point of the basic plane: itself for a letter or mark, else a space."""
    global _letters
    if _letters is None:
        table = np.full(0x10000, 0x20, np.uint32)
        for m in regex.finditer(r"[\p{L}\p{M}]", "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)):
            table[ord(m[0])] = ord(m[0])
        _letters = table
    return _letters


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the lower-cased text's 1- to 3-grams of letters and gaps, ascending, and how often each occurs."""
    total = np.zeros(BUCKETS, np.int64)
    text = text.lower()
    for at in range(0, len(text), PART):
        # Parts overlap so that each n-gram is counted where it ends.
        lead = min(at, ORDERS - 1)
        points = np.frombuffer(text[at - lead : at + PART].encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.where(points < 0x10000, _letter_table()[np.minimum(points, 0xFFFF)], points)
        mixed = np.zeros(len(points), np.uint32)
        for n in range(ORDERS):
            term = points * _FACTORS[n]
            mixed[n:] ^= term[: len(points) - n] >> np.uint32(7) ^ term[: len(points) - n]
            code = (mixed * np.uint32(0x9E3779B1)) >> np.uint32(18)
            total += np.bincount(code[max(n, lead) :], minlength=BUCKETS)
    used = np.flatnonzero(total)
    return used, total[used]


@dataclass
class LanguageModel:
    languages: list[str]
    log_prior: np.ndarray
    log_likelihood: np.ndarray  # bucket x language

    def scores(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior probability."""
        rows = [gram_counts(t) if t and _LETTER.search(t) else None for t in texts]
        known = [i for i, r in enumerate(rows) if r is not None]
        names, best = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if known and self.languages:
            sizes = np.array([len(rows[i][0]) for i in known])
            bucket = np.concatenate([rows[i][0] for i in known])
            count = np.concatenate([rows[i][1] for i in known])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            logp = np.add.reduceat(self.log_likelihood[bucket] * count[:, None], starts) + self.log_prior
            logp -= logp.max(axis=1, keepdims=True)
            posterior = np.exp(logp)
            posterior /= posterior.sum(axis=1, keepdims=True)
            for i, k, p in zip(known, posterior.argmax(axis=1), posterior.max(axis=1)):
                names[i], best[i] = self.languages[k], p
        return names, best


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in slices(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            used, counts = gram_counts(text)
            sums.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))[used] += counts
            sums[lang][BUCKETS] += 1
    for lang, counts in sums.items():
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(counts[used])], names=["lang", "bucket", "n"])


def fit_languages(labelled: DataFrame, fit_rows: int = 20_000, max_languages: int = 2_000) -> LanguageModel:
    """A model of the non-null `lang` values of `labelled(doc_id, text, lang)`.

    It is fitted on about `fit_rows` rows, taken by a hash of doc_id and text, so a rerun takes the same. Null texts
    teach nothing. More than `max_languages` languages are refused: the matrix must stay small enough to broadcast.
    """
    rows = columns_or_null(labelled, doc_id="string", text="string", lang="string").where("lang is not null and text is not null")
    share = min(1.0, fit_rows / max(1, rows.count()))
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(share * 1_000_000))
    sums = rows.select("text", "lang").mapInArrow(_counter, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sums = stage(sums)
    found = sums.select("lang").distinct().count()
    if found > max_languages:
        raise ValueError(f"{found} languages; max_languages is {max_languages}")
    pdf = sums.toPandas()
    languages = sorted(pdf["lang"].unique())
    counts = np.zeros((BUCKETS + 1, len(languages)))
    index = {lang: i for i, lang in enumerate(languages)}
    counts[pdf["bucket"].to_numpy(), pdf["lang"].map(index).to_numpy(dtype=int)] = pdf["n"].to_numpy()
    docs, grams = counts[BUCKETS], counts[:BUCKETS] + 0.5
    return LanguageModel(languages, np.log(docs / max(docs.sum(), 1)), np.log(grams / grams.sum(axis=0)))


def identify_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of `docs(doc_id, text)`; other columns are not looked at.

    `und` with score 0 where the text is null or has no letter, or where the model knows no language. Whole texts
    count, of any length; equal scores go to the language that sorts first; repeated rows give repeated rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, best = shared.value.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(best, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return columns_or_null(docs, doc_id="long", text="string").mapInArrow(score, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of `docs`, all columns, whose text has a language (see `identify_language`); the text is judged in place, nothing is joined.

    A model that knows no language cannot reject one: every row whose text has a letter stays then.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            if shared.value.languages:
                known = [n != UNKNOWN for n in shared.value.scores(texts)[0]]
            else:
                known = [bool(t and _LETTER.search(t)) for t in texts]
            kept = batch.filter(pa.array(known, pa.bool_()))
            if kept.num_rows:
                yield kept

    return docs.mapInArrow(keep, schema)
