"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the most frequent n-grams (one to three characters inside words, word ends
included) in order of frequency. A document goes to the language whose profile has the least
out-of-place distance to its own: the sum, over the document's n-grams, of how far each one's rank
is from its rank in the language, or the profile size where it is missing.

Profiles are fitted on a bounded sample of labelled rows (``rows_per_language``, chosen by a hash of
the id); every document is then predicted from its whole text.

Edge cases: null text and text without a letter are ``und`` with score 0; null labels are not
learned from; a null id counts as the empty string in the split; ties go to the alphabetically
first language; with nothing to learn from every document is ``und``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import release, text_rows

PROFILE = 300
ROWS_PER_LANGUAGE = 4000
UNKNOWN = "und"
#: A document with less in common with every language is rejected by ``keep_known``.
LEAST_SCORE = 0.1

_BITS = 21  # of a code point
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether a code point is a letter (built once per worker)."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTER[0]


def ngrams(text: str) -> np.ndarray:
    """Codes of all n-grams of one to three characters that lie inside a word or touch its ends."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = np.where(_letters()[c], c, 1).astype(np.int64)  # 1 marks what is no letter
    if not (c > 1).any():
        return c[:0]
    c = np.concatenate(([1], c, [1]))
    c = c[np.r_[True, (c[1:] != 1) | (c[:-1] != 1)]]  # one mark between words
    two = (c[:-1] << _BITS) | c[1:]
    three = (two[:-1] << _BITS) | c[2:]
    return np.concatenate((c[c > 1], two, three[c[1:-1] > 1]))


def profile(codes: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent codes in order (ties: smaller code first)."""
    found, n = np.unique(codes, return_counts=True)
    if len(found) > size:  # only those that can be among the first
        least = np.partition(n, len(n) - size)[len(n) - size]
        keep = n >= least
        found, n = found[keep], n[keep]
    return found[np.lexsort((found, -n))][:size]


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit_profiles(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, size: int = PROFILE,
                 id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Profiles by language from the rows that are not held out (a table of languages x ``size``)."""
    rows = docs.where(F.col(lang_col).isNotNull() & ~held_out(id_col))
    counts = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("rows"))
    share = F.least(F.lit(1.0), F.lit(float(rows_per_language)) / F.col("rows"))
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = (rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), draw.alias("draw"))
              .join(F.broadcast(counts), "lang")  # a row per language, as the profiles
              .where(F.col("draw") < share).select("lang", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: dict[str, list[str]] = {}
            for lang, text in text_rows(batch, "lang", "text"):
                texts.setdefault(lang, []).append(text or "")
            for lang, some in texts.items():
                found, n = np.unique(ngrams("\n".join(some)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found),
                                                  pa.array(n.astype(np.int64))], names=["lang", "code", "n"])

    total = (sample.mapInArrow(count, "lang string, code long, n long")
             .groupBy("lang", "code").agg(F.sum("n").alias("n")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    out: dict[str, list] = {}
    for r in total.withColumn("rank", rank).where(F.col("rank") <= size).orderBy("lang", "rank").collect():
        out.setdefault(r["lang"], []).append(r["code"])
    return {k: np.array(v, dtype=np.int64) for k, v in sorted(out.items())}


def distances(found: np.ndarray, sorted_profiles: list[tuple[np.ndarray, np.ndarray]], size: int) -> list[int]:
    """Out-of-place distance of a document's profile to each language's (codes sorted, with their ranks)."""
    here = np.arange(len(found))
    out = []
    for codes, ranks in sorted_profiles:
        at = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
        out.append(int(np.where(codes[at] == found, np.abs(ranks[at] - here), size).sum()))
    return out


def _judge(text: str | None, names: list[str], table: list[tuple[np.ndarray, np.ndarray]], size: int) -> tuple[str, float]:
    found = profile(ngrams(text or ""), size)
    if not len(found) or not names:
        return UNKNOWN, 0.0
    far = distances(found, table, size)
    best = min(range(len(far)), key=far.__getitem__)
    return names[best], 1.0 - far[best] / (size * len(found))


def _sorted(profiles: dict[str, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(codes[order], order) for codes in profiles.values() for order in [np.argsort(codes)]]


def keep_known(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE, text_col: str = "text",
               least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is found with at least the score ``least``; all columns stay."""
    names, table = list(profiles), _sorted(profiles)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_judge(t, names, table, size) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))
        release()

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names may clash
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE, text_col: str = "text",
            keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred and score (1: in place everywhere, 0: nothing in common)."""
    names = list(profiles)
    table = _sorted(profiles)
    kept = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_judge(t, names, table, size) for t in batch.column("text").to_pylist()]
            lang, score = [x[0] for x in found], [x[1] for x in found]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                names=[*kept, "lang_pred", "score"])

    kinds = ", ".join(f"{k} {docs.schema[c].dataType.simpleString()}" for k, c in zip(kept, keep))
    rows = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, kept)], F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, kept)], "lang_pred", "score")


def language_digest(docs: DataFrame) -> DataFrame:
    """The registered query: doc_id, held_out, lang_pred, score."""
    found = predict(docs, fit_profiles(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
