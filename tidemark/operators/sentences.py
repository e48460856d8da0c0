"""NWS-14: the sentences that say most of a page, by their place in the graph of its sentences.

Two sentences are alike by the words they share, each weighted by how few of the page's sentences have it
(cosine of the weighted word sets). A sentence's rank is the principal eigenvector of the likeness matrix,
by a fixed number of power steps. With A the matrix of sentences by words the likeness is A A^T, so a step is
two products with A: pairs of sentences are never formed, a step takes time in proportion to the words.

A page is one row (at most ``PROVIDER_PAGE_SIZE`` articles), so pages are ranked side by side without a shuffle.
Sentences end at . ! or ? before white space. Sentences without a word in another sentence rank last, by
their place; a sentence that stands in several articles is taken once, at its first place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.news import (NOTE_INPUT_TEMPLATE, PAGE_KEYS, REASON_EMPTY_SUMMARY, REASON_EMPTY_TEXT, REASON_PROMPT_ECHO, STOPWORDS,
                                     low_quality_summary, normalize_whitespace)

STEPS = 30
SUMMARY_SENTENCES = 2

_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
_WORD = re.compile("[a-z]{3,}")
_STOP = frozenset(STOPWORDS)
_BODY = NOTE_INPUT_TEMPLATE.split("{content}")[0].rsplit("\n", 1)[1]


def sentences_of(text: str) -> list[str]:
    return [" ".join(s.split()) for s in _SENTENCE_END.split(text.strip()) if s.strip()]


def words_of(sentence: str) -> set[str]:
    return set(_WORD.findall(sentence.lower())) - _STOP


def ranks(words: list[set[str]], steps: int = STEPS) -> list[float]:
    """Centrality of each sentence, largest 1."""
    import numpy as np
    count: dict[str, int] = {}
    for ws in words:
        for w in ws:
            count[w] = count.get(w, 0) + 1
    # a word of one sentence links nothing, but makes the sentence longer
    place = {w: i for i, w in enumerate(sorted(count))}
    idf = np.array([np.log(1 + len(words) / count[w]) for w in place])
    rows = np.repeat(np.arange(len(words)), [len(ws) for ws in words])
    cols = np.array([place[w] for ws in words for w in sorted(ws)], dtype=np.int64)
    a = idf[cols] if len(cols) else np.zeros(0)
    norm = np.sqrt(np.bincount(rows, a * a, len(words)))
    a = a / norm[rows]
    shared = np.array([count[w] > 1 for w in place])[cols] if len(cols) else np.zeros(0, dtype=bool)
    rows, cols, a = rows[shared], cols[shared], a[shared]
    x = np.ones(len(words))
    for _ in range(steps):
        y = np.bincount(cols, a * x[rows], len(place))
        x = np.bincount(rows, a * y[cols], len(words))
        top = x.max(initial=0.0)
        if top <= 0:
            break
        x = x / top
    return x.tolist()


def best_sentences(articles: list[str], n: int = SUMMARY_SENTENCES) -> list[str]:
    """The ``n`` most central sentences of a page's articles, in page order."""
    found = list(dict.fromkeys(s for text in articles for s in sentences_of(text)))
    score = ranks([words_of(s) for s in found])
    order = sorted(range(len(found)), key=lambda i: (-round(score[i], 9), i))[:n]
    return [found[i] for i in sorted(order)]


def ranked(inputs: DataFrame, n: int = SUMMARY_SENTENCES) -> DataFrame:
    """Summaries of ``summary_input`` rows by sentence rank: ``generated`` and ``reason`` beside PAGE_KEYS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [" ".join(best_sentences([x.partition(_BODY)[2] for x in (notes or [])], n)) for notes in batch.column("note_inputs").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (*PAGE_KEYS, "empty")), pa.array(texts, pa.string())],
                                             names=[*PAGE_KEYS, "empty", "text"])

    rows = inputs.select(*[F.col(k).cast("string").alias(k) for k in PAGE_KEYS], (F.size("note_inputs") == 0).alias("empty"), "note_inputs")
    made = rows.mapInArrow(run, ", ".join(f"{k} string" for k in PAGE_KEYS) + ", empty boolean, text string")
    reason = (F.when(F.col("empty"), F.lit(REASON_EMPTY_TEXT)).when(normalize_whitespace(F.col("text")) == "", F.lit(REASON_EMPTY_SUMMARY))
              .when(low_quality_summary(F.col("text"), F.col("ticker")), F.lit(REASON_PROMPT_ECHO)))
    return made.select(*PAGE_KEYS, F.when(reason.isNull(), F.col("text")).alias("generated"), reason.alias("reason"))
