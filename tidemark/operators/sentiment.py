"""NWS-13 with a lexicon learned from the articles, and with negation and degree.

``induce_lexicon`` spreads the valences of seed words over the words they stand with: in each of a fixed
number of rounds a word's valence becomes the sum of the known valences within ``WINDOW`` words of it, per
occurrence. A word enters the lexicon with at least ``LEAST_COUNT`` occurrences, ``SUPPORT`` of them near known
words, ``AGREE`` per cent of those on one side, and a valence of ``LEAST_VALENCE``; words that stand with
everything stay out, so chance does not spread from round to round. Tasks add up
integers per word of their texts and hand on one row per word; seeds keep their valences. What is sent to
the tasks is the lexicon alone, the ``MOST_WORDS`` strongest words of a round.

``scoped_score`` scores a text by the lexicon: a word within three words behind a negation counts three
quarters the other way, one right behind a degree word more or less. All sums are integers (thousandths).

Edge cases: null and empty texts score 0 and teach nothing; repeated rows count each; no seed in any text
leaves the seeds alone; an empty table gives the seeds.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.news import OWN_LEXICON, SENTIMENT_ALPHA

WINDOW, ROUNDS = 4, 3
LEAST_COUNT, SUPPORT, AGREE, LEAST_VALENCE = 5, 3, 70, 300
STRONGEST, MOST_WORDS = 3000, 20_000
ENTRIES = 300_000

NEGATIONS = frozenset("no not never none neither nor without hardly cannot".split())
NEGATION_REACH = 3
#: Quarters by which the next word counts.
DEGREES = {"very": 5, "extremely": 6, "highly": 5, "sharply": 5, "strongly": 5, "deeply": 5,
           "slightly": 2, "somewhat": 3, "partly": 3, "barely": 1, "little": 2}

_TOKEN = re.compile("[a-z]+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def near_sums(words: list[str], lexicon: dict[str, int], count: Counter, above: Counter, below: Counter, valence: Counter) -> None:
    """Add a text's words to the occurrences, those near known words of a positive and of a negative sum, and the sums."""
    count.update(words)
    known = [(i, lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    if not known:
        return
    near: dict[int, int] = {}
    for i, v in known:
        for j in range(max(0, i - WINDOW), min(len(words), i + WINDOW + 1)):
            if j != i:
                near[j] = near.get(j, 0) + v
    for j, v in near.items():
        above[words[j]] += v > 0
        below[words[j]] += v < 0
        valence[words[j]] += v


def spread(texts: DataFrame, lexicon: dict[str, int]) -> DataFrame:
    """(word, n, above, below, valence) over all texts. The lexicon goes with the function: at most MOST_WORDS and the seeds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Counter(), Counter(), Counter(), Counter()

        def out():
            names = list(sums[0])
            made = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([s[w] for w in names], pa.int64()) for s in sums)],
                                              names=["word", "n", "above", "below", "valence"])
            for s in sums:
                s.clear()
            return made

        for batch in batches:
            for text in batch.column("text").to_pylist():
                near_sums(tokens(text), lexicon, *sums)
                if len(sums[0]) > ENTRIES:
                    yield out()
        yield out()

    return texts.mapInArrow(run, "word string, n long, above long, below long, valence long").groupBy("word").agg(
        *[F.sum(c).alias(c) for c in ("n", "above", "below", "valence")])


def thousandths(seeds: dict[str, float]) -> dict[str, int]:
    return {w: round(v * 1000) for w, v in seeds.items()}


def induce_lexicon(articles: DataFrame, text_col: str = "text", seeds: dict[str, float] | None = None, rounds: int = ROUNDS) -> dict[str, int]:
    """word -> valence in thousandths, the seeds included."""
    known = thousandths(OWN_LEXICON if seeds is None else seeds)
    texts = articles.select(F.col(text_col).alias("text"))
    lexicon = dict(known)
    for _ in range(rounds):
        near = spread(texts, lexicon)
        value = F.greatest(F.lit(-STRONGEST), F.least(F.lit(STRONGEST), F.call_function("div", F.col("valence"), F.col("n"))))
        support, side = F.col("above") + F.col("below"), F.greatest("above", "below")
        found = near.where((F.col("n") >= LEAST_COUNT) & (support >= SUPPORT) & (side * 100 >= support * AGREE)).select("word", value.alias("v")) \
            .where((F.abs("v") >= LEAST_VALENCE) & ~F.col("word").isin(*known, *NEGATIONS, *DEGREES)) \
            .orderBy(F.abs("v").desc(), "word").limit(MOST_WORDS).collect()
        lexicon = known | {r["word"]: r["v"] for r in found}
    return lexicon


def text_valence(words: list[str], lexicon: dict[str, int]) -> int:
    """Sum of a text's valences (thousandths): a fold over its words with the scopes that are open."""
    total, negated, quarters = 0, 0, 4
    for w in words:
        v = lexicon.get(w)
        if v is not None:
            v = v * quarters // 4
            total += -(v * 3) // 4 if negated else v
        quarters = DEGREES.get(w, 4)
        negated = NEGATION_REACH if w in NEGATIONS else max(0, negated - 1)
    return total


def scoped_score(articles: DataFrame, lexicon: dict[str, int], id_col: str = "article_id", text_col: str = "text") -> DataFrame:
    """(id, valence, score): score = s / sqrt(s² + 15) of the summed valence s, in [-1, 1]."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_valence(tokens(t), lexicon) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.int64())], names=["id", "valence"])

    kind = articles.schema[id_col].dataType.simpleString()
    rows = articles.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, valence long")
    s = F.col("valence") / 1000
    return rows.select(F.col("id").alias(id_col), "valence", F.round(s / F.sqrt(s * s + F.lit(float(SENTIMENT_ALPHA))), 4).alias("score"))
