"""Benchmark decontamination by latent semantic retrieval.

Documents are read as overlapping passages of words. Terms are the words of the benchmark, weighted
by inverse document frequency over the whole corpus; a passage is a TF-IDF vector over them. A
randomised SVD of the passage matrix (range finder with one power step, distributed: every task
multiplies its sparse rows, only matrices of terms x rank are summed) gives the latent space. Each
passage is compared there with every benchmark item by cosine; the candidates' words are aligned
with the item by longest common subsequence, and items answered in the passage are accepted as
paraphrases at a lower overlap.

Items of more than ``LONG`` words are searched by their passages as well (query rows of their own,
``WINDOW`` words each), for a passage is only a small part of them; alignment is always with the
whole item, over the item's length on both sides of the passage.

Passages that cannot reach the cosine threshold with any query row are dropped before the SVD by an upper
bound on the plain TF-IDF cosine (each term's largest share of a query row). Candidates must therefore
share words with the item: the latent space is fitted on the passages that pass and ranks only those, and a
passage near an item by related words alone is not found. The benchmark is a stated query set: it is handled in
blocks of ``BLOCK`` query rows (one item at least), so term tables and latent vectors stay bounded
however large it grows; what is kept of the corpus grows with the corpus. Scripts written without
spaces are split into characters.

Edge cases: null texts have no passages; items with fewer than ``LEAST_WORDS`` words prove nothing and
are not searched; repeated items are separate items; repeated rows and null ids are kept; an empty
benchmark or table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import keyed, materialize, text_rows, unkeyed

WINDOW, STRIDE = 32, 16
#: Longer items are also cut into passages; up to here a passage holds half of the item.
LONG = 2 * WINDOW
LEAST_WORDS = 6
BLOCK = 256
RANK = 288
COSINE = 0.4
#: Shares of an item's words that must follow in the same order: alone, and with the answer.
COPY, PARAPHRASE = 0.6, 0.5
#: Rows per piece of the summed matrices.
PIECE = 64

#: Scripts without spaces: Thai to Myanmar, Khmer, kana, Han.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[^\W{_UNSPACED}]+|(?=\w)[{_UNSPACED}]")
_SENTENCE = re.compile(r"[.!?:\n。！？：]\s*")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def answer_of(text: str) -> list[str]:
    """Words of the last sentence: where an item states its answer."""
    parts = [words_of(p) for p in _SENTENCE.split(text)]
    return next((p for p in reversed(parts) if p), [])


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence (bit-parallel over ``a``)."""
    masks: dict[str, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        m = masks.get(w)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def _contains(words: list[str], part: list[str]) -> bool:
    n = len(part)
    return any(words[i:i + n] == part for i, w in enumerate(words[:len(words) - n + 1]) if w == part[0])


def query_rows(words: list[str]) -> list[list[str]]:
    """The item, and its passages if it is a long one (the last ends with the item)."""
    if len(words) <= LONG:
        return [words]
    starts = [*range(0, len(words) - WINDOW, WINDOW), len(words) - WINDOW]
    return [words, *(words[a:a + WINDOW] for a in starts)]


class Items:
    """One block of the benchmark: words, answers, query rows (with the first of each item), terms and weights."""

    def __init__(self, rows: list[tuple]):
        self.ids = [i for i, _ in rows]
        self.words = [words_of(t) for _, t in rows]
        self.answers = [answer_of(t) for _, t in rows]
        rows_of = [query_rows(x) for x in self.words]
        self.rows = [r for x in rows_of for r in x]
        self.first = np.cumsum([0, *map(len, rows_of)])[:-1]
        self.terms = {w: k for k, w in enumerate(sorted({w for x in self.words for w in x}))}
        self.weights = np.zeros(len(self.terms))

    def weigh(self, frequency: dict[str, int], documents: int) -> None:
        for w, k in self.terms.items():
            # squared, so that words of every text weigh next to nothing
            self.weights[k] = np.log((1 + documents) / (1 + frequency.get(w, 0))) ** 2 + 1e-6

    def vectors(self) -> np.ndarray:
        out = np.zeros((len(self.rows), len(self.terms)))
        for i, ws in enumerate(self.rows):
            for w in ws:
                out[i, self.terms[w]] += 1
        out *= self.weights
        return out / np.linalg.norm(out, axis=1, keepdims=True)


def document_frequency(docs: DataFrame, vocabulary: frozenset[str], text_col: str = "text") -> tuple[dict[str, int], int]:
    """In how many documents each benchmark word occurs, over all documents (a row per word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        n = 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                n += 1
                for w in vocabulary.intersection(words_of(text)):
                    seen[w] = seen.get(w, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([*seen, None], pa.string()), pa.array([*seen.values(), n], pa.int64())],
                                         names=["word", "n"])

    rows = (docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).collect())
    found = {r["word"]: r["n"] for r in rows}
    return found, found.pop(None, 0)


def reach_of(item: list[str]) -> int:
    """Words on each side of a passage among which the item is sought."""
    return len(item) if len(item) > LONG else LONG // 2


def passages(docs: DataFrame, items: Items, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages that may reach the threshold: doc_id, txt, at (first word), terms, counts, and the words around."""
    reach = max(reach_of(x) for x in items.words)
    terms, weights = items.terms, np.append(items.weights, 0.0)
    share = np.append(items.vectors().max(axis=0), 0.0)  # a term's largest share of an item
    missing = len(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [[] for _ in range(6)], 0

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [pa.array(out[0], batch.schema.field("doc_id").type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()),
                     pa.array(out[3], pa.list_(pa.int32())), pa.array(out[4], pa.list_(pa.int32())), pa.array(out[5], pa.string())],
                    names=["doc_id", "txt", "at", "terms", "counts", "around"])

            for doc, txt, text in text_rows(batch, "doc_id", "txt", "text"):
                ws = words_of(text)
                if not ws:
                    continue
                t = np.array([terms.get(w, missing) for w in ws])
                x = weights[t]
                starts = np.arange(0, max(1, len(ws) - WINDOW + STRIDE), STRIDE)
                ends = np.minimum(starts + WINDOW, len(ws))
                dot, square = (np.concatenate(([0.0], np.cumsum(v))) for v in (x * share[t], x * x))
                # repeated terms only make the true norm larger, so this is an upper bound
                norm = np.sqrt(np.maximum(square[ends] - square[starts], 1e-18))
                for k in np.flatnonzero(dot[ends] - dot[starts] >= (COSINE - 1e-6) * norm):
                    a, b = int(starts[k]), int(ends[k])
                    found, n = np.unique(t[a:b], return_counts=True)
                    keep = found != missing
                    if not keep.any():
                        continue
                    for c, v in zip(out, (doc, txt, a, found[keep], n[keep], " ".join(ws[max(0, a - reach):b + reach]))):
                        c.append(v)
                    size += len(out[5][-1])
                    if size > 4 << 20:  # long items have long surroundings
                        yield made()
                        out, size = [[] for _ in range(6)], 0
            yield made()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("txt"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, txt long, at int, terms array<int>, counts array<int>, around string")


def _dense(batch: pa.RecordBatch, weights: np.ndarray) -> Iterator[np.ndarray]:
    """Normalised TF-IDF rows of a batch, some hundred at a time."""
    terms, counts = batch.column("terms"), batch.column("counts")
    for a in range(0, len(terms), 512):
        t, c = terms[a:a + 512], counts[a:a + 512]
        lengths = np.diff(t.offsets.to_numpy())
        out = np.zeros((len(lengths), len(weights)))
        at = np.repeat(np.arange(len(lengths)), lengths)
        ids = t.flatten().to_numpy()
        out[at, ids] = c.flatten().to_numpy() * weights[ids]
        out /= np.linalg.norm(out, axis=1, keepdims=True)
        yield out


def _summed(rows: DataFrame, weights: np.ndarray, left: np.ndarray | None, right: np.ndarray) -> np.ndarray:
    """Sum over all passages x of outer(x left or x, x right): terms x rank, or rank x rank.

    Tasks emit one partial matrix each, in pieces of ``PIECE`` rows that are summed by piece.
    """
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast((weights, left, right))  # terms x rank numbers, bounded by the block
    height = len(weights) if left is None else left.shape[1]
    width = right.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, lt, rt = shared.value
        total = np.zeros((height, width))
        some = False
        for batch in batches:
            for x in _dense(batch, w):
                total += (x if lt is None else x @ lt).T @ (x @ rt)
                some = True
        if some:
            cuts = range(0, height, PIECE)
            yield pa.RecordBatch.from_arrays([pa.array(list(cuts), pa.int32()),
                                              pa.array([total[a:a + PIECE].tobytes() for a in cuts], pa.binary())],
                                             names=["piece", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, data in text_rows(batch, "piece", "data"):
                part = np.frombuffer(data)
                sums[piece] = sums[piece] + part if piece in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())],
                                         names=["piece", "data"])

    made = rows.select("terms", "counts").mapInArrow(run, "piece int, data binary")
    pieces = made.repartition("piece").mapInArrow(add, "piece int, data binary").collect()
    out = np.zeros((height, width))
    for r in pieces:
        part = np.frombuffer(bytes(r["data"])).reshape(-1, width)
        out[r["piece"]:r["piece"] + len(part)] += part
    return out


def latent_space(rows: DataFrame, items: Items, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """Right singular vectors (terms x rank) of the passages, with the items as rows of equal total weight."""
    q = items.vectors()
    n_terms = len(items.terms)
    rank = min(rank, n_terms)
    n = rows.count()
    load = max(1.0, n / max(1, len(q)))
    start = np.random.default_rng(seed).standard_normal((n_terms, rank))
    y = load * (q.T @ (q @ start))
    if n:
        y += _summed(rows, items.weights, None, start)
    basis, _ = np.linalg.qr(y)
    gram = load * ((q @ basis).T @ (q @ basis))
    if n:
        gram += _summed(rows, items.weights, basis, basis)
    values, vectors = np.linalg.eigh(gram)
    return basis @ vectors[:, np.argsort(-values)]


def matches(rows: DataFrame, items: Items, space: np.ndarray) -> DataFrame:
    """doc_id, txt, item (place in the block), cosine, overlap, answered: verified candidates."""
    latent = items.vectors() @ space
    reach = max(reach_of(x) for x in items.words)
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast((items.weights, space, latent, items.first, items.words, items.answers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, v, q, first, item_words, answers = shared.value
        for batch in batches:
            around, starts = batch.column("around"), batch.column("at")
            out: list[list] = [[], [], [], []]
            places = []
            at = 0
            for x in _dense(batch, w):
                near = np.maximum.reduceat((x @ v) @ q.T, first, axis=1)  # the nearest query row of each item
                for i, j in zip(*np.nonzero(near >= COSINE)):
                    words, item = around[at + int(i)].as_py().split(" "), item_words[j]
                    lead, own = min(starts[at + int(i)].as_py(), reach), reach_of(item)
                    words = words[max(0, lead - own):lead + WINDOW + own]
                    overlap = lcs(item, words) / len(item)
                    if overlap < PARAPHRASE:
                        continue
                    answered = bool(answers[j]) and _contains(words, answers[j])
                    if overlap >= COPY or answered:
                        places.append(at + int(i))
                        for c, value in zip(out, (int(j), float(near[i, j]), overlap, answered)):
                            c.append(value)
                at += len(x)
            take = pa.array(places, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("txt").take(take), pa.array(out[0], pa.int32()),
                 pa.array(out[1], pa.float64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.bool_())],
                names=["doc_id", "txt", "item", "cosine", "overlap", "answered"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "txt", "at", "terms", "counts", "around").mapInArrow(
        run, f"doc_id {kind}, txt long, item int, cosine double, overlap double, answered boolean")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, txt, item_id, cosine, overlap, answered."""
    spark = docs.sparkSession
    numbered = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    # the stated query set, a block at a time
    rows = (r for r in numbered.where("text IS NOT NULL").toLocalIterator() if len(words_of(r["text"])) >= LEAST_WORDS)
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    found = None
    block: list[tuple] = []

    def search() -> DataFrame:
        items = Items(block)
        items.weigh(*document_frequency(docs, frozenset(items.terms), text_col))
        kept = materialize(passages(docs, items, id_col, text_col), "leak-passages")
        names = spark.createDataFrame(list(enumerate(items.ids)), f"item int, item_id {item_kind}")
        hits = matches(kept, items, latent_space(kept, items, max(RANK, len(items.rows) + 32))).join(F.broadcast(names), "item")  # at most a block
        return materialize(hits.groupBy("doc_id", "txt", "item_id").agg(
            F.max("cosine").alias("cosine"), F.max("overlap").alias("overlap"), F.max("answered").alias("answered")), "leaks")

    size = 0
    for r in rows:
        more = len(query_rows(words_of(r["text"])))
        if block and size + more > BLOCK:
            part = search()
            found = part if found is None else found.unionByName(part)
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += more
    if block:
        part = search()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"doc_id {kind}, txt long, item_id {item_kind}, cosine double, overlap double, answered boolean")
    return found


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    found = leaks(docs, benchmark, id_col, text_col)
    found = materialize(found.select(F.xxhash64("doc_id").alias("i"), F.col("txt").alias("t")).distinct(), "leak-rows")
    return unkeyed(keyed(docs, id_col, text_col).join(found, ["i", "t"], "left_anti"), docs)


def leaks_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The registered query: doc_id, item_id, cosine, overlap, answered."""
    return leaks(docs, benchmark).drop("txt").select(
        "doc_id", "item_id", F.round("cosine", 6).alias("cosine"), F.round("overlap", 6).alias("overlap"), "answered")
