"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases level by level. Runs of one symbol are joined; deterministic coin
tossing then gives every symbol a label of three values from a few symbols to its left (lowest bit
in which it differs from its neighbour, repeated, then reduced); phrases begin at local maxima of the
labels and are named by a hash of what they hold. The next level parses the names. Cuts depend
only on nearby symbols, so equal substrings get equal phrase names inside, wherever they stand.

A fingerprint is the set of the smallest ``SKETCH`` name hashes of levels 2 to 4 (phrases of about 6,
15 and 40 characters); the likeness of two fingerprints estimates the Jaccard coefficient of the
phrase sets, exactly while they are small. A text too short for level 2 is named as a whole.

Edge cases: null is the empty text, whose fingerprint is empty (likeness 1 to another empty one, 0 to
anything else); equal texts have equal fingerprints; equal ids are ordered by their text; null
ids come last; a table of one row is its own next document; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import text_rows

SKETCH = 64
LEVELS = (2, 3, 4)
#: Ranges of ids a table is dealt into: this many per shuffle partition, and at most.
RANGES_PER_PARTITION, MOST_RANGES = 8, 4096
#: Characters parsed at once (a longer text is parsed alone).
SLICE = 1 << 17

_U = np.uint64
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_POS = np.array([(2 * i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF for i in range(1, 65)], dtype=_U)
_TABLES: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def _tables() -> dict[str, np.ndarray]:
    if not _TABLES:
        n = np.arange(1 << 16)
        ctz = np.zeros(1 << 16, dtype=np.uint8)
        for b in range(15, -1, -1):
            ctz[(n >> b) & 1 == 1] = b
        _TABLES["ctz"] = ctz
        # smallest of 0, 1, 2 that neither neighbour has (7: no neighbour)
        _TABLES["free"] = np.array([[min({0, 1, 2} - {a, b}) for b in range(8)] for a in range(8)], dtype=np.uint8).ravel()
    return _TABLES


def _before(x: np.ndarray, first: np.ndarray, fill) -> np.ndarray:
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[first] = fill
    return out


def _after(x: np.ndarray, last: np.ndarray, fill) -> np.ndarray:
    out = np.empty_like(x)
    out[:-1] = x[1:]
    out[last] = fill
    return out


def _toss(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels 0 to 5, different for neighbours, from ``names`` that differ between neighbours."""
    ctz = _tables()["ctz"]
    differ = names ^ _before(names, first, 0)
    differ[first] = 1
    low = differ & _U(0xFFFF)
    bit = ctz[low.astype(np.int64)]
    rest = np.flatnonzero(low == 0)  # equal in the low bits: rare
    for shift in (16, 32, 48):
        if not len(rest):
            break
        part = (differ[rest] >> _U(shift)) & _U(0xFFFF)
        hit = part != 0
        bit[rest[hit]] = ctz[part[hit].astype(np.int64)] + shift
        rest = rest[~hit]
    label = (bit << 1) | ((names >> bit.astype(_U)) & _U(1)).astype(np.uint8)
    for _ in range(3):
        d = label ^ _before(label, first, 0)
        d[first] = 1
        bit = ctz[d]
        label = (bit << 1) | ((label >> bit) & 1)
    return label


def parse_level(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases and where each text's phrases start (``starts`` has one more entry than texts)."""
    if not len(names):
        return names, starts
    sizes = np.diff(starts)
    first = np.zeros(len(names), dtype=bool)
    first[starts[:-1][sizes > 0]] = True
    head = first.copy()
    head[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(head)
    run = np.diff(np.append(at, len(names)))
    names = names[at]
    long = run > 1
    names[long] = _mix(names[long] + _POS[0] * run[long].astype(_U))
    # joined runs never equal their neighbours by more than a hash collision, which only joins phrases
    first = first[at]
    starts = np.searchsorted(at, starts)
    first_at = np.flatnonzero(first)
    last_at = np.append(first_at[1:], len(names)) - 1
    label = _toss(names, first_at)
    free = _tables()["free"]
    for value in (5, 4, 3):
        i = np.flatnonzero(label == value)
        if len(i):
            padded_left = np.where(first[i], 7, label[i - 1])
            right = np.where(np.isin(i, last_at, assume_unique=True), 7, label[np.minimum(i + 1, len(label) - 1)])
            label[i] = free[padded_left.astype(np.int64) * 8 + right]
    cut = (label > _before(label, first_at, 0)) & (label > _after(label, last_at, 0))
    cut |= first
    begin = np.flatnonzero(cut)
    place = np.arange(len(names)) - np.repeat(begin, np.diff(np.append(begin, len(names))))
    out = _mix(np.add.reduceat(names * _POS[np.minimum(place, 63)], begin))
    return out, np.searchsorted(begin, starts)


def phrase_sets(texts: list[str], sketch: int = SKETCH) -> list[np.ndarray]:
    """Per text: its fingerprint as sorted 32-bit values."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    names = _mix(chars.astype(_U) + _U(1))
    found: list[list[np.ndarray]] = [[] for _ in texts]
    whole: list[np.ndarray | None] = [None] * len(texts)
    for level in range(1, max(LEVELS) + 1):
        names, starts = parse_level(names, starts)
        tops = ((names + _U(level)) >> _U(32)).astype(np.uint32)
        if level in LEVELS:
            for i, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
                if b - a > 1 or (b > a and whole[i] is None):
                    found[i].append(tops[a:b])
                    whole[i] = tops[a:b]
    return [np.unique(np.concatenate(x))[:sketch] if x else np.zeros(0, dtype=np.uint32) for x in found]


def likeness(a: np.ndarray, b: np.ndarray, sketch: int = SKETCH) -> float:
    """Estimated Jaccard coefficient of the sets behind two fingerprints."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:sketch]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum() / len(union))


def shown(a: np.ndarray) -> str:
    return a.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(range, extra, doc_id, text), sorted by descending id inside a range, one range in one partition.

    Each range ends with a copy (``extra`` 1) of the first row of the next one, so a task sees every
    row's successor; the last range gets the first row of all.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    wide = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = min(MOST_RANGES, RANGES_PER_PARTITION * wide)
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100_000)).first()[0]
    limits = F.array(*[F.lit(c) for c in sorted(set(cuts or []))]).cast("array<long>")
    where = F.when(F.col("doc_id").isNull(), F.lit(n + 1)).otherwise(F.size(F.filter(limits, lambda c: F.col("doc_id") < c)))
    rows = rows.withColumn("range", where).withColumn("tie", F.xxhash64("text"))
    top = rows.groupBy("range").agg(F.max(F.struct("doc_id", F.bitwise_not("tie").alias("t"))).alias("top"))
    tops = sorted(top.collect(), key=lambda r: r["range"])  # at most one row per range
    heads = [(r["range"], r["top"]["doc_id"], ~r["top"]["t"], tops[i - 1]["range"]) for i, r in enumerate(tops)]
    table = spark.createDataFrame(heads, "range int, head long, head_tie long, earlier int")
    marked = rows.join(F.broadcast(table), "range")
    is_head = F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("tie") == F.col("head_tie"))
    here = F.struct("range", F.lit(0).alias("extra"))
    there = F.struct(F.col("earlier").alias("range"), F.lit(1).alias("extra"))
    dealt = marked.withColumn("to", F.explode(F.when(is_head, F.array(here, there)).otherwise(F.array(here))))
    return (dealt.select("to.range", "to.extra", "doc_id", "tie", "text").repartition("range")
            .sortWithinPartitions("range", "extra", F.desc_nulls_last("doc_id"), "tie"))


def fingerprint_pairs(ordered: DataFrame, sketch: int = SKETCH) -> DataFrame:
    """Per row of ``ordered``: fingerprints of its text and its edited text, and how alike they are."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(doc_id, text, next text)"""
        held = None
        for batch in batches:
            for where, extra, doc, text in text_rows(batch, "range", "extra", "doc_id", "text"):
                if held is not None and held[0] == where:
                    yield held[1], held[2], text
                held = None if extra else (where, doc, text)

    def slices(batches) -> Iterator[list[tuple]]:
        some, size = [], 0
        for row in rows(batches):
            some.append(row)
            size += 2 * len(row[1])
            if size > SLICE:
                yield some
                some, size = [], 0
        if some:
            yield some

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            changed = [edited(t, following) for _, t, following in some]
            texts = [t for _, t, _ in some]
            # rows follow each other, so the next row's fingerprint is at hand but for breaks between ranges
            extra = {i: some[i][2] for i in range(len(some)) if i + 1 == len(some) or some[i + 1][1] != some[i][2]}
            sets = phrase_sets(texts + changed + list(extra.values()), sketch)
            k = len(some)
            own, other = sets[:k], sets[k:2 * k]
            follow = dict(zip(extra, sets[2 * k:]))
            yield pa.RecordBatch.from_arrays([
                pa.array([d for d, _, _ in some], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed]),
                pa.array([shown(x) for x in own]), pa.array([shown(x) for x in other]),
                pa.array([likeness(a, b, sketch) for a, b in zip(own, other)], pa.float64()),
                pa.array([likeness(own[i], follow[i] if i in follow else own[i + 1], sketch) for i in range(k)], pa.float64()),
            ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return ordered.select("range", "extra", "doc_id", "text").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")


def fingerprint(docs: DataFrame, sketch: int = SKETCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints alone: doc_id, n_chars, fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            done, size, some = [], 0, []
            for t in texts:
                some.append(t)
                size += len(t)
                if size > SLICE:
                    done += phrase_sets(some, sketch)
                    some, size = [], 0
            done += phrase_sets(some, sketch) if some else []
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(t) for t in texts], pa.int64()),
                                              pa.array([shown(x) for x in done], pa.string())],
                                             names=["doc_id", "n_chars", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_chars long, fingerprint string")


def fingerprint_digest(docs: DataFrame) -> DataFrame:
    """The registered query."""
    return fingerprint_pairs(in_order(docs))
