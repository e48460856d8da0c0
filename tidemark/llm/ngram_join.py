"""Exact Jaccard self-join on word shingles by universe partition and the pigeonhole principle.

Two sets of a size band that reach the threshold differ in at most H shingles. Hashing splits the
shingle universe into parts; with ``n1`` parts at least one (more with slack) holds at most ``k``
of the differences, ``n1 * (k + 1) > H``. Each part is split into ``n2`` segments and every subset
of ``n2 - k`` segments is indexed, or, for small sets, the part and its one-deletion neighbourhood.
Which form a band uses is decided by cost: signatures written, plus the false candidates expected
from the number of sets in the band and from how likely a signature lies wholly inside a passage
shared with unrelated texts.

Shingles that many texts share would make such signatures alike; they are left out of the index, which
is exact too, since the differences among the other shingles are still at most H. They are found by
counts over every text, kept per cell of the hash space: a cell with many more shingles than the mean
is left out whole. A signature without shingles says nothing and is not indexed. A set with more such empty parts than
the slack is *deficient* there; a pair can be missed only if both are, so deficient sets are
indexed again under other hash seeds and, deficient under all of them, by the shingles of a prefix
(rarer ones first, then in hash order), which misses nothing.

Sets that share a signature are not paired with each other but with a hub: first inside a map task
(one row per signature leaves it, however many copies the task holds), then per signature. Linked
hubs and members form components; a signature whose members then lie in different components has
pairs that no hub saw, and for the sets of those signatures a rarest-first prefix filter with
position and size bounds produces every remaining candidate across components. All candidates are
verified on whole sets.

Sets and shingles are identified by 64-bit hashes. Edge cases: null, empty and white-space texts
have the empty set and link with nothing; texts of one to three words are one shingle; equal sets
are one class; null ids take part (a component's id is its smallest non-null id); an empty table
gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import keyed, materialize, release, text_rows, unkeyed
from tidemark.llm.components import components

WORDS = 4
PERCENT = 85
SEEDS = 3
#: Length scale (shingles) of passages that unrelated documents share, and the share of a band they may reach.
PASSAGE = 60
RELATED = 0.001
#: Index entries held by a map task before it writes them, and expected per bucket.
FLUSH = 250_000
BUCKET_ENTRIES = 500_000

#: Rounds of hubs before the remaining pairs are written.
HUB_TURNS = 2
#: Cells of the hash space (by its high bits) in which shingles are counted, cells in a block of counts, and the share
#: of the documents (and least number of them) by which a common cell is above the mean.
CELL_BITS, BLOCK_BITS = 20, 16
COMMON, LEAST_COMMON = 0.001, 4

_U = np.uint64
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_A = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


#: A number per byte (none for white space), and the longest piece of a text that is hashed at once.
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BYTE = np.where(_SPACE, _U(0), mix(np.arange(1, 257, dtype=_U) * _A))
PIECE = 1 << 20


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, words: int = WORDS):
        self.words, self.places = words, np.zeros(0, dtype=_U)

    def word_hashes(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)  # bytes: only A-Z
        out, at = [], 0
        while at < len(raw):
            end = at + PIECE
            while end < len(raw) and not _SPACE[raw[end]]:
                end += 1
            out.append(self.piece_hashes(raw[at:end]))
            at = end
        return out[0] if len(out) == 1 else np.concatenate([*out, np.zeros(0, dtype=_U)])

    def piece_hashes(self, raw: np.ndarray) -> np.ndarray:
        """Per word the sum of its bytes' numbers times an odd number of their place in the word."""
        space = _SPACE[raw]
        first = ~space
        first[1:] &= space[:-1]
        starts = np.flatnonzero(first)
        if not len(starts):
            return np.zeros(0, dtype=_U)
        raw = raw[starts[0]:]
        starts = starts - starts[0]
        place = np.arange(len(raw)) - np.repeat(starts, np.diff(starts, append=len(raw)))
        if (longest := int(place.max())) >= len(self.places):
            self.places = mix((np.arange(2 * longest + 64, dtype=_U) + _U(1)) * _M2) | _U(1)
        return mix(np.add.reduceat(_BYTE[raw] * self.places[place], starts))

    def __call__(self, text: str | None) -> np.ndarray:
        w = self.word_hashes(text or "")
        k = self.words
        if len(w) == 0:
            return np.zeros(0, dtype=_U)
        if len(w) < k:
            h = np.array([len(w)], dtype=_U)
            for j in range(len(w)):
                h = mix(h * _A + w[j:j + 1])
            return h
        h = w[: len(w) - k + 1].copy()
        for j in range(1, k):
            h = mix(h * _A + w[j: len(w) - k + 1 + j] + _U(j))
        h.sort()
        return h[np.r_[True, h[1:] != h[:-1]]]


def cell_counts(tokens: np.ndarray) -> bytes:
    """How many tokens fall in each cell of the hash space (two to four per cell on average)."""
    cells = 1 << max(0, int(len(tokens)).bit_length() - 2)
    n = np.bincount((tokens & _U(cells - 1)).astype(np.int64), minlength=cells)
    wide = bool(n.max() > 255) if len(n) else False
    return bytes([wide]) + n.astype(np.uint32 if wide else np.uint8).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sets, from their cell counts."""
    x, y = (np.frombuffer(v[1:], dtype=np.uint32 if v[0] else np.uint8).astype(np.int64) for v in (a, b))
    cells = min(len(x), len(y))
    return int(np.abs(x.reshape(-1, cells).sum(0) - y.reshape(-1, cells).sum(0)).sum())


# --- bands and allocation -----------------------------------------------------------------------

def band_starts(largest: int, percent: int = PERCENT) -> list[int]:
    """Band limits such that a partner at the threshold lies in the same or the next band."""
    out = [1, 2]
    while out[-2] <= largest:
        out.append(max(out[-1] + 1, (out[-1] - 1) * 100 // percent + 1))
    return out


def max_difference(small: int, large: int, percent: int = PERCENT) -> int:
    return (small + large) * (100 - percent) // (100 + percent)


def allocate(starts: list[int], band: int, population: int, percent: int = PERCENT) -> tuple | None:
    """(n1, k, n2, slack, H) of a band's index with the least cost; n2 = 0: one-deletion neighbourhoods."""
    small = starts[band + 1] - 1
    large = min(starts[band + 2] - 1, small * 100 // percent)
    differ = max_difference(small, large, percent)
    if differ == 0:
        return None  # only equal sets reach the threshold
    size = starts[band]
    share = min(0.6, PASSAGE / size)
    best = None
    for k, n2 in ((0, 1), (1, 3), (1, 4), (2, 4), (2, 5), (1, 0)):
        slack = 0
        for _ in range(4):
            n1 = differ // (k + 1) + 1 + slack
            per = size / n1
            if n2 == 0:
                weak = math.exp(-per) * (1 + per)
            else:
                weak = math.exp(-per) if k == 0 else min(1.0, math.comb(n2, k) * (k / n2) ** per)
            slack = math.ceil(2 * weak * n1) if weak * n1 > 0.02 else 0
        n1 = differ // (k + 1) + 1 + slack
        per = size / n1
        written = size + n1 if n2 == 0 else n1 * math.comb(n2, k)
        told = max(per - 1, 0.5) if n2 == 0 else per * (n2 - k) / n2
        cost = written * (1 + 10 * RELATED * population * share ** told)
        if best is None or cost < best[0]:
            best = (cost, (n1, k, n2, slack, differ))
    return best[1]


@lru_cache(maxsize=None)
def _subsets(n2: int, take: int) -> np.ndarray:
    out = np.zeros((math.comb(n2, take), n2))
    for i, c in enumerate(combinations(range(n2), take)):
        out[i, list(c)] = 1
    return out


def _sums(values: np.ndarray, key: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts and exact sums of the high and low 32 bits per cell."""
    lo = np.bincount(key, weights=(values & _U(0xFFFFFFFF)).astype(np.float64), minlength=cells)
    hi = np.bincount(key, weights=(values >> _U(32)).astype(np.float64), minlength=cells)
    return np.bincount(key, minlength=cells), hi, lo


def _named(hi, lo, n, scheme: int, which: np.ndarray) -> np.ndarray:
    h = mix(hi.astype(_U) * _A + lo.astype(_U))
    h = mix(h + n.astype(_U) * _M1 + _U(scheme))
    return mix(h * _A + which.astype(_U))


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> _U(64 - CELL_BITS)).astype(np.int64)


def _is_common(tokens: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which ``tokens`` are left out: ``common`` says so of each cell, or lists the shingles in ascending order."""
    if not len(common):
        return np.zeros(len(tokens), dtype=bool)
    if common.dtype == bool:
        return common[_cell(tokens)]
    at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
    return common[at] == tokens


def signatures(tokens: np.ndarray, band: int, plan: tuple, percent: int = PERCENT,
               common: np.ndarray = np.zeros(0, dtype=_U)) -> list[np.ndarray]:
    """Index entries of a set under one band's index."""
    n1, k, n2, slack, _ = plan
    out = []
    whole, often = tokens, _is_common(tokens, common)
    tokens = whole[~often]
    for seed in range(SEEDS):
        scheme = band * 8 + seed
        h = mix(tokens + _U((scheme * 2 + 1) * int(_A) & 0xFFFFFFFFFFFFFFFF))
        part = (h % _U(n1)).astype(np.int64)
        if n2 == 0:
            n, hi, lo = _sums(h, part, n1)
            ids = np.arange(n1)
            full = n > 0
            out.append(_named(hi, lo, n, scheme, ids)[full])
            rest = n[part] > 1  # a part of one shingle has no neighbour with shingles
            p, x = part[rest], h[rest]
            out.append(_named(hi[p] - (x >> _U(32)).astype(np.float64), lo[p] - (x & _U(0xFFFFFFFF)).astype(np.float64),
                              n[p] - 1, scheme, p))
            weak = int((n <= 1).sum())
        else:
            seg = ((h >> _U(32)) % _U(n2)).astype(np.int64)
            n, hi, lo = _sums(h, part * n2 + seg, n1 * n2)
            if k == 0:
                sn, sh, sl = n, hi, lo
                which = np.arange(n1)
            else:
                take = _subsets(n2, n2 - k).T
                sn, sh, sl = ((x.reshape(n1, n2) @ take).ravel() for x in (n, hi, lo))
                which = np.arange(n1 * take.shape[1])
            full = sn > 0
            out.append(_named(sh, sl, sn, scheme, which)[full])
            weak = int((~full).reshape(n1, -1).any(axis=1).sum())
        if weak <= slack:
            return out
    size = len(whole)
    prefix = size - -(-percent * size // 100) + 1
    h = mix(whole + _A)
    h = h[np.lexsort((h, often))][:prefix]
    out.append(mix(h + _U((band * 8 + 7) * int(_M2) & 0xFFFFFFFFFFFFFFFF)))
    return out


# --- Spark side ---------------------------------------------------------------------------------

def shingle_sets(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, txt (hash of the text), node (hash of the set, null if empty), n, cells; one row per input row (``part`` 0).

    Under ``part`` 1 the counts of shingles per cell of the hash space, of every set of a task once: ``txt`` is the block
    of cells, ``n`` how many of them have shingles, ``cells`` their places and counts.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("txt"), F.col(text_col).alias("text"))

    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "txt", "node", "n", "cells", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        seen, counts, ids = set(), np.zeros(1 << CELL_BITS, dtype=np.int64), None
        for batch in batches:
            ids = batch.column("doc_id").type
            node, size, cells, new = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle(text)
                h = xxhash.xxh3_64_intdigest(s.tobytes()) >> 1 if len(s) else None
                size.append(len(s))
                cells.append(cell_counts(s) if len(s) else None)
                node.append(h)
                if len(s) and h not in seen:
                    seen.add(h)
                    new.append(_cell(s))
            if new:
                counts += np.bincount(np.concatenate(new), minlength=len(counts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("txt"), pa.array(node, pa.int64()),
                                              pa.array(size, pa.int64()), pa.array(cells, pa.binary()),
                                              pa.array(np.zeros(len(size), dtype=np.int32))], names=names)
        for block, of_block in enumerate(counts.reshape(-1, 1 << BLOCK_BITS)):
            at = np.flatnonzero(of_block)
            if len(at):
                packed = at.astype(np.uint16).tobytes() + of_block[at].astype(np.uint32 if of_block.max() > 0xFFFF else np.uint16).tobytes()
                yield pa.RecordBatch.from_arrays([pa.nulls(1, ids), pa.array([block], pa.int64()), pa.nulls(1, pa.int64()),
                                                  pa.array([len(at)], pa.int64()), pa.array([packed], pa.binary()),
                                                  pa.array([1], pa.int32())], names=names)

    return rows.mapInArrow(run, f"doc_id {kind}, txt long, node long, n long, cells binary, part int")


def _packed(low: np.ndarray, node: np.ndarray) -> bytes:
    """Entries of one bucket: 32 bits of each signature, places in the list of nodes, and that list."""
    nodes, place = np.unique(node, return_inverse=True)
    wide = len(nodes) > 0xFFFF
    head = np.array([len(low), len(nodes), wide], dtype=np.uint32)
    return head.tobytes() + nodes.tobytes() + low.tobytes() + place.astype(np.uint32 if wide else np.uint16).tobytes()


def _unpacked(blob) -> tuple[np.ndarray, np.ndarray]:
    n, m, wide = (int(x) for x in np.frombuffer(blob, dtype=np.uint32, count=3))
    nodes = np.frombuffer(blob, dtype=np.int64, count=m, offset=12)
    low = np.frombuffer(blob, dtype=np.uint32, count=n, offset=12 + 8 * m)
    place = np.frombuffer(blob, dtype=np.uint32 if wide else np.uint16, count=n, offset=12 + 8 * m + 4 * n)
    return low, nodes[place]


def common_shingles(counts: DataFrame, sets: int, shingles: int) -> np.ndarray:
    """Which cells of the hash space hold common shingles, from the ``counts`` of all texts (see ``shingle_sets``).

    A cell is common with ``COMMON`` of the ``sets`` more than its share of all ``shingles``. What reaches the driver is
    a bit per cell, whatever the input. Only the speed of the join depends on it.
    """
    least = max(LEAST_COMMON, math.ceil(COMMON * sets)) + shingles / (1 << CELL_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, n, packed in text_rows(batch, "txt", "n", "cells"):
                at = np.frombuffer(packed, dtype=np.uint16, count=n)
                found = np.frombuffer(packed, dtype=np.uint16 if len(packed) == 4 * n else np.uint32, offset=2 * n)
                total.setdefault(block, np.zeros(1 << BLOCK_BITS, dtype=np.int64))[at] += found
        for block, of_block in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(of_block >= least).tobytes()])],
                                             names=["block", "bits"])

    out = np.zeros(1 << CELL_BITS, dtype=bool)
    for r in counts.select("txt", "n", "cells").repartition("txt").mapInArrow(run, "block long, bits binary").collect():
        at = r["block"] << BLOCK_BITS
        out[at:at + (1 << BLOCK_BITS)] = np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8))
    return out


def _index(docs: DataFrame, starts: list[int], plans: dict[int, tuple], n_buckets: int, words: int, percent: int,
           text_col: str, common: np.ndarray) -> DataFrame:
    """Signature entries packed per bucket, and the hub pairs found inside the map task.

    Rows (bucket, entries). A signature is its bucket and 32 more bits: the few that meet by chance
    are told apart by the check on whole sets. Under a negative bucket: pairs already made, as
    signatures, members and hubs.
    """
    edges = np.array(starts)
    bits = np.packbits(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        common = np.unpackbits(bits).astype(bool)
        sigs, nodes, held = [], [], 0
        done = set()  # a set's entries are written once a task

        def flush():
            sig, node = np.concatenate(sigs), np.concatenate(nodes)
            bucket = sig % _U(n_buckets)
            sig = (bucket << _U(32)) | ((sig // _U(n_buckets)) & _U(0xFFFFFFFF))
            sig, node, member, hub, msig = _star(sig, node)  # sorted by bucket now
            bucket, low = (sig >> _U(32)).astype(np.int64), sig.astype(np.uint32)
            at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            ends = np.r_[at[1:], len(bucket)]
            ids = [int(bucket[a]) for a in at]
            blobs = [_packed(low[a:b], node[a:b]) for a, b in zip(at, ends)]
            for a in range(0, len(member), 20_000):
                b = a + 20_000
                ids.append(-1 - int(msig[a] % _U(n_buckets)))  # spread like the rest
                blobs.append(msig[a:b].tobytes() + member[a:b].tobytes() + hub[a:b].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())],
                                              names=["bucket", "entries"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                s = shingle(text)
                if not len(s):
                    continue
                node = xxhash.xxh3_64_intdigest(s.tobytes()) >> 1
                if node in done:
                    continue
                done.add(node)
                band = int(np.searchsorted(edges, len(s), side="right")) - 1
                for i in (band - 1, band):
                    if plans.get(i):
                        for x in signatures(s, i, plans[i], percent, common):
                            sigs.append(x)
                            nodes.append(np.full(len(x), node, dtype=np.int64))
                            held += len(x)
                if held > FLUSH:
                    yield flush()
                    sigs, nodes, held = [], [], 0
        if held:
            yield flush()
        release()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, entries binary")


def _star(sig: np.ndarray, node: np.ndarray):
    """One entry per signature (its smallest node, the hub), and the other members with that hub."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    keep = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])] if len(sig) else np.zeros(0, bool)
    sig, node = sig[keep], node[keep]
    first = np.r_[True, sig[1:] != sig[:-1]] if len(sig) else np.zeros(0, bool)
    hub = node[first][np.cumsum(first) - 1] if len(sig) else node
    rest = ~first
    return sig[first], node[first], node[rest], hub[rest], sig[rest]


_PAIRS = "sig long, x long, hub long"


def _pairs_batch(sig, x, hub) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(x), pa.array(hub)], names=["sig", "x", "hub"])


def _meet(t: pa.Table) -> pa.Table:
    """Members of one bucket of signatures against the hub of their signature; pairs already made as they are."""
    blobs = [blob.as_buffer() for chunk in t.column("entries").chunks for blob in chunk]
    bucket = t.column("bucket")[0].as_py()
    if bucket < 0:
        sig, member, hub = (np.concatenate(x) for x in zip(*(np.frombuffer(b, dtype=np.int64).reshape(3, -1) for b in blobs)))
        return pa.Table.from_batches([_pairs_batch(sig, member, hub)])
    low, node = (np.concatenate(x) for x in zip(*map(_unpacked, blobs)))
    _, _, member, hub, msig = _star((_U(bucket) << _U(32)) | low.astype(_U), node)
    return pa.Table.from_batches([_pairs_batch(msig, member, hub)])


def hub_pairs(docs: DataFrame, sizes: DataFrame, counts: DataFrame, words: int, percent: int, text_col: str) -> DataFrame:
    """(sig, x, hub): every member of a signature shared by several sets, tied to a hub of it."""
    # one row per distinct size: bounded by the longest text
    count = {r["n"]: (r["sets"], r["rows"]) for r in sizes.collect()}
    starts = band_starts(max(count, default=1), percent)
    edges = np.array(starts)
    in_band: dict[int, int] = {}
    for n, (sets, _) in count.items():
        b = int(np.searchsorted(edges, n, side="right")) - 1
        in_band[b] = in_band.get(b, 0) + sets
    plans = {}
    for i in range(len(starts) - 2):
        if in_band.get(i, 0) + in_band.get(i + 1, 0) > 1 and in_band.get(i, 0):
            plan = allocate(starts, i, in_band.get(i, 0) + in_band.get(i + 1, 0), percent)
            if plan:
                plans[i] = plan
    total = 0
    for n, (_, rows) in count.items():
        b = int(np.searchsorted(edges, n, side="right")) - 1
        for i in (b - 1, b):
            if i in plans:
                n1, k, n2, _, _ = plans[i]
                total += rows * (n + n1 if n2 == 0 else n1 * math.comb(n2, k))
    wide = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n_buckets = max(4 * wide, total // BUCKET_ENTRIES + 1)
    common = common_shingles(counts, sum(sets for sets, _ in count.values()), sum(n * sets for n, (sets, _) in count.items()))
    index = _index(docs, starts, plans, n_buckets, words, percent, text_col, common)
    return materialize(index.groupBy("bucket").applyInArrow(_meet, _PAIRS), "jaccard-pairs")


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sizes and cell counts leave room for a link."""
    side = classes.select("node", "n", "cells")
    both = (pairs.join(side.toDF("a", "na", "ca"), "a").join(side.select("node", "n").toDF("b", "nb"), "b")
            .where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
            .join(side.select("node", "cells").toDF("b", "cb"), "b"))
    return _within_bounds(both, percent)


def _within_bounds(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the rows (a, b, na, nb, ca, cb) whose cell counts differ by no more than a link allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [least_difference(ca, cb) <= max_difference(na, nb, percent)
                    for na, nb, ca, cb in text_rows(batch, "na", "nb", "ca", "cb")]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "na", "nb", "ca", "cb").mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that reach the threshold, checked on whole sets."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("ta", "tb")))
    return both.where(f"100 * common >= {percent} * (na + nb - common)").select("a", "b")


def _sets_of(docs: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """node, n, tokens for the representatives ``wanted`` (node, rep(doc_id, txt))."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("txt"), F.col(text_col).alias("text"))
    want = wanted.select("node", F.col("rep.doc_id").alias("r"), F.col("rep.txt").alias("txt"))
    found = (rows.join(want, (rows["txt"] == want["txt"]) & rows["doc_id"].eqNullSafe(want["r"]))
             .select("node", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            ids, sets = [], []
            for node, text in text_rows(batch, "node", "text"):
                ids.append(node)
                sets.append(shingle(text).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(sets, pa.list_(pa.int64()))], names=["node", "n", "tokens"])

    # rows repeated in the input give the same set again
    return found.mapInArrow(run, "node long, n long, tokens array<long>").dropDuplicates(["node"])


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """node, n, pos, t: the rarest-first prefix of each set (its shingles that occur in no other set left out)."""
    tokens = sets.select("node", "n", F.explode("tokens").alias("t"))
    often = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    per_set = (tokens.join(often, "t").groupBy("node", "n")
               .agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("ts")))
    first = per_set.withColumn("alone", F.col("n") - F.size("ts")).withColumn(
        "take", F.expr(f"n - ({percent} * n + 99) DIV 100 + 1 - alone")).where("take > 0")
    return (first.select("node", "n", "alone", F.posexplode(F.expr("slice(ts, 1, CAST(take AS INT))")).alias("i", "ft"))
            .select("node", "n", (F.col("alone") + F.col("i")).alias("pos"), F.col("ft.t").alias("t")))


def _prefix_hubs(prefix: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """(a, b): every set with the hub it shares most prefix shingles with, if in another component.

    The first ``turn`` takes the set with the fewest rarer shingles before this one, the most central of a
    family; later turns take other members."""
    order = F.struct("pos", "node") if turn == 0 else F.struct(F.xxhash64("node", F.lit(turn)), "node")
    hubs = prefix.groupBy("t").agg(F.min_by("node", order).alias("hub"))
    tied = prefix.select("t", "node").join(hubs, "t").where("node <> hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("c"))
    best = tied.groupBy("node").agg(F.max(F.struct("c", "hub")).alias("m")).select("node", F.col("m.hub").alias("hub"))
    la = labels.select("node", "label")
    return (best.join(la, "node").join(la.toDF("hub", "hub_label"), "hub").where("label <> hub_label")
            .select(F.col("node").alias("a"), F.col("hub").alias("b")))


def _rest_pairs(prefix: DataFrame, labels: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Every candidate across components: sets that share a prefix shingle, with position, size and cell bounds."""
    named = (prefix.join(labels.join(classes.select("node", "cells"), "node"), "node")
             .select("t", "node", "n", "pos", "label", "cells"))
    a, b = named.toDF("t", "a", "na", "pa", "la", "ca"), named.toDF("t", "b", "nb", "pb", "lb", "cb")
    need = f"({percent} * (na + nb) + {100 + percent - 1}) DIV {100 + percent}"
    met = (a.join(b, "t").where("a < b AND la <> lb")
           .where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
           # the first token a linked pair shares leaves room for the whole overlap behind it
           .where(f"least(na - pa, nb - pb) >= {need}"))
    return _within_bounds(met, percent).distinct()


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Those of ``pairs`` (sig, x, hub) whose ends lie in different components."""
    lx = label.select(F.col("node").alias("x"), F.col("label").alias("lx"))
    lh = label.select(F.col("node").alias("hub"), F.col("label").alias("lh"))
    return (pairs.join(lx, "x", "left").join(lh, "hub", "left")
            .where("coalesce(lx, x) <> coalesce(lh, hub)").select("sig", "x", "hub"))


def _checked(docs: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, percent: int, id_col: str,
             text_col: str) -> DataFrame:
    """The links among candidate ``pairs``: bounds first, then whole sets, read for what is left."""
    return _verified(docs, classes, _possible(pairs, classes, percent), words, percent, id_col, text_col)


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, percent: int, id_col: str,
              text_col: str) -> DataFrame:
    left = materialize(pairs, "jaccard-possible")
    if not left.take(1):
        return left
    nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    sets = materialize(_sets_of(docs, classes.join(nodes, "node"), words, id_col, text_col), "jaccard-sets")
    return materialize(_linked(left, sets, percent), "jaccard-links")


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """doc_id, txt, n_shingles, label (null: no shingles), component_id for every row of ``docs``."""
    told = materialize(shingle_sets(docs, words, id_col, text_col), "jaccard-rows", "part")
    rows, counts = told.where("part = 0").drop("part"), told.where("part = 1")
    classes = materialize(rows.where("node IS NOT NULL").groupBy("node", "n").agg(
        F.min(F.struct("doc_id", "txt")).alias("rep"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("rows"),
        F.max("cells").alias("cells")), "jaccard-classes")
    sizes = classes.groupBy("n").agg(F.count(F.lit(1)).alias("sets"), F.sum("rows").alias("rows"))
    pairs = hub_pairs(docs, sizes, counts, words, percent, text_col)
    # the hub a set shares most signatures with is tried first, the others only across components
    tied = pairs.groupBy(F.col("x").alias("a"), F.col("hub").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    best = materialize(tied.groupBy("a").agg(F.max(F.struct("c", "b")).alias("m")).select("a", F.col("m.b").alias("b")), "jaccard-best")
    links = _checked(docs, classes, best, words, percent, id_col, text_col)
    label = components(links)

    def join(found: DataFrame) -> None:
        nonlocal links, label
        if found.take(1):
            links = links.unionByName(found)
            label = components(links)

    others = _apart(pairs, label).select(F.col("x").alias("a"), F.col("hub").alias("b")).distinct()
    others = others.join(best, ["a", "b"], "left_anti")
    join(_checked(docs, classes, others, words, percent, id_col, text_col))
    # signatures with members in several components
    apart = _apart(pairs, label).select("sig").distinct()
    # a signature of two sets has had its only pair checked
    sized = pairs.groupBy("sig").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    open_pairs = pairs.join(apart.join(sized, "sig").select("sig"), "sig")
    open_nodes = materialize(open_pairs.select(F.col("x").alias("node")).union(open_pairs.select("hub")).distinct(), "jaccard-open")
    if open_nodes.take(1):
        rest = _sets_of(docs, classes.join(open_nodes, "node"), words, id_col, text_col)
        prefix = materialize(_prefixes(rest, percent), "jaccard-prefix")

        def labels() -> DataFrame:
            return open_nodes.join(label, "node", "left").select("node", F.coalesce("label", "node").alias("label"))

        for turn in range(HUB_TURNS):  # again hubs first: most of a family joins without its pairs being written
            join(_checked(docs, classes, _prefix_hubs(prefix, labels(), turn), words, percent, id_col, text_col))
        join(_verified(docs, classes, _rest_pairs(prefix, labels(), classes, percent), words, percent, id_col, text_col))
    by_set = classes.join(label, "node", "left").select("node", "least_id", F.coalesce("label", "node").alias("label"))
    least = by_set.groupBy("label").agg(F.min("least_id").alias("component_id"))
    of_set = by_set.join(least, "label").select("node", "label", "component_id")
    out = rows.join(of_set, "node", "left")
    return out.select("doc_id", "txt", F.col("n").alias("n_shingles"), "label",
                      F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every component: the smallest id (null last), then the smallest text hash.

    Rows without shingles link with nothing and all stay.
    """
    found = materialize(jaccard_components(docs, words, percent, id_col, text_col), "jaccard-found")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "txt")).alias("kept")
    kept = found.where("label IS NOT NULL").groupBy("label").agg(first).select("kept.doc_id", "kept.txt")
    # equal rows are one row of their component; those without shingles come back as often as they are
    kept = kept.withColumn("one", F.lit(True)).unionByName(
        found.where("label IS NULL").select("doc_id", "txt").distinct().withColumn("one", F.lit(False)))
    kept = materialize(kept.select(F.xxhash64("doc_id").alias("i"), F.col("txt").alias("t"), "one"), "jaccard-kept")
    rows = keyed(docs, id_col, text_col).join(kept, ["i", "t"])
    copies = materialize(rows.where("one").groupBy("i", "t").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "jaccard-copies")
    if copies.take(1):
        rest = rows.join(copies, ["i", "t"], "left_anti")
        rows = rest.unionByName(rows.join(copies, ["i", "t"], "left_semi").dropDuplicates(["i", "t"]))
    return unkeyed(rows, docs)


def jaccard_digest(docs: DataFrame) -> DataFrame:
    """The registered query."""
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")
