"""Packing of tokenised documents into sequences of bounded length by bin completion.

Pieces differ for the packer only by their length, so the problem is its histogram: at most
``capacity`` numbers, whatever the corpus size. That histogram (and nothing else) goes to the
driver, where ``complete_bins`` fills one kind of sequence at a time around the largest remaining
piece: the best-fit filling is the incumbent, undominated fillings are enumerated largest piece
first, and a branch is cut when the waste bound of what is left cannot beat the incumbent. A
filling is used as often as its pieces last. Each piece then finds its sequence from its rank among
the pieces of its length, counted on the executors in salted groups, so one length that holds a
third of all pieces is spread over many tasks.

Edge cases: null and empty texts are the end id alone; texts longer than a sequence are cut into
full pieces and a rest; equal rows are packed as separate documents; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from tidemark.llm.common import materialize, release, text_rows
from tidemark.llm.tokens import encoder, public_tokenizer

CAPACITY = 4096
END_ID = 1
SALTS = 1024
#: Search nodes per filling and per tail search; past it the best solution so far stands.
NODES = 20_000
#: Sequences a tail search packs anew, fewest first.
TAILS = (3, 6, 12, 24)

_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


# --- histogram packing --------------------------------------------------------------------------

def _best_fit(sizes: list[int], counts: dict[int, int], room: int) -> list[int]:
    """Largest piece that fits, again and again (``sizes`` descending)."""
    out, used = [], {}
    for s in sizes:
        while s <= room and counts[s] - used.get(s, 0) > 0:
            out.append(s)
            used[s] = used.get(s, 0) + 1
            room -= s
    return out


def completion(sizes: list[int], counts: dict[int, int], room: int, nodes: int = NODES) -> list[int]:
    """The undominated filling of ``room`` with the least waste (ties: larger pieces first)."""
    sizes = [s for s in sizes if s <= room and counts[s] > 0]
    if not sizes:
        return []
    best = _best_fit(sizes, counts, room)
    best_sum = sum(best)
    if best_sum == room:
        return best
    if counts.get(room, 0) > 0:
        return [room]
    tail = [0] * (len(sizes) + 1)  # all that is left from a position on
    for i in range(len(sizes) - 1, -1, -1):
        tail[i] = min(room, tail[i + 1] + sizes[i] * counts[sizes[i]])
    smallest = sizes[-1]
    budget = [nodes]
    chosen: list[int] = []

    def search(i: int, left: int, total: int) -> bool:
        nonlocal best, best_sum
        if total > best_sum:
            best, best_sum = list(chosen), total
            if best_sum == room:
                return True
        if left < smallest:
            return False
        while i < len(sizes):
            if total + min(left, tail[i]) <= best_sum or budget[0] <= 0:  # waste bound
                return False
            s = sizes[i]
            if s <= left:
                budget[0] -= 1
                most = min(counts[s], left // s)
                # dominance: more copies of the larger piece before fewer
                for k in range(most, 0, -1):
                    chosen.extend([s] * k)
                    if search(i + 1, left - s * k, total + s * k):
                        return True
                    del chosen[-k:]
            i += 1
        return False

    search(0, room, 0)
    return best


def complete_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Fillings with their multiplicities, covering the histogram exactly."""
    by_completion = _fill(histogram, capacity, completion)
    total = sum(s * n for s, n in histogram.items())
    bound = max(-(-total // capacity), sum(n for s, n in histogram.items() if 2 * s > capacity))
    if sum(m for _, m in by_completion) == bound:
        return by_completion
    by_best_fit = _fill(histogram, capacity, lambda sizes, counts, room: _best_fit(sizes, counts, room))
    best = min((by_completion, by_best_fit), key=lambda x: sum(m for _, m in x))
    return _improve(best, capacity, bound)


def _improve(packing: list[tuple[list[int], int]], capacity: int, bound: int) -> list[tuple[list[int], int]]:
    """``packing`` with its last sequences packed anew while that saves one and the lower bound is not reached."""
    total = sum(m for _, m in packing)
    at = 0
    while total > bound and at < len(TAILS):
        head, tail, room = list(packing), [], TAILS[at]
        while head and room:
            filling, times = head.pop()
            taken = min(times, room)
            tail += [filling] * taken
            room -= taken
            if times > taken:
                head.append((filling, times - taken))
        fewer = _tail_search([s for x in tail for s in x], capacity, len(tail))
        if fewer is None:
            at += 1
            continue
        packing, total = head + [(x, 1) for x in fewer], total - len(tail) + len(fewer)
    return packing


def _tail_search(pieces: list[int], capacity: int, known: int, nodes: int = NODES) -> list[list[int]] | None:
    """Fewer than ``known`` sequences for ``pieces``, or None: branches over the undominated fillings around the largest piece."""
    counts: dict[int, int] = {}
    for s in pieces:
        counts[s] = counts.get(s, 0) + 1
    sizes = sorted(counts, reverse=True)
    budget = [nodes]

    def fillings(i: int, room: int, chosen: list[int]) -> Iterator[list[int]]:
        """Fillings of the room to which no piece left can be added."""
        while i < len(sizes) and (sizes[i] > room or counts[sizes[i]] == 0):
            i += 1
        budget[0] -= 1
        if budget[0] <= 0:
            return
        if i == len(sizes):
            if all(counts[s] == 0 or s > room for s in sizes):
                yield list(chosen)
            return
        s = sizes[i]
        most = min(counts[s], room // s)
        for k in range(most, -1, -1):
            counts[s] -= k
            yield from fillings(i + 1, room - s * k, chosen + [s] * k)
            counts[s] += k

    def search(left: int, limit: int) -> list[list[int]] | None:
        """At most ``limit`` sequences for what is left."""
        if left == 0:
            return []
        if left > limit * capacity or budget[0] <= 0:
            return None
        largest = next(s for s in sizes if counts[s])
        counts[largest] -= 1
        found = sorted(fillings(0, capacity - largest, []), key=lambda x: (-sum(x), len(x)))
        for filling in found:
            if left - largest - sum(filling) > (limit - 1) * capacity:
                break
            for s in filling:
                counts[s] -= 1
            rest = search(left - largest - sum(filling), limit - 1)
            for s in filling:
                counts[s] += 1
            if rest is not None:
                counts[largest] += 1
                return [[largest, *filling], *rest]
        counts[largest] += 1
        return None

    return search(sum(pieces), known - 1)


def _fill(histogram: dict[int, int], capacity: int, fill) -> list[tuple[list[int], int]]:
    counts = {s: n for s, n in histogram.items() if n > 0}
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("piece lengths must lie between 1 and the capacity")
    out = []
    sizes = sorted(counts, reverse=True)
    while sizes:
        largest = sizes[0]
        counts[largest] -= 1
        filling = [largest, *fill(sizes, counts, capacity - largest)]
        counts[largest] += 1
        use: dict[int, int] = {}
        for s in filling:
            use[s] = use.get(s, 0) + 1
        times = min(counts[s] // k for s, k in use.items())
        for s, k in use.items():
            counts[s] -= k * times
        out.append((filling, times))
        sizes = [s for s in sizes if counts[s] > 0]
    return out


# --- Spark side ---------------------------------------------------------------------------------

def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, on request, the ids."""
    path = tokenizer or public_tokenizer("word_bpe_49k.json")
    schema = T._parse_datatype_string(_PIECES + (", ids array<int>" if with_ids else ""))
    id_type = docs.schema[id_col].dataType
    schema[0].dataType = id_type
    end = int(end_id).to_bytes(4, "little")
    width = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        enc = encoder(path, "word")
        for batch in batches:
            ids, piece, start, length, crc, blobs = [], [], [], [], [], []
            for doc, text in text_rows(batch, "id", "text"):
                data = enc.encode(text or "") + end
                for k, at in enumerate(range(0, len(data), width)):
                    part = data[at:at + width]
                    ids.append(doc)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        blobs.append(np.frombuffer(part, dtype="<i4"))
            cols = [pa.array(ids, batch.schema.field("id").type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int32()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(blobs, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)
        enc.rest()
        release()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def ranked(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``rank`` among those of the same length (0 .. n-1), in salted groups.

    Rows that tie in every ordering column are equal, so any order among them gives the same table.
    """
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("base", F.coalesce(F.sum("n").over(
        Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    here = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return (salted.withColumn("i", F.row_number().over(here) - 1)
            .join(before.select("length", "salt", "base"), ["length", "salt"])
            .withColumn("rank", F.col("base") + F.col("i")).drop("salt", "i", "base"))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Placement of materialised ``pieces``: adds sequence_id and offset (gapless from 0 per sequence)."""
    spark = pieces.sparkSession
    # at most ``capacity`` rows, whatever the input
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots: dict[int, list[tuple]] = {}
    taken: dict[int, int] = {}
    first_sequence = 0
    for filling, times in complete_bins(histogram, capacity):
        at, offsets = 0, {}
        for s in filling:
            offsets.setdefault(s, []).append(at)
            at += s
        for s, where in offsets.items():
            lo = taken.get(s, 0)
            taken[s] = lo + len(where) * times
            slots.setdefault(s, []).append((lo, taken[s], first_sequence, where))
        first_sequence += times
    schema = "length int, slots array<struct<lo:long,hi:long,sequence:long,offsets:array<int>>>"
    table = spark.createDataFrame([(s, x) for s, x in slots.items()], schema)  # bounded as the histogram
    out = ranked(pieces).join(F.broadcast(table), "length")
    out = out.withColumn("slot", F.expr("filter(slots, x -> rank >= x.lo AND rank < x.hi)[0]")).drop("slots")
    out = out.withColumn("j", F.col("rank") - F.col("slot.lo")).withColumn("w", F.size("slot.offsets").cast("long"))
    return (out.withColumn("sequence_id", F.col("slot.sequence") + F.expr("j DIV w"))
            .withColumn("offset", F.expr("slot.offsets[CAST(j % w AS INT)]").cast("long"))
            .drop("slot", "j", "w", "rank"))


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, length, ids and the documents in order.

    Needs pieces with ids; a group holds at most one sequence's tokens.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return (placed.groupBy("sequence_id").agg(parts.alias("parts"))
            .select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"),
                    F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("offsets")))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its sequence and offset."""
    pieces = materialize(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids), "pieces")
    return pack(pieces, capacity)


def packing_digest(docs: DataFrame) -> DataFrame:
    """The registered query: placements with the ids' digest."""
    return pack_documents(docs).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"),
                                       "ids_crc32", "sequence_id", "offset")
