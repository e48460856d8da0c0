"""Centroid clustering over a VA-file: vectors as few-bit cells, whole vectors only where intervals overlap.

Components are integers (floor(scale * x)), so all sums, centroids and distances are exact.

* ``vector_file`` writes one Parquet table: the components, one byte-sized cell per dimension (edges at
  the quantiles of a normal distribution with the dimension's mean and deviation, outer edges at its
  extremes) and a ``page``: the folder that holds the row. Rows are dealt into pages by how near they lie
  to the border between their two nearest centroids, so rows that stay undecided later lie together.
* In each round a task reads pages and cells only. Per centroid set, tables [dimension, cell] ->
  smallest and largest squared difference give each centroid's distance interval; where the best interval
  overlaps another, the interval of the difference of two distances (linear in the vector, so much
  narrower) is tried. A vector whose old and new nearest centroids are both certain and equal changes no
  sum. Pages with any other vector are read again with their components, and only those vectors'
  distances are computed; they change the sums of the clusters they leave and join.
* Centroids and sums (k rows) are all that reaches the driver. Nothing is shuffled but k partial sums
  a task.

The first round and the last assignment need every whole vector (all sums, all distances).

Edge cases: rows with null vectors, another number of components, or null, NaN or infinite components are
left out; repeated rows and repeated or null ids count as they stand; equal distances go to the smaller
centroid number; fewer kept rows than centroids give as many centroids as rows; an empty table gives an
empty result; other columns are not read. Components must stay below 2^27 after scaling (an error else:
squared distances beyond would not fit a long).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from statistics import NormalDist

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import materialize

DIMENSIONS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, 3
CELLS = 256
PAGES = 8
LARGEST = 1 << 27
EXACT = 1 << 22  # below it, products of 64 components sum exactly in doubles


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMENSIONS,
                    scale: int = SCALE) -> DataFrame:
    """(vec_id, x array<int>): rows whose vector has ``dims`` finite components, as floor(scale * x)."""
    v = F.col("v")
    kept = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")) \
        .where((F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    scaled = F.transform(v, lambda x: x * F.lit(float(scale)))
    small = F.forall("v", lambda x: F.abs(x) < LARGEST)
    return kept.withColumn("v", scaled).select("vec_id", F.when(small, F.transform("v", lambda x: F.floor(x).cast("int")))
        .otherwise(F.raise_error(F.lit("a component is too large for exact distances"))).alias("x"))


def seeds(vectors: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The ``k`` vectors with the smallest SHA-256 of 'seed:id', in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r["x"]) for r in vectors.select(order.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()]


def _matrix(column: pa.Array, dims: int):
    import numpy as np
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def _distances(x, centroids):
    """Exact squared distances, rows by centroids."""
    import numpy as np
    if max(abs(x).max(initial=0), abs(centroids).max(initial=0)) < EXACT and x.shape[1] <= 64:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None]).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)


def _sums(x, cluster, k: int, sign: int = 1) -> list[tuple[int, int, list[int]]]:
    """(cluster, count, sums) of the rows of a block."""
    import numpy as np
    found = []
    for c in range(k):
        mine = x[cluster == c]
        if len(mine):
            found.append((c, sign * len(mine), (sign * mine.sum(0, dtype=np.int64)).tolist()))
    return found


class _Totals:
    """Partial sums of a task: k rows however many vectors it reads."""

    SCHEMA = "c int, d int, s decimal(38,0)"  # d = -1: the number of vectors

    def __init__(self, k: int, dims: int):
        self.n, self.s = [0] * k, [[0] * dims for _ in range(k)]

    def add(self, found) -> None:
        for c, n, s in found:
            self.n[c] += n
            self.s[c] = [a + b for a, b in zip(self.s[c], s)]

    def batch(self) -> pa.RecordBatch:
        from decimal import Decimal
        rows = [(c, d, Decimal(v)) for c, sums in enumerate(self.s) for d, v in enumerate([*sums, self.n[c]]) if v]
        width = len(self.s[0])
        c, d, v = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array([-1 if x == width else x for x in d], pa.int32()),
                                           pa.array(v, pa.decimal128(38, 0))], names=["c", "d", "s"])


def _collected(partials: DataFrame, k: int, dims: int) -> tuple[list[int], list[list[int]]]:
    """Counts and sums per centroid: k rows of dims + 1 numbers."""
    n, s = [0] * k, [[0] * dims for _ in range(k)]
    for r in partials.groupBy("c", "d").agg(F.sum("s").alias("s")).collect():
        if r["d"] < 0:
            n[r["c"]] = int(r["s"])
        else:
            s[r["c"]][r["d"]] = int(r["s"])
    return n, s


def _moved(centroids: list[list[int]], n: list[int], s: list[list[int]]) -> list[list[int]]:
    return [[v // n[c] for v in s[c]] if n[c] else centroids[c] for c in range(len(centroids))]


def first_sums(vectors: DataFrame, centroids: list[list[int]]) -> tuple[list[int], list[list[int]]]:
    k, dims = len(centroids), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        c, totals = np.array(centroids, dtype=np.int64), _Totals(k, dims)
        for batch in batches:
            x = _matrix(batch.column("x"), dims)
            totals.add(_sums(x, _distances(x, c).argmin(1), k))
        yield totals.batch()

    return _collected(vectors.select("x").mapInArrow(run, _Totals.SCHEMA), k, dims)


def cell_edges(vectors: DataFrame, dims: int = DIMENSIONS, cells: int = CELLS) -> tuple[list[list[int]], list[list[int]]]:
    """Per dimension the smallest and largest integer of each cell (a cell may be empty: smallest above largest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        n, found = 0, None
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column("x"), dims)
            y = x.astype(np.float64)
            part = x.min(0), x.max(0), y.sum(0), (y * y).sum(0)
            found = part if found is None else (np.minimum(found[0], part[0]), np.maximum(found[1], part[1]),
                                                found[2] + part[2], found[3] + part[3])
            n += len(x)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()),
                                              *map(pa.array, found)], names=["d", "n", "lo", "hi", "s", "q"])

    stats = vectors.select("x").mapInArrow(run, "d int, n long, lo long, hi long, s double, q double").groupBy("d").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect()
    lows, highs = [], []
    quantiles = [NormalDist().inv_cdf(i / cells) for i in range(1, cells)]
    for r in sorted(stats, key=lambda r: r["d"]):  # one row per dimension; the edges need no exact mean
        lo, hi, m = r["lo"], r["hi"], r["s"] / r["n"]
        deviation = max(0.0, r["q"] / r["n"] - m * m) ** 0.5
        inner = [min(max(round(m + deviation * q), lo), hi + 1) for q in quantiles]
        lows.append([lo, *inner])
        highs.append([*[e - 1 for e in inner], hi])
    return lows, highs


def vector_file(vectors: DataFrame, centroids: list[list[int]], lows: list[list[int]], pages: int = PAGES) -> DataFrame:
    """The written table (vec_id, x, cells, page), partitioned by page."""
    dims = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        c, edges = np.array(centroids, dtype=np.int64), np.array(lows, dtype=np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"), dims)
            cells = np.stack([np.searchsorted(edges[d][1:], x[:, d], side="right") for d in range(dims)], 1).astype(np.uint8)
            gap = np.zeros(len(x))
            if len(c) > 1 and len(x):
                near = _distances(x, c)
                first, second = np.argsort(near, axis=1, kind="stable")[:, :2].T
                at = np.arange(len(x))
                apart = np.sqrt(((c[first] - c[second]) ** 2).sum(1).astype(np.float64)) + 1
                # powers of two of the distance to the border, in units of the centroids' own distance
                gap = np.log2((near[at, second] - near[at, first]) / apart ** 2 + 2.0 ** (1 - pages)) + pages - 1
            page = np.clip(gap, 0, pages - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("x"), pa.array([r.tobytes() for r in cells], pa.binary()), pa.array(page)],
                names=["vec_id", "x", "cells", "page"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = vectors.mapInArrow(run, f"vec_id {kind}, x array<int>, cells binary, page int")
    return materialize(rows, "va-file", "page")


class Intervals:
    """Which centroid is nearest, from cells alone."""

    def __init__(self, centroids, lows, highs):
        import numpy as np
        self.c = np.array(centroids, dtype=np.int64)
        self.k, self.dims = self.c.shape
        self.lo, self.hi = np.array(lows, dtype=np.int64), np.array(highs, dtype=np.int64)
        self.cells = self.lo.shape[1]
        below = self.lo[:, :, None] - self.c.T[:, None, :]
        above = self.hi[:, :, None] - self.c.T[:, None, :]
        largest = np.maximum(below ** 2, above ** 2)
        smallest = np.where((below <= 0) & (above >= 0), 0, np.minimum(below ** 2, above ** 2))
        self.table = np.concatenate([smallest, largest], 2).reshape(self.dims * self.cells, 2 * self.k)
        self.norm = (self.c ** 2).sum(1)

    def bounds(self, cells):
        """Smallest and largest squared distance of each row to each centroid."""
        import numpy as np
        found = np.zeros((len(cells), 2 * self.k), dtype=np.int64)
        for d in range(self.dims):
            found += self.table[cells[:, d].astype(np.int64) + d * self.cells]
        return found[:, :self.k], found[:, self.k:]

    def nearest(self, cells):
        """The nearest centroid of each row, or -1 where the cells leave it open."""
        import numpy as np
        smallest, largest = self.bounds(cells)
        best = largest.argmin(1)
        order = np.arange(self.k)[None]
        at = np.arange(len(cells))
        top = largest[at, best][:, None]
        others = order != best[:, None]
        # an equal distance goes to the smaller number
        clear = (top < smallest) | ((top == smallest) & (best[:, None] < order)) | ~others
        certain = clear.all(1)
        open_rows = np.flatnonzero(~certain)
        if len(open_rows):
            part = cells[open_rows].astype(np.int64)
            d = np.arange(self.dims)[None]
            lo, hi = self.lo[d, part], self.hi[d, part]
            # the guess need not be that of the single intervals: the nearest to the middle of the cell
            middle = _distances((lo + hi) // 2, self.c)
            guess = middle.argmin(1)
            certain[open_rows] = self._closer(lo, hi, guess)
            best[open_rows] = guess
        return np.where(certain, best, -1)

    def _closer(self, lo, hi, guess):
        """Whether the guessed centroid is nearest for every vector of the cell.

        |x - a|^2 - |x - b|^2 = 2 x (b - a) + |a|^2 - |b|^2: its maximum over the cell is taken dimension by dimension.
        """
        import numpy as np
        clear = np.ones(len(lo), dtype=bool)
        both, width = lo + hi, hi - lo
        for a in range(self.k):
            mine = np.flatnonzero(guess == a)
            if not len(mine):
                continue
            apart = self.c - self.c[a]
            top = _product(both[mine], apart) + _product(width[mine], abs(apart)) + self.norm[a] - self.norm[None]
            open_ = (top > 0) | ((top == 0) & (np.arange(self.k)[None] < a))
            open_[:, a] = False
            clear[mine] = ~open_.any(1)
        return clear


def _product(x, y):
    """x y^T, exact."""
    import numpy as np
    if max(abs(x).max(initial=0), abs(y).max(initial=0)) < EXACT and x.shape[1] <= 64:
        return (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64)
    return x @ y.T


def _cells(column: pa.Array, dims: int):
    import numpy as np
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), dims)


def open_pages(file: DataFrame, old: list[list[int]], new: list[list[int]], lows, highs) -> DataFrame:
    """(page, n): pages with vectors whose change the cells leave open or show, and their number."""
    dims = len(old[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        before, after = Intervals(old, lows, highs), Intervals(new, lows, highs)
        found = np.zeros(PAGES, dtype=np.int64)
        for batch in batches:
            cells = _cells(batch.column("cells"), dims)
            a, b = before.nearest(cells), after.nearest(cells)
            found += np.bincount(batch.column("page").to_numpy()[(a != b) | (a < 0)], minlength=PAGES)
        used = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype("int32")), pa.array(found[used])], names=["page", "n"])

    return file.select("cells", "page").mapInArrow(run, "page int, n long").groupBy("page").agg(F.sum("n").alias("n"))


def changed_sums(file: DataFrame, old: list[list[int]], new: list[list[int]], lows, highs) -> DataFrame:
    """What the vectors that change their centroid take from and bring to the sums."""
    k, dims = len(old), len(old[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        before, after, totals = Intervals(old, lows, highs), Intervals(new, lows, highs), _Totals(k, dims)
        for batch in batches:
            cells = _cells(batch.column("cells"), dims)
            a, b = before.nearest(cells), after.nearest(cells)
            rows = np.flatnonzero((a != b) | (a < 0))
            if not len(rows):
                continue
            x = _matrix(batch.column("x").take(pa.array(rows)), dims)
            a, b = _distances(x, before.c).argmin(1), _distances(x, after.c).argmin(1)
            x, a, b = x[a != b], a[a != b], b[a != b]
            totals.add(_sums(x, a, k, -1))
            totals.add(_sums(x, b, k))
        yield totals.batch()

    return file.select("x", "cells", "page").mapInArrow(run, _Totals.SCHEMA)


def fit(rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMENSIONS, scale: int = SCALE,
        id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[list[list[int]], DataFrame | None, list[dict]]:
    """Centroids after ``rounds`` rounds, the vector file, and per round the share of vectors read whole."""
    vectors = integer_vectors(rows, id_col, vector_col, dims, scale)
    old = seeds(vectors, k, seed)
    if not old or rounds < 1:
        return old, None, []
    n, s = first_sums(vectors, old)
    total = sum(n)
    new = _moved(old, n, s)
    lows, highs = cell_edges(vectors, dims)
    file = vector_file(vectors, new, lows)
    report = [{"round": 1, "open": total, "pages": PAGES}]
    for at in range(2, rounds + 1):
        pages = {r["page"]: r["n"] for r in open_pages(file, old, new, lows, highs).collect()}  # at most PAGES rows
        report.append({"round": at, "open": sum(pages.values()), "pages": len(pages)})
        if pages:
            part = file.where(F.col("page").isin(*sorted(pages)))
            dn, ds = _collected(changed_sums(part, old, new, lows, highs), len(old), dims)
            n = [a + b for a, b in zip(n, dn)]
            s = [[a + b for a, b in zip(x, y)] for x, y in zip(s, ds)]
        old, new = new, _moved(new, n, s)
    return new, file, report


def assign(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance): every vector's nearest centroid and squared distance."""
    dims = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        c = np.array(centroids, dtype=np.int64)
        for batch in batches:
            near = _distances(_matrix(batch.column("x"), dims), c)
            best = near.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best.astype("int32")),
                                              pa.array(near[np.arange(len(near)), best])], names=["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def clusters_digest(rows: DataFrame, **parameters) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    centroids, file, _ = fit(rows, **parameters)
    columns = "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    if not centroids:
        kind = rows.schema[parameters.get("id_col", "vec_id")].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, "
                                                     "inertia long, centroid_sha256 string")
    if file is None:
        names = {k: v for k, v in parameters.items() if k in ("id_col", "vector_col", "dims", "scale")}
        file = integer_vectors(rows, **names)
    found = materialize(assign(file, centroids), "clusters")
    inertia = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    per = F.array(*[F.lit(inertia.get(c, 0)).cast("long") for c in range(len(centroids))])
    return found.withColumns({"cluster_inertia": F.get(per, F.col("cluster")), "inertia": F.lit(sum(inertia.values())).cast("long"),
                              "centroid_sha256": F.get(F.array(*[F.lit(d) for d in digests]), F.col("cluster"))}).select(*columns)


def sql(k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMENSIONS, scale: int = SCALE) -> str:
    """DuckDB SQL for ``clusters_digest``: every distance of every round, in long form."""
    ctes = [f"""v AS (SELECT row_number() OVER () AS r, vec_id, [floor({scale} * e::DOUBLE)::BIGINT FOR e IN embedding] AS x
      FROM (SELECT * FROM embeddings WHERE len(embedding) = {dims}
            AND len([e FOR e IN embedding IF e IS NOT NULL AND isfinite(e::DOUBLE)]) = {dims}))""",
            "p AS (SELECT r, unnest(x) AS x, generate_subscripts(x, 1) AS d FROM v)",
            f"""c0 AS (SELECT c, unnest(x) AS x, generate_subscripts(x, 1) AS d
      FROM (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('{seed}:' || vec_id::VARCHAR) AS h, x FROM v) ORDER BY h, x LIMIT {k}))"""]
    for i in range(rounds + 1):
        ctes.append(f"a{i} AS (SELECT r, arg_min(c, (s, c)) AS c, min(s) AS s FROM (SELECT p.r, c{i}.c, sum((p.x - c{i}.x) * (p.x - c{i}.x))::BIGINT AS s "
                    f"FROM p JOIN c{i} USING (d) GROUP BY ALL) GROUP BY r)")
        if i < rounds:
            ctes.append(f"m{i} AS (SELECT a{i}.c, p.d, sum(p.x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM p JOIN a{i} USING (r) GROUP BY ALL)")
            ctes.append(f"c{i + 1} AS (SELECT c{i}.c, CASE WHEN m{i}.n IS NULL THEN c{i}.x ELSE ((m{i}.s - (((m{i}.s % m{i}.n) + m{i}.n) % m{i}.n)) // m{i}.n)::BIGINT END AS x, "
                        f"c{i}.d FROM c{i} LEFT JOIN m{i} ON m{i}.c = c{i}.c AND m{i}.d = c{i}.d)")
    names = [c.split(" AS ", 1) for c in ctes]
    body = ",\n".join(f"{a} AS MATERIALIZED {b}" for a, b in names)
    last = f"a{rounds}"
    return f"""WITH {body},
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS digest FROM c{rounds} GROUP BY c)
SELECT v.vec_id, {last}.c::INTEGER AS cluster, {last}.s AS distance, sum({last}.s) OVER (PARTITION BY {last}.c)::BIGINT AS cluster_inertia,
       sum({last}.s) OVER ()::BIGINT AS inertia, h.digest AS centroid_sha256
FROM {last} JOIN v USING (r) JOIN h ON h.c = {last}.c"""
