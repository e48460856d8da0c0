"""Extendible hashing of documents into shards of bounded size (DataFrame functions only).

A row's key is a 60-bit hash of its id and content. A directory of hash prefixes starts with one
bucket; only a bucket over the byte limit is split on the next bit, until every bucket fits. The
splits are found from sums per prefix: one aggregate at a depth a little below the expected one,
rolled up to every shorter prefix, gives all leaves at once; buckets still over the limit there are
taken further bits down in the next round, without touching the others.

Edge cases: null id and null text hash like any other value (null text has 0 bytes); a document
over the limit by itself gets a shard of its own; equal rows (same id and text) share a key that no
bit can split, so a group of them over the limit is laid out as numbered overflow pages of one
bucket; an empty table gives no rows. Extra columns are not touched: the result holds one row per
input row with the id and its shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import materialize

KEY_BITS = 60
#: Bits below the expected depth of the first round, and per later round.
SLACK_BITS = 3
ROUND_BITS = 12
#: Rows of one overflow block (equal rows are written out in blocks of this many).
BLOCK = 10_000
#: Bytes of text per shard in the registered query.
SHARD_BYTES = 1 << 20


def hash_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Distinct (id, content) rows: ``h`` (60-bit key), ``unit`` (full hash), bytes each, copies ``n``."""
    text_md5 = F.coalesce(F.md5(F.col(text_col)), F.lit("-"))
    unit = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit(":"), text_md5))
    rows = docs.select(F.col(id_col).alias("id"),
                       F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"),
                       unit.alias("unit"))
    units = rows.groupBy("id", "unit", "n_bytes").agg(F.count(F.lit(1)).alias("n"))
    return units.withColumn("h", F.conv(F.substring("unit", 1, KEY_BITS // 4), 16, 10).cast("long"))


def _split(units: DataFrame, limit: int, base: int, depth: int) -> DataFrame:
    """Nodes (d, p) from ``base`` to ``depth`` bits: leaves (``over`` false) and, at ``depth``, buckets still too large.

    A leaf fits (or holds a single row, or has no bits left) and its parent does not.
    """
    cells = (units.groupBy(F.shiftright("h", KEY_BITS - depth).alias("cell"))
             .agg(F.sum(F.col("n_bytes") * F.col("n")).alias("b"), F.sum("n").alias("k")))
    levels = cells.select("cell", "b", "k", F.explode(F.sequence(F.lit(base), F.lit(depth))).alias("d"))
    nodes = (levels.withColumn("p", F.expr(f"shiftright(cell, {depth} - d)"))
             .groupBy("d", "p").agg(F.sum("b").alias("b"), F.sum("k").alias("k")))
    fits = (F.col("b") <= limit) | (F.col("k") == 1)
    siblings = Window.partitionBy("d", F.shiftright("p", 1))
    parent_fits = ((F.sum("b").over(siblings) <= limit) | (F.sum("k").over(siblings) == 1)) & (F.col("d") > base)
    return (nodes.select("d", "p", "b", "k", fits.alias("fits"), parent_fits.alias("parent_fits"))
            .where(~F.col("parent_fits") & (F.col("fits") | (F.col("d") == depth)))
            .select("d", "p", F.col("b").alias("shard_bytes"), F.col("k").alias("shard_docs"),
                    (~F.col("fits") & (F.col("d") < KEY_BITS)).alias("over")))


def _first_depth(total: int, limit: int) -> int:
    return min(KEY_BITS, max(1, (max(0, total // limit)).bit_length() + SLACK_BITS))


def extendible_shards(docs: DataFrame, limit_bytes: int = SHARD_BYTES, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, depth, prefix, page, shard, shard_bytes, shard_docs.

    ``shard`` names the bucket by its bits ('' for the undivided directory), plus ``.page`` where
    equal rows overflow. ``shard_bytes`` and ``shard_docs`` describe the whole bucket.
    """
    spark = docs.sparkSession
    units = materialize(hash_units(docs, id_col, text_col), "shard-units")
    total = units.agg(F.sum(F.col("n_bytes") * F.col("n"))).first()[0] or 0
    base, depth, done, rest = 0, _first_depth(total, limit_bytes), None, units
    while True:
        nodes = materialize(_split(rest, limit_bytes, base, depth), "shard-nodes")
        cells = nodes.withColumn("cells", F.expr(f"shiftleft(1L, {depth} - d)"))
        # a leaf covers 2^(depth-d) cells of this round; units find theirs by trying each depth that occurs
        depths = [r[0] for r in cells.select("d").distinct().collect()]
        tried = rest.withColumn("d", F.explode(F.array(*[F.lit(d) for d in sorted(depths)]))) if depths else None
        if tried is None:
            break
        tried = tried.withColumn("p", F.expr(f"shiftright(h, {KEY_BITS} - d)"))
        placed = tried.join(nodes, ["d", "p"])
        found = placed.where(~F.col("over")).drop("over")
        done = found if done is None else done.unionByName(found)
        if depth >= KEY_BITS or not nodes.where("over").take(1):
            break
        rest = materialize(placed.where("over").select(*units.columns), "shard-over")
        base, depth = depth, min(KEY_BITS, depth + ROUND_BITS)
    if done is None:
        done = units.select("*", F.lit(0).alias("d"), F.lit(0).cast("long").alias("p"),
                            F.lit(0).cast("long").alias("shard_bytes"), F.lit(0).cast("long").alias("shard_docs"))
    per_page = F.greatest(F.lit(1), F.expr(f"CAST({limit_bytes} DIV greatest(n_bytes, 1) AS BIGINT)"))
    overflow = (F.col("d") == KEY_BITS) & (F.col("shard_bytes") > limit_bytes) & (F.col("shard_docs") > 1)
    blocks = (done.withColumn("block", F.explode(F.expr(f"sequence(0L, (n - 1) DIV {BLOCK})")))
              .withColumn("i", F.explode(F.expr(f"sequence(block * {BLOCK}, least(n, (block + 1) * {BLOCK}) - 1)"))))
    page = F.when(overflow, F.floor(F.col("i") / per_page)).otherwise(F.lit(0)).cast("long")
    bits = F.when(F.col("d") > 0, F.lpad(F.conv(F.col("p").cast("string"), 10, 2), F.col("d"), F.lit("0"))).otherwise(F.lit(""))
    out = blocks.withColumn("page", page)
    return out.select(F.col("id").alias(id_col), "n_bytes", F.col("d").cast("int").alias("depth"), F.col("p").alias("prefix"),
                      "page", F.when(overflow, F.concat(bits, F.lit("-"), "unit", F.lit("."), F.col("page").cast("string"))).otherwise(bits).alias("shard"),
                      "shard_bytes", "shard_docs")


def write_shards(docs: DataFrame, shards: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` with one folder per shard (rows of a shard meet in one task, at most a shard's bytes).

    A row finds its shard by null-safe id and the key's prefix; copies on overflow pages are numbered.
    """
    text_md5 = F.coalesce(F.md5(F.col(text_col)), F.lit("-"))
    unit = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit(":"), text_md5))
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(id_col)
    rows = docs.withColumns({"shard key": unit}).toDF(*names, "unit")
    rows = rows.withColumn("h", F.conv(F.substring("unit", 1, KEY_BITS // 4), 16, 10).cast("long"))
    pages = (shards.groupBy(F.col(id_col).alias("s_id"), "depth", "prefix", "shard").agg(F.count(F.lit(1)).alias("n"))
             .withColumn("s_unit", F.regexp_extract("shard", r"-([0-9a-f]{32})\.", 1))
             .withColumn("base", F.regexp_extract("shard", r"^([^.]*)", 1)))
    leaves = pages.groupBy("s_id", "depth", "prefix", "s_unit", "base").agg(F.max("n").alias("per_page"))
    placed = rows.join(leaves, F.col(names[at]).eqNullSafe(F.col("s_id")) & F.expr(f"shiftright(h, {KEY_BITS} - depth) = prefix")
                       & F.expr("s_unit IN ('', unit)"))
    placed = materialize(placed.select(*names, "unit", "s_unit", "base", "per_page", F.monotonically_increasing_id().alias("m"))
                         .withColumn("part", F.shiftright("m", 33)), "shard-rows")
    # copies are numbered inside each part, after those of the parts before
    over = placed.where("s_unit <> ''")
    before = (over.groupBy("unit", "part").agg(F.count(F.lit(1)).alias("k"))
              .withColumn("before", F.sum("k").over(Window.partitionBy("unit").orderBy("part")) - F.col("k")).drop("k"))
    over = (over.withColumn("i", F.row_number().over(Window.partitionBy("unit", "part").orderBy("m")) - 1).join(before, ["unit", "part"])
            .withColumn("shard", F.expr("concat(base, '.', CAST((before + i) DIV per_page AS STRING))")))
    out = placed.where("s_unit = ''").withColumn("shard", F.col("base")).select(*names, "shard").unionByName(over.select(*names, "shard"))
    out = out.toDF(*docs.columns, "shard")
    out.repartition("shard").sortWithinPartitions("shard").write.partitionBy("shard").parquet(path)


SQL = f"""
WITH units AS (
  SELECT doc_id, unit, n_bytes, count(*) AS n, CAST('0x' || substr(unit, 1, 15) AS BIGINT) AS h
  FROM (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
               md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(md5(text), '-')) AS unit FROM documents)
  GROUP BY ALL),
nodes AS (
  SELECT d, h >> ({KEY_BITS} - d) AS p, sum(n_bytes * n) AS b, sum(n) AS k
  FROM units, range(0, {KEY_BITS + 1}) r(d) GROUP BY ALL),
marked AS (
  SELECT c.d, c.p, c.b, c.k, (c.b <= {SHARD_BYTES} OR c.k = 1 OR c.d = {KEY_BITS}) AS fits,
         coalesce(u.b <= {SHARD_BYTES} OR u.k = 1, false) AS parent_fits
  FROM nodes c LEFT JOIN nodes u ON u.d = c.d - 1 AND u.p = c.p >> 1),
leaves AS (SELECT * FROM marked WHERE fits AND NOT parent_fits),
placed AS (
  SELECT u.*, l.d, l.p, l.b, l.k, unnest(range(u.n)) AS i,
         (l.d = {KEY_BITS} AND l.b > {SHARD_BYTES} AND l.k > 1) AS overflow
  FROM units u JOIN leaves l ON l.p = u.h >> ({KEY_BITS} - l.d)),
paged AS (
  SELECT *, CASE WHEN overflow THEN i // greatest(1, {SHARD_BYTES} // greatest(n_bytes, 1)) ELSE 0 END AS page,
         CASE WHEN d > 0 THEN lpad(bin(p), CAST(d AS INTEGER), '0') ELSE '' END AS bits FROM placed)
SELECT doc_id, n_bytes, CAST(d AS INTEGER) AS depth, p AS prefix, CAST(page AS BIGINT) AS page,
       CASE WHEN overflow THEN bits || '-' || unit || '.' || page ELSE bits END AS shard,
       CAST(b AS BIGINT) AS shard_bytes, CAST(k AS BIGINT) AS shard_docs
FROM paged
"""
