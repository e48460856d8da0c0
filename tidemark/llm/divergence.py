"""Divergence of the sources of each language by their terms, counted over collapsed duplicate texts.

1. ``collapse``: equal texts of a language become one row with the number of copies per source. Each
   task sends a text once (its repeats as counts), so a text that a third of all rows share costs one
   row per task; the rows of a text meet by (lang, SHA-256 of the text).
2. ``term_counts``: each collapsed text is cut into terms once; its document frequency and its counts
   per source are added with the number of copies as weights, per task first, then by Spark.
3. ``kept_terms``: per language, the terms in at least ``min_df`` documents.
4. ``divergence``: with p the smoothed share of a term in a group (a source of a language, or the
   whole language) the value of a term is (p - q)^2 / q, rounded down. A pair of sources is evaluated
   sparsely: the value of a term in neither is one constant, terms in one of the two enter by the
   histogram of that source's counts, and only terms in both are looked at together, a block of
   terms at a time.

All numbers are exact integers. Edge cases: null text, lang and source count as ''; empty texts and
texts without terms belong to their group and have no term; a language without kept terms gives each
pair the value 0; one source alone gives no pair; repeated rows count each; equal values are ordered by
the item's UTF-8 bytes; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import materialize

SCALE = 1_000_000_000
MIN_DF = 3
TOP_TERMS = 200
#: Entries that a task holds before it hands its sums on.
ENTRIES = 400_000
PAIR_CELLS = 2 << 20

_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_COLLAPSED = "lang string, h binary, source string, copies long, text string"
_COUNTS = "lang string, term string, source string, n long, d long"


def terms(text: str) -> list[bytes]:
    """Terms in order: runs of ASCII letters (lower-cased) and characters beyond ASCII, as UTF-8."""
    return text.encode().translate(_TERM_BYTES).split()


def collapse(docs: DataFrame) -> DataFrame:
    """Rows (lang, h, source, copies, text), rows of one text behind each other in one partition.

    A text stands in at least one row of its (lang, h); the copies of all its rows add up.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, again = set(), Counter()

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
                zip(*found) if found else [[]] * 5, (pa.string(), pa.binary(), pa.string(), pa.int64(), pa.string()))],
                names=["lang", "h", "source", "copies", "text"])

        for batch in batches:
            found = []
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                h = hashlib.sha256(text.encode()).digest()
                if (lang, h) in seen:
                    again[lang, h, source] += 1
                else:
                    seen.add((lang, h))
                    found.append((lang, h, source, 1, text))
            yield out(found)
            if len(seen) + len(again) > ENTRIES:
                yield out([(*key, n, None) for key, n in again.items()])
                seen, again = set(), Counter()
        yield out([(*key, n, None) for key, n in again.items()])

    return rows.mapInArrow(combine, _COLLAPSED).repartition("lang", "h").sortWithinPartitions("lang", "h")


def term_counts(collapsed: DataFrame) -> DataFrame:
    """(lang, term, source, n, d): occurrences in a source, and documents (entered under one of a text's sources)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, Counter] = defaultdict(Counter)
        d: dict[str, Counter] = defaultdict(Counter)
        key, text, copies = None, None, Counter()

        def close():
            if not text:
                return
            words, total = terms(text), sum(copies.values())
            home = min(copies)
            if total == 1:
                n[home].update(words)
                d[home].update(set(words))
                return
            for word, times in Counter(words).items():
                d[home][word] += total
                for source, some in copies.items():
                    n[source][word] += some * times

        def out(lang):
            for source, counts in n.items():
                df = d[source]
                words = list(counts)
                for at in range(0, len(words), 50_000):
                    part = words[at:at + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()),
                         pa.array([source] * len(part), pa.string()), pa.array([counts[w] for w in part], pa.int64()),
                         pa.array([df[w] for w in part], pa.int64())], names=["lang", "term", "source", "n", "d"])
            n.clear()
            d.clear()

        for batch in batches:
            for lang, h, source, some, body in zip(*(batch.column(c).to_pylist() for c in ("lang", "h", "source", "copies", "text"))):
                if (lang, h) != key:
                    close()
                    if key and (lang != key[0] or sum(map(len, n.values())) > ENTRIES):
                        yield from out(key[0])
                    key, text, copies = (lang, h), None, Counter()
                text = body if text is None else text
                copies[source] += some
        close()
        if key:
            yield from out(key[0])

    return collapsed.mapInArrow(count, _COUNTS)


def kept_terms(counts: DataFrame, min_df: int = MIN_DF) -> DataFrame:
    """(lang, term, source, n, all_n) of the terms in at least ``min_df`` documents of their language;
    all_n is the term's count in the language.

    One shuffle by (lang, term): the sums by source and by language and the document frequency need no other.
    """
    sums = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    by = Window.partitionBy("lang", "term")
    return sums.withColumns({"df": F.sum("d").over(by), "all_n": F.sum("n").over(by)}).where(F.col("df") >= min_df) \
        .select("lang", "term", "source", "n", "all_n")


def _share(n: str | Column, total: str, v: str) -> Column:
    """1 + floor(SCALE (n + 1) / (N + V)), exact (a language without kept terms has no shares, only a row)."""
    n = F.col(n) if isinstance(n, str) else n
    top = (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return _floor_div(top, F.greatest(F.col(total) + F.col(v), F.lit(1))) + 1


def _floor_div(a: Column, b: Column) -> Column:
    """a div b for numbers not below 0, as bigint."""
    return F.call_function("div", a.cast("decimal(38,0)"), b.cast("decimal(20,0)"))


def _value(p: Column, q: Column) -> Column:
    """(p - q)^2 div q; below 2^63, as shares are at most SCALE + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, sid, total, v, s_total): every occurring source of every language with its number of
    occurrences of kept terms, the language's number of terms and of occurrences; sid numbers a language's sources."""
    some = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    v = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    by = Window.partitionBy("lang")
    zero = F.lit(0).cast("long")
    return (some.join(totals, ["lang", "source"], "left").join(v, "lang", "left")
            .withColumns({"total": F.coalesce("total", zero), "v": F.coalesce("v", zero)})
            .withColumn("s_total", F.sum("total").over(by))
            .withColumn("sid", F.row_number().over(by.orderBy("source")).cast("int")))


def _with_shares(kept: DataFrame, found: DataFrame) -> DataFrame:
    return kept.join(found, ["lang", "source"]).select(
        "lang", "term", "source", "sid", _share("n", "total", "v").alias("p"), _share(F.lit(0), "total", "v").alias("p0"),
        _share("all_n", "s_total", "v").alias("q"))


def _both(shares: DataFrame) -> DataFrame:
    """(lang, a, b, value): over the terms in both sources, what the sparse sums of ``_pairs`` count wrongly."""
    rows = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("sid", "p", "p0")).alias("z")) \
        .where(F.size("z") > 1).select("lang", F.col("z.sid").alias("sid"), F.col("z.p").alias("p"), F.col("z.p0").alias("p0"))

    def f(p, q):
        return (p - q) ** 2 // q

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        held: dict[tuple[str, int], list] = defaultdict(list)
        sizes: Counter = Counter()

        def out(lang, z):
            sid, p, p0 = (np.stack(x) for x in zip(*held.pop((lang, z))))
            sizes.pop((lang, z))
            width = int(sid.max()) + 1
            step = max(1, PAIR_CELLS // (len(sid) * z))
            for at in range(0, z, step):  # rows of the pair matrix, so that a block stays small
                s, ps, p0s = (x[:, at:at + step, None] for x in (sid, p, p0))
                t, pt, p0t = (x[:, None, :] for x in (sid, p, p0))
                value = f(ps, pt) - f(ps, p0t) - f(p0s, pt) + f(p0s, p0t)
                code, place = np.unique((s * width + t).ravel(), return_inverse=True)
                sums = np.zeros(len(code), dtype=np.int64)
                np.add.at(sums, place, value.ravel())
                keep = code // width != code % width
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * int(keep.sum()), pa.string()), pa.array((code // width)[keep].astype("int32")),
                     pa.array((code % width)[keep].astype("int32")), pa.array(sums[keep])], names=["lang", "a", "b", "value"])

        for batch in batches:
            cols = [batch.column(c) for c in ("sid", "p", "p0")]
            at = cols[0].offsets.to_numpy()
            flat = [c.values.to_numpy(zero_copy_only=False).astype(np.int64) for c in cols]
            for i, lang in enumerate(batch.column("lang").to_pylist()):
                key = (lang, int(at[i + 1] - at[i]))
                held[key].append([x[at[i]:at[i + 1]] for x in flat])
                sizes[key] += key[1] ** 2
                if sizes[key] > PAIR_CELLS or len(held[key]) >= 10_000:
                    yield from out(*key)
        for key in list(held):
            yield from out(*key)

    return rows.mapInArrow(evaluate, "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("both"))


def _pairs(shares: DataFrame, found: DataFrame) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of a language's sources."""
    p0 = _share(F.lit(0), "total", "v")
    a = found.select("lang", F.col("source"), F.col("sid").alias("a"), "v", p0.alias("p0a"))
    b = found.select("lang", F.col("source").alias("item"), F.col("sid").alias("b"), p0.alias("p0b"))
    pairs = a.join(b, "lang").where(F.col("a") != F.col("b"))
    histogram = shares.groupBy("lang", "sid", "p").agg(F.count(F.lit(1)).alias("m"))
    none = _value(F.col("p0a"), F.col("p0b"))
    left = histogram.withColumnRenamed("sid", "a").join(pairs, ["lang", "a"]).groupBy("lang", "a", "b").agg(
        F.sum(F.col("m") * (_value(F.col("p"), F.col("p0b")) - none)).alias("left"))
    right = histogram.withColumnRenamed("sid", "b").join(pairs, ["lang", "b"]).groupBy("lang", "a", "b").agg(
        F.sum(F.col("m") * (_value(F.col("p0a"), F.col("p")) - none)).alias("right"))
    zero = F.lit(0).cast("long")
    keys = ["lang", "a", "b"]
    return pairs.join(left, keys, "left").join(right, keys, "left").join(_both(shares), keys, "left").select(
        "lang", "source", "item", (F.col("v") * none + F.coalesce("left", zero) + F.coalesce("right", zero)
                                   + F.coalesce("both", zero)).alias("value"))


def _language_terms(shares: DataFrame) -> DataFrame:
    """(lang, source, item, value): terms more frequent in the source than in its language."""
    return shares.where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"),
                                                        _value(F.col("p"), F.col("q")).alias("value"))


def divergence(docs: DataFrame, min_df: int = MIN_DF, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the other sources of the language by their
    divergence, part ``term`` the ``top_terms`` terms in which a source exceeds its language."""
    kept = materialize(kept_terms(term_counts(collapse(docs)), min_df), "source-terms")
    found = materialize(groups(docs, kept), "sources")
    shares = _with_shares(kept, found)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    pairs = _pairs(shares, found).withColumn("rank", rank)
    best = _language_terms(shares).withColumn("rank", rank).where(F.col("rank") <= top_terms)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(best.withColumn("part", F.lit("term")).select(*columns))


#: DuckDB: every text is cut by itself, and every pair and term is evaluated in full.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {MIN_DF}),
k AS (SELECT * FROM c JOIN kept USING (lang, term)),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY ALL),
t AS (SELECT g.lang, g.source, coalesce(sum(k.n), 0)::HUGEINT AS total, coalesce(any_value(v.v), 0) AS v
      FROM g LEFT JOIN k USING (lang, source) LEFT JOIN v ON v.lang = g.lang GROUP BY ALL),
s AS (SELECT lang, sum(total)::HUGEINT AS total FROM t GROUP BY ALL),
p AS (SELECT t.lang, t.source, kept.term, coalesce(k.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(k.n, 0) + 1)) // (t.total + t.v) AS p
      FROM t JOIN kept ON kept.lang = t.lang LEFT JOIN k ON k.lang = t.lang AND k.source = t.source AND k.term = kept.term),
q AS (SELECT k.lang, k.term, 1 + ({SCALE}::HUGEINT * (sum(k.n)::HUGEINT + 1)) // (any_value(s.total) + any_value(v.v)) AS q
      FROM k JOIN s ON s.lang = k.lang JOIN v ON v.lang = k.lang GROUP BY ALL),
pv AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
       FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(pv.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, ((p.p - q.q) * (p.p - q.q) // q.q)::BIGINT AS value
          FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value,
                  row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
           UNION ALL
           SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
