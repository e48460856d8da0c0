from collections import Counter, defaultdict
from hashlib import md5

from tidemark.llm import sharding as S


def brute(rows, limit):
    """Directory of prefixes, split one bit at a time."""
    keyed = defaultdict(list)
    for i, text in rows:
        unit = md5(f"{'-' if i is None else i}:{'-' if text is None else md5(text.encode()).hexdigest()}".encode()).hexdigest()
        keyed[""].append((i, len((text or "").encode()), f"{int(unit[:15], 16):060b}", unit))
    done = {}
    while keyed:
        prefix, group = keyed.popitem()
        if sum(r[1] for r in group) <= limit or len(group) == 1 or len(prefix) == 60:
            done[prefix] = group
            continue
        for r in group:
            keyed[r[2][:len(prefix) + 1]].append(r)
    out = Counter()
    for prefix, group in done.items():
        size = sum(r[1] for r in group)
        over = len(prefix) == 60 and size > limit and len(group) > 1
        seen = Counter()
        for i, n, _, unit in group:
            page = seen[unit] // max(1, limit // max(n, 1)) if over else 0
            seen[unit] += 1
            shard = f"{prefix}-{unit}.{page}" if over else prefix
            out[(i, n, len(prefix), page, shard, size, len(group))] += 1
    return out


def got(df):
    return Counter((r["doc_id"], r["n_bytes"], r["depth"], r["page"], r["shard"], r["shard_bytes"], r["shard_docs"]) for r in df.collect())


def test_equals_bit_by_bit_splitting(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    for limit in (1 << 14, 1 << 17, 1 << 40):
        assert got(S.extendible_shards(documents, limit)) == brute(rows, limit)


def test_only_oversized_buckets_split(documents):
    out = S.extendible_shards(documents, 1 << 15)
    sizes = out.groupBy("shard").agg({"n_bytes": "sum", "*": "count"}).collect()
    assert all(r["sum(n_bytes)"] <= 1 << 15 or r["count(1)"] == 1 for r in sizes)


def test_odd_rows_and_overflow_pages(spark, odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(S.extendible_shards(odd, 100)) == brute(rows, 100)
    copies = spark.createDataFrame([(9, "same text again")] * 25, "doc_id long, text string")
    out = S.extendible_shards(copies, 60)
    assert got(out) == brute([(9, "same text again")] * 25, 60)
    assert max(r["count"] for r in out.groupBy("shard").count().collect()) == 4
    assert S.extendible_shards(nothing).count() == 0


def test_written_shards_hold_their_documents(tmp_path, spark, documents):
    out = S.extendible_shards(documents, 1 << 16)
    S.write_shards(documents, out, str(tmp_path / "shards"))
    back = spark.read.option("basePath", str(tmp_path / "shards")).schema(documents.schema).parquet(str(tmp_path / "shards"))
    assert back.count() == documents.count()


def test_written_shards_keep_null_and_repeated_ids(tmp_path, spark, odd):
    rows = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(9, "same text again")] * 25, "doc_id long, text string"))
    out = S.extendible_shards(rows, 60)
    S.write_shards(rows, out, str(tmp_path / "shards"))
    back = spark.read.schema("doc_id long, text string, shard string").parquet(str(tmp_path / "shards"))
    assert Counter(tuple(r) for r in back.select("doc_id", "text").collect()) == Counter(tuple(r) for r in rows.collect())
    assert Counter(r["shard"] or "" for r in back.collect()) == Counter(r["shard"] for r in out.collect())
