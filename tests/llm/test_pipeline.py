import zlib

import corpus_pipeline as C
from tidemark.llm import decontamination as D, language_id as L, pii as P
from tidemark.llm.queries import QUERIES, oracles
from test_ngram_join import shingles
from test_pii import plain
from test_tokens import expected


def test_stages_against_plain_python(spark, documents):
    sf = "/root/testdata/sf0.001"
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = {r["doc_id"]: r["text"] for r in documents.collect()}
    profiles = L.fit_profiles(documents)
    table = L._sorted(profiles)
    rows = {i: t for i, t in rows.items() if L._judge(t, list(profiles), table, L.PROFILE)[1] >= L.LEAST_SCORE}
    ids = sorted(rows)
    sets = {i: shingles(rows[i], C.WORDS) for i in ids}
    label = {i: i for i in ids}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in ids:
        for b in ids:
            if b < a and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= C.PERCENT * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    label[max(x, y)] = min(x, y)
    rows = {i: rows[i] for i in ids if find(i) == i}
    items = [" ".join(D.words_of(r["text"])) for r in benchmark.collect()]
    rows = {i: t for i, t in rows.items() if not any(f" {x} " in f" {' '.join(D.words_of(t))} " for x in items)}
    rows = {i: P.mask(t, plain(t)) for i, t in rows.items()}
    want = sorted((i, k // 4, zlib.crc32(b[k:k + 4 * 4096])) for i, b in expected(rows.items(), "word", 1)
                  for k in range(0, len(b), 4 * 4096))
    out = C.run(spark, sf)
    assert sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in out.collect()) == want


def test_stages_keep_the_columns(spark, documents, odd):
    docs = odd
    for name, stage in C.STAGES[:-1]:
        docs = C.materialize(stage(spark, docs, "/root/testdata/sf0.001"), f"test-{name}")
        assert docs.columns == odd.columns
    assert [n for n, _ in C.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "packing"]


def test_every_operator_is_registered():
    import __spark_entry__ as E
    names = E.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(names)
    assert set(oracles()) <= set(E.oracle_sql())
