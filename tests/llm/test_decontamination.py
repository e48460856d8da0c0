import random

import numpy as np

from tidemark.llm import decontamination as D


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], max(row[j + 1], row[j]) if x != y else last + 1
    return row[-1]


def test_lcs():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 70))] for _ in range(2))
        assert D.lcs(a, b) == plain_lcs(a, b)


def test_finds_every_item_and_nothing_else(spark, documents):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r["item_id"], " ".join(D.words_of(r["text"]))) for r in benchmark.collect()]
    want = {(r["doc_id"], i) for r in documents.collect() for i, t in items
            if f" {t} " in f" {' '.join(D.words_of(r['text']))} "}
    out = D.leaks_digest(documents, benchmark).collect()
    assert want and {(r["doc_id"], r["item_id"]) for r in out} == want
    assert all(r["overlap"] == 1 and 0 < r["cosine"] < 1.001 for r in out)
    kept = D.clean(documents, benchmark)
    assert kept.columns == documents.columns
    assert {r["doc_id"] for r in documents.collect()} - {r["doc_id"] for r in kept.collect()} == {d for d, _ in want}


def test_edited_copies_and_paraphrases(spark):
    rng = random.Random(2)
    vocabulary = [f"term{i}" for i in range(3000)]
    items = [[rng.choice(vocabulary) for _ in range(40)] for _ in range(20)]
    benchmark = spark.createDataFrame([(k, " ".join(w[:34]) + ". " + " ".join(w[34:])) for k, w in enumerate(items)],
                                      "item_id long, text string")
    rows, want = [], set()
    for k, w in enumerate(items):
        noise = lambda n: [rng.choice(vocabulary) for _ in range(n)]
        light = [x if rng.random() > 0.2 else rng.choice(vocabulary) for x in w]
        # half the words replaced, but the answer given
        heavy = [x if j % 2 or j >= 34 else rng.choice(vocabulary) for j, x in enumerate(w)]
        rows += [(3 * k, " ".join(noise(100) + light + noise(50))), (3 * k + 1, " ".join(noise(30) + heavy + noise(90))),
                 (3 * k + 2, " ".join(noise(300)))]
        want |= {(3 * k, k), (3 * k + 1, k)}
    out = D.leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out} == want


def test_long_items_and_unspaced_scripts(spark):
    rng = random.Random(3)
    vocabulary = [f"term{i}" for i in range(4000)]
    noise = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = {k: noise(n) for k, n in enumerate((100, 200, 250, 300, 400, 600, 1000))}
    items[10] = "".join(chr(rng.randrange(0x4e00, 0x5e00)) for _ in range(40))
    items[11] = noise(12)
    part = items[5].split()
    rows = [(k, f"{noise(70)} {t} {noise(50)}") for k, t in items.items() if k != 10]
    rows += [(10, "".join(chr(rng.randrange(0x4e00, 0x5e00)) for _ in range(55)) + items[10] + "".join(chr(rng.randrange(0x4e00, 0x5e00)) for _ in range(30))),
             (20, " ".join(part[:420])), (21, noise(30) + " " + " ".join(part[:200])), (22, noise(1500)), (23, items[10][:15])]
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    out = D.leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out} == {(k, k) for k in items} | {(20, 5)}
    assert all(r["overlap"] == 1 for r in out if r["doc_id"] < 20)


def test_latent_space_equals_a_dense_svd(spark, documents):
    benchmark = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    items = D.Items(benchmark)
    items.weigh(*D.document_frequency(documents, frozenset(items.terms)))
    kept = D.materialize(D.passages(documents, items), "test-passages")
    space = D.latent_space(kept, items, rank=len(items.terms))
    assert np.allclose(space.T @ space, np.eye(space.shape[1]), atol=1e-8)
    full = items.vectors() @ space @ space.T
    assert np.allclose(full, items.vectors(), atol=1e-6)


def test_odd_rows(spark, odd, nothing):
    benchmark = spark.createDataFrame([(1, "plain text of a few words in a row"), (2, None), (3, ""), (4, "too short"),
                                       (1, "plain text of a few words in a row")], "item_id long, text string")
    out = D.leaks_digest(odd, benchmark).collect()
    assert {r["doc_id"] for r in out} == {1, 8} and {r["item_id"] for r in out} == {1}
    assert D.clean(odd, benchmark).columns == odd.columns
    assert D.leaks_digest(nothing, benchmark).count() == 0
    assert D.leaks_digest(odd, benchmark.limit(0)).count() == 0
