import random

import numpy as np
import pytest

from tidemark.llm import ngram_join as J
from tidemark.llm.components import components


def shingles(text, words):
    w = tuple((text or "").encode().lower().split())
    if not w:
        return frozenset()
    return frozenset([w] if len(w) < words else [w[k:k + words] for k in range(len(w) - words + 1)])


def brute(rows, words=4, percent=85):
    """(id, set size, smallest id reachable) by comparing every pair."""
    sets = [shingles(t, words) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    label[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            r = find(k)
            least[r] = min(least.get(r, i), i)
    return sorted((str(i), len(s), str(least.get(find(k)) if s else i)) for k, ((i, _), s) in enumerate(zip(rows, sets)))


def got(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in df.collect())


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


def test_equals_all_pairs_on_planted_families(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = ["", None, " ", "one", "One", "two words", "a b c", "a b c d"]
    for size in (5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 45, 80, 150):
        base = rng.choices(vocabulary, k=size)
        texts += family(rng, base, 12, max(1, size // 40 + 1))
        texts += [" ".join(base[:-1]), " ".join(base[1:]), " ".join(base + ["x"])]
    passage = rng.choices(vocabulary, k=50)
    texts += [" ".join(rng.choices(vocabulary, k=rng.randint(1, 30)) + passage) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(J.jaccard_digest(df)) == brute(rows)


def test_equals_all_pairs_on_documents(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert got(J.jaccard_components(documents, 5, 80)) == brute(rows, 5, 80)


def test_odd_rows(odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(J.jaccard_digest(odd)) == brute(rows)
    assert J.jaccard_digest(nothing).count() == 0
    kept = J.keep_one(odd)
    assert kept.columns == odd.columns
    # the copies of 1 and 8 leave one row; rows without words all stay
    assert kept.where("text like 'plain%'").collect()[0]["doc_id"] == 1
    assert kept.where("text like 'plain%'").count() == 1 and kept.count() == odd.count() - 2


def test_signatures_miss_no_pair():
    """Any two sets within the band's difference share a signature."""
    rng = np.random.default_rng(11)
    starts = J.band_starts(600)
    for size in (6, 7, 9, 13, 20, 33, 60, 140, 400):
        band = int(np.searchsorted(starts, size, side="right")) - 1
        for population in (10, 10 ** 5, 10 ** 9):
            plan = J.allocate(starts, band, population)
            if plan is None:
                continue
            for _ in range(60):
                a = np.unique(rng.integers(0, 2 ** 63, size=size, dtype=np.uint64))
                top = min(starts[band + 2] - 1, size * 100 // 85)
                differ = J.max_difference(size, top)
                drop = int(rng.integers(0, differ + 1))
                b = np.unique(np.concatenate((a[drop // 2:], rng.integers(0, 2 ** 63, size=drop - drop // 2, dtype=np.uint64))))
                common = len(np.intersect1d(a, b))
                if 100 * common >= 85 * (len(a) + len(b) - common):
                    # also when some, many or all of the shared shingles are common ones
                    for often in (0, 0.3, 0.9, 1):
                        left_out = np.sort(a[rng.random(len(a)) < often])
                        x = np.concatenate(J.signatures(a, band, plan, common=left_out))
                        y = np.concatenate(J.signatures(b, band, plan, common=left_out))
                        assert len(np.intersect1d(x, y))


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)]
    label = {}

    def find(x):
        label.setdefault(x, x)
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    out = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {x: find(x) for a, b in links if a != b for x in (a, b)}


def test_common_shingles_are_counted_over_every_text(spark):
    """a sample of the documents decided before."""
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(i, f"{passage} own{i} text{i} of{i} document{i} number{i}" if i % 3 else f"alone{i} a{i} b{i} c{i} d{i}") for i in range(60)]
    told = J.shingle_sets(spark.createDataFrame(rows + rows[:1], "doc_id long, text string").coalesce(1))
    assert told.where("part = 0").count() == 61
    shingle = J.Shingler()
    sets = [shingle(t) for _, t in rows]
    found = J.common_shingles(told.where("part = 1"), len(sets), sum(map(len, sets)))
    expected = np.bincount(np.concatenate([J._cell(s) for s in sets]), minlength=1 << J.CELL_BITS)
    assert (found == (expected >= J.LEAST_COMMON + sum(map(len, sets)) / (1 << J.CELL_BITS))).all()
    assert J._is_common(shingle(passage), found).all()


def test_words_of_pieces_are_those_of_the_text(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("aAbBé \t\n\x0b\x1c") for _ in range(rng.randint(0, 80))) for _ in range(200)]
    whole = [J.Shingler().word_hashes(t) for t in texts]
    seen = {}
    for t, hashes in zip(texts, whole):
        words = t.encode().lower().split()
        assert len(words) == len(hashes)
        assert all(seen.setdefault(w, int(h)) == int(h) for w, h in zip(words, hashes))
    assert len(set(seen.values())) == len(seen)
    monkeypatch.setattr(J, "PIECE", 5)
    assert all((J.Shingler().word_hashes(t) == w).all() for t, w in zip(texts, whole))
