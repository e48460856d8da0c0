import hashlib

import numpy as np

from tidemark.llm import fingerprints as P


def brute_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))


def test_digest_against_a_plain_loop(documents):
    rows = brute_order([(r["doc_id"], r["text"] or "") for r in documents.collect()])
    out = {r["doc_id"]: r for r in P.fingerprint_digest(documents).collect()}
    assert len(out) == len(rows)
    alone = {r["doc_id"]: r["fingerprint"] for r in P.fingerprint(documents).collect()}
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        changed = text[:len(text) - half] + following[:half]
        r = out[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        sets = P.phrase_sets([text, changed, following])
        assert r["fingerprint"] == P.shown(sets[0]) == alone[i] and r["edited_fingerprint"] == P.shown(sets[1])
        assert r["near_edited"] == P.likeness(sets[0], sets[1]) and r["near_next"] == P.likeness(sets[0], sets[2])


def test_edited_texts_are_nearer_than_others(documents):
    out = P.fingerprint_digest(documents).where("n_chars > 400").collect()
    assert sum(r["near_edited"] > r["near_next"] for r in out) / len(out) > 0.97


def test_equal_substrings_share_interior_names():
    rng = np.random.default_rng(3)
    letters = list("abcdefgh ")
    middle = "".join(rng.choice(letters, 600))
    one, two = "".join(rng.choice(letters, 37)) + middle, "".join(rng.choice(letters, 222)) + middle + "tail of another kind"

    def names(text, level):
        x = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        n, s = P._mix(x.astype(np.uint64) + np.uint64(1)), np.array([0, len(x)])
        for _ in range(level):
            n, s = P.parse_level(n, s)
        return n

    for level in (1, 2, 3):
        a, b = names(one, level), names(two, level)
        inside = np.isin(a, b).mean()
        assert inside > (0.9, 0.85, 0.6)[level - 1]
    assert 1.5 < len(one) / len(names(one, 1)) < 5


def test_parse_does_not_depend_on_its_neighbours_in_the_batch():
    texts = ["", "a", "aaaa", "abab" * 9, "the quick brown fox " * 5, "é" * 7 + "xyz"]
    together = P.phrase_sets(texts)
    for t, s in zip(texts, together):
        assert (P.phrase_sets([t])[0] == s).all()


def test_odd_rows(spark, odd, nothing):
    out = P.fingerprint_digest(odd).collect()
    assert len(out) == odd.count()
    empty = [r for r in out if r["n_chars"] == 0]
    assert all(r["fingerprint"] == "" and r["near_edited"] == 1.0 for r in empty)
    assert len({r["fingerprint"] for r in out if r["doc_id"] in (1, 8)}) == 1
    assert P.fingerprint_digest(nothing).count() == 0
    one = spark.createDataFrame([(1, "only one document here, and a short one")], "doc_id long, text string")
    r = P.fingerprint_digest(one).collect()[0]
    assert r["near_next"] == 1.0
