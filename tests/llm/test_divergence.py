import re
from collections import Counter, defaultdict

from tidemark.llm import divergence as D

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_df=D.MIN_DF, top=D.TOP_TERMS):
    """Every text by itself, every pair and term in full."""
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        words = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        counts[lang, source].update(words)
        df[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in df[lang].items() if n >= min_df]
        sources = sorted(s for x, s in groups if x == lang)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10 ** 9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            term = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                order = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(order[:most])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_equals_brute_force(documents, monkeypatch):
    rows = [(r["text"], r["lang"], r["source"]) for r in documents.collect()]
    want = brute(rows)
    assert rows_of(D.divergence(documents)) == want
    monkeypatch.setattr(D, "ENTRIES", 40)  # sums handed on again and again, pair blocks of a few cells
    monkeypatch.setattr(D, "PAIR_CELLS", 50)
    assert rows_of(D.divergence(documents)) == want


def test_copies_over_sources_and_letters_beyond_ascii(spark):
    rows = [("Éa ÉA éa x", "fr", "s1"), ("same text Same", "fr", "s1"), ("same text Same", "fr", "s2"), ("same text Same", "fr", "s2"),
            ("same text Same", "en", "s2"), ("éa 中文 x-x", "fr", None), ("éa 中文", "fr", "s3"), ("123 !", "fr", "s4"), (None, "fr", "s5"),
            ("", None, None), ("ÄÖ éa Straße", "fr", "s3"), ("one", "xx", "a"), ("two", "xx", "b")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert rows_of(D.divergence(docs)) == brute(rows)
    assert rows_of(D.divergence(docs, min_df=1, top_terms=2)) == brute(rows, 1, 2)


def test_odd_rows_and_nothing(odd, nothing):
    assert rows_of(D.divergence(odd)) == brute([(r["text"], r["lang"], r["source"]) for r in odd.collect()])
    assert D.divergence(nothing).collect() == []


def test_a_text_is_sent_and_cut_once(spark):
    docs = spark.createDataFrame([("the same text", "en", f"s{i % 3}") for i in range(3000)], "text string, lang string, source string").coalesce(2)
    rows = D.collapse(docs).collect()
    assert sum(r["copies"] for r in rows) == 3000
    assert sum(r["text"] is not None for r in rows) <= 2 and len(rows) <= 8
    counts = {(r["term"], r["source"]): r["n"] for r in D.term_counts(D.collapse(docs)).collect()}
    assert counts == {(t, f"s{i}"): 1000 for t in ("the", "same", "text") for i in range(3)}
    assert sum(r["d"] for r in D.term_counts(D.collapse(docs)).collect()) == 9000
