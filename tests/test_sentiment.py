"""The learned lexicon against a plain restatement, and against labelled sentences it has not seen."""
import random
from collections import Counter, defaultdict

from tidemark.operators import sentiment as S
from tidemark.operators.news import OWN_LEXICON

GOOD = "soared climbed outperformed brightened robust upbeat thriving record rewarding".split()
BAD = "slumped tumbled faltered bleak woeful plunged mired troubled wobbled".split()
PLAIN = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(10)]


def corpus(r, n):
    up, down = ([w for w, v in OWN_LEXICON.items() if (v > 1) == sign and abs(v) > 1] for sign in (True, False))
    rows = []
    for k in range(n):
        words = [r.choice(PLAIN) for _ in range(r.randint(20, 60))]
        for _ in range(3):
            good = r.random() < .5
            i = r.randrange(len(words))
            words[i:i] = [r.choice(GOOD if good else BAD), r.choice(PLAIN), r.choice(up if good else down)]
        rows.append((k, " ".join(words)))
    return rows


def plain_lexicon(texts, seeds, rounds):
    known = {w: round(v * 1000) for w, v in seeds.items()}
    lexicon = dict(known)
    for _ in range(rounds):
        n, sides, total = Counter(), defaultdict(list), defaultdict(int)
        for text in texts:
            words = S.tokens(text)
            for j, w in enumerate(words):
                n[w] += 1
                some = [lexicon[words[i]] for i in range(len(words)) if i != j and abs(i - j) <= S.WINDOW and words[i] in lexicon]
                if sum(some):
                    sides[w].append(sum(some) > 0)
                total[w] += sum(some)
        found = {}
        for w in n:
            v = max(-S.STRONGEST, min(S.STRONGEST, int(total[w] / n[w])))
            if n[w] >= S.LEAST_COUNT and len(sides[w]) >= S.SUPPORT and abs(v) >= S.LEAST_VALENCE and w not in known and w not in S.NEGATIONS and w not in S.DEGREES \
                    and 100 * max(sides[w].count(True), sides[w].count(False)) >= S.AGREE * len(sides[w]):
                found[w] = v
        lexicon = known | found
    return lexicon


def test_lexicon_equals_the_plain_one_and_judges_unseen_sentences(spark, monkeypatch):
    r = random.Random(11)
    rows = corpus(r, 300) + [(900, None), (901, ""), (902, "!!!")]
    df = spark.createDataFrame(rows, "article_id long, text string")
    lexicon = S.induce_lexicon(df)
    assert lexicon == plain_lexicon([t for _, t in rows], OWN_LEXICON, S.ROUNDS)
    monkeypatch.setattr(S, "ENTRIES", 20)
    assert S.induce_lexicon(df) == lexicon
    learned = [w for w in (*GOOD, *BAD) if w not in OWN_LEXICON]
    assert sum((lexicon.get(w, 0) > 0) == (w in GOOD) and w in lexicon for w in learned) / len(learned) >= 0.9
    # held-out sentences use learned words only, no seed
    sentences = []
    for k in range(400):
        good = r.random() < .5
        words = [r.choice(PLAIN) for _ in range(10)]
        words.insert(5, r.choice([w for w in (GOOD if good else BAD) if w not in OWN_LEXICON]))
        turned = r.random() < .3
        if turned:
            words.insert(5, r.choice(["not", "never", "hardly"]))
        sentences.append((k, " ".join(words), good != turned))
    got = {x["article_id"]: x["score"] for x in S.scoped_score(spark.createDataFrame(sentences, "article_id long, text string, good boolean"), lexicon).collect()}
    right = sum((got[k] > 0) == good and got[k] != 0 for k, _, good in sentences)
    assert right / len(sentences) >= 0.9
    seeds_only = {w: round(v * 1000) for w, v in OWN_LEXICON.items()}
    assert all(S.text_valence(S.tokens(t), seeds_only) == 0 for _, t, _ in sentences)  # the given list alone knows none


def test_scopes_of_negation_and_degree(spark):
    lex = {"good": 1000, "bad": -800}
    cases = {"good": 1000, "very good": 1250, "slightly bad": -400, "not good": -750, "not a very good": -938, "never bad": 600,
             "not one two three good": 1000, "good not": 1000, "no good no bad": -750 + 600, "": 0, "extremely, GOOD!": 1500}
    df = spark.createDataFrame([(k, k) for k in cases], "article_id string, text string")
    got = {x["article_id"]: x["valence"] for x in S.scoped_score(df, lex).collect()}
    assert got == cases
    assert S.scoped_score(df.limit(0), lex).collect() == []
    assert S.induce_lexicon(df.limit(0)) == S.thousandths(OWN_LEXICON)
