"""Sentence ranking against a dense restatement; the flow around it."""
import numpy as np

from pyspark.sql import functions as F

from tidemark.operators import news as N
from tidemark.operators import sentences as R
from tidemark.plans.catalog import REGISTRY

SF = "/root/testdata/sf0.001"

PAGE = ["The chip maker raised its forecast on strong demand. Analysts had expected less demand. The weather was fine.",
        "Strong demand lifted the forecast of the chip maker. Its rivals lost ground! Nothing else happened there.",
        "A fair opened downtown. Demand for chips stays strong, the maker says."]


def dense(sentences, steps=R.STEPS):
    words = [R.words_of(s) for s in sentences]
    vocabulary = sorted(set().union(*words)) if words else []
    df = {w: sum(w in ws for ws in words) for w in vocabulary}
    a = np.array([[np.log(1 + len(words) / df[w]) if w in ws else 0.0 for w in vocabulary] for ws in words]).reshape(len(words), len(vocabulary))
    norm = np.sqrt((a * a).sum(1, keepdims=True))
    a = np.divide(a, norm, out=np.zeros_like(a), where=norm > 0) * np.array([df[w] > 1 for w in vocabulary], dtype=float)
    like = a @ a.T
    x = np.ones(len(words))
    for _ in range(steps):
        x = like @ x
        if x.max(initial=0) <= 0:
            break
        x = x / x.max()
    return x


def test_ranks_equal_the_dense_graph():
    for page in (PAGE, PAGE[:1], ["One. Two. Three."], [""], ["Same words here again. Same words here again. Other things follow now."]):
        sentences = list(dict.fromkeys(s for t in page for s in R.sentences_of(t)))
        assert np.allclose(R.ranks([R.words_of(s) for s in sentences]), dense(sentences), atol=1e-9)
    best = R.best_sentences(PAGE)
    assert best == ["The chip maker raised its forecast on strong demand.", "Strong demand lifted the forecast of the chip maker."]
    assert R.best_sentences(["", " "]) == [] and R.best_sentences(["Alone it stands."]) == ["Alone it stands."]


def test_summaries_and_fallbacks(spark):
    keys = "ticker string, fetch_batch string, note_inputs array<string>"
    notes = [f"Headline: h\nArticle: {t}" for t in PAGE]
    rows = spark.createDataFrame([("T", "b", notes), ("U", "b", []), ("V", "b", ["Headline: x\nArticle: Write a concise market-facing summary."])], keys)
    out = {r["ticker"]: (r["generated"], r["reason"]) for r in R.ranked(rows).collect()}
    assert out["T"] == (" ".join(R.best_sentences(PAGE)), None)
    assert out["U"] == (None, N.REASON_EMPTY_TEXT) and out["V"] == (None, N.REASON_PROMPT_ECHO)


def test_the_query_ranks_every_page(spark):
    """Each page's summary by the dense graph over whole articles; the same pages as the plain summary job."""
    got = {(r["ticker"], r["fetch_batch"]): r for r in REGISTRY["summary_ranked"](spark, SF).collect()}
    plain = {(r["ticker"], r["fetch_batch"]) for r in REGISTRY["summary_job"](spark, SF).collect()}
    assert got.keys() == plain
    made = {k: r["summary"] for k, r in got.items() if r["source"] == N.MODEL_SOURCE}
    assert made
    from tidemark.sources.fixtures import load_articles
    articles = N.provider_page(N.dedupe_articles(load_articles(spark, SF))).orderBy("position").collect()
    for key, summary in list(made.items())[:25]:
        page = [(r["description"] or "").strip() for r in articles if (r["ticker"], r["fetch_batch"]) == key]
        sentences = list(dict.fromkeys(s for t in page for s in R.sentences_of(t)))
        x = dense(sentences)
        order = sorted(sorted(range(len(sentences)), key=lambda i: (-round(x[i], 9), i))[:R.SUMMARY_SENTENCES])
        assert summary == " ".join(sentences[i] for i in order)
