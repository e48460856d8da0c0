"""News operators against brute-force Python on small inputs (the entity rule, keys, scores)."""
import re
from collections import Counter

from pyspark.sql import functions as F

from tidemark.operators import news as N

STOP = set(N.STOPWORDS)


def _brute_entities(text, ticker, canon):
    text = re.sub(r"\s+", " ", text or "").strip()
    if not text:
        return []
    low = text.lower()
    found = [c for c in canon if c.lower() in low]
    for e in re.findall(r"\b[A-Z][a-zA-Z]{2,}(?:\s+[A-Z][a-zA-Z]{2,})*\b", text):
        e = e.strip()
        if e.upper() == ticker.upper():
            found.append(e.upper())
        elif e.lower() not in STOP:
            found.append(e)
    return [(n, c) for n, c in Counter(found).most_common(6)]


ROWS = [
    (1, "AAPL", "Apple Inc said Apple shares rose", "Analysts at Goldman Sachs like the iPhone maker. The Market"),
    (2, "MSFT", "Microsoft and  Azure   growth", "MSFT beats; Microsoft Corp guidance up. Straße Über Ökonomie"),
    (3, "ZZY", "no capitals here", ""),
    (4, "NVDA", "Nvidia GeForce launch", "NVIDIA said NVidia chips. Nvidia Nvidia"),
]


def test_entities_match_brute_force(spark):
    from tidemark.functions.symbols import symbol_profile
    df = spark.createDataFrame(ROWS, "article_id long, ticker string, title string, description string") \
        .withColumn("position", F.col("article_id"))
    prof = {r["ticker"]: [r["canonical_ticker"], r["company_name"], *r["aliases"]]
            for r in symbol_profile(df.select("ticker"), "ticker").collect()}
    got = {}
    for r in N.extract_entities(df.withColumn("entity_text", N._joined_text("title", "description"))).collect():
        got[r["article_id"]] = [(e["name"], e["count"]) for e in r["entities"]]
    for aid, ticker, title, desc in ROWS:
        text = " ".join(x for x in (title, desc) if x)
        assert got[aid] == _brute_entities(text, ticker, prof[ticker]), aid


def _brute_key(title, desc):
    base = " ".join(x for x in (title, desc) if x).lower()
    norm = re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", base)).strip()
    return " ".join(norm.split()[:18])


def test_article_key_and_dedupe(spark):
    rows = [(1, "b1", 1, "Apple beats: Q3!", "Revenue up"), (2, "b1", 2, "apple BEATS q3", "revenue... up"),
            (3, "b1", 3, "", ""), (4, "b2", 4, "Apple beats: Q3!", "Revenue up")]
    df = spark.createDataFrame(rows, "article_id long, fetch_batch string, position long, title string, "
                                     "description string")
    keys = {r["article_id"]: r["k"] for r in df.select("article_id", N.article_key(F.col("title"), F.col("description"))
                                                        .alias("k")).collect()}
    for aid, _, _, t, d in rows:
        assert keys[aid] == _brute_key(t, d)
    kept = sorted(r["article_id"] for r in N.dedupe_articles(df).collect())
    assert kept == [1, 4]


def test_cluster_quality_impact(spark):
    rows = [("Earnings beat", "said the CEO", "https://www.reuters.com/x", "Reuters", 0.5),
            ("Merger talk", None, None, "PR Newswire press release", -0.9),
            ("Quiet day", "nothing", "https://unrated.example/x", "Press Release Wire", 0.0),
            ("Chip launch", "tariff", "https://www.fool.com/x", "Fool", 0.1)]
    df = spark.createDataFrame(rows, "title string, description string, url string, source_name string, "
                                     "sentiment double")
    out = df.select(N.topic_cluster(N._joined_text("title", "description")).alias("c"),
                    N.source_quality(F.col("url"), F.col("source_name")).alias("q")).collect()
    assert [r["c"] for r in out] == ["earnings", "deal", "general", "product"]
    assert [float(r["q"]) for r in out] == [1.0, 0.45, 0.55, 0.76]
    score, label = N.impact_score(N._joined_text("title", "description"), F.col("sentiment"), F.lit(2),
                                  N.source_quality(F.col("url"), F.col("source_name")))
    got = [(float(r[0]), r[1]) for r in df.select(score, label).collect()]
    # 0.5*0.45 + 2*0.08 + 1.0*0.35 + 0.28 (earnings) + 0.16 ("ai" in "said", Q16) = 1.175 → capped at 1
    assert got[0] == (1.0, "high")
    # 0.9*0.45 + 0.16 + 0.45*0.35 + 0.24 = 0.9625 → 0.96
    assert got[1] == (0.96, "high")
    assert got[2] == (round(0.16 + 0.55 * 0.35, 2), "low")


def test_low_quality_summary(spark):
    df = spark.createDataFrame([("AAPL", "  "), ("AAPL", "aapl MARKET NEWS DIGEST today"), ("AAPL", "Fine text."),
                                ("MSFT", "Headline: x")], "ticker string, s string")
    got = [r[0] for r in df.select(N.low_quality_summary(F.col("s"), F.col("ticker"))).collect()]
    assert got == [True, True, False, True]


def test_cache_article_arrays_for_one_ticker(spark):
    from tidemark.operators import cache as C
    from tidemark.plans.catalog import Ctx, _cache, _enriched
    c = Ctx(spark, "/root/testdata/sf0.001")
    children = C.cache_articles(_enriched(c))
    rows = C.latest_cache_row(_cache(c)).filter(F.col("article_count") > 0).limit(1)
    served = C.article_arrays(children, rows).collect()[0]
    assert len(served["news_articles"]) == served["article_count"]
    positions = [a["position"] for a in served["news_articles"]]
    assert positions == sorted(positions)


def test_summary_job_fallback_reasons(spark):
    from tidemark.plans.catalog import Ctx, _enriched
    c = Ctx(spark, "/root/testdata/sf0.001")
    page = N.provider_page(_enriched(c)).drop("_r")
    metrics = N.news_metrics(page, keys=N.PAGE_KEYS)
    batches = page.where("ticker = 'AAPL'").select("fetch_batch").distinct().count()

    def echo(texts):
        return ["AAPL market news digest: " + t for t in texts]

    def empty_final(texts):
        return [t if t.startswith("Headline:") else "" for t in texts]

    def boom(texts):
        raise RuntimeError("model unavailable")

    for fn, reason in [(echo, N.REASON_PROMPT_ECHO), (empty_final, N.REASON_EMPTY_SUMMARY), (boom, "model unavailable"),
                       (lambda texts: ["" for _ in texts], N.REASON_EMPTY_NOTES)]:
        rows = N.summary_job(metrics, page, fn).filter(F.col("ticker") == "AAPL").collect()
        assert len(rows) == batches > 1 and {r["source"] for r in rows} == {N.FALLBACK_SOURCE}
        assert {r["fallback_reason"] for r in rows} == {reason}
        assert all(r["summary"].endswith(N.LOCAL_FALLBACK_SUFFIX.strip() + " " + reason) for r in rows)
    ok = N.summary_job(metrics, page).filter(F.col("ticker") == "AAPL").collect()[0]
    assert ok["source"] == N.MODEL_SOURCE and ok["fallback_reason"] is None


def test_refilled_articles_keep_their_ticker(spark):
    rows = [(1, "AAPL", None, "lower case only", None), (2, "MSFT", "A Title About Azure Growth", "x", None)]
    a = spark.createDataFrame(rows, "article_id long, ticker string, title string, description string, url string")
    e = N.extract_entities(a.withColumn("entity_text", N._joined_text("title", "description")))
    out = {r["article_id"]: r for r in N.article_content(e).collect()}
    assert out[1]["ticker"] == "AAPL" and out[2]["ticker"] == "MSFT" and out[1]["content"] == "lower case only"


def test_entities_come_from_the_whole_text(spark):
    text = "word " * 5000 + "Shares of Apple Inc. Zurich Insurance Zurich Insurance"
    docs = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    from tidemark.sources.fixtures import articles_from_documents
    out = N.enrich_articles(articles_from_documents(docs)).collect()[0]
    assert ("Zurich Insurance Zurich Insurance" in {e["name"] for e in out["entities"]})
    assert out["description"].endswith("Zurich Insurance")
