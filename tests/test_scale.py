"""What queries work out once: plans and calls, on small tables built here."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import news as N
from tidemark.plans import catalog as Q


def _plan(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, f"Goldman Sachs  said growth\tof item {i} beats forecasts. Strong gains for Apple number {i}.", "en", "wire") for i in range(240)]
    spark.createDataFrame(docs + docs[:3] + [(900, None, None, None)], "doc_id long, text string, lang string, source string").write.parquet(f"{at}/documents.parquet")
    start = dt.datetime(2024, 1, 2, 13)
    events = [(i, start + dt.timedelta(hours=i % 9, days=i % 20), i % 7, "view", float(i % 50), '{"k": 3}') for i in range(400)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string") \
        .write.parquet(f"{at}/events.parquet")
    return at


def test_texts_are_gone_through_once(spark, tables):
    # the filter on the key worked out the whole text again for every use
    plan = _plan(N.dedupe_articles(Q.load_articles(spark, tables)))
    assert plan.count("regexp_replace(") == 1


@pytest.mark.parametrize("name", ["upsert_news", "resolve_news_summary", "summary_job"])
def test_articles_are_enriched_once(spark, tables, name, monkeypatch):
    # every reader of the articles enriched them again
    calls, enrich = [], N.enrich_articles
    monkeypatch.setattr(N, "enrich_articles", lambda a, *rest: calls.append(1) or enrich(a, *rest))
    assert Q.REGISTRY[name](spark, tables).count() > 0
    assert len(calls) == 1


def test_learned_sentiment_reads_the_texts_it_wrote(spark, tables, monkeypatch):
    # every round built the articles again
    from tidemark.operators import sentiment
    seen, induce = [], sentiment.induce_lexicon
    monkeypatch.setattr(sentiment, "induce_lexicon", lambda a: seen.append(_plan(a)) or induce(a, rounds=1))
    Q.REGISTRY["sentiment_learned"](spark, tables)
    assert "regexp_replace" not in seen[0]


def test_correlation_reads_the_events_once(spark, tables):
    # F8: both sides of the join, and each side's benchmark, read the events
    found = Q.REGISTRY["ticker_correlation"](spark, tables)
    assert "get_json_object" not in _plan(found) and "events.parquet" not in _plan(found)


def test_white_space_is_one_space(spark):
    texts = ["a  b", " a\t b ", "a\x1c\x1fb", "a  b", "a   b", "a b", "", None, "\n", "a \n\r\n b  "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    before = F.trim(F.regexp_replace(F.coalesce("t", F.lit("")), r"(?U)[\s\x{1c}-\x{1f}]+", " "))
    assert all(r[0] == r[1] for r in df.select(N.normalize_whitespace(F.col("t")), before).collect())
