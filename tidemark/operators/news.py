"""NWS-1…16: news enrichment as table jobs over an article table.

Input rows: (article_id, ticker, fetch_batch, position, title, description, url, published_at,
source_name, sentiment[, content]). Everything per article is a column expression; everything
across articles (dedupe, entity counting, cluster sizes, per-ticker metrics) is a grouped
aggregation or a window on small keys (article, batch, ticker) — no collect to the driver.
The only Python step is the pluggable summariser in ``summary_job`` (``mapInPandas``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.symbols import match_entities

# ---------------------------------------------------------------------------------------------
# Fixed values (must equal the reference): stopwords, rated domains, cluster and impact keywords,
# weights and thresholds, and the prompt fragments that mark a low-quality summary.
# ---------------------------------------------------------------------------------------------
STOPWORDS = ["the", "and", "for", "with", "from", "that", "this", "into", "about", "after", "before", "while",
             "amid", "over", "under", "stock", "shares", "company", "market", "markets", "news", "says", "said",
             "will", "have", "has", "had", "its", "their", "they", "them", "you", "your", "are", "was", "were",
             "inc", "corp", "ltd", "co", "plc"]
HIGH_QUALITY_DOMAINS = {"reuters.com": 1.0, "bloomberg.com": 1.0, "wsj.com": 0.98, "ft.com": 0.98,
                        "cnbc.com": 0.95, "marketwatch.com": 0.9, "finance.yahoo.com": 0.9,
                        "seekingalpha.com": 0.82, "benzinga.com": 0.8, "fool.com": 0.76}
CLUSTER_RULES = [
    ("earnings", ["earnings", "revenue", "profit", "guidance", "forecast", "quarter"]),
    ("analyst", ["upgrade", "downgrade", "rating", "target", "analyst"]),
    ("deal", ["acquisition", "merger", "partnership", "deal", "buyout"]),
    ("product", ["launch", "product", "release", "device", "platform", "chip"]),
    ("regulation", ["regulator", "investigation", "lawsuit", "antitrust", "policy"]),
    ("macro", ["rates", "inflation", "economy", "fed", "tariff", "jobs"]),
]
IMPACT_KEYWORDS = [
    (["earnings", "guidance", "forecast", "revenue"], "0.28"),
    (["merger", "acquisition", "lawsuit", "investigation"], "0.24"),
    (["launch", "chip", "ai", "contract", "deal"], "0.16"),
]
NO_URL_QUALITY, UNRATED_QUALITY, PRESS_RELEASE_CAP = "0.45", "0.65", "0.55"
SENTIMENT_WEIGHT, ENTITY_WEIGHT, ENTITY_CAP, QUALITY_WEIGHT = "0.45", "0.08", 4, "0.35"
HIGH_IMPACT, MEDIUM_IMPACT = 0.75, 0.45
SUMMARY_SENTIMENT_CUTOFF = 0.2
TOP_ENTITIES_PER_ARTICLE, TOP_ENTITIES_PER_TICKER = 6, 8
ARTICLE_KEY_TOKENS = 18
LOW_QUALITY_FRAGMENTS = ["{ticker} market news digest", "Write a concise market-facing summary",
                         "Primary headlines:", "Condensed article notes:", "Headline:", "Article:"]
SUMMARY_TEMPLATE = ("Recent coverage for %s is %s overall based on %d articles. Impact is %s with source quality "
                    "averaging %.2f. Key headlines include: %s.")
NO_ARTICLES_TEMPLATE = "No recent articles were available to summarize for %s."
FALLBACK_REASON_SUFFIX = " Fallback reason: "
LOCAL_FALLBACK_SUFFIX = " Local summarizer fallback used because: "
FALLBACK_SOURCE = "fallback"
NO_ARTICLES_REASON = "No articles available"
LOCAL_UNAVAILABLE_REASON = "Local summary unavailable"
STALE_CACHE_REASON = "Served stale cache because refresh failed"
PROVIDER_PAGE_SIZE = 8                     # articles per provider fetch (one summary covers one page)
PROMPT_TITLES, PROMPT_CLUSTERS, PROMPT_ENTITIES = 5, 4, 6
NOTE_INPUT_TEMPLATE = "Headline: {title}\nArticle: {content}"
PROMPT_TEMPLATE = ("Ticker: {ticker}\nOverall sentiment: {sentiment}\nAverage impact: {impact}\n"
                   "Dominant clusters: {clusters}\nNamed entities: {entities}\nTop headlines:\n{titles}\n"
                   "Article summaries:\n{notes}\n"
                   "Summarize the main drivers, risks, and likely market impact in 2-3 sentences.")
REASON_EMPTY_TEXT = "Article text was empty"
REASON_EMPTY_NOTES = "Local summarizer returned empty article notes"
REASON_EMPTY_SUMMARY = "Local summarizer returned an empty final summary"
REASON_PROMPT_ECHO = "Local summarizer echoed the prompt instead of generating a summary"
MODEL_SOURCE = "local_model"
FRESH_CACHE_SOURCE, NEWS_PROVIDER_SOURCE, STALE_NEWS_SOURCE = "daily_cache", "newsapi", "daily_cache_stale"

# Capitalised phrases: a capital letter, 2+ letters, optionally more such words. Word boundaries
# are spelled out with Unicode letters/digits so they do not depend on the regex engine's \b.
# The capital letter is asked for first: what stands before it is looked at only there.
ENTITY_PATTERN = (r"(?=[A-Z])(?<![\p{L}\p{N}_])[A-Z][a-zA-Z]{2,}(?:\s+[A-Z][a-zA-Z]{2,})*(?![\p{L}\p{N}_])")

DEC2 = "decimal(10,2)"


def _dec(x: str) -> Column:
    return F.lit(x).cast("decimal(6,4)")


def _joined_text(*cols: str) -> Column:
    """' '.join(filter(None, [...])): NULL and '' parts are skipped."""
    return F.concat_ws(" ", *[F.when(F.col(c) != "", F.col(c)) for c in cols])


def _has_col(df: DataFrame, name: str) -> bool:
    return name in df.columns


def article_key(title: Column, description: Column) -> Column:
    """NWS-1: lower-cased title + description, non [a-z0-9 ] → space, collapsed, first 18 tokens."""
    base = F.lower(F.concat_ws(" ", F.when(title != "", title), F.when(description != "", description)))
    # tokens are what stands between runs of other characters; the limit ends the search behind the last one
    # needed (the first part may be empty, the part beyond the limit is the rest of the text)
    toks = F.filter(F.split(base, "[^a-z0-9]+", ARTICLE_KEY_TOKENS + 2), lambda t: t != "")
    return F.array_join(F.slice(toks, 1, ARTICLE_KEY_TOKENS), " ")


def dedupe_articles(articles: DataFrame, batch_col: str = "fetch_batch", order_col: str = "position") -> DataFrame:
    """NWS-2: drop articles with an empty key; keep the first article per (batch, key).

    Done before enrichment (the reference enriches first): same survivors, less work.
    """
    # the row number decides between equal places; a filter is not moved below it, where it would work out
    # the key (and the texts it is made of) again for every use
    keyed = articles.withColumn("article_key", article_key(F.col("title"), F.col("description"))) \
        .withColumn("_row", F.monotonically_increasing_id()).filter(F.col("article_key") != "")
    # rank 1 of a group runs as a limit per group before the shuffle (a key copied many times sends one row a
    # task), and columns that no one reads later are not carried
    first = Window.partitionBy(batch_col, "article_key").orderBy(order_col, "_row")
    return keyed.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") == 1).drop("_r", "_row")


def normalize_whitespace(text: Column) -> Column:
    """Collapse every run of Unicode whitespace to one space and strip."""
    # single spaces stay as they are
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U) [\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}&&[^ ]][\s\x{1c}-\x{1f}]*", " "))


def _mention_array(text_col: str, ticker_col: str) -> Column:
    """All entity mentions of a row's (whitespace-normalised) text, in order: canonical matches of
    the ticker's profile first, then capitalised phrases (stopwords dropped, ticker upper-cased)."""
    raw = F.regexp_extract_all(F.col(text_col), F.lit(ENTITY_PATTERN), 0)
    stop = F.array(*[F.lit(s) for s in STOPWORDS])
    tk = F.upper(F.coalesce(F.col(ticker_col), F.lit("")))
    mapped = F.filter(F.transform(raw, lambda e: F.when(F.upper(F.trim(e)) == tk, F.upper(F.trim(e)))
                                  .when(F.array_contains(stop, F.lower(F.trim(e))), F.lit(None))
                                  .otherwise(F.trim(e))), lambda e: e.isNotNull())
    return F.when(F.col(text_col) == "", F.array().cast("array<string>")) \
        .otherwise(F.concat(F.col("canonical_entity_matches"), mapped))


def rank_mentions_inline(rows: DataFrame, mentions: str, out: str, n: int = TOP_ENTITIES_PER_ARTICLE) -> DataFrame:
    """``out``: the top-n (name, count) of a mention array inside the row, by count desc, first mention asc.

    The mentions are sorted by name and place, so equal ones stand together and a name's count is the length of
    its run: no look-up per mention, whatever the length of the text. Every step is a column of its own.
    """
    def name(i):
        return F.get("_sorted", i)["name"]

    rows = rows.withColumn("_sorted", F.sort_array(F.transform(mentions, lambda x, i: F.struct(x.alias("name"), i.alias("pos")))))
    starts = F.filter(F.transform("_sorted", lambda x, i: F.when((i == 0) | (x["name"] != name(i - 1)), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_starts", starts)
    runs = F.transform("_starts", lambda at, j: F.struct(
        (at - F.coalesce(F.get("_starts", j + 1), F.size("_sorted"))).alias("nc"),
        F.get("_sorted", at)["pos"].alias("pos"), name(at).alias("name")))
    top = F.transform(F.slice(F.sort_array(runs), 1, n), lambda e: F.struct(e["name"].alias("name"), (-e["nc"]).cast("bigint").alias("count")))
    return rows.withColumn(out, top).drop("_sorted", "_starts")


def entity_mentions(articles: DataFrame, text_col: str = "entity_text", ticker_col: str = "ticker",
                    id_col: str = "article_id") -> DataFrame:
    """Every entity mention of every article with its position: canonical matches first (profile
    order), then capitalised phrases in text order (quirk Q17: one mention can count twice).

    Output: (id, name, pos). One row per mention; the text is processed whole.
    """
    base = articles.select(id_col, ticker_col, normalize_whitespace(F.col(text_col)).alias("_text"))
    canon = match_entities(base, "_text", ticker_col).select(id_col, "canonical_entity_matches", ticker_col, "_text")
    return canon.select(id_col, F.posexplode(_mention_array("_text", ticker_col)).alias("pos", "name"))


def top_entities(mentions: DataFrame, id_col: str = "article_id", n: int = TOP_ENTITIES_PER_ARTICLE,
                 weight_col: str | None = None) -> DataFrame:
    """Rank names per id by (count desc, first mention asc); keep the top n.

    ``weight_col`` sums a count column instead of counting rows (NWS-10 weighting).
    Output: (id, rank, name, count).
    """
    w = F.sum(weight_col) if weight_col else F.count(F.lit(1))
    g = mentions.groupBy(id_col, "name").agg(w.cast("bigint").alias("count"), F.min("pos").alias("_first"))
    rk = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("count"), "_first"))
    return g.withColumn("rank", rk).filter(F.col("rank") <= n).select(id_col, "rank", "name", "count")


def extract_entities(articles: DataFrame, text_col: str = "entity_text", id_col: str = "article_id",
                     long_text: bool = False) -> DataFrame:
    """NWS-3: ``entities`` = top 6 (name, count) per article as ARRAY<STRUCT<name, count>>.

    Ranked inside the row (default): no shuffle, no join. ``long_text=True``: mentions are exploded and
    counted with a grouped aggregate, then joined back, for texts too long for a row's arrays."""
    if not long_text:
        cols = articles.columns
        base = articles.withColumn("_text", normalize_whitespace(F.col(text_col)))
        # the mentions are a column of their own, so the ranking does not extract them again per mention
        prof = match_entities(base, "_text", "ticker").withColumn("_mentions", _mention_array("_text", "ticker"))
        return rank_mentions_inline(prof, "_mentions", "entities").select(*cols, "entities")
    top = top_entities(entity_mentions(articles, text_col, "ticker", id_col), id_col)
    packed = top.groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.struct("rank", "name", "count"))).alias("_e"))
    ents = packed.select(id_col, F.transform("_e", lambda x: F.struct(x["name"].alias("name"),
                                                                     x["count"].alias("count"))).alias("entities"))
    out = articles.join(ents, id_col, "left")
    return out.withColumn("entities", F.coalesce(F.col("entities"),
                                                 F.array().cast("array<struct<name:string,count:bigint>>")))


def topic_cluster(text: Column, lowered: bool = False) -> Column:
    """NWS-4: first cluster whose keyword occurs (substring) in the lower-cased text, else general.

    ``lowered``: the text is a lower-cased column already (it is asked once a keyword)."""
    low = text if lowered else F.lower(text)
    expr = None
    for name, words in CLUSTER_RULES:
        cond = F.lit(False)
        for w in words:
            cond = cond | F.contains(low, F.lit(w))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit("general"))


def source_quality(url: Column, source_name: Column) -> Column:
    """NWS-5: 0.45 without URL, rated domain score or 0.65, capped at 0.55 for press releases."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    host = F.when(host.startswith("www."), F.substring(host, 5, 1000)).otherwise(host)
    table = F.create_map(*[x for k, v in HIGH_QUALITY_DOMAINS.items() for x in (F.lit(k), F.lit(str(v)))])
    score = F.coalesce(F.element_at(table, host).cast("decimal(4,2)"), _dec(UNRATED_QUALITY).cast("decimal(4,2)"))
    pr = F.coalesce(F.instr(F.lower(source_name), "press release") > 0, F.lit(False))
    score = F.when(pr, F.least(score, _dec(PRESS_RELEASE_CAP).cast("decimal(4,2)"))).otherwise(score)
    return F.when(url.isNull() | (url == ""), _dec(NO_URL_QUALITY).cast("decimal(4,2)")).otherwise(score)


def impact_score(text: Column, sentiment: Column, entity_count: Column, quality: Column,
                 word_boundary: bool = False, lowered: bool = False) -> tuple[Column, Column]:
    """NWS-6: (score, label). Keywords are substrings (Q16: 'ai' hits 'said') unless word_boundary.

    Exact decimal arithmetic, rounded half-up to 2 places (the reference rounds a binary float).
    """
    low = text if lowered else F.lower(text)
    kw = F.lit(0).cast("decimal(6,4)")
    for words, weight in IMPACT_KEYWORDS:
        if word_boundary:
            hit = low.rlike(r"\b(" + "|".join(words) + r")\b")
        else:
            hit = F.lit(False)
            for w in words:
                hit = hit | F.contains(low, F.lit(w))
        kw = kw + F.when(hit, _dec(weight)).otherwise(F.lit(0).cast("decimal(6,4)"))
    raw = (F.abs(F.coalesce(sentiment.cast("decimal(10,4)"), F.lit(0).cast("decimal(10,4)"))) * _dec(SENTIMENT_WEIGHT)
           + F.least(entity_count, F.lit(ENTITY_CAP)).cast("decimal(6,0)") * _dec(ENTITY_WEIGHT)
           + F.coalesce(quality.cast("decimal(10,4)"), F.lit(0).cast("decimal(10,4)")) * _dec(QUALITY_WEIGHT)
           + kw)
    score = F.least(F.lit(1).cast(DEC2), F.round(raw, 2).cast(DEC2))
    label = F.when(score >= HIGH_IMPACT, "high").when(score >= MEDIUM_IMPACT, "medium").otherwise("low")
    return score, label


def enrich_articles(articles: DataFrame, word_boundary: bool = False) -> DataFrame:
    """NWS-7: entities, quality, cluster, canonical ticker/company, canonical matches, impact."""
    a = articles.withColumn("entity_text", _joined_text("title", "description"))
    content_cols = ["title", "description"] + (["content"] if _has_col(a, "content") else [])
    a = extract_entities(a, "entity_text")
    a = match_entities(a, "entity_text", "ticker")
    # lower-cased once: a column that many expressions read
    a = a.withColumn("_low", F.lower(_joined_text(*content_cols)))
    a = a.withColumns({
        "source_quality_score": source_quality(F.col("url"), F.col("source_name")),
        "cluster": topic_cluster(F.col("_low"), lowered=True),
    })
    score, label = impact_score(F.col("_low"), F.col("sentiment"), F.size("entities"),
                                F.col("source_quality_score"), word_boundary, lowered=True)
    return a.withColumns({"impact_score": score, "impact_label": label}).drop("entity_text", "_low")


def attach_cluster_counts(articles: DataFrame, batch_col: str = "fetch_batch") -> DataFrame:
    """NWS-8: number of articles of the same cluster in the same batch."""
    # counted and joined back: article rows of a large cluster need not meet in one task
    sizes = articles.groupBy(batch_col, "cluster").agg(F.count(F.lit(1)).alias("cluster_article_count"))
    return articles.join(sizes, [batch_col, "cluster"]).select(*articles.columns, "cluster_article_count")


def cluster_distribution(articles: DataFrame, group_col: str = "fetch_batch") -> DataFrame:
    """NWS-9: clusters by article count (ties: first seen), with rank."""
    g = articles.groupBy(group_col, "cluster").agg(F.count(F.lit(1)).alias("article_count"),
                                                   F.min("position").alias("_first"))
    rk = F.row_number().over(Window.partitionBy(group_col).orderBy(F.desc("article_count"), "_first"))
    return g.withColumn("rank", rk).drop("_first")


def _label(avg: Column) -> Column:
    return F.when(avg >= HIGH_IMPACT, "high").when(avg >= MEDIUM_IMPACT, "medium").otherwise("low")


def news_metrics(enriched: DataFrame, tickers: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """NWS-10: per key (default: ticker) averages (round 4), impact label, top 8 weighted entities,
    clusters. ``tickers`` (with the key columns) adds a zero row for keys without articles.
    Entities and clusters come back as 'name:count|…' strings in rank order.
    """
    from tidemark.functions.numeric import round_ratio_half_up
    keys = keys or ["ticker"]

    def avg4(c: str) -> Column:
        unscaled = (F.coalesce(F.col(c).cast("decimal(10,4)"), F.lit(0).cast("decimal(10,4)")) * 10000) \
            .cast("decimal(38,0)")
        return round_ratio_half_up(F.sum(unscaled), F.count(F.lit(1)) * 10000, 4).cast("decimal(10,4)")

    base = enriched.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("article_count"), avg4("sentiment").alias("avg_sentiment"),
        avg4("impact_score").alias("avg_impact_score"), avg4("source_quality_score").alias("avg_source_quality_score"),
        F.sum(F.coalesce(F.col("impact_score").cast("decimal(10,4)"), F.lit(0))).alias("_impact_sum"))
    base = base.withColumn("impact_label", _label(F.col("_impact_sum") / F.col("article_count"))).drop("_impact_sum")
    gid = F.to_json(F.struct(*[F.col(k) for k in keys]))
    # weighted entity counts: key → name → sum(count); ties by first appearance (article order, rank)
    ents = enriched.select(gid.alias("_gid"), "position", F.posexplode("entities").alias("_i", "_e")) \
        .select("_gid", (F.col("position") * 100 + F.col("_i")).alias("pos"),
                F.col("_e.name").alias("name"), F.col("_e.count").alias("cnt"))
    top = top_entities(ents, "_gid", TOP_ENTITIES_PER_TICKER, "cnt")
    top_s = top.groupBy("_gid").agg(F.sort_array(F.collect_list(F.struct("rank", "name", "count"))).alias("_t")) \
        .select("_gid", F.array_join(F.transform("_t", lambda x: F.concat(x["name"], F.lit(":"),
                                                                        x["count"].cast("string"))), "|")
                .alias("top_entities"))
    clus = cluster_distribution(enriched.withColumn("_gid", gid), "_gid")
    clus_s = clus.groupBy("_gid").agg(F.sort_array(F.collect_list(F.struct("rank", "cluster", "article_count")))
                                      .alias("_c")) \
        .select("_gid", F.array_join(F.transform("_c", lambda x: F.concat(x["cluster"], F.lit(":"),
                                                                        x["article_count"].cast("string"))), "|")
                .alias("clusters"))
    out = base.withColumn("_gid", gid).join(top_s, "_gid", "left").join(clus_s, "_gid", "left").drop("_gid")
    if tickers is not None:
        out = tickers.select(*keys).distinct().join(out, keys, "left")
    zero4 = F.lit(0).cast("decimal(10,4)")
    return out.select(*keys, F.coalesce("article_count", F.lit(0).cast("bigint")).alias("article_count"),
                      F.coalesce("avg_sentiment", zero4).alias("avg_sentiment"),
                      F.coalesce("avg_impact_score", zero4).alias("avg_impact_score"),
                      F.coalesce("avg_source_quality_score", zero4).alias("avg_source_quality_score"),
                      F.coalesce("impact_label", F.lit("low")).alias("impact_label"),
                      F.coalesce("top_entities", F.lit("")).alias("top_entities"),
                      F.coalesce("clusters", F.lit("")).alias("clusters"))


def template_summary(metrics: DataFrame, headlines: DataFrame | None = None, reason: Column | None = None,
                     keys: list[str] | None = None) -> DataFrame:
    """NWS-11: deterministic summary text per ticker from ``news_metrics`` (+ first 3 headlines)."""
    keys = keys or ["ticker"]
    m = metrics if headlines is None else metrics.join(headlines, keys, "left")
    heads = F.coalesce(F.col("headlines"), F.lit("")) if "headlines" in m.columns else F.lit("")
    avg = F.col("avg_sentiment")
    label = F.when(avg > SUMMARY_SENTIMENT_CUTOFF, "positive").when(avg < -SUMMARY_SENTIMENT_CUTOFF, "negative") \
        .otherwise("mixed")
    body = F.format_string(SUMMARY_TEMPLATE, F.col("ticker"), label, F.col("article_count"), F.col("impact_label"),
                           F.col("avg_source_quality_score").cast("double"), heads)
    none = F.format_string(NO_ARTICLES_TEMPLATE, F.col("ticker"))
    r = reason if reason is not None else F.lit(None).cast("string")
    text = F.when(F.col("article_count") == 0,
                  F.when(r.isNotNull(), F.concat(none, F.lit(FALLBACK_REASON_SUFFIX), r)).otherwise(none)) \
        .otherwise(F.when(r.isNotNull(), F.concat(body, F.lit(LOCAL_FALLBACK_SUFFIX), r))
                   .otherwise(body))
    fallback = F.coalesce(r, F.when(F.col("article_count") == 0, F.lit(NO_ARTICLES_REASON))
                          .otherwise(F.lit(LOCAL_UNAVAILABLE_REASON)))
    return m.select(*keys, text.alias("summary"), F.lit(FALLBACK_SOURCE).alias("source"),
                    F.lit(None).cast("string").alias("model"), fallback.alias("fallback_reason"))


def first_headlines(articles: DataFrame, n: int = 3, keys: list[str] | None = None) -> DataFrame:
    """Per key: among the first n articles in arrival order, the non-empty titles, ', '-joined."""
    keys = keys or ["ticker"]
    rk = F.row_number().over(Window.partitionBy(*keys).orderBy("position"))
    top = articles.withColumn("_r", rk).filter((F.col("_r") <= n) & F.col("title").isNotNull() & (F.col("title") != ""))
    return top.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_r", "title"))).alias("_h")) \
        .select(*keys, F.array_join(F.transform("_h", lambda x: x["title"]), ", ").alias("headlines"))


def low_quality_summary(summary: Column, ticker: Column) -> Column:
    """NWS-12: empty after whitespace normalisation, or contains a prompt fragment (case-insensitive)."""
    norm = F.lower(normalize_whitespace(summary))
    frags = [F.lower(F.lit(f)) if "{ticker}" not in f
             else F.lower(F.concat(ticker, F.lit(f.replace("{ticker}", "")))) for f in LOW_QUALITY_FRAGMENTS]
    hit = F.lit(False)
    for fr in frags:
        hit = hit | (F.instr(norm, fr) > 0)
    return (norm == "") | hit


PAGE_KEYS = ["ticker", "fetch_batch"]


def provider_page(articles: DataFrame) -> DataFrame:
    """The first PROVIDER_PAGE_SIZE articles of each fetch in arrival order (a provider answers a fetch with
    one page; ``row_number ≤ k`` runs as a per-group limit before the shuffle)."""
    rk = F.row_number().over(Window.partitionBy(*PAGE_KEYS).orderBy("position"))
    return articles.withColumn("_r", rk).filter(F.col("_r") <= PROVIDER_PAGE_SIZE)


def summary_input(metrics: DataFrame, articles: DataFrame) -> DataFrame:
    """NWS-15: per fetch (ticker, batch) the pieces of the summary prompt — sentiment and impact labels, top
    clusters (≤ 4) and entities (≤ 6), headlines of the first 5 usable articles, and the note inputs
    ("Headline: …\\nArticle: …") of the usable articles of the page (bounded arrays)."""
    content = F.coalesce(F.col("content"), F.col("description")) if "content" in articles.columns \
        else F.col("description")
    page = provider_page(articles).withColumn("_content", F.trim(F.coalesce(content, F.lit(""))))
    usable = page.filter(F.col("_content") != "")
    note_in = F.concat(F.lit("Headline: "), F.trim(F.coalesce("title", F.lit(""))), F.lit("\nArticle: "),
                       F.col("_content"))
    per = usable.groupBy(*PAGE_KEYS).agg(
        F.sort_array(F.collect_list(F.struct("_r", note_in.alias("n"), F.col("title").alias("t")))).alias("_a"))
    per = per.select(*PAGE_KEYS, F.transform("_a", lambda x: x["n"]).alias("note_inputs"),
                     F.transform(F.filter(F.slice("_a", 1, PROMPT_TITLES), lambda x: F.coalesce(x["t"], F.lit("")) != ""),
                                 lambda x: F.concat(F.lit("- "), F.trim(x["t"]))).alias("titles"))
    avg = F.col("avg_sentiment")
    label = F.when(avg > SUMMARY_SENTIMENT_CUTOFF, "positive").when(avg < -SUMMARY_SENTIMENT_CUTOFF, "negative") \
        .otherwise("mixed")
    clusters = F.slice(F.split(F.coalesce("clusters", F.lit("")), r"\|"), 1, PROMPT_CLUSTERS)
    clusters = F.array_join(F.transform(F.filter(clusters, lambda c: c != ""), lambda c: F.concat(
        F.substring_index(c, ":", 1), F.lit(" ("), F.substring_index(c, ":", -1), F.lit(")"))), ", ")
    ents = F.slice(F.split(F.coalesce("top_entities", F.lit("")), r"\|"), 1, PROMPT_ENTITIES)
    ents = F.array_join(F.transform(F.filter(ents, lambda e: e != ""), lambda e: F.substring_index(e, ":", 1)), ", ")
    return metrics.join(per, PAGE_KEYS, "left").select(
        *PAGE_KEYS, label.alias("sentiment_label"), "impact_label", clusters.alias("clusters_block"),
        ents.alias("entities_block"), F.coalesce("note_inputs", F.array().cast("array<string>")).alias("note_inputs"),
        F.array_join(F.coalesce("titles", F.array().cast("array<string>")), "\n").alias("titles_block"))


def first_sentences(text: Column, n: int = 2) -> Column:
    """The first ``n`` sentences (ended by . ! or ? before white space), one space between them."""
    sentences = F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda x: x != "")
    return F.array_join(F.slice(sentences, 1, n), " ")


def extractive(inputs: DataFrame) -> DataFrame:
    """The built-in summariser: a note is the first two sentences of its article, the summary the first
    two sentences of the notes. Columns ``generated`` and ``reason`` beside PAGE_KEYS."""
    body = F.transform("note_inputs", lambda x: F.substr(x, F.instr(x, F.lit("\nArticle: ")) + F.length(F.lit("\nArticle: "))))
    notes = F.filter(F.transform(body, lambda x: first_sentences(x)), lambda x: x != "")
    d = inputs.withColumn("notes", notes)
    d = d.withColumn("text", first_sentences(F.regexp_replace(F.array_join("notes", " "), r"\n", " ")))
    reason = (F.when(F.size("note_inputs") == 0, F.lit(REASON_EMPTY_TEXT)).when(F.size("notes") == 0, F.lit(REASON_EMPTY_NOTES))
              .when(normalize_whitespace(F.col("text")) == "", F.lit(REASON_EMPTY_SUMMARY))
              .when(low_quality_summary(F.col("text"), F.col("ticker")), F.lit(REASON_PROMPT_ECHO)))
    return d.select(*PAGE_KEYS, F.when(reason.isNull(), F.col("text")).alias("generated"), reason.alias("reason"))


def called(inputs: DataFrame, summarizer: Callable) -> DataFrame:
    """Notes and summaries by a batched callable ``summarizer(list[str]) -> list[str]``, on bounded arrays
    (at most one page of notes per row); an error becomes the row's reason."""
    schema = ", ".join(f"{k} string" for k in [*PAGE_KEYS, "text", "reason"])

    def run(batches):
        import pandas as pd
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                text = reason = None
                try:
                    inputs_ = list(row.note_inputs) if row.note_inputs is not None else []
                    notes = [n for n in summarizer(inputs_) if n] if inputs_ else []
                    if not inputs_:
                        reason = REASON_EMPTY_TEXT
                    elif not notes:
                        reason = REASON_EMPTY_NOTES
                    else:
                        text = summarizer([PROMPT_TEMPLATE.format(
                            ticker=row.ticker, sentiment=row.sentiment_label, impact=row.impact_label,
                            clusters=row.clusters_block or "", entities=row.entities_block or "",
                            titles=row.titles_block or "", notes="\n".join(f"- {n}" for n in notes))])[0]
                except Exception as e:  # noqa: BLE001 - reported as the fallback reason
                    reason = str(e)
                out.append((row.ticker, row.fetch_batch, text, reason))
            yield pd.DataFrame(out, columns=[*PAGE_KEYS, "text", "reason"])

    made = inputs.mapInPandas(run, schema)
    reason = F.coalesce("reason", F.when(normalize_whitespace(F.col("text")) == "", F.lit(REASON_EMPTY_SUMMARY))
                        .when(low_quality_summary(F.col("text"), F.col("ticker")), F.lit(REASON_PROMPT_ECHO)))
    return made.select(*PAGE_KEYS, F.when(reason.isNull(), F.col("text")).alias("generated"), reason.alias("reason"))


def summary_job(metrics: DataFrame, articles: DataFrame, summarizer: Callable | str | None = None,
                model_name: str = "extractive") -> DataFrame:
    """NWS-14: per fetch, notes for each usable article of the page, then a summary of the prompt built
    from the notes; on no usable text, empty notes, an empty summary, a prompt echo (NWS-12) or an error
    the template summary (NWS-11) is used with the reference's reason.

    ``metrics`` holds PAGE_KEYS. Without a ``summarizer`` the first sentences are taken (a column expression);
    ``"ranked"`` takes the page's most central sentences (``operators.sentences``); a model of one's own is a
    batched callable (see ``called``)."""
    inp = summary_input(metrics, articles)
    if summarizer == "ranked":
        from tidemark.operators.sentences import ranked
        gen = ranked(inp)
    else:
        gen = extractive(inp) if summarizer is None else called(inp, summarizer)
    page = provider_page(articles).drop("_r")
    fb = template_summary(metrics.join(gen.select(*PAGE_KEYS, "reason"), PAGE_KEYS, "left"),
                          first_headlines(page, keys=PAGE_KEYS), reason=F.col("reason"), keys=PAGE_KEYS)
    ok = gen.filter(F.col("generated").isNotNull()).select(*PAGE_KEYS, "generated")
    made = F.col("generated").isNotNull()
    return fb.join(ok, PAGE_KEYS, "left").select(
        *PAGE_KEYS, F.coalesce("generated", "summary").alias("summary"),
        F.when(made, F.lit(MODEL_SOURCE)).otherwise(F.col("source")).alias("source"),
        F.when(made, F.lit(model_name)).alias("model"),
        F.when(~made, F.col("fallback_reason")).alias("fallback_reason"))


def article_content(articles: DataFrame, pages: DataFrame | None = None, id_col: str = "article_id",
                    page_id_col: str = "page_id") -> DataFrame:
    """NWS-16: content = fetched page text when the article has a URL and a page was fetched,
    else title + description; without a URL, description or title. Entities are refilled from the
    content for articles whose entity list is empty (when ``entities`` is present)."""
    a = articles
    if pages is not None:
        p = pages.select(F.col(page_id_col).alias("_pid"), F.col("page_text").alias("_page"))
        a = a.join(p, a[id_col] == p["_pid"], "left").drop("_pid")
    else:
        a = a.withColumn("_page", F.lit(None).cast("string"))
    fallback = F.trim(_joined_text("title", "description"))
    no_url = F.coalesce(F.when(F.col("description") != "", F.col("description")),
                        F.when(F.col("title") != "", F.col("title")), F.lit(""))
    content = F.when(F.col("url").isNull() | (F.col("url") == ""), no_url) \
        .otherwise(F.coalesce(F.when(F.trim("_page") != "", F.trim("_page")), fallback))
    out = a.withColumn("content", content).drop("_page")
    if "entities" in out.columns:
        # the content is scanned without a ticker of its own; the article keeps it
        empty = out.filter(F.size("entities") == 0).drop("entities").withColumnRenamed("ticker", "_ticker")
        refilled = extract_entities(empty.withColumn("_scanned", F.col("content")).withColumn("ticker", F.lit("")),
                                    "_scanned", id_col, long_text=True) \
            .drop("_scanned", "ticker").withColumnRenamed("_ticker", "ticker")
        out = out.filter(F.size("entities") > 0).unionByName(refilled.select(*out.columns))
    return out


# NWS-13 (re-aimed): the reference calls an external scorer whose lexicon is not part of it.
# This is our own small finance lexicon (word → valence); parity with that scorer is not claimed.
OWN_LEXICON = {
    "beat": 1.5, "beats": 1.5, "gain": 1.2, "gains": 1.2, "growth": 1.4, "record": 1.1, "strong": 1.6,
    "surge": 1.8, "upgrade": 1.5, "profit": 1.3, "rally": 1.6, "rise": 1.0, "rises": 1.0, "up": 0.5,
    "miss": -1.5, "misses": -1.5, "loss": -1.6, "losses": -1.6, "weak": -1.4, "drop": -1.2, "drops": -1.2,
    "fall": -1.1, "falls": -1.1, "downgrade": -1.5, "lawsuit": -1.3, "fraud": -2.5, "crash": -2.4,
    "down": -0.5, "risk": -0.8, "cut": -1.0, "cuts": -1.0,
}
SENTIMENT_ALPHA = 15


def sentiment_score(text: Column, lexicon: dict[str, float] | None = None) -> Column:
    """NWS-13: compound polarity in [-1, 1]: sum of token valences s, normalised s / sqrt(s² + 15).

    Tokens are runs of ASCII letters of the lower-cased text; the lexicon is a literal map (its
    size is fixed by the caller), so scoring stays inside the row — no join, no shuffle."""
    lex = lexicon or OWN_LEXICON
    m = F.create_map(*[x for k, v in lex.items() for x in (F.lit(k), F.lit(float(v)))])
    toks = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), 0)
    s = F.aggregate(F.transform(toks, lambda t: F.coalesce(F.element_at(m, t), F.lit(0.0))), F.lit(0.0),
                    lambda acc, x: acc + x)
    return F.round(s / F.sqrt(s * s + F.lit(float(SENTIMENT_ALPHA))), 4)


def resolve_news(provider: DataFrame, cache_latest: DataFrame, as_of: str) -> DataFrame:
    """FRS-3: per ticker: fresh cached articles → 'daily_cache'; else provider articles →
    the provider label; else stale cached articles → 'daily_cache_stale'; else an error row.

    ``provider``: (ticker, article_count) of a successful fetch; ``cache_latest``: latest cache
    row per ticker (with the news columns)."""
    from tidemark.operators.cache import cache_status
    st = cache_status(cache_latest, as_of, "news").select("ticker", "is_stale", "freshness_reason")
    c = cache_latest.select("ticker", F.coalesce(F.col("article_count"), F.lit(0)).alias("cached_articles")) \
        .join(st, "ticker", "left")
    p = provider.select("ticker", F.col("article_count").alias("fetched_articles"), F.lit(True).alias("_ok"))
    j = c.join(p, "ticker", "full")
    has_cache = F.coalesce(F.col("cached_articles"), F.lit(0)) > 0
    fresh = has_cache & ~F.coalesce(F.col("is_stale"), F.lit(True))
    ok = F.coalesce(F.col("_ok"), F.lit(False))
    source = F.when(fresh, FRESH_CACHE_SOURCE).when(ok, NEWS_PROVIDER_SOURCE).when(has_cache, STALE_NEWS_SOURCE)
    return j.select("ticker", source.alias("source"),
                    F.when(fresh | (~ok & has_cache), F.col("cached_articles")).when(ok, F.col("fetched_articles"))
                    .cast("bigint").alias("article_count"),
                    F.when(~fresh & ~ok & has_cache, F.lit(STALE_CACHE_REASON)).alias("fallback_reason"),
                    F.when(source.isNull(), F.lit("No news available")).alias("error"))


def resolve_news_summary(cache_latest: DataFrame, made: DataFrame, as_of: str) -> DataFrame:
    """FRS-3 for summaries, per ticker: the fresh cached summary unless it is of low quality; else a new
    one; else the stale cached one (again unless low quality); else the no-articles text.

    ``cache_latest``: latest cache row per ticker with its summary; ``made``: (ticker, summary, source, model,
    fallback_reason, article_count) of the tickers that could be summarised now."""
    from tidemark.operators.cache import cache_status
    st = cache_status(cache_latest, as_of, "news_summary").select("ticker", "is_stale")
    c = cache_latest.select("ticker", F.col("news_summary").alias("c_summary"), F.col("summary_source").alias("c_source"),
                            F.col("summary_model").alias("c_model"), F.col("summary_fallback_reason").alias("c_reason"),
                            F.coalesce(F.col("article_count"), F.lit(0)).alias("c_count")).join(st, "ticker", "left")
    m = made.select("ticker", *[F.col(x).alias(f"m_{x}") for x in ("summary", "source", "model", "fallback_reason", "article_count")])
    j = c.join(m, "ticker", "full")
    usable = F.col("c_summary").isNotNull() & ~low_quality_summary(F.col("c_summary"), F.col("ticker"))
    fresh = F.coalesce(usable & ~F.coalesce("is_stale", F.lit(True)), F.lit(False))
    new = ~fresh & F.col("m_summary").isNotNull()
    stale = ~fresh & ~new & F.coalesce(usable, F.lit(False))
    none = F.format_string(NO_ARTICLES_TEMPLATE, F.col("ticker"))
    return j.select(
        "ticker", F.when(fresh | stale, F.col("c_summary")).when(new, F.col("m_summary")).otherwise(none).alias("summary"),
        F.when(fresh, F.col("c_source")).when(new, F.col("m_source")).when(stale, F.lit(STALE_NEWS_SOURCE))
        .otherwise(F.lit(FALLBACK_SOURCE)).alias("source"),
        F.when(fresh | stale, F.col("c_model")).when(new, F.col("m_model")).alias("model"),
        F.when(fresh, F.col("c_reason")).when(new, F.col("m_fallback_reason")).when(stale, F.lit(STALE_CACHE_REASON))
        .otherwise(F.lit(NO_ARTICLES_REASON)).alias("fallback_reason"),
        F.when(fresh | stale, F.col("c_count")).when(new, F.col("m_article_count")).otherwise(0).cast("bigint").alias("article_count"))
