"""Validation messages per fault (first failing rule wins) and valid + invalid = input."""
from tidemark.operators.validation import split_valid, validate_events
from tidemark.sources.fixtures import load_raw_messages

BASE = ('"ticker": "aapl ", "price": 101.5, "volume": 10, "event_time": "2024-01-10T15:00:00+00:00", '
        '"source": " yf "')


def _check(spark, bodies, **kw):
    df = spark.createDataFrame([("t", 0, i, b, None) for i, b in enumerate(bodies)],
                               "topic string, partition int, offset long, value string, timestamp timestamp")
    return [r["validation_error"] for r in validate_events(df, **kw).orderBy("offset").collect()]


def test_messages(spark):
    bodies = [
        "{" + BASE + "}",
        '{"ticker": "A", "volume": 1, "event_time": "2024-01-10T15:00:00Z", "source": "x"}',
        "{" + BASE.replace('"aapl "', '"   "') + "}",
        "{" + BASE.replace('"aapl "', '"ABCDEFGHIJK"') + "}",
        "{" + BASE.replace("101.5", '"NaN"') + "}",
        "{" + BASE.replace("101.5", '"abc"') + "}",
        "{" + BASE.replace('"volume": 10', '"volume": "12.5"') + "}",
        "{" + BASE.replace('"volume": 10', '"volume": 12.7') + "}",
        "{" + BASE.replace("+00:00", "") + "}",
        "{" + BASE.replace("2024-01-10T15:00:00+00:00", "yesterday") + "}",
        "{" + BASE + ', "bar_interval": "1h"}',
        "{" + BASE + ', "market_session": "premarket"}',
        "{" + BASE + ', "open_price": 1, "high_price": 0.5, "low_price": 0.4, "close_price": 1}',
        "{" + BASE + ', "open_price": 1, "high_price": 2, "low_price": 1.5, "close_price": 1}',
        "[1]",
        '{"ticker": ',
        "{" + BASE + ', "open_price": -1}',
    ]
    got = _check(spark, bodies)
    assert got == [
        None,
        "Kafka message is missing fields: price",
        "Kafka message ticker must not be empty.",
        "Kafka message ticker must be 10 characters or fewer.",
        "Kafka message price must be a finite non-negative number.",
        "could not convert string to float: 'abc'",
        "invalid literal for int() with base 10: '12.5'",
        None,
        "Kafka message event_time must include timezone information.",
        "Invalid isoformat string: 'yesterday'",
        "Kafka message bar_interval must be one of: 15m, 1d, 1m, 30m, 5m, 60m, snapshot.",
        "Kafka message market_session must be one of: closed, post, pre, regular.",
        "Kafka message high_price must be greater than or equal to open/close/low.",
        "Kafka message low_price must be less than or equal to open/close/high.",
        "Kafka message value must be a JSON object.",
        "Kafka message value is not valid JSON.",
        "Kafka message open_price must be a finite non-negative number.",
    ]
    mapped = _check(spark, bodies[10:12], session_vocab="mapped")
    assert mapped == [None, None]                                # Q1 / Q2 mapped vocabularies


def test_normalised_values(spark):
    df = spark.createDataFrame([("t", 0, 0, "{" + BASE + "}", None)],
                               "topic string, partition int, offset long, value string, timestamp timestamp")
    valid, _ = split_valid(validate_events(df))
    r = valid.collect()[0]
    assert r["ticker"] == "AAPL" and r["source"] == "yf" and str(r["price"]) == "101.50"
    assert r["event_kind"] == "live_snapshot" and r["bar_interval"] == "snapshot" and r["market_session"] == "regular"


def test_split_is_complete(spark):
    msgs = load_raw_messages(spark, "/root/testdata/sf0.001")
    valid, invalid = split_valid(validate_events(msgs))
    assert valid.count() + invalid.count() == msgs.count()


def test_values_that_fit_no_column_are_rejected(spark):
    ok = "{" + BASE + "}"
    bodies = [ok.replace("101.5", "123456789.5"), ok.replace("101.5", '"-nan"'), ok.replace("101.5", '"+NaN"'), ok.replace("101.5", "1e400"),
              ok.replace('"volume": 10', '"volume": 1e20'), ok.replace('"volume": 10', '"volume": 100000000000000000000'),
              ok.replace('"volume": 10', '"volume": "100000000000000000000"'), ok.replace('"volume": 10', '"volume": -1e20'),
              "{" + BASE + ', "open_price": 1, "high_price": 999999999, "low_price": 1, "close_price": 1}',
              ok.replace("101.5", "99999999.99"), ok.replace("101.5", "99999999.999")]
    price, volume = "Kafka message price is out of range.", "Kafka message volume is out of range."
    finite = "Kafka message price must be a finite non-negative number."
    assert _check(spark, bodies) == [price, finite, finite, finite, volume, volume, volume, "Kafka message volume must be non-negative.",
                                     "Kafka message high_price is out of range.", None, price]


def test_defaults_stand_in_for_empty_values_by_json_type(spark):
    def body(v):
        return "{" + BASE + f', "event_kind": {v}' + "}"

    falsy, texts = ["null", '""', "0", "0.0", "false", "{}", "[]", '"  "'], ['"0"', '"false"', "1", "true"]
    got = _check(spark, [body(v) for v in falsy + texts])
    error = "Kafka message event_kind must be one of: historical_bar, intraday_bar, live_snapshot."
    assert got == [None] * len(falsy) + [error] * len(texts)
