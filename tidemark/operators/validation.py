"""VAL-1…12: validation of raw price-event messages, in one pass and without a UDF.

The message is parsed once into a VARIANT. Key presence, JSON value types (a JSON number and a
numeric string are different inputs for ``volume``) and the text of every field come from
``variant_get`` / ``schema_of_variant``; every rule is a Column, and the error of a row is the
first failing rule in the reference's order (``coalesce`` of ``when(rule_fails, message)``).
Valid and invalid rows are two filters of the same projection.

dead-lettered instead of stopping the consumer (Q12); a null ticker is dead-lettered and a
null source becomes 'unknown' (Q13); prices are rounded half-up on their decimal text, where
Python's binary ``round`` would round ``12.345`` down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.ingest import parse_event_json
from tidemark.sources.tables import EVENT_COLUMNS

# The validator's vocabularies and messages.
REQUIRED_EVENT_FIELDS = ["ticker", "price", "volume", "event_time", "source"]
ALLOWED_EVENT_KINDS = ["historical_bar", "intraday_bar", "live_snapshot"]
ALLOWED_BAR_INTERVALS = ["15m", "1d", "1m", "30m", "5m", "60m", "snapshot"]
ALLOWED_MARKET_SESSIONS = ["closed", "post", "pre", "regular"]
MSG_PREFIX = "Kafka message"
MSG_NOT_OBJECT = "Kafka message value must be a JSON object."
MSG_NOT_JSON = "Kafka message value is not valid JSON."
MSG_MISSING = "Kafka message is missing fields: "
MSG_TICKER_EMPTY = "Kafka message ticker must not be empty."
MSG_TICKER_LONG = "Kafka message ticker must be 10 characters or fewer."
MSG_PRICE = "Kafka message price must be a finite non-negative number."
MSG_VOLUME = "Kafka message volume must be non-negative."
# Own messages: values that pass the rules above but fit no column.
MSG_RANGE = "Kafka message {} is out of range."
MSG_TZ = "Kafka message event_time must include timezone information."
MSG_HIGH = "Kafka message high_price must be greater than or equal to open/close/low."
MSG_LOW = "Kafka message low_price must be less than or equal to open/close/high."
# Optional vocabulary mapping (quirks Q1, Q2): calendar names and the default history interval.
MAPPED_SESSIONS = {"premarket": "pre", "after_hours": "post"}
MAPPED_INTERVALS = {"1h": "60m"}

ISO_DATETIME = (r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?)?"
                r"(Z|[+-]\d{2}(:?\d{2}(:?\d{2})?)?)?$")
TZ_SUFFIX = r"(Z|[+-]\d{2}(:?\d{2}(:?\d{2})?)?)$"
INT_TEXT = r"^\s*[+-]?\d+(_\d+)*\s*$"
FLOAT_TEXT = r"^\s*[+-]?((\d+(_\d+)*)?\.?\d+(_\d+)*([eE][+-]?\d+)?|nan|inf|infinity)\s*$"
NAN_TEXT = r"^\s*[+-]?nan\s*$"

DEC = "decimal(10,2)"


def _field(v: Column, name: str) -> tuple[Column, Column, Column]:
    """(present, json_type, text) of a top-level field of a VARIANT object."""
    var = F.variant_get(v, f"$.{name}", "variant")
    present = var.isNotNull()
    jtype = F.schema_of_variant(var)
    text = F.variant_get(v, f"$.{name}", "string")
    return present, jtype, text


def _py_repr(s: Column) -> Column:
    return F.concat(F.lit("'"), s, F.lit("'"))


def _float_parse(jtype: Column, text: Column) -> tuple[Column, Column]:
    """Python ``float(x)``: (double value, error message or NULL)."""
    is_num = jtype.startswith("DECIMAL") | jtype.isin("BIGINT", "DOUBLE", "FLOAT", "INT")
    is_bool = jtype == "BOOLEAN"
    txt_ok = F.lower(text).rlike(FLOAT_TEXT)
    val = (F.when(is_num, text.try_cast("double"))
           .when(is_bool, F.when(text == "true", 1.0).otherwise(0.0))
           .when((jtype == "STRING") & F.lower(text).rlike(NAN_TEXT), F.lit(float("nan")))
           .when((jtype == "STRING") & txt_ok, F.translate(F.trim(text), "_", "").try_cast("double")))
    err = (F.when(jtype == "VOID", F.lit("float() argument must be a string or a real number, not 'NoneType'"))
           .when((jtype == "STRING") & ~txt_ok, F.concat(F.lit("could not convert string to float: "), _py_repr(text)))
           .when(jtype.startswith("OBJECT") | jtype.startswith("ARRAY"),
                 F.concat(F.lit("float() argument must be a string or a real number, not '"),
                          F.when(jtype.startswith("OBJECT"), "dict").otherwise("list"), F.lit("'"))))
    return val, err


def _price_value(text: Column) -> Column:
    """Price rounded to 2 places (half up on the decimal text) as DECIMAL(10,2)."""
    # DECIMAL(18,8) keeps the arithmetic in 64-bit longs; anything wider overflows DECIMAL(10,2) anyway
    t = F.translate(F.trim(text), "_", "")
    return F.round(t.try_cast("decimal(18,8)"), 2).try_cast(DEC)


def _finite_nonneg(d: Column) -> Column:
    return d.isNotNull() & ~F.isnan(d) & (d != float("inf")) & (d != float("-inf")) & (d >= 0)


_FIELDS = EVENT_COLUMNS
_OHLC = ["open_price", "high_price", "low_price", "close_price"]


def validate_events(messages: DataFrame, value_col: str = "value", session_vocab: str = "strict",
                    keep: list[str] | None = None) -> DataFrame:
    """VAL-1: every message with ``validation_error`` (NULL when valid) and typed event columns.

    Built as staged projections so that every intermediate value is a column computed once per
    row: parse (one VARIANT) → field presence/type/text → typed values and rule inputs → error.
    ``session_vocab="mapped"`` maps premarket→pre, after_hours→post and 1h→60m first (Q1, Q2).
    """
    keep = keep if keep is not None else [c for c in messages.columns if c != value_col]
    c = F.col
    # stage 1: parse once
    s1 = parse_event_json(messages, value_col, "_v").select(*keep, c(value_col).alias("payload"), "_v")
    # stage 2: presence, JSON type and text of each field
    cols2 = [c(k) for k in keep] + [c("payload"), F.schema_of_variant(c("_v")).alias("_root")]
    for n in _FIELDS:
        p, t, x = _field(c("_v"), n)
        cols2 += [p.alias(f"_p_{n}"), t.alias(f"_t_{n}"), x.alias(f"_x_{n}")]
    s2 = s1.select(*cols2, c("_v").isNull().alias("_not_json"))

    # stage 3: typed values and rule inputs
    price_d, price_err = _float_parse(c("_t_price"), c("_x_price"))
    vo_t, vo_x = c("_t_volume"), c("_x_volume")
    vol_is_int = vo_t == "BIGINT"
    vol_is_frac = vo_t.startswith("DECIMAL") | vo_t.isin("DOUBLE", "FLOAT")
    vol_text_ok = vo_x.rlike(INT_TEXT)
    vol_d = vo_x.try_cast("double")
    volume = (F.when(vol_is_int, vo_x.try_cast("bigint"))
              .when(vol_is_frac, F.when(vol_d.isNotNull() & ~F.isnan(vol_d) & (F.abs(vol_d) != float("inf")),
                                        F.coalesce(vo_x.try_cast("decimal(38,10)"), vol_d).try_cast("bigint")))
              .when((vo_t == "STRING") & vol_text_ok, F.translate(F.trim(vo_x), "_", "").try_cast("bigint"))
              .when(vo_t == "BOOLEAN", F.when(vo_x == "true", 1).otherwise(0).cast("bigint")))
    vol_err = (F.when(vo_t == "VOID", F.lit("int() argument must be a string, a bytes-like object or a real number, "
                                            "not 'NoneType'"))
               .when((vo_t == "STRING") & ~vol_text_ok,
                     F.concat(F.lit("invalid literal for int() with base 10: "), _py_repr(vo_x)))
               .when(vol_is_frac & F.isnan(vol_d), F.lit("cannot convert float NaN to integer"))
               .when(vol_is_frac & (F.abs(vol_d) == float("inf")), F.lit("cannot convert float infinity to integer")))
    et_x = c("_x_event_time")
    et_text = F.regexp_replace(et_x, "Z", "+00:00")

    def opt_text(name: str, default: str) -> Column:
        # falsy by JSON type: the texts "0" and "false" are values
        x, t = c(f"_x_{name}"), c(f"_t_{name}")
        number = t.startswith("DECIMAL") | t.isin("BIGINT", "DOUBLE", "FLOAT", "INT")
        falsy = (x.isNull() | (x == "") | ((t == "BOOLEAN") & (x == "false")) | (number & (x.try_cast("double") == 0))
                 | x.isin("{}", "[]") & (t.startswith("OBJECT") | t.startswith("ARRAY")))
        return F.coalesce(F.nullif(F.trim(F.when(falsy, F.lit(default)).otherwise(x)), F.lit("")), F.lit(default))

    kind, interval, session = (opt_text("event_kind", "live_snapshot"), opt_text("bar_interval", "snapshot"),
                               opt_text("market_session", "regular"))
    if session_vocab == "mapped":
        smap = F.create_map(*[F.lit(x) for kv in MAPPED_SESSIONS.items() for x in kv])
        imap = F.create_map(*[F.lit(x) for kv in MAPPED_INTERVALS.items() for x in kv])
        session = F.coalesce(F.element_at(smap, session), session)
        interval = F.coalesce(F.element_at(imap, interval), interval)
    cols3 = [c(k) for k in keep] + [
        c("payload"), c("_not_json"), (~c("_root").startswith("OBJECT")).alias("_not_object"),
        F.array_compact(F.array(*[F.when(~c(f"_p_{n}"), F.lit(n)) for n in REQUIRED_EVENT_FIELDS])).alias("_missing"),
        (c("_t_ticker") == "VOID").alias("_ticker_null"),
        F.upper(F.trim(c("_x_ticker"))).alias("ticker"),
        price_d.alias("_price_d"), price_err.alias("_price_err"),
        _price_value(c("_x_price")).alias("price"),
        volume.alias("volume"), vol_err.alias("_vol_err"), F.translate(F.trim(vo_x), "_", "").try_cast("double").alias("_vol_d"),
        et_text.alias("_et_text"),
        F.when(et_x.rlike(ISO_DATETIME), et_text.try_cast("timestamp")).alias("_et_ts"),
        et_x.rlike(TZ_SUFFIX).alias("_has_tz"),
        F.coalesce(F.nullif(F.trim(c("_x_source")), F.lit("")), F.lit("unknown")).alias("source"),
        kind.alias("event_kind"), interval.alias("bar_interval"), session.alias("market_session"),
    ]
    for n in _OHLC:
        given = c(f"_p_{n}") & (c(f"_t_{n}") != "VOID")
        d, perr = _float_parse(c(f"_t_{n}"), c(f"_x_{n}"))
        cols3 += [given.alias(f"_g_{n}"), F.when(given, _price_value(c(f"_x_{n}"))).alias(n),
                  F.when(given & perr.isNotNull(), perr)
                  .when(given & ~_finite_nonneg(F.round(d, 2)), F.lit(f"{MSG_PREFIX} {n} must be a finite "
                                                                     f"non-negative number."))
                  .when(given & _price_value(c(f"_x_{n}")).isNull(), F.lit(MSG_RANGE.format(n))).alias(f"_e_{n}")]
    s3 = s2.select(*cols3)

    # stage 4: the first failing rule wins
    all4 = c("_g_open_price") & c("_g_high_price") & c("_g_low_price") & c("_g_close_price")
    o, h, lo, cl = c("open_price"), c("high_price"), c("low_price"), c("close_price")

    def one_of(label: str, col: Column, allowed: list[str]) -> Column:
        return F.when(~col.isin(*allowed), F.lit(f"{MSG_PREFIX} {label} must be one of: {', '.join(allowed)}."))

    error = F.coalesce(
        F.when(c("_not_json"), F.lit(MSG_NOT_JSON)),
        F.when(c("_not_object"), F.lit(MSG_NOT_OBJECT)),
        F.when(F.size(c("_missing")) > 0, F.concat(F.lit(MSG_MISSING), F.array_join(c("_missing"), ", "))),
        F.when(c("_ticker_null") | (c("ticker") == ""), F.lit(MSG_TICKER_EMPTY)),
        F.when(F.length(c("ticker")) > 10, F.lit(MSG_TICKER_LONG)),
        c("_price_err"),
        F.when(~_finite_nonneg(F.round(c("_price_d"), 2)), F.lit(MSG_PRICE)),
        F.when(c("price").isNull(), F.lit(MSG_RANGE.format("price"))),
        c("_vol_err"),
        F.when((c("volume") < 0) | (c("volume").isNull() & (c("_vol_d") < 0)), F.lit(MSG_VOLUME)),
        F.when(c("volume").isNull(), F.lit(MSG_RANGE.format("volume"))),
        F.when(c("_et_ts").isNull(), F.concat(F.lit("Invalid isoformat string: "), _py_repr(c("_et_text")))),
        F.when(~c("_has_tz"), F.lit(MSG_TZ)),
        one_of("event_kind", c("event_kind"), ALLOWED_EVENT_KINDS),
        one_of("bar_interval", c("bar_interval"), ALLOWED_BAR_INTERVALS),
        one_of("market_session", c("market_session"), ALLOWED_MARKET_SESSIONS),
        *[c(f"_e_{n}") for n in _OHLC],
        F.when(all4 & (h < F.greatest(o, cl, lo)), F.lit(MSG_HIGH)),
        F.when(all4 & (lo > F.least(o, cl, h)), F.lit(MSG_LOW)),
    )
    event_time = F.when(c("_has_tz"), c("_et_ts"))
    # ``_barrier`` (spark_partition_id(), non-deterministic) keeps filters on the result above this
    # projection as long as they reference it (see ``split_valid``): the rules are evaluated once per
    # row instead of being substituted into every predicate down to the scan.
    return s3.select(
        *keep, "payload", "ticker", "price", "volume", event_time.alias("event_time"),
        F.substring("source", 1, 100).alias("source"), "open_price", "high_price", "low_price", "close_price",
        F.substring("event_kind", 1, 50).alias("event_kind"), F.substring("bar_interval", 1, 20).alias("bar_interval"),
        F.substring("market_session", 1, 20).alias("market_session"), error.alias("validation_error"),
        F.spark_partition_id().alias("_barrier"),
    )


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid events, invalid messages) from the output of ``validate_events``."""
    b = F.col("_barrier") >= 0 if "_barrier" in checked.columns else F.lit(True)
    valid = checked.filter(F.col("validation_error").isNull() & b).drop("validation_error", "payload", "_barrier")
    invalid = checked.filter(F.col("validation_error").isNotNull() & b) \
        .select(*[c for c in checked.columns if c not in EVENT_COLUMNS and c != "_barrier"])
    return valid, invalid


def dead_letters(invalid: DataFrame, created_at: Column | None = None) -> DataFrame:
    """SNK-3 row shape: topic, partition, offset, payload, error cut to 2000 chars, created_at."""
    return invalid.select(
        F.col("topic").alias("source_topic"), F.col("partition").cast("int").alias("source_partition"),
        F.col("offset").cast("bigint").alias("source_offset"), "payload",
        F.substring("validation_error", 1, 2000).alias("validation_error"),
        (created_at if created_at is not None else F.col("timestamp")).alias("created_at"))
