"""Filters, duplicates, nulls, text, types and times."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pipekit.operators import clean, schema
from pipekit.plans.etl import default_transform
from pipekit.queries.registry import Tables, query

# The test tables have no nulls, so events get some that both engines can repeat.
EVENTS_WITH_NULLS = """
    SELECT event_id, ts, user_id % 10 AS grp,
           CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 11 = 0 THEN '' ELSE event_type END AS event_type,
           CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value
    FROM events"""


def events_with_nulls(table: Tables) -> DataFrame:
    event_id = F.col("event_id")
    kind = F.when(event_id % 5 == 0, None).when(event_id % 11 == 0, "").otherwise(F.col("event_type"))
    value = F.when(event_id % 7 != 0, F.col("value"))
    grp = (F.col("user_id") % 10).alias("grp")
    return table("events").select("event_id", "ts", grp, kind.alias("event_type"), value.alias("value"))


# --- filters and duplicates ----------------------------------------------------------------


@query(
    "filter_rows",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_returnflag <> 'N'
    """,
)
def filter_rows(table: Tables) -> DataFrame:
    condition = (
        "l_shipdate >= timestamp_ntz'1997-01-01' AND l_discount BETWEEN 0.05D AND 0.07D AND l_returnflag <> 'N'"
    )
    kept = clean.filter_rows(table("lineitem"), condition)
    return kept.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")


def _dedup_sql(way: str) -> str:
    rest = "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"
    order = ", ".join(f"{c} {way}" for c in ["l_shipdate", *rest.split(", ")])
    return f"""
    SELECT * FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {order}) = 1
    """


@query("dedup_last", _dedup_sql("DESC"))
def dedup_last(table: Tables) -> DataFrame:
    return clean.deduplicate(table("lineitem"), ["l_orderkey", "l_linenumber"], "l_shipdate", "last")


@query("dedup_first", _dedup_sql("ASC"))
def dedup_first(table: Tables) -> DataFrame:
    return clean.deduplicate(table("lineitem"), ["l_orderkey", "l_linenumber"], "l_shipdate", "first")


@query(
    "dedup_hot_key",
    """
    SELECT * FROM events
    QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1
    """,
)
def dedup_hot_key(table: Tables) -> DataFrame:
    """Few keys with very many rows each."""
    return clean.deduplicate(table("events"), ["event_type"], "ts")


@query(
    "dedup_no_time",
    "SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) = 1",
)
def dedup_no_time(table: Tables) -> DataFrame:
    return clean.deduplicate(table("documents"), ["text"])


@query("drop_duplicates", "SELECT DISTINCT text, lang, source FROM documents")
def drop_duplicates(table: Tables) -> DataFrame:
    return clean.drop_duplicates(table("documents").select("text", "lang", "source"))


@query(
    "duplicate_counts",
    """
    SELECT count(*) AS input_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS kept,
           count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS removed
    FROM lineitem
    """,
)
def duplicate_counts(table: Tables) -> DataFrame:
    return clean.duplicate_counts(table("lineitem"), ["l_orderkey", "l_linenumber"])


DISTINCT_DOCUMENTS = "SELECT DISTINCT text, lang, n_chars FROM documents"


@query("drop_duplicates_digest", DISTINCT_DOCUMENTS)
def drop_duplicates_digest(table: Tables) -> DataFrame:
    """Whole texts, of which only those with a repeated digest are shuffled."""
    return clean.drop_duplicates(table("documents").select("text", "lang", "n_chars"), by_digest=True)


@query(
    "duplicate_counts_digest",
    f"""
    SELECT count(*) AS input_rows, (SELECT count(*) FROM ({DISTINCT_DOCUMENTS})) AS kept,
           count(*) - (SELECT count(*) FROM ({DISTINCT_DOCUMENTS})) AS removed FROM documents
    """,
)
def duplicate_counts_digest(table: Tables) -> DataFrame:
    """Whole texts beside a map, which has no order and no hash."""
    documents = table("documents").select("text", "lang", "n_chars")
    return clean.duplicate_counts(documents.withColumn("facts", F.create_map(F.lit("n"), "n_chars")))


# --- nulls ---------------------------------------------------------------------------------


@query(
    "nulls_drop",
    f"SELECT * FROM ({EVENTS_WITH_NULLS}) WHERE event_type IS NOT NULL AND value IS NOT NULL",
)
def nulls_drop(table: Tables) -> DataFrame:
    return clean.handle_nulls(events_with_nulls(table), {"mode": "drop", "columns": []})


@query("nulls_drop_columns", f"SELECT * FROM ({EVENTS_WITH_NULLS}) WHERE value IS NOT NULL")
def nulls_drop_columns(table: Tables) -> DataFrame:
    return clean.handle_nulls(events_with_nulls(table), {"mode": "drop", "columns": ["value"]})


@query(
    "nulls_fill",
    f"""
    SELECT event_id, ts, grp, coalesce(event_type, 'none') AS event_type, value FROM ({EVENTS_WITH_NULLS})
    """,
)
def nulls_fill(table: Tables) -> DataFrame:
    strategy = {"mode": "fill", "value": "none", "columns": ["event_type"]}
    return clean.handle_nulls(events_with_nulls(table), strategy)


@query(
    "nulls_fill_any",
    f"""
    SELECT event_id, ts, grp, event_type, coalesce(value, 0) AS value FROM ({EVENTS_WITH_NULLS})
    """,
)
def nulls_fill_any(table: Tables) -> DataFrame:
    return clean.handle_nulls(events_with_nulls(table), {"mode": "fill", "value": 0})


@query(
    "nulls_fill_by_type",
    f"""
    WITH e AS ({EVENTS_WITH_NULLS})
    SELECT CAST(event_id AS DOUBLE) AS event_id, ts, CAST(grp AS DOUBLE) AS grp,
           coalesce(event_type, 'Unknown') AS event_type,
           round(coalesce(value, (SELECT avg(value) FROM e)), 6) AS value
    FROM e
    """,
)
def nulls_fill_by_type(table: Tables) -> DataFrame:
    return clean.fill_by_type(events_with_nulls(table)).withColumn("value", F.round("value", 6))


@query(
    "nulls_fill_groups",
    f"""
    SELECT grp, round(avg(coalesce(n, m)), 6) AS mean FROM (
        SELECT user_id % 10 AS grp, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END AS n FROM events),
        (SELECT avg(CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END) AS m FROM events)
    GROUP BY ALL
    """,
)
def nulls_fill_groups(table: Tables) -> DataFrame:
    """An integer column with nulls becomes double when filled with its mean."""
    n = F.when(F.col("event_id") % 3 != 0, F.col("event_id"))
    events = table("events").select((F.col("user_id") % 10).alias("grp"), n.alias("n"))
    filled = clean.fill_by_type(events)
    return filled.groupBy("grp").agg(F.round(F.avg("n"), 6).alias("mean"))


@query(
    "empty_to_null",
    f"SELECT event_id, ts, grp, nullif(event_type, '') AS event_type, value FROM ({EVENTS_WITH_NULLS})",
)
def empty_to_null(table: Tables) -> DataFrame:
    return clean.empty_to_null(events_with_nulls(table))


# --- text ----------------------------------------------------------------------------------

STRIP_SQL = r"""trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30)
    || chr(31) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196)
    || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233)
    || chr(8239) || chr(8287) || chr(12288))"""

EMOJI_SQL = (
    r"regexp_replace({}, '[\x{{1F000}}-\x{{1FAFF}}\x{{2600}}-\x{{27BF}}\x{{231A}}\x{{231B}}\x{{23E9}}-\x{{23FA}}"
    r"\x{{2B05}}-\x{{2B07}}\x{{2B1B}}\x{{2B1C}}\x{{2B50}}\x{{2B55}}][\x{{1F000}}-\x{{1FAFF}}\x{{2600}}-\x{{27BF}}"
    r"\x{{231A}}\x{{231B}}\x{{23E9}}-\x{{23FA}}\x{{2B05}}-\x{{2B07}}\x{{2B1B}}\x{{2B1C}}\x{{2B50}}\x{{2B55}}"
    r"\x{{FE0F}}\x{{200D}}\x{{20E3}}\x{{E0020}}-\x{{E007F}}]*|\x{{FE0F}}?\x{{20E3}}', '', 'g')"
)

TITLE_SQL = (
    r"list_aggregate(list_transform(regexp_extract_all(lower({}), "
    r"'[\p{{Lu}}\p{{Ll}}\p{{Lt}}]+|[^\p{{Lu}}\p{{Ll}}\p{{Lt}}]+'), "
    r"lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), 'string_agg', '')"
)


@query(
    "text_normalize",
    f"SELECT doc_id, {EMOJI_SQL.format('lower(' + STRIP_SQL.format('text') + ')')} AS text FROM documents",
)
def text_normalize(table: Tables) -> DataFrame:
    return clean.normalize_text(table("documents").select("doc_id", "text"), ["text"])


@query(
    "text_emoji",
    f"""
    SELECT conv_id, turn, {EMOJI_SQL.format("CASE WHEN turn % 2 = 0 THEN '☕️ ' || text || ' 👩‍💻 #️⃣1' ELSE text END")} AS text
    FROM conversations
    """,
)
def text_emoji(table: Tables) -> DataFrame:
    """Emoji with joiners, variation selectors and a keycap, around every second text."""
    talk = table("conversations")
    marked = F.concat(F.lit("☕️ "), "text", F.lit(" 👩‍💻 #️⃣1"))
    text = F.when(F.col("turn") % 2 == 0, marked).otherwise(F.col("text"))
    return clean.normalize_text(talk.select("conv_id", "turn", text.alias("text")), ["text"], ["rm_emoji"])


@query(
    "text_title",
    f"""
    SELECT p_partkey, {TITLE_SQL.format(STRIP_SQL.format("chr(9) || p_name || '-o''x 2nd '"))} AS "City",
           {TITLE_SQL.format('p_type')} AS department, p_brand
    FROM part
    """,
)
def text_title(table: Tables) -> DataFrame:
    city = F.concat(F.lit("\t"), "p_name", F.lit("-o'x 2nd "))
    part = table("part").select("p_partkey", city.alias("City"), F.col("p_type").alias("department"), "p_brand")
    return clean.standardize_text(part)


@query(
    "batch_columns",
    "SELECT c_custkey, 'batch-1' AS processing_batch_id, TRUE AS stamped FROM customer",
)
def batch_columns(table: Tables) -> DataFrame:
    stamped = clean.add_batch_columns(table("customer").select("c_custkey"), "batch-1")
    return stamped.select("c_custkey", "processing_batch_id", F.col("processed_at").isNotNull().alias("stamped"))


@query(
    "etl_default",
    f"""
    WITH d AS (SELECT lang AS city, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS department, text,
                      CASE WHEN n_chars % 7 = 0 THEN NULL ELSE n_chars END AS n_chars FROM documents)
    SELECT DISTINCT {TITLE_SQL.format('city')} AS city, {TITLE_SQL.format("coalesce(department, 'Unknown')")} AS department,
           text, round(coalesce(n_chars, (SELECT avg(n_chars) FROM d)), 6) AS n_chars, 'b7' AS processing_batch_id
    FROM d
    """,
)
def etl_default(table: Tables) -> DataFrame:
    source = table("documents").select(
        F.col("lang").alias("city"),
        F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("department"),
        "text",
        F.when(F.col("n_chars") % 7 != 0, F.col("n_chars")).alias("n_chars"),
    )
    return default_transform(source, "b7").drop("processed_at").withColumn("n_chars", F.round("n_chars", 6))


# --- types and times -----------------------------------------------------------------------


@query(
    "cast_types",
    """
    SELECT event_id, CAST(event_id % 100 AS TINYINT) AS small, TRY_CAST(value AS BIGINT) AS whole,
           TRY_CAST(event_type AS BIGINT) AS not_a_number, CAST(value AS DECIMAL(12,2)) AS amount,
           CAST(ts AS DATE) AS day
    FROM (SELECT event_id, ts, event_type, trunc(value) + 0.0 AS value FROM events)
    """,
)
def cast_types(table: Tables) -> DataFrame:
    whole = F.floor("value").cast("double")
    events = table("events").select(
        "event_id",
        (F.col("event_id") % 100).alias("small"),
        whole.alias("whole"),
        F.col("event_type").alias("not_a_number"),
        whole.alias("amount"),
        F.col("ts").alias("day"),
    )
    casts = {"small": "Int8", "whole": "Int64", "not_a_number": "Int64", "amount": "Decimal(12,2)", "day": "Date"}
    return schema.cast_types(events, casts)


@query(
    "cast_locale",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice AS german, l_extendedprice AS english,
           NULL::DOUBLE AS wrong
    FROM lineitem
    """,
)
def cast_locale(table: Tables) -> DataFrame:
    """Prices written in two ways and read back; the German way is not English."""
    english = F.format_number("l_extendedprice", 2)
    german = F.translate(english, ",.", ".,")
    keys = ("l_orderkey", "l_partkey", "l_suppkey")
    lines = table("lineitem").select(*keys, german.alias("german"), english.alias("english"))
    lines = lines.withColumn("wrong", F.concat(F.lit("1,2,"), "english"))
    lines = schema.cast_types(lines, {"german": "Float64"}, locale="de_DE")
    return schema.cast_types(lines, {"english": "Float64", "wrong": "Float64"})


@query(
    "cast_failures",
    """
    SELECT 'event_type' AS "column", 0 AS ordinal, 'Int64' AS target,
           count(*) FILTER (event_type IS NOT NULL) AS failures FROM (SELECT * FROM events)
    UNION ALL
    SELECT 'digits', 1, 'Int8', count(*) FILTER (event_id > 127) FROM events
    """,
)
def cast_failures(table: Tables) -> DataFrame:
    events = table("events").select("event_type", F.col("event_id").cast("string").alias("digits"))
    return schema.cast_failures(events, {"event_type": "Int64", "digits": "Int8"})


def _guess_sql(ordinal: int, name: str, text: str, source: str) -> str:
    integer = "regexp_matches(s, '^\\s*[+-]?[0-9]+\\s*$') AND TRY_CAST(s AS BIGINT) IS NOT NULL"
    number = "regexp_matches(s, '(?i)^\\s*[+-]?(([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)\\s*$')"
    return f"""
    SELECT '{name}' AS "column", {ordinal} AS ordinal,
           CASE WHEN bool_and({integer}) FILTER (s <> '') THEN 'integer'
                WHEN bool_and({number}) FILTER (s <> '') THEN 'number'
                WHEN bool_and(lower(s) IN ('true', 'false')) FILTER (s <> '') THEN 'boolean'
                ELSE 'string' END AS guessed_type,
           coalesce(bool_or(s IS NULL OR s = ''), FALSE) AS nullable
    FROM (SELECT CAST({text} AS VARCHAR) AS s FROM ({source}))"""


GUESSED = ["event_id", "ts", "user_id", "event_type", "value", "props"]
GUESS_SQL = " UNION ALL ".join(
    _guess_sql(i, c, "event_id % 2 = 0" if c == "even" else c, "SELECT * FROM events")
    for i, c in enumerate([*GUESSED, "even"])
)
INFER_SQL = " UNION ALL ".join(
    _guess_sql(i, c, c, EVENTS_WITH_NULLS) for i, c in enumerate(["event_id", "ts", "grp", "event_type", "value"])
)


@query("guess_types", f"SELECT * EXCLUDE (nullable) FROM ({GUESS_SQL})")
def guess_types(table: Tables) -> DataFrame:
    events = table("events").withColumn("even", F.col("event_id") % 2 == 0)
    return schema.guess_types(events.select(*[F.col(c).cast("string") for c in events.columns]))


@query(
    "infer_schema",
    f"""
    SELECT "column", ordinal, nullable, CASE guessed_type WHEN 'integer' THEN 'bigint' WHEN 'number' THEN 'double'
           ELSE guessed_type END AS type
    FROM ({INFER_SQL})
    """,
)
def infer_schema(table: Tables) -> DataFrame:
    events = events_with_nulls(table)
    return schema.infer_schema(events.select(*[F.col(c).cast("string") for c in events.columns]))


@query(
    "time_parse",
    """
    SELECT event_id, date_trunc('second', ts) AS ts, strftime(ts, '%Y-%m') AS ts_cohort FROM events
    """,
)
def time_parse(table: Tables) -> DataFrame:
    """Text in one of two formats, by row."""
    fancy = F.date_format("ts", "dd.MM.yyyy HH:mm:ss")
    plain = F.date_format("ts", "yyyy/MM/dd HH-mm-ss")
    text = F.when(F.col("event_id") % 2 == 0, fancy).otherwise(plain).alias("ts")
    formats = ["dd.MM.yyyy HH:mm:ss", "yyyy/MM/dd HH-mm-ss"]
    return schema.parse_time(table("events").select("event_id", text), "ts", formats=formats)


@query(
    "time_round_hour",
    """
    SELECT event_id, date_trunc('hour', timezone('America/New_York', timezone('UTC', ts))) AS ts FROM events
    """,
)
def time_round_hour(table: Tables) -> DataFrame:
    events = table("events").select("event_id", "ts")
    return schema.parse_time(events, "ts", "America/New_York", "hour", add_cohort=False)


@query(
    "time_round_day",
    "SELECT event_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ts, strftime(ts, '%Y-%m') AS ts_cohort FROM events",
)
def time_round_day(table: Tables) -> DataFrame:
    return schema.parse_time(table("events").select("event_id", "ts"), "ts", round_to="day")


@query(
    "time_cohort",
    """
    SELECT o_orderkey, o_custkey, o_orderdate,
           strftime(min(o_orderdate) OVER (PARTITION BY o_custkey), '%Y-%m') AS o_orderdate_cohort
    FROM orders
    """,
)
def time_cohort(table: Tables) -> DataFrame:
    orders = table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return schema.parse_time(orders, "o_orderdate", entity="o_custkey")
