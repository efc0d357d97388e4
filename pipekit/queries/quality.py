"""Profiles and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pipekit.operators import carried, quality
from pipekit.plans.analyze import analyze_file
from pipekit.queries.cleaning import EVENTS_WITH_NULLS, events_with_nulls
from pipekit.queries.registry import Tables, query
from pipekit.session import fresh_path, saved
from pipekit.sinks.files import export_files


def _column_sql(ordinal: int, name: str, dtype: str, guess: str, text: bool = False) -> str:
    present = f"{name} IS NOT NULL AND {name} <> ''" if text else f"{name} IS NOT NULL"
    length = f"length({name})" if text else "NULL"
    return f"""
    SELECT '{name}' AS "column", {ordinal} AS ordinal, '{dtype}' AS dtype, '{guess}' AS guessed_type,
           count(*) AS row_count, count(*) FILTER (NOT ({present})) AS null_count,
           round(100 * count(*) FILTER (NOT ({present})) / count(*), 2) AS null_percentage,
           count(DISTINCT {name}) FILTER ({present}) AS unique_count,
           CAST(max({length}) FILTER ({present}) AS INTEGER) AS max_length,
           CAST(avg({length}) FILTER ({present}) AS DOUBLE) AS avg_length
    FROM t"""


def _profile_sql(source: str, columns: list[tuple]) -> str:
    return f"WITH t AS ({source})" + " UNION ALL ".join(_column_sql(i, *c) for i, c in enumerate(columns))


EXACT = tuple(s for s in quality.STATS if s != "sample_values")


@query(
    "profile_columns",
    _profile_sql(
        EVENTS_WITH_NULLS,
        [
            ("event_id", "bigint", "integer"),
            ("ts", "timestamp_ntz", "string"),
            ("grp", "bigint", "integer"),
            ("event_type", "string", "string", True),
            ("value", "double", "number"),
        ],
    ),
)
def profile_columns(table: Tables) -> DataFrame:
    return quality.profile_columns(events_with_nulls(table), exact_distinct=True, stats=EXACT)


@query(
    "profile_documents",
    _profile_sql(
        "SELECT * FROM documents",
        [
            ("doc_id", "bigint", "integer"),
            ("text", "string", "string", True),
            ("lang", "string", "string", True),
            ("source", "string", "string", True),
            ("n_chars", "bigint", "integer"),
        ],
    ),
)
def profile_documents(table: Tables) -> DataFrame:
    return quality.profile_columns(table("documents"), exact_distinct=True, stats=EXACT)


@query(
    "profile_late_values",
    """
    SELECT 'late' AS "column", count(*) - count(*) FILTER (l_orderkey = m) AS null_count,
           count(DISTINCT l_extendedprice) FILTER (l_orderkey = m) AS unique_count, 1 AS samples
    FROM lineitem, (SELECT max(l_orderkey) AS m FROM lineitem)
    """,
)
def profile_late_values(table: Tables) -> DataFrame:
    """A column that is null but for a few rows still gets a sample of its values."""
    lines = table("lineitem")
    last = F.col("l_orderkey") == lines.agg(F.max("l_orderkey")).scalar()
    late = lines.select(F.when(last, F.col("l_extendedprice")).alias("late"))
    found = quality.profile_columns(late, exact_distinct=True, sample_values=1)
    return found.select("column", "null_count", "unique_count", F.size("sample_values").alias("samples"))


LINE_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


@query(
    "profile_approx",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS row_count, count(*) - count({c}) AS null_count,
                   count(DISTINCT {c}) > 0 AS unique_close, TRUE AS has_samples FROM lineitem"""
        for c in LINE_COLUMNS
    ),
)
def profile_approx(table: Tables) -> DataFrame:
    """The default profile; each estimate of distinct values must be within 20 % of the truth."""
    lines = table("lineitem")
    truths = [F.struct(F.lit(c).alias("column"), F.count_distinct(c).alias("truth")) for c in LINE_COLUMNS]
    truth = lines.agg(F.array(*truths).alias("t")).select(F.inline("t"))
    pairs = quality.profile_columns(lines).join(truth, "column")
    close = F.abs(F.col("unique_count") / F.col("truth") - 1) < 0.2
    samples = F.size("sample_values").between(1, 5)
    return pairs.select("column", "row_count", "null_count", close.alias("unique_close"), samples.alias("has_samples"))


DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


@query(
    "profile_samples",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", TRUE AS few, count(DISTINCT {c}) > 0 AS known FROM documents""" for c in DOCUMENT
    ),
)
def profile_samples(table: Tables) -> DataFrame:
    """Each column has one to five sample values, and all of them are values of that column."""
    documents = table("documents").select(*[F.col(c).cast("string") for c in DOCUMENT])
    samples = quality.profile_columns(table("documents"), stats=["sample_values"])
    values = documents.unpivot([], list(DOCUMENT), "column", "value").distinct()
    each = samples.select("column", F.explode("sample_values").alias("value"))
    found = each.join(values.withColumn("known", F.lit(True)), ["column", "value"], "left")
    known = F.bool_and(F.coalesce("known", F.lit(False)))
    return found.groupBy("column").agg(F.count(F.lit(1)).between(1, 5).alias("few"), known.alias("known"))


@query(
    "profile_dataset",
    f"""
    WITH t AS (SELECT grp, event_type, value FROM ({EVENTS_WITH_NULLS})),
         f AS (SELECT count(*) AS row_count, 3 AS column_count,
                      count(*) FILTER (event_type IS NULL OR event_type = '') AS event_type_nulls,
                      count(*) FILTER (value IS NULL) AS value_nulls,
                      count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS duplicate_rows FROM t)
    SELECT row_count, column_count, event_type_nulls + value_nulls AS total_nulls, duplicate_rows, event_type_nulls,
           round(100 * (1 - (event_type_nulls + value_nulls) / (row_count * 3)), 6) AS completeness_score,
           round(100 * (1 - (event_type_nulls + value_nulls) / (row_count * 3)), 6) AS quality_score
    FROM f
    """,
)
def profile_dataset(table: Tables) -> DataFrame:
    profile = quality.profile_dataset(events_with_nulls(table).select("grp", "event_type", "value"))
    scores = {c: F.round(c, 6) for c in ("completeness_score", "quality_score")}
    nulls = F.col("null_counts")["event_type"]
    return profile.withColumns({**scores, "event_type_nulls": nulls}).drop("null_counts")


@query(
    "profile_duplicates",
    """
    SELECT count(*) AS row_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents))
           AS duplicate_rows
    FROM documents
    """,
)
def profile_duplicates(table: Tables) -> DataFrame:
    documents = table("documents").select("text", "lang")
    return quality.profile_dataset(documents).select("row_count", "duplicate_rows")


@query(
    "quality_issues",
    f"""
    WITH t AS (SELECT grp, event_type, value, 'web' AS origin FROM ({EVENTS_WITH_NULLS})),
         f AS (SELECT round(100 * count(*) FILTER (event_type IS NULL OR event_type = '') / count(*), 2) AS e,
                      round(100 * count(*) FILTER (value IS NULL) / count(*), 2) AS v,
                      round(100 * (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t))) / count(*), 2) AS d,
                      max(length(event_type)) AS m FROM t)
    SELECT 'event_type' AS "column", 'null_percentage' AS issue, e AS value FROM f WHERE e > 10
    UNION ALL SELECT 'value', 'null_percentage', v FROM f WHERE v > 10
    UNION ALL SELECT 'event_type', 'max_length', m FROM f WHERE m > 7
    UNION ALL SELECT 'origin', 'constant', 1 FROM f
    UNION ALL SELECT NULL, 'duplicate_percentage', d FROM f WHERE d > 0
    """,
)
def quality_issues(table: Tables) -> DataFrame:
    events = events_with_nulls(table).select("grp", "event_type", "value").withColumn("origin", F.lit("web"))
    return quality.quality_issues(events, {"null_percentage": 10.0, "max_length": 7.0})


@query(
    "analyze_csv",
    """
    WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
                      CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders)
    SELECT 'o_orderkey' AS "column", 0 AS ordinal, 'integer' AS guessed_type, count(*) AS row_count,
           0 AS null_count, 0.0 AS null_percentage, 0 AS duplicate_rows,
           2 * count(*) - count(o_orderstatus) - count(o_totalprice) AS total_nulls FROM o
    UNION ALL SELECT 'o_orderstatus', 1, 'string', count(*), count(*) - count(o_orderstatus),
           round(100 * (count(*) - count(o_orderstatus)) / count(*), 2), 0,
           2 * count(*) - count(o_orderstatus) - count(o_totalprice) FROM o
    UNION ALL SELECT 'o_totalprice', 2, 'number', count(*), count(*) - count(o_totalprice),
           round(100 * (count(*) - count(o_totalprice)) / count(*), 2), 0,
           2 * count(*) - count(o_orderstatus) - count(o_totalprice) FROM o
    """,
)
def analyze_csv(table: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    orders = table("orders").select(
        "o_orderkey",
        F.when(key % 9 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(key % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"),
    )
    path = fresh_path(orders.sparkSession, "analyze")
    export_files(orders, path, "csv")
    stats = ("guessed_type", "row_count", "null_count", "null_percentage")
    whole, columns = analyze_file(orders.sparkSession, path, stats=stats)
    facts = {c: whole.select(c).scalar() for c in ("duplicate_rows", "total_nulls")}
    return columns.withColumns(facts)


@query(
    "profile_carried",
    _profile_sql(
        EVENTS_WITH_NULLS,
        [("grp", "bigint", "x"), ("event_type", "string", "x", True), ("value", "double", "x")],
    ).replace("SELECT '", "SELECT TRUE AS unique_close, TRUE AS median_close, '")
    .replace(", 'x' AS guessed_type", "")
    .replace("count(DISTINCT grp) FILTER (grp IS NOT NULL) AS unique_count,", "")
    .replace("count(DISTINCT value) FILTER (value IS NOT NULL) AS unique_count,", "")
    .replace("count(DISTINCT event_type) FILTER (event_type IS NOT NULL AND event_type <> '') AS unique_count,", ""),
)
def profile_carried(table: Tables) -> DataFrame:
    """The states of three parts, kept in a table, merge to the profile of all rows: equal counts,
    distinct values within 5 %, medians within 2 % of the ranks."""
    events = events_with_nulls(table)
    columns = events.select("grp", "event_type", "value")
    part = F.col("event_id") % 3
    parts = [carried.profile_states(events.where(part == i).select(columns.columns)) for i in range(3)]
    kept = saved(parts[0].unionByName(parts[1]).unionByName(parts[2]), "states")
    found = carried.carried_profile(kept, at=[0.5])
    whole = columns.agg(*[F.count_distinct(F.nullif(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns.columns])
    truth = whole.unpivot([], columns.columns, "column", "truth")
    medians = {r["column"]: r["quantiles"][0] for r in found.where("quantiles IS NOT NULL").collect()}
    below = [F.avg((F.col(c) <= m).cast("int")).alias(c) for c, m in medians.items()]
    above = [F.avg((F.col(c) < m).cast("int")).alias(c) for c, m in medians.items()]
    upto = columns.agg(*below).unpivot([], list(medians), "column", "upto")
    under = columns.agg(*above).unpivot([], list(medians), "column", "under")
    close = F.abs(F.col("unique_count") / F.col("truth") - 1) < 0.05
    median = F.coalesce((F.col("under") <= 0.52) & (F.col("upto") >= 0.48), F.lit(True))
    facts = found.join(truth, "column").join(upto, "column", "left").join(under, "column", "left")
    exact = ("column", "dtype", "row_count", "null_count", "null_percentage", "max_length", "avg_length")
    ordinal = F.col("ordinal")
    return facts.select(*exact, ordinal, close.alias("unique_close"), median.alias("median_close"))
