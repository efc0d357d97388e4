"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pipekit.llm import (
    bpe,
    decontaminate,
    licenses,
    neighbours as neighbours_by_tree,
    periodic,
    quality_model,
    quality_rules,
    simhash,
    suffix_dedup,
    token_counts,
    token_shards,
    warc,
    whitening,
)
from pipekit.session import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Whole texts reach Python workers in small batches; a batch holds one text at least.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def configured(function: Callable) -> Callable:
    """A function of a session and more, run with SETTINGS."""

    @wraps(function)
    def run(spark: SparkSession, *rest) -> DataFrame:
        for key, value in SETTINGS.items():
            spark.conf.set(key, value)
        return function(spark, *rest)

    return run


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of `table(name)`; `sql` is the same query for the oracle."""

    def register(function: Callable) -> Callable:
        @configured
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def sha256(column):
    return F.sha2(column, 256)


@query("op1_byte_bpe")
def byte_bpe(table):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    done = bpe.round_trip(table("documents"), ranks, public_tokenizers.PATTERN)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha256(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        sha256("decoded").alias("decoded_sha256"),
    )


DECONTAMINATION_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, WORDS AS ws FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, WORDS AS ws FROM benchmark),
windows AS (
  SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS w
  FROM (SELECT item, ws, least(len(ws), 10) AS n, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM items WHERE len(ws) > 0)
),
places AS (
  SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS w
  FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM docs), (SELECT DISTINCT n FROM windows)
  WHERE i + n - 1 <= len(ws)
),
hits AS (SELECT r, i, n, item FROM places JOIN windows USING (n, w)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)
""".replace(
    "WORDS",
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')",
)


@query("op2_decontamination", DECONTAMINATION_SQL)
def decontamination(table):
    found = decontaminate.contamination(table("documents"), table("benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        sha256(F.array_join(F.array_sort("items"), ",")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op3_suffix_dedup")
def suffixes(table):
    return suffix_dedup.repeats(table("documents").select("doc_id", "text")).select(
        "row.doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        sha256("kept").alias("kept_sha256"),
    )


@query("op4_license_scan")
def license_scan(table):
    scanned = licenses.license_scan(table("documents"))
    starts = F.transform("base", lambda b: b["start"].cast("long"))
    labels = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    found = F.transform("found", lambda d: d["label"])
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, found)), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda d: d["weight"])), F.lit(0.0)).alias("score"),
        F.size("found").cast("long").alias("n_detections"),
    )


SEED = 20240101


@query("op5_token_shards")
def shards(table):
    documents = table("documents")
    tokenizer = token_shards.tiktoken_ids(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    folder = fresh_path(documents.sparkSession, "shards")
    written = token_shards.write_shards(documents, folder, tokenizer, seed=SEED)
    return token_shards.read_shards(written, packed=True).select(
        "slot",
        "shard",
        F.col("key").alias("doc_id"),
        "part",
        F.col("n").alias("n_tokens"),
        sha256("tokens").alias("tokens_sha256"),
    )


@query("op6_quality_model")
def quality_scores(table):
    documents = table("documents")
    network = quality_model.train(documents, table("labels"), "doc_id", "text", "quality")
    scored = quality_model.score(documents, network)
    held_out = quality_model.held_out(F.col("doc_id"))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query(
    "op7_warc",
    """
    WITH rows AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
    marked AS (
      SELECT page_id, payload, strlen(payload) AS payload_bytes, max(page_id) OVER (PARTITION BY payload) AS last FROM rows
    )
    SELECT page_id, payload_bytes, sha1(payload) AS payload_digest,
      CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
    FROM marked
    """,
)
def archives(table):
    pages = table("pages")
    written = warc.write_archives(pages, fresh_path(pages.sparkSession, "warc"), "page_id", "html", "url")
    return warc.read_archives(written, payloads=False).select(
        F.col("key").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        # A record that fails its checks is no record.
        F.when(F.col("problem").isNull(), F.col("record_type")).alias("record_type"),
        F.col("refers_to").cast("long").alias("refers_to"),
    )


TOKEN_LIMIT = 4096


@query("op8_token_counts")
def counts(table):
    done = token_counts.token_counts(table("documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return done.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query("op9_quality_rules")
def quality(table):
    return quality_rules.quality_rules(table("documents"))


@query("op10_simhash")
def near_duplicates(table):
    return simhash.near_duplicates(table("documents"))


WORD_GAP = r"[\x20\x09-\x0D]+"


def planted(documents):
    """The documents with the contract's periodic tails: of one in ten, by the checksum of its id, the
    words from `a` on repeat the first `p` of them. Only the words of these are split and joined."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", WORD_GAP), lambda word: word != "")
    rows = documents.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    rows = rows.withColumn("g", F.expr("h div 10")).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.expr("CASE WHEN n > 0 THEN g % n END"))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = "transform(sequence(0, n - a - 1), i -> get(words, cast(a + i % p AS int)))"
    text = F.expr(f"array_join(concat(slice(words, 1, cast(a AS int)), {tail}), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def periodic_runs(table):
    found = periodic.mark_runs(planted(table("documents")))
    longest = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS back, -r.period AS short)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    best = found.withColumn("best", longest)
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.short")).alias("period"),
        F.expr("1000 * best.length div -best.short").alias("exponent_milli"),
        sha256(lines).alias("runs_sha256"),
        sha256("collapsed").alias("collapsed_sha256"),
    )


@query("op13_whitening")
def whitened(table):
    return whitening.whiten(table("embeddings"))


@query("op11_neighbours")
def neighbours(table):
    found = neighbours_by_tree.nearest(table("embeddings"))
    return found.select(F.col("query").alias("query_id"), "rank", F.col("key").alias("vec_id"), "score")
