"""Jobs written as named nodes and the edges between them."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from pipekit.operators import aggregate, clean, joins, ordering, quality, schema
from pipekit.plans import audit, partitions
from pipekit.session import saved
from pipekit.sinks import database as database_sink, files as file_sink
from pipekit.sources import database, files

Params = Mapping[str, Any]

# Node parameters whose function argument has another name.
RENAMED = {"format": "fmt", "infer_schema": "infer", "sql_params": "params", "top_n": "top_n_rows"}
INPUTS = ("from", "left", "right")


def _aggregate(spark: SparkSession, df: DataFrame | None, engine: str | None = None, **params: Any) -> DataFrame:
    if engine:
        return database.aggregate_in_engine(spark, engine, **params)
    return aggregate.aggregate(df, **params)


def _profile(
    spark: SparkSession, df: DataFrame | None, engine: str | None = None, table: str | None = None, **params: Any
) -> DataFrame:
    """Rows per column; with `path`, the whole profile is written there as JSON and is the result."""
    source = {k: params.pop(k) for k in ("url", "options") if k in params}
    path = params.pop("path", None)
    df = database.read_table(spark, engine, table, **source) if engine else df
    if path is None:
        return quality.profile_columns(df, **params)
    quality.profile_table(df, **params).write.mode("overwrite").json(path)
    return spark.read.json(path)


def _infer(spark: SparkSession, df: DataFrame | None, source_ref: str | None = None, **params: Any) -> DataFrame:
    return schema.infer_schema(df if source_ref is None else files.read_files(spark, source_ref), **params)


def _audit(spark: SparkSession, df: DataFrame | None, **params: Any) -> DataFrame | None:
    """Log an event; after a sink, with the number of `rows` it wrote."""
    if df is not None and df.columns == ["rows_written"]:
        written = df.first().rows_written
        params["metrics"] = {**({} if written is None else {"rows": written}), **(params.get("metrics") or {})}
    audit.log_event(spark, **params)
    return df


def _written(spark: SparkSession, rows: int | None) -> DataFrame:
    """What a sink node gives to later ones: the number of rows it wrote."""
    return spark.createDataFrame([(rows,)], "rows_written bigint")


# Node types. What each calls, given the session and its input table.
NODES: dict[str, Callable[..., DataFrame | None]] = {
    "Source.FileRead": lambda spark, df, **p: files.read_files(spark, **p),
    "Source.CloudStorage": lambda spark, df, **p: files.bulk_import(spark, **p),
    "Source.DBQuery": lambda spark, df, **p: database.read_query(spark, **p),
    "Schema.Infer": _infer,
    "Type.Cast": lambda spark, df, **p: schema.cast_types(df, **p),
    "Time.Parse": lambda spark, df, **p: schema.parse_time(df, **p),
    "Clean.Deduplicate": lambda spark, df, **p: clean.deduplicate(df, **p),
    "Clean.Nulls": lambda spark, df, **p: clean.handle_nulls(df, **p),
    "Clean.Text": lambda spark, df, **p: clean.normalize_text(df, **p),
    "Transform.Join": lambda spark, df, other, **p: joins.join_tables(df, other, **p),
    "Transform.Aggregate": _aggregate,
    "Transform.Pivot": lambda spark, df, **p: aggregate.pivot(df, **p),
    "Transform.SortRank": lambda spark, df, **p: ordering.sort_rank(df, **p),
    "Transform.Filter": lambda spark, df, **p: clean.filter_rows(df, **p),
    "DQ.Profile": _profile,
    "Sink.DBWrite": lambda spark, df, **p: _written(spark, database_sink.write_table(df, **p)),
    "Sink.DataLake": lambda spark, df, **p: _written(spark, file_sink.write_datalake(df, **p)),
    "Sink.Files": lambda spark, df, **p: _written(spark, file_sink.export_files(df, **p)),
    "Orch.Partitioning": lambda spark, df, **p: partitions.make_partitions(spark, **p),
    "Orch.Trigger": lambda spark, df, **p: df,
    "Audit.Log": _audit,
}


def ordered_nodes(nodes: Sequence[Params], edges: Sequence[tuple[str, str]], inputs: Collection[str]) -> list[tuple[Params, list[str]]]:
    """The nodes so that each comes after those it reads or follows, each with the tables it reads.

    A node reads what its parameters name, or else the nodes with an edge to it, in the order of the
    edges; other edges only say what comes first. Nodes that could come next keep their given order.
    """
    by_id: dict[str, Params] = {}
    for node in nodes:
        if node["op"] not in NODES:
            raise ValueError(f"unknown node type {node['op']!r}; known: {sorted(NODES)}")
        if node["id"] in by_id or node["id"] in inputs:
            raise ValueError(f"two tables are called {node['id']!r}")
        by_id[node["id"]] = node
    odd = sorted({end for edge in edges for end in edge if end not in by_id and end not in inputs})
    if odd:
        raise ValueError(f"edges lead to or from {odd}, which are no nodes")
    into = sorted({end for _, end in edges if end in inputs})
    if into:
        raise ValueError(f"edges lead to {into}, which are given")
    reads: dict[str, list[str]] = {}
    after: dict[str, set[str]] = {}
    for name, node in by_id.items():
        params = node.get("params", {})
        before = [start for start, end in edges if end == name]
        reads[name] = [params[key] for key in INPUTS if key in params] or list(dict.fromkeys(before))
        unknown = [s for s in reads[name] if s not in by_id and s not in inputs]
        if unknown:
            raise ValueError(f"node {name!r} reads {unknown}, which no node makes")
        after[name] = {s for s in (*reads[name], *before) if s in by_id}
    done: list[str] = []
    while len(done) < len(by_id):
        ready = [name for name in by_id if name not in done and after[name] <= set(done)]
        if not ready:
            raise ValueError(f"nodes wait for each other: {sorted(set(by_id) - set(done))}")
        done.append(ready[0])
    return [(by_id[name], reads[name]) for name in done]


def _shared(order: Sequence[tuple[Params, list[str]]]) -> set[str]:
    """Tables that several branches with a sink of their own read."""
    sinks: dict[str, set[str]] = {}
    branches: dict[str, list[set[str]]] = {}
    for node, reads in reversed(order):
        own = set().union(*branches.get(node["id"], []))
        sinks[node["id"]] = own | ({node["id"]} if node["op"].startswith("Sink.") else set())
        for name in reads:
            branches.setdefault(name, []).append(sinks[node["id"]])
    return {
        name
        for name, own in branches.items()
        if len([b for b in own if b]) > 1 and len(set().union(*own)) > 1
    }


def run_graph(
    spark: SparkSession, nodes: Sequence[Params], edges: Sequence[tuple[str, str]] = (), **inputs: DataFrame
) -> dict[str, DataFrame | None]:
    """Run nodes `{"id", "op", "params"}`; returns the table of each id.

    A node names its input in `params["from"]` (joins: `left` and `right`), another node or one of
    `inputs`, or is given it by an edge `(from, to)`; edges between nodes that read nothing of each
    other only order them. Nodes run after all they wait for, whatever their order here; nodes that wait
    for each other, and names of no node, are errors before anything runs. Tables stay lazy, so
    everything up to a sink is one plan; but a table that leads to several sinks by several ways is
    written once, in the shared folder, and read by each.
    """
    order = ordered_nodes(nodes, edges, inputs)
    tables: dict[str, DataFrame | None] = dict(inputs)
    shared = _shared(order)
    for name in shared & set(inputs):
        tables[name] = saved(tables[name], "shared")
    for node, reads in order:
        params = {k: v for k, v in node.get("params", {}).items() if k not in INPUTS}
        arguments = {RENAMED.get(k, k): v for k, v in params.items()}
        upstream = [tables[s] for s in reads] or [None]
        if node["op"] != "Transform.Join":  # a node that reads one table may wait for several
            upstream = upstream[:1]
        made = NODES[node["op"]](spark, *upstream, **arguments)
        tables[node["id"]] = saved(made, "shared") if node["id"] in shared and made is not None else made
    return tables
