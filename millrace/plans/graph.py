"""Pipeline graphs: a spec of nodes and edges turned into DataFrames and writes."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from millrace.functions.templating import resolve_dates
from millrace.functions.tokens import compact_date, path_token
from millrace.operators.aggregate import aggregate
from millrace.operators.columns import basic_chain, schema_from_descriptor, split_valid
from millrace.operators.combine import union_by_name
from millrace.operators.dictionary import iterator_entries
from millrace.operators.join import join_tables, lookup
from millrace.operators.order import sort_rows
from millrace.operators.predicates import filter_rows
from millrace.plans.context import RunContext
from millrace.plans.fanout import foreach_app, multi_date
from millrace.plans.transforms import apply_callable, query, read_table, sql_over
from millrace.session import scratch_path
from millrace.sinks.files import write_csv, write_mode, write_parquet, written
from millrace.sinks.tables import ensure_namespace, quoted, write_table
from millrace.sinks.units import Journal, append_unit, append_unit_table, unit_name
from millrace.sources.layout import Layout

# Node types of a pipeline spec.
SOURCES = {"jdbc_extract", "impala_extract", "s3_extract", "csv_extract", "json_extract", "table_extract"}
TRANSFORMS = {"filter", "join", "sort", "lookup", "sql_transform", "aggregate", "notebook_transform"}
LOADS = {"load_sql", "load_parquet"}
# These may also start a graph: SQL then runs over the catalog, a callable reads what it wants.
STARTERS = {"sql_transform", "notebook_transform"}

Reader = Callable[[SparkSession, dict, RunContext], DataFrame]


@dataclass
class Environment:
    """What a spec refers to by name: readers per node type or node id, dictionaries, callables, output root."""

    readers: Mapping[str, Reader] = field(default_factory=dict)
    dictionaries: Mapping[str, DataFrame] = field(default_factory=dict)
    callables: Mapping[str, Callable] = field(default_factory=dict)
    output: Layout | None = None


@dataclass
class Node:
    id: str
    type: str
    label: str
    config: dict
    inputs: list[str] = field(default_factory=list)
    outputs: list[str] = field(default_factory=list)


@dataclass
class Branch:
    """What one source feeds."""

    source: str
    label: str
    job_name: str
    transforms: list[str]
    loads: list[str]
    staging: str | None
    iterator: str | None


class Graph:
    """A checked spec ``{nodes: [{id, data: {nodeType, label, config}}], edges: [{source, target}]}``."""

    def __init__(self, spec: dict, name: str = "pipeline") -> None:
        self.name = name
        self.nodes: dict[str, Node] = {}
        for n in spec.get("nodes") or []:
            data, nid = n.get("data") or {}, str(n.get("id"))
            config = data.get("config") or {}
            self.nodes[nid] = Node(nid, str(data.get("nodeType") or ""), str(data.get("label") or nid), config)
        for e in spec.get("edges") or []:
            source, target = str(e.get("source")), str(e.get("target"))
            if source not in self.nodes or target not in self.nodes:
                raise ValueError(f"edge {source} -> {target} names an unknown node")
            self.nodes[source].outputs.append(target)
            self.nodes[target].inputs.append(source)
        self.order = self._topological()
        self._check()

    def _topological(self) -> list[str]:
        try:
            return list(TopologicalSorter({n.id: n.inputs for n in self.nodes.values()}).static_order())
        except CycleError as err:
            raise ValueError(f"the graph has a cycle: {err.args[1]}") from None

    def _check(self) -> None:
        known = SOURCES | TRANSFORMS | LOADS | {"iterator"}
        for node in self.nodes.values():
            if node.type not in known:
                raise ValueError(f"node {node.id} has the unknown type {node.type!r}")
            feeds = [i for i in node.inputs if self.nodes[i].type != "iterator"]
            if node.type in (TRANSFORMS - STARTERS) | LOADS and not feeds:
                raise ValueError(f"{node.type} {node.id} has no input")
            if node.type == "join" and len(feeds) != 2:
                raise ValueError(f"join {node.id} needs two inputs, has {len(feeds)}")
        loaded = lambda n: _loads_itself(self.nodes[n]) or any(self.nodes[r].type in LOADS for r in self.reachable(n))
        orphans = [n for n in self.sources() if not loaded(n)]
        if orphans:
            raise ValueError(f"sources without a downstream load: {orphans}")

    def sources(self) -> list[str]:
        return [n for n in self.order if self.is_source(n)]

    def is_source(self, nid: str) -> bool:
        node = self.nodes[nid]
        feeds = [i for i in node.inputs if self.nodes[i].type != "iterator"]
        return node.type in SOURCES or (node.type in STARTERS and not feeds)

    def reachable(self, start: str) -> set[str]:
        seen, stack = set(), list(self.nodes[start].outputs)
        while stack:
            nid = stack.pop()
            if nid not in seen:
                seen.add(nid)
                stack += self.nodes[nid].outputs
        return seen

    def iterator_of(self, nid: str) -> str | None:
        stack, seen = list(self.nodes[nid].inputs), set()
        while stack:
            up = stack.pop()
            if self.nodes[up].type == "iterator":
                return up
            if up not in seen:
                seen.add(up)
                stack += self.nodes[up].inputs
        return None

    def branches(self) -> list[Branch]:
        """One branch per source: the transforms and loads it reaches, in order, and its own staging load."""
        reach = {s: self.reachable(s) for s in self.sources()}
        found = []
        for source, below in reach.items():
            shared = set().union(*[r for s, r in reach.items() if s != source])
            loads = [n for n in self.order if n in below and self.nodes[n].type in LOADS]
            own = [n for n in loads if n not in shared]
            found.append(
                Branch(
                    source=source,
                    label=self.nodes[source].label,
                    job_name=f"{path_token(self.name, 'PIPELINE')}_{path_token(source, 'SRC')}",
                    transforms=[n for n in self.order if n in below and self.nodes[n].type in TRANSFORMS],
                    loads=loads,
                    staging=own[0] if own and own[0] != loads[-1] else None,
                    iterator=self.iterator_of(source),
                )
            )
        return found


def apply_steps(df: DataFrame, steps: list[dict], env: Environment | None = None, ctx: RunContext | None = None):
    """An ordered list of ``{type, config}`` steps over one table."""
    for step in steps:
        df = _transform(step["type"], step.get("config") or {}, [df], env or Environment(), ctx or RunContext())
    return df


def _transform(kind: str, config: dict, inputs: list[DataFrame], env: Environment, ctx: RunContext) -> DataFrame:
    if kind == "join":
        left, right = inputs
        how, prefix = config.get("join_type", "inner"), config.get("prefix", "right_")
        return left.transform(join_tables(right, config["keys"], how, prefix, config.get("hot_keys", False)))
    df = inputs[0] if len(inputs) == 1 else union_by_name(*inputs)
    if kind == "filter":
        return df.transform(filter_rows(config.get("conditions", []), config.get("logic") or "AND"))
    if kind == "sort":
        return df.transform(sort_rows(config.get("columns", [])))
    if kind == "aggregate":
        return df.transform(
            aggregate(config.get("group_by"), config.get("aggregations"), config.get("order_by"))
        )
    if kind == "lookup":
        name = str(config.get("dict_id"))
        if name not in env.dictionaries:
            raise ValueError(f"lookup needs the dictionary {name}, which is not there")
        return df.transform(
            lookup(env.dictionaries[name], config.get("match_column", ""), config.get("output_column", ""),
                   config.get("default_value", ""))
        )
    if kind == "sql_transform":
        return sql_over(df, ctx.render(config["sql"]))
    if kind == "notebook_transform":
        return apply_callable(df, env.callables[config["callable"]], ctx)
    raise ValueError(f"unknown step type {kind!r}")


def _entries(graph: Graph, nid: str, env: Environment) -> tuple[DataFrame | None, list[str]]:
    """The dictionary entries of the iterator above a source, and the keys selected in it."""
    iterator = graph.iterator_of(nid)
    if iterator is None:
        return None, []
    cfg = graph.nodes[iterator].config
    name = str(cfg.get("dictionary_id"))
    if name not in env.dictionaries:
        raise ValueError(f"iterator needs the dictionary {name}, which is not there")
    keys = [str(k) for k in cfg.get("selected_keys") or []]
    return iterator_entries(env.dictionaries[name], keys, cfg.get("entry_filters")), keys


def _read(spark: SparkSession, node: Node, env: Environment, ctx: RunContext) -> DataFrame:
    cfg = node.config
    if node.type == "sql_transform":
        return query(spark, ctx.render(cfg["sql"]), cfg.get("source_db") or ctx.namespace)
    if node.type == "notebook_transform":
        source = read_table(spark, cfg["source_table"], cfg.get("source_db")) if cfg.get("source_table") else None
        return env.callables[cfg["callable"]](spark, source, ctx)
    reader = env.readers.get(node.id) or env.readers.get(node.type)
    if reader is None:
        raise ValueError(f"no reader for {node.type} {node.id}")
    return reader(spark, cfg, ctx)


def _source(spark: SparkSession, graph: Graph, nid: str, env: Environment, ctx: RunContext, legacy: dict | None):
    """A source's rows for all applications and dates of the run.

    With ``app_column`` (and ``date_column``) one scan serves all of them. Only a
    query whose text names ``$app_id`` or ``$app_name`` is built once per entry; the
    parts are one union, so still one job.
    """
    node = graph.nodes[nid]
    cfg = node.config
    entries, keys = _entries(graph, nid, env)
    text = str(cfg)
    if entries is not None and not cfg.get("app_column") and ("$app_id" in text or "$app_name" in text):
        found = entries.orderBy("iteration").select("key", "value").collect()  # a part of the plan each
        if not found:
            raise ValueError(f"the iterator above {nid} selects no entry")
        parts = [_read(spark, node, env, replace(ctx, app_id=e["key"], app_name=e["value"])) for e in found]
        df = union_by_name(*[p.withColumn("application_id", F.lit(e["key"])) for p, e in zip(parts, found)])
    else:
        df = _read(spark, node, env, ctx)
        if entries is not None and cfg.get("app_column"):
            df = foreach_app(df, cfg["app_column"], entries, keys)
    if cfg.get("date_column") and (cfg.get("dates") or cfg.get("date_from")):
        days = resolve_dates(cfg.get("dates"), cfg.get("date_from"), cfg.get("date_to"), ctx.business_date)
        df = multi_date(df, cfg["date_column"], days, cfg.get("date_partition", "business_date"))
    return df.transform(basic_chain(**legacy)) if legacy else df


def _loads_itself(node: Node) -> bool:
    """Whether a store extract names a table of its own to write to."""
    return node.type == "s3_extract" and bool(node.config.get("target_table"))


def _rows_per_file(node: Node, graph: Graph) -> int | None:
    """A load's segment size, or else the smallest chunk size of the sources above it."""
    own = node.config.get("rows_per_segment")
    chunks = [graph.nodes[s].config.get("chunk_size") for s in graph.sources() if node.id in graph.reachable(s)]
    return own or min((int(c) for c in chunks if c), default=None)


def _is_csv(config: dict) -> bool:
    return (config.get("output_format") or config.get("target")) == "csv"


def _save(node: Node, df: DataFrame, graph: Graph, env: Environment, ctx: RunContext, unit: str | None = None) -> dict:
    """Write a load's rows. A ``unit`` that appends replaces the rows of its own earlier tries."""
    cfg = node.config
    mode = cfg.get("mode") or "overwrite"
    if _loads_itself(node) or node.type == "load_sql":
        if _loads_itself(node):
            mode, namespace, name = cfg.get("write_mode") or "overwrite", cfg.get("target_db") or ctx.namespace, cfg["target_table"]
        else:
            namespace, name = cfg.get("namespace_db") or cfg.get("database") or ctx.namespace, cfg.get("table_name")
        namespace, name = (namespace or "").strip(), (name or "").strip()
        if unit and write_mode(mode) == "append" and namespace and name:
            ensure_namespace(df.sparkSession, namespace)
            return {"table": quoted(namespace, name), "rows_loaded": append_unit_table(df, quoted(namespace, name), unit, cfg.get("partition_by"))}
        return write_table(df, namespace, name, mode, cfg.get("partition_by"))
    if env.output is None:
        raise ValueError(f"{node.id} writes files, but the environment has no output root")
    layout = Layout(env.output.root, cfg.get("output_dir"), cfg.get("path_template"))
    path = layout.dataset(compact_date(ctx.business_date or "undated"), graph.name, node.label, ctx.app_id)
    if _is_csv(cfg):
        return {"path": path, "rows_loaded": write_csv(df, path, mode, _rows_per_file(node, graph))}
    if unit and write_mode(mode) == "append":
        return {"path": path, "rows_loaded": append_unit(df, path, unit, cfg.get("partition_by"))}
    rows = write_parquet(df, path, mode, cfg.get("partition_by"), _rows_per_file(node, graph))
    return {"path": path, "rows_loaded": rows}


def _together(inputs: list[DataFrame]) -> DataFrame:
    return inputs[0] if len(inputs) == 1 else union_by_name(*inputs)


def _write_node(
    spark: SparkSession, node: Node, df: DataFrame, graph: Graph, env: Environment, ctx: RunContext, unit: str | None = None
) -> tuple[DataFrame, dict]:
    """Write a load's rows; returns what the nodes below read, and the outcome.

    They read a target that holds exactly these rows, with the types they had.
    Partitioned targets keep other partitions, appended ones older rows, and CSV
    no empty text: there the rows go through the run's own folder first, whose
    path the outcome names as ``passed``.
    """
    cfg, passed = node.config, None
    mode = cfg.get("write_mode" if _loads_itself(node) else "mode") or "overwrite"
    fresh = mode == "overwrite" and not cfg.get("partition_by") and not _is_csv(cfg)
    if node.outputs and not fresh:
        passed = scratch_path(spark, "staging")
        df.write.parquet(passed)
        df = spark.read.schema(df.schema).parquet(passed)
    done = _save(node, df, graph, env, ctx, unit)
    if passed or node.outputs:
        done["passed"] = {"path": passed or done.get("path"), "schema": df.schema.json()}
        df = _passed_on(spark, done)
    return df, done


def _passed_on(spark: SparkSession, done: dict) -> DataFrame:
    """What the nodes below a finished load read."""
    rows = done["passed"]
    if not rows["path"]:
        return spark.table(done["table"])
    return spark.read.schema(StructType.fromJson(json.loads(rows["schema"]))).parquet(rows["path"])


def _reject(node: Node, df: DataFrame, ctx: RunContext) -> DataFrame:
    """The rows that fit the node's ``expect`` schema; the others are appended to its ``reject_table``.

    Rejected rows of any node have one shape: node_id, bad_columns, and the row
    as JSON. The rows are computed once for both.
    """
    cfg = node.config
    good, bad = split_valid(written(df, "checked"), schema_from_descriptor(cfg["expect"]))
    if cfg.get("reject_table"):
        names = [c for c in bad.columns if c != "bad_columns"]
        row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"})
        bad = bad.select(F.lit(node.id).alias("node_id"), "bad_columns", row.alias("row"))
        namespace = (cfg.get("reject_db") or ctx.namespace or "").strip()
        ensure_namespace(bad.sparkSession, namespace)
        unit = unit_name("reject", node.id, ctx.business_date, ctx.app_id)
        append_unit_table(bad, quoted(namespace, cfg["reject_table"].strip()), unit)
    return good


def _shared(graph: Graph, nid: str, needed: set[str]) -> bool:
    """Whether several nodes below would each compute this one anew.

    Loads pass on what they wrote. Plain scans of files and tables are read by
    each with its own filters and columns; their ``share`` asks for a copy.
    """
    node = graph.nodes[nid]
    if len([o for o in node.outputs if o in needed]) < 2 or node.type in LOADS or _loads_itself(node):
        return False
    return bool(node.config.get("share", node.type not in {"s3_extract", "csv_extract", "json_extract", "table_extract"}))


def build(
    spark: SparkSession,
    graph: Graph,
    env: Environment,
    ctx: RunContext | None = None,
    legacy: dict | None = None,
    write: bool = False,
    frames: dict[str, DataFrame] | None = None,
    keep_going: bool = False,
    journal: Journal | None = None,
) -> tuple[dict[str, DataFrame], list[dict]]:
    """Walk the graph once; every node becomes one DataFrame, shared by all nodes below it.

    With ``write`` each load node is written as it is reached. Nodes below a staging
    load then read what it wrote, and a node that feeds several others is written
    once to the scratch folder, so the work above is not done again.
    """
    ctx = ctx or RunContext()
    frames, results, lost = dict(frames or {}), [], {}
    writes = [n for n in graph.order if graph.nodes[n].type in LOADS or _loads_itself(graph.nodes[n])]
    units = {n: unit_name(graph.name, n, ctx.business_date, ctx.app_id) for n in writes}
    done = {n: journal.done(spark, units[n]) for n in writes} if write and journal else {}
    todo = {n for n in writes if not done.get(n)}
    # Without a load that is still to be written, a node has nothing to do.
    needed = {n for n in graph.nodes if not write or n in todo or todo & graph.reachable(n)}

    def make(node: Node, inputs: list[DataFrame]) -> DataFrame:
        nid, source = node.id, graph.is_source(node.id)
        if source or node.type in LOADS:
            df = _source(spark, graph, nid, env, ctx, legacy) if source else _together(inputs)
        else:
            df = _transform(node.type, node.config, inputs, env, ctx)
        if node.config.get("expect"):
            df = _reject(node, df, ctx) if write else split_valid(df, schema_from_descriptor(node.config["expect"]))[0]
        if write and nid in units:
            df, outcome = _write_node(spark, node, df, graph, env, ctx, units[nid] if journal else None)
            if journal:
                journal.finish(spark, units[nid], outcome)
            results.append({"node_id": nid, "type": node.type, "label": node.label, **outcome})
        elif write and _shared(graph, nid, needed):
            df = written(df, "shared")
        return df

    for nid in graph.order:
        node = graph.nodes[nid]
        if node.type == "iterator" or nid in frames:
            continue
        if done.get(nid):
            results.append({"node_id": nid, "type": node.type, "label": node.label, **done[nid], "resumed": True})
            if done[nid].get("passed") and nid in needed:
                frames[nid] = _passed_on(spark, done[nid])
            continue
        if nid not in needed:
            continue
        broken = [i for i in node.inputs if i in lost]
        try:
            if broken:
                raise RuntimeError(f"no rows from {', '.join(broken)}")
            frames[nid] = make(node, [frames[i] for i in node.inputs if i in frames])
        except Exception as err:
            if not keep_going:
                raise
            lost[nid] = (str(err).strip().splitlines() or [type(err).__name__])[0]
            results.append({"node_id": nid, "type": node.type, "label": node.label, "rows_loaded": 0, "error": lost[nid], "skipped": bool(broken)})
    return frames, results


def run(
    spark: SparkSession,
    graph: Graph,
    env: Environment,
    ctx: RunContext | None = None,
    legacy: dict | None = None,
    keep_going: bool = False,
    journal: str | None = None,
) -> list[dict]:
    """Run every load of the graph.

    An error stops the run, or, with ``keep_going``, what lies below the node:
    its result names the ``error``, those below are ``skipped``, other branches go
    on. With ``journal``, a shared folder, every load leaves a record when its
    rows are in place; another run with the same graph name, date and
    application goes on after the loads that have one (``resumed``).
    """
    return build(spark, graph, env, ctx, legacy, True, None, keep_going, Journal(journal) if journal else None)[1]


def observe_steps(df: DataFrame, steps: list[dict], env: Environment | None = None) -> tuple[DataFrame, dict]:
    """The steps with a row counter before and after each, filled by whatever action runs the plan.

    The counters are run statistics: a map task that Spark repeats after losing an
    executor is counted again. Counts of written rows do not have this weakness.
    """
    seen: dict[str, Observation] = {}

    def count(frame: DataFrame, name: str) -> DataFrame:
        seen[name] = Observation()
        return frame.observe(seen[name], F.count(F.lit(1)).alias("rows"))

    df = count(df, "input")
    for i, step in enumerate(steps, 1):
        df = count(apply_steps(df, [step], env), f"{i}:{step['type']}")
    return df, seen
