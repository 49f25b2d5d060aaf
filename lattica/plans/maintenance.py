"""Upkeep of a stored graph: builds, updates by changed files, and forgetting; each is one commit.

A parser is any function from rows (file_path, content, ...) to a Graph whose
rows carry ``seq``; a file for which it gives no node has failed and keeps what
is stored of it.  Passes are resolvers of the whole graph, run when a file of
their kind has changed; of what they rewrite, only the buckets that differ are
written.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica import schemas
from lattica.functions import text as X
from lattica.graph import Graph
from lattica.operators import resolve
from lattica.plans import impact, store
from lattica.plans.ledger import GraphStore, Version
from lattica.plans.materialise import discard, keep

Parser = Callable[[DataFrame], Graph]


@dataclass(frozen=True)
class Pass:
    """A resolver (edges out of a graph) and the endings of the files that call for it."""

    run: Callable[[Graph], DataFrame]
    suffixes: tuple[str, ...] = ()


#: Which changed files call for which resolver; those without endings always run.
PASSES = (
    Pass(resolve.resolve_python_imports, (".py",)),
    Pass(resolve.resolve_rescript, (".res", ".resi")),
    Pass(resolve.resolve_spring_di, (".java",)),
    Pass(resolve.resolve_hcl, (".tf", ".hcl")),
    Pass(resolve.resolve_scoped, (".php", ".rs", ".cs")),
    Pass(resolve.resolve_temporal, (".java",)),
    Pass(resolve.resolve_bare_calls),
)


def resolved(g: Graph, passes: Sequence[Pass], touched: DataFrame | None = None) -> DataFrame:
    """Edges after the passes, in their order, with the columns that they had; ``touched`` (file_path) gates them."""
    have = set(g.edges.columns)
    endings = tuple({s for p in passes for s in p.suffixes})
    called = None
    if touched is not None and endings:
        own = F.concat(F.lit("."), F.substring_index("file_path", ".", -1))
        called = {r["s"] for r in touched.select(own.alias("s")).filter(F.col("s").isin(*endings)).distinct().collect()}
    edges = g.edges if "extra" in have else g.edges.withColumn("extra", F.lit("{}"))
    due = [p for p in passes if not p.suffixes or called is None or called & set(p.suffixes)]
    if not due:
        return g.edges
    edges = keep(edges, "edges")
    for p in due:  # each names the edges several times, so the plan would grow as a power of the passes
        after = keep(p.run(g.with_(edges=edges)).select(*edges.columns), "edges")
        discard(edges)
        edges = after
    return edges.select(*g.edges.columns)


def hashed(current: DataFrame) -> DataFrame:
    """(file_path, _hash): the content hash of each file of a listing (file_path, content)."""
    return current.select("file_path", F.sha2(F.col("content").cast("binary"), 256).alias("_hash"))


def _parsed(parse: Parser, files: DataFrame) -> Graph:
    """The parser's rows, one per name and call site, with the content's hash on file nodes."""
    new = parse(files)
    names = store.last_wins(new.nodes, ["qualified_name"], "seq").drop("seq", "file_hash")
    nodes = names.join(hashed(files), "file_path", "left").withColumn("file_hash", F.when(F.col("kind") == "File", F.col("_hash"))).drop("_hash")
    return Graph(nodes, store.last_wins(new.edges, list(schemas.EDGE_KEY), "seq").drop("seq"))


def build(current: DataFrame, parse: Parser, passes: Sequence[Pass] = PASSES, derive: Callable[[Graph], Graph] | None = None) -> Graph:
    """The graph of a whole listing."""
    g = _parsed(parse, current)
    g = g.with_(edges=resolved(g, passes))
    return derive(g) if derive else g


def dependents(g: Graph, files: DataFrame, hops: int = 2) -> DataFrame:
    """(file_path, hop): files that depend on any of the files, by edges into their nodes."""
    owner = g.nodes.select(F.col("qualified_name").alias("target_qualified"), F.col("file_path").alias("src"))
    steps = g.edges.filter(~F.col("kind").isin("CONTAINS", "TESTED_BY")).join(owner, "target_qualified").select("src", F.col("file_path").alias("dst")).filter("src <> dst")
    return impact.reach(steps, files.select(F.col("file_path").alias("node")), hops).filter("hop > 0").select(F.col("node").alias("file_path"), "hop")


def _moved(graph: GraphStore, at: Version, name: str, old: DataFrame, new: DataFrame, files: DataFrame):
    """Staged buckets of ``new`` where it differs from ``old`` or holds one of ``files``."""
    same = [c for c in new.columns if c in old.columns]
    # a row a bucket and side comes back: how many rows, and two 64-bit hashes of each summed; no row is shuffled
    nulls = [F.col(c).isNull() for c in same]  # hashes pass over nulls
    summed = [F.sum(F.xxhash64(F.lit(seed), *nulls, *same).cast("decimal(20,0)")) for seed in (1, 2)]
    marks = lambda rows: {r["_b"]: tuple(r)[1:] for r in rows.groupBy(graph.bucket(name, at).alias("_b")).agg(F.count(F.lit(1)), *summed).collect()}
    before, after = marks(old), marks(new)
    touched = graph.buckets_of(name, at, files) | {b for b in before.keys() | after.keys() if before.get(b) != after.get(b)}
    moved = dict.fromkeys(touched) | graph.stage(name, at, new.filter(graph.bucket(name, at).isin(*touched))) if touched else {}
    return moved, new.schema.toDDL()


def _stored_as(rows: DataFrame, old: DataFrame) -> DataFrame:
    """``rows`` with all columns of the table they join, null where they have none."""
    return old.limit(0).unionByName(rows, allowMissingColumns=True)


def incremental_update(
    graph: GraphStore,
    current: DataFrame,
    parse: Parser,
    changed: DataFrame | None = None,
    *,
    passes: Sequence[Pass] = PASSES,
    reconcile: bool = True,
    derive: Callable[[Graph], Graph] | None = None,
    hops: int = 2,
    note: dict[str, str] | None = None,
) -> DataFrame:
    """Bring the stored graph up to a listing (file_path, content); returns (file_path, outcome).

    Asked for are the ``changed`` files, those queued for another reading and,
    with ``reconcile``, all whose content hash differs from the stored one or
    that are new.  These and their dependents are parsed again unless their
    hash is the stored one ("parsed", "unchanged", "failed"); stored files that
    the listing lacks go ("stale" when reconciling, else "missing" if asked
    for), with every edge that touches their nodes.  Without ``reconcile`` the
    work follows the files asked for.  Flows and communities are derived again
    if ``derive`` is given.
    """
    result: dict[str, DataFrame] = {}

    def change(at: Version):
        nodes, edges = graph.table("nodes", at), graph.table("edges", at)
        spark = graph.spark
        nodes = spark.createDataFrame([], schemas.NODES) if nodes is None else nodes
        edges = spark.createDataFrame([], schemas.EDGES) if edges is None else edges
        nodes = nodes if "file_hash" in nodes.columns else nodes.withColumn("file_hash", F.lit(None).cast("string"))
        g = Graph(nodes, edges)
        stored = nodes.filter(F.col("kind") == "File").groupBy("file_path").agg(F.max("file_hash").alias("_old"))
        known = nodes.select("file_path").distinct()
        now = hashed(current)
        asked = changed.select("file_path") if changed is not None else current.select("file_path").limit(0)
        if (queue := graph.table("queue", at)) is not None:
            asked = asked.union(queue.select("file_path"))
        stale = known.limit(0)
        if reconcile:
            both = now.join(stored, "file_path", "left")
            asked = asked.union(both.filter(F.col("_old").isNull() | (F.col("_old") != F.col("_hash"))).select("file_path"))
            stale = known.join(now, "file_path", "left_anti")
        asked = keep(asked.distinct(), "asked")
        near = dependents(g, asked, hops).select("file_path").join(asked, "file_path", "left_anti") if nodes.columns else asked.limit(0)
        every = asked.withColumn("dependent", F.lit(False)).union(near.withColumn("dependent", F.lit(True)))
        seen = every.join(now, "file_path", "left").join(stored, "file_path", "left").join(known.withColumn("_known", F.lit(True)), "file_path", "left")
        state = F.when(F.col("_hash").isNull() & F.col("_known"), "missing").when(F.col("_hash").isNull(), "unknown").when(F.col("_hash").eqNullSafe(F.col("_old")), "unchanged").otherwise("read")
        state = keep(seen.select("file_path", "dependent", state.alias("outcome")).union(stale.join(every.select("file_path"), "file_path", "left_anti").select("file_path", F.lit(False), F.lit("stale"))), "state")
        reading = state.filter("outcome = 'read'").select("file_path")
        new = _parsed(parse, current.join(reading, "file_path", "left_semi"))
        new = Graph(keep(_stored_as(new.nodes, nodes), "nodes"), keep(_stored_as(new.edges, edges), "edges"))
        read = reading.join(new.nodes.select("file_path").distinct(), "file_path", "left_semi")
        gone = state.filter("outcome IN ('missing', 'stale')").select("file_path")
        files = keep(read.union(gone), "files")
        lost = nodes.join(gone, "file_path", "left_semi").select("qualified_name")
        left = edges.join(files, "file_path", "left_anti")
        for end in ("source_qualified", "target_qualified"):
            left = left.join(lost.withColumnRenamed("qualified_name", end), end, "left_anti")
        after = Graph(nodes.join(files, "file_path", "left_anti").select(*nodes.columns).unionByName(new.nodes, allowMissingColumns=True), left.select(*edges.columns).unionByName(new.edges.join(read, "file_path", "left_semi"), allowMissingColumns=True))
        done = keep(resolved(after, passes, files), "edges")
        told = state.join(read.withColumn("_read", F.lit(True)), "file_path", "left").select("file_path", F.when(F.col("outcome") != "read", F.col("outcome")).when(F.col("_read"), "parsed").otherwise("failed").alias("outcome"), "dependent")
        result["told"] = keep(told, "told")
        out = {"nodes": graph.replaced("nodes", at, files, new.nodes), "edges": _moved(graph, at, "edges", edges, done, files)}
        said = dict(note or {})
        if not files.isEmpty():
            said["last_build_type"] = "incremental"
        if said:
            rows = spark.createDataFrame(sorted(said.items()), "key string, value string")
            if "last_build_type" in said:
                rows = rows.union(spark.range(1).select(F.lit("last_updated"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")))
            out["metadata"] = graph.replaced("metadata", at, rows, rows)
        if queue is not None:
            out["queue"] = graph.replaced("queue", at, queue, None)
        if derive:
            out |= _derived(graph, at, derive(after.with_(edges=done)))
        for held in (asked, state, new.nodes, new.edges, files, done):
            discard(held)
        return out

    graph.update(change)
    return result["told"]


def _derived(graph: GraphStore, at: Version, g: Graph):
    """Derived tables of ``g`` in place of the stored ones."""
    return {n: graph.replaced(n, at, None, getattr(g, n)) for n in ("flows", "memberships", "communities") if getattr(g, n) is not None}


def forget(
    graph: GraphStore,
    files: DataFrame,
    current: DataFrame | None = None,
    parse: Parser | None = None,
    *,
    passes: Sequence[Pass] = PASSES,
    derive: Callable[[Graph], Graph] | None = None,
) -> DataFrame:
    """Drop files so that the rest is as if they had never been built; returns (file_path, outcome) of them and their referrers.

    Referrers are read again where ``current`` holds them; elsewhere their ends
    in forgotten nodes fall back to bare names, and they are queued for the next
    update.  All passes run, since one file less can make another the only
    choice.  Vectors of forgotten nodes go in the same commit; flows and
    communities are derived again, or without ``derive`` lose what touches them.
    """
    result: dict[str, DataFrame] = {}

    def change(at: Version):
        nodes, edges = graph.table("nodes", at), graph.table("edges", at)
        if nodes is None:
            result["told"] = files.select("file_path", F.lit("unknown").alias("outcome"))
            return {}
        asked = files.select("file_path").distinct()
        lost = keep(nodes.join(asked, "file_path", "left_semi").select("qualified_name").distinct(), "lost")
        ends = edges.select("file_path", F.explode(F.array("source_qualified", "target_qualified")).alias("qualified_name"))
        referring = keep(ends.join(lost, "qualified_name", "left_semi").select("file_path").distinct().join(asked, "file_path", "left_anti"), "referrers")
        new = Graph(nodes.limit(0), edges.limit(0))
        if parse is not None and current is not None:
            again = _parsed(parse, current.join(referring, "file_path", "left_semi"))
            new = Graph(_stored_as(again.nodes, nodes), _stored_as(again.edges, edges))
        new = Graph(keep(new.nodes, "nodes"), keep(new.edges, "edges"))
        read = new.nodes.select("file_path").distinct()
        replaced = keep(asked.union(read), "files")
        left = edges.join(replaced, "file_path", "left_anti")
        for end in ("source_qualified", "target_qualified"):
            gone = lost.select(F.col("qualified_name").alias(end), F.lit(True).alias("_gone"))
            bare = F.when(F.col(end).contains("::"), X.last_segment(X.last_segment(F.col(end)), ".")).otherwise(F.col(end))  # a file's path stays what it is
            left = left.join(gone, end, "left").withColumn(end, F.when(F.col("_gone"), bare).otherwise(F.col(end))).drop("_gone")
        after = Graph(nodes.join(replaced, "file_path", "left_anti").select(*nodes.columns).unionByName(new.nodes, allowMissingColumns=True), left.select(*edges.columns).unionByName(new.edges, allowMissingColumns=True))
        done = keep(resolved(after, passes), "edges")
        waiting = referring.join(read, "file_path", "left_anti")
        told = asked.select("file_path", F.lit("forgotten").alias("outcome")).union(read.select("file_path", F.lit("parsed"))).union(waiting.select("file_path", F.lit("queued")))
        result["told"] = keep(told, "told")
        out = {"nodes": graph.replaced("nodes", at, replaced, new.nodes), "edges": _moved(graph, at, "edges", edges, done, replaced)}
        if not waiting.isEmpty():
            out["queue"] = graph.replaced("queue", at, waiting, waiting)
        if graph.table("vectors", at) is not None:
            out["vectors"] = graph.replaced("vectors", at, lost, None)
        if derive:
            out |= _derived(graph, at, derive(after.with_(edges=done)))
        else:
            if (held := graph.table("memberships", at)) is not None:
                flows = held.join(lost, "qualified_name", "left_semi").select("flow_id").distinct()
                out["memberships"] = graph.replaced("memberships", at, flows, None)
                if graph.table("flows", at) is not None:
                    out["flows"] = graph.replaced("flows", at, flows, None)
            if graph.table("communities", at) is not None:
                out["communities"] = graph.replaced("communities", at, lost, None)
        return out

    graph.update(change)
    return result["told"]
