"""Scans, point lookups, filters and projections over nodes and edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica.functions import text as X
from lattica.graph import Graph


def scan_nodes(g: Graph, exclude_files: bool = True) -> DataFrame:
    return g.nodes.filter(F.col("kind") != "File") if exclude_files else g.nodes


def scan_edges(g: Graph) -> DataFrame:
    return g.edges


def point_node(g: Graph, qn: str) -> DataFrame:
    """The node of that name; failing that, of the name with a path in POSIX spelling."""
    posix = qn.replace("\\", "/")
    found = g.nodes.filter(F.col("qualified_name").isin(qn, posix))
    best = W.orderBy(F.when(F.col("qualified_name") == qn, 0).otherwise(1))
    return found.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")


def nodes_by_file(g: Graph, path: str) -> DataFrame:
    return g.nodes.filter(F.col("file_path") == path)


def nodes_by_kind(g: Graph, kinds: Sequence[str], file_pattern: str | None = None) -> DataFrame:
    """Nodes of some kinds, optionally with a substring (any case, SQL wildcards) in the path."""
    out = g.nodes.filter(F.col("kind").isin(*kinds))
    return out.filter(F.col("file_path").ilike(f"%{file_pattern}%")) if file_pattern else out


def edges_by_source(g: Graph, qn: str) -> DataFrame:
    return g.edges.filter(F.col("source_qualified") == qn)


def edges_by_target(g: Graph, qn: str) -> DataFrame:
    return g.edges.filter(F.col("target_qualified") == qn)


def edges_by_bare_target(g: Graph, name: str, kind: str = "CALLS", language: str | None = None) -> DataFrame:
    """Edges whose target is still the bare name; with a language, only from sources that may mean it."""
    out = g.edges.filter((F.col("target_qualified") == name) & (F.col("kind") == kind))
    if language is None:
        return out
    sources = g.nodes.filter(X.same_family(F.col("language"), F.lit(language))).select(F.col("qualified_name").alias("_qn"))
    return out.join(sources, F.col("source_qualified") == F.col("_qn"), "left_semi")


def nodes_by_qns(g: Graph, names: DataFrame) -> DataFrame:
    """Nodes of the names in a column ``qualified_name``."""
    return g.nodes.join(names.select("qualified_name").distinct(), "qualified_name", "left_semi")


def files_matching(g: Graph, pattern: str) -> DataFrame:
    return g.nodes.filter(F.col("file_path").ilike(f"%{pattern}")).select("file_path").distinct()


def all_files(g: Graph) -> DataFrame:
    """Paths of nodes that are not virtual, and of edges."""
    real = F.coalesce(F.get_json_object("extra", "$.virtual"), F.lit("false")) != "true"
    return g.nodes.filter(real).select("file_path").union(g.edges.select("file_path")).distinct()


def file_hashes(g: Graph) -> DataFrame:
    return g.nodes.filter(F.col("kind") == "File").select("file_path", "file_hash")


def file_markers(g: Graph) -> DataFrame:
    return g.nodes.filter(F.col("kind") == "File").select("file_path").distinct()


def exists(rows: DataFrame) -> DataFrame:
    """One row: whether there are any, from at most one row of input."""
    return rows.limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


def node_ids_by_files(g: Graph, paths: DataFrame) -> DataFrame:
    return g.nodes.join(paths.select("file_path").distinct(), "file_path", "left_semi").select("qualified_name")


def large_nodes(g: Graph, min_lines: int = 50, max_lines: int | None = None, kind: str | None = None, file_pattern: str | None = None, limit: int = 50) -> DataFrame:
    """Longest nodes with their line counts; hardware declarations are left out."""
    lines = F.col("line_end") - F.col("line_start") + 1
    out = g.nodes.withColumn("line_count", lines).filter((F.col("line_count") >= min_lines) & ~X.is_hdl(F.col("extra")))
    if max_lines is not None:
        out = out.filter(F.col("line_count") <= max_lines)
    if kind:
        out = out.filter(F.col("kind") == kind)
    if file_pattern:
        out = out.filter(F.col("file_path").ilike(f"%{file_pattern}%"))
    return out.orderBy(F.desc("line_count"), "qualified_name").limit(limit)


def qualified_tail(g: Graph, tail: str, limit: int = 20) -> DataFrame:
    """Nodes whose name after ``::``, or whole name, is ``tail``."""
    hit = (X.symbol(F.col("qualified_name")) == tail) | (F.col("qualified_name") == tail)
    return g.nodes.filter(hit).orderBy("qualified_name").limit(limit)


def count_by_name(g: Graph, name: str, language: str | None = None, kinds: Sequence[str] = ()) -> DataFrame:
    out = g.nodes.filter(F.col("name") == name)
    out = out.filter(F.col("language") == language) if language else out
    out = out.filter(F.col("kind").isin(*kinds)) if kinds else out
    return out.agg(F.count(F.lit(1)).alias("n"))


def nodes_without_signature(g: Graph) -> DataFrame:
    return g.nodes.filter(F.col("signature").isNull())


def with_signatures(g: Graph) -> DataFrame:
    """Nodes with a signature filled in where there is none."""
    made = X.signature(F.col("kind"), F.col("name"), F.col("params"), F.col("return_type"))
    return g.nodes.withColumn("signature", F.coalesce("signature", made))


def node_to_dict(nodes: DataFrame) -> DataFrame:
    keep = ("kind", "name", "qualified_name", "file_path", "line_start", "line_end", "language", "parent_name", "is_test")
    return nodes.select(*(X.sanitize(F.col(c)).alias(c) if c in ("name", "qualified_name", "parent_name") else F.col(c) for c in keep))


def edge_to_dict(edges: DataFrame, listed: int = 20) -> DataFrame:
    """Edges for output; candidate lists in ``extra`` are cut to ``listed``."""
    several = F.slice(F.coalesce(F.from_json(F.get_json_object("extra", "$.ambiguous_targets"), "array<string>"), F.array().cast("array<string>")), 1, listed)
    return edges.select("kind", X.sanitize(F.col("source_qualified")).alias("source"), X.sanitize(F.col("target_qualified")).alias("target"), "file_path", "line", several.alias("ambiguous_targets"))


def resolve_paths(g: Graph, path: str) -> DataFrame:
    """Stored paths that equal a user's path, else those that end in it."""
    files = g.nodes.select("file_path").distinct()
    exact = files.filter(F.col("file_path") == path)
    ends = files.filter(F.col("file_path").endswith("/" + path.lstrip("/")))
    none = exact.agg(F.count(F.lit(1)).alias("_n")).filter("_n = 0")
    return exact.union(ends.join(F.broadcast(none), F.lit(True), "left_semi"))


def select_minimal(rows: DataFrame, columns: Sequence[str], order: Sequence[str], first: int = 5) -> DataFrame:
    return rows.orderBy(*order).select(*columns).limit(first)
