"""A stored inverted index of nodes: postings in buckets by term, with the length of their document, changed by file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.operators import search
from lattica.plans.ledger import GraphStore, Version


def _measured(nodes: DataFrame) -> DataFrame:
    """Nodes with ``len``, how many terms all their fields hold."""
    held = [f for f in search.FIELDS if f in nodes.columns]
    return nodes.withColumn("len", sum((F.size(search.tokens(F.coalesce(F.col(f), F.lit("")))) for f in held), F.lit(0)).cast("long"))


def postings(nodes: DataFrame) -> DataFrame:
    """(term, qualified_name, file_path, field, pos, len) of nodes; len counts all terms of the node and is carried along, not joined."""
    docs = _measured(nodes.select("qualified_name", F.col("file_path").alias("_file"), *(f for f in search.FIELDS if f in nodes.columns and f != "qualified_name")))
    rows = search.node_index(Graph(docs, nodes.limit(0)), keep=("_file", "len"))
    return rows.select("term", "qualified_name", F.col("_file").alias("file_path"), "field", "pos", "len")


def _lengths(nodes: DataFrame) -> DataFrame:
    """(file_path, docs, terms): what a file's nodes add to the number and the length of documents."""
    return _measured(nodes).filter("len > 0").groupBy("file_path").agg(F.count(F.lit(1)).alias("docs"), F.sum("len").alias("terms"))


def build(graph: GraphStore) -> Version:
    """Index all stored nodes anew."""

    def change(at: Version):
        nodes = graph.table("nodes", at)
        return {"postings": graph.replaced("postings", at, None, postings(nodes)), "lengths": graph.replaced("lengths", at, None, _lengths(nodes))}

    return graph.update(change)


def refresh(graph: GraphStore, files: DataFrame) -> Version:
    """Index again what the store holds of some files; buckets of terms that neither their old nor their new nodes have stay."""

    def change(at: Version):
        nodes, old = graph.table("nodes", at), graph.table("postings", at)
        asked = files.select("file_path").distinct()
        again = nodes.join(asked, "file_path", "left_semi")
        new = postings(again)
        gone = old.join(asked, "file_path", "left_semi").select("term")
        touched = graph.buckets_of("postings", at, gone) | graph.buckets_of("postings", at, new.select("term"))
        left = graph.table("postings", at, touched).join(asked, "file_path", "left_anti").select(*old.columns)
        staged = graph.stage("postings", at, left.unionByName(new)) if touched else {}
        return {"postings": (dict.fromkeys(touched) | staged, new.schema.toDDL()), "lengths": graph.replaced("lengths", at, asked, _lengths(again))}

    return graph.update(change)


def lookup(graph: GraphStore, query: str, at: Version | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings, stats) for a query: the buckets of its terms are read and no other."""
    at = at or graph.state()
    words = sorted(set(search.query_tokens(query)))
    terms = graph.spark.createDataFrame([(w,) for w in words], "term string")
    rows = graph.table("postings", at, graph.buckets_of("postings", at, terms)).filter(F.col("term").isin(*words))
    stats = graph.table("lengths", at).agg(F.sum("docs").alias("docs"), (F.sum("terms") / F.sum("docs")).alias("avg_len"))
    return rows, stats


def fts_search(graph: GraphStore, query: str, limit: int = 50) -> DataFrame:
    """(qualified_name, score) of nodes that hold the query as a phrase."""
    rows, stats = lookup(graph, query)
    return search.phrase_search(rows, "qualified_name", query, limit, stats)
