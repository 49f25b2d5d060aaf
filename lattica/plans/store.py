"""Changes of graph tables as plain functions, and exports; ``ledger`` keeps what they return."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica import schemas
from lattica.functions import text as X
from lattica.graph import Graph
from lattica.operators.resolve import last_wins
from lattica.plans.ledger import GraphStore  # noqa: F401
from lattica.plans.materialise import keep

def upsert_nodes(nodes: DataFrame, new: DataFrame, seq: str = "seq") -> DataFrame:
    """Nodes with new rows over old ones of the same name; of several new rows the greatest ``seq`` stays."""
    fresh = last_wins(new, ["qualified_name"], seq).drop(seq)
    return nodes.join(fresh, "qualified_name", "left_anti").unionByName(fresh, allowMissingColumns=True)


def upsert_edges(edges: DataFrame, new: DataFrame, seq: str = "seq") -> DataFrame:
    key = list(schemas.EDGE_KEY)
    fresh = last_wins(new, key, seq).drop(seq)
    same = F.lit(True)
    keys = fresh.select(*(F.col(k).alias(f"_{k}") for k in key))
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return edges.join(keys, same, "left_anti").unionByName(fresh, allowMissingColumns=True)


def remove_files(g: Graph, files: DataFrame) -> Graph:
    """Without the rows that the files own; edges of other files into them stay."""
    f = files.select("file_path").distinct()
    return Graph(g.nodes.join(f, "file_path", "left_anti"), g.edges.join(f, "file_path", "left_anti"))


def remove_files_permanently(g: Graph, files: DataFrame) -> Graph:
    """Without the rows that the files own, and without any edge that touches their nodes."""
    f = files.select("file_path").distinct()
    gone = g.nodes.join(f, "file_path", "left_semi").select("qualified_name")
    left = remove_files(g, f)
    by = lambda e, end: e.join(gone.withColumnRenamed("qualified_name", end), end, "left_anti")
    return Graph(left.nodes, by(by(left.edges, "source_qualified"), "target_qualified"))


def replace_files(g: Graph, files: DataFrame, nodes: DataFrame, edges: DataFrame, seq: str = "seq") -> Graph:
    """The rows of the files replaced by new ones; of repeated nodes or call sites the last wins."""
    left = remove_files(g, files)
    return Graph(upsert_nodes(left.nodes, nodes, seq), upsert_edges(left.edges, edges, seq))


def change_detect(g: Graph, current: DataFrame) -> DataFrame:
    """(file_path, change): files whose content (file_path, content) differs from the stored hash, is new, or is gone."""
    stored = g.nodes.filter(F.col("kind") == "File").select("file_path", "file_hash")
    now = current.select("file_path", F.sha2("content", 256).alias("_now"))
    both = stored.join(now, "file_path", "full")
    change = F.when(F.col("_now").isNull(), "gone").when(F.col("file_hash").isNull(), "new").when(F.col("file_hash") != F.col("_now"), "changed")
    return both.select("file_path", change.alias("change")).filter("change is not null")


def delete_directories(g: Graph, directories: DataFrame) -> DataFrame:
    """Stored files below deleted directories (path), by a join on every ancestor of a file."""
    parts = F.split("file_path", "/")
    above = g.nodes.select("file_path").distinct().select("file_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("path"))
    return above.join(directories.select("path").distinct(), "path", "left_semi").select("file_path").distinct()


def json_lines(g: Graph) -> DataFrame:
    """A JSON line per row of every table that the graph has, with all its columns and the part it belongs to."""
    parts = {"node": g.nodes, "edge": g.edges, "flow": g.flows, "membership": g.memberships, "community": g.communities}
    lines = [rows.select(F.to_json(F.struct(F.lit(what).alias("type"), *rows.columns)).alias("value")) for what, rows in parts.items() if rows is not None]
    out = lines[0]
    for more in lines[1:]:
        out = out.union(more)
    return out


def export_json(g: Graph, path: str) -> None:
    """Write ``json_lines``."""
    json_lines(g).write.text(path)


def _xml(c):
    out = F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def graphml_lines(g: Graph) -> DataFrame:
    """GraphML elements of nodes and edges, a line each."""
    n = g.nodes.select(F.format_string('<node id="%s"><data key="kind">%s</data><data key="name">%s</data></node>', _xml("qualified_name"), _xml("kind"), _xml("name")).alias("value"))
    e = g.edges.select(F.format_string('<edge source="%s" target="%s"><data key="kind">%s</data></edge>', _xml("source_qualified"), _xml("target_qualified"), _xml("kind")).alias("value"))
    return n.union(e)


def cypher_lines(g: Graph) -> DataFrame:
    """Cypher statements that create the graph, a line each."""
    q = lambda c: F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    n = g.nodes.select(F.format_string("CREATE (:%s {qualified_name: '%s', name: '%s'});", F.col("kind"), q("qualified_name"), q("name")).alias("value"))
    e = g.edges.select(F.format_string("MATCH (a {qualified_name: '%s'}), (b {qualified_name: '%s'}) CREATE (a)-[:%s]->(b);", q("source_qualified"), q("target_qualified"), F.col("kind")).alias("value"))
    return n.union(e)


def wiki_pages(g: Graph, members: int = 50, deps: int = 15) -> DataFrame:
    """(community_id, page): markdown of members and of the communities most depended on."""
    from lattica.operators import ranking

    m = g.communities.join(g.nodes.select("qualified_name", "name", "kind"), "qualified_name")
    top = ranking.top_k_per_group(m, ["community_id"], ["qualified_name"], members)
    body = top.groupBy("community_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "name", "kind"))), lambda s: F.concat(F.lit("- "), s["name"], F.lit(" ("), s["kind"], F.lit(")"))), "\n").alias("body"))
    c = g.communities.select("qualified_name", "community_id")
    out = g.edges.join(c.select(F.col("qualified_name").alias("source_qualified"), F.col("community_id")), "source_qualified").join(c.select(F.col("qualified_name").alias("target_qualified"), F.col("community_id").alias("other")), "target_qualified").filter("community_id <> other").groupBy("community_id", "other").agg(F.count(F.lit(1)).alias("n"))
    far = ranking.top_k_per_group(out, ["community_id"], [F.desc("n"), "other"], deps).groupBy("community_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "other", "n"))), lambda s: F.concat(F.lit("- community "), s["other"].cast("string"), F.lit(": "), s["n"].cast("string"))), "\n").alias("deps"))
    return body.join(far, "community_id", "left").select("community_id", F.concat(F.lit("# Community "), F.col("community_id").cast("string"), F.lit("\n\n## Members\n"), "body", F.lit("\n\n## Depends on\n"), F.coalesce("deps", F.lit("none"))).alias("page"))


def referrers(g: Graph, files: DataFrame) -> DataFrame:
    """Files outside the given ones that refer to their nodes; to be read again when those are forgotten."""
    gone = g.nodes.join(files.select("file_path").distinct(), "file_path", "left_semi").select(F.col("qualified_name").alias("target_qualified"))
    return g.edges.join(gone, "target_qualified", "left_semi").select("file_path").distinct().join(files.select("file_path"), "file_path", "left_anti")


def with_symbols(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("symbol", X.symbol(F.col("qualified_name")))


#: What a page name leaves out, what becomes a hyphen in it, and how long it may be.
NOTE_DROPS, NOTE_GAPS, NOTE_LENGTH = r"(?U)[^\w\s-]", r"(?U)[\s_]+", 100


def note_names(nodes: DataFrame) -> DataFrame:
    """(qualified_name, page): a page name each. Of nodes whose names give one page the first by qualified name has it plain,
    the others end in eight digits of a hash of theirs."""
    kept = F.regexp_replace(F.lower(F.coalesce("name", "qualified_name")), NOTE_DROPS, "")
    plain = F.substring(F.regexp_replace(F.regexp_replace(kept, NOTE_GAPS, "-"), "^-+|-+$", ""), 1, NOTE_LENGTH)
    own = nodes.select("qualified_name", F.when(plain != "", plain).otherwise("unnamed").alias("_plain"))
    first = own.groupBy("_plain").agg(F.min("qualified_name").alias("_first"))
    page = F.when(F.col("qualified_name") == F.col("_first"), F.col("_plain")).otherwise(F.concat("_plain", F.lit("-"), F.substring(F.sha2("qualified_name", 256), 1, 8)))
    return own.join(first, "_plain").select("qualified_name", page.alias("page"))


def _noted(g: Graph) -> DataFrame:
    """Nodes with the name of their page and their community, stored, as several parts of a vault read them."""
    rows = g.nodes.join(note_names(g.nodes), "qualified_name").join(g.communities.select("qualified_name", "community_id"), "qualified_name", "left")
    return keep(rows.select("qualified_name", "name", "kind", "file_path", "language", "page", "community_id"), "notes")


def _text(c):
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def obsidian_index(g: Graph, noted: DataFrame | None = None) -> DataFrame:
    """(page, section, item, line) of the page ``_INDEX``, which reads no edge but to count them."""
    n = _noted(g) if noted is None else noted
    index = n.select(F.lit("_INDEX").alias("page"), F.lit(1).alias("section"), F.concat(_text("name"), F.lit("\x01"), F.col("page")).alias("item"), F.concat(F.lit("- [["), "page", F.lit("]] ("), _text("kind"), F.lit(")")).alias("line"))
    count = lambda rows, what, at: rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit("_INDEX").alias("page"), F.lit(0).alias("section"), F.lit(at).alias("item"), F.concat(F.lit(f"**{what}:** "), F.col("n").cast("string")).alias("line"))
    of = n.filter("community_id is not null").select("community_id").distinct()
    return count(g.nodes, "Nodes", "00").unionByName(count(g.edges, "Edges", "01")).unionByName(count(of, "Communities", "02")).unionByName(index)


def obsidian_links(g: Graph, noted: DataFrame | None = None) -> DataFrame:
    """(page, section, item, line): a line for each neighbour of a node, once, and a title before a page's first.

    Rows meet the neighbour's page first and their own page last; a pair's
    kinds meet where its neighbour lies and a page's lines where the page
    lies, so edges are shuffled twice in all.
    """
    pages = (_noted(g) if noted is None else noted).select("qualified_name", "page")
    end = lambda a, b: F.struct(F.col(a).alias("qualified_name"), F.col(b).alias("_other"))
    both = g.edges.select("kind", F.explode(F.array(end("source_qualified", "target_qualified"), end("target_qualified", "source_qualified"))).alias("_e")).select("_e.*", "kind")
    far = both.join(pages.select(F.col("qualified_name").alias("_other"), F.col("page").alias("to")), "_other")
    near = far.groupBy("_other", "qualified_name", "to").agg(F.min("kind").alias("kind")).select("qualified_name", "to", "kind").join(pages, "qualified_name")
    link = F.concat(F.lit("- "), "kind", F.lit(": [["), "to", F.lit("|"), F.initcap(F.replace("to", F.lit("-"), F.lit(" "))), F.lit("]]"))
    line = lambda item, text: F.struct(item.alias("item"), text.alias("line"))
    title, own = line(F.lit(""), F.lit("## Connections")), line(F.col("to"), link)
    placed = near.withColumn("_r", F.row_number().over(Window.partitionBy("qualified_name").orderBy("to")))
    lines = F.when(F.col("_r") == 1, F.array(title, own)).otherwise(F.array(own))
    return placed.select("page", F.lit(1).alias("section"), F.explode(lines).alias("_l")).select("page", "section", "_l.*")


def obsidian_lines(g: Graph, members: int = 50) -> DataFrame:
    """(page, section, item, line): the notes of a vault by lines, to be read in the order of the first three columns.

    A page per node (front matter, title, a link to each neighbour once), one
    per community with its first members, and ``_INDEX``. No page is gathered
    in one row, so a hub's links and the index may be of any length.
    """
    from lattica.operators import ranking

    n = _noted(g)
    head = F.filter(F.array(
        F.lit("---"), F.concat(F.lit("kind: "), _text("kind")), F.concat(F.lit("file: "), _text("file_path")), F.concat(F.lit("language: "), _text("language")),
        F.concat(F.lit("community: "), F.col("community_id").cast("string")), F.lit("tags:"), F.concat(F.lit("  - "), F.lower(_text("kind"))), F.lit("---"),
        F.concat(F.lit("# "), X.sanitize(F.coalesce("name", "qualified_name"))), F.lit(""), F.concat(F.lit("**Kind:** "), _text("kind")), F.concat(F.lit("**File:** `"), _text("file_path"), F.lit("`")),
    ), lambda x: x.isNotNull())
    heads = n.select("page", F.lit(0).alias("section"), F.posexplode(head).alias("_i", "line")).select("page", "section", F.format_string("%02d", "_i").alias("item"), "line")
    of = n.filter("community_id is not null")
    note = F.concat(F.lit("_COMMUNITY_"), F.col("community_id").cast("string"))
    sizes = of.groupBy("community_id").agg(F.count(F.lit(1)).alias("n")).select(note.alias("page"), F.lit(0).alias("section"), F.posexplode(F.array(F.concat(F.lit("# Community: community-"), F.col("community_id").cast("string")), F.concat(F.lit("**Size:** "), F.col("n").cast("string")), F.lit("## Members"))).alias("_i", "line")).select("page", "section", F.format_string("%02d", "_i").alias("item"), "line")
    top = ranking.top_k_per_group(of.select("community_id", "qualified_name", F.col("page").alias("to")), ["community_id"], ["qualified_name"], members)
    inside = top.select(note.alias("page"), F.lit(1).alias("section"), F.col("qualified_name").alias("item"), F.concat(F.lit("- [["), "to", F.lit("]]")).alias("line"))
    parts = [heads, obsidian_links(g, n), sizes, inside, obsidian_index(g, n)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def export_obsidian(g: Graph, path: str, files: int = 64) -> None:
    """Write the notes below ``path`` as rows (page, line), a page's rows in order and together in one of ``files`` files.

    A folder a page would be as many folders as nodes; who lays out a vault
    reads a file and splits it by page.
    """
    lines = obsidian_lines(g).repartition(files, "page").sortWithinPartitions("page", "section", "item")
    lines.select("page", "line").write.parquet(path)
