"""More registered queries: services and events, resolvers, text functions, readers, logs and summaries."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from lattica.catalog import _CRIT, _DEG, _ENTRY, _HIT, _RISK, _RISKS, _SP, ORACLES, QUERIES, A, B, _calls_with, _files, _flat, _impact_sql, _spans_of, _table, add, add_plain, add_sf, traced
from lattica.functions import text as X
from lattica.graph import Graph
from lattica.operators import aggregates, lookups, patterns, ranges, ranking, resolve, search
from lattica.plans import flows, impact, maintenance, review, savings, store
from lattica.plans.materialise import shared_dir
from lattica.sources import files, history
from lattica.streaming import watch

# -- a service graph over nations and regions ------------------------------------------------------
_SVC = "concat('/svc/n', cast(n_nationkey as string), '.java::Svc', cast(n_nationkey as string), '.serve_', cast(n_nationkey as string))"
_SPATH = "concat('/svc/n', cast(n_nationkey as string), '.java')"
SERVICE_NODES = f"""
SELECT 'Function' AS kind, concat('serve_', cast(n_nationkey as string)) AS name, {_SVC} AS qualified_name, {_SPATH} AS file_path, 'java' AS language, concat('Svc', cast(n_nationkey as string)) AS parent_name, false AS is_test, '{{{{}}}}' AS extra FROM {{nation}}
UNION ALL SELECT 'Endpoint', concat('/', cast(r_regionkey as string)), concat('endpoint:/', cast(r_regionkey as string)), '/svc/api.java', 'java', cast(null as string), false, '{{{{}}}}' FROM {{region}}
UNION ALL SELECT 'Scheduler', concat('every', cast(r_regionkey as string)), concat('scheduler:', cast(r_regionkey as string)), '/svc/api.java', 'java', cast(null as string), false, '{{{{}}}}' FROM {{region}}
""".replace("{{{{}}}}", "{{}}")
SERVICE_EDGES = f"""
SELECT 'HANDLES' AS kind, {_SVC} AS source_qualified, concat('endpoint:/', cast(n_regionkey as string)) AS target_qualified, {_SPATH} AS file_path, cast(1 as int) AS line FROM {{nation}}
UNION ALL SELECT 'TRIGGERS', concat('scheduler:', cast(n_regionkey as string)), {_SVC}, '/svc/api.java', cast(2 as int) FROM {{nation}} WHERE n_nationkey % 2 = 0
UNION ALL SELECT 'PUBLISHES', {_SVC}, concat('event:e', cast(n_regionkey as string)), {_SPATH}, cast(3 as int) FROM {{nation}} WHERE n_nationkey % 4 = 1
UNION ALL SELECT 'HANDLES', {_SVC}, concat('event:e', cast(n_regionkey as string)), {_SPATH}, cast(4 as int) FROM {{nation}} WHERE n_nationkey % 3 = 0
UNION ALL SELECT 'CONSUMES', {_SVC}, CASE WHEN n_nationkey % 5 = 0 THEN 'config:app.*' ELSE concat('config:app.r', cast(n_regionkey as string)) END, {_SPATH}, cast(5 as int) FROM {{nation}}
UNION ALL SELECT 'CALLS', {_SVC}, concat('Svc', cast((n_nationkey + 1) % 25 as string), '::serve_', cast((n_nationkey + 1) % 25 as string)), {_SPATH}, cast(6 as int) FROM {{nation}}
"""


def service_graph(spark: SparkSession, sf_dir: str) -> Graph:
    t = {n: _table(spark, sf_dir, n) for n in ("nation", "region")}
    edges = spark.sql(SERVICE_EDGES, nation=t["nation"]).withColumn("extra", F.lit("{}"))
    return Graph(spark.sql(SERVICE_NODES, **t), edges)


_plain = lambda sql: _flat(sql.format(nation="nation", region="region"))
_SN, _SE = f"SN AS ({_plain(SERVICE_NODES)})", f"SE AS ({_plain(SERVICE_EDGES)})"


def add_service(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(service_graph(spark, sf_dir))
    if sql:
        ORACLES[name] = f"WITH {_SN}, {_SE} {_flat(sql)}"


_SHOW = "qualified_name, kind, name, file_path"
_in = lambda kind, far, near, value: f"SELECT {_SHOW} FROM SN WHERE qualified_name IN (SELECT {far} FROM SE WHERE kind = '{kind}' AND {near} = '{value}')"
_S3 = "/svc/n3.java::Svc3.serve_3"
add_service("handlers_of", lambda g: patterns.handlers_of(g, "endpoint:/2"), _in("HANDLES", "source_qualified", "target_qualified", "endpoint:/2"))
add_service("endpoints_for", lambda g: patterns.endpoints_for(g, _S3), _in("HANDLES", "target_qualified", "source_qualified", _S3) + " AND kind = 'Endpoint'")
add_service("triggers_of", lambda g: patterns.triggers_of(g, "scheduler:1"), _in("TRIGGERS", "target_qualified", "source_qualified", "scheduler:1"))
add_service("triggered_by", lambda g: patterns.triggered_by(g, "/svc/n2.java::Svc2.serve_2"), _in("TRIGGERS", "source_qualified", "target_qualified", "/svc/n2.java::Svc2.serve_2"))
add_service("publishers_of", lambda g: patterns.publishers_of(g, "event:e1"), _in("PUBLISHES", "source_qualified", "target_qualified", "event:e1"))
add_service("listeners_of", lambda g: patterns.listeners_of(g, "event:e1"), _in("HANDLES", "source_qualified", "target_qualified", "event:e1"))
add_service("consumers_of", lambda g: patterns.consumers_of(g, "app.r1"), f"SELECT {_SHOW} FROM SN WHERE qualified_name IN (SELECT source_qualified FROM SE WHERE kind = 'CONSUMES' AND target_qualified IN ('config:app.r1', 'config:app.*', 'config:app.r1.*'))")
add_service("resolve_events", lambda g: resolve.event_calls(g).select("source_qualified", "target_qualified", "confidence"), "SELECT DISTINCT p.source_qualified, h.source_qualified AS target_qualified, 0.95e0 AS confidence FROM SE p JOIN SE h ON p.target_qualified = h.target_qualified WHERE p.kind = 'PUBLISHES' AND h.kind = 'HANDLES'")
add_service("event_nodes", lambda g: resolve.event_nodes(g).select("qualified_name"), "SELECT DISTINCT target_qualified AS qualified_name FROM SE WHERE kind IN ('PUBLISHES', 'HANDLES') AND target_qualified NOT IN (SELECT qualified_name FROM SN)")
add_service("resolve_scoped", lambda g: resolve.resolve_scoped(g).filter("kind = 'CALLS'").select("source_qualified", "target_qualified"), "SELECT source_qualified, coalesce(n.qualified_name, target_qualified) AS target_qualified FROM SE LEFT JOIN SN n ON concat(n.parent_name, '::', n.name) = target_qualified WHERE SE.kind = 'CALLS'")


def _dotted(g: Graph) -> Graph:
    """Imports of the derived graph written as dotted modules."""
    mod = F.regexp_replace(F.regexp_replace("file_path", r"^/src/", "src."), r"\.py$", "")
    more = g.edges.filter("kind = 'IMPORTS_FROM'").withColumn("target_qualified", mod).withColumn("extra", F.lit("{}"))
    return g.with_(edges=more)


add("resolve_python_imports", lambda g: resolve.resolve_python_imports(_dotted(g)).select("source_qualified", "target_qualified"), "SELECT source_qualified, file_path AS target_qualified FROM E WHERE kind = 'IMPORTS_FROM'")
add("viz_resolve_target", lambda g: resolve.resolve_for_display(g.with_(edges=g.edges.filter("kind = 'CONTAINS'").withColumn("target_qualified", X.last_segment(F.col("target_qualified"))).withColumn("extra", F.lit("{}")))).filter("source_qualified like '/src/%'").select("source_qualified", "target_qualified"), "SELECT source_qualified, target_qualified FROM E WHERE kind = 'CONTAINS' AND source_qualified LIKE '/src/%'")

# -- lookups and predicates ------------------------------------------------------------------------
_ID = "md5(qualified_name)"
add("point_node_id", lambda g: g.nodes.filter(F.md5("qualified_name") == F.md5(F.lit(A))).select("qualified_name", "kind"), f"SELECT qualified_name, kind FROM N WHERE {_ID} = md5('{A}')")
add("node_kind_by_id", lambda g: g.nodes.filter(F.md5("qualified_name") == F.md5(F.lit(A))).select("kind"), f"SELECT kind FROM N WHERE {_ID} = md5('{A}')")
add("file_hashes", lambda g: lookups.file_hashes(g.with_(nodes=g.nodes.withColumn("file_hash", F.sha2("file_path", 256)))), "SELECT file_path, sha256(file_path) AS file_hash FROM N WHERE kind = 'File'")
add("nodes_without_signature", lambda g: lookups.nodes_without_signature(g.with_(nodes=g.nodes.withColumn("signature", F.when(F.col("kind") == "File", F.col("name"))))).select("qualified_name"), "SELECT qualified_name FROM N WHERE kind <> 'File'")
add("edge_to_dict", lambda g: lookups.edge_to_dict(g.edges.withColumn("extra", F.lit('{"ambiguous_targets": ["a", "b"]}'))).select("source", "target", F.size("ambiguous_targets").alias("listed")), "SELECT source_qualified AS source, target_qualified AS target, 2 AS listed FROM E")
add("is_test_file", lambda g: g.nodes.withColumn("p", F.concat(F.lit("/x/test_"), "name", F.lit(".py"))).filter(X.is_test_file(F.col("p")) & ~X.is_test_file(F.col("file_path"))).select("qualified_name"), "SELECT qualified_name FROM N WHERE name NOT LIKE '%/%'")
add("entry_name", lambda g: g.nodes.filter(X.is_entry_name(F.col("name"), F.col("language"))).select("qualified_name"), "SELECT qualified_name FROM N WHERE starts_with(name, 'test_')")
add("entry_decorator", lambda g: g.nodes.filter(X.is_entry_decorator(F.col("extra"))).select("qualified_name"), "SELECT qualified_name FROM N WHERE extra LIKE '%app.get%'")
add("is_test_community", lambda g: g.nodes.select("qualified_name", X.is_test_community(F.concat(F.lower("kind"), F.lit("-"), "name")).alias("t")), "SELECT qualified_name, kind = 'Test' AS t FROM N")
add("java_fqn_shape", lambda g: g.nodes.filter(X.is_java_name(F.concat(F.lit("com.x."), "name"))).select("qualified_name"), "SELECT qualified_name FROM N WHERE kind <> 'File'")
add("overlap_filter", lambda g: g.nodes.filter("line_start <= 200 and line_end >= 100").select("qualified_name"), "SELECT qualified_name FROM N WHERE line_start <= 200 AND line_end >= 100")
add("select_minimal", lambda g: lookups.select_minimal(g.nodes, ["qualified_name", "kind"], ["qualified_name"]), "SELECT qualified_name, kind FROM N ORDER BY 1 LIMIT 5")
add("sanitize", lambda g: g.nodes.select("qualified_name", X.sanitize(F.concat("name", F.lit("\x01\x07"))).alias("clean")), "SELECT qualified_name, name AS clean FROM N")
add("sentinel_limit", lambda g: ranking.sentinel_limit(g.edges.select("source_qualified").distinct(), ["source_qualified"], 5), "SELECT source_qualified, (SELECT count(DISTINCT source_qualified) FROM E) > 5 AS truncated FROM (SELECT DISTINCT source_qualified FROM E ORDER BY 1 LIMIT 5) x")
add("union_files", lambda g: g.nodes.select("file_path").union(g.edges.select("file_path")).distinct(), "SELECT file_path FROM N UNION SELECT file_path FROM E")
add("union_all_directions", lambda g: g.edges.select("source_qualified", "target_qualified").union(g.edges.select("target_qualified", "source_qualified")), "SELECT source_qualified, target_qualified FROM E UNION ALL SELECT target_qualified, source_qualified FROM E")
add("set_intersect", lambda g: g.edges.select(F.col("target_qualified").alias("q")).intersect(g.nodes.select(F.col("qualified_name").alias("q"))), "SELECT target_qualified AS q FROM E INTERSECT SELECT qualified_name FROM N")
add("token_budget_prefix", lambda g: ranking.token_budget_prefix(g.nodes.select("qualified_name"), ["qualified_name"], X.estimate_tokens(F.col("qualified_name")), 300), "SELECT * FROM (SELECT qualified_name, cast(sum(cast(ceil(length(qualified_name) / 4.0) AS bigint)) OVER (ORDER BY qualified_name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bigint) AS used FROM N) x WHERE used <= 300")
add("community_ids_for", lambda g: g.nodes.filter(F.col("file_path") == A).select("qualified_name").join(g.communities, "qualified_name"), f"SELECT qualified_name, community_id FROM C JOIN N USING (qualified_name) WHERE file_path = '{A}'")
add("get_community", lambda g: g.communities.filter("community_id = 3").join(g.nodes.select("qualified_name", "kind"), "qualified_name"), "SELECT qualified_name, community_id, kind FROM C JOIN N USING (qualified_name) WHERE community_id = 3")
add("knowledge_gaps", lambda g: aggregates.isolated_nodes(g).select(F.lit("isolated").alias("gap"), F.col("qualified_name").alias("subject")).union(aggregates.thin_communities(g).select(F.lit("thin"), F.col("community_id").cast("string"))).union(aggregates.untested_hotspots(g).select(F.lit("hotspot"), "qualified_name")).union(aggregates.single_file_communities(g).select(F.lit("single_file"), F.col("community_id").cast("string"))), """SELECT 'isolated' AS gap, subject FROM (SELECT N.qualified_name AS subject FROM N LEFT JOIN D USING (qualified_name) WHERE N.kind <> 'File' AND coalesce(degree, 0) <= 1 ORDER BY 1 LIMIT 50) a UNION ALL SELECT 'thin', cast(community_id AS varchar) FROM C GROUP BY community_id HAVING count(*) < 3
  UNION ALL SELECT 'hotspot', subject FROM (SELECT N.qualified_name AS subject FROM N JOIN D USING (qualified_name) WHERE N.kind <> 'File' AND NOT is_test AND degree >= 5 AND qualified_name NOT IN (SELECT source_qualified FROM E WHERE kind = 'TESTED_BY') ORDER BY degree DESC, 1 LIMIT 20) b
  UNION ALL SELECT 'single_file', cast(community_id AS varchar) FROM C JOIN N USING (qualified_name) GROUP BY community_id HAVING count(DISTINCT file_path) = 1 AND count(*) >= 3""", _DEG)
add("flow_qns", lambda g: (lambda h: flows.members_of(h, h.flows.orderBy("entry").limit(1)).select("qualified_name").distinct())(traced(g)), "SELECT DISTINCT qualified_name FROM flow WHERE entry = (SELECT min(entry) FROM critic)", _CRIT, True)
add("flow_position", lambda g: traced(g, True).memberships.select("entry", "qualified_name", "position"))
add("flow_order", lambda g: traced(g, True).memberships.groupBy("entry").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("position").alias("places"), F.max("position").alias("last")), "SELECT entry, count(*) AS n, count(*) AS places, count(*) - 1 AS last FROM flow GROUP BY 1", _CRIT, True)
add("flow_criticalities", lambda g: flows.flow_counts(traced(g)).withColumn("criticality", F.round("criticality", 6)), "SELECT qualified_name, count(*) AS flows, round(sum(criticality), 6) AS criticality FROM flow JOIN critic USING (entry) GROUP BY 1", _CRIT, True)
add("store_flows", lambda g: _snapshot(traced(g)).flows.select("entry", "node_count", "file_count", "depth"), "SELECT entry, node_count, file_count, depth FROM critic", _CRIT, True)
add("store_communities", lambda g: _snapshot(g).communities.select("qualified_name", "community_id"), "SELECT qualified_name, community_id FROM C")
add("pr_risk_band", lambda g: aggregates.risk_index(g).select("qualified_name", review.risk_band(F.col("risk_score")).alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("n")), f"SELECT CASE WHEN risk_score > 0.7e0 THEN 'high' WHEN risk_score > 0.4e0 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM ({_RISK}) r GROUP BY 1")
add("review_context", lambda g: review.review_context(g, _files(g, A)).select("part", "subject"))
add("minimal_context", lambda g: review.minimal_context(g, _spans_of(g)), "SELECT 'nodes' AS what, cast(count(*) AS varchar) AS value FROM N UNION ALL SELECT 'edges', cast(count(*) AS varchar) FROM E UNION ALL SELECT 'files', cast(count(*) AS varchar) FROM N WHERE kind = 'File' UNION ALL (SELECT 'changed', h.qualified_name FROM (" + _HIT + ") h JOIN risk USING (qualified_name) JOIN N ON N.qualified_name = h.qualified_name WHERE h.kind IN ('Function', 'Test', 'Class') AND NOT coalesce(N.extra LIKE '%verilog_kind%', false) ORDER BY round(risk_score, 9) DESC, 2 LIMIT 5)", _SP + ", " + _calls_with + ", " + _RISKS)
add("relevant_lines", lambda g: ranges.merge_windows(g.nodes.filter((F.col("file_path") == A) & (F.col("kind") == "Function")).select("file_path", F.col("line_start").alias("start"), F.col("line_end").alias("end"))),
    f"SELECT file_path, min(s) AS start, max(e) AS \"end\" FROM (SELECT *, sum(fresh) OVER (ORDER BY s, e ROWS UNBOUNDED PRECEDING) g FROM (SELECT file_path, s, e, CASE WHEN s > max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 OR max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NULL THEN 1 ELSE 0 END fresh FROM (SELECT file_path, greatest(line_start - 2, 1) s, line_end + 2 e FROM N WHERE file_path = '{A}' AND kind = 'Function') a) b) c GROUP BY file_path, g")


def _kept(g: Graph) -> store.GraphStore:
    """A new store that holds the graph, files with the hash of their path as content."""
    kept = store.GraphStore(g.nodes.sparkSession, f"{shared_dir(g.nodes.sparkSession)}/lattica/store-{uuid.uuid4().hex}", 16)
    kept.write(g.with_(nodes=g.nodes.withColumn("file_hash", F.when(F.col("kind") == "File", F.sha2("file_path", 256)))))
    return kept


def _forgotten(g: Graph) -> Graph:
    kept = _kept(g)
    maintenance.forget(kept, _files(g, A), passes=(maintenance.Pass(resolve.resolve_bare_calls),))
    return kept.read()


_GONE = f"G AS MATERIALIZED (SELECT qualified_name FROM N WHERE file_path = '{A}')"
_bare = lambda end: f"CASE WHEN {end} IN (SELECT qualified_name FROM G) AND {end} LIKE '%::%' THEN regexp_extract({end}, '[^.:]*$') ELSE {end} END"
add("forget", lambda g: _forgotten(g).nodes.select("qualified_name"), f"SELECT qualified_name FROM N WHERE file_path <> '{A}'")
add("forget_edges", lambda g: _forgotten(g).edges.select("kind", "source_qualified", "target_qualified", "line"), f"SELECT kind, {_bare('source_qualified')} AS source_qualified, {_bare('target_qualified')} AS target_qualified, line FROM E WHERE file_path <> '{A}'", _GONE)
add("forget_communities", lambda g: _forgotten(g).communities, f"SELECT * FROM C WHERE qualified_name NOT IN (SELECT qualified_name FROM G)", _GONE)


def _new_version(files: DataFrame) -> Graph:
    """What a parser finds in the new version of a file: itself and one function."""
    row = lambda kind, name, qn: (F.lit(kind).alias("kind"), name.alias("name"), qn.alias("qualified_name"), "file_path", F.lit(1).alias("line_start"), F.lit(9).alias("line_end"), F.lit("python").alias("language"), F.lit(None).cast("string").alias("parent_name"), F.lit(False).alias("is_test"), F.lit("{}").alias("extra"), F.lit(1).alias("seq"))
    nodes = files.select(*row("File", F.col("file_path"), F.col("file_path"))).union(files.select(*row("Function", F.lit("fresh"), F.concat("file_path", F.lit("::fresh")))))
    edges = files.select(F.lit("CONTAINS").alias("kind"), F.col("file_path").alias("source_qualified"), F.concat("file_path", F.lit("::fresh")).alias("target_qualified"), "file_path", F.lit(1).alias("line"), F.lit(1.0).alias("confidence"), F.lit(1).alias("seq"))
    return Graph(nodes, edges)


def _updated(g: Graph) -> Graph:
    """The stored graph after a listing without one region's files, with one file changed and some that have no file node yet."""
    kept = _kept(g)
    listing = g.nodes.select("file_path").distinct().filter("file_path NOT LIKE '/geo/asia/%'")
    now = listing.withColumn("content", F.when(F.col("file_path") == A, "second version").otherwise(F.col("file_path")))
    maintenance.incremental_update(kept, now, _new_version, passes=())
    return kept.read()


_NOW = f"CUR AS MATERIALIZED (SELECT DISTINCT file_path FROM N WHERE file_path NOT LIKE '/geo/asia/%'), RE AS MATERIALIZED (SELECT file_path FROM CUR WHERE file_path = '{A}' OR file_path NOT IN (SELECT file_path FROM N WHERE kind = 'File')), LOST AS MATERIALIZED (SELECT qualified_name FROM N WHERE file_path LIKE '/geo/asia/%')"
add("incremental_update", lambda g: _updated(g).nodes.select("qualified_name", "file_hash"), """SELECT qualified_name, CASE WHEN kind = 'File' THEN sha256(file_path) END AS file_hash FROM N WHERE file_path IN (SELECT file_path FROM CUR) AND file_path NOT IN (SELECT file_path FROM RE)
  UNION ALL SELECT file_path, sha256(CASE WHEN file_path = '""" + A + """' THEN 'second version' ELSE file_path END) FROM RE UNION ALL SELECT concat(file_path, '::fresh'), NULL FROM RE""", _NOW)
add("incremental_edges", lambda g: _updated(g).edges.select("kind", "source_qualified", "target_qualified", "file_path"), """SELECT kind, source_qualified, target_qualified, file_path FROM E WHERE file_path NOT IN (SELECT file_path FROM RE) AND file_path NOT LIKE '/geo/asia/%' AND source_qualified NOT IN (SELECT qualified_name FROM LOST) AND target_qualified NOT IN (SELECT qualified_name FROM LOST)
  UNION ALL SELECT 'CONTAINS', file_path, concat(file_path, '::fresh'), file_path FROM RE""", _NOW)


def _watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions after a stream of file events: the last event of a path counts, a purchase deletes it."""
    kept = store.GraphStore(spark, f"{shared_dir(spark)}/lattica/store-{uuid.uuid4().hex}", 8)
    path = f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a pattern may name a file as well as a folder
    changes = events.select(F.concat(F.lit("/u/"), F.col("user_id").cast("string"), F.lit(".py")).alias("file_path"), (F.col("event_type") == "purchase").alias("deleted"), F.col("event_type").alias("content"), F.col("event_id").alias("seq"))
    one = lambda files: (lambda g: g.with_(nodes=g.nodes.join(files.select("file_path", "content"), "file_path").withColumn("name", F.when(F.col("kind") == "Function", F.col("content")).otherwise(F.col("name"))).drop("content")))(_new_version(files))
    q = watch.watch(changes, kept, one, f"{shared_dir(spark)}/lattica/watch-{uuid.uuid4().hex}", None, passes=())
    q.awaitTermination()
    return kept.read().nodes.filter("kind = 'Function'").select("file_path", "name")


add_plain("watch_updates", _watched, "SELECT concat('/u/', user_id, '.py') AS file_path, t AS name FROM (SELECT user_id, arg_max(event_type, event_id) AS t FROM events GROUP BY 1) x WHERE t <> 'purchase'")
add("replace_batch", lambda g: store.replace_files(g, _files(g, A, B), g.nodes.limit(0).withColumn("seq", F.lit(1)), g.edges.limit(0).withColumn("seq", F.lit(1))).nodes.select("qualified_name"), f"SELECT qualified_name FROM N WHERE file_path NOT IN ('{A}', '{B}')")
add("reconcile_stale", lambda g: ranking.stale(g.nodes.select("file_path").distinct(), g.nodes.filter("language = 'python'").select("file_path").distinct(), "file_path"), "SELECT DISTINCT file_path FROM N WHERE file_path NOT IN (SELECT file_path FROM N WHERE language = 'python')")
add("change_detect", lambda g: store.change_detect(g.with_(nodes=g.nodes.withColumn("file_hash", F.sha2("file_path", 256))), g.nodes.filter("kind = 'File'").select("file_path", F.when(F.col("language") == "java", F.lit("new")).otherwise(F.col("file_path")).cast("binary").alias("content"))), "SELECT file_path, 'changed' AS change FROM N WHERE kind = 'File' AND language = 'java'")
def _letters(g: Graph) -> DataFrame:
    """Vectors of nodes by how often each letter stands in their name: any provider's would do."""
    low = F.lower("name")
    return g.nodes.filter("kind = 'Class'").select("qualified_name", F.array(*((F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in _ABC)).alias("embedding"))


_ABC = "abcdefghijklmnopqrstuvwxyz"
_letter_vector = lambda w: [float(w.count(c)) for c in _ABC]
add("semantic_search", lambda g: search.hybrid_search(g, "region", _letters(g), _letter_vector("region"), limit=5).select("qualified_name", F.round("score", 9).alias("score")))
add("kind_boost", lambda g: g.nodes.select("qualified_name", search.kind_boost("supply_token_1").alias("boost")), "SELECT qualified_name, CASE WHEN kind = 'Function' THEN 1.5e0 ELSE 1e0 END * CASE WHEN contains(lower(qualified_name), 'supply_token_1') THEN 2e0 ELSE 1e0 END AS boost FROM N")
add("embed_nodes", lambda g: search.stale_vectors(search.node_text(g), search.node_text(g).filter("length(text) % 2 = 0").select("qualified_name", F.sha2("text", 256).alias("text_hash"), F.lit("p").alias("provider")), "p").select("qualified_name"))
add("export_json", lambda g: store.json_lines(Graph(g.nodes.select("qualified_name", "kind", "is_test"), g.edges.select("kind", "source_qualified", "target_qualified", "line"))),
    """SELECT concat('{"type":"node","qualified_name":"', qualified_name, '","kind":"', kind, '","is_test":', is_test, '}') AS value FROM N UNION ALL SELECT concat('{"type":"edge","kind":"', kind, '","source_qualified":"', source_qualified, '","target_qualified":"', target_qualified, '","line":', line, '}') FROM E""")


def _tasks(g: Graph) -> DataFrame:
    """From each method its class's base (two edges away), and another region's base, which is farther."""
    own = g.nodes.filter("kind = 'Function' AND language = 'java'").select(F.col("qualified_name").alias("task"), F.element_at(F.split("file_path", "/"), 3).alias("region"))
    bases = g.nodes.filter("kind = 'Class' AND name LIKE 'Region%'").select(F.col("qualified_name").alias("expected"), F.element_at(F.split("file_path", "/"), 3).alias("of"))
    last = bases.agg(F.max("of").alias("last"))
    return own.join(bases, F.col("region") == F.col("of")).select("task", F.col("task").alias("start"), "expected").union(own.join(bases.join(last, F.col("of") == F.col("last")), F.col("region") != F.col("of")).select("task", "task", "expected"))


_TASKS = f"""B AS MATERIALIZED (SELECT qualified_name AS expected, split_part(file_path, '/', 3) AS region FROM N WHERE kind = 'Class' AND name LIKE 'Region%'),
  TK AS MATERIALIZED (SELECT N.qualified_name AS task, expected FROM N JOIN B ON B.region = split_part(file_path, '/', 3) OR B.region = (SELECT max(region) FROM B) WHERE N.kind = 'Function' AND language = 'java'),
  ST AS MATERIALIZED (SELECT source_qualified s, target_qualified t FROM E UNION SELECT target_qualified, source_qualified FROM E),
  H1 AS MATERIALIZED (SELECT DISTINCT task, t AS node FROM (SELECT DISTINCT task FROM TK) x JOIN ST ON s = task), H2 AS MATERIALIZED (SELECT DISTINCT task, t AS node FROM H1 JOIN ST ON s = node WHERE t IN (SELECT expected FROM B)),
  R AS MATERIALIZED (SELECT task, node, min(hop) AS hop FROM (SELECT task, node, 1 AS hop FROM H1 UNION ALL SELECT task, node, 2 FROM H2) y GROUP BY 1, 2)"""
add("multi_hop", lambda g: impact.multi_hop(g, _tasks(g)), "SELECT TK.task, expected, hop FROM TK LEFT JOIN R ON R.task = TK.task AND node = expected", _TASKS)
add("multi_hop_recall", lambda g: impact.multi_hop_recall(g, _tasks(g)), "SELECT count(DISTINCT TK.task) AS tasks, count(*) AS expected, count(hop) AS reached, count(hop) / count(*) AS recall FROM TK LEFT JOIN R ON R.task = TK.task AND node = expected", _TASKS)
#: Questions that find nodes by name, and one that finds none.
_QUESTIONS = ("supply token", "part_1", "nation1", "region", "no such thing")


def _question_hits(g: Graph, limit: int) -> DataFrame:
    """(question, qualified_name, rank from 1) of a keyword search for each question."""
    found = [ranking.ranked(search.keyword_search(g, q, limit), [F.desc("score"), "qualified_name"], "qualified_name").select(F.lit(q).alias("question"), F.col("item").alias("qualified_name"), (F.col("rank") + 1).alias("rank")) for q in _QUESTIONS]
    return functools.reduce(DataFrame.union, found)


def _question_list(g: Graph) -> DataFrame:
    return g.nodes.sparkSession.createDataFrame([(q,) for q in _QUESTIONS], "question string")


def _hits_sql(limit: int) -> str:
    score = lambda q: f"CASE WHEN lower(name) = '{q}' THEN 3 WHEN starts_with(lower(name), '{q}') THEN 2 ELSE 1 END"
    holds = lambda q: " AND ".join(f"(name ILIKE '%{w}%' OR qualified_name ILIKE '%{w}%')" for w in q.split())
    return "QH AS MATERIALIZED (SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{q}' AS question, qualified_name, row_number() OVER (ORDER BY {score(q)} DESC, qualified_name) AS rank FROM N WHERE {holds(q)}" for q in _QUESTIONS) + f") x WHERE rank <= {limit})"


_quarter = lambda text: f"greatest(1, length({text}) // 4)"
add_sf("token_reduction", lambda g, s, d: savings.token_reduction(g, _question_list(g), _question_hits(g, 5), _table(s, d, "documents")).withColumn("average_ratio", F.round("average_ratio", 9)),
    """SELECT question, naive AS naive_tokens, cast(t AS bigint) AS graph_tokens, ratio AS reduction_ratio, round(avg(ratio) OVER (), 9) AS average_ratio FROM (SELECT question, naive, t, CASE WHEN t > 0 THEN naive / t ELSE 0e0 END AS ratio FROM QC CROSS JOIN NAIVE) x""",
    _hits_sql(5) + f""", QL AS (SELECT * FROM (VALUES {", ".join(f"('{q}')" for q in _QUESTIONS)}) v(question)),
  NAIVE AS MATERIALIZED (SELECT cast(sum({_quarter('text')}) AS bigint) AS naive FROM documents WHERE text IS NOT NULL),
  QE AS MATERIALIZED (SELECT source_qualified AS q, sum({_quarter("to_json({'kind': kind, 'source_qualified': source_qualified, 'target_qualified': target_qualified, 'file_path': file_path, 'line': line})")}) AS more FROM (SELECT *, row_number() OVER (PARTITION BY source_qualified ORDER BY line, kind, target_qualified, file_path) AS r FROM E WHERE source_qualified IN (SELECT qualified_name FROM QH)) e WHERE r <= 5 GROUP BY 1),
  QC AS MATERIALIZED (SELECT QL.question, coalesce(sum({_quarter("to_json({'kind': N.kind, 'name': N.name, 'qualified_name': N.qualified_name, 'file_path': N.file_path})")} + coalesce(more, 0)) FILTER (N.kind IS NOT NULL), 0) AS t FROM QL LEFT JOIN QH ON QH.question = QL.question LEFT JOIN N ON N.qualified_name = QH.qualified_name LEFT JOIN QE ON q = QH.qualified_name GROUP BY 1)""")
add("flow_completeness", lambda g: flows.entry_points(g).agg(F.avg(F.col("qualified_name").contains("part_").cast("double")).alias("found")), "SELECT avg(CASE WHEN qualified_name LIKE '%part\\_%' ESCAPE '\\' THEN 1e0 ELSE 0e0 END) AS found FROM ep", _ENTRY)
#: What each question should find: a part of a qualified name.
_WANTED = (("supply token", "Nation1.supply"), ("part_1", "part_10"), ("nation1", "Nation1"), ("region", "Region2"), ("no such thing", "part_1"))
add("search_quality", lambda g: search.search_quality(_question_hits(g, 20).withColumnRenamed("question", "query"), g.nodes.sparkSession.createDataFrame(_WANTED, "query string, name string")),
    "SELECT w.q AS query, coalesce(1e0 / min(rank), 0e0) AS reciprocal FROM QW w LEFT JOIN QH ON question = w.q AND contains(lower(qualified_name), lower(w.name)) GROUP BY 1",
    _hits_sql(20) + f", QW AS (SELECT * FROM (VALUES {', '.join(f'({q!r}, {n!r})' for q, n in _WANTED)}) v(q, name))")
add("builtin_call_filter", lambda g: g.edges.filter((F.col("kind") == "CALLS") & ~F.col("target_qualified").isin("print", "len", "ext_1")).select("target_qualified"), "SELECT target_qualified FROM E WHERE kind = 'CALLS' AND target_qualified NOT IN ('print', 'len', 'ext_1')")

# -- readers and logs ------------------------------------------------------------------------------


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part").select("p_partkey", "p_size")
    text = F.concat(F.lit("--- a/x\n+++ b/part_"), "p_partkey", F.lit(".py\n@@ -1,2 +"), "p_size", F.lit(",4 @@\n+a\n@@ -9 +"), F.col("p_size") + 100, F.lit(" @@\n+b\n"))
    return p.select(F.col("p_partkey").alias("diff_id"), text.alias("text"))


add_plain("parse_unified_diff", lambda s, d: ranges.parse_unified_diff(_diffs(s, d)), "SELECT p_partkey AS diff_id, concat('part_', p_partkey, '.py') AS file_path, p_size AS start, p_size + 3 AS \"end\" FROM part UNION ALL SELECT p_partkey, concat('part_', p_partkey, '.py'), p_size + 100, p_size + 100 FROM part")
add_plain("parse_numstat", lambda s, d: ranges.parse_numstat(_table(s, d, "orders").select(F.concat(F.lit("1\t2\t/f"), F.col("o_custkey") % 50, F.lit(".py\x00-\t-\t/g.bin\x00")).alias("text"))), "SELECT concat('/f', o_custkey % 50, '.py') AS file_path, count(*) AS commits FROM orders GROUP BY 1 UNION ALL SELECT '/g.bin', count(*) FROM orders")
add_plain("bench_aggregate", lambda s, d: aggregates.bench_aggregate(_table(s, d, "orders").select(F.col("o_orderpriority").alias("mode"), F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "error").otherwise("skipped").alias("status"), F.col("o_custkey").cast("double").alias("value"))).withColumn("mean", F.round("mean", 6)),
          "SELECT o_orderpriority AS mode, count(*) FILTER (o_orderstatus = 'F') AS ok, count(*) FILTER (o_orderstatus = 'O') AS errors, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS skipped, round(avg(o_custkey) FILTER (o_orderstatus = 'F'), 6) AS mean FROM orders GROUP BY 1")
#: Documents as the texts of source files; the two digits of a brand's file come from the key.
_FILE_OF = "concat('/src/brand', cast(doc_id % 5 + 1 as string), cast(cast(floor(doc_id / 5) as bigint) % 5 + 1 as string), '.py')"
_MEASURE = """CHG AS (SELECT '{A}' AS p UNION SELECT '{B}'), FT AS MATERIALIZED (SELECT {file} AS p, cast(ceil(length(text) / 4.0) AS bigint) AS t FROM documents),
  IMP AS MATERIALIZED ({impact}), NEAR AS MATERIALIZED (SELECT DISTINCT file_path AS p FROM IMP WHERE file_path NOT IN (SELECT p FROM CHG)),
  K AS MATERIALIZED (SELECT list(name ORDER BY score DESC, qualified_name) AS names FROM (SELECT IMP.*, N.name FROM IMP JOIN N USING (qualified_name) ORDER BY score DESC, qualified_name LIMIT 5) x),
  M AS MATERIALIZED (SELECT (SELECT count(*) FROM CHG) AS changed_files, (SELECT count(*) FROM N WHERE file_path IN (SELECT p FROM CHG)) AS changed_nodes, (SELECT count(*) FROM IMP) AS impacted_nodes, (SELECT count(*) FROM NEAR) AS impacted_files,
    (SELECT greatest(0, coalesce(max(total_impacted), 0) - count(*)) FROM IMP) AS nodes_omitted, (SELECT coalesce(names, []) FROM K) AS names,
    cast((SELECT coalesce(sum(t), 0) FROM FT WHERE p IN (SELECT p FROM CHG)) AS bigint) AS changed_tokens, cast((SELECT coalesce(sum(t), 0) FROM FT WHERE p IN (SELECT p FROM NEAR)) AS bigint) AS impacted_tokens),
  G AS MATERIALIZED (SELECT *, changed_tokens + impacted_tokens AS baseline_tokens, cast(ceil(length(to_json({{'changed_files': changed_files, 'changed_nodes': changed_nodes, 'impacted_nodes': impacted_nodes, 'impacted_files': impacted_files, 'risk': CASE WHEN impacted_nodes > 20 THEN 'high' WHEN impacted_nodes > 5 THEN 'medium' ELSE 'low' END, 'key_entities': names, 'nodes_omitted': nodes_omitted}})) / 4.0) AS bigint) AS graph_tokens FROM M),
  W AS MATERIALIZED (SELECT *, changed_tokens + graph_tokens AS returned_tokens, changed_nodes * 400 + impacted_nodes * 1000 AS search_trace_tokens, changed_nodes * 100 AS analysis_tokens, impacted_files * 800 AS precision_tokens FROM G),
  V AS MATERIALIZED (SELECT *, search_trace_tokens + analysis_tokens + precision_tokens + baseline_tokens AS total_counterfactual, greatest(0, baseline_tokens - returned_tokens) AS saved_tokens FROM W)"""
_percent = lambda part, whole: f"CASE WHEN {whole} > 0 THEN cast(floor({part} * 100e0 / {whole} + 0.5e0) AS bigint) ELSE 0 END"
_imp_body, _imp_with = _impact_sql(2, f"SELECT qualified_name AS q, 1e0 AS score FROM N WHERE file_path IN ('{A}', '{B}')")
add_sf("measure_savings", lambda g, s, d: savings.measure_savings(g, _files(g, A, B), _table(s, d, "documents").select(F.expr(_FILE_OF).alias("file_path"), "text")),
    f"""SELECT changed_files, impacted_files, changed_nodes, impacted_nodes, nodes_omitted, changed_tokens, impacted_tokens, baseline_tokens, graph_tokens, returned_tokens, saved_tokens, {_percent('saved_tokens', 'baseline_tokens')} AS saved_percent, search_trace_tokens, analysis_tokens, precision_tokens, total_counterfactual,
    greatest(0, total_counterfactual - returned_tokens) AS counterfactual_saved, {_percent('greatest(0, total_counterfactual - returned_tokens)', 'total_counterfactual')} AS counterfactual_saved_percent FROM V""",
    _imp_with + ", " + _MEASURE.format(A=A, B=B, file=_FILE_OF, impact=_imp_body))
add_plain("docs_section", lambda s, d: files.docs_section(_table(s, d, "benchmark").select(F.concat(F.lit('<section name="usage">'), "text", F.lit("</section>")).alias("text")), "usage"), "SELECT text AS section FROM benchmark")
add_plain("query_identifiers", lambda s, d: _table(s, d, "part").select("p_partkey", F.array_join(search.identifiers(F.concat(F.lit("call get_users of Context.Next for Part"), "p_partkey", F.lit("Item "), "p_name")), ",").alias("found")), "SELECT p_partkey, concat('context.next,get_users,part', p_partkey, 'item') AS found FROM part")


# -- sites: references by part that resolvers rewrite, with ambiguous ones and ones out of reach ------
_K = "cast(p_partkey as string)"
_DIR = "concat('/infra/d', cast(p_partkey % 40 as string))"
_HNAME = f"CASE WHEN p_partkey % 5 = 0 THEN concat('aws.s', cast(p_partkey % 3 as string)) ELSE concat('aws.r', {_K}) END"
_MOD = "cast(p_partkey % 30 as string)"
_SYM = "concat('a', cast(p_partkey % 9 as string), '::f', cast(p_partkey as string))"
_node = lambda name, qn, path, language="'x'", parent="cast(null as string)", where="true": f"SELECT 'Function' AS kind, {name} AS name, {qn} AS qualified_name, {path} AS file_path, {language} AS language, {parent} AS parent_name, false AS is_test, '{{{{}}}}' AS extra FROM {{part}} WHERE {where}"
_edge = lambda kind, source, target, path, extra="'{{}}'": f"SELECT '{kind}' AS kind, {source} AS source_qualified, {target} AS target_qualified, {path} AS file_path, cast(p_partkey as int) AS line, {extra} AS extra FROM {{part}}"
SITE_NODES = " UNION ALL ".join([
    _node(_HNAME, f"concat({_DIR}, '/main.tf::h', {_K})", f"concat({_DIR}, '/main.tf')"),
    _node(f"concat('g', {_K})", f"concat('/r/Mod', {_MOD}, '.res::g', {_K})", f"concat('/r/Mod', {_MOD}, '.res')"),
    _node(f"concat('g', {_K})", f"concat('/r/Mod', {_MOD}, '.resi::g', {_K})", f"concat('/r/Mod', {_MOD}, '.resi')", where="p_partkey % 4 = 0"),
    _node(f"concat('f', {_K})", f"concat('/c/x.cpp::', {_SYM})", "'/c/x.cpp'", "'cpp'"),
    _node(f"concat('f', {_K})", f"concat('/c/y.cpp::', {_SYM})", "'/c/y.cpp'", "'cpp'", where="p_partkey % 5 = 0"),
    _node(f"concat('go', {_K})", f"concat('/s/I', {_K}, '.java::Impl', {_K}, '.go', {_K})", f"concat('/s/I', {_K}, '.java')", "'java'", f"concat('Impl', {_K})"),
    _node(f"concat('fn', {_K})", f"concat('/m/mod', cast((p_partkey + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END) % 20 as string), '.py::fn', {_K})", "concat('/m/mod', cast((p_partkey + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END) % 20 as string), '.py')", "'python'"),
    _node(f"concat('fn', {_K})", f"concat('/t/test_', {_K}, '.py::fn', {_K})", f"concat('/t/test_', {_K}, '.py')", "'python'", where="p_partkey % 10 = 1"),
])
_inject = lambda kind: [
    _edge(kind, f"concat('/s/C', {_K}, '.java::Ctl', {_K})", f"concat('Port', {_K})", f"concat('/s/C', {_K}, '.java')", "'{{\"field_name\": \"p\"}}'"),
    _edge("IMPLEMENTS", f"concat('/s/I', {_K}, '.java::Impl', {_K})", f"concat('Port', {_K})", f"concat('/s/I', {_K}, '.java')"),
    _edge("IMPLEMENTS", f"concat('/s/I', {_K}, '.java::Alt', {_K})", f"concat('Port', {_K})", f"concat('/s/I', {_K}, '.java')") + " WHERE p_partkey % 4 = 0",
    _edge("CALLS", f"concat('/s/C', {_K}, '.java::Ctl', {_K}, '.run')", f"concat('go', {_K})", f"concat('/s/C', {_K}, '.java')", "'{{\"receiver\": \"p\"}}'"),
]
SITE_EDGES = {
    "resolve_hcl": [_edge("REFERENCES", f"concat('/infra/v', {_K})", _HNAME, "concat('/infra/d', cast((p_partkey + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END) % 40 as string), '/vars.tf')")],
    "resolve_rescript": [_edge("CALLS", f"concat('/r/u', {_K})", f"concat(CASE WHEN p_partkey % 6 = 0 THEN 'Nope' ELSE concat('Mod', {_MOD}) END, '.g', {_K})", "'/r/Use.res'")],
    "resolve_rescript_peel": [_edge("CALLS", f"concat('/r/u', {_K})", f"concat('Mod', {_MOD}, '.g', {_K}, '.resp.code')", "'/r/Use.res'")],
    "resolve_rescript_opens": [
        _edge("CALLS", f"concat('/r/o', {_K})", f"concat('g', {_K})", f"concat('/r/Open', {_K}, '.res')"),
        _edge("IMPORTS_FROM", f"concat('/r/Open', {_K}, '.res')", "concat('Mod', cast((p_partkey + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END) % 30 as string), '.Sub')", f"concat('/r/Open', {_K}, '.res')", "CASE WHEN p_partkey % 5 = 0 THEN '{{}}' ELSE '{{\"rescript_import_kind\": \"open\"}}' END"),
    ],
    "resolve_hcl_modules": [
        _edge("IMPORTS_FROM", f"concat('/infra/live/x', {_K}, '/main.tf::m')", "CASE WHEN p_partkey % 7 = 0 THEN './none' WHEN p_partkey % 2 = 0 THEN concat('../.././d', cast(p_partkey % 40 as string), '/main.tf') ELSE concat('../../d', cast(p_partkey % 40 as string), '/') END", f"concat('/infra/live/x', {_K}, '/main.tf')"),
        _edge("REFERENCES", f"concat('/infra/v', {_K})", f"concat('/infra/d', cast(p_partkey % 40 as string), '/vars.tf::', {_HNAME})", "concat('/infra/d', cast(p_partkey % 40 as string), '/vars.tf')"),
    ],
    "resolve_cpp_scope": [_edge("CALLS", f"concat('/c/u', {_K})", f"concat('f', {_K})", "'/c/u.cpp'", "concat('{{\"receiver_scope\": \"', CASE WHEN p_partkey % 7 = 0 THEN 'zz' ELSE concat('a', cast(p_partkey % 9 as string)) END, '::inner\"}}')")],
    "resolve_cpp_tests": [
        _edge("CALLS", f"concat('/c/u', {_K})", f"concat('f', {_K})", "'/c/u.cpp'", "concat('{{\"receiver_scope\": \"', CASE WHEN p_partkey % 7 = 0 THEN 'zz' ELSE concat('a', cast(p_partkey % 9 as string)) END, '::inner\"}}')"),
        _edge("TESTED_BY", f"concat('f', {_K})", f"concat('/c/u', {_K})", "CASE WHEN p_partkey % 11 = 0 THEN '/c/other.cpp' ELSE '/c/u.cpp' END"),
    ],
    "resolve_spring_di": _inject("INJECTS"),
    "resolve_temporal": _inject("TEMPORAL_STUB"),
    "resolve_bare_tests": [
        _edge("TESTED_BY", f"concat('fn', {_K})", f"concat('/t/test_', {_K}, '.py::test_', {_K})", f"concat('/t/test_', {_K}, '.py')"),
        _edge("IMPORTS_FROM", f"concat('/t/test_', {_K}, '.py')", "concat('/m/mod', cast(p_partkey % 20 as string), '.py')", f"concat('/t/test_', {_K}, '.py')"),
    ],
}


def add_site(name: str, run, sql: str) -> None:
    """Register a resolver on the sites; ``sql`` sees RN and RE, their nodes and the edges of this resolver."""
    edges = " UNION ALL ".join(SITE_EDGES[name])

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        part = _table(spark, sf_dir, "part")
        return run(Graph(spark.sql(SITE_NODES, part=part), spark.sql(edges, part=part)))

    QUERIES[name] = query
    ORACLES[name] = f"WITH RN AS ({_flat(SITE_NODES.format(part='part'))}), RE AS ({_flat(edges.format(part='part'))}) {_flat(sql)}"


_sole = lambda cond: f"(SELECT CASE WHEN count(DISTINCT qualified_name) = 1 THEN max(qualified_name) END FROM RN WHERE {cond})"
_WHERE = "regexp_extract({}.file_path, '^(.*)/[^/]*$', 1)"
add_site("resolve_hcl", lambda g: resolve.resolve_hcl(g).select("source_qualified", "target_qualified"), f"SELECT source_qualified, coalesce(q, t) AS target_qualified FROM (SELECT source_qualified, target_qualified AS t, {_sole('RN.name = RE.target_qualified AND ' + _WHERE.format('RN') + ' = ' + _WHERE.format('RE'))} AS q FROM RE) x")
add_site("resolve_rescript", lambda g: resolve.resolve_rescript(g).select("source_qualified", "target_qualified"), "SELECT source_qualified, CASE WHEN starts_with(target_qualified, 'Mod') THEN concat('/r/', split_part(target_qualified, '.', 1), '.res::', split_part(target_qualified, '.', 2)) ELSE target_qualified END AS target_qualified FROM RE")
add_site("resolve_cpp_scope", lambda g: resolve.resolve_cpp_scope(g).select("source_qualified", "target_qualified", "resolution"), """SELECT source_qualified, CASE WHEN n = 1 THEN q ELSE t END AS target_qualified, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' END AS resolution FROM (SELECT source_qualified, target_qualified AS t, (SELECT count(*) FROM RN WHERE ends_with(qualified_name, concat('.cpp::', s, '::', target_qualified))) AS n, (SELECT max(qualified_name) FROM RN WHERE ends_with(qualified_name, concat('.cpp::', s, '::', target_qualified))) AS q FROM (SELECT *, regexp_extract(extra, '"([^":]*)::inner"', 1) AS s FROM RE) e) x""")
for _name, _mark in (("resolve_spring_di", "spring_resolved"), ("resolve_temporal", "temporal_resolved")):
    add_site(_name, lambda g, f=getattr(resolve, _name), m=_mark: f(g).filter("kind = 'CALLS'").select("source_qualified", "target_qualified", m),
             f"SELECT source_qualified, CASE WHEN line % 4 = 0 THEN target_qualified ELSE concat('/s/I', line, '.java::Impl', line, '.go', line) END AS target_qualified, line % 4 <> 0 AS {_mark} FROM RE WHERE kind = 'CALLS'")
add_site("resolve_bare_tests", lambda g: resolve.resolve_bare_tests(g).filter("kind = 'TESTED_BY'").select("source_qualified", "target_qualified", "resolution", F.coalesce(F.size("candidates"), F.lit(0)).alias("listed")),
         """SELECT CASE WHEN n = 1 THEN q ELSE s END AS source_qualified, target_qualified, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS resolution, cast(CASE WHEN n > 1 THEN n ELSE 0 END AS int) AS listed FROM (SELECT e.source_qualified AS s, e.target_qualified, count(DISTINCT RN.qualified_name) AS n, max(RN.qualified_name) AS q FROM (SELECT * FROM RE WHERE kind = 'TESTED_BY') e LEFT JOIN (SELECT file_path, target_qualified AS other FROM RE WHERE kind = 'IMPORTS_FROM' UNION SELECT file_path, file_path FROM RE) i ON i.file_path = e.file_path LEFT JOIN RN ON RN.name = e.source_qualified AND RN.file_path = i.other GROUP BY 1, 2) x""")  # fmt: skip


add_site("resolve_rescript_peel", lambda g: resolve.resolve_rescript(g).select("source_qualified", "target_qualified"), "SELECT source_qualified, concat('/r/Mod', line % 30, '.res::g', line) AS target_qualified FROM RE")
add_site("resolve_rescript_opens", lambda g: resolve.resolve_rescript(g).select("kind", "source_qualified", "target_qualified"), "SELECT kind, source_qualified, CASE WHEN kind = 'IMPORTS_FROM' THEN concat('/r/', split_part(target_qualified, '.', 1), '.res') WHEN line % 3 = 0 OR line % 5 = 0 THEN target_qualified ELSE concat('/r/Mod', line % 30, '.res::g', line) END AS target_qualified FROM RE")
add_site("resolve_hcl_modules", lambda g: resolve.resolve_hcl(g).select("kind", "source_qualified", "target_qualified"), """SELECT kind, source_qualified, CASE WHEN kind = 'IMPORTS_FROM' AND line % 7 > 0 THEN concat('/infra/d', line % 40, '/main.tf') WHEN kind = 'REFERENCES' AND n = 1 THEN q ELSE target_qualified END AS target_qualified
  FROM (SELECT RE.*, (SELECT count(*) FROM RN WHERE name = split_part(target_qualified, '::', 2) AND RN.file_path = concat('/infra/d', line % 40, '/main.tf')) AS n, (SELECT max(qualified_name) FROM RN WHERE name = split_part(target_qualified, '::', 2) AND RN.file_path = concat('/infra/d', line % 40, '/main.tf')) AS q FROM RE) x""")


_FOUND = "line % 7 > 0 AND line % 5 > 0"
add_site("resolve_cpp_tests", lambda g: resolve.resolve_cpp_scope(g).select("kind", "source_qualified", "target_qualified"), f"SELECT kind, CASE WHEN kind = 'TESTED_BY' AND {_FOUND} AND line % 11 > 0 THEN concat('/c/x.cpp::a', line % 9, '::f', line) ELSE source_qualified END AS source_qualified, CASE WHEN kind = 'CALLS' AND {_FOUND} THEN concat('/c/x.cpp::a', line % 9, '::f', line) ELSE target_qualified END AS target_qualified FROM RE")


def _snapshot(g: Graph) -> Graph:
    """The graph as a store gives it back that has just been given it."""
    kept = store.GraphStore(g.nodes.sparkSession, f"{shared_dir(g.nodes.sparkSession)}/lattica/store-{uuid.uuid4().hex}")
    return kept.read(kept.write(g))


add("read_snapshot", lambda g: _snapshot(g).nodes.select("qualified_name", "kind", "file_path"), "SELECT qualified_name, kind, file_path FROM N")
add("save_snapshot", lambda g: _snapshot(g).edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "SELECT kind, count(*) AS n FROM E GROUP BY 1")

# -- versions, the registry and the savings log ----------------------------------------------------
_DIFF = "concat('M', chr(0), '/src/', o_custkey % 50, '.py', chr(0), 'R087', chr(0), '/old/', o_orderkey, '.py', chr(0), '/new/', o_orderkey, '.py', chr(0), 'D', chr(0), '/src/', o_custkey % 50, '.py', chr(0))"
add_plain("git_diff_files", lambda s, d: history.parse_name_status(_table(s, d, "orders").select("o_orderkey", F.expr(_DIFF).alias("raw")), "raw"),
    "SELECT o_orderkey, 0 AS position, concat('/src/', o_custkey % 50, '.py') AS file_path FROM orders UNION ALL SELECT o_orderkey, 1, concat('/old/', o_orderkey, '.py') FROM orders UNION ALL SELECT o_orderkey, 2, concat('/new/', o_orderkey, '.py') FROM orders")
_BUILT, _HEAD, _BASE = "concat('c', o_custkey % 4)", "concat('c', o_orderkey % 4)", "CASE WHEN o_orderkey % 5 > 0 THEN concat('c', o_custkey % 3) END"


def _freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").withColumn("repo", F.col("o_orderkey"))
    day = F.when(F.col("o_orderkey") % 11 == 0, "none").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    put = F.map_from_arrays(F.array(F.lit("last_updated"), F.lit("git_head_sha"), F.lit("git_branch")), F.array(day, F.expr(f"CASE WHEN o_orderkey % 7 > 0 THEN {_BUILT} END"), F.lit("main")))
    heads = o.select("repo", F.expr(_HEAD).alias("head_sha"), F.expr(_BASE).alias("merge_base"), F.lit("1997-01-01").cast("timestamp").alias("now"))
    return history.freshness(o.select("repo", F.explode(put).alias("key", "value")), heads).drop("built_on_branch")


add_plain("freshness", _freshness, f"""SELECT repo, updated_at, CASE WHEN updated_at <> 'none' THEN greatest(0, 86400 * date_diff('day', try_cast(updated_at AS date), DATE '1997-01-01')) END AS age_seconds, built_at_sha, head_sha,
  CASE WHEN built_at_sha IS NULL THEN NULL WHEN built_at_sha = head_sha THEN 'same' WHEN merge_base IS NULL THEN 'unknown' WHEN merge_base = built_at_sha THEN 'ancestor' WHEN merge_base = head_sha THEN 'descendant' ELSE 'diverged' END AS build_relation
  FROM (SELECT o_orderkey AS repo, CASE WHEN o_orderkey % 11 = 0 THEN 'none' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS updated_at, CASE WHEN o_orderkey % 7 > 0 THEN {_BUILT} END AS built_at_sha, {_HEAD} AS head_sha, {_BASE} AS merge_base FROM orders) o""")
_KNOWN = "SELECT cast(r_regionkey AS bigint) AS seq, concat('/r/', r_regionkey) AS path, lower(r_name) AS alias, cast(null AS varchar(9)) AS data_dir FROM {region}"
_ENTRIES = "SELECT cast(100 + s_suppkey AS bigint) AS seq, concat('/r/', s_suppkey % 50) AS path, CASE WHEN s_suppkey % 3 > 0 THEN concat('s', s_suppkey) ELSE '' END AS alias, CASE WHEN s_suppkey % 7 = 0 THEN concat('/d/', s_suppkey) END AS data_dir FROM {supplier}"


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, entries = spark.sql(_KNOWN, region=_table(spark, sf_dir, "region")), spark.sql(_ENTRIES, supplier=_table(spark, sf_dir, "supplier"))
    return history.unregister(history.unregister(history.register(known, entries), "/r/7"), "africa")


add_plain("registry", _registry, f"""SELECT * FROM (SELECT min(seq) AS seq, path, arg_max(alias, seq) FILTER (WHERE alias <> '') AS alias, arg_max(data_dir, seq) FILTER (WHERE data_dir <> '') AS data_dir
  FROM ({_KNOWN.format(region="region")} UNION ALL {_ENTRIES.format(supplier="supplier")}) x GROUP BY path) y WHERE path <> '/r/7' AND alias IS DISTINCT FROM 'africa'""")


_CHOSEN = ("s12", "africa", "7", "31", "none")
_choose = lambda s, d: history.select_repos(_registry(s, d), list(_CHOSEN))
_REG = lambda: ORACLES["registry"]
add_plain("select_repos", lambda s, d: _choose(s, d).select("name", "state", "path"), f"""WITH R AS MATERIALIZED ({_flat(_REG())}), W AS (SELECT unnest({list(_CHOSEN)}) AS name), M AS (SELECT name, path, 0 AS way FROM W JOIN R ON alias = name UNION ALL SELECT name, path, 1 FROM W JOIN R ON regexp_extract(path, '[^/]*$') = name),
  B AS (SELECT * FROM (SELECT *, min(way) OVER (PARTITION BY name) AS first_way FROM M) x WHERE way = first_way) SELECT W.name, CASE WHEN n IS NULL THEN 'unknown' WHEN n > 1 THEN 'ambiguous' ELSE 'selected' END AS state, path FROM W LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY name) AS n FROM B) b ON b.name = W.name""")


def _logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/lattica/savings-{uuid.uuid4().hex}"
    o = _table(spark, sf_dir, "orders").select(F.concat(F.lit("/r/"), F.col("o_custkey") % 9).alias("repo"), F.lit("measure").alias("kind"), F.col("o_orderpriority").alias("tool"), F.lit(500).alias("baseline_tokens"), (F.col("o_orderkey") % 500).alias("returned_tokens"))
    half = lambda odd: o.filter(F.col("returned_tokens") % 2 == odd)
    for rows in (half(0), half(1)):  # the second is appended to the first
        history.log_savings(rows.withColumns({"saved_tokens": F.col("baseline_tokens") - F.col("returned_tokens"), "saved_percent": F.lit(0)}), path)
    return files.read_savings_log(spark, path).select("repo", "tool", "saved_tokens")


add_plain("log_savings", _logged, "SELECT concat('/r/', o_custkey % 9) AS repo, o_orderpriority AS tool, cast(500 - o_orderkey % 500 AS bigint) AS saved_tokens FROM orders")
_NOTES = r"""plain AS (SELECT N.*, regexp_replace(regexp_replace(regexp_replace(lower(name), '[^\w\s-]', '', 'g'), '[\s_]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM N),
  pages AS MATERIALIZED (SELECT plain.*, CASE WHEN qualified_name = min(qualified_name) OVER (PARTITION BY slug) THEN slug ELSE concat(slug, '-', substr(sha256(qualified_name), 1, 8)) END AS page, community_id FROM plain LEFT JOIN C USING (qualified_name)),
  ends AS (SELECT source_qualified q, target_qualified o, kind FROM E UNION ALL SELECT target_qualified, source_qualified, kind FROM E), near AS MATERIALIZED (SELECT q, o, min(kind) AS kind FROM ends GROUP BY 1, 2),
  one AS MATERIALIZED (SELECT page, o, near.kind FROM near JOIN pages ON qualified_name = q), links AS MATERIALIZED (SELECT one.page, one.kind, p.page AS dest FROM one JOIN pages p ON p.qualified_name = o)"""
add("export_obsidian", store.obsidian_lines)
add("obsidian_links", lambda g: store.obsidian_lines(g).filter("section = 1 and line like '- %: [[%'").select("page", F.substring_index("line", "|", 1).alias("link")), "SELECT page, concat('- ', kind, ': [[', dest) AS link FROM links", _NOTES)
add("obsidian_index", lambda g: store.obsidian_index(g).select("line"), "SELECT concat('- [[', page, ']] (', kind, ')') AS line FROM pages UNION ALL SELECT concat('**Nodes:** ', count(*)) FROM N UNION ALL SELECT concat('**Edges:** ', count(*)) FROM E UNION ALL SELECT concat('**Communities:** ', count(DISTINCT community_id)) FROM C", _NOTES)
