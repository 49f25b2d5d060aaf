"""Endpoint resolution: edges whose ends are bare names get full names where the evidence leaves one choice.

Every resolver returns a new edges DataFrame: candidates are joined, counted per
edge, and an end is rewritten only where exactly one is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica.functions import text as X
from lattica.graph import Graph

LISTED = 20


def _keyed(edges: DataFrame) -> DataFrame:
    """Edges with a key that equal call sites share."""
    return edges.withColumn("_e", F.xxhash64("kind", "source_qualified", "target_qualified", "file_path", F.coalesce("line", F.lit(-1))))


def imported_files(g: Graph) -> DataFrame:
    """(file_path, other): each file with itself and the files it imports, by path, namespace or a member's name."""
    imports = g.edges.filter(F.col("kind") == "IMPORTS_FROM").select("file_path", F.substring_index("target_qualified", "::", 1).alias("other"))
    spaces = g.nodes.select(F.col("file_path").alias("_f"), F.explode(F.from_json(F.get_json_object("extra", "$.csharp_namespaces"), "array<string>")).alias("other"))
    by_space = imports.join(spaces, "other").select("file_path", F.col("_f").alias("other"))
    own = g.nodes.select("file_path", F.col("file_path").alias("other"))
    return imports.union(by_space).union(own).distinct()


def _resolve_end(g: Graph, kind: str, end: str, kinds: tuple[str, ...]) -> DataFrame:
    """Rewrite a bare end of edges of a kind by the only candidate in the file or its imports."""
    e = _keyed(g.edges)
    bare = e.filter((F.col("kind") == kind) & ~F.col(end).contains("::") & (F.col(end) != "")).select("_e", "file_path", F.col(end).alias("name")).distinct()
    nodes = g.nodes.filter(F.col("kind").isin(*kinds)).select("name", "qualified_name", F.col("file_path").alias("other"))
    near = bare.join(imported_files(g), "file_path").join(nodes, ["name", "other"])
    found = near.select("_e", "qualified_name").distinct()
    counts = found.groupBy("_e").agg(F.count(F.lit(1)).alias("_n"), F.min("qualified_name").alias("_q"))
    # the first few of each edge, cut in every task before they meet
    first = found.withColumn("_p", F.row_number().over(W.partitionBy("_e").orderBy("qualified_name"))).filter(F.col("_p") <= LISTED)
    listed = first.groupBy("_e").agg(F.array_sort(F.collect_list("qualified_name")).alias("_c"))
    out = e.join(counts.join(listed, "_e"), "_e", "left")
    new = F.when(F.col("_n") == 1, F.col("_q")).otherwise(F.col(end))
    several = F.when(F.col("_n") > 1, F.col("_c"))
    state = F.when(F.col("_n") == 1, "resolved").when(F.col("_n") > 1, "ambiguous").when((F.col("kind") == kind) & ~F.col(end).contains("::"), "unresolved")
    return out.withColumn("resolution", state).withColumn("candidates", several).withColumn(end, new).drop("_e", "_c", "_n", "_q")


def resolve_bare_calls(g: Graph) -> DataFrame:
    return _resolve_end(g, "CALLS", "target_qualified", ("Function", "Test", "Class"))


def resolve_bare_tests(g: Graph) -> DataFrame:
    return _resolve_end(g, "TESTED_BY", "source_qualified", ("Function", "Test", "Class"))


def unique_by_key(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, value) of keys that have one distinct value."""
    return rows.groupBy(*key).agg(F.countDistinct(value).alias("_n"), F.min(value).alias(value)).filter("_n = 1").drop("_n")


def resolve_python_imports(g: Graph) -> DataFrame:
    """Dotted modules of imports become the only file whose path ends in them."""
    files = g.nodes.filter((F.col("kind") == "File") & F.col("file_path").endswith(".py")).select("file_path").distinct()
    module = F.regexp_replace(F.regexp_replace("_s", r"\.py$", ""), r"/__init__$", "")
    tails = files.select(F.col("file_path").alias("_path"), F.explode(X.path_suffixes(F.col("file_path"))).alias("_s")).select("_path", F.replace(module, F.lit("/"), F.lit(".")).alias("target_qualified"))
    sure = unique_by_key(tails, ["target_qualified"], "_path")
    e = g.edges.join(sure, "target_qualified", "left")
    hit = (F.col("kind") == "IMPORTS_FROM") & F.col("_path").isNotNull() & ~F.col("target_qualified").contains("/")
    return e.withColumn("target_qualified", F.when(hit, F.col("_path")).otherwise(F.col("target_qualified"))).select(*g.edges.columns)


def _members(g: Graph) -> DataFrame:
    """(owner, method, member): methods by the name of their class."""
    return g.nodes.filter(F.col("parent_name").isNotNull()).select(F.col("parent_name").alias("owner"), F.col("name").alias("method"), F.col("qualified_name").alias("member"))


def _by_injection(g: Graph, edge_kind: str, mark: str) -> DataFrame:
    """Calls on an injected field: its type, that type's only implementor, that one's method."""
    extra = lambda k: F.get_json_object("extra", f"$.{k}")
    fields = g.edges.filter(F.col("kind") == edge_kind).select(F.col("source_qualified").alias("_cls"), extra("field_name").alias("_field"), X.last_segment(F.col("target_qualified")).alias("_type"))
    impl = g.edges.filter(F.col("kind").isin("IMPLEMENTS", "INHERITS")).select(X.last_segment(F.col("target_qualified")).alias("_type"), X.last_segment(F.col("source_qualified")).alias("_impl"))
    sole = unique_by_key(impl, ["_type"], "_impl")
    typed = unique_by_key(fields.join(sole, "_type", "left").withColumn("owner", F.coalesce("_impl", "_type")), ["_cls", "_field"], "owner")
    methods = unique_by_key(_members(g), ["owner", "method"], "member")
    e = g.edges.withColumn("_field", extra("receiver")).withColumn("_cls", F.regexp_replace("source_qualified", r"\.[^.:]*$", "")).withColumn("method", X.last_segment(X.last_segment(F.col("target_qualified")), "."))
    e = e.join(typed, ["_cls", "_field"], "left").join(methods, ["owner", "method"], "left")
    hit = (F.col("kind") == "CALLS") & F.col("member").isNotNull() & ~F.coalesce(F.col("extra"), F.lit("")).contains('"spring_resolved"')
    return e.withColumn("target_qualified", F.when(hit, F.col("member")).otherwise(F.col("target_qualified"))).withColumn(mark, hit).select(*g.edges.columns, mark)


def resolve_spring_di(g: Graph) -> DataFrame:
    return _by_injection(g, "INJECTS", "spring_resolved")


def resolve_temporal(g: Graph) -> DataFrame:
    return _by_injection(g, "TEMPORAL_STUB", "temporal_resolved")


def event_calls(g: Graph) -> DataFrame:
    """Calls from each publisher of an event to each of its listeners, confidence 0.95, inferred.

    These are the result, one row per pair; an event's publishers and listeners
    meet by a join on the event.
    """
    pub = g.edges.filter(F.col("kind") == "PUBLISHES").select(F.col("target_qualified").alias("_ev"), "source_qualified", "file_path", "line")
    sub = g.edges.filter(F.col("kind") == "HANDLES").select(F.col("target_qualified").alias("_ev"), F.col("source_qualified").alias("target_qualified"))
    return pub.join(sub.distinct(), "_ev").select(F.lit("CALLS").alias("kind"), "source_qualified", "target_qualified", "file_path", "line", F.lit(0.95).alias("confidence"), F.lit("INFERRED").alias("confidence_tier")).distinct()


def event_nodes(g: Graph) -> DataFrame:
    names = g.edges.filter(F.col("kind").isin("PUBLISHES", "HANDLES")).select(F.col("target_qualified").alias("qualified_name")).distinct()
    return names.join(g.nodes.select("qualified_name"), "qualified_name", "left_anti").select(F.lit("Event").alias("kind"), X.last_segment(F.col("qualified_name")).alias("name"), "qualified_name", F.lit('{"virtual": true}').alias("extra"))


def _mirrored(edges: DataFrame, new: Column) -> DataFrame:
    """Calls with their ``new`` target, and with it the tests that mirror them: TESTED_BY edges of the same file and line from the old target to the caller."""
    rows = edges.withColumn("_new", new)
    at = F.coalesce("line", F.lit(-1))
    moved = rows.filter((F.col("kind") == "CALLS") & (F.col("_new") != F.col("target_qualified")))
    moved = moved.groupBy(F.col("target_qualified").alias("_old"), F.col("source_qualified").alias("_test"), F.col("file_path").alias("_f"), at.alias("_l")).agg(F.min("_new").alias("_subject"))
    mirror = rows.withColumn("_k", F.when(F.col("kind") == "TESTED_BY", F.col("source_qualified")))
    out = mirror.join(moved, (F.col("_k") == F.col("_old")) & (F.col("target_qualified") == F.col("_test")) & (F.col("file_path") == F.col("_f")) & (at == F.col("_l")), "left")
    return out.withColumns({"source_qualified": F.coalesce("_subject", "source_qualified"), "target_qualified": F.when(F.col("kind") == "CALLS", F.col("_new")).otherwise(F.col("target_qualified"))})


def resolve_scoped(g: Graph) -> DataFrame:
    """``Class::method`` calls of languages with scopes: the only such member, or the only one in reach of the file; mirrored tests follow."""
    e = _keyed(g.edges)
    parts = F.split("target_qualified", "::")
    scoped = e.filter((F.col("kind") == "CALLS") & (F.size(parts) >= 2) & ~F.col("target_qualified").contains("/")).select("_e", "file_path", F.element_at(parts, -2).alias("owner"), F.element_at(parts, -1).alias("method")).distinct()
    members = g.nodes.filter(F.col("parent_name").isNotNull()).select(F.lower("parent_name").alias("_o"), F.lower("name").alias("_m"), "qualified_name", F.col("file_path").alias("other"))
    cand = scoped.join(members, (F.lower("owner") == F.col("_o")) & (F.lower("method") == F.col("_m")))
    every = unique_by_key(cand, ["_e"], "qualified_name")
    near = unique_by_key(cand.join(imported_files(g), ["file_path", "other"], "left_semi"), ["_e"], "qualified_name").withColumnRenamed("qualified_name", "_near")
    out = e.join(every, "_e", "left").join(near, "_e", "left")
    return _mirrored(out, F.coalesce("qualified_name", "_near", "target_qualified")).select(*g.edges.columns)


def resolve_cpp_scope(g: Graph) -> DataFrame:
    """Calls with a namespace path: the innermost enclosing scope of the caller in which the path names one node.

    (edge columns, resolution): resolved, ambiguous (several in that scope) or null.
    Tests that mirror a call follow it.
    """
    e = _keyed(g.edges)
    scope = F.get_json_object("extra", "$.receiver_scope")
    calls = e.filter((F.col("kind") == "CALLS") & scope.isNotNull()).select("_e", F.split(scope, "::").alias("_sc"), F.col("target_qualified").alias("_t")).distinct()
    tries = calls.select("_e", "_t", F.posexplode(F.transform(F.sequence(F.size("_sc"), F.lit(0), F.lit(-1)), lambda i: F.slice("_sc", 1, i))).alias("_p", "_scope"))
    tries = tries.withColumn("_sym", F.when(F.size("_scope") > 0, F.concat_ws("::", F.array_join("_scope", "::"), "_t")).otherwise(F.col("_t")))
    named = g.nodes.select(X.symbol(F.col("qualified_name")).alias("_sym"), "qualified_name")
    hits = tries.join(named, "_sym").groupBy("_e", "_p").agg(F.countDistinct("qualified_name").alias("_n"), F.min("qualified_name").alias("_q"))
    first = hits.groupBy("_e").agg(F.min_by(F.struct("_n", "_q"), "_p").alias("_b"))
    out = e.join(first, "_e", "left")
    told = out.withColumn("resolution", F.when(F.col("_b._n") == 1, "resolved").when(F.col("_b._n") > 1, "ambiguous"))
    return _mirrored(told, F.when(F.col("_b._n") == 1, F.col("_b._q")).otherwise(F.col("target_qualified"))).select(*g.edges.columns, "resolution")


def _rescript_modules(g: Graph) -> DataFrame:
    """(module, module_file): files by the name they give their module, an implementation before an interface."""
    files = g.nodes.filter(F.col("file_path").rlike(r"(?i)\.resi?$")).select("file_path").distinct()
    named = files.select(X.stem(F.col("file_path")).alias("module"), "file_path", F.lower("file_path").endswith(".resi").alias("_i"))
    return named.groupBy("module").agg(F.min_by("file_path", F.struct("_i", "file_path")).alias("module_file"))


def resolve_rescript(g: Graph) -> DataFrame:
    """Calls and imports across modules.

    ``Module.a.b.c`` means the longest of a.b.c, a.b and a that the module's
    file defines, as what follows may be fields of a result.  A bare name means
    the first module that the file opens or includes, in the order of lines,
    whose file defines it.  Imports by module become the module's file.
    """
    modules = _rescript_modules(g)
    e = _keyed(g.edges)
    known = g.nodes.select(F.col("qualified_name").alias("_q")).distinct()
    calls = e.filter((F.col("kind") == "CALLS") & ~F.col("target_qualified").contains("::")).select("_e", "file_path", "target_qualified").distinct()
    parts = F.split("target_qualified", r"\.")
    dotted = calls.filter(F.col("target_qualified").contains(".")).select("_e", F.element_at(parts, 1).alias("module"), F.slice(parts, 2, F.size(parts)).alias("_rest"))
    tails = dotted.join(modules, "module").select("_e", "module_file", "_rest", F.explode(F.sequence(F.lit(1), F.size("_rest"))).alias("_n"))
    tries = tails.select("_e", (-F.col("_n")).alias("_rank"), F.concat("module_file", F.lit("::"), F.array_join(F.slice(F.col("_rest"), F.lit(1), F.col("_n")), ".")).alias("_q"))
    opening = F.get_json_object("extra", "$.rescript_import_kind").isin("open", "include") if "extra" in g.edges.columns else F.lit(False)
    opens = g.edges.filter((F.col("kind") == "IMPORTS_FROM") & F.col("file_path").rlike(r"(?i)\.resi?$")).filter(opening).select("file_path", F.substring_index("target_qualified", ".", 1).alias("module"), F.coalesce("line", F.lit(0)).alias("_rank"))
    bare = calls.filter(~F.col("target_qualified").contains(".")).join(opens, "file_path").join(modules, "module").select("_e", "_rank", F.concat("module_file", F.lit("::"), "target_qualified").alias("_q"))
    best = tries.union(bare).join(known, "_q", "left_semi").groupBy("_e").agg(F.min_by("_q", F.struct("_rank", "_q")).alias("_q"))
    roots = modules.select(F.col("module").alias("_root"), "module_file")
    importing = (F.col("kind") == "IMPORTS_FROM") & ~F.col("target_qualified").rlike(r"[/\\]")
    out = e.join(best, "_e", "left").withColumn("_root", F.when(importing, F.substring_index("target_qualified", ".", 1))).join(roots, "_root", "left")
    return out.withColumn("target_qualified", F.coalesce("_q", "module_file", "target_qualified")).select(*g.edges.columns)


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def normal_path(path: Column) -> Column:
    """A path without empty steps, ``.`` and ``..``; it stays absolute if it was."""
    steps = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, s)))
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(walked, "/"))


def resolve_hcl(g: Graph) -> DataFrame:
    """References to the only node of that name in the referring file's directory, which is one module; local module sources to their file.

    A source that names a directory means its main.tf, or else its first file.
    """
    own = g.nodes.filter(F.col("file_path").rlike(r"\.(tf|hcl)$"))
    defs = unique_by_key(own.filter(F.col("kind") != "File").select(_folder(F.col("file_path")).alias("_dir"), F.col("name").alias("_name"), F.col("qualified_name").alias("_q")), ["_dir", "_name"], "_q")
    known = own.select(F.col("qualified_name").alias("target_qualified"), F.lit(True).alias("_known")).distinct()
    files = own.select("file_path").distinct().select(F.col("file_path").alias("_file"))
    exact = files.select(F.col("_file").alias("_at"), F.lit(0).alias("_rank"), "_file")
    inside = files.select(_folder(F.col("_file")).alias("_at"), F.when(F.col("_file").endswith("/main.tf"), 1).otherwise(2).alias("_rank"), "_file")
    places = exact.union(inside).groupBy("_at").agg(F.min_by("_file", F.struct("_rank", "_file")).alias("_file"))
    local = (F.col("kind") == "IMPORTS_FROM") & F.col("file_path").rlike(r"\.(tf|hcl)$") & F.col("target_qualified").rlike(r"^\.\.?/")
    at = F.when(local, normal_path(F.concat(_folder(F.col("file_path")), F.lit("/"), "target_qualified")))
    name = F.regexp_replace("target_qualified", "^.*?::", "")
    e = g.edges.join(known, "target_qualified", "left").withColumns({"_dir": _folder(F.col("file_path")), "_name": name, "_at": at}).join(defs, ["_dir", "_name"], "left").join(places, "_at", "left")
    hit = F.col("kind").isin("REFERENCES", "DEPENDS_ON") & F.col("_q").isNotNull() & F.col("_known").isNull()
    return e.withColumn("target_qualified", F.when(hit, F.col("_q")).otherwise(F.coalesce("_file", "target_qualified"))).select(*g.edges.columns)


def resolve_for_display(g: Graph) -> DataFrame:
    """Bare targets by name: the only node, one of the same file, one of the same directory, else the first."""
    where = lambda p: F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    e = _keyed(g.edges)
    full = g.nodes.select(F.col("qualified_name").alias("target_qualified"))
    bare = e.join(full, "target_qualified", "left_anti").select("_e", "file_path", X.last_segment(F.col("target_qualified")).alias("name")).distinct()
    n = g.nodes.select("name", "qualified_name", F.col("file_path").alias("_f"))
    rank: Column = F.when(F.col("_f") == F.col("file_path"), 0).when(where("_f") == where("file_path"), 1).otherwise(2)
    best = bare.join(n, "name").groupBy("_e").agg(F.min_by("qualified_name", F.struct(rank, F.col("qualified_name"))).alias("_q"))
    return e.join(best, "_e", "left").withColumn("target_qualified", F.coalesce("_q", "target_qualified")).select(*g.edges.columns)


def last_wins(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The row of greatest sequence of every key."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(F.desc(seq)))).filter("_r = 1").drop("_r")
