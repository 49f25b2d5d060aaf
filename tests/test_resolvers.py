"""Second halves of the resolvers, and tests found by evidence, on small graphs."""

from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.operators import patterns, resolve

NODE = "kind string, name string, qualified_name string, file_path string, language string, parent_name string, is_test boolean, extra string"
EDGE = "kind string, source_qualified string, target_qualified string, file_path string, line int, extra string"


def graph(spark, nodes, edges):
    rows = [(k, q.split("::")[-1], q, q.split("::")[0], None, None, k == "Test", "{}") for k, q in nodes]
    return Graph(spark.createDataFrame(rows, NODE), spark.createDataFrame([(k, s, t, f, i, x) for i, (k, s, t, f, x) in enumerate(edges)], EDGE))


def targets(df):
    return {(r.source_qualified, r.line): r.target_qualified for r in df.collect()}


def test_rescript_scopes(spark):
    nodes = [("File", "/r/LogicUtils.res"), ("Function", "/r/LogicUtils.res::parse"), ("Function", "/r/LogicUtils.resi::parse"), ("Function", "/r/LogicUtils.res::Sub.deep"), ("Function", "/r/Api.resi::call"), ("Function", "/r/Api.resi::parse")]
    opened = '{"rescript_import_kind": "open"}'
    edges = [
        ("CALLS", "a", "LogicUtils.parse", "/r/Use.res", "{}"), ("CALLS", "a", "LogicUtils.parse.resp.x", "/r/Use.res", "{}"), ("CALLS", "a", "LogicUtils.Sub.deep.y", "/r/Use.res", "{}"), ("CALLS", "a", "LogicUtils.Sub", "/r/Use.res", "{}"),
        ("IMPORTS_FROM", "/r/Use.res", "LogicUtils.Sub", "/r/Use.res", opened), ("IMPORTS_FROM", "/r/Use.res", "Api", "/r/Use.res", '{"rescript_import_kind": "include"}'), ("IMPORTS_FROM", "/r/No.res", "Api", "/r/No.res", "{}"),
        ("CALLS", "a", "parse", "/r/Use.res", "{}"), ("CALLS", "a", "call", "/r/Use.res", "{}"), ("CALLS", "a", "call", "/r/No.res", "{}"), ("CALLS", "a", "/x.py::parse", "/r/Use.res", "{}"), ("IMPORTS_FROM", "/r/Use.res", "./Api.js", "/r/Use.res", "{}"),
    ]
    got = [t for _, t in sorted((k[1], v) for k, v in targets(resolve.resolve_rescript(graph(spark, nodes, edges))).items())]
    u = "/r/LogicUtils.res::"
    assert got == [u + "parse", u + "parse", u + "Sub.deep", "LogicUtils.Sub", "/r/LogicUtils.res", "/r/Api.resi", "/r/Api.resi", u + "parse", "/r/Api.resi::call", "call", "/x.py::parse", "./Api.js"]


def test_hcl_modules(spark):
    nodes = [("File", "/t/main.tf"), ("File", "/t/variables.tf"), ("Function", "/t/variables.tf::var.region"), ("Function", "/t/variables.tf::var.twice"), ("Function", "/t/main.tf::var.twice"), ("File", "/t/modules/network/main.tf"), ("File", "/t/modules/network/a.tf"), ("File", "/t/modules/db/z.tf"), ("File", "/t/modules/db/b.tf"), ("Function", "/t/modules/db/b.tf::var.region")]
    edges = [
        ("REFERENCES", "/t/main.tf::local.tags", "/t/main.tf::var.region", "/t/main.tf", "{}"), ("REFERENCES", "x", "/t/main.tf::var.twice", "/t/main.tf", "{}"), ("REFERENCES", "x", "var.twice", "/t/main.tf", "{}"),
        ("IMPORTS_FROM", "m", "./modules/network", "/t/main.tf", "{}"), ("IMPORTS_FROM", "m", "./modules/../modules/db/", "/t/main.tf", "{}"), ("IMPORTS_FROM", "m", "../../variables.tf", "/t/modules/db/b.tf", "{}"), ("IMPORTS_FROM", "m", "./none", "/t/main.tf", "{}"), ("IMPORTS_FROM", "m", "./modules/db", "/t/x.py", "{}"),
    ]
    got = [t for _, t in sorted((k[1], v) for k, v in targets(resolve.resolve_hcl(graph(spark, nodes, edges))).items())]
    assert got == ["/t/variables.tf::var.region", "/t/main.tf::var.twice", "var.twice", "/t/modules/network/main.tf", "/t/modules/db/b.tf", "/t/variables.tf", "./none", "./modules/db"]


def test_normal_paths(spark):
    paths = {"/a/./b/../c": "/a/c", "/../a": "/a", "a//b/": "a/b", "/": "/", "": ""}
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", resolve.normal_path(F.col("p")).alias("n"))
    assert {r.p: r.n for r in df.collect()} == paths


def test_candidates_are_counted_and_listed_in_part(spark):
    nodes = [("Function", f"/m{i:02d}.py::f") for i in range(30)] + [("Function", "/m05.py::only")]
    edges = [("IMPORTS_FROM", "/u.py", f"/m{i:02d}.py", "/u.py", "{}") for i in range(30)] + [("CALLS", "/u.py::x", "f", "/u.py", "{}"), ("CALLS", "/u.py::x", "only", "/u.py", "{}"), ("CALLS", "/u.py::x", "nobody", "/u.py", "{}")]
    got = {r.line: r for r in resolve.resolve_bare_calls(graph(spark, nodes, edges)).filter("kind = 'CALLS'").collect()}
    assert got[30].resolution == "ambiguous" and got[30].candidates == [f"/m{i:02d}.py::f" for i in range(20)] and got[30].target_qualified == "f"
    assert (got[31].target_qualified, got[31].resolution) == ("/m05.py::only", "resolved") and got[32].resolution == "unresolved"


def test_tests_by_evidence(spark):
    nodes = [("File", "/a.py"), ("Class", "/a.py::C"), ("Function", "/a.py::C.m"), ("Function", "/a.py::run"), ("Function", "/b.py::run"), ("Test", "/t.py::t1"), ("Test", "/t.py::t2"), ("Test", "/t.py::t3"), ("Test", "/u.py::t4"), ("Function", "/a.py::callee")]
    edges = [
        ("CONTAINS", "/a.py::C", "/a.py::C.m", "/a.py", "{}"), ("TESTED_BY", "/a.py::C.m", "/t.py::t1", "/t.py", "{}"), ("TESTED_BY", "run", "/t.py::t2", "/t.py", "{}"), ("IMPORTS_FROM", "/t.py", "/a.py", "/t.py", "{}"),
        ("TESTED_BY", "run", "/u.py::t4", "/u.py", "{}"), ("TESTED_BY", "/a.py::run", "/t.py::t3", "/t.py", '{"ambiguous_targets": ["x"]}'), ("CALLS", "/a.py::run", "/a.py::callee", "/a.py", "{}"), ("TESTED_BY", "/a.py::callee", "/t.py::t3", "/t.py", "{}"),
        ("CALLS", "/b.py::run", "callee", "/b.py", "{}"), ("TESTED_BY", "/a.py::callee", "/gone.py::t9", "/gone.py", "{}"),
    ]
    g = graph(spark, nodes, edges)
    starts = spark.createDataFrame([("/a.py",), ("/a.py::C",), ("/a.py::run",), ("/b.py::run",)], "qualified_name string")
    got = {tuple(r) for r in patterns.transitive_tests(g, starts).collect()}
    assert got == {("/a.py", "/t.py::t1", False), ("/a.py", "/t.py::t3", False), ("/a.py::C", "/t.py::t1", False), ("/a.py::run", "/t.py::t2", False), ("/a.py::run", "/t.py::t3", True)}


def test_callers_of_overloads(spark):
    """A bare C++ call tells nothing of two functions of a name, one with a receiver nothing at all."""
    cpp = lambda names: [("Function", q.rsplit("::", 1)[1].split("(")[0], q, q.split("::")[0], "cpp", None, False, "{}") for q in names]
    nodes = cpp(["/w.cpp::mark()", "/w.cpp::del(File*,bool)", "/w.cpp::del(File*)", "/w.cpp::one(int)", "/u.cpp::user()", "/u.cpp::other()"])
    edges = [("CALLS", "/w.cpp::del(File*,bool)", "/w.cpp::mark()", "/w.cpp", 1, "{}"), ("CALLS", "/u.cpp::user()", "del", "/u.cpp", 2, "{}"), ("CALLS", "/u.cpp::user()", "one", "/u.cpp", 3, "{}"), ("CALLS", "/u.cpp::other()", "one", "/u.cpp", 4, '{"receiver": "w"}'), ("CALLS", "/u.cpp::other()", "mark", "/u.cpp", 5, '{"unresolved_targets": ["x"]}')]
    g = Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE))
    got = lambda q: {(r.qualified_name, r.target_resolution) for r in patterns.callers_of(g, q).collect()}
    assert got("/w.cpp::mark()") == {("/w.cpp::del(File*,bool)", "resolved")}
    assert got("/w.cpp::del(File*)") == got("/w.cpp::del(File*,bool)") == set()
    assert got("/w.cpp::one(int)") == {("/u.cpp::user()", "unresolved")}


def test_mirrored_tests_follow_scoped_calls(spark):
    nodes = [("Function", "go", "/a.php::Car.go", "/a.php", "php", "Car", False, "{}"), ("Test", "t", "/t.php::t", "/t.php", "php", None, True, "{}")]
    edges = [("CALLS", "/t.php::t", "Car::go", "/t.php", 3, "{}"), ("TESTED_BY", "Car::go", "/t.php::t", "/t.php", 3, "{}"), ("TESTED_BY", "Car::go", "/t.php::t", "/t.php", 4, "{}"), ("TESTED_BY", "Car::stop", "/t.php::t", "/t.php", 3, "{}")]
    g = Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE))
    got = {(r.kind, r.source_qualified, r.target_qualified, r.line) for r in resolve.resolve_scoped(g).collect()}
    assert got == {("CALLS", "/t.php::t", "/a.php::Car.go", 3), ("TESTED_BY", "/a.php::Car.go", "/t.php::t", 3), ("TESTED_BY", "Car::go", "/t.php::t", 4), ("TESTED_BY", "Car::stop", "/t.php::t", 3)}
