"""Stems and the stored index of terms."""


from lattica.functions.porter import porter
from lattica.graph import Graph
from lattica.operators import search
from lattica.plans import text_index
from lattica.plans.ledger import GraphStore

#: Words and their stems.
STEMS = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "motoring": "motor", "sing": "sing", "conflated": "conflat", "sized": "size", "hopping": "hop",
    "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "digitizer": "digit", "hopefulness": "hope", "triplicate": "triplic", "electriciti": "electr",
    "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "generalizations": "gener", "by": "by",
}


def test_stems():
    assert {w: porter(w) for w in STEMS} == STEMS


NODE = "qualified_name string, name string, file_path string, kind string"
EDGE = "kind string, source_qualified string, target_qualified string, file_path string"


def rows(*names):
    return [(f"/{f}.py::{n}", n, f"/{f}.py", "Function") for f, n in names]


def test_index_follows_files_and_reads_its_terms(spark, tmp_path):
    s = GraphStore(spark, f"file://{tmp_path}/s", 32)
    first = rows(("a", "get_users"), ("a", "user_getter"), ("b", "running_jobs"), ("c", "run_job"))
    s.write(Graph(spark.createDataFrame(first, NODE), spark.createDataFrame([], EDGE)))
    text_index.build(s)
    found = lambda q: {r.qualified_name for r in text_index.fts_search(s, q).collect()}
    assert found("run jobs") == {"/b.py::running_jobs", "/c.py::run_job"} and found("getting user") == {"/a.py::get_users"} and found("") == set()
    before = s.state()
    new = rows(("c", "walk_job"))
    s.commit(before, {"nodes": s.replaced("nodes", before, spark.createDataFrame([("/c.py",)], "file_path string"), spark.createDataFrame(new, NODE))})
    text_index.refresh(s, spark.createDataFrame([("/c.py",)], "file_path string"))
    assert found("run job") == {"/b.py::running_jobs"} and found("walked jobs") == {"/c.py::walk_job"}
    after = s.state()
    same = [b for b, p in after.tables["postings"].items() if before.tables["postings"].get(b) == p]
    assert same, "terms that neither version has stay where they are"
    g = s.read()
    whole = {(r.qualified_name, round(r.score, 9)) for r in search.phrase_search(search.node_index(g), "qualified_name", "jobs").collect()}
    stored = {(r.qualified_name, round(r.score, 9)) for r in text_index.fts_search(s, "jobs").collect()}
    assert whole == stored and len(stored) == 2
    assert [r.qualified_name for r in search.search_nodes(g, "job", postings=text_index.lookup(s, "job")[0]).collect()] == ["/b.py::running_jobs", "/c.py::walk_job"]
