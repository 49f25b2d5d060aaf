"""Betweenness, communities and flows against plain loops on small graphs."""

import random
from collections import Counter, defaultdict, deque

import pytest
from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.plans import centrality, communities, flows, impact

NODE = "kind string, name string, qualified_name string, file_path string, line_start int, line_end int, language string, parent_name string, is_test boolean, extra string"
EDGE = "kind string, source_qualified string, target_qualified string, file_path string, line int, extra string, confidence double"


def graph(spark, names, edges, tests=()):
    rows = [("Test" if q in tests else "Function", q.split("::")[-1], q, q.split("::")[0], 1, 9, "python", None, q in tests, "{}") for q in names]
    return Graph(spark.createDataFrame(rows, NODE), spark.createDataFrame([(k, s, t, s.split("::")[0], 1, "{}", 1.0) for k, s, t in edges], EDGE))


def plain_betweenness(pairs, names, sources):
    adj = defaultdict(set)
    for a, b in pairs:
        if a != b:
            adj[a].add(b)
    out = Counter()
    for s in sources:
        dist, paths, order, q = {s: 0}, Counter({s: 1}), [], deque([s])
        while q:
            v = q.popleft()
            order.append(v)
            for w in adj[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    q.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        share = Counter()
        for w in reversed(order):
            for v in order:
                if w in adj[v] and dist[w] == dist[v] + 1:
                    share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                out[w] += share[w]
    n = len(names)
    return {k: v * (n / len(sources)) / ((n - 1) * (n - 2)) for k, v in out.items() if v}


@pytest.mark.parametrize("seed", [1, 2])
def test_betweenness_by_rounds(spark, seed):
    rng = random.Random(seed)
    names = [f"/m{i % 4}.py::f{i}" for i in range(18)]
    edges = [("CALLS", rng.choice(names), rng.choice([*names, "ext"])) for _ in range(40)]
    g = graph(spark, names, edges)
    ends = {x for _, a, b in edges for x in (a, b)}
    want = {k: v for k, v in plain_betweenness([e[1:] for e in edges], ends, sorted(ends)).items() if k in names}
    got = {r.qualified_name: r.betweenness for r in centrality.bridge_nodes(g, top=100).collect()}
    assert got == pytest.approx(want, abs=1e-11)
    some = [r.node for r in spark.createDataFrame([(x,) for x in ends], "node string").orderBy(F.xxhash64("node", F.lit(42)), "node").limit(5).collect()]
    want = {k: v for k, v in plain_betweenness([e[1:] for e in edges], ends, some).items() if k in names}
    assert {r.qualified_name: r.betweenness for r in centrality.bridge_nodes(g, top=100, sources=5).collect()} == pytest.approx(want, abs=1e-11)


def test_no_paths(spark):
    assert centrality.bridge_nodes(graph(spark, ["/a.py::f"], [])).count() == 0


def ring(cliques, size):
    groups = [[f"/c{c}.py::n{c}_{i}" for i in range(size)] for c in range(cliques)]
    edges = [("CALLS", x, y) for g in groups for x in g for y in g if x < y]
    edges += [("CALLS", groups[c][0], groups[(c + 1) % cliques][1]) for c in range(cliques)]
    return groups, edges


def plain_modularity(edges, of, resolution):
    pairs = {tuple(sorted(e[1:])) for e in edges}
    k, inside = Counter(), Counter()
    for a, b in pairs:
        k[of[a]] += 1
        k[of[b]] += 1
        if of[a] == of[b]:
            inside[of[a]] += 2
    m = 2 * len(pairs)
    return sum(inside[c] / m - resolution * (k[c] / m) ** 2 for c in k)


def test_leiden_finds_a_ring_of_cliques(spark):
    groups, edges = ring(6, 5)
    g = graph(spark, [x for c in groups for x in c], edges)
    of = {r.qualified_name: r.community for r in communities.by_modularity(g, 1.0).collect()}
    assert [len({of[x] for x in c}) for c in groups] == [1] * 6 and len(set(of.values())) == 6


def test_leiden_communities_are_connected_and_good(spark):
    rng = random.Random(3)
    names = [f"/r.py::v{i}" for i in range(60)]
    home = {x: i % 4 for i, x in enumerate(names)}
    edges = [("CALLS", a, b) for a in names for b in names if a < b and rng.random() < (0.25 if home[a] == home[b] else 0.02)]
    g = graph(spark, names, edges)
    of = {r.qualified_name: r.community for r in communities.by_modularity(g, 1.0, min_size=1).collect()}
    assert plain_modularity(edges, of, 1.0) > plain_modularity(edges, {x: home[x] for x in names}, 1.0) - 0.02
    assert communities.modularity(g, communities.by_modularity(g, 1.0, min_size=1)).first()[0] == pytest.approx(plain_modularity(edges, of, 1.0))
    for c in set(of.values()):
        own = {x for x in of if of[x] == c}
        seen, todo = set(), [min(own)]
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += [b if a == v else a for _, a, b in edges if v in (a, b) and (b if a == v else a) in own]
        assert seen == own and c == min(own)


def test_parts_of_communities(spark):
    edges = spark.createDataFrame([(a, b) for x, y in [("a", "b"), ("b", "c"), ("d", "e"), ("c", "d")] for a, b in ((x, y), (y, x))], "a string, b string")
    members = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "y"), ("e", "x"), ("f", "y")], "a string, c string")
    assert {r.a: r.part for r in communities.connected(edges, members).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "f"}


def test_tests_go_with_what_they_test(spark):
    names = [f"/p.py::f{i}" for i in range(4)] + ["/t.py::t0", "/t.py::t1", "/t.py::t2"]
    edges = [("TESTED_BY", "/p.py::f0", "/t.py::t0"), ("TESTED_BY", "/t.py::t0", "f1"), ("TESTED_BY", "/p.py::f2", "/t.py::t1"), ("TESTED_BY", "/p.py::f0", "/t.py::t1"), ("TESTED_BY", "/t.py::t1", "/t.py::t2")]
    g = graph(spark, names, edges, {"/t.py::t0", "/t.py::t1", "/t.py::t2"})
    before = {"/p.py::f0": "A", "/p.py::f1": "A", "/p.py::f2": "B", "/p.py::f3": "B", "/t.py::t0": "C", "/t.py::t1": "B", "/t.py::t2": "C"}
    c = spark.createDataFrame(sorted(before.items()), "qualified_name string, community string")
    after = {r.qualified_name: r.community for r in communities.with_tests(g, c).collect()}
    assert after == before | {"/t.py::t0": "A"}  # t1's own is among the tied, t2 has no subject


def test_oversized_communities_fall_apart(spark):
    groups, edges = ring(4, 5)
    names = [x for c in groups for x in c]
    g = graph(spark, [*names, "/o.py::o1", "/o.py::o2"], edges)
    one = spark.createDataFrame([(x, "big") for x in names] + [("/o.py::o1", "small"), ("/o.py::o2", "small")], "qualified_name string, community string")
    got = {r.qualified_name: (r.community, r.parent) for r in communities.split_oversized(g, one).collect()}
    assert got["/o.py::o1"] == ("small", None) and len(got) == 22
    assert all(p == "big" for q, (_, p) in got.items() if q in names) and len({c for q, (c, _) in got.items() if q in names}) > 1


def plain_flows(edges, entries, depth):
    adj = defaultdict(set)
    for _, a, b in edges:
        adj[a].add(b)
    out = {}
    for s in entries:
        place, front = {s: (0, 0)}, [s]
        for hop in range(1, depth + 1):
            found = {}
            for v in front:
                for w in adj[v]:
                    if w not in place:
                        found[w] = min(found.get(w, 10**9), place[v][1])
            front = sorted(found, key=lambda w: (found[w], w))
            for w in front:
                place[w] = (hop, len(place))
        if len(place) > 1:
            out |= {(s, w): p for w, p in place.items()}
    return out


@pytest.mark.parametrize("depth", [15, 2])
def test_flows_of_many_entries_by_bits(spark, depth):
    rng = random.Random(7)
    names = [f"/m{i % 5}.py::f{i:03d}" for i in range(150)]
    edges = [("CALLS", rng.choice(names), rng.choice(names)) for _ in range(220)]
    g = graph(spark, names, edges)
    entries = spark.createDataFrame([(x,) for x in names[:140]], "qualified_name string").repartition(3)
    got = {(r.entry, r.qualified_name): (r.hop, r.position) for r in flows.trace(g, entries, depth).collect()}
    assert got == plain_flows(edges, names[:140], depth)
    sizes = Counter(e for e, _ in got)
    assert {r.entry: r.node_count for r in flows.criticality(g, flows.reach(g, entries, depth)).collect()} == sizes


def test_positions_walk_numbers_and_useful_calls(spark, monkeypatch):
    stored, real = {}, flows.keep
    names = [f"/m.py::{x}" for x in "abcde"]
    e = dict(zip("abcde", names, strict=True))
    calls = [("a", "c"), ("a", "b"), ("b", "e"), ("c", "d"), ("d", "a"), ("e", "b"), ("e", "d")]
    g = graph(spark, names, [("CALLS", e[x], e[y]) for x, y in calls])
    reached = flows.reach(g, spark.createDataFrame([(e["a"],)], "qualified_name string"))
    monkeypatch.setattr(flows, "keep", lambda df, name: stored.setdefault(name, df) and real(df, name))
    got = {r.qualified_name[-1]: r.position for r in flows.placed(g, reached).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "e": 3, "d": 4}
    assert stored["links"].count() == 4 and dict(stored["placed"].dtypes)["s"] == "bigint"  # calls back and within a hop are gone
    whole = flows.flow_tables(g, spark.createDataFrame([(e["a"],)], "qualified_name string"))
    assert [tuple(r) for r in flows.flow_snapshots(whole).collect()] == [(e["a"], [e[x] for x in "abced"])]


def test_entries_of_one_part_share_words(spark):
    edges = [("CALLS", f"/m.py::e{i}", f"/m.py::p{i % 4}a") for i in range(256)] + [("CALLS", f"/m.py::p{k}a", f"/m.py::p{k}b") for k in range(4)]
    g = graph(spark, sorted({x for e in edges for x in e[1:]}), edges)
    found = flows.reach(g, flows.entry_points(g))
    assert found.entries.count() == 256 and found.flows().count() == 256 * 3
    words = {r.qualified_name: r.n for r in found.rows.groupBy("qualified_name").agg(F.countDistinct("word").alias("n")).collect()}
    assert max(words.values()) <= 2
    whole, bare = flows.flow_tables(g), flows.flow_tables(g, positions=False)
    assert flows.flow_counts(bare).exceptAll(flows.flow_counts(whole)).isEmpty() and bare.memberships.count() == 256 * 3
    assert sorted(flows.get_flow(bare, "::e1", positions=False).collect()) == sorted(flows.get_flow(whole, "::e1").collect()) != []
    files = spark.createDataFrame([("/m.py",)], "file_path string")
    again = flows.incremental_flows(bare, files, positions=False)
    assert again.flows.select("entry", "node_count").exceptAll(whole.flows.select("entry", "node_count")).isEmpty() and again.flows.count() == 256



@pytest.mark.parametrize("hops", [0, 1, 2, 3])
def test_multi_hop_meets_in_the_middle(spark, monkeypatch, hops):
    rng = random.Random(hops)
    names = [f"v{i}" for i in range(14)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(16)] + [("hub", f"leaf{i}") for i in range(60)] + [("s", "hub")]
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    dist = lambda a, b: next((k for k in range(hops + 1) if b in within(a, k)), None)
    within = lambda a, k: {a} if k == 0 else (w := within(a, k - 1)) | {y for x in w for y in near[x]}
    tasks = [(f"t{a}", a, b) for a in names for b in rng.sample(names, 3)] + [("ts", "s", "leaf0"), ("ts", "s", "gone")]
    written, real = [], impact.keep
    monkeypatch.setattr(impact, "keep", lambda df, name: written.append(real(df, name)) or written[-1])
    g = graph(spark, names, [("CALLS", a, b) for a, b in pairs])
    got = {(r.task, r.expected): r.hop for r in impact.multi_hop(g, spark.createDataFrame(tasks, "task string, start string, expected string"), hops).collect()}
    assert got == {(t, b): dist(a, b) for t, a, b in tasks}
    if hops == 2:
        assert sum(df.filter("node like 'leaf%'").count() for df in written if "node" in df.columns) == 1



def test_betweenness_walks_numbers(spark, monkeypatch):
    stored, real = {}, centrality.keep
    monkeypatch.setattr(centrality, "keep", lambda df, name: stored.setdefault(name, df) and real(df, name))
    steps = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "src string, dst string")
    got = centrality.betweenness(steps, spark.createDataFrame([("a",)], "node string")).collect()
    assert [tuple(r) for r in got] == [("b", 1.0)]
    assert dict(stored["level"].dtypes)["v"] == dict(stored["shares"].dtypes)["v"] == "bigint"


def test_leiden_rounds_carry_numbers(spark, monkeypatch):
    names = [f"/m{i % 3}.py::f{i}" for i in range(24)]
    pairs = [(names[i], names[j]) for i in range(24) for j in range(i) if i // 6 == j // 6 or (i - j == 6 and i % 6 == 0)]
    seen = []
    evaluated = communities._evaluated
    monkeypatch.setattr(communities, "_evaluated", lambda e, state, pull: seen.append((e.dtypes, state.dtypes)) or evaluated(e, state, pull))
    e = communities.affinity_edges(graph(spark, names, [("CALLS", *p) for p in pairs]))
    of = {r.a: r.c for r in communities.leiden(e).collect()}
    assert seen and not any("string" in t for e_, s in seen for _, t in (*e_, *s))
    assert of == {q: min(names[i // 6 * 6 : i // 6 * 6 + 6]) for i, q in enumerate(names)}


def test_callers_of_a_block_hand_on_one_row_a_target():
    import pandas as pd

    words = [f"w{k}" for k in range(flows.LOT)]
    front = pd.DataFrame([(1, 0, 1 << k, *[0] * (flows.LOT - 1)) for k in range(1)] + [(i, 0, 1 << i, *[0] * (flows.LOT - 1)) for i in range(2, 40)], columns=["id", "lot", *words])
    calls = pd.DataFrame([(s, d, 0) for s in range(1, 60) for d in (7, 100, 100 + s)], columns=["s", "d", "block"])
    packed = flows._packed(calls)
    assert len(packed) == 1 and sorted(map(tuple, next(flows._unpacked(iter([packed]))).to_numpy())) == sorted(zip(calls["s"], calls["d"], strict=True))
    got = flows._handed_on(front, packed)
    every = sum(1 << i for i in range(2, 40)) | 1
    assert len(got) == 2 + 39 and {r.id: r.w0 for r in got.itertuples() if r.id <= 100} == {7: every, 100: every}
    assert flows._handed_on(front[:0], packed).empty and flows._handed_on(front, packed[:0]).empty


def test_flow_queries_spell_out_only_what_they_ask(spark):
    edges = [("CALLS", f"/m{i % 3}.py::e{i}", f"/p{i % 4}.py::p{i % 4}") for i in range(70)] + [("CALLS", f"/p{k}.py::p{k}", f"/p{k}.py::q{k}") for k in range(4)]
    g = graph(spark, sorted({x for e in edges for x in e[1:]}), edges)
    bare = flows.flow_tables(g, positions=False)
    assert dict(bare.memberships.reached.lots.dtypes)["id"] == "bigint" and "word" not in bare.memberships.reached.lots.columns
    plain = bare.with_(memberships=bare.memberships.select("flow_id", "entry", "qualified_name"))
    one = spark.createDataFrame([("/p1.py::q1",)], "qualified_name string")
    same = lambda a, b: a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and not a.isEmpty()
    assert same(flows.flows_of(bare, one), flows.flows_of(plain, one))
    assert same(flows.flow_counts(bare).select("qualified_name", "flows"), flows.flow_counts(plain).select("qualified_name", "flows"))


def test_registered_bridges_take_every_source_in_rounds(spark, monkeypatch):
    from lattica.catalog import QUERIES

    rng = random.Random(3)
    names = [f"/m{i % 4}.py::f{i}" for i in range(130)]
    edges = [("CALLS", rng.choice(names), rng.choice(names)) for _ in range(150)]
    g = graph(spark, names, edges)
    ends = sorted({x for _, a, b in edges for x in (a, b)})
    assert len(ends) > 100
    monkeypatch.setattr("lattica.catalog.graph", lambda spark, sf_dir: g)
    monkeypatch.setattr(centrality, "ROUND_ROWS", len(ends) * 40)
    rounds, real = [], centrality._shares
    monkeypatch.setattr(centrality, "_shares", lambda steps, starts: rounds.append(starts.count()) or real(steps, starts))
    want = sorted(((-round(v, 12), k) for k, v in plain_betweenness([e[1:] for e in edges], ends, ends).items()))[:10]
    got = QUERIES["bridge_nodes"](spark, "").collect()
    assert [r.qualified_name for r in got] == [k for _, k in want] and [r.betweenness for r in got] == pytest.approx([-v for v, _ in want], abs=1e-11)
    assert len(rounds) > 1 and sum(rounds) == len({a for _, a, b in edges if a != b})
