"""Execution flows: entry points, traces, criticality, and their upkeep."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica import schemas
from lattica.functions import text as X
from lattica.graph import Graph
from lattica.operators import patterns
from lattica.plans.materialise import keep


def entry_points(g: Graph, include_tests: bool = False) -> DataFrame:
    """Functions and tests that nothing but files calls, or whose decorator or name says so."""
    n = g.nodes.filter(F.col("kind").isin("Function", "Test") & ~X.is_hdl(F.col("extra")))
    if not include_tests:
        n = n.filter(~(F.col("is_test") | X.is_test_file(F.col("file_path"))))
    called = patterns.call_targets(g, include_file_sources=False).withColumn("_called", F.lit(True))
    n = n.join(called, "qualified_name", "left")
    named = X.is_entry_decorator(F.col("extra")) | X.is_entry_name(F.col("name"), F.col("language"))
    return n.filter(F.col("_called").isNull() | named).select("qualified_name", "name", "kind", "file_path")


def _set_bits() -> Column:
    return F.expr("filter(sequence(0, 63), i -> (shiftright(bits, i) & 1L) = 1L)")


#: Entries travel in lots of so many words of 64 bits; callers are dealt out in blocks of this power of two, and a block looks at so many calls at a time.
LOT, BLOCK_BITS, CHUNK = 8, 14, 1 << 18
_WORDS = tuple(f"w{k}" for k in range(LOT))


def _calls(g: Graph) -> DataFrame:
    """(s, d, known) of every call, names as hashes of 64 bits; known: the target is a node."""
    known = g.nodes.select(F.xxhash64("qualified_name").alias("d")).distinct().withColumn("known", F.lit(True))
    calls = g.edges.filter(F.col("kind") == "CALLS").select(F.xxhash64("source_qualified").alias("s"), F.xxhash64("target_qualified").alias("d"))
    return calls.join(known, "d", "left").select("s", "d", F.coalesce("known", F.lit(False)).alias("known"))


def _apart(rows: DataFrame) -> DataFrame:
    """Rows of a lot as rows (..., word, bits) of its words that have a bit."""
    each = F.explode(F.array(*(F.struct((F.col("lot") * LOT + k).alias("word"), F.col(w).alias("bits")) for k, w in enumerate(_WORDS))))
    return rows.select(*(c for c in rows.columns if c not in ("lot", *_WORDS)), each.alias("_w")).select("*", "_w.word", "_w.bits").drop("_w").filter("bits <> 0")


@dataclass(frozen=True)
class Reach:
    """What entries reach, 64 of them to a word and eight words to a row.

    ``entries`` is (entry, word, bit), ``numbers`` (qualified_name, h, id) of
    nodes, ``calls`` what ``_calls`` gives and ``packed`` those between nodes,
    by numbers.  ``lots`` is (id, lot, w0 to w7, hop): the
    entries of the lot that first come to the node with that many calls.  A
    node that all entries reach is a row per lot, not one per entry.
    """

    entries: DataFrame
    numbers: DataFrame
    calls: DataFrame
    packed: DataFrame
    lots: DataFrame
    depth: int

    @property
    def steps(self) -> DataFrame:
        """(s, d) of calls between nodes, by numbers."""
        return self.packed.mapInPandas(_unpacked, "s long, d long")

    @property
    def rows(self) -> DataFrame:
        """(qualified_name, word, bits, hop)."""
        return self.named(_apart(self.lots)).select("qualified_name", "word", "bits", "hop")

    def named(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the names of their numbers."""
        return rows.join(self.numbers.select("id", "qualified_name"), "id")

    def several(self) -> DataFrame:
        """(id, word, bits, hop) without the entries that reach no other node."""
        more = self.lots.filter("hop > 0").groupBy("lot").agg(*(F.bit_or(w).alias(f"_{w}") for w in _WORDS))
        both = self.lots.join(more, "lot").select("id", "lot", *(F.col(w).bitwiseAND(F.col(f"_{w}")).alias(w) for w in _WORDS), "hop")
        return _apart(both)

    def single(self, rows: DataFrame) -> DataFrame:
        """``rows`` (word, bits, ...) with a row per entry: what travels for that are the names of a word, not the entries' rows."""
        each = F.explode(F.expr("filter(transform(sequence(0, 63), i -> if((shiftright(bits, i) & 1L) = 1L, _of[i], null)), x -> x is not null)"))
        return rows.join(_by_bit(self.entries, "entry"), "word").select(*(c for c in rows.columns if c not in ("word", "bits")), each.alias("entry"))

    def flows(self) -> DataFrame:
        """(entry, qualified_name, hop) of entries that reach another node."""
        return self.single(self.named(self.several())).select("entry", "qualified_name", "hop")

    def of(self, names: DataFrame) -> DataFrame:
        """(entry, qualified_name) of the flows of some nodes (qualified_name); no other node's entries are told apart."""
        ids = self.numbers.join(names.select("qualified_name").distinct(), "qualified_name", "left_semi").select("id")
        return self.single(self.named(self.several().join(ids, "id", "left_semi"))).select("entry", "qualified_name")

    def entries_at(self, names: DataFrame) -> DataFrame:
        """(entry) of the flows of some nodes (qualified_name), each once."""
        ids = self.numbers.join(names.select("qualified_name").distinct(), "qualified_name", "left_semi").select("id")
        met = self.several().join(ids, "id", "left_semi").groupBy("word").agg(F.bit_or("bits").alias("bits"))
        return self.single(met).select("entry")

    def only(self, entries: DataFrame) -> Reach:
        """What a few of the entries (entry) reach, by the same numbers."""
        kept = keep(self.entries.join(entries.select("entry").distinct(), "entry", "left_semi"), "entries")
        mask = kept.groupBy((F.col("word") - F.pmod("word", F.lit(LOT))).alias("_first")).agg(*(_bits_of("word", k).alias(f"_{w}") for k, w in enumerate(_WORDS)))
        mask = mask.select((F.col("_first") / LOT).cast("long").alias("lot"), *(f"_{w}" for w in _WORDS))
        rows = self.lots.join(mask, "lot").select("id", "lot", *(F.col(w).bitwiseAND(F.col(f"_{w}")).alias(w) for w in _WORDS), "hop")
        return Reach(kept, self.numbers, self.calls, self.packed, keep(rows.filter(_any()), "hop"), self.depth)


def _by_bit(entries: DataFrame, value: str) -> DataFrame:
    """(word, _of): the 64 values of a word's entries, null where there is none."""
    of = entries.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("bit", value))).alias("_of"))
    return of.select("word", F.expr("transform(sequence(0, 63), i -> _of[i])").alias("_of"))


def _bits_of(word: str, k: int) -> Column:
    """The bits (column ``bit``) of the k-th word of a lot."""
    return F.bit_or(F.when(F.pmod(word, F.lit(LOT)) == k, F.expr("shiftleft(1L, bit)")).otherwise(F.lit(0).cast("long")))


def _any() -> Column:
    return functools.reduce(Column.__or__, (F.col(w) != 0 for w in _WORDS))


#: How often the way along least callees is doubled, and that of the groups this gives.
NEAR_DOUBLED, GROUPS_DOUBLED = 3, 2


def _near(steps: DataFrame) -> DataFrame:
    """(s, near): a mark that callers in one part of the graph mostly share.

    It only tells which nodes to put side by side, so two calls of a caller
    will do: its least callee's least callee and so on leads into one of few
    rounds of calls, named by their least member; these groups join where a
    greatest callee leads from one into another.
    """
    ends = keep(steps.groupBy("s").agg(F.min("d").alias("to"), F.max("d").alias("far")), "near")
    way = ends.select("s", "to", F.col("to").alias("low"))
    ahead = lambda rows: rows.select(F.col("s").alias("to"), F.col("to").alias("_to"), F.col("low").alias("_low"))
    for _ in range(NEAR_DOUBLED):
        way = keep(way.join(ahead(way), "to", "left").select("s", F.coalesce("_to", "to").alias("to"), F.least("low", "_low").alias("low")), "near")
    group = keep(way.join(ahead(way), "to", "left").select("s", F.coalesce("_low", "to").alias("group")), "near")
    pairs = group.join(ends.select("s", "far"), "s").join(group.select(F.col("s").alias("far"), F.col("group").alias("_group")), "far").select("group", "_group").distinct()
    both = pairs.union(pairs.select("_group", "group"))
    root = keep(both.groupBy("group").agg(F.min("_group").alias("_root")).select("group", F.least("group", "_root").alias("root")), "near")
    for _ in range(GROUPS_DOUBLED):
        root = keep(root.join(root.select(F.col("group").alias("root"), F.col("root").alias("_root")), "root", "left").select("group", F.coalesce("_root", "root").alias("root")), "near")
    return group.join(root, "group", "left").select("s", F.coalesce("root", "group").alias("near"))


def _packed(steps: pd.DataFrame) -> pd.DataFrame:
    """A block's calls in the order of their targets, some to a row."""
    steps = steps.sort_values("d", kind="stable")
    cuts = [steps[i : i + CHUNK] for i in range(0, len(steps), CHUNK)]
    return pd.DataFrame({"block": [steps["block"].iloc[0]] * len(cuts), "s": [c["s"].to_numpy().tobytes() for c in cuts], "d": [c["d"].to_numpy().tobytes() for c in cuts]})


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for s, d in zip(batch["s"], batch["d"], strict=True):
            yield pd.DataFrame({"s": np.frombuffer(s, "int64"), "d": np.frombuffer(d, "int64")})


def _handed_on(front: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
    """What callers of one block hand on to those they call, the bits that meet there or-ed."""
    out = []
    lots = [(lot, rows.sort_values("id")) for lot, rows in front.groupby("lot", sort=False)]
    for calls in _unpacked(iter([steps])):
        s, d = calls["s"].to_numpy(), calls["d"].to_numpy()
        for lot, rows in lots:
            ids, bits = rows["id"].to_numpy(), rows[list(_WORDS)].to_numpy()
            at = np.minimum(np.searchsorted(ids, s), len(ids) - 1)
            hit = np.flatnonzero(ids[at] == s)
            if len(hit):
                to, first = np.unique(d[hit], return_index=True)
                out.append(pd.DataFrame(np.bitwise_or.reduceat(bits[at[hit]], first, axis=0), columns=_WORDS).assign(id=to, lot=lot))
    return pd.concat(out)[["id", "lot", *_WORDS]] if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("id", "lot", *_WORDS)})


def reach(g: Graph, entries: DataFrame, depth: int = schemas.MAX_FLOW_DEPTH) -> Reach:
    """Breadth first from all entries at once: in a hop the nodes just reached hand on their bits along their calls.

    Bits that a node already has are masked out, so a hop carries and writes
    what is new only.  Nodes are numbered, and entries put into words, in an
    order that has those side by side that reach the same ones.  So a node
    meets few words, and a block of callers, which ors what it hands on before
    anything is shuffled, mostly calls the same nodes.
    """
    calls = keep(_calls(g), "calls")
    known = calls.filter("known").select("s", "d")
    names = g.nodes.select("qualified_name").distinct().withColumn("h", F.xxhash64("qualified_name"))
    ordered = names.join(_near(known), F.col("h") == F.col("s"), "left").orderBy(F.asc_nulls_last("near"), "h")
    numbers = keep(ordered.select("qualified_name", "h", F.monotonically_increasing_id().alias("id")), "numbers")
    of = lambda end, id_: numbers.select(F.col("h").alias(end), F.col("id").alias(id_))
    ends = known.join(of("s", "_s"), "s").join(of("d", "_d"), "d").select(F.col("_s").alias("s"), F.col("_d").alias("d"))
    steps = keep(ends.withColumn("block", F.shiftright("s", BLOCK_BITS)).groupBy("block").applyInPandas(_packed, "block long, s binary, d binary"), "steps")
    start = numbers.join(entries.select("qualified_name").distinct(), "qualified_name").select("id", F.col("qualified_name").alias("entry"))
    numbered = keep(start.orderBy("id").withColumn("_at", F.monotonically_increasing_id()).selectExpr("entry", "id", "_at div 64 AS word", "cast(_at % 64 AS int) AS bit"), "entries")
    words = [_bits_of("word", k).alias(w) for k, w in enumerate(_WORDS)]
    front = lots = keep(numbered.groupBy("id", F.expr(f"word div {LOT}").alias("lot")).agg(*words).withColumn("hop", F.lit(0)), "hop")
    schema = ", ".join(f"{c} long" for c in ("id", "lot", *_WORDS))
    for hop in range(1, depth + 1):
        dealt = front.drop("hop").withColumn("block", F.shiftright("id", BLOCK_BITS)).groupBy("block")
        found = dealt.cogroup(steps.groupBy("block")).applyInPandas(_handed_on, schema)
        none = F.lit(0).cast("long")
        both = found.select("id", "lot", *_WORDS, *(none.alias(f"_{w}") for w in _WORDS)).union(lots.select("id", "lot", *(none for _ in _WORDS), *_WORDS))
        met = both.groupBy("id", "lot").agg(*(F.bit_or(c).alias(c) for w in _WORDS for c in (w, f"_{w}")))
        new = met.select("id", "lot", *(F.col(w).bitwiseAND(F.bitwise_not(F.col(f"_{w}"))).alias(w) for w in _WORDS)).filter(_any())
        front = keep(new.withColumn("hop", F.lit(hop)), "hop")
        if front.isEmpty():
            break
        lots = lots.union(front)
    return Reach(numbered.drop("id"), numbers, calls, steps, lots, depth)


def placed(g: Graph, reached: Reach) -> DataFrame:
    """Flow members (entry, qualified_name, hop, position): by hop, then the least position of a caller, then name.

    Names are numbered in their order first.  Calls that lead some entry from a
    hop to the next are found for 64 entries at a time; only these meet the
    positions of single entries, so a call back costs an entry nothing.
    """
    several = keep(reached.several(), "several")
    names = keep(reached.named(several.select("id").distinct()).orderBy("qualified_name").withColumn("at", F.monotonically_increasing_id()), "names")
    number = lambda end, id_: names.select(F.col("id").alias(end), F.col("at").alias(id_))
    steps = reached.steps.join(number("s", "_s"), "s").join(number("d", "_d"), "d").select(F.col("_s").alias("s"), F.col("_d").alias("d"))
    rows = keep(several.join(number("id", "at"), "id").select(F.col("at").alias("id"), "word", "bits", "hop"), "numbers")
    to = rows.select(F.col("id").alias("d"), "word", F.col("bits").alias("_to"), "hop")
    from_ = rows.select(F.col("id").alias("s"), "word", "bits", (F.col("hop") + 1).alias("hop"))
    both = F.col("bits").bitwiseAND(F.col("_to"))
    links = keep(from_.join(steps, "s").join(to, ["d", "word", "hop"]).select("s", "d", "word", both.alias("bits"), "hop").filter("bits <> 0"), "links")
    single = rows.withColumn("bit", F.explode(_set_bits()))
    sizes = single.groupBy("word", "bit", "hop").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("word", "bit").orderBy("hop").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = keep(sizes.select("word", "bit", "hop", before.alias("_before")), "offsets")
    front = keep(single.filter("hop = 0").select("word", "bit", F.col("id").alias("s"), "hop", F.lit(0).cast("long").alias("position")), "placed")
    out = front
    for hop in range(1, (rows.agg(F.max("hop")).first()[0] or 0) + 1):
        here = links.filter(F.col("hop") == hop).drop("hop")
        called = front.drop("hop").join(here, ["s", "word"]).filter("(shiftright(bits, bit) & 1L) = 1L").groupBy("word", "bit", "d").agg(F.min("position").alias("_from"))
        order = F.row_number().over(W.partitionBy("word", "bit").orderBy("_from", "d")) - 1
        ranked = called.withColumn("_at", order).join(offsets.filter(F.col("hop") == hop), ["word", "bit"])
        front = keep(ranked.select("word", "bit", F.col("d").alias("s"), "hop", (F.col("_before") + F.col("_at")).alias("position")), "placed")
        out = out.union(front)
    return out.join(reached.entries, ["word", "bit"]).join(names.select(F.col("at").alias("s"), "qualified_name"), "s").select("entry", "qualified_name", "hop", "position")


def trace(g: Graph, entries: DataFrame, depth: int = schemas.MAX_FLOW_DEPTH) -> DataFrame:
    """(entry, qualified_name, hop, position) of flows of two nodes or more: a node comes by its least number of calls."""
    return placed(g, reach(g, entries, depth))


def criticality(g: Graph, reached: Reach) -> DataFrame:
    """(entry, node_count, file_count, depth, criticality) of every traced flow, the score unrounded.

    Facts of nodes join the rows of 64 entries; single entries meet only sums.
    """
    external = reached.calls.filter("not known").groupBy(F.col("s").alias("h")).agg(F.count(F.lit(1)).alias("_ext"))
    tested = g.edges.filter(F.col("kind") == "TESTED_BY").select(F.xxhash64("source_qualified").alias("h")).distinct().withColumn("_tested", F.lit(1))
    nodes = g.nodes.select(F.xxhash64("qualified_name").alias("h"), "file_path", X.is_security_name(F.col("name"), F.col("qualified_name")).cast("int").alias("_sec"))
    nodes = reached.numbers.select("h", "id").join(nodes, "h").join(external, "h", "left").join(tested, "h", "left").na.fill(0, ["_ext", "_tested"])
    rows = reached.lots.join(nodes.select("id", "file_path", "_ext", "_sec", "_tested"), "id")
    # By blocks of neighbours, so that a task sees few entries and its sums are few.
    rows = _apart(keep(rows.repartition(F.shiftright("id", BLOCK_BITS)), "facts"))
    facts = rows.withColumn("bit", F.explode(_set_bits()))
    f = facts.groupBy("word", "bit").agg(F.count(F.lit(1)).alias("node_count"), F.max("hop").alias("depth"), *(F.sum(c).alias(c) for c in ("_ext", "_sec", "_tested")))
    files = rows.groupBy("word", "file_path").agg(F.bit_or("bits").alias("bits")).withColumn("bit", F.explode(_set_bits())).groupBy("word", "bit").agg(F.count(F.lit(1)).alias("file_count"))
    f = f.filter("node_count > 1").join(files, ["word", "bit"]).join(reached.entries, ["word", "bit"])
    one = F.lit(1.0)
    score = (
        F.least((F.col("file_count") - 1) / 4.0, one) * 0.30
        + F.least(F.col("_ext") / 5.0, one) * 0.20
        + F.least(F.col("_sec") / F.col("node_count"), one) * 0.25
        + (1.0 - F.col("_tested") / F.col("node_count")) * 0.15
        + F.least(F.col("depth") / 10.0, one) * 0.10
    )
    return f.select("entry", "node_count", "file_count", "depth", F.least(F.greatest(score, F.lit(0.0)), one).alias("criticality"))


def flow_tables(g: Graph, entries: DataFrame | None = None, depth: int = schemas.MAX_FLOW_DEPTH, positions: bool = True) -> Graph:
    """The graph with ``flows`` (flow_id by entry name) and ``memberships``; positions, which need every entry's own order, only where asked."""
    reached = reach(g, entry_points(g) if entries is None else entries, depth)
    flows = keep(criticality(g, reached).withColumn("flow_id", F.xxhash64("entry")), "flows")
    # The stored rows of many entries are far fewer than memberships, so a query spells out what it asks for.
    rows = placed(g, reached) if positions else reached.flows().withColumn("position", F.lit(None).cast("long"))
    members = rows.select(F.xxhash64("entry").alias("flow_id"), "entry", "qualified_name", "position")
    members.reached = reached
    return g.with_(flows=flows, memberships=members)


def _reached(g: Graph) -> Reach | None:
    """What the graph's memberships are spelt out from, where they come from a trace as it is."""
    return getattr(g.memberships, "reached", None)


def flows_of(g: Graph, names: DataFrame) -> DataFrame:
    """(flow_id, entry, qualified_name) of the flows of some nodes (qualified_name)."""
    if (reached := _reached(g)) is not None:
        return reached.of(names).select(F.xxhash64("entry").alias("flow_id"), "entry", "qualified_name")
    return g.memberships.select("flow_id", "qualified_name").join(names.select("qualified_name").distinct(), "qualified_name", "left_semi").join(g.flows.select("flow_id", "entry"), "flow_id").select("flow_id", "entry", "qualified_name").distinct()


def members_of(g: Graph, flows: DataFrame) -> DataFrame:
    """(flow_id, qualified_name) of the members of a few flows (flow_id, entry)."""
    if (reached := _reached(g)) is not None:
        return reached.only(flows.select("entry")).flows().select(F.xxhash64("entry").alias("flow_id"), "qualified_name")
    return g.memberships.join(flows.select("flow_id"), "flow_id", "left_semi").select("flow_id", "qualified_name").distinct()


def affected_flows(g: Graph, files: DataFrame) -> DataFrame:
    """Flows with a node in the files, most critical first."""
    touched = g.nodes.join(files.select("file_path").distinct(), "file_path", "left_semi").select("qualified_name")
    if (reached := _reached(g)) is not None:
        hit = reached.entries_at(touched).select(F.xxhash64("entry").alias("flow_id"))
    else:
        hit = g.memberships.join(touched, "qualified_name", "left_semi").select("flow_id").distinct()
    return g.flows.join(hit, "flow_id", "left_semi").orderBy(F.desc("criticality"), "entry")


SORTS = {"criticality": F.desc, "depth": F.desc, "node_count": F.desc, "file_count": F.desc, "entry": F.asc}


def list_flows(g: Graph, sort_by: str = "criticality", limit: int = 50) -> DataFrame:
    by = sort_by if sort_by in SORTS else "criticality"
    return g.flows.orderBy(SORTS[by](by), "entry").limit(limit)


def get_flow(g: Graph, name: str, positions: bool = True, depth: int = schemas.MAX_FLOW_DEPTH) -> DataFrame:
    """The steps of the most critical flow whose entry holds the name; that one flow is put in order where memberships come without ``positions``."""
    hit = g.flows.filter(F.col("entry").ilike(f"%{name}%")).orderBy(F.desc("criticality"), "entry").limit(1)
    if positions:
        steps = g.memberships.join(F.broadcast(hit.select("flow_id")), "flow_id", "left_semi")
    elif (reached := _reached(g)) is not None and reached.depth == depth:
        steps = placed(g, reached.only(hit.select("entry")))
    else:
        steps = trace(g, hit.select(F.col("entry").alias("qualified_name")), depth)
    return steps.join(g.nodes.select("qualified_name", "name", "kind", "file_path", "line_start"), "qualified_name").select("position", "qualified_name", "name", "kind", "file_path", "line_start")


def incremental_flows(g: Graph, files: DataFrame, depth: int = schemas.MAX_FLOW_DEPTH, positions: bool = True) -> Graph:
    """Flows after a change of files: those that touch them are traced anew, with positions or, as the rest, without; the rest stay."""
    gone = affected_flows(g, files).select("flow_id", "entry")
    entries = entry_points(g)
    inside = entries.join(files.select("file_path").distinct(), "file_path", "left_semi").select("qualified_name")
    again = entries.join(inside.union(gone.select(F.col("entry").alias("qualified_name"))).distinct(), "qualified_name", "left_semi")
    redone = flow_tables(g, again, depth, positions)
    old = g.flows.join(gone, "flow_id", "left_anti").join(redone.flows.select("flow_id"), "flow_id", "left_anti")
    keep = old.select("flow_id")
    return g.with_(flows=old.unionByName(redone.flows), memberships=g.memberships.join(keep, "flow_id", "left_semi").unionByName(redone.memberships))


def flow_counts(g: Graph) -> DataFrame:
    """(qualified_name, flows, criticality): memberships of nodes and the sum of their flows' criticality."""
    if (reached := _reached(g)) is None:
        return g.memberships.join(g.flows.select("flow_id", "criticality"), "flow_id").groupBy("qualified_name").agg(F.count(F.lit(1)).alias("flows"), F.sum("criticality").alias("criticality"))
    # A word's 64 values meet its rows, so that no membership is a row.
    values = reached.entries.join(g.flows.select("entry", "criticality"), "entry")
    hit = reached.several().join(_by_bit(values, "criticality"), "word").withColumn("_hit", F.expr("filter(transform(sequence(0, 63), i -> if((shiftright(bits, i) & 1L) = 1L, _of[i], null)), x -> x is not null)"))
    sums = hit.groupBy("id").agg(F.sum(F.size("_hit")).alias("flows"), F.sum(F.expr("aggregate(_hit, 0D, (a, x) -> a + x)")).alias("criticality"))
    return reached.named(sums).filter("flows > 0").select("qualified_name", "flows", "criticality")


def flow_snapshots(g: Graph) -> DataFrame:
    """Entry, up to three steps between, and the last step of every flow."""
    # Only numbers are grouped to find the last step; a window would sort all names.
    last = g.memberships.groupBy("flow_id").agg(F.max("position").alias("_last"))
    kept = g.memberships.join(last, "flow_id").filter((F.col("position") <= 3) | (F.col("position") == F.col("_last")))
    return kept.groupBy("entry").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "qualified_name"))), lambda s: s["qualified_name"]).alias("critical_path"))
