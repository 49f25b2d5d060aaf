"""A store of graph tables in buckets, with a log of commits.

A table is rows in a fixed number of buckets by a hash of its key: nodes and
edges by file, flows by flow, vectors by name, postings by term.  A commit is one small file in
the log that says which folder holds each bucket it changed; everything else
stays where it was, so what a commit writes grows with what it changes.  The
file's name is the commit's number; it is written aside and renamed to that
name only if there is none, as streaming checkpoints are, so of two writers that began at one version the second fails and starts again.
Readers fold the log from its last entry that names all and see one version
throughout.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica import schemas
from lattica.graph import Graph

#: What the rows of a table are dealt by.
KEYS = {"nodes": "file_path", "edges": "file_path", "flows": "flow_id", "memberships": "flow_id", "communities": "qualified_name", "vectors": "qualified_name", "metadata": "key", "queue": "file_path", "postings": "term", "lengths": "file_path"}
#: Every so many commits, one that names all buckets.
WHOLE_EVERY = 16


class Conflict(RuntimeError):
    """Another writer has committed since the version that a change began at."""


@dataclass(frozen=True)
class Version:
    """What a commit made of the store: for each table the folder of each bucket that holds rows."""

    number: int = -1
    buckets: int = 64
    tables: Mapping[str, Mapping[int, str]] = field(default_factory=dict)
    columns: Mapping[str, str] = field(default_factory=dict)


class GraphStore:
    """Versions of graph tables below ``root``; ``buckets`` counts for a new store only."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self._new = spark, root.rstrip("/"), buckets

    # -- files of the log, through the file system that the root lies on --------------------------
    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _numbers(self) -> list[int]:
        fs, p = self._fs("log")
        if not fs.exists(p):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(p))
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def _entry(self, number: int) -> dict:
        fs, p = self._fs(f"log/{number:012d}.json")
        stream = fs.open(p)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def version(self) -> int | None:
        """The number of the newest commit."""
        at = self.state().number
        return None if at < 0 else at

    def state(self, number: int | None = None) -> Version:
        """The version of that number, or the newest one."""
        entries: list[dict] = []
        last = -1
        for n in reversed([n for n in self._numbers() if number is None or n <= number]):
            last = max(last, n)
            entries.append(self._entry(n))
            if entries[-1]["whole"]:
                break
        tables: dict[str, dict[int, str]] = {}
        columns: dict[str, str] = {}
        buckets = self._new
        for e in reversed(entries):
            buckets = e["buckets"]
            columns |= e["columns"]
            for name, moved in e["tables"].items():
                at = tables.setdefault(name, {})
                for b, path in moved.items():
                    if path is None:
                        at.pop(int(b), None)
                    else:
                        at[int(b)] = path
        return Version(last, buckets, tables, columns)

    # -- reading ------------------------------------------------------------------------------------
    def table(self, name: str, at: Version | None = None, buckets: Iterable[int] | None = None) -> DataFrame | None:
        """A table's rows, of the given buckets only if any are given; None if the store has no such table."""
        at = at or self.state()
        if name not in at.columns:
            return None
        held = at.tables.get(name, {})
        wanted = sorted(held if buckets is None else set(buckets) & set(held))
        if not wanted:
            return self.spark.createDataFrame([], at.columns[name])
        return self.spark.read.schema(at.columns[name]).parquet(*(f"{self.root}/{held[b]}" for b in wanted))

    def read(self, version: int | None = None) -> Graph:
        """The graph of a version, with flows and communities where they are stored."""
        at = self.state(version)
        g = lambda name, schema=None: self.table(name, at) if name in at.columns else self.spark.createDataFrame([], schema) if schema else None
        return Graph(g("nodes", schemas.NODES), g("edges", schemas.EDGES), g("communities"), g("flows"), g("memberships"))

    # -- writing ------------------------------------------------------------------------------------
    def bucket(self, name: str, at: Version, key: str | None = None) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(F.col(key or KEYS[name]).cast("string"), F.lit(""))), F.lit(at.buckets)).cast("int")

    def buckets_of(self, name: str, at: Version, keys: DataFrame) -> set[int]:
        """The buckets that the keys lie in; at most as many as the store has."""
        return {r["b"] for r in keys.select(self.bucket(name, at).alias("b")).distinct().collect()}

    def stage(self, name: str, at: Version, rows: DataFrame) -> dict[int, str]:
        """Write rows, a folder for each bucket; nobody sees them before a commit names them."""
        folder = f"data/{name}/{uuid.uuid4().hex}"
        dealt = rows.withColumn("_bucket", self.bucket(name, at))
        # one file's rows may be most of a table: adaptive execution splits such a bucket among tasks
        dealt.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        fs, p = self._fs(folder)
        names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
        return {int(n.split("=")[1]): f"{folder}/{n}" for n in names if n.startswith("_bucket=")}

    def replaced(self, name: str, at: Version, keys: DataFrame | None, new: DataFrame | None, on: str | None = None) -> tuple[dict[int, str | None], str]:
        """Buckets in which the rows of ``keys`` give way to ``new``, staged; no other bucket is read or written.

        Without ``keys`` the whole table gives way.
        """
        on = on or KEYS[name]
        if keys is None:
            moved: dict[int, str | None] = dict.fromkeys(at.tables.get(name, {}))
            return moved | self.stage(name, at, new), new.schema.toDDL()
        touched = self.buckets_of(name, at, keys)
        if new is not None:
            touched |= self.buckets_of(name, at, new)
        old = self.table(name, at, touched)
        if old is None:
            rows = new
        else:
            left = old.join(keys.select(on).distinct(), on, "left_anti").select(*old.columns)
            rows = left if new is None else left.unionByName(new, allowMissingColumns=True)
        if rows is None:
            return {}, ""
        return dict.fromkeys(touched) | self.stage(name, at, rows), rows.schema.toDDL()

    def commit(self, at: Version, changes: Mapping[str, tuple[Mapping[int, str | None], str]]) -> Version:
        """Name staged buckets as the version after ``at``; raises ``Conflict`` if that number is taken."""
        number = at.number + 1
        tables = {k: dict(v) for k, v in at.tables.items()}
        columns = dict(at.columns)
        for name, (moved, ddl) in changes.items():
            for b, path in moved.items():
                tables.setdefault(name, {})[b] = path
            if ddl:
                columns[name] = ddl
        tables = {k: {b: p for b, p in v.items() if p is not None} for k, v in tables.items()}
        whole = number % WHOLE_EVERY == 0
        said = tables if whole else {k: dict(moved) for k, (moved, _) in changes.items()}
        entry = {"whole": whole, "buckets": at.buckets, "columns": columns, "tables": {k: {str(b): p for b, p in v.items()} for k, v in said.items()}}
        fs, draft = self._fs(f"log/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        _, final = self._fs(f"log/{number:012d}.json")
        sc = self.spark.sparkContext
        files = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), sc._jsc.hadoopConfiguration())
        plain = sc._gateway.new_array(getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # never over a file that is there
        try:
            files.rename(draft, final, plain)
        except Exception as e:  # py4j wraps what the file system throws
            fs.delete(draft, False)
            if fs.exists(final):
                raise Conflict(f"version {number} is taken") from e
            raise
        return Version(number, at.buckets, tables, columns)

    def update(self, change: Callable[[Version], Mapping[str, tuple[Mapping[int, str | None], str]]], attempts: int = 5) -> Version:
        """Commit what ``change`` makes of the newest version, anew if another writer came first."""
        for left in reversed(range(attempts)):
            at = self.state()
            try:
                return self.commit(at, change(at))
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def write(self, g: Graph, **more: DataFrame) -> int:
        """All tables of ``g`` in place of what is stored; a version written meanwhile by another raises ``Conflict``."""
        at = self.state()
        given = {n: getattr(g, n) for n in ("nodes", "edges", "communities", "flows", "memberships") if getattr(g, n) is not None} | more
        return self.commit(at, {n: self.replaced(n, at, None, rows) for n, rows in given.items()}).number

    def put(self, **values: str) -> Version:
        """Set metadata; other keys stay."""
        rows = self.spark.createDataFrame(sorted(values.items()), "key string, value string")
        return self.update(lambda at: {"metadata": self.replaced("metadata", at, rows, rows)})

    def get(self, key: str) -> str | None:
        rows = self.table("metadata")
        found = rows.filter(F.col("key") == key).first() if rows is not None else None
        return found["value"] if found else None

    def vacuum(self, keep: int = 1) -> int:
        """Delete folders that none of the last ``keep`` versions names; returns how many went."""
        numbers = self._numbers()
        kept = numbers[-max(1, keep) :]
        named = {p for n in kept for v in self.state(n).tables.values() for p in v.values()}
        gone = 0
        for name in KEYS:
            fs, p = self._fs(f"data/{name}")
            for run in fs.listStatus(p) if fs.exists(p) else ():
                for b in fs.listStatus(run.getPath()):
                    path = f"data/{name}/{run.getPath().getName()}/{b.getPath().getName()}"
                    if b.isDirectory() and path not in named:
                        fs.delete(b.getPath(), True)
                        gone += 1
        return gone
