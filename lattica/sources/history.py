"""What versions of a repository say: changed paths, how fresh a graph is, the list of repositories, the savings log."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Status letters whose record names two paths, the old one and the new one.
TWO_PATHS = ("R", "C")
_RECORD = rf"(?s)[{''.join(TWO_PATHS)}]\d*\x00[^\x00]*\x00[^\x00]*\x00|[A-Z]\d*\x00[^\x00]*\x00"
#: Fixed value: the characters of a reference that git is asked about.
SAFE_REF = r"^[A-Za-z0-9_.~^/@{}\-]+$"


def name_status_paths(raw: Column) -> Column:
    """Paths of NUL-separated name-status output in their order, each once; a rename gives both of its paths. Null gives none."""
    records = F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(_RECORD), F.lit(0))
    paths = F.flatten(F.transform(records, lambda r: F.slice(F.split(r, "\x00"), 2, 2)))
    return F.array_distinct(F.filter(paths, lambda p: p != ""))


def parse_name_status(outputs: DataFrame, column: str) -> DataFrame:
    """The columns of ``outputs`` but ``column``, and (position, file_path) for each path that it names."""
    rest = [c for c in outputs.columns if c != column]
    return outputs.select(*rest, F.posexplode(name_status_paths(F.col(column))).alias("position", "file_path"))


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", *args], cwd=root, capture_output=True, check=True, timeout=120, stdin=subprocess.DEVNULL).stdout.decode("utf-8", "surrogateescape")


def _safe(ref: str) -> str:
    if ref.startswith("-") or not re.fullmatch(SAFE_REF, ref):
        raise ValueError(f"not a git reference: {ref!r}")
    return ref


def changed_files(spark: SparkSession, root: str, base: str = "HEAD~1") -> DataFrame:
    """(position, file_path): paths of a working copy that differ from ``base``.

    The driver asks git once; a list of paths is bounded by the checkout. A
    reference that git would take for an option raises, as a failing git does.
    """
    raw = _git(root, "diff", "--name-status", "-z", _safe(base), "--")
    return parse_name_status(spark.createDataFrame([(raw,)], "raw string"), "raw")


def tracked_files(spark: SparkSession, root: str, submodules: bool = False) -> DataFrame:
    """(file_path): paths below ``root`` that git tracks; no rows outside a checkout."""
    args = ["git", "ls-files", "-z", *(["--recurse-submodules"] if submodules else [])]
    found = subprocess.run(args, cwd=root, capture_output=True, timeout=120, stdin=subprocess.DEVNULL)
    raw = found.stdout.decode("utf-8", "replace") if found.returncode == 0 else ""
    paths = spark.createDataFrame([(raw,)], "raw string").select(F.explode(F.split("raw", "\x00")).alias("file_path"))
    return paths.filter("file_path <> ''")


def build_relation(built: Column, head: Column, base: Column) -> Column:
    """Where the commit of a build stands to the one checked out, by their merge base; unknown if they share none."""
    return F.when(built == head, "same").when(base.isNull(), "unknown").when(base == built, "ancestor").when(base == head, "descendant").otherwise("diverged")


def freshness(metadata: DataFrame, heads: DataFrame) -> DataFrame:
    """One row per repository with metadata (repo, key, value): when, on what and how far from its head it was built.

    ``heads`` holds (repo, head_sha, merge_base, now). Columns without a value
    are null; an age is never below 0; a time that is none leaves the age null.
    """
    pick = lambda k: F.max(F.when((F.col("key") == k) & (F.col("value") != ""), F.col("value")))
    built = metadata.groupBy("repo").agg(pick("last_updated").alias("updated_at"), pick("git_head_sha").alias("built_at_sha"), pick("git_branch").alias("built_on_branch"))
    at = F.expr("try_cast(updated_at AS timestamp)")
    age = F.when(at.isNotNull() & F.col("now").isNotNull(), F.greatest(F.lit(0).cast("long"), F.col("now").cast("timestamp").cast("long") - at.cast("long")))
    known = F.col("built_at_sha").isNotNull() & F.col("head_sha").isNotNull()
    rows = built.filter("updated_at is not null or built_at_sha is not null").join(heads, "repo", "left")
    return rows.select("repo", "updated_at", age.alias("age_seconds"), "built_at_sha", "built_on_branch", "head_sha",
                       F.when(known, build_relation(F.col("built_at_sha"), F.col("head_sha"), F.col("merge_base"))).alias("build_relation"))


def head_of(spark: SparkSession, repo: str, root: str, built_sha: str | None) -> DataFrame:
    """The row of ``heads`` for one checkout."""
    head = _git(root, "rev-parse", "HEAD").strip()
    base = None
    if built_sha:
        found = subprocess.run(["git", "merge-base", _safe(built_sha), head], cwd=root, capture_output=True, timeout=120, stdin=subprocess.DEVNULL, text=True)
        base = found.stdout.strip() or None
    return spark.createDataFrame([(repo, head, base)], "repo string, head_sha string, merge_base string").withColumn("now", F.current_timestamp())


def register(registry: DataFrame, entries: DataFrame) -> DataFrame:
    """The registry (seq, path, alias, data_dir) with ``entries`` of the same columns: a known path keeps its place, and an
    alias or folder that is given replaces the one it had; null or empty ones leave it."""
    last = lambda c: F.max_by(c, F.when(F.col(c) != "", F.col("seq")))
    rows = registry.unionByName(entries).groupBy("path").agg(F.min("seq").alias("seq"), *(last(c).alias(c) for c in ("alias", "data_dir")))
    return rows.select("seq", "path", "alias", "data_dir")


def unregister(registry: DataFrame, path_or_alias: str) -> DataFrame:
    """The registry without the entries of that path or alias."""
    return registry.filter((F.col("path") != path_or_alias) & ~F.col("alias").eqNullSafe(F.lit(path_or_alias)))


def find(registry: DataFrame, alias: str | None = None, path: str | None = None) -> DataFrame:
    """The first entry with the alias or path, or no row."""
    asked = F.col("alias") == alias if alias is not None else F.col("path") == path
    return registry.filter(asked).orderBy("seq").limit(1)


def select_repos(registry: DataFrame, names: list[str]) -> DataFrame:
    """(name, state, seq, path): the registry entries each name stands for.

    A name is an alias first, and only if no entry has that alias the folder a
    path ends in.  One that several entries answer to takes them all and is
    "ambiguous", one that none does is "unknown" with no path; a name given
    twice counts once.  ``seq`` keeps the registry's order.
    """
    asked = registry.sparkSession.createDataFrame([(n,) for n in sorted(set(names))], "name string")
    entries = registry.withColumn("folder", F.regexp_extract(F.regexp_replace("path", "/+$", ""), "[^/]*$", 0))
    either = F.explode(F.array(F.struct(F.lit(0).alias("by"), F.col("alias").alias("name")), F.struct(F.lit(1).alias("by"), F.col("folder").alias("name"))))
    named = entries.select("seq", "path", either.alias("k")).select("seq", "path", "k.by", "k.name").filter("name <> ''")
    hits = asked.join(named, "name", "left")
    told = hits.groupBy("name").agg(F.min("by").alias("_by"))
    best = hits.join(told, "name").filter(F.col("by").eqNullSafe(F.col("_by")))
    counts = best.groupBy("name").agg(F.count("path").alias("_n"))
    state = F.when(F.col("_n") == 0, "unknown").when(F.col("_n") > 1, "ambiguous").otherwise("selected")
    return best.join(counts, "name").select("name", state.alias("state"), "seq", "path")


def log_savings(entries: DataFrame, *paths: str) -> DataFrame:
    """Append entries (repo, kind, tool, baseline_tokens, returned_tokens, saved_tokens, saved_percent) to logs of JSON lines,
    stamped with the time of writing; what was written is returned."""
    counts = ("baseline_tokens", "returned_tokens", "saved_tokens", "saved_percent")
    has = lambda c, other: F.col(c) if c in entries.columns else other
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    rows = entries.select(has("ts", stamp).alias("ts"), "repo", "kind", has("tool", F.lit(None).cast("string")).alias("tool"), *(F.col(c).cast("long").alias(c) for c in counts), has("estimated", F.lit(True)).alias("estimated"))
    for path in paths:
        rows.write.mode("append").json(path)
    return rows
