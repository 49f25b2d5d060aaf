"""Inventory and log readers."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Directories and files that are never source; a leading slash means the root's own.
IGNORED = (
    "**/node_modules/**", "**/.git/**", "**/.svn/**", "**/__pycache__/**", "*.pyc", "**/.venv/**", "**/venv/**",
    "/dist/**", "/build/**", "/.next/**", "/.nuxt/**", "/target/**", "/bin/**", "/obj/**",
    "**/vendor/**", "/storage/**", "/bootstrap/cache/**", "/public/build/**", "**/.bundle/**", "**/.gradle/**", "*.jar",
    "**/.dart_tool/**", "**/.pub-cache/**", "**/cdk.out/**", "/coverage/**", "**/.cache/**", "/.tmp/**", "/tmp/**",
    "*.min.js", "*.min.css", "*.map", "*.lock", "package-lock.json", "yarn.lock", "*.db", "*.sqlite", "*.db-journal", "*.db-wal",
)


#: Folders of build output, and the files beside them that prove it.
OUTPUT_MANIFESTS = {
    "target": ("pom.xml", "Cargo.toml", "build.sbt"),
    "build": ("build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts"),
    ".next": ("next.config.js", "next.config.mjs", "next.config.cjs", "next.config.ts"),
    ".nuxt": ("nuxt.config.js", "nuxt.config.mjs", "nuxt.config.ts"),
}
#: The longest path, and the most bytes of one of its names.
MOST_PATH, MOST_NAME = 1000, 255
#: What Spark reads as one value.
MOST_BYTES = 2**31 - 1


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression: ** any parts, * within a part, ? one character."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" + pattern[i] if pattern[i] in r".^$+{}[]|()\\" else pattern[i]), i + 1
    return f"^{out}$"


def is_ignored(path: Column, patterns: Sequence[str] = IGNORED) -> Column:
    """Whether a path below the root (without a leading slash) is ignored; a pattern without a slash fits a file's name anywhere."""
    anywhere = [p if "/" in p else f"**/{p}" for p in patterns]
    return path.rlike("|".join(glob_regex(p.removeprefix("/")) for p in anywhere))


def ignore_rules(lines: Sequence[str]) -> tuple[list[str], list[str]]:
    """(patterns, spared) of an ignore file's lines, which are a user's few.

    Blank lines and those that begin with # say nothing.  A folder's bare name
    (``name/`` or ``name/**``) is ignored at any depth, one with a slash inside
    or in front only below the root; ``!path`` spares a nested output folder.
    """
    rules = [line.strip() for line in lines]
    rules = [r for r in rules if r and not r.startswith("#")]
    spared = [r[1:].strip().strip("/") for r in rules if r.startswith("!")]
    patterns = []
    for r in (r for r in rules if not r.startswith("!")):
        folder = r.removesuffix("**") if r.endswith("/**") else r
        bare = folder.endswith("/") and "/" not in folder[:-1]
        patterns.append(f"**/{folder}**" if bare and folder != "/" else f"{folder}**" if folder.endswith("/") else r)
    return patterns, spared


def nested_outputs(paths: DataFrame, spared: Sequence[str] = ()) -> DataFrame:
    """(folder): folders that a manifest beside them marks as build output, below the root's own level.

    ``paths`` is (below), every path under the root.  A nested folder of such a
    name without its manifest holds sources and is no output.
    """
    table = F.create_map(*(x for out, names in OUTPUT_MANIFESTS.items() for n in names for x in (F.lit(n), F.lit(out))))
    parent, name = F.regexp_extract("below", "^(.*)/[^/]+$", 1), F.substring_index("below", "/", -1)
    found = paths.select(parent.alias("_parent"), table[name].alias("_out")).filter("_out is not null and _parent <> ''")
    folders = found.select(F.concat_ws("/", "_parent", "_out").alias("folder")).distinct()
    return folders.filter(~F.col("folder").isin(*spared)) if spared else folders


def _local(uri: str) -> str | None:
    """The path of a file: address, None for stores that know no links."""
    return unquote(re.sub("^file:/*", "/", uri)) if uri.startswith("file:") else None


def _linked(root: str):
    """Whether a path is reached through a link below the root; asked where the file is read, for local files only."""

    @F.pandas_udf("boolean")
    def linked(paths: pd.Series) -> pd.Series:
        base = _local(root)
        if base is None:
            return pd.Series([False] * len(paths))
        real = os.path.realpath(base)
        at = [os.path.relpath(_local(p), base) for p in paths]
        return pd.Series([os.path.realpath(os.path.join(real, a)) != os.path.join(real, a) for a in at])

    return linked


def collect_files(spark: SparkSession, root: str, languages: dict[str, str], ignored: Sequence[str] = IGNORED, tracked: DataFrame | None = None, ignore_file: str | None = None, max_bytes: int = MOST_BYTES) -> DataFrame:
    """(file_path, language, content) of the source files below a root, an address with its scheme.

    Left out are ignored paths, also by the root's ``ignore_file``; build output
    that a manifest marks at any depth; paths too long for common file systems;
    files reached through links; unknown languages; binary files, by a NUL in
    the first 8,192 bytes; files above ``max_bytes``, which Spark can't hold as
    one value.  ``tracked`` is (file_path), paths below the root: where it has
    rows, only these are taken.  Names are judged without contents, which meet them once.
    """
    root = root.rstrip("/")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = read.load(root).filter(F.col("length") <= max_bytes)
    base = root.split(":", 1)[-1].strip("/")
    below = F.regexp_replace(F.regexp_replace("path", r"^[A-Za-z0-9+.\-]+:/*", ""), "^" + re.escape(base) + "/", "")
    patterns, spared = list(ignored), []
    if ignore_file is not None:
        own = read.option("pathGlobFilter", ignore_file).load(root).filter(below == ignore_file)
        more, spared = ignore_rules([r[0] for r in own.select(F.explode(F.split(F.decode("content", "UTF-8"), "\r?\n"))).collect()])  # one file of rules
        patterns += more
    known = F.create_map(*(x for k, v in languages.items() for x in (F.lit(k), F.lit(v))))[F.concat(F.lit("."), F.substring_index("path", ".", -1))]
    paths = files.select("path", below.alias("below"), known.alias("language"))
    outputs = nested_outputs(paths, spared)
    fits = (F.length("path") <= MOST_PATH) & ~F.exists(F.split("below", "/"), lambda p: F.octet_length(p) > MOST_NAME)
    named = paths.filter(F.col("language").isNotNull() & fits & ~is_ignored(F.col("below"), patterns))
    if tracked is not None:
        none = tracked.agg(F.count(F.lit(1)).alias("_n")).filter("_n = 0")
        listed = tracked.select(F.col("file_path").alias("below")).distinct()
        named = named.join(listed, "below", "left_semi").unionByName(named.join(F.broadcast(none), F.lit(True), "left_semi"))  # one row
    parts = F.split("below", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    inside = named.select("below", F.explode(above).alias("folder")).join(outputs, "folder", "left_semi").select("below").distinct()
    named = named.join(inside, "below", "left_anti").filter(~_linked(root)("path"))
    head = F.hex(F.substring("content", 1, 8192))
    rows = files.select("path", "content").filter(~head.rlike("^(..)*00")).join(named.select("path", "language"), "path")
    return rows.select(F.col("path").alias("file_path"), "language", "content")


def read_savings_log(spark: SparkSession, path: str) -> DataFrame:
    """Log entries, one JSON object a line; lines that are none are left out."""
    return spark.read.schema("ts string, tool string, repo string, baseline_tokens long, returned_tokens long, saved_tokens long").option("mode", "DROPMALFORMED").json(path)


def read_memories(spark: SparkSession, path: str) -> DataFrame:
    """(question, type, answer) of markdown notes with a front matter."""
    t = spark.read.option("wholetext", "true").text(path)
    field = lambda k: F.regexp_extract("value", rf"(?m)^{k}:\s*(.*)$", 1)
    return t.select(field("question").alias("question"), field("type").alias("type"), F.trim(F.regexp_replace("value", r"(?s)^---.*?---", "")).alias("answer"))


def docs_section(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """What stands between the tags of a section."""
    return docs.select(F.regexp_extract(F.col(text), rf'(?s)<section name="{name}">(.*?)</section>', 1).alias("section")).filter("section <> ''")
