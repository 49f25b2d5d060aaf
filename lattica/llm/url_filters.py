"""URL filtering: host and path rules, and a classifier on hashed character n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class UrlModel:
    """Weights of a logistic regression on hashed n-grams; ``bits`` bounds their number."""

    weights: tuple[float, ...]
    bias: float
    bits: int
    sizes: tuple[int, ...]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to / ? # or end, A-Z lower-cased; then up to ? # or end.

    Both are empty for a null url or one without ``://``.
    """
    rest = F.when(F.instr(url, "://") > 0, F.expr("1")).isNotNull()
    tail = F.substring_index(url, "://", 1)
    after = url.substr(F.length(tail) + 4, F.length(url))
    host = F.regexp_extract(after, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(after, r"\A[^/?#]*([^?#]*)", 1)
    return F.when(rest, lower_ascii(host)).otherwise(F.lit("")), F.when(rest, path).otherwise(F.lit(""))


def match_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule name, verdict) of the longest rule that fits, null if none does; equal lengths go to the first in the list."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def features(host: str, path: str, bits: int, sizes: Iterable[int]) -> list[int]:
    """Distinct hashed n-grams of ^host$ and ^path$, kept apart by a prefix."""
    out = set()
    mask = (1 << bits) - 1
    for tag, s in (("h", host), ("p", path)):
        s = f"^{s}$"
        for n in sizes:
            out.update(zlib.crc32(f"{tag}{n}{s[i : i + n]}".encode("utf-8", "surrogatepass")) & mask for i in range(len(s) - n + 1))
    return sorted(out)


def fit(labelled: Sequence[tuple[str, str, int]], *, bits: int = 14, sizes: Sequence[int] = (2, 3, 4), rounds: int = 200, rate: float = 0.5, l2: float = 1e-4) -> UrlModel:
    """Full-batch logistic regression on (host, path, label) rows, label 1 for allow.

    Classes weigh the same.  With one class only, the model always says that
    class; with no rows it allows.
    """
    import numpy as np

    if not labelled or len({y for _, _, y in labelled}) == 1:
        return UrlModel((0.0,) * (1 << bits), -1.0 if labelled and not labelled[0][2] else 1.0, bits, tuple(sizes))
    found = [features(h, p, bits, sizes) for h, p, _ in labelled]
    y = np.array([t for _, _, t in labelled], float)
    row = np.repeat(np.arange(len(found)), [len(f) for f in found])
    col = np.fromiter((c for f in found for c in f), np.int64)
    scale = 1 / np.sqrt(np.array([max(1, len(f)) for f in found], float))
    per = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, b = np.zeros(1 << bits), 0.0
    g2, gb2 = np.full(1 << bits, 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(row, w[col] * scale[row], len(y)) + b
        err = per * (1 / (1 + np.exp(-z)) - y)
        g = np.bincount(col, err[row] * scale[row], 1 << bits) + l2 * w
        gb = err.sum()
        g2 += g * g
        gb2 += gb * gb
        w -= rate * g / np.sqrt(g2)
        b -= rate * gb / gb2**0.5
    return UrlModel(tuple(w.tolist()), float(b), bits, tuple(sizes))


def score(model: UrlModel, host: str, path: str) -> float:
    f = features(host, path, model.bits, model.sizes)
    return sum(model.weights[i] for i in f) / max(1, len(f)) ** 0.5 + model.bias


def training_rows(ruled: DataFrame, limit: int) -> list[tuple[str, str, int]]:
    """A bounded sample of urls that a rule decides, ``limit`` per verdict, chosen by hash of the url."""
    rows = []
    for verdict in ("allow", "block"):
        one = ruled.filter(F.col("verdict") == verdict).select("host", "path").distinct()
        picked = one.orderBy(F.xxhash64("host", "path"), "host", "path").limit(limit).collect()
        rows += [(r.host, r.path, int(verdict == "allow")) for r in picked]
    return rows


def judge(pages: DataFrame, rules: Sequence[Rule], model: UrlModel, *, url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict`` and ``url_score`` to every row.

    The longest rule that fits decides, else the sign of the model's score
    (0 or more: allow).  Urls without ``://`` and null urls are judged by the
    model on empty host and path.  Repeated rows each get their verdict, an
    empty table gives none.  Columns that have one of the added names are
    replaced, all others stay.
    """
    host, path = url_parts(F.col(url))
    parts = pages.withColumn("host", host).withColumn("path", path)
    shared = parts.sparkSession.sparkContext.broadcast(model)  # 2^bits doubles, whatever the input

    @F.pandas_udf("double")
    def by_model(h: pd.Series, p: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([score(m, a, b) for a, b in zip(h, p)], dtype="float64")

    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    out = parts.withColumn("url_score", by_model("host", "path")).withColumn("rule", rule)
    return out.withColumn("verdict", F.coalesce(verdict, F.when(F.col("url_score") >= 0, "allow").otherwise("block")))
