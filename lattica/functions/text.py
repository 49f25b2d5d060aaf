"""Scalar text expressions over names, paths and keys; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica import schemas

#: Languages that may call each other by bare name.
SCRIPT_FAMILY = ("javascript", "typescript", "tsx")


def symbol(qn: Column) -> Column:
    """What follows the first ``::``, or the whole name."""
    at = F.instr(qn, "::")
    return F.when(at > 0, F.substring(qn, at + 2, F.length(qn))).otherwise(qn)


def last_segment(x: Column, by: str = "::") -> Column:
    return F.substring_index(x, by, -1)


def extension(path: Column) -> Column:
    """What follows the last dot, empty without one."""
    return F.when(F.instr(path, ".") > 0, F.substring_index(path, ".", -1)).otherwise(F.lit(""))


def parent_dir(path: Column) -> Column:
    """The last directory's name, or the file's stem where there is none."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise(stem(path))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(F.translate(path, "\\", "/"), "/", -1), r"\.[^.]*$", "")


def path_suffixes(path: Column) -> Column:
    """Every suffix of whole path parts, longest first."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def any_of(x: Column, words: Sequence[str]) -> Column:
    """Whether any of the words is a substring."""
    return x.rlike("|".join(words))


def is_security_name(name: Column, qn: Column) -> Column:
    return any_of(F.lower(name), schemas.SECURITY_KEYWORDS) | any_of(F.lower(qn), schemas.SECURITY_KEYWORDS)


def is_risk_index_name(name: Column) -> Column:
    return any_of(F.lower(name), schemas.RISK_INDEX_KEYWORDS)


def is_test_file(path: Column) -> Column:
    return path.rlike(schemas.TEST_FILE)


def is_test_community(name: Column) -> Column:
    """Names of communities that hold tests."""
    return name.rlike(f"(?i){schemas.TEST_COMMUNITY}")


def is_entry_name(name: Column, language: Column) -> Column:
    php = (language == "php") & name.rlike("|".join(schemas.ENTRY_NAMES_PHP))
    return name.rlike("|".join(schemas.ENTRY_NAMES)) | F.coalesce(php, F.lit(False))


def decorators(extra: Column) -> Column:
    """The ``decorators`` of a JSON object as an array, whether it holds a list or one string."""
    raw = F.get_json_object(extra, "$.decorators")
    listed = F.from_json(raw, "array<string>")
    return F.when(raw.startswith("["), listed).when(raw.isNotNull(), F.array(raw)).otherwise(F.array().cast("array<string>"))


def is_entry_decorator(extra: Column) -> Column:
    any_case = "(?i)" + "|".join(schemas.ENTRY_DECORATORS_ANY_CASE)
    exact = "|".join(schemas.ENTRY_DECORATORS)
    return F.exists(decorators(extra), lambda d: d.rlike(any_case) | d.rlike(exact))


def is_hdl(extra: Column) -> Column:
    """Declarations of hardware languages, which are no callable code; a text probe on the stored JSON."""
    return F.coalesce(extra.like('%"verilog_kind"%'), F.lit(False))


def sanitize(x: Column, most: int = 256) -> Column:
    """Without control characters other than tab and newline, cut to ``most``."""
    return F.substring(F.regexp_replace(x, r"[\x00-\x08\x0b-\x1f]", ""), 1, most)


def signature(kind: Column, name: Column, params: Column, returns: Column) -> Column:
    """A one-line signature by kind, 512 characters at most."""
    call = F.concat(F.lit("def "), name, F.lit("("), F.coalesce(params, F.lit("")), F.lit(")"), F.when(F.coalesce(returns, F.lit("")) != "", F.concat(F.lit(" -> "), returns)).otherwise(F.lit("")))
    return F.substring(F.when(kind.isin("Function", "Test"), call).when(kind == "Class", F.concat(F.lit("class "), name)).otherwise(name), 1, 512)


def split_words(name: Column) -> Column:
    """Words of a camelCase, snake_case, dotted or dashed name."""
    return F.filter(F.split(F.regexp_replace(name, r"([a-z])([A-Z])", "$1_$2"), r"[_\-.\s]+"), lambda w: w != "")


def slug(name: Column, most: int = 30) -> Column:
    """Lower-case words joined by dashes, cut at a word boundary."""
    whole = F.array_join(F.transform(split_words(F.regexp_replace(name, r"[^A-Za-z0-9]+", " ")), lambda w: F.lower(w)), "-")
    cut = F.regexp_extract(F.substring(whole, 1, most + 1), r"^(.+)-[^-]*$", 1)
    return F.when(F.length(whole) <= most, whole).when(cut != "", cut).otherwise(F.substring(whole, 1, most))


def config_key(key: Column) -> Column:
    """A configuration key in one spelling: each dotted part in camel case, an index at its end kept.

    A part of one word keeps its spelling unless it is all capitals.
    """
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))

    def one(part):
        index = F.regexp_extract(part, r"(\[[0-9]+\])$", 1)
        base = F.regexp_replace(part, r"\[[0-9]+\]$", "")
        words = F.filter(F.split(base, "[-_]+"), lambda w: w != "")
        shout = (F.upper(base) == base) & (F.lower(base) != base)
        head = F.when(shout | (F.size(words) > 1), F.lower(F.get(words, F.lit(0)))).otherwise(F.get(words, F.lit(0)))
        rest = F.array_join(F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), capital), "")
        return F.when(F.size(words) == 0, index).otherwise(F.concat(head, rest, index))

    return F.array_join(F.transform(F.split(F.trim(key), r"\."), one), ".")


def key_patterns(key: Column) -> Column:
    """Targets that consumers of a key may name: the key, all below it, and each dotted prefix's wildcard."""
    parts = F.split(key, r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("config:"), F.array_join(F.slice(parts, 1, i), "."), F.lit(".*")))
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("config:"), key)), prefixes))


def is_java_name(x: Column) -> Column:
    """Shape of a fully qualified Java name: three dotted parts or more, or an owner with a capital."""
    return x.rlike(r"^[A-Za-z_$][\w$]*(\.[A-Za-z_$][\w$]*){2,}$") | x.rlike(r"^([a-z_$][\w$]*\.)*[A-Z][\w$]*\.[A-Za-z_$][\w$]*$")


def same_family(a: Column, b: Column) -> Column:
    """Whether two languages may call each other by bare name."""
    return (a == b) | (a.isin(*SCRIPT_FAMILY) & b.isin(*SCRIPT_FAMILY))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def ratio_percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(part * 100.0 / whole + 0.5)).otherwise(0).cast("long")
