"""A training-corpus pipeline: five stages, each one operator of ``lattica.llm`` over all rows that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import mixing, ngram_jaccard, pieces, quality, substrings
from lattica.llm.common import id_key, store, table, text_key
from lattica.llm.queries import VOCABULARY

#: Bytes of a string that is judged as repeated.  No contract fixes it here: passages of more than 50 words are to go,
#: and of such in these tables one of a hundred is below 239 bytes.
REPEATED_BYTES = 200

#: Columns of ``documents`` that every stage but the last returns.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the forest; null and empty texts go.

    The forest is fitted on the statistics of labelled rows; the second pass
    scores every text where it is read, so no text is moved.
    """
    measured = store(quality.base_rules(quality.stats(docs, "doc_id")), "stats")
    forest = quality.fit(measured, table(spark, sf_dir, "labels"))
    return quality.judge(quality.base_rules(quality.stats(docs, *COLUMNS)), forest).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by 80 % of 5-word shingles: that of least (doc_id with null last, text hash).

    Repeated rows are one document.  Texts without shingles link with nothing.
    """
    keyed = docs.withColumn("_id", id_key()).withColumn("_text", text_key())
    groups = ngram_jaccard.jaccard_components(keyed, ngram_jaccard.Likeness(words=5, percent=80), "_id", "_text", group="_group")
    alone = [F.when(F.col("_group").isNull(), F.col(c)).alias(f"_alone{c}") for c in ("_id", "_text")]
    first = groups.groupBy("_group", *alone).agg(F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "_id", "_text")).alias("_first"))
    return keyed.join(first.select("_first._id", "_first._text"), ["_id", "_text"], "left_semi").dropDuplicates(["_id", "_text"]).select(*COLUMNS)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the whole characters under repeated strings of ``REPEATED_BYTES`` bytes; what is left empty goes.

    So null and empty texts go; repeated rows repeat each other and lose what a string of that length covers.
    """
    kept = substrings.remove_repeated_bytes(docs, "doc_id", "lang", "source", length=REPEATED_BYTES, whole_chars=True)
    text = F.decode(F.col("kept"), "UTF-8")
    return kept.filter("octet_length(kept) > 0").select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; where a source's budget ends, the last one is cut to its first words.

    Null and empty texts have no words, so the mix takes none of them; rows of one id and text share one decision.
    """
    keyed = docs.withColumn("_id", id_key()).withColumn("_text", text_key())
    sized = store(mixing.with_size(keyed, ("doc_id", "source", "_id", "_text")), "sizes")
    plan = mixing.mix(sized).filter("taken > 0").select("_id", "_text", "size", "epochs", "cut").dropDuplicates(["_id", "_text"])
    rows = keyed.join(plan, ["_id", "_text"])
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), (F.col("epochs") + (F.col("cut") > 0).cast("int")).cast("int"))))
    part = (F.col("_copy") > F.col("epochs")) & (F.col("cut") < F.col("size"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    text = F.when(part, F.array_join(F.slice(words, F.lit(1), F.col("cut").cast("int")), " ")).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def encoded_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, with the digest of what they decode to; null and empty texts have no ids, repeated rows each get theirs."""
    return pieces.encode(docs, pieces.load_vocabulary(VOCABULARY), "doc_id", "lang", "source")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("mixed_sources", mixed_sources),
    ("encoded_pieces", encoded_pieces),
]

#: The stages hold a fitted forest, components and a best-path fold, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what a stage returns is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
