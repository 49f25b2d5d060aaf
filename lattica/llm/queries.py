"""Contract queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import ball_kmeans, clause_grammar, lm_scoring, media, mixing, ngram_jaccard, oracles, pieces, quality, rolling_ranks, sharding, substrings, url_filters, window_log
from lattica.llm.common import small_batches, store, table, utf8, work_path

RULES = (
    url_filters.Rule("allow", "org", "/"),
    url_filters.Rule("block", "example.org", "/es/"),
    url_filters.Rule("block", "example.org", "/en/1"),
    url_filters.Rule("allow", "com", "/fr/"),
    url_filters.Rule("block", "com", "/de/"),
)
SHARDS = 40
#: A public vocabulary; any sentencepiece model file does.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal of every byte under a 400-byte string that occurs twice."""
    out = substrings.remove_repeated_bytes(table(spark, sf_dir, "documents"), "doc_id")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every whole text, and the digest of what they decode to."""
    return pieces.encode(table(spark, sf_dir, "documents"), pieces.load_vocabulary(VOCABULARY), "doc_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics, base rules, and the forest's verdict for every document."""
    measured = store(quality.base_rules(quality.stats(table(spark, sf_dir, "documents"), "doc_id")), "stats")
    forest = quality.fit(measured, table(spark, sf_dir, "labels"))
    return quality.judge(measured, forest).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "odd_score")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as an image in an archive, read back through the data source."""
    small_batches(spark)
    spark.dataSource.register(media.MediaArchive)
    path = work_path(spark, "media")
    table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("data")).write.format("media_archive").mode("append").save(path)

    return spark.read.format("media_archive").option("content", "digest").load(path)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    sized = mixing.with_size(table(spark, sf_dir, "documents"), ("doc_id", "source"))
    return mixing.mix(store(sized, "sizes")).select("doc_id", "size", "source_size", "target", "taken", "source", "epochs")


def op6_window_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal of repeated 35-word windows through the fingerprint log."""
    out = window_log.remove_repeated_windows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and subword log probabilities of every text, learned from four fifths of the documents."""
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 1
    return lm_scoring.score(table(spark, sf_dir, "documents"), held_out, VOCABULARY)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url; the classifier learns from a bounded sample of urls that rules decide."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = url_filters.url_parts(F.col("url"))
    parts = pages.select(host.alias("host"), path.alias("path"))
    _, verdict = url_filters.match_rule(F.col("host"), F.col("path"), RULES)
    model = url_filters.fit(url_filters.training_rows(parts.withColumn("verdict", verdict), 500))
    return url_filters.judge(pages, RULES, model).select("page_id", "host", "path", "rule", "verdict", "url_score")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard among 40 of equal weight, its slot, and its shard among 41."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(utf8()).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return sharding.shard(docs, [1.0] * SHARDS, grown=[1.0] * (SHARDS + 1)).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles are 90 % alike."""
    return ngram_jaccard.jaccard_components(table(spark, sf_dir, "documents"), ngram_jaccard.Likeness(words=3, percent=90))


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all usable vectors after ten rounds."""
    return ball_kmeans.centroid_clusters(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, scale=1024, seed=3)


def op12_clause_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text by the clause grammar, learned from labelled documents that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
    model = clause_grammar.fit(clause_grammar.labelled(docs, labels, ~held_out))
    return clause_grammar.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "clauses")


def op13_rolling_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, sums, languages and ranks of lengths over the ten minutes and the half day before each document, within its source."""
    h = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10_000))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.length("text").cast("long").alias("length"), (F.col("doc_id") + h).alias("place"))
    docs = docs.withColumn("event_s", F.expr("60 * ((place - pmod(place, 6)) div 6)"))
    return rolling_ranks.rolling_features(docs, (600, 43_200))


QUERIES = {
    "op1_suffix_array": op1_suffix_array,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_quality_rules": op3_quality_rules,
    "op4_media_columns": op4_media_columns,
    "op5_mixing": op5_mixing,
    "op6_window_log": op6_window_log,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_url_filters": op8_url_filters,
    "op9_sharding": op9_sharding,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_ball_kmeans": op11_ball_kmeans,
    "op12_clause_grammar": op12_clause_grammar,
    "op13_rolling_ranks": op13_rolling_ranks,
}

#: The other operators gather by fitted models, components or best paths, or go over bytes; tests hold them against brute force.
ORACLES = {"op5_mixing": oracles.OP5, "op6_window_log": oracles.OP6, "op9_sharding": oracles.OP9, "op11_ball_kmeans": oracles.OP11, "op13_rolling_ranks": oracles.OP13}
