"""The opN_ queries: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import alignment_counts
from .chat import read_back, windows
from .common import written
from .embedding_dedup import near_vectors
from .exact_dedup import exact_groups
from .line_dedup import dedup_lines
from .mixing import mix, n_words
from .near_dedup import near_classes
from .packing import pack
from .pii import BASE, pii_spans
from .quality import features, judged
from .repair import damaged, repaired_conversations
from .suffix_tree import scored
from .url_filter import judge

#: The contract's rules: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
SAYING = "</s>[INST] ok [/INST]"


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", SAYING), (-1, 1, "assistant", SAYING)], "conv_id long, turn long, role string, text string")
    back = read_back(windows(turns.unionByName(extra)))
    per_window = back.select("conv", "window", F.size("turns").alias("n"), F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"), "learned", "chars")
    whole = per_window.groupBy("conv").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list(F.struct("window", "turns", "learned"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    learned = F.array_join(F.col("w.learned"), "")
    return whole.select(F.col("conv").alias("conv_id"), "n_turns", F.sha2(F.array_join(F.col("w.turns"), ""), 256).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), "formatted_chars")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return judged(features(docs, keep=["doc_id"])).select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, placed = pack(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return placed.withColumnRenamed("id", "doc_id")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    out = scored(docs, ~held_out)
    return out.select(F.col("id").alias("doc_id"), (~F.col("learns")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_classes(_table(spark, sf_dir, "documents", "doc_id", "text"), words=2)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = written(_table(spark, sf_dir, "documents", "doc_id", "text", "source").select("doc_id", "source", n_words(F.col("text")).alias("size")))
    taken, sources = mix(docs, F.array("source"), F.col("size"), [F.col("doc_id")])
    targets = spark.createDataFrame([(s["source"], s["size"], s["target"]) for s in sources], "name string, source_size long, target double")
    out = taken.join(F.broadcast(targets), F.col("source").eqNullSafe(F.col("name")))  # a row a source
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_spans(_table(spark, sf_dir, "documents", "doc_id", "text"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(kind).__eq__)).cast("long").alias(f"n_{kind}") for kind in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_counts(_table(spark, sf_dir, "documents", "doc_id", "text")).withColumnRenamed("id", "doc_id")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return repaired_conversations(turns, damaged(turns))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_vectors(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def chat_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op1."""
    return op1_chat_formatting(spark, sf_dir).drop("formatted_chars")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op2."""
    return op2_quality_rules(spark, sf_dir).drop("kept", "quality")


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op4."""
    return op4_lm_scoring(spark, sf_dir).drop("score").withColumn("base_score", F.round("base_score", 3))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op7."""
    return op7_mixing(spark, sf_dir).drop("taken").withColumn("target", F.round("target", 3))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op9."""
    return op9_url_filters(spark, sf_dir).withColumn("verdict", F.when(F.col("rule").isNotNull(), F.col("verdict")))


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op10: DuckDB's patterns give texts, not places."""
    return op10_pii(spark, sf_dir).drop("base_sha256", "spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_chat_formatting, op2_quality_rules, op3_best_fit_packing, op4_lm_scoring, op5_near_dedup, op6_exact_dedup, op7_mixing, op8_line_dedup, op9_url_filters, op10_pii, op11_alignment, op12_conversation_repair, op13_embedding_dedup)
    return {f.__name__: f for f in (*own, chat_digests, quality_base, lm_base, mix_targets, url_rules, pii_counts)}
