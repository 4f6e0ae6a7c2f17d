"""The operators over their whole tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from residua.llm import chat, decontaminate, jaccard, langid, lm, negatives, packing, passages, pii, quality, ranking, simhash, sql, urls
from residua.llm.texts import id_remainder
from residua.plans.registry import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*columns)


@query("op1_benchmark_decontamination", sql.DECONTAMINATION)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("scan.items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", F.col("scan.n_words").alias("n_words"), F.col("scan.n_hit").alias("n_hit"),
        F.size("scan.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("scan.n_words"), F.col("scan.n_hit")).alias("contaminated"),
    )


@query("op2_substring_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(documents(spark, sf_dir, "doc_id", "text"))


@query("op3_chat_formatting", sql.CHAT)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


@query("op4_lm_scoring")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = F.coalesce(id_remainder(F.col("doc_id"), 10), F.lit(0))
    docs = documents(spark, sf_dir, "doc_id", "text")
    found = lm.score(docs, left != 0)
    return found.select("doc_id", (left == 0).alias("held_out"), *[f"lm.{c}" for c in (
        "n_tokens", "n_known", "train_tokens", "base_score", "score")])


@query("op5_simhash_near_duplicates")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


@query("op6_quality_rules", sql.QUALITY)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.assess(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", *[f"quality.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words", "base_failed", "kept")])


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = langid.fit(docs.filter(id_remainder(F.col("doc_id"), 5) != 0))
    found = docs.select("doc_id", langid.identify(docs, model).alias("found"))
    return found.select(
        "doc_id", F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(True)).alias("held_out"),
        F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"),
    )


@query("op8_pii")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    found = pii.find(docs, pii.fit(docs))
    listed = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("pii.base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in pii.KINDS],
                        F.sha2(listed(F.col("pii.base")), 256).alias("base_sha256"),
                        listed(F.col("pii.spans")).alias("spans"))


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = documents(spark, sf_dir, "doc_id", "text", "source").select(
        "doc_id", "source", F.xxhash64("text").alias("cluster"), packing.count_tokens("text").alias("n_tokens"))
    return packing.pack(sized)


@query("op10_url_filters", sql.URL_FILTERS)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("page_id", *[f"judged.{c}" for c in ("host", "path", "rule", "verdict")])


@query("op11_ngram_jaccard_join", sql.JACCARD)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.similarity_components(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"))


@query("op12_ranked_lexical_search", sql.RANKED)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark"))


@query("op13_hard_negatives", sql.NEGATIVES)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", noisy), F.col("vec_id") % 100 == 0)
