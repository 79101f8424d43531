"""The opN_ queries: thin digests over the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read_table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality_rules import quality_verdicts

    done = quality_verdicts(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", "cutoff")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.ngram_join import ngram_components

    return ngram_components(read_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontaminate import contaminated

    done = contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return done.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.token_counts import token_counts

    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.line_dedup import dedup_lines

    done = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.common import fresh_path, materialize
    from tessera.llm.warc import read_archives, with_revisits, write_archives

    pages = with_revisits(read_table(spark, sf_dir, "pages"))
    manifest = materialize(write_archives(pages, fresh_path(spark, "warc")), "manifest")
    # One task for each archive, however Spark would pack the manifest's small files.
    spread = manifest.repartition(max(1, manifest.count()))
    return read_archives(spread).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.suffix_dedup import remove_copies

    done = remove_copies(read_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.language_id import fold
    from tessera.llm.lm_scoring import score_texts

    return score_texts(read_table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 10) == 0)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.language_id import fold, predict, train

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 3) == 1
    names, logp = train(docs.filter(~held_out))
    return predict(docs, names, logp).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import plan_mixture

    plan = plan_mixture(read_table(spark, sf_dir, "documents"), max_epochs=4.0)
    return plan.select(F.col("id").alias("doc_id"), "source", "n_tokens", "epoch", "block_order", "doc_order", F.round("weight", 9).alias("weight"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_ngram_join, op3_decontamination, op4_token_counts, op5_line_dedup, op6_warc, op7_suffix_dedup, op8_lm_scoring, op9_language_id, op10_mixing)}


def oracle_sql() -> dict[str, str]:
    from tessera.llm import sql

    return {"op1_quality_rules": sql.quality_rules(), "op2_ngram_join": sql.ngram_join(), "op3_decontamination": sql.decontamination(), "op5_line_dedup": sql.line_dedup(), "op6_warc": sql.warc(), "op10_mixing": sql.mixing()}
