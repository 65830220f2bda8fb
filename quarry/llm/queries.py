"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.llm import alignment, chat, decontam, divergence, exact_dedup, jaccard, line_dedup, packing, personal, quality, toxicity, url_filter, warc


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark, sf_dir):
    return chat.chat_query(_table(spark, sf_dir, "conversations"))


def op2_toxicity(spark, sf_dir):
    return toxicity.toxicity_query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def tokenizer_path(name="word_bpe_49k.json"):
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_packing(spark, sf_dir):
    return packing.packing_query(_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_quality(spark, sf_dir):
    return quality.quality_query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_jaccard(spark, sf_dir):
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op6_url_filter(spark, sf_dir):
    return url_filter.url_query(_table(spark, sf_dir, "pages"))


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"), keep="max")


def op8_warc(spark, sf_dir):
    return warc.warc_query(_table(spark, sf_dir, "pages"))


def op9_line_dedup(spark, sf_dir):
    out = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_decontaminate(spark, sf_dir):
    return decontam.decontamination_query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_alignment(spark, sf_dir):
    return alignment.alignment(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_personal(spark, sf_dir):
    return personal.personal_query(_table(spark, sf_dir, "documents"))


def op13_divergence(spark, sf_dir):
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def queries():
    first = (op1_chat_format, op2_toxicity, op3_packing, op4_quality, op5_jaccard, op6_url_filter, op7_exact_dedup, op8_warc, op9_line_dedup, op10_decontaminate)
    return {f.__name__: f for f in (*first, op11_alignment, op12_personal, op13_divergence)}


def oracle_sql():
    return {
        "op1_chat_format": chat.ORACLE,
        "op6_url_filter": url_filter.ORACLE,
        "op7_exact_dedup": exact_dedup.ORACLE,
        "op8_warc": warc.ORACLE,
        "op9_line_dedup": line_dedup.ORACLE,
        "op13_divergence": divergence.ORACLE,
    }
