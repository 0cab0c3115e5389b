"""Registered text queries: each operator over its whole table, and the pipeline."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession, functions as F

from stemma.llm.bpe import encode_digests
from stemma.llm.collocations import collocations
from stemma.llm.conversations import damaged, repair
from stemma.llm.language import identify
from stemma.llm.licenses import scan_licenses
from stemma.llm.lines import drop_repeated_lines
from stemma.llm.oracles import LLM_ORACLES
from stemma.llm.near import near_duplicates
from stemma.llm.neighbours import nearest
from stemma.llm.packing import pack
from stemma.llm.phrases import fingerprints
from stemma.llm.quality import rate
from stemma.llm.repeats import repeated_spans
from stemma.llm.scoring import score_documents


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark, sf_dir):
    return repeated_spans(table(spark, sf_dir, "documents"), length=50).drop("spans")


def op2_quality(spark, sf_dir):
    rated = rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rated.select("doc_id", "expected_grade", "tail_probability", "kept")


def op3_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


def op4_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


def op5_language(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op6_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), tokenizer(), size=2048, end_id=0)


def op7_bpe(spark, sf_dir):
    return encode_digests(table(spark, sf_dir, "documents"), tokenizer())


def op8_language_model(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"))


def op9_phrase_fingerprints(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, similarity=0.8)


def op11_line_dedup(spark, sf_dir):
    kept = drop_repeated_lines(table(spark, sf_dir, "documents"), least=40, documents=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_conversation_repair(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    return repair(conversations, damaged(conversations))


def op13_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"), longest=3, least=10, top=2000)


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


LLM_REGISTRY = {f.__name__: f for f in (
    op1_suffix_dedup, op2_quality, op3_neighbours, op4_license_scan, op5_language, op6_best_fit_packing, op7_bpe,
    op8_language_model, op9_phrase_fingerprints, op10_near_duplicates, op11_line_dedup,
    op12_conversation_repair, op13_collocations, pipeline)}
if corpus_pipeline.ORACLE_SQL:
    LLM_ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
