"""Registered queries of the subpackage: each applies its operator to whole tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedyard.llm import apportion, bayes_quality, flatgraph, hmm, htmltree, hyperminhash, kneser_ney, onebit, oracle, residue_mining, spelling, suffixmerge, wumanber, zipwarc
from feedyard.llm.common import prep, table


def op1_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prep(spark), sf_dir, "documents")
    return hyperminhash.near_duplicates(docs, k=2, percent=80).select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id", "kept")


def op2_block_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltree.extract(table(prep(spark), sf_dir, "pages"))


def op3_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prep(spark), sf_dir, "documents")
    return suffixmerge.cut(docs, texts=False).select("doc.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    prep(spark)
    found = wumanber.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def op5_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = zipwarc.read(zipwarc.write(table(prep(spark), sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prep(spark), sf_dir, "documents")
    return hmm.score(docs, kneser_ney.held_out(F.col("doc_id"), 10, 0))


def op7_bayes_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prep(spark)
    found = bayes_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc.doc_id", F.col("host").alias("site_host"), F.col("path").alias("site_path"), "d_low", "d_toxic", "host_low", "host_toxic", "path_low", "path_toxic", "p_low", "p_toxic", "rejected")


def op8_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatgraph.link(table(prep(spark), sf_dir, "embeddings"), limit=0.93)[0]


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.predict(table(prep(spark), sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "entropy", "rejected")


def op10_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prep(spark), sf_dir, "documents")
    return apportion.mix(docs).select("doc.doc_id", "size", "source_size", "target", "taken")


def op11_residue_gemm(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(prep(spark), sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return residue_mining.mine(vectors.withColumn("label", moved), scale=256, positives=5, negatives=10, low=30, high=90)


def op12_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(prep(spark), sf_dir, "documents"), least=7, often=2, slip=31, factor=10)


def op13_one_bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onebit.search(table(prep(spark), sf_dir, "embeddings"), k=20)


QUERIES = {
    "op1_hyperminhash": op1_hyperminhash,
    "op2_block_tree": op2_block_tree,
    "op3_suffix_merge": op3_suffix_merge,
    "op4_wu_manber": op4_wu_manber,
    "op5_zip_warc": op5_zip_warc,
    "op6_hidden_markov": op6_hidden_markov,
    "op7_bayes_quality": op7_bayes_quality,
    "op8_flat_graph": op8_flat_graph,
    "op9_kneser_ney": op9_kneser_ney,
    "op10_sainte_lague": op10_sainte_lague,
    "op11_residue_gemm": op11_residue_gemm,
    "op12_bit_sliced": op12_bit_sliced,
    "op13_one_bit": op13_one_bit,
}

#: The others have no SQL form (trained models, a seeded choice); their tests hold them
#: against brute force, exact round trips or held-out accuracy.
ORACLE: dict[str, str] = {
    "op1_hyperminhash": oracle.NEAR_DUPLICATES,
    "op3_suffix_merge": oracle.REPEATS,
    "op4_wu_manber": oracle.CONTAMINATION,
    "op5_zip_warc": oracle.WARC,
    "op8_flat_graph": oracle.VECTOR_LINKS,
    "op11_residue_gemm": oracle.HARD_NEGATIVES,
    "op12_bit_sliced": oracle.VARIANTS,
    "op13_one_bit": oracle.NEAREST,
}
