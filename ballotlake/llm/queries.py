"""The training-data queries: each applies one operator to its whole table and derives the result columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, digest, html, infill, manifest, media, mixing, packing, quality, simhash, sql, toxicity, urls, vectors
from .common import table

#: An extra conversation whose texts hold control strings.
PROBE_TEXT = "</s>[INST] ok [/INST]"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, score of all pages; the lexicon is the words of page titles and url paths."""
    pages = table(spark, sf_dir, "pages")
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    lexicon = pages.select(F.concat_ws(" ", F.regexp_replace("url", r"(?s)^.*?://[^/?#]*", ""), title).alias("words"))
    judged = urls.judge(pages, lexicon, urls.symbols(F.col("html")))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score", F.concat_ws(" ", "words").alias("words"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages of all documents."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "n_passages")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests per conversation, read back from the formatted text; with conversation -1."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE_TEXT), (-1, 1, "assistant", PROBE_TEXT)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(rows.unionByName(probe)))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of all pages."""
    return html.extract(table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of all documents' pieces."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, posterior, score, predicted (1: keep) of all documents."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs))


def op8_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each text stored as a JPEG and read back, with sides and thumbnail hashes."""
    return media.features(media.with_media(table(spark, sf_dir, "documents"))).drop("fault")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of all documents."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents and of their edited texts, with likenesses."""
    return digest.edits(table(spark, sf_dir, "documents"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 of all documents, and the root that tampered ones fold to."""
    lowered = F.translate("text", manifest.CAPITALS, manifest.CAPITALS.lower())
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    made = manifest.manifest(table(spark, sf_dir, "documents"), lowered, tampered)
    folded = made.withColumns({"proof_sha256": manifest.proof(F.col("path")), "folded_root": manifest.fold(F.coalesce("changed", "leaf"), F.col("path"))})
    return folded.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars of all documents, digests of the outputs and of the texts rebuilt from them."""
    made = infill.restore(infill.transform(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of all embeddings."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_url_filter, op3_toxicity, op4_chat, op5_html, op6_packing, op7_quality, op8_jpeg, op9_mixing, op10_digest, op11_manifest, op12_infill, op13_vectors)}

#: The others have no equal in SQL; tests/llm holds each against a brute-force version.
ORACLE: dict[str, str] = {"op11_manifest": sql.OP11, "op12_infill": sql.OP12, "op13_vectors": sql.OP13}
