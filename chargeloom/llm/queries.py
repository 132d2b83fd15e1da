"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import delete_folder
from . import bpe, chat, codebooks, decontaminate, html_text, langid, quality, simhash, tokenfile, topk, unigram, urls, whitening
from .common import checkpointed, fresh_folder, tables


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = tables(sf_dir)
    found = decontaminate.decontaminate(read(spark, "documents"), read(spark, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(tables(sf_dir)(spark, "embeddings"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = tables(sf_dir)(spark, "documents").select("doc_id", "text")
    decoded = bpe.round_trip_documents(docs, path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), " "), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.rotate_perspectives(tables(sf_dir)(spark, "conversations"))
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"], m["end"])), ",")
    return found.withColumn("mask", mask)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(tables(sf_dir)(spark, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(sf_dir)(spark, "documents").select("doc_id", "text")
    folder = fresh_folder(spark, "tokens")
    tokenfile.write_tokens(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    found = checkpointed(tokenfile.read_tokens(spark, folder, with_ids=False).withColumnRenamed("crc32", "ids_crc32"))
    delete_folder(spark, folder)
    return found


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables(sf_dir)(spark, "pages").select("page_id", "html")
    found = html_text.extract_text(pages).drop("html")
    return found.select("page_id", F.length("text").cast("long").alias("n_chars"), "text")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = tables(sf_dir)
    docs = read(spark, "documents").select("doc_id", "text")
    scored = quality.score_quality(docs, read(spark, "labels"))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(sf_dir)(spark, "documents").select("doc_id", "text", "lang")
    found = langid.identify_languages(docs)
    return found.select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.size("language.spans").alias("n_spans")
    )


def op10_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(sf_dir)(spark, "documents").select("doc_id", "text")
    found = unigram.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", F.col("tokens.n_tokens").alias("n_tokens"), F.col("tokens.score").alias("score"))


def op11_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = tables(sf_dir)(spark, "embeddings").select("vec_id", "embedding", "label")
    coded, known = codebooks.compress(vectors)
    digests = {length: known.digest(length) for length in known.books}
    length = F.col("length")
    digest = F.coalesce(*(F.when(length == k, F.lit(v)) for k, v in digests.items()), F.lit(None).cast("string"))
    code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    found = codebooks.with_label_error(coded)
    return found.select("vec_id", code.alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables(sf_dir)(spark, "pages").select("page_id", "url")
    found = urls.judge(pages, urls.train(urls.labelled_urls(spark)), urls.RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "score")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(tables(sf_dir)(spark, "embeddings").select("vec_id", "embedding"))
    # The outer form keeps Spark from asking for the arrays' size first, which would project every vector twice.
    rows = found.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode_outer("whitened").alias("place", "whitened")).filter("place is not null")
    return rows.select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "whitened", F.col("explained")[F.col("place")].alias("explained"), "identity_error")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_topk": op2_topk,
        "op3_bpe": op3_bpe,
        "op4_chat": op4_chat,
        "op5_simhash": op5_simhash,
        "op6_tokenfile": op6_tokenfile,
        "op7_html": op7_html,
        "op8_quality": op8_quality,
        "op9_langid": op9_langid,
        "op10_unigram": op10_unigram,
        "op11_codebooks": op11_codebooks,
        "op12_urls": op12_urls,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": topk.ORACLE_SQL, "op4_chat": chat.ORACLE_SQL, "op11_codebooks": codebooks.oracle_sql()}
