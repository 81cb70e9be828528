"""Registered queries of this subpackage, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

import logging
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chat_format, decontaminate, embedding_dedup, filter_audit, html_extract, language_id, license_scan, mixing, packing, quality_pu, simhash_dedup, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _in_fold(key: Column, parts: int, fold: int) -> Column:
    """Whether crc32 of the key as text has the remainder `fold`; a null key has none."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == fold, F.lit(False))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted; digests of turns and of the trained text as read back. Null ids form one conversation, null texts are empty, repeated rows are repeated turns."""
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = chat_format.format_conversations(rows.select("conv_id", "turn", "role", chat_format.text_part(F.col("text")).alias("parts")))
    turns = chat_format.read_turns(F.col("formatted"))
    text = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), chat_format.unescape(t["body"]), F.lit("\n"))), "")
    loss = chat_format.loss_text(F.col("formatted"), F.col("loss_mask"))
    read = done.select("conv_id", F.size(turns).cast("long").alias("n_turns"), text.alias("_t"), loss.alias("_l"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select("conv_id", "n_turns", F.sha2("_t", 256).alias("turns_sha256"), F.length("_l").cast("long").alias("loss_chars"), F.sha2("_l", 256).alias("loss_sha256"), "formatted_chars")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page: "" for null, empty and text-free ones. One row per row of pages, repeated ones too."""
    done = html_extract.extract_pages(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences found in whole documents. Null, empty and wordless texts hold none; rows that repeat a doc_id are reported together."""
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors. Unusable vectors (null, zero, non-finite) stand alone; equal ones link; a null id names no component."""
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document. Null and wordless texts have size 0; a null source is one of its own, last; reruns agree."""
    _, found = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. Texts without words have fingerprint zero and link; a null id names no component."""
    return simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record per page, written and read back. Quarantined bytes of a damaged archive are logged, and are the result's `gaps`; a sound archive has none."""
    _, records = warc.archive_pages(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    kept, gaps = warc.split_gaps(records)
    n, size = gaps.agg(F.count("*"), F.sum("size")).first()
    if n:
        logging.getLogger(__name__).warning("%d gaps of %d bytes are in quarantine", n, size)
    out = kept.select(warc.page_id_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), warc.page_id_of(F.col("refers_to")).alias("refers_to"))
    out.gaps = gaps
    return out


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the best window. Null and wordless texts and items match nothing; repeated rows are reported each."""
    return decontaminate.find_contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document. Null texts and texts without letters are `und` with score 0; `rejected` is true for these and for texts too far from every language. A null id is never held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.filter(~_in_fold(F.col("doc_id"), 4, 2)))
    got = docs.select("doc_id", _in_fold(F.col("doc_id"), 4, 2).alias("held_out"), language_id.predict(F.col("text"), model).alias("p"))
    return got.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, empty and null texts too. A null id is never held out; repeated documents have equal scores."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality_pu.train(docs, labels.filter(~_in_fold(F.col("doc_id"), 5, 0)))
    got = docs.select("doc_id", _in_fold(F.col("doc_id"), 5, 0).alias("held_out"), quality_pu.score(F.col("text"), model).alias("score"))
    return got.select("doc_id", "held_out", "score", (F.col("score") >= quality_pu.CUT).cast("int").alias("predicted"))



def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers aligned in every document. Null and empty texts, and those that pieces can't give back, have zeros and an empty digest; repeated rows are documents of their own."""
    vocabulary, model = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    done = align.align(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, model, digest=True)
    return done.withColumnRenamed("groups", "groups_sha256")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens, a row for each piece. Null and empty texts are the id 0 alone; a null source is one of its own; repeated rows are packed each."""
    done = packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return done.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents in all 120 orders, counted by source. Null texts and sources are empty; repeated rows count each; an empty table gives no rows."""
    return filter_audit.audit(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), _table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_chat_formatting, op2_html_extraction, op3_license_scans, op4_embedding_near_dedup, op5_mixing, op6_simhash_near_dedup, op7_warc, op8_decontamination, op9_language_id, op10_quality, op11_token_alignment, op12_packing, op13_filter_audit)
}

_ESCAPED = r"regexp_replace(replace({0}, '\', '\\'), '([<\[])(/?(?:s>|(?:INST|IMG|AUD|DOC)\]))', '\1\\~\2', 'g')"

ORACLES: dict[str, str] = {
    "op1_chat_formatting": f"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS t,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS l,
    '<s>' || string_agg('[INST]' || {_ESCAPED.format("role")} || '[/INST]' || {_ESCAPED.format("text")} || '</s>', '' ORDER BY turn NULLS FIRST, role, text) AS f FROM m GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(t) AS turns_sha256, length(l)::BIGINT AS loss_chars, sha256(l) AS loss_sha256, length(f)::BIGINT AS formatted_chars FROM g""",
    "op3_license_scans": license_scan.oracle(),
    "op4_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
    "op5_mixing": mixing.oracle(),
    "op7_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f""",
    "op8_decontamination": decontaminate.oracle(),
    "op13_filter_audit": filter_audit.oracle(),
}
