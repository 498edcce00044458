"""The training-data operators on the given tables: one query each, with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm import alignment, chat, decontaminate, dom, jaccard, langid, pieces, pii, quality, sharding, spelling, syncmers, warc
from flowspark.llm.common import held_out, table

SQL: dict[str, str] = {}

#: The tokenizers' files; another installation sets them before it builds the queries.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) with a contaminated passage."""
    docs, bench = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontaminate.contaminated(docs, bench)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = [spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(t).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(odd).alias("text")) for t, r in enumerate(("user", "assistant"))]
    made = chat.format_events(chat.conversation_events(rows.unionByName(more[0]).unionByName(more[1])))
    back = made.withColumn("turns", chat.parse(F.col("formatted"))).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_spans")))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL["op10_chat_formatting"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
  CAST(sum(8 + length(role) + length(text) + (length(text) - length(replace(text, '\', '')))
    + len(regexp_extract_all(text, '<s>|</s>|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign_shards(table(spark, sf_dir, "documents"), shards=8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, told by count and hash, and whether they decode to the text."""
    model = pieces.load(PIECE_MODEL)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = pieces.decode(pieces.encode(docs, model), model)
    text = F.coalesce("text", F.lit(""))
    return done.select("doc_id", F.length(text).cast("long").alias("n_chars"), F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), (F.col("decoded") == text).alias("round_trip"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.detect(docs.select("doc_id", "text"), langid.fit(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three replicas of the pages as archived records; replica 1 has damaged payloads, replica 2 has lost records."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    good = warc.record(F.col("url"), F.col("html"), F.col("page_id"))
    bad = warc.record(F.col("url"), F.concat(F.lit("#"), F.substring("html", 2, 2**31 - 1)), F.col("page_id"))
    digest, damaged = F.sha2(good, 256), F.coalesce(F.col("page_id") % 97 == 5, F.lit(False))
    copies = F.array(
        F.struct(F.lit(0).alias("replica"), F.col("digest").alias("digest")),
        F.struct(F.lit(1).alias("replica"), F.when(F.col("damaged"), F.col("bad")).otherwise(F.col("digest")).alias("digest")),
        F.struct(F.lit(2).alias("replica"), F.when(F.coalesce(F.col("page_id") % 89 == 7, F.lit(False)), F.lit(None)).otherwise(F.col("digest")).alias("digest")),
    )
    listed = pages.select(
        "page_id", warc.file_of(F.col("page_id"), F.col("url")).alias("file"), F.length(good).cast("long").alias("length"), digest.alias("digest"),
        damaged.alias("damaged"), F.when(damaged, F.sha2(bad, 256)).alias("bad"),
    )
    listed = warc.cut(warc.place_records(listed))
    leaves = listed.select("file", "offset", "length", F.explode(copies).alias("c")).select("file", "offset", "length", "c.*").where("digest is not null")
    found = warc.audit(leaves)
    return found.join(listed.select("file", "offset", "page_id", "length").distinct(), ["file", "offset"]).select("page_id", "file", "offset", "length", "replica", "kind")


SQL["op6_warc_fixity"] = r"""
WITH r AS (
  SELECT page_id, 'part-' || CAST(page_id // 256 AS VARCHAR) AS file,
    CAST(strlen('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
      || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
      || 'Content-Length: ' || strlen(html) || chr(13) || chr(10)) + 2 + strlen(html) + 4 AS BIGINT) AS length
  FROM pages),
o AS (SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM r)
SELECT page_id, file, "offset", length, 1 AS replica, 'altered' AS kind FROM o WHERE page_id % 97 = 5 AND page_id % 89 <> 7
UNION ALL SELECT page_id, file, "offset", length, 2, 'missing' FROM o WHERE page_id % 89 = 7 AND page_id % 97 <> 5
UNION ALL SELECT page_id, file, "offset", length, unnest([0, 1, 2]), 'unsettled' FROM o WHERE page_id % 89 = 7 AND page_id % 97 = 5
"""

def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), n=4, percent=85)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    done = dom.extract(pages, dom.fit(pages))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs))
    count = lambda kind: F.size(F.filter("all_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    written_out = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(written_out("base_spans").cast("binary"), 256).alias("base_sha256"), written_out("all_spans").alias("spans"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), alignment.load(BYTE_MODEL, PIECE_MODEL))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the corpus, with letters lost by a hash of document and word, folded into their frequent near words."""
    words = spelling.word_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), change=spelling.drop_letter(199))
    return spelling.group_variants(words)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline at the top of the repository."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontamination, op2_sharding, op3_quality, op4_sentencepiece, op5_language_id, op6_warc_fixity, op7_ngram_jaccard, op8_fingerprints, op9_html_extraction, op10_chat_formatting, op11_personal_data, op12_token_alignment, op13_spelling, pipeline)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
