"""The registered queries of these operators, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm.runtime import materialize, scratch_path, table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chartloom.llm.token_store import read_token_store, write_token_store

    folder = scratch_path(spark, "token-store")
    manifest = write_token_store(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), folder)
    return read_token_store(manifest, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chartloom.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), with_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chartloom.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chartloom.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches: all documents; their counts revised to hold an end token each; texts without words deleted.  The first
    is sent twice."""
    from chartloom.llm.token_rollup import TokenRollup, count_tokens, deletes, inserts, revisions

    docs = table(spark, sf_dir, "documents")
    version = "byte_bpe_50k"
    counts = materialize(count_tokens(docs, _vocabulary("byte_bpe_50k.json"), version), "token-counts")
    revised = counts.withColumn("tokenizer", F.lit(version + "+end")).withColumn("n_tokens", F.col("n_tokens") + 1)
    rollup = TokenRollup(spark, scratch_path(spark, "token-rollup"))
    rollup.commit("documents", inserts(counts))
    rollup.commit("end tokens", revisions(counts, revised))
    rollup.commit("empty texts", deletes(revised.where("n_chars = 0")))
    rollup.commit("documents", inserts(counts))
    return rollup.totals()


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chartloom.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chartloom.llm.chat_format import format_conversations, loss_text, text_parts, turns_read_back

    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    out = format_conversations(rows.unionByName(extra).select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts")))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = out.select("conv_id", "formatted", turns_read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), c AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    sum(length(role) + length(text) + 23
        + 1 * (length(role) + length(text) - length(replace(replace(replace(role || text, chr(92), ''), '<', ''), '[', '')))) AS formatted_chars
  FROM m GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM c
"""


def op2_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chartloom.llm.span_dedup import remove_repeated_spans

    found = remove_repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "first_docs", "removed_chars", "text")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chartloom.llm.topk_search import quantised, top_k, usable

    vectors = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", quantised(F.col("embedding")).alias("weights"))
    return top_k(vectors.where("vec_id % 20 = 0"), vectors)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS query, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.query, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, query ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chartloom.llm.toxicity import fit_and_score, held_out

    docs = table(spark, sf_dir, "documents")
    scored = fit_and_score(docs, table(spark, sf_dir, "labels"), ["doc_id", "lang"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("rejected").alias("rejected_by_language"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chartloom.llm.weighted_sampling import edited_likeness

    return edited_likeness(table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chartloom.llm.importance_resampling import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chartloom.llm.conversation_repair import damaged, repair

    return repair(damaged(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_span_dedup": op2_span_dedup,
        "op3_top_k": op3_top_k,
        "op4_token_store": op4_token_store,
        "op5_bpe": op5_bpe,
        "op6_html": op6_html,
        "op7_decontaminate": op7_decontaminate,
        "op8_token_counts": op8_token_counts,
        "op9_simhash": op9_simhash,
        "op10_toxicity": op10_toxicity,
        "op11_fingerprints": op11_fingerprints,
        "op12_resampling": op12_resampling,
        "op13_repair": op13_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1_SQL, "op3_top_k": OP3_SQL}
