"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringework.llm import ans, bpe, chat, common, hmm, langid, packing, quality, secretscan, simhash, topk


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = common.crc_mod("doc_id", 7) == 2
    out = hmm.score(common.table(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.groups(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hexadecimal(F.col("code")).alias("fingerprint"), "component_id")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    out = chat.format_chats(rows.unionByName(own))
    turns = chat.read_back(F.col("formatted"))
    out = out.withColumn("turns", turns).withColumn("loss", chat.loss_turns(F.col("turns")))
    said = F.concat_ws("", F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=0, capacity=2048)


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.report(common.table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = langid.train(docs, common.crc_mod("doc_id", 4) != 2)
    out = langid.predict(docs, model)
    return out.select("doc_id", (common.crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(common.table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_path(spark, "rans")
    ans.write(common.table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 2, folder)
    return ans.read(spark, folder).drop("ids")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(common.table(spark, sf_dir, "documents"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_lm_scoring, op2_simhash, op3_chat_formatting, op4_best_fit_packing, op5_secret_scans, op6_language_id, op7_bpe, op8_token_output, op9_quality_rules, op10_exact_top_k]
    return {f.__name__: f for f in own}


def _escaped(c: str) -> str:
    c = f"replace({c}, '\\', '\\0')"
    for i, s in enumerate(chat.DEFAULT.control, 1):
        c = f"replace({c}, '{s}', '\\{i:x}')"
    return c


def oracle_sql() -> dict[str, str]:
    t = chat.DEFAULT
    marks = " ".join(f"WHEN '{r}' THEN {len(o) + len(c)}" for r, (o, c, _) in t.turns.items())
    other = sum(map(len, t.other))
    return {
        "op3_chat_formatting": f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', NULL UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', NULL),
x AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    string_agg(role, ',' ORDER BY turn, role, text) AS roles,
    sum(length({_escaped("text")}) + CASE role {marks} ELSE {other} + length(replace({_escaped("role")}, chr(10), '\\n')) END) AS formatted_chars
  FROM r GROUP BY conv_id, alone)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars,
  regexp_full_match(roles, '(system,)?user,assistant(,user,assistant)*') AS valid
FROM x""",
        "op10_exact_top_k": """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM e AS q JOIN e AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
    }
