"""The opN_ queries: each operator applied to its whole table, with production parameters."""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lynxmark.llm import fingerprints as sketches
from lynxmark.llm import brown, conversations, jaccard, langid, quantize
from lynxmark.llm.bpe import Codec
from lynxmark.llm.common import TEXTS, crc_fold, materialize
from lynxmark.llm.mixing import Mix
from lynxmark.llm.secret_scan import KINDS, SecretModel, find_secrets, listed, samples
from lynxmark.llm.simhash import near_duplicates
from lynxmark.llm.suffixes import repeated_passages
from lynxmark.llm.tokencount import TokenCounter
from lynxmark.llm.topk import top_k


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the sources' targets: what the mix takes of each."""
    mix = Mix(_table(spark, sf_dir, "documents"))
    return mix.documents().select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best integer inner products of every fiftieth vector id among all other rows."""
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint of three-word shingles and its component at two bits."""
    found = near_duplicates(_table(spark, sf_dir, "documents"), width=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def op4_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the class model and by the words' counts; a tenth of the ids is held out of training."""
    fold = crc_fold(F.col("doc_id"), 10)
    scored = brown.fit_and_score(_table(spark, sf_dir, "documents"), fold != 0, fold == 0)
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return scored.select(F.col("id").alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", perplexity.alias("perplexity"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sketch beside those of its edited text and of the next document."""
    rows = sketches.with_edits(_table(spark, sf_dir, "documents"))
    own, edited, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return rows.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketches.to_text(own).alias("fingerprint"), sketches.to_text(edited).alias("edited_fingerprint"),
        sketches.resemblance(own, edited).alias("near_edited"), sketches.resemblance(own, following).alias("near_next"), sketches.distinct_shingles(own).alias("distinct_shingles"), sketches.containment(own, edited).alias("contained_in_edited"),
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: the ids' number and digest, and the decoded text's."""
    codec = Codec(spark, public_tokenizers.path("word_bpe_49k.json"))
    both = _table(spark, sf_dir, "documents").select("doc_id", codec.round_trip(F.col("text")).alias("both")).select("doc_id", "both.ids", "both.decoded")
    told = both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    return materialize(told, "bpe", TEXTS)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learnt from three quarters of the labelled ids."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = crc_fold(F.col("doc_id"), 4)
    found = langid.predict(docs.select("doc_id", "text"), langid.train(docs, fold != 2), out="found")
    told = found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
    return materialize(told, "languages", TEXTS)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with its repeated passages."""
    found = repeated_passages(_table(spark, sf_dir, "documents"))
    sizes = F.transform("spans", lambda s: s["high"] - s["low"])
    told = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["low"].cast("string"), s["high"].cast("string"))), ",")
    return found.select(F.col("id").alias("doc_id"), "n_words", F.size("spans").cast("long").alias("n_spans"), F.aggregate(sizes, F.lit(0), lambda a, x: a + x).cast("long").alias("repeated_words"), told.alias("spans"))


def op9_token_counts(spark: SparkSession, sf_dir: str, limit: int = 4096) -> DataFrame:
    """Every document's tokens, counted in overlapping chunks where it is long."""
    counter = TokenCounter(spark, public_tokenizers.path("piece_bpe_32k.model"))
    counted = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), counter.count(F.col("text")).alias("n_tokens"))
    return materialize(counted.withColumn("over_limit", F.col("n_tokens") > limit), "counted", TEXTS)


def _is_kind(kind: int, secret: Column) -> Column:
    return secret["kind"] == kind


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: fixed patterns, and runs that the character models hold for random."""
    model = SecretModel.train(samples(spark))
    found = find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    n = [F.size(F.filter("secrets", partial(_is_kind, k))).cast("long") for k in range(len(KINDS))]
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    return found.select("doc_id", n[0].alias("n_assign"), n[1].alias("n_access"), n[2].alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"), n[3].alias("n_random"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after damage, its cheapest repair, and the digest of what that makes."""
    rows = _table(spark, sf_dir, "conversations")
    return conversations.repaired(rows, conversations.damage(rows))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code in eight parts of sixteen entries, and how far it is from what the code stands for."""
    codes = quantize.Quantizer(_table(spark, sf_dir, "embeddings")).codes_by_label()
    return codes.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its set of five-word shingles and its component at a likeness of 0.8."""
    found = jaccard.Join(_table(spark, sf_dir, "documents")).components()
    return found.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), "component_id")


OPERATORS = (
    op1_mix_sources, op2_exact_topk, op3_simhash_near_dedup, op4_brown_lm, op5_document_fingerprints, op6_bpe, op7_language_id, op8_suffix_dedup, op9_token_counts, op10_secret_scan, op11_conversation_repair,
    op12_vector_codes, op13_jaccard_join,
)
QUERIES = {f.__name__: f for f in OPERATORS}
#: The others cannot be written in SQL: each is held against a brute-force version in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op11_conversation_repair": conversations.SQL,
    "op12_vector_codes": quantize.sql(),
    "op13_jaccard_join": jaccard.SQL,
    "op2_exact_topk": """
        WITH sound AS (SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (SELECT q.uid AS quid, q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
            FROM sound q JOIN sound d ON q.uid <> d.uid WHERE q.vec_id % 50 = 0),
        ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY quid ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
}
