"""From raw documents to token ids: five stages, each over all that the stage before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lynxmark.llm import langid
from lynxmark.llm.bpe import Codec
from lynxmark.llm.common import TEXTS, fresh, materialize
from lynxmark.llm.mixing import Mix
from lynxmark.llm.secret_scan import SecretModel, find_secrets, redact, samples
from lynxmark.llm.simhash import drop_similar


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; texts that are null, empty or without a letter, or are in a script
    that no learnt language uses, go, and so do those whose likeliest language is nearly a blind guess.

    A null lang becomes the predicted one; all other values and columns stay, repeated rows
    are judged each for itself, and without a labelled document none is kept. No rows give none.
    """
    out = fresh(docs, "found")
    net = langid.train(docs, F.lit(True))
    found = langid.predict(docs, net, out=out)
    kept = found.where(langid.is_known(F.col(out), net))
    return materialize(kept.withColumn("lang", F.coalesce("lang", f"{out}.lang")).select(*docs.columns), "known", TEXTS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, likeness 0.8 or more.

    It is the one with the smallest id, null ids last. Null texts and texts without words are
    copies of each other, repeated rows too; texts of fewer than five words are one shingle.
    All columns stay as they are. No rows give none.
    """
    return drop_similar(docs, width=5, similarity=0.8)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts become a mark; every document stays, and n_chars, where there is such a column, follows where its text
    has changed. Null and empty texts stay as they are, repeated rows too. No rows give none."""
    out = fresh(docs, "found")
    found = find_secrets(docs, SecretModel.train(samples(spark)), out=out)
    clean = found.withColumn("text", redact(F.col("text"), F.col(out)))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.size(out) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources, a row for each pass over a document with the words that the pass takes, joined by one space.

    Documents of which no word is taken, null and empty ones among them, have no row. A null
    source is one of its own. Repeated rows and ids count each for themselves. n_chars, where
    there is such a column, is the row's; all other columns are the document's. No rows give none.
    """
    mixed = Mix(docs).mixed_documents()
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.length("text").cast("long"))
    return mixed.select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text's token ids, and what they decode to: the columns doc_id, lang, source, n_tokens, ids and decoded, and no
    others. Null and empty texts have no ids. Repeated rows stay. No rows give none."""
    codec = Codec(spark, public_tokenizers.path("word_bpe_49k.json"))
    both = docs.select("doc_id", "lang", "source", codec.round_trip(F.col("text")).alias("both"))
    return materialize(both.select("doc_id", "lang", "source", F.size("both.ids").cast("long").alias("n_tokens"), "both.ids", "both.decoded"), "tokens", TEXTS)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mix_sources", mix_sources), ("bpe", bpe)]
#: The stages' models cannot be written in SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
