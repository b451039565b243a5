"""The corpus operators as registered queries: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.llm import ann
from lapwing.llm.alignment import align_documents
from lapwing.llm.chat import link_quotations
from lapwing.llm.common import read
from lapwing.llm.lexical import RANKED_SQL, ranked_search
from lapwing.llm.licenses import license_scan
from lapwing.llm.line_dedup import line_links
from lapwing.llm.mixing import MIX_SQL, mix
from lapwing.llm.ngram_join import near_duplicates
from lapwing.llm.oracles import JACCARD_SQL, LINES_SQL, SUBSTRING_SQL
from lapwing.llm.packing import pack
from lapwing.llm.quality import quality_report
from lapwing.llm.substring_dedup import remove_repeated_words
from lapwing.llm.suffix_dedup import remove_repeated_bytes
from lapwing.llm.toxicity import toxicity


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: counts, ``base_failed`` and the line rules' verdict ``kept``."""
    return quality_report(read(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per line that is not blank: its class, links to classes within the allowed edits, and whether it stays."""
    return line_links(read(spark, sf_dir, "documents"), least_chars=1)


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of each vector whose id is divisible by 50."""
    vectors = read(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter("vec_id % 50 = 0"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: bytes, bytes and spans that repeat text of an earlier document, and a digest of the rest."""
    out = remove_repeated_bytes(read(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return out.select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per piece of a document in a sequence of 2048 tokens or a smaller power of two."""
    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document and license found in it."""
    return license_scan(read(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in reply order, their bodies without quotations."""
    return link_quotations(read(spark, sf_dir, "conversations"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: its class of equal 5-gram sets, its component of near-duplicates and its links."""
    return near_duplicates(read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: words that the mix takes of it, and its source's size and target."""
    return mix(read(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: words, words under windows of 50 that an earlier document has, and a digest of the rest."""
    out = remove_repeated_words(read(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return out.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: its toxicity, and how many sentences offend and where the worst one stands."""
    out = toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    worst = F.array_max(F.transform("sentences", lambda s: F.struct(s["score"].alias("score"), (-s["start"]).alias("before"), s["stop"].alias("stop"))))
    return out.select(
        "doc_id", "held_out", "score", "predicted", F.size("sentences").cast("long").alias("n_offending"),
        (-worst["before"]).cast("long").alias("worst_start"), worst["stop"].cast("long").alias("worst_stop"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: tokens of two tokenizers, groups between common cuts, links, and how common the linked id pairs are."""
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align_documents(read(spark, sf_dir, "documents"), *paths, whole_groups=False)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents of highest lexical score for each benchmark item."""
    return ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_line_dedup": op2_line_dedup,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_packing": op5_packing,
    "op6_license_scan": op6_license_scan,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_mixing": op9_mixing,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_toxicity": op11_toxicity,
    "op12_token_alignment": op12_token_alignment,
    "op13_ranked_search": op13_ranked_search,
}

#: The others have no SQL form, or an approximate or free result; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op2_line_dedup": LINES_SQL,
    "op8_ngram_jaccard": JACCARD_SQL,
    "op9_mixing": MIX_SQL,
    "op10_substring_dedup": SUBSTRING_SQL,
    "op13_ranked_search": RANKED_SQL,
}
