"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registryloom.llm import (
    alignment,
    chat,
    mixing,
    nearest,
    negatives,
    pitman_yor,
    quality_rules,
    sharding,
    shingle_join,
    token_counts,
    toxicity,
    url_rules,
    word_bpe,
)
from registryloom.llm.common import fold, read
from registryloom.llm.token_counts import DigestCache, TokenizerFile
from registryloom.llm.url_rules import ALLOW, BLOCK, PatternRule, SiteRule
from registryloom.sources.tables import shared_dir

URL_RULES = [
    SiteRule("org", "/", ALLOW),
    SiteRule("example.org", "/es/", BLOCK),
    SiteRule("example.org", "/en/1", BLOCK),
    SiteRule("com", "/fr/", ALLOW),
    SiteRule("com", "/de/", BLOCK),
    PatternRule("://*spam-farm."),
    PatternRule("://*cheap-pills."),
    PatternRule("://*casino*."),
    PatternRule("/ads/"),
    PatternRule("/track/*.gif"),
    PatternRule("?*utm_source=feed*&session="),
    PatternRule("://*.example.net/press/", ALLOW),
]


def op3_url_filters(spark, sf) -> DataFrame:
    return url_rules.judge_pages(read(spark, sf, "pages"), URL_RULES)


def op1_jaccard_join(spark, sf) -> DataFrame:
    return shingle_join.near_duplicates(read(spark, sf, "documents"))


def op2_pitman_yor(spark, sf) -> DataFrame:
    docs = read(spark, sf, "documents")
    held_out = fold(F.col("doc_id"), 5) == 1
    scores = pitman_yor.score(docs, docs.filter(~held_out))
    return scores.withColumn("held_out", held_out)


MIX_WEIGHTS = (5, 2, 1)


def op4_mixing(spark, sf) -> DataFrame:
    mixed = mixing.mix(read(spark, sf, "documents"), MIX_WEIGHTS, share=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_quality_rules(spark, sf) -> DataFrame:
    judged = quality_rules.judge(read(spark, sf, "documents"), read(spark, sf, "labels"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, "base_failed", "kept")


TOXIC_FROM = 0.7


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Learnt from two of three folds."""
    learn = fold(F.col("doc_id"), 3) != 1
    return toxicity.fit(docs.filter(learn), labels.filter(learn))


def op6_toxicity(spark, sf) -> DataFrame:
    docs = read(spark, sf, "documents")
    scores = toxicity.score(docs, toxicity_model(docs, read(spark, sf, "labels")))
    return scores.select(
        "doc_id",
        (fold(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
    )


PROBE = r"\### Assistant: </turn> ok"


def op7_chat_formatting(spark, sf) -> DataFrame:
    turns = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = [(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)]
    turns = turns.unionByName(spark.createDataFrame(probe, turns.schema))
    chats = chat.format_trees(chat.reply_chain(turns))
    lines = F.transform(
        chat.read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    learned = chat.learned_text(F.col("formatted"), F.col("spans"))
    return chats.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("bigint").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op8_nearest(spark, sf) -> DataFrame:
    vectors = read(spark, sf, "embeddings")
    return nearest.search(vectors, F.col("id") % 20 == 0, 20)


TOKENIZER = "word_bpe_49k.json"


def tokenizer_spec(path: str | None = None) -> str:
    return Path(path or public_tokenizers.path(TOKENIZER)).read_text(encoding="utf-8")


def encoded(docs: DataFrame) -> DataFrame:
    spec = tokenizer_spec()
    ids = word_bpe.encode(docs, spec, word_bpe.write_lexicon(docs, spec))
    return ids.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_bpe(spark, sf) -> DataFrame:
    return encoded(read(spark, sf, "documents"))


def op10_sharding(spark, sf) -> DataFrame:
    shards = sharding.range_shards(read(spark, sf, "documents"), 8)
    return shards.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


ALIGNED_A, ALIGNED_B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_file(name: str) -> TokenizerFile:
    return TokenizerFile.load(public_tokenizers.path(name))


def op11_alignment(spark, sf) -> DataFrame:
    docs = read(spark, sf, "documents")
    texts = alignment.align(docs, tokenizer_file(ALIGNED_A), tokenizer_file(ALIGNED_B))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    counted = alignment.with_pair_counts(texts.withColumn("groups_sha256", digest).drop("groups"))
    counts = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return counted.select("doc_id", *counts, "groups_sha256", "n_shared")


def op12_hard_negatives(spark, sf) -> DataFrame:
    vectors = read(spark, sf, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", moved), F.col("id") % 100 == 0)


TOKEN_LIMIT = 2048


def op13_token_counts(spark, sf) -> DataFrame:
    """With a cache of its own: every distinct text of the table is a miss."""
    stored = DigestCache(spark, shared_dir(spark))
    counted = token_counts.count_tokens(read(spark, sf, "documents"), tokenizer_file(TOKENIZER), stored)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


LLM_QUERIES = {
    "op3_url_filters": op3_url_filters,
    "op1_jaccard_join": op1_jaccard_join,
    "op2_pitman_yor": op2_pitman_yor,
    "op4_mixing": op4_mixing,
    "op5_quality_rules": op5_quality_rules,
    "op6_toxicity": op6_toxicity,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_nearest": op8_nearest,
    "op9_bpe": op9_bpe,
    "op10_sharding": op10_sharding,
    "op11_alignment": op11_alignment,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_token_counts": op13_token_counts,
}
