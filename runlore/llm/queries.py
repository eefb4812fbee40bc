"""The operators applied to whole tables: names, queries and, where SQL can say it, DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .bpe import bpe_digests, read_ranks
from .html_text import main_text_column
from .jaccard import jaccard_components
from .language_id import fit_language_id, language
from .language_model import language_model_scores, train_language_model
from .line_dedup import LINE_DEDUP_SQL, drop_boilerplate_lines
from .mixing import each_row, mix_decisions
from .oracles import JACCARD_SQL, REPEATS_SQL
from .prefix_trie import conversation_keys, prefix_nodes, with_shared_starts
from .quality import fit_quality, quality
from .suffix_dedup import without_repeats
from .toxicity import fit_toxicity, toxicity_score
from .vector_search import TOP_K_SQL, top_k
from .whitening import whitened


def _remainder(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels of documents that are not held out: doc_id, held_out, score,
    predicted. A null id is not held out."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = fit_toxicity(docs, labels, where=lambda i: _remainder(i, 5) != 0)
    scored = docs.select("doc_id", toxicity_score(docs, model).alias("score"))
    return scored.select(
        "doc_id", F.coalesce(_remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without strings of 400 bytes that are found elsewhere too: doc_id, n_bytes,
    n_removed, n_spans, kept_sha256; and n_passage_bytes, has_passage (1 or 0): bytes covered by strings of 256 bytes that are
    found elsewhere too, about 45 words, of which those below 400 bytes stay."""
    small_batches(spark)
    found = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    covered = lambda spans: F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", covered("spans").alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"), covered("passages").alias("n_passage_bytes"), (F.size("passages") > 0).cast("int").alias("has_passage"),
    )


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars."""
    small_batches(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", main_text_column("html").alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("bigint"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents without lines on more than a tenth of their source's documents: doc_id, n_lines, n_removed, text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingles have a Jaccard similarity of 0.9 or more: doc_id, n_shingles,
    component_id."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = jaccard_components(docs, k=3, percent=90)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of what they decode to: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return docs.select("doc_id", bpe_digests(docs, ranks, public_tokenizers.PATTERN).alias("x")).select("doc_id", "x.*")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and the regression's verdict of every document: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, quality."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return docs.select("doc_id", quality(docs, model).alias("q")).select("doc_id", "q.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix's words of every document: doc_id, size, source_size, target, taken."""
    rows = each_row(mix_decisions(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 rows of greatest integer inner product for every vector whose id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 50 == 0)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document, learnt from nine tenths of them: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score, perplexity. A null id is not held out."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = lambda i: F.coalesce(_remainder(i, 10) == 0, F.lit(False))
    model = train_language_model(docs.filter(~held_out(F.col("doc_id"))))
    return language_model_scores(docs, model).select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score", "perplexity",
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every embedding on the 32 leading components: vec_id, component, n, deviation, whitened,
    explained, identity_error."""
    found = whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.withColumnRenamed("id", "vec_id")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    return prefix_nodes(with_shared_starts(conversation_keys(table(spark, sf_dir, "conversations"))))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that are not held out: doc_id, held_out, lang_pred, score. A null
    id is not held out, nor is it learnt from."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language_id(docs, where=_remainder(F.col("doc_id"), 4) != 2)
    held_out = F.coalesce(_remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held_out, language(docs, model).alias("x")).select("doc_id", "held_out", "x.*")


QUERIES = {"op1_toxicity": op1_toxicity, "op2_suffix_dedup": op2_suffix_dedup, "op3_html_text": op3_html_text, "op4_line_dedup": op4_line_dedup, "op5_jaccard": op5_jaccard, "op6_bpe": op6_bpe, "op7_quality": op7_quality, "op8_mixing": op8_mixing, "op9_top_k": op9_top_k, "op10_lm_score": op10_lm_score, "op11_whitening": op11_whitening, "op12_prefix_trie": op12_prefix_trie, "op13_language_id": op13_language_id}

ORACLES = {
    "op2_suffix_dedup": REPEATS_SQL, "op4_line_dedup": LINE_DEDUP_SQL, "op5_jaccard": JACCARD_SQL, "op9_top_k": TOP_K_SQL,
}
