"""Mixing sources to target weights, in tokens.

A source of ``available`` tokens that is to give ``wanted`` tokens gives ``wanted // available`` complete epochs of all its
documents; what is left is a fractional selection by Efraimidis-Spirakis sampling: a document of quality weight
``w`` gets the key ``-ln(u) / w`` of a uniform ``u`` drawn by hashing its id, documents are sorted by key within
their source, and those whose prefix sum of tokens fits the budget are taken.

The prefix sums are distributed: keys fall into order-preserving buckets (leading bits of the key, as in radix
selection), tokens are summed per source and bucket, and only the sort within a bucket is by document. So a
source that has a third of all documents is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.functions.keys import with_ordered_key
from tidewright.llm.bpe import TOKENIZERS, broadcast_ranks, token_count
from tidewright.operators.scan import join_on
from tidewright.session import cut_lineage

SEED = 20240501
#: Leading bits of a key that make its bucket: sign, exponent and 12 bits of the mantissa.
BUCKET_BITS = 24
#: Budgets up to this many sources are sent to all tasks; more meet the documents in a salted shuffle.
BROADCAST_SOURCES = 100_000
SALTS = 64


def quality_rules(text: Column) -> dict[str, Column]:
    """Published rules of thumb for running text (Rae et al. 2021, "Scaling language models", appendix A), each true if it holds.

    Words are separated by white space; texts in scripts without it break the rules on words and weigh less for that.
    """
    words = F.regexp_count(text, F.lit(r"\S+"))
    lines = F.regexp_count(text, F.lit(r"(?m)^.*\S.*$"))
    share = lambda pattern, of: F.try_divide(F.regexp_count(text, F.lit(pattern)), of)
    letters = F.try_divide(F.length(F.regexp_replace(text, r"\s", "")), words)
    return {
        "50 to 100,000 words": words.between(50, 100_000),
        "words of 3 to 10 characters on average": letters.between(3, 10),
        "four words in five have a letter": share(r"\S*\p{L}\S*", words) >= 0.8,
        "a hash sign or ellipsis for at most one word in ten": share(r"#|\.\.\.|\u2026", words) <= 0.1,
        "at most nine lines in ten begin with a bullet": share(r"(?m)^\s*[-*\u2022]", lines) <= 0.9,
        "at most three lines in ten end with an ellipsis": share(r"(?m)(?:\.\.\.|\u2026)\s*$", lines) <= 0.3,
    }


#: Least weight, so that every document can be drawn.
LEAST_WEIGHT = 0.02


def quality_weight(text: Column) -> Column:
    """1 for a text that keeps all ``quality_rules``; each broken rule divides it by three, down to ``LEAST_WEIGHT``."""
    broken = [F.when(F.coalesce(r, F.lit(False)), 0).otherwise(1) for r in quality_rules(text).values()]
    return F.greatest(F.lit(LEAST_WEIGHT), F.pow(F.lit(3.0), -sum(broken[1:], broken[0]).cast("double")))


def uniform(key: Column, seed: int) -> Column:
    """A number above 0 and below 1, drawn by hashing the key: the same on every run and partitioning."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11)
    return (bits.cast("double") + 0.5) / float(2**53)


def sized_documents(
    documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS, weight: Column | None = None, seed: int = SEED
) -> DataFrame:
    """Each document's source, tokens and sampling key, written once; texts are read in this step alone."""
    ranks = broadcast_ranks(documents.sparkSession, vocabulary, folder)
    w = quality_weight(F.col(text)) if weight is None else weight
    sized = documents.select(
        F.col(key).alias("doc_id"),
        F.col(source).alias("source"),
        token_count(F.col(text), ranks).alias("n_tokens"),
        (-F.ln(uniform(F.col(key), seed)) / w).alias("sampling_key"),
    )
    return cut_lineage(sized)


def source_budgets(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per target source: ``wanted`` tokens, complete ``epochs`` and the ``rest`` to select.

    ``wanted`` is the target share of ``total_tokens`` (all tokens of the documents by default), at most ``max_repeats``
    times what the source has. Defined results: targets with a NULL source or share, or a negative share, are
    left out, of several rows of a source the largest share counts; a NULL ``max_repeats`` means no
    repetition (1); a source without tokens gives nothing.
    """
    rows = targets.where(F.col("source").isNotNull() & (F.col("target_share") >= 0))
    rows = rows.groupBy("source").agg(F.max(F.struct("target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))).alias("t"))
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    whole = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("all_tokens"))
    plan = rows.join(have, "source", "left").crossJoin(F.broadcast(whole))  # one row
    total = F.col("all_tokens") if total_tokens is None else F.lit(total_tokens).cast("bigint")
    available = F.coalesce("available", F.lit(0)).cast("bigint")
    plan = plan.select("source", "t.target_share", "t.max_repeats", available.alias("available_tokens"), "all_tokens", total.cast("double").alias("total"))
    wanted = F.least(F.col("target_share") * F.col("total"), (F.greatest("max_repeats", F.lit(0)) * F.col("available_tokens")).cast("double"))
    plan = plan.withColumn("wanted", wanted)
    epochs = F.when(F.col("available_tokens") > 0, F.floor(F.col("wanted") / F.col("available_tokens"))).otherwise(F.lit(0)).cast("bigint")
    plan = plan.withColumn("epochs", epochs)
    return plan.withColumn("rest", F.col("wanted") - F.col("epochs") * F.col("available_tokens"))


def mix(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """The documents of the mix: ``doc_id``, ``source``, ``n_tokens`` and ``copies`` (how often it is used, 1 or more).

    Of the fractional selection the document at the border is taken if that brings the source nearer to its budget.
    Defined results: documents without tokens, without source or of no target source are not in the mix; rows
    that repeat a document are documents of their own; ties of keys are broken by id.
    """
    budgets = cut_lineage(source_budgets(sized, targets, total_tokens).where(F.col("wanted") > 0))
    plan, docs = budgets.select("source", "epochs", "rest"), sized.where(F.col("n_tokens") > 0)
    if budgets.count() <= BROADCAST_SOURCES:
        docs = docs.join(F.broadcast(plan), "source")
    else:
        salts = plan.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        docs = docs.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "sampling_key"), F.lit(SALTS)).cast("int")).join(salts, ["source", "__salt"]).drop("__salt")
    docs = with_ordered_key(docs, "sampling_key", "__key")
    docs = docs.withColumn("__bucket", F.shiftright("__key", 64 - BUCKET_BITS)).drop("__key")
    buckets = docs.groupBy("source", "__bucket").agg(F.sum("n_tokens").alias("__n"))
    earlier = W.partitionBy("source").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = buckets.select("source", "__bucket", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    placed = join_on(docs, buckets, ["source", "__bucket"])
    inside = W.partitionBy("source", "__bucket").orderBy("sampling_key", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("__before", F.col("__base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    taken = F.col("__before") + F.col("n_tokens") / 2 <= F.col("rest")
    copies = (F.col("epochs") + F.when(taken, 1).otherwise(0)).cast("int")
    return placed.select("doc_id", "source", "n_tokens", copies.alias("copies")).where(F.col("copies") > 0)


def mix_shares(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per target source what it was to give and what it gives: ``share_of_total`` is relative to the budget that the
    target shares apply to, ``share_of_mix`` to the tokens of the mix."""
    budgets = source_budgets(sized, targets, total_tokens)
    used = mix(sized, targets, total_tokens).groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies")
    )
    joined = budgets.join(used, "source", "left")
    mixed = F.coalesce("mixed", F.lit(0)).cast("bigint")
    every = F.sum("mixed_tokens").over(W.partitionBy(F.lit(1)))  # one row per target source
    joined = joined.withColumns({"mixed_tokens": mixed, "documents": F.coalesce("documents", F.lit(0)), "most_copies": F.coalesce("most_copies", F.lit(0))})
    return joined.select(
        "source",
        "target_share",
        "max_repeats",
        "available_tokens",
        "mixed_tokens",
        "documents",
        "most_copies",
        (F.col("mixed_tokens") / F.nullif(F.col("total"), F.lit(0.0))).alias("share_of_total"),
        (F.col("mixed_tokens") / F.nullif(every, F.lit(0))).alias("share_of_mix"),
        (F.col("wanted") < F.col("target_share") * F.col("total")).alias("capped"),
    )
