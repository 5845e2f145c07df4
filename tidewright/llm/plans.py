"""The pN queries of percentiles and of the text problems. Operators on text have no SQL form; tests compare them with other means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import bpe, lookalikes, mixing, percentiles
from tidewright.operators.radix import exact_percentiles, quantile_name
from tidewright.operators.scan import join_on
from tidewright.sources.tables import table

# 4. percentiles of very large numeric columns

QUANTILES = (0.01, 0.05, 0.5, 0.95, 0.99)
NAMES = [quantile_name(q) for q in QUANTILES]
GROUPS = ["measure", "generator", "target", "batch"]


def measures(spark: SparkSession, sf: str) -> DataFrame:
    """Losses by generator, target and batch; returns and rolling correlations by generator."""
    losses = table(spark, sf, "path_losses").select(F.lit("loss").alias("measure"), "generator", "target", "batch", "run_day", F.col("loss").alias("value"))
    of = lambda name: F.struct(F.lit(name).alias("measure"), F.col(name).alias("value"))
    each = F.explode(F.array(of("btc_log_return"), of("eth_log_return"), of("rolling_correlation"))).alias("m")
    none = F.lit(None).cast("string")
    returns = table(spark, sf, "path_returns").select("generator", "run_day", each)
    returns = returns.select("m.measure", "generator", none.alias("target"), none.alias("batch"), "run_day", "m.value")
    return losses.unionByName(returns)


def _summaries(spark: SparkSession, sf: str) -> DataFrame:
    return percentiles.part_summaries(measures(spark, sf), GROUPS, "run_day", "value", QUANTILES)


def _rounded(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) + F.lit(0.0) for c in names})


def p4_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of every run_day from its own summary (scope day) and of all days from the combined ones (scope all).

    In single precision: 24 bits where the summary knows 13, so that engines that interpolate in another order agree."""
    daily = _summaries(spark, sf)
    every = daily.drop("run_day").withColumns({"scope": F.lit("all"), "run_day": F.lit(None).cast("date")})
    out = percentiles.summary_percentiles(daily.withColumn("scope", F.lit("day")).unionByName(every), ["scope", *GROUPS, "run_day"], QUANTILES)
    out = out.select("scope", *GROUPS, F.date_format("run_day", "yyyy-MM-dd").alias("run_day"), "n_values", *NAMES, "relative_error")
    return out.withColumns({n: F.col(n).cast("float") for n in NAMES})


def p4_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """The summaries of all run_days as they are stored, one row for each histogram."""
    return percentiles.packed(_summaries(spark, sf), GROUPS, "run_day").withColumn("run_day", F.date_format("run_day", "yyyy-MM-dd"))


def p4_exact_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(exact_percentiles(measures(spark, sf), GROUPS, "value", QUANTILES), NAMES)


def p4_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles from the combined summaries beside the exact ones: measured relative error, and whether the stated one holds."""
    found = percentiles.summary_percentiles(_summaries(spark, sf), GROUPS, QUANTILES)
    exact = exact_percentiles(measures(spark, sf), GROUPS, "value", QUANTILES)
    each = lambda df, cols: df.select(*GROUPS, F.explode(F.array(*[F.struct(F.lit(n).alias("quantile"), *[F.col(f"{n}{e}").alias(a) for e, a in cols]) for n in NAMES])).alias("x")).select(*GROUPS, "x.*")
    both = join_on(each(found, [("", "found"), ("_error", "most")]), each(exact, [("", "exact")]), [*GROUPS, "quantile"], "inner")
    gap = F.abs(F.col("found") - F.col("exact"))
    out = both.select(*GROUPS, "quantile", F.col("exact"), F.try_divide(gap, F.abs("exact")).alias("measured_error"), (gap <= F.col("most") * (1 + 1e-9)).alias("within_stated_error"))
    return out.withColumns({"exact": F.round("exact", 9) + F.lit(0.0), "measured_error": F.round("measured_error", 7) + F.lit(0.0)})


_P4_ROWS = """
with v as (
  select 'loss' measure, generator, target, batch, run_day, loss x from path_losses
  union all select 'btc_log_return', generator, null, null, run_day, btc_log_return from path_returns
  union all select 'eth_log_return', generator, null, null, run_day, eth_log_return from path_returns
  union all select 'rolling_correlation', generator, null, null, run_day, rolling_correlation from path_returns)
"""
# a bucket has the values that share sign, exponent and 12 bits of the mantissa; its midpoint stands for them
_P4_BUCKETS = """
, e as (select *, cast(floor(log2(abs(x))) as integer) g from v where x is not null and x <> 0),
s as (select *, g + case when abs(x) / power(2.0, g) >= 2 then 1 when abs(x) / power(2.0, g) < 1 then -1 else 0 end ex from e),
b as (
  select measure, generator, target, batch, run_day, x,
    sign(x) * (floor(abs(x) / power(2.0, ex) * 4096) + 0.5) / 4096 * power(2.0, ex) y from s
  union all select measure, generator, target, batch, run_day, x, x from v where x is null or x = 0)
"""
_G = ", ".join(GROUPS)


def _cuts(x: str, single: bool = False) -> str:
    cut = lambda q: f"cast(quantile_cont({x}, {q}) + 0.0 as float)" if single else f"round(quantile_cont({x}, {q}), 9) + 0.0"
    return ", ".join(f"{cut(q)} {n}" for q, n in zip(QUANTILES, NAMES))


def _scope_sql(scope: str, day: str, by: str) -> str:
    return f"select '{scope}' scope, {_G}, {day} run_day, count(x) n_values, {_cuts('y', True)}, case when count(x) > 0 then power(2.0, -13) end relative_error from b group by {by}"


# 7. to 9. text


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf, "documents"))


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.sized_documents(table(spark, sf, "documents"))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_sized(spark, sf), table(spark, sf, "mix_targets"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_shares(_sized(spark, sf), table(spark, sf, "mix_targets"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalikes.lookalike_pairs(table(spark, sf, "documents"))


def p9_classes(spark: SparkSession, sf: str) -> DataFrame:
    return lookalikes.lookalike_classes(table(spark, sf, "documents"))


def p9_forms(spark: SparkSession, sf: str) -> DataFrame:
    docs = lookalikes.unify_corpus(table(spark, sf, "documents"))
    return docs.select("doc_id", F.col("form"))


QUERIES = {
    "p4_percentiles": p4_percentiles,
    "p4_summaries": p4_summaries,
    "p4_exact_percentiles": p4_exact_percentiles,
    "p4_accuracy": p4_accuracy,
    "p7_ids": p7_ids,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_classes": p9_classes,
    "p9_forms": p9_forms,
}
ORACLE: dict[str, str] = {
    "p4_percentiles": _P4_ROWS + _P4_BUCKETS + _scope_sql("all", "cast(null as varchar)", _G) + " union all " + _scope_sql("day", "strftime(run_day, '%Y-%m-%d')", f"{_G}, run_day"),
    "p4_exact_percentiles": _P4_ROWS + f"select {_G}, count(x) n_values, {_cuts('x')} from v group by {_G}",
    # the exact values are those of the whole column; that none is further off than stated is what is checked
    "p4_accuracy": _P4_ROWS
    + _P4_BUCKETS
    + ", q as ("
    + " union all ".join(f"select {_G}, '{n}' quantile, quantile_cont(x, {q}) e, quantile_cont(y, {q}) f from b group by {_G}" for q, n in zip(QUANTILES, NAMES))
    + f") select {_G}, quantile, round(e, 9) + 0.0 exact, case when e <> 0 then round(abs(f - e) / abs(e), 7) + 0.0 end measured_error, case when e is not null then true end within_stated_error from q",
}
