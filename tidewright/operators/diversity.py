"""Nearest neighbours of path vectors, duplicates, memorisation, coverage, and a linear discriminator.

A stated set of queries is searched against all rows in blocks: a block of queries, bounded in bytes, is sent to all tasks, each
task keeps the best of its own rows for every query, and these are merged. No pair table is built.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.functions.prng import draw
from tidewright.session import cut_lineage, ship_package

#: Bytes of query vectors sent to all tasks at once.
QUERY_BYTES = 32 << 20
#: Rows of the data side, and queries, compared at once in a task: two million distances at most.
ROWS_AT_ONCE = 2_048
QUERIES_AT_ONCE = 1_024
#: Share of the vectors' squared lengths by which rounding may raise a projected squared distance above the true one.
SLACK = 1e-9


def path_vectors(paths: DataFrame, returns: Sequence[str], keep: Sequence[str], path: str = "path_id", step: str = "step_no") -> DataFrame:
    """Each path as one vector: all steps of the first asset, then of the next."""
    ordered = F.array_sort(F.collect_list(F.struct(step, *returns)))
    rows = paths.groupBy(path, *keep).agg(ordered.alias("__s"))
    parts = [F.col("__s").getField(c) for c in returns]
    return rows.select(path, *keep, F.concat(*parts).alias("vector"))


def nearest(queries: DataFrame, rows: DataFrame, key: str = "id", vector: str = "vector", k: int = 1, exclude_self: bool = False, scale: Sequence[float] | None = None, project: int | None = None, keep: int = 8, seed: int = 7) -> DataFrame:
    """The ``k`` nearest rows of each query: ``query_id``, ``neighbour_id``, ``distance`` (root mean square difference).

    ``project`` looks at the span of that many random directions first (signs drawn portably) and compares the ``keep`` rows of each
    chunk and query that are nearest there. A distance within the span is at most the whole one, so it then compares every other
    row but those that are farther there than the ``k``-th found: the result is that of None, which compares all rows
    throughout. ``exclude_self`` leaves out rows with the query's own key.
    Ties are broken by key. Defined results: rows without vector are left out; no queries give no rows.
    """
    ship_package(queries.sparkSession)
    clean = lambda df: df.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    q, data = clean(queries), clean(rows)
    head = q.limit(1).collect()
    if not head:
        return data.limit(0).select(F.col("id").alias("query_id"), F.col("id").alias("neighbour_id"), F.lit(0.0).alias("distance"))
    width = len(head[0]["vector"])
    size = max(1, QUERY_BYTES // (8 * width))
    blocks = max(1, -(-q.count() // size))
    directions = None
    if project:
        rng = np.random.default_rng(seed)
        directions = np.linalg.qr(rng.choice([-1.0, 1.0], size=(width, project)))[0]  # orthonormal: no distance grows
    found = None
    order = W.partitionBy("query_id").orderBy("distance", "neighbour_id")
    for b in range(blocks):
        part = q if blocks == 1 else q.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        local = part.toPandas()  # one block of queries, bounded by QUERY_BYTES (twice that where hashing is uneven)
        if len(local):
            shared = queries.sparkSession.sparkContext.broadcast((local["id"].to_numpy(), np.vstack(local["vector"].to_numpy())))
            hits = data.mapInPandas(_search(shared, k, exclude_self, scale, directions, keep), "query_id bigint, neighbour_id bigint, distance double")
            hits = hits.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= k).drop("__rank")
            if blocks > 1:  # done with a block before the next is sent, so one block is held at a time
                hits = cut_lineage(hits)
                shared.destroy()
            found = hits if found is None else found.unionByName(hits)
    return found


class _Best:
    """The ``k`` nearest rows so far of a slice of the queries."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, directions: np.ndarray | None, k: int):
        self.ids, self.q, self.qp, self.k = ids, q, q if directions is None else q @ directions, k
        self.norms = (self.qp * self.qp).sum(axis=1)
        self.best = np.full((len(ids), k), np.inf)
        self.who = np.full((len(ids), k), np.iinfo(np.int64).max)

    def _merge(self, which, distances: np.ndarray, names: np.ndarray) -> None:
        every, who = np.hstack([self.best[which], distances]), np.hstack([self.who[which], names])
        order = np.lexsort((who, every), axis=1)[:, : self.k]
        self.best[which], self.who[which] = np.take_along_axis(every, order, axis=1), np.take_along_axis(who, order, axis=1)

    def look(self, own: np.ndarray, x: np.ndarray, xp: np.ndarray, first: int, exclude_self: bool, projected: bool) -> None:
        """Takes in a chunk of rows: the ``first`` nearest by ``xp``, and where that is a projection all that its bound leaves open."""
        sizes = self.norms[:, None] + (xp * xp).sum(axis=1)[None, :]
        d = sizes - 2 * self.qp @ xp.T
        if exclude_self:
            d[self.ids[:, None] == own[None, :]] = np.inf
        m = min(first, d.shape[1])
        near = np.argpartition(d, m - 1, axis=1)[:, :m]
        exact = np.sqrt(((self.q[:, None, :] - x[near]) ** 2).mean(axis=2))
        exact[~np.isfinite(np.take_along_axis(d, near, axis=1))] = np.inf
        self._merge(slice(None), exact, own[near])
        if projected:
            np.put_along_axis(d, near, np.inf, axis=1)
            left = np.isfinite(d) & (d - SLACK * sizes <= self.best[:, -1:] ** 2 * self.q.shape[1])
            for i in np.flatnonzero(left.any(axis=1)):
                at = np.flatnonzero(left[i])
                self._merge(slice(i, i + 1), np.sqrt(((self.q[i] - x[at]) ** 2).mean(axis=1))[None, :], own[at][None, :])


def _search(shared, k: int, exclude_self: bool, scale, directions, keep: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        by = 1.0 if scale is None else np.asarray(scale)
        slices = [_Best(ids[at : at + QUERIES_AT_ONCE], q[at : at + QUERIES_AT_ONCE] / by, directions, k) for at in range(0, len(ids), QUERIES_AT_ONCE)]
        for pdf in batches:
            for at in range(0, len(pdf), ROWS_AT_ONCE):
                chunk = pdf.iloc[at : at + ROWS_AT_ONCE]
                own, x = chunk["id"].to_numpy(), np.vstack(chunk["vector"].to_numpy()) / by
                xp = x if directions is None else x @ directions
                for s in slices:
                    s.look(own, x, xp, k if directions is None else max(k, keep), exclude_self, directions is not None)
        for s in slices:
            good = np.isfinite(s.best)
            yield pd.DataFrame({"query_id": np.repeat(s.ids, k)[good.ravel()], "neighbour_id": s.who[good], "distance": s.best[good]})

    return run


def rounded_key(vector: Column, decimals: int = 12) -> Column:
    """A digest of a vector rounded half to even; -0.0 counts as 0.0."""
    rounded = F.transform(vector, lambda x: F.bround(x, decimals) + F.lit(0.0))
    return F.md5(F.concat_ws(",", F.transform(rounded, lambda x: x.cast("string"))))


def unique_fraction(vectors: DataFrame, groups: Sequence[str], vector: str = "vector", decimals: int = 12) -> DataFrame:
    """Share of distinct vectors after rounding, and of redundant ones."""
    distinct = vectors.groupBy(*groups, rounded_key(F.col(vector), decimals).alias("__d")).agg(F.count(F.lit(1)).alias("__n"))
    out = distinct.groupBy(*groups).agg(F.sum("__n").alias("n"), F.count(F.lit(1)).alias("distinct_n"))
    share = F.col("distinct_n") / F.col("n")
    return out.withColumns({"unique_fraction": share, "redundant_fraction": 1 - share})


def exact_matches(candidates: DataFrame, training: DataFrame, groups: Sequence[str], vector: str = "vector", decimals: int = 12) -> DataFrame:
    """Share of candidate vectors that occur among the training vectors."""
    known = training.select(rounded_key(F.col(vector), decimals).alias("__d")).distinct().withColumn("__hit", F.lit(1))
    joined = candidates.withColumn("__d", rounded_key(F.col(vector), decimals)).join(known, "__d", "left")
    return joined.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.count("__hit").alias("matches"), (F.count("__hit") / F.count(F.lit(1))).alias("exact_match_fraction"))


#: Labelled rows of each class that a discriminator is fitted on at most.
DISCRIMINATOR_ROWS = 2_000


def _fit_and_score(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, steps: int = 500, rate: float = 0.1, l2: float = 1e-3) -> float:
    """Balanced held-out accuracy of a logistic regression by gradient descent, at least 0.5."""
    fit, held = [], []
    for c in (0, 1):  # the same share of either class is held out
        own = rng.permutation(np.flatnonzero(y == c))
        cut = min(max(round(0.7 * len(own)), 1), len(own) - 1)
        fit.append(own[:cut])
        held.append(own[cut:])
    fit, held = np.concatenate(fit), np.concatenate(held)
    mean, sd = x[fit].mean(axis=0), x[fit].std(axis=0)
    z = (x - mean) / np.where(sd == 0, 1.0, sd)
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z[fit] @ w + b, -30, 30)))
        gap = p - y[fit]
        w -= rate * (z[fit].T @ gap / len(fit) + l2 * w)
        b -= rate * gap.mean()
    said = z[held] @ w + b > 0
    rates = [(said[y[held] == c] == bool(c)).mean() for c in (0, 1) if (y[held] == c).any()]
    return max(0.5, float(np.mean(rates))) if rates else 0.5


def discriminator(features: DataFrame, columns: Sequence[str], candidates: Sequence[str], reference: str = "reference", repetitions: int = 5, most: int = DISCRIMINATOR_ROWS, seed: int = 42) -> DataFrame:
    """How well a linear classifier tells each candidate's paths from the reference's: accuracy over repetitions.

    Each repetition takes up to ``most`` rows of each class in the order of portable random numbers, as many of both.
    """
    ship_package(features.sparkSession)
    rows = features.select("path_id", "side", *columns).na.drop()
    picks = []
    for name in candidates:
        both = rows.where(F.col("side").isin(name, reference)).withColumn("candidate", F.lit(name))
        picks.append(both.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1)))))
    every = picks[0]
    for p in picks[1:]:
        every = every.unionByName(p)
    order = W.partitionBy("candidate", "rep", "side").orderBy(draw(seed, F.col("rep"), F.col("path_id")), "path_id")
    sample = every.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= most).drop("__rank")
    names = list(columns)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rep, name = int(pdf["rep"].iloc[0]), pdf["candidate"].iloc[0]
        pdf = pdf.sort_values("path_id")
        real, fake = pdf[pdf["side"] == reference], pdf[pdf["side"] != reference]
        n = min(len(real), len(fake))
        if n < 4:
            return pd.DataFrame({"candidate": [name], "rep": [rep], "rows": [2 * n], "accuracy": [0.5]})
        rng = np.random.default_rng(seed + rep)
        take = lambda d: d.iloc[np.sort(rng.permutation(len(d))[:n])][names].to_numpy(dtype=float)
        x = np.vstack([take(real), take(fake)])
        y = np.repeat([0.0, 1.0], n)
        return pd.DataFrame({"candidate": [name], "rep": [rep], "rows": [2 * n], "accuracy": [_fit_and_score(x, y, rng)]})

    each = sample.groupBy("candidate", "rep").applyInPandas(run, "candidate string, rep int, rows bigint, accuracy double")
    return each.groupBy("candidate").agg(F.max("rows").alias("rows"), F.avg("accuracy").alias("accuracy_mean"), F.coalesce(F.stddev_samp("accuracy"), F.lit(0.0)).alias("accuracy_deviation"))
