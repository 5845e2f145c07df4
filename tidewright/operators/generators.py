"""Generators of scenario paths: block bootstrap, bivariate Student-t, conditional coupling flow; and augmentation sets."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.prng import draw
from tidewright.operators.ranks import ranked
from tidewright.operators.scan import join_on
from tidewright.operators.windows import at_home, frames, numbered, sharded
from tidewright.session import cut_lineage, ship_package


def block_starts(returns: DataFrame, entity: str, length: int) -> DataFrame:
    """Where all blocks of ``length`` successive valid returns begin: ``tick_no`` and ``block_no`` from 0 within the entity.

    ``returns`` has every tick, ``tick_no`` and ``returns_valid``; segments shorter than a block give none.
    """
    if length < 1:
        raise ValueError("blocks have at least one step")
    ahead = frames(entity).rowsBetween(0, length - 1)
    whole = F.sum(F.col("returns_valid").cast("int")).over(ahead) == length
    starts = sharded(returns.select(entity, "tick_no", "returns_valid"), entity, 0, length - 1).withColumn("__whole", whole)
    return numbered(starts.where(F.col("__whole") & at_home()).select(entity, "tick_no"), entity, "tick_no", "block_no")


def block_bootstrap(returns: DataFrame, entity: str, columns: Sequence[str], length: int, paths: int, horizon: int, seed: int = 5042) -> DataFrame:
    """``paths`` paths of ``horizon`` steps per entity, of blocks drawn uniformly with replacement, cut at the horizon.

    Only drawn blocks are laid out in steps.
    """
    starts = block_starts(returns, entity, length)
    counts = starts.groupBy(entity).agg((F.max("block_no") + 1).alias("__blocks"))
    wanted = -(-horizon // length)
    draws = counts.select(entity, "__blocks", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(paths - 1).cast("bigint"))).alias("path_no"))
    draws = draws.select("*", F.explode(F.sequence(F.lit(0), F.lit(wanted - 1))).alias("__j"))
    draws = draws.select(entity, "path_no", "__j", F.pmod(draw(seed, F.col(entity), F.col("path_no"), F.col("__j")), F.col("__blocks")).alias("block_no"))
    drawn = join_on(draws, starts, [entity, "block_no"], "inner")
    steps = drawn.select(entity, "path_no", "__j", F.col("tick_no").alias("__from"), F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("__k"))
    steps = steps.select(entity, "path_no", (F.col("__j") * length + F.col("__k")).cast("bigint").alias("step_no"), (F.col("__from") + F.col("__k")).alias("tick_no")).where(F.col("step_no") < horizon)
    return join_on(steps, returns.select(entity, "tick_no", *columns), [entity, "tick_no"], "inner").select(entity, "path_no", "step_no", *columns)


def nested_subsets(pool: DataFrame, groups: Sequence[str], key: str, ratios: Sequence[float], seed: int = 42) -> DataFrame:
    """Nested random subsets of each group: a row per ratio and member. Sizes are rounded half to even."""
    if not ratios or min(ratios) <= 0 or max(ratios) > 1:
        raise ValueError("ratios must be above 0 and at most 1")
    drawn = pool.select(*groups, key).distinct().withColumn("__u", draw(seed, F.col(key)).cast("double"))
    sizes = drawn.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n"))
    placed = ranked(drawn, groups, "__u", [key], "__rank").withColumn("__rank", F.col("__rank") + 1)
    placed = join_on(placed, sizes, groups)
    labels = F.array(*[F.struct(F.lit(f"{round(r * 100):03d}pct").alias("subset"), F.lit(float(r)).alias("ratio")) for r in sorted(set(ratios))])
    each = placed.select("*", F.explode(labels).alias("__s"))
    return each.where(F.col("__rank") <= F.bround(F.col("__n") * F.col("__s.ratio"))).select(*groups, key, F.col("__s.subset").alias("subset"))


#: Vectors that a flow samples at once in a task.
SAMPLES_AT_ONCE = 65_536


def uniforms(keys: np.ndarray, count: int, seed: int) -> np.ndarray:
    """``count`` numbers above 0 and below 1 for each row of integer ``keys``, by counter: they depend on seed and keys alone.

    The mixing function is the finaliser of splitmix64.
    """

    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    golden = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        state = mix(np.full(len(keys), seed, np.int64).view(np.uint64) + golden)
        for c in range(keys.shape[1]):
            state = mix(state + np.ascontiguousarray(keys[:, c], np.int64).view(np.uint64) + golden)
        bits = mix(state[:, None] + np.arange(1, count + 1, dtype=np.uint64)[None, :] * golden)
    return ((bits >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def normals(u: np.ndarray) -> np.ndarray:
    """Standard normal numbers of pairs of uniform ones (Box and Muller)."""
    r, angle = np.sqrt(-2 * np.log(u[:, 0::2])), 2 * np.pi * u[:, 1::2]
    out = np.empty_like(u)
    out[:, 0::2], out[:, 1::2] = r * np.cos(angle), r * np.sin(angle)
    return out


def chi_square(u: np.ndarray, df: float) -> np.ndarray:
    """Chi-square numbers of uniform ones, by the inverse of a distribution function tabulated on a fine grid."""
    grid = np.linspace(0.0, 1.0, 20_001)[1:] ** 3 * (df + 60 * np.sqrt(2 * df))
    density = np.exp((df / 2 - 1) * np.log(grid) - grid / 2 - df / 2 * np.log(2.0) - lgamma(df / 2))
    grid = np.append(0.0, grid)
    density = np.append(0.0 if df > 2 else density[0], density)
    share = np.append(0.0, np.cumsum((density[1:] + density[:-1]) / 2 * np.diff(grid)))
    return np.interp(u, share / share[-1], grid)


def student_t_pairs(rows: DataFrame, df: float = 5.0, seed: int = 7, ids: Sequence[str] = ("row_id",)) -> DataFrame:
    """Bivariate Student-t draws: ``rows`` has the integers ``ids``, locations m0, m1, raw scales s0, s1 and raw correlation c.

    Scales are softplus plus 1e-3, the correlation 0.95 tanh; both assets share one chi-square denominator. Draws are seeded by
    the ids of the row, so they do not depend on the partitioning.
    """
    ids = list(ids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            z = np.empty((len(pdf), 3))
            u = uniforms(pdf[ids].to_numpy(), 4, seed)
            z[:, :2] = normals(u[:, :2])
            z[:, 2] = chi_square(u[:, 2], df)
            scale = np.logaddexp(0, pdf[["s0", "s1"]].to_numpy()) + 1e-3
            rho = 0.95 * np.tanh(pdf["c"].to_numpy())
            shrink = np.sqrt(df / z[:, 2])
            x = pdf["m0"].to_numpy() + scale[:, 0] * z[:, 0] * shrink
            y = pdf["m1"].to_numpy() + scale[:, 1] * (rho * z[:, 0] + np.sqrt(1 - rho**2) * z[:, 1]) * shrink
            yield pdf[ids].assign(x=x, y=y)

    ship_package(rows.sparkSession)
    keys = [F.col(c).cast("bigint").alias(c) for c in ids]
    return rows.select(*keys, "m0", "m1", "s0", "s1", "c").mapInPandas(run, ", ".join(f"{c} bigint" for c in ids) + ", x double, y double")


@dataclass
class CouplingFlow:
    """Conditional affine coupling flow in NumPy: fitted by gradient descent, applied to DataFrames in Arrow batches.

    Each coupling permutes the dimensions, keeps one half and shifts and scales the other by a network of the kept half and
    the condition; log-scales are bounded by ``bound * tanh``. The density is that of a standard normal base.
    """

    dim: int
    condition_dim: int = 0
    couplings: int = 4
    hidden: int = 32
    bound: float = 2.0
    seed: int = 0
    weights: list[dict[str, np.ndarray]] = field(default_factory=list)
    history: list[float] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.dim < 2 or self.couplings < 1:
            raise ValueError("a flow has at least two dimensions and one coupling")
        rng = np.random.default_rng(self.seed)
        half = self.dim // 2
        self.orders = [np.arange(self.dim) if i == 0 else rng.permutation(self.dim) for i in range(self.couplings)]
        if not self.weights:
            for _ in range(self.couplings):
                fan = half + self.condition_dim
                first = rng.normal(0, 1 / np.sqrt(max(fan, 1)), (fan, self.hidden))
                last = rng.normal(0, 1e-2, (self.hidden, 2 * (self.dim - half)))
                self.weights.append({"w1": first, "b1": np.zeros(self.hidden), "w2": last, "b2": np.zeros(last.shape[1])})

    def _net(self, w: dict[str, np.ndarray], kept: np.ndarray, cond: np.ndarray | None):
        into = kept if cond is None else np.hstack([kept, cond])
        pre = into @ w["w1"] + w["b1"]
        gate = 1 / (1 + np.exp(-np.clip(pre, -60, 60)))
        act = pre * gate
        raw = act @ w["w2"] + w["b2"]
        n = raw.shape[1] // 2
        squash = np.tanh(raw[:, n:] / self.bound)
        return raw[:, :n], self.bound * squash, (into, pre, gate, act, squash)

    def forward(self, x: np.ndarray, cond: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Base coordinates and log absolute determinant."""
        z, logdet, half = np.asarray(x, float), np.zeros(len(x)), self.dim // 2
        for order, w in zip(self.orders, self.weights):
            z = z[:, order]
            shift, scale, _ = self._net(w, z[:, :half], cond)
            z = np.hstack([z[:, :half], (z[:, half:] - shift) * np.exp(-scale)])
            logdet -= scale.sum(axis=1)
        return z, logdet

    def inverse(self, z: np.ndarray, cond: np.ndarray | None = None) -> np.ndarray:
        x, half = np.asarray(z, float), self.dim // 2
        for order, w in zip(reversed(self.orders), reversed(self.weights)):
            shift, scale, _ = self._net(w, x[:, :half], cond)
            x = np.hstack([x[:, :half], x[:, half:] * np.exp(scale) + shift])
            back = np.empty_like(x)
            back[:, order] = x
            x = back
        return x

    def log_prob(self, x: np.ndarray, cond: np.ndarray | None = None, per_dimension: bool = False) -> np.ndarray:
        z, logdet = self.forward(x, cond)
        out = logdet - 0.5 * (z * z).sum(axis=1) - 0.5 * self.dim * np.log(2 * np.pi)
        return out / self.dim if per_dimension else out

    def _gradients(self, x: np.ndarray, cond: np.ndarray | None):
        """Mean negative log-likelihood and its gradient with respect to all weights."""
        half, z, kept = self.dim // 2, x, []
        loss = 0.5 * self.dim * np.log(2 * np.pi)
        for order, w in zip(self.orders, self.weights):
            z = z[:, order]
            shift, scale, cache = self._net(w, z[:, :half], cond)
            moved = (z[:, half:] - shift) * np.exp(-scale)
            kept.append((scale, moved, cache))
            loss += scale.sum(axis=1).mean()
            z = np.hstack([z[:, :half], moved])
        loss += 0.5 * (z * z).sum(axis=1).mean()
        n, g, grads = len(x), z / len(x), []
        for order, w, (scale, moved, (into, pre, gate, act, squash)) in zip(reversed(self.orders), reversed(self.weights), reversed(kept)):
            g_moved = g[:, half:]
            g_shift = -g_moved * np.exp(-scale)
            g_scale = (-g_moved * moved + 1 / n) * (1 - squash**2)
            g_raw = np.hstack([g_shift, g_scale])
            g_act = g_raw @ w["w2"].T
            g_pre = g_act * (gate + pre * gate * (1 - gate))
            grads.append({"w1": into.T @ g_pre, "b1": g_pre.sum(axis=0), "w2": act.T @ g_raw, "b2": g_raw.sum(axis=0)})
            g_in = g_pre @ w["w1"].T
            g = np.hstack([g[:, :half] + g_in[:, :half], g_moved * np.exp(-scale)])
            back = np.empty_like(g)
            back[:, order] = g
            g = back
        return loss, grads[::-1]

    def _moments(self) -> dict:
        zeros = lambda: [{k: np.zeros_like(v) for k, v in w.items()} for w in self.weights]
        return {"t": 0, "m": zeros(), "s": zeros()}

    def _epoch(self, x: np.ndarray, cond: np.ndarray | None, moments: dict, rng: np.random.Generator, batch: int, rate: float, decay: float, clip: float) -> None:
        """One pass over the rows in mini-batches of a fresh permutation, by AdamW with clipped gradients."""
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            pick = order[at : at + batch]
            moments["t"] += 1
            loss, grads = self._gradients(x[pick], None if cond is None else cond[pick])
            if not np.isfinite(loss):
                raise FloatingPointError("the likelihood is not finite")
            shrink = min(1.0, clip / (np.sqrt(sum((g * g).sum() for gr in grads for g in gr.values())) + 1e-12))
            for w, gr, m, s in zip(self.weights, grads, moments["m"], moments["s"]):
                for k in w:
                    g = gr[k] * shrink
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    w[k] -= rate * (m[k] / (1 - 0.9 ** moments["t"]) / (np.sqrt(s[k] / (1 - 0.999 ** moments["t"])) + 1e-8) + decay * w[k])

    def _flat(self, moments: dict) -> np.ndarray:
        return np.concatenate([w[k].ravel() for part in (self.weights, moments["m"], moments["s"]) for w in part for k in ("w1", "b1", "w2", "b2")])

    def _unflat(self, flat: np.ndarray, moments: dict) -> None:
        at = 0
        for part in (self.weights, moments["m"], moments["s"]):
            for w in part:
                for k in ("w1", "b1", "w2", "b2"):
                    w[k] = flat[at : at + w[k].size].reshape(w[k].shape).copy()
                    at += w[k].size

    def fit(self, x: np.ndarray, cond: np.ndarray | None = None, epochs: int = 60, batch: int = 256, rate: float = 1e-3, patience: int = 10, decay: float = 1e-4, clip: float = 5.0) -> "CouplingFlow":
        """AdamW on a 90/10 split: the rate halves on plateaus, gradients are clipped, the best state is kept."""
        x = np.asarray(x, float)
        rng = np.random.default_rng(self.seed + 1)
        order = rng.permutation(len(x))
        held, train = order[: max(1, len(x) // 10)], order[max(1, len(x) // 10) :]
        pick = lambda i: (x[i], None if cond is None else cond[i])
        state_of = self._moments()
        best, state, bad = np.inf, None, 0
        for _ in range(epochs):
            self._epoch(*pick(train), state_of, rng, batch, rate, decay, clip)
            score = -float(self.log_prob(*pick(held)).mean())
            self.history.append(score)
            if score < best - 1e-4:
                best, bad, state = score, 0, [{k: v.copy() for k, v in w.items()} for w in self.weights]
            else:
                bad += 1
                if bad % 4 == 0:
                    rate /= 2
                if bad >= patience:
                    break
        if state:
            self.weights = state
        return self

    def save(self, path: str) -> None:
        arrays = {f"{k}_{i}": v for i, w in enumerate(self.weights) for k, v in w.items()}
        config = {k: v for k, v in asdict(self).items() if k not in ("weights",)}
        np.savez(path, config=np.array(json.dumps(config)), **arrays)

    @classmethod
    def load(cls, path: str) -> "CouplingFlow":
        with np.load(path, allow_pickle=False) as data:
            config = json.loads(str(data["config"]))
            weights = [{k: data[f"{k}_{i}"] for k in ("w1", "b1", "w2", "b2")} for i in range(config["couplings"])]
        return cls(**config, weights=weights)

    def score(self, rows: DataFrame, key: str, vector: str, condition: str | None = None) -> DataFrame:
        """``key`` and ``log_prob`` of each row's vector, in Arrow batches."""
        shared = ship_package(rows.sparkSession).sparkContext.broadcast(self)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    cond = np.vstack(pdf["c"].to_numpy()) if condition else None
                    yield pd.DataFrame({"k": pdf["k"], "log_prob": shared.value.log_prob(np.vstack(pdf["x"].to_numpy()), cond)})

        cols = [F.col(key).cast("bigint").alias("k"), F.col(vector).alias("x"), *([F.col(condition).alias("c")] if condition else [])]
        return rows.select(*cols).mapInPandas(run, "k bigint, log_prob double").withColumnRenamed("k", key)

    def sample(self, conditions: DataFrame, key: str, draws: int, condition: str | None = None, seed: int = 0) -> DataFrame:
        """``draws`` vectors for each row of ``conditions``, seeded by key and draw, to 12 decimals: ``key``, ``draw_no``, ``vector``."""
        shared = ship_package(conditions.sparkSession).sparkContext.broadcast(self)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            flow = shared.value
            for pdf in batches:
                step = max(1, SAMPLES_AT_ONCE // draws)
                for at in range(0, len(pdf), step):
                    part = pdf.iloc[at : at + step]
                    keys = np.column_stack([np.repeat(part["k"].to_numpy(), draws), np.tile(np.arange(draws), len(part))])
                    z = normals(uniforms(keys, flow.dim + flow.dim % 2, seed))[:, : flow.dim]
                    cond = np.repeat(np.vstack(part["c"].to_numpy()), draws, axis=0) if condition else None
                    # the last bits of a product depend on how many rows it has
                    yield pd.DataFrame({"k": keys[:, 0], "draw_no": keys[:, 1], "vector": list(np.round(flow.inverse(z, cond), 12))})

        cols = [F.col(key).cast("bigint").alias("k"), *([F.col(condition).alias("c")] if condition else [])]
        return conditions.select(*cols).mapInPandas(run, "k bigint, draw_no bigint, vector array<double>").withColumnRenamed("k", key)


#: Rows that one worker of a distributed fit holds, and tasks that add up the workers' weights.
ROWS_A_WORKER = 10_000
REDUCERS = 16


def fit_flows(flows: Sequence[CouplingFlow], rates: Sequence[float], rows: DataFrame, key: str, vector: str, condition: str, rounds: int = 60, passes: int = 1, batch: int = 256, patience: int = 8, decay: float = 1e-4, clip: float = 5.0) -> None:
    """Fits flows on all rows by averaged local training (McMahan et al. 2017): in every round each worker makes ``passes`` passes over
    its own rows from the shared weights and moments of AdamW, and these are averaged by rows.

    One row in ten, by portable random numbers, is held out; a flow keeps the weights of its best round, its rate halves after a
    round that is no better, and it stops after ``patience`` of them. Workers grow with the rows (``ROWS_A_WORKER`` each); their weights are added up by ``REDUCERS`` tasks as they stream by, so neither a task nor the
    driver holds more than a few copies of the weights.
    """
    spark = ship_package(rows.sparkSession)
    held = F.pmod(draw(17, F.col(key)), F.lit(10)) == 0
    data = rows.select(F.col(key).cast("bigint").alias("k"), F.col(vector).alias("x"), F.col(condition).alias("c"), held.alias("held"))
    data = cut_lineage(data)
    total, spared = data.agg(F.count(F.lit(1)), F.count_if("held")).first()
    workers = max(1, -(-total // ROWS_A_WORKER))
    data = cut_lineage(data.repartition(workers, "k").sortWithinPartitions("k"))
    schema = "flow int, n bigint, held bigint, score double, weights binary, steps bigint"

    def local(shared, last: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = [p for p in batches if len(p)]
            if not parts:
                return
            pdf = pd.concat(parts)
            x, c, out = np.vstack(pdf["x"].to_numpy()), np.vstack(pdf["c"].to_numpy()), pdf["held"].to_numpy(dtype=bool)
            use = ~out
            if not spared:  # too few rows to hold any out
                out = use
            for i, (flow, rate, epoch, moments) in shared.value.items():
                score = float(flow.log_prob(x[out], c[out]).sum()) if out.any() else 0.0
                n = int(use.sum())
                if n and not last:
                    rng = np.random.default_rng([flow.seed, epoch, int(pdf["k"].iloc[0]) & 0x7FFFFFFF])
                    for _ in range(passes):
                        flow._epoch(x[use], c[use], moments, rng, batch, rate, decay, clip)  # noqa: SLF001
                yield pd.DataFrame({"flow": [i], "n": [n], "held": [int(out.sum())], "score": [score], "weights": [(flow._flat(moments) * n).tobytes()], "steps": [moments["t"]]})  # noqa: SLF001

        return run

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list] = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                one = [r.n, r.held, r.score, np.frombuffer(r.weights)]
                known = sums.get(r.flow)
                sums[r.flow] = [a + b for a, b in zip(known[:4], one)] + [max(known[4], r.steps)] if known else [*one, r.steps]
        for i, (n, h, score, w, t) in sums.items():
            yield pd.DataFrame({"flow": [i], "n": [n], "held": [h], "score": [score], "weights": [w.tobytes()], "steps": [t]})

    going = {i: {"rate": r, "best": np.inf, "bad": 0, "moments": f._moments()} for i, (f, r) in enumerate(zip(flows, rates))}  # noqa: SLF001
    for i, g in going.items():
        g["state"] = flows[i]._flat(g["moments"])  # noqa: SLF001
    for epoch in range(rounds + 1):
        if not going:
            break
        shared = spark.sparkContext.broadcast({i: (flows[i], g["rate"], epoch, g["moments"]) for i, g in going.items()})
        made = data.mapInPandas(local(shared, epoch == rounds), schema)
        if workers > REDUCERS:
            made = made.repartition(REDUCERS).mapInPandas(add_up, schema)
        sums: dict[int, list] = {}
        for r in made.collect():  # a copy of the weights from each reducer
            one = [r.n, r.held, r.score, np.frombuffer(bytes(r.weights))]
            known = sums.get(r.flow)
            sums[r.flow] = [a + b for a, b in zip(known[:4], one)] + [max(known[4], r.steps)] if known else [*one, r.steps]
        shared.destroy()
        for i, (n, h, score, total, t) in sums.items():
            g, flow = going[i], flows[i]
            nll = -score / max(h, 1)
            flow.history.append(nll)
            if nll < g["best"] - 1e-4:
                g.update(best=nll, state=flow._flat(g["moments"]), bad=0)  # noqa: SLF001
            else:
                g.update(bad=g["bad"] + 1, rate=g["rate"] / 2)
            if n and epoch < rounds:
                flow._unflat(total / n, g["moments"])  # noqa: SLF001
                g["moments"]["t"] = t
        for i in [i for i, g in going.items() if g["bad"] >= patience or epoch == rounds]:
            g = going.pop(i)
            flows[i]._unflat(g["state"], g["moments"])  # noqa: SLF001
