"""Conditional factor model: cross-sections, managed portfolios, distributed training of the conditional autoencoder,
period errors and what is pooled from them.

Rows stay where Spark has them. Training sends a few thousand parameters out and sums gradients back once a step; every
fold trains at the same time, as gradients are kept by fold."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ewm import Ewm, add_along
from ..functions.nulls import finite, sdiv
from ..functions.windows import Frames
from ..panel import Panel
from ..plans.shared import kept_partitions, settled


class ModelError(ValueError):
    pass


def column_sets(panel: Panel, return_column: str, exclude: Sequence[str] = (), portfolio_columns: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Beta columns, which are all but keys, the return and ``exclude`` in the panel's order, and portfolio columns, which
    are those named or all beta columns. The network's k-th input is the k-th beta column."""
    columns = [c for c in panel.df.columns if c not in (panel.date, panel.entity)]
    unknown = sorted({return_column, *exclude, *portfolio_columns} - set(columns))
    if unknown:
        raise ModelError(f"the panel has no columns {unknown}")
    if return_column in portfolio_columns:
        raise ModelError(f"the return {return_column!r} can't form portfolios of itself")
    beta = [c for c in columns if c != return_column and c not in exclude]
    if not beta:
        raise ModelError("no beta columns remain")
    return beta, list(portfolio_columns) or beta


def cross_sections(panel: Panel, return_column: str, beta_columns: Sequence[str], portfolio_columns: Sequence[str] = (), standardize: bool = True, min_cross_section: int = 2) -> DataFrame:
    """(date, entity, r, z, p): returns, beta inputs and portfolio inputs of periods with enough returns.

    Standardised: inputs are average ranks of the date in [-1, 1] with 0 where missing, returns are z-scores. An empty
    ``portfolio_columns`` means all beta columns, and the guard counts those: with no more returns than portfolio
    columns the regression would fit them exactly."""
    portfolio_columns = list(portfolio_columns) or list(beta_columns)
    if min_cross_section <= len(portfolio_columns):
        raise ModelError(f"min_cross_section {min_cross_section} must exceed the {len(portfolio_columns)} portfolio columns")
    frames = Frames(panel.date, panel.entity)
    used = list(dict.fromkeys([*beta_columns, *portfolio_columns]))
    df = panel.df.select(F.col(panel.date).alias("date"), F.col(panel.entity).alias("entity"), finite(F.col(return_column).cast("double")).alias("r"), *(finite(F.col(c).cast("double")).alias(f"x_{c}") for c in used))
    df = df.filter("r is not null")
    frames = Frames("date", "entity")
    df = df.withColumn("_n", F.count("r").over(frames.section)).filter(F.col("_n") >= min_cross_section).drop("_n")
    if standardize:
        spread = frames.std(F.col("r"), frames.section, 1)
        made = {f"x_{c}": F.coalesce(frames.rank(F.col(f"x_{c}"), by="signed"), F.lit(0.0)) for c in used}
        df = df.withColumns({**made, "r": F.when(spread > 0, (F.col("r") - F.avg("r").over(frames.section)) / spread).otherwise(F.lit(0.0))})
    else:
        df = df.withColumns({f"x_{c}": F.coalesce(F.col(f"x_{c}"), F.lit(0.0)) for c in used})
    arr = lambda cols: F.array(*(F.col(f"x_{c}") for c in cols))
    return df.select("date", "entity", "r", arr(beta_columns).alias("z"), arr(portfolio_columns).alias("p"))


def _matrix(col: pa.Array) -> np.ndarray:
    n = len(col)
    return np.asarray(col.flatten()).reshape(n, -1) if n else np.zeros((0, 0))


#: Numbers of moments that a task holds before it sends them on.
HELD = 1 << 22


def _moments(sections: DataFrame) -> DataFrame:
    """(date, g, s, q): sums P'P, P'r and r'r of each task's rows of a date; a task adds up its rows before it sends them, so
    no date's cross-section is gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, list[np.ndarray]] = {}

        def flushed() -> pa.RecordBatch:
            g, s, q = zip(*held.values(), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(list(held), kind), *(pa.array([x.ravel() for x in v], pa.list_(pa.float64())) for v in (g, s)), pa.array([float(x) for x in q])], names=["date", "g", "s", "q"])

        for b in batches:
            if not len(b):
                continue
            kind = b.schema.field(0).type
            codes = b.column(0).dictionary_encode()
            p, r, at = _matrix(b.column(2)), np.asarray(b.column(1)), np.asarray(codes.indices)
            order = np.argsort(at, kind="stable")
            cuts = np.append(np.flatnonzero(np.diff(at[order], prepend=-1)), len(at))
            for lo, hi in pairwise(cuts.tolist()):
                own = order[lo:hi]
                made = [p[own].T @ p[own], p[own].T @ r[own], r[own] @ r[own]]
                key = codes.dictionary[int(at[own[0]])]
                held[key] = [x + y for x, y in zip(held[key], made, strict=True)] if key in held else made
            if len(held) * p.shape[1] ** 2 > HELD:
                yield flushed()
                held.clear()
        if held:
            yield flushed()

    kind = sections.schema["date"].dataType.simpleString()
    return sections.select("date", "r", "p").mapInArrow(run, f"date {kind}, g array<double>, s array<double>, q double")


def _solved(g: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(g, rcond=1e-10, hermitian=True) @ s


def left_out(g: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Row k: the least-squares weights without column k, 0 at its place. Where P'P has an inverse all rows come from it by
    one downdate each; else each is solved for the smallest norm."""
    k = len(s)
    values = np.linalg.eigvalsh(g) if k else np.zeros(0)
    if k and values[0] > 1e-10 * values[-1]:
        inverse = np.linalg.inv(g)
        out = (inverse @ s)[None] - (inverse * ((inverse @ s) / np.diag(inverse))[None]).T
        np.fill_diagonal(out, 0.0)
        return out
    out = np.zeros((k, k))
    for i in range(k):
        rest = np.delete(np.arange(k), i)
        out[i, rest] = _solved(g[np.ix_(rest, rest)], s[rest])
    return out


def managed_portfolios(sections: DataFrame, leave_out: bool = False) -> DataFrame:
    """(date, x): least-squares weights of the portfolio inputs on the returns, of smallest norm where they aren't unique.
    With ``leave_out`` also ``without``: for each portfolio column the weights solved again as if it were 0, and ``explained``
    and ``explained_without``, what each solution explains of the returns' square sum ``total``. All of it comes from the same
    sums, in one pass over the rows."""

    def solve(t: pa.Table) -> pa.Table:
        g, s = np.sum(t["g"].to_pylist(), axis=0), np.sum(t["s"].to_pylist(), axis=0)
        g = g.reshape(len(s), len(s))
        x = _solved(g, s)
        made = {"date": t["date"].slice(0, 1), "x": pa.array([x], pa.list_(pa.float64()))}
        if leave_out:
            others = left_out(g, s)
            one = lambda w: float(2 * (w @ s) - w @ g @ w)
            made["without"] = pa.array([others.tolist()], pa.list_(pa.list_(pa.float64())))
            made["total"] = pa.array([float(np.sum(t["q"].to_numpy()))])
            made["explained"] = pa.array([one(x)])
            made["explained_without"] = pa.array([[one(w) for w in others]], pa.list_(pa.float64()))
        return pa.table(made)

    kind = sections.schema["date"].dataType.simpleString()
    more = ", without array<array<double>>, total double, explained double, explained_without array<double>" if leave_out else ""
    return _moments(sections).groupBy("date").applyInArrow(solve, f"date {kind}, x array<double>{more}")


def portfolio_importance(solved: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, importance): the pooled R2 that the regression portfolios lose when one of their characteristics is 0 and
    they are solved again; ``solved`` is ``managed_portfolios(..., leave_out=True)``."""
    each = solved.select("total", "explained", F.posexplode("explained_without").alias("k", "rest"))
    names = F.array(*map(F.lit, columns))
    return each.groupBy(F.element_at(names, F.col("k") + 1).alias("column")).agg(sdiv(F.sum(F.col("explained") - F.col("rest")), F.sum("total")).alias("importance"))


@dataclass(frozen=True)
class Network:
    """Betas by a ReLU network of the characteristics, factors linear in the managed portfolios."""

    inputs: int
    portfolios: int
    factors: int = 3
    hidden: tuple[int, ...] = ()

    @property
    def shapes(self) -> list[tuple[int, int]]:
        dims = [self.inputs, *self.hidden, self.factors]
        return [*((a, b) for a, b in zip(dims[:-1], dims[1:], strict=True)), *((1, b) for b in dims[1:]), (self.portfolios, self.factors)]

    @property
    def size(self) -> int:
        return sum(a * b for a, b in self.shapes)

    def start(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        depth = len(self.hidden) + 1
        return np.concatenate([(rng.standard_normal(s) * np.sqrt(1 / s[0]) if i < depth or i == len(self.shapes) - 1 else np.zeros(s)).ravel() for i, s in enumerate(self.shapes)])

    def split(self, theta: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        out, at = [], 0
        for s in self.shapes:
            out.append(theta[at : at + s[0] * s[1]].reshape(s))
            at += s[0] * s[1]
        depth = len(self.hidden) + 1
        return out[:depth], out[depth : 2 * depth], out[-1]

    def weights(self) -> np.ndarray:
        """Which parameters the L1 penalty falls on: all but biases."""
        depth = len(self.hidden) + 1
        return np.concatenate([np.full(a * b, not depth <= i < 2 * depth) for i, (a, b) in enumerate(self.shapes)])

    def forward(self, theta: np.ndarray, z: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        w, b, f = self.split(theta)
        acts = [z]
        for i, (a, c) in enumerate(zip(w, b, strict=True)):
            h = acts[-1] @ a + c
            acts.append(np.maximum(h, 0) if i < len(w) - 1 else h)
        return acts[-1], x @ f, acts

    def gradient(self, theta: np.ndarray, z: np.ndarray, x: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, float]:
        """Of the summed squared error, and that sum."""
        w, _, _ = self.split(theta)
        beta, factor, acts = self.forward(theta, z, x)
        err = (beta * factor).sum(axis=1) - r
        delta = 2 * err[:, None] * factor
        gw, gb = [], []
        for i in range(len(w) - 1, -1, -1):
            gw.insert(0, acts[i].T @ delta)
            gb.insert(0, delta.sum(axis=0, keepdims=True))
            if i:
                delta = (delta @ w[i].T) * (acts[i] > 0)
        gf = x.T @ (2 * err[:, None] * beta)
        return np.concatenate([g.ravel() for g in (*gw, *gb, gf)]), float(err @ err)


    def sensitivity(self, theta: np.ndarray, z: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Of each row's fitted return to its characteristics."""
        w, _, _ = self.split(theta)
        _, delta, acts = self.forward(theta, z, x)
        for i in range(len(w) - 1, -1, -1):
            delta = delta @ w[i].T
            if i:
                delta = delta * (acts[i] > 0)
        return delta


@dataclass
class Training:
    epochs: int = 50
    rate: float = 0.02
    l1: float = 1e-4
    l1_mode: str = "proximal"
    decay: float = 0.0
    gamma: float = 0.99
    patience: int = 10
    min_delta: float = 1e-4
    seed: int = 42
    seed_per_fold: bool = False

    def step(self, net: Network, theta: np.ndarray, m: np.ndarray, v: np.ndarray, g: np.ndarray, number: int, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parameters and moments after the Adam step of that number (from 1)."""
        if self.l1_mode == "subgradient":
            g = g + self.l1 * np.sign(theta) * net.weights()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**number)) / (np.sqrt(v / (1 - 0.999**number)) + 1e-8)
        new = theta * (1 - rate * self.decay) - move
        if self.l1_mode == "proximal" and self.l1:
            new = np.where(net.weights(), np.sign(new) * np.maximum(np.abs(new) - rate * self.l1, 0), new)
        return new, m, v


@dataclass
class Fit:
    theta: dict[int, np.ndarray]
    history: list[dict] = field(default_factory=list)
    best_epoch: dict[int, int] = field(default_factory=dict)


#: Rows of a block.
BLOCK = 1 << 13


def _blocks(rows: DataFrame) -> DataFrame:
    """(fold, train, r, z, x): the same rows in blocks of one fold and part, their numbers as bytes, written once: a pass of
    the training reads them without laying out a list a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list[tuple]] = {}
        waiting: dict[tuple[int, bool], int] = {}

        def packed(key: tuple[int, bool]) -> pa.RecordBatch:
            cols = [np.concatenate(c) for c in zip(*held.pop(key), strict=True)]
            waiting.pop(key)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]]), *(pa.array([c.astype(float).tobytes()], pa.binary()) for c in cols)], names=["fold", "train", "r", "z", "x"])

        for b in batches:
            if not len(b):
                continue
            fold, train = (np.asarray(b.column(i).to_numpy(zero_copy_only=False)) for i in (0, 1))
            r, z, x = np.asarray(b.column(2)), _matrix(b.column(3)), _matrix(b.column(4))
            for f in np.unique(fold).tolist():
                for part in (True, False):
                    on = (fold == f) & (train == part)
                    if on.any():
                        held.setdefault((f, part), []).append((r[on], z[on], x[on]))
                        waiting[f, part] = waiting.get((f, part), 0) + int(on.sum())
                        if waiting[f, part] >= BLOCK:
                            yield packed((f, part))
        for key in list(held):
            yield packed(key)

    slim = rows.select("fold", (F.col("part") == "train").alias("train"), "r", "z", "x")
    return settled(slim.mapInArrow(run, "fold int, train boolean, r binary, z binary, x binary"), "blocks")


def fit_folds(rows: DataFrame, net: Network, how: Training = Training()) -> Fit:
    """Train all folds at once. ``rows`` are (fold, part, r, z, x) with part train or val; they are read once.

    Each epoch is one pass: tasks sum gradients and errors of their rows by fold, Adam steps on the sums, L1 shrinks
    weights after the step (``l1_mode`` proximal) or joins the gradient (subgradient), and a fold stops once its
    validation R2 has not gained for ``patience`` epochs; its best parameters count."""
    if how.l1_mode not in ("proximal", "subgradient"):
        raise ModelError(f"l1_mode must be proximal or subgradient, not {how.l1_mode!r}")
    blocks = _blocks(rows)
    folds = [r["fold"] for r in blocks.select("fold").distinct().orderBy("fold").collect()]
    theta = {f: net.start(how.seed + (f if how.seed_per_fold else 0)) for f in folds}
    best, best_at = {f: (-np.inf, theta[f]) for f in folds}, dict.fromkeys(folds, 0)
    m, v = {f: np.zeros(net.size) for f in folds}, {f: np.zeros(net.size) for f in folds}
    fit, open_ = Fit({}), set(folds)
    for epoch in range(1, how.epochs + 1):
        if not open_:
            break
        sent = rows.sparkSession.sparkContext.broadcast({f: theta[f] for f in open_})

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, bool], np.ndarray] = {}
            for b in batches:
                for f, part, *cols in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if f in sent.value:
                        r, z, x = (np.frombuffer(c) for c in cols)
                        g, sse = net.gradient(sent.value[f], z.reshape(len(r), -1), x.reshape(len(r), -1), r)
                        row = np.concatenate([g if part else np.zeros(0), [sse, float(r @ r), len(r)]])
                        sums[f, part] = sums.get((f, part), 0) + row
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums]), pa.array([list(s) for s in sums.values()], pa.list_(pa.float64()))], names=["fold", "train", "s"])

        parts = blocks.mapInArrow(run, "fold int, train boolean, s array<double>")
        total: dict[tuple[int, bool], np.ndarray] = {}
        for r in parts.collect():  # a partial sum of fixed size from each task, all tasks at once
            key = (r["fold"], r["train"])
            total[key] = total.get(key, 0) + np.array(r["s"])
        sent.unpersist()
        for f in sorted(open_):
            grad, val = total[f, True], total.get((f, False))
            sse, sst, n = grad[-3:]
            score = 1 - (val[0] / val[1] if val is not None and val[1] > 0 else sse / sst)
            fit.history.append({"fold": f, "epoch": epoch, "train_r2": 1 - sse / sst, "score": score})
            if score > best[f][0] + how.min_delta:
                best[f], best_at[f] = (score, theta[f].copy()), epoch
            elif epoch - best_at[f] >= how.patience:
                open_.discard(f)
                continue
            g = grad[:-3] / n
            theta[f], m[f], v[f] = how.step(net, theta[f], m[f], v[f], g, epoch, how.rate * how.gamma ** (epoch - 1))
    fit.theta, fit.best_epoch = {f: best[f][1] for f in folds}, best_at
    return fit


def fit_batches(rows: DataFrame, net: Network, how: Training = Training(), batch_periods: int = 4, lanes: int = 4) -> Fit:
    """As ``fit_folds``, in steps on batches of whole periods: ``rows`` are (fold, part, date, entity, r, z, x).

    A fold's periods are dealt to ``lanes`` by a hash of the date and stay there. In every pass each lane starts from the
    fold's parameters and moments, goes through its periods in an order drawn from seed and epoch, takes a step a
    ``batch_periods``, and the lanes' results are averaged by their rows. A lane's rows stream through its task; it holds one
    batch of periods. What comes back is a few vectors a lane, added up in the lanes' order, so reruns agree whatever the
    partitioning."""
    if how.l1_mode not in ("proximal", "subgradient") or batch_periods < 1 or lanes < 1:
        raise ModelError("l1_mode must be proximal or subgradient; batches and lanes are at least one")
    day = F.xxhash64(F.lit(how.seed), F.col("date").cast("string")).alias("day")
    slim = rows.select("fold", (F.col("part") == "train").alias("train"), day, "entity", "r", "z", "x")
    lane = F.pmod(F.col("day"), F.lit(lanes)).cast("int")
    dealt = kept_partitions(slim.withColumn("lane", lane).repartition("fold", "lane"))
    folds = [r["fold"] for r in dealt.select("fold").distinct().orderBy("fold").collect()]
    theta = {f: net.start(how.seed + (f if how.seed_per_fold else 0)) for f in folds}
    best, best_at = {f: (-np.inf, theta[f]) for f in folds}, dict.fromkeys(folds, 0)
    m, v, steps = {f: np.zeros(net.size) for f in folds}, {f: np.zeros(net.size) for f in folds}, dict.fromkeys(folds, 0)
    fit, open_ = Fit({}), set(folds)
    for epoch in range(1, how.epochs + 1):
        if not open_:
            break
        sent = rows.sparkSession.sparkContext.broadcast({f: (theta[f], m[f], v[f], steps[f]) for f in open_})
        rate = how.rate * how.gamma ** (epoch - 1)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, rate=rate) -> Iterator[pa.RecordBatch]:
            for (f, lane), parts in groupby(_periods(batches), key=lambda p: p[0]):
                if f not in sent.value:
                    continue
                start, m1, v1, done = sent.value[f]
                now, k = start, done
                errors, held = np.zeros((2, 3)), []  # of train and validation rows, as in fit_folds

                def stepped() -> None:
                    nonlocal now, m1, v1, k
                    r, z, x = (np.concatenate(c) for c in zip(*held, strict=True))
                    g, _ = net.gradient(now, z, x, r)
                    k += 1
                    now, m1, v1 = how.step(net, now, m1, v1, g / len(r), k, rate)
                    held.clear()

                for _, train, r, z, x in parts:
                    _, sse = net.gradient(start, z, x, r)
                    errors[0 if train else 1] += sse, r @ r, len(r)
                    if train:
                        held.append((r, z, x))
                        if len(held) == batch_periods:
                            stepped()
                if held:
                    stepped()
                yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([lane], pa.int32()), pa.array([k - done], pa.int32()), pa.array([errors.ravel()], pa.list_(pa.float64())), *(pa.array([a], pa.list_(pa.float64())) for a in (now, m1, v1))], names=["fold", "lane", "steps", "errors", "theta", "m", "v"])

        order = ["fold", "lane", F.xxhash64(F.lit(epoch), "day"), "day", "train", "entity"]
        parts = dealt.sortWithinPartitions(*order).mapInArrow(run, "fold int, lane int, steps int, errors array<double>, theta array<double>, m array<double>, v array<double>")
        back = sorted(parts.collect(), key=lambda r: (r["fold"], r["lane"]))  # a row a fold and lane
        sent.unpersist()
        for f in sorted(open_):
            own = [r for r in back if r["fold"] == f]
            (sse, sst, _), (val_sse, val_sst, _) = np.sum([r["errors"] for r in own], axis=0).reshape(2, 3)
            score = 1 - (val_sse / val_sst if val_sst > 0 else sse / sst)
            fit.history.append({"fold": f, "epoch": epoch, "train_r2": 1 - sse / sst, "score": score})
            if score > best[f][0] + how.min_delta:
                best[f], best_at[f] = (score, theta[f].copy()), epoch
            elif epoch - best_at[f] >= how.patience:
                open_.discard(f)
                continue
            share = np.array([r["errors"][2] for r in own])
            share = share / share.sum()
            theta[f], m[f], v[f] = (sum(w * np.array(r[c]) for w, r in zip(share, own, strict=True)) for c in ("theta", "m", "v"))
            steps[f] += max(r["steps"] for r in own)
    fit.theta, fit.best_epoch = {f: best[f][1] for f in folds}, best_at
    return fit


def _periods(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """((fold, lane), train, r, z, x) of each period's rows, in the order they come."""
    held: list[tuple] = []
    last = None
    for b in batches:
        if not len(b):
            continue
        fold, train, r, lane = (np.asarray(b.column(i).to_numpy(zero_copy_only=False)) for i in (0, 1, 4, 7))
        date = np.asarray(b.column(2))
        z, x = _matrix(b.column(5)), _matrix(b.column(6))
        change = (np.diff(fold) != 0) | (np.diff(lane) != 0) | (np.diff(date) != 0) | (train[1:] != train[:-1])
        for lo, hi in pairwise([0, *(np.flatnonzero(change) + 1).tolist(), len(b)]):
            key = (int(fold[lo]), int(lane[lo]), int(date[lo]), bool(train[lo]))
            if held and key != last:
                yield last[:2], last[3], *(np.concatenate(c) for c in zip(*held, strict=True))
                held = []
            held.append((r[lo:hi], z[lo:hi], x[lo:hi]))
            last = key
    if held:
        yield last[:2], last[3], *(np.concatenate(c) for c in zip(*held, strict=True))


def score_rows(rows: DataFrame, net: Network, fit: Fit, keep: Sequence[str] = ("fold", "part", "date", "entity", "r")) -> DataFrame:
    """``keep`` and, from each row's fold, beta and factor."""
    sent = rows.sparkSession.sparkContext.broadcast(fit.theta)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    at = list(keep).index("fold")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = len(b)
            fold, z, x = np.asarray(b.column(at)), _matrix(b.column(len(keep))), _matrix(b.column(len(keep) + 1))
            beta, factor = np.zeros((n, net.factors)), np.zeros((n, net.factors))
            for f in np.unique(fold):
                on = fold == f
                beta[on], factor[on], _ = net.forward(sent.value[int(f)], z[on], x[on])
            ends = pa.array(np.arange(n + 1) * net.factors, pa.int32())
            cols = [pa.ListArray.from_arrays(ends, pa.array(a.ravel())) for a in (beta, factor)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *cols], names=[*keep, "beta", "factor"])

    return rows.select(*keep, "z", "x").mapInArrow(run, f"{kinds}, beta array<double>, factor array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def factor_forecast(factors: DataFrame, mode: str = "expanding_mean", alpha: float = 0.01, by: Sequence[str] = ()) -> DataFrame:
    """(by, date, level): the forecast of each date from the factors before it; NULL on the first.

    ``factors`` are (by, date, factor). One row a date; each factor runs along one window."""
    one = factors.select(*by, "date", F.posexplode("factor").alias("k", "f"))
    if mode == "expanding_mean":
        before = Window.partitionBy(*by, "k").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
        level = one.withColumn("f", F.avg("f").over(before))
    elif mode == "ewma":
        if not 0 < alpha <= 1:
            raise ModelError("alpha must lie in (0, 1]")
        run = one.withColumn("_run", F.to_json(F.struct(*by, "k")))
        run = add_along(run, {"_ewm": Ewm("f", alpha, False, 1)}, "date", "_run")
        level = run.select(*by, "date", "k", F.lag("_ewm").over(Window.partitionBy("_run").orderBy("date")).alias("f"))
    else:
        raise ModelError(f"mode must be expanding_mean or ewma, not {mode!r}")
    whole = F.transform(F.array_sort(F.collect_list(F.struct("k", "f"))), lambda s: s["f"])
    some = F.size(F.filter("level", lambda x: x.isNotNull())) > 0
    return level.groupBy(*by, "date").agg(whole.alias("level")).withColumn("level", F.when(some, F.col("level")))


def per_period_errors(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, date, sse_total, sst_total, sse_pred, sst_pred) of rows (by, date, r, fitted, predicted); a period without
    prediction counts 0 in the last two."""
    known = F.col("predicted").isNotNull()
    sq = lambda x: F.coalesce(F.sum(x * x), F.lit(0.0))
    r = F.col("r")
    return scored.groupBy(*by, "date").agg(sq(r - F.col("fitted")).alias("sse_total"), sq(r).alias("sst_total"), sq(F.when(known, r - F.col("predicted"))).alias("sse_pred"), sq(F.when(known, r)).alias("sst_pred"))


def pooled_r_squared(errors: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ratios of sums over periods, never means of period or fold scores."""
    r2 = lambda k: (1 - sdiv(F.sum(f"sse_{k}"), F.sum(f"sst_{k}"))).alias(f"{k}_r2")
    return errors.groupBy(*by).agg(r2("total"), r2("pred"), F.count("*").alias("periods"))


def factor_diagnostics(scored: DataFrame, n_factors: int, by: Sequence[str] = ()) -> DataFrame:
    """Participation ratio of the factors' contributions sum (beta f)^2, and the largest |correlation| of two factors."""
    share = [F.sum(F.pow(F.col("beta")[k] * F.col("factor")[k], 2)) for k in range(n_factors)]
    total = sum(share[1:], share[0])
    effective = sdiv(total * total, sum((s * s for s in share[1:]), share[0] * share[0])).alias("effective")
    out = scored.groupBy(*by).agg(effective)
    dates = scored.groupBy(*by, "date").agg(F.first("factor").alias("factor"))
    pairs = [F.abs(F.corr(F.col("factor")[i], F.col("factor")[j])) for i in range(n_factors) for j in range(i)]
    top = F.greatest(*pairs) if len(pairs) > 1 else pairs[0] if pairs else F.lit(None).cast("double")
    rest = dates.groupBy(*by).agg(F.when(~F.isnan(top), top).alias("max_abs_correlation"))
    return out.join(rest, list(by)) if by else out.withColumn("_", F.lit(0)).join(rest.withColumn("_", F.lit(0)), "_").drop("_")


def importance_summary(scores: DataFrame) -> DataFrame:
    """Of rows (fold, column, importance): spread over folds by column."""
    x = F.col("importance")
    return scores.groupBy("column").agg(F.percentile(x, 0.5).alias("median"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).alias("folds"), F.count_if(x > 0).alias("folds_positive"))


def characteristic_sensitivity(rows: DataFrame, net: Network, fit: Fit, columns: Sequence[str]) -> DataFrame:
    """(fold, column, importance): the mean absolute slope of fitted test returns in each characteristic."""
    sent = rows.sparkSession.sparkContext.broadcast(fit.theta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold, z, x = np.asarray(b.column(0)), _matrix(b.column(1)), _matrix(b.column(2))
            for f in np.unique(fold):
                on = fold == f
                total = np.abs(net.sensitivity(sent.value[int(f)], z[on], x[on])).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([f] * len(columns), pa.int32()), pa.array(list(columns)), pa.array(total), pa.array([int(on.sum())] * len(columns))], names=["fold", "column", "total", "n"])

    parts = rows.filter("part = 'test'").select("fold", "z", "x").mapInArrow(run, "fold int, column string, total double, n long")
    return parts.groupBy("fold", "column").agg((F.sum("total") / F.sum("n")).alias("importance"))


def characteristic_importance(rows: DataFrame, net: Network, fit: Fit, columns: Sequence[str], portfolio_columns: Sequence[str] = ()) -> DataFrame:
    """(fold, column, importance): the R2 that each fold's test rows lose with one characteristic set to 0. A characteristic
    that is among the ``portfolio_columns`` is 0 in the portfolios, too: ``rows`` then have ``without``, the portfolios solved
    again without each of these columns."""
    sent = rows.sparkSession.sparkContext.broadcast(fit.theta)
    again = {c: i for i, c in enumerate(portfolio_columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, str | None], np.ndarray] = {}
        for b in batches:
            if not len(b):
                continue
            fold, r, z, x = np.asarray(b.column(0)), np.asarray(b.column(1)), _matrix(b.column(2)), _matrix(b.column(3))
            without = np.asarray(b.column(4).flatten().flatten()).reshape(len(b), len(again), -1) if again else None
            for f in np.unique(fold).tolist():
                on = fold == f
                for k, c in enumerate([*columns, None]):
                    zeroed = z[on]
                    if c is not None:
                        zeroed[:, k] = 0.0
                    beta, factor, _ = net.forward(sent.value[f], zeroed, without[on, again[c]] if c in again else x[on])
                    err = r[on] - (beta * factor).sum(axis=1)
                    sums[f, c] = sums.get((f, c), 0) + np.array([err @ err, r[on] @ r[on]])
        if sums:
            sse, sst = np.array(list(sums.values())).T
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in sums], pa.int32()), pa.array([c for _, c in sums], pa.string()), pa.array(sse), pa.array(sst)], names=["fold", "column", "sse", "sst"])

    test = rows.filter("part = 'test'").select("fold", "r", "z", "x", *(["without"] if again else []))
    parts = test.mapInArrow(run, "fold int, column string, sse double, sst double")
    r2 = parts.groupBy("fold", "column").agg((1 - sdiv(F.sum("sse"), F.sum("sst"))).alias("r2"))
    base = F.max(F.when(F.col("column").isNull(), F.col("r2"))).over(Window.partitionBy("fold"))
    return r2.withColumn("importance", base - F.col("r2")).filter("column is not null").select("fold", "column", "importance")
