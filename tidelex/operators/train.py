"""Training of one linear head per concept, a bucket of concepts side by side in each group."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = 5  # anchor, same-language positive and negative, cross-language positive and negative


class Adam:
    def __init__(self, shape: tuple[int, ...], rate: float | np.ndarray, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8):
        self.rate, self.b1, self.b2, self.eps, self.t = rate, b1, b2, eps, 0
        self.m, self.v = np.zeros(shape), np.zeros(shape)

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += (1 - self.b1) * (g - self.m)
        self.v = self.b2 * self.v + (1 - self.b2) * g * g
        scale = np.sqrt(self.v) / np.sqrt(1 - self.b2**self.t) + self.eps
        return w - self.rate / (1 - self.b1**self.t) * self.m / scale


class Plateau:
    """Cuts a rate when a loss hasn't become better (by a relative threshold) for longer than patience; after a cut, cooldown steps
    don't count as bad, and no rate falls below least."""

    def __init__(self, factor: float = 0.5, patience: int = 3, threshold: float = 1e-4, eps: float = 1e-8, cooldown: int = 0, least: float = 0.0):
        self.factor, self.patience, self.threshold, self.eps, self.cooldown, self.least = factor, patience, threshold, eps, cooldown, least
        self.best, self.bad, self.resting = np.inf, 0, 0

    def rate(self, rate: float, loss: float) -> float:
        better = loss < self.best * (1 - self.threshold) or not np.isfinite(self.best)
        self.best, self.bad = (loss, 0) if better else (self.best, self.bad + 1)
        if self.resting:
            self.resting, self.bad = self.resting - 1, 0
        if self.bad <= self.patience:
            return rate
        self.bad, self.resting = 0, self.cooldown
        low = max(rate * self.factor, self.least)
        return low if rate - low > self.eps else rate


def loss_and_gradient(w: np.ndarray, x: np.ndarray, margin: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x: (samples, 5 roles, inputs); margin and use: (samples, 2) for the same- and cross-language triplets; w: (outputs, inputs). Any of
    them may have the same leading axes, for heads side by side, whose losses and gradients don't touch each other."""
    y = np.tanh(x @ np.swapaxes(w, -1, -2)[..., None, :, :])
    size = np.sqrt((y * y).sum(-1))
    anchor, na = y[..., 0, :], size[..., 0]
    g = np.zeros_like(y)
    total = np.zeros(x.shape[:-3])
    dist, left = {}, {}
    for r in range(1, ROLES):
        s = (anchor * y[..., r, :]).sum(-1)
        n = na * size[..., r] + 1e-8
        dist[r], left[r] = 1 - s / n, (s, n)
    for k, (p, q) in enumerate(((1, 2), (3, 4))):
        hinge = (dist[p] - dist[q] + margin[..., k]) * use[..., k]
        on = (hinge > 0) * use[..., k] / x.shape[-3]
        total = total + np.maximum(hinge, 0).sum(-1) / x.shape[-3]
        for r, sign in ((p, 1.0), (q, -1.0)):
            s, n = left[r]
            f = (sign * on)[..., None]
            safe_a, safe_r = np.maximum(na, 1e-30), np.maximum(size[..., r], 1e-30)
            g[..., 0, :] += f * (-y[..., r, :] / n[..., None] + (s * size[..., r] / (safe_a * n * n))[..., None] * anchor)
            g[..., r, :] += f * (-anchor / n[..., None] + (s * na / (safe_r * n * n))[..., None] * y[..., r, :])
    back = g * (1 - y * y)
    flat = lambda z: z.reshape(*z.shape[:-3], -1, z.shape[-1])
    return total, np.swapaxes(flat(back), -1, -2) @ flat(x)


@dataclass(frozen=True)
class Training:
    outputs: int = 8
    epochs: int = 10
    epoch_size: int = 512
    batch: int = 64
    rate: float = 1e-2
    dropout: float = 0.05
    margin: float = 0.1
    margin_scale: float = 0.0  # above 0: the margin is that many deviations of the concept's distances, if larger
    seed: int = 42
    min_rows: int = 10
    bucket: int = 16  # concepts trained side by side
    mine_every: int = 1  # epochs that share a draw of samples
    factor: float = 0.5
    patience: int = 3
    cooldown: int = 0
    least_rate: float = 0.0


POSITIVES = 20


class Sampler:
    """Five-point samples of a concept by hard mining. For each anchor and either group of neighbours (its language, the others) it lists the nearest
    POSITIVES (a third of the group at most) and, for each of them, the nearest neighbour beyond these that is farther by margin."""

    def __init__(self, dist: np.ndarray, lang: np.ndarray, margin: float):
        n = len(lang)
        self.own = [np.flatnonzero(lang == x) for x in np.unique(lang)]
        self.k = np.zeros((2, n), int)
        self.pos, self.neg, self.gap = np.zeros((2, n, POSITIVES), int), np.full((2, n, POSITIVES), -1), np.zeros((2, n, POSITIVES))
        for mine in self.own:
            for side, near in enumerate((mine, np.setdiff1d(np.arange(n), mine))):
                d = dist[np.ix_(mine, near)].copy()
                if side == 0:
                    np.fill_diagonal(d, np.inf)
                m = len(near) - (side == 0)
                if m < 3:
                    continue
                k = min(POSITIVES, max(1, m // 3))
                order = np.argsort(d, axis=1, kind="stable")[:, :m]
                self.k[side, mine] = k
                for a, o, row in zip(mine.tolist(), order, np.take_along_axis(d, order, 1), strict=True):
                    at = np.maximum(np.searchsorted(row, row[:k] + margin), k)
                    found = at < m
                    self.pos[side, a, :k] = near[o[:k]]
                    self.neg[side, a, :k][found] = near[o[at[found]]]
                    self.gap[side, a, :k][found] = row[at[found]] - row[:k][found]

    def draw(self, rng: np.random.Generator, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(indices by role, margins, which triplets count) of at most count samples: an anchor of either language, each as likely, and a positive on both
        sides. Without a triplet in its language an anchor is passed over (20 tries a sample in all); without one across, that side doesn't count."""
        parts, have = [], 0
        for _ in range(20):
            if have >= count or not self.own:
                break
            u = rng.random((count, 4))
            which = (u[:, 0] * len(self.own)).astype(int)
            size = np.array([len(x) for x in self.own])
            start = np.cumsum(size) - size
            a = np.concatenate(self.own)[start[which] + (u[:, 1] * size[which]).astype(int)]
            row, gaps, flags = [a], [], []
            for side in (0, 1):
                p = (u[:, 2 + side] * self.k[side, a]).astype(int)
                ok = (self.k[side, a] > 0) & (self.neg[side, a, p] >= 0)
                row += [np.where(ok, self.pos[side, a, p], a), np.where(ok, self.neg[side, a, p], a)]
                gaps.append(np.where(ok, self.gap[side, a, p], 0.0)), flags.append(ok)
            good = np.flatnonzero(flags[0])[: count - have]
            parts.append((np.stack(row, 1)[good], np.stack(gaps, 1)[good], np.stack(flags, 1)[good].astype(float)))
            have += len(good)
        return tuple(np.concatenate([p[i] for p in parts]) if parts else np.zeros((0, w)) for i, w in ((0, ROLES), (1, 2), (2, 2)))


@dataclass
class Prepared:
    """A concept ready for training: inputs in training order, samplers of its training and validation rows, and its own random numbers."""

    concept: str
    x: np.ndarray
    train: Sampler
    validation: Sampler | None
    n_train: int
    margin: float
    rng: np.random.Generator


def prepare(concept: str, x: np.ndarray, mining: np.ndarray, lang: np.ndarray, cfg: Training) -> Prepared | None:
    """Distances are those of the mining vectors; the last fifth of the rows, in the order given, validates. None under min_rows."""
    n = len(x)
    if n < cfg.min_rows:
        return None
    unit = mining / np.maximum(np.linalg.norm(mining, axis=1, keepdims=True), 1e-8)
    dist = 1 - unit @ unit.T
    np.fill_diagonal(dist, 0)
    spread = float(np.std(dist[np.triu_indices(n, 1)])) if cfg.margin_scale > 0 and n > 2 else 0.0
    margin = max(cfg.margin, cfg.margin_scale * spread)
    n_val = min(max(int(0.2 * n), 1), n - 3) if n > 3 else 0
    cut = n - n_val
    val = Sampler(dist[cut:, cut:], lang[cut:], margin) if n_val >= 4 else None
    return Prepared(concept, x, Sampler(dist[:cut, :cut], lang[:cut], margin), val, cut, margin, np.random.default_rng([cfg.seed, zlib.crc32(concept.encode())]))


def train_bucket(specs: list[Prepared], cfg: Training) -> dict[str, tuple[np.ndarray, list[float], list[float]]]:
    """concept -> (weights, training losses, validation losses). All heads of the bucket take each step in one batched product; epochs are cut to
    the shortest draw, so that batches stay rectangular. A concept draws from its own random numbers: what it learns doesn't depend on its
    neighbours but for that cut. One that can't draw a sample keeps its first weights, with losses of 0."""
    out, ready, first = {}, [], []
    for s in specs:
        w = s.rng.normal(0, 1 / np.sqrt(s.x.shape[1]), (cfg.outputs, s.x.shape[1]))
        val = s.validation.draw(s.rng, cfg.epoch_size // 10 + 1) if s.validation else None
        drawn = s.train.draw(s.rng, cfg.epoch_size)
        if len(drawn[0]):
            ready.append((s, w, val)), first.append(drawn)
        else:
            out[s.concept] = w, [0.0] * cfg.epochs, [0.0] * cfg.epochs
    if not ready:
        return out
    w = np.stack([x for _, x, _ in ready])
    base = np.cumsum([0, *(len(s.x) for s, _, _ in ready[:-1])])
    bank = np.concatenate([s.x for s, _, _ in ready])
    adam = Adam(w.shape, np.full((len(ready), 1, 1), cfg.rate))
    plateaus = [Plateau(cfg.factor, cfg.patience, cooldown=cfg.cooldown, least=cfg.least_rate) for _ in ready]
    seen, checked, drawn = [], [], first
    for epoch in range(cfg.epochs):
        if epoch and epoch % cfg.mine_every == 0:
            drawn = [s.train.draw(s.rng, cfg.epoch_size) for s, _, _ in ready]
        size = min(len(d[0]) for d in drawn)
        at, margin, use = (np.stack([d[i][:size] for d in drawn]) for i in range(3))
        at = at.astype(int) + base[:, None, None]
        losses = []
        for i in range(0, size, cfg.batch):
            x = bank[at[:, i : i + cfg.batch]]
            keep = np.stack([s.rng.random(x.shape[1:]) for s, _, _ in ready]) >= cfg.dropout
            loss, g = loss_and_gradient(w, x * keep / (1 - cfg.dropout), margin[:, i : i + cfg.batch], use[:, i : i + cfg.batch])
            w = adam.step(w, g)
            losses.append(loss)
        seen.append(np.mean(losses, axis=0) if losses else np.zeros(len(ready)))
        now = seen[-1].copy()
        for j, (s, _, val) in enumerate(ready):
            if val is not None and len(val[0]):
                now[j] = loss_and_gradient(w[j], s.x[s.n_train + val[0].astype(int)], val[1], val[2])[0]
            adam.rate[j] = plateaus[j].rate(float(adam.rate[j, 0, 0]), float(now[j]))
        checked.append(now)
    for j, (s, _, _) in enumerate(ready):
        out[s.concept] = w[j], [float(x[j]) for x in seen], [float(x[j]) for x in checked]
    return out


def train_head(x: np.ndarray, mining: np.ndarray, lang: np.ndarray, cfg: Training = Training(), concept: str = "") -> tuple[np.ndarray, list[float], list[float]]:
    """(weights, training losses, validation losses) of a concept alone."""
    spec = prepare(concept, x, mining, lang, replace(cfg, min_rows=0))
    return train_bucket([spec], cfg)[concept]


HEADS = "concept_id string, n_rows long, margin double, first_loss double, last_loss double, weights array<array<double>>"


def train_heads(rows: DataFrame, cfg: Training = Training()) -> DataFrame:
    """rows(concept_id, lang, x) of capped concepts -> HEADS; concepts under min_rows are skipped. Where rows have m, samples are mined in that space
    and heads learned on x, else both are x. Rows come in the order of pos, where they have it; else the languages take turns by id. Concepts
    are dealt to buckets by a hash, about cfg.bucket each, and a bucket is a group."""
    n = rows.select("concept_id").distinct().count()
    cols = [c for c in ("concept_id", "id", "lang", "pos", "x", "m") if c in rows.columns]
    dealt = rows.select(*cols, F.pmod(F.xxhash64("concept_id"), F.lit(max(1, -(-n // cfg.bucket)))).alias("bucket"))

    def run(_: tuple, df: pd.DataFrame) -> pd.DataFrame:
        specs, size = [], {}
        for concept, g in df.groupby("concept_id"):
            if "pos" in g:
                g = g.sort_values("pos")
            else:
                g = g.sort_values("id")
                turn = g.groupby("lang").cumcount()
                both = min(int((g.lang == x).sum()) for x in ("en", "es"))
                g = g.assign(over=(turn >= both), turn=turn).sort_values(["over", "turn", "lang"])
            x = np.array(g.x.tolist(), float)
            spec = prepare(str(concept), x, np.array(g.m.tolist(), float) if "m" in g else x, g.lang.to_numpy(), cfg)
            if spec is not None:
                specs.append(spec)
                size[spec.concept] = len(g)
        margin = {s.concept: s.margin for s in specs}
        got = [(c, size[c], margin[c], seen[0], seen[-1], w.tolist()) for c, (w, seen, _) in train_bucket(specs, cfg).items()]
        return pd.DataFrame(got, columns=["concept_id", "n_rows", "margin", "first_loss", "last_loss", "weights"])

    return dealt.groupBy("bucket").applyInPandas(run, HEADS)


def kmeans_best(rows: DataFrame, ks: tuple[int, ...] = (2, 3, 4, 5), seed: int = 42, rounds: int = 50) -> DataFrame:
    """rows(concept_id, id, x) of capped concepts -> (concept_id, k, silhouette, davies_bouldin) of the k with the best exact silhouette; a k
    needs 2k rows."""

    def lloyd(x: np.ndarray, k: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        c = x[[int(rng.integers(len(x)))]]
        while len(c) < k:  # far points are likelier starts
            d = ((x[:, None] - c[None]) ** 2).sum(-1).min(1)
            c = np.r_[c, x[[int(np.searchsorted(np.cumsum(d), rng.random() * d.sum()).clip(0, len(x) - 1))]]]
        label = np.zeros(len(x), int)
        for _ in range(rounds):
            new = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
            if (new == label).all() and _:
                break
            label = new
            c = np.array([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(k)])
        return label

    def to_clusters(x: np.ndarray, of: np.ndarray) -> np.ndarray:
        """of(rows, clusters): who belongs to each -> the mean distance of each row to the others of a cluster, NaN where there are none. Some rows at a time: neither
        all differences nor all distances of a concept are held at once."""
        step = max(1, (1 << 22) // max(x.size, 1))
        sums = np.empty(of.shape)
        for i in range(0, len(x), step):
            sums[i : i + step] = np.sqrt(((x[i : i + step, None] - x[None]) ** 2).sum(-1)) @ of
        n = of.sum(0)[None] - of  # a row's distance to itself is 0
        return np.divide(sums, n, out=np.full(of.shape, np.nan), where=n > 0)

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        x = np.array(df.sort_values("id").x.tolist(), float)
        labels = {k: lloyd(x, k) for k in ks if len(x) >= 2 * k}
        labels = {k: label for k, label in labels.items() if len(np.unique(label)) > 1}
        dist = to_clusters(x, np.concatenate([np.eye(k)[label] for k, label in labels.items()], axis=1)) if labels else None
        best, at = None, 0
        for k, label in labels.items():
            means, at = dist[:, at : at + k], at + k
            own = means[np.arange(len(x)), label]
            other = np.where(np.arange(k)[None] == label[:, None], np.inf, np.nan_to_num(means, nan=np.inf)).min(1)
            s = float(np.where(np.isnan(own), 0.0, (other - own) / np.maximum(np.maximum(own, other), 1e-12)).mean())
            centre = np.array([x[label == j].mean(0) for j in range(k) if (label == j).any()])
            spread = np.array([np.linalg.norm(x[label == j] - x[label == j].mean(0), axis=1).mean() for j in range(k) if (label == j).any()])
            gap = np.linalg.norm(centre[:, None] - centre[None], axis=-1)
            np.fill_diagonal(gap, np.inf)
            db = float(((spread[:, None] + spread[None]) / gap).max(1).mean())
            if best is None or s > best[1]:
                best = (k, s, db)
        if best is None:
            return pd.DataFrame({"concept_id": [], "k": [], "silhouette": [], "davies_bouldin": []}).astype({"concept_id": str, "k": "int64"})
        return pd.DataFrame({"concept_id": [key[0]], "k": [best[0]], "silhouette": [best[1]], "davies_bouldin": [best[2]]})

    return rows.groupBy("concept_id").applyInPandas(run, "concept_id string, k long, silhouette double, davies_bouldin double")


def plane(rows: DataFrame) -> DataFrame:
    """rows(concept_id, id, x) of capped concepts -> (concept_id, id, u, v): the two main components of each concept, signs fixed by the
    largest loading. It stands in for a non-linear projection."""

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("id")
        x = np.array(df.x.tolist(), float)
        _, _, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
        axes = axes[:2] if len(axes) > 1 else np.r_[axes, np.zeros_like(axes)]
        axes = axes * np.where(axes[np.arange(2), np.abs(axes).argmax(1)] < 0, -1.0, 1.0)[:, None]
        at = (x - x.mean(0)) @ axes.T
        return pd.DataFrame({"concept_id": key[0], "id": df.id.to_numpy(), "u": at[:, 0], "v": at[:, 1]})

    return rows.groupBy("concept_id").applyInPandas(run, "concept_id string, id long, u double, v double")
