"""Quality classifier by positive-unlabelled learning.

A small network minimises the non-negative unbiased risk: trusted positives, unlabelled
web text, and the class prior.  With loss l, risk
    prior * E_pos[l(f)] + max(0, E_unl[l(-f)] - prior * E_pos[l(-f)])
where the second term estimates the negatives' risk; when a batch makes it negative its
gradient is followed upwards, which keeps the network from fitting the positives alone.

The prior comes from positives and unlabelled text alone: a logistic model tells one half
of either apart, and on the other halves the share of unlabelled texts above a threshold,
divided by the share of positives above it, is at least the prior for every threshold.
The threshold with the least upper bound gives the estimate.

Learning takes bounded samples (`most_positive`, `most_unlabelled` rows, those with the
smallest hashes of their id), so what reaches the driver is bounded whatever the input.
Scores read every whole text.  Inputs are byte frequencies and repetition statistics of
the text; labels, language, source and id are never inputs.

Defined results: a null text is scored as an empty one; without positives every score is
the prior 0.5; repeated rows are scored alike; an empty table gives no rows; other columns
are carried through, but those named score and predicted are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

N_STATS = 8
WIDTH = 256 + N_STATS


def features(text: str | None) -> np.ndarray:
    """Square roots of byte frequencies, then statistics of words and lines."""
    raw = (text or "").encode()
    out = np.zeros(WIDTH, np.float32)
    if not raw:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    out[:256] = np.sqrt(counts / len(raw))
    words = raw.split()
    n = len(words)
    if not n:
        return out
    lines = [x for x in raw.split(b"\n") if x]
    seen = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    out[256:] = (
        np.log1p(n) / 10,
        (len(raw) - n) / n / 10,
        seen / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        pairs / max(1, n - 1),
        len(set(lines)) / max(1, len(lines)),
        np.log1p(len(lines)) / 10,
        max(map(len, words)) / 100,
    )
    return np.clip(out, 0, 4)


@dataclass
class Network:
    """One hidden layer; score = sigmoid of its output."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.maximum(z @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x).astype(np.float64), -30, 30)))


Params = list[np.ndarray]


def risk(params: Params, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, float]:
    """The positives' part of the risk and the negatives' part, before it is held above zero (sigmoid loss)."""

    def loss(x: np.ndarray) -> float:
        f = np.maximum(x @ params[0] + params[1], 0) @ params[2] + params[3][0]
        return float((1 / (1 + np.exp(-np.clip(f, -30, 30)))).mean())  # of -f; that of f is one less this

    return prior * (1 - loss(xp)), loss(xu) - prior * loss(xp)


def gradients(params: Params, xp: np.ndarray, xu: np.ndarray, prior: float) -> Params:
    """Of the whole risk, or, where the negatives' part is below zero, of that part turned upwards."""
    x = np.concatenate([xp, xu])
    h = np.maximum(x @ params[0] + params[1], 0)
    f = h @ params[2] + params[3][0]
    s = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
    slope = s * (1 - s)
    p, u = slice(0, len(xp)), slice(len(xp), None)
    g = np.zeros_like(f)
    if s[u].mean() - prior * s[p].mean() >= 0:
        g[p], g[u] = -2 * prior * slope[p] / len(xp), slope[u] / len(xu)
    else:
        g[p], g[u] = prior * slope[p] / len(xp), -slope[u] / len(xu)
    back = np.outer(g, params[2]) * (h > 0)
    return [x.T @ back, back.sum(axis=0), h.T @ g, np.array([g.sum()], f.dtype)]


def _adam(params: Params, steps: int, grads, rate: float) -> None:
    """Follow `grads(step)` downwards, in place."""
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        for k, grad in enumerate(grads(step)):
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad**2
            params[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)


def _scaled(*parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    both = np.concatenate(parts)
    scale = both.std(axis=0)
    mean, scale = both.mean(axis=0), np.where(scale < 1e-3, 1e-1, scale)
    return mean, scale, [np.clip((x - mean) / scale, -8, 8) for x in parts]


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 5) -> float:
    """Share of positives among the unlabelled rows, estimated without any negative label; between 0.05 and 0.95."""
    rng = np.random.default_rng(seed)
    _, _, (p, u) = _scaled(positive, unlabelled)
    p, u = p[rng.permutation(len(p))], u[rng.permutation(len(u))]
    half_p, half_u = max(1, len(p) // 2), max(1, len(u) // 2)
    x = np.concatenate([p[:half_p], u[:half_u]])
    y = np.concatenate([np.ones(half_p), np.zeros(half_u)])
    weight = np.where(y == 1, 0.5 / half_p, 0.5 / half_u)
    params = [np.zeros(x.shape[1]), np.zeros(1)]

    def grads(step: int) -> Params:
        g = (1 / (1 + np.exp(-np.clip(x @ params[0] + params[1][0], -30, 30))) - y) * weight
        return [x.T @ g + 1e-3 * params[0], np.array([g.sum()])]

    _adam(params, 200, grads, 2e-2)
    sp, su = (np.sort(z @ params[0]) for z in (p[half_p:] if len(p) > 1 else p, u[half_u:] if len(u) > 1 else u))
    at = np.unique(np.quantile(sp, np.linspace(0, 0.95, 96)))
    above_p, above_u = 1 - np.searchsorted(sp, at) / len(sp), 1 - np.searchsorted(su, at) / len(su)
    error = np.sqrt(np.log(40) / 2) * (len(sp) ** -0.5 + len(su) ** -0.5)
    best = np.argmin((above_u + error) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.95))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 24, epochs: int = 40, seed: int = 3) -> Network:
    """Minimise the non-negative risk by Adam on batches of 256 rows of either kind."""
    rng = np.random.default_rng(seed)
    mean, scale, (zp, zu) = _scaled(positive, unlabelled)
    width, size = positive.shape[1], 256
    params = [rng.normal(0, (2 / width) ** 0.5, (width, hidden)).astype(np.float32), np.zeros(hidden, np.float32), rng.normal(0, hidden**-0.5, hidden).astype(np.float32), np.zeros(1, np.float32)]
    each = -(-len(zu) // size)
    order = rng.permutation(len(zu))

    def grads(step: int) -> Params:
        nonlocal order
        at = (step - 1) % each
        if at == 0:
            order = rng.permutation(len(zu))
        xu, xp = zu[order[at * size : (at + 1) * size]], zp[rng.integers(0, len(zp), size)]
        out = gradients(params, xp, xu, prior)
        out[0] = out[0] + 1e-5 * params[0]
        return out

    _adam(params, epochs * each, grads, 3e-3)
    return Network(mean, scale, params[0], params[1], params[2], float(params[3][0]))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 1 modulo 3."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learn(
    docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", most_positive: int = 6000, most_unlabelled: int = 12000
) -> Network | None:
    """Fit on bounded samples of the rows that are not held out; None without positives.  Negative labels are not read."""
    judged = labels.where((F.col("quality") == 1) & F.col(id_col).isNotNull() & ~held_out(id_col))

    def sample(ids: DataFrame, most: int) -> DataFrame:
        return ids.select(id_col).dropDuplicates().orderBy(F.xxhash64(F.col(id_col), F.lit(11)), id_col).limit(most)

    trusted = sample(judged, most_positive).withColumn("trusted", F.lit(True))
    web = sample(docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)), most_unlabelled).withColumn("web", F.lit(True))
    picked = trusted.join(web, id_col, "full")  # at most most_positive + most_unlabelled rows: safe to broadcast

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"trusted": b["trusted"].notna(), "web": b["web"].notna(), "x": [features(t).tobytes() for t in b["text"]]})

    rows = (
        docs.select(id_col, F.col(text).alias("text"))
        .join(F.broadcast(picked), id_col)
        .orderBy(id_col)
        .select("trusted", "web", "text")
        .mapInPandas(vectors, "trusted boolean, web boolean, x binary")
        .toPandas()
    )
    if not len(rows):
        return None
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(-1, WIDTH)
    if not rows["trusted"].any() or not rows["web"].any():
        return None
    positive, web = x[rows["trusted"].to_numpy()], x[rows["web"].to_numpy()]
    return fit(positive, web, class_prior(positive, web))


def score(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """Add score (0 to 1) and predicted (1 if score >= 0.5) to every row."""
    if net is None:
        return docs.withColumn("score", F.lit(0.5)).withColumn("predicted", F.lit(1))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            out = [net.score(np.stack([features(t) for t in b[at : at + 2048]])) for at in range(0, len(b), 2048)]
            yield pd.Series(np.concatenate(out) if out else [], dtype=float)

    out = docs.withColumn("score", scored(F.col(text)))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
