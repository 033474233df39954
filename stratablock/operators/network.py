"""The equivariant graph network and its reverse sampling, in numpy, a graph at a time.

Weights are one dictionary of arrays (an NPZ file); they are broadcast. Each
task runs whole sampling loops, so a graph's state never crosses to the JVM
between steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .diffusion import check_noise, gaussian_edge, uniform_class, uniform_edge

Weights = dict[str, np.ndarray]


def random_weights(hidden: int = 64, layers: int = 4, classes: int = 2, seed: int = 0) -> Weights:
    """Untrained weights of the right shapes, for tests and smoke runs."""
    rng = np.random.default_rng(seed)
    w: Weights = {"layers": np.array(layers)}

    def linear(name: str, a: int, b: int, bias: bool = True) -> None:
        w[f"{name}.w"] = rng.normal(0, 1 / math.sqrt(a), (a, b))
        if bias:
            w[f"{name}.b"] = np.zeros(b)

    linear("node_embed", classes, hidden)
    linear("edge_embed", 1, hidden)
    for k in range(layers):
        linear(f"{k}.message.0", 3 * hidden + 4, hidden)
        linear(f"{k}.message.1", hidden, hidden)
        linear(f"{k}.coord.0", hidden, hidden)
        linear(f"{k}.coord.1", hidden, 1, bias=False)
        linear(f"{k}.node.0", 2 * hidden, hidden)
        linear(f"{k}.node.1", hidden, hidden)
        w[f"{k}.coord.1.w"] *= 0.01
    linear("coord_head.0", hidden, hidden)
    linear("coord_head.1", hidden, 1)
    linear("edge_head", hidden, 1)
    linear("node_head.0", hidden, hidden)
    linear("node_head.1", hidden, classes)
    return w


def load_weights(path: str | None) -> Weights:
    """Weights from an NPZ file; a missing one ends the program with status 1."""
    import os
    import sys

    if path is None or not os.path.exists(path):
        print(f"no checkpoint at {path}", file=sys.stderr)
        sys.exit(1)
    with np.load(path) as f:
        return {k: f[k] for k in f.files}


def _linear(w: Weights, name: str, x: np.ndarray) -> np.ndarray:
    out = x @ w[f"{name}.w"]
    return out + w[f"{name}.b"] if f"{name}.b" in w else out


def _silu(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.exp(-np.clip(x, -60, 60)))


def pair_features(r: np.ndarray) -> np.ndarray:
    """[N, N, 4]: distance, both norms, safe cosine."""
    n = len(r)
    size = np.linalg.norm(r, axis=1)
    a, b = np.broadcast_to(size[:, None], (n, n)), np.broadcast_to(size[None, :], (n, n))
    return np.stack([np.linalg.norm(r[:, None] - r[None, :], axis=2), a, b, (r @ r.T) / (a * b + 1e-6)], axis=2)


def layer(w: Weights, k: int, h: np.ndarray, r: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Messages over all pairs, then new coordinates (centred) and node features."""
    n, d = h.shape
    both = (mask[:, None] * mask[None, :])[:, :, None]
    hi, hj = np.broadcast_to(h[:, None], (n, n, d)), np.broadcast_to(h[None, :], (n, n, d))
    msg = np.concatenate([hi, hj, pair_features(r), y], axis=2)
    msg = _silu(_linear(w, f"{k}.message.1", _silu(_linear(w, f"{k}.message.0", msg)))) * both
    pull = _linear(w, f"{k}.coord.1", _silu(_linear(w, f"{k}.coord.0", msg))) * both
    moved = r + (pull * (r[:, None] - r[None, :])).sum(axis=1)
    moved = (moved - (moved * mask[:, None]).sum(axis=0) / (mask.sum() + 1e-6)) * mask[:, None]
    update = _linear(w, f"{k}.node.1", _silu(_linear(w, f"{k}.node.0", np.concatenate([h, msg.sum(axis=1)], axis=1))))
    return (h + update) * mask[:, None], moved


def forward(w: Weights, x: np.ndarray, r: np.ndarray, y: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Predicted coordinates, symmetric edge logits and class logits of one graph.

    ``x`` [N, classes], ``r`` [N, 3], ``y`` [N, N, 1].
    """
    active = np.ones(len(r)) if mask is None else mask
    h, edge = _linear(w, "node_embed", x), _linear(w, "edge_embed", y)
    for k in range(int(w["layers"])):
        h, r = layer(w, k, h, r, edge, active)
    scale = _linear(w, "coord_head.1", _silu(_linear(w, "coord_head.0", h)))
    out = r + r / (np.linalg.norm(r, axis=1, keepdims=True) + 1e-6) * scale
    if mask is not None:
        out = (out - (out * mask[:, None]).sum(axis=0) / (mask.sum() + 1e-6)) * mask[:, None]
    logits = _linear(w, "edge_head", h[:, None] + h[None, :])[:, :, 0]
    return out, (logits + logits.T) / 2, _linear(w, "node_head.1", _silu(_linear(w, "node_head.0", h)))


def alphas(steps: int, s: float = 0.008) -> np.ndarray:
    a = np.cos((np.arange(steps + 1) / steps + s) / (1 + s) * math.pi / 2) ** 2
    return a / a[0]


def sample(w: Weights, n: int, classes: int, steps: int, kind: str, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One graph by reverse diffusion: coordinates, edge probabilities and node classes of the last prediction."""
    check_noise(kind)
    eye = np.eye(classes)
    bar = alphas(steps)
    r = rng.normal(size=(n, 3))
    r -= r.mean(axis=0)
    if kind == "absorbing":
        y, x = np.full((n, n, 1), 0.5), np.full((n, classes), 1 / classes)
    else:
        y, x = (rng.random((n, n, 1)) > 0.5) * 1.0, eye[rng.integers(0, classes, n)]
    logits = kinds = None
    for t in range(steps, 0, -1):
        guess, logits, kinds = forward(w, x, r, y)
        now, before = bar[t], bar[t - 1]
        keep = now / before
        r = math.sqrt(before) * (1 - keep) / (1 - now) * guess + math.sqrt(keep) * (1 - before) / (1 - now) * r
        if t > 1:
            z = rng.normal(size=(n, 3))
            r += math.sqrt((1 - before) / (1 - now) * (1 - keep)) * (z - z.mean(axis=0))
        y = _edges_before(logits[:, :, None], y, now, before, t, kind, rng)
        x = _classes_before(kinds, x, now, before, t, kind, rng, eye)
    return r, 1 / (1 + np.exp(-np.clip(logits, -60, 60))), kinds.argmax(axis=1)


def _edges_before(logit, y, now, before, t, kind, rng):
    """Edges one step earlier: drawn from their posterior, and decided at the last step."""
    p = 1 / (1 + np.exp(-np.clip(logit, -60, 60)))
    if kind == "uniform":
        sure = decisive = uniform_edge(p, y, now, before)
    else:
        sure = p if kind == "absorbing" else gaussian_edge(p, before, math.sqrt, np.vectorize(math.erf))
        decisive = p
    new = (rng.random(p.shape) < sure if t > 1 else decisive > 0.5) * 1.0
    if kind != "absorbing":
        return new
    shown = np.ones(p.shape, bool) if t == 1 else rng.random(p.shape) < before
    return np.where(y != 0.5, y, np.where(shown, new, 0.5))


def _classes_before(logits, x, now, before, t, kind, rng, eye):
    """One-hot classes one step earlier, as for edges; those under absorbing noise that show already stay."""
    weight = np.exp(logits - logits.max(axis=1, keepdims=True))
    weight /= weight.sum(axis=1, keepdims=True)
    size = len(eye)
    if kind == "uniform":
        weight = uniform_class(weight, x, now, before, size)
    last = t == 1
    if last or kind == "discretized_gaussian":
        noise = 0.0 if last else math.sqrt(1 - before) * rng.normal(size=weight.shape)
        best = ((1.0 if last else math.sqrt(before)) * weight + noise).argmax(axis=1)
    else:
        best = (rng.random((len(weight), 1)) * weight.sum(axis=1, keepdims=True) < np.cumsum(weight, axis=1)).argmax(axis=1)
    new = eye[best]
    if kind != "absorbing":
        return new
    shown = last | (rng.random((len(weight), 1)) < before)
    hidden = x.max(axis=1, keepdims=True) < 1 / size + 0.01
    return np.where(hidden, np.where(shown, new, 1 / size), x)


def sample_graphs(spark: SparkSession, weights: Weights, count: int, n: int, steps: int = 500, kind: str = "uniform", classes: int = 2, seed: int = 0) -> DataFrame:
    """id, nodes ARRAY<STRUCT<node,x,y,z,class>>, probs ARRAY<STRUCT<src,dst,prob>> of ``count`` sampled graphs."""
    check_noise(kind)
    shared = spark.sparkContext.broadcast(weights)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i in f["id"]:
                r, p, c = sample(shared.value, n, classes, steps, kind, np.random.default_rng([seed, int(i)]))
                nodes = [{"node": k, "x": float(a), "y": float(b), "z": float(z), "class": int(c[k])} for k, (a, b, z) in enumerate(r)]
                probs = [{"src": a, "dst": b, "prob": float(p[a, b])} for a in range(n) for b in range(n)]
                rows.append((int(i), nodes, probs))
            yield pd.DataFrame(rows, columns=["id", "nodes", "probs"])

    schema = "id long, nodes array<struct<node:int,x:double,y:double,z:double,class:int>>, probs array<struct<src:int,dst:int,prob:double>>"
    return spark.range(count).mapInPandas(run, schema)


def generate(spark: SparkSession, weights: Weights, count: int, n: int, threshold: float = 0.5, **options) -> DataFrame:
    """id, vertices, boundaries, surface_values of the sampled buildings that close at least one face."""
    from pyspark.sql import functions as F

    from . import cycles, export

    found = sample_graphs(spark, weights, count, n, **options)
    nodes = found.select("id", F.inline("nodes"))
    probs = found.select("id", F.inline("probs"))
    numbered, among = cycles.active_edges(probs, nodes.select("id", "node", "class"))
    at = nodes.join(numbered, ["id", "node"]).select("id", F.col("new").alias("node"), "x", "y", "z")
    return export.reconstruct(at, among, threshold)
