"""Noise schedules, forward noise, posteriors and losses of graph diffusion, as columns.

Every draw is a function of a seed and the row's keys (``functions.random``),
so noise replays on any partitioning. Coordinates are x, y, z columns; edges and
nodes are rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import session
from ..functions import arrays, random

NOISE = ("uniform", "absorbing", "discretized_gaussian")
SMALL = 1e-8


def check_noise(kind: str) -> str:
    if kind not in NOISE:
        raise ValueError(f"unknown discrete noise type: {kind}")
    return kind


def schedule(spark: SparkSession, steps: int = 500, s: float = 0.008) -> DataFrame:
    """t, alpha_bar for t = 0..steps: a squared cosine that starts at 1."""
    start = math.cos(s / (1 + s) * math.pi / 2) ** 2
    angle = (F.col("t") / F.lit(float(steps)) + F.lit(s)) / F.lit(1 + s) * F.lit(math.pi / 2)
    return spark.range(steps + 1).select(F.col("id").cast("int").alias("t"), (F.pow(F.cos(angle), 2.0) / F.lit(start)).alias("alpha_bar"))


def validation_time(steps: int) -> int:
    """The step at which validation adds noise."""
    return steps // 2


def step_ratios(sched: DataFrame) -> DataFrame:
    """The schedule with alpha_prev, and alpha_t: the share that one step keeps."""
    return sched.withColumn("alpha_prev", F.lag("alpha_bar").over(Window.orderBy("t"))).withColumn("alpha_t", F.col("alpha_bar") / F.col("alpha_prev"))


def reverse_coefficients(ratios: DataFrame) -> DataFrame:
    """What one reverse step takes of the prediction and of the current state, and its deviation."""
    beta, rest = 1 - F.col("alpha_t"), 1 - F.col("alpha_bar")
    return ratios.filter("t > 0").select(
        "t",
        (F.sqrt("alpha_prev") * beta / rest).alias("coef_pred"),
        (F.sqrt("alpha_t") * (1 - F.col("alpha_prev")) / rest).alias("coef_t"),
        F.sqrt((1 - F.col("alpha_prev")) / rest * beta).alias("sigma"),
    )


def centered(rows: DataFrame, by: list[str], columns: list[str], mask: str | None = None) -> DataFrame:
    """Columns less their mean in the group; with a mask, of masked rows over their number plus 1e-6."""
    w = Window.partitionBy(*by)
    if mask is None:
        return rows.withColumns({c: F.col(c) - F.avg(c).over(w) for c in columns})
    n = F.sum(mask).over(w) + 1e-6
    return rows.withColumns({c: F.col(c) - F.sum(F.col(c) * F.col(mask)).over(w) / n for c in columns})


def coordinate_noise(nodes: DataFrame, alpha_bar: Column, seed: int, by: list[str]) -> DataFrame:
    """``nodes`` (by, node, x, y, z, mask) with noisy xt, yt, zt: alpha_bar times the place, plus centred noise."""
    keys = [F.col(k) for k in (*by, "node")]
    eps = {f"e{c}": random.normal(f"{seed}{c}", *keys) * F.col("mask") for c in "xyz"}
    free = centered(nodes.withColumns(eps), by, list(eps), "mask")
    sigma = F.sqrt(1 - alpha_bar)
    return free.withColumns({f"{c}t": alpha_bar * F.col(c) + sigma * F.col(f"e{c}") for c in "xyz"}).drop(*eps)


def edge_noise(y: Column, alpha_bar: Column, kind: str, seed: int, *keys: Column) -> Column:
    """A binary edge after forward noise; each direction has its own draw."""
    check_noise(kind)
    u = random.uniform(seed, *keys)
    if kind == "uniform":
        return F.when(u > alpha_bar, (random.uniform(f"{seed}v", *keys) > 0.5).cast("double")).otherwise(y)
    if kind == "absorbing":
        return F.when(u > alpha_bar, F.lit(0.5)).otherwise(y)
    z = F.sqrt(alpha_bar) * (2 * y - 1) + F.sqrt(1 - alpha_bar) * random.normal(seed, *keys)
    return (z > 0).cast("double")


def uniform_edge(p, y, now, before):
    """The probability of an edge one step earlier under uniform noise; of numbers, arrays or columns alike.

    ``p``: predicted, ``y``: seen, ``now`` and ``before``: the shares of signal left at the step and at the one before.
    """
    keep = now / before
    one = (keep * y + (1 - keep) * 0.5) * p
    zero = (keep * (1 - y) + (1 - keep) * 0.5) * (1 - p)
    return one / (one + zero + SMALL)


def gaussian_edge(p, before, sqrt, erf_of):
    """The probability that a thresholded Gaussian of the predicted edge is positive one step earlier."""
    return 0.5 * (1 + erf_of(sqrt(before) * (2 * p - 1) / (sqrt(1 - before) + SMALL) / math.sqrt(2)))


def uniform_class(p, x, now, before, size: int):
    """The weight of a class one step earlier under uniform noise, before it is normed."""
    keep = now / before
    return (keep * x + (1 - keep) / size) * p


#: Coefficients of rational approximations of the error function, as published by W. J. Cody
#: ("Rational Chebyshev approximations for the error function", Mathematics of Computation 23, 1969), highest power first.
_ERF_SMALL = (
    (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3),
    (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3),
)
_ERF_MIDDLE = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
_ERF_LARGE = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)
#: Where one approximation gives way to the next, and from where on the function is 1 in double precision.
_ERF_ENDS = (0.46875, 4.0, 6.0)


def _ratio(table: tuple, x: Column) -> Column:
    def horner(c: tuple) -> Column:
        out = F.lit(c[0])
        for k in c[1:]:
            out = out * x + F.lit(k)
        return out

    return horner(table[0]) / horner(table[1])


def erf(z: Column) -> Column:
    """The error function, which Spark lacks; errors below 1e-15. Null stays null."""

    def of(v: Column) -> Column:
        y = F.abs(v)
        tail = F.lit(1 / math.sqrt(math.pi)) - _ratio(_ERF_LARGE, 1 / (y * y)) / (y * y)
        beyond = F.when(y <= _ERF_ENDS[1], F.exp(-y * y) * _ratio(_ERF_MIDDLE, y)).when(y <= _ERF_ENDS[2], F.exp(-y * y) / y * tail).otherwise(0.0)
        return F.when(y <= _ERF_ENDS[0], v * _ratio(_ERF_SMALL, v * v)).otherwise(F.signum(v) * (1 - beyond))

    return arrays.let(z.cast("double"), of)


def edge_posterior(logit: Column, yt: Column, alpha_bar: Column, alpha_prev: Column, kind: str) -> Column:
    """The probability of an edge one step earlier; for absorbing noise, of a masked edge that is revealed."""
    check_noise(kind)
    p = arrays.sigmoid(logit)
    if kind == "absorbing":
        return p
    if kind == "discretized_gaussian":
        return gaussian_edge(p, alpha_prev, F.sqrt, erf)
    return uniform_edge(p, yt, alpha_bar, alpha_prev)


def edge_step(logit: Column, yt: Column, alpha_bar: Column, alpha_prev: Column, t: int, kind: str, seed: int, *keys: Column) -> Column:
    """An edge one step earlier: drawn before the last step, decided at it."""
    p, sure = arrays.sigmoid(logit), edge_posterior(logit, yt, alpha_bar, alpha_prev, kind)
    u = random.uniform(seed, *keys)
    if kind == "uniform":
        return (u < sure).cast("double") if t > 1 else (sure > 0.5).cast("double")
    if kind == "discretized_gaussian":
        return (u < sure).cast("double") if t > 1 else (p > 0.5).cast("double")
    if t > 1:
        drawn = F.when(u < alpha_prev, (random.uniform(f"{seed}v", *keys) < p).cast("double")).otherwise(F.lit(0.5))
    else:
        drawn = (p > 0.5).cast("double")
    return F.when(yt == 0.5, drawn).otherwise(yt)


def category_noise(x: list[Column], alpha_bar: Column, kind: str, seed: int, *keys: Column) -> list[Column]:
    """One-hot classes after forward noise."""
    check_noise(kind)
    size = len(x)
    u = random.uniform(seed, *keys)
    if kind == "uniform":
        other = random.integer(size, f"{seed}v", *keys)
        return [F.when(u < alpha_bar, c).otherwise((other == k).cast("double")) for k, c in enumerate(x)]
    if kind == "absorbing":
        return [F.when(u > alpha_bar, F.lit(1 / size)).otherwise(c) for c in x]
    z = F.array(*(F.sqrt(alpha_bar) * c + F.sqrt(1 - alpha_bar) * random.normal(f"{seed}{k}", *keys) for k, c in enumerate(x)))
    return [(arrays.argmax(z) == k).cast("double") for k in range(size)]


def category_posterior(logits: list[Column], xt: list[Column], alpha_bar: Column, alpha_prev: Column, kind: str = "uniform") -> list[Column]:
    """Class probabilities one step earlier, under uniform noise; else those of the prediction."""
    p = arrays.softmax(logits)
    if check_noise(kind) != "uniform":
        return p
    raw = [uniform_class(q, x, alpha_bar, alpha_prev, len(xt)) for x, q in zip(xt, p, strict=True)]
    total = sum(raw[1:], raw[0]) + SMALL
    return [r / total for r in raw]


def drawn_class(probs: list[Column], u: Column) -> Column:
    """The class whose share of the total holds ``u``."""
    total = sum(probs[1:], probs[0])
    out, below = F.lit(len(probs) - 1), None
    steps = []
    for p in probs[:-1]:
        below = p if below is None else below + p
        steps.append(below)
    for k in reversed(range(len(steps))):
        out = F.when(u * total < steps[k], F.lit(k)).otherwise(out)
    return out


def category_step(logits: list[Column], xt: list[Column], alpha_bar: Column, alpha_prev: Column, t: int, kind: str, seed: int, *keys: Column) -> list[Column]:
    """One-hot classes one step earlier: drawn before the last step, the likeliest at it."""
    size = len(xt)
    p = category_posterior(logits, xt, alpha_bar, alpha_prev, kind)
    if kind == "discretized_gaussian":
        z = [F.sqrt(alpha_prev) * q + F.sqrt(1 - alpha_prev) * random.normal(f"{seed}{k}", *keys) for k, q in enumerate(p)] if t > 1 else p
        best = arrays.argmax(F.array(*z))
        return [(best == k).cast("double") for k in range(size)]
    u = random.uniform(seed, *keys)
    best = drawn_class(p, u) if t > 1 else arrays.argmax(F.array(*p))
    new = [(best == k).cast("double") for k in range(size)]
    if kind == "uniform":
        return new
    masked = F.greatest(*xt) < 1 / size + 0.01
    if t > 1:
        reveal = random.uniform(f"{seed}r", *keys) < alpha_prev
        new = [F.when(reveal, c).otherwise(F.lit(1 / size)) for c in new]
    return [F.when(masked, c).otherwise(x) for c, x in zip(new, xt, strict=True)]


def coordinate_loss(square: Column, mask: Column) -> Column:
    """An aggregate: squared errors of active nodes over three times their number, in the whole batch."""
    return F.sum(square * mask) / (F.sum(mask) * 3.0 + 1e-6)


def edge_loss(logit: Column, y: Column) -> Column:
    """An aggregate: mean cross entropy with logits, over all pairs."""
    return F.avg(F.greatest(logit, F.lit(0.0)) - logit * y + F.log1p(F.exp(-F.abs(logit))))


def node_loss(logits: list[Column], target: Column) -> Column:
    """An aggregate: mean cross entropy of classes."""
    chosen = F.get(F.array(*logits), target)
    return F.avg(arrays.log_sum_exp(logits) - chosen)


def accuracy(logits: list[Column], target: Column) -> Column:
    return F.avg((arrays.argmax(F.array(*logits)) == target).cast("double"))


def total_loss(coordinates: Column, edges: Column, nodes: Column) -> Column:
    return 3.0 * coordinates + 2.0 * edges + 1.0 * nodes


def baseline_coordinate(xt: Column, alpha_bar: Column) -> Column:
    """The linear least-squares prediction of a coordinate of unit variance from its noisy state: what a model must beat."""
    return alpha_bar * xt / (alpha_bar * alpha_bar + 1 - alpha_bar)


def baseline_edge(yt: Column, alpha_bar: Column, density: float = 0.25) -> Column:
    """The log odds of an edge given its state under uniform noise, where a share ``density`` of all pairs is joined."""
    spread = (1 - alpha_bar) / 2
    return F.lit(math.log(density / (1 - density))) + F.log((alpha_bar * yt + spread) / (alpha_bar * (1 - yt) + spread))


def baseline_classes(xt: list[Column], alpha_bar: Column) -> list[Column]:
    """Class scores given the state under uniform noise, all classes alike before."""
    return [F.log(alpha_bar * x + (1 - alpha_bar) / len(xt)) for x in xt]


def batch_losses(nodes: DataFrame, pairs: DataFrame, scores: list[str], by: str = "batch") -> DataFrame:
    """by, coord_mse, edge_bce, node_ce, node_acc and their weighted ``loss`` of each batch of padded graphs.

    ``nodes``: by, x, y, z, mask, the predicted xp, yp, zp, class ``scores`` and ``target``, virtual nodes included;
    ``pairs``: by, y and the predicted ``logit`` of all pairs.
    """
    square = sum(((F.col(f"{c}p") - F.col(c)) ** 2 for c in "yz"), (F.col("xp") - F.col("x")) ** 2)
    logits = [F.col(c) for c in scores]
    own = nodes.groupBy(by).agg(
        coordinate_loss(square, F.col("mask")).alias("coord_mse"), node_loss(logits, F.col("target")).alias("node_ce"), accuracy(logits, F.col("target")).alias("node_acc")
    )
    both = own.join(session.shuffled(pairs.groupBy(by).agg(edge_loss(F.col("logit"), F.col("y")).alias("edge_bce"))), by)
    return both.withColumn("loss", total_loss(F.col("coord_mse"), F.col("edge_bce"), F.col("node_ce")))


def pair_features(nodes: DataFrame, by: list[str]) -> DataFrame:
    """All ordered pairs of a graph's nodes, loops included: distance, both norms, and a safe cosine.

    ``nodes``: by, node, x, y, z. A graph has a bounded number of nodes; pairs never leave it.
    """
    a = nodes.select(*by, F.col("node").alias("i"), *(F.col(c).alias(f"{c}i") for c in "xyz"))
    b = nodes.select(*by, F.col("node").alias("j"), *(F.col(c).alias(f"{c}j") for c in "xyz"))
    square = lambda s: F.col(f"x{s}") ** 2 + F.col(f"y{s}") ** 2 + F.col(f"z{s}") ** 2
    apart = sum(((F.col(f"{c}i") - F.col(f"{c}j")) ** 2 for c in "yz"), (F.col("xi") - F.col("xj")) ** 2)
    along = sum((F.col(f"{c}i") * F.col(f"{c}j") for c in "yz"), F.col("xi") * F.col("xj"))
    return a.join(session.shuffled(b), by).select(
        *by, "i", "j", F.sqrt(apart).alias("dist"), F.sqrt(square("i")).alias("norm_i"), F.sqrt(square("j")).alias("norm_j"),
        (along / (F.sqrt(square("i")) * F.sqrt(square("j")) + 1e-6)).alias("cos"),
    )


def message_sums(messages: DataFrame, by: list[str], value: str = "msg") -> DataFrame:
    """by, i, total: messages of all neighbours j summed at node i."""
    return messages.groupBy(*by, "i").agg(F.sum(value).alias("total"))
