"""Generalised least squares with autoregressive errors (M7, M8).

Each series (a calendar month, say) is followed along time (years). A row whose last p times are all there, or that has
nothing but a gap-free start of its series before it, needs those rows only: one Spark pass adds up the products of such
rows with their predecessors, and for any autoregressive coefficients the likelihood is a function of these few sums.

Rows behind a gap, up to the next p times in a row, form stretches that a Kalman filter follows: the state is the last p
values of the process, a gap is a power of its transition matrix. A stretch starts from the p rows before it, so
stretches are independent of each other. All trial coefficients of a search step are filtered in one Spark pass over the
stretches, and only sums over all of them come back. Sums and stretches of order p serve the lower orders, too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanaq.operators.coefficients import coefficient_table
from almanaq.operators.within import model_rows
from almanaq.sources.package import ship_package
from almanaq.sources.tables import materialise

_CELLS = 1 << 20  # numbers of the filters' states that are carried side by side in a task


class LagSums(NamedTuple):
    """Sums of products of rows ``(1, xs, y)`` with their predecessors, and what they can't describe.

    ``groups[k]`` is the number of rows with k predecessors (at consecutive times) that matter, and an array
    ``[i, j, a, b]``: entry a of predecessor i (0 is the row itself) times entry b of predecessor j. ``stretches`` has a
    row per stretch behind a gap: ``times``, ``values`` (rows one after another), and ``known``, how many of its first
    rows only set the state. None without gaps.
    """

    order: int
    groups: dict[int, tuple[int, np.ndarray]]
    stretches: DataFrame | None
    rows: int


def lag_sums(df: DataFrame, y: str, xs: Sequence[str], time: str, group: str | Sequence[str], p: int) -> LagSums:
    """The sums for orders up to p. Raises when a time repeats inside a series.

    The windows order one series, which has one row per time.
    """
    by = [group] if isinstance(group, str) else list(group)
    variables = [*xs, y]
    m = len(variables) + 1
    data = model_rows(df, [*by, time], variables)
    along = Window.partitionBy(*by).orderBy("_t")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    data = data.select(*by, F.col(time).cast("long").alias("_t"), F.array(F.lit(1.0), *[F.col(v) for v in variables]).alias("_q"))
    ordered = data.select(
        *by, "_t", "_q", F.row_number().over(along).alias("_at"), (F.col("_t") - F.lag("_t").over(along)).alias("_step"),
        F.collect_list(F.struct(F.col("_t").alias("t"), F.col("_q").alias("q"))).over(along.rowsBetween(-p, -1)).alias("_before"))
    starts = F.max(F.when(F.col("_step").isNull() | (F.col("_step") != 1), F.col("_at"))).over(so_far)
    ordered = ordered.withColumn("_start", starts).withColumn("_run", F.col("_at") - F.col("_start"))
    ordered = ordered.withColumn("_open", (F.col("_start") > 1) & (F.col("_run") < p))
    # Each closed row against itself and its predecessors: at most (p + 1)(p + 2) / 2 pairs.
    size = F.when(~F.col("_open"), F.least("_run", F.lit(p))).cast("int")
    own = F.concat(F.array("_q"), F.transform(F.slice(F.reverse("_before"), F.lit(1), F.coalesce(size, F.lit(0))), lambda x: x["q"]))
    pairs = ordered.select(size.alias("_k"), "_step", own.alias("_rows")).select("_k", "_step", "_rows", F.posexplode("_rows").alias("_i", "_a"))
    pairs = pairs.select("_k", "_step", "_i", "_a", F.posexplode("_rows").alias("_j", "_b")).where("_j >= _i")
    table = pairs.groupBy("_k", "_i", "_j").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_step") < 1).alias("repeats"),
        *[F.sum(F.get("_a", F.lit(a)) * F.get("_b", F.lit(b))).alias(f"_{a}_{b}") for a in range(m) for b in range(m)]).collect()
    if not table:
        raise ValueError("no complete rows")
    if sum(row["repeats"] for row in table):
        raise ValueError(f"{time} repeats inside a {group}")
    groups: dict[int, tuple[int, np.ndarray]] = {}
    open_rows = 0
    for row in table:
        k, i, j = row["_k"], row["_i"], row["_j"]
        if k is None:
            open_rows = row["rows"]
            continue
        _, products = groups.setdefault(k, (row["rows"], np.zeros((k + 1, k + 1, m, m))))
        products[i, j] = np.array([[row[f"_{a}_{b}"] for b in range(m)] for a in range(m)])
        products[j, i] = products[i, j].T
    stretches = None
    if open_rows:
        first = F.col("_open") & ~F.coalesce(F.lag("_open").over(along), F.lit(False))
        opened = ordered.withColumn("_stretch", F.sum(first.cast("int")).over(so_far)).where("_open")
        listed = opened.groupBy(*by, "_stretch").agg(
            F.min_by("_before", "_t").alias("_before"), F.array_sort(F.collect_list(F.struct(F.col("_t").alias("t"), F.col("_q").alias("q")))).alias("_rows"))
        whole = F.concat("_before", "_rows")
        tasks = df.sparkSession.sparkContext.defaultParallelism
        stretches = materialise(listed.repartition(tasks, *by, "_stretch").select(
            F.transform(whole, lambda x: x["t"]).alias("times"), F.flatten(F.transform(whole, lambda x: x["q"])).alias("values"),
            F.size("_before").alias("known")))
    return LagSums(p, groups, stretches, open_rows + sum(rows for rows, _ in groups.values()))


def ar_from_partial(partial: Sequence[float], up_to: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """AR coefficients, and autocorrelations at distances 0, 1, ... from partial autocorrelations."""
    phi, r, v = np.zeros(0), [1.0], 1.0
    for kappa in partial:
        r.append(float(kappa * v + sum(phi[i] * r[len(phi) - i] for i in range(len(phi)))))
        phi = np.append(phi - kappa * phi[::-1], kappa)
        v *= 1.0 - kappa ** 2
    while len(r) <= up_to:
        r.append(float(phi @ r[:-len(phi) - 1:-1]))
    return phi, np.array(r)


class Fit(NamedTuple):
    loglik: float
    beta: np.ndarray
    covariance: np.ndarray
    sigma2: float
    phi: np.ndarray


def filtered(times: list[np.ndarray], values: list[np.ndarray], known: np.ndarray, partials: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over some stretches, for each row of ``partials``: ``v v' / f`` of the prediction errors v of ``(1, xs, y)`` with
    variance f, and ``log f``. The process has variance 1."""
    trials, p = partials.shape
    m = values[0].shape[1]
    phi_r = [ar_from_partial(k, p) for k in partials]
    step = np.zeros((trials, p, p))
    step[:, 0] = [phi for phi, _ in phi_r]
    step[:, np.arange(1, p), np.arange(p - 1)] = 1.0
    gamma = np.array([r[np.abs(np.subtract.outer(np.arange(p), np.arange(p)))] for _, r in phi_r])
    longest = max((int(np.diff(t).max(initial=1)) for t in times), default=1)
    powers = [step]  # over 1, 2, 4, ... times
    while 1 << len(powers) <= longest:
        powers.append(powers[-1] @ powers[-1])
    w, log_f = np.zeros((trials, m, m)), np.zeros(trials)
    order = sorted(range(len(times)), key=lambda i: -len(times[i]))
    side = max(1, _CELLS // (trials * p * (p + m)))
    for lo in range(0, len(order), side):
        part = order[lo:lo + side]
        length = np.array([len(times[i]) for i in part])
        state, spread = np.zeros((len(part), trials, p, m)), np.zeros((len(part), trials, p, p))  # spread: less the one at rest
        for k in range(int(length[0])):
            n = int((length > k).sum())  # the stretches are ordered by length
            here = part[:n]
            a, q = state[:n], spread[:n]
            if k:
                gap = np.array([times[i][k] - times[i][k - 1] for i in here])
                for bit, power in enumerate(powers):
                    at = np.flatnonzero(gap >> bit & 1)
                    if len(at) == n:
                        a, q = power @ a, power @ q @ power.swapaxes(1, 2)
                    elif len(at):
                        a[at], q[at] = power @ a[at], power @ q[at] @ power.swapaxes(1, 2)
            cover = gamma + q
            f = np.maximum(cover[..., 0, 0], 1e-300)
            v = np.array([values[i][k] for i in here])[:, None, :] - a[:, :, 0, :]
            scored = known[here] <= k
            if scored.any():
                vs, fs = v[scored], f[scored]
                w += np.einsum("ska,skb->kab", vs / fs[..., None], vs)
                log_f += np.log(fs).sum(0)
            gain = cover[..., 0] / f[..., None]
            state[:n] = a + gain[..., None] * v[:, :, None, :]
            spread[:n] = q - gain[..., None] * cover[..., 0][:, :, None, :]
    return w, log_f


def _stretch_sums(stretches: DataFrame, m: int, partials: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``filtered`` over all stretches in one pass: a row per trial and task goes to the sums."""
    ship_package(stretches.sparkSession)
    size = m * m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, log_f = np.zeros((len(partials), m, m)), np.zeros(len(partials))
        for b in batches:
            times = [np.array(t) for t in b.column(0).to_pylist()]
            values = [np.array(v).reshape(-1, m) for v in b.column(1).to_pylist()]
            if times:
                more = filtered(times, values, np.array(b.column(2)), partials)
                w, log_f = w + more[0], log_f + more[1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(partials))), pa.array(log_f), *(pa.array(w.reshape(-1, size)[:, i]) for i in range(size))],
            ["trial", "log_f", *[f"w{i}" for i in range(size)]])

    schema = "trial long, log_f double, " + ", ".join(f"w{i} double" for i in range(size))
    sums = stretches.mapInArrow(run, schema).groupBy("trial").agg(F.sum("log_f").alias("log_f"), *[F.sum(f"w{i}").alias(f"w{i}") for i in range(size)])
    w, log_f = np.zeros((len(partials), size)), np.zeros(len(partials))
    for row in sums.collect():  # a row per trial
        log_f[row["trial"]] = row["log_f"]
        w[row["trial"]] = [row[f"w{i}"] for i in range(size)]
    return w.reshape(-1, m, m), log_f


def fit_many(sums: LagSums, partials: Sequence[Sequence[float]]) -> list[Fit]:
    """Restricted log likelihood and estimates at each of several partial autocorrelations, all of one order.

    With gaps one Spark pass for all of them, without gaps none.
    """
    trials = np.array(partials, float)
    p = trials.shape[1]
    if p > sums.order:
        raise ValueError(f"sums of order {sums.order} don't hold order {p}")
    groups: dict[int, tuple[int, np.ndarray]] = {}
    for k, (rows, products) in sums.groups.items():
        size = min(k, p)
        old = groups.get(size, (0, 0.0))
        groups[size] = rows + old[0], products[:size + 1, :size + 1] + old[1]
    m = next(iter(sums.groups.values()))[1].shape[-1]
    if sums.stretches is not None:
        gap_w, gap_log = _stretch_sums(sums.stretches, m, trials)
    fits = []
    for t, partial in enumerate(trials):
        phi, r = ar_from_partial(partial)
        w, log_v = (gap_w[t], gap_log[t]) if sums.stretches is not None else (0.0, 0.0)
        for k, (rows, products) in groups.items():
            at = np.arange(k + 1)
            corr = r[np.abs(np.subtract.outer(at, at))]
            weights = np.linalg.solve(corr[1:, 1:], corr[1:, 0])
            v = 1.0 - weights @ corr[1:, 0]
            a = np.concatenate([[1.0], -weights])
            w = w + np.einsum("i,j,ijab->ab", a, a, products) / v
            log_v += rows * np.log(v)
        fits.append(_solved(w, log_v, sums.rows, phi))
    return fits


def _solved(w: np.ndarray, log_v: float, rows: int, phi: np.ndarray) -> Fit:
    k = w.shape[0] - 1
    xx, xy = w[:k, :k], w[:k, k]
    beta = np.linalg.solve(xx, xy)
    dof = rows - k
    rss = w[k, k] - xy @ beta
    sigma2 = rss / dof
    loglik = -0.5 * (dof * (np.log(2 * np.pi * sigma2) + 1.0) + log_v + np.linalg.slogdet(xx)[1])
    return Fit(loglik, beta, sigma2 * np.linalg.inv(xx), sigma2, phi)


def fit_at(sums: LagSums, partial: Sequence[float]) -> Fit:
    """Restricted log likelihood and estimates at given partial autocorrelations."""
    return fit_many(sums, [partial])[0]


def _grid(p: int) -> np.ndarray:
    line = np.linspace(-0.9, 0.9, 13 if p < 3 else 7)
    return np.stack(np.meshgrid(*[line] * p), axis=-1).reshape(-1, p)


def _maximise(score, p: int) -> np.ndarray:
    """Partial autocorrelations with the best score: a coarse grid, then a simplex on the atanh scale, twice."""
    best = max(_grid(p), key=score)
    point = np.arctanh(best)
    for size in (0.3, 0.02, 0.001):
        point = _simplex(lambda z: -score(np.tanh(z)), point, size)
    return np.tanh(point)


def _maximise_in_steps(scores: Callable[[np.ndarray], np.ndarray], p: int) -> np.ndarray:
    """The same maximum with few calls, each for many trial points at once: a coarse grid, then Newton steps on the atanh
    scale, the slopes and curvatures taken from the points around, with several step lengths tried together."""
    grid = _grid(p)
    point = np.arctanh(grid[int(np.argmax(scores(grid)))])
    eye, width = np.eye(p), 0.05
    ahead = [(i, j) for i in range(p) for j in range(i)]
    for _ in range(60):
        around = [np.zeros(p), *eye, *-eye, *(eye[i] + eye[j] for i, j in ahead)]
        value = scores(np.tanh(point + width * np.array(around)))
        up, down = value[1:p + 1], value[p + 1:2 * p + 1]
        slope, curve = (up - down) / (2 * width), np.diag(up + down - 2 * value[0]) / width ** 2
        for (i, j), both in zip(ahead, value[2 * p + 1:]):
            curve[i, j] = curve[j, i] = (both - up[i] - up[j] + value[0]) / width ** 2
        size, basis = np.linalg.eigh(curve)
        move = basis @ ((basis.T @ slope) / np.maximum(np.abs(size), 1e-8))  # uphill whatever the curvature
        move *= min(1.0, 1.0 / max(np.abs(move).max(), 1e-300))
        if np.abs(move).max() < 1e-7:
            return np.tanh(point)
        lengths = np.array([1.0, 0.5, 0.2, 0.05])
        tried = point + lengths[:, None] * move
        gained = scores(np.tanh(tried)) - value[0]
        if gained.max() > 0:
            point = tried[int(np.argmax(gained))]
            width = float(np.clip(np.abs(move).max(), 1e-3, width))
        elif width > 1e-3:
            width = max(width / 5, 1e-3)
        else:  # nothing above rounding is left to gain
            return np.tanh(point)
    raise ArithmeticError("the likelihood search did not converge")


def maximum(sums: LagSums, p: int) -> Fit:
    """The fit with the largest restricted likelihood among those of order p."""
    if sums.stretches is None:
        return fit_at(sums, _maximise(lambda q: fit_at(sums, q).loglik, p))
    return fit_at(sums, _maximise_in_steps(lambda q: np.array([f.loglik for f in fit_many(sums, q)]), p))


def _simplex(loss, start: np.ndarray, size: float) -> np.ndarray:
    """Nelder-Mead downhill search."""
    points = [start] + [start + size * e for e in np.eye(len(start))]
    values = [loss(q) for q in points]
    for _ in range(2000):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if max(np.max(np.abs(q - points[0])) for q in points[1:]) < 1e-10:
            break
        centre = np.mean(points[:-1], axis=0)
        mirrored = centre + (centre - points[-1])
        value = loss(mirrored)
        if value < values[0]:
            further = centre + 2 * (centre - points[-1])
            far_value = loss(further)
            points[-1], values[-1] = (further, far_value) if far_value < value else (mirrored, value)
        elif value < values[-2]:
            points[-1], values[-1] = mirrored, value
        else:
            inner = centre + 0.5 * ((mirrored if value < values[-1] else points[-1]) - centre)
            inner_value = loss(inner)
            if inner_value < min(value, values[-1]):
                points[-1], values[-1] = inner, inner_value
            else:
                points = [points[0]] + [points[0] + 0.5 * (q - points[0]) for q in points[1:]]
                values = [values[0]] + [loss(q) for q in points[1:]]
    else:
        raise ArithmeticError("the likelihood search did not converge")
    return points[int(np.argmin(values))]


def gls_ar(
    df: DataFrame, y: str, xs: Sequence[str], time: str, group: str | Sequence[str], p: int = 1, sums: LagSums | None = None,
) -> DataFrame:
    """GLS of y on xs (with intercept) under AR(p) errors along ``time`` inside each ``group``, by restricted likelihood.

    Several orders can share the ``sums`` of the highest one (``lag_sums``). Missing times count by their real distance.
    """
    sums = sums or lag_sums(df, y, xs, time, group, p)
    fit = maximum(sums, p)
    return coefficient_table(
        df.sparkSession, ["(Intercept)", *xs], fit.beta, np.sqrt(np.diag(fit.covariance)), sums.rows - len(fit.beta),
        {"n_obs": sums.rows, "sigma": float(np.sqrt(fit.sigma2)), "log_lik": float(fit.loglik),
         **{f"phi_{i}": float(v) for i, v in enumerate(fit.phi, 1)}})


def gls_ar_profile(
    df: DataFrame, y: str, xs: Sequence[str], time: str, group: str | Sequence[str], partials: Sequence[Sequence[float]],
) -> DataFrame:
    """The fit at each of several given partial autocorrelations, all of one order, from one pass over the data.

    One row per entry: ``partial_i``, ``phi_i``, ``log_lik``, ``sigma``, coefficients and their standard errors.
    """
    p = len(partials[0])
    sums = lag_sums(df, y, xs, time, group, p)
    names = ["intercept", *xs]
    rows = []
    for partial, fit in zip(partials, fit_many(sums, partials)):
        rows.append([float(v) for v in (
            *partial, *fit.phi, fit.loglik, np.sqrt(fit.sigma2), *fit.beta, *np.sqrt(np.diag(fit.covariance)))])
    columns = [f"{kind}_{i}" for kind in ("partial", "phi") for i in range(1, p + 1)]
    columns += ["log_lik", "sigma", *names, *[f"se_{n}" for n in names]]
    return df.sparkSession.createDataFrame(rows, ", ".join(f"{c} double" for c in columns))
