"""ARMA models of one series by exact Gaussian likelihood, several orders side by side."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Greatest magnitude of a free parameter, which keeps partial autocorrelations within 0.9988; steps of the search, and the gain of the mean log-likelihood at which it ends.
BOUND, STEPS, GAIN = 20.0, 60, 1e-9
#: Step lengths that are tried at once.
LENGTHS = np.array([1.0, 0.5, 0.2, 0.06, 0.015, 0.002])


def coefficients(free: np.ndarray, n_ar: int) -> tuple[np.ndarray, np.ndarray]:
    """(phi, theta) of rows of free parameters: partial autocorrelations z / sqrt(1 + z^2), so that every model is stationary and invertible."""

    def levinson(z: np.ndarray) -> np.ndarray:
        r, out = z / np.sqrt(1 + z * z), np.zeros_like(z)
        for k in range(z.shape[1]):
            out[:, :k] -= r[:, [k]] * out[:, :k][:, ::-1]
            out[:, k] = r[:, k]
        return out

    return levinson(free[:, :n_ar]), -levinson(free[:, n_ar:])


def kalman(y: np.ndarray, phi: np.ndarray, theta: np.ndarray, constant: bool) -> dict:
    """Of every row of coefficients: log-likelihood (variance and mean at their best values), mean, variance, prediction errors, state ahead.

    The state has the value to come first. The filter runs over the series and over a series of ones at once, whose errors give the mean by
    generalised least squares. Once the state's variance has settled it is no longer updated.
    """
    m, n = len(phi), len(y)
    r = max(phi.shape[1], theta.shape[1] + 1)
    a1, b1 = np.zeros((m, r)), np.zeros((m, r))
    a1[:, : phi.shape[1]] = phi
    b1[:, 0], b1[:, 1 : theta.shape[1] + 1] = 1.0, theta
    noise = b1[:, :, None] * b1[:, None, :]
    forward = lambda x: a1[:, :, None] * x[:, :1, :] + np.concatenate([x[:, 1:, :], np.zeros((m, 1, x.shape[2]))], axis=1)
    turn = np.zeros((m, r, r))
    turn[:, :, 0] = a1
    turn[:, np.arange(r - 1), np.arange(1, r)] = 1.0
    both = (turn[:, :, None, :, None] * turn[:, None, :, None, :]).reshape(m, r * r, r * r)
    spread = np.linalg.solve(np.eye(r * r) - both, noise.reshape(m, r * r, 1)).reshape(m, r, r)
    state, errors, scales = np.zeros((m, r, 2)), np.zeros((m, n, 2)), np.zeros((m, n))
    settled, gain = False, None
    for t in range(n):
        if not settled:
            f = spread[:, 0, 0]
            gain = spread[:, :, 0] / f[:, None]
        v = np.array([y[t], 1.0]) - state[:, 0, :]
        errors[:, t], scales[:, t] = v, f
        state = forward(state + gain[:, :, None] * v[:, None, :])
        if not settled:
            new = forward(np.swapaxes(forward(spread - gain[:, :, None] * gain[:, None, :] * f[:, None, None]), 1, 2)) + noise
            settled = t % 4 == 3 and float(np.abs(new - spread).max()) < 1e-13
            spread = new
    one = errors[:, :, 1] / scales
    mean = (errors[:, :, 0] * one).sum(1) / np.maximum((errors[:, :, 1] * one).sum(1), 1e-300) if constant else np.zeros(m)
    e = errors[:, :, 0] - mean[:, None] * errors[:, :, 1]
    variance = np.maximum((e * e / scales).mean(1), 1e-300)
    loglik = -0.5 * (n * (np.log(2 * np.pi * variance) + 1) + np.log(scales).sum(1))
    return {"loglik": np.where(np.isfinite(loglik), loglik, -1e300), "mean": mean, "variance": variance, "errors": e, "state": state[:, :, 0] - mean[:, None] * state[:, :, 1]}


def maximise(y: np.ndarray, orders: Sequence[tuple[int, int]], constant: bool) -> tuple[np.ndarray, int]:
    """(free parameters at the greatest likelihood, places of autoregressive ones), a row an order (p, q).

    Quasi-Newton steps with numerical gradients, from two starting points; all orders and all steps tried are rows of one filter. An order that then does worse than one it
    contains starts again from there, so that likelihoods rise with the order.
    """
    n_ar, n_ma = max(p for p, _ in orders), max(q for _, q in orders)
    k, n = n_ar + n_ma, len(y)
    mask = np.array([[i < p for i in range(n_ar)] + [i < q for i in range(n_ma)] for p, q in orders], float).reshape(len(orders), k)
    if not k:
        return mask, 0
    starts = np.array([[0.1] * n_ar + [0.05] * n_ma, [0.8] * n_ar + [-0.4] * n_ma])
    starts[1, 1:n_ar] = 0.0
    starts[1, n_ar + 1 :] = 0.0
    own = np.repeat(mask, 2, axis=0)
    # Minus the mean log-likelihood of rows of parameters, in groups of any shape.
    cost = lambda z: -kalman(y, *coefficients(z.reshape(-1, k), n_ar), constant)["loglik"].reshape(z.shape[:-1]) / n

    def slope(z: np.ndarray, keep: np.ndarray) -> np.ndarray:
        h = 1e-5 * np.eye(k)
        found = cost(np.concatenate([z[:, None, :] + h, z[:, None, :] - h], axis=1))
        return (found[:, :k] - found[:, k:]) / 2e-5 * keep

    free, value = _search(np.tile(starts, (len(orders), 1)) * own, own, cost, slope)
    pick = 2 * np.arange(len(orders)) + (value[1::2] < value[::2])
    free, value = free[pick], value[pick]
    place = {o: i for i, o in enumerate(orders)}
    for _ in range(n_ar + n_ma):
        inner = [min([j for o in ((p - 1, q), (p, q - 1)) if (j := place.get(o)) is not None], key=lambda j: value[j], default=i) for i, (p, q) in enumerate(orders)]
        again = np.flatnonzero(value[inner] < value - GAIN)
        if not len(again):
            break
        start = (free[np.array(inner)[again]] + 0.02 * (free[np.array(inner)[again]] == 0)) * mask[again]
        free[again], value[again] = _search(start, mask[again], cost, slope)
        worse = again[value[again] > value[np.array(inner)[again]]]
        free[worse], value[worse] = free[np.array(inner)[worse]], value[np.array(inner)[worse]]
    return free, n_ar


def _search(free: np.ndarray, own: np.ndarray, cost, slope) -> tuple[np.ndarray, np.ndarray]:
    """Quasi-Newton descent of every row of ``free`` by itself, over the parameters that are its ``own``; (rows, costs)."""
    k = free.shape[1]
    value, gradient = cost(free), slope(free, own)
    curve = np.tile(np.eye(k), (len(free), 1, 1))
    going, fresh = np.ones(len(free), bool), np.ones(len(free), bool)
    for _ in range(STEPS):
        at = np.flatnonzero(going)
        if not len(at):
            break
        g = gradient[at]
        way = -np.einsum("mij,mj->mi", curve[at], g) * own[at]
        wrong = (way * g).sum(1) >= 0
        way[wrong], curve[at[wrong]], fresh[at[wrong]] = -g[wrong], np.eye(k), True
        way *= np.minimum(1.0, 2 / np.maximum(np.abs(way).max(1, keepdims=True), 1e-300))
        tried = np.clip(free[at][:, None, :] + LENGTHS[:, None] * way[:, None, :], -BOUND, BOUND)
        costs = cost(tried)
        best = costs.argmin(1)
        new, least = tried[np.arange(len(at)), best], costs[np.arange(len(at)), best]
        better = least < value[at]
        little = value[at] - least < GAIN
        # Without a gain: once more down the gradient, then the end.
        going[at[little & fresh[at]]] = False
        curve[at[little]], fresh[at[little]] = np.eye(k), True
        moved = at[better]
        if len(moved):
            s = new[better] - free[moved]
            free[moved], value[moved] = new[better], least[better]
            after = slope(free[moved], own[moved])
            d = after - gradient[moved]
            gradient[moved] = after
            sd = (s * d).sum(1)
            good = (sd > 1e-14) & ~little[better]
            rows, s, d, sd = moved[good], s[good], d[good], sd[good]
            left = np.eye(k) - s[:, :, None] * d[:, None, :] / sd[:, None, None]
            curve[rows] = left @ curve[rows] @ np.swapaxes(left, 1, 2) + s[:, :, None] * s[:, None, :] / sd[:, None, None]
            fresh[rows] = False
    return free, value


def residual_p(e: np.ndarray, lags: int = 12) -> float:
    """Ljung-Box p of residuals with ``lags`` (even) degrees of freedom."""
    n, e = len(e), e - e.mean()
    lags = min(lags, (n - 1) // 2 * 2)
    v = float(e @ e)
    if lags < 2 or v <= 0:
        return 1.0
    half = n * (n + 2) * sum((float(e[k:] @ e[:-k]) / v) ** 2 / (n - k) for k in range(1, lags + 1)) / 2
    term, total = 1.0, 1.0
    for i in range(1, lags // 2):
        term *= half / i
        total += term
    return float(np.exp(-half) * total)


def fit_orders(y: np.ndarray, d: int, orders: Sequence[tuple[int, int]], most_d: int, h: int = 1) -> list[dict]:
    """The fits of ``orders`` (p, q) to the d-th difference of ``y``; none for a series too short or constant.

    Without differences there is a mean. Every fit is to as many values as the ``most_d``-th difference has, so that criteria of different d go by one sample. ``ahead`` are h values after the series.
    """
    y = np.asarray(y, float)
    z = (np.diff(y, d) if d else y)[most_d - d :]
    orders = [(p, q) for p, q in orders if len(z) >= p + q + 4]
    if not orders or np.ptp(z) <= 1e-12 * max(np.abs(z).max(), 1e-300):
        return []
    # Computed at deviation 1, which the likelihood is corrected for.
    unit, constant = float(z.std()), d == 0
    free, n_ar = maximise(z / unit, orders, constant)
    phi, theta = coefficients(free, n_ar)
    found = kalman(z / unit, phi, theta, constant)
    out = []
    for i, (p, q) in enumerate(orders):
        loglik, k, n = float(found["loglik"][i]) - len(z) * np.log(unit), p + q + 1 + constant, len(z)
        state, ahead = found["state"][i].copy(), []
        for _ in range(h):
            ahead.append((state[0] + found["mean"][i]) * unit)
            state = np.concatenate([phi[i], np.zeros(len(state) - n_ar)]) * state[0] + np.append(state[1:], 0.0)
        values = np.array(ahead)
        for j in range(d, 0, -1):
            values = np.cumsum(values) + (np.diff(y, j - 1)[-1] if j > 1 else y[-1])
        out.append({
            "p": p, "q": q, "phi": phi[i, :p], "theta": theta[i, :q], "mean": float(found["mean"][i]) * unit, "variance": float(found["variance"][i]) * unit**2, "loglik": loglik,
            "aic": 2 * k - 2 * loglik, "bic": k * np.log(n) - 2 * loglik, "p_value": residual_p(found["errors"][i]), "ahead": values, "sample": z,
        })
    return out
