"""Empirical-Bayes location/scale site effects from sufficient statistics.

Formulas: Johnson, Li and Rabinovic (2007) and Fortin et al. (2018). Input arrays are moments per site (axis 0)
and feature (last axis); nothing here sees a data row.
"""

from __future__ import annotations

import numpy as np


def site_moments_of_z(n, sc, scc, sx, sxx, scx, alpha, beta, sigma):
    """Sum and sum of squares of the standardised values per site, from the raw moments."""
    fit_x = np.einsum("qg,sqg->sg", beta, scx)
    fit_c = sc @ beta
    fit_cc = np.einsum("qg,sqr,rg->sg", beta, scc, beta)
    total = (sx - n[:, None] * alpha - fit_c) / sigma
    square = (sxx - 2 * alpha * sx - 2 * fit_x + n[:, None] * alpha**2 + 2 * alpha * fit_c + fit_cc) / sigma**2
    return total, square


def shrink(n, total, square, gamma, delta, tol=1e-4, limit=10_000):
    """Posterior location and scale of one site over its features, by the fixed-point iteration."""
    prior_mean, prior_var = gamma.mean(), gamma.var(ddof=1)
    m, s2 = delta.mean(), delta.var(ddof=1)
    if not (prior_var > 0 and s2 > 0):
        return gamma, delta
    a, b = (2 * s2 + m**2) / s2, (m * s2 + m**3) / s2
    g, d = gamma.copy(), delta.copy()
    for _ in range(limit):
        g_new = (prior_var * n * gamma + d * prior_mean) / (prior_var * n + d)
        spread = square - 2 * g_new * total + n * g_new**2
        d_new = (b + 0.5 * spread) / (n / 2 + a - 1)
        # A feature without spread has no effect to settle.
        moved = np.append(np.abs(g_new - g) / np.maximum(np.abs(g), 1e-12), np.abs(d_new - d) / np.maximum(np.abs(d), 1e-12))
        change = np.nanmax(moved, initial=0.0)
        g, d = g_new, d_new
        if change < tol:
            return g, d
    raise RuntimeError(f"site effects did not settle after {limit} steps")


def fit_sites(n, sc, scc, sx, sxx, scx, eb=True, reference=None):
    """Affine map per (site, feature): adjusted = slope * x + cov . c + const. Also mean and SD after adjustment.

    Sites with a single row have no variance: their map is NaN. `reference` (a site position) fixes that site's
    location and scale as the target for all the others.
    """
    sites, q = sc.shape
    features = sx.shape[1]
    total_n = n.sum()
    gram = np.zeros((sites + q, sites + q))
    gram[:sites, :sites] = np.diag(n)
    gram[:sites, sites:], gram[sites:, :sites] = sc, sc.T
    gram[sites:, sites:] = scc.sum(axis=0)
    right = np.vstack([sx, scx.sum(axis=0)])
    coef = np.linalg.lstsq(gram, right, rcond=None)[0]
    beta = coef[sites:]
    if reference is None:
        alpha = (n / total_n) @ coef[:sites]
        rss = sxx.sum(axis=0) - np.einsum("kg,kg->g", coef, right)
        sigma = np.sqrt(np.maximum(rss, 0) / total_n)
    else:
        alpha = coef[reference]
        _, square = site_moments_of_z(n, sc, scc, sx, sxx, scx, alpha, beta, np.ones(features))
        sigma = np.sqrt(np.maximum(square[reference], 0) / n[reference])
    live = sigma > 1e-12
    safe = np.where(live, sigma, 1.0)
    total, square = site_moments_of_z(n, sc, scc, sx, sxx, scx, alpha, beta, safe)
    gamma = total / n[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        delta = np.where(n[:, None] > 1, (square - total**2 / n[:, None]) / (n[:, None] - 1), np.nan)
    gamma_star, delta_star = gamma.copy(), delta.copy()
    if eb and live.sum() > 1:
        for s in range(sites):
            if n[s] > 1:
                gamma_star[s, live], delta_star[s, live] = shrink(
                    n[s], total[s, live], square[s, live], gamma[s, live], delta[s, live]
                )
    if reference is not None:
        gamma_star[reference], delta_star[reference] = 0.0, 1.0
    slope = 1.0 / np.sqrt(np.where(delta_star > 0, delta_star, np.nan))
    slope[:, ~live] = 1.0
    gamma_star[:, ~live] = 0.0
    const = alpha * (1 - slope) - sigma * gamma_star * slope
    cov = beta[None, :, :] * (1 - slope[:, None, :])
    first = slope * sx + n[:, None] * const + np.einsum("sq,sqg->sg", sc, cov)
    second = (
        slope**2 * sxx + n[:, None] * const**2 + np.einsum("sqg,sqr,srg->sg", cov, scc, cov) + 2 * slope * const * sx
        + 2 * slope * np.einsum("sqg,sqg->sg", cov, scx) + 2 * const * np.einsum("sq,sqg->sg", sc, cov)
    )
    mean = np.nansum(first, axis=0) / total_n
    sd = np.sqrt(np.maximum(np.nansum(second, axis=0) / total_n - mean**2, 0))
    return slope, const, cov, mean, sd
