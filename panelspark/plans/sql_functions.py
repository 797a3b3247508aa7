"""Distribution functions as DuckDB SQL, for queries whose results hold probabilities.

Each is a sum of a series, written out over a list: the lower incomplete gamma function and the incomplete beta function.
"""

from __future__ import annotations

TERMS = 400


def gamma_p(a: str, x: str) -> str:
    """Regularised lower incomplete gamma function, for x > 0."""
    return f"list_sum(list_transform(range({TERMS}), lambda term_no: exp((({a}) + term_no) * ln({x}) - ({x}) - lgamma(({a}) + term_no + 1))))"


def chi2_tail(x: str, df: str) -> str:
    return f"(case when {x} > 0 then 1 - {gamma_p(f'({df}) / 2.0::double', f'({x}) / 2.0::double')} when {x} <= 0 then 1.0::double end)"


def normal_cdf(z: str) -> str:
    return f"(case when {z} = 0 then 0.5::double when abs({z}) > 12 then case when {z} > 0 then 1.0::double else 0.0::double end else 0.5::double + sign({z}) * {gamma_p('0.5::double', f'(({z}) * ({z}) / 2)')} / 2 end)"


def normal_two_sided(z: str) -> str:
    return chi2_tail(f"(({z}) * ({z}))", "1")


def _beta_series(a: str, b: str, x: str) -> str:
    log_beta = f"(lgamma({a}) + lgamma({b}) - lgamma(({a}) + ({b})))"
    each = f"exp(lgamma(({a}) + ({b}) + term_no) - lgamma(({a}) + ({b})) - lgamma(({a}) + 1 + term_no) + lgamma(({a}) + 1) + term_no * ln({x}))"
    return f"(exp(({a}) * ln({x}) + ({b}) * ln(1 - ({x})) - {log_beta}) / ({a}) * list_sum(list_transform(range({2 * TERMS}), lambda term_no: {each})))"


def beta_i(a: str, b: str, x: str) -> str:
    """Regularised incomplete beta function; the series runs on the side where it converges fast."""
    return f"(case when {x} <= 0 then 0.0::double when {x} >= 1 then 1.0::double when {x} <= (({a}) + 1) / (({a}) + ({b}) + 2) then {_beta_series(a, b, x)} else 1 - {_beta_series(b, a, f'(1 - ({x}))')} end)"


def t_two_sided(t: str, df: str) -> str:
    return beta_i(f"(({df}) / 2.0::double)", "0.5::double", f"(({df}) / (({df}) + ({t}) * ({t})))")


def f_tail(f: str, d1: str, d2: str) -> str:
    return beta_i(f"(({d2}) / 2.0::double)", f"(({d1}) / 2.0::double)", f"(({d2}) / (({d2}) + ({d1}) * ({f})))")


def normal_ppf(p: str) -> str:
    """Newton's method from 0, which nears the quantile from one side."""
    return f"list_reduce(list_prepend(0.0::double, list_transform(range(40), lambda i: 0.0::double)), lambda z, i: z - ({normal_cdf('z')} - ({p})) / (exp(-z * z / 2) / sqrt(2 * pi())))"
