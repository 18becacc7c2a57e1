"""SQL generator for oracle fits: Newton–Raphson for a two-parameter logit (a + b·x) on grouped cells,
unrolled as a chain of CTEs (one per step). Input CTE columns: g, x, n, w, wy.
Output CTE ``<prefix>_fit``: g, b0, b1, se0, se1, loglik, n_obs, sum_w, sum_wy.
"""

from __future__ import annotations


def newton_ctes(cells: str, prefix: str, iters: int = 25) -> str:
    parts = [f"{prefix}_0 AS (SELECT DISTINCT g, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b FROM {cells})"]
    for k in range(iters):
        parts.append(
            f"""{prefix}_{k + 1} AS (
  SELECT g, a + (i11 * g0 - i01 * g1) / (i00 * i11 - i01 * i01) AS a, b + (i00 * g1 - i01 * g0) / (i00 * i11 - i01 * i01) AS b
  FROM (SELECT g, a, b, sum(wy - w * p) AS g0, sum(x * (wy - w * p)) AS g1, sum(w * p * (1 - p)) AS i00,
               sum(w * x * p * (1 - p)) AS i01, sum(w * x * x * p * (1 - p)) AS i11
        FROM (SELECT s.g, s.a, s.b, c.x, c.w, c.wy, 1 / (1 + exp(-(s.a + s.b * c.x))) AS p
              FROM {prefix}_{k} s JOIN {cells} c ON s.g = c.g)
        GROUP BY g, a, b))"""
        )
    parts.append(
        f"""{prefix}_fit AS (
  SELECT g, a AS b0, b AS b1, sqrt(i11 / (i00 * i11 - i01 * i01)) AS se0, sqrt(i00 / (i00 * i11 - i01 * i01)) AS se1,
         ll AS loglik, CAST(n AS BIGINT) AS n_obs, sw AS sum_w, swy AS sum_wy
  FROM (SELECT g, a, b, sum(w * p * (1 - p)) AS i00, sum(w * x * p * (1 - p)) AS i01, sum(w * x * x * p * (1 - p)) AS i11,
               sum(-wy * ln(1 + exp(-eta)) - (w - wy) * ln(1 + exp(eta))) AS ll, sum(n) AS n, sum(w) AS sw, sum(wy) AS swy
        FROM (SELECT s.g, s.a, s.b, c.x, c.w, c.wy, c.n, s.a + s.b * c.x AS eta, 1 / (1 + exp(-(s.a + s.b * c.x))) AS p
              FROM {prefix}_{iters} s JOIN {cells} c ON s.g = c.g)
        GROUP BY g, a, b))"""
    )
    return ",\n".join(parts)


def coef_rows(fit: str, x_name: str, model: str, extra: str = "") -> str:
    """Long coefficient rows (model, variable, beta, se[, extra…]) from a ``_fit`` CTE."""
    return f"""SELECT {extra}'{model}' AS model, 'intercept' AS variable, b0 AS beta, se0 AS se FROM {fit}
UNION ALL SELECT {extra}'{model}', '{x_name}', b1, se1 FROM {fit}"""


# Fixed constant: two-sided 95 % normal critical value.
Z95 = 1.959963984540054

def erfc_sql(x: str) -> str:
    """erfc by numerical integration, independent of ``functions.dist``: for x >= 0,
    2/√π · exp(-x²) · ∫ exp(-t² - 2xt) dt over [0, 7] by Simpson's rule."""
    point = "(i * 0.005)"
    weight = "CASE WHEN i = 0 OR i = 1400 THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END"
    total = f"list_sum(list_transform(range(0, 1401), lambda i: ({weight}) * exp(-{point} * {point} - 2 * abs({x}) * {point})))"
    pos = f"(2 / sqrt(pi()) * exp(-abs({x}) * abs({x})) * 0.005 / 3 * {total})"
    return f"(CASE WHEN ({x}) >= 0 THEN {pos} ELSE 2 - {pos} END)"


def two_sided_p_sql(z: str) -> str:
    return erfc_sql(f"abs({z}) / sqrt(2)")


def wald_cols(beta: str = "beta", se: str = "se") -> str:
    z = f"({beta}) / ({se})"
    return (
        f"{z} AS z, {two_sided_p_sql(z)} AS p_value, exp({beta}) AS odds_ratio, "
        f"exp({beta} - {Z95} * {se}) AS ci_lower, exp({beta} + {Z95} * {se}) AS ci_upper"
    )


def chi2_sf_sql(x: str, df: str) -> str:
    """χ² upper tail for integer df (series with lgamma; same formula as functions.dist)."""
    h = f"(({x}) / 2.0)"
    even = f"(exp(-{h}) * list_sum(list_transform(range(0, CAST(({df}) // 2 AS BIGINT)), lambda i: exp(i * ln({h}) - lgamma(i + 1)))))"
    odd_series = (
        f"list_sum(list_transform(range(1, CAST((({df}) - 1) // 2 + 1 AS BIGINT)), lambda i: exp((i - 0.5) * ln({h}) - lgamma(i + 0.5))))"
    )
    odd = f"({erfc_sql(f'sqrt({h})')} + exp(-{h}) * coalesce({odd_series}, 0))"
    return (
        f"(CASE WHEN ({x}) IS NULL OR ({df}) IS NULL OR ({df}) < 1 THEN NULL WHEN ({x}) <= 0 THEN CAST(1 AS DOUBLE) "
        f"WHEN ({df}) % 2 = 0 THEN {even} ELSE {odd} END)"
    )


def newton_multi(cells: str, prefix: str, terms: list[str], iters: int = 9, group: str = "1") -> str:
    """CTEs of a logit with any number of parameters (intercept, then ``terms``: expressions of the cell columns)
    by Newton steps, one per value of ``group`` (an expression of the cell columns). Each step sums the score and the
    information matrix over the cells and solves by sweeping the augmented matrix, one CTE a pivot. ``<prefix>_fit`` has
    one row a group: g, b0..bk, se0..sek, loglik."""
    x = ["1.0", *[f"CAST({t} AS DOUBLE)" for t in terms]]
    p = len(x)
    design = f"{prefix}_x AS MATERIALIZED (SELECT {group} AS g, n, w, wy, " + ", ".join(f"{e} AS x{i}" for i, e in enumerate(x)) + f" FROM {cells})"
    parts = [design, f"{prefix}_0 AS MATERIALIZED (SELECT DISTINCT g, " + ", ".join(f"CAST(0 AS DOUBLE) AS b{i}" for i in range(p)) + f" FROM {prefix}_x)"]
    eta = " + ".join(f"s.b{i} * c.x{i}" for i in range(p))
    upper = [(i, j) for i in range(p) for j in range(i, p)]

    def name(i, j):
        return f"h{min(i, j)}_{max(i, j)}"

    for k in range(iters + 1):
        sums = [f"sum(v * x{i} * x{j}) AS {name(i, j)}" for i, j in upper] + [f"sum(x{i} * (wy - w * p)) AS g{i}" for i in range(p)]
        parts.append(
            f"{prefix}_{k}_s0 AS MATERIALIZED (SELECT g, {', '.join(sums)}, "
            f"sum(-wy * ln(1 + exp(-eta)) - (w - wy) * ln(1 + exp(eta))) AS ll "
            f"FROM (SELECT *, w * p * (1 - p) AS v FROM (SELECT c.*, {eta} AS eta, 1 / (1 + exp(-({eta}))) AS p "
            f"FROM {prefix}_x c JOIN {prefix}_{k} s ON c.g = s.g)) GROUP BY g)"
        )
        for d in range(p):  # sweep on pivot d: after all pivots the matrix is minus the inverse, g the step
            piv = name(d, d)
            cols = []
            for i, j in upper:
                if i == d and j == d:
                    cols.append(f"-1 / {piv} AS {name(i, j)}")
                elif d in (i, j):
                    cols.append(f"{name(i, j)} / {piv} AS {name(i, j)}")
                else:
                    cols.append(f"{name(i, j)} - {name(i, d)} * {name(d, j)} / {piv} AS {name(i, j)}")
            cols += [f"g{d} / {piv} AS g{d}" if i == d else f"g{i} - {name(i, d)} * g{d} / {piv} AS g{i}" for i in range(p)]
            parts.append(f"{prefix}_{k}_s{d + 1} AS MATERIALIZED (SELECT g, {', '.join(cols)}, ll FROM {prefix}_{k}_s{d})")
        if k < iters:
            step = ", ".join(f"s.b{i} + g.g{i} AS b{i}" for i in range(p))
            parts.append(f"{prefix}_{k + 1} AS MATERIALIZED (SELECT s.g, {step} FROM {prefix}_{k} s JOIN {prefix}_{k}_s{p} g ON s.g = g.g)")
    fit = ", ".join(f"s.b{i}" for i in range(p)) + ", " + ", ".join(f"sqrt(-g.{name(i, i)}) AS se{i}" for i in range(p))
    parts.append(f"{prefix}_fit AS MATERIALIZED (SELECT s.g, {fit}, g.ll AS loglik FROM {prefix}_{iters} s JOIN {prefix}_{iters}_s{p} g ON s.g = g.g)")
    return ",\n".join(parts)


def permutation_sql(i: str, n: str, a: str, key: str, rounds: int = 4) -> str:
    """The keyed permutation of 0 … n − 1 (``operators.split.keyed_permutation``): ``a`` is ⌈√n⌉, the other half has
    ⌈n / a⌉ places; a result beyond n goes through again, at most a·b − n times."""
    b = f"(({n} + {a} - 1) // {a})"

    def once(v: str) -> str:
        x, y = f"(({v}) // {b})", f"(({v}) % {b})"
        mixed = lambda r, half, m: f"(('0x' || substr(md5({key} || ':{r}:' || {half}), 1, 8))::BIGINT % {m})"
        for r in range(rounds):
            x = f"(({x} + {mixed(2 * r, y, a)}) % {a})"
            y = f"(({y} + {mixed(2 * r + 1, x, b)}) % {b})"
        return f"({x} * {b} + {y})"

    return f"list_reduce(range(0, {a} * {b} - {n}), lambda v, k: CASE WHEN v < {n} THEN v ELSE {once('v')} END, {once(i)})"
