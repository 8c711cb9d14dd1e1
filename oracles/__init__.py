"""Independent DuckDB SQL for the analyses, over the same derived inputs.

Bodies are written against named building blocks; :func:`complete` puts the needed ones in front.
"""

from __future__ import annotations

import re

from tenurekit.sources.standin import TEXTS, sql_text

BLOCKS: dict[str, str] = {name: sql_text(name, "unnest(generate_series(1, {n}))") for name in TEXTS}
BODIES: dict[str, str] = {}

_WORD = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")


def block(name: str, sql: str) -> None:
    BLOCKS[name] = sql


def oracle(name: str, sql: str) -> None:
    if name in BODIES:
        raise ValueError(f"oracle {name} is given twice")
    BODIES[name] = sql


def complete(body: str) -> str:
    """The body behind a WITH list of every building block it reaches, inputs first."""
    order: list[str] = []

    def visit(text: str, seen: tuple[str, ...]) -> None:
        for word in dict.fromkeys(_WORD.findall(text)):
            if word in BLOCKS and word not in order and word not in seen:
                visit(BLOCKS[word], (*seen, word))
                order.append(word)

    visit(body, ())
    if not order:
        return body
    listed = ",\n".join(f"{name} AS ({BLOCKS[name]})" for name in order)
    return f"WITH {listed}\n{body}"


def half_up(numerator: str, denominator: str, places: int, scale: int = 1) -> str:
    """Exact ``round(scale * numerator / denominator, places)`` of non-negative integers."""
    top, bottom = f"CAST({numerator} AS HUGEINT)", f"CAST({denominator} AS HUGEINT)"
    step = 10**places
    return f"(CAST(({2 * scale * step} * {top} + {bottom}) // (2 * {bottom}) AS DOUBLE) / {float(step)})"


def pct(numerator: str, denominator: str, places: int = 1) -> str:
    return half_up(numerator, denominator, places, 100)


def share(source: str, by: str, *, n: str = "count(*)", within: str = "", places: int = 1, names=("n", "pct")) -> str:
    """Group, then each group's percentage of its total."""
    n_name, pct_name = names
    over = f"sum(_n) OVER ({'PARTITION BY ' + within if within else ''})"
    keys = ", ".join(part.split(" AS ")[-1].strip() for part in by.split(";"))
    return (
        f"SELECT {keys}, _n AS {n_name}, {pct('_n', over, places)} AS {pct_name} FROM "
        f"(SELECT {by.replace(';', ',')}, CAST({n} AS BIGINT) AS _n FROM {source} GROUP BY ALL) g"
    )


def rates(source: str, by: str, hit: str, *, names=("n_subscribers", "n_cancelled", "cancel_rate_pct"), places=1, having="") -> str:
    n_name, hit_name, pct_name = names
    keys = "".join(part.split(" AS ")[-1].strip() + ", " for part in by.split(";") if part)
    listed = by.replace(";", ",") + ", " if by else ""
    return (
        f"SELECT {keys}_n AS {n_name}, _k AS {hit_name}, {pct('_k', '_n', places)} AS {pct_name} FROM "
        f"(SELECT {listed}count(DISTINCT subscription_id) AS _n, count(*) FILTER (WHERE {hit}) AS _k "
        f"FROM {source} GROUP BY ALL) g {having}"
    )


def gamma_tail(shape: str, x: str) -> str:
    """Regularised upper incomplete gamma by the series of the lower one."""
    return (
        f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 400 THEN 0.0 WHEN {x} <= 0 THEN 1.0 ELSE greatest(0.0, 1 - list_sum([exp(({shape} + i) * ln({x}) - {x} "
        f"- lgamma({shape} + i + 1)) FOR i IN range(0, 1200)])) END"
    )


def chi2_test(table: str, by: str = "") -> str:
    """Chi-square of rows ``(n, k)``: hit and rest per group, Yates with two groups."""
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    same = " AND ".join(f"t.{c.strip()} = m.{c.strip()}" for c in by.split(",")) if by else "TRUE"
    return f"""
      SELECT {keys}chi2, dof, round({gamma_tail('dof / 2.0', 'chi2 / 2.0')}, 6) AS p_value FROM (
        SELECT {keys}CASE WHEN bool_and(possible) THEN sum(power(greatest(abs(o - e) - CASE WHEN r = 2 THEN
                 least(0.5, abs(o - e)) ELSE 0 END, 0), 2) / e) END AS chi2, max(r) - 1 AS dof
        FROM (
          SELECT {', '.join('t.' + c.strip() for c in by.split(',')) + ', ' if by else ''}unnest([k, n - k])::DOUBLE AS o,
                 unnest([n * sk / sn, n * (sn - sk) / sn])::DOUBLE AS e, r, n > 0 AND sk > 0 AND sk < sn AS possible
          FROM ({table}) t JOIN (SELECT {keys}CAST(sum(n) AS DOUBLE) AS sn, CAST(sum(k) AS DOUBLE) AS sk, count(*) AS r
                                 FROM ({table}) x {group}) m ON {same}) cells {group}) tests"""


from oracles import base, cancellation, deferrals, first_month, ingest, lifecycle, overview, published, sanity, temporal  # noqa: E402, F401


def oracle_sql() -> dict[str, str]:
    return {name: complete(body) for name, body in BODIES.items()}
