"""DuckDB SQL of the exact trees: levels are common table expressions over the order lines ``ol``."""

from __future__ import annotations

from storelens.operators.exact_tree import BOUNDS, DEPTH, MIN_LEAF
from storelens.schema import CATEGORICAL_FEATURES


def _rnd(x: str, d: int) -> str:
    s = f"{10 ** d}.0"
    return f"(sign({x}) * floor(abs({x}) * {s} + 0.5) / {s})"


def _bound(c: str, steps: dict[str, int | None]) -> str:
    step = steps[c]
    x = f"CAST({c} AS DOUBLE)"
    return x if step is None else f"CAST(floor({x} / {float(step)}) AS DOUBLE) * {float(step)}"


def tree_ctes(label: str, balance: bool, depth: int = DEPTH, min_leaf: int = MIN_LEAF,
              steps: dict[str, int | None] = BOUNDS) -> str:
    """CTEs ``splits`` (all levels) and ``routed`` (row_id, node, y of every row), to follow a WITH list."""
    def w(n: str, y: str) -> str:
        n, y = f"CAST({n} AS DOUBLE)", f"CAST({y} AS DOUBLE)"
        return f"(wt.none * ({n} - {y}) + wt.one * {y})" if balance else n

    def s(y: str) -> str:
        return f"(wt.one * CAST({y} AS DOUBLE))" if balance else f"CAST({y} AS DOUBLE)"

    bounds = ", ".join(f"{_bound(c, steps)} AS b_{c}" for c in BOUNDS)
    out = [f"""wt AS (
  SELECT CASE WHEN count(*) > sum({label}) THEN count(*) / (2.0::DOUBLE * (count(*) - sum({label}))) ELSE 1.0::DOUBLE END AS none,
         CASE WHEN sum({label}) > 0 THEN count(*) / (2.0::DOUBLE * sum({label})) ELSE 1.0::DOUBLE END AS one FROM ol
)""" if balance else "wt AS (SELECT 1 AS none)",
           f"r0 AS (SELECT row_id, CAST(1 AS BIGINT) AS node, {label} AS y, {', '.join(CATEGORICAL_FEATURES)}, {bounds} FROM ol)"]
    for k in range(depth):
        flat = [f"SELECT node, y, '{c}' AS feature, {c} AS level, CAST(NULL AS DOUBLE) AS bound FROM r{k}"
                for c in CATEGORICAL_FEATURES]
        flat += [f"SELECT node, y, '{c}', CAST(NULL AS VARCHAR), b_{c} FROM r{k}" for c in BOUNDS]
        route = " ".join([f"WHEN p.feature = '{c}' THEN CAST(coalesce(r.{c} = p.level, false) AS BIGINT)"
                          for c in CATEGORICAL_FEATURES]
                         + [f"WHEN p.feature = '{c}' THEN CAST(NOT coalesce(r.b_{c} <= p.bound, false) AS BIGINT)"
                            for c in BOUNDS])
        keep = ", ".join([f"r.{c}" for c in CATEGORICAL_FEATURES] + [f"r.b_{c}" for c in BOUNDS])
        out.append(f"""tot{k} AS (SELECT node, count(*) AS n, coalesce(sum(y), 0) AS t FROM r{k} GROUP BY node),
cell{k} AS (
  SELECT node, feature, level, bound, count(*) AS n, coalesce(sum(y), 0) AS t FROM ({' UNION ALL '.join(flat)})
  WHERE level IS NOT NULL OR bound IS NOT NULL GROUP BY ALL
),
part{k} AS (
  SELECT c.node, c.feature, c.level, c.bound, tot.n AS an, tot.t AS a_t,
         CASE WHEN c.level IS NULL THEN sum(c.n) OVER up ELSE c.n END AS pn,
         CASE WHEN c.level IS NULL THEN sum(c.t) OVER up ELSE c.t END AS pt
  FROM cell{k} c JOIN tot{k} tot ON c.node = tot.node
  WINDOW up AS (PARTITION BY c.node, c.feature ORDER BY c.bound ROWS UNBOUNDED PRECEDING)
),
score{k} AS (
  SELECT part{k}.*, {s('pt')} * {s('pt')} / {w('pn', 'pt')} + {s('(a_t - pt)')} * {s('(a_t - pt)')} / {w('(an - pn)', '(a_t - pt)')} AS score,
         {s('a_t')} * {s('a_t')} / {w('an', 'a_t')} AS base
  FROM part{k}, wt WHERE pn >= {min_leaf} AND an - pn >= {min_leaf}
),
best{k} AS (
  SELECT * FROM score{k} WHERE node >= {1 << k} AND node < {2 << k}
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY score DESC, feature, level NULLS FIRST, bound NULLS FIRST) = 1
),
p{k} AS (SELECT node, feature, level, bound, an AS n, CAST(a_t AS DOUBLE) AS t, score - base AS gain FROM best{k} WHERE score - base > 0),
r{k + 1} AS (
  SELECT r.row_id, CASE {f"WHEN p.node IS NULL THEN r.node ELSE 2 * r.node + (CASE {route} END)"} END AS node, r.y, {keep}
  FROM r{k} r LEFT JOIN p{k} p ON r.node = p.node
)""")
    out.append("splits AS (" + " UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(depth)) + ")")
    out.append(f"leaves AS (SELECT node, count(*) AS n, coalesce(sum(y), 0) AS t FROM r{depth} GROUP BY node)")
    out.append(f"nodes AS (SELECT node, feature, level, bound, n, t, gain FROM splits UNION ALL "
               f"SELECT node, NULL, NULL, NULL, n, CAST(t AS DOUBLE), NULL FROM leaves)")
    out.append(f"valued AS (SELECT nodes.*, {s('t')} / {w('n', 't')} AS value FROM nodes, wt)")
    return ",\n".join(out)


NODES = f"""SELECT node, feature, level, bound, n AS rows, {_rnd('t', 4)} AS label, {_rnd('value', 6)} AS value,
  {_rnd('gain', 4)} AS gain FROM valued"""
IMPORTANCE = f"""SELECT feature, {_rnd('g / (SELECT sum(gain) FROM splits)', 6)} AS importance FROM (
  SELECT feature || coalesce('_' || level, '') AS feature, sum(gain) AS g FROM splits GROUP BY ALL)"""
SCORES = f"""SELECT r.row_id, r.node, CAST(r.y AS DOUBLE) AS actual, {_rnd('v.value', 6)} AS predicted
FROM r{DEPTH} r JOIN valued v ON v.node = r.node AND v.feature IS NULL"""

MATRIX_CELLS = """lev AS (
  {levels}
), place AS (
  SELECT feature, level, row_number() OVER (ORDER BY pos, level) - 1 AS position FROM lev
)
{cells}"""


def matrix_cells(numeric: list[str]) -> str:
    levels = " UNION ALL ".join(f"SELECT DISTINCT {i} AS pos, '{c}' AS feature, {c} AS level FROM ol WHERE {c} IS NOT NULL"
                                for i, c in enumerate(CATEGORICAL_FEATURES))
    cells = [f"SELECT row_id, CAST(p.position AS INTEGER) AS position, CAST(1 AS DOUBLE) AS value FROM ol JOIN place p "
             f"ON p.feature = '{c}' AND p.level = ol.{c}" for c in CATEGORICAL_FEATURES]
    cells += [f"SELECT row_id, CAST((SELECT count(*) FROM place) + {i} AS INTEGER), CAST({c} AS DOUBLE) FROM ol WHERE {c} <> 0"
              for i, c in enumerate(numeric)]
    return MATRIX_CELLS.format(levels=levels, cells=" UNION ALL ".join(cells))
