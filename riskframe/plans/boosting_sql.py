"""DuckDB text of second-order boosting, for the oracle of M4b: every round and level as plain SQL."""

from __future__ import annotations


def boosting_ctes(rows: str, rounds: int, depth: int, rate: float, reg_lambda: float, least_hessian: float) -> dict[str, str]:
    """CTEs that grow ``rounds`` trees on ``rows`` (app_id, y, x DOUBLE[]); the last one is ``grown``, a row per node."""
    ctes = {
        "boost_rows": rows,
        "boost_values": "SELECT f, v, lead(v) OVER (PARTITION BY f ORDER BY v) AS nv FROM "
                        "(SELECT DISTINCT unnest(range(len(x))) AS f, unnest(x) AS v FROM boost_rows)",
        "margin_0": "SELECT app_id, y, x, (SELECT ln(avg(y) / (1 - avg(y))) FROM boost_rows) AS m FROM boost_rows",
    }
    trees = []
    for r in range(rounds):
        ctes[f"grad_{r}"] = f"""SELECT app_id, x, 1 / (1 + exp(-m)) - y AS g, 1 / (1 + exp(-m)) * (1 - 1 / (1 + exp(-m))) AS h
          FROM margin_{r}"""
        ctes[f"at_{r}_0"] = f"SELECT app_id, CAST(0 AS BIGINT) AS node FROM grad_{r}"
        splits, leaves = [], []
        parts = [f"SELECT {r} AS tree, CAST(0 AS BIGINT) AS node, 0 AS depth, sum(g) AS G, sum(h) AS H, count(*) AS n FROM grad_{r}"]
        for d in range(depth):
            ctes[f"hist_{r}_{d}"] = f"""SELECT node, f, v, sum(g) AS g, sum(h) AS h, count(*) AS n FROM (
              SELECT node, unnest(range(len(x))) AS f, unnest(x) AS v, g, h FROM grad_{r} JOIN at_{r}_{d} USING (app_id)) GROUP BY ALL"""
            ctes[f"cum_{r}_{d}"] = f"""SELECT node, f, v, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl,
              sum(g) OVER a AS gt, sum(h) OVER a AS ht, sum(n) OVER a AS nt FROM hist_{r}_{d}
              WINDOW w AS (PARTITION BY node, f ORDER BY v), a AS (PARTITION BY node, f)"""
            ctes[f"gain_{r}_{d}"] = f"""SELECT *, round(0.5 * (gl * gl / (hl + {reg_lambda}) + (gt - gl) * (gt - gl) / (ht - hl + {reg_lambda})
              - gt * gt / (ht + {reg_lambda})), 6) AS gain FROM cum_{r}_{d}
              WHERE hl >= {least_hessian} AND ht - hl >= {least_hessian} AND nt > nl"""
            before = " + ".join(f"(SELECT count(*) FROM {s})" for s in splits) or "0"
            ctes[f"split_{r}_{d}"] = f"""SELECT node, f, (v + nv) / 2 AS threshold, gain, gl, hl, nl, gt, ht, nt,
                2 * ({before}) + 2 * row_number() OVER (ORDER BY node) - 1 AS lft FROM (
                  SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, v) AS k FROM gain_{r}_{d} WHERE gain > 0)
              JOIN boost_values USING (f, v) WHERE k = 1"""
            ctes[f"at_{r}_{d + 1}"] = f"""SELECT app_id, CASE WHEN x[f + 1] <= threshold THEN lft ELSE lft + 1 END AS node
              FROM at_{r}_{d} JOIN split_{r}_{d} USING (node) JOIN grad_{r} USING (app_id)"""
            leaves.append(f"SELECT app_id, node FROM at_{r}_{d} WHERE node NOT IN (SELECT node FROM split_{r}_{d})")
            parts += [f"SELECT {r}, lft, {d + 1}, gl, hl, nl FROM split_{r}_{d}",
                      f"SELECT {r}, lft + 1, {d + 1}, gt - gl, ht - hl, nt - nl FROM split_{r}_{d}"]
            splits.append(f"split_{r}_{d}")
        leaves.append(f"SELECT app_id, node FROM at_{r}_{depth}")
        ctes[f"node_{r}"] = " UNION ALL ".join(parts)
        chosen = " UNION ALL ".join(f"SELECT node, f, threshold, gain FROM {s}" for s in splits)
        ctes[f"tree_{r}"] = f"SELECT node_{r}.*, f, threshold, gain, -G / (H + {reg_lambda}) AS weight FROM node_{r} LEFT JOIN ({chosen}) USING (node)"
        ctes[f"margin_{r + 1}"] = f"""SELECT app_id, y, x, m + {rate} * weight AS m FROM margin_{r}
          JOIN ({' UNION ALL '.join(leaves)}) USING (app_id) JOIN tree_{r} USING (node)"""
        trees.append(f"SELECT * FROM tree_{r}")
    ctes["grown"] = " UNION ALL ".join(trees)
    return ctes
