"""DuckDB twin of the checked training runs: a one-layer linear tower, step by step.

A whole epoch is a recursive CTE, one row a step. Each step is a chain of CTEs: outputs per item from the current parameters (one list,
weights row by row, then the bias), distances and gradients of the batch's tuples, the
gradient of the outputs summed per item, its product with the items' vectors, and the
next parameters.
"""

from __future__ import annotations

from tuplespace.functions.hashing import duck_draw_hash as H

ROLES = "icsn"


def rational_start_sql(dim_in: int, dim_out: int) -> str:
    """The rational weights of layer 1 and zero biases as one list."""
    return (
        f"SELECT list_concat(list_transform(range({dim_in * dim_out}), "
        f"lambda k: (((31 * (k // {dim_out}) + 17 * (k % {dim_out}) + 7) % 101) - 50) / 500.0), "
        f"list_transform(range({dim_out}), lambda k: 0.0)) AS p"
    )


def _dot(a: str, b: str, n: int) -> str:
    return " + ".join(f"{a}[{k}] * {b}[{k}]" for k in range(1, n + 1))


def outputs_sql(p: str, dim_in: int, dim_out: int) -> str:
    """Per item: x, the length r of its output (floored), ss, and the unit output u, by parameters ``p``."""
    z = ", ".join(
        f"list_sum(list_transform(range({dim_in}), lambda i: x[i + 1] * p[i * {dim_out} + {j + 1}])) + p[{dim_in * dim_out + j + 1}]"
        for j in range(dim_out))
    return (
        "SELECT item_id, x, ss, r, list_transform(z, lambda v: v / r) AS u FROM ("
        "SELECT *, sqrt(greatest(ss, 1e-12)) AS r FROM (SELECT *, " + _dot("z", "z", dim_out) + " AS ss FROM ("
        f"SELECT item_id, x, [{z}] AS z FROM vec, {p})))"
    )


def distances_sql(tuples: str, outputs: str, dim_out: int) -> str:
    """Per tuple the unit outputs, lengths and squared distances of its roles."""
    joins = " ".join(f"JOIN {outputs} {r} ON {r}.item_id = t.{r}" for r in ROLES)
    cols = ", ".join(f"{r}.u AS u_{r}, {r}.r AS r_{r}, {r}.ss AS ss_{r}" for r in ROLES)
    d2 = ", ".join(
        "(" + " + ".join(f"(u_i[{k}] - u_{r}[{k}]) ^ 2" for k in range(1, dim_out + 1)) + f") AS d2{r}" for r in "csn")
    return f"SELECT *, {d2} FROM (SELECT t.i, t.c, t.s, t.n, {cols} FROM {tuples} t {joins})"


def _positions_sql(seed: str, source: str) -> str:
    order = H(seed, "i", "c", "s", "n", "'epoch0'")
    return f"SELECT i, c, s, n, row_number() OVER (ORDER BY {order}, i, c, s, n) - 1 AS pos FROM {source}"


def _step_ctes(margin, dim_in: int, dim_out: int, rows: str, p: str, u: str, d: str, g: str, s: str, w: str) -> list[str]:
    """CTEs named u, d, g, s, w: outputs by the parameters ``p``, the scored ``rows``, the gradient of the outputs per
    item, of the parameters, and as one list (NULL without rows)."""
    ms, mc, mn = margin
    k8 = range(1, dim_out + 1)
    out = [f"{u} AS MATERIALIZED ({outputs_sql(p, dim_in, dim_out)})",
           f"{d} AS MATERIALIZED ({distances_sql(rows, u, dim_out)})"]
    pull = {  # the loss's gradient by each role's unit output
        "i": [f"2 * (wc * (u_i[{j}] - u_c[{j}]) + (u_i[{j}] - u_s[{j}]) + wn * (u_i[{j}] - u_n[{j}]))" for j in k8],
        "c": [f"-2 * wc * (u_i[{j}] - u_c[{j}])" for j in k8],
        "s": [f"-2 * (u_i[{j}] - u_s[{j}])" for j in k8],
        "n": [f"-2 * wn * (u_i[{j}] - u_n[{j}])" for j in k8],
    }
    weights = (f"(SELECT *, (CASE WHEN d2c > {mc} THEN 1.0 ELSE 0.0 END) - (CASE WHEN d2c < {ms} THEN 1.0 ELSE 0.0 END) AS wc, "
               f"-(CASE WHEN d2n < {mn} THEN 1.0 ELSE 0.0 END) AS wn FROM {d})")
    parts = " UNION ALL ".join(
        f"SELECT {r} AS item_id, [{', '.join(pull[r])}] AS g, u_{r} AS u, r_{r} AS r, ss_{r} AS ss FROM {weights}" for r in ROLES)
    along = _dot("g", "u", dim_out)
    sums = ", ".join(f"sum((g[{j}] - CASE WHEN ss > 1e-12 THEN gu * u[{j}] ELSE 0.0 END) / r)" for j in k8)
    out.append(f"{g} AS MATERIALIZED (SELECT item_id, [{sums}] AS gz FROM (SELECT *, {along} AS gu FROM ({parts})) GROUP BY item_id)")
    out.append(
        f"{s} AS MATERIALIZED (SELECT i * {dim_out} + j AS k, sum(v.x[i + 1] * q.gz[j + 1]) AS g FROM {g} q JOIN vec v ON v.item_id = q.item_id, "
        f"range({dim_in}) a(i), range({dim_out}) b(j) GROUP BY 1 UNION ALL "
        f"SELECT {dim_in * dim_out} + j AS k, sum(gz[j + 1]) AS g FROM {g}, range({dim_out}) b(j) GROUP BY 1)")
    out.append(f"{w} AS MATERIALIZED (SELECT list(g / (SELECT count(*) FROM {d}) ORDER BY k) AS g FROM {s})")
    return out


def _after(p: str, w: str, lr: float) -> str:
    return f"list_transform(range(len({p})), lambda k: {p}[k + 1] - {lr!r} * {w}[k + 1])"


def one_step_sql(margin, lr: float, seed: str, batch: int, dim_in: int, dim_out: int, source: str = "tuples_train") -> list[str]:
    """CTEs of the first step: ``pos``, ``p0``, its scored batch ``d0``, its gradient ``w0`` and the parameters ``p1``."""
    return [f"pos AS MATERIALIZED ({_positions_sql(seed, source)})", f"p0 AS MATERIALIZED ({rational_start_sql(dim_in, dim_out)})",
            *_step_ctes(margin, dim_in, dim_out, f"(SELECT * FROM pos WHERE pos < {batch})", "p0", "u0", "d0", "g0", "s0", "w0"),
            f"p1 AS MATERIALIZED (SELECT CASE WHEN w0.g IS NULL THEN p0.p ELSE {_after('p0.p', 'w0.g', lr)} END AS p FROM p0, w0)"]


def fit_sql(margin, lr: float, seed: str, batch: int, dim_in: int, dim_out: int, source: str = "tuples_train", name: str = "fit") -> list[str]:
    """CTEs of one epoch over all rows of ``source``, as many steps as it takes: ``{name}`` is recursive, one row a step
    (step from 0, p after it, norm, n, loss, hits); the row of step -1 holds the start."""
    ms, mc, mn = margin
    loss = f"sum(d2s + greatest(d2c - {mc}, 0.0) + greatest({ms} - d2c, 0.0) + greatest({mn} - d2n, 0.0))"
    hits = {"comp": f"d2c < {mc} AND d2c > {ms}", "sim": f"d2s < {ms}", "neg": f"d2n > {mc}", "rank": "d2c < d2n"}
    counts = ", ".join(f"count(*) FILTER (WHERE {h}) AS hit_{x}" for x, h in hits.items())
    rows = f"(SELECT q.i, q.c, q.s, q.n FROM {name}pos q JOIN {name} f ON q.pos // {batch} = f.step + 1)"
    chain = ", ".join(_step_ctes(margin, dim_in, dim_out, rows, f"(SELECT p FROM {name})", *[f"{name}{x}" for x in "udgsw"]))
    step = (
        f"SELECT f.step + 1 AS step, {_after('f.p', 'w.g', lr)} AS p, sqrt(list_sum(list_transform(w.g, lambda v: v * v)) / len(w.g)) AS norm, "
        f"t.n, t.loss, t.hit_comp, t.hit_sim, t.hit_neg, t.hit_rank FROM {name} f, {name}w w, "
        f"(SELECT count(*) AS n, {loss} AS loss, {counts} FROM {name}d) t WHERE t.n > 0")
    zeros = ", ".join(f"CAST(0 AS BIGINT) AS hit_{x}" for x in hits)
    return [f"{name}pos AS MATERIALIZED ({_positions_sql(seed, source)})",
            f"{name} AS (SELECT CAST(-1 AS BIGINT) AS step, CAST(p AS DOUBLE[]) AS p, CAST(0 AS DOUBLE) AS norm, CAST(0 AS BIGINT) AS n, "
            f"CAST(0 AS DOUBLE) AS loss, {zeros} FROM ({rational_start_sql(dim_in, dim_out)}) "
            f"UNION ALL SELECT * FROM (WITH {chain} {step}))"]


def epoch_metrics_sql(name: str) -> str:
    """(step, metric, value) as the fit logs them: the gradient norm of each step, then the epoch's means."""
    steps = f"(SELECT * FROM {name} WHERE step >= 0)"
    means = f"SELECT count(*) AS step, 'mean_loss' AS metric, sum(loss) / sum(n) AS value FROM {steps}"
    last = f"SELECT count(*), 'last_batch_loss', max_by(loss / n, step) FROM {steps}"
    accs = " UNION ALL ".join(f"SELECT count(*), 'acc_{x}', sum(hit_{x}) / sum(n) FROM {steps}" for x in ("comp", "sim", "neg", "rank"))
    return f"SELECT step, 'grad_norm' AS metric, norm AS value FROM {steps} UNION ALL {means} UNION ALL {last} UNION ALL {accs}"
