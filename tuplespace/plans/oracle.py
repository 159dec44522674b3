"""DuckDB SQL twins of the registered queries (run by the driver on the same Parquet).

The CTE chain mirrors the Spark plans step by step, but uses the obvious SQL forms
(row_number per group, brute-force joins) so it is an independent check.
"""

from __future__ import annotations

from tuplespace.config import DEFAULT_MARGINS, TupleConfig
from tuplespace.functions.hashing import duck_draw_hash as H
from tuplespace.sources.testdata import DUCK_CTES

SEED = TupleConfig().seed

BASE = {
    "catalog_raw": DUCK_CTES["catalog_raw"],
    "catalog": (
        "SELECT DISTINCT asin, categories, replace(title, chr(10), ' ') AS title, imUrl "
        "FROM catalog_raw WHERE asin IS NOT NULL AND categories IS NOT NULL "
        "AND title IS NOT NULL AND imUrl IS NOT NULL"
    ),
    "pairs": DUCK_CTES["pairs"],
    "comp": "SELECT item_id_1, item_id_2 FROM pairs WHERE label = '1'",
    "neg": "SELECT item_id_1, item_id_2 FROM pairs WHERE label = '0'",
    "vectors": DUCK_CTES["vectors"],
    "cat_paths": (
        "SELECT asin, categories, list_sort(list_transform(list_filter("
        "from_json(categories, '[[\"VARCHAR\"]]'), lambda p: len(p) > 0), lambda p: CAST(to_json(p) AS VARCHAR))) "
        "AS paths FROM catalog"
    ),
    "idx": "SELECT DISTINCT unnest(paths) AS path, asin AS item_id FROM cat_paths",
    "idx_ranked": (
        "SELECT path, item_id, row_number() OVER (PARTITION BY path ORDER BY item_id) - 1 AS r, "
        "count(*) OVER (PARTITION BY path) AS n FROM idx"
    ),
    "idx_sizes": "SELECT path, count(*) AS n FROM idx GROUP BY path",
    "draws": (
        "SELECT c.item_id_1, c.item_id_2 AS comp_id, CASE WHEN len(p.paths) > 0 THEN "
        f"p.paths[1 + ({H(SEED, 'c.item_id_1', 'c.item_id_2', chr(39) + 'path' + chr(39))} % len(p.paths))] "
        "END AS path FROM comp c JOIN cat_paths p ON p.asin = c.item_id_1"
    ),
    "draws_item": (
        "SELECT d.item_id_1, d.comp_id, d.path, r.item_id AS item_id_2 FROM draws d "
        "LEFT JOIN idx_sizes z ON z.path = d.path LEFT JOIN idx_ranked r ON r.path = d.path AND "
        f"r.r = {H(SEED, 'd.item_id_1', 'd.comp_id', chr(39) + 'item' + chr(39))} % z.n"
    ),
    "draws_noself": (
        "SELECT d.item_id_1, d.comp_id, d.path, r.item_id AS item_id_2 FROM draws d "
        "LEFT JOIN idx_sizes z ON z.path = d.path "
        "LEFT JOIN idx_ranked o ON o.path = d.path AND o.item_id = d.item_id_1 "
        "LEFT JOIN idx_ranked r ON r.path = d.path AND z.n > 1 AND r.r = "
        f"({H(SEED, 'd.item_id_1', 'd.comp_id', chr(39) + 'item' + chr(39))} % NULLIF(z.n - 1, 0)) + "
        f"CASE WHEN ({H(SEED, 'd.item_id_1', 'd.comp_id', chr(39) + 'item' + chr(39))} % NULLIF(z.n - 1, 0)) >= o.r "
        "THEN 1 ELSE 0 END"
    ),
    "sim": "SELECT item_id_1, item_id_2 FROM draws_item WHERE item_id_2 IS NOT NULL",
    "vid": "SELECT item_id FROM vectors",
    "comp_v": (
        "SELECT p.item_id_1, p.item_id_2 FROM comp p JOIN vid a ON a.item_id = p.item_id_1 "
        "JOIN vid b ON b.item_id = p.item_id_2"
    ),
    "neg_v": (
        "SELECT p.item_id_1, p.item_id_2 FROM neg p JOIN vid a ON a.item_id = p.item_id_1 "
        "JOIN vid b ON b.item_id = p.item_id_2"
    ),
    "sim_v": (
        "SELECT p.item_id_1, p.item_id_2 FROM sim p JOIN vid a ON a.item_id = p.item_id_1 "
        "JOIN vid b ON b.item_id = p.item_id_2"
    ),
    "C": "SELECT DISTINCT item_id_1 AS i, item_id_2 AS c FROM comp_v",
    "S": "SELECT DISTINCT item_id_1 AS i, item_id_2 AS s FROM sim_v",
    "N": "SELECT DISTINCT item_id_1 AS i, item_id_2 AS n FROM neg_v",
    "s_ranked": "SELECT i, s, row_number() OVER (PARTITION BY i ORDER BY s) - 1 AS r, count(*) OVER (PARTITION BY i) AS k FROM S",
    "n_ranked": "SELECT i, n, row_number() OVER (PARTITION BY i ORDER BY n) - 1 AS r, count(*) OVER (PARTITION BY i) AS k FROM N",
    "tuples_test": (
        "SELECT C.i, C.c, s.s, n.n FROM C "
        "JOIN (SELECT i, max(k) AS k FROM s_ranked GROUP BY i) ks ON ks.i = C.i "
        "JOIN (SELECT i, max(k) AS k FROM n_ranked GROUP BY i) kn ON kn.i = C.i "
        f"JOIN s_ranked s ON s.i = C.i AND s.r = {H(SEED, 'C.i', 'C.c', chr(39) + 's' + chr(39))} % ks.k "
        f"JOIN n_ranked n ON n.i = C.i AND n.r = {H(SEED, 'C.i', 'C.c', chr(39) + 'n' + chr(39))} % kn.k"
    ),
    "tuples_train": "SELECT C.i, C.c, S.s, N.n FROM C JOIN S ON S.i = C.i JOIN N ON N.i = C.i",
}



def sqd(a: str, b: str) -> str:
    """Sum of squared differences of two DOUBLE lists (SQL text)."""
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda k: ({a}[k] - {b}[k]) ^ 2))"


def order_sum_sql(v: str) -> str:
    """Sum of k * v[k], k from 1 (SQL text)."""
    return f"list_sum(list_transform(range(1, len({v}) + 1), lambda k: k * CAST({v}[k] AS DOUBLE)))"


def l2n(v: str) -> str:
    return (f"list_transform({v}, lambda x: CAST(x AS DOUBLE) / sqrt(greatest(list_sum("
            f"list_transform({v}, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))), 1e-12)))")


BASE.update({
    "pairs_v": (
        "SELECT p.kind, p.item_id_1, p.item_id_2, a.ev AS ev1, b.ev AS ev2 FROM ("
        "SELECT 'comp' AS kind, item_id_1, item_id_2 FROM comp UNION ALL "
        "SELECT 'neg', item_id_1, item_id_2 FROM neg UNION ALL "
        "SELECT 'sim', item_id_1, item_id_2 FROM sim) p "
        "JOIN vectors a ON a.item_id = p.item_id_1 JOIN vectors b ON b.item_id = p.item_id_2"
    ),
    "pair_dist": (
        "SELECT kind, item_id_1, item_id_2, sqrt(" + sqd("CAST(ev1 AS DOUBLE[])", "CAST(ev2 AS DOUBLE[])")
        + ") AS eu FROM pairs_v"
    ),
    "outputs_id": f"SELECT item_id, {l2n('ev')} AS out FROM vectors",
    "test_dist": (
        "SELECT t.i, t.c, t.s, t.n, " + sqd("vi.out", "vc.out") + " AS d2c, " + sqd("vi.out", "vs.out")
        + " AS d2s, " + sqd("vi.out", "vn.out") + " AS d2n FROM tuples_test t "
        "JOIN outputs_id vi ON vi.item_id = t.i JOIN outputs_id vc ON vc.item_id = t.c "
        "JOIN outputs_id vs ON vs.item_id = t.s JOIN outputs_id vn ON vn.item_id = t.n"
    ),
    "train_dist": (
        "SELECT t.i, t.c, t.s, t.n, " + sqd("vi.out", "vc.out") + " AS d2c, " + sqd("vi.out", "vs.out")
        + " AS d2s, " + sqd("vi.out", "vn.out") + " AS d2n FROM tuples_train t "
        "JOIN outputs_id vi ON vi.item_id = t.i JOIN outputs_id vc ON vc.item_id = t.c "
        "JOIN outputs_id vs ON vs.item_id = t.s JOIN outputs_id vn ON vn.item_id = t.n"
    ),
    "test_pos": (
        "SELECT i, c, s, n, row_number() OVER (ORDER BY "
        + H(SEED, "i", "c", "s", "n", "'order'") + ", i, c, s, n) - 1 AS pos FROM tuples_test"
    ),
})

BASE.update({
    "dense": "SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM (SELECT DISTINCT item_id FROM vectors)",
})


def tower_sql(src: str, vec: str, dims=(64, 16, 12, 8)) -> str:
    """The rational-weight tower as nested list expressions (one list per layer)."""
    cur = f"CAST({vec} AS DOUBLE[])"
    sql = f"SELECT item_id, {cur} AS h0 FROM {src}"
    for l, (n_in, n_out) in enumerate(zip(dims[:-1], dims[1:]), start=1):
        units = []
        for j in range(n_out):
            dot = (f"list_sum(list_transform(range({n_in}), lambda i: h{l - 1}[i + 1] * "
                   f"((((31 * i + {17 * j} + {7 * l}) % 101) - 50) / 500.0)))")
            units.append(dot if l == len(dims) - 1 else f"greatest({dot}, 0.0)")
        sql = f"SELECT item_id, [{', '.join(units)}] AS h{l} FROM ({sql})"
    last = f"h{len(dims) - 1}"
    return f"SELECT item_id, {l2n(last)} AS out FROM ({sql})"


BASE.update({
    "outputs_tower": tower_sql("vectors", "ev"),
    "tower_dist": (
        "SELECT t.i, t.c, t.s, t.n, " + sqd("vi.out", "vc.out") + " AS d2c, " + sqd("vi.out", "vs.out")
        + " AS d2s, " + sqd("vi.out", "vn.out") + " AS d2n FROM tuples_test t "
        "JOIN outputs_tower vi ON vi.item_id = t.i JOIN outputs_tower vc ON vc.item_id = t.c "
        "JOIN outputs_tower vs ON vs.item_id = t.s JOIN outputs_tower vn ON vn.item_id = t.n"
    ),
})


def linear_gradient_sql(margin, dim_in: int = 64, dim_out: int = 8, source: str = "tuples_test") -> str:
    """Mean gradient of the loss over the tuples of ``source`` for a one-layer linear tower
    z = x W (W_1 rational, zero bias): sum over tuples and roles of x (outer) g_z.
    Parameters are numbered as flattened: W row-major, then b."""
    ms, mc, mn = margin
    units = ", ".join(
        f"list_sum(list_transform(range({dim_in}), lambda i: x[i + 1] * ((((31 * i + {17 * j} + 7) % 101) - 50) / 500.0)))"
        for j in range(dim_out)
    )
    k8 = f"range({dim_out})"
    lin = (f"SELECT item_id, x, z, sqrt(greatest(list_sum(list_transform(z, lambda v: v * v)), 1e-12)) AS r, "
           f"list_sum(list_transform(z, lambda v: v * v)) AS ss FROM (SELECT item_id, x, [{units}] AS z FROM "
           f"(SELECT item_id, CAST(ev AS DOUBLE[]) AS x FROM vectors))")
    unit = f"SELECT item_id, x, r, ss, list_transform(z, lambda v: v / r) AS u FROM ({lin})"
    per = (
        "SELECT t.i, a.x AS xa, c.x AS xc, s.x AS xs, n.x AS xn, a.u AS ua, c.u AS uc, s.u AS us, n.u AS un, "
        "a.r AS ra, c.r AS rc, s.r AS rs, n.r AS rn, a.ss AS sa, c.ss AS sc, s.ss AS s_s, n.ss AS sn "
        f"FROM {source} t JOIN ({unit}) a ON a.item_id = t.i JOIN ({unit}) c ON c.item_id = t.c "
        f"JOIN ({unit}) s ON s.item_id = t.s JOIN ({unit}) n ON n.item_id = t.n"
    )
    diffs = (
        f"SELECT *, list_transform({k8}, lambda k: ua[k + 1] - uc[k + 1]) AS ec, "
        f"list_transform({k8}, lambda k: ua[k + 1] - us[k + 1]) AS es, "
        f"list_transform({k8}, lambda k: ua[k + 1] - un[k + 1]) AS en FROM ({per})"
    )
    wts = (
        "SELECT *, (CASE WHEN d2c > " + str(mc) + " THEN 1.0 ELSE 0.0 END) - (CASE WHEN d2c < " + str(ms)
        + " THEN 1.0 ELSE 0.0 END) AS wc, -(CASE WHEN d2n < " + str(mn) + " THEN 1.0 ELSE 0.0 END) AS wn FROM ("
        "SELECT *, list_sum(list_transform(ec, lambda v: v * v)) AS d2c, "
        f"list_sum(list_transform(en, lambda v: v * v)) AS d2n FROM ({diffs}))"
    )
    gu = (
        f"SELECT *, list_transform({k8}, lambda k: 2 * (wc * ec[k + 1] + es[k + 1] + wn * en[k + 1])) AS gua, "
        f"list_transform({k8}, lambda k: -2 * wc * ec[k + 1]) AS guc, "
        f"list_transform({k8}, lambda k: -2 * es[k + 1]) AS gus, "
        f"list_transform({k8}, lambda k: -2 * wn * en[k + 1]) AS gun FROM ({wts})"
    )

    def gz(g, u, r, ss):
        dot = f"list_sum(list_transform({k8}, lambda k: {g}[k + 1] * {u}[k + 1]))"
        return (f"CASE WHEN {ss} > 1e-12 THEN list_transform({k8}, lambda k: ({g}[k + 1] - {dot} * {u}[k + 1]) / {r}) "
                f"ELSE list_transform({g}, lambda v: v / {r}) END")

    rows = " UNION ALL ".join(
        f"SELECT {x} AS x, {gz(g, u, r, ss)} AS gz FROM ({gu})"
        for x, g, u, r, ss in (("xa", "gua", "ua", "ra", "sa"), ("xc", "guc", "uc", "rc", "sc"),
                               ("xs", "gus", "us", "rs", "s_s"), ("xn", "gun", "un", "rn", "sn"))
    )
    return (
        f"SELECT param, round(g / (SELECT count(*) FROM {source}), 6) AS g FROM ("
        f"SELECT wi * {dim_out} + wj AS param, sum(x[wi + 1] * gz[wj + 1]) AS g FROM ({rows}) q, "
        f"range({dim_in}) ti(wi), range({dim_out}) tj(wj) GROUP BY wi, wj "
        f"UNION ALL SELECT {dim_in * dim_out} + wj AS param, sum(gz[wj + 1]) AS g FROM ({rows}) q, "
        f"range({dim_out}) tj(wj) GROUP BY wj)"
    )


def margins_values(margins=DEFAULT_MARGINS) -> str:
    rows = ", ".join(f"({k}, {ms}, {mc}, {mn})" for k, (ms, mc, mn) in enumerate(margins))
    return f"(VALUES {rows}) AS m(margin_id, ms, mc, mn)"


def loss_sql(ms="m.ms", mc="m.mc", mn="m.mn") -> dict[str, str]:
    t = {
        "loss_sim": "d2s",
        "loss_c1": f"greatest(d2c - {mc}, 0.0)",
        "loss_c2": f"greatest({ms} - d2c, 0.0)",
        "loss_neg": f"greatest({mn} - d2n, 0.0)",
    }
    t["loss"] = " + ".join(f"({v})" for v in t.values())
    return t


def pred_sql(ms="m.ms", mc="m.mc", mn="m.mn") -> dict[str, str]:
    return {
        "pred_comp": f"(d2c < {mc} AND d2c > {ms})",
        "pred_sim": f"(d2s < {ms})",
        "pred_neg": f"(d2n > {mc})",
        "pred_rank": "(d2c < d2n)",
    }


def r6(expr: str, name: str) -> str:
    return f"round({expr}, 6) AS {name}"


ORDER = list(BASE)


def with_ctes(body: str, *needs: str) -> str:
    """Prefix ``body`` with the CTEs it (transitively) needs, in dependency order."""
    wanted: set[str] = set()

    def visit(name: str) -> None:
        if name in wanted:
            return
        wanted.add(name)
        for other in ORDER:
            if other != name and _mentions(BASE[name], other):
                visit(other)

    for n in needs:
        visit(n)
    ctes = [f"{n} AS ({BASE[n]})" for n in ORDER if n in wanted]
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


def _mentions(sql: str, name: str) -> bool:
    import re

    return re.search(rf"\b(FROM|JOIN)\s+{re.escape(name)}\b", sql) is not None

