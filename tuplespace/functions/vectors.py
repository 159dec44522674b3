"""Vector expressions on ARRAY<FLOAT|DOUBLE> columns (higher-order functions, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the epsilon of the normalisation (unit length unless sum of squares <= EPS).
NORM_EPS = 1e-12


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def parse_vector(text: Column) -> Column:
    """'[a, b, ...]' -> ARRAY<DOUBLE>; malformed text gives null (never eval)."""
    return F.from_json(text, "array<double>")


def parse_vector_loose(text: Column) -> Column:
    """Bracket strip + comma split + cast; for '1,2' style payloads."""
    body = F.regexp_replace(text, r"[\[\]\s]", "")
    parts = F.filter(F.split(body, ","), lambda p: p != "")
    return F.transform(parts, lambda p: p.cast("double"))


def sq_distance(a: Column, b: Column) -> Column:
    """Sum of squared differences in double precision (null if lengths differ)."""
    diffs = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))
    return F.when(F.size(a) == F.size(b), F.aggregate(diffs, F.lit(0.0), lambda acc, x: acc + x))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(sq_distance(a, b))


def sum_squares(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def order_sum(v: Column) -> Column:
    """Sum of k * v[k], k from 1: a digest of a vector that a change of order changes."""
    terms = F.zip_with(v, F.sequence(F.lit(1), F.size(v)), lambda x, k: x.cast("double") * k)
    return F.when(F.size(v) > 0, F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x))


def l2_normalize(v: Column) -> Column:
    """v * rsqrt(max(sum v^2, eps)); the zero vector stays zero.

    The sum of squares is bound once by aggregate's finish function (a scale
    written inside transform's lambda would be recomputed for every element)."""
    return F.aggregate(
        v,
        F.lit(0.0),
        lambda acc, x: acc + x.cast("double") * x.cast("double"),
        lambda ss: F.transform(v, lambda x: x.cast("double") * (F.lit(1.0) / F.sqrt(F.greatest(ss, F.lit(NORM_EPS))))),
    )


def l2_scale(v: Column) -> Column:
    """The factor of :func:`l2_normalize`: v times it is the normalised vector, to the bit."""
    return F.lit(1.0) / F.sqrt(F.greatest(sum_squares(v), F.lit(NORM_EPS)))


def vector_text(v: Column) -> Column:
    """ARRAY -> '[a, b]' text (the reference's vector file spelling)."""
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ", "), F.lit("]"))


# --- Arrow batch kernel for data-sized distance work ----------------------------------
# Spark's higher-order array functions are interpreted per element; for millions of
# 64-dim pairs an Arrow batch (one 2-D numpy subtraction per batch) is cheaper.

def _sq_dist_arrow(a, b):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    n = len(a)
    out = np.full(n, np.nan)
    valid = np.ones(n, dtype=bool)
    if a.null_count or b.null_count:
        valid &= ~(np.asarray(a.is_null()) | np.asarray(b.is_null()))
    la = np.asarray(pc.fill_null(pc.list_value_length(a), -1))
    lb = np.asarray(pc.fill_null(pc.list_value_length(b), -2))
    valid &= la == lb
    if n and valid.all() and (la == la[0]).all():
        width = int(la[0])
        va = np.asarray(pc.list_flatten(a), dtype=np.float64).reshape(n, width)
        vb = np.asarray(pc.list_flatten(b), dtype=np.float64).reshape(n, width)
        return pa.array(((va - vb) ** 2).sum(axis=1))
    # Null and ragged rows are set apart; the others go width by width on the 2-D path.
    for width in np.unique(la[valid]).tolist():
        rows = np.flatnonzero(valid & (la == width))
        va, vb = (np.asarray(pc.list_flatten(x.take(pa.array(rows))), dtype=np.float64).reshape(len(rows), width) for x in (a, b))
        out[rows] = ((va - vb) ** 2).sum(axis=1)
    return pa.array(out, mask=~valid)


def with_sq_distances(df, specs, keep, sqrt: bool = False):
    """Append squared distances (or distances with ``sqrt``) for each (a, b, out)
    in ``specs``; rows keep the ``keep`` columns. Null when a vector is missing or
    the lengths differ (as sq_distance)."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import types as T

    fields = [df.schema[c] for c in keep] + [T.StructField(o, T.DoubleType()) for _, _, o in specs]
    schema = T.StructType(fields)
    needed = list(dict.fromkeys(list(keep) + [c for a, b, _ in specs for c in (a, b)]))

    def run(batches):
        for batch in batches:
            arrays = [batch.column(c) for c in keep]
            for a, b, _ in specs:
                d = _sq_dist_arrow(batch.column(a), batch.column(b))
                if sqrt:
                    d = pa.array(np.sqrt(np.asarray(d.to_numpy(zero_copy_only=False))), mask=np.asarray(d.is_null()))
                arrays.append(d)
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema(
                [pa.field(f.name, batch.schema.field(f.name).type) for f in fields[: len(keep)]]
                + [pa.field(o, pa.float64()) for _, _, o in specs]
            ))

    return df.select(*needed).mapInArrow(run, schema)
