"""The shared item tower: fc -> relu -> fc -> relu -> fc, then L2 normalisation.

The reference pushes anchor, complementary, similar and negative through the same
weights, i.e. four passes per tuple. The tower is a function of the item alone, so
here it runs once per distinct item (Arrow batches in mapInPandas, 2-D numpy
matmuls) and the tuples join the small output table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuplespace.functions.vectors import NORM_EPS, as_double, l2_normalize

Layers = list[tuple[np.ndarray, np.ndarray]]


def rational_weights(dims: tuple[int, ...]) -> Layers:
    """Deterministic weights both engines can reproduce exactly:
    W_l[i][j] = ((31 i + 17 j + 7 l) % 101 - 50) / 500 for layer l = 1.., zero bias."""
    layers = []
    for l, (n_in, n_out) in enumerate(zip(dims[:-1], dims[1:]), start=1):
        i = np.arange(n_in)[:, None]
        j = np.arange(n_out)[None, :]
        w = (((31 * i + 17 * j + 7 * l) % 101) - 50) / 500.0
        layers.append((w.astype(np.float64), np.zeros(n_out, dtype=np.float64)))
    return layers


def glorot_weights(dims: tuple[int, ...], seed: int) -> Layers:
    """Glorot-normal weights (std sqrt(2/(in+out)), truncated at 2 std) and zero bias."""
    rng = np.random.default_rng(seed)
    layers = []
    for n_in, n_out in zip(dims[:-1], dims[1:]):
        std = np.sqrt(2.0 / (n_in + n_out))
        w = rng.normal(0.0, std, size=(n_in, n_out))
        while (far := np.abs(w) > 2 * std).any():  # draw again, so no mass piles up at the ends
            w[far] = rng.normal(0.0, std, size=int(far.sum()))
        layers.append((w, np.zeros(n_out)))
    return layers


def forward(x: np.ndarray, layers: Layers, keep: bool = False):
    """Batch forward pass; relu after every layer but the last.

    With ``keep`` also returns the pre-activations of every layer (for backprop)."""
    acts, pre = [x], []
    h = x
    for k, (w, b) in enumerate(layers):
        z = h @ w + b
        pre.append(z)
        h = np.maximum(z, 0.0) if k < len(layers) - 1 else z
        acts.append(h)
    return (h, acts, pre) if keep else h


def normalize_rows(z: np.ndarray) -> np.ndarray:
    ss = np.sum(z * z, axis=1, keepdims=True)
    return z / np.sqrt(np.maximum(ss, NORM_EPS))


def stack(col, dim: int | None = None) -> np.ndarray:
    """A column of equally long vectors as a matrix; an Arrow list column is flattened at once."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.Array):
        flat = np.asarray(col.flatten(), dtype=np.float64)
        return flat.reshape(len(col), dim if dim is not None else (len(flat) // len(col) if len(col) else 0))
    if len(col) == 0:
        return np.zeros((0, dim or 0))
    return np.concatenate(list(col)).astype(np.float64, copy=False).reshape(len(col), -1)


def tower_outputs(vectors: DataFrame, layers: Layers | None, normalize: bool = True,
                  out_col: str = "out") -> DataFrame:
    """(item_id, ev) -> (item_id, out ARRAY<DOUBLE>).

    ``layers=None`` is the identity tower (vectors as they are); the normalisation
    then stays a native expression.
    """
    if layers is None:
        v = as_double(F.col("ev"))
        return vectors.select("item_id", (l2_normalize(v) if normalize else v).alias(out_col))
    id_type = vectors.schema["item_id"].dataType
    schema = T.StructType([
        T.StructField("item_id", id_type),
        T.StructField(out_col, T.ArrayType(T.DoubleType())),
    ])
    dim_in = layers[0][0].shape[0]

    def run(batches):
        for batch in batches:
            z = forward(stack(batch.column("ev"), dim_in), layers)
            if normalize:
                z = normalize_rows(z)
            ends = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.ListArray.from_arrays(ends, pa.array(z.ravel()))], names=["item_id", out_col])

    return vectors.select("item_id", "ev").where(F.col("ev").isNotNull()).mapInArrow(run, schema)
