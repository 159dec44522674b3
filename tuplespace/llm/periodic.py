"""Periodic runs of words: scale-tiled search, boundary Z-functions, stitched intervals.

A run is a maximal stretch of words with smallest period q and at least
``max(LEAST_WORDS, LEAST_PERIODS * q)`` words. Periods are searched by octave: for the
periods q in [S, 2S), S a power of two, a document is cut into tiles around the
boundaries c = 0, S, 2S, ..., a tile being the words [c - S, c + 4S).

* A tile is solved alone. The Z-function of the words from c gives, for each q, how far
  they agree with the words from c + q; the Z-function of the reversed words before
  both boundaries gives how far they agree to the left. Together they are the fragment
  of period q around [c, c + q + S). A boundary whose next S words do not return
  q words later (compared by rolling hashes, all boundaries of a block at once) has no
  such fragment and needs no Z-function.
* A run of at least 4q words holds two neighbouring boundaries or more that find it.
  Fragments of neighbouring tiles share q words at least and so belong to one run;
  the first and the last tile see the run's ends. A fragment that has a proper divisor
  of q as a period is no fragment of smallest period q, and then neither is its run.
* Fragments are shuffled by document and period and stitched where they share q words.

Tiles of one document, or of one stretch of a document with more than ``GROUP`` words,
are solved in one task; the stretches of a long document are rows of their own and are
dealt over all tasks. A tile row for every octave would multiply each text by its
number of octaves, so short texts are tiled where they are read. Only texts with
fragments cross a shuffle.

Cases: a null or empty text has no words and no run. Rows that repeat an id stay, each
judged by its own text. A null id is a row like others, to which no repetition is
planted. Words are compared by 64-bit hash, case included. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuplespace.llm.common import SAME_BYTES, hash_spans, small_batches, string_view, text_blocks, word_spans
from tuplespace.session import cut_lineage

LEAST_WORDS, LEAST_PERIODS = 6, 4
GROUP = 1 << 16  # words: a longer document is dealt in stretches
_BASE = np.uint64(0x9E3779B97F4A7C15)


def least_length(period):
    return np.maximum(LEAST_WORDS, LEAST_PERIODS * period)


def z_function(s: list) -> list[int]:
    """z[i]: how many items from i on agree with those from 0 on (z[0] is the length)."""
    n = len(s)
    z = [n] + [0] * (n - 1)
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _prime_factors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] if n > 1 else out


def solve_tile(codes: np.ndarray, boundary: int, size: int, periods: list[int]) -> list[tuple[int, int, int]]:
    """(period, begin, end) of the fragments with a smallest period among ``periods`` in one tile of ``codes``."""
    low, high = max(boundary - size, 0), min(boundary + 4 * size, len(codes))
    ahead = z_function(codes[boundary:high].tolist())
    upto = min(boundary + 2 * size, high)  # the left side of c + q, q < 2 * size
    before = codes[low:boundary][::-1].tolist()
    behind = z_function([*before, None, *codes[low:upto][::-1].tolist()])

    def left(q: int) -> int:
        at = len(before) + 1 + upto - boundary - q
        return behind[at] if at < len(behind) else 0

    out = []
    for q in periods:
        begin, end = boundary - left(q), boundary + q + ahead[q]
        inner = end < boundary + 4 * size and begin > boundary - size
        if ahead[q] < size or (inner and end - begin < least_length(q)):
            continue
        shorter = (q // p for p in _prime_factors(q))
        if not any(left(d) >= boundary - begin and ahead[d] + d >= end - boundary for d in shorter):
            out.append((q, begin, end))
    return out


def fragments(codes: np.ndarray, begins: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray, sizes):
    """Fragments of all units (stretches [begins, ends) of ``codes``): (unit, period, begin, end), places within the unit.

    ``first`` and ``last`` bound a unit's own boundaries, ``sizes`` are the octaves."""
    powers = np.ones(len(codes) + 1, np.uint64)
    powers[1:] = _BASE
    np.cumprod(powers, out=powers)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers[:-1], out=sums[1:])
    found: list[tuple[int, int, int, int]] = []
    for size in sizes:
        units = np.flatnonzero(ends - begins >= 4 * size)
        if not len(units):
            continue
        counts = np.maximum(-(-last[units] // size) - -(-first[units] // size), 0)
        unit = np.repeat(units, counts)
        boundary = (np.arange(len(unit)) - np.repeat(np.cumsum(counts) - counts, counts) + -(-first[unit] // size)) * size
        keep = begins[unit] + boundary + 2 * size <= ends[unit]  # room for the shortest period
        unit, boundary = unit[keep], boundary[keep]
        for a in range(0, len(unit), max(1, (1 << 18) // size)):
            some, c = unit[a : a + max(1, (1 << 18) // size)], boundary[a : a + max(1, (1 << 18) // size)]
            at = (begins[some] + c)[:, None]
            there = at + np.arange(size, 2 * size)
            fits = there + size <= ends[some][:, None]
            there = np.where(fits, there, at)
            own = (sums[at + size * fits[:, :1]] - sums[at]) * powers[there - at]
            returns = fits & (own == sums[there + size * fits] - sums[there])
            rows, shifts = np.nonzero(returns)
            if not len(rows):
                continue
            heads = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            reach = _reach(found, size)
            for h, e in zip(heads.tolist(), [*heads[1:].tolist(), len(rows)], strict=True):
                k = int(rows[h])
                u, place = int(some[k]), int(c[k])
                if _inside(reach.get(u), max(place - size, 0), place + 4 * size):
                    continue
                text = codes[begins[u] : ends[u]]
                found += [(u, q, x, y) for q, x, y in solve_tile(text, place, size, (shifts[h:e] + size).tolist())]
    return stitch(np.array(found, np.int64).reshape(-1, 4))


def _reach(found, size: int) -> dict[int, tuple[list[int], list[int]]]:
    """Per unit the begins of its runs found so far with periods under ``size``, and the furthest end up to each."""
    out: dict[int, tuple[list[int], list[int]]] = {}
    runs = stitch(np.array(found, np.int64).reshape(-1, 4))
    runs = runs[(runs[:, 1] < size) & (runs[:, 3] - runs[:, 2] >= LEAST_PERIODS * size)]
    for u, _, x, y in runs[np.lexsort((runs[:, 2], runs[:, 0]))].tolist():
        begins, ends = out.setdefault(u, ([], []))
        begins.append(x)
        ends.append(max(y, ends[-1]) if ends else y)
    return out


def _inside(runs, low: int, high: int) -> bool:
    """A tile inside a run of a shorter period holds no fragment of another smallest period: fragments here
    have at least the sum of both periods, and two periods of so long a stretch have their divisor as period."""
    at = bisect_right(runs[0], low) - 1 if runs else -1
    return at >= 0 and runs[1][at] >= high


def stitch(rows: np.ndarray) -> np.ndarray:
    """Union of (unit, period, begin, end) rows that share at least ``period`` words, by unit, period and begin."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    out = [rows[0].copy()]
    for row in rows[1:]:
        top = out[-1]
        if row[0] == top[0] and row[1] == top[1] and row[2] + row[1] <= top[3]:
            top[3] = max(top[3], row[3])
        else:
            out.append(row.copy())
    return np.array(out)


def octaves(n: int) -> list[int]:
    """The octaves in which a text of ``n`` words can hold a run."""
    return [1 << k for k in range(max(int(n) // LEAST_PERIODS, 0).bit_length())]


# Texts ----------------------------------------------------------------------------

def planted_order(doc_id: int, n: int) -> np.ndarray:
    """Which original word stands at each place, by the contract's rule: every tenth id by hash repeats part of itself to the end."""
    h = zlib.crc32(str(doc_id).encode())
    out = np.arange(n)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        out[a:] = a + (out[a:] - a) % p
    return out


def plain_order(doc_id, n: int) -> np.ndarray:
    return np.arange(n)


_TILED = ("doc_id long, d8 long, n long, joined binary, collapsed_sha256 string, periods array<long>, begins array<long>, "
          "ends array<long>, size long, base long, lows long, highs long, words binary")


def _tile_texts(order, group: int):
    """Per text its fragments (those of short texts) or its stretches as further rows (long texts)."""
    def run(batches):
        for block in text_blocks(batches):
            data, offsets = string_view(block.column("text"))
            starts, ends, owners = word_spans(data, offsets)
            codes = hash_spans(data, starts, ends, SAME_BYTES)
            edges = np.searchsorted(owners, np.arange(block.num_rows + 1))
            raw, ids, names = data.tobytes(), block.column("doc_id").to_pylist(), block.column("d8").to_pylist()
            places = []
            for k, doc_id in enumerate(ids):
                n = int(edges[k + 1] - edges[k])
                places.append(edges[k] + (np.arange(n) if doc_id is None else order(doc_id, n)))
            place = np.concatenate(places) if places else np.zeros(0, np.int64)
            codes = codes[place]
            counts = np.diff(edges)
            short = np.flatnonzero(counts <= group)
            most = int(counts[short].max(initial=0))
            found = fragments(codes, edges[short], edges[short + 1], np.zeros(len(short), np.int64), counts[short], octaves(most))
            cuts = np.searchsorted(found[:, 0], np.arange(len(short) + 1)) if len(found) else np.zeros(len(short) + 1, np.int64)
            where = dict(zip(short.tolist(), range(len(short)), strict=True))
            rows = []
            for k, doc_id in enumerate(ids):
                n, own = int(counts[k]), found[:0]
                if k in where:
                    own = found[cuts[where[k]] : cuts[where[k] + 1]]
                joined = b" ".join([raw[a:b] for a, b in zip(starts[places[k]].tolist(), ends[places[k]].tolist(), strict=True)])
                kept = k in where and not len(own)  # nothing to drop
                rows.append((doc_id, names[k], n, None if kept else joined, hashlib.sha256(joined).hexdigest() if kept else None,
                             *(own[:, j].tolist() for j in (1, 2, 3)), None, None, None, None, None))
                if k not in where:
                    rows += [(doc_id, names[k], n, None, None, None, None, None, *s) for s in
                             stretches(codes[edges[k] : edges[k + 1]], group)]
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    longs, lists = pa.int64(), pa.list_(pa.int64())
    kinds = [longs, longs, longs, pa.binary(), pa.string(), lists, lists, lists, longs, longs, longs, longs, pa.binary()]
    names = [f.split()[0] for f in _TILED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def stretches(codes: np.ndarray, group: int):
    """(largest octave, base, first and last own boundary from the base, words) of each stretch of one long text.

    Octaves up to group / 16 share a stretch of ``group`` words and their margins; each longer octave has its own."""
    small = [s for s in octaves(len(codes)) if 16 * s <= group] or [1]
    plans = [(small[-1], max(group, 16))] + [(s, 16 * s) for s in octaves(len(codes)) if 16 * s > max(group, 16)]
    for size, width in plans:
        for begin in range(0, len(codes), width):
            base = max(begin - size, 0)
            words = codes[base : begin + width + 4 * size]
            yield size, base, begin - base, min(begin + width, len(codes)) - base, words.astype("<u8").tobytes()


def _solve_stretches(group: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                codes = np.frombuffer(row["words"], "<u8").astype(np.uint64)
                sizes = [row["size"]] if 16 * row["size"] > max(group, 16) else octaves(4 * row["size"])
                found = fragments(codes, np.zeros(1, np.int64), np.array([len(codes)]), np.array([row["lows"]]),
                                  np.array([row["highs"]]), sizes)
                found = found + np.array([0, 0, row["base"], row["base"]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["doc_id"]] * len(found), pa.int64()), pa.array([row["d8"]] * len(found), pa.int64()),
                     *(pa.array(found[:, k]) for k in (1, 2, 3))], names=["doc_id", "d8", "period", "begin", "end"])

    return run


def _collapse(batches):
    """The contract's row of each text with fragments, from its whole runs."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            words, runs = row["joined"].split(b" ") if row["joined"] else [], sorted(row["runs"] or [], key=lambda r: (r["begin"], r["length"], r["period"]))
            step = np.zeros(len(words) + 1, np.int64)
            for r in runs:
                step[r["begin"] + r["period"]] += 1
                step[r["begin"] + r["length"]] -= 1
            gone = np.cumsum(step[:-1]) > 0
            kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            lines = "".join(f"{r['begin']},{r['length']},{r['period']}\n" for r in runs)
            best = min(runs, key=lambda r: (-r["length"], r["begin"], r["period"]), default=None)
            top = (None,) * 4 if best is None else (
                best["begin"], best["length"], best["period"], 1000 * best["length"] // best["period"])
            rows.append((row["doc_id"], len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(),
                         hashlib.sha256(b" ".join(kept)).hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], pa.int64() if k < 6 else pa.string()) for k in range(8)],
            names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])


def _tiled(docs: DataFrame, order, group: int) -> DataFrame:
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long"), text.alias("text"),
                        F.xxhash64(text, F.col("doc_id").isNull()).alias("d8"))
    return cut_lineage(texts.mapInArrow(_tile_texts(order, group), _TILED), "period-tiles")


def _runs(tiled: DataFrame, group: int) -> DataFrame:
    zipped = F.explode(F.arrays_zip("periods", "begins", "ends")).alias("f")
    short = tiled.where("size IS NULL").select("doc_id", "d8", zipped).select(
        "doc_id", "d8", F.col("f.periods").alias("period"), F.col("f.begins").alias("begin"), F.col("f.ends").alias("end"))
    long = tiled.where("size IS NOT NULL").select("doc_id", "d8", "size", "base", "lows", "highs", "words")
    long = long.repartition("doc_id", "d8", "size", "base").mapInArrow(
        _solve_stretches(group), "doc_id long, d8 long, period long, begin long, end long")
    by_begin = Window.partitionBy("doc_id", "d8", "period").orderBy("begin", "end")
    known = F.max("end").over(by_begin.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(known >= F.col("begin") + F.col("period"), 0).otherwise(1)
    marked = short.unionByName(long).withColumn("opens", opens).withColumn("run", F.sum("opens").over(by_begin))
    runs = marked.groupBy("doc_id", "d8", "period", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    length = F.col("end") - F.col("begin")
    return runs.select("doc_id", "d8", "begin", length.alias("length"), "period").where(
        length >= F.greatest(F.lit(LEAST_WORDS), LEAST_PERIODS * F.col("period")))


def periodic_runs(docs: DataFrame, order=plain_order, group: int = GROUP) -> DataFrame:
    """All runs of ``docs`` (doc_id, text): doc_id, d8 (hash of the text), begin, length, period."""
    return _runs(_tiled(docs, order, group), group)


def collapse_runs(docs: DataFrame, order=planted_order, group: int = GROUP) -> DataFrame:
    """Per row of ``docs``: number of runs, the longest, digests of all runs and of the text without their repeats.

    ``order(doc_id, n)`` gives the original word at each of the ``n`` places of a document."""
    tiled = _tiled(docs, order, group)
    key = ["doc_id", "d8"]
    held = _runs(tiled, group).groupBy(*key).agg(F.collect_list(F.struct("begin", "length", "period")).alias("runs"))
    texts = tiled.where("size IS NULL AND joined IS NOT NULL").select(*key, "joined")
    same = texts["doc_id"].eqNullSafe(held["doc_id"]) & (texts["d8"] == held["d8"])
    out = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    busy = texts.join(held, same, "left").select(texts["doc_id"], "joined", "runs").mapInArrow(_collapse, out)
    no_runs = hashlib.sha256(b"").hexdigest()
    nothing = [F.lit(None).cast("long").alias(c) for c in ("start", "length", "period", "exponent_milli")]
    plain = tiled.where("size IS NULL AND joined IS NULL").select(
        "doc_id", F.lit(0).cast("long").alias("n_runs"), *nothing, F.lit(no_runs).alias("runs_sha256"), "collapsed_sha256")
    return plain.unionByName(busy)
