import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from tuplespace.llm.conversations import coded_rows, damaged, repair_conversations, repair_report, segments

OTHER = {"": "u", "s": "u", "u": "a", "a": "u"}
FULL = {"u": "user", "a": "assistant"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def brute(rows):
    """Cheapest edits of one conversation's ordered rows by memoised search over all of them, least audit first."""
    faults, seen = [], set()
    for _, _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
        seen.add((role, text))

    @cache
    def best(i, last):
        found = []
        if i == len(rows):
            if last in ("", "a"):
                found.append((0, "", ()))
        else:
            _, _, role, text = rows[i]
            c, a, out = best(i + 1, last)
            found.append((c + 2, "D" + a, out))
            if faults[i] not in (1, 2):
                more = 5 if faults[i] == 3 else 0
                first = role[:1]
                if (last, first) in (("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")):
                    c, a, out = best(i + 1, first)
                    found.append((c + more, "K" + a, (f"{role}:{text}", *out)))
                c, a, out = best(i + 1, OTHER[last])
                found.append((c + more + 1, "R" + a, (f"{FULL[OTHER[last]]}:{text}", *out)))
        for steps in (1, 2):
            now, lines = last, []
            for _ in range(steps):
                now = OTHER[now]
                lines.append(f"{FULL[now]}:")
            row = after_inserts(i, now)
            if row:
                found.append((row[0] + 5 * steps, "I" * steps + row[1], (*lines, *row[2])))
        return min(found)

    @cache
    def after_inserts(i, last):
        """As best, but the next step is a row's edit or the end."""
        if i == len(rows):
            return (0, "", ()) if last in ("", "a") else None
        _, _, role, text = rows[i]
        found = []
        c, a, out = best(i + 1, last)
        found.append((c + 2, "D" + a, out))
        if faults[i] not in (1, 2):
            more = 5 if faults[i] == 3 else 0
            if (last, role[:1]) in (("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")):
                c, a, out = best(i + 1, role[:1])
                found.append((c + more, "K" + a, (f"{role}:{text}", *out)))
            c, a, out = best(i + 1, OTHER[last])
            found.append((c + more + 1, "R" + a, (f"{FULL[OTHER[last]]}:{text}", *out)))
        return min(found)

    cost, audit, lines = best(0, "")
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, digest), lines


def expected(rows, tie):
    out = {conv: [] for conv, *_ in rows}
    for row in damage(rows):
        out[row[0]].append(row)
    return {c: brute(sorted(r, key=lambda x: (x[1] is not None, x[1] or 0, x[2], tie[x[3]])))[0] for c, r in out.items()}


def hashes(spark, rows):
    texts = {r[3] for r in damage(rows)} | {"", " "}
    found = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "xxhash64(t) h").collect()
    return {r.t: r.h for r in found}


def table(spark, rows):
    data = [(*r, "x", 1) for r in rows]
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string, rank string, code int").repartition(4)


def found(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[n] for n in names) for r in rows}


def sample(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "cut", "a b", "  ", "", None, f"own {turn}.", f"own {turn} ", "é?\n"])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 3]), role, text))
    return rows


@pytest.mark.parametrize("chunk", [8192, 3, 1])
def test_equals_brute_force(spark, chunk):
    rows = sample(4, 40, 9) + [(None, k, "user", f"{k}.") for k in range(5)] + [(None, None, None, None)]
    assert found(repair_report(table(spark, rows), chunk)) == expected(rows, hashes(spark, rows))


def test_long_conversation_over_many_chunks(spark):
    """Stretches of blank, repeated and truncated rows, which don't converge, cross many chunks."""
    rng = random.Random(8)
    rows = [(1, k, rng.choice(["user", "assistant"]), rng.choice([f"{k}.", f"{k}", "", "same."])) for k in range(60)]
    rows += [(1, 60 + k, "user", "" if k % 2 else f"cut {k}") for k in range(40)] + [(2, 1, "assistant", "Hello.")]
    assert found(repair_report(table(spark, rows), 5)) == expected(rows, hashes(spark, rows))
    coded = coded_rows(damaged(table(spark, rows)), 5)
    assert segments(coded).where("used != reached").count() > 0


def test_repaired_rows(spark):
    rows = [r for r in sample(11, 25, 8)]
    tie = {r.t: r.h for r in spark.createDataFrame([(r[3] or " ",) for r in rows] + [("",)], "t string").selectExpr("t", "xxhash64(t) h").collect()}
    want = {}
    for conv in {r[0] for r in rows}:
        own = [(c, t, " " if a is None else a, " " if x is None else x) for c, t, a, x in rows if c == conv]
        want[conv] = list(brute(sorted(own, key=lambda x: (x[1] is not None, x[1] or 0, x[2], tie[x[3]])))[1])
    got = {c: [] for c in want}
    for r in repair_conversations(table(spark, rows), 4).orderBy("conv_id", "place").collect():
        assert r.place == len(got[r.conv_id])
        got[r.conv_id].append(f"{r.role}:{r.text}")
    assert got == want


def test_empty_table_and_dropped_conversation(spark):
    assert found(repair_report(table(spark, [(1, 1, "user", "a")]).where("false"))) == {}
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    nothing = hashlib.sha256(b"").hexdigest()
    assert found(repair_report(table(spark, [(gone, 0, "user", "a.")]))) == {gone: (0, 0, 0, 0, 0, 0, "", nothing)}


def test_query(spark, sf_small):
    from tuplespace.llm.queries import op11_viterbi_repair

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(op11_viterbi_repair(spark, sf_small)) == expected(rows, hashes(spark, rows))
