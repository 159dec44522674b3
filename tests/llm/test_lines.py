import hashlib
import re
from collections import Counter

from tuplespace.llm.lines import LineRuns, drop_frequent_lines, line_report
from tuplespace.llm.queries import op4_line_runs

STRIP = " \t\n\x0b\x0c\r"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(STRIP))


def brute(rows, least=10):
    split = [(i, (t or "").split("\n")) for i, t in rows]
    found = Counter(k for _, ls in split for k in {key(x) for x in ls} if k)
    out = []
    for i, ls in split:
        kept = [x for x in ls if not (key(x) and found[key(x)] >= least)]
        out.append((i, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_query(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op4_line_runs(spark, sf_small).collect()), key=str) == brute(rows)


def test_edges(spark, rng):
    hot = ["Common LINE", "  common line\t", "É x", "é x", "\x0b", "x" * 50000]
    rows = [(k, "\n".join(rng.choices([*hot, f"own {k}", "", " "], k=rng.randint(0, 9)))) for k in range(60)]
    rows += [(None, "common line"), (None, None), (107, "common line\ncommon line"), (107, "common line\ncommon line"), (108, "\n\n"),
             (109, "common line\n" * 3000 + "end"), (110, None), (111, "")]
    docs = spark.createDataFrame([(i, t, 0, "z") for i, t in rows], "doc_id long, text string, pos int, h1 string").repartition(4)
    assert sorted((tuple(r) for r in line_report(docs).collect()), key=str) == brute(rows)
    assert line_report(docs.where("doc_id > 1000")).collect() == []
    texts = {r.doc_id: r.kept_text for r in drop_frequent_lines(docs).collect()}
    assert texts[109] == "end" and texts[108] == "\n\n"


def test_batches_and_compaction_keep_counts(spark, rng):
    runs, want = LineRuns(spark, settled=5, fanout=2), Counter()
    for _ in range(7):
        batch = Counter(rng.choices(range(12), k=9))
        want.update(batch)
        runs.add(spark.createDataFrame([(k, k + 1, n) for k, n in batch.items()], "h1 long, h2 int, n long"))
        assert all(len(level) < 2 for level in runs.levels)
    assert sorted(r.h1 for r in runs.frequent().collect()) == sorted(k for k, n in want.items() if n >= 5)
    assert LineRuns(spark, 3).frequent().collect() == []


def test_settled_hashes_are_not_added_again(spark):
    runs = LineRuns(spark, settled=3)
    runs.add(spark.createDataFrame([(1, 1, 3), (2, 2, 1)], "h1 long, h2 int, n long"))
    runs.add(spark.createDataFrame([(1, 1, 9), (2, 2, 1)], "h1 long, h2 int, n long"))
    assert [(r.h1, r.n) for r in runs.levels[0][1].collect()] == [(2, 1)]
