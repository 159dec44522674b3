"""URL filter by a character language-model ratio.

Two variable-order Markov models, one of accepted and one of rejected URLs, give the
probability of each character after the up to ``ORDER`` characters before it. Orders
are interpolated by Witten-Bell smoothing: a context that was seen often trusts its
own counts, a new one falls back to the shorter context, down to an even chance. A
URL's score is the difference of the two log-likelihoods divided by its length; it is
accepted at or above a threshold that is calibrated on URLs kept out of training.

The labels come from host and path rules: a URL under a rule has the rule's verdict
and trains or calibrates the models, any other gets the method's verdict. The models see the
whole URL as it stands, scheme, query and fragment included. Counting
and scoring work on distinct URLs, so that copies of a URL are one row. A URL is cut into
pieces of ``PIECE`` characters before its characters become rows, which carry a row id and no URL. n-grams are
pre-aggregated before every shuffle; the few that are frequent meet their ratios by a
broadcast of at most ``HOT_SHARE`` rows, so that no n-gram's occurrences crowd one task. Only DataFrame functions are used.

Cases: a URL that is null or has no ``://`` has an empty host and path and fits no rule;
it is scored as it stands, null as the empty string. Without examples of both kinds the score is that
of the even chance, the threshold 0. Repeated rows are judged alike. Further columns
are not read.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuplespace.session import cut_lineage, drop_table

ORDER = 4
EVEN_CHANCE = 1 / 256
CALIBRATION_DIGITS = ("0", "4", "8", "c")  # first hexadecimal digit of the URL's MD5: a quarter of the labelled URLs
BIN = 0.02
PIECE = 256
HOT_SHARE = 5_000  # an n-gram with more than one in so many of all characters is hot
# The rules, (host, start of path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
_OPEN, _CLOSE = "\x02", "\x03"


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits (host or parent domain, start of path) as a struct (rule, verdict), or null."""
    longest_first = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(
        F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in longest_first]
    return F.coalesce(*[F.when(condition, rule) for condition, rule in fits])


def _positions(urls: DataFrame) -> DataFrame:
    """(columns but url, ctx, ch): a row per character and the end mark, with the ORDER characters before it."""
    rest = [c for c in urls.columns if c != "url"]
    pieces = F.regexp_extract_all(F.concat("url", F.lit(_CLOSE)), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    cut = urls.select(*rest, pieces.alias("_pieces")).select(*rest, "_pieces", F.posexplode("_pieces").alias("_k", "_piece"))
    before = F.when(F.col("_k") == 0, _OPEN * ORDER).otherwise(F.right(F.element_at("_pieces", F.greatest(F.col("_k"), F.lit(1))), F.lit(ORDER)))
    text = cut.select(*rest, F.concat(before, "_piece").alias("_text"))
    rows = text.withColumn("_at", F.explode(F.sequence(F.lit(1), F.length("_text") - ORDER)))
    return rows.select(*rest, F.substring("_text", F.col("_at"), F.lit(ORDER)).alias("ctx"),
                       F.substring("_text", F.col("_at") + ORDER, F.lit(1)).alias("ch"))


def gram_ratios(grams: DataFrame, counted: DataFrame) -> DataFrame:
    """(ctx, ch, ratio): log-likelihood difference of every gram in ``grams``, by the counts
    ``counted`` (ctx, ch, n_allow, n_block) of the training URLs."""
    out = grams.select("ctx", "ch", F.lit(EVEN_CHANCE).alias("p_allow"), F.lit(EVEN_CHANCE).alias("p_block"))
    for order in range(ORDER + 1):
        shorter = F.substring("ctx", -order, order) if order else F.lit("")
        own = counted.groupBy(shorter.alias("c"), F.col("ch").alias("h")).agg(
            F.sum("n_allow").alias("n_allow"), F.sum("n_block").alias("n_block"))
        ctx = own.groupBy("c").agg(*[f(x).alias(f"{name}_{k}") for k in ("allow", "block") for name, f, x in (
            ("all", F.sum, F.col(f"n_{k}")), ("kinds", F.sum, (F.col(f"n_{k}") > 0).cast("long")))])
        out = out.withColumn("c", shorter).join(ctx, "c", "left")
        out = out.join(own, (out["c"] == own["c"]) & (out["ch"] == own["h"]), "left").select(
            out["ctx"], out["ch"], *[_witten_bell(k).alias(f"p_{k}") for k in ("allow", "block")])
    return out.select("ctx", "ch", (F.ln("p_allow") - F.ln("p_block")).alias("ratio"))


def _witten_bell(k: str) -> Column:
    total, kinds, n, p = (F.col(c) for c in (f"all_{k}", f"kinds_{k}", f"n_{k}", f"p_{k}"))
    return F.when(total > 0, (F.coalesce(n, F.lit(0)) + kinds * p) / (total + kinds)).otherwise(p)


def score_urls(urls: DataFrame) -> DataFrame:
    """``urls`` (id, url, cls, calibrates), ids distinct, with their score."""
    grams = cut_lineage(
        _positions(urls.select("url", "cls", "calibrates")).groupBy("ctx", "ch").agg(F.count(F.lit(1)).alias("n"), *[
            F.count(F.when((F.col("cls") == k) & ~F.col("calibrates"), 1)).alias(f"n_{k}") for k in ("allow", "block")]),
        "url-grams")
    counted = grams.where("n_allow + n_block > 0")
    ratios = cut_lineage(gram_ratios(grams, counted).join(grams.select("ctx", "ch", "n"), ["ctx", "ch"]), "url-ratios")
    least = (grams.agg(F.sum("n")).first()[0] or 0) / HOT_SHARE
    hot = ratios.where(F.col("n") > least).select("ctx", "ch", "ratio")  # under HOT_SHARE rows
    rare = ratios.where(F.col("n") <= least).select("ctx", "ch", "ratio")
    places = _positions(urls.select("id", "url"))
    told = places.join(F.broadcast(hot), ["ctx", "ch"]).select("id", "ratio").unionByName(
        places.join(F.broadcast(hot), ["ctx", "ch"], "left_anti").join(rare, ["ctx", "ch"]).select("id", "ratio"))
    scores = told.groupBy("id").agg(F.round(F.sum("ratio") / F.count(F.lit(1)), 9).alias("score"))
    scored = cut_lineage(urls.join(scores, "id"), "url-scores")
    drop_table(grams)
    drop_table(ratios)
    return scored


def calibrated_threshold(scored: DataFrame) -> float:
    """The bin edge with the best balanced accuracy on the calibration URLs, nearest to 0 of equals; 0 without both kinds."""
    known = scored.where(F.col("calibrates") & F.col("cls").isNotNull())
    bins = known.groupBy(F.floor(F.col("score") / BIN).alias("edge")).agg(
        F.count(F.when(F.col("cls") == "allow", 1)).alias("good"), F.count(F.when(F.col("cls") == "block", 1)).alias("bad"))
    lower = Window.orderBy("edge").rowsBetween(Window.unboundedPreceding, -1)  # a few thousand bins at most
    whole = Window.partitionBy()
    edges = bins.select("edge", F.sum("good").over(whole).alias("goods"), F.sum("bad").over(whole).alias("bads"),
                        F.coalesce(F.sum("good").over(lower), F.lit(0)).alias("lost"),
                        F.coalesce(F.sum("bad").over(lower), F.lit(0)).alias("caught"))
    both = F.col("caught") * F.col("goods") - F.col("lost") * F.col("bads")  # in whole numbers, no rounding
    best = edges.where("goods > 0 AND bads > 0").orderBy(both.desc(), F.abs("edge"), "edge").select("edge").head()
    return best[0] * BIN if best else 0.0


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, score."""
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
    host, path = host_and_path(F.col("url"))
    split = rows.select("url").distinct().select("url", host.alias("host"), path.alias("path"))
    ruled = split.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    digit = F.substring(F.md5(F.col("url").cast("binary")), 1, 1)
    urls = ruled.select(F.monotonically_increasing_id().alias("id"), "url", "host", "path", F.col("_rule.rule").alias("rule"),
                        F.col("_rule.verdict").alias("cls"), digit.isin(*CALIBRATION_DIGITS).alias("calibrates"))
    scored = score_urls(cut_lineage(urls, "urls"))
    threshold = calibrated_threshold(scored)
    judged = scored.select(
        "url", "host", "path", "rule", F.coalesce("cls", F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"),
        "score")
    return rows.join(judged, "url").select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def _orders_sql() -> str:
    """The chain of orders 0 to ORDER, each the previous one with its own counts mixed in."""
    steps = [f"p_start AS (SELECT ctx, ch, {EVEN_CHANCE!r}::DOUBLE AS p_allow, {EVEN_CHANCE!r}::DOUBLE AS p_block FROM grams)"]
    last = "p_start"
    for order in range(ORDER + 1):
        short = f"right(ctx, {order})" if order else "''"
        mixed = ", ".join(
            f"CASE WHEN x.all_{k} > 0 THEN (coalesce(o.n_{k}, 0) + x.kinds_{k} * p.p_{k}) / (x.all_{k} + x.kinds_{k})"
            f" ELSE p.p_{k} END AS p_{k}" for k in ("allow", "block"))
        steps.append(f"own{order} AS (SELECT {short} AS c, ch, sum(n_allow) AS n_allow, sum(n_block) AS n_block"
                     " FROM counted GROUP BY 1, 2)")
        steps.append(f"ctx{order} AS (SELECT c, sum(n_allow) AS all_allow, count(*) FILTER (WHERE n_allow > 0) AS kinds_allow,"
                     f" sum(n_block) AS all_block, count(*) FILTER (WHERE n_block > 0) AS kinds_block FROM own{order} GROUP BY c)")
        steps.append(f"p{order} AS (SELECT p.ctx, p.ch, {mixed} FROM {last} p LEFT JOIN ctx{order} x ON x.c = {short.replace('ctx', 'p.ctx')}"
                     f" LEFT JOIN own{order} o ON o.c = {short.replace('ctx', 'p.ctx')} AND o.ch = p.ch)")
        last = f"p{order}"
    return ",\n".join(steps)


def _rule_sql(column: int) -> str:
    longest_first = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    cases = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[column]}'"
        for h, p, v in longest_first)
    return f"CASE {cases} END"


def urls_sql() -> str:
    """The same rows in DuckDB."""
    return f"""
WITH named AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
split AS (
  SELECT DISTINCT url,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM named),
urls AS (
  SELECT url, host, path, {_rule_sql(0)} AS rule, {_rule_sql(1)} AS cls, substr(md5(url), 1, 1) IN {CALIBRATION_DIGITS!r} AS calibrates
  FROM split),
padded AS (SELECT *, repeat(chr(2), {ORDER}) || url || chr(3) AS txt FROM urls),
places AS (SELECT *, unnest(range(1, length(txt) - {ORDER} + 1)) AS pos FROM padded),
chars AS (SELECT url, cls, calibrates, substr(txt, pos, {ORDER}) AS ctx, substr(txt, pos + {ORDER}, 1) AS ch FROM places),
grams AS (
  SELECT ctx, ch, count(*) FILTER (WHERE cls = 'allow' AND NOT calibrates) AS n_allow,
         count(*) FILTER (WHERE cls = 'block' AND NOT calibrates) AS n_block
  FROM chars GROUP BY ctx, ch),
counted AS (SELECT * FROM grams WHERE n_allow + n_block > 0),
{_orders_sql()},
scores AS (
  SELECT c.url, round(sum(ln(p.p_allow) - ln(p.p_block)) / count(*), 9) AS score
  FROM chars c JOIN p{ORDER} p USING (ctx, ch) GROUP BY c.url),
scored AS (SELECT * FROM urls JOIN scores USING (url)),
bins AS (
  SELECT floor(score / {BIN}) AS edge, count(*) FILTER (WHERE cls = 'allow') AS good, count(*) FILTER (WHERE cls = 'block') AS bad
  FROM scored WHERE calibrates AND cls IS NOT NULL GROUP BY 1),
edges AS (
  SELECT edge, sum(good) OVER () AS goods, sum(bad) OVER () AS bads,
         coalesce(sum(good) OVER (ORDER BY edge ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lost,
         coalesce(sum(bad) OVER (ORDER BY edge ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caught
  FROM bins),
threshold AS (
  SELECT coalesce((SELECT edge * {BIN} FROM edges WHERE goods > 0 AND bads > 0
                   ORDER BY caught * goods - lost * bads DESC, abs(edge), edge LIMIT 1), 0.0) AS t)
SELECT s.page_id, c.host, c.path, c.rule,
       coalesce(c.cls, CASE WHEN c.score >= (SELECT t FROM threshold) THEN 'allow' ELSE 'block' END) AS verdict,
       round(c.score, 6) AS score
FROM named s JOIN scored c USING (url)
"""
