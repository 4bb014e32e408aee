"""URL filter: host and path rules, and beyond them the ratio of two character language models, in DataFrame operations only.

Urls that a rule decides are the labelled examples: one smoothed variable-order Markov model is counted over all accepted, one over all rejected
ones (each page counts).  A character's probability is interpolated from order 0 up to ``ORDER``: with n the count of context and
character, N of the context and T the number of different characters after it, p(k) = (n + T * p(k - 1)) / (N + T), from 1 / ``ALPHABET``; a context that a
model has not seen leaves p as it is.  The score of a url is the mean over its characters, start and end marked, of log p(accepted) - log p(rejected), in
whole millionths, so that sums don't depend on their order.

Calibration: one in ``HELD_OUT`` distinct labelled urls (by crc32) is kept out of the counts; the threshold is the score, on a grid of
``GRID`` millionths, at which the sum of both error rates on them is least (ties: the grid point nearest to 0, then the smaller).

Work grows with the distinct urls: equal urls are counted first; models are tables of contexts, joined by context and character.  Each character
window that a judged url holds is resolved once; the resolved windows are broadcast only up to ``BROADCAST_ROWS``.

Defined results: null urls and urls without ``://`` have an empty host and path, fit no rule and are judged as the empty text; rows without or with repeated
page_id each give a row; without any labelled url, or with those of one verdict only, the threshold is 0 and a score of 0 is allowed; an
empty table gives no rows.  Columns besides page_id and url are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import store

ORDER, ALPHABET, HELD_OUT, GRID, BROADCAST_ROWS = 4, 128, 5, 10_000, 500_000
# The rules of the registered query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
START, END = "\x02", "\x03"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where ``://`` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    found = [F.regexp_extract(rest, "^([^/?#]*+)([^?#]*+)", i) for i in (1, 2)]
    return F.translate(found[0], _UPPER, _LOWER), found[1]


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """Struct of rule and verdict of the longest fitting rule, null fields where none fits."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        rule_host, _, rule_path = rule.partition("/")
        fits = F.concat(F.lit("."), host).endswith("." + rule_host) & path.startswith("/" + rule_path)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _marked(host: Column, path: Column) -> Column:
    return F.concat(F.lit(START), host, path, F.lit(END))


def _windows(text: Column, order: int) -> Column:
    """Per character but the first: up to ``order`` characters before it, and itself."""
    return F.transform(F.sequence(F.lit(2), F.length(text)), lambda i: F.struct(text.substr(F.greatest(i - order, F.lit(1)), F.least(i - 1, F.lit(order))).alias("context"), text.substr(i, F.lit(1)).alias("char")))


def _suffixes(context: Column) -> Column:
    """The context and all its shorter ends, the empty one too."""
    n = F.length(context)
    return F.transform(F.sequence(F.lit(0), n), lambda k: context.substr(n - k + 1, k))


def count_models(labelled: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """labelled: text, accepted, rejected (numbers of pages).  Counts per context and character, and per context, of both models."""
    seen = labelled.select("accepted", "rejected", F.explode(_windows(F.col("text"), order)).alias("w"))
    seen = seen.groupBy("w.context", "w.char").agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r"))
    grams = seen.select(F.explode(_suffixes(F.col("context"))).alias("context"), "char", "a", "r").groupBy("context", "char").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    grams = store(grams, "url-grams")
    contexts = grams.groupBy("context").agg(F.sum("a").alias("na"), F.count_if(F.col("a") > 0).alias("ta"), F.sum("r").alias("nr"), F.count_if(F.col("r") > 0).alias("tr"))
    return grams, contexts


def ratios(windows: DataFrame, grams: DataFrame, contexts: DataFrame, order: int = ORDER) -> DataFrame:
    """context, char, ratio (millionths): log p(accepted) - log p(rejected) of distinct windows."""
    each = windows.select("context", "char", F.explode(_suffixes(F.col("context"))).alias("end"))
    counts, known = contexts.withColumnRenamed("context", "end"), grams.join(contexts, "context").withColumnRenamed("context", "end")
    met = each.join(known, ["end", "char"], "left")
    # only pairs that no model has seen ask for their context alone, so that the empty context is no hot key
    unseen = met.filter("na is null").select("context", "char", "end", "a", "r").join(counts, "end", "left")
    each = met.filter("na is not null").unionByName(unseen)
    names = ["a", "na", "ta", "r", "nr", "tr"]
    at = F.length("end")
    wide = each.groupBy("context", "char").agg(*[F.coalesce(F.sum(F.when(at == k, F.col(c))), F.lit(0)).cast("double").alias(f"{c}{k}") for k in range(order + 1) for c in names])

    def log_p(n: str, total: str, kinds: str) -> Column:
        p = F.lit(1.0 / ALPHABET)
        for k in range(order + 1):
            size = F.col(f"{total}{k}") + F.col(f"{kinds}{k}")
            p = F.when(size > 0, (F.col(f"{n}{k}") + F.col(f"{kinds}{k}") * p) / size).otherwise(p)
        return F.log(p)

    return wide.select("context", "char", F.round((log_p("a", "na", "ta") - log_p("r", "nr", "tr")) * 1e6).cast("long").alias("ratio"))


def scores(urls: DataFrame, ratio: DataFrame, broadcast: bool, order: int = ORDER) -> DataFrame:
    """urls: host, path.  Adds score: the mean ratio of a url's characters, in whole millionths."""
    each = urls.select("host", "path", F.explode(_windows(_marked(F.col("host"), F.col("path")), order)).alias("w")).select("host", "path", "w.*")
    met = each.join(F.broadcast(ratio) if broadcast else ratio, ["context", "char"])
    return met.groupBy("host", "path").agg(F.floor(F.sum("ratio").cast("double") / F.count("*")).alias("score"))


def threshold(held_out: DataFrame) -> int:
    """held_out: score, accepted, rejected.  Urls of at least this score are accepted."""
    bins = held_out.groupBy(F.floor(F.col("score").cast("double") / GRID).alias("bin")).agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r"))
    every = Window.orderBy("bin")  # a mean of logarithms of probabilities: some thousand bins, whatever the number of urls
    big = "decimal(19,0)"
    below, whole = every.rowsBetween(Window.unboundedPreceding, -1), every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lost = F.coalesce(F.sum("a").over(below), F.lit(0)).cast(big) * F.sum("r").over(whole).cast(big)
    kept = (F.sum("r").over(whole) - F.coalesce(F.sum("r").over(below), F.lit(0))).cast(big) * F.sum("a").over(whole).cast(big)
    tried = bins.select("bin", (lost + kept).alias("errors"), ((F.sum("a").over(whole) > 0) & (F.sum("r").over(whole) > 0)).alias("both"))
    best = tried.filter("both").agg(F.min(F.struct("errors", F.abs("bin").alias("off"), "bin")).alias("best")).first()["best"]
    return 0 if best is None else best["bin"] * GRID


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule, verdict of every page, and its score where the models judged."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("by", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "by.*")
    urls = store(rows.groupBy("host", "path", "rule", "verdict").agg(F.count("*").alias("n")), "urls")
    sides = [F.when(F.col("verdict") == v, F.col("n")).otherwise(0).alias(c) for v, c in (("allow", "accepted"), ("block", "rejected"))]
    held = F.crc32(F.concat("host", "path").cast("binary")) % HELD_OUT == 0
    labelled = urls.filter("verdict is not null")
    grams, contexts = count_models(labelled.filter(~held).select(_marked(F.col("host"), F.col("path")).alias("text"), *sides), order)
    asked = urls.filter(F.col("verdict").isNull() | held)
    windows = asked.select(F.explode(_windows(_marked(F.col("host"), F.col("path")), order)).alias("w")).select("w.*").distinct()
    ratio = store(ratios(windows, grams, contexts, order), "url-ratios")
    scored = store(asked.join(scores(asked, ratio, ratio.count() <= BROADCAST_ROWS, order), ["host", "path"]).select("host", "path", "verdict", "score", *sides), "url-scores")
    limit = threshold(scored.filter("verdict is not null"))
    judged = scored.filter("verdict is null").select("host", "path", "score")
    undecided = rows.filter("verdict is null").drop("verdict").join(judged, ["host", "path"]).withColumn("verdict", F.when(F.col("score") >= limit, "allow").otherwise("block"))
    ruled = rows.filter("verdict is not null").withColumn("score", F.lit(None).cast("long"))
    columns = ["page_id", "host", "path", "rule", "verdict", "score"]
    return ruled.select(*columns).unionAll(undecided.select(*columns))


def keep_allowed(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """The pages whose url is allowed, whole rows."""
    packed = pages.select(F.struct(*pages.columns).alias("page_id"), F.col("url"))
    return judge(packed, rules).filter("verdict = 'allow'").select("page_id.*")
