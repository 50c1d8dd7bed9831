"""URL filter: host and path rules, and a character language-model ratio for URLs no rule fits.

Two variable-order Markov models are learned from the URLs that rules accept and reject. With
Witten-Bell smoothing, the probability of a character behind k others blends its count with the
probability behind k - 1 of them, weighted by how many different characters have followed:

    P(c | s) = (n(sc) + t(s) P(c | s')) / (n(s) + t(s)),        P(c) blends with 1 / ALPHABET

An URL's score is the mean of ln P_rejected - ln P_accepted over its characters and its end, in whole
millionths, so sums are exact in any order. The cut is calibrated on ruled URLs kept out of the
counts (by md5): it is where the share of rejected URLs at or above it exceeds that of accepted ones
most. Everything is DataFrame operations: windows of ORDER + 1 characters are counted once, shorter
contexts are sums over them, and URLs meet the scored windows by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.llm.common import materialise

ORDER = 3
ALPHABET = 128
CALIBRATION = ("d", "e", "f")
"""First hexadecimal digits of the md5 of URLs that calibrate the cut instead of being counted."""

# Fixed values: (host, path, verdict) of the rules.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"://([^/?#]*)([^?#]*)"
START, END = "\u0002", "\u0003"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 2)


def _chosen(host: Column, path: Column, rules: tuple, what: int | None) -> Column:
    """The longest fitting rule, or its verdict."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule[0]) | host.endswith("." + rule[0])) & path.startswith(rule[1])
        found = F.when(fits, rule[0] + rule[1] if what is None else rule[what]).otherwise(found)
    return found


def ruled(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """(page_id, url, host, path, rule, ruling): NULL URLs become empty."""
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
    rows = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    host, path = F.col("host"), F.col("path")
    return rows.select(
        "*", _chosen(host, path, rules, None).alias("rule"), _chosen(host, path, rules, 2).alias("ruling")
    )


def _windows(urls: DataFrame) -> DataFrame:
    """A row per character of an URL and its end: the ORDER characters before it and itself."""
    text = F.concat(F.lit(START * ORDER), F.translate("url", _UPPER, _LOWER), F.lit(END))
    rows = urls.select("id", "counted", "ruling", text.alias("text"))
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(1), F.length("text") - ORDER)))
    return rows.select("id", "counted", "ruling", F.substring("text", F.col("at"), F.lit(ORDER + 1)).alias("gram"))


def _log_ratios(grams: DataFrame) -> DataFrame:
    """(gram, micro): ln P_rejected - ln P_accepted of a gram's last character, in whole millionths."""
    shorter = None
    for k in range(ORDER + 1):
        level = grams.groupBy(F.right("gram", F.lit(k + 1)).alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        context = Window.partitionBy(F.substring("gram", 1, k)) if k else Window.partitionBy(F.lit(0))
        sums = [(F.sum(c).over(context), F.sum((F.col(c) > 0).cast("long")).over(context)) for c in ("a", "r")]
        level = level.select(
            "gram", "a", "r", *(e.alias(f"{n}_{c}") for c, pair in zip("ar", sums, strict=True) for n, e in zip("nt", pair, strict=True))
        )
        if shorter is None:
            level = level.select("*", F.lit(1.0 / ALPHABET).alias("below_a"), F.lit(1.0 / ALPHABET).alias("below_r"))
        else:
            below = shorter.select(F.col("gram").alias("suffix"), F.col("p_a").alias("below_a"), F.col("p_r").alias("below_r"))
            level = level.withColumn("suffix", F.right("gram", F.lit(k))).join(below, "suffix")
        smooth = {
            c: F.when(F.col(f"n_{c}") == 0, F.col(f"below_{c}")).otherwise(
                (F.col(c) + F.col(f"t_{c}") * F.col(f"below_{c}")) / (F.col(f"n_{c}") + F.col(f"t_{c}"))
            )
            for c in "ar"
        }
        shorter = level.select("gram", smooth["a"].alias("p_a"), smooth["r"].alias("p_r"))
    micro = F.round(1_000_000 * (F.log("p_r") - F.log("p_a"))).cast("long")
    return shorter.select("gram", micro.alias("micro"))


def _cut(scored: DataFrame) -> DataFrame:
    """One row: the score from which on URLs are blocked; NULL without calibration URLs of both kinds."""
    kinds = [F.sum((F.col("ruling") == kind).cast("long")) for kind in ("allow", "block")]
    steps = scored.filter("NOT counted AND ruling IS NOT NULL").groupBy(F.expr("floor(micro / 1000)").alias("step"))
    steps = steps.agg(kinds[0].alias("allow"), kinds[1].alias("block"))
    # one row per thousandth of a score: their number is bounded by the scores' range
    from_here = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    all_rows = Window.partitionBy(F.lit(0))
    share = {k: F.sum(k).over(from_here) / F.sum(k).over(all_rows) for k in ("allow", "block")}
    gain = steps.select("step", (share["block"] - share["allow"]).alias("gain"))
    best = gain.filter("gain IS NOT NULL").agg(F.max(F.struct("gain", "step")).alias("best"))
    return best.select((F.col("best.step") * 1000).alias("cut"))


def judge(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """One row per row of `pages`: (page_id, host, path, rule, verdict, score).

    Host: behind the first `://` up to `/`, `?`, `#` or the end, A to Z in lower case; path: from
    there up to `?`, `#` or the end; both empty without `://`. A rule fits its host and all
    subdomains if the path starts with the rule's; the longest decides. Other URLs are blocked if
    their score reaches the cut. Without ruled URLs of both kinds on both sides of the md5 split there
    is no cut, and they are allowed. NULL URLs count as empty ones. Repeated rows and NULL ids are
    rows as any other; an URL counts once, however many pages have it. Other columns are ignored.
    """
    rows = ruled(pages, rules)
    kept_out = F.substring(F.md5(F.col("url").cast("binary")), 1, 1).isin(*CALIBRATION)
    urls = rows.groupBy("url").agg(F.first("ruling").alias("ruling"))  # equal for equal URLs
    urls = urls.select(F.monotonically_increasing_id().alias("id"), "url", "ruling", (~kept_out).alias("counted"))
    urls = materialise(urls, "urls")  # ids are drawn once
    windows = _windows(urls)
    seen = {c: F.sum((F.col("counted") & (F.col("ruling") == kind)).cast("long")) for c, kind in (("a", "allow"), ("r", "block"))}
    grams = windows.groupBy("gram").agg(F.coalesce(seen["a"], F.lit(0)).alias("a"), F.coalesce(seen["r"], F.lit(0)).alias("r"))
    ratios = _log_ratios(materialise(grams, "url_grams"))
    means = windows.select("id", "gram").join(ratios, "gram").groupBy("id")
    means = means.agg(F.floor(F.sum("micro") / F.count("*")).alias("micro"))
    scored = materialise(urls.join(means, "id").select("url", "ruling", "counted", "micro"), "scored_urls")
    cut = _cut(scored)
    both = scored.filter("counted").agg(F.count_distinct("ruling").alias("kinds"))
    verdict = F.when((both.scalar() == 2) & (F.col("micro") >= cut.scalar()), "block").otherwise("allow")
    judged = scored.select(F.col("url"), "micro", verdict.alias("by_model"))
    return rows.join(judged, "url").select(
        "page_id", "host", "path", "rule", F.coalesce("ruling", "by_model").alias("verdict"),
        (F.col("micro") / 1_000_000).alias("score"),
    )
