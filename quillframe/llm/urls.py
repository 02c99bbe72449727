"""URL filter: ratio of variable-order character Markov models, as DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import maybe_broadcast, saved, table

#: Verdict, host, path; a rule fits its host and all subdomains of it, where the path starts with the rule's.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
ORDER = 5
#: Symbols that the uniform model below all orders spreads over.
ALPHABET = 256
#: One URL form of so many is kept out of the counts and calibrates the threshold.
CALIBRATION_MOD = 5
#: Thresholds tried: so many for each nat a character, up to REACH nats either way.
STEPS, REACH = 64, 8
BROADCAST_ROWS = 500_000


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or where there is no ://."""
    host = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or where there is no ://."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule (host and path as one string) and verdict of the longest rule that fits; null where none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    first = lambda values: F.coalesce(*[F.when(fit, F.lit(v)) for fit, v in zip(fits, values)])
    return first([h + p for _, h, p in ordered]), first([v for v, _, _ in ordered])


def form_of(host: Column, path: Column) -> Column:
    """What the models read: host and path, each digit as 0."""
    return F.translate(F.concat(host, path), "123456789", "000000000")


def grams_of(form: Column) -> Column:
    """The ORDER-gram that ends at each character and at the end of the form."""
    padded = F.concat(F.lit("\x02" * (ORDER - 1)), form, F.lit("\x03"))
    return F.transform(F.sequence(F.lit(1), F.length(form) + 1), lambda i: F.substring(padded, i, F.lit(ORDER)))


def log_ratios(forms: DataFrame) -> DataFrame:
    """form, accepted, rejected (weights to learn from) to gram, ratio: nats by which rejection is likelier.

    Witten-Bell: an order's estimate gives its unseen mass to the next lower order; contexts that were never seen
    pass to it whole, so each gram is judged by its longest known context. Grams of all forms are in the result.
    """
    held = forms.select(F.explode(grams_of(F.col("form"))).alias("gram"), "accepted", "rejected")
    held = saved(held.groupBy("gram").agg(F.sum("accepted").alias("na"), F.sum("rejected").alias("nr")), "grams")
    lower = None
    for k in range(1, ORDER + 1):
        rows = held.groupBy(F.expr(f"right(gram, {k})").alias("g")).agg(F.sum("na").alias("na"), F.sum("nr").alias("nr"))
        context = Window.partitionBy(F.expr(f"left(g, {k - 1})"))
        rows = rows.select("g", F.expr(f"right(g, {k - 1})").alias("s"), *[f(x).alias(n) for c in "ar" for x, f, n in (
            (F.col(f"n{c}"), lambda x: x, f"n{c}"),
            (F.col(f"n{c}"), lambda x: F.sum(x).over(context), f"t{c}"),
            (F.when(F.col(f"n{c}") > 0, 1).otherwise(0), lambda x: F.sum(x).over(context), f"k{c}"),
        )])
        if lower is None:
            rows = rows.withColumns({"pa": F.lit(1 / ALPHABET), "pr": F.lit(1 / ALPHABET)})
        else:
            rows = rows.join(lower, "s")
        estimate = lambda c: F.when(F.col(f"t{c}") > 0, (F.col(f"n{c}") + F.col(f"k{c}") * F.col(f"p{c}")) / (F.col(f"t{c}") + F.col(f"k{c}"))).otherwise(F.col(f"p{c}"))
        lower = rows.select(F.col("g").alias("s"), estimate("a").alias("pa"), estimate("r").alias("pr"))
    return lower.select(F.col("s").alias("gram"), (F.log("pr") - F.log("pa")).alias("ratio"))


def scores(forms: DataFrame) -> DataFrame:
    """form, accepted, rejected to the same with score: the ratio of a form a character, models of its fold's complement.

    Forms whose crc32 mod CALIBRATION_MOD is 0 lend nothing to the counts.
    """
    learn = F.crc32("form") % CALIBRATION_MOD != 0
    taught = forms.select("form", *[F.when(learn, F.col(c)).otherwise(F.lit(0)).alias(c) for c in ("accepted", "rejected")])
    ratios = saved(log_ratios(taught), "ratios")
    held = forms.select("form", "accepted", "rejected", F.explode(grams_of(F.col("form"))).alias("gram"))
    found = held.join(maybe_broadcast(ratios, ratios.count(), BROADCAST_ROWS), "gram")
    return found.groupBy("form", "accepted", "rejected").agg(F.avg("ratio").alias("score"))


def threshold(scored: DataFrame) -> float:
    """Of the calibration forms, the score over which the share of rejected ones is furthest above that of accepted ones.

    Ties go to the score nearest to 0; 0 where the calibration lacks either kind.
    """
    step = F.greatest(F.lit(-REACH * STEPS), F.least(F.lit(REACH * STEPS), F.ceil(F.col("score") * STEPS))).cast("int")
    kept = scored.where(F.crc32("form") % CALIBRATION_MOD == 0)
    bins = kept.groupBy(step.alias("bin")).agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r")).collect()  # 2 * REACH * STEPS + 1 rows at most
    all_a, all_r = sum(b["a"] for b in bins), sum(b["r"] for b in bins)
    if not all_a or not all_r:
        return 0.0
    gain = lambda t: sum(b["r"] / all_r - b["a"] / all_a for b in bins if b["bin"] > t)
    return max(range(-REACH * STEPS, REACH * STEPS + 1), key=lambda t: (round(gain(t), 12), -abs(t))) / STEPS


def judged(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), score (of the models), for each row.

    Rules judge first; the URLs that they judge teach the models, which judge the rest: block where the score is over the calibrated threshold.
    Null URLs and those without :// have an empty host and path, no rule, and the models' verdict on the empty form.
    Without rules' verdicts of both kinds the models know nothing and allow. Repeated rows stay; other columns are not looked at.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = saved(rows.withColumns({"rule": rule, "by_rule": verdict, "form": form_of(F.col("host"), F.col("path"))}), "urls")
    count = lambda v: F.count(F.when(F.col("by_rule") == v, 1))
    forms = saved(rows.groupBy("form").agg(count("allow").alias("accepted"), count("block").alias("rejected")), "forms")
    scored = saved(scores(forms), "scores")
    limit = threshold(scored)
    named = scored.select("form", "score")
    out = rows.join(maybe_broadcast(named, named.count(), BROADCAST_ROWS), "form")
    own = F.when(F.col("score") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", own).alias("verdict"), "score")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each url. Null urls have empty host and path; repeated rows stay; an empty table gives none."""
    return judged(table(spark, sf_dir, "pages"))
