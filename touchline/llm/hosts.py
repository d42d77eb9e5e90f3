"""URL filter: empirical-Bayes host reputation below a list of rules.

Page outcomes (bad or not) are counted by host. Each host's bad rate has a beta
prior around its registered domain's posterior mean, each domain's around its
suffix's, each suffix's around the global rate; how strongly each level shrinks is
estimated from the beta-binomial spread of its members (method of moments). A host
is blocked if the lower posterior bound of its bad rate exceeds the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import stage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Suffixes of two labels under which names are registered.
LONG_SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp",
                 "or.jp", "co.kr", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "co.in", "co.za")

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    found = F.coalesce(F.regexp_extract(url, _URL, 1), F.lit(""))
    return F.translate(found, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    two, three = F.substring_index(name, ".", -2), F.substring_index(name, ".", -3)
    long = two.isin(*LONG_SUFFIXES)
    return F.when(long, two).otherwise(F.substring_index(name, ".", -1)), F.when(long, three).otherwise(two)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest of `rules` (verdict, host, path) that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0])):  # the longest comes last
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def page_outcome(html: Column, least_words: int = 20, symbol_share: float = 0.1) -> Column:
    """Weak label of a page from its own visible text: 1 (bad) if more than `symbol_share` symbols a word,
    0 if not, null (no label) under `least_words` words."""
    seen = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    seen = F.trim(F.regexp_replace(F.regexp_replace(seen, r"&[A-Za-z]+;", "&"), r"\s+", " "))
    words = F.length(seen) - F.length(F.translate(seen, " ", "")) + 1
    symbols = F.length(seen) - F.length(F.translate(seen, "#*$%&|<>!", ""))
    return F.when(words >= least_words, (symbols > symbol_share * words).cast("int"))


def _spread(level: DataFrame, mean: str) -> float:
    """Prior strength (alpha + beta) of a level: from the excess of its members' squared deviations over the binomial's."""
    q = F.col(mean) * (1 - F.col(mean))
    r = level.agg(F.sum((F.col("bad") - F.col("n") * F.col(mean)) ** 2 - F.col("n") * q).alias("excess"),
                  F.sum(F.col("n") * (F.col("n") - 1) * q).alias("scale")).first()
    rho = (r["excess"] / r["scale"]) if r["scale"] else 0.0
    rho = min(max(rho, 1e-4), 0.99)
    return 1 / rho - 1


def reputation(outcomes: DataFrame, limit: float = 0.5, z: float = 1.645) -> DataFrame:
    """(host, mean, bound, verdict) of every host of `outcomes(host, bad)`; bad is 1, 0 or null (unlabelled).

    bound: mean - z standard deviations of the host's beta posterior; block if over `limit`."""
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = stage(outcomes.groupBy("host").agg(F.sum("bad").alias("bad"), F.count("bad").alias("n"))
                  .select("host", suffix.alias("suffix"), domain.alias("domain"),
                          F.coalesce("bad", F.lit(0)).cast("double").alias("bad"),
                          F.col("n").cast("double").alias("n")), "hosts")
    total = hosts.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).first()
    rate = (total["bad"] + 0.5) / (total["n"] + 1.0) if total["n"] else 0.5
    parents = None
    for key, above in (("suffix", None), ("domain", "suffix"), ("host", "domain")):
        keys = [key] if above is None else [key, above]
        level = hosts.groupBy(*keys).agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
        if parents is None:
            level = level.withColumn("prior", F.lit(rate))
        else:
            level = level.join(parents.select(F.col(above), F.col("mean").alias("prior")), above)
        level = stage(level, f"reputation-{key}")
        strength = _spread(level, "prior")
        a = F.col("bad") + strength * F.col("prior")
        b = F.col("n") - F.col("bad") + strength * (1 - F.col("prior"))
        parents = level.select(*keys, a.alias("a"), b.alias("b"), (a / (a + b)).alias("mean"))
    sd = F.sqrt(F.col("a") * F.col("b") / ((F.col("a") + F.col("b")) ** 2 * (F.col("a") + F.col("b") + 1)))
    bound = F.col("mean") - z * sd
    return parents.select("host", "mean", bound.alias("bound"),
                          F.when(bound > limit, "block").otherwise("allow").alias("verdict"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], limit: float = 0.5, z: float = 1.645) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate, bound) per row of `pages(page_id, url, html, ...)`.

    A null url, or one without `://`, has an empty host and path, and counts as a host of its own.
    Null html gives no outcome. Repeated rows stay repeated; an empty table gives none."""
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    known = reputation(own.select("host", page_outcome(F.col("html")).alias("bad")), limit, z)
    out = own.drop("html").join(known.withColumnRenamed("verdict", "standing"), "host")
    found = rule_of(F.col("host"), F.col("path"), rules)
    return out.select("page_id", "host", "path", found["rule"].alias("rule"),
                      F.coalesce(found["verdict"], F.col("standing")).alias("verdict"),
                      F.col("mean").alias("bad_rate"), "bound")
