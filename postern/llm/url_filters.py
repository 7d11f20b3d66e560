"""URL filters by empirical-Bayes host reputation.

Labelled page outcomes are shrunk level by level: the corpus rate is the prior of a suffix, the suffix's
posterior the prior of a registered domain, the domain's that of a host. What a level passes down leaves out the
outcomes of the child it goes to (a host's prior knows the other hosts of its domain, the other domains of its suffix and the
other suffixes), so every outcome weighs on a host once. The strength of each level's beta prior is fitted by the
method of moments on how siblings differ. ``n`` outcomes of one child tell its siblings no more than
``n * (k + 1) / (k + n)`` independent ones would, ``k`` being that strength, so a hot host does not speak for its domain. A page is blocked when its host's posterior leaves a rate of
bad pages up to ``THRESHOLD`` a probability below ``DOUBT``: the exact beta quantile at ``DOUBT`` is the lower
bound of the posterior. Explicit rules come first.

Hosts: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Without user and
port, the suffix is the last label, or the last two if they are in ``SUFFIXES`` (a parameter; any public list can
be given); the registered domain is the suffix and one label more; a numeric address is its own domain.

Defined cases: null urls and urls without ``://`` have an empty host and path, fit no rule and get the
verdict of the host ``""``; null outcomes are not counted; null and repeated page ids are rows of their own, but
the outcome of a page counts once for a host, however often the page is repeated, and is bad if any of its outcome rows is; extra
columns are ignored; an empty table gives no rows; without any label every page is allowed unless a
rule blocks it. Counts combine before the shuffle, so a host with a third of all pages costs one row
per task; reputations join back by broadcast, or, beyond ``BROADCAST_ROWS`` hosts, by broadcast for the hosts
with more than one in ``BROADCAST_ROWS`` pages and by shuffle for the others.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._rank import BROADCAST_ROWS
from ._store import written

#: (host and path prefix, verdict); a rule fits its host and all subdomains.
RULES: tuple[tuple[str, str], ...] = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)
THRESHOLD = 0.5
DOUBT = 0.05
#: A prior weighs at least as much as so many outcomes, so that a single page never decides about a host.
LEAST_STRENGTH = 2.0
#: Common public suffixes of two labels.
SUFFIXES: tuple[str, ...] = tuple(
    "ac.jp ac.uk co.id co.il co.in co.jp co.kr co.nz co.th co.uk co.za com.ar com.au com.br com.cn com.hk com.mx com.my"
    " com.pl com.sg com.tr com.tw com.ua com.vn edu.au gov.au gov.uk ne.jp net.au or.jp org.au org.uk".split()
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, _, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def domain_and_suffix(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """The registered domain of a host and its public suffix."""
    name = F.regexp_extract(host, "([^@:]*)(:[0-9]*)?$", 1)
    two = F.substring_index(name, ".", -2)
    long = two.isin(*suffixes) if suffixes else F.lit(False)
    numeric = name.rlike(r"^[0-9.]+$")
    domain = F.when(numeric, name).when(long, F.substring_index(name, ".", -3)).otherwise(two)
    suffix = F.when(numeric, F.lit("")).when(long, two).otherwise(F.substring_index(name, ".", -1))
    return domain, suffix


def beta_cdf(x: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """P(rate <= x) under beta(a, b), by the continued fraction of the incomplete beta function (Lentz)."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    if not 0 < x < 1:
        return np.full(a.shape, float(x >= 1))
    # The fraction converges fast left of the mean; right of it the mirrored one does.
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    lgamma = np.frompyfunc(math.lgamma, 1, 1)
    norm = (lgamma(p + q) - lgamma(p) - lgamma(q)).astype(float)
    front = np.exp(p * np.log(y) + q * np.log1p(-y) + norm) / p
    tiny = 1e-300
    d = 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    c, total = np.ones_like(p), d.copy()
    for m in range(1, 100_000):
        step = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        for k in (step, -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + k * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + k / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            total *= c * d
        if not np.any(np.abs(c * d - 1) > 1e-12):
            break
    return np.where(swap, 1 - front * total, front * total)


def _below(threshold: float):  # noqa: ANN202
    @F.pandas_udf("double")
    def below(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(beta_cdf(threshold, a.to_numpy(), b.to_numpy()))

    return below


def _moments(level: DataFrame) -> DataFrame:
    """One row: how ``bad`` of ``n`` scatters around the rate of the siblings (the parent's ``up_bad`` of ``up_n`` without
    the child's own) and what binomial noise alone would give. A child without labelled siblings tells nothing."""
    p, q, n = F.col("bad") / F.col("n"), (F.col("up_bad") - F.col("bad") + 0.5) / (F.col("up_n") - F.col("n") + 1.0), F.col("n")
    return level.where("n > 0 AND up_n > n").agg(
        F.sum(n * (p - q) * (p - q)).alias("spread"), F.sum(q * (1 - q)).alias("noise"), F.sum((n - 1) * q * (1 - q)).alias("room")
    )


def _told(strength: float, bad: str, n: str) -> list[Column]:
    """What a child's outcomes are worth to its parent."""
    worth = F.lit(strength + 1) / (F.lit(strength) + F.col(n))
    return [(F.col(bad) * worth).alias("t_bad"), (F.col(n) * worth).alias("t_n")]


def _strength(moments) -> float:  # noqa: ANN001  a row
    """How many outcomes a level's prior weighs."""
    if not moments.room:
        return LEAST_STRENGTH
    rho = min(0.999, max(0.001, (moments.spread - moments.noise) / moments.room))
    return max(LEAST_STRENGTH, 1 / rho - 1)


def reputation(
    hosts: DataFrame, suffixes: Sequence[str] = SUFFIXES, threshold: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """``host, bad, n`` (one row per host: bad outcomes of all outcomes) -> the same rows, without other columns, with
    ``a, b`` of the posterior, its ``mean``, and ``below``: the probability of a rate up to ``threshold``."""

    def looked_up(rows: DataFrame, up: DataFrame, key: str) -> DataFrame:
        small = up.limit(broadcast_rows + 1).count() <= broadcast_rows
        return rows.join(F.broadcast(up) if small else up, key)

    def summed(rows: DataFrame, *keys: str) -> DataFrame:
        bad, n = rows.columns[-2:]
        return rows.groupBy(*keys).agg(F.sum(bad).alias("up_bad"), F.sum(n).alias("up_n"))

    domain, suffix = domain_and_suffix(F.col("host"), suffixes)
    rows = hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "bad", "n")
    by_domain = written(summed(rows, "domain", "suffix"), "url-domains")
    by_suffix = summed(by_domain, "suffix")
    total = by_suffix.agg(F.sum("up_bad"), F.sum("up_n")).first()
    domains = by_domain.toDF("domain", "suffix", "bad", "n")
    levels = (
        looked_up(rows, by_domain.drop("suffix"), "domain"),
        looked_up(domains, by_suffix, "suffix"),
        by_suffix.toDF("suffix", "bad", "n").withColumns({"up_bad": F.lit(total[0]), "up_n": F.lit(total[1])}),
    )
    of_host, of_domain, of_suffix = (_strength(_moments(level).first()) for level in levels)  # three sums each

    # Upwards: what children tell their parents (t_: told by, d_, s_: known to).
    rows = rows.select("*", *_told(of_host, "bad", "n"))
    domains = summed(rows, "domain", "suffix").toDF("domain", "suffix", "d_bad", "d_n")
    domains = written(domains.select("*", *_told(of_domain, "d_bad", "d_n")), "url-domains-told")
    tops = summed(domains, "suffix").toDF("suffix", "s_bad", "s_n")
    tops = written(tops.select("*", *_told(of_suffix, "s_bad", "s_n")), "url-suffixes-told")
    all_bad, all_n = (x or 0.0 for x in tops.agg(F.sum("t_bad"), F.sum("t_n")).first())

    # Downwards: what is known from the others. A prior never weighs more than what it comes from, so little evidence
    # above stays little below.
    def prior(bad: Column, n: Column, strength: float) -> list[Column]:
        return [(bad / n).alias("p"), F.least(F.lit(strength), n).alias("w")]

    def others(known: str) -> tuple[Column, Column]:
        bad, n = (F.greatest(F.col(f"{known}_{x}") - F.col(f"t_{x}"), F.lit(0.0)) for x in ("bad", "n"))
        return F.col("p") * F.col("w") + bad, F.col("w") + n

    bad, n = (F.greatest(F.lit(t) - F.col(c), F.lit(0.0)) for t, c in ((all_bad, "t_bad"), (all_n, "t_n")))
    tops = tops.select("suffix", "s_bad", "s_n", *prior(bad + 0.5, n + 1.0, of_suffix))
    domains = looked_up(domains, tops, "suffix").select("domain", "d_bad", "d_n", *prior(*others("s"), of_domain))
    rows = looked_up(rows, domains, "domain").select("host", "bad", "n", *prior(*others("d"), of_host))
    a = F.col("p") * F.col("w") + F.col("bad")
    b = (1 - F.col("p")) * F.col("w") + F.col("n") - F.col("bad")
    rows = rows.select("host", "bad", "n", a.alias("a"), b.alias("b"))
    return rows.select("*", (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"), _below(threshold)("a", "b").alias("below"))


def judged(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    threshold: float = THRESHOLD,
    suffixes: Sequence[str] = SUFFIXES,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, bad_mean, bad_below``.

    ``outcomes``: ``page_id, bad`` (0/1) of the labelled pages."""
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    labelled = outcomes.where("bad IS NOT NULL AND page_id IS NOT NULL").groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    seen = rows.select("page_id", "host").join(labelled, "page_id").distinct()
    zero = F.lit(0).cast("long")
    counts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).select("host", "pages", zero.alias("bad"), zero.alias("n"))
    counts = counts.union(seen.groupBy("host").agg(zero, F.sum("bad"), F.count("bad")))
    hosts = written(counts.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("pages", "bad", "n")]), "url-hosts")
    trust = reputation(hosts, suffixes, threshold, broadcast_rows).select("host", "mean", "below")
    trust = written(trust, "url-reputation")
    if hosts.limit(broadcast_rows + 1).count() <= broadcast_rows:
        rows = rows.join(F.broadcast(trust), "host", "left")
    else:
        n_pages = hosts.agg(F.sum("pages")).first()[0]
        hot = hosts.where(F.col("pages") * broadcast_rows > n_pages).select("host")  # fewer than broadcast_rows
        frequent = rows.join(F.broadcast(trust.join(F.broadcast(hot), "host", "left_semi")), "host")
        rows = frequent.unionByName(rows.join(F.broadcast(hot), "host", "left_anti").join(trust, "host"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("below") < DOUBT, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(says, own).alias("verdict"),
        F.col("mean").alias("bad_mean"),
        F.col("below").alias("bad_below"),
    )
