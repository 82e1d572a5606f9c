"""URL filter: rules first, then the reputation of the host.

Labelled outcomes of pages are counted per host. Three beta-binomial priors shrink them: a host towards its registered
domain, a domain towards its suffix, a suffix towards all pages. Each prior's strength comes from the spread of the
children around their parent, by moments. A page is allowed if the lower bound of its host's posterior good rate
reaches a threshold.

Cases: a null url or one without ``://`` has an empty host and path, and is judged as host ''; outcomes that are null
count for nothing; pages and outcomes that repeat count each time; without outcomes every rate is one half and wide, so
the bound fails any threshold of one half; an empty table gives no rows; of equally long rules the first in order of
strings wins; columns not in ``keep`` are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import staged

# Second-level names under which a country's registry sells domains.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for a null url or one without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.expr(f"substr({url}, instr({url}, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def rule_for(host: str, path: str, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits. Rules are (verdict, 'host/path')."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, slash, rest = text.partition("/")
        fits = ((F.col(host) == name) | F.col(host).endswith("." + name)) & F.col(path).startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def domain_and_suffix(host: str) -> tuple[Column, Column]:
    """Registered domain and suffix by the labels' form; an address or a single label is its own domain and suffix."""
    name = F.regexp_replace(F.regexp_replace(host, r"\A.*@", ""), r":[0-9]*\z", "")
    labels = F.split(name, r"\.")
    n = F.size(labels)
    plain = name.rlike(r"\A[0-9.]+\z") | (n < 2)
    second = (n > 2) & (F.length(F.element_at(labels, -1)) == 2) & F.element_at(labels, -2).isin(*SECOND_LEVEL)
    wide = F.when(second, 2).otherwise(1)
    tail = lambda k: F.array_join(F.slice(labels, n - k + 1, k), ".")
    return F.when(plain, name).otherwise(tail(wide + 1)), F.when(plain, name).otherwise(tail(wide))


def _strength(children: DataFrame) -> float:
    """A prior's strength from how far children's counts stray from their parent's mean; between 1 and 1000."""
    m = F.col("mean")
    spare = F.pow(F.col("good") - F.col("n") * m, 2) - F.col("n") * m * (1 - m)
    row = children.agg(F.sum(spare).alias("x"), F.sum(F.col("n") * (F.col("n") - 1) * m * (1 - m)).alias("y")).first()
    rho = row["x"] / row["y"] if row["y"] else 0.0
    rho = min(0.5, max(1 / 1001, rho))
    return 1 / rho - 1


def reputations(pages: DataFrame, outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """host, n, good, mean and bound for the host of every page. pages: host; outcomes: host, good (1, 0 or null).

    Counts are summed before they are joined, so that a host with a third of all pages is one row here.
    """
    seen = pages.select("host", F.lit(None).cast("int").alias("good"))
    rows = seen.unionByName(outcomes.select("host", F.col("good").cast("int").alias("good")))
    hosts = rows.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    domain, suffix = domain_and_suffix("host")
    hosts = staged(hosts.withColumns({"domain": domain, "suffix": suffix}))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    base = ((total["good"] or 0) + 1) / ((total["n"] or 0) + 2)

    def shrunk(children: DataFrame) -> DataFrame:
        s = _strength(children)
        mean = (F.lit(s) * F.col("mean") + F.col("good")) / (F.lit(s) + F.col("n"))
        return children.withColumns({"mean": mean, "held": F.lit(s) + F.col("n")})

    suffixes = staged(shrunk(suffixes.withColumn("mean", F.lit(base)))).select("suffix", "mean")
    domains = staged(shrunk(domains.join(suffixes, "suffix"))).select("domain", "suffix", "mean")
    hosts = shrunk(hosts.join(domains, ["domain", "suffix"]))
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("held") + 1))
    return hosts.select("host", "n", "good", "mean", (F.col("mean") - z * spread).alias("bound"))


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[tuple[str, str]],
    url: str = "url",
    keep: tuple[str, ...] = ("page_id",),
    threshold: float = 0.5,
    z: float = 1.645,
) -> DataFrame:
    """``keep`` beside host, path, rule, verdict and bound of every page. outcomes: url, good (1, 0 or null)."""
    host, path = host_and_path(url)
    source = pages.select(*dict.fromkeys([*keep, url])).withColumns({"host": host, "path": path})
    known_host, _ = host_and_path("url")
    known = reputations(source, outcomes.select(known_host.alias("host"), "good"), z)
    rule, verdict = rule_for("host", "path", rules)
    own = F.when(F.col("bound") >= threshold, "allow").otherwise("block")
    return source.join(known.select("host", "bound"), "host").select(
        *keep, "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bound"
    )
