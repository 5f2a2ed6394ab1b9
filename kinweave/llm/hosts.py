"""URL filter by rules and by empirical-Bayes host reputation. DataFrame functions only.

Each page's labelled outcome (bad or not) counts for its host, the host's registered domain and that one's suffix.
Rates shrink through beta-binomial priors: the whole table's rate is the prior of a suffix, the suffix's posterior
mean that of a domain, the domain's that of a host. Each level's prior weight comes from the method of moments over
that level's groups. A host is blocked if the lower bound of its bad rate is above the threshold: the posterior mean
less some standard deviations of the posterior beta distribution, the normal approximation of its quantile.

Which page a label is about: the row of ``labels`` whose id equals the page's. The tables share these numbers and no
other key; pages without a label count for nothing but get their host's verdict.

Suffixes follow a rule, not the public list, which changes by the day: see ``domain_of``. A registry that the rule
doesn't know makes one domain of its members, whose hosts then share a prior but keep their own outcomes.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and is allowed (nothing
speaks against it); a host without labelled pages is judged by its domain's prior; pages without any label in the
table are all allowed; several labels of one page count as one, bad if any is; equal rules: the longest text wins and
no two of a table may have the same text; urls of any length are judged whole; an empty table gives an empty table.
Further columns, whatever their names, are kept out.

Only group counts are shuffled (pre-aggregated in each task); the host table goes back to the pages by a join that
Spark broadcasts if the table is small and whose skewed hosts it splits otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.shared import materialise

#: A rule's verdict and its host and path, in one text.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Reputation:
    #: Standard deviations of the posterior below its mean; least bad rate at that bound that blocks.
    deviations: float = 1.645
    threshold: float = 0.25
    #: Second labels below which names are registered where the last label is a country's (two letters): co.uk, gov.br.
    categories: tuple[str, ...] = (
        "ac", "asn", "asso", "co", "com", "ed", "edu", "gen", "go", "gob", "gouv", "gov", "govt", "id", "ind", "info", "k12", "lg",
        "ltd", "me", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "police", "sch", "school", "web",
    )
    #: Names below which a service gives its users names of their own.
    shared: tuple[str, ...] = (
        "appspot.com", "azurewebsites.net", "blogspot.com", "cloudfront.net", "firebaseapp.com", "fly.dev", "github.io", "gitlab.io",
        "herokuapp.com", "netlify.app", "onrender.com", "pages.dev", "r2.dev", "readthedocs.io", "substack.com", "tumblr.com", "vercel.app",
        "web.app", "weebly.com", "wixsite.com", "wordpress.com", "workers.dev",
    )


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters in lower case) and path."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule = verdict = None
    for what, text in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def name_of(host: Column) -> Column:
    """The host without user, port and a dot at its end."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")


def domain_of(host: Column, settings: Reputation) -> tuple[Column, Column]:
    """Registered domain and suffix.

    The suffix is the last label, or the last two if they are a category below a country or a shared name; the domain
    has one label more. An address (IPv4, or IPv6 in brackets) is its own domain, with the suffix ``ip``.
    """
    name = name_of(host)
    two = F.substring_index(name, ".", -2)
    of_country = (F.length(F.substring_index(name, ".", -1)) == 2) & F.substring_index(two, ".", 1).isin(*settings.categories) & name.contains(".")
    long = two.isin(*settings.shared) | of_country
    address = name.rlike(r"^[0-9]+(\.[0-9]+){3}$") | name.startswith("[")
    suffix = F.when(address, "ip").when(long, two).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(address, name).when(long, F.substring_index(name, ".", -3)).otherwise(two)
    return domain, suffix


def prior_weight(groups: DataFrame) -> float:
    """Pseudo-observations of the prior over ``groups`` (n, bad), by the method of moments; one row to the driver."""
    got = groups.filter("n > 0").agg(F.count("*"), F.sum("n"), F.sum("bad"), F.sum(F.col("bad") * F.col("bad") / F.col("n"))).first()
    number, n, bad, squares = (float(x or 0) for x in got)
    if number < 2 or bad <= 0 or bad >= n:
        return 10.0
    mean, size = bad / n, n / number
    spread = (squares / n - mean * mean) / (mean * (1 - mean))
    within = 1 / size
    rho = min(0.9, max(0.001, (spread - within) / (1 - within) if size > 1 else 0.001))
    return 1 / rho - 1


def judge(pages: DataFrame, labels: DataFrame, settings: Reputation = Reputation(), rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", bad: Column | None = None) -> DataFrame:
    """``id_col``, host, path, rule, verdict, and what the host's judgement rests on.

    ``bad``: whether a row of ``labels`` is a bad outcome; by default low quality or toxic.
    """
    if bad is None:
        bad = F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))
    outcome = labels.filter(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("_page")).agg(F.max(bad.cast("int")).alias("_bad"))
    host, path = split_url(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("_id"), host.alias("_host"), path.alias("_path"))
    domain, suffix = domain_of(F.col("host"), settings)
    seen = urls.join(outcome, F.col("_id") == F.col("_page"), "left")
    hosts = materialise(
        seen.groupBy(F.col("_host").alias("host")).agg(F.count("_bad").alias("n"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad")).withColumns({"domain": domain, "suffix": suffix}), "hosts"
    )
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    total, all_bad = (int(x or 0) for x in suffixes.agg(F.sum("n"), F.sum("bad")).first())
    rate = (all_bad + 0.5) / (total + 1.0)
    of_suffix, of_domain, of_host = (prior_weight(x) for x in (suffixes, domains, hosts))

    def shrunk(prior: Column, weight: float) -> Column:
        return (F.col("bad") + weight * prior) / (F.col("n") + weight)

    by_suffix = suffixes.select("suffix", shrunk(F.lit(rate), of_suffix).alias("suffix_rate"))
    by_domain = domains.join(by_suffix, "suffix").select("domain", "suffix", shrunk(F.col("suffix_rate"), of_domain).alias("domain_rate"))
    mean = shrunk(F.col("domain_rate"), of_host)
    bound = F.col("rate") - settings.deviations * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + of_host + 1))
    judged = hosts.join(by_domain, ["domain", "suffix"]).withColumn("rate", mean).select(F.col("host").alias("_judged"), F.col("n").alias("host_labels"), F.col("bad").alias("host_bad"), bound.alias("bound"))
    rule, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    blocked = (F.col("_host") != "") & F.coalesce(F.col("bound") > settings.threshold, F.lit(False)) & F.lit(total > 0)
    return urls.join(judged, F.col("_host") == F.col("_judged"), "left").select(
        F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), rule.alias("rule"), F.coalesce(verdict, F.when(blocked, "block").otherwise("allow")).alias("verdict"), "host_labels", "host_bad"
    )


def judge_sql(settings: Reputation = Reputation()) -> str:
    """DuckDB SQL for the rows of ``judge`` over the tables pages and labels."""
    clauses = sorted(RULES, key=lambda r: -len(r[1]))
    fits = []
    for _, text in clauses:
        name, slash, start = text.partition("/")
        fits.append(f"((host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{start}'))")
    rule = " ".join(f"WHEN {f} THEN '{t}'" for f, (_, t) in zip(fits, clauses, strict=True))
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _) in zip(fits, clauses, strict=True))
    listed = lambda values: ", ".join(f"'{x}'" for x in values)

    def last(n: int) -> str:
        return f"array_to_string(list_slice(string_split(name, '.'), -{n}, -1), '.')"

    address = "(regexp_matches(name, '^[0-9]+(\\.[0-9]+){3}$') OR starts_with(name, '['))"
    long = f"({last(2)} IN ({listed(settings.shared)}) OR (length({last(1)}) = 2 AND string_split({last(2)}, '.')[1] IN ({listed(settings.categories)}) AND contains(name, '.')))"

    def weight(table: str) -> str:
        return f"""(SELECT CASE WHEN g < 2 OR b <= 0 OR b >= n THEN 10.0 ELSE 1 / least(0.9, greatest(0.001, CASE WHEN n / g > 1 THEN ((q / n - (b / n) * (b / n)) / ((b / n) * (1 - b / n)) - g / n) / (1 - g / n) ELSE 0.001 END)) - 1 END
            FROM (SELECT count(*)::DOUBLE g, coalesce(sum(n), 0)::DOUBLE n, coalesce(sum(bad), 0)::DOUBLE b, coalesce(sum(bad::DOUBLE * bad / n), 0) q FROM {table} WHERE n > 0))"""

    return f"""
WITH outcome AS (SELECT doc_id, max(CASE WHEN coalesce(toxic = 1, false) OR coalesce(quality = 0, false) THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
rests AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
urls AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
counted AS (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), '\\.?(:[0-9]*)?$', '') AS name, count(o.bad) AS n, coalesce(sum(o.bad), 0) AS bad FROM urls LEFT JOIN outcome o ON o.doc_id = page_id GROUP BY host),
hosts AS (SELECT host, n, bad, CASE WHEN {address} THEN name WHEN {long} THEN {last(3)} ELSE {last(2)} END AS domain, CASE WHEN {address} THEN 'ip' WHEN {long} THEN {last(2)} ELSE {last(1)} END AS suffix FROM counted),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
scalars AS (SELECT (SELECT (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1.0::DOUBLE) FROM suffixes) AS rate, (SELECT sum(n) FROM suffixes) AS total, {weight("suffixes")} AS ws, {weight("domains")} AS wd, {weight("hosts")} AS wh),
judged AS (SELECT h.host, h.n, h.bad, (h.bad + wh * ((d.bad + wd * ((s.bad + ws * rate) / (s.n + ws))) / (d.n + wd))) / (h.n + wh) AS rate, wh, total
    FROM hosts h JOIN domains d USING (domain, suffix) JOIN suffixes s USING (suffix), scalars),
final AS (SELECT page_id, u.host, path, j.n, j.bad, j.host <> '' AND total > 0 AND j.rate - {settings.deviations} * sqrt(j.rate * (1 - j.rate) / (j.n + wh + 1)) > {settings.threshold} AS blocked FROM urls u JOIN judged j USING (host))
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN blocked THEN 'block' ELSE 'allow' END AS verdict, n::BIGINT AS host_labels, bad::BIGINT AS host_bad FROM final"""
