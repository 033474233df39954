"""URL filters: empirical-Bayes reputation of hosts.

Labelled page outcomes (bad or not) are counted per host, registered domain
and suffix. Each level is a beta-binomial whose prior has the mean of the
level above and a strength found by the method of moments from all groups of
the level: a host with few labelled pages is drawn to its domain, a domain to
its suffix, a suffix to the whole. A page is blocked when the lower bound of
its host's posterior share of bad pages exceeds a limit. Rules on host and
path come first; the longest that fits decides.

The suffix is the longest of ``SUFFIXES`` that a host ends in, else its last
label, and the registered domain is one label more; ports do not count, and an
IP address is its own domain and suffix.

Scale: all counts are partial aggregates; pages meet their host's row by a
join that Spark may split on a hot host. The moments are three sums a level.

Defined cases: a null url, or one without ``://``, has empty host and path and
takes part in the whole's prior only; unlabelled hosts have their prior's
mean and spread; with no labels at all nothing is blocked by reputation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

#: (rule, verdict): hosts with all subdomains, and the beginning of the path.
RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]
#: Blocked when mean - Z * deviation of the posterior is over LIMIT.
Z, LIMIT = 1.64, 0.3
#: Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0
#: Public suffixes of several labels: those in common use, not the whole public list.
_SECOND = {
    "ac co ed fi go or sa": "cr",
    "co org me ltd plc net sch ac gov nhs police": "uk", "com net org edu gov asn id": "au", "co net org ac govt school geek gen iwi maori mil cri health": "nz",
    "co org net ac gov web law nom school": "za", "co or ne ac ad ed go gr lg": "jp", "co or ne re pe go mil ac hs ms es sc kg": "kr",
    "co net org firm gen ind ac edu res gov nic mil": "in", "com net org gov edu ac mil": "cn", "com net org edu gov idv": "tw hk", "com net org edu gov": "sg lb mt cy sv gt ni do",
    "com net org edu gov mil name": "my", "co in ac go or net mi": "th", "co or ac go web sch net mil my biz desa": "id", "com net org gov edu ngo mil": "ph",
    "com net org edu gov ac biz info name pro health": "vn", "com net org gov edu mil art blog eco ind inf adv eng etc": "br", "com net org gob gov edu int mil tur": "ar",
    "com net org gob edu": "mx", "com net org edu gov mil nom": "co", "com net org gob edu mil nom": "pe", "com co net org gob edu info web": "ve", "com net org edu gub mil": "uy",
    "com net org edu gob gov mil": "ec bo", "com net org gov edu bel pol av dr web gen info biz name tel tv k12": "tr", "co org net ac gov muni idf k12": "il",
    "com net org gov edu in": "ua", "com net org edu gov info biz": "pl", "com nom org gob edu": "es", "com org net gov edu int publ nome": "pt", "gov edu": "it",
    "com asso nom prd gouv tm": "fr", "co or ac gv": "at", "co org info": "hu", "com net org edu gov": "gr", "com net org edu gov sci mil name eun": "eg",
    "com net org gov med pub edu sch": "sa", "com net org edu gov fam biz web": "pk", "com net org edu gov mil name sch i mobi": "ng", "co or ne go ac sc me mobi info": "ke",
}
SUFFIXES = sorted(
    {f"{a}.{b}" for seconds, tops in _SECOND.items() for a in seconds.split() for b in tops.split()}
    | set("github.io gitlab.io readthedocs.io blogspot.com herokuapp.com appspot.com firebaseapp.com web.app netlify.app vercel.app pages.dev workers.dev fly.dev onrender.com azurewebsites.net cloudfront.net s3.amazonaws.com".split())
)
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), CAPITALS, SMALL)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _name(name: Column) -> tuple[Column, Column]:
    """A host without its port, and whether it is an IP address."""
    bare = F.regexp_replace(name, r":[0-9]*$", "")
    return bare, bare.rlike(r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\])$")


def _labels(bare: Column, more: int) -> Column:
    """The suffix of a host, with ``more`` labels before it."""
    out = F.substring_index(bare, ".", -1 - more)
    for n in sorted({s.count(".") + 1 for s in SUFFIXES}):  # the longest is asked first
        listed = F.substring_index(bare, ".", -n).isin([s for s in SUFFIXES if s.count(".") + 1 == n])
        out = F.when(listed, F.substring_index(bare, ".", -n - more)).otherwise(out)
    return out


def suffix(name: Column) -> Column:
    bare, address = _name(name)
    return F.when(address, bare).otherwise(_labels(bare, 0))


def domain(name: Column) -> Column:
    bare, address = _name(name)
    return F.when(address, bare).otherwise(_labels(bare, 1))


def rule(name: Column, at: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does."""
    hit = verdict = None
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        end, begin = text.split("/", 1)
        fits = ((name == end) | name.endswith("." + end)) & at.startswith("/" + begin)
        hit = F.when(fits, text) if hit is None else hit.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return (hit, verdict) if hit is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _strength(groups: DataFrame) -> float:
    """The prior strength of a level, from its groups' n, bad and prior mean m.

    With weights n, the spread of the groups' shares around their priors, less
    what binomial sampling alone gives, is the variance between groups.
    """
    noise = F.col("m") * (1 - F.col("m"))
    sums = (
        groups.filter("n > 0")
        .agg(
            F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("m"), 2)).alias("spread"),
            F.sum(noise).alias("sampling"),
            F.sum(F.col("n") * noise).alias("total"),
        )
        .first()
    )
    if not sums["total"] or sums["total"] <= sums["sampling"]:
        return STRONGEST
    between = (sums["spread"] - sums["sampling"]) / (sums["total"] - sums["sampling"])
    return min(max(1 / between - 1, WEAKEST), STRONGEST) if between > 0 else STRONGEST


def _mean(strength: float) -> Column:
    return (F.col("bad") + F.lit(strength) * F.col("m")) / (F.col("n") + F.lit(strength))


def reputation(hosts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """host, n, bad, bad_mean, bad_lower for every row of ``hosts`` (host); ``outcomes``: host, bad (0 or 1)."""
    labelled = outcomes.dropna().groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    known = hosts.dropDuplicates(["host"]).join(labelled, "host", "left").na.fill(0, ["n", "bad"])
    known = store.cut(known.withColumns({"domain": domain(F.col("host")), "suffix": suffix(F.col("host"))}), "hosts")
    total = known.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    whole = (total["bad"] + 1) / (total["n"] + 2) if total["n"] else 0.0
    counts = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    level = known.groupBy("suffix").agg(*counts).withColumn("m", F.lit(whole))
    top = level.select("suffix", _mean(_strength(level)).alias("m"))
    level = known.groupBy("suffix", "domain").agg(*counts).join(top, "suffix")
    middle = level.select("domain", _mean(_strength(level)).alias("m"))
    level = known.join(middle, "domain")
    s = _strength(level)
    a, size = F.col("bad") + F.lit(s) * F.col("m"), F.col("n") + F.lit(s)
    deviation = F.sqrt(a * (size - a) / (size * size * (size + 1)))
    return level.select("host", "n", "bad", _mean(s).alias("bad_mean"), (_mean(s) - F.lit(Z) * deviation).alias("bad_lower"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] = RULES, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_mean, bad_lower for every row of ``pages`` (page_id, url).

    ``outcomes``: url and bad (0 or 1) of labelled pages.
    """
    parts = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    known = reputation(parts.select("host"), outcomes.select(host(F.col("url")).alias("host"), "bad"))
    hit, says = rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bad_lower") > limit, "block").otherwise("allow")
    return parts.join(known.select("host", "bad_mean", "bad_lower"), "host", "left").select(
        "page_id", "host", "path", hit.alias("rule"), F.coalesce(says, method).alias("verdict"), "bad_mean", "bad_lower"
    )
