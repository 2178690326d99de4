"""URL filtering: rules for hosts and paths, and a classifier for what no rule decides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexivec.functions.text import ascii_lower
from plexivec.plans.skew import lookup
from plexivec.plans.staging import staged

#: So many rules are compiled into the plan; more, or a table of any size, are joined.
MAX_COMPILED = 16
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
BUCKETS = 1 << 14

# The small labelled URL table, names of hosts of kinds that are commonly blocked, and of others.
BLOCK_HOSTS = """
luckyspin-casino royalcasino24 vegas-slots-online jackpot-slots onlinecasino-bonus blackjack-roulette
pokerstarsroom texas-poker-chips sportsbetting-odds bestbets-football bet365days betting-tips-vip free-bet-codes
cheap-viagra-online buy-cialis-now canadian-pharmacy-rx discountpills24 no-prescription-pills weightloss-pills cheapmeds-store
xxx-videos-hd free-porn-tube adultcams-live hot-adult-chat sexdating-club adult-toys-xxx nude-webcam-girls escort-adult-ads
seo-link-farm buy-backlinks-cheap spam-mailer-pro linkfarm-directory autoblog-spam article-spinner-farm bulk-email-spam
ads.doubleserve adserver.clickbank-media track.clicks-redirect popup-ads-network tracking.pixel-ads banner-ads-exchange adtracker
ads.tracker-metrics ad-tracking trackads-pixel ads-delivery mobile-ads-tracker freebets sports-bets lucky-bets
free-iphone-winner claim-prize-now win-free-giftcards lottery-winner-claim get-rich-quick-money payday-loans-instant easy-cash-loans
replica-watches-cheap fake-rolex-store cheap-handbags-outlet warez-cracks-keygen torrent-movies-free serial-keygen-download
""".split()
ALLOW_HOSTS = """
cityuniversity library.state news.daily-herald gardeners docs.python-tutorial en.encyclopedia
nature-journal weather-service physics.college history.museum recipes.homecooking forum.woodworking
cityhall parks.county school.district wiki.linux-users developer.opensource healthcare-clinic
theguardianpost economics.institute travel.mountains bookstore poetry.writers science.academy
maps.transport railways photographer art.gallery music.conservatory theatre
sports.local-league farmers-market archive.newspaper law.court astronomy-club knitting
cinema-reviews electricians thoughtful-essays engineering.society childrens-hospital notes.mathematics
language.dictionary gardening-advice cycling.touring botanical-gardens softwarecraft hiking-trails
""".split()
# Letters that are frequent together in English, of which ordinary names are made up.
PIECES = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()
MADE_UP = 200
# Beginnings and ends of hosts and paths that say nothing of the kind of a site, and paths that do.
BEGINNINGS = ["", "www.", "m.", "blog."]
ENDS = ["com", "org", "net", "info", "co.uk"]
PATHS = ["/", "/en/12", "/about", "/de/7.html", "/news/2020/item.html", "/fr/825/", "/page?id=3", "/es/"]
BLOCK_PATHS = ["/bonus/signup", "/buy/online-order.html", "/free/spins/2", "/xxx/gallery/12", "/track/click", "/win/claim"]
ALLOW_PATHS = ["/wiki/page", "/articles/5/", "/docs/intro.html", "/posts/2019/03/", "/library/catalogue", "/contact"]


def made_up_names() -> list[str]:
    """Names of 3 to 6 pieces, by a rule: most hosts of the web are names that no table has."""
    return ["".join(PIECES[(i * 31 + k * k * 17 + i * k * 7) % len(PIECES)] for k in range(3 + i % 4)) for i in range(MADE_UP)]


def labelled_urls() -> list[tuple[str, float]]:
    """The labelled table, label 1 is block: every name with beginnings, ends and paths that say nothing, in turn, and one path of its kind."""
    out = []
    for hosts, own, label in ((BLOCK_HOSTS, BLOCK_PATHS, 1.0), (ALLOW_HOSTS + made_up_names(), ALLOW_PATHS, 0.0)):
        for i, host in enumerate(hosts):
            for k in (i, i + 3, i + 6):
                out.append((f"http://{BEGINNINGS[k % len(BEGINNINGS)]}{host}.{ENDS[k % len(ENDS)]}{PATHS[k % len(PATHS)]}", label))
            out.append((f"http://{BEGINNINGS[(i + 1) % len(BEGINNINGS)]}{host}.{ENDS[(i + 2) % len(ENDS)]}{own[i % len(own)]}", label))
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty if it is null or has no ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return ascii_lower(host), path


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, or null.

    A rule is a host and a path that starts with ``/``; it fits its host and all subdomains if the path
    starts with the rule's.  Of equally long rules the first in code-point order; of two verdicts of a rule the later one (block).
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]], r[1])):
        name, _, tail = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{tail}"))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def joined_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` (with ``host, path``) with the struct ``_rule`` as ``best_rule`` finds it, for a table ``rule, verdict`` of any size.

    Distinct hosts meet the names that rules have by their ends at the dots; distinct pairs of host and path meet the rules of these
    names by the beginnings of the path of every length that the name's rules have.  Nothing else is compared; common hosts, ends
    and pairs are looked up apart, and a row moves once at most.  Rules that are null are left out.
    """
    at = F.locate("/", F.col("rule"))
    name = F.when(at > 0, F.expr("left(rule, locate('/', rule) - 1)")).otherwise(F.col("rule"))
    start = F.when(at > 0, F.expr("substring(rule, locate('/', rule))")).otherwise("/")
    known = rules.filter(F.col("rule").isNotNull()).select(name.alias("name"), start.alias("start"), "rule", "verdict")
    # texts of one name and start differ by a lacking slash only: the longer counts
    best = F.max(F.struct(F.length("rule").alias("n"), "verdict", "rule"))
    known = staged(known.groupBy("name", "start").agg(best.alias("_b")).select("name", "start", F.struct("_b.rule", "_b.verdict").alias("_rule")), "rules")
    lengths = known.groupBy("name").agg(F.collect_set(F.length("start")).alias("lengths"))
    pairs = staged(rows.groupBy("host", "path").agg(F.count("*").alias("_n")), "pairs")
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = pairs.groupBy("host").agg(F.count("*").alias("_m")).select("host", "_m", F.explode(F.array_distinct(ends)).alias("name"))
    fits = _met(hosts, lengths, ["name"]).groupBy("host", "_m").agg(F.collect_list(F.struct("name", "lengths")).alias("names"))
    tries = _met(pairs, fits.drop("_m"), ["host"]).select("host", "path", "_n", F.explode("names").alias("_t"))
    tries = tries.select("host", "path", "_n", F.col("_t.name").alias("name"), F.explode("_t.lengths").alias("_l")).filter(F.col("_l") <= F.length("path"))
    tries = tries.select("host", "path", "_n", "name", F.expr("left(path, _l)").alias("start"))
    order = F.struct((-F.length("_rule.rule")).alias("n"), F.col("_rule.rule").alias("rule"), F.col("_rule").alias("of"))
    found = _met(tries, known, ["name", "start"]).groupBy("host", "path").agg(F.min(order).alias("_o"), F.first("_n").alias("_n"))
    found = staged(found.select(F.xxhash64("host", "path").alias("_key"), "host", "path", F.col("_o.of").alias("_rule"), "_n"), "found")
    total = pairs.agg(F.sum("_n")).first()[0] or 0
    out = lookup(rows.withColumn("_key", F.xxhash64("host", "path")), found, ["_key", "host", "path"], "_n", total, F.monotonically_increasing_id())
    return out.drop("_key", "_n")


def _met(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` that have a row of ``groups`` by ``keys``, with its columns; keys of many rows are looked up apart."""
    rows = staged(rows.withColumn("_key", F.xxhash64(*keys)), "tries")
    sizes = rows.groupBy("_key", *keys).agg(F.count("*").alias("_size"))
    known = staged(sizes.join(groups, keys), "met")
    return lookup(rows, known, ["_key", *keys], "_size", rows.count(), F.monotonically_increasing_id(), "inner").drop("_key", "_size")


def _grams(text: str, mark: str) -> str:
    """SQL for the marked runs of 3 to 5 characters of a text with ``^`` and ``$`` around it."""
    t = f"concat('^', {text}, '$')"
    return ", ".join(f"transform(sequence(1, greatest(length({t}) - {n - 1}, 1)), i -> concat('{mark}', substring({t}, i, {n})))" for n in (3, 4, 5))


def fit_url_model(spark: SparkSession, table: Sequence[tuple[str, float]] | None = None) -> PipelineModel:
    """Logistic regression on hashed character n-grams of host and path, fitted on the labelled table, both labels of equal weight."""
    given = list(table or labelled_urls())
    share = {label: sum(y == label for _, y in given) / len(given) for _, label in given}
    rows = spark.createDataFrame([(u, y, 0.5 / share[y]) for u, y in given], "url string, label double, weight double")
    host, path = host_and_path(F.col("url"))
    grams = SQLTransformer(statement=f"SELECT *, concat({_grams('host', 'h')}, {_grams('path', 'p')}) AS grams FROM __THIS__")
    hashed = HashingTF(numFeatures=BUCKETS, inputCol="grams", outputCol="features", binary=True)
    fit = LogisticRegression(regParam=0.005, maxIter=100, standardization=False, weightCol="weight", probabilityCol="probability")
    return Pipeline(stages=[grams, hashed, fit]).fit(rows.coalesce(1).select(host.alias("host"), path.alias("path"), "label", "weight"))


def judge_urls(pages: DataFrame, model: PipelineModel, url_col: str = "url", rules: Sequence[tuple[str, str]] | DataFrame = RULES) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, block_score``.

    The verdict is the best rule's, or the classifier's: block from a probability of 0.5.  A null URL or
    one without ``://`` has an empty host and path, which no rule fits, and is judged by the classifier
    like any other.  ``rules`` are pairs of rule and verdict, or a table of them, of any number.  URLs of any length are read whole.  Repeated rows have equal results; an empty table
    gives an empty result.  Columns of these names are replaced.
    """
    host, path = host_and_path(F.col(url_col))
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "block_score")]
    packed = pages.select(F.struct(*names).alias("_row"), host.alias("host"), path.alias("path"))
    scored = model.transform(packed).withColumn("block_score", vector_to_array("probability")[1])
    if isinstance(rules, DataFrame) or len(rules) > MAX_COMPILED:
        listed = rules if isinstance(rules, DataFrame) else pages.sparkSession.createDataFrame(list(rules), "rule string, verdict string")
        scored = joined_rules(scored.select("_row", "host", "path", "block_score"), listed)
    else:
        scored = scored.withColumn("_rule", best_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return scored.select("_row.*", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "block_score")
