"""Which URLs a crawl keeps: rules by host and path first, then a logistic regression on character n-grams.

The regression is Spark ML's, over hashed n-grams of host and path, and is trained from a small table of labelled URLs.
All of it is built-in functions and the model's own transform, so a URL is judged where its row is read.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import unused_name

SIZES = (3, 4, 5)
BUCKETS = 1 << 15
REGULARISATION = 0.002
ITERATIONS = 60
THRESHOLD = 0.5

#: More rules than this are joined as a table instead of being written into the expression.
MAX_LITERAL_RULES = 200
#: Up to so many rules the table is broadcast; beyond, the join shuffles.
MAX_BROADCAST_RULES = 500_000

ALLOW, BLOCK = "allow", "block"
COLUMNS = ("host", "path", "rule", "score", "verdict")


class Rule(NamedTuple):
    """What is done with URLs of a host and its subdomains whose path starts with ``path``."""

    host: str
    path: str
    verdict: str


#: The rules of the registered query, fixed values.
RULES = (Rule("net", "/", BLOCK), Rule("example.net", "/en/", ALLOW), Rule("example.com", "/de/", BLOCK), Rule("org", "/fr/", ALLOW))

_BLOCKED = """
http://casino-royale.test/en/12.html http://www.win-casino.test/play/ https://blog.casino.test/?ref=9 http://online-poker.test/en/bonus https://slots-free.test/spin/77 https://blog.jackpot-win.test/de/31
http://bets-now.test/fr/8812 https://free-bet.test/en/501.html http://www.sport-bets.test/odds/ https://lucky-roulette.test/es/4 http://cheap-meds.test/en/33 https://blog.pills-online.test/de/10/ http://www.buy-pills.test/fr/7
https://cheap-viagra.test/en/1822.html http://diet-pills.test/es/9 https://discount-pharmacy.test/en/44 http://ads-server.test/en/3313 https://m.ads-click.test/de/2 http://track-ads.test/px/1 http://blog.clicktrack.test/en/5
http://www.pop-ads.test/fr/90 https://ad-tracker.test/es/13 http://banner-ads.test/en/6.html https://spam-mail.test/en/77 http://link-farm.test/de/5112/ https://www.spam-links.test/fr/3 http://content-farm.test/es/41
https://blog.seo-spam.test/en/9 http://adult-video.test/en/18 https://blog.xxx-adult.test/de/6 http://www.adult-chat.test/fr/2 https://x-rated.test/es/71 http://porn-x.test/en/3 https://sexy-cams.test/de/8 http://adult-dating.test/en/52
https://fast-loans.test/en/55 http://m.payday-loan.test/de/12 https://cheap-replica.test/fr/4 http://replica-watch.test/en/21 https://blog.free-warez.test/es/6 http://crack-keygen.test/en/7 https://m.torrent-free.test/de/31
http://malware-x.test/en/2 https://win-prize.test/fr/66 http://free-win.test/es/18 https://get-rich.test/en/40 http://www.miracle-cure.test/de/3 https://cheap-bags.test/fr/15
"""

_ALLOWED = """
http://stonebridge.test/en/12.html https://www.theatre.test/en/7 http://blog.thornton.test/de/31 https://m.northern.test/fr/8812 http://station.test/es/501.html https://nation.test/en/33/ http://www.translation.test/de/10
https://hearth.test/fr/7 http://weather.test/en/1822.html https://blog.mathematics.test/es/9 http://anthem.test/en/44 https://m.brotherhood.test/en/3313 http://together.test/de/2 https://earth.test/fr/90 http://breathing.test/es/13
https://www.leatherworks.test/en/6.html http://blog.clothing.test/en/77 https://worthing.test/de/5112/ http://thread.test/fr/3 https://m.feathers.test/es/41 http://smithson.test/en/9 https://bath.test/en/18 http://motion.test/de/6
https://www.education.test/fr/2 http://foundation.test/es/71 https://blog.author.test/en/3 http://health.test/de/8 https://m.thrush.test/en/52 http://gathering.test/en/55 https://youth.test/de/12 http://conservation.test/fr/4
https://www.athens.test/en/21 http://blog.ethics.test/es/6 https://method.test/en/7 http://thistle.test/de/31 https://m.library.test/en/2 http://museum.test/fr/66 https://www.garden.test/es/18 http://history.test/en/40
https://blog.recipes.test/de/3 http://school.test/fr/15 https://m.university.test/en/61 http://news.test/de/1000 https://www.science.test/en/4000/ http://music.test/fr/222 https://blog.travel.test/es/37 http://river.test/en/5
https://m.mountain.test/de/46 http://village.test/en/17.html https://www.harbour.test/fr/9 http://kitchen.test/es/88 https://blog.painting.test/en/73 http://forum.test/de/15 https://docs.test/en/28 http://wiki.test/fr/64
https://m.lighthouse.test/en/99 http://southern.test/de/7 https://www.orchestra.test/es/24 http://theory.test/en/6 https://blog.hiking.test/fr/11 http://carpenter.test/en/3010 https://bakery.test/de/5 http://timetable.test/en/64 https://botany.test/es/2
http://heritage.test/en/8 https://blog.chemistry.test/fr/30 http://www.shepherd.test/de/19 https://cheese.test/en/27 http://m.heather.test/es/54 https://orchard.test/fr/16
"""


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The labelled table of the registered query: ``url`` and ``blocked`` (1 or 0), invented for it."""
    rows = [(u, 1) for u in _BLOCKED.split()] + [(u, 0) for u in _ALLOWED.split()]
    return spark.createDataFrame(rows, "url string, blocked int").coalesce(1)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z in lower case, and the path of a URL; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ngrams(text: Column, mark: str) -> Column:
    """The runs of 3 to 5 characters of a text between marks of its ends, each after ``mark``; none of an empty text.

    Capital letters count as small ones and all digits as 0, so that page numbers say nothing.
    """
    plain = F.translate(text, string.ascii_uppercase + string.digits, string.ascii_lowercase + "0" * 10)
    chars = F.split(F.concat(F.lit("^"), plain, F.lit("$")), "")

    def runs(n: int) -> Column:
        starts = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), *(chars[i + k] for k in range(n))))

    found = F.flatten(F.filter(F.array(*map(runs, SIZES)), lambda r: r.isNotNull()))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(found)


def _grams(host: Column, path: Column) -> Column:
    return F.concat(ngrams(host, "h"), ngrams(path, "p"))


def train(labelled: DataFrame, *, url_col: str = "url", label_col: str = "blocked") -> PipelineModel:
    """The regression, fitted on labelled URLs; rows without a label are left out. Either label must be there."""
    rows = labelled.select(_grams(*host_and_path(F.col(url_col))).alias("grams"), F.col(label_col).cast("double").alias("label")).filter("label is not null")
    hashed = HashingTF(inputCol="grams", outputCol="features", numFeatures=BUCKETS, binary=True)
    regression = LogisticRegression(featuresCol="features", labelCol="label", regParam=REGULARISATION, maxIter=ITERATIONS, tol=1e-4, standardization=False)
    return Pipeline(stages=[hashed, regression]).fit(rows)


def by_rules(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """``rule`` and ``verdict`` of the longest rule that fits, null if none does.

    Of rules of one length the one with the longer host counts, then the smaller one.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), len(r.host), [-ord(c) for c in r.host + r.path])):
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def with_rule_table(urls: DataFrame, rules: DataFrame, name: str) -> DataFrame:
    """``urls(host, path)`` with the struct ``name`` of :func:`by_rules`, for a table of any number of rules.

    Each distinct (host, path) meets the rules of its host's endings, no longer than the longest host of a rule; the
    rules are broadcast only up to ``MAX_BROADCAST_RULES``.
    """
    known = rules.select(F.col("host").alias("_of"), F.col("path").alias("_from"), "verdict").distinct()
    count, labels = known.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(F.split("_of", r"\."))), F.lit(1))).first()
    pairs = urls.select("host", "path").distinct()
    parts = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda i: F.array_join(F.slice(parts, -i, i), "."))
    met = pairs.withColumn("_of", F.explode(ends)).join(F.broadcast(known) if count <= MAX_BROADCAST_RULES else known, "_of").filter(F.startswith("path", F.col("_from")))
    text = F.concat("_of", "_from")
    best = met.groupBy("host", "path").agg(F.min_by(F.struct(text.alias("rule"), "verdict"), F.struct(-F.length(text), -F.length("_of"), text)).alias(name))
    # A pair that most rows share is split by AQE: each side has one row a pair but this one.
    return urls.join(best, ["host", "path"], "left")


def judge(urls: DataFrame, model: PipelineModel, rules: Sequence[Rule] | DataFrame = (), *, url_col: str = "url", threshold: float = THRESHOLD) -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule``, ``score`` and ``verdict`` (allow or block).

    The host is what follows the first ``://`` up to ``/ ? #`` or the end, A-Z in lower case, and the path what follows
    it up to ``? #`` or the end. A rule fits its host and all subdomains where the path starts with the rule's; the
    longest one that fits is ``rule`` and decides. ``score`` is the model's probability of block, which decides
    where no rule does: block from ``threshold`` on.

    Defined cases: a URL that is null, empty or without ``://`` has an empty host and path, fits no rule and has
    score 0, so it is allowed, as is one of ``://`` alone. Of rules of one length the one with the longer host
    counts, then the smaller text. Ports and user names are part of the host. Long URLs are judged whole, repeated
    rows alike; an empty table gives no rows. Columns named like the five new ones are replaced, others stay.
    """
    host, path = host_and_path(F.col(url_col))
    others = [c for c in urls.columns if c.lower() not in COLUMNS]
    own = unused_name("row", urls)
    rows = urls.select(F.struct(*urls.columns).alias(own), host.alias("host"), path.alias("path"))
    if isinstance(rules, DataFrame) or len(rules) > MAX_LITERAL_RULES:
        table = rules if isinstance(rules, DataFrame) else urls.sparkSession.createDataFrame(list(rules), "host string, path string, verdict string")
        rows = with_rule_table(rows, table, "_rule")
    else:
        rows = rows.withColumn("_rule", by_rules(rules, F.col("host"), F.col("path")))
    scored = model.transform(rows.withColumn("grams", _grams(F.col("host"), F.col("path"))))
    score = F.when(F.size("grams") == 0, F.lit(0.0)).otherwise(vector_to_array("probability")[1])
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("score") >= threshold, BLOCK).otherwise(ALLOW))
    found = scored.select(own, "host", "path", "_rule", score.alias("score")).withColumn("verdict", verdict)
    return found.select(*(F.col(f"{own}.`{c}`").alias(c) for c in others), "host", "path", F.col("_rule.rule").alias("rule"), "score", "verdict")
