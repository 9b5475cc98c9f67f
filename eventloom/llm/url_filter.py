"""Operator 6: URL filtering by rules, and by logistic regression where no rule fits. DataFrame functions only.

The model sees hashed character n-grams of host and path.  It is trained here, on a small labelled table of
URLs (``LABELLED`` or the caller's), of at most ``MOST_LABELS`` rows; scoring is one pass without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules as (host and path prefix, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
SIZES = (3, 4, 5)
BUCKETS = 1 << 15
#: The bound of the training sample: more labelled rows than this are refused, not cut.
MOST_LABELS = 100_000

#: The labelled table: URLs to block and to allow.
LABELLED = {
    "block": """
https://www.casino-royal.com/en/slots
http://best-casino.net/win/jackpot
https://m.win-casino-online.org/play
https://casino-win-big.com/en/1001
http://blog.bigwin-casino.biz/2020
https://free-bets-now.com/en/offer
http://www.freebets.org/sport
https://m.sports-bets.net/odds.html
https://bets-free.com/de/bonus
http://online-betting-bets.info/en
https://www.cheap-pills-shop.com/buy
http://pills-cheap.net/en/order
https://m.discount-pills.org/rx
https://cheapmeds-pills.com/fr/buy
http://blog.diet-pills-cheap.info/1
https://ads-tracker.com/pixel
http://track-ads.net/click
https://www.adstrack.org/en/c.gif
https://m.ads-server-track.com/b
http://ads.track-clicks.info/en/3
https://spam-farms.com/links
http://www.link-spam-farm.net/en
https://m.seo-spam.org/page
https://content-farm-spam.com/de/2
http://spamfarm.info/es/77
https://www.adult-xxx.com/video
http://adult-x-videos.net/en
https://m.adult-chat.org/live
https://x-adult.com/fr/pics
http://blog.adultx.info/en/8
https://porn-xxx-free.com/en
http://www.cheap-viagra.net/buy
https://slots-poker-win.com/en/2
https://payday-loans-cheap.com/apply
http://malware-download.net/free.exe
https://phishing-login.com/verify
https://www.casino-bonus.example.com/en/7711
http://m.lucky-casino.example.org/fr/310/
https://blog.free-bets-today.example.com/es/4410.html
http://bets-win.example.net/en/91?page=2
https://m.buy-cheap-pills.example.com/en/1208
http://www.pills-online.example.org/es/77#top
https://ads-track-pixel.example.com/en/5
http://m.ads-server.example.net/de/610/
https://www.link-spam.example.com/fr/2207
http://blog.spam-farm-links.example.org/en/31.html
https://adult-x-chat.example.com/en/9001
http://www.adult-cams.example.org/es/44
""",
    "allow": """
https://www.wikipedia.org/wiki/Spark
https://en.library.org/en/books/12
http://www.university.edu/en/course/101
https://blog.science-daily.com/en/2231.html
https://m.newspaper.com/en/article/77
https://www.weather.org/de/berlin
https://docs.python.org/3/library/
http://blog.gardening.com/en/551/
https://www.museum.org/fr/expo/9
https://recipes.cooking.com/es/17.html
https://m.history.org/en/4410
http://www.travel-notes.com/fr/321
https://research.institute.org/en/paper/8
https://www.city-council.gov/en/3021
https://blog.teacher.com/de/77.html
http://therapist.org/en/12
https://www.anthem.com/en/4021/
https://motion-lab.com/en/661
https://ththe.example.com/en/9120
https://www.thering.example.org/es/1204
http://m.tionsh.example.com/fr/7311.html
https://blog.therth.example.org/en/882/
http://www.ththin.example.com/es/5120
https://thernt.example.org/de/991
https://m.station.com/en/201?page=2
https://nation.org/en/75.html
https://www.edition.com/fr/18
http://blog.weaver.org/en/6613
https://www.sheath.com/en/31
https://m.theory.org/de/4
https://health.gov/en/advice/22
https://thand.example.net/de/2201
http://tiond.example.net/fr/87
https://www.nding.example.net/es/3105/
http://m.erthe.example.net/en/714.html
https://blog.thersh.example.net/de/18#top
http://anthe.example.net/fr/5023?page=2
https://m.thent.example.com/de/902
http://blog.ertion.example.com/de/4410
https://www.forest.org/es/19
http://words.com/en/3/
https://www.standard.org/en/iso/7
https://blog.astronomy.org/en/2024
https://m.farming.com/en/wheat
https://www.trackfield.org/en/athletics
https://freedom.org/en/essay
https://www.winter.com/en/snow
https://adults-learning.edu/en/course
""",
}


def labelled(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(u).alias("url"), F.lit(k == "block").alias("blocked")) for k, text in LABELLED.items() for u in text.split()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def host(url: Column) -> Column:
    """What follows the first ``://`` up to / ? # or the end, A-Z in lower case; empty for null or no ``://``."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _fits(rule: str, at_host: Column, at_path: Column) -> Column:
    name, slash, rest = rule.partition("/")
    return ((at_host == name) | F.endswith(at_host, F.lit("." + name))) & F.startswith(at_path, F.lit(slash + rest))


def rule_of(at_host: Column, at_path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, else null."""
    longest = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    return F.coalesce(*[F.when(_fits(r, at_host, at_path), F.lit(r)) for r, _ in longest]) if rules else F.lit(None).cast("string")


def _grams(text: Column, mark: str) -> Column:
    framed = F.concat(F.lit("^"), F.regexp_replace(text, r"[0-9]+", "0"), F.lit("$"))
    last = F.char_length(framed)

    def of(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(last - size + 1, F.lit(1)))
        return F.transform(starts, lambda k: F.concat(F.lit(mark), F.substring(framed, k, F.lit(size))))

    return F.concat(*map(of, SIZES))


def grams(at_host: Column, at_path: Column) -> Column:
    """Marked n-grams of host and path; a run of digits counts as one."""
    return F.concat(_grams(at_host, "h"), _grams(F.lower(at_path), "p"))


def _features(urls: DataFrame) -> DataFrame:
    """Adds _features to rows with host and path."""
    rows = urls.withColumn("_grams", grams(F.col("host"), F.col("path")))
    return HashingTF(numFeatures=BUCKETS, binary=True, inputCol="_grams", outputCol="_features").transform(rows).drop("_grams")


def train(table: DataFrame, url: str = "url", blocked: str = "blocked") -> LogisticRegressionModel | bool:
    """Fits the regression on a labelled table; with labels of one kind only, that kind is the verdict for all."""
    rows = table.where(F.col(blocked).isNotNull()).select(host(F.col(url)).alias("host"), path(F.col(url)).alias("path"), F.col(blocked).cast("double").alias("label"))
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if n > MOST_LABELS:
        raise ValueError(f"{n} labelled URLs; the bound is {MOST_LABELS}")
    if ones in (0, n):
        return bool(ones)
    rows = _features(rows).select("_features", "label").coalesce(1)
    return LogisticRegression(featuresCol="_features", labelCol="label", regParam=0.002, maxIter=200, standardization=False).fit(rows)


def judge(pages: DataFrame, table: DataFrame, rules: tuple = RULES, key: str = "page_id", url: str = "url", threshold: float = 0.5) -> DataFrame:
    """One row per page: key, host, path, rule (else null), verdict (block or allow: the rule's, else the model's).

    Null URLs and those without ``://`` have empty host and path; the model judges them like any other. Repeated
    rows stay, null keys pass through, an empty table gives an empty result. Only key and url are read.
    """
    rows = pages.select(F.col(key).alias("_key"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    model = train(table)
    if isinstance(model, bool):
        own = F.lit("block" if model else "allow")
    else:
        model.setProbabilityCol("").setRawPredictionCol("").setPredictionCol("_blocked").setThreshold(threshold)
        rows = model.transform(_features(rows))
        own = F.when(F.col("_blocked") > 0.5, "block").otherwise("allow")
    ruled = reduce(lambda out, r: F.when(F.col("rule") == r[0], r[1]).otherwise(out), rules, own)
    return rows.select(F.col("_key").alias(key), "host", "path", "rule", ruled.alias("verdict"))
