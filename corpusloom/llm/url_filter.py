"""URL filters: rules by host and path, and logistic regression on hashed character n-grams for the rest.

The model is trained from a small table of labelled urls by Spark's own
logistic regression, on counts of the 3- and 4-character runs of the host
and the path, hashed to ``FEATURES`` places; the model is that many numbers.
Scoring is an expression over each row, without a shuffle, so a host that has a
third of all urls is no different from others.

A rule fits its host and all subdomains of it, if the url's path starts with
the rule's path; the longest rule wins. What no rule fits, the model judges.

Defined cases: a null url, or one without "://", has an empty host and path; an
empty host and path are allowed; urls are compared as they are, without decoding;
equal rows are judged alike; other columns of the pages are not read; an empty
table gives no rows; labels must have both kinds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import tables
from corpusloom.llm.registry import query

FEATURES = 1 << 14
GRAMS = (3, 4)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path), the rules of the registered query.
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
)

#: Labelled urls (1: block): what the registered query's model is trained from.
LABELLED = {
    1: """
http://casino-royal.example.org/play http://www.best-casino.example.net/en/12 https://casino-win-big.example.com/bonus?id=3
http://online-casino.example.info/slots https://free-bets.example.org/en/today http://bets-now.example.com/football
https://sports-bets.example.net/odds/5 http://free-bets-club.example.info/de/77 http://cheap-pills.example.org/order
https://www.buy-pills.example.net/viagra http://diet-pills.example.com/en/9 https://blog.cheap-pills-shop.example.info/fr/1
http://pharma-discount.example.org/pills/order http://adult-video.example.net/x https://www.adult-x-chat.example.org/en/450
http://xxx-adult.example.com/live https://m.adult-x.example.info/es/8 http://spam-farm.example.net/links
https://www.link-spam-farm.example.com/en/31 http://blog.spam-farm-seo.example.org/page/2 http://seo-spam.example.info/backlinks
https://ads-track.example.org/click?id=8 http://m.ads-track.example.net/pixel https://track-ads.example.com/redirect
http://popup-ads.example.info/banner https://poker-bets.example.net/en/win http://win-money-fast.example.org/now
https://free-money-casino.example.net/fr/20 http://cheap-loans.example.com/apply https://payday-loans-cheap.example.org/en/3
http://crack-keygen.example.net/download http://free-warez.example.org/crack https://lottery-win.example.com/claim
http://replica-watches-cheap.example.net/buy https://escort-adult.example.org/city http://mail.cheap-meds-pills.example.net/de/14
""",
    0: """
https://news.example.org/2020/05/world http://www.library.example.net/catalogue/12 https://blog.gardener.example.com/en/roses
https://museum.example.org/de/exhibits/4 http://www.weather.example.net/forecast https://docs.example.org/guide/install
https://m.teacher.example.com/lessons/7 http://university.example.org/en/courses https://science.example.net/articles/88.html
http://blog.kitchen.example.org/fr/recipes https://www.history.example.com/es/ages/3 http://city-council.example.net/minutes
https://theatre.example.org/programme/2021 http://hospital.example.net/departments https://blog.cyclist.example.org/en/751
https://harbour.example.net/de/180/ http://orchard.example.org/fr/229 https://www.lighthouse.example.net/en/142#top
http://m.village.example.org/de/57?page=2 https://mountain.example.com/en/785.html http://blog.sailing.example.net/en/18
https://pottery.example.org/es/370 https://grammar.example.net/en/638?utm_source=feed http://www.theorem.example.org/de/498
https://weaver.example.org/en/327 http://www.northern.example.com/en/450?page=2 https://m.cathedral.example.net/fr/54#top
http://blog.lantern.example.org/es/417 https://thermal.example.net/en/91.html http://station.example.com/de/883?utm_source=feed
https://encyclopedia.example.org/wiki/Rivers http://www.bookshop.example.net/authors/k https://railway.example.com/timetable/9
https://blog.astronomy.example.org/en/stars http://code.example.net/projects/parser https://forum.linguist.example.org/thread/55
http://archive.example.net/fr/maps/1880 https://www.choir.example.org/en/concerts https://m.botany.example.net/de/plants/6
http://translation.example.org/es/words/2 https://standards.example.net/rfc/791 http://music-school.example.com/en/piano
""",
}


def with_parts(urls: DataFrame, url_col: str) -> DataFrame:
    """Adds ``host`` and ``path``."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER)
    return urls.withColumns({"host": host, "path": F.regexp_extract(url, pattern, 2)})


def matching_rule(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits ``host`` and ``path``, as text, and its verdict; null if none does."""
    rule = verdict = F
    for kind, name, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2])):
        fits = ((F.col("host") == name) | F.col("host").endswith(f".{name}")) & F.col("path").startswith(path)
        rule, verdict = rule.when(fits, name + path), verdict.when(fits, kind)
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _grams(column: str, n: int) -> Column:
    """The runs of ``n`` characters of a marked, bounded text, such as host:^cat$."""
    text = F.concat(F.lit("^"), F.col(column), F.lit("$"))
    runs = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.concat(F.lit(f"{column}:"), F.substring(text, i, F.lit(n))))
    return F.when(F.length(text) >= n, runs).otherwise(F.array().cast("array<string>"))


def with_grams(urls: DataFrame) -> DataFrame:
    return urls.withColumn("grams", F.concat(*[_grams(c, n) for c in ("host", "path") for n in GRAMS]))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The built-in table: ``url, label``."""
    return spark.createDataFrame([(url, float(label)) for label, urls in LABELLED.items() for url in urls.split()], "url string, label double")


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", features: int = FEATURES) -> PipelineModel:
    """Fits the regression to rows of a url and 1 (block) or 0; rows without a label are left out."""
    rows = with_grams(with_parts(labelled.select(F.col(url_col).alias("url"), F.col(label_col).cast("double").alias("label")), "url"))
    stages = [
        HashingTF(inputCol="grams", outputCol="counts", numFeatures=features),
        LogisticRegression(featuresCol="counts", labelCol="label", regParam=0.02, maxIter=60),
    ]
    return Pipeline(stages=stages).fit(rows.where("label is not null").coalesce(1))


def judge(pages: DataFrame, model: PipelineModel, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: ``id_col, host, path, rule, verdict``."""
    rows = with_grams(with_parts(pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url")), "url"))
    rule, verdict = matching_rule(rules)
    scored = model.transform(rows)
    own = F.when((F.col("prediction") == 1) & ((F.col("host") != "") | (F.col("path") != "")), "block").otherwise("allow")
    return scored.select(F.col("page").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"))


@query("op10_url_filters")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(tables.read(spark, sf_dir, "pages"), train(labelled_urls(spark)))
