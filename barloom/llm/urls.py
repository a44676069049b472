"""URL filters: host and path rules first, else a logistic regression on hashed n-grams.

Everything is DataFrame functions. A URL is read as host and path; its text ``^host$path`` is
cut into n-grams of ``SIZES`` characters, hashed to ``BUCKETS`` features, each counted once and
scaled to unit length. The regression is fitted on a small labelled table of URLs (at most
``TRAIN_ROWS``) in its dual form: one row holds the table of inner products, and gradient steps
run over it as an array fold. The weights, at most ``BUCKETS`` numbers, become an array literal
of the scoring expression, so that judging a table is one projection.

Rules are part of the query text: at most ``RULES``. A rule fits its host and all subdomains, if
the path starts with the rule's; the longest wins, of equals the first in the alphabet.

Defined cases: a null URL or one without ``://`` has an empty host and path; a rule for an empty
host fits nothing else; an empty text is judged by the intercept alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 4096
SIZES = (3, 4, 5)
STEPS, RATE, RIDGE = 300, 1.0, 0.001
TRAIN_ROWS = 512
PRIOR = 0.1  # share of URLs to block that is expected where no n-gram is known
RULES = 1000

# Invented URLs of the training table, 1 for those to block.
BLOCKED = """
ads.example/banner adserver.example/click m.ads.example/en/12 track.example/pixel.gif tracker.example/t?u=1 www.ad-track.example/de/12 trackads.example/ ads-click.example/fr/1
casino.example/ blog.casino.example/en/7 casino-bonus.example/en/7.html win-casino.example/play www.online-casino.example/slots poker.example/win bigwin.example/jackpot m.win-big.example/es/3
bets.example/ sport-bets.example/en/81/ free-bet.example/en/44 m.free-spins.example/fr/2 betting.example/live adult.example/ blog.adult.example/en/5 adult-video.example/x xxx.example/en/3
porn.example/ www.porn.example/de/9 sex-chat.example/cam x-rated.example/ pills.example/ blog.pills.example/en/6 cheap-meds.example/buy www.cheap-drugs.example/es/4 viagra.example/order cheap-viagra.example/en/9
pills-shop.example/ spam.example/ www.spam.example/fr/8 spam-mail.example/send link-farm.example/ m.seo-farm.example/links content-farm.example/de/5
phish.example/login free-prize.example/claim warez.example/crack torrent.example/get malware.example/run popup.example/ad
""".split()
ALLOWED = """
news.example/ daily-news.example/en/12 www.wiki.example/article blog.example/post m.news.example/de/4 docs.example/guide blog.garden.example/en/7 m.weather.example/fr/3
www.library.example/books university.example/en/55 museum.example/fr/7 weather.example/today recipes.example/soup maps.example/ www.school.example/ forum.example/thread
garden.example/roses music.example/score history.example/es/21 science.example/paper www.health.example/advice travel.example/lisbon train.example/times bank.example/branches
city.example/council law.example/acts blog.thorin.example/en/9 m.thetion.example/de/31 www.onthe.example/fr/8 theriver.example/en/40.html mill.example/ another.example/en/3/
shop.example/shoes winter.example/snow pilots.example/air homes.example/ address.example/ readers.example/ thing.example/en/14 www.nothing.example/de/22 m.anything.example/en/31
station.example/en/61/ nation.example/fr/17 blog.motion.example/es/9 heron.example/en/5 www.onion.example/en/88.html reading.example/de/19 hearing.example/en/27 thistle.example/en/33
m.heather.example/en/47 leather.example/fr/52 www.thatch.example/en/64 thread.example/es/71 blog.mouth.example/en/93 south.example/de/35 health.example/en/18 theatre.example/fr/26
m.northern.example/en/39 other.example/en/41 www.there.example/es/48 blog.these.example/en/57 then.example/en/66 m.than.example/de/75 thunder.example/en/82 edition.example/fr/96
rest.example/en/11 www.west.example/en/29 nest.example/de/45 blog.table.example/en/53 noble.example/en/62 m.able.example/es/79 hand.example/en/84 thousand.example/fr/91
""".split()

#: The rules of the contract's query: verdict by host and path.
QUERY_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def host(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def buckets(host_: Column, path_: Column) -> Column:
    """Distinct feature numbers of a URL."""
    text = F.concat(F.lit("^"), host_, F.lit("$"), path_)
    grams = F.concat(*[F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in SIZES])
    return F.array_distinct(F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int")))


def training_table(spark: SparkSession) -> DataFrame:
    """``(url, blocked)``: the built-in labelled table."""
    rows = [(f"https://{u}", 1) for u in BLOCKED] + [(f"https://{u}", 0) for u in ALLOWED]
    return spark.createDataFrame(rows, "url string, blocked int")


def fit(table: DataFrame) -> tuple[list[float], float]:
    """Weights of the features and the intercept, from ``(url, blocked)``."""
    rows = table.dropna(subset=["url", "blocked"])
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    if n > TRAIN_ROWS:
        raise ValueError(f"at most {TRAIN_ROWS} labelled URLs, not {n}")
    if not n:
        return [0.0] * BUCKETS, -1.0
    f = buckets(host(F.col("url")), path(F.col("url")))
    one = rows.select("url", F.col("blocked").cast("double").alias("y"), f.alias("f"))
    one = one.groupBy().agg(F.array_sort(F.collect_list(F.struct("url", "y", "f"))).alias("t"))

    def inner(a: Column, b: Column) -> Column:
        norm = F.sqrt(F.size(a["f"]).cast("double") * F.size(b["f"]))
        return F.size(F.array_intersect(a["f"], b["f"])) / norm

    one = one.select("t", F.transform("t", lambda a: F.transform("t", lambda b: inner(a, b))).alias("k"))
    start = F.struct(F.transform("t", lambda a: F.lit(0.0)).alias("alpha"), F.lit(0.0).alias("bias"))

    def step(s: Column, _: Column) -> Column:
        def error(row: Column, a: Column) -> Column:
            z = F.aggregate(F.zip_with(row, s["alpha"], lambda x, y: x * y), s["bias"], lambda u, v: u + v)
            return a["y"] - 1 / (1 + F.exp(-z))

        wrong = F.zip_with("k", "t", error)
        alpha = F.zip_with(s["alpha"], wrong, lambda a, e: a + RATE * (e - RIDGE * a))
        return F.struct(alpha.alias("alpha"), (s["bias"] + RATE / n * F.aggregate(wrong, F.lit(0.0), lambda u, v: u + v)).alias("bias"))

    fitted = one.select("t", F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step).alias("s"))
    each = fitted.select(F.col("s.bias").alias("bias"), F.explode(F.arrays_zip("t", F.col("s.alpha").alias("alpha"))).alias("e"))
    each = each.select("bias", (F.col("e.alpha") / F.sqrt(F.size("e.t.f").cast("double"))).alias("w"), F.explode("e.t.f").alias("b"))
    got = each.groupBy("b").agg(F.sum("w").alias("w"), F.first("bias").alias("bias")).collect()  # at most BUCKETS rows
    weights = [0.0] * BUCKETS
    for r in got:
        weights[r.b] = r.w
    odds = math.log(PRIOR / (1 - PRIOR)) - math.log((ones + 0.5) / (n - ones + 0.5))  # the table's share is not that of the web
    return weights, got[0].bias + odds


def score(f: Column, weights: list[float], bias: float) -> Column:
    """Probability that a URL with features ``f`` is to be blocked."""
    w = F.array(*[F.lit(x) for x in weights])
    total = F.aggregate(f, F.lit(0.0), lambda a, b: a + F.get(w, b))
    return 1 / (1 + F.exp(-(F.lit(bias) + total / F.sqrt(F.greatest(F.size(f), F.lit(1)).cast("double")))))


def longest_rule(host_: Column, path_: Column, rules: dict[str, str]) -> Column:
    """Struct of the winning rule and its verdict; null if none fits."""
    if len(rules) > RULES:
        raise ValueError(f"at most {RULES} rules")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r), [-ord(c) for c in r])):  # the longest is tried first
        h, _, p = r.partition("/")
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith("/" + p)
        found = F.when(fits, F.struct(F.lit(r).alias("rule"), F.lit(rules[r]).alias("verdict"))).otherwise(found)
    return found


def judged(pages: DataFrame, rules: dict[str, str], table: DataFrame | None = None, url_col: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep`` columns with host, path, rule, verdict and the method's probability to block."""
    weights, bias = fit(training_table(pages.sparkSession) if table is None else table)
    read = pages.select(*[f"`{c}`" for c in keep], host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    read = read.withColumn("_fits", longest_rule(F.col("host"), F.col("path"), rules))
    read = read.withColumn("blocked", score(buckets(F.col("host"), F.col("path")), weights, bias))
    verdict = F.coalesce("_fits.verdict", F.when(F.col("blocked") >= 0.5, "block").otherwise("allow"))
    return read.select(*keep, "host", "path", F.col("_fits.rule").alias("rule"), verdict.alias("verdict"), "blocked")
