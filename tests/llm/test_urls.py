import math
import re

import pytest

from barloom.llm import urls

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow", "a.b/": "allow", "a.b/x": "block"}
URLS = [
    "https://x.example.net/en/1", "http://NET/", "https://net", "https://net?x", "https://sub.example.net/de/", "http://example.com/de/9?x=/en/", "http://myexample.com/de/", "https://q.org/fr/x#y",
    "no scheme", None, "", "://", "x://h", "a://B://c/d", "https://Ünet/é?ü", "http://a.b/x/y", "http://a.b/", "http://casino-win.example/en/1", "http://ads.site/p", "http://weather.site/\nq", "http://" + "w" * 50000 + "/p",
]


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    rule = max(fits, key=len, default=None)
    return host, path, rule


def grams(host, path):
    s = f"^{host}${path}"
    return {s[i : i + n] for n in urls.SIZES for i in range(len(s) - n + 1)}


@pytest.fixture(scope="module")
def fitted(spark):
    return urls.fit(urls.training_table(spark))


def test_rules_and_parts(spark):
    rows = [(i, u, "x", 1) for i, u in enumerate(URLS)] + [(None, URLS[0], "x", 1), (0, URLS[0], "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, blocked int")
    got = urls.judged(df, RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(URLS[r.page_id or 0])
        assert (r.host, r.path, r.rule) == want
        assert r.verdict == (RULES[r.rule] if r.rule else "block" if r.blocked >= 0.5 else "allow")
    verdicts = {URLS[r.page_id or 0]: r.verdict for r in got}
    assert verdicts["http://casino-win.example/en/1"] == verdicts["http://ads.site/p"] == "block"
    assert verdicts["no scheme"] == verdicts["http://weather.site/\nq"] == "allow"
    assert urls.judged(df.limit(0), RULES).count() == 0


def test_fit_matches_plain_gradient_steps(spark, fitted):
    """The same regression without hashing, one number at a time."""
    table = [(brute(f"https://{u}")[:2], y) for y, us in ((1, urls.BLOCKED), (0, urls.ALLOWED)) for u in us]
    f = [grams(*hp) for hp, _ in table]
    k = [[len(a & b) / math.sqrt(len(a) * len(b)) for b in f] for a in f]
    alpha, bias = [0.0] * len(f), 0.0
    for _ in range(urls.STEPS):
        wrong = [y - 1 / (1 + math.exp(-bias - sum(x * a for x, a in zip(row, alpha)))) for (_, y), row in zip(table, k)]
        alpha = [a + urls.RATE * (e - urls.RIDGE * a) for a, e in zip(alpha, wrong)]
        bias += urls.RATE / len(f) * sum(wrong)
    ones = sum(y for _, y in table)
    bias += math.log(urls.PRIOR / (1 - urls.PRIOR)) - math.log((ones + 0.5) / (len(f) - ones + 0.5))
    weights, got_bias = fitted
    assert abs(got_bias - bias) < 0.2
    for (hp, y), row in zip(table, k):
        z = bias + sum(x * a for x, a in zip(row, alpha))
        df = spark.range(1).select(urls.buckets(urls.F.lit(hp[0]), urls.F.lit(hp[1])).alias("f")) if hp in (table[0][0], table[-1][0]) else None
        if df is not None:
            p = df.select(urls.score(urls.F.col("f"), weights, got_bias)).first()[0]
            assert (p >= 0.5) == (z >= 0) == bool(y)


def test_no_python_in_the_plan(spark, fitted):
    df = spark.createDataFrame([(1, "https://a.b/c")], "page_id long, url string")
    plan = urls.judged(df, RULES)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
