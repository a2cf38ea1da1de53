import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tabula.llm import url_lm
from tabula.llm.queries import QUERIES, URL_RULES
from tests.conftest import SF_SMALL


def parse(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def rule_for(host, path):
    fits = [r for r in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)


def code(url):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), url)
    return re.sub(r"[^a-z0/.\-_?=&#:%]", "*", re.sub("[1-9]", "0", low))


def model(strings):
    n = [Counter(), Counter(), Counter()]
    for s in strings:
        s = "^^" + s
        for i in range(2, len(s)):
            for k in range(3):
                n[k][s[i - k : i + 1]] += 1
    m, kinds = defaultdict(int), defaultdict(int)
    for k in (1, 2):
        for g, c in n[k].items():
            m[g[:-1]] += c
            kinds[g[:-1]] += 1
    total = sum(n[0].values())

    def p(g):
        if len(g) == 1:
            return (n[0][g] + 1) / (total + url_lm.ALPHABET)
        return p(g[1:]) if not m[g[:-1]] else (n[len(g) - 1][g] + kinds[g[:-1]] * p(g[1:])) / (m[g[:-1]] + kinds[g[:-1]])

    return p


def test_hosts_paths_and_rules(spark):
    urls = ["http://A.Example.COM/en/x?q#f", "https://www.example.com/en/1", "x://example.com", "http://h?a/b", "http://notexample.com/en/", None, "", "no scheme", "a://b://c/d", "http://x.net/es/1", "http://net/es/", "ftp://É.com/Ä#", "http://com/"]
    got = url_lm.filter_urls(spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "k int, url string"), URL_RULES).orderBy("k").collect()
    for r in got:
        host, path = parse(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule_for(host, path)), r
        assert r.rule is None or r.verdict == ("allow" if URL_RULES[r.rule] else "block")


def test_model_against_brute_force(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    got = QUERIES["op1_url_language_model"](spark, SF_SMALL).collect()
    urls = {r.page_id: r.url for r in pages.collect()}
    known = pages.select("url", url_lm._part(F.col("url")).alias("part")).collect()
    kinds = {True: [], False: []}
    held = []
    for u, part in known:
        rule = rule_for(*parse(u))
        if rule:
            (kinds[URL_RULES[rule]] if part else held).append(code(u) if part else (code(u), URL_RULES[rule]))
    good, bad = model(kinds[True]), model(kinds[False])

    def score(s):
        t = "^^" + s
        return sum(math.log(good(t[i - 2 : i + 1]) / bad(t[i - 2 : i + 1])) for i in range(2, len(t))) / len(s)

    scored = [(math.floor(score(s) * url_lm.STEPS), ok) for s, ok in held]
    steps = sorted({k for k, _ in scored})
    n = Counter(ok for _, ok in scored)
    cost = {t: round((sum(ok and k < t for k, ok in scored) / n[True] + 1 - sum(not ok and k < t for k, ok in scored) / n[False]) * 1e9) for t in steps}
    least = min(steps, key=lambda t: (cost[t], t)) / url_lm.STEPS
    assert len(got) == len(urls)
    for r in got:
        if r.rule is None:
            assert r.verdict == ("allow" if score(code(urls[r.page_id])) >= least else "block"), r


def test_odd_tables(spark):
    rows = [(1, "http://a.com/x", "r"), (1, "http://a.com/x", "r"), (None, None, None), (2, "http://x.org/" + "y" * 100_000, "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string").withColumn("symbols", F.lit(1)).withColumn("score", F.lit(1))
    got = url_lm.filter_urls(pages, URL_RULES).collect()
    assert len(got) == 4 and {r.verdict for r in got} == {"allow"}
    assert url_lm.filter_urls(pages.limit(0), URL_RULES).collect() == []
