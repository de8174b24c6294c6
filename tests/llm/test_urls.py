import random
import string

from pyspark.sql import functions as F

from lumenframe.llm import urls


def plain(url, rules):
    """Every rule tried on every url."""
    host, path, tail = urls.split_url(url)
    prefix = [r for r in rules if r.kind == "prefix" and any((host == h or host.endswith("." + h)) and path.startswith(p) for h, p in [(r.pattern[: r.pattern.index("/")], r.pattern[r.pattern.index("/") :])])]
    hits = [r for r in rules if r.kind == "pattern" and host + tail and urls.expression(r).match(host + tail)]
    best = max(prefix, key=lambda r: len(r.pattern), default=None)
    verdict = best.verdict if best else "allow" if any(r.verdict == "allow" for r in hits) else "block" if hits else "allow"
    return host, path, best and best.pattern, verdict


def test_split():
    assert urls.split_url("HTTP://WWW.Example.COM?x=/a") == ("www.example.com", "", "?x=/a")
    assert urls.split_url("http://a.b/p/Q?x#y") == ("a.b", "/p/Q", "/p/Q?x#y")
    assert urls.split_url("a.b/c") == urls.split_url(None) == urls.split_url("") == ("", "", "")
    assert urls.split_url("x://a#b://c/d")[:2] == ("a", "")


def test_index_misses_no_rule():
    rnd = random.Random(5)
    rules = [*urls.PREFIX_RULES, *urls.PATTERN_RULES, urls.Rule("*", "allow"), urls.Rule("ads", "block"), urls.Rule("|a.", "block"), urls.Rule("Ads^", "block"), urls.Rule("x*y^z", "block")]
    parts = ["ads", "example", "www", "com", "net", "en", "es", "login", "docs", "x", "Y", "z", "com/en", "é", "K"]
    for _ in range(3000):
        url = rnd.choice(["http://", "https://", "", "://"]) + "".join(rnd.choice(parts) + rnd.choice([".", "/", "?", "=", "-", "", "#", "/ads/"]) for _ in range(rnd.randrange(8)))
        counts = {t: rnd.randrange(5) for r in rules for t in urls.literal_tokens(r)}
        index, always = urls.build_index(rules, counts)
        some = [r for r in rules if r.pattern != "*"]
        for own in (rules, some):
            index, always = urls.build_index(own, counts)
            a, b, _ = urls.match(url, own, index, always)
            verdict = a.verdict if a else b.verdict if b else "allow"
            assert (*urls.split_url(url)[:2], a and a.pattern, verdict) == plain(url, own), url


def test_judge_with_nulls_clashes_and_blocks(spark):
    rows = [(1, "http://www.example.com/en/1"), (2, "http://a.net/fr/x"), (3, None), (4, "junk"), (None, "http://ads.x.org/"), (6, "http://example.com/en/?q"), (6, "http://example.com/en/?q"), (7, "http://x.org/login")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("found_0__", F.lit(2))
    want = sorted([str((i, *plain(u, urls.PREFIX_RULES + urls.PATTERN_RULES))) for i, u in rows])
    for block in (1000, 4):
        got = urls.judge(pages, block=block)
        assert got.columns.count("host") == 1 and "found_0__" in got.columns
        assert sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in got.collect()) == want
    assert urls.judge(pages.limit(0)).count() == 0
    assert {r.verdict for r in urls.judge(pages, rules=()).collect()} == {"allow"}


def test_many_rules_take_the_join(spark):
    rules = [urls.Rule(f"/{a}{b}{c}q/", "block") for a in string.ascii_lowercase for b in string.ascii_lowercase for c in "abcd"]
    pages = spark.createDataFrame([(1, "http://x.y/zzaq/"), (2, "http://x.y/zzaqq/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.judge(pages, rules).collect()} == {1: "block", 2: "allow"}


def test_rule_lists_and_long_urls(spark):
    rules = urls.parse_rules(["! a list", "[Adblock]", "||ads.example^", "@@||ads.example/ok^", "example.com##.banner", "/x[0-9]/", "||a.b^$third-party", "", "# note", "/promo/*"])
    assert [(r.pattern, r.verdict) for r in rules] == [("||ads.example^", "block"), ("||ads.example/ok^", "allow"), ("/promo/*", "block")]
    long = "http://h/" + "a/" * 20_000 + "promo/1"
    pages = spark.createDataFrame([(1, "http://x.ads.example/"), (2, "http://ads.example/ok"), (3, long), (4, "http://h/promo")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.judge(pages, rules).collect()} == {1: "block", 2: "allow", 3: "block", 4: "allow"}
