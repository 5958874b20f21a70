from registryloom.llm import url_rules
from registryloom.llm.url_rules import ALLOW, BLOCK, PatternRule, SiteRule

SITES = [
    SiteRule("org", "/", ALLOW),
    SiteRule("example.org", "/en/1", BLOCK),
    SiteRule("com", "/fr/", ALLOW),
    SiteRule("a.com", "/fr/", BLOCK),
]
URLS = [
    "http://Sub.Example.ORG/en/123?x=1",
    "https://example.org/en/2#t",
    "http://notexample.org/en/1",
    "http://example.org",
    "http://b.a.com/fr/x",
    "http://ba.com/fr/x",
    "ftp://u@h:80://z/p",
    "no scheme.org/",
    "",
    None,
    None,
    "http://x.net/ads/banner.gif?ADS",
    "http://x.net/ads/ok/1",
]


def fits(rule, host, path):
    return (host == rule.host or host.endswith("." + rule.host)) and path.startswith(rule.path)


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    host, tail = rest[:cut].lower(), rest[cut:]
    path = tail.split("?")[0].split("#")[0] if "://" in (url or "") else ""
    found = max((r for r in SITES if fits(r, host, path)), key=lambda r: len(r.name), default=None)
    return host, path, found and found.name, found and found.verdict


def test_sites_equal_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    rows = url_rules.judge_pages(pages, SITES).collect()
    assert len(rows) == len(URLS)
    for r in rows:
        host, path, rule, verdict = brute(URLS[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or ALLOW), r


def test_patterns_decide_where_no_site_does(spark):
    rules = [*SITES, PatternRule("/ads/"), PatternRule("/ads/ok/", ALLOW), PatternRule("*")]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    got = {r.page_id: (r.pattern, r.verdict) for r in url_rules.judge_pages(pages, rules).collect()}
    assert got[11] == ("*", BLOCK) and got[12] == ("/ads/ok/", ALLOW)
    assert got[9] == (None, ALLOW) and got[0] == (None, BLOCK)


def test_rules_are_indexed_by_their_rarest_token(spark):
    urls = spark.createDataFrame([(u,) for u in ("http://a.org/b", "http://a.org/c", "http://d.org/b")], "url string")
    index = url_rules.rule_index(urls, [SiteRule("a.org", "/b/", BLOCK), SiteRule("org", "", BLOCK), PatternRule("x")])
    assert index == [(0, "a"), (1, ""), (2, "")], "the last token may go on, so it is none"


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge_pages(pages, SITES).count() == 0
