import itertools

from shelfrate.llm.common import values
from shelfrate.llm.queries import URL_RULES
from shelfrate.llm.url_filter import judge_urls


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), v, h + p) for v, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, verdict, rule = max(fits, default=(0, "allow", None))
    return host, path, rule, verdict


HOSTS = ["example.org", "WWW.Example.ORG", "a.b.example.org", "xexample.org", "fr.com", "com", "org", "", "ex.org:80",
         "user@example.org", "É.com", "example.org."]
PATHS = ["", "/", "/es", "/es/", "/en/1", "/en/123?x=/es/", "/fr/", "/de/#/fr/", "/FR/", "?q", "#f", "/a/\n/b"]
URLS = [f"{s}{h}{p}" for s, h, p in itertools.product(["http://", "x://y://"], HOSTS, PATHS)] + [
    None, "", "no scheme", "://", "http://" + "a." * 3000 + "com/de/" + "x" * 5000]


def test_matches_brute_force(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, "http://a.com/de/"), (0, URLS[0])]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in rows], "page_id long, url string, host string, rule string")
    got = judge_urls(pages, values(spark, list(URL_RULES), "verdict string, host string, path string")).collect()
    assert sorted(map(str, [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got])) == sorted(
        map(str, [(i, *brute(u, URL_RULES)) for i, u in rows]))


def test_no_rules_repeated_rules_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    none = values(spark, [], "verdict string, host string, path string")
    assert judge_urls(pages, none).head()["verdict"] == "allow"
    twice = values(spark, [("allow", "com", "/"), ("block", "com", "/")], "verdict string, host string, path string")
    assert judge_urls(pages, twice).head()["verdict"] == "block"
    assert judge_urls(pages.limit(0), twice).count() == 0


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string").select("page_id", "url")
    plan = judge_urls(pages, values(spark, list(URL_RULES), "verdict string, host string, path string"))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
