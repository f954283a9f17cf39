import math
import random
import re

from tidemark.llm import urls
from tidemark.llm.q_urls import RULES, op9_url_filter

URLS = [
    None, "", "no scheme/en/7", "http://Example.COM/en/7", "http://a.example.com/en/71?x=://b/", "ftp://com/en/", "http://notcom/en/x",
    "http://xexample.com/en/7", "https://m.example.net/de/8#t", "https://net/de/", "http://b.org/es/?q", "http://b.org?es/", "x://y://z/en/",
    "http://ÉXAMPLE.org/ÉS", "http://example.com", "http:///de/", "http://b.org/es/?q",
]


def plain(url):
    _, found, rest = (url or "").partition("://")
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups() if found else ("", "")
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = []
    for verdict, rule in RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return host, path, *(max(fits)[1:] if fits else (None, None))


def pages(spark, found):
    return spark.createDataFrame([(i, u, "clash") for i, u in enumerate(found)], "page_id long, url string, host string")


def test_hosts_paths_and_rules(spark, tmp_path):
    pages(spark, URLS).write.parquet(f"{tmp_path}/pages.parquet")
    rows = {r.page_id: r for r in op9_url_filter(spark, str(tmp_path)).collect()}
    assert len(rows) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, rule, verdict = plain(u)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule)
        assert rows[i].verdict == verdict if verdict else rows[i].verdict in ("allow", "block")


def test_model_tells_hosts_apart(spark):
    random.seed(2)
    made = [f"http://{random.choice('abc')}shop.example.com/en/{random.randint(0, 6)}{i}" for i in range(300)]
    made += [f"http://{random.choice('abc')}wiki.example.net/de/{random.randint(0, 7)}{i}" for i in range(300)]
    asked = [f"http://cshop.example.com/fr/{i}" for i in range(20)] + [f"http://awiki.example.net/fr/{i}" for i in range(20)]
    rows = {r.page_id: r for r in urls.judge(pages(spark, made + asked), RULES).collect()}
    assert [rows[600 + i].verdict for i in range(40)] == ["block"] * 20 + ["allow"] * 20


def test_scores_equal_a_plain_model(spark):
    rows = [("h.com", "/a" + "b" * (i % 5), "allow" if i % 3 else "block") for i in range(60)]
    decided = spark.createDataFrame(rows, "host string, path string, verdict string")
    got = {(r.host, r.path): r.score for r in urls.score(decided, urls.train(decided)).collect()}
    counts = {"allow": {}, "block": {}}
    for h, p, v in rows:
        t = urls.START + h + p + urls.END
        for i in range(1, len(t)):
            for n in range(1, urls.ORDER + 1):
                if i + 1 >= n:
                    g = t[i + 1 - n : i + 1]
                    counts[v][g] = counts[v].get(g, 0) + 1
    framed = {v: sum(r[2] == v for r in rows) for v in counts}
    total = {v: sum(n for g, n in c.items() if len(g) == 1) for v, c in counts.items()}
    both = lambda g: sum(c.get(g, 0) for c in counts.values())

    def prob(v, g):
        if len(g) == 1:
            return (counts[v].get(g, 0) + 0.5) / (total[v] + 0.5 * urls.SYMBOLS)
        ctx = framed[v] if g[:-1] == urls.START else counts[v].get(g[:-1], 0)
        return (counts[v].get(g, 0) + urls.WEIGHT * prob(v, g[1:])) / (ctx + urls.WEIGHT)

    for h, p, _ in rows:
        t = urls.START + h + p + urls.END
        sums = []
        for i in range(1, len(t)):
            kept = [t[i + 1 - n : i + 1] for n in range(1, urls.ORDER + 1) if i + 1 >= n and both(t[i + 1 - n : i + 1]) >= urls.MIN_COUNT]
            sums.append(math.log10(prob("allow", kept[-1]) / prob("block", kept[-1])) if kept else 0.0)
        assert abs(got[h, p] - sum(sums) / len(sums)) < 1e-9


def test_no_rule_and_no_rows(spark):
    assert {r.verdict for r in urls.judge(pages(spark, ["http://q.de/", None]), RULES).collect()} == {"allow"}
    assert urls.judge(pages(spark, []), RULES).count() == 0


def test_columns_that_clash(spark):
    rows = [(i, f"http://a.com/en/{i}", 1, 2, 3, "x", 4) for i in range(5)] + [(9, "http://b.net/de/1", 1, 2, 3, "x", 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, t long, i long, __row long, gram string, page_ long")
    got = urls.judge(df, [("block", "com/en/"), ("allow", "net/de/")]).collect()
    assert len(got) == 6 and {(r.t, r.i, r["__row"], r.gram, r.page_) for r in got} == {(1, 2, 3, "x", 4)}
    assert {r.page_id: r.verdict for r in got} == {**{i: "block" for i in range(5)}, 9: "allow"}
