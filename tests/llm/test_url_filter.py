import random
import re
from collections import Counter, defaultdict

from emberlog.llm.url_filter import DAMPING, RULES, ROUNDS, judge_urls


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def brute(rows):
    """Rules, then dense PageRank, round for round."""
    judged, seeds, links = [], {0: Counter(), 1: Counter()}, Counter()
    for key, url, html in rows:
        host, path = parts(url)
        fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fit, key=lambda r: len(r.name)) if fit else None
        judged.append((key, host, path, rule))
        if rule and host:
            seeds[rule.verdict == "block"][host] += 1
        for to in re.findall(r"""href="(?:https?:)?//([^/?#"'\s>]+)""", html or ""):
            if host and to.lower() != host:
                links[host, to.lower()] += 1
    scores = {}
    for kind in (0, 1):
        edges = Counter({(b, a) if kind else (a, b): n for (a, b), n in links.items()})
        out = Counter()
        for (a, _), n in edges.items():
            out[a] += n
        rank = dict(seeds[kind])
        for _ in range(ROUNDS):
            new = defaultdict(float, {h: (1 - DAMPING) * m for h, m in seeds[kind].items()})
            for (a, b), n in edges.items():
                new[b] += DAMPING * rank.get(a, 0) * n / out[a]
            rank = new
        scores[kind] = rank
    verdict = lambda h: "block" if scores[1].get(h, 0) > scores[0].get(h, 0) else "allow"
    return Counter((k, h, p, r and r.name, r.verdict if r else verdict(h)) for k, h, p, r in judged)


def pages():
    rnd = random.Random(2)
    hosts = [f"{a}.{b}" for a in ("a", "b", "www.c", "d", "e") for b in ("net", "example.org", "com", "io", "xorg")]
    rows = []
    for i in range(300):
        host = rnd.choice(hosts)
        links = "".join(f'<a href="{rnd.choice(["https:", "http:", ""])}//{rnd.choice(hosts)}/x">' for _ in range(rnd.randrange(3)))
        rows.append((i, f"http://{host.title() if i % 2 else host}{rnd.choice(['/es/1', '/en/1x', '/en/2', '/fr/', '/de/9?a=/b', '', '?q#f', '#x', '/'])}", links + '<a href="/relative">'))
    return rows + [(900, None, None), (901, "no scheme", ""), (902, "http://", "<a href=//a.net>"), (902, "http://", "<a href=//a.net>"), (None, "x://ORG/", None), (903, "http://é.org:80/a://b", "")] + [(1000 + i, "http://hot.net/", '<a href="http://bad.com/">') for i in range(200)] + [(2000, "http://bad.com/de/", None)]


def test_against_brute_force(spark):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "'x' AS kind").repartition(3)
    got = judge_urls(df).collect()
    assert Counter(tuple(r)[:5] for r in got) == brute(rows)
    assert {r.verdict for r in got if r.host == "hot.net"} == {"block"}
    assert judge_urls(df.limit(0)).count() == 0


def test_without_links_seeds_decide(spark):
    rows = [(1, "http://a.com/fr/", ""), (2, "http://a.com/fr/2", ""), (3, "http://a.com/de/", ""), (4, "http://a.com/en/", ""), (5, "http://b.com/de/", ""), (6, "http://b.com/x", ""), (7, "http://c.com/x", "")]
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("com/fr/", "allow"), 2: ("com/fr/", "allow"), 3: ("com/de/", "block"), 4: (None, "allow"), 5: ("com/de/", "block"), 6: (None, "block"), 7: (None, "allow")}
