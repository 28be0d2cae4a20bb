import random
import re

from pyspark.sql import functions as F

from cladeframe.llm import link_trust as T

SCHEMA = "page_id long, url string, html string, host string, path string, verdict int, rule string, trust string, n long, a string, b string, share double"


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (fold(m[1]), m[2]) if m else ("", "")


def brute(pages, rules=T.RULES):
    read = [(page_id, *parts(url), html) for page_id, url, html in pages]
    fit = []
    for _, host, path, _ in read:
        fits = [(len(h + p), len(h), v == "block", v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        fit.append(max(fits)[3:] if fits else None)
    names = {h for _, h, _, _ in read if h}
    edges: dict = {}
    for _, host, _, html in read:
        for b in re.findall(T.LINK, html or ""):
            b = fold(b)
            if host and b != host:
                edges[host, b] = edges.get((host, b), 0) + 1
                names.add(b)
    chain = set(names)
    for name in names:
        labels = name.split(".")
        chain |= {".".join(labels[k:]) for k in range(len(labels) - 1)}
    for name in chain:
        labels = name.split(".")
        if len(labels) > 2 and not re.search(r"(^|\.)[0-9]*$", name) and ":" not in name:
            up = ".".join(labels[1:])
            edges[name, up] = edges.get((name, up), 0) + 1
            edges[up, name] = edges.get((up, name), 0) + 1

    def ranks(edges, verdict):
        own = {}
        for (_, host, _, _), f in zip(read, fit, strict=True):
            if host:
                own.setdefault(host, []).append(1.0 if f and f[0] == verdict else 0.0)
        now = {h: (sum(x) / len(x), 1.0) for h, x in own.items()}
        total = {}
        for (a, _), n in edges.items():
            total[a] = total.get(a, 0) + n
        whole = dict(now)
        for _ in range(T.STEPS):
            after = {}
            for (a, b), n in edges.items():
                if a in now:
                    x, y = after.get(b, (0.0, 0.0))
                    after[b] = x + T.DAMPING * n / total[a] * now[a][0], y + T.DAMPING * n / total[a] * now[a][1]
            now = after
            for b, (x, y) in now.items():
                p, q = whole.get(b, (0.0, 0.0))
                whole[b] = p + x, q + y
        return {h: x / y for h, (x, y) in whole.items()}

    trust, distrust = ranks(edges, "allow"), ranks({(b, a): n for (a, b), n in edges.items()}, "block")
    out = []
    for (page_id, host, path, _), f in zip(read, fit, strict=True):
        t, d = trust.get(host, 0.0), distrust.get(host, 0.0)
        bad = d >= T.THRESHOLD - T.SLACK and d > t + T.SLACK
        out.append((page_id, host, path, f[1] if f else None, f[0] if f else ("block" if bad else "allow"), round(t, 6), round(d, 6)))
    return out


def check(spark, pages, rules=T.RULES):
    table = spark.createDataFrame([(*p, "h", "p", 1, "r", "t", 1, "a", "b", 0.5) for p in pages], SCHEMA)
    got = T.judge(table, rules).select("page_id", "host", "path", "rule", "verdict", F.round("trust", 6), F.round("distrust", 6))
    order = lambda x: tuple((v is None, str(v)) for v in x)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(brute(pages, rules), key=order)


def linked(*urls):
    return "".join(f'<a class=x HREF = "{u}">t</a>' for u in urls)


ODD = [
    (1, None, None), (2, "", ""), (3, "no scheme/x", linked("http://a.com/")), (4, "http://", None), (5, "http://A.NET", "x"), (6, "http://a.net?x#y", None),
    (7, "HTTPS://User@M.Example.NET/en/x?q#f", None), (7, "HTTPS://User@M.Example.NET/en/x?q#f", None), (None, "ftp://example.com/de/", ""),
    (8, "http://example.com/de", None), (9, "http://xexample.com/de/a", None), (10, "http://10.0.0.1/fr/", linked("//b.org/z", "x://C.org:80")),
    (11, "a://b://c/d", None), (12, "http://org/fr/", None), (13, "http://www.org/fr/" + "é" * 20_000, "<p>" + "x" * 200_000), (14, "http://ÉA.org/fr/\n/x", None),
]


def test_rules_and_odd_urls(spark):
    check(spark, ODD)


def graph(rng):
    hosts = [f"{'www.' if k % 3 == 0 else ''}h{k}.{d}" for k, d in enumerate(["example.com", "example.net", "example.org", "shop.de"] * 8)]
    pages = []
    for k in range(300):
        host = hosts[0] if k % 3 == 0 else rng.choice(hosts)
        path = rng.choice(["/de/", "/en/", "/fr/", "", "/"]) + str(k)
        links = [rng.choice(["http:", "https:", ""]) + f"//{rng.choice(hosts[1::4] if 'shop' in host else hosts)}/p" for _ in range(rng.randrange(4))]
        pages.append((k, f"https://{host}{path}", linked("/own", *links) + '<img src=http://cdn.net/i.png>'))
    # a host all of whose links go to a blocked one that no other host links to
    return [*pages, (900, "http://hub.de/a", linked(*["http://worst.net/"] * 5)), (901, "http://hub.de/b", None), (902, "http://worst.net/", None)]


def test_trust_spreads_over_links(spark):
    pages = graph(random.Random(4))
    check(spark, pages)
    assert {v for *_, rule, v, _, _ in brute(pages) if rule is None} == {"allow", "block"}


def test_dealt_edges_and_pages_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(T, "DEALT", 3)
    monkeypatch.setattr(T, "SENT_HOSTS", 0)
    check(spark, graph(random.Random(5)) + ODD)


def test_no_pages(spark):
    check(spark, [])


def test_longest_rule_then_longest_host_then_block(spark):
    rules = [("allow", "b.c", "/de/"), ("block", "a.b.c", "/d"), ("allow", "x.y", "/"), ("block", "x.y", "/"), ("allow", "z", "")]
    check(spark, [(1, "http://a.b.c/de/", None), (2, "http://x.y/", None), (3, "http://q.z", None), (4, "http://b.c/de/1", None)], rules)
