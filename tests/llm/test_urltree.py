import re
from collections import defaultdict

from pyspark.sql import functions as F

from arborlake.llm import queries, urltree
from arborlake.llm.urltree import Rule, Tree

SF = "/root/testdata/sf0.001"


def slow_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split(r"[?#]", rest[len(host):])[0]


def slow_rule(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def slow_tree(rows, t):
    """rows: (host, path, bad or None); {(host, parts): (template, rejected)} by a walk over nested dictionaries."""
    def parts(path):
        out = [re.sub("[0-9]+", "#", s) for s in (path[1:] if path.startswith("/") else path).split("/")]
        return tuple(out[:t.depth] + ["**"] if len(out) > t.depth else out)

    def kind(p, at):
        return "end" if len(p) <= at + 1 else "number" if "#" in p[at + 1] else "word"

    named = {(h, parts(p)): "" for h, p, _ in rows}
    count = defaultdict(lambda: [0, 0, 0])
    for h, p, bad in rows:
        c = count[h, parts(p)]
        c[0], c[1], c[2] = c[0] + 1, c[1] + bool(bad), c[2] + (bad is not None)
    for at in range(max((len(p) for _, p in named), default=0)):
        nodes = defaultdict(lambda: defaultdict(list))
        for (h, p), template in named.items():
            if len(p) > at:
                nodes[h, template][p[at]].append((h, p))
        for (h, template), children in nodes.items():
            add = lambda keys: [sum(count[k][i] for k in keys) for i in range(3)]
            profile = lambda keys: {x: sum(count[k][0] for k in keys if kind(k[1], at) == x) / add(keys)[0] for x in ("end", "number", "word")}
            every = [k for keys in children.values() for k in keys]
            n, bad, known = add(every)
            rate, pooled = bad / max(known, 1), profile(every)
            rare, like = set(), set()
            for part, keys in children.items():
                m, b, k = add(keys)
                mine = profile(keys)
                away = sum(abs(mine[x] - pooled[x]) for x in pooled) / 2
                if k >= t.labels and known - k >= t.labels:
                    alike = abs(b / k - rate) <= t.deviation * ((rate * (1 - rate) / k) ** 0.5 + 1e-9)
                else:
                    alike = k < t.labels and known - k < t.labels
                if len(children) > t.children and m < t.share * n:
                    rare.add(part)
                elif "#" not in part and away <= t.distance and alike:
                    like.add(part)
            for part, keys in children.items():
                name = part.replace("#", "*") if "#" in part else "*" if part in rare or part in like and len(like) > 1 else part
                for k in keys:
                    named[k] = template + "/" + name
    total, known = sum(c[1] for c in count.values()), sum(c[2] for c in count.values())
    rate = total / known if known else 0.5
    stats = defaultdict(lambda: [0, 0])
    for (h, p), template in named.items():
        s = stats[h, template]
        s[0], s[1] = s[0] + count[h, p][1], s[1] + count[h, p][2]
    rejected = {k: (b + t.weight * rate) / (n + t.weight) >= t.purity and n >= t.labels for k, (b, n) in stats.items()}
    return {(h, p): (template, rejected[h, template]) for (h, p), template in named.items()}, parts


def expected(pages, rules, t=Tree()):
    rows = []
    for i, url in pages:
        host, path = slow_split(url)
        rows.append((i, host, path, slow_rule(host, path, rules)))
    tree, parts = slow_tree([(h, p, None if r is None else r.verdict == "block") for _, h, p, r in rows], t)
    return sorted((repr((i, h, p, r and r.text, r.verdict if r else "block" if tree[h, parts(p)][1] else "allow", tree[h, parts(p)][0]))
                   for i, h, p, r in rows))


def got(frame):
    return sorted(repr((r.page_id, r.host, r.path, r.rule, r.verdict, r.template)) for r in frame.collect())


def test_query_equals_brute_force(spark):
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    answer = queries.QUERIES["op10_url_filter"](spark, SF)
    assert answer.columns == ["page_id", "host", "path", "rule", "verdict"] and answer.count() == len(pages)
    assert got(urltree.judge(spark.read.parquet(f"{SF}/pages.parquet"), queries.RULES)) == expected(pages, queries.RULES)


def test_templates_with_labels(spark):
    urls = [f"http://a.b.com/shop/item{i}/view" for i in range(12)] + [f"http://a.b.com/spam/{w}" for w in "abcdefgh"]
    urls += [f"http://a.b.com/blog/{i % 3}/p-{i}.html" for i in range(9)] + [f"https://x.org/{w}/1" for w in ("de", "fr", "it")] * 3
    urls += [f"http://big.net/u/{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'abcdefghijk'[i // 26]}/x" for i in range(200)]
    urls += ["http://A.B.com", "nothing", None, "http://?q", "ftp://h#f", "http://deep.org/" + "/".join("abcdefghijklmn"), "x\n://y.com/a\nb?c"]
    pages = list(enumerate(urls))
    rules = (Rule("block", "com", "/spam/a"), Rule("block", "b.com", "/spam/b"), Rule("block", "com", "/spam/c"), Rule("block", "com", "/spam/d"),
             Rule("block", "com", "/spam/e"), Rule("allow", "com", "/shop/item1"), Rule("block", "net", "/u/a"))
    frame = spark.createDataFrame(pages, "page_id int, url string")
    answer = urltree.judge(frame, rules, t=Tree(share=0.05))
    assert got(answer) == expected(pages, rules, Tree(share=0.05))
    by = {r.page_id: r for r in answer.collect()}
    assert by[0].template == "/shop/item*/view" and by[29].template == "/*/*"
    unruled = [r for r in by.values() if r.path.startswith("/u/") and r.rule is None]
    assert {r.template for r in unruled} == {"/u/*/x"} and {r.verdict for r in unruled} == {"block"}


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "http://é.COM/Ä?", "y"), (3, "", None)],
                                  "page_id long, url string, host string").withColumn("parts", F.lit(1))
    rows = urltree.judge(pages, queries.RULES).collect()
    assert len(rows) == 4 and {(r.page_id, r.host, r.path, r.verdict) for r in rows} == {
        (1, "", "", "allow"), (None, "é.com", "/Ä", "allow"), (3, "", "", "allow")}
    assert urltree.judge(pages.limit(0), queries.RULES).count() == 0
