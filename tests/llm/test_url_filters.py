"""Rules and templates of addresses against plain code."""

import re
from collections import Counter, defaultdict

from newsloom.llm import queries, url_filters

RULES = ["org/", "example.org/es/", "example.org/en/1", "com/fr/", "com/de/"]
SAYS = dict(zip(RULES, ["allow", "block", "block", "allow", "block"], strict=True))


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def fitting(host, path):
    fit = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return max(fit, key=len, default=None)


def kind(segment):
    return "end" if segment is None else "empty" if segment == "" else "number" if segment == "#" else "deep" if segment == "**" else "numbered" if "#" in segment else "word"


def alike(one: Counter, two: Counter) -> bool:
    n, m = sum(one.values()), sum(two.values())
    if sum(abs(one[c] / n - two[c] / m) for c in one | two) / 2 <= 0.05:
        return True
    cells = [c for c in one | two if one[c] + two[c]]
    free = len(cells) - 1
    far = sum((one[c] * (m / n) ** 0.5 - two[c] * (n / m) ** 0.5) ** 2 / (one[c] + two[c]) for c in cells)
    return far <= free * (1 - 2 / (9 * free) + 3.09 * (2 / (9 * free)) ** 0.5) ** 3


def brute(rows, given=None):
    """(page_id, host, path, rule, verdict, template, purity) by a tree in memory, host by host."""
    pages = []
    for n, (i, url) in enumerate(rows):
        host, path = parts(url)
        rule = fitting(host, path)
        segments = re.sub("[0-9]+", "#", path).split("/")[1:]
        segments = [*segments[:4], "**"] if len(segments) > 4 else segments
        pages.append({"id": i, "host": host, "path": path, "rule": rule, "label": SAYS.get(rule) or (given[n] if given else None), "segments": segments, "template": ""})
    for level in range(5):
        nodes = defaultdict(list)
        for p in pages:
            if len(p["segments"]) > level:
                nodes[p["host"], p["template"]].append(p)
        for own in nodes.values():
            profile = defaultdict(Counter)
            for p in own:
                after = p["segments"][level + 1] if len(p["segments"]) > level + 1 else None
                profile[p["segments"][level]][kind(after), p["label"]] += 1
            size = {s: sum(c.values()) for s, c in profile.items()}
            named = sorted((s for s in size if size[s] >= 20 and size[s] >= 0.05 * len(own)), key=lambda s: (-size[s], s))
            rest = sum((profile[s] for s in size if s not in named), Counter())
            groups = [[[None], rest]] if rest else []
            for s in named:
                for g in groups:
                    if alike(profile[s], g[1]):
                        g[0].append(s)
                        g[1] = g[1] + profile[s]
                        break
                else:
                    groups.append([[s], profile[s]])
            name = {}
            for members, _ in groups:
                title = "*" if members[0] is None else "|".join(sorted(members))
                name |= dict.fromkeys(members, title)
            for p in own:
                p["template"] += "/" + name.get(p["segments"][level], "*")
    total = Counter(p["label"] for p in pages)
    every = (total["block"] + 1) / (total["block"] + total["allow"] + 2)
    hosts, templates = defaultdict(Counter), defaultdict(Counter)
    for p in pages:
        hosts[p["host"]][p["label"]] += 1
        templates[p["host"], p["template"]][p["label"]] += 1
    drawn = lambda c, prior: (c["block"] + 5 * prior) / (c["block"] + c["allow"] + 5)
    out = []
    for p in pages:
        purity = drawn(templates[p["host"], p["template"]], drawn(hosts[p["host"]], every))
        out.append((p["id"], p["host"], p["path"], p["rule"], SAYS.get(p["rule"]) or ("block" if purity >= 0.8 else "allow"), p["template"], round(purity, 9)))
    return sorted(out, key=str)


def judged(spark, rows, given=None):
    if given:
        df = spark.createDataFrame([(*r, g) for r, g in zip(rows, given, strict=True)], "page_id long, url string, says string")
    else:
        df = spark.createDataFrame(rows, "page_id long, url string")
    out = url_filters.judge(df, label_col="says" if given else None)
    return sorted(((*r[:-1], round(r[-1], 9)) for r in out.collect()), key=str)


def test_odd_addresses(spark):
    urls = [
        None, "", "no scheme", "http://", "://", "http://ORG/", "http://a.Example.ORG/es/1", "https://example.org/en/123?x=1", "https://example.org/en/23", "http://notexample.org/es/",
        "http://badorg/x", "http://x.com/fr/", "http://x.com/fr", "http://x.com/de/a?b=http://y.org/", "http://x.com?q=/de/", "http://x.com#/fr/", "http://com/de/", "a://b://c.org/d", "http://x.org",
        "http://u@x.org:80/a", "http://Ünï.org/É", "http://x.net/a\nb/c", "http://x.net/" + "a/" * 5000, "http://x.net/" + "9" * 100_000, "http://x.net//", "http://x.net/%41*|/", "http://x.com/de/1", "http://x.com/de/1",
    ]
    rows = list(enumerate(urls)) + [(None, "http://x.org/"), (3, "http://x.org/a")]
    assert judged(spark, rows) == brute(rows)


def test_whole_table_equals_the_tree_in_memory(spark):
    at = "/root/testdata/sf0.1"
    rows = [(r.page_id, r.url) for r in spark.read.parquet(f"{at}/pages.parquet").collect()]
    got = sorted(((*r[:-1], round(r[-1], 9)) for r in queries.op13_url_filters(spark, at).collect()), key=str)
    assert got == brute(rows)


def test_templates_reject_their_unlabelled_pages(spark):
    rows, given, want = [], [], {}
    for n in range(1500):
        spam, page = n % 3 == 0, f"{n * 7919 % 100_003}"
        url = f"http://shop.net/tag/{'abcdefgh'[n % 8] * (n % 11 + 1)}{page}x/buy" if spam else f"http://shop.net/news/{page}.html"
        rows.append((n, url))
        given.append(None if n % 5 == 0 else "block" if spam else "allow")
        want[n] = "block" if spam else "allow"
    got = judged(spark, rows, given)
    assert got == brute(rows, given)
    assert {r[0]: r[4] for r in got} == want
    assert {r[5] for r in got} == {"/tag/*/buy", "/news/#.html"}


def test_alike_branches_are_one_and_others_are_not(spark):
    rows, given = [], []
    for n in range(900):
        section = ("red", "blue", "ads")[n % 3]
        rows.append((n, f"http://a.net/{section}/{n}"))
        given.append("block" if section == "ads" else "allow" if n % 2 else None)
    got = judged(spark, rows, given)
    assert got == brute(rows, given)
    assert {r[5] for r in got} == {"/blue|red/#", "/ads/#"}


def test_hot_paths_and_an_empty_table(spark):
    rows = [(n, "http://hot.com/de/1") for n in range(400)] + [(1000 + n, f"http://h{n}.net/{'abcdefghij'[n % 10]}/{n}") for n in range(300)]
    assert judged(spark, rows) == brute(rows)
    assert judged(spark, []) == []


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://x.org/a", "h", "p", "l")], "page_id long, url string, host string, path string, label string")
    assert url_filters.judge(df).collect()[0][:5] == (1, "x.org", "/a", "org/", "allow")


def test_names_that_look_like_templates(spark):
    rows = [(n, f"http://{'abcd'[n % 4]}.net/{('', '*', 'a|b', '%2A')[n % 4]}/x{n}") for n in range(200)]
    assert {r[5] for r in judged(spark, rows)} == {"//x#", "/%2A/x#", "/a%7Cb/x#", "/%25#A/x#"}
