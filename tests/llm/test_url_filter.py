import math
import re
from collections import defaultdict

from granary.llm import url_filter as M
from granary.llm.common import table


def brute(rows, bad, rules=M.RULES):
    seen = []
    for i, url in rows:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host = "".join(c.lower() if c.isascii() else c for c in m[1]) if m else ""
        path = m[2] if m else ""
        typed = re.sub("[0-9]+", "<n>", re.sub(r"(?i)(?<![0-9a-z])(?=[a-f]*[0-9])[0-9a-f]{8,}(?![0-9a-z])", "<h>", path))
        segs = tuple(re.sub("^/", "", typed).split("/"))
        fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        seen.append((i, host, path, segs, max(fit, default=(0, None, None))[1:]))
    count = defaultdict(lambda: [0, 0, 0])
    for i, host, _, segs, _ in seen:
        c = count[host, segs]
        c[0] += 1
        c[1] += i in bad
        c[2] += bad.get(i, 0)
    at = dict.fromkeys(count, "")
    for d in range(1, max((len(segs) for _, segs in count), default=0) + 1):
        cell = defaultdict(lambda: [0, 0, 0])
        for (host, segs), c in count.items():
            if len(segs) >= d:
                k = cell[host, at[host, segs], segs[d - 1], segs[d] if len(segs) > d else ""]
                for j in range(3):
                    k[j] += c[j]
        branch, pooled = defaultdict(lambda: [0, 0, 0]), defaultdict(int)
        for (h, a, s, x), c in cell.items():
            for j in range(3):
                branch[h, a, s][j] += c[j]
            pooled[h, a, x] += c[0]
        new = {}
        for (h, a, s), (bn, bl, bb) in branch.items():
            kids = [v for (h2, a2, _), v in branch.items() if (h2, a2) == (h, a)]
            pn, pl, pb = (sum(v[j] for v in kids) for j in range(3))
            kinds = [(x, n) for (h2, a2, x), n in pooled.items() if (h2, a2) == (h, a)]
            chi = sum((cell.get((h, a, s, x), [0])[0] - bn * n / pn) ** 2 / (bn * n / pn) for x, n in kinds)
            free, rate = len(kinds) - 1, pb / pl if pl else 0
            variable = len(kids) >= M.FANOUT and pn < M.VISITS * len(kids) and bn < M.VISITS
            apart = abs(bb - bl * rate) > 2 * math.sqrt(max(bl * rate * (1 - rate), 1))
            new[h, a, s] = "*" if variable or len(kids) > 1 and chi <= free + 2 * math.sqrt(2 * free) + 1e-9 and not apart else s
        for (h, segs), a in list(at.items()):
            if len(segs) >= d:
                at[h, segs] = a + "/" + new[h, a, segs[d - 1]]
    template = {k: k[0] + a for k, a in at.items()}
    rate = sum(c[2] for c in count.values()) / max(1, sum(c[1] for c in count.values()))
    stat = defaultdict(lambda: [0, 0])
    for k, c in count.items():
        stat[template[k]][0] += c[2]
        stat[template[k]][1] += c[1]
    out = []
    for i, host, path, segs, (rule, verdict) in seen:
        b, n = stat[template[host, segs]]
        p = (b + M.PRIOR * rate) / (n + M.PRIOR)
        out.append((i, host, path, rule, verdict or ("block" if p >= M.REJECT else "allow"), template[host, segs], round(p, 9)))
    return sorted(out, key=str)


def got(df):
    return sorted([(r.page_id, r.host, r.path, r.rule, r.verdict, r.template, round(r.purity, 9)) for r in df.collect()], key=str)


def test_pages_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    pages, labels = table(spark, d, "pages"), M.labels_of(table(spark, d, "labels"))
    bad = {r.page_id: r.bad for r in labels.collect()}
    assert got(M.judge(pages, labels)) == brute([(r.page_id, r.url) for r in pages.collect()], bad)


def test_trees_and_edges(spark):
    urls = [f"https://A.shop.io/item/{x}/view" for x in ("red", "blue", "green", "black", "white", "pink", "cyan", "gold", "grey")]
    urls += [f"http://a.shop.io/spam/{i}" for i in range(30)] + [f"http://a.shop.io/blog/{i}/x?y" for i in range(30)]
    urls += [
        "http://b.io/a/b/c/d/e/f/g", "http://b.io/deadbeef12/x", "nothing", None, "", "x://", "HTTP://EXAMPLE.COM/en/7?x",
        "http://xexample.com/en/1", "http://sub.example.net/de/81#a", "a://b.org/es/", "://q?r/s", "http://b.io/" + "long/" * 300
    ]
    urls += [f"http://deep.io/a/b/c/d/e/{x}/{i}" for i in range(12) for x in ("spam", "docs")]  # parted only at the sixth segment
    rows = list(enumerate(urls)) + [(3, urls[3]), (None, urls[4])]
    bad = {i: int("spam" in (u or "")) for i, u in rows if i is not None and i % 2}
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, rule string, template string")
    labels = spark.createDataFrame(list(bad.items()) + [(None, 1), (2, None)], "page_id long, bad int")
    out = got(M.judge(pages, labels))
    assert out == brute(rows, bad)
    assert any(r[5] == "a.shop.io/item/*/view" for r in out) and all(r[4] == "block" for r in out if "/spam/" in r[2])
    assert M.judge(pages.where("false"), labels).count() == 0 and M.judge(pages, labels.where("false")).where(
        "verdict = 'block' AND rule IS NULL"
    ).count() == 0
