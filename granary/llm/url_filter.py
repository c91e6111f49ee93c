"""URL filtering by rules and by path-template trees, with DataFrame functions only.

Each host has a tree of path segments. A segment's runs of digits and long hexadecimal runs are typed
(`<n>`, `<h>`). From the root down the children of each node are generalised:
a node with at least `FANOUT` children that are met fewer than `VISITS` times each on average is variable, and its rare
children become `*`; and sibling branches whose next segments and whose labelled shares do not differ
statistically from their siblings' together (chi-square, two standard deviations) merge into `*`. The tree grows as deep as
some node has two paths or more; what is left of a single path is taken as it is.
A template (host and generalised path) is rejected if its share of bad labels, smoothed by `PRIOR`
labels at the whole table's share, reaches `REJECT`.

Rules come first: a rule (host, path) fits its host and all subdomains if the url's path starts with its
path; of several the longest text wins. The host of a url is what follows its first `://` up to `/`, `?`, `#` or the end, A-Z
lower-cased; the path goes on to `?`, `#` or the end. A null url or one without `://` has neither (empty strings), and
is judged as the template of the empty host.

The tree is built on counts of (host, typed path), never on pages. Sums of a node are made by partial aggregation and written
before they are joined, so the paths of one very large host are dealt to many tasks where they meet them. Repeated rows each get
their row, null page_ids have no label, an empty table gives no rows, extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, settled

FANOUT, VISITS, PRIOR, REJECT = 8, 3.0, 4.0, 0.5
#: (verdict, host, path)
RULES = (
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"),
    ("block", "org", "/es/")
)

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def typed_segments(path: Column) -> Column:
    """The path's segments with typed runs."""
    typed = F.regexp_replace(F.regexp_replace(path, r"(?i)(?<![0-9a-z])(?=[a-f]*[0-9])[0-9a-f]{8,}(?![0-9a-z])", "<h>"), "[0-9]+", "<n>")
    return F.split(F.regexp_replace(typed, "^/", ""), "/")


def _differs(bad: Column, n: Column, rate: Column) -> Column:
    """Whether bad of n labels is further than two standard deviations from the rate."""
    return F.abs(bad - n * rate) > 2 * F.sqrt(F.greatest(n * rate * (1 - rate), F.lit(1.0)))


def templates(paths: DataFrame) -> DataFrame:
    """paths: host, segs, n, labels, bad, one row for each host and segs. Adds template."""
    sums = lambda *p: [F.sum(c).alias(p[0] + s) for c, s in (("n", "n"), ("labels", "l"), ("bad", "b"))]
    rest = lambda depth: F.array_join(F.slice("segs", depth, F.greatest(F.size("segs"), F.lit(1))), "/")
    node, done, depth = paths.withColumn("at", F.lit("")), None, 0
    while True:
        depth += 1
        # nodes of one path are leaves: the rest of the path is its template
        alone = settled(node.groupBy("host", "at").agg(F.count("*").alias("__paths")), "url-nodes")
        deep = (F.col("__paths") > 1) & (F.size("segs") >= depth)
        node = settled(node.join(alone, ["host", "at"]).withColumn("__deep", deep).drop("__paths"), "url-parted")
        tail = F.when(F.size("segs") >= depth, F.concat(F.lit("/"), rest(depth))).otherwise(F.lit(""))
        ended = node.where("NOT __deep").select(*paths.columns, F.concat("at", tail).alias("at"))
        done = ended if done is None else done.unionByName(ended)
        step = {"seg": F.get("segs", F.lit(depth - 1)), "next": F.coalesce(F.get("segs", F.lit(depth)), F.lit(""))}
        grown = node.where("__deep").drop("__deep").withColumns(step)
        if grown.isEmpty():
            return done.withColumn("template", F.concat("host", "at")).drop("at")
        cells = settled(
            grown.groupBy("host", "at", "seg", "next").agg(*sums("")), "url-cells"
        ).toDF("host", "at", "seg", "next", "n", "labels", "bad")
        branch = settled(cells.groupBy("host", "at", "seg").agg(*sums("b")), "url-branches")
        pooled = settled(cells.groupBy("host", "at", "next").agg(F.sum("n").alias("cn")), "url-pooled")
        kinds = pooled.groupBy("host", "at").agg(F.count("*").alias("kinds"))
        parent = branch.groupBy("host", "at").agg(F.count("*").alias("kids"), *(F.sum("b" + c).alias("p" + c) for c in "nlb"))
        parent = settled(parent.join(kinds, ["host", "at"]), "url-parents")
        # chi-square of each branch's next segments against its siblings together; unseen segments add their expectation
        met = cells.join(pooled, ["host", "at", "next"]).join(branch, ["host", "at", "seg"]).join(parent, ["host", "at"])
        expected = F.col("bn") * F.col("cn") / F.col("pn")
        chi = met.groupBy("host", "at", "seg").agg((F.sum(F.pow(F.col("n") - expected, 2) / expected - expected) + F.first("bn")).alias("chi"))
        judged = chi.join(branch, ["host", "at", "seg"]).join(parent, ["host", "at"])
        free = F.col("kinds") - 1
        variable = (F.col("kids") >= FANOUT) & (F.col("pn") < VISITS * F.col("kids")) & (F.col("bn") < VISITS)
        usual = ~_differs(F.col("bb"), F.col("bl"), F.coalesce(F.try_divide("pb", "pl"), F.lit(0.0)))
        similar = (F.col("kids") > 1) & (F.col("chi") <= free + 2 * F.sqrt(2 * free)) & usual
        judged = settled(judged.select("host", "at", "seg", F.when(variable | similar, F.lit("*")).otherwise(F.col("seg")).alias("as")), "url-judged")
        node = settled(
            grown.join(judged, ["host", "at", "seg"]).select(*paths.columns, F.concat("at", F.lit("/"), "as").alias("at")),
            f"url-depth-{depth}"
        )
        discard(alone, cells, branch, pooled, parent, judged)


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity. labels: page_id, bad (0 or 1)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("segs", typed_segments(F.col("path")))
    own = labels.where("bad IN (0, 1)").groupBy(F.col("page_id").cast("long").alias("__id")).agg(F.max("bad").alias("bad"))
    labelled = rows.join(own, rows["page_id"] == own["__id"], "left")
    paths = labelled.groupBy("host", "segs").agg(
        F.count("*").alias("n"), F.count("bad").alias("labels"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    paths = settled(paths, "url-paths")
    total = paths.agg(F.sum("bad"), F.sum("labels")).first()
    rate = total[0] / total[1] if total[1] else 0.0
    tree = templates(paths)
    purity = tree.groupBy("template").agg(F.sum("bad").alias("tb"), F.sum("labels").alias("tl"))
    purity = purity.select("template", ((F.col("tb") + PRIOR * rate) / (F.col("tl") + PRIOR)).alias("purity"))
    # one row for each host and typed path: Spark broadcasts it only below its own size threshold
    known = tree.select("host", "segs", "template").join(purity, "template")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    return (
        rows.join(known, ["host", "segs"], "left").withColumn("__rule", rule).select(
            "page_id", "host", "path", F.col("__rule.rule").alias("rule"),
            F.coalesce(F.col("__rule.verdict"), F.when(F.col("purity") >= REJECT, "block").otherwise("allow")).alias("verdict"), "template",
            "purity"
        )
    )


def labels_of(quality: DataFrame) -> DataFrame:
    """The table of document labels as page labels: quality 0 is bad."""
    return quality.select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).cast("int").alias("bad"))
