"""URL filter: rules first, else the labelled purity of a url's path template in its host's template tree.

Each host has a tree of path segments.  A segment is variable by its form (runs of
digits, hexadecimal ids, over 64 characters) or by its count: a name that fewer than
``SUPPORT`` urls or less than 1 / ``FAN`` of its parent's urls carry becomes the
wildcard ``*``.  So a node keeps at most ``FAN`` named branches; those
whose urls go on alike and are labelled alike (a chi-square test of homogeneity, pooled
as branches join) are merged into one, such as ``(de|en)``.  Then the next level is
grown below the merged branches.  A template's purity is its share of bad among
its labelled urls, smoothed towards its parent's: (bad + WEIGHT * parent) / (labelled + WEIGHT),
from the share in the whole corpus down; at ``REJECT`` or more the template is blocked.

Scale: urls are counted by (host, path form) first, so a host with a third of all urls
is a few rows a task; each level is a count by (node, segment) and a join back.
A group that is handled in one piece is a node's named branches, at most ``FAN``.
A template names ``DEPTH`` segments; deeper paths share the open tail ``**``.

Input of ``judge``: ``page_id`` (bigint), ``url``; labelled urls: ``url``, ``bad`` (0 or 1).
Defined cases: a null url, or one without ``://``, has an empty host and path, which is a
host and a path like others; repeated urls and ids are judged row by row; no
labelled url: nothing is blocked but by a rule; an empty table gives no rows;
other columns are not read; ties between branches go by count, then by name.
"""

from __future__ import annotations

import math
import string

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm.common import stored

SUPPORT, FAN, DEPTH = 8, 64, 8
WEIGHT, REJECT = 10.0, 0.5
#: One in a hundred pairs of like branches is kept apart (normal quantile).
QUANTILE = 2.326

#: The rules of the query, fixed values: (host and path, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: What may follow a segment, by form.
FOLLOWS = ("end", "slash", "number", "id", "long", "mixed", "file", "word")


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*+([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; a rule fits its host and all subdomains (a short list: one CASE)."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, below = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + below))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def forms(path: Column, depth: int = DEPTH) -> Column:
    """The segments of a path, by form where that varies; after ``depth`` of them the open tail."""
    def form(s: Column) -> Column:
        return (F.when(F.length(s) > 64, "{long}").when(s.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$") & ~s.rlike(r"^[0-9]+$"), "{id}")
                .otherwise(F.regexp_replace(s, r"[0-9]+", "{n}")))

    cut = F.split(F.regexp_replace(path, r"^/", ""), "/", depth + 1)
    named = F.transform(F.slice(cut, 1, depth), form)
    named = F.when(F.size(cut) > depth, F.concat(named, F.array(F.lit("**")))).otherwise(named)
    return F.when(path == "", F.array().cast("array<string>")).otherwise(named)


def _follows(segment: Column) -> Column:
    return (F.when(segment.isNull(), "end").when(segment == "", "slash").when(segment == "{n}", "number").when(segment == "{id}", "id")
            .when(segment == "{long}", "long").when(F.contains(segment, F.lit("{n}")), "mixed").when(F.contains(segment, F.lit(".")), "file")
            .otherwise("word"))


def alike(a: list[float], b: list[float]) -> tuple[float, int]:
    """Chi-square of two rows of counts, and its degrees of freedom (columns held by either, less one)."""
    na, nb = sum(a), sum(b)
    held = [(x, y) for x, y in zip(a, b) if x + y]
    if not na or not nb or len(held) < 2:
        return 0.0, 0
    total = 0.0
    for x, y in held:
        ea, eb = (x + y) * na / (na + nb), (x + y) * nb / (na + nb)
        total += (x - ea) ** 2 / ea + (y - eb) ** 2 / eb
    return total, len(held) - 1


def similar(a: tuple, b: tuple) -> bool:
    """Whether two branches, each (what follows, labels) in counts, may be drawn from one."""
    (x, n), (y, m) = alike(a[0], b[0]), alike(a[1], b[1])
    df = n + m
    return not df or x + y <= df * (1 - 2 / (9 * df) + QUANTILE * math.sqrt(2 / (9 * df))) ** 3


def _merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The branches of one node, at most FAN: each joins the first earlier group that it is similar to."""
    rows = rows.sort_values(["n", "segment"], ascending=[False, True])
    groups: list[tuple[list, list, list]] = []
    for r in rows.itertuples(index=False):
        mine = ([float(getattr(r, c)) for c in FOLLOWS], [float(r.bad), float(r.labelled - r.bad)])
        group = next((g for g in groups if similar(g, mine)), None)
        if group is None:
            groups.append((*mine, [r.segment]))
        else:
            for total, more in zip(group, mine):
                total[:] = [t + x for t, x in zip(total, more)]
            group[2].append(r.segment)
    found = [(s, g[2][0] if len(g[2]) == 1 else f"({'|'.join(sorted(g[2]))})") for g in groups for s in g[2]]
    return pd.DataFrame([(*key, s, name) for s, name in found], columns=["host", "node", "segment", "branch"])


def templates(urls: DataFrame, labelled: DataFrame) -> DataFrame:
    """(host, form, template, purity): the template of every path form of ``urls`` (host, path), given labelled ones (host, path, bad)."""
    zero = F.lit(0).cast("bigint")
    seen = urls.select("host", forms(F.col("path")).alias("form"), F.lit(1).cast("bigint").alias("n"), zero.alias("labelled"), zero.alias("bad"))
    told = labelled.select("host", forms(F.col("path")).alias("form"), zero.alias("n"), F.lit(1).cast("bigint").alias("labelled"),
                           F.col("bad").cast("bigint").alias("bad"))
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
    paths = stored(seen.unionByName(told).groupBy("host", "form").agg(*sums), "url-forms")
    all_labelled, all_bad, levels = paths.agg(F.sum("labelled"), F.sum("bad"), F.max(F.size("form"))).first()
    prior = all_bad / all_labelled if all_labelled else 0.0

    def purity(parent: Column) -> Column:
        return (F.col("bad") + F.lit(WEIGHT) * parent) / (F.col("labelled") + F.lit(WEIGHT))

    hosts = paths.groupBy("host").agg(*sums).select("host", purity(F.lit(prior)).alias("purity"))
    at = stored(paths.join(hosts, "host").withColumn("node", F.lit("")), "url-level")
    for level in range(levels or 0):
        segment, after = F.get("form", F.lit(level)), F.get("form", F.lit(level + 1))
        live = at.filter(segment.isNotNull()).withColumn("segment", segment).withColumn("after", _follows(after))
        counts = live.groupBy("host", "node", "segment").agg(
            *sums, *(F.sum(F.when(F.col("after") == c, F.col("n")).otherwise(0)).alias(c) for c in FOLLOWS))
        totals = counts.groupBy("host", "node").agg(F.sum("n").alias("node_n"))
        named = counts.filter(F.col("n") >= SUPPORT).join(totals, ["host", "node"]).filter(F.col("n") * FAN >= F.col("node_n"))
        branches = named.drop("node_n").groupBy("host", "node").applyInPandas(
            _merge, "host string, node string, segment string, branch string")
        fixed = F.col("segment").isin("", "{n}", "{id}", "{long}", "**")   # variable by form already, or the path's end
        branch = F.coalesce("branch", F.when(fixed, F.col("segment")).otherwise("*"))
        grown = (at.withColumn("segment", segment).join(branches, ["host", "node", "segment"], "left")
                 .withColumn("node", F.when(F.col("segment").isNull(), F.col("node")).otherwise(F.concat("node", F.lit("/"), branch)))
                 .drop("branch"))
        grown = stored(grown, "url-grown")
        nodes = (grown.filter("segment IS NOT NULL").groupBy("host", "node").agg(*sums, F.first("purity").alias("above"))
                 .select("host", "node", purity(F.col("above")).alias("below")))
        at = stored(grown.join(nodes, ["host", "node"], "left")
                    .withColumn("purity", F.when(F.col("segment").isNotNull(), F.col("below")).otherwise(F.col("purity")))
                    .drop("segment", "below"), "url-level")
    return at.select("host", "form", F.col("node").alias("template"), "purity")


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, template, purity, verdict of every page."""
    host, path = parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    told = labelled.select(host.alias("host"), path.alias("path"), "bad").filter("bad IS NOT NULL")
    tree = templates(split, told)
    rule, says = matched_rule(F.col("host"), F.col("path"), rules)
    by_tree = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return (split.withColumn("form", forms(F.col("path"))).join(tree, ["host", "form"], "left")
            .select("page_id", "host", "path", rule.alias("rule"), "template", "purity", F.coalesce(says, by_tree).alias("verdict")))


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Stand-in for labelled urls: a page's label is that of the document whose number its path names last; bad: toxic or of low quality."""
    number = F.regexp_extract(parts(F.col("url"))[1], r"([0-9]{1,18})[^0-9]*$", 1)
    bad = F.greatest(1 - F.col("quality"), F.col("toxic"))
    named = pages.select("url", F.when(number != "", number).try_cast("bigint").alias("doc_id"))
    return named.join(labels.select("doc_id", bad.alias("bad")), "doc_id").select("url", "bad")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every url of pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(pages, labelled_urls(pages, labels))
