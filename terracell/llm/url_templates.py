"""URL verdicts from rules and from a path-template tree per host (operator 5)."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

#: a segment value stays a branch of its own if at least one page in so many goes through it
FAN_OUT = 20
#: pages from which a segment value can be a branch of its own, and below which a branch is not split further
ENOUGH = 4
#: how much a page without a label counts towards the prior in a template with pooled values
UNLABELLED = 0.25
#: wild paths and segments of a host up to which its siblings merge in one task; beyond them the same merging runs level by level, parents apart
MERGED_PATHS, MERGED_DEPTH = 4000, 200

TEMPLATES = "host string, wild array<string>, template string, purity double, reject boolean"


@dataclass
class Node:
    """A branch of a host's tree: pages through it, labelled ones among them, the wild paths merged into it."""

    pages: int = 0
    bad: int = 0
    good: int = 0
    wilds: list[list[str]] = field(default_factory=list)
    children: dict[str, Node] = field(default_factory=dict)

    def add(self, wild: list[str], pages: int, bad: int, good: int) -> None:
        node = self
        for segment in [None, *wild]:
            node = node if segment is None else node.children.setdefault(segment, Node())
            node.pages += pages
            node.bad += bad
            node.good += good
        node.wilds.append(wild)

    def absorb(self, other: Node) -> None:
        self.pages += other.pages
        self.bad += other.bad
        self.good += other.good
        self.wilds += other.wilds
        for segment, child in other.children.items():
            if segment in self.children:
                self.children[segment].absorb(child)
            else:
                self.children[segment] = child

    def purity(self, prior: float, weight: float) -> float:
        """Share of bad ones among the labelled pages, as if `weight` more had been seen at the prior rate."""
        return (self.bad + weight * prior) / (self.bad + self.good + weight)

    def shares(self) -> dict[str, float]:
        """What part of the pages ends here or goes on through each child."""
        out = {segment: child.pages / max(1, self.pages) for segment, child in self.children.items()}
        out[""] = 1 - sum(out.values())
        return out

    def merge_children(self, distance: float, gap: float, prior: float, weight: float) -> None:
        """Bottom up, put siblings together whose continuations and labels look alike."""
        for child in self.children.values():
            child.merge_children(distance, gap, prior, weight)
        self.children = {"|".join(sorted(names)): node for names, node in self.groups(distance, gap, prior, weight)}

    def groups(self, distance: float, gap: float, prior: float, weight: float) -> list[tuple[list[str], Node]]:
        """The children, whose own are merged, as groups that look alike; those with most pages come first."""
        groups: list[tuple[list[str], Node]] = []
        for segment, child in sorted(self.children.items(), key=lambda x: (-x[1].pages, x[0])):
            for names, node in groups:
                a, b = node.shares(), child.shares()
                apart = sum(abs(a.get(k, 0) - b.get(k, 0)) for k in a.keys() | b.keys()) / 2
                if apart <= distance and abs(node.purity(prior, weight) - child.purity(prior, weight)) <= gap:
                    names.append(segment)
                    node.absorb(child)
                    break
            else:
                groups.append(([segment], child))
        return groups

    def templates(self, prefix: str = "") -> Iterable[tuple[str, Node]]:
        if self.wilds:
            yield prefix, self
        for segment, child in self.children.items():
            yield from child.templates(f"{prefix}/{segment}")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z in lower case) and path (up to ? or #); both empty without a ://."""
    found = F.locate("://", url) > 0
    rest = F.expr("substring(url, locate('://', url) + 3)")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.when(found, host).otherwise(""), F.when(found, path).otherwise("")


def rule_for(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (verdict, host, path) that fits the columns host and path, and its verdict; else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def shape(path: Column) -> Column:
    """Segments of a path with every run of digits as <n>."""
    segments = F.split(F.regexp_replace(F.regexp_replace(path, "^/", ""), "[0-9]+", "<n>"), "/", -1)
    return F.when(path == "", F.expr("cast(array() as array<string>)")).otherwise(segments)


def smoothed(prior: float, weight: Column | float) -> Column:
    """Node.purity of the columns bad and good."""
    return (F.col("bad") + weight * prior) / (F.col("bad") + F.col("good") + weight)


def wild_paths(shapes: DataFrame, fan_out: int, gap: float, prior: float, weight: float) -> DataFrame:
    """Adds `wild`: the segments, with the values of variable fields as *.

    Level by level, a value keeps its name if it holds at least 1/fan_out of the pages of its node, or has ENOUGH pages.
    A field is variable where the values with ENOUGH pages are more than fan_out and more than the pages each has on
    average; there, a value of less than 1/fan_out needs ENOUGH labelled pages and a smoothed share of bad ones that differs
    by more than `gap` from the node's. A branch is done when it has less than ENOUGH pages or a single shape: it keeps the
    segments that are left.
    """
    sums = [F.sum(c).alias(c) for c in ("pages", "bad", "good")]
    node = ["host", "prefix"]
    live = shapes.withColumn("prefix", F.expr("cast(array() as array<string>)"))
    done, k = [], 0
    while True:
        here = live.filter(F.size("shape") > k).withColumn("value", F.get("shape", F.lit(k)))
        values = here.groupBy(*node, "value").agg(*sums, F.count(F.lit(1)).alias("shapes"))
        totals = values.groupBy(*node).agg(
            F.sum("pages").alias("total"),
            F.sum("shapes").alias("all_shapes"),
            F.count_if(F.col("pages") >= ENOUGH).alias("distinct"),
            (F.sum("bad") + weight * prior).alias("node_bad"),
            (F.sum("bad") + F.sum("good") + weight).alias("node_labelled"),
        )
        variable = (F.col("distinct") > fan_out) & (F.col("distinct") * F.col("distinct") > F.col("total"))
        differs = F.abs(smoothed(prior, weight) - F.col("node_bad") / F.col("node_labelled")) > gap
        named = (F.col("pages") * fan_out >= F.col("total")) | (
            (F.col("pages") >= ENOUGH) & (~variable | ((F.col("bad") + F.col("good") >= ENOUGH) & differs))
        )
        stays = (F.col("total") < ENOUGH) | (F.col("all_shapes") == 1)
        kept = values.join(totals, node).select(*node, "value", named.alias("named"), stays.alias("stays")).filter("named or stays")
        going = here.join(kept, [*node, "value"], "left")
        name = F.when(F.col("named"), F.col("value")).otherwise("*")
        ended = F.coalesce("stays", F.lit(False))
        rest = F.slice("shape", k + 1, F.size("shape"))
        going = going.withColumn("prefix", F.concat("prefix", F.when(ended, rest).otherwise(F.array(name))))
        going = going.withColumn("over", ended | (F.size("shape") <= k + 1))
        over = live.filter(F.size("shape") <= k).withColumn("over", F.lit(True))
        level = keep(going.select(*over.columns).unionByName(over), "url-level")
        done.append(level.filter("over").drop("over"))
        live, k = level.filter("not over").drop("over"), k + 1
        if live.isEmpty():
            break
    return reduce(DataFrame.unionByName, done).withColumnRenamed("prefix", "wild")


def host_templates(rows: pd.DataFrame, distance: float, gap: float, prior: float, weight: float, limit: float) -> pd.DataFrame:
    """One host's merged tree; rows has at most MERGED_PATHS wild paths."""
    root = Node()
    for wild, pages, bad, good in zip(rows["wild"], rows["pages"], rows["bad"], rows["good"]):
        root.add(list(wild), int(pages), int(bad), int(good))
    root.merge_children(distance, gap, prior, weight)
    out = []
    for template, node in root.templates():
        pooled = any("*" in wild for wild in node.wilds)
        unlabelled = node.pages - node.bad - node.good
        purity = node.purity(prior, weight + UNLABELLED * unlabelled * pooled)
        out += [(rows["host"].iloc[0], wild, template, purity, purity >= limit) for wild in node.wilds]
    return pd.DataFrame(out, columns=["host", "wild", "template", "purity", "reject"])


def level_names(nodes: DataFrame, distance: float, gap: float, prior: float, weight: float) -> DataFrame:
    """host, parent, segment, name: what the merged tree calls each branch that has siblings on its level or below, as Node.merge_children does.

    Bottom up, one job a level from the lowest that branches. A group is the children of one parent with the pages of what goes on below each.
    """
    parent = F.slice("prefix", 1, F.size("prefix") - 1)
    below = nodes.filter(F.size("prefix") > 0).withColumns({"parent": parent, "segment": F.element_at("prefix", -1)})
    branching = below.groupBy("host", "parent").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    lowest = branching.agg(F.max(F.size("parent") + 1)).first()[0] or 0

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        siblings = Node()
        for segment, pages, bad, good, kids in zip(rows["segment"], rows["pages"], rows["bad"], rows["good"], rows["kids"]):
            on = {kid["name"]: Node(pages=int(kid["pages"])) for kid in (kids if kids is not None else [])}
            siblings.children[segment] = Node(int(pages), int(bad), int(good), children=on)
        host, above = rows["host"].iloc[0], list(rows["parent"].iloc[0])
        out = []
        for place, (names, node) in enumerate(siblings.groups(distance, gap, prior, weight)):
            name = "|".join(sorted(names))
            out += [(host, above, segment, name, place, node.pages) for segment in names]
        return pd.DataFrame(out, columns=["host", "parent", "segment", "name", "place", "pages"])

    def kids_of(named: DataFrame) -> DataFrame:
        """The groups of each parent in their order."""
        groups = named.select("host", "parent", "place", "name", "pages").distinct()
        kids = F.array_sort(F.collect_list(F.struct("place", "name", "pages"))).alias("kids")
        return groups.groupBy("host", "parent").agg(kids).withColumnRenamed("parent", "prefix")

    # below the lowest branching a node has one child at most
    only = below.filter(F.size("prefix") == lowest + 1).withColumns({"name": F.col("segment"), "place": F.lit(0)})
    kids, names = kids_of(only), []
    for k in range(lowest, 0, -1):
        level = below.filter(F.size("prefix") == k).join(kids, ["host", "prefix"], "left")
        merged = level.groupBy("host", "parent").applyInPandas(merge, "host string, parent array<string>, segment string, name string, place int, pages long")
        named = keep(merged, "url-names")
        names.append(named.select("host", "parent", "segment", "name"))
        kids = kids_of(named)
    none = below.select("host", "parent", "segment", F.col("segment").alias("name")).limit(0)
    return reduce(DataFrame.unionByName, names, none)


def large_templates(counts: DataFrame, distance: float, gap: float, prior: float, weight: float, limit: float) -> DataFrame:
    """host_templates of hosts of any size: no task holds more than the children of one branch."""
    sums = [F.sum(c).alias(c) for c in ("pages", "bad", "good")]

    def prefixes(path: str) -> Column:
        return F.explode(F.transform(F.sequence(F.lit(0), F.size(path)), lambda k: F.slice(path, 1, k))).alias("prefix")

    nodes = keep(counts.select("host", prefixes("wild"), "pages", "bad", "good").groupBy("host", "prefix").agg(*sums), "url-nodes")
    names = level_names(nodes, distance, gap, prior, weight)
    steps = counts.select("host", "wild", F.posexplode("wild").alias("k", "segment"))
    steps = steps.withColumn("parent", F.expr("slice(wild, 1, k)")).join(names, ["host", "parent", "segment"], "left")
    step = F.struct("k", F.coalesce("name", "segment").alias("name"))
    called = steps.groupBy("host", "wild").agg(F.array_sort(F.collect_list(step)).getField("name").alias("named"))
    empty = F.expr("cast(array() as array<string>)")
    paths = keep(counts.join(called, ["host", "wild"], "left").withColumn("named", F.coalesce("named", empty)), "url-named")
    through = paths.select("host", prefixes("named"), "pages", "bad", "good").groupBy("host", "prefix").agg(*sums)
    pooled = paths.groupBy("host", "named").agg(F.max(F.array_contains("wild", "*")).alias("pooled"))
    judged = pooled.join(through.withColumnRenamed("prefix", "named"), ["host", "named"])
    unlabelled = F.col("pages") - F.col("bad") - F.col("good")
    more = F.when(F.col("pooled"), UNLABELLED * unlabelled).otherwise(0.0)
    template = F.when(F.size("named") == 0, "").otherwise(F.concat(F.lit("/"), F.array_join("named", "/")))
    judged = judged.select("host", "named", template.alias("template"), smoothed(prior, F.lit(weight) + more).alias("purity"))
    return paths.select("host", "wild", "named").join(judged, ["host", "named"]).select(
        "host", "wild", "template", "purity", (F.col("purity") >= limit).alias("reject")
    )


def url_verdicts(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    fan_out: int = FAN_OUT,
    distance: float = 0.2,
    gap: float = 0.15,
    prior: float = 0.2,
    weight: float = 4.0,
    limit: float = 0.6,
) -> DataFrame:
    """Allow or block each url: by the longest rule that fits, else by the labelled purity of its path template.

    The pages that a rule decides are the labels (blocked: bad). Per host, paths form a tree over all of their segments: digits
    are generalised, rare values and those of variable fields become a wildcard (see wild_paths), and siblings merge whose continuations differ by at most `distance` in total
    variation and whose smoothed shares of bad pages differ by at most `gap`. A template is rejected when its smoothed share
    reaches `limit`. The share is smoothed towards a fixed prior and not towards the host's, since rules label only some branches of
    a host, and those say nothing about the others. In a template with a wildcard, each page without a label counts UNLABELLED
    towards the prior, so that a few labelled values do not decide about all that are pooled with them.

    Pages are counted per host and shape before anything is grouped; the tree grows in Spark by host and prefix, one job a level for as long as
    branches go on. Siblings of a host merge in one task if it has at most MERGED_PATHS wild paths of at most MERGED_DEPTH
    segments; in larger hosts they merge level by level in Spark (see level_names), with the same templates and shares.

    Returns page_id, host, path, rule (null where the template decides), verdict, template, purity (null where no host).

    A null url, or one without ://, has empty host and path, forms the template of the empty host and is allowed. Repeated
    pages count each and are judged each. An empty table gives no rows. Other columns are ignored.
    """
    parsed = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
    host, path = split_url(F.col("url"))
    parsed = parsed.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = rule_for(rules)
    parsed = parsed.withColumns({"rule": rule, "said": said, "shape": shape(F.col("path"))})
    shapes = parsed.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(F.col("said") == "block").alias("bad"),
        F.count_if(F.col("said") == "allow").alias("good"),
    )
    wild = wild_paths(shapes, fan_out, gap, prior, weight)
    counts = wild.groupBy("host", "wild").agg(F.sum("pages").alias("pages"), F.sum("bad").alias("bad"), F.sum("good").alias("good"))

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        return host_templates(rows, distance, gap, prior, weight, limit)

    counts = keep(counts, "url-wild-paths")
    hosts = counts.groupBy("host").agg(F.count(F.lit(1)).alias("paths"), F.max(F.size("wild")).alias("segments"))
    large = hosts.filter((F.col("paths") > MERGED_PATHS) | (F.col("segments") > MERGED_DEPTH)).select("host")
    large = keep(large, "url-large-hosts")
    merged = counts.join(large, "host", "left_anti").groupBy("host").applyInPandas(judge, TEMPLATES)
    if not large.isEmpty():
        merged = merged.unionByName(large_templates(counts.join(large, "host", "left_semi"), distance, gap, prior, weight, limit))
    judged = keep(merged, "url-templates")
    verdicts = wild.select("host", "shape", "wild").join(judged, ["host", "wild"]).select("host", "shape", "template", "purity", "reject")
    method = F.when(F.col("reject"), "block").otherwise("allow")
    return parsed.join(verdicts, ["host", "shape"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "template", "purity"
    )
