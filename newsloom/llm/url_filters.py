"""Filters of addresses: given rules, and a tree of path templates that is learnt for each host.

Rules name a host with its subdomains and the beginning of a path. Addresses that a rule fits are labelled by it, and
these labels judge the templates of all others.

Paths are counted by host and shape (digits as one sign) before anything else, so a hot host or path is as many rows as
it has shapes. The tree grows by levels, all hosts at once. Of a node's branches those with a fair share of its pages
keep their names; the others are variable and become one wildcard, so a node has a bounded number of branches. Branches
of a node whose pages cannot be told apart - by the kinds of what follows and by their labels - become one. A template
is then rejected by the share of blocked pages among its labelled ones, drawn towards that of its host, and the host's
towards that of all.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.text import lower_ascii
from newsloom.storage import materialize

ALLOW, BLOCK = "allow", "block"
#: The rules of the query: verdict, and host with the beginning of the path.
RULES = ((ALLOW, "org/"), (BLOCK, "example.org/es/"), (BLOCK, "example.org/en/1"), (ALLOW, "com/fr/"), (BLOCK, "com/de/"))
#: Segments that are told apart; what is deeper is one segment.
DEPTH = 4
#: A branch keeps its name with so many pages and such a share of its node's; a node has 20 named branches at most.
MIN_PAGES, MIN_SHARE = 20, 0.05
#: Branches are alike if their profiles differ by such a share at most, or by no more than chance: a normal deviate.
TOLERANCE, DEVIATE = 0.05, 3.09
#: So many labelled pages weigh as much as what is known of the host; a template is rejected from such a share.
STRENGTH, REJECT = 5.0, 0.8
#: Shapes with a thousandth of all pages go back to the pages by broadcast: a thousand rows at most.
HOT = 1000
#: What can follow a segment.
KINDS = ("end", "empty", "number", "numbered", "word", "deep")
DEEP, ANY = "**", "*"


def address(url: Column) -> tuple[Column, Column]:
    """Host and path. No address or no ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    part = lambda pattern: F.coalesce(F.regexp_extract(rest, pattern, 1), F.lit(""))
    return lower_ascii(part(r"^([^/?#]*)")), part(r"^[^/?#]*([^?#]*)")


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. Of equally long ones, those that block first.

    Rules are a short list that becomes part of the plan.
    """
    name = verdict = F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == BLOCK, r[1])):
        at, begin = rule.split("/", 1)
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + begin)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def shape_of(path: Column) -> Column:
    """The path with digits as ``#``, and all from the fifth segment on as ``**``."""
    parts = F.split(F.regexp_replace(path, "[0-9]+", "#"), "/")
    cut = F.concat(F.slice(parts, 1, DEPTH + 1), F.array(F.lit(DEEP)))
    return F.array_join(F.when(F.size(parts) > DEPTH + 1, cut).otherwise(parts), "/")


def _kind(segment: Column) -> Column:
    """The place in KINDS of a segment, null at the end."""
    cases = ((segment.isNull(), 0), (segment == "", 1), (segment == "#", 2), (segment == DEEP, 5), (segment.contains("#"), 3))
    out = F.lit(4)
    for case, value in reversed(cases):
        out = F.when(case, value).otherwise(out)
    return out


def alike(one: np.ndarray, two: np.ndarray) -> bool:
    """Whether two profiles of counts differ by TOLERANCE of the pages at most, or by no more than chance."""
    n, m = one.sum(), two.sum()
    if np.abs(one / n - two / m).sum() / 2 <= TOLERANCE:
        return True
    both = one + two
    seen = both > 0
    free = int(seen.sum()) - 1
    a, b = one[seen], two[seen]
    distance = ((a * math.sqrt(m / n) - b * math.sqrt(n / m)) ** 2 / both[seen]).sum()
    return bool(distance <= free * (1 - 2 / (9 * free) + DEVIATE * math.sqrt(2 / (9 * free))) ** 3)


def merged(names: list[str], profiles: np.ndarray, rest: np.ndarray) -> list[str]:
    """The names that branches of one node go by; ``rest`` is the profile of its variable segments.

    The variable segments are the first group. By falling number of pages, then by name, each branch joins the first
    group whose profile so far is like its own, or starts one.
    """
    groups: list[tuple[list[str], np.ndarray]] = [([ANY], rest)] if rest.sum() else []
    of = {}
    for i in sorted(range(len(names)), key=lambda i: (-profiles[i].sum(), names[i])):
        at = next((g for g, (_, total) in enumerate(groups) if alike(profiles[i], total)), len(groups))
        if at == len(groups):
            groups.append(([], np.zeros_like(rest)))
        groups[at] = ([*groups[at][0], names[i]], groups[at][1] + profiles[i])
        of[i] = at
    plain = lambda s: s.replace("%", "%25").replace("|", "%7C").replace("*", "%2A") if s != DEEP else s
    title = [ANY if members[0] == ANY and rest.sum() and g == 0 else "|".join(sorted(map(plain, members))) for g, (members, _) in enumerate(groups)]
    return [title[of[i]] for i in range(len(names))]


def _name(nodes: DataFrame) -> DataFrame:
    """``(host, template, segment, name)`` of the named branches of each node, a node being one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for row in batch.to_pylist():
                profiles = np.array([b["profile"] for b in row["branches"]], float)
                names = [b["segment"] for b in row["branches"]]
                rest = np.array(row["profile"], float) - profiles.sum(axis=0)
                for segment, name in zip(names, merged(names, profiles, rest), strict=True):
                    for column, value in zip(out, (row["host"], row["template"], segment, name), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], ["host", "template", "segment", "name"])

    return nodes.mapInArrow(run, "host string, template string, segment string, name string")


def _level(paths: DataFrame, level: int) -> DataFrame:
    """The paths with the name of their segment at a level added to their template."""
    segment, after = F.get("segments", F.lit(level)), F.get("segments", F.lit(level + 1))
    cells = [F.sum(F.when(_kind(after) == k, F.col(c)).otherwise(0)) for k in range(len(KINDS)) for c in ("allowed", "blocked", "unlabelled")]
    totals = [c.alias(f"c{i}") for i, c in enumerate(cells)]
    profile = F.array(*[f"c{i}" for i in range(len(cells))])
    live = paths.where(segment.isNotNull()).withColumn("segment", segment)
    branches = live.groupBy("host", "template", "segment").agg(F.sum("n").alias("n"), *totals)
    whole = branches.groupBy("host", "template").agg(F.sum("n").alias("all"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(cells))])
    whole = whole.select("host", "template", "all", profile.alias("profile"))
    frequent = branches.where(F.col("n") >= MIN_PAGES).select("host", "template", "segment", "n", profile.alias("own"))
    named = frequent.join(whole, ["host", "template"]).where(F.col("n") >= MIN_SHARE * F.col("all"))
    # A node has 1 / MIN_SHARE such branches at most.
    nodes = named.groupBy("host", "template").agg(F.first("profile").alias("profile"), F.collect_list(F.struct("segment", F.col("own").alias("profile"))).alias("branches"))
    name = materialize(_name(nodes), "branches", free=False)
    found = paths.withColumn("segment", segment).join(name, ["host", "template", "segment"], "left")
    grown = F.when(F.col("segment").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), F.coalesce("name", F.lit(ANY))))
    return materialize(found.select("host", "shape", "segments", "n", "allowed", "blocked", "unlabelled", grown.alias("template")), "paths", free=False)


def learn(pages: DataFrame) -> DataFrame:
    """``(host, shape, n, template, purity, learnt)`` for pages of ``(host, path, label)``, a label being a verdict or null.

    ``purity`` is the smoothed share of blocked pages among the labelled ones of the template.
    """
    count = lambda says: F.count(F.when(F.col("label") == says, 1))
    paths = pages.groupBy("host", shape_of(F.col("path")).alias("shape")).agg(F.count("*").alias("n"), count(ALLOW).alias("allowed"), count(BLOCK).alias("blocked"))
    paths = paths.withColumn("unlabelled", F.col("n") - F.col("allowed") - F.col("blocked")).withColumn("template", F.lit(""))
    split = F.split("shape", "/")
    paths = materialize(paths.withColumn("segments", F.slice(split, F.lit(2), F.greatest(F.size(split) - 1, F.lit(0)))), "paths")
    for level in range(paths.agg(F.max(F.size("segments"))).first()[0] or 0):
        paths = _level(paths, level)
    sums = [F.sum(c).alias(c) for c in ("allowed", "blocked")]
    drawn = lambda prior: (F.col("blocked") + STRENGTH * prior) / (F.col("allowed") + F.col("blocked") + STRENGTH)
    every = paths.agg(*sums).select(F.coalesce((F.col("blocked") + 1) / (F.col("allowed") + F.col("blocked") + 2), F.lit(0.5)).alias("every"))
    hosts = paths.groupBy("host").agg(*sums).crossJoin(F.broadcast(every)).select("host", drawn(F.col("every")).alias("of_host"))  # one row
    templates = paths.groupBy("host", "template").agg(*sums).join(hosts, "host").select("host", "template", drawn(F.col("of_host")).alias("purity"))
    judged = paths.select("host", "shape", "n", "template").join(templates, ["host", "template"])
    return judged.withColumn("learnt", F.when(F.col("purity") >= REJECT, BLOCK).otherwise(ALLOW))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, label_col: str | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict, template, purity)`` of every row.

    The verdict is the rule's, else that of the address's template. ``label_col`` (``allow``, ``block`` or null) labels
    further pages for the templates. A null address, or one without ``://``, has an empty host and path, and they have
    a template of their own. Rows that repeat count each and are each returned. Other columns are not read. No rows: an
    empty result.
    """
    host, path = address(F.col(url_col))
    given = F.col(label_col).cast("string") if label_col else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), given.alias("given"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), says.alias("says"), shape_of(F.col("path")).alias("shape"), F.coalesce(says, "given").alias("label"))
    learnt = materialize(learn(rows.select("host", "path", "label")), "templates")
    total = learnt.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(learnt.where(F.col("n") >= max(2, -(-total // HOT))))
    cold = rows.join(hot, ["host", "shape"], "left_anti").join(learnt, ["host", "shape"])
    both = rows.join(hot, ["host", "shape"]).unionByName(cold)
    return both.select("page_id", "host", "path", "rule", F.coalesce("says", "learnt").alias("verdict"), "template", "purity")
