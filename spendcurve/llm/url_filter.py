"""URL filter: rules by host and path, and gradient-boosted trees over lexical features for the rest.

Native: features, histograms and scores are DataFrame expressions. The trees are trained on the URLs that
a rule judges. Rows with the same binned features are gathered first; every level of a tree then takes one
aggregation into (leaf, feature, bin) sums of gradients, of which there are a bounded number.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendcurve.llm.common import Stash, ascii_lower

TREES, DEPTH, BINS = 9, 3, 16
SHRINK, RIDGE = 0.3, 1.0
#: Parts that hosts are dealt into: a training URL's suffix rate comes from the hosts of the other parts.
FOLDS = 5
#: Every tree leaves out each feature whose number, added to the tree's, has this divisor, so that no feature decides alone.
LEFT_OUT = 3
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "hyphens", "digit_ratio", "entropy", "parameters", "has_fragment", "suffix_rate", "file_suffix",
    "segment_length", "segment_code",
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first ://, up to / ? # or the end, and then up to ? # or the end; both empty without ://."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The features but suffix_rate; every one is a number, 0 for a null url."""
    url = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    size = F.length(url)
    letters = F.split(url, "")
    share = F.aggregate(
        F.array_distinct(letters),
        F.lit(0.0),
        lambda s, c: s + (size - F.length(F.replace(url, c))) * F.log2(F.greatest(size - F.length(F.replace(url, c)), F.lit(1)).cast("double")),
    )
    segment = F.regexp_extract(path, "^/([^/]*)", 1)
    codes = F.aggregate(F.split(segment, ""), F.lit(0), lambda s, c: s + F.ascii(c))
    file = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)
    return {
        "url_length": size,
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": F.length(F.regexp_replace(path, "[^/]", "")),
        "labels": F.length(F.regexp_replace(host, r"[^.]", "")),
        "hyphens": F.length(F.regexp_replace(host, "[^-]", "")),
        "digit_ratio": F.when(size > 0, _count(url, "[0-9]") * 100 / size).otherwise(0),
        "entropy": F.when(size > 0, F.log2(size.cast("double")) - share / size).otherwise(0),
        "parameters": F.when(F.length(query) > 0, 1 + F.length(F.regexp_replace(query, "[^&]", ""))).otherwise(0),
        "has_fragment": F.contains(url, F.lit("#")).cast("int"),
        "segment_length": F.length(segment),
        "segment_code": F.when(F.length(segment) > 0, codes / F.length(segment)).otherwise(0),
        "file_suffix": F.when(F.length(file) > 0, 2).when(F.endswith(path, F.lit("/")), 1).otherwise(0),
    }


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits: its host or a subdomain of it, and a path that starts with its path; else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + start))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


@dataclass
class Tree:
    """Splits by node number (root 1, children 2n and 2n + 1) and leaf values; a bin over the split goes right."""

    splits: dict[int, tuple[str, int]]
    values: dict[int, float]

    def node(self, at: int = 1) -> Column:
        if at not in self.splits:
            return F.lit(at)
        name, edge = self.splits[at]
        return F.when(F.col(name) > edge, self.node(2 * at + 1)).otherwise(self.node(2 * at))

    def score(self, at: int = 1) -> Column:
        if at not in self.splits:
            return F.lit(self.values.get(at, 0.0))
        name, edge = self.splits[at]
        return F.when(F.col(name) > edge, self.score(2 * at + 1)).otherwise(self.score(2 * at))


def tree_features(number: int) -> list[str]:
    """The features that a tree may split on."""
    return [f for k, f in enumerate(FEATURES) if (k + number) % LEFT_OUT]


def _best_split(sums: dict[str, list[tuple[float, float]]], features: list[str]) -> tuple[float, str, int] | None:
    """The split of a leaf with the highest gain; ties go to the first feature and the lowest bin."""
    best = None
    for name in features:
        cells = sums.get(name)
        if not cells:
            continue
        g, h = sum(c[0] for c in cells), sum(c[1] for c in cells)
        left_g = left_h = 0.0
        for k in range(BINS - 1):
            left_g, left_h = left_g + cells[k][0], left_h + cells[k][1]
            if left_h < 1e-6 or h - left_h < 1e-6:
                continue
            gain = round(left_g**2 / (left_h + RIDGE) + (g - left_g) ** 2 / (h - left_h + RIDGE) - g**2 / (h + RIDGE), 6)
            if gain > 1e-3 and (best is None or gain > best[0]):
                best = (gain, name, k)
    return best


def train(binned: DataFrame) -> tuple[float, list[Tree]]:
    """Boost trees on rows (features' bins, blocked, n) with logistic loss; returns the prior log odds and the trees."""
    n, blocked = binned.agg(F.sum("n"), F.sum("blocked")).first()
    if not n:
        return -1.0, []
    prior = math.log((blocked + 1) / (n - blocked + 1))
    if blocked in (0, n):
        return prior, []
    trees: list[Tree] = []
    for number in range(TREES):
        features = tree_features(number)
        margin = F.lit(prior)
        for tree in trees:
            margin = margin + tree.score()
        chance = 1 / (1 + F.exp(-margin))
        table = binned.withColumn("g", F.col("blocked") - F.col("n") * chance).withColumn("h", F.col("n") * chance * (1 - chance))
        tree = Tree({}, {})
        for level in range(DEPTH):
            cells = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("bin")) for f in features])).alias("c")
            rows = table.select(tree.node().alias("leaf"), "g", "h", cells).groupBy("leaf", "c.f", "c.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            leaves: dict[int, dict[str, list[tuple[float, float]]]] = {}
            for r in rows:
                if r.leaf >= 2**level:
                    leaves.setdefault(r.leaf, {}).setdefault(r.f, [(0.0, 0.0)] * BINS)[r.bin] = (r.g, r.h)
            for leaf, sums in leaves.items():
                found = _best_split(sums, features)
                if not found:
                    g, h = (sum(c[k] for c in sums[features[0]]) for k in (0, 1))
                    tree.values[leaf] = -0.0 if h + RIDGE == 0 else SHRINK * g / (h + RIDGE)
                    continue
                _, name, edge = found
                tree.splits[leaf] = (name, edge)
                for child, cut in ((2 * leaf, sums[name][: edge + 1]), (2 * leaf + 1, sums[name][edge + 1 :])):
                    tree.values[child] = SHRINK * sum(c[0] for c in cut) / (sum(c[1] for c in cut) + RIDGE)
        if tree.splits:
            trees.append(tree)
    return prior, trees


def filter_urls(df: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url", hold_out: int | None = None) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, score (the trees' chance of block) and the host's fold.

    `rules` maps host/path to allow or block; a rule also fits subdomains and longer paths, the longest
    that fits wins, and where none does the trees decide: block over a chance of one half. All URLs that
    a rule fits are training rows, but those of the fold `hold_out`, on which the trees can then be measured.
    A training URL's suffix rate, the share of blocked URLs under its last label, is taken from other folds. A null url, or one without ://, has an empty host and path and is judged
    by the trees. Repeated rows are judged one by one; a null id stays null. Without training rows, or with
    one verdict among them, the prior decides; an empty table gives an empty result.
    """
    spark = df.sparkSession
    stash = Stash(spark, "urls")
    pages = df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{url_col}`").cast("string").alias("__url"))
    host, path = parts(F.col("__url"))
    cut = pages.select("*", host.alias("host"), path.alias("path"))
    cut = cut.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("__suffix", F.substring_index("host", ".", -1))
    verdicts = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair]) if rules else F.lit(None).cast("map<string,string>")
    cut = cut.withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int"))
    cut = cut.withColumn("__blocked", (verdicts[F.col("rule")] == "block").cast("int"))
    named = lexical(F.col("__url"), F.col("host"), F.col("path"))
    cut = stash.keep(cut.select("*", *[c.cast("double").alias(f"__{n}") for n, c in named.items()]), "features")

    labels = cut.filter("rule IS NOT NULL" if hold_out is None else f"rule IS NOT NULL AND fold <> {int(hold_out)}")
    # a rule's host ends the host of a URL that it fits, so there are no more suffixes here than rules
    counted = labels.groupBy("__suffix", "fold").agg(F.count("*").alias("n"), F.sum("__blocked").alias("b"))
    whole = F.struct(F.lit(-1).alias("fold"), F.sum("n").alias("n"), F.sum("b").alias("b"))
    totals = counted.groupBy("__suffix").agg(whole.alias("all"), F.collect_list(F.struct("fold", "n", "b")).alias("parts"))
    rate = lambda n, b: (b + 1) / (n + 2)
    others = F.transform("parts", lambda x: F.struct(x["fold"].alias("fold"), rate(F.col("all.n") - x["n"], F.col("all.b") - x["b"]).alias("rate")))
    rates = totals.select("__suffix", rate(F.col("all.n"), F.col("all.b")).alias("__whole"), F.map_from_entries(others).alias("__others"))
    trains = F.col("rule").isNotNull() if hold_out is None else F.col("rule").isNotNull() & (F.col("fold") != hold_out)
    own_rate = F.when(trains, F.col("__others")[F.col("fold")]).otherwise(F.col("__whole"))
    full = cut.join(F.broadcast(rates), "__suffix", "left").withColumn("__suffix_rate", F.coalesce(own_rate, F.lit(0.5)))
    marks = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    labelled = full.filter(trains)
    edges = labelled.agg(*[F.percentile_approx(f"__{f}", marks, 1000).alias(f) for f in FEATURES]).first()
    above = {f: sorted(set(edges[f] or [])) for f in FEATURES}

    def bins(f: str) -> Column:
        out = F.lit(0)
        for edge in above[f]:
            out = out + (F.col(f"__{f}") > edge).cast("int")
        return out.alias(f)

    table = labelled.select("__blocked", *[bins(f) for f in FEATURES]).groupBy(*FEATURES).agg(F.count("*").alias("n"), F.sum("__blocked").alias("blocked"))
    prior, trees = train(stash.keep(table, "binned"))
    margin = F.lit(prior)
    for tree in trees:
        margin = margin + tree.score()
    scored = full.select("__id", "host", "path", "rule", "fold", *[bins(f) for f in FEATURES]).withColumn("score", 1 / (1 + F.exp(-margin)))
    own = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    out = scored.withColumn("verdict", F.coalesce(verdicts[F.col("rule")], own))
    return out.select(F.col("__id").alias(id_col), "host", "path", "rule", "verdict", "score", "fold")
