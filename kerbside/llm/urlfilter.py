"""URL filters: rules, and gradient-boosted trees on lexical features for urls that no rule fits.

Everything over rows is a built-in expression, an aggregate or a join. Features are binned to a few levels each, so all
labelled urls reduce, in one aggregate with map-side combine, to at most the product of the levels: CELLS rows of counts
that do not grow with the data. Boosting is exact on those counts and runs on the driver; the trees are then written as
one CASE expression, so scoring is a projection. Labelled urls are those that a rule fits. A labelled url's suffix share
comes from the labelled urls of the other folds (crc32 of the url modulo FOLDS), so the trees never see a url's own label;
held_out() learns without a fold and measures on it.

Scale: one scan for suffix statistics (an aggregate by suffix), one for the cells, one for scoring; no url is shuffled but
for the join with the suffix table, which is equi-join on the suffix (adaptive execution splits a suffix with many urls,
and broadcasts the table only if its measured size is below Spark's threshold).

Defined cases: null, empty or scheme-less url: empty host and path, no rule, judged by the trees; repeated rows are judged
alike; ties between rules: the longer, then the alphabetically first; other columns are ignored; without labelled urls the
trees are empty and every other url is allowed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: (host, path prefix, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Upper bounds of each feature's levels; a value above the last is in one level more.
LEVELS = {
    "length": (24, 32, 40, 48, 64),
    "depth": (1, 2, 4),
    "digit_ratio": (0.02, 0.1, 0.2),
    "entropy": (3.6, 4.0, 4.3),
    "params": (0, 1),
    "suffix_block": (0.2, 0.4, 0.6, 0.8),
}
CELLS = math.prod(len(v) + 1 for v in LEVELS.values())
ROUNDS, DEPTH, RATE, L2 = 12, 3, 0.4, 1.0
FOLDS = 5


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty without one."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text without the slash before its path's end, and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):  # the last that fits holds
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Bits a character: each distinct character's share is what its removal shortens the text by."""
    n = F.length(text).cast("double")
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    bits = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda a, c: F.when(c == "", a).otherwise(a - share(c) * F.log2(share(c))))
    return F.when(n > 0, bits).otherwise(F.lit(0.0))


def features(urls: DataFrame) -> DataFrame:
    """urls with host, path, rule, ruled and the lexical features, but for the suffix's."""
    out = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "u": F.coalesce("url", F.lit(""))})
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    n = F.length("u")
    return out.withColumns({
        "rule": rule,
        "ruled": verdict,
        "suffix": F.substring_index("host", ".", -1),
        "fold": (F.crc32("u") % FOLDS).cast("int"),
        "length": n,
        "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")),
        "digit_ratio": F.length(F.regexp_replace("u", "[^0-9]", "")) / F.greatest(n, F.lit(1)),
        "entropy": entropy(F.col("u")),
        "params": F.regexp_count("u", F.lit("[?&][^=&#]+=")),
    })


def level(feature: str) -> Column:
    out = F.lit(0)
    for i, bound in enumerate(LEVELS[feature]):
        out = F.when(F.col(feature) > bound, i + 1).otherwise(out)
    return out.cast("int")


def suffix_table(rows: DataFrame) -> DataFrame:
    """Labelled urls and blocked ones of each suffix, in all and by fold."""
    blocked = F.col("ruled") == "block"
    count = lambda of: F.struct(F.count_if(of).alias("n"), F.count_if(of & blocked).alias("bad"))
    folds = F.array(*(count(F.col("fold") == i) for i in range(FOLDS)))
    return rows.where("ruled IS NOT NULL").groupBy("suffix").agg(count(F.lit(True)).alias("all"), folds.alias("folds"))


def with_share(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with suffix_block, the smoothed share of blocked urls of the suffix, for a labelled url without its own fold."""
    out = rows.join(table, "suffix", "left")
    own = F.when(F.col("ruled").isNotNull(), F.col("folds")[F.col("fold")])
    left = lambda f: F.coalesce(F.col("all")[f], F.lit(0)) - F.coalesce(own[f], F.lit(0))
    return out.withColumn("suffix_block", (left("bad") + 1) / (left("n") + 2)).drop("all", "folds")


def cells(rows: DataFrame) -> list[tuple[tuple[int, ...], int, int]]:
    """Counts of labelled urls, blocked ones, for each vector of levels: at most CELLS rows."""
    counted = rows.where("ruled IS NOT NULL").groupBy(*(level(f).alias(f) for f in LEVELS)).agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "block").alias("bad"))
    return sorted((tuple(r[f] for f in LEVELS), r["n"], r["bad"]) for r in counted.collect())


def grow(data: list[tuple[tuple[int, ...], float, float]], depth: int):
    """A regression tree on (levels, gradient, hessian): a leaf's value, or (feature, level, below or at, above)."""
    g, h = sum(d[1] for d in data), sum(d[2] for d in data)
    gain_of = lambda a, b: a * a / (b + L2)
    best, at = 1e-9, None
    for f, bounds in enumerate(LEVELS.values()) if depth else ():
        for k in range(len(bounds)):
            low = [d for d in data if d[0][f] <= k]
            if 0 < len(low) < len(data):
                ga, ha = sum(d[1] for d in low), sum(d[2] for d in low)
                if (gain := gain_of(ga, ha) + gain_of(g - ga, h - ha) - gain_of(g, h)) > best:
                    best, at = gain, (f, k)
    if at is None:
        return -g / (h + L2)
    f, k = at
    return f, k, grow([d for d in data if d[0][f] <= k], depth - 1), grow([d for d in data if d[0][f] > k], depth - 1)


def value(tree, levels: tuple[int, ...]) -> float:
    while isinstance(tree, tuple):
        f, k, low, high = tree
        tree = low if levels[f] <= k else high
    return tree


def boost(counts: list[tuple[tuple[int, ...], int, int]]) -> list:
    """Trees whose sum times RATE is the log-odds of block, by Newton steps on the logistic loss."""
    trees: list = []
    score = dict.fromkeys((c[0] for c in counts), 0.0)
    for _ in range(ROUNDS if counts else 0):
        data = []
        for x, n, bad in counts:
            p = 1 / (1 + math.exp(-score[x]))
            data.append((x, n * p - bad, n * p * (1 - p)))
        trees.append(tree := grow(data, DEPTH))
        for x in score:
            score[x] += RATE * value(tree, x)
    return trees


def as_column(tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, k, low, high = tree
    name = list(LEVELS)[f]
    return F.when(F.coalesce(F.col(name) <= LEVELS[name][k], F.lit(True)), as_column(low)).otherwise(as_column(high))


def probability(trees: list) -> Column:
    return 1 / (1 + F.exp(-sum((as_column(t) * RATE for t in trees), F.lit(0.0))))


def held_out(pages: DataFrame, fold: int = 0) -> DataFrame:
    """(n, right): labelled urls of a fold, and those that trees learned on the other folds judge as their rule does."""
    rows = features(pages.select("url"))
    known = rows.where(F.col("fold") != fold)
    table = common.stored(suffix_table(known), "url-suffixes")
    trees = boost(cells(with_share(known, table)))
    judged = with_share(rows.where((F.col("fold") == fold) & F.col("ruled").isNotNull()), table)
    right = F.when(probability(trees) > 0.5, "block").otherwise("allow") == F.col("ruled")
    return judged.agg(F.count("*").alias("n"), F.count_if(right).alias("right"))


def judge(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """host, path, rule, verdict and the trees' probability of block for every url."""
    rows = features(pages.select(key, "url"))
    rows = with_share(rows, common.stored(suffix_table(rows), "url-suffixes"))
    return rows.withColumn("block_score", probability(boost(cells(rows)))).select(key, "host", "path", "rule", F.coalesce("ruled", F.when(F.col("block_score") > 0.5, "block").otherwise("allow")).alias("verdict"), "block_score")


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"))
