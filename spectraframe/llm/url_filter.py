"""URL filtering by association rules, in DataFrame functions and Spark's FP-growth.

A url's tokens are its host's labels, its path's segments (numbers are one token), its file ending and the names of its
query's parameters. FP-growth mines the token sets that go with a label in labelled urls. A mined rule is kept if its
support and confidence reach their least values and no rule with some of its tokens
has the same verdict with as much confidence. Each rule is filed under its rarest token; a url looks up its own tokens
there, and of the rules whose tokens it has all of, the most confident one decides (then support, then allow).

Before mining, tokens that stand in the same labelled urls become one item (else any set of them would be mined), and those
in too few are left out.

Given rules (host and path) come first: one fits its host and its subdomains if the path starts with its own; the
longest wins. They are filed under their host, and a url looks up the suffixes of its own.

Urls are grouped by those of their tokens that rules use, so each such set is looked up once; verdicts of sets are
broadcast if they have been counted and are few, else only those of hot sets. More than MOST_RULES mined rules, or
MOST_ITEMS items, are an error, not a cut.

Defined cases: null url or one without :// has an empty host and path and no tokens; no labelled urls give no mined
rules; labelled urls with a null verdict are none; where no rule fits the verdict is `otherwise`; repeated rows are judged
alike; other columns stay as they are, but input columns named host, path, rule or verdict are replaced.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, LOWER, MOST_BROADCAST, UPPER, written

MOST_RULES, MOST_ITEMS = 20_000, 20_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """The sorted distinct tokens of a url."""
    host, path = host_and_path(url)
    segments = F.filter(F.split(F.translate(path, UPPER, LOWER), "/"), lambda x: x != "")
    names = F.regexp_extract_all(F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), 1)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    parts = [F.transform(labels, lambda x: F.concat(F.lit("host:"), x)), F.transform(segments, lambda x: F.concat(F.lit("path:"), F.regexp_replace(F.regexp_replace(x, r"\.[a-z]+$", ""), "^[0-9]+$", "#"))),
             F.transform(F.filter(F.transform(segments, lambda x: F.regexp_extract(x, r"\.([a-z]+)$", 1)), lambda x: x != ""), lambda x: F.concat(F.lit("ending:"), x)), F.transform(names, lambda x: F.concat(F.lit("query:"), x))]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def given_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (host, path, verdict) that fits, as a struct (rule, verdict), else null."""
    by_host: dict[str, list[tuple[str, str]]] = {}
    for h, p, verdict in rules:
        by_host.setdefault(h, []).append((p, verdict))
    kind = "array<struct<path:string,verdict:string>>"
    index = F.create_map(*[x for h, own in sorted(by_host.items()) for x in (F.lit(h), F.array(*[F.struct(F.lit(p).alias("path"), F.lit(v).alias("verdict")) for p, v in own]).cast(kind))])
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    found = F.flatten(F.transform(suffixes, lambda h: F.transform(F.filter(F.coalesce(F.try_element_at(index, h), F.array().cast(kind)), lambda r: path.startswith(r["path"])), lambda r: F.struct(F.length(F.concat(h, r["path"])).alias("n"), F.length(h).alias("h"), F.concat(h, r["path"]).alias("rule"), r["verdict"].alias("verdict")))))
    return F.array_max(found)


Rules = list[tuple[tuple[tuple[str, ...], ...], str, float, float]]


def mine(labelled: DataFrame, least_support: float = 0.002, least_confidence: float = 0.9) -> Rules:
    """Pruned rules (needs, verdict, confidence, support) from rows (tokens, verdict). A rule needs one token at least of each
    of its classes: a class has the tokens that stand in the same labelled urls, so any of them gives the same rule."""
    rows = labelled.select(F.array_sort(F.array_distinct("tokens")).alias("tokens"), "verdict").groupBy("tokens", "verdict").agg(F.count(F.lit(1)).alias("n"))
    rows = written(rows)
    total = rows.agg(F.sum("n")).first()[0] or 0
    if not total:
        return []
    # tokens of the same urls have the same sums; those of too few are in no rule
    h = [F.xxhash64("tokens", "verdict", F.lit(k)).cast("decimal(38,0)") * F.col("n") for k in range(2)]
    sums = rows.select(F.explode("tokens").alias("token"), "n", h[0].alias("x"), h[1].alias("y")).groupBy("token").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    sums = sums.where(F.col("n") >= F.ceil(F.lit(least_support) * total - 1e-9))
    found = sums.groupBy("n", "x", "y").agg(F.array_sort(F.collect_list("token")).alias("members")).limit(MOST_ITEMS + 1).collect()
    if len(found) > MOST_ITEMS:
        raise ValueError(f"more than {MOST_ITEMS} tokens reach the least support; raise it")
    classes = {r["members"][0]: tuple(r["members"]) for r in found}
    names = F.array(*map(F.lit, sorted(classes))).cast("array<string>")
    items = rows.select(F.concat(F.array_intersect("tokens", names), F.array(F.concat(F.lit("="), "verdict"))).alias("items"), F.explode(F.sequence(F.lit(1), F.col("n"))))
    model = FPGrowth(itemsCol="items", minSupport=least_support, minConfidence=least_confidence).fit(items.select("items"))
    out = model.associationRules.where(F.col("consequent")[0].startswith("=") & ~F.exists("antecedent", lambda x: x.startswith("=")))
    rules = out.select(F.array_sort("antecedent").alias("a"), F.substr(F.col("consequent")[0], F.lit(2)).alias("v"), "confidence", "support").limit(MOST_RULES + 1).collect()
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules; raise the least support")
    kept: list[tuple[tuple[str, ...], str, float, float]] = []
    for r in sorted(rules, key=lambda r: (len(r["a"]), r["a"], r["v"])):
        if not any(v == r["v"] and c >= r["confidence"] and set(a) <= set(r["a"]) for a, v, c, _ in kept):
            kept.append((tuple(r["a"]), r["v"], r["confidence"], r["support"]))
    return [(tuple(classes[x] for x in a), v, c, s) for a, v, c, s in kept]


def looked_up(rows: DataFrame, mined: Rules) -> DataFrame:
    """rows (with a column tokens) and `mined_verdict`, null where no rule fits."""
    spark: SparkSession = rows.sparkSession
    if not mined:
        return rows.withColumn("mined_verdict", F.lit(None).cast("string"))
    often: dict[str, int] = {}
    for needs, *_ in mined:
        for own in needs:
            often[own[0]] = often.get(own[0], 0) + 1
    members = {x: own[0] for needs, *_ in mined for own in needs for x in own}
    index = spark.createDataFrame([(min((own[0] for own in needs), key=lambda x: (often[x], x)), [own[0] for own in needs], v, float(c), float(s)) for needs, v, c, s in mined], "token string, needs array<string>, v string, c double, s double")
    names = spark.createDataFrame(sorted(members.items()), "member string, class string")
    rows = rows.withColumn("used", F.array_sort(F.array_intersect("tokens", F.array(*map(F.lit, sorted(members))))))
    sets = rows.where(F.size("used") > 0).groupBy(F.col("used").alias("own")).agg(F.count(F.lit(1)).alias("n"))
    # MOST_ITEMS and MOST_RULES rows at most are broadcast
    has = sets.select("own", "n", F.explode("own").alias("member")).join(F.broadcast(names), "member").groupBy("own").agg(F.max("n").alias("n"), F.collect_set("class").alias("has"))
    hits = has.select("own", "n", "has", F.explode("has").alias("token")).join(F.broadcast(index), "token").where(F.size(F.array_except("needs", "has")) == 0)
    best = written(hits.groupBy("own").agg(F.max("n").alias("n"), F.max(F.struct("c", "s", (F.col("v") == "allow").alias("a"), "v"))["v"].alias("mined_verdict")))
    if best.count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(best.drop("n")), F.col("used") == F.col("own"), "left").drop("used", "own")
    total = rows.count()
    hot = F.broadcast(best.where(F.col("n") * HOT_SHARE > total).drop("n"))  # HOT_SHARE rows at most
    rare = rows.join(hot, F.col("used") == F.col("own"), "left_anti").where(F.size("used") > 0).join(best.where(F.col("n") * HOT_SHARE <= total).drop("n"), F.col("used") == F.col("own"), "left")
    return rows.where(F.size("used") == 0).withColumns({"own": F.col("used"), "mined_verdict": F.lit(None).cast("string")}).unionByName(rows.join(hot, F.col("used") == F.col("own"))).unionByName(rare).drop("used", "own")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", otherwise: str = "allow", labelled: DataFrame | None = None) -> DataFrame:
    """pages with host, path, rule and verdict. Labels (url, verdict) to mine from; by default the urls that given rules fit."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.struct(*[F.col(c) for c in pages.columns]).alias("page"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.select("page", "host", "path", given_rule(F.col("host"), F.col("path"), rules).alias("given"), tokens(F.col("url")).alias("tokens"))
    if labelled is None:
        labels = rows.where(F.col("given").isNotNull()).select("tokens", F.col("given.verdict").alias("verdict"))
    else:
        labels = labelled.where(F.col("verdict").isNotNull()).select(tokens(F.col("url")).alias("tokens"), "verdict")
    out = looked_up(rows, mine(labels))
    own = [F.col("page")[c].alias(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return out.select(*own, "host", "path", F.col("given.rule").alias("rule"), F.coalesce("given.verdict", "mined_verdict", F.lit(otherwise)).alias("verdict"))
