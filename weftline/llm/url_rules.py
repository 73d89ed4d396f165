"""Operator 7: URL filters by association rules.

The host is what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; the path goes
on up to `?`, `#` or the end. Given rules (host, path, verdict) fit the host and its subdomains where
the URL's path starts with theirs; the longest wins. All other URLs are judged by mined rules.

A labelled URL is a basket of tokens: its host's labels and their parts, the top-level domain, words of
the path and names of query fields, and its class. Spark's FP-growth finds frequent combinations of up to
``MAX_TOKENS`` tokens; those that imply the class `block` with ``MIN_CONFIDENCE`` (by the lower end of a 95 % interval for
labels counted in the corpus) and hold no smaller rule are kept. Each is indexed by its rarest token; a
URL meets the rules of its tokens in a join and is blocked where it has all tokens of one.

Labels are those of documents judged toxic or of low quality, by the document number in a page's path, and, where
the caller has one, a table ``seeds`` (url, class) of URLs whose class is known; a combination needs ``SEED_COUNT`` of
those. Where labels say nothing about URLs, nothing is mined, and what no given rule fits is allowed. Null URLs and those without `://` have empty host and path, no tokens, and are
allowed. Rows that repeat a page_id are rows of their own; columns beyond the two named are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch

#: Fixed values: (host, path, verdict).
GIVEN = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
MIN_CONFIDENCE, MAX_TOKENS = 0.9, 3
#: Baskets that a combination must hold in, however many there are in all.
MIN_COUNT, SEED_COUNT = 20, 3


def host_and_path(url: str = "url") -> tuple[F.Column, F.Column]:
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, upper.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def tokens(url: str = "url") -> F.Column:
    """Distinct tokens of a URL whose host and path are columns already."""
    labels = F.split("host", r"\.")
    parts = F.filter(F.split("host", r"[^a-z0-9]+"), lambda x: x != "")
    names = F.filter(F.split(F.lower("path"), r"[^a-z]+"), lambda x: x != "")
    fields = F.filter(F.transform(F.split(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"\?([^#]*)", 1), "&"), lambda x: F.regexp_extract(x, r"^([^=]*)", 1)), lambda x: x != "")
    found = F.concat(
        F.transform(F.filter(labels, lambda x: x.contains("-")), lambda x: F.concat(F.lit("label:"), x)), F.transform(parts, lambda x: F.concat(F.lit("host:"), x)),
        F.transform(names, lambda x: F.concat(F.lit("path:"), x)), F.transform(fields, lambda x: F.concat(F.lit("field:"), x)),
    )
    return F.array_distinct(F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(found))


def given_rule(rules: list[tuple[str, str, str]] = GIVEN) -> tuple[F.Column, F.Column]:
    """Rule and verdict of the longest given rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


#: Stands between the tokens of a set.
BETWEEN = "\x1f"


def subsets(tokens_: str, size: int) -> F.Column:
    """All sets of ``size`` tokens of a sorted array, as texts."""
    after = lambda xs, i: F.slice(xs, i + 2, F.size(xs))
    whole = F.col(tokens_)
    sets = F.transform(whole, lambda x: F.array(x))
    if size > 1:
        sets = F.flatten(F.transform(whole, lambda x, i: F.transform(after(whole, i), lambda y: F.array(x, y))))
    if size > 2:
        sets = F.flatten(F.transform(sets, lambda s: F.transform(F.filter(whole, lambda z: z > F.element_at(s, -1)), lambda z: F.concat(s, F.array(z)))))
    return F.transform(sets, lambda s: F.array_join(s, BETWEEN))


def mined(labelled: DataFrame, scratch: Scratch, name: str, min_count: int, bounded: bool) -> DataFrame:
    """From (tokens, class): rules as (rule, tokens), the antecedents of `block`.

    FP-growth by itself finds sets of any size, as many as there are subsets of tokens that always go together. So it
    mines sets of one, two and three tokens one after another: a set is an item, and each basket holds one and the
    class. A larger set is built of tokens from smaller ones that are frequent with `block` and no rule yet.
    """
    from pyspark.ml.fpm import FPGrowth

    baskets = scratch.save(labelled.filter(F.size("tokens") > 0).select(F.monotonically_increasing_id().alias("basket"), F.array_sort("tokens").alias("tokens"), F.concat(F.lit("class:"), "class").alias("class")), f"{name}-baskets")
    found, z = labelled.sparkSession.createDataFrame([], "tokens array<string>"), 1.96
    current = baskets
    for size in range(1, MAX_TOKENS + 1):
        sets = current.select("class", F.explode(subsets("tokens", size)).alias("set"))
        # Neither a rule nor part of one: sets in fewer blocked baskets than a rule needs. FP-growth keeps items on the driver.
        enough = sets.filter("class = 'class:block'").groupBy("set").count().filter(F.col("count") >= min_count).select("set")
        items = scratch.save(sets.join(enough, "set", "left_semi").select(F.array("set", "class").alias("items")), f"{name}-items{size}")
        n = items.count()
        if not n or min_count - 0.5 > n:
            break
        model = FPGrowth(itemsCol="items", minSupport=(min_count - 0.5) / n, minConfidence=MIN_CONFIDENCE).fit(items)  # it rounds support * n up
        rules = model.associationRules.filter(F.element_at("consequent", 1) == "class:block")
        # The lower end of Wilson's interval: few baskets, or a mere tendency, are no rule.
        of = F.col("support") * n / F.col("confidence")
        low = (F.col("confidence") + z * z / (2 * of) - z * F.sqrt((F.col("confidence") * (1 - F.col("confidence")) + z * z / (4 * of)) / of)) / (1 + z * z / of)
        rules = (rules.filter(low >= MIN_CONFIDENCE) if bounded else rules).select(F.element_at("antecedent", 1).alias("set"))
        rules = scratch.save(rules, f"{name}-rules{size}")
        found = found.union(rules.select(F.split("set", BETWEEN).alias("tokens")))
        if size == MAX_TOKENS:
            break
        frequent = model.freqItemsets.filter((F.size("items") == 2) & F.array_contains("items", "class:block")).select(F.element_at(F.array_remove("items", "class:block"), 1).alias("set"))
        open_ = frequent.join(rules, "set", "left_anti").select(F.explode(F.split("set", BETWEEN)).alias("token")).distinct()
        single = current.select("basket", "class", F.explode("tokens").alias("token")).join(open_, "token")
        current = scratch.save(single.groupBy("basket", "class").agg(F.array_sort(F.collect_list("token")).alias("tokens")), f"{name}-open{size}")
    rules = scratch.save(found.select("tokens", F.array_join("tokens", " ").alias("rule")), f"{name}-rules")
    sub, sup = rules.select(F.col("rule").alias("small"), F.explode("tokens").alias("token"), F.size("tokens").alias("size")), rules.select("rule", F.explode("tokens").alias("token"))
    larger = sub.join(sup, "token").filter("small <> rule").groupBy("small", "rule", "size").agg(F.count("*").alias("n")).filter("n = size").select("rule").distinct()
    return rules.join(larger, "rule", "left_anti").select("rule", "tokens")


def filtered(spark: SparkSession, pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = GIVEN, seeds: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule of every page."""
    scratch = Scratch(spark, "url-rules")
    host, path = host_and_path()
    rule, verdict = given_rule(rules)
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path})
    number = F.regexp_extract("path", r"^/[a-z]+/(\d{1,18})", 1)
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.when((F.min("quality") == 0) | (F.max("toxic") == 1), "block").otherwise("allow").alias("class"))
    by_document = parsed.filter(number != "").withColumn("doc_id", number.cast("long")).join(known, "doc_id").select(tokens().alias("tokens"), "class")
    found = mined(by_document, scratch, "documents", MIN_COUNT, True)
    if seeds is not None:
        by_seed = seeds.select("url", "class").withColumns({"host": host, "path": path}).select(tokens().alias("tokens"), "class")
        found = found.union(mined(by_seed, scratch, "seeds", SEED_COUNT, False)).dropDuplicates(["rule"])
    rows = scratch.save(parsed.withColumns({"rule": rule, "verdict": verdict}), "parsed")
    open_ = rows.filter("rule IS NULL AND host <> ''").select("url", "host", "path").distinct().withColumn("tokens", tokens())
    # Inverted index: each rule under its token that the fewest open URLs have.
    each = open_.select("url", F.explode("tokens").alias("token"))
    common = each.groupBy("token").agg(F.count("*").alias("n"))
    index = found.withColumn("token", F.explode("tokens")).join(common, "token", "left").groupBy("rule", "tokens").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token")).alias("key")).select("rule", F.col("tokens").alias("wanted"), F.col("key.token").alias("token"))
    index = scratch.save(index, "index")
    hits = open_.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token").filter(F.forall("wanted", lambda x: F.array_contains("tokens", x))).groupBy("url").agg(F.min("rule").alias("mined_rule"))
    judged = rows.join(hits, "url", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")).alias("verdict"), F.when(F.col("rule").isNull(), F.col("mined_rule")).alias("mined_rule"))
