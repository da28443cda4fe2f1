"""URL filters: fixed host and path rules, and association rules mined from labelled pages.

Tokens that occur on the same labelled pages say the same, so they are merged into one item before mining: a deep
path that many pages share is one item and not all subsets of its segments. Spark's FP-growth then mines sets of
items that occur often among labelled pages; sets that imply a bad label with enough support and confidence become
rules, and a rule that contains another is dropped. A page has an item if it has one of its tokens. Rules are
matched by an inverted index: each is filed under the tokens of its rarest item, a page looks up its own tokens,
and a filed rule matches if the page has all its items. A fixed rule, where one fits, decides before them.

Path prefixes with different page counts are different items; a chain of d of them, each frequent enough, costs
FP-growth up to 2**d sets. A null url, or one without ``://``, has no host, path, rule or tokens and is allowed.
Repeated rows get equal results, each as a row. Pages without a label are judged like others. Empty tables work:
without labels there are no mined rules.
"""

from __future__ import annotations

from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

# The contract's rules.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

#: A mined rule covers this share of labelled pages at least, and so many of them; and this share of what it
#: covers is bad. More rules than BROADCAST_RULES are joined by a shuffle.
LEAST_SUPPORT, LEAST_PAGES, LEAST_CONFIDENCE, BROADCAST_RULES = 0.002, 12, 0.9, 50_000
BAD = "label=bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``, or empty."""
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fixed rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(RULES, key=lambda x: len(x[0] + x[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens: host labels, the top-level label, path segments with numbers as #, query keys."""
    labels = F.filter(F.split(host(url), r"\."), lambda x: x != "")
    part = lambda kind, values: F.transform(values, lambda x: F.concat(F.lit(kind), x))
    segments = F.filter(F.split(F.regexp_replace(path(url), "[0-9]+", "#"), "/"), lambda x: x != "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    last = F.slice(labels, F.greatest(F.size(labels), F.lit(1)), 1)
    return F.array_distinct(F.concat(part("host=", labels), part("top=", last), part("path=", segments), part("query=", keys)))


RULE = "items array<array<string>>, anchor array<string>, confidence double, pages long"


def merged(labelled: DataFrame, least: int) -> DataFrame:
    """item, tokens, pages: the tokens of ``least`` labelled pages or more, those of the same pages together."""
    spread = labelled.select("row", F.explode(F.array_distinct("tokens")).alias("token"))
    page_set = spread.groupBy("token").agg(F.count(F.lit(1)).alias("pages"), F.bit_xor(F.xxhash64("row")).alias("a"), F.bit_xor(F.xxhash64(F.lit(7), "row")).alias("b"))
    return page_set.where(F.col("pages") >= least).groupBy("pages", "a", "b").agg(F.min("token").alias("item"), F.array_sort(F.collect_list("token")).alias("tokens")).select("item", "tokens", "pages")


def mined(labelled: DataFrame, support: float = LEAST_SUPPORT, pages: int = LEAST_PAGES, confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """RULE rows from rows of tokens and bad: ``items`` are sets of interchangeable tokens, of which the anchor is
    the rarest."""
    spark = labelled.sparkSession
    labelled = stored(labelled.select("tokens", "bad", F.monotonically_increasing_id().alias("row")), "url-rows")  # ids fixed by being written
    n = labelled.count()
    if not n:
        return spark.createDataFrame([], RULE)
    least = min(1.0, max(support, pages / n))
    items = stored(merged(labelled, ceil(least * n - 1e-9)), "url-items")
    own = labelled.select("row", F.explode(F.array_distinct("tokens")).alias("item")).join(items.select("item"), "item").groupBy("row").agg(F.collect_list("item").alias("found"))
    baskets = labelled.join(own, "row", "left").select(F.coalesce("found", F.array().cast("array<string>")).alias("found"), "bad")
    baskets = baskets.select(F.when(F.col("bad"), F.array_append("found", F.lit(BAD))).otherwise(F.col("found")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=confidence).fit(baskets)
    found = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD)))
    rules = stored(found.select(F.array_sort("antecedent").alias("rule"), "confidence", F.round(F.col("support") * n).cast("long").alias("pages")), "url-rules")
    # a rule that contains another says nothing new
    rarest = F.array_min("found")["item"]
    ranked = rules.select("rule", F.explode("rule").alias("item")).join(items.select("item", F.col("pages").alias("often")), "item").groupBy("rule").agg(F.collect_list(F.struct("often", "item")).alias("found"))
    anchored = stored(rules.join(ranked.select("rule", rarest.alias("anchor")), "rule"), "url-anchored")
    larger = anchored.select(F.col("rule").alias("own"), F.explode("rule").alias("anchor")).join(anchored.select("rule", "anchor"), "anchor")
    implied = larger.where((F.size("rule") < F.size("own")) & (F.size(F.array_except("rule", "own")) == 0)).select(F.col("own").alias("rule")).distinct()
    least_rules = anchored.join(implied, "rule", "left_anti")
    listed = least_rules.select("rule", F.explode("rule").alias("item")).join(items.select("item", "tokens"), "item").groupBy("rule").agg(F.array_sort(F.collect_list("tokens")).alias("items"))
    anchors = items.select(F.col("item").alias("anchor"), F.col("tokens").alias("_tokens"))
    return stored(least_rules.join(listed, "rule").join(anchors, "anchor").select("items", F.col("_tokens").alias("anchor"), "confidence", "pages"), "url-index")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct urls that some rule matches, with the number of rules."""
    few = rules.count() <= BROADCAST_RULES
    index = rules.select(F.xxhash64("items").alias("rule"), "items", F.explode("anchor").alias("token"))
    looked_up = urls.select("url", tokens(F.col("url")).alias("own")).select("url", "own", F.explode("own").alias("token"))
    hits = looked_up.join(F.broadcast(index) if few else index, "token").where(F.forall("items", lambda x: F.arrays_overlap(x, F.col("own"))))
    return hits.groupBy("url").agg(F.count_distinct("rule").alias("mined_rules"))  # a url can have several tokens of an anchor


def judged(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url: str = "url") -> DataFrame:
    """id, host, path, rule, verdict and mined_rules, a row for each page."""
    own = pages.select(pages[id_column].alias("id"), pages[url].alias("url"))
    hits = stored(matched(own.where("url IS NOT NULL").select("url").distinct(), rules), "url-hits")
    rows = own.join(hits, "url", "left").select("id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.coalesce("mined_rules", F.lit(0)).cast("long").alias("mined_rules"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"))
    method = F.when(F.col("mined_rules") > 0, "block").otherwise("allow")
    return rows.select(F.col("id").alias(id_column), "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "mined_rules")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """tokens and bad of the pages with a label of the same number: bad if toxic or of low quality. Several
    labels of a page make it bad if one of them does."""
    by_page = labels.groupBy(labels["doc_id"].alias("page_id")).agg(F.max(F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False))).alias("bad"))
    return pages.where("url IS NOT NULL").select("page_id", tokens(F.col("url")).alias("tokens")).join(by_page, "page_id").where("size(tokens) > 0").select("tokens", "bad")


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judged(pages, mined(stored(labelled_pages(pages, table(spark, sf_dir, "labels")), "url-labelled")))
