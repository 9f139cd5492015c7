"""URL filters: fixed host and path rules, then association rules mined by FP-growth, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointing

#: Fixed values: (verdict, host, path).
FIXED = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
LABEL = "label=block"
#: Share of the labelled URLs, and number of them, that must hold a rule's tokens and the label, share of those with the tokens that must have it, and items in a rule that may make a longer one needless.
SUPPORT, LEAST, CONFIDENCE, TOKENS = 0.005, 20, 0.6, 3
#: Rules up to which the index is broadcast. Frequent sets number at most the mean count of token sets in a URL over SUPPORT, however many URLs there are.
BROADCAST_RULES = 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both are empty for a null URL or one without ``://``."""
    rest = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, rest, 1), _UPPER, _LOWER), F.regexp_extract(url, rest, 2)


def fixed_rule(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fixed rule that fits, and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, of, start in sorted(FIXED, key=lambda x: len(x[1] + x[2])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(of + start)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Host labels, path parts, the ending and the names of query arguments, each with a mark of its place; every token once."""
    mark = lambda sign, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(sign), x))
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)
    names = F.regexp_extract_all(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1))
    return F.array_distinct(F.concat(mark("host=", F.split(host, r"\.")), mark("path=", F.split(path, "/")), mark("end=", F.array(ending)), mark("arg=", names)))


def parsed(pages: DataFrame, url_col: str) -> DataFrame:
    host, path = host_and_path(F.col(url_col))
    return pages.select(F.col(url_col).alias("url"), host.alias("host"), path.alias("path")).where("url is not null").distinct().select("url", tokens(F.col("host"), F.col("path"), F.col("url")).alias("items"))


def token_table(labelled: DataFrame, least: float, confidence: float) -> DataFrame:
    """token, item and sure (the token is a rule on its own) of the tokens that rules can hold. ``labelled``: items, block.

    What FP-growth need not see is left out, all of it without a loss: tokens that too few blocked URLs hold; those that every URL holds, which change
    nothing in a rule; and those that are rules themselves, since longer rules with them match nothing else. Tokens that the same URLs hold become one
    item, the least of them: a rule holds one of them as well as another, so deep paths don't multiply.
    """
    row = F.xxhash64("items")
    tokens = labelled.select(F.explode("items").alias("token"), "block", row.alias("row")).groupBy("token").agg(
        F.count("*").alias("n"), F.count_if("block").alias("bad"), F.sum(F.col("row").cast("decimal(38,0)")).alias("sum"), F.bit_xor("row").alias("xor"))
    total = labelled.agg(F.count("*").alias("all_n"), F.count_if("block").alias("all_bad"))
    tokens = tokens.join(F.broadcast(total)).where((F.col("bad") >= least) & (F.col("n") < F.col("all_n")))
    sure = (F.col("bad") >= confidence * F.col("n")) & (F.col("bad") * F.col("all_n") > F.col("all_bad") * F.col("n"))
    items = tokens.groupBy("n", "bad", "sum", "xor").agg(F.min("token").alias("item"), F.collect_list("token").alias("tokens"), F.first(sure).alias("sure"))
    return items.select(F.explode("tokens").alias("token"), "item", "sure")


def without_implied(rules: DataFrame) -> DataFrame:
    """The rules (rule, items) without those of more than TOKENS items that hold all items of a rule of up to TOKENS: they match nothing else."""
    long = rules.where(F.size("items") > TOKENS).withColumn("items", F.array_sort("items"))
    at = lambda i: F.get(F.col("items"), i)
    after = lambda i: F.sequence(i, F.size("items") - 1)
    sets = F.transform(after(F.lit(0)), lambda i: F.flatten(F.transform(after(i), lambda j: F.transform(after(j), lambda k: F.xxhash64(F.array_distinct(F.array(at(i), at(j), at(k))))))))
    short = rules.where(F.size("items") <= TOKENS).select("rule")
    implied = long.select(F.col("rule").alias("of"), F.explode(F.array_distinct(F.flatten(sets))).alias("rule")).join(short, "rule", "left_semi").select(F.col("of").alias("rule")).distinct()
    return rules.join(implied, "rule", "left_anti")


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """The rules (rule, items), sets of items of any size that occur with the label often enough, without_implied(), and the items' tokens (token, item).
    ``labelled``: items (tokens), block (boolean)."""
    labelled = labelled.where((F.size("items") > 0) | F.col("block")).persist()
    count = max(1, labelled.count())
    least = max(support * count, LEAST)
    checkpointing(labelled.sparkSession)
    tokens = token_table(labelled, least, confidence).checkpoint()
    few = tokens.count() <= BROADCAST_RULES
    kept = tokens.where(~F.col("sure")).select("token", "item")
    rows = labelled.select("block", "items", F.monotonically_increasing_id().alias("number"))
    held = rows.select("number", "block", F.explode("items").alias("token")).join(F.broadcast(kept) if few else kept, "token").groupBy("number", "block").agg(F.collect_set("item").alias("items"))
    baskets = held.select(F.when(F.col("block"), F.concat("items", F.array(F.lit(LABEL)))).otherwise(F.col("items")).alias("items")).persist()
    # URLs of which no token is left count for the label's share, by which a rule must be better
    share = labelled.agg(F.try_divide(F.count_if("block"), F.count("*")).alias("share"))
    inside = baskets.count()
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (math.ceil(least) - 0.5) / max(1, inside)), minConfidence=confidence).fit(baskets)
    found = model.associationRules.where(F.array_contains("consequent", LABEL)).join(F.broadcast(share)).where("confidence > share")
    rules = found.select(F.array_sort("antecedent").alias("items")).unionByName(tokens.where("sure").select(F.array("item").alias("items")).distinct())
    out = without_implied(rules.select(F.xxhash64("items").alias("rule"), "items")).checkpoint()
    baskets.unpersist()
    labelled.unpersist()
    return out, tokens.select("token", "item")


def matches(urls: DataFrame, rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """The urls that hold a token of each item of a rule. ``urls``: url, items. The rules' inverted index (token, rule, item) is joined with the tokens of the urls."""
    index = rules.select("rule", F.size("items").alias("need"), F.explode("items").alias("item")).join(tokens, "item")
    few = index.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    held = urls.select("url", F.explode("items").alias("token"))
    if few:
        pairs = held.join(F.broadcast(index), "token")
    else:  # common tokens are dealt out over 32 copies of the index
        salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
        pairs = held.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(32)).cast("int")).join(salted, ["token", "salt"])
    return pairs.groupBy("url", "rule", "need").agg(F.countDistinct("item").alias("n")).where("n = need").select("url").distinct()


def filter_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``pages``: the id, ``host``, ``path``, ``rule`` (the fixed rule that decides, or null) and ``verdict`` (allow or block).

    ``labels`` (doc_id, quality, toxic) says of pages of the same number whether they are of low quality or toxic; pages that are teach the rules.
    Where no fixed rule fits, a URL is blocked if a mined rule matches. Null URLs have an empty host and path and are allowed; so is everything else
    if there are no labels. Repeated rows and null ids stay, other columns are left out.
    """
    marks = labels.select(F.col(label_id).alias("of"), (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("block"))
    marks = marks.groupBy("of").agg(F.max("block").alias("block"))
    known = pages.select(F.col(id_col).alias("of"), F.col(url_col).alias("url")).join(marks, "of").groupBy("url").agg(F.max("block").alias("block"))
    urls = parsed(pages, url_col)
    rules, table = mine(urls.join(known, "url").select("items", "block"))
    bad = matches(urls, rules, table).select(F.col("url").alias("bad"))
    host, path = host_and_path(F.col("url"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", "url", host.alias("host"), path.alias("path"))
    rows = rows.join(bad, F.col("url") == F.col("bad"), "left")
    return rows.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("bad").isNotNull(), "block").otherwise("allow")).alias("verdict"))
