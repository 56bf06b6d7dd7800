"""URL filtering by fixed rules and by association rules that FP-growth mines from labels.

Each labelled url is a set of tokens (labels of its host, words of its path, parameter names). Tokens
that occur in exactly the same labelled urls are one item, so a template of many tokens that always
come together is not mined set by set. Spark's FP-growth finds the frequent sets of items, with one
more item for a bad label; from a set's counts with and without that item come the rules. Those stay
that have enough support, a confidence of at least LIFT times the share of bad urls, and no more
general rule as confident. They match through an inverted index: a rule is filed under its rarest
item, urls look up their items, and the rest of the rule is checked where the item matched.
A fixed rule (host and path prefix) that fits decides before any mined rule; the longest wins.

Defined results: a null url or one without `://` has an empty host and path and no tokens, and is
allowed; page ids may repeat or be null; a null label is no label; without bad labels or without rules
everything that no fixed rule blocks is allowed; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, stored

#: Least support of a mined rule, as a share and a number of labelled urls, and how many times more often its urls are bad than all are.
SUPPORT, LEAST, LIFT = 0.0005, 10, 1.5
BAD = "=bad"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Rules below this number are broadcast with their index; beyond it the look-up is a shuffled join.
BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and every domain that it is a subdomain of."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def tokens(url: Column) -> Column:
    """Distinct tokens of a url; numbers are left out, since each belongs to a page or two."""
    host, path = host_of(url), path_of(url)
    mark = lambda kind, words: F.transform(F.filter(words, lambda w: (w != "") & ~w.rlike("^[0-9]+$")), lambda w: F.concat(F.lit(kind), w))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    return F.array_distinct(
        F.concat(
            mark("host:", F.split(host, r"\.")),
            mark("path:", F.split(ascii_lower(path), "[/._-]")),
            mark("has:", F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1))),
        )
    )


def items_of(labelled: DataFrame) -> DataFrame:
    """(token, item): tokens of exactly the same urls have one item, the smallest of them. labelled: _row, tokens."""
    seen = labelled.select("_row", F.explode("tokens").alias("token"))
    # Which urls a token has: their number and two independent sums of their hashes.
    h = lambda seed: F.sum(F.xxhash64("_row", F.lit(seed)).cast("decimal(38,0)")).alias(f"h{seed}")
    held = seen.groupBy("token").agg(F.count("*").alias("n"), h(1), h(2))
    first = held.groupBy("n", "h1", "h2").agg(F.min("token").alias("item"))
    return held.join(first, ["n", "h1", "h2"]).select("token", "item")


def with_items(urls: DataFrame, items: DataFrame) -> DataFrame:
    """_row and the set of items of each url (_row, tokens) that has any."""
    few = items.count() <= BROADCAST_RULES
    seen = urls.select("_row", F.explode("tokens").alias("token"))
    return seen.join(F.broadcast(items) if few else items, "token").groupBy("_row").agg(F.collect_set("item").alias("items"))


def filed(rules: DataFrame, often: DataFrame) -> DataFrame:
    """rules with `item`, the one of the antecedent that is rarest by often (item, count)."""
    wide = rules.select("rule_id", F.explode("antecedent").alias("item")).join(often, "item", "left")
    rarest = wide.groupBy("rule_id").agg(F.min_by("item", F.struct(F.coalesce("count", F.lit(0)), "item")).alias("item"))
    return rarest.join(rules, "rule_id")


def mined(labelled: DataFrame, support: float = SUPPORT, lift: float = LIFT, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(url, bad) -> rules (rule_id, antecedent of items, confidence, support) and items (token, item).

    No rule stays that another, with a part of its antecedent, is as confident as.
    """
    spark = labelled.sparkSession
    rows = labelled.where("url is not null and bad is not null").select("bad", tokens(F.col("url")).alias("tokens")).where(F.size("tokens") > 0)
    rows = checkpointed(rows.withColumn("_row", F.monotonically_increasing_id()))
    n, share = rows.agg(F.count("*"), F.avg(F.col("bad").cast("double"))).first()
    if not share:
        return spark.createDataFrame([], "rule_id long, antecedent array<string>, confidence double, support double"), spark.createDataFrame([], "token string, item string")
    items = checkpointed(items_of(rows))
    sets = with_items(rows, items).join(rows.select("_row", "bad"), "_row")
    baskets = checkpointed(sets.select(F.concat("items", F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items")))
    support = max(support, min(1.0, least / n))
    frequent = checkpointed(FPGrowth(itemsCol="items", minSupport=support).fit(baskets).freqItemsets)
    plain = frequent.where(~F.array_contains("items", BAD)).select(F.array_sort("items").alias("antecedent"), F.col("freq").alias("all"))
    bad = frequent.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_sort(F.array_remove("items", BAD)).alias("antecedent"), "freq")
    confidence = (F.col("freq") / F.col("all")).alias("confidence")
    rules = plain.join(bad, "antecedent").where(F.col("freq") >= lift * share * F.col("all")).select("antecedent", confidence, (F.col("freq") / n).alias("support"))
    rules = checkpointed(rules.withColumn("rule_id", F.monotonically_increasing_id()))
    # A more general rule shares its rarest item with the special one, so pairs meet on items and no others.
    wide = rules.select("rule_id", "antecedent", "confidence", F.explode("antecedent").alias("item"))
    general = filed(rules, wide.groupBy("item").count()).select("item", F.col("antecedent").alias("less"), F.col("confidence").alias("other"))
    needless = wide.join(general, "item").where((F.size("less") < F.size("antecedent")) & (F.size(F.array_except("less", "antecedent")) == 0) & (F.col("other") >= F.col("confidence")))
    return checkpointed(rules.join(needless.select("rule_id").distinct(), "rule_id", "left_anti")), items


def fixed_rules(spark, block: list[str], allow: list[str]) -> DataFrame:
    """Rules written as host/path, e.g. org/es/ for the path /es/ of every host in org."""
    rows = [(r, r.partition("/")[0], "/" + r.partition("/")[2], verdict) for verdict, rules in (("block", block), ("allow", allow)) for r in rules]
    return spark.createDataFrame(rows, "rule string, domain string, prefix string, says string")


def judged(pages: DataFrame, labelled: DataFrame, block: list[str], allow: list[str], support: float = SUPPORT, lift: float = LIFT, least: int = LEAST) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence (of the mined rule that blocks) of every row."""
    spark = pages.sparkSession
    urls = stored(pages.select("page_id", "url").withColumn("_row", F.monotonically_increasing_id()))
    rows = urls.select("_row", "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))

    fixed = fixed_rules(spark, block, allow)
    fits = rows.select("_row", "path", F.explode(suffixes(F.col("host"))).alias("domain")).join(F.broadcast(fixed) if len(block) + len(allow) <= BROADCAST_RULES else fixed, "domain").where(F.col("path").startswith(F.col("prefix")))
    fits = fits.groupBy("_row").agg(F.max_by(F.struct("rule", "says"), F.struct(F.length("rule"), "rule")).alias("_fixed"))

    rules, items = mined(labelled, support, lift, least)
    used = checkpointed(items.join(rules.select(F.explode("antecedent").alias("item")).distinct(), "item", "left_semi"))
    own = stored(with_items(urls.select("_row", tokens(F.col("url")).alias("tokens")), used))
    seen = own.select("_row", "items", F.explode("items").alias("item"))
    index = checkpointed(filed(rules, seen.groupBy("item").count()).select("item", "antecedent", "confidence"))
    hits = seen.join(F.broadcast(index) if index.count() <= BROADCAST_RULES else index, "item").where(F.size(F.array_except("antecedent", "items")) == 0)
    hits = hits.groupBy("_row").agg(F.max("confidence").alias("confidence"))

    found = rows.join(fits, "_row", "left").join(hits, "_row", "left")
    mined_verdict = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return found.select("page_id", "host", "path", F.col("_fixed.rule").alias("rule"), F.coalesce("_fixed.says", mined_verdict).alias("verdict"), "confidence")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad): a page shows the document whose id is the first number of its path; bad is toxic or of low quality."""
    number = F.try_to_number(F.regexp_extract(path_of(F.col("url")), "/([0-9]{1,18})(?![0-9])", 1), F.lit("999999999999999999")).cast("long")
    bad = (F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)
    marks = labels.where("toxic is not null or quality is not null").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    return pages.select("url", number.alias("doc_id")).join(marks, "doc_id").select("url", "bad")
