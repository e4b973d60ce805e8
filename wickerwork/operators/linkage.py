"""Linking our variants with another guide's, by blocking joins and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wickerwork.functions.text import fold_key, lookup
from wickerwork.operators.textjoin import contains_join
from wickerwork.session import cut_lineage

#: The words variants of the guide go by for each promo type.
PROMO_TAGS = {"prerelease": "prerelease", "datestamped": "prerelease", "promopack": "stamp", "stamped": "stamp", "buyabox": "buy-a-box",
              "bundle": "bundle", "release": "release", "boxtopper": "topper", "judgegift": "judge", "fnm": "fnm", "gameday": "game day", "instore": "store"}


def same_name(a: Column, b: Column) -> Column:
    """Folded names equal but for a plural."""
    bare = lambda c: F.regexp_replace(fold_key(c), "s+$", "")
    return F.coalesce((b != "") & (bare(a) == bare(b)), F.lit(False))


def _bare(c: Column) -> Column:
    """What names that are the same but for a plural share; null for an empty one, which is like no other."""
    return F.nullif(F.regexp_replace(fold_key(c), "s+$", ""), F.lit(""))


def _tagged(kind: str, keys: Column) -> Column:
    """An array of keys of one kind, nulls left out."""
    return F.transform(F.filter(F.array_distinct(keys), lambda k: k.isNotNull()), lambda k: F.concat(F.lit(f"{kind}:"), k))


def _promo_words(listed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(slug, tag, word): the wanted promo words that a promo listing's set or tag has in it. Few sets and tags are different,
    and so are few words; they meet by their letter groups."""
    words = wanted.select(F.col("word").alias("query"), F.col("word").alias("q")).distinct()
    texts = listed.filter(F.col("code").startswith("PRM")).select("slug", "tag").distinct()
    # a sign that no word has stands between the two
    texts = texts.withColumn("_both", F.concat_ws("\u0001", fold_key(F.col("tag")), fold_key(F.col("slug"))))
    return contains_join(texts, words, "_both").select("slug", "tag", F.col("q").alias("word")).distinct()


def _alike(rows: DataFrame, keys: list[str], told: list[str]) -> DataFrame:
    """keys and ``_told``, the sorted set of what the rows of a key tell: keys that tell the same link the same."""
    return cut_lineage(rows.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct(*told))).alias("_told")), "told")


def link_variants(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(variant, guide_id, pass, score, sure): the guide's listing of each of our variants.

    ours(variant, name, foil, set_name, codes array, parent_name, parent_codes array, number, promo_types array);
    theirs(name, foil, pos, slug, number null, code, tag, guide_id). A listing may be of the variant's set, a tagged one of the set
    it is from, or one of a promo set its types name; the first of these ways that finds any is used, and of several the one
    that scores best, the earliest on a tie. Each way has keys of its own, a set's name or code or a promo word, which a listing
    meets together with its name, finish and number (or having none), so a name that thousands of sets print makes no pairs
    across them. Variants that tell the same are linked once, by the first of them, and listings that tell the same are met once,
    by the earliest, and counted: copies of either make no pairs."""
    variants = _alike(ours, ["variant"], [c for c in ours.columns if c != "variant"])
    firsts = cut_lineage(variants.groupBy("_told").agg(F.min("variant").alias("first")), "alike-variants")
    members = variants.join(firsts, "_told").select("first", "variant")
    ours = firsts.select(F.col("first").alias("variant"), F.explode("_told").alias("_o")).select("variant", "_o.*")
    listings = _alike(theirs, ["guide_id", "pos"], ["name", "foil", "slug", "number", "code", "tag"])
    listings = cut_lineage(listings.groupBy("_told").agg(F.min(F.struct("pos", "guide_id")).alias("_l"), F.count(F.lit(1)).alias("copies")), "alike-listings")
    theirs = listings.select("_l.*", "copies", F.explode("_told").alias("_t")).select("pos", "guide_id", "copies", "_t.*")
    tail = F.element_at(F.split("number", "-"), -1)
    mine = ours.withColumns({
        "_numbers": F.array("number", tail, F.regexp_replace(tail, r"\D+$", ""), F.regexp_replace(tail, r"^\D+|\D+$", "")),
        "_wanted": F.transform("promo_types", lambda t: fold_key(F.coalesce(lookup(PROMO_TAGS)[t], t)))})
    listed = theirs.select("name", "foil", "pos", "slug", F.col("number").alias("their_number"), F.col("code"), F.coalesce("tag", F.lit("")).alias("tag"), "guide_id", "copies")
    none = F.array().cast("array<string>")
    words = lambda c: F.coalesce(c, none)
    keys = F.concat(_tagged("name", F.array(_bare(F.col("set_name")))), _tagged("code", words(F.col("codes"))),
                    _tagged("of name", F.array(_bare(F.col("parent_name")))), _tagged("of code", words(F.col("parent_codes"))), _tagged("word", words(F.col("_wanted"))))
    unnumbered = F.lit("\u0000")
    mine = mine.withColumn("_key", F.explode(keys)).withColumn("_n", F.explode(F.array_distinct(F.concat("_numbers", F.array(unnumbered)))))
    found = _promo_words(listed, mine.select(F.explode("_wanted").alias("word")).filter("word <> ''"))
    told = found.groupBy("slug", "tag").agg(F.collect_set("word").alias("_words"))
    slug, code = F.array(_bare(F.col("slug"))), F.array(F.lower("code"))
    own = F.concat(_tagged("name", slug), _tagged("code", code))
    parent = F.when(F.col("tag") != "", F.concat(_tagged("of name", slug), _tagged("of code", code))).otherwise(none)
    promo_keys = F.when(F.col("code").startswith("PRM"), _tagged("word", words(F.col("_words")))).otherwise(none)
    keyed = listed.join(told, ["slug", "tag"], "left").withColumn("_key", F.explode(F.concat(own, parent, promo_keys))).drop("_words")
    keyed = keyed.withColumn("_n", F.coalesce("their_number", unnumbered))
    rows = mine.join(keyed, ["name", "foil", "_n", "_key"]).withColumns({"_tag": fold_key(F.col("tag")), "_slug": fold_key(F.col("slug"))})
    by_tag = F.exists("_wanted", lambda w: F.contains(F.col("_tag"), w))
    named = by_tag | F.exists("_wanted", lambda w: F.contains(F.col("_slug"), w))
    promo_words = F.array(*[F.lit(w) for w in sorted({"".join(c for c in v if c.isalnum()) for v in PROMO_TAGS.values()})])
    promo = F.exists(promo_words, lambda w: F.contains(F.col("_tag"), w)) & ~by_tag
    low = F.lower("code")
    in_set = (same_name(F.col("slug"), F.col("set_name")) | F.array_contains("codes", low)) & ~promo
    of_parent = (F.col("tag") != "") & (same_name(F.col("slug"), F.col("parent_name")) | F.coalesce(F.array_contains("parent_codes", low), F.lit(False)))
    way = F.when(in_set, 0).when(of_parent, 1).when(F.col("code").startswith("PRM") & named, 2)
    exact = F.when(F.col("their_number") == F.col("number"), 2).when(F.col("their_number").isNotNull(), 1).otherwise(0)
    score = exact + F.when((F.col("tag") != "") & by_tag, 2).otherwise(0) + (F.col("tag") == "").cast("int")
    rows = rows.withColumns({"pass": way, "score": score}).filter(F.col("pass").isNotNull())
    rows = rows.select("variant", "guide_id", "pos", "copies", "pass", "score").distinct()  # a pair meets by every key it shares
    order = W.partitionBy("variant").orderBy("pass", F.desc("score"), "pos", "guide_id")
    ties = F.sum("copies").over(W.partitionBy("variant", "pass", "score"))
    return (rows.withColumns({"_k": F.row_number().over(order), "_ties": ties}).filter("_k = 1").withColumnRenamed("variant", "first").join(members, "first")
            .select("variant", "guide_id", "pass", "score", ((F.col("_ties") == 1) & (F.col("pass") == 0)).alias("sure")))


def plausible(links: DataFrame, latest: DataFrame, prices: DataFrame, sure: float = 5.0, unsure: float = 2.0) -> DataFrame:
    """Links whose latest price there is within a factor of ours. latest(guide_id, theirs), prices(variant, ours)."""
    rows = links.join(latest, "guide_id").join(prices, "variant")
    within = F.when(F.col("sure"), sure).otherwise(unsure)
    ratio = F.try_divide("theirs", "ours")
    return rows.filter(ratio.between(1 / within, within))


def match_sets(theirs: DataFrame, ours: DataFrame) -> DataFrame:
    """(set, code): the guide's code of each of our sets, by folded name or else by code; the first of several wins.
    theirs(slug, name, code), ours(set, set_name)."""
    names = ours.groupBy(fold_key(F.col("set_name")).alias("key")).agg(F.min("set").alias("by_name"))
    codes = ours.select("set").distinct().select(F.col("set").alias("low"), F.col("set").alias("by_code"))
    rows = theirs.withColumns({"key": fold_key(F.col("name")), "low": F.lower("code")}).join(names, "key", "left").join(codes, "low", "left")
    found = rows.select("slug", "code", F.coalesce("by_name", "by_code").alias("set")).filter("set is not null")
    return found.groupBy("set").agg(F.min_by("code", "slug").alias("code"))
