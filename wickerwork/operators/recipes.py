"""Recipes (rules a basket satisfies when it holds every item), found by their rarest items first.

Tables: recipe_items(recipe, item, must_lead), basket_items(leader, basket, item)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wickerwork.operators.ranking import listed, number_rows, top_n
from wickerwork.session import cut_lineage


def valid_recipes(recipe_items: DataFrame, known: DataFrame) -> DataFrame:
    """Recipe rows whose items are all known items."""
    unknown = recipe_items.join(known, "item", "left_anti").select("recipe").distinct()
    return recipe_items.join(unknown, "recipe", "left_anti")


def allowed_leaders(recipe_items: DataFrame, leader_items: DataFrame) -> DataFrame:
    """(leader, recipe): leaders whose own items include every item the recipe says must lead."""
    musts = recipe_items.filter("must_lead").groupBy("recipe").agg(F.count(F.lit(1)).alias("musts"))
    held = (recipe_items.filter("must_lead").join(leader_items, "item").groupBy("leader", "recipe")
            .agg(F.count(F.lit(1)).alias("held")).join(musts, "recipe").filter(F.col("held") == F.col("musts"))
            .select("leader", "recipe"))
    return held


def by_rarity(recipe_items: DataFrame, plays: DataFrame) -> DataFrame:
    """(recipe, item, place, size): a recipe's few items, least played first. plays(item, plays)."""
    counted = recipe_items.select("recipe", "item").distinct().join(plays, "item", "left").fillna(0, ["plays"])
    whole = W.partitionBy("recipe")
    return counted.select("recipe", "item", F.row_number().over(whole.orderBy("plays", "item")).alias("place"), F.count(F.lit(1)).over(whole).alias("size"))


def recipe_sets(recipe_items: DataFrame) -> DataFrame:
    """(recipe, set): recipes of the same items have the same set, named by the first of them."""
    whole = recipe_items.groupBy("recipe").agg(F.array_sort(F.collect_set("item")).alias("_items"))
    names = whole.groupBy("_items").agg(F.min("recipe").alias("set"))
    return cut_lineage(whole.join(names, "_items").select("recipe", "set"), "recipe-sets")


def _led(found: DataFrame, recipe_items: DataFrame, leader_items: DataFrame | None) -> DataFrame:
    """Rows (leader, recipe, ...) without those of recipes with items that must lead, but for the leaders that have them."""
    musts = recipe_items.filter("must_lead").select("recipe").distinct()
    free = found.join(musts, "recipe", "left_anti")
    if leader_items is None:
        return free
    led = found.join(musts, "recipe", "left_semi").join(allowed_leaders(recipe_items, leader_items), ["leader", "recipe"])
    return free.unionByName(led.select(*free.columns))


def baskets_with_recipes(basket_items: DataFrame, recipe_items: DataFrame, leader_items: DataFrame | None = None) -> DataFrame:
    """(leader, basket, recipe): baskets holding every item of a recipe, their leader's own items counting as held. Recipes with
    items that must lead are kept to the leaders that have them. Recipes are named beside the sets baskets hold, so their rows,
    which grow with baskets times recipes, are never shuffled."""
    members = recipe_sets(recipe_items)
    found = matched_sets(basket_items, recipe_items, members, leader_items)
    musts = cut_lineage(recipe_items.filter("must_lead").select("recipe").distinct(), "musts")
    free = listed(members.join(musts, "recipe", "left_anti"), ["set"], "recipe")
    rows = found.join(free, "set").select("leader", "basket", F.explode("listed").alias("recipe"))
    if leader_items is None or musts.isEmpty():
        return rows
    led = listed(members.join(allowed_leaders(recipe_items, leader_items), "recipe"), ["leader", "set"], "recipe")
    return rows.unionByName(found.join(led, ["leader", "set"]).select("leader", "basket", F.explode("listed").alias("recipe")))


def recipe_counts(basket_items: DataFrame, recipe_items: DataFrame, leader_items: DataFrame | None = None) -> DataFrame:
    """(leader, recipe, baskets): how many baskets of a leader hold each recipe. Baskets are counted for each set of items before any
    recipe of the set is named, so recipes that are the same make no rows of their own."""
    members = recipe_sets(recipe_items)
    counts = matched_sets(basket_items, recipe_items, members, leader_items).groupBy("leader", "set").agg(F.count(F.lit(1)).alias("baskets"))
    return of_recipes(counts, recipe_items, members, leader_items)


def of_recipes(sums: DataFrame, recipe_items: DataFrame, members: DataFrame, leader_items: DataFrame | None = None) -> DataFrame:
    """Sums (leader, set, ...) over the baskets of a set as those of its recipes: (leader, recipe, ...)."""
    sums = cut_lineage(sums, "set-sums")
    return _led(sums.join(members, "set").drop("set"), recipe_items, leader_items)


def matched_sets(basket_items: DataFrame, recipe_items: DataFrame, members: DataFrame, leader_items: DataFrame | None = None,
                 told: DataFrame | None = None, items: bool = False) -> DataFrame:
    """(leader, basket, set): baskets holding every item of a set; with ``told`` (leader, basket, ...) its columns too, with ``items``
    the basket's items that recipes have.

    A basket is one row with its items. Its pairs are looked up among the pairs of two rarest items, and where it meets a set by
    them, the items beyond are looked for in the row at hand: what a basket nearly holds is never written."""
    recipe_items = recipe_items.join(members.filter("recipe = set").select("recipe"), "recipe", "left_semi")
    used = cut_lineage(recipe_items.select("item").distinct(), "recipe-items")
    bags = (basket_items.select("leader", "basket", "item").join(used.withColumn("_used", F.lit(True)), "item", "left")
            .groupBy("leader", "basket").agg(F.collect_set(F.when(F.col("_used"), F.col("item"))).alias("items")))
    if leader_items is not None:
        own = cut_lineage(leader_items.join(used, "item").groupBy("leader").agg(F.collect_set("item").alias("_own")), "own-items")
        bags = bags.join(own, "leader", "left").withColumn("items", F.when(F.col("_own").isNull(), F.col("items")).otherwise(F.array_union("items", "_own"))).drop("_own")
    if told is not None:
        bags = bags.join(told, ["leader", "basket"])
    bags = cut_lineage(bags.filter(F.size("items") > 0), "bags")
    plays = bags.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("plays"))
    at = lambda k: F.max(F.when(F.col("place") == k, F.col("item")))
    heads = cut_lineage(by_rarity(recipe_items, plays).groupBy(F.col("recipe").alias("set"), "size").agg(
        at(1).alias("_first"), at(2).alias("_second"), at(3).alias("_third"), F.collect_list(F.when(F.col("place") > 3, F.col("item"))).alias("_more")), "heads")
    shown = [c for c in bags.columns if items or c != "items"]
    one = bags.withColumn("_first", F.explode("items"))
    two = one.withColumn("_second", F.explode("items"))
    third = F.array_contains("items", F.col("_third"))
    met = [one.join(heads.filter("size = 1").select("_first", "set"), "_first")]
    # two and three items are compared as they are; a fold over more would slow those few down
    met.append(two.join(heads.filter("size in (2, 3)").select("_first", "_second", "_third", "set"), ["_first", "_second"]).filter(F.col("_third").isNull() | third))
    if not heads.filter("size > 3").isEmpty():
        long = two.join(heads.filter("size > 3").select("_first", "_second", "_third", "_more", "set"), ["_first", "_second"]).filter(third)
        met.append(long.filter(F.forall("_more", lambda i: F.array_contains("items", i))))
    return reduce(DataFrame.unionByName, [m.select(*shown, "set") for m in met])


def leader_recipes(counts: DataFrame, n: DataFrame, least: int = 5, common: float = 0.02) -> DataFrame:
    """Recipes enough of a leader's baskets hold: (leader, recipe, baskets). counts(leader, recipe, baskets)."""
    return counts.join(n, "leader").filter(F.col("baskets") >= F.greatest(F.lit(float(least)), common * F.col("n"))).drop("n")


def top_recipes(counts: DataFrame, n: int = 3000, least: int = 5) -> DataFrame:
    """The most played recipes over all leaders, ranked. Counting comes first, so one row per recipe is ranked."""
    counts = counts.groupBy("recipe").agg(F.sum("baskets").alias("baskets")).filter(F.col("baskets") >= least)
    best = counts.orderBy(F.desc("baskets"), F.asc("recipe")).limit(n)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("baskets"), F.asc("recipe"))))


def recipe_leaders(counts: DataFrame, n: int = 24) -> DataFrame:
    """The leaders playing each recipe most."""
    return top_n(counts, "recipe", [F.desc("baskets"), F.asc("leader")], n)


def deletion_keys(recipe_items: DataFrame) -> DataFrame:
    """(recipe, rest, missing): each recipe of two items or more less each of its items, ``rest`` being the sorted others."""
    whole = recipe_items.groupBy("recipe").agg(F.array_sort(F.collect_set("item")).alias("_items")).filter(F.size("_items") > 1)
    each = whole.select("recipe", "_items", F.explode("_items").alias("missing"))
    return each.select("recipe", F.filter("_items", lambda i: i != F.col("missing")).alias("rest"), "missing")


def near_recipes(query_items: DataFrame, recipe_items: DataFrame, counts: DataFrame) -> DataFrame:
    """Recipes a query is one item short of: (query, recipe, missing, baskets). counts(recipe, baskets).

    A recipe less one item is looked for like a recipe, by its rarest items, and once for all recipes that are the same but for
    that item; a query that holds it meets the lists of those recipes, one for each missing item, and lists go whose item is in the
    query's row too. Every item of a recipe of two or more is in one of its rests, so the row has all items that can be missing.
    Items and rests go by numbers in the rows that meet the lists: these are shuffled, as many as queries times what they hold."""
    wanted = recipe_items.join(counts.select("recipe"), "recipe", "left_semi").select("recipe", "item").distinct()
    numbers = cut_lineage(number_rows(wanted.select("item").distinct(), [F.asc("item")], "_i").withColumn("_i", F.col("_i").cast("int")), "item-numbers")
    numbered = lambda rows: rows.join(numbers, "item").drop("item").withColumnRenamed("_i", "item")
    keys = cut_lineage(deletion_keys(numbered(wanted)), "deletion-keys")
    different = cut_lineage(number_rows(keys.select("rest").distinct(), [F.asc("rest")], "_r").withColumn("_r", F.col("_r").cast("int")), "rest-numbers")
    keys = keys.join(different, "rest").select("recipe", F.col("_r").alias("rest"), "missing")
    rests = different.select(F.col("_r").alias("recipe"), F.explode("rest").alias("item")).withColumn("must_lead", F.lit(False))
    held = numbered(query_items.select(F.lit(0).alias("leader"), F.col("query").alias("basket"), "item"))
    members = rests.select("recipe", F.col("recipe").alias("set")).distinct()
    found = matched_sets(held, rests, members, items=True).select(F.col("set").alias("rest"), "basket", "items")
    options = listed(keys.join(counts, "recipe").select("rest", "missing", F.struct("recipe", "baskets").alias("option")), ["rest", "missing"], "option")
    named = options.join(numbers.select(F.col("_i").alias("missing"), F.col("item").alias("_name")), "missing")
    met = found.join(named, "rest").filter(~F.array_contains("items", F.col("missing")))
    return (met.select(F.col("basket").alias("query"), F.col("_name").alias("missing"), F.explode("listed").alias("option"))
            .select("query", "option.recipe", "missing", "option.baskets"))


def recipe_text(recipes: DataFrame) -> DataFrame:
    """Recipes as Markdown. recipes(recipe, names, needs, makes arrays; mana, easy, notable, steps text): symbols in
    braces become [[symbol:x]], an item is named by its front face."""

    def lines(text):
        marked = F.regexp_replace(text, r"\{([^}/]+)/?([^}]*)\}", "[[symbol:$1$2]]")
        low = F.transform(F.split(marked, r"(?=\[\[symbol:)|(?<=\]\])"),
                          lambda part: F.when(part.startswith("[[symbol:"), F.lower(part)).otherwise(part))
        return F.filter(F.transform(F.split(F.array_join(low, ""), "\n"), lambda x: F.trim(x)), lambda x: x != "")

    card = lambda c: F.concat(F.lit("[["), F.split(c, " // ")[0], F.lit("]]"))
    first = F.concat(F.transform("needs", lambda x: F.concat(F.lit("Any "), x)), lines(F.col("easy")), lines(F.col("notable")),
                     F.transform(lines(F.col("mana")), lambda x: F.concat(x, F.lit(" available"))))
    steps = F.transform(lines(F.col("steps")), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    empty = F.array().cast("array<string>")
    body = F.concat(
        F.array(F.concat(F.lit("## "), F.array_join("names", " + ")), F.lit(""),
                F.concat(F.lit("**Cards:** "), F.array_join(F.transform("names", card), " + ")), F.lit("")),
        F.when(F.size(first) > 0, F.concat(F.array(F.lit("**First:**")), F.transform(first, lambda x: F.concat(F.lit("- "), x)),
                                           F.array(F.lit("")))).otherwise(empty),
        F.array(F.lit("**Steps:**")), steps, F.array(F.lit("")),
        F.array(F.concat(F.lit("**Result:** "), F.when(F.size("makes") > 0, F.array_join("makes", ", ")).otherwise("a combo")), F.lit("")))
    return recipes.select("recipe", F.array_join(body, "\n").alias("text"))


def group_recipes(recipes: DataFrame, keys: Sequence[str] = ("leader",)) -> DataFrame:
    """(keys, recipe, head, core, option): recipes of a leader that differ in one item and need and make the same, as one group.

    recipes(keys, recipe, pos, items array, needs array, makes array). In the order ``pos``, a recipe joins the first group it is one
    item apart from, else it heads one. The first to join a head leaves the group the items both share, its core, and later ones
    must hold the core. Same-item repeats go first, by key.

    Recipes one item apart share a deletion key, so only such meet. A round decides all recipes at once whose place no undecided
    earlier one can change; the first of the undecided always can be, and all that meet in one group's core go together."""
    keys = list(keys)
    like = F.concat_ws("\u0001", F.array_join("needs", "\u0002"), F.coalesce(F.get("makes", F.lit(0)), F.lit("")), F.size("items").cast("string"))
    named = recipes.withColumn("items", F.array_sort("items")).withColumn("_like", like)
    first = named.groupBy(*keys, "items").agg(F.min_by(F.struct("recipe", "pos", "_like"), "pos").alias("_f"))
    rows = cut_lineage(first.select(*keys, "items", "_f.recipe", F.col("_f.pos").cast("long").alias("pos"), "_f._like"), "recipes")
    rest = F.filter("items", lambda i: i != F.col("_item"))
    key = F.concat_ws("\u0001", *[F.col(k).cast("string") for k in keys], "_like", F.array_join(rest.cast("array<string>"), "\u0002"))
    every = rows.withColumn("_item", F.explode("items"))
    keyed = cut_lineage(every.select(*keys, "pos", key.alias("key")), "recipe-keys")
    left, heads = keyed, keyed.select(*keys, F.col("pos").alias("head"), "key", F.lit(True).alias("open")).filter("false")
    joined, alone = None, None
    never = F.lit(1 << 62)
    while not left.isEmpty():
        # of each key: its first undecided recipe, its first group still open, its first group with it as core
        undecided = left.groupBy("key").agg(F.min("pos").alias("first"))
        groups = heads.groupBy("key").agg(F.min(F.when(F.col("open"), F.col("head"))).alias("o"), F.min(F.when(~F.col("open"), F.col("head"))).alias("c"))
        met = left.join(undecided, "key").join(groups, "key", "left")
        seen = met.groupBy(*keys, "pos").agg(
            F.min(F.when(F.col("first") < F.col("pos"), F.col("first"))).alias("u"), F.min("c").alias("c"), F.min("o").alias("o"), F.min_by("key", "o").alias("ok"))
        # of each open head: the first undecided recipe that could join it
        nearest = heads.filter("open").join(undecided, "key").groupBy(*keys, F.col("head").alias("o")).agg(F.min("first").alias("next"))
        u, c, o = (F.coalesce(x, never) for x in ("u", "c", "o"))
        ask = seen.join(nearest, [*keys, "o"], "left")
        heading = F.col("u").isNull() & F.col("c").isNull() & F.col("o").isNull()
        into_core = F.col("c").isNotNull() & (c < o) & (c < u)
        closing = F.col("o").isNotNull() & (o < c) & (o < u) & (F.col("next") == F.col("pos"))
        decided = cut_lineage(ask.withColumn("did", F.when(heading, "heads").when(into_core, "joins").when(closing, "closes")).filter("did is not null"), "decided")
        now = decided.filter("did <> 'heads'").select(*keys, "pos", F.when(F.col("did") == "joins", F.col("c")).otherwise(F.col("o")).alias("head"))
        new = decided.filter("did = 'heads'").select(*keys, "pos")
        shut = decided.filter("did = 'closes'").select(*keys, F.col("o").alias("head"), F.col("ok").alias("key"), F.lit(False).alias("open"))
        opened = keyed.join(new, [*keys, "pos"]).select(*keys, F.col("pos").alias("head"), "key", F.lit(True).alias("open"))
        heads = cut_lineage(heads.join(shut.select(*keys, "head"), [*keys, "head"], "left_anti").unionByName(shut).unionByName(opened), "recipe-heads")
        left = cut_lineage(left.join(decided.select(*keys, "pos"), [*keys, "pos"], "left_anti"), "recipe-keys")
        joined, alone = (now, new) if joined is None else (joined.unionByName(now), alone.unionByName(new))
    if joined is None:
        joined, alone = rows.select(*keys, "pos", F.col("pos").alias("head")), rows.select(*keys, "pos")
    placed = cut_lineage(joined.unionByName(alone.select(*keys, "pos", F.col("pos").alias("head"))), "recipe-groups")
    head = rows.select(*keys, F.col("pos").alias("head"), F.col("recipe").alias("_head"), F.col("items").alias("_head_items"))
    whole = rows.select(*keys, "pos", "recipe", "items").join(placed, [*keys, "pos"]).join(head, [*keys, "head"])
    # all of a group hold its core and no other two share more, so any member and the head tell it
    cores = whole.filter("pos <> head").groupBy(*keys, "head").agg(F.first(F.array_intersect("items", "_head_items")).alias("_core"))
    full = whole.join(cores, [*keys, "head"], "left").withColumn("core", F.coalesce("_core", "items"))
    option = F.get(F.array_except("items", "core"), F.lit(0)).cast("string")
    return full.select(*keys, "recipe", F.col("_head").alias("head"), F.array_sort("core").alias("core"), option.alias("option"))
