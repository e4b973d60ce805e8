"""Basket analytics: play counts, weights, similarity, recommendations, and how groups of baskets differ.

Tables: baskets(leader, basket, ...), basket_items(leader, basket, item[, copies])."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wickerwork.functions.numeric import half_even, half_up, rarity
from wickerwork.operators.ranking import carry_forward, top_n, upper_median
from wickerwork.session import cut_lineage

#: Similarities and scores are rounded to this before they rank, so summation order cannot reorder results.
DIGITS = 9
NEIGHBOURS = {"ratio": 0.3, "least": 10, "most": 100}
STAPLE_DISCOUNT = 0.5


def normalise_baskets(baskets: DataFrame, basket_items: DataFrame, leaders: DataFrame, known: DataFrame, basics: DataFrame,
                      banned: DataFrame) -> DataFrame:
    """Distinct items of the baskets that are not removed and whose leaders are all known items, less basic and banned
    items and the basket's own leaders. leaders(basket, item); known, basics, banned(item)."""
    unknown = leaders.join(known, "item", "left_anti").select("basket").distinct()
    kept = baskets.filter(F.col("removed").isNull()).join(unknown, "basket", "left_anti")
    return (basket_items.join(kept.select("basket"), "basket", "left_semi")
            .join(known, "item", "left_semi").join(basics.unionByName(banned).distinct(), "item", "left_anti")
            .join(leaders, ["basket", "item"], "left_anti").select("leader", "basket", "item").distinct())


def sizes(baskets: DataFrame, keys: Sequence[str] = ("leader",)) -> DataFrame:
    return baskets.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def play_counts(basket_items: DataFrame, keys: Sequence[str] = ("leader",), out: str = "plays") -> DataFrame:
    """Baskets playing each item, per group."""
    return basket_items.groupBy(*keys, "item").agg(F.count(F.lit(1)).alias(out))


def item_weights(plays: DataFrame, n: DataFrame) -> DataFrame:
    return plays.join(n, "leader").withColumn("weight", rarity(F.col("n"), F.col("plays")))


def basket_prices(basket_items: DataFrame, prices: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """Cents of a basket: price times copies over priced items, basics left out. prices(item, cents)."""
    if skipped is not None:
        basket_items = basket_items.join(skipped, "item", "left_anti")
    return (basket_items.join(prices.select("item", "cents"), "item", "left")
            .groupBy("leader", "basket").agg(F.coalesce(half_even(F.sum(F.col("cents") * F.col("copies"))), F.lit(0))
                                             .cast("long").alias("cents")))


def typical(df: DataFrame, value: str, missing: int, groups: DataFrame) -> DataFrame:
    """Upper median of a value per leader; ``missing`` for a leader with none."""
    return groups.join(upper_median(df, "leader", value), "leader", "left").fillna({"median": missing})


def signature(plays: DataFrame, n: DataFrame, count: int = 60) -> DataFrame:
    """A leader's items by share of its baskets less share of all baskets, most first."""
    everywhere = plays.groupBy("item").agg(F.sum("plays").alias("everywhere"))
    overall = n.select("leader", "n").withColumn("total", n.agg(F.sum("n")).scalar())
    lift = F.round(F.col("plays") / F.col("n") - F.col("everywhere") / F.col("total"), DIGITS)
    rows = plays.join(overall, "leader").join(everywhere, "item").withColumn("lift", lift)
    return top_n(rows.select("leader", "item", "lift"), "leader", [F.desc("lift"), F.asc("item")], count)


def staples(basket_items: DataFrame, total: DataFrame, least: float = 0.05) -> DataFrame:
    """Items at least ``least`` of all baskets play. total: one row, column ``n``."""
    counts = play_counts(basket_items, keys=())
    return counts.filter(F.col("plays") >= least * total.select("n").scalar()).select("item", "plays")


def usual_tag_plays(basket_items: DataFrame, item_tags: DataFrame, total: DataFrame) -> DataFrame:
    """Plays per basket of each tag's items over all baskets: (tag, usual)."""
    counts = play_counts(basket_items, keys=())
    return (counts.join(item_tags, "item").groupBy("tag").agg(F.sum("plays").alias("plays"))
            .select("tag", (F.col("plays") / total.select("n").scalar()).alias("usual")))


def leader_tags(plays: DataFrame, n: DataFrame, item_tags: DataFrame, lands: DataFrame, least_baskets: int = 100,
                common: float = 0.02) -> DataFrame:
    """(leader, tag, item): tags of a leader's common items that are not lands, tags on two items or more."""
    rows = (plays.join(n.filter(F.col("n") >= least_baskets), "leader")
            .filter(F.col("plays") >= F.greatest(F.lit(2.0), common * F.col("n")))
            .join(lands, "item", "left_anti").join(item_tags, "item").select("leader", "tag", "item"))
    kept = rows.groupBy("leader", "tag").agg(F.count(F.lit(1)).alias("k")).filter("k >= 2")
    return rows.join(kept.select("leader", "tag"), ["leader", "tag"])


def first_set_items(leaders: DataFrame, item_sets: DataFrame, sets: DataFrame, kind: str) -> DataFrame:
    """(leader, item): the items of the oldest set of a kind that any of a leader's own items is in.
    leaders(leader, item), item_sets(item, set), sets(set, released, set_type)."""
    eligible = item_sets.join(sets.filter(F.col("set_type") == kind), "set")
    oldest = (leaders.join(eligible, "item").groupBy("leader", "item")
              .agg(F.min_by("set", F.struct("released", "set")).alias("set")).select("leader", "set").distinct())
    return oldest.join(eligible.select("item", "set"), "set").select("leader", "item").distinct()


def newest(baskets: DataFrame, n: int = 10_000) -> DataFrame:
    """The newest n baskets per leader, by update date then id as text."""
    order = [F.desc("updated"), F.desc(F.col("basket").cast("string"))]
    return top_n(baskets, "leader", order, n)


def made_dates(baskets: DataFrame, width: int = 100_000) -> DataFrame:
    """When each basket was made: its own date, or that of the last dated basket numbered at or before it; text ids and
    removed baskets give and take no date by number. baskets(id BIGINT null for text ids, basket, created, removed)."""
    numbered = baskets.filter(F.col("id").isNotNull())
    anchor = F.when(F.col("removed").isNull(), F.col("created"))
    carried = carry_forward(numbered.withColumn("_anchor", anchor), [], "id", "_anchor", "_made", width=width)
    dated = carried.withColumn("made", F.coalesce("created", "_made")).drop("_anchor", "_made")
    return dated.unionByName(baskets.filter(F.col("id").isNull()).withColumn("made", F.col("created")))


# ---- similarity and recommendations ---------------------------------------------------------------------------


def weighted_queries(queries: DataFrame, weights: DataFrame, n: DataFrame) -> DataFrame:
    """queries(query, leader, item) with weights; an item no basket of the leader plays weighs ln(n) squared."""
    return (queries.distinct().join(n, "leader").join(weights.select("leader", "item", "weight"), ["leader", "item"], "left")
            .select("query", "leader", "item", F.coalesce("weight", F.pow(F.log("n"), 2)).alias("weight")))


def similarity(queries: DataFrame, basket_items: DataFrame, plays: DataFrame, n: DataFrame) -> DataFrame:
    """Rarity-weighted cosine of each query basket with its leader's baskets: (query, leader, basket, similarity, shared).

    Baskets sharing nothing with the query have similarity 0 and no row. Baskets are laid out by basket once; norms and
    overlaps are both sums in that layout, and the queries' side is broadcast by the adaptive plan while it is small."""
    weights = item_weights(plays, n)
    mine = weighted_queries(queries, weights, n)
    norms = mine.groupBy("query", "leader").agg(F.sum("weight").alias("norm"))
    weighted = basket_items.select("leader", "basket", "item").join(weights.select("leader", "item", "weight"), ["leader", "item"])
    theirs = weighted.groupBy("leader", "basket").agg(F.sum("weight").alias("theirs"))
    dots = (weighted.join(mine.select("query", "leader", "item"), ["leader", "item"])
            .groupBy("query", "leader", "basket").agg(F.sum("weight").alias("dot"), F.count(F.lit(1)).alias("shared")))
    cosine = F.when(F.col("dot") > 0, F.col("dot") / F.sqrt(F.col("norm") * F.col("theirs"))).otherwise(F.lit(0.0))
    return (dots.join(theirs, ["leader", "basket"]).join(norms, ["query", "leader"])
            .select("query", "leader", "basket", F.round(cosine, DIGITS).alias("similarity"), "shared"))


def rank_similar(similar: DataFrame, n: int) -> DataFrame:
    return top_n(similar, "query", [F.desc("similarity"), F.desc("shared"), F.asc("basket")], n)


def neighbours(similar: DataFrame, ratio: float = 0.3, least: int = 10, most: int = 100) -> DataFrame:
    """Who votes: up to ``most`` of the most similar, past the first ``least`` only those at ``ratio`` of the best."""
    ranked = rank_similar(similar.filter(F.col("similarity") > 0), most)
    best = F.max("similarity").over(W.partitionBy("query"))
    return ranked.withColumn("best", best).filter((F.col("rank") <= least) | (F.col("similarity") >= ratio * F.col("best")))


def votes(near: DataFrame, basket_items: DataFrame) -> DataFrame:
    """(query, leader, item, share, baskets): similarity-weighted share of the neighbours playing each item."""
    total = near.groupBy("query").agg(F.sum("similarity").alias("total"))
    return (near.select("query", "leader", "basket", "similarity").join(basket_items.select("leader", "basket", "item"), ["leader", "basket"])
            .groupBy("query", "leader", "item").agg(F.sum("similarity").alias("votes"), F.count(F.lit(1)).alias("baskets"))
            .join(total, "query").withColumn("share", F.col("votes") / F.col("total")).drop("votes", "total"))


def recommend_adds(voted: DataFrame, queries: DataFrame, plays: DataFrame, n: DataFrame,
                   discount: float = STAPLE_DISCOUNT) -> DataFrame:
    """Items the neighbours play that the query does not, by share less part of their usual share."""
    return (voted.join(queries.select("query", "item").distinct(), ["query", "item"], "left_anti")
            .join(plays, ["leader", "item"]).join(n, "leader")
            .withColumn("score", F.round(F.col("share") - discount * F.col("plays") / F.col("n"), DIGITS))
            .select("query", "leader", "item", "share", "baskets", "score"))


def recommend_cuts(voted: DataFrame, queries: DataFrame) -> DataFrame:
    """The query's own items with their share of the neighbours (0 when none plays it)."""
    return (queries.select("query", "leader", "item").distinct()
            .join(voted.select("query", "item", "share"), ["query", "item"], "left")
            .select("query", "leader", "item", F.round(F.coalesce("share", F.lit(0.0)), DIGITS).alias("share")))


def shown_cuts(cuts: DataFrame, below: float = 0.1, n: int = 16) -> DataFrame:
    return top_n(cuts.filter(F.col("share") < below), "query", [F.asc("share"), F.asc("item")], n)


def fold_copies(similar: DataFrame, basket_items: DataFrame, limit: int, alike: float = 0.9) -> DataFrame:
    """Most similar baskets, near-copies folded into the first shown that shares ``alike`` of their items together.

    Each round shows every query's best basket left and folds the copies of it, by counting shared items in a join;
    a basket ranked after the last one shown is not counted. (query, basket, similarity, shown, copies)"""
    items = basket_items.select("leader", "basket", "item").distinct()
    counts = items.groupBy("leader", "basket").agg(F.count(F.lit(1)).alias("size"))
    left = cut_lineage(similar.join(counts, ["leader", "basket"]))
    order = F.struct(-F.col("similarity"), -F.col("shared"), F.col("basket"))
    found = None
    for round_ in range(limit):
        first = left.groupBy("query", "leader").agg(F.min(order).alias("_at")).select(
            "query", "leader", F.col("_at.basket").alias("first"), "_at")
        if first.limit(1).count() == 0:
            break
        head = first.join(items, (first["first"] == items["basket"]) & (first["leader"] == items["leader"])).select(
            first["query"], first["leader"], "item")
        sized = first.join(counts.select("leader", F.col("basket").alias("first"), F.col("size").alias("first_size")), ["leader", "first"])
        overlap = (left.select("query", "leader", "basket").join(items, ["leader", "basket"]).join(head, ["query", "leader", "item"])
                   .groupBy("query", "leader", "basket").agg(F.count(F.lit(1)).alias("both")))
        jaccard = F.col("both") / (F.col("size") + F.col("first_size") - F.col("both"))
        judged = (left.join(sized, ["query", "leader"]).join(overlap, ["query", "leader", "basket"], "left").fillna(0, ["both"])
                  .withColumn("_gone", (F.col("basket") == F.col("first")) | (jaccard >= alike)))
        judged = cut_lineage(judged.select("query", "leader", "basket", "similarity", "shared", "size", "first", "_at", "_gone"))
        gone = judged.filter("_gone").select("query", "basket", "similarity", F.col("first"), order.alias("_order"), "_at",
                                             F.lit(round_).alias("shown"))
        found = gone if found is None else found.unionByName(gone)
        left = judged.filter("not _gone").select("query", "leader", "basket", "similarity", "shared", "size")
    last = found.groupBy("query").agg(F.max("shown").alias("_last"), F.max("_at").alias("_end"))
    full = F.col("_last") == limit - 1
    return (found.join(last, "query").filter(~full | (F.col("_order") <= F.col("_end")))
            .groupBy("query", "shown", F.col("first").alias("basket"))
            .agg(F.max("similarity").alias("similarity"), (F.count(F.lit(1)) - 1).alias("copies")))


def evaluate(baskets: DataFrame, basket_items: DataFrame, hidden: int, queries_per_leader: int, shown: int = 20,
             seed: int = 1) -> DataFrame:
    """Hide items of sampled baskets, recommend them back, and report per leader the share found in the top ``shown``,
    beside plain popularity. Sampling and hiding go by hash, so a run can be repeated."""
    pick = F.xxhash64(F.lit(seed), "leader", "basket")
    counted = basket_items.groupBy("leader", "basket").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > hidden)
    tested = top_n(counted, "leader", [pick.asc(), F.asc("basket")], queries_per_leader).select("leader", "basket")
    theirs = basket_items.select("leader", "basket", "item").distinct().join(tested, ["leader", "basket"])
    order = W.partitionBy("basket").orderBy(F.xxhash64(F.lit(seed + 1), "basket", "item"), "item")
    marked = cut_lineage(theirs.withColumn("_k", F.row_number().over(order)))
    held = marked.filter(F.col("_k") <= hidden).select(F.col("basket").alias("query"), "leader", "item")
    queries = marked.filter(F.col("_k") > hidden).select(F.col("basket").alias("query"), "leader", "item")
    rest = basket_items.join(tested, ["leader", "basket"], "left_anti")
    plays, n = play_counts(rest), sizes(baskets.join(tested, ["leader", "basket"], "left_anti"))
    near = neighbours(similarity(queries, rest, plays, n))
    adds = top_n(recommend_adds(votes(near, rest), queries, plays, n), "query", [F.desc("score"), F.asc("item")], shown)
    popular = top_n(queries.select("query", "leader").distinct().join(plays, "leader")
                    .join(queries.select("query", "item"), ["query", "item"], "left_anti"),
                    "query", [F.desc("plays"), F.asc("item")], shown)
    hit = lambda found, name: (held.join(found.select("query", "item"), ["query", "item"]).groupBy("leader")
                               .agg(F.count(F.lit(1)).alias(name)))
    return (held.groupBy("leader").agg(F.count(F.lit(1)).alias("hidden"))
            .join(hit(adds, "recommended"), "leader", "left").join(hit(popular, "popular"), "leader", "left").fillna(0)
            .select("leader", "hidden", (F.col("recommended") / F.col("hidden")).alias("recommended_share"),
                    (F.col("popular") / F.col("hidden")).alias("popular_share")))


# ---- groups of baskets ----------------------------------------------------------------------------------------


def distinctive(grouped: DataFrame, plays: DataFrame, n: DataFrame, group_sizes: DataFrame, ignore: DataFrame | None = None,
                count: int = 12) -> DataFrame:
    """The items a group plays more than all its leader's baskets. grouped(leader, grp, basket, item),
    group_sizes(leader, grp, members)."""
    here = grouped.groupBy("leader", "grp", "item").agg(F.count(F.lit(1)).alias("here"))
    if ignore is not None:
        here = here.join(ignore, "item", "left_anti")
    lift = F.round(F.col("here") / F.col("members") - F.col("plays") / F.col("n"), DIGITS)
    rows = (here.join(group_sizes, ["leader", "grp"]).join(plays, ["leader", "item"]).join(n, "leader")
            .select("leader", "grp", "item", lift.alias("lift")))
    return top_n(rows, ["leader", "grp"], [F.desc("lift"), F.asc("item")], count)


def tag_scores(here: DataFrame, members: DataFrame, usual: DataFrame, item_tags: DataFrame, keys: Sequence[str],
               usual_keys: Sequence[str] = (), least: float = 0.5) -> DataFrame:
    """(keys, tag, more, score): plays per basket of a tag's items in a group over the usual, relative to its root.
    here(keys, item, plays), members(keys, members), usual(usual_keys, tag, usual)."""
    keys, usual_keys = list(keys), list(usual_keys)
    mine = (here.join(item_tags, "item").groupBy(*keys, "tag").agg(F.sum("plays").alias("k"))
            .join(members, keys).join(usual, [*usual_keys, "tag"]))
    more = F.round(F.col("k") / F.col("members") - F.col("usual"), DIGITS)
    return (mine.withColumn("more", more).filter(F.col("more") >= least)
            .withColumn("score", F.round(F.col("more") / F.sqrt(F.col("usual") + 1), DIGITS))
            .select(*keys, "tag", "more", "score"))


def pick_tags(scores: DataFrame, tag_items: DataFrame, keys: Sequence[str], count: int, alike: float = 0.5) -> DataFrame:
    """The best-scored tags of each group, skipping one that shares half its items with a better one.

    tag_items(keys, tag, item). Overlaps are counted in a join; the greedy walk then folds over a group's few dozen
    scored tags inside one expression."""
    keys = list(keys)
    tagged = scores.join(tag_items, [*keys, "tag"]).select(*keys, "tag", "score", "item")
    held = tagged.groupBy(*keys, "tag", "score").agg(F.count(F.lit(1)).alias("held"))
    left = tagged.select(*keys, "item", F.struct(-F.col("score"), F.col("tag")).alias("_at"), "tag")
    right = tagged.select(*keys, "item", F.struct(-F.col("score"), F.col("tag")).alias("_better"), F.col("tag").alias("better"))
    both = (left.join(right, [*keys, "item"]).filter(F.col("_better") < F.col("_at"))
            .groupBy(*keys, "tag", "better").agg(F.count(F.lit(1)).alias("both")))
    other = held.select(*keys, F.col("tag").alias("better"), F.col("held").alias("other"))
    rivals = (both.join(held.drop("score"), [*keys, "tag"]).join(other, [*keys, "better"])
              .filter(F.col("both") / (F.col("held") + F.col("other") - F.col("both")) >= alike)
              .groupBy(*keys, "tag").agg(F.collect_set("better").alias("rivals")))
    listed = (held.join(rivals, [*keys, "tag"], "left")
              .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
                  (-F.col("score")).alias("s"), F.col("tag"),
                  F.coalesce("rivals", F.array().cast("array<string>")).alias("rivals")))).alias("_tags")))
    walk = F.aggregate("_tags", F.array().cast("array<string>"), lambda kept, t: F.when(
        (F.size(kept) < count) & ~F.arrays_overlap(kept, t["rivals"]), F.array_append(kept, t["tag"])).otherwise(kept))
    return listed.select(*keys, F.posexplode(walk).alias("pos", "tag"))


def average_basket(grouped: DataFrame, members: DataFrame, lands: DataFrame, keys: Sequence[str] = ("leader",)) -> DataFrame:
    """(keys, land, item, rank): the most played items, as many lands and others as the mean basket has.
    grouped(keys, basket, item), members(keys, members), lands(item)."""
    keys = list(keys)
    marked = grouped.join(lands.select("item", F.lit(True).alias("land")), "item", "left").fillna({"land": False})
    counts = marked.groupBy(*keys, "land", "item").agg(F.count(F.lit(1)).alias("k"))
    wanted = (counts.groupBy(*keys, "land").agg(F.sum("k").alias("total")).join(members, keys)
              .select(*keys, "land", half_up(F.col("total") / F.col("members")).alias("wanted")))
    place = F.row_number().over(W.partitionBy(*keys, "land").orderBy(F.desc("k"), F.asc("item")))
    return (counts.withColumn("rank", place).join(wanted, [*keys, "land"]).filter(F.col("rank") <= F.col("wanted"))
            .select(*keys, "land", "item", "rank"))


def basic_fill(averaged: DataFrame, kinds: DataFrame, leader_count: int = 1, full: int = 100) -> DataFrame:
    """Copies of each basic kind that fill an average basket to ``full``, split evenly, the first kinds one more.
    averaged(leader, item...), kinds(leader, kind, pos from 0)."""
    lacking = averaged.groupBy("leader").agg(F.count(F.lit(1)).alias("held")).select(
        "leader", F.greatest(F.lit(0), full - leader_count - F.col("held")).alias("basics"))
    k = F.count(F.lit(1)).over(W.partitionBy("leader"))
    return (kinds.withColumn("_k", k).join(lacking, "leader")
            .withColumn("copies", F.floor(F.col("basics") / F.col("_k"))
                        + F.when(F.col("pos") < F.col("basics") % F.col("_k"), 1).otherwise(0))
            .filter("copies > 0").select("leader", "kind", "copies"))


def played_differently(grouped: DataFrame, members: DataFrame, keys: Sequence[str], a, b, least: float = 0.15,
                       n: int = 6) -> DataFrame:
    """Items group b plays more or less than group a, n each way, with pooled standard errors.
    grouped(keys, side, basket, item), members(keys, side, members)."""
    keys = list(keys)
    on = lambda s, c: F.sum(F.when(F.col("side") == s, F.col(c)).otherwise(0))
    size = members.groupBy(*keys).agg(on(a, "members").alias("na"), on(b, "members").alias("nb"))
    counts = grouped.groupBy(*keys, "item", "side").agg(F.count(F.lit(1)).alias("k"))
    rows = (counts.groupBy(*keys, "item").agg(on(a, "k").alias("ka"), on(b, "k").alias("kb")).join(size, keys)
            .filter((F.col("na") > 0) & (F.col("nb") > 0)))
    p = F.try_divide(F.col("ka") + F.col("kb"), F.col("na") + F.col("nb"))
    se = F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1.0), F.col("na")) + F.try_divide(F.lit(1.0), F.col("nb"))))
    rows = (rows.withColumn("a", F.try_divide("ka", "na")).withColumn("b", F.try_divide("kb", "nb"))
            .withColumn("evidence", F.coalesce(F.try_divide(F.col("b") - F.col("a"), se), F.lit(0.0)))
            .filter(F.greatest("a", "b") >= least).withColumn("gap", F.round(F.col("b") - F.col("a"), DIGITS)).filter("gap <> 0")
            .withColumn("direction", F.when(F.col("gap") > 0, "more").otherwise("less")))
    return top_n(rows.select(*keys, "direction", "item", "a", "b", "evidence", "gap"), [*keys, "direction"],
                 [F.desc(F.abs("gap")), F.asc("item")], n)


def leader_of(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Which leader a query is compared with: its own if known, else its guess, else the closest.
    candidates(query, own, guess, closest), known(leader)."""
    sure = known.select(F.col("leader").alias("own"), F.lit(True).alias("_known"))
    return (candidates.join(sure, "own", "left")
            .select("query", F.when(F.col("_known"), F.col("own")).otherwise(F.coalesce("guess", "closest")).alias("leader")))


def guess_leader(query_items: DataFrame, leader_items: DataFrame, n: DataFrame) -> DataFrame:
    """The most played leader all of whose items a query holds, pairs before single ones.
    query_items(query, item), leader_items(leader, item), n(leader, n)."""
    size = leader_items.groupBy("leader").agg(F.count(F.lit(1)).alias("parts"))
    full = (query_items.join(leader_items, "item").groupBy("query", "leader").agg(F.countDistinct("item").alias("held"))
            .join(size, "leader").filter(F.col("held") == F.col("parts")).join(n, "leader"))
    return top_n(full, "query", [F.desc(F.col("parts") > 1), F.desc("n"), F.asc("leader")], 1).select("query", F.col("leader").alias("guess"))


def closest_leaders(query_items: DataFrame, signatures: DataFrame, n: DataFrame, count: int = 6) -> DataFrame:
    """Leaders by how many of their signature items a query plays, ties to the one with more baskets."""
    overlap = (query_items.join(signatures.select("leader", "item"), "item")
               .groupBy("query", "leader").agg(F.count(F.lit(1)).alias("overlap")).join(n, "leader"))
    return top_n(overlap, "query", [F.desc("overlap"), F.desc("n"), F.asc("leader")], count)


def jaccard(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Shared share of two baskets' items. pairs(a, b); left, right(basket, item)."""
    a = left.select(F.col("basket").alias("a"), "item")
    b = right.select(F.col("basket").alias("b"), "item")
    na = a.groupBy("a").agg(F.count(F.lit(1)).alias("na"))
    nb = b.groupBy("b").agg(F.count(F.lit(1)).alias("nb"))
    both = pairs.join(a, "a").join(b, ["b", "item"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    return (pairs.join(na, "a").join(nb, "b").join(both, ["a", "b"], "left").fillna(0, ["both"])
            .withColumn("jaccard", F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))))


def symmetric_difference(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """(query, item, side): in theirs but not mine ('add'), in mine but not theirs ('cut')."""
    add = theirs.join(mine, ["query", "item"], "left_anti").withColumn("side", F.lit("add"))
    cut = mine.join(theirs, ["query", "item"], "left_anti").withColumn("side", F.lit("cut"))
    return add.unionByName(cut)


def within_colors(df: DataFrame, identity: Column, colors: Column) -> DataFrame:
    """Rows whose identity mask has no bit outside ``colors``."""
    return df.filter(identity.bitwiseAND(F.bitwise_not(colors)) == 0)


def random_niche(shares: DataFrame, seed: int, keys: Sequence[str] = ("leader",), middle: float = 0.15, reach: float = 0.1) -> DataFrame:
    """One item some but not most baskets play, picked by hash. shares(keys, item, share)."""
    niche = shares.filter(F.abs(F.col("share") - middle) <= reach)
    return top_n(niche, list(keys), [F.md5(F.concat_ws(":", F.lit(str(seed)), *keys, "item")).asc()], 1).drop("rank")
