"""Bundles: items a leader's baskets play together more than chance would have it, and who plays how much of one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wickerwork.functions.numeric import phi
from wickerwork.operators.baskets import DIGITS
from wickerwork.operators.pairs import candidates, pair_counts, strong_links
from wickerwork.operators.ranking import top_n

PHI, MAX_BUNDLE = 0.3, 8
TUNED_TOP, BAND_BASKETS, TUNED_BANDS = 60, 100, 5


def coverage(sets: DataFrame, basket_items: DataFrame) -> DataFrame:
    """(leader, basket, bundle, held, size): how many of a bundle's items each basket that plays any of them plays.
    sets(leader, bundle, item)."""
    size = sets.groupBy("leader", "bundle").agg(F.count(F.lit(1)).alias("size"))
    return (basket_items.select("leader", "basket", "item").join(sets, ["leader", "item"]).groupBy("leader", "basket", "bundle")
            .agg(F.count(F.lit(1)).alias("held")).join(size, ["leader", "bundle"]))


def classify(covered: DataFrame) -> DataFrame:
    """``held`` of ``size`` as all or some (a basket with no row plays none)."""
    return covered.withColumn("has", F.when(F.col("held") == F.col("size"), "all").otherwise("some"))


def runs(sets: DataFrame, basket_items: DataFrame) -> DataFrame:
    """(leader, bundle, basket): the baskets playing every item of a bundle."""
    return coverage(sets, basket_items).filter("held = size").select("leader", "bundle", "basket")


def pair_set_counts(running: DataFrame, n: DataFrame) -> DataFrame:
    """(leader, a, b, ka, kb, both, n, phi): baskets running each of two bundles and both, of all pairs of a leader's bundles.
    running(leader, bundle, basket). Bundles of a basket are counted like its items, so no row is made for a basket and pair."""
    counted = running.groupBy("leader", "bundle").agg(F.count(F.lit(1)).alias("k"))
    ka, kb = (counted.select("leader", F.col("bundle").alias(x), F.col("k").alias(f"k{x}")) for x in "ab")
    both = pair_counts(running.select("leader", "basket", F.col("bundle").alias("item")).distinct())
    pairs = ka.join(kb, "leader").filter("a < b").join(both, ["leader", "a", "b"], "left").fillna(0, ["both"])
    return pairs.join(n, "leader").withColumn("phi", F.round(phi(F.col("both"), F.col("ka"), F.col("kb"), F.col("n")), DIGITS))


def stratify(basket_items: DataFrame, clusters: DataFrame, lands: DataFrame, limited: DataFrame, top: int = TUNED_TOP,
             band: int = BAND_BASKETS, bands: int = TUNED_BANDS) -> DataFrame:
    """(leader, basket, grp): groups of alike baskets, by cluster, by how many of its cluster's most played items a basket
    has (equal-count bands), and by how many limited items. clusters(leader, basket, cluster)."""
    rows = clusters.join(basket_items, ["leader", "basket"])
    counts = rows.join(lands, "item", "left_anti").groupBy("leader", "cluster", "item").agg(F.count(F.lit(1)).alias("k"))
    most = top_n(counts, ["leader", "cluster"], [F.desc("k"), F.asc("item")], top).select("leader", "cluster", "item")
    tuned = rows.join(most, ["leader", "cluster", "item"]).groupBy("leader", "basket").agg(F.count(F.lit(1)).alias("tuned"))
    few = rows.join(limited, "item").groupBy("leader", "basket").agg(F.count(F.lit(1)).alias("limited"))
    full = clusters.join(tuned, ["leader", "basket"], "left").join(few, ["leader", "basket"], "left").fillna(0, ["tuned", "limited"])
    # place in the order by tuned, from the counts of each tuned value: within a value baskets are placed by 1,024 hash
    # slices, so no task sorts a whole cluster
    part = full.withColumn("_slice", F.pmod(F.xxhash64("basket"), F.lit(1024)))
    sizes = part.groupBy("leader", "cluster", "tuned", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    order = W.partitionBy("leader", "cluster").orderBy("tuned", "_slice")
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    members = F.sum("_n").over(W.partitionBy("leader", "cluster"))
    starts = starts.withColumn("members", members).drop("_n")
    inner = F.row_number().over(W.partitionBy("leader", "cluster", "tuned", "_slice").orderBy("basket"))
    placed = part.withColumn("_in", inner).join(starts, ["leader", "cluster", "tuned", "_slice"])
    count = F.greatest(F.lit(1), F.least(F.lit(bands), F.floor(F.col("members") / band)))
    slot = F.floor((F.col("_start") + F.col("_in") - 1) * count / F.col("members"))
    step = F.when(F.col("limited") == 0, 0).when(F.col("limited") <= 3, 1).when(F.col("limited") <= 7, 2).otherwise(3)
    return placed.select("leader", "basket", ((F.col("cluster") * bands + slot) * 4 + step).alias("grp"))


def grow_bundles(links: DataFrame, barred: DataFrame, staples: DataFrame, precon: DataFrame, order: DataFrame, least: float = PHI,
                 most: int = MAX_BUNDLE) -> DataFrame:
    """(leader, bundle, item, pos): bundles grown from each leader's strongest pair by the item whose weakest link to those
    in is strongest. links(leader, a, b, link); barred(item) may join but not start one; order(leader, item, place).

    The walk is sequential, so a leader's links are one group. Only links at ``least`` or more come here, between its
    candidate items (see ``candidates``): a bounded table however many baskets the leader has."""
    strong = links.filter(F.col("link") >= least)
    oa = order.select("leader", F.col("item").alias("a"), F.col("place").alias("pa"))
    ob = order.select("leader", F.col("item").alias("b"), F.col("place").alias("pb"))
    mark = lambda df, name: df.select("item", F.lit(True).alias(name))
    rows = strong.join(oa, ["leader", "a"]).join(ob, ["leader", "b"])
    for side in ("a", "b"):
        for flags, name in ((barred, "land"), (staples, "staple")):
            rows = rows.join(mark(flags, f"{name}_{side}").withColumnRenamed("item", side), side, "left")
        rows = rows.join(precon.select("leader", F.col("item").alias(side), F.lit(True).alias(f"precon_{side}")), ["leader", side], "left")
    rows = rows.fillna(False)
    types = {f.name: f.dataType.simpleString() for f in links.schema.fields}
    schema = f"leader {types['leader']}, bundle bigint, item {types['a']}, pos int"

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        link: dict = {}
        place, flags, name = {}, {}, {}
        seeds = []
        for r in pdf.itertuples(index=False):
            for p, item, land, staple, pre in ((r.pa, r.a, r.land_a, r.staple_a, r.precon_a), (r.pb, r.b, r.land_b, r.staple_b, r.precon_b)):
                name[p], flags[p] = item, (land, staple, pre)
            lo, hi = sorted((r.pa, r.pb))
            link.setdefault(lo, {})[hi] = link.setdefault(hi, {})[lo] = r.link
            if not r.land_a and not r.land_b:
                seeds.append((-r.link, lo, hi))
        used: set = set()
        out, count = [], 0
        for _, a, b in sorted(seeds):
            if (a, b) in used:
                continue
            members = [a, b]
            while len(members) < most:
                shared = set(link[members[0]])
                for x in members[1:]:
                    shared &= set(link[x])
                shared -= set(members)
                if not shared:
                    break
                members.append(max(shared, key=lambda c: (min(link[x][c] for x in members), c)))
            pairs = {(min(x, y), max(x, y)) for i, x in enumerate(members) for y in members[i + 1:]}
            old = len(pairs & used)
            used |= pairs
            kinds = [flags[m] for m in members]
            if (old * 4 > len(members) * (len(members) - 1) or 2 * sum(k[2] for k in kinds) >= len(kinds)
                    or all(k[1] for k in kinds)):
                continue
            out += [[pdf["leader"].iloc[0], count, name[m], i] for i, m in enumerate(members)]
            count += 1
        return pd.DataFrame(out, columns=["leader", "bundle", "item", "pos"])

    return rows.groupBy("leader").applyInPandas(grow, schema)


def find_bundles(basket_items: DataFrame, plays: DataFrame, n: DataFrame, groups: DataFrame, lands: DataFrame, staples: DataFrame,
                 precon: DataFrame, least: float = PHI, common: float = 0.03, support: int = 5) -> tuple[DataFrame, DataFrame]:
    """Bundles (leader, bundle, item, pos) and their support (leader, bundle, baskets), those of too little support left out."""
    chosen = candidates(plays, n, common=common)
    kept = basket_items.select("leader", "basket", "item").distinct().join(chosen, ["leader", "item"])
    links = strong_links(kept, groups, least)
    place = F.row_number().over(W.partitionBy("leader").orderBy(F.desc("plays"), F.asc("item")))
    order = plays.join(chosen, ["leader", "item"]).withColumn("place", place).select("leader", "item", "place")
    bundles = grow_bundles(links, lands, staples, precon, order, least)
    counts = (runs(bundles.select("leader", "bundle", "item"), kept).groupBy("leader", "bundle")
              .agg(F.count(F.lit(1)).alias("baskets")).filter(F.col("baskets") >= support))
    return bundles.join(counts.select("leader", "bundle"), ["leader", "bundle"]), counts


def most_run(running: DataFrame, n: DataFrame, count: int = 12, common: float = 0.03, floor: int = 3) -> DataFrame:
    """The bundles run by enough baskets, the most run: (leader, bundle, runs, rank)."""
    counted = (running.groupBy("leader", "bundle").agg(F.count(F.lit(1)).alias("runs")).join(n, "leader")
               .filter(F.col("runs") >= F.greatest(F.lit(float(floor)), common * F.col("n"))))
    return top_n(counted.select("leader", "bundle", "runs"), "leader", [F.desc("runs"), F.asc("bundle")], count)


def bundle_extras(running: DataFrame, sets: DataFrame, basket_items: DataFrame, plays: DataFrame, n: DataFrame, count: int = 6,
                  least: float = 0.2, with_least: int = 5, playing: int = 10) -> DataFrame:
    """Items baskets running a bundle add most: phi with running it at ``least``, share above the other baskets'.
    (leader, bundle, item, share, base, both, phi, rank)"""
    k = running.groupBy("leader", "bundle").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= playing)
    both = (running.join(basket_items.select("leader", "basket", "item"), ["leader", "basket"]).groupBy("leader", "bundle", "item")
            .agg(F.count(F.lit(1)).alias("both")).filter(F.col("both") >= with_least).join(sets, ["leader", "bundle", "item"], "left_anti"))
    rows = both.join(k, ["leader", "bundle"]).join(plays, ["leader", "item"]).join(n, "leader").filter(F.col("n") > F.col("k"))
    rows = (rows.withColumn("share", F.col("both") / F.col("k")).withColumn("base", F.try_divide(F.col("plays") - F.col("both"), F.col("n") - F.col("k")))
            .withColumn("phi", F.round(phi(F.col("both"), F.col("k"), F.col("plays"), F.col("n")), DIGITS))
            .filter((F.col("phi") >= least) & (F.col("share") > F.col("base"))))
    return top_n(rows.select("leader", "bundle", "item", "share", "base", "both", "phi"), ["leader", "bundle"], [F.desc("phi"), F.asc("item")], count)


def held_of(sets: DataFrame, query_items: DataFrame, least: float = 0.5) -> DataFrame:
    """How much of each bundle a query has, for those it has at least half of: (query, leader, bundle, held, size, has).
    query_items(query, leader, item)."""
    found = coverage(sets, query_items.withColumnRenamed("query", "basket")).withColumnRenamed("basket", "query")
    return classify(found).filter(F.col("held") >= least * F.col("size"))


def recipes_with(sets: DataFrame, recipe_items: DataFrame) -> DataFrame:
    """(leader, bundle, recipes): recipes containing the whole bundle."""
    size = sets.groupBy("leader", "bundle").agg(F.count(F.lit(1)).alias("size"))
    return (sets.join(recipe_items.select("recipe", "item"), "item").groupBy("leader", "bundle", "recipe").agg(F.count(F.lit(1)).alias("held"))
            .join(size, ["leader", "bundle"]).filter("held = size").groupBy("leader", "bundle").agg(F.count(F.lit(1)).alias("recipes")))


def newest_running(running: DataFrame, baskets: DataFrame, count: int = 12) -> DataFrame:
    """The newest baskets running each bundle or recipe. baskets(leader, basket, updated)."""
    return top_n(running.join(baskets, ["leader", "basket"]), ["leader", "bundle"], [F.desc("updated"), F.asc("basket")], count)


def alternatives(items: DataFrame, item_tags: DataFrame, from_cents: int = 500, share: float = 0.5, least: float = 0.35,
                 tag_most: int = 1500, shown: int = 6) -> DataFrame:
    """Cheaper items that do the same: same kind, identity within, at most ``share`` of the price, with ``least`` of the
    item's tag weight. items(item, cents, kind, identity), item_tags(item, tag). (item, other, weight, rank)

    Tags on more than ``tag_most`` items link nothing, which is also what bounds the join on tags."""
    total = items.agg(F.count(F.lit(1)))
    held = item_tags.join(items.select("item"), "item").groupBy("tag").agg(F.count(F.lit(1)).alias("held"))
    weights = held.select("tag", "held", F.log(total.scalar() / F.col("held")).alias("weight"))
    dear = items.filter(F.col("cents") >= from_cents).select("item", "kind", "identity", "cents")
    mine = dear.join(item_tags, "item").join(weights, "tag").select("item", "tag", "weight", "held")
    own = mine.groupBy("item").agg(F.sum("weight").alias("own"))
    theirs = item_tags.withColumnRenamed("item", "other")
    shared = (mine.filter(F.col("held") <= tag_most).join(theirs, "tag").filter("item <> other")
              .groupBy("item", "other").agg(F.sum("weight").alias("weight")))
    o = items.select(F.col("item").alias("other"), F.col("kind").alias("kind"), F.col("identity").alias("their_identity"), F.col("cents").alias("their_cents"))
    rows = (shared.join(own, "item").filter(F.round(F.col("weight"), DIGITS) >= F.round(least * F.col("own"), DIGITS))
            .join(dear, "item").join(o, ["other", "kind"])
            .filter(F.col("their_identity").bitwiseAND(F.bitwise_not(F.col("identity"))) == 0)
            .filter(F.col("their_cents").isNotNull() & (F.col("their_cents") <= share * F.col("cents")))
            .select("item", "other", F.round("weight", DIGITS).alias("weight")))
    return top_n(rows, "item", [F.desc("weight"), F.asc("other")], shown)
