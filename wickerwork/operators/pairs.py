"""Co-occurrence of items within baskets, and the correlations, links and graph edges built on it."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickerwork.functions.numeric import phi
from wickerwork.operators.baskets import DIGITS
from wickerwork.operators.ranking import top_n
from wickerwork.session import cut_lineage

#: Thresholds of partners, links and graph edges.
PARTNER_PHI, LINK, STAND_OUT, EDGES_EACH, APART = 0.2, 0.3, 0.12, 2, -0.15
BUNDLE_LINK, BUNDLE_APART = 0.15, -0.1
MIN_WITH, MIN_PLAYING, PRIOR_BASKETS = 5, 10, 20


def candidates(plays: DataFrame, n: DataFrame, least: int = 5, common: float = 0.03, most: float = 0.8) -> DataFrame:
    """(leader, item): items enough of a leader's baskets play, but not nearly all. As every one is in ``common`` of the
    baskets, there are at most mean basket size / common of them, however many baskets a leader has."""
    return (plays.join(n, "leader").filter((F.col("plays") >= F.greatest(F.lit(float(least)), common * F.col("n")))
                                           & (F.col("plays") <= most * F.col("n"))).select("leader", "item"))


#: Cells of the dense 0/1 matrix of a block's often-played items, and pairs of its other items that are held before they are summed.
DENSE_CELLS, HELD_PAIRS = 1 << 24, 1 << 22


def _matrix_product(basket: np.ndarray, item: np.ndarray, baskets: int, wide: int, weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Counts of pairs among items 0 to ``wide``, as the product of a 0/1 matrix with itself; and with its rows weighted, sums."""
    matrix = np.zeros((baskets, wide), dtype=np.float32)
    matrix[basket, item] = 1
    counts = np.triu(matrix.T @ matrix, 1).astype(np.int64)
    a, b = np.nonzero(counts)
    sums = [np.rint(matrix.T.astype(np.float64) @ (matrix * w[:, None]))[a, b].astype(np.int64) for w in weights]
    return a, b, [counts[a, b], *sums]


def _laid_pairs(basket: np.ndarray, item: np.ndarray, band: np.ndarray | None, dense: int, items: int,
                weights: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Counts of the other pairs: rows of a basket lie together, so rows some places apart are its pairs; sorted keys are summed
    whenever many are held. Pairs of two ``dense`` items are counted elsewhere; pairs more than a band apart are none."""
    held: list[np.ndarray] = []
    where: list[np.ndarray] = []
    size, apart, rows = 0, 1, np.arange(len(basket))

    def summed() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        keys, place, counts = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
        at = np.concatenate(where) if weights else None
        return keys // items, keys % items, [counts, *[np.rint(np.bincount(place, weights=w[at])).astype(np.int64) for w in weights]]

    while True:
        rows = rows[rows + apart < len(basket)]
        rows = rows[basket[rows] == basket[rows + apart]]  # the last places of a basket drop out one by one
        if not len(rows):
            break
        x, y = item[rows], item[rows + apart]
        wanted = np.maximum(x, y) >= dense
        if band is not None:
            wanted &= np.abs(band[x] - band[y]) <= 1
        x, y = x[wanted], y[wanted]
        held.append(np.minimum(x, y) * items + np.maximum(x, y))
        if weights:
            where.append(basket[rows][wanted])
        size += len(x)
        if size > HELD_PAIRS:
            yield summed()
            held, where, size = [], [], 0
        apart += 1
    if size:
        yield summed()


def pair_counts(basket_items: DataFrame, keys: Sequence[str] = ("leader",), block: int = 400_000, band: str | None = None,
                sums: Sequence[str] = ()) -> DataFrame:
    """(keys, a, b, both, sums) with a < b: baskets holding both items, and the sums over them of whole numbers of a basket, the
    columns ``sums``. Rows must be distinct.

    Whole baskets are hashed over the tasks, so a hot leader is spread too. Each task counts blocks of baskets: the items many
    of a block's baskets hold by a product of 0/1 matrices, all other pairs as sorted keys, so that memory does not depend on how
    many items there are. What leaves a task is one count per item pair it saw in a block; the counts are then summed. With
    ``band``, a whole number of each item, only pairs at most one band apart are counted."""
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in basket_items.schema.fields}
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [f"a {types['item']}", f"b {types['item']}", "both bigint", *[f"{c} bigint" for c in sums]])
    bands = [*([band] if band else []), *sums]
    laid = basket_items.select(*keys, "basket", "item", *bands).repartition(*keys, "basket").sortWithinPartitions(*keys, "basket")

    def multiply(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for key, rows in pdf.groupby(keys, sort=False, dropna=False) if keys else [((), pdf)]:
            key = key if isinstance(key, tuple) else (key,)
            names, item, often = np.unique(rows["item"].to_numpy(), return_inverse=True, return_counts=True)
            basket = pd.factorize(rows["basket"])[0]
            baskets = int(basket.max()) + 1
            # items by how often they are played: the first ones are dense
            by_plays = np.argsort(-often, kind="stable")
            place = np.empty(len(names), np.int64)
            place[by_plays] = np.arange(len(names))
            item = place[item]
            wide = int(min((often >= baskets / 64).sum(), DENSE_CELLS // baskets))
            of_item = None
            if band:
                of_item = np.zeros(len(names), np.int64)
                of_item[item] = rows[band].to_numpy()
            weights = []
            for c in sums:
                of_basket = np.zeros(baskets)
                of_basket[basket] = rows[c].to_numpy()
                weights.append(of_basket)
            inside = item < wide
            parts = [_matrix_product(basket[inside], item[inside], baskets, wide, weights)] if wide else []
            for a, b, found in itertools.chain(parts, _laid_pairs(basket, item, of_item, wide, len(names), weights)):
                if band:
                    near = np.abs(of_item[a] - of_item[b]) <= 1
                    a, b, found = a[near], b[near], [f[near] for f in found]
                x, y = by_plays[a], by_plays[b]
                for lo in range(0, len(x), 1 << 18):
                    part = slice(lo, lo + (1 << 18))
                    first, last = np.minimum(x[part], y[part]), np.maximum(x[part], y[part])  # names are in order
                    out = pd.DataFrame({"a": names[first], "b": names[last], **{c: f[part] for c, f in zip(["both", *sums], found)}})
                    for k, v in zip(keys, key):
                        out[k] = v
                    yield out[[*keys, "a", "b", "both", *sums]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for pdf in batches:
            if rows + len(pdf) > block and rows:
                # a basket may go on in this batch: keep its rows back
                full = pd.concat(held, ignore_index=True)
                tail = (full[[*keys, "basket"]] == full[[*keys, "basket"]].iloc[-1]).all(axis=1)
                yield from multiply(full[~tail])
                held, rows = [full[tail]], int(tail.sum())
            held.append(pdf)
            rows += len(pdf)
        if rows:
            yield from multiply(pd.concat(held, ignore_index=True))

    return laid.mapInPandas(run, schema).groupBy(*keys, "a", "b").agg(*[F.sum(c).alias(c) for c in ("both", *sums)])


def correlated_pairs(basket_items: DataFrame, plays: DataFrame, n: DataFrame, least: float) -> DataFrame:
    """(leader, a, b, both, plays_a, plays_b, n, phi): the pairs whose correlation is ``least`` or more.

    The correlation of two items is at most the root of the ratio of their odds, plays / (n - plays), the smaller over the larger.
    So items are put into bands of the odds, each 1 / least ** 2 wide, and only pairs of one band or of two next to each other are
    counted at all; items every basket plays correlate with nothing."""
    if not 0 < least < 1:
        raise ValueError("least must lie between 0 and 1")
    odds = plays.join(n, "leader").filter(F.col("plays") < F.col("n")).withColumn("odds", F.col("plays") / (F.col("n") - F.col("plays")))
    banded = odds.select("leader", "item", F.floor(F.log("odds") / (-2 * math.log(least))).alias("band"))
    counts = pair_counts(basket_items.select("leader", "basket", "item").join(banded, ["leader", "item"]), band="band")
    return pair_phi(counts, plays, n).filter(F.col("phi") >= least)


def both_ways(pairs: DataFrame) -> DataFrame:
    """Every pair from either end."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    return pairs.unionByName(pairs.select(*rest, F.col("b").alias("a"), F.col("a").alias("b")))


def with_plays(pairs: DataFrame, plays: DataFrame, n: DataFrame, keys: Sequence[str] = ("leader",)) -> DataFrame:
    keys = list(keys)
    pa = plays.select(*keys, F.col("item").alias("a"), F.col("plays").alias("plays_a"))
    pb = plays.select(*keys, F.col("item").alias("b"), F.col("plays").alias("plays_b"))
    return pairs.join(pa, [*keys, "a"]).join(pb, [*keys, "b"]).join(n, keys)


def pair_phi(pairs: DataFrame, plays: DataFrame, n: DataFrame) -> DataFrame:
    """(leader, a, b, both, plays_a, plays_b, n, phi)"""
    rows = with_plays(pairs, plays, n)
    return rows.withColumn("phi", F.round(phi(F.col("both"), F.col("plays_a"), F.col("plays_b"), F.col("n")), DIGITS))


def group_spreads(items: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How often each item is played in each group of alike baskets, (leader, grp, item, k, z), z being the group's size; and the
    spread of its being played, summed over the groups, (leader, item, spread)."""
    size = groups.groupBy("leader", "grp").agg(F.count(F.lit(1)).alias("z"))
    per = (items.join(groups, ["leader", "basket"]).groupBy("leader", "grp", "item").agg(F.count(F.lit(1)).alias("k"))
           .join(size, ["leader", "grp"]))
    return per, per.groupBy("leader", "item").agg(F.sum(F.col("k") - F.col("k") * F.col("k") / F.col("z")).alias("spread"))


def grouped_links(pairs: DataFrame, items: DataFrame, groups: DataFrame, least: int = 5) -> DataFrame:
    """(leader, a, b, both, link): correlation of a pair within groups of alike baskets, pooled over the groups.
    items(leader, basket, item), groups(leader, basket, grp)."""
    per, spread = group_spreads(items, groups)
    return _pooled(pairs, per, spread, least)


def strong_links(items: DataFrame, groups: DataFrame, link: float, least: int = 5) -> DataFrame:
    """``grouped_links`` of ``link`` or more, of counted pairs of items that can have such a link only.

    In a group, what two items are played together beyond chance is at most the smaller one's spread, so a link is at most the root
    of the ratio of their spreads: items are put into bands of the spread, and pairs more than a band apart are not counted."""
    per, spread = group_spreads(items, groups)
    per, spread = cut_lineage(per, "group-plays"), cut_lineage(spread, "group-spreads")
    banded = spread.filter("spread > 0").select("leader", "item", F.floor(F.log("spread") / (-2 * math.log(link))).alias("band"))
    pairs = pair_counts(items.select("leader", "basket", "item").join(banded, ["leader", "item"]), band="band")
    return _pooled(pairs, per, spread, least).filter(F.col("link") >= link)


def _pooled(pairs: DataFrame, per: DataFrame, spread: DataFrame, least: int) -> DataFrame:
    enough = pairs.filter(F.col("both") >= least)
    ka = per.select("leader", "grp", F.col("item").alias("a"), F.col("k").alias("ka"), "z")
    kb = per.select("leader", "grp", F.col("item").alias("b"), F.col("k").alias("kb"))
    chance = (enough.join(ka, ["leader", "a"]).join(kb, ["leader", "grp", "b"])
              .groupBy("leader", "a", "b", "both").agg(F.sum(F.col("ka") * F.col("kb") / F.col("z")).alias("chance")))
    sa = spread.select("leader", F.col("item").alias("a"), F.col("spread").alias("sa"))
    sb = spread.select("leader", F.col("item").alias("b"), F.col("spread").alias("sb"))
    product = F.col("sa") * F.col("sb")
    scale = F.sqrt(F.when(product != 0, product).otherwise(F.lit(1.0)))
    return (chance.join(sa, ["leader", "a"]).join(sb, ["leader", "b"])
            .select("leader", "a", "b", "both", F.round((F.col("both") - F.col("chance")) / scale, DIGITS).alias("link")))


def played_more_with(pairs: DataFrame, plays: DataFrame, n: DataFrame, least: int = MIN_WITH, playing: int = MIN_PLAYING,
                     prior: float = PRIOR_BASKETS, evidence: float = 2.0) -> DataFrame:
    """For every item x, the items baskets playing x play more: (leader, x, item, base, share, both, evidence, score)."""
    rows = (with_plays(both_ways(pairs), plays, n).withColumnsRenamed({"a": "x", "b": "item"})
            .filter((F.col("plays_a") >= playing) & (F.col("both") >= least)))
    base, share = F.col("plays_b") / F.col("n"), F.col("both") / F.col("plays_a")
    z = F.try_divide(share - base, F.sqrt(base * (1 - base) / F.col("plays_a")))
    return (rows.filter(share > base).withColumn("base", base).withColumn("share", share).withColumn("evidence", z)
            .filter(F.col("evidence") >= evidence)
            .withColumn("score", F.round((F.col("both") - F.col("plays_a") * base) / (F.col("plays_a") + prior), DIGITS))
            .select("leader", "x", "item", "base", "share", "both", F.col("plays_a").alias("plays_x"), "plays_b", "n", "evidence", "score"))


def partners(more: DataFrame, least: float = PARTNER_PHI, count: int = 12) -> DataFrame:
    """(leader, x, item, phi, rank): the items most correlated with each x."""
    rows = more.withColumn("phi", F.round(phi(F.col("both"), F.col("plays_x"), F.col("plays_b"), F.col("n")), DIGITS)).filter(F.col("phi") >= least)
    return top_n(rows.select("leader", "x", "item", "base", "share", "phi", F.col("both").alias("held")), ["leader", "x"], [F.desc("phi"), F.asc("item")], count)


def ring_pairs(chosen: DataFrame, held: DataFrame, plays: DataFrame) -> DataFrame:
    """Correlation of the chosen partners of each centre among the baskets holding the centre.

    chosen(leader, centre, item): a bounded dozen per centre. held(leader, centre, basket). Each basket is read once per
    centre it holds, and the partner pairs of a centre are counted by the same matrix product as all pairs.
    (leader, centre, a, b, both, ka, kb, n, phi)"""
    among = held.join(chosen, ["leader", "centre"])
    rows = among.join(plays, ["leader", "basket", "item"]).select("leader", "centre", "basket", "item")
    n = held.groupBy("leader", "centre").agg(F.count(F.lit(1)).alias("n"))
    counts = rows.groupBy("leader", "centre", "item").agg(F.count(F.lit(1)).alias("plays"))
    seen = pair_counts(rows, ["leader", "centre"])
    order = ["leader", "centre"]
    left = chosen.select(*order, F.col("item").alias("a"))
    right = chosen.select(*order, F.col("item").alias("b"))
    every = left.join(right, order).filter("a < b").join(seen, [*order, "a", "b"], "left").fillna(0, ["both"])
    full = with_plays(every, counts, n, order)
    return full.withColumn("phi", F.round(phi(F.col("both"), F.col("plays_a"), F.col("plays_b"), F.col("n")), DIGITS))
