"""Graphs of a dozen nodes around an item, a leader's bundles, or one bundle, of all leaders at once: tables of nodes and edges.

The pairs of a graph, some sixty at most, are one array, folded in order inside one expression; everything before that are
counts over all baskets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickerwork.functions.numeric import phi
from wickerwork.operators.baskets import DIGITS
from wickerwork.operators.pairs import APART, EDGES_EACH, LINK, MIN_WITH, STAND_OUT, pair_counts, with_plays

#: Fixed value: evidence from which a result is shown as won or lost.
CLEAR = 2.0


def _pick(pairs: Column, each: int, both_free: bool, node_type: str) -> Column:
    """Those of an ordered array of pairs that are shown: one end, or both, must have fewer than ``each`` so far."""
    start = F.struct(F.array().cast(f"array<{node_type}>").alias("ends"), F.filter(pairs, lambda _: F.lit(False)).alias("shown"))

    def take(done: Column, pair: Column) -> Column:
        free = [F.size(F.filter(done["ends"], _is(pair[end]))) < each for end in ("a", "b")]
        grown = F.struct(F.concat(done["ends"], F.array(pair["a"], pair["b"])).alias("ends"), F.concat(done["shown"], F.array(pair)).alias("shown"))
        return F.when(free[0] & free[1] if both_free else free[0] | free[1], grown).otherwise(done)

    return F.aggregate(pairs, start, take)["shown"]


def _is(value: Column):
    return lambda x: x == value


def pick_edges(scored: DataFrame, keys: Sequence[str], link: float = LINK, stand_out: float = STAND_OUT, apart: float = APART,
               each: int = EDGES_EACH, least: int = MIN_WITH, typical_from: int = 1) -> DataFrame:
    """(keys, a, b, strength, kind): the edges shown of each graph. ``together``: pairs far above its typical (upper median) phi, the
    strongest first, unless both ends already have ``each``; ``apart``: the clearest pairs rarely together, while both ends have
    fewer. scored(keys, a, b, both, phi)."""
    keys = list(keys)
    node = {f.name: f.dataType.simpleString() for f in scored.schema.fields}["a"]
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("phi")).alias("down"), "a", "b", "both", "phi")))
    rows = scored.groupBy(*keys).agg(ranked.alias("_pairs"))
    n = F.size("_pairs")
    # the upper median of a falling array is at its lower middle
    typical = F.when(n >= typical_from, F.element_at("_pairs", n - F.floor(n / 2).cast("int"))["phi"]).otherwise(F.lit(0.0))
    rows = rows.withColumn("_least", F.greatest(F.lit(link), typical + stand_out))
    strong = F.filter("_pairs", lambda p: (p["phi"] >= F.col("_least")) & (p["both"] >= least))
    weak = F.reverse(F.filter("_pairs", lambda p: p["phi"] <= apart))
    named = lambda pairs, kind: F.transform(pairs, lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), p["phi"].alias("strength"), F.lit(kind).alias("kind")))
    shown = F.concat(named(_pick(strong, each, False, node), "together"), named(_pick(weak, each, True, node), "apart"))
    return rows.select(*keys, F.inline(shown))


def clear_results(results: DataFrame, evidence: float = CLEAR) -> DataFrame:
    """Results (lift, evidence) that clearly differ either way."""
    return results.filter(F.abs(F.round("evidence", 9)) >= evidence)


def with_won(nodes: DataFrame, won: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The nodes with the lift of those that clearly win more or less, and one node ``won`` for each graph that has any; and the
    edges from it, (keys, node, lift). nodes(keys, node, kind, ...), won(keys, node, lift)."""
    keys = list(keys)
    edges = won.join(nodes.select(*keys, "node"), [*keys, "node"], "left_semi").select(*keys, "node", "lift")
    marked = nodes.join(edges, [*keys, "node"], "left")
    hubs = edges.select(*keys).distinct().withColumn("kind", F.lit("won"))
    return marked.unionByName(hubs, allowMissingColumns=True), edges


def synergy_nodes(chosen: DataFrame) -> DataFrame:
    """(leader, centre, node, kind, base, share, phi): each centre and its partners. chosen(leader, x, item, base, share, phi)."""
    centres = chosen.select("leader", F.col("x").alias("centre"), F.col("x").alias("node")).distinct().withColumn("kind", F.lit("centre"))
    partners = chosen.select("leader", F.col("x").alias("centre"), F.col("item").alias("node"), F.lit("partner").alias("kind"), "base", "share", "phi")
    return partners.unionByName(centres, allowMissingColumns=True)


def spokes(chosen: DataFrame) -> DataFrame:
    """The edges from each centre to its partners."""
    return chosen.select("leader", F.col("x").alias("centre"), F.col("x").alias("a"), F.col("item").alias("b"), F.col("phi").alias("strength"), F.lit("spoke").alias("kind"))


def bundle_nodes(shown: DataFrame, sets: DataFrame, strongest: int = 2) -> DataFrame:
    """(leader, node, kind, runs, name): the bundles of a leader's map, named by their first items. shown(leader, bundle, runs),
    sets(leader, bundle, item, pos)."""
    first = F.array_sort(F.collect_list(F.when(F.col("pos") < strongest, F.struct("pos", "item"))))
    names = sets.groupBy("leader", "bundle").agg(F.array_join(F.transform(first, lambda x: x["item"]), " + ").alias("name"))
    return shown.join(names, ["leader", "bundle"]).select("leader", F.col("bundle").alias("node"), F.lit("bundle").alias("kind"), "runs", "name")


def core_pairs(sets: DataFrame, basket_items: DataFrame, plays: DataFrame, n: DataFrame) -> DataFrame:
    """(leader, bundle, a, b, both, phi): the pairs of each bundle's own items, by the baskets of its leader that hold them. Only
    bundles' items are counted, a bundle at a time, so no other pair of a basket is met. sets(leader, bundle, item)."""
    members = sets.select("leader", "bundle", "item")
    inside = basket_items.select("leader", "basket", "item").distinct().join(members, ["leader", "item"])
    seen = pair_counts(inside, ["leader", "bundle"])
    every = (members.withColumnRenamed("item", "a").join(members.withColumnRenamed("item", "b"), ["leader", "bundle"]).filter("a < b")
             .join(seen, ["leader", "bundle", "a", "b"], "left").fillna(0, ["both"]))
    full = with_plays(every, plays, n)
    return full.withColumn("phi", F.round(phi(F.col("both"), F.col("plays_a"), F.col("plays_b"), F.col("n")), DIGITS))


def bundle_graph(sets: DataFrame, runs: DataFrame, plays: DataFrame, extras: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (leader, bundle, node, kind, baskets, base, share, phi) of each bundle's graph, itself (node null), its items and the
    items added most; and the edges from it to those. runs(leader, bundle, runs), extras as ``bundle_extras`` gives them."""
    keys = ["leader", "bundle"]
    own = runs.select(*keys, F.lit("bundle").alias("kind"), F.col("runs").alias("baskets"))
    core = sets.join(plays, ["leader", "item"], "left").select(*keys, F.col("item").alias("node"), F.lit("core").alias("kind"), F.coalesce("plays", F.lit(0)).alias("baskets"))
    more = extras.select(*keys, F.col("item").alias("node"), F.lit("extra").alias("kind"), F.col("both").alias("baskets"), "base", "share", "phi")
    nodes = more.unionByName(core, allowMissingColumns=True).unionByName(own, allowMissingColumns=True)
    edges = extras.select(*keys, F.lit(None).cast("string").alias("a"), F.col("item").alias("b"), F.col("phi").alias("strength"), F.lit("extra").alias("kind"))
    return nodes, edges
