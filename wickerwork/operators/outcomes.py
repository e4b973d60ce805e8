"""Outcome statistics of event entries: totals, item effects, pooled effects, players, highlights.

Tables: entries(entry, leader, player, player_name, date, size, top_cut, standing, games, wins, draws),
entry_items(entry, item)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wickerwork.functions.numeric import (DESIGN_EFFECT, PRIOR_GAMES, compare, half_even, match_points,
                                          points_per_game, share)
from wickerwork.operators.baskets import DIGITS
from wickerwork.operators.pairs import both_ways, pair_counts
from wickerwork.operators.ranking import top_n
from wickerwork.operators.textjoin import contains_join
from wickerwork.operators.windows import RESULT_DAYS, cutoff, every_month, in_windows
from wickerwork.session import cut_lineage

MIN_RESULT_BASKETS, MIN_PAIR_BASKETS, POOL_BASKETS = 10, 20, 3


def in_cut() -> Column:
    return F.col("top_cut") > 0


def made_cut() -> Column:
    return (F.col("standing") > 0) & (F.col("standing") <= F.col("top_cut"))


def tallies() -> list[Column]:
    """baskets, games, wins, cut_baskets (in events with a cut), cuts (made it), draws"""
    return [F.count(F.lit(1)).alias("baskets"), F.sum("games").alias("games"), F.sum("wins").alias("wins"),
            F.sum(in_cut().cast("long")).alias("cut_baskets"), F.sum(made_cut().cast("long")).alias("cuts"), F.sum("draws").alias("draws")]


COUNTS = ("baskets", "games", "wins", "cut_baskets", "cuts", "draws")


def totals(entries: DataFrame, keys: Sequence[str], today: str, days: Sequence[int] = RESULT_DAYS) -> DataFrame:
    """Tallies per key and look-back in one aggregate. An entry whose leader is unresolved (null) has no leader's totals."""
    known = entries.filter(F.col("leader").isNotNull()) if "leader" in keys else entries
    return in_windows(known, "date", today, days).groupBy(*keys, "w").agg(*tallies())


def totals_with_field(entries: DataFrame, today: str, days: Sequence[int] = RESULT_DAYS) -> DataFrame:
    """Leaders' totals and those of the whole field (leader null and field true), as grouping sets of one pass. Entries with an
    unresolved leader count in the field only."""
    rows = in_windows(entries, "date", today, days)
    sets = rows.groupingSets([["leader", "w"], ["w"]], "leader", "w")
    return sets.agg(*tallies(), (F.grouping("leader") == 1).alias("field")).filter(F.col("field") | F.col("leader").isNotNull())


def played_items(entries: DataFrame, entry_items: DataFrame, basics: DataFrame | None = None, leader_items: DataFrame | None = None) -> DataFrame:
    """Entries joined to the items they play, basics and the leader's own items left out."""
    items = entry_items if basics is None else entry_items.join(basics, "item", "left_anti")
    rows = entries.join(items, "entry")
    return rows if leader_items is None else rows.join(leader_items, ["leader", "item"], "left_anti")


def item_totals(played: DataFrame, today: str, days: Sequence[int] = RESULT_DAYS, least: int = 2) -> DataFrame:
    """Tallies per leader, item and look-back, for items at least ``least`` baskets play in the widest."""
    counts = totals(played, ["leader", "item"], today, days).drop("draws")
    widest = counts.filter((F.col("w") == max(days)) & (F.col("baskets") >= least)).select("leader", "item")
    return counts.join(widest, ["leader", "item"])


def pooled(item_rows: DataFrame, leader_rows: DataFrame, field: DataFrame, least: int = POOL_BASKETS) -> DataFrame:
    """Item effects across leaders per look-back: (item, w, baskets, leaders, lift, evidence).

    Within each leader with enough baskets either side the win-rate difference is weighed by how far it can be trusted,
    so a strong leader playing an item does not make it look good."""
    t = leader_rows.select("leader", "w", F.col("baskets").alias("all_baskets"), F.col("games").alias("all_games"), F.col("wins").alias("all_wins"))
    rows = item_rows.join(t, ["leader", "w"])
    fair = ((F.col("baskets") >= least) & (F.col("all_baskets") - F.col("baskets") >= least) & (F.col("games") > 0)
            & (F.col("games") < F.col("all_games")))
    others = F.col("all_games") - F.col("games")
    weight = F.try_divide(F.lit(1.0), share(F.lit(1.0), F.col("games")) + share(F.lit(1.0), others))
    gap = share(F.col("wins"), F.col("games")) - share(F.col("all_wins") - F.col("wins"), others)
    sums = rows.groupBy("item", "w").agg(
        F.sum("baskets").alias("baskets"), F.count(F.when(fair, 1)).alias("_leaders"),
        F.sum(F.when(fair, weight * gap)).alias("_d"), F.sum(F.when(fair, weight)).alias("_w"))
    rates = field.select("w", F.when(F.col("games") > 0, F.col("wins") / F.col("games")).otherwise(F.lit(0.0)).alias("_rate"))
    usable = F.col("_w").isNotNull() & (F.col("_rate") > 0) & (F.col("_rate") < 1)
    d = F.col("_d") / F.col("_w")
    return (sums.join(rates, "w").select(
        "item", "w", "baskets", F.when(usable, F.col("_leaders")).otherwise(0).alias("leaders"),
        F.when(usable, d * F.col("_w") / (F.col("_w") + PRIOR_GAMES)).otherwise(F.lit(0.0)).alias("lift"),
        F.when(usable, d / F.sqrt(DESIGN_EFFECT * F.col("_rate") * (1 - F.col("_rate")) / F.col("_w"))).otherwise(F.lit(0.0)).alias("evidence")))


def item_results(item_rows: DataFrame, leader_rows: DataFrame, least: int = MIN_RESULT_BASKETS) -> DataFrame:
    """How baskets with an item did against the leader's others: win rates, lift, evidence, cut conversion."""
    t = leader_rows.filter(F.col("baskets") >= 2 * least).select("leader", "w", *[F.col(c).alias(f"all_{c}") for c in COUNTS[:5]])
    rest = lambda c: F.col(f"all_{c}") - F.col(c)
    rows = item_rows.join(t, ["leader", "w"]).filter((F.col("baskets") >= least) & (rest("baskets") >= least))
    lift, evidence = compare(F.col("wins"), F.col("games"), rest("wins"), rest("games"), share(F.col("all_wins"), F.col("all_games")))
    return rows.select("leader", "item", "w", "baskets", share(F.col("baskets"), F.col("all_baskets")).alias("share"), "games",
                       share(F.col("wins"), F.col("games")).alias("win_rate"), share(rest("wins"), rest("games")).alias("win_rate_without"),
                       lift.alias("lift"), evidence.alias("evidence"), share(F.col("cuts"), F.col("cut_baskets")).alias("conversion"),
                       share(rest("cuts"), rest("cut_baskets")).alias("conversion_without"))


def within(entries: DataFrame, today: str | None, days: int | None) -> DataFrame:
    """The entries of one look-back, or all where none is asked for."""
    return entries if days is None else entries.filter(F.col("date") >= cutoff(today, days))


def bundle_results(entries: DataFrame, covered: DataFrame, bundles: DataFrame, today: str | None = None, days: int | None = None) -> DataFrame:
    """Entries playing all of a bundle against those playing none, some counted apart.

    covered(leader, entry, bundle, held, size), bundles(leader, bundle). An entry playing none has no coverage row, so
    "none" is the leader's total less the rest: nothing is paired with every bundle."""
    entries = within(entries, today, days)
    all_of = entries.groupBy("leader").agg(*tallies())
    has = F.when(F.col("held") == F.col("size"), "all").otherwise("some").alias("has")
    seen = (entries.join(covered.select("leader", "entry", "bundle", has), ["leader", "entry"])
            .groupBy("leader", "bundle").pivot("has", ["all", "some"]).agg(*tallies()))
    rows = bundles.join(all_of, "leader").join(seen, ["leader", "bundle"], "left")
    part = lambda side, c: F.coalesce(F.col(f"{side}_{c}"), F.lit(0))
    for c in COUNTS[:5]:
        rows = rows.withColumns({f"all_{c}": part("all", c), f"some_{c}": part("some", c)})
    for c in COUNTS[:5]:
        rows = rows.withColumn(f"none_{c}", F.col(c) - F.col(f"all_{c}") - F.col(f"some_{c}"))
    rate = share(F.col("wins"), F.col("games"))
    fair = (F.col("all_games") > 0) & (F.col("none_games") > 0) & (rate > 0) & (rate < 1)
    lift, evidence = compare(F.col("all_wins"), F.col("all_games"), F.col("none_wins"), F.col("none_games"), rate)
    return rows.select("leader", "bundle", *[f"{s}_{c}" for s in ("all", "none", "some") for c in COUNTS[:5]],
                       F.when(fair, lift).alias("lift"), F.when(fair, evidence).alias("evidence"))


def against_none(seen: DataFrame, totals: DataFrame) -> DataFrame:
    """(leader, bundle, lift, evidence): baskets running a bundle against those holding none of its items, which are the leader's
    total less the rest. seen(leader, bundle, all_games, all_wins, some_games, some_wins), totals(leader, games, wins)."""
    rows = seen.join(totals, "leader").withColumns({f"none_{c}": F.col(c) - F.col(f"all_{c}") - F.col(f"some_{c}") for c in ("games", "wins")})
    rate = share(F.col("wins"), F.col("games"))
    fair = rows.filter((F.col("all_games") > 0) & (F.col("none_games") > 0) & (rate > 0) & (rate < 1))
    lift, evidence = compare(F.col("all_wins"), F.col("all_games"), F.col("none_wins"), F.col("none_games"), rate)
    return fair.select("leader", "bundle", lift.alias("lift"), evidence.alias("evidence"))


def wins_more_with(entries: DataFrame, holders: DataFrame, entry_items: DataFrame, least: int = MIN_PAIR_BASKETS, today: str | None = None,
                   days: int | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Among entries holding x (an item, or all of a bundle), those also playing each other item against those not.
    holders(leader, x, entry). With ``pairs`` (leader, x, item), of those only. (leader, x, item, with/without counts, lift,
    evidence)"""
    facts = within(entries, today, days).select("entry", "games", "wins")
    held = holders.join(facts, "entry")
    t = held.groupBy("leader", "x").agg(F.count(F.lit(1)).alias("n"), F.sum("games").alias("g"), F.sum("wins").alias("k"))
    met = held.join(entry_items, "entry")
    both = ((met if pairs is None else met.join(pairs, ["leader", "x", "item"], "left_semi")).groupBy("leader", "x", "item")
            .agg(F.count(F.lit(1)).alias("with_baskets"), F.sum("games").alias("with_games"), F.sum("wins").alias("with_wins")))
    return _with_and_without(both, t, least)


def _with_and_without(both: DataFrame, t: DataFrame, least: int) -> DataFrame:
    rows = both.join(t, ["leader", "x"]).withColumns({
        "without_baskets": F.col("n") - F.col("with_baskets"), "without_games": F.col("g") - F.col("with_games"),
        "without_wins": F.col("k") - F.col("with_wins")})
    rate = share(F.col("k"), F.col("g"))
    rows = rows.filter((F.col("with_baskets") >= least) & (F.col("without_baskets") >= least) & (F.col("with_games") > 0)
                       & (F.col("without_games") > 0) & (rate > 0) & (rate < 1))
    lift, evidence = compare(F.col("with_wins"), F.col("with_games"), F.col("without_wins"), F.col("without_games"), rate)
    return rows.select("leader", "x", "item", "with_baskets", "with_wins", "without_baskets", "without_wins",
                       lift.alias("lift"), evidence.alias("evidence"))


def items_winning_more_with(entries: DataFrame, entry_items: DataFrame, least: int = MIN_PAIR_BASKETS, today: str | None = None,
                            days: int | None = None) -> DataFrame:
    """``wins_more_with`` of every item x at once: pairs of items are counted with their games and wins as ``pair_counts`` does, no row
    being made for an entry and pair."""
    facts = within(entries, today, days).select("leader", F.col("entry").alias("basket"), "games", "wins")
    rows = facts.join(entry_items.select(F.col("entry").alias("basket"), "item").distinct(), "basket")
    t = rows.groupBy("leader", F.col("item").alias("x")).agg(F.count(F.lit(1)).alias("n"), F.sum("games").alias("g"), F.sum("wins").alias("k"))
    pairs = both_ways(pair_counts(rows, sums=["games", "wins"])).withColumnsRenamed({"a": "x", "b": "item", "both": "with_baskets", "games": "with_games", "wins": "with_wins"})
    return _with_and_without(pairs, t, least)


def win_ties(entries: DataFrame, runs: DataFrame, least: int = MIN_RESULT_BASKETS, today: str | None = None, days: int | None = None) -> DataFrame:
    """Results of the entries running each node set, and of those running both of a pair, against the leader's others.
    runs(leader, node, entry). (leader, a, b null for a node, baskets, games, wins, lift, evidence)"""
    entries = within(entries, today, days)
    t = entries.groupBy("leader").agg(F.sum("games").alias("all_games"), F.sum("wins").alias("all_wins"))
    facts = entries.select("entry", "games", "wins")
    sums = [F.count(F.lit(1)).alias("baskets"), F.sum("games").alias("games"), F.sum("wins").alias("wins")]
    one = runs.join(facts, "entry").groupBy("leader", F.col("node").alias("a"), F.lit(None).cast("string").alias("b")).agg(*sums)
    laid = runs.select("leader", F.col("entry").alias("basket"), F.col("node").alias("item")).distinct().join(facts.withColumnRenamed("entry", "basket"), "basket")
    two = pair_counts(laid, sums=["games", "wins"]).withColumnRenamed("both", "baskets")
    rows = one.unionByName(two).join(t, "leader")
    rate = share(F.col("all_wins"), F.col("all_games"))
    rest_g, rest_w = F.col("all_games") - F.col("games"), F.col("all_wins") - F.col("wins")
    fair = (F.col("baskets") >= least) & (F.col("games") > 0) & (rest_g > 0) & (rate > 0) & (rate < 1)
    lift, evidence = compare(F.col("wins"), F.col("games"), rest_w, rest_g, rate)
    return rows.select("leader", "a", "b", "baskets", "games", "wins", F.when(fair, lift).alias("lift"), F.when(fair, evidence).alias("evidence"))


def cut_groups(entries: DataFrame, today: str, days: int) -> DataFrame:
    """(leader, basket, side): entries of events with a cut in a look-back, as missed or made."""
    return (entries.filter(in_cut() & (F.col("date") >= cutoff(today, days)))
            .select("leader", F.col("entry").alias("basket"), F.when(made_cut(), "made").otherwise("missed").alias("side")))


def top_finishes(entries: DataFrame, best: int = 4, n: int = 200) -> DataFrame:
    """The newest top finishes of each leader, the better standing first within a day."""
    return top_n(entries.filter(F.col("standing") <= best), "leader", [F.desc("date"), F.asc("standing"), F.asc("entry")], n)


def highlights(entries: DataFrame, today: str, month: int = 30, before: int = 90, best: int = 20, breakout: int = 10,
               rising: int = 15) -> DataFrame:
    """Best, breakout and rising leader of the last month against the days before it, three different ones:
    (kind, leader, baskets, points, players, was). One row per leader is compared; each pick leaves out those before it. Entries
    with an unresolved leader count in the totals that shares are of, but are never picked."""
    start, old = cutoff(today, month), cutoff(today, month + before)
    now, then = F.col("date") >= start, (F.col("date") < start) & (F.col("date") >= old)
    on = lambda side, c: F.sum(F.when(side, F.col(c)).otherwise(0))
    rows = entries.filter((now | then) & F.col("leader").isNotNull()).groupBy("leader").agg(
        F.count(F.when(now, 1)).alias("n"), F.count(F.when(then, 1)).alias("n0"), F.countDistinct(F.when(now, F.col("player"))).alias("players"),
        *[on(side, c).alias(f"{c}{s}") for side, s in ((now, ""), (then, "0")) for c in ("games", "wins", "draws")])
    ppg = points_per_game(F.col("games"), F.col("wins"), F.col("draws"))
    ppg0 = points_per_game(F.col("games0"), F.col("wins0"), F.col("draws0"))
    rows = rows.filter("n > 0").withColumns({"points": F.round(ppg, DIGITS), "points0": F.round(ppg0, DIGITS)})
    everything = entries.filter(now | then).agg(F.count(F.when(now, 1)).alias("a"), F.count(F.when(then, 1)).alias("b"))
    total, total0 = everything.select("a").scalar(), everything.select("b").scalar()
    rows = rows.withColumn("_share", F.round(F.col("n") / total / ((F.col("n0") + 1) / (total0 + 1)), DIGITS)).withColumn(
        "_was", F.col("n0") / F.greatest(total0, F.lit(1)))

    def pick(kind: str, pool: DataFrame, least: Column, score: Column, was: Column) -> DataFrame:
        top = pool.filter(least).agg(F.max(F.struct(score.alias("s"), F.col("leader"), F.col("n"), F.col("points"), F.col("players"), was.alias("was"))).alias("_p"))
        return top.filter("_p is not null").select(F.lit(kind).alias("kind"), "_p.leader", F.col("_p.n").alias("baskets"), "_p.points", "_p.players", "_p.was")

    first = pick("best", rows, F.col("n") >= best, F.col("points"), F.lit(None).cast("double"))
    left = rows.join(first.select("leader"), "leader", "left_anti")
    second = pick("breakout", left, F.col("n") >= breakout, F.col("_share"), F.col("_was"))
    left = left.join(second.select("leader"), "leader", "left_anti")
    third = pick("rising", left, (F.col("n") >= rising) & (F.col("n0") >= rising), F.round(F.col("points") - F.col("points0"), DIGITS), F.col("points0"))
    return first.unionByName(second).unionByName(third)


# ---- leaders and players --------------------------------------------------------------------------------------


def leaderboard(rows: DataFrame) -> DataFrame:
    """Totals with rate, points, points per game and cut rate."""
    return rows.withColumns({
        "rate": F.coalesce(share(F.col("wins"), F.col("games")), F.lit(0.0)), "points": match_points(F.col("wins"), F.col("draws")),
        "ppg": points_per_game(F.col("games"), F.col("wins"), F.col("draws")), "cut_rate": share(F.col("cuts"), F.col("cut_baskets"))})


def ranked_by(board: DataFrame, by: str, least: int = 0, name: str = "leader") -> DataFrame:
    """A leaderboard sorted by one of its numbers, the rows with more baskets first among equals."""
    return board.filter(F.col("baskets") >= least).orderBy(F.col(by).desc_nulls_last(), F.desc("baskets"), F.asc(name))


def first_period(rows: DataFrame, least: int = 150) -> DataFrame:
    """The shortest look-back with enough baskets, else the widest: (leader, w)."""
    return rows.groupBy("leader").agg(F.coalesce(F.min(F.when(F.col("baskets") >= least, F.col("w"))), F.max("w")).alias("w"))


def without_top_players(player_rows: DataFrame, leader_rows: DataFrame, top: int = 2) -> DataFrame:
    """A leader's win rate without its players with most wins."""
    best = (top_n(player_rows, "leader", [F.desc("wins"), F.desc("baskets"), F.asc("player")], top).groupBy("leader")
            .agg(F.sum("games").alias("top_games"), F.sum("wins").alias("top_wins")))
    return (leader_rows.join(best, "leader").filter(F.col("games") > F.col("top_games"))
            .select("leader", "games", "wins", share(F.col("wins") - F.col("top_wins"), F.col("games") - F.col("top_games")).alias("rate_without")))


def player_histories(entries: DataFrame) -> DataFrame:
    """Every entry of a player with its number in that player's history, newest first, and the newest known name."""
    latest = entries.groupBy("player").agg(F.max_by("player_name", F.struct("date", "entry")).alias("name"))
    place = F.row_number().over(W.partitionBy("player").orderBy(F.desc("date"), F.asc("entry")))
    return entries.withColumn("place", place).drop("player_name").join(latest, "player")


def player_index(entries: DataFrame) -> DataFrame:
    """Baskets of each leader a player played, most first, with the player's total."""
    played = entries.groupBy("player", "leader").agg(F.count(F.lit(1)).alias("baskets"))
    whole = W.partitionBy("player")
    return played.withColumn("total", F.sum("baskets").over(whole)).withColumn(
        "place", F.row_number().over(whole.orderBy(F.desc("baskets"), F.asc("leader"))))


def player_ranking(entries: DataFrame, today: str, days: Sequence[int] = RESULT_DAYS, least: int = 5) -> DataFrame:
    """Totals per look-back of the players with enough entries."""
    enough = entries.groupBy("player").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("player")
    return totals(entries, ["player"], today, days).join(enough, "player")


def favourites(entries: DataFrame, played: DataFrame, item_rows: DataFrame, leader_rows: DataFrame, least: int = 2, n: int = 48,
               days: int = max(RESULT_DAYS)) -> DataFrame:
    """Items in more of a player's baskets than others' of the same leaders would have:
    (player, item, baskets, games, wins, expected, rank). Shares are of items kept in the widest look-back, 0 otherwise."""
    t = cut_lineage(leader_rows.filter(F.col("w") == days).select("leader", F.col("baskets").alias("n")), "leaders")
    shares = item_rows.filter(F.col("w") == days).join(t, "leader").select("leader", "item", (F.col("baskets") / F.col("n")).alias("share"))
    shares = cut_lineage(shares, "shares")  # its size is known when the join is planned
    known = entries.join(t.select("leader"), "leader", "left_semi")
    leads = known.groupBy("player", "leader").agg(F.count(F.lit(1)).alias("k"))
    enough = leads.groupBy("player").agg(F.sum("k").alias("k")).filter(F.col("k") >= 2).select("player")
    counts = (played.join(t.select("leader"), "leader", "left_semi").join(enough, "player", "left_semi").groupBy("player", "item")
              .agg(F.count(F.lit(1)).alias("baskets"), F.sum("games").alias("games"), F.sum("wins").alias("wins")).filter(F.col("baskets") >= least))
    pairs = counts.join(leads, "player").join(shares, ["leader", "item"], "left")  # who is counted has leaders
    expected = pairs.groupBy(*counts.columns).agg(F.sum(F.col("k") * F.col("share")).alias("e"))
    rows = (expected.withColumn("e", F.round(F.coalesce("e", F.lit(0.0)), DIGITS))
            .filter(F.col("baskets") > F.col("e")).withColumn("_over", F.round(F.col("e") - F.col("baskets"), DIGITS)))
    return top_n(rows, "player", [F.asc("_over"), F.asc("item")], n).select(
        "player", "item", "baskets", "games", "wins", (half_even(F.col("e") * 10) / 10).alias("expected"), "rank")


def player_profile(entries: DataFrame) -> DataFrame:
    """A player's record, best finish (place for the field's size) and rank by match points."""
    rows = entries.groupBy("player").agg(
        *tallies(), F.min(F.struct(F.round(F.col("standing") / F.col("size"), DIGITS).alias("place"), (-F.col("size")).alias("minus"),
                                   F.col("entry"), F.col("standing"))).alias("_best"), F.min("date").alias("since"))
    return leaderboard(rows).select("player", "baskets", "games", "wins", "points", "ppg", "rate", "cut_rate", "since",
                                    F.col("_best.entry").alias("best_entry"), F.col("_best.standing").alias("best_standing"))


def points_ranks(board: DataFrame) -> DataFrame:
    """Competition rank by points, from the count of players at each total (far fewer rows than players)."""
    counts = board.groupBy("points").agg(F.count(F.lit(1)).alias("k"))
    above = F.coalesce(F.sum("k").over(W.orderBy(F.desc("points")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return board.join(counts.withColumn("rank", above + 1).select("points", "rank"), "points")


def player_search(entries: DataFrame, queries: DataFrame, leaders: int = 3, shown: int = 12) -> DataFrame:
    """Players whose name contains each query, exact names first, with their top leaders. queries(query, q), q lower-case;
    a query of under two letters finds nobody."""
    index = player_index(entries)
    people = entries.groupBy("player").agg(F.max_by("player_name", F.struct("date", "entry")).alias("name"), F.count(F.lit(1)).alias("baskets"))
    people = people.withColumn("_name", F.lower("name"))
    asked = queries.filter(F.length("q") >= 2)
    found = contains_join(people, asked, "_name")
    best = top_n(found, "query", [F.desc(F.col("_name") == F.col("q")), F.desc("baskets"), F.asc("name"), F.asc("player")], shown)
    tops = index.filter(F.col("place") <= leaders).select("player", "leader", F.col("baskets").alias("leader_baskets"), "place")
    return best.select("query", "player", "name", "baskets", "rank").join(tops, "player")


def list_versions(entries: DataFrame, entry_items: DataFrame) -> DataFrame:
    """Items added and cut against the same player's list before with the same leader: (player, leader, entry, item, change).
    Lists are compared by joining items to the neighbouring list, one row per item."""
    order = W.partitionBy("player", "leader").orderBy("date", "entry")
    linked = entries.select("player", "leader", "entry", F.lag("entry").over(order).alias("before")).filter("before is not null")
    now = linked.join(entry_items, "entry")
    was = linked.join(entry_items.withColumnRenamed("entry", "before"), "before")
    key = ["player", "leader", "entry", "before", "item"]
    added = now.select(*key).join(was.select(*key), key, "left_anti").withColumn("change", F.lit("added"))
    cut = was.select(*key).join(now.select(*key), key, "left_anti").withColumn("change", F.lit("cut"))
    return added.unionByName(cut).drop("before")


def halves(entries: DataFrame) -> DataFrame:
    """Record in the first floor(n / 2) and the other events of each player and leader."""
    mine = W.partitionBy("player", "leader")
    place = F.row_number().over(mine.orderBy("date", "entry"))
    rows = entries.withColumn("_p", place).withColumn("_n", F.count(F.lit(1)).over(mine)).withColumn(
        "half", F.when(F.col("_p") <= F.floor(F.col("_n") / 2), 1).otherwise(2))
    return rows.groupBy("player", "leader", "half").agg(F.count(F.lit(1)).alias("baskets"), F.sum("games").alias("games"), F.sum("wins").alias("wins"))


def clearest_changes(entries: DataFrame, entry_items: DataFrame, deal: Callable[[DataFrame], DataFrame] = lambda played: played) -> DataFrame:
    """Items in some but not all of a player's lists with a leader, with games won with and without and how clear the gap is.
    ``deal`` may lay what was played over tasks by player and leader."""
    t = entries.groupBy("player", "leader").agg(F.count(F.lit(1)).alias("n"), F.sum("games").alias("all_games"), F.sum("wins").alias("all_wins"))
    have = (deal(entries.join(entry_items, "entry").select("player", "leader", "item", "games", "wins")).groupBy("player", "leader", "item")
            .agg(F.count(F.lit(1)).alias("baskets"), F.sum("games").alias("games"), F.sum("wins").alias("wins")))
    gw, kw = F.col("all_games") - F.col("games"), F.col("all_wins") - F.col("wins")
    rows = have.join(t, ["player", "leader"]).filter((F.col("n") >= 2) & (F.col("baskets") < F.col("n")) & (F.col("games") > 0) & (gw > 0))
    rate, without = share(F.col("wins"), F.col("games")), share(kw, gw)
    return rows.select("player", "leader", "item", "baskets", rate.alias("rate"), without.alias("rate_without"),
                       (F.abs(rate - without) * F.sqrt(F.try_divide(F.lit(1.0), share(F.lit(1.0), F.col("games")) + share(F.lit(1.0), gw)))).alias("clear"))


def basket_check(results: DataFrame, query_items: DataFrame, colors_ok: DataFrame, signal: float = 2.0) -> DataFrame:
    """A query's items whose baskets clearly win less, and items it lacks, in its colours, whose baskets clearly win more.
    results(leader, item, lift, evidence), query_items(query, leader, item), colors_ok(query, item)."""
    own = query_items.join(results, ["leader", "item"]).filter((F.col("lift") < 0) & (F.col("evidence") <= -signal)).withColumn("side", F.lit("mine_less"))
    lack = (query_items.select("query", "leader").distinct().join(results.filter((F.col("lift") > 0) & (F.col("evidence") >= signal)), "leader")
            .join(colors_ok, ["query", "item"], "left_semi").join(query_items, ["query", "leader", "item"], "left_anti").withColumn("side", F.lit("missing_more")))
    cols = ["query", "leader", "item", "side", "lift", "evidence"]
    return own.select(*cols).unionByName(lack.select(*cols))


def rank_against(difference: DataFrame, results: DataFrame) -> DataFrame:
    """Adds by best lift first and cuts by worst, untested items last. difference(query, leader, item, side)."""
    rows = difference.join(results.select("leader", "item", "lift"), ["leader", "item"], "left")
    better = F.when(F.col("side") == "add", -F.round("lift", DIGITS)).otherwise(F.round("lift", DIGITS))
    place = F.row_number().over(W.partitionBy("query", "side").orderBy(better.asc_nulls_last(), F.asc("item")))
    return rows.withColumn("place", place)


def results_by_month(entries: DataFrame, entry_items: DataFrame) -> DataFrame:
    """Results of each item by month beside all of its leader's, months without any filled with 0."""
    month = F.trunc("date", "MM").alias("month")
    sums = lambda p: [F.count(F.lit(1)).alias(f"{p}baskets"), F.sum("games").alias(f"{p}games"), F.sum("wins").alias(f"{p}wins")]
    every = every_month(entries.groupBy("leader", month).agg(*sums("all_")), ["leader"], zero=["all_baskets", "all_games", "all_wins"])
    rows = entries.join(entry_items, "entry").groupBy("leader", "item", month).agg(*sums(""))
    calendar = rows.select("leader", "item").distinct().join(every, "leader")
    return calendar.join(rows, ["leader", "item", "month"], "left").fillna(0)
