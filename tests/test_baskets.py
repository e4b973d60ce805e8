"""Planted baskets with known neighbours, bundles, recipes, partners and trends."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from wickerwork.operators import baskets as B
from wickerwork.operators import bundles as U
from wickerwork.operators import graphs as GR
from wickerwork.operators import pairs as P
from wickerwork.operators import recipes as R
from wickerwork.operators import trends as T
from wickerwork.operators import windows as win


def table(spark, baskets, leader="L"):
    rows = [(leader, b, i) for b, items in baskets.items() for i in items]
    return spark.createDataFrame(rows, "leader string, basket int, item int")


def heads(spark, baskets, leader="L"):
    return spark.createDataFrame([(leader, b) for b in baskets], "leader string, basket int")


FIVE = {1: [10, 11, 12, 13], 2: [10, 11, 12, 14], 3: [10, 14, 15, 16], 4: [10, 11, 12, 13], 5: [10, 15, 16]}


@pytest.fixture(scope="module")
def five(spark):
    items = table(spark, FIVE)
    return items, B.play_counts(items), B.sizes(heads(spark, FIVE))


def asked(spark, items):
    return spark.createDataFrame([(1, "L", i) for i in items], "query int, leader string, item int")


def test_similar_baskets_rank_by_shared_rare_items(spark, five):
    items, plays, n = five
    found = B.rank_similar(B.similarity(asked(spark, [10, 11, 12, 13]), items, plays, n), 10).orderBy("rank").collect()
    assert [r["basket"] for r in found] == [1, 4, 2, 3, 5]
    assert found[0]["similarity"] == 1 and found[0]["shared"] == 4 and found[-1]["similarity"] == 0


def test_near_copies_fold_into_the_first_shown(spark, five):
    items, plays, n = five
    similar = B.similarity(asked(spark, [10, 11, 12, 13]), items, plays, n)
    folded = B.fold_copies(similar, items, 10).orderBy("shown").collect()
    assert [(r["basket"], r["copies"]) for r in folded] == [(1, 1), (2, 0), (3, 0), (5, 0)]
    short = B.fold_copies(similar, items, 1).collect()
    assert [(r["basket"], r["copies"]) for r in short] == [(1, 0)]  # the copy comes after the last one shown


def test_recommendations(spark, five):
    items, plays, n = five
    queries = asked(spark, [11, 12, 13, 99])
    voted = B.votes(B.neighbours(B.similarity(queries, items, plays, n)), items)
    adds = [r["item"] for r in B.recommend_adds(voted, queries, plays, n).orderBy(F.desc("score")).collect()]
    assert adds[:2] == [10, 14] and not set(adds) & {11, 12, 13, 99}
    cuts = B.recommend_cuts(voted, queries).orderBy("share", F.desc("item")).collect()
    assert cuts[0]["item"] == 99 and cuts[0]["share"] == 0


def test_closest_leaders(spark):
    signatures = spark.createDataFrame([("1", i) for i in (5, 6, 7)] + [("2", i) for i in (5, 6, 8)] + [("3", 9)], "leader string, item int")
    n = spark.createDataFrame([("1", 300), ("2", 50), ("3", 900)], "leader string, n int")
    mine = spark.createDataFrame([(1, 5), (1, 6), (1, 8)], "query int, item int")
    assert [r["leader"] for r in B.closest_leaders(mine, signatures, n).orderBy("rank").collect()] == ["2", "1"]


def test_a_tag_like_a_better_one_is_skipped(spark):
    scores = spark.createDataFrame([("L", "tutor-to", 3.0), ("L", "tutor", 2.0), ("L", "ramp", 1.0)], "leader string, tag string, score double")
    items = spark.createDataFrame([("L", t, i) for t, s in {"tutor-to": [1, 2, 3], "tutor": [1, 2, 3, 4], "ramp": [8, 9]}.items() for i in s], "leader string, tag string, item int")
    assert [r["tag"] for r in B.pick_tags(scores, items, ["leader"], 3).orderBy("pos").collect()] == ["tutor-to", "ramp"]


def test_pair_counts_against_every_pair(spark):
    rng = random.Random(2)
    baskets = {b: sorted(rng.sample(range(40), rng.randrange(1, 15))) for b in range(300)}
    want = {}
    for b, items in baskets.items():
        for x, y in itertools.combinations(items, 2):
            want["AB"[b % 2], x, y] = want.get(("AB"[b % 2], x, y), 0) + 1
    rows = spark.createDataFrame([("AB"[b % 2], b, i) for b, s in baskets.items() for i in s], "leader string, basket int, item int")
    for block in (400_000, 50):
        got = {(r["leader"], r["a"], r["b"]): r["both"] for r in P.pair_counts(rows, block=block).collect()}
        assert got == want


def skewed_baskets(items=300, baskets=900):
    """Items from one in nearly every basket to ones hardly played; every tenth goes with the next one."""
    rng = random.Random(7)
    out = {}
    for b in range(baskets):
        held = {i for i in range(items) if rng.random() < 0.9 / (1 + i / 3)}
        out[b] = sorted(held | {i + 1 for i in held if i % 10 == 0 and rng.random() < 0.8})
    return out


@pytest.mark.parametrize("least", [0.15, 0.4])
def test_correlated_pairs_equal_all_pairs_filtered(spark, least):
    items = table(spark, skewed_baskets())
    plays, n = B.play_counts(items), B.sizes(heads(spark, skewed_baskets()))
    key = lambda df: {(r["a"], r["b"]): (r["both"], r["phi"]) for r in df.collect()}
    want = key(P.pair_phi(P.pair_counts(items), plays, n).filter(F.col("phi") >= least))
    assert key(P.correlated_pairs(items, plays, n, least)) == want and len(want) > 10


def test_strong_links_equal_all_links_filtered(spark):
    items = table(spark, skewed_baskets())
    groups = spark.createDataFrame([("L", b, b % 3) for b in skewed_baskets()], "leader string, basket int, grp int")
    key = lambda df: {(r["a"], r["b"]): (r["both"], r["link"]) for r in df.collect()}
    want = key(P.grouped_links(P.pair_counts(items), items, groups).filter("link >= 0.3"))
    assert key(P.strong_links(items, groups, 0.3)) == want and len(want) > 10


def test_thirty_thousand_items_are_counted_in_bounded_memory(spark):
    """Few often-played items and 30,000 rare ones: neither a matrix of all of them nor all pairs are ever held."""
    common = spark.range(4000).select(F.lit("L").alias("leader"), F.col("id").alias("basket"), F.explode(F.sequence(F.lit(0), F.lit(5)).cast("array<long>")).alias("item"))
    rare = spark.range(60_000).select(F.lit("L").alias("leader"), F.pmod(F.xxhash64("id"), F.lit(4000)).alias("basket"), (F.col("id") % 30_000 + 100).alias("item"))
    twins = rare.filter("item % 100 = 0").withColumn("item", F.col("item") + 1_000_000)  # each in the same baskets as its twin
    rows = common.unionByName(rare).unionByName(twins).distinct()
    n = spark.createDataFrame([("L", 4000)], "leader string, n long")
    found = P.correlated_pairs(rows, B.play_counts(rows), n, 0.95)
    assert found.filter("b - a = 1000000").count() == 300
    assert P.pair_counts(rows).filter("a < 6 and b < 6").agg(F.min("both")).first()[0] == 4000


def bundle_input(spark):
    baskets = {i: [*([] if i % 3 else [0, 1]), *([] if i % 2 else [2]), *([3, 4] if i < 50 else [])] for i in range(100)}
    items = table(spark, baskets)
    return items, B.play_counts(items), B.sizes(heads(spark, baskets))


def find(spark, groups, precon=(), staples=()):
    items, plays, n = bundle_input(spark)
    none = spark.createDataFrame([], "item int")
    groups = spark.createDataFrame([("L", i, groups(i)) for i in range(100)], "leader string, basket int, grp int")
    fixed = spark.createDataFrame([(i,) for i in staples], "item int")
    pre = spark.createDataFrame([("L", i) for i in precon], "leader string, item int")
    found, counts = U.find_bundles(items, plays, n, groups, none, fixed, pre)
    sets = {}
    for r in found.collect():
        sets.setdefault(r["bundle"], []).append(r["item"])
    return {tuple(sorted(sets[r["bundle"]])): r["baskets"] for r in counts.collect()}


def test_bundles(spark):
    assert find(spark, lambda i: 0) == {(0, 1): 34, (3, 4): 50}
    assert find(spark, lambda i: int(i < 50)) == {(0, 1): 34}  # 3 and 4 only go with their group
    assert find(spark, lambda i: 0, precon=[0]) == {(3, 4): 50}
    assert find(spark, lambda i: 0, staples=[3, 4]) == {(0, 1): 34}


def test_played_more_with(spark):
    baskets = {i: [*([100] if i < 40 else []), *([101] if i < 50 else []), *([102] if i < 5 else []), *([103] if i < 4 else []), 104,
                   *([105] if (i < 20 if i < 40 else i < 70) else []), *([106] if i >= 97 else [])] for i in range(100)}
    items = table(spark, baskets)
    plays, n, pairs = B.play_counts(items), B.sizes(heads(spark, baskets)), P.pair_counts(items)
    rows = P.played_more_with(pairs, plays, n).filter("x = 100").orderBy(F.desc("score")).collect()
    assert [r["item"] for r in rows] == [101, 102]
    assert (rows[0]["base"], rows[0]["share"], rows[0]["plays_x"], rows[0]["both"]) == (0.5, 1.0, 40, 40)
    assert P.played_more_with(pairs, plays, n).filter("x = 102").count() == 0
    loose = P.played_more_with(pairs, plays, n, least=4, evidence=0.0).filter("x = 100").orderBy(F.desc("score"), "item").collect()
    assert [r["item"] for r in loose] == [101, 102, 103]
    made = lambda i: [datetime.date(2026, 1, 15), datetime.date(2026, 3, 2), None, datetime.date(2025, 12, 31)][0 if i < 30 else 1 if i < 60 else 2 if i < 90 else 3]
    dated = spark.createDataFrame([("L", i, made(i)) for i in baskets], "leader string, basket int, made date")
    months = T.play_rate_by_month(items, dated).filter("item = 100").orderBy("month").collect()
    assert [(r["made"], r["playing"]) for r in months] == [(10, 0), (30, 30), (0, 0), (30, 10)]


def test_synergy_edges(spark):
    def held(i):
        if i < 60:
            return [100, *([] if i % 2 else [101, 102]), *([] if i % 3 else [103, 104]), *([105] if i < 20 else []), *([106] if i >= 40 else []), 107]
        return [*([] if i % 10 else [101, 102, 103, 104, 105, 106]), 107]
    baskets = {i: held(i) for i in range(120)}
    items = table(spark, baskets)
    plays, n = B.play_counts(items), B.sizes(heads(spark, baskets))
    ring = P.partners(P.played_more_with(P.pair_counts(items), plays, n)).filter("x = 100")
    assert {r["item"] for r in ring.collect()} == set(range(101, 107))
    chosen = ring.select("leader", F.col("x").alias("centre"), "item")
    centre = items.filter("item = 100").select("leader", F.col("item").alias("centre"), "basket")
    edges = {(r["a"], r["b"]): r["kind"] for r in GR.pick_edges(P.ring_pairs(chosen, centre, items), ["leader", "centre"]).collect()}
    assert edges[101, 102] == "together" and edges[103, 104] == "together" and edges[105, 106] == "apart"
    assert sum(k == "together" for k in edges.values()) <= 4


def test_recipes_count_the_leader_as_played(spark):
    baskets = {i: [1, 2, *([3] if i < 5 else [])] for i in range(10)}
    items = table(spark, baskets)
    recipe = {"a": [1, 2], "b": [9, 1], "c": [1, 3], "d": [1, 4], "e": [8, 1]}
    rows = spark.createDataFrame([(r, i, r == "e" and i == 8) for r, s in recipe.items() for i in s], "recipe string, item int, must_lead boolean")
    lead = spark.createDataFrame([("L", 9)], "leader string, item int")
    counts = {r["recipe"]: r["count"] for r in R.baskets_with_recipes(items, rows, lead).groupBy("recipe").count().collect()}
    assert counts == {"a": 10, "b": 10, "c": 5}
    must = spark.createDataFrame([("b", 9, True), ("b", 1, False), ("x", 1, True)], "recipe string, item int, must_lead boolean")
    assert {r["recipe"] for r in R.baskets_with_recipes(items, must, lead).select("recipe").distinct().collect()} == {"b"}


def test_recipe_groups_differ_in_one_item(spark):
    rows = [("r1", 0, [1, 2, 3], ["n"], ["p"]), ("r2", 1, [1, 2, 4], ["n"], ["p"]), ("r3", 2, [1, 2, 5], ["m"], ["p"]), ("r4", 3, [3, 2, 1], ["n"], ["p"]), ("r5", 4, [7, 8], [], [])]
    df = spark.createDataFrame([("L", *r) for r in rows], "leader string, recipe string, pos int, items array<int>, needs array<string>, makes array<string>")
    got = {r["recipe"]: (r["head"], list(r["core"]), r["option"]) for r in R.group_recipes(df).collect()}
    assert got == {"r1": ("r1", [1, 2], "3"), "r2": ("r1", [1, 2], "4"), "r3": ("r3", [1, 2, 5], None), "r5": ("r5", [7, 8], None)}


def test_recipe_text(spark):
    df = spark.createDataFrame([("r", ["A // B", "C"], ["land"], ["Infinite"], "{W/U}", "Be ready.", "", "Do {2}{G}.\nStop.")],
                               "recipe string, names array<string>, needs array<string>, makes array<string>, mana string, easy string, notable string, steps string")
    text = R.recipe_text(df).first()["text"]
    assert "**Cards:** [[A]] + [[C]]" in text and "- Any land" in text and "- [[symbol:wu]] available" in text
    assert "1. Do [[symbol:2]][[symbol:g]]." in text and "2. Stop." in text and "**Result:** Infinite" in text


def test_trends(spark):
    made = spark.createDataFrame([("1", 100, 10, 5, 1), ("2", 20, 20, 12, 6), ("3-4", 30, 6, 3, 0)], "leader string, ever long, w90 long, w30 long, w7 long")
    assert [r["leader"] for r in T.trending_leaders(made, "w30").collect()] == ["2"]
    plays = spark.createDataFrame([("1", 5, 90, 10, 5, 1), ("1", 9, 10, 0, 0, 0), ("2", 5, 20, 20, 12, 6), ("3-4", 9, 6, 6, 3, 0)], "leader string, item int, ever long, w90 long, w30 long, w7 long")
    trends = T.item_trends(plays, made, "w30").orderBy(F.desc("share")).collect()
    assert [(r["item"], r["now"]) for r in trends] == [(5, 17), (9, 3)]
    assert [r["item"] for r in T.rising_items(T.item_trends(plays, made, "w30")).orderBy(F.desc("score")).collect()] == [5, 9]
    table_ = made.withColumns({"identity": F.when(F.col("leader") == "1", 1).when(F.col("leader") == "2", 3).otherwise(4), "price": F.when(F.col("leader") == "1", 20000).when(F.col("leader") == "2", 8000).otherwise(5000),
                               "bracket": F.when(F.col("leader") == "1", 3).otherwise(2), "parts": F.when(F.col("leader") == "3-4", 2).otherwise(1),
                               "themes": F.when(F.col("leader") == "1", F.array(F.lit("tokens"))).when(F.col("leader") == "2", F.array(F.lit("lifegain"))).otherwise(F.array(F.lit("tokens"), F.lit("lifegain")))})
    keys = lambda **k: sorted(r["leader"] for r in table_.filter(T.leader_filter(**k)).collect())
    assert keys(identity=3) == ["2"] and keys(identity=0) == [] and keys(max_price=10000, kind="single") == ["2"]
    assert keys(themes=["tokens"], brackets=[2]) == ["3-4"] and keys(window="w7", least=1) == ["1", "2"]


def test_windows_are_filled_in_or_absent(spark):
    day = datetime.date
    dated = spark.createDataFrame([(day(2026, 1, 1),), (day(2026, 9, 20),), (None,)], "made date")
    found = {r["w"]: r["since"] for r in win.valid_windows(dated, "made", "2026-10-04").collect()}
    assert found == {90: day(2026, 7, 6), 30: day(2026, 9, 4)}  # nobody is known to be made in the last 7 days


def test_made_dates_by_number(spark):
    day = datetime.date
    rows = [(1, "1", day(2026, 1, 1), None), (2, "2", None, None), (0, "0", None, None), (3, "3", day(2026, 2, 1), None), (None, "m", day(2026, 3, 1), None), (None, "n", None, None),
            (4, "4", day(2026, 5, 1), day(2026, 6, 1)), (5, "5", None, None)]
    df = spark.createDataFrame(rows, "id long, basket string, created date, removed date")
    got = {r["basket"]: r["made"] for r in B.made_dates(df, width=2).collect()}
    assert got == {"1": day(2026, 1, 1), "2": day(2026, 1, 1), "0": None, "3": day(2026, 2, 1), "m": day(2026, 3, 1), "n": None, "4": day(2026, 5, 1), "5": day(2026, 2, 1)}


def walked(recipes):
    """Groups by a plain walk in order: {recipe: (head, core, option)}. recipes: (recipe, items, like)."""
    groups, seen = [], set()
    for recipe, items, like in recipes:
        items = frozenset(items)
        if items in seen:
            continue
        seen.add(items)
        for g in groups:
            if g["like"] == (like, len(items)) and len(g["core"] & items) == len(items) - 1:
                g["core"] &= items
                g["rows"].append((recipe, items))
                break
        else:
            groups.append({"like": (like, len(items)), "core": items, "rows": [(recipe, items)]})
    return {recipe: (g["rows"][0][0], sorted(g["core"]), str(min(items - g["core"])) if items - g["core"] else None) for g in groups for recipe, items in g["rows"]}


@pytest.mark.parametrize("pool,size", [(9, 3), (14, 2), (40, 4)])
def test_recipe_groups_equal_a_walk_in_order(spark, pool, size):
    rng = random.Random(pool)
    recipes = {leader: [(f"{leader}{i}", rng.sample(range(pool), rng.choice([size, size, size - 1])), rng.choice("xxy")) for i in range(120)] for leader in "AB"}
    rows = [(leader, r, pos, items, [like], ["p"]) for leader, listed in recipes.items() for pos, (r, items, like) in enumerate(listed)]
    df = spark.createDataFrame(rows, "leader string, recipe string, pos int, items array<int>, needs array<string>, makes array<string>").repartition(5)
    got = {r["recipe"]: (r["head"], list(r["core"]), r["option"]) for r in R.group_recipes(df).collect()}
    want = {k: v for listed in recipes.values() for k, v in walked(listed).items()}
    assert got == want and len({v[0] for v in want.values()}) < len(want)
    assert R.group_recipes(df.filter("false")).count() == 0


def test_near_recipes_equal_every_recipe_tried(spark):
    rng = random.Random(9)
    baskets = {b: set(rng.sample(range(25), rng.randrange(1, 12))) for b in range(80)}
    recipes = {f"r{i}": set(rng.sample(range(25), rng.randrange(1, 5))) for i in range(150)} | {"lone": {99}}
    counts = {r: len(r) for r in recipes if r != "r7"}
    items = spark.createDataFrame([(b, i) for b, held in baskets.items() for i in held], "query int, item int")
    rows = spark.createDataFrame([(r, i) for r, needed in recipes.items() for i in needed], "recipe string, item int")
    got = {(r["query"], r["recipe"], r["missing"], r["baskets"]) for r in R.near_recipes(items, rows, spark.createDataFrame(list(counts.items()), "recipe string, baskets long")).collect()}
    want = {(b, r, min(needed - held), counts[r]) for b, held in baskets.items() for r, needed in recipes.items()
            if r in counts and len(needed) > 1 and len(needed - held) == 1}
    assert got == want and len({len(recipes[r]) for _, r, _, _ in want}) == 3


def test_pair_sums_equal_every_pair(spark):
    rng = random.Random(4)
    baskets = {b: (rng.randrange(9), rng.sample(range(30), rng.randrange(1, 9))) for b in range(200)}
    rows = spark.createDataFrame([("L", b, i, games) for b, (games, held) in baskets.items() for i in held], "leader string, basket int, item int, games long")
    want = {}
    for games, held in baskets.values():
        for x, y in itertools.combinations(sorted(held), 2):
            n, g = want.get((x, y), (0, 0))
            want[x, y] = n + 1, g + games
    for block in (400_000, 60):
        got = {(r["a"], r["b"]): (r["both"], r["games"]) for r in P.pair_counts(rows, block=block, sums=["games"]).collect()}
        assert got == want


def test_recipes_of_the_same_items_count_alike(spark):
    items = table(spark, {1: [1, 2, 3], 2: [1, 2], 3: [2, 3]})
    rows = spark.createDataFrame([("a", 1, False), ("a", 2, False), ("b", 2, False), ("b", 1, False), ("c", 2, True), ("c", 1, False), ("d", 3, False)],
                                 "recipe string, item int, must_lead boolean")
    lead = spark.createDataFrame([("M", 2)], "leader string, item int")
    counts = {r["recipe"]: r["baskets"] for r in R.recipe_counts(items, rows, lead).collect()}
    assert counts == {"a": 2, "b": 2, "d": 2}  # c wants an item that only another leader has
    assert R.baskets_with_recipes(items, rows, lead).count() == 6


def edges_by_hand(pairs, link, stand_out, apart, each, least):
    """The greedy pick over one graph's pairs {(a, b): (both, phi)}."""
    typical = sorted(phi for _, phi in pairs.values())[len(pairs) // 2]
    strong = sorted(((-phi, a, b) for (a, b), (both, phi) in pairs.items() if phi >= max(link, typical + stand_out) and both >= least))
    weak = sorted(((-phi, a, b) for (a, b), (_, phi) in pairs.items() if phi <= apart), reverse=True)
    out = set()
    for kind, rows, enough in (("together", strong, any), ("apart", weak, all)):
        used = {}
        for _, a, b in rows:
            if enough(used.get(x, 0) < each for x in (a, b)):
                used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
                out.add((a, b, kind))
    return out


def test_edges_of_many_graphs_equal_a_walk(spark):
    rng = random.Random(13)
    graphs = {g: {(a, b): (rng.randrange(12), round(rng.uniform(-1, 1), 1)) for a, b in itertools.combinations(range(rng.randrange(2, 12)), 2)} for g in range(25)}
    rows = [("L", g, a, b, both, phi) for g, pairs in graphs.items() for (a, b), (both, phi) in pairs.items()]
    picked = GR.pick_edges(spark.createDataFrame(rows, "leader string, g int, a int, b int, both int, phi double"), ["leader", "g"], link=0.2, stand_out=0.1, apart=-0.3)
    got = {}
    for r in picked.collect():
        got.setdefault(r["g"], set()).add((r["a"], r["b"], r["kind"]))
    want = {g: edges_by_hand(pairs, 0.2, 0.1, -0.3, 2, 5) for g, pairs in graphs.items() if pairs}
    assert got == {g: e for g, e in want.items() if e} and len({k for e in want.values() for _, _, k in e}) == 2


def test_won_nodes(spark):
    nodes = spark.createDataFrame([("L", 1, "x", "centre"), ("L", 1, "y", "partner"), ("L", 2, "z", "centre")], "leader string, g int, node string, kind string")
    won = spark.createDataFrame([("L", 1, "y", 0.2), ("L", 1, "elsewhere", 0.3)], "leader string, g int, node string, lift double")
    marked, edges = GR.with_won(nodes, won, ["leader", "g"])
    assert sorted((r["g"], r["node"] or "", r["kind"], r["lift"]) for r in marked.collect()) == [(1, "", "won", None), (1, "x", "centre", None), (1, "y", "partner", 0.2), (2, "z", "centre", None)]
    assert [(r["g"], r["node"]) for r in edges.collect()] == [(1, "y")]


def test_recipes_are_matched_in_the_baskets_own_rows(spark, monkeypatch):
    staged, real = [], R.cut_lineage
    monkeypatch.setattr(R, "cut_lineage", lambda df, name="stage": staged.append(real(df, name)) or staged[-1])
    baskets = {b: list(range(20)) for b in range(50)}
    rows = spark.createDataFrame([(f"r{i}", x, False) for i in range(300) for x in (i % 10, 10 + i % 7, 17 + i % 5)], "recipe string, item int, must_lead boolean")
    got = {r["recipe"]: r["baskets"] for r in R.recipe_counts(table(spark, baskets), rows).collect()}
    assert got == {f"r{i}": 50 for i in range(300) if 17 + i % 5 < 20}
    assert max(df.count() for df in staged) < 50 * 20  # neither what a basket nearly holds nor its items one by one


def test_near_recipes_shuffle_no_names(spark):
    items = spark.createDataFrame([(b, f"item {(b + i) % 9}") for b in range(20) for i in range(4)], "query int, item string")
    rows = spark.createDataFrame([(r, f"item {(r * k) % 9}") for r in range(1, 9) for k in (1, 2, 4)], "recipe int, item string")
    found = R.near_recipes(items, rows, spark.createDataFrame([(r, 1) for r in range(1, 9)], "recipe int, baskets long"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() > 0 and "items:array<int>" in plan and "array<string>" not in plan


def test_similar_sets_go_by_numbers_and_lose_no_pair(spark):
    import random
    from wickerwork.operators.setjoin import similar_sets
    rng, sets = random.Random(5), {}
    for k in range(120):
        base = sets[rng.randrange(k)] if k and rng.random() < 0.7 else {f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 25))}
        sets[k] = (base - set(rng.sample(sorted(base), min(len(base) - 1, rng.randrange(3))))) | {f"w{rng.randrange(40)}" for _ in range(rng.randrange(2))} | ({f"own{k}"} if rng.random() < 0.2 else set())
    found = similar_sets(spark.createDataFrame([(k, w) for k, ws in sets.items() for w in ws], "basket int, item string"), 0.8)
    firsts = {frozenset(ws): k for k, ws in reversed(sets.items())}
    reps = sorted(firsts.values())
    want = {(a, b, len(sets[a] & sets[b])) for a in reps for b in reps if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}
    want |= {(firsts[frozenset(ws)], k, len(ws)) for k, ws in sets.items() if firsts[frozenset(ws)] != k}
    assert len(want) > 20 and sorted((r["a"], r["b"], r["shared"]) for r in found.collect()) == sorted(want)
    assert "items" not in found._jdf.queryExecution().optimizedPlan().toString()  # pairs carry no lists of words


def test_colours_are_told_in_a_baskets_own_row(spark, folder):
    from wickerwork.plans import load_all
    from wickerwork.plans.registry import QUERIES
    load_all()
    plan = QUERIES["f10_within_colors"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Relation [l_orderkey") == 1  # lines are read once
