"""A small catalogue searched with plain words."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wickerwork.functions.text import fold, price_limit, spoken_price
from wickerwork.operators import catalog as C
from wickerwork.operators import search as S

TERMS = ["U", "B", "G", "Sorcery", "Enchantment", "Land", "Trample", "Goblin", "Token Creation", "CMC_3", "CMC_4", "CMC_5", "CMC_6", "CMC_7_plus",
         "token:B", "token:Goblin", "token:Trample", "tag:flicker", "tag:theft", "tag:theft-enchantment", "tag:mill", "tag:silence"]
NAMES = {"tag:mill": ["library grinder"], "tag:silence": ["spell lock"]}
ITEMS = {"Quick Fingers": ["Sorcery", "tag:theft", "CMC_3"], "Rug Snatcher": ["U", "tag:theft", "tag:theft-enchantment", "CMC_5"], "Loan Shark": ["B", "tag:theft"],
         "Blinker": ["U", "tag:flicker"], "Camp": ["B", "Token Creation", "token:B", "token:Goblin", "CMC_6"], "Raider": ["B", "Goblin", "CMC_4"],
         "Warren": ["Land", "Goblin"], "Giant": ["G", "Trample", "CMC_7_plus"], "Millstone": ["tag:mill"], "Hush": ["Enchantment", "tag:silence"],
         "Stampede": ["G", "Token Creation", "token:Trample"], "Swamp": ["Land", "B"], "Grove": ["Land", "G"]}
QUERIES = ["stealing enchantments", "blinking", "mid black goblins", "making black goblin tokens", "quiet evening", "library grinders", "big trample",
           "you can't cast spells", "green lands or spell locks"]


@pytest.fixture(scope="module")
def parsed(spark):
    posted = spark.createDataFrame([(t, i) for i, ts in ITEMS.items() for t in ts], "term string, item string")
    counts = spark.createDataFrame([(t,) for t in TERMS], "term string").join(C.term_counts(posted), "term", "left").fillna(0, ["d"])
    weights = S.term_weights(counts, F.lit(len(ITEMS)))
    names = spark.createDataFrame([(t, n) for t in TERMS if t.startswith("tag:") for n in [t[4:], *NAMES.get(t, [])]], "term string, name string")
    groups = S.parse(spark.createDataFrame(list(enumerate(QUERIES)), "query int, text string"), names, weights).cache()
    mains, found = {}, {}
    for r in S.main_terms(groups).collect():
        mains.setdefault(QUERIES[r["query"]], set()).add(r["term"])
    for r in S.score(groups, posted, weights).collect():
        found.setdefault(QUERIES[r["query"]], []).append((-r["score"], r["item"]))
    return mains, {q: [i for _, i in sorted(rows)] for q, rows in found.items()}


def test_words_plurals_and_tags(parsed):
    mains, _ = parsed
    assert mains["stealing enchantments"] == {"tag:theft-enchantment"}
    assert mains["blinking"] == {"tag:flicker"}
    assert mains["mid black goblins"] == {"CMC_4", "CMC_5", "B", "Goblin"}
    assert "quiet evening" not in mains
    assert mains["library grinders"] == {"tag:mill"}
    assert mains["big trample"] == {"CMC_6", "CMC_7_plus", "Trample"}
    assert mains["you can't cast spells"] == {"tag:silence"}
    assert mains["green lands or spell locks"] == {"G", "Land", "tag:silence"}


def test_ranking(parsed):
    _, found = parsed
    assert found["stealing enchantments"][0] == "Rug Snatcher" and set(found["stealing enchantments"][1:]) == {"Quick Fingers", "Loan Shark"}
    assert found["mid black goblins"][0] == "Raider" and found["big trample"][0] == "Giant"
    assert set(found["green lands or spell locks"]) == {"Hush", "Grove", "Giant", "Stampede", "Warren", "Swamp"}


def test_words_after_makes_describe_the_token(parsed):
    mains, found = parsed
    assert mains["making black goblin tokens"] == {"token:B", "token:Goblin", "Token Creation"} and found["making black goblin tokens"][0] == "Camp"


def test_prices_and_names(spark):
    asked = {"mill below $7": 7.0, "silence less than 12 euros": 12.0, "giants €0.75 or less": 0.75, "camps below US$3.5": 3.5, "giants under 5 power": None, "a warren": None}
    df = spark.createDataFrame([(q,) for q in asked], "q string")
    assert {r["q"]: r["p"] for r in df.select("q", spoken_price(F.col("q")).alias("p")).collect()} == asked
    assert spark.range(1).select(price_limit(F.lit("Budget goblins")).alias("p")).first()["p"] == 1
    assert spark.range(1).select(fold(F.lit("Séance’s Édge  ")).alias("f")).first()["f"] == "seance's edge"


def test_kinds_keywords_and_tokens(spark):
    lines = {"Artifact Land": "Land", "Enchantment Creature — God": "Creature", "Instant // Land": "Instant", "": None}
    df = spark.createDataFrame([(t,) for t in lines], "t string")
    assert {r["t"]: r["k"] for r in df.select("t", C.kind_of(F.col("t")).alias("k")).collect()} == lines
    words = spark.createDataFrame([("Toxic",), ("Double strike",), ("Strike",)], "keyword string")
    texts = spark.createDataFrame([(1, "A toxicity report."), (2, "Toxic 1. Double strike, menace")], "id int, text string")
    assert {(r["id"], r["keyword"]) for r in C.find_keywords(texts, words).collect()} == {(2, "Toxic"), (2, "Double strike")}
    items = spark.createDataFrame([(1, "Create three 2/2 black Zombie creature tokens with menace."), (2, "Create a token that's a copy of another artifact.")], "item int, text string")
    menace = spark.createDataFrame([("Menace",)], "keyword string")
    zombie = spark.createDataFrame([("Zombie",)], "name string")
    assert {r["feature"] for r in C.token_features(items, menace, zombie).collect()} == {"token:B", "token:Creature", "token:Zombie", "token:Menace"}


def test_colourless_and_set_filters(spark):
    rows = spark.createDataFrame([("a", 0, ["one"]), ("b", 3, ["one", "two"]), ("c", 0, None)], "item string, identity int, sets array<string>")
    pick = lambda **asked: {r["item"] for r in rows.filter(C.item_filter(**asked)).collect()}
    assert pick(colors=["C"]) == {"a", "c"} and pick(colors=["W", "U"]) == {"b"} and pick(in_set="two") == {"b"} and pick(in_set="one", colors=["C"]) == {"a"}


def test_ancestors_stop_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "gone")], "child string, parent string")
    tags = spark.createDataFrame([(t,) for t in "abcx"], "tag string")
    held = spark.createDataFrame([(1, "a"), (2, "x")], "item int, tag string")
    assert {(r["item"], r["tag"]) for r in C.tags_with_ancestors(held, edges, tags).collect()} == {(1, "a"), (1, "b"), (1, "c"), (2, "x")}


def test_names_of_items_and_texts_of_queries_meet_once(spark):
    names = spark.createDataFrame([(1, "Red Gear"), (1, "red gear"), (1, "blue nut"), (2, "red gear"), (3, None)], "item int, name string")
    asked = spark.createDataFrame([(7, " red gear "), (7, "Blue Nut"), (8, "RED GEAR"), (9, "gear"), (10, None)], "query int, text string")
    found = S.exact_names(asked, names)
    assert sorted(map(tuple, found.collect())) == [(7, 1), (7, 2), (8, 1), (8, 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not plan.lstrip().startswith("Aggregate") and "Distinct" not in plan  # hits are not gathered again


def test_scores_of_few_and_of_many_queries_agree(spark, monkeypatch):
    groups = spark.createDataFrame([(q, f"g{t % 3}", f"t{t}", 1.0 / (1 + t % 2)) for q in range(6) for t in range(q, q + 5)], "query int, grp string, term string, credit double")
    posted = spark.createDataFrame([(f"t{t}", i) for i in range(20) for t in range(12) if (i + t) % 4 < 2] * 2, "term string, item int")
    weights = spark.createDataFrame([(f"t{t}", 1.0 + t) for t in range(11)], "term string, weight double")
    few = S.score(groups, posted, weights)
    assert few._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(query") == 0
    rows = sorted(map(tuple, few.collect()))
    monkeypatch.setattr(S, "FEW", 3)
    assert rows and rows == sorted(map(tuple, S.score(groups, posted, weights).collect()))


def test_equal_texts_are_parsed_once_and_found_for_all(spark):
    asked = spark.createDataFrame([(q, ["red gear", "blue nut", "red nut gear"][q % 3]) for q in range(30)] + [(40, "red"), (40, "gear"), (41, None)], "query int, text string")
    texts, askers = S.different_texts(asked)
    assert sorted(r["query"] for r in texts.collect()) == [0, 1, 2, 40, 40]
    variants = S.tag_variants(spark.createDataFrame([("g", "red gear"), ("g", "gear"), ("n", "nut"), ("b", "blue nuts")], "term string, name string"))
    found = S.matched_tags(S.query_words(S.spoken_words(texts, variants), variants), variants)
    got = {(r["query"], r["term"], r["size"]) for r in S.for_askers(found.select("query", "term", "size"), askers).collect()}
    want = {0: [("g", 2.0)], 1: [("n", 1.0), ("b", 2.0)], 2: [("g", 2.0), ("n", 1.0)]}
    assert got == {(q, *m) for q in range(30) for m in want[q % 3]} | {(40, "g", 2.0)}


def test_hits_of_few_queries_are_never_rows(spark, monkeypatch):
    groups = spark.createDataFrame([(q, f"g{t}", f"t{t}", 1.0) for q in range(40) for t in range(60)], "query int, grp string, term string, credit double")
    posted = spark.range(50).select(F.concat(F.lit("i"), "id").alias("item"), F.explode(F.sequence(F.lit(0), F.lit(59))).alias("t")).select("item", F.concat(F.lit("t"), "t").alias("term"))
    weights = spark.createDataFrame([(f"t{t}", 1.0) for t in range(60)], "term string, weight double")
    monkeypatch.setattr(S, "CELLS", 100)
    found = S.score(groups, posted, weights)
    assert found.count() == 2000 and found.filter("score <> 1").isEmpty()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "sum(" not in plan
    assert S.score(groups.filter("query < 0"), posted, weights).isEmpty()


def test_scores_far_below_the_best_are_no_rows(spark, monkeypatch):
    """Of many items with one of a query's two terms and few with both, tasks keep those near the best they have met."""
    groups = spark.createDataFrame([(1, "a", "a", 1.0), (1, "b", "b", 1.0), (2, "a", "a", 1.0)], "query int, grp string, term string, credit double")
    posted = spark.range(2000).selectExpr("id AS item", "explode(IF(id % 100 = 0, array('a', 'b'), array('a'))) AS term")
    weights = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 1.0)], "term string, d int, weight double")
    monkeypatch.setattr(S, "CELLS", 100)
    items = posted.selectExpr("item", "item AS number", "item AS cents", "item AS value", "CAST(NULL AS DATE) AS released", "'x' AS name").distinct()
    every, near = S.score(groups, posted, weights), S.score(groups, posted, weights, S.STRONG_MATCH)
    assert near.filter("query = 1").count() < 400 < 2000 == every.filter("query = 1").count()
    kept = lambda found: sorted(map(tuple, S.sort_results(found, "value-asc", items).select("query", "item", "score", "place").collect()))
    assert len(kept(near)) == 2020 and kept(near) == kept(every)


def test_no_plan_holds_all_steps_of_parsing(spark):
    weights = spark.createDataFrame([(t, 1, 1.0) for t in TERMS], "term string, d int, weight double")
    names = spark.createDataFrame([("tag:mill", "library grinder")], "term string, name string")
    groups = S.parse(spark.createDataFrame(list(enumerate(QUERIES)), "query int, text string"), names, weights)
    assert groups._jdf.queryExecution().executedPlan().toString().count("Exchange") < 20


def test_parts_of_the_same_text_are_parsed_once(spark, folder, monkeypatch):
    seen, real = [], S.parse
    monkeypatch.setattr(S, "parse", lambda queries, *more: seen.append(queries) or real(queries, *more))
    assert entry.queries()["n8_parsed_queries"](spark, folder).count() > 0
    assert seen[0].count() == seen[0].select("text").distinct().count()
