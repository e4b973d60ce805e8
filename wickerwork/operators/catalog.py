"""Catalogue jobs: kinds, masks, tags and their ancestors, item numbers, names, features, terms and postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wickerwork.functions.numeric import cents, mask_of
from wickerwork.functions.text import COLOR_WORDS, fold, lookup
from wickerwork.operators.ranking import number_rows, top_n
from wickerwork.session import cut_lineage

# ---- fixed values ---------------------------------------------------------------------------------------------
KIND_ORDER = ["Land", "Creature", "Planeswalker", "Battle", "Instant", "Sorcery", "Artifact", "Enchantment"]
TYPE_ORDER = ["Creature", "Planeswalker", "Battle", "Instant", "Sorcery", "Artifact", "Enchantment", "Land", "Other"]
TYPES = ["Creature", "Instant", "Sorcery", "Artifact", "Enchantment", "Land", "Planeswalker", "Battle", "Legendary"]
FILTER_TYPES = TYPES[:-1]
COLORS = ["W", "U", "B", "R", "G"]
FORMATS = ["standard", "pioneer", "modern", "legacy", "vintage", "commander", "pauper"]
VALUE_BUCKETS = ["CMC_0", "CMC_1", "CMC_2", "CMC_3", "CMC_4", "CMC_5", "CMC_6", "CMC_7_plus"]
STOPWORDS = ["you", "the", "of", "new", "will", "time", "lord", "head", "art", "fire", "moon", "gold", "mine", "plan", "key", "map",
             "town", "lady", "sand", "hell", "case", "room", "double"]
TRIVIA_TAGS = ["card-names", "un-design", "type-errata", "draft-signpost", "digital-only-mechanics"]
NOT_A_PLAN = (r"^cycle-|-effect$|vanilla|^multiple-|^passive-ability$|^delayed-trigger$|^inverted-effects$|^intervening-if|out-of-color|"
              r"^noncreature-typal$|^unique-type-line$|^drawback$|^cheaper-than-mv$|^staple-with")
SUBTYPE = r"^[A-Z][A-Za-z'-]+$"
TOKEN = r"(?i)\bcreates? ([^.;]*?)\btokens?\b([^.;]*)"
# ---------------------------------------------------------------------------------------------------------------


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def kind_of(type_line: Column) -> Column:
    """The kind an item is listed under: the first of KIND_ORDER among its front face's type words."""
    front = F.split(F.trim(F.split(type_line, "//")[0]), r"\s+")
    return F.try_element_at(F.filter(strings(KIND_ORDER), lambda k: F.array_contains(front, k)), F.lit(1))


def subtypes(type_line: Column) -> Column:
    """Words after the dash of each face."""
    after = F.transform(F.filter(F.split(type_line, "//"), lambda p: p.contains("—")), lambda p: F.split(F.trim(F.split(p, "—")[1]), r"\s+"))
    return F.filter(F.flatten(after), lambda w: w != "")


def type_words(type_line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(type_line, "//", " ")), r"\s+")


def filter_columns(items: DataFrame) -> DataFrame:
    """identity, types and legal masks, kind, price in cents. items(item, type_line, color_identity, legalities, price)."""
    legal = F.map_keys(F.map_filter("legalities", lambda _, v: v.isin("legal", "restricted")))
    return items.withColumns({
        "identity": mask_of(F.col("color_identity"), COLORS), "types": mask_of(type_words(F.col("type_line")), FILTER_TYPES),
        "legal": mask_of(legal, FORMATS), "kind": kind_of(F.col("type_line")), "cents": cents(F.col("price"))})


def item_filter(colors: list[str] | None = None, types: list[str] = (), legal_in: str = "", least: float | None = None,
                most: float | None = None, max_cents: int | None = None, in_set: str = "") -> Column:
    """Predicate over ``filter_columns``, ``value`` and ``sets`` (array): identity exactly the colours (letters that are no colour,
    as for colourless, add nothing), any of the types, printed in the set, and so on."""
    ok = F.lit(True)
    if colors:
        ok = ok & (F.col("identity") == sum(1 << COLORS.index(c) for c in set(colors) if c in COLORS))
    if types:
        ok = ok & (F.col("types").bitwiseAND(sum(1 << FILTER_TYPES.index(t) for t in types)) != 0)
    if legal_in:
        ok = ok & (F.col("legal").bitwiseAND(1 << FORMATS.index(legal_in)) != 0)
    if least is not None:
        ok = ok & (F.col("value") >= least)
    if most is not None:
        ok = ok & (F.col("value") <= most)
    if in_set:
        ok = ok & F.coalesce(F.array_contains("sets", in_set), F.lit(False))
    if max_cents is not None:
        ok = ok & F.col("cents").isNotNull() & (F.col("cents") <= max_cents)
    return ok


def by_kind(items: DataFrame) -> DataFrame:
    """(kind, place, items): items grouped by kind in the fixed order."""
    order = lookup({k: str(i) for i, k in enumerate(TYPE_ORDER)})
    kind = F.coalesce(F.col("kind"), F.lit("Other"))
    return items.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("items")).withColumn("place", order[F.col("kind")].cast("int"))


# ---- numbers and names ----------------------------------------------------------------------------------------


def item_numbers(items: DataFrame) -> DataFrame:
    """Dense item numbers, most popular first: by (no rank, rank, name, item)."""
    order = [F.asc(F.col("rank").isNull()), F.asc_nulls_last("rank"), F.asc("name"), F.asc("item")]
    return number_rows(items, order)


def name_lookup(items: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(key, number): folded whole names and front faces of items, the lowest number first, then other names.
    items(number, name), aliases(number, name)."""
    faces = items.select("number", F.explode(F.array(F.struct(F.lit(0).alias("face"), F.col("name").alias("n")),
                                                     F.struct(F.lit(1).alias("face"), F.split("name", " // ")[0].alias("n")))).alias("_f"))
    rows = faces.select(fold(F.col("_f.n")).alias("key"), F.lit(0).alias("source"), "number", "_f.face")
    if aliases is not None:
        rows = rows.unionByName(aliases.select(fold(F.col("name")).alias("key"), F.lit(1).alias("source"), "number", F.lit(0).alias("face")))
    return rows.groupBy("key").agg(F.min(F.struct("source", "number", "face")).alias("_b")).select("key", "_b.number")


def full_names(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """(query, wanted, name null if unknown): full names in any case or by front face, whole names first; names that say
    one face twice are left out. wanted(query, wanted), names(name)."""
    parts = F.split("name", " // ")
    real = names.select("name").distinct().filter(F.size(F.array_distinct(parts)) == F.size(parts))
    keys = real.select(F.lower("name").alias("key"), F.lit(0).alias("p"), "name").unionByName(
        real.select(F.lower(parts[0]).alias("key"), F.lit(1).alias("p"), "name"))
    best = keys.groupBy("key").agg(F.min(F.struct("p", "name")).alias("_b")).select("key", F.col("_b.name").alias("name"))
    return wanted.withColumn("key", F.lower("wanted")).join(best, "key", "left").select("query", "wanted", "name")


def leader_key(texts: DataFrame, lookup_table: DataFrame) -> DataFrame:
    """(id, leader): "A / B" as sorted item numbers joined by "-", for the texts whose names all resolve. texts(id, text)."""
    parts = texts.select("id", F.posexplode(F.split("text", " / ")).alias("pos", "name")).withColumn("key", F.lower("name"))
    found = parts.join(lookup_table, "key", "left")
    return (found.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count("number").alias("k"), F.array_sort(F.collect_list("number")).alias("_l"))
            .filter("n = k").select("id", F.array_join(F.transform("_l", lambda x: x.cast("string")), "-").alias("leader")))


def name_prefix_search(names: DataFrame, queries: DataFrame, shown: int = 12) -> DataFrame:
    """Items whose name contains each query, names starting with it first, then by number."""
    from wickerwork.operators.textjoin import contains_join
    low = names.withColumn("_low", F.lower("name"))
    found = contains_join(low, queries.filter(F.length("q") >= 2), "_low")
    return top_n(found, "query", [F.desc(F.startswith(F.col("_low"), F.col("q"))), F.asc("number")], shown)


def leaders_eligible(items: DataFrame, n: int | None = None) -> DataFrame:
    """Ranked, legal items that can lead: a legendary creature in front, or text that says so; the n most popular."""
    front = F.split("type_line", " // ")[0]
    rows = items.filter(F.col("rank").isNotNull() & (F.col("legalities")["commander"] == "legal")
                        & ((front.contains("Legendary") & front.contains("Creature")) | F.col("text").contains("can be your commander")))
    return rows if n is None else rows.orderBy("rank", "item").limit(n)


def sets_newest_first(variants: DataFrame) -> DataFrame:
    """(set, released, place): sets by earliest release, newest first."""
    first = variants.groupBy("set").agg(F.min("released").alias("released"))
    return first.withColumn("place", F.row_number().over(W.orderBy(F.desc("released"), F.asc("set"))))


# ---- tags -----------------------------------------------------------------------------------------------------


def ancestors(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(tag, ancestor) of a tag graph, whatever cycles it has. Each round doubles the length of the paths known, and stops
    when no pair is new. edges(child, parent)."""
    known = cut_lineage(edges.select(F.col("child").alias("tag"), F.col("parent").alias("ancestor")).distinct())
    count = known.count()
    for _ in range(rounds):
        step = known.alias("a").join(known.alias("b"), F.col("a.ancestor") == F.col("b.tag")).select(F.col("a.tag"), F.col("b.ancestor"))
        known = cut_lineage(known.unionByName(step).distinct())
        grown = known.count()
        if grown == count:
            return known
        count = grown
    raise RuntimeError(f"paths still grow after {rounds} rounds")


def tags_with_ancestors(item_tags: DataFrame, edges: DataFrame, tags: DataFrame) -> DataFrame:
    """(item, tag): items are of their tags and of every ancestor among the known tags."""
    real = edges.join(tags.select(F.col("tag").alias("child")), "child").join(tags.select(F.col("tag").alias("parent")), "parent")
    up = ancestors(real)
    return item_tags.unionByName(item_tags.join(up, "tag").select("item", F.col("ancestor").alias("tag"))).distinct()


def without_trivia(tags: DataFrame, edges: DataFrame, listed: list[str] = TRIVIA_TAGS) -> DataFrame:
    """Tags neither listed, nor under a listed tag, nor about storylines."""
    under = ancestors(edges).filter(F.col("ancestor").isin(listed)).select("tag").distinct()
    return tags.filter(~F.col("tag").isin(listed) & ~F.col("tag").contains("storyline")).join(under, "tag", "left_anti")


def telling_tags(item_tags: DataFrame, most: int = 2000) -> DataFrame:
    """Tags that tell what items do: not about wording, on at most ``most`` items."""
    kept = item_tags.groupBy("tag").agg(F.count(F.lit(1)).alias("k")).filter((F.col("k") <= most) & ~F.col("tag").rlike(NOT_A_PLAN))
    return item_tags.join(kept.select("tag"), "tag").select("item", "tag")


# ---- features, terms, postings --------------------------------------------------------------------------------


def find_keywords(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """(id, keyword): keywords a text holds as whole words, the longest first where they overlap. texts(id, text).

    Texts are cut at word boundaries and their runs of pieces joined to the keywords, whose lengths are all that is read
    on the way; overlaps are settled by a fold over one text's own hits."""
    pieces = lambda c: F.filter(F.split(F.lower(c), r"\b"), lambda x: x != "")
    known = keywords.select("keyword", F.array_join(pieces(F.col("keyword")), "").alias("gram"), F.size(pieces(F.col("keyword"))).alias("len"))
    lengths = known.agg(F.array_sort(F.collect_set("len"))).scalar()
    cut = texts.select("id", pieces(F.col("text")).alias("_p")).withColumn("_lens", lengths)
    runs = (cut.select("id", "_p", F.explode("_lens").alias("len")).filter(F.size("_p") >= F.col("len"))
            .select("id", "_p", "len", F.explode(F.sequence(F.lit(1), F.size("_p") - F.col("len") + 1)).alias("start"))
            .select("id", "len", "start", F.array_join(F.slice("_p", F.col("start"), F.col("len")), "").alias("gram")))
    hits = runs.join(known, ["gram", "len"])
    listed = hits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("len")).alias("minus"), "keyword"))).alias("_h"))
    first = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("kept"))
    walk = F.aggregate("_h", first, lambda s, h: F.when(h["start"] > s["end"], F.struct(
        (h["start"] - h["minus"] - 1).alias("end"), F.array_append(s["kept"], h["keyword"]).alias("kept"))).otherwise(s))
    return listed.select("id", F.explode(F.array_distinct(walk["kept"])).alias("keyword"))


def token_features(items: DataFrame, keywords: DataFrame, names: DataFrame) -> DataFrame:
    """(item, feature): colours, types, subtypes and keywords of the tokens an item's text creates; copies are skipped.
    items(item, text), keywords(keyword), names(name): subtype names."""
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(1)).alias("made"), F.regexp_extract_all("text", F.lit(TOKEN), F.lit(2)).alias("rest"))
    clauses = items.select("item", F.posexplode(both).alias("pos", "_c")).select("item", "pos", "_c.made", "_c.rest")
    low = F.lower(F.ltrim("rest"))
    clauses = clauses.filter(~low.startswith("that's a copy") & ~low.startswith("that are copies"))
    said = clauses.select("item", F.explode(F.regexp_extract_all("made", F.lit("([A-Za-z'-]+)"), F.lit(1))).alias("word"))
    capital = F.concat(F.upper(F.substring("word", 1, 1)), F.lower(F.expr("substring(word, 2)")))
    color = lookup(COLOR_WORDS)[F.lower("word")]
    kind = F.when(capital.isin(TYPES), capital)
    plain = said.select("item", "word", F.coalesce(color, kind).alias("what"))
    named = plain.filter("what is null").join(names.select(F.col("name").alias("word")), "word").select("item", F.col("word").alias("what"))
    withs = clauses.select(F.struct("item", "pos").alias("id"), F.lower(F.regexp_extract("rest", r'^\s*with ([^"]*)', 1)).alias("text")).filter("text <> ''")
    granted = find_keywords(withs, keywords).select(F.col("id.item").alias("item"), F.col("keyword").alias("what"))
    rows = plain.filter("what is not null").select("item", "what").unionByName(named).unionByName(granted)
    return rows.select("item", F.concat(F.lit("token:"), "what").alias("feature")).distinct()


def common_terms(features: DataFrame, least: int = 3) -> DataFrame:
    """(term): features on enough items that are no everyday words. features(item, feature), distinct."""
    counts = features.groupBy(F.col("feature").alias("term")).agg(F.count(F.lit(1)).alias("k"))
    return counts.filter((F.col("k") >= least) & ~F.lower("term").isin(STOPWORDS)).select("term")


def term_space(keywords: DataFrame, names: DataFrame, tokens: DataFrame, item_tags: DataFrame, n: Column) -> DataFrame:
    """(term, category): the terms items are indexed by, each in the first category it is in."""
    spark = keywords.sparkSession
    fixed = lambda values, category: spark.createDataFrame([(v, category) for v in values], "term string, category int")
    tags = item_tags.groupBy("tag").agg(F.count(F.lit(1)).alias("k")).filter(
        (F.col("k") >= 2) & (F.col("k") <= n / 2) & ~F.col("tag").startswith("cycle")).select(F.concat(F.lit("tag:"), "tag").alias("term"))
    rows = (fixed([*COLORS, "Colorless"], 0).unionByName(fixed(TYPES, 1)).unionByName(keywords.select("term", F.lit(2).alias("category")))
            .unionByName(names.select("term", F.lit(3).alias("category"))).unionByName(fixed(VALUE_BUCKETS, 4))
            .unionByName(fixed(["Token Creation"], 5)).unionByName(tokens.select("term", F.lit(5).alias("category")))
            .unionByName(tags.select("term", F.lit(6).alias("category"))))
    return rows.groupBy("term").agg(F.min("category").alias("category"))


def item_features(items: DataFrame, keywords: DataFrame, tokens: DataFrame, item_tags: DataFrame) -> DataFrame:
    """(item, feature): all an item can be found by. items(item, text, type_line, colors, keywords, value)."""
    colors = F.when(F.size("colors") > 0, F.col("colors")).otherwise(strings(["Colorless"]))
    bucket = F.when(F.col("value") < 7, F.concat(F.lit("CMC_"), F.col("value").cast("int").cast("string"))).otherwise("CMC_7_plus")
    own = F.concat(colors, F.array_intersect(strings(TYPES), type_words(F.col("type_line"))), subtypes(F.col("type_line")), F.col("keywords"), F.array(bucket))
    rows = items.select("item", F.explode(own).alias("feature"))
    found = find_keywords(items.select(F.col("item").alias("id"), "text"), keywords).select(F.col("id").alias("item"), F.col("keyword").alias("feature"))
    made = tokens.select("item").distinct().withColumn("feature", F.lit("Token Creation"))
    tagged = item_tags.select("item", F.concat(F.lit("tag:"), "tag").alias("feature"))
    return rows.unionByName(found).unionByName(tokens.select("item", "feature")).unionByName(made).unionByName(tagged).distinct()


def postings(features: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, item), kept to the term space."""
    return features.select(F.col("feature").alias("term"), "item").join(terms.select("term"), "term")


def term_counts(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("d"))
