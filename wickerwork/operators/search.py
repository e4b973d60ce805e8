"""Text queries to ranked items, as a batch over a table of queries.

Tables: queries(query, text), tag_names(term, name), weights(term, d, weight), postings(term, item)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from wickerwork.functions.numeric import half_up, idf
from wickerwork.functions.text import (ALSO, AMBIGUOUS, COLOR_WORDS, FILLER, JARGON, TYPE_WORDS, VALUE_WORDS, forms, raw_words, stem,
                                       words)
from wickerwork.operators.ranking import listed, number_rows, top_n
from wickerwork.operators.textjoin import contains_join
from wickerwork.session import cut_lineage

STRONG_MATCH = 0.75
#: Rows of query groups that are surely a small table.
FEW = 100_000
#: Items times queries, and hits, that a task sums at a time.
CELLS = 1_000_000
#: More than what rounding to six places can move a score and its query's best against each other.
ROUNDED = 2e-6


def _tasks(df: DataFrame) -> int:
    """As many tasks as shuffles have, given where rows are small but costly, which adaptive plans would put into one task."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def different_texts(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each different text once, under the smallest query that says it: texts(query, text); and who else says it: askers(query,
    listed), in arrays of at most LONGEST_LIST. What is found for a text is found for all that say it."""
    said = queries.groupBy("query").agg(F.array_sort(F.collect_list("text")).alias("_texts"))
    lists = listed(said, ["_texts"], "query")
    classes = lists.groupBy("_texts").agg(F.min(F.array_min("listed")).alias("query"))
    classes = cut_lineage(classes.repartition(_tasks(queries), "query"), "texts")
    return classes.select("query", F.explode("_texts").alias("text")), cut_lineage(lists.join(classes, "_texts").select("query", "listed"), "askers")


def for_askers(found: DataFrame, askers: DataFrame) -> DataFrame:
    """What was found for each different text, for every query that says it; named last and not shuffled."""
    others = [c for c in found.columns if c != "query"]
    return found.join(askers, "query").select(F.explode("listed").alias("query"), *others)


def term_weights(counts: DataFrame, n: Column) -> DataFrame:
    return counts.withColumn("weight", idf(n, F.col("d")))


def tag_variants(tag_names: DataFrame) -> DataFrame:
    """(term, name, word, size): the distinct words of every name a tag goes by."""
    rows = tag_names.filter(~F.col("name").isin(AMBIGUOUS)).select("term", "name", F.array_distinct(words(F.col("name"))).alias("_w")).distinct()
    return rows.filter(F.size("_w") > 0).select("term", "name", F.explode("_w").alias("word"), F.size("_w").alias("size"))


def implied_words(variants: DataFrame, least: int = 3) -> DataFrame:
    """(word, implied): a word in at least three tag names, all of which say a type, implies that type."""
    uses = variants.filter(~F.col("word").isin(TYPE_WORDS)).groupBy("word").agg(F.count(F.lit(1)).alias("uses")).filter(F.col("uses") >= least)
    types = variants.filter(F.col("word").isin(TYPE_WORDS)).select("term", "name", F.col("word").alias("implied"))
    both = variants.join(types, ["term", "name"]).groupBy("word", "implied").agg(F.count(F.lit(1)).alias("k"))
    return both.join(uses, "word").filter("k = uses").select("word", "implied")


def verb_bases(seen: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, base): "drawing" to draw, "untapped" to untap, only where the result is a word tag names use."""
    w = F.col("word")
    n = F.length(w)
    tries = [F.struct(F.lit(0).alias("p"), w.alias("base"))]
    place = 1
    for suffix in ("ing", "ed"):
        cut = F.substring(w, 1, n - len(suffix))
        fits = w.endswith(suffix) & (n >= len(suffix) + 3)
        for b in (cut, F.concat(cut, F.lit("e")), F.substring(w, 1, n - len(suffix) - 1)):
            tries.append(F.struct(F.lit(place).alias("p"), F.when(fits, stem(b)).alias("base")))
            place += 1
    options = seen.select("word").distinct().select("word", F.explode(F.array(*tries)).alias("_t")).select("word", "_t.p", "_t.base").filter("base is not null")
    found = options.join(vocabulary.select(F.col("word").alias("base")), "base")
    return found.groupBy("word").agg(F.min_by("base", "p").alias("base"))


def spoken_words(queries: DataFrame, variants: DataFrame) -> DataFrame:
    """(query, pos, word, stemmed, base): the words of each query in order. Stems and verb bases are worked out once per
    distinct word, far fewer than the words of all queries, and joined back; the table is written out as everything
    downstream reads it."""
    said = cut_lineage(queries.select("query", F.posexplode(raw_words(F.col("text"))).alias("pos", "word")), "said")
    lexicon = said.select("word").distinct().withColumn("stemmed", stem(F.col("word")))
    bases = verb_bases(lexicon.select(F.col("stemmed").alias("word")), variants.select("word").distinct())
    lexicon = lexicon.join(bases.withColumnRenamed("word", "stemmed"), "stemmed", "left").withColumn("base", F.coalesce("base", "stemmed"))
    lexicon = cut_lineage(lexicon, "lexicon")  # its size is known when the join is planned
    return cut_lineage(said.join(lexicon, "word").select("query", "pos", "word", "stemmed", "base"))


def query_words(spoken: DataFrame, variants: DataFrame) -> DataFrame:
    """(query, word, root, half): a query's words as tag names write them, the types they imply, and the words they also
    stand for, at half credit."""
    based = spoken.filter(~F.col("word").isin(FILLER)).select("query", F.col("base").alias("word"))
    full = based.unionByName(based.join(implied_words(variants), "word").select("query", F.col("implied").alias("word"))).distinct()
    extra = [(w, a) for w, others in ALSO.items() for a in others]
    also = spoken.sparkSession.createDataFrame(extra, "root string, word string")
    held = full.select("query", "word", F.lit(True).alias("_held"))
    added = (full.filter(F.col("word").isin(list(ALSO))).withColumnRenamed("word", "root").join(F.broadcast(also), "root")
             .join(held, ["query", "word"], "left").filter("_held is null")
             .groupBy("query", "word").agg(F.max("root").alias("root")).withColumn("half", F.lit(True)))
    return full.select("query", "word", F.col("word").alias("root"), F.lit(False).alias("half")).unionByName(added.select("query", "word", "root", "half"))


def matched_tags(qwords: DataFrame, variants: DataFrame) -> DataFrame:
    """(query, term, size, words, roots): per query and tag its fullest name whose words are all in the query.

    A query's words ride in one row, and a name is looked up by its rarest word alone, so only names that match are shuffled."""
    uses = variants.groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
    names = variants.join(uses, "word").groupBy("term", "name", "size").agg(
        F.min_by("word", F.struct("uses", "word")).alias("_key"), F.array_sort(F.collect_set("word")).alias("words"))
    names = cut_lineage(names.filter(F.size("words") == F.col("size")), "names")
    asked = qwords.repartition(_tasks(qwords), "query").groupBy("query").agg(F.collect_list(F.struct("word", "root", "half")).alias("_q"))
    asked = asked.withColumn("_key", F.explode(F.array_distinct(F.col("_q.word"))))
    met = asked.join(names, "_key").filter(F.size(F.array_except("words", F.col("_q.word"))) == 0)
    met = met.withColumn("_q", F.filter("_q", lambda x: F.array_contains("words", x["word"])))
    credit = F.aggregate("_q", F.lit(0.0), lambda c, x: c + F.when(x["half"], 0.5).otherwise(1.0))
    full = met.filter(F.exists("_q", lambda x: ~x["half"])).select(
        "query", "term", "name", credit.alias("credit"), "words", F.array_sort(F.array_distinct(F.col("_q.root"))).alias("roots"))
    return top_n(full, ["query", "term"], [F.desc("credit"), F.asc("name")], 1).select("query", "term", F.col("credit").alias("size"), "words", "roots")


def tag_groups(matched: DataFrame, weights: DataFrame) -> DataFrame:
    """(query, grp, term, credit): matched tags that share root words form one group; the tag covering most of the query,
    by size times weight, gets full credit. Sharing is settled by a fold over one query's own matches."""
    weighed = matched.join(weights.select("term", "weight"), "term", "left").withColumn("s", F.col("size") * F.col("weight"))
    listed = weighed.repartition(_tasks(matched), "query").groupBy("query").agg(F.array_sort(F.collect_list(F.struct("term", "roots", "s"))).alias("_m"))
    none = F.array().cast("array<struct<tags:array<struct<term:string,s:double>>,roots:array<string>>>")

    def merge(groups: Column, m: Column) -> Column:
        touching = F.filter(groups, lambda g: F.arrays_overlap(g["roots"], m["roots"]))
        apart = F.filter(groups, lambda g: ~F.arrays_overlap(g["roots"], m["roots"]))
        joined = F.struct(F.concat(F.flatten(F.transform(touching, lambda g: g["tags"])), F.array(F.struct(m["term"].alias("term"), m["s"].alias("s")))).alias("tags"),
                          F.array_distinct(F.concat(F.flatten(F.transform(touching, lambda g: g["roots"])), m["roots"])).alias("roots"))
        return F.concat(apart, F.array(joined))

    grouped = listed.select("query", F.explode(F.aggregate("_m", none, merge)).alias("_g"))
    rows = grouped.select("query", F.concat(F.lit("tags:"), F.array_min("_g.tags.term")).alias("grp"), F.array_max("_g.tags.s").alias("_most"), F.explode("_g.tags").alias("_t"))
    credit = F.when(F.col("_most") > 0, F.col("_t.s") / F.col("_most")).otherwise(F.lit(1.0))
    return rows.filter("_t.s is not null").select("query", "grp", F.col("_t.term").alias("term"), credit.alias("credit"))


def phrase_hits(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(query, term): terms a query's words hold as whole words, plurals allowed. texts(query, words array), terms(term,
    phrase). Runs of words are joined to the spellings of the phrases: no query is compared with every term."""
    known = terms.select("term", F.explode(forms(F.col("phrase"))).alias("gram")).withColumn("len", F.size(F.split("gram", " ")))
    known = cut_lineage(known, "spellings")
    lengths = known.agg(F.array_sort(F.collect_set("len"))).scalar()
    cut = texts.filter(F.size("words") > 0).select("query", "words").withColumn("_l", lengths)
    runs = (cut.select("query", "words", F.explode("_l").alias("len")).filter(F.size("words") >= F.col("len"))
            .select("query", "words", "len", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1)).alias("s"))
            .select("query", F.array_join(F.slice("words", F.col("s"), F.col("len")), " ").alias("gram")).distinct())
    return runs.join(known, "gram").select("query", "term").distinct()


def named_terms(spoken: DataFrame, matched: DataFrame, terms: DataFrame) -> DataFrame:
    """(query, grp, term, credit): what the words no tag took up name: tokens, colours, mana values, types, keywords."""
    spark = spoken.sparkSession
    consumed = matched.filter(F.size("words") > 1).select("query", F.explode("words").alias("stemmed")).distinct()
    said = F.when(F.col("base") == F.col("stemmed"), F.array(F.struct("word", "stemmed"))).otherwise(
        F.array(F.struct("word", "stemmed"), F.struct(F.col("base").alias("word"), F.col("base").alias("stemmed"))))
    kept = (spoken.select("query", "pos", F.posexplode(said).alias("sub", "_s")).select("query", "pos", "sub", "_s.word", "_s.stemmed")
            .join(consumed, ["query", "stemmed"], "left_anti"))
    texts = kept.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("pos", "sub", "word", "stemmed"))).alias("_w"))
    texts = texts.select("query", F.transform("_w", lambda x: x["word"]).alias("raw"), F.transform("_w", lambda x: x["stemmed"]).alias("stems"))
    verb, noun = F.array_position("stems", "create"), F.array_position("stems", "token")
    before = lambda at: F.slice("raw", F.lit(1), (at - 1).cast("int"))
    onward = lambda at: F.slice("raw", at.cast("int"), F.size("raw"))
    none = F.array().cast("array<string>")
    texts = texts.select("query", "raw", (verb > 0).alias("has_verb"), F.when(verb > 0, onward(verb + 1)).when(noun > 0, before(noun)).otherwise(none).alias("token"),
                         F.when(verb > 0, before(verb)).when(noun > 0, onward(noun)).otherwise(F.col("raw")).alias("rest"))
    texts = cut_lineage(texts, "left-words")
    colors = spark.createDataFrame(list(COLOR_WORDS.items()), "phrase string, term string")
    token_terms = (colors.select(F.concat(F.lit("token:"), "term").alias("term"), "phrase")
                   .unionByName(terms.filter(F.col("term").startswith("token:") & (F.length("term") > 7)).select("term", F.expr("substring(term, 7)").alias("phrase"))))
    made = cut_lineage(phrase_hits(texts.select("query", F.col("token").alias("words")), token_terms), "made")
    any_made = made.select("query").distinct().withColumn("_t", F.lit(True))
    texts = texts.join(any_made, "query", "left").withColumn("clause", F.col("has_verb") | F.coalesce("_t", F.lit(False)))
    texts = cut_lineage(texts.select("query", "clause", F.when(F.col("clause"), F.col("rest")).otherwise(F.col("raw")).alias("words")), "clauses")
    plain = terms.filter((F.length("term") > 1) & ~F.col("term").rlike("^(CMC_|tag:|token:)")).select("term", F.col("term").alias("phrase"))
    values = spark.createDataFrame([(b, w) for ws, bs in VALUE_WORDS for w in ws for b in bs], "term string, phrase string")
    # words and mana values are looked up at once
    wanted = colors.select("term", "phrase").unionByName(plain).withColumn("_value", F.lit(False)).unionByName(values.withColumn("_value", F.lit(True)))
    hits = cut_lineage(phrase_hits(texts.select("query", "words"), wanted.select(F.struct("term", "_value").alias("term"), "phrase")).select("query", "term.*"), "phrase-hits")
    single = (hits.filter("not _value").select("query", "term").unionByName(made)
              .unionByName(texts.filter("clause").select("query", F.lit("Token Creation").alias("term"))).distinct())
    buckets = hits.filter("_value").withColumn("grp", F.lit("value"))
    rows = single.withColumn("grp", F.concat(F.lit("term:"), "term")).join(terms.select("term"), "term", "left_semi")
    return rows.select("query", "grp", "term", F.lit(1.0).alias("credit")).unionByName(buckets.select("query", "grp", "term", F.lit(1.0).alias("credit")))


def parse(queries: DataFrame, tag_names: DataFrame, weights: DataFrame) -> DataFrame:
    """(query, grp, term, credit): the feature groups of each query. Each step is staged, so that no plan holds the steps before it:
    what a driver needs for a plan grows with the plan, and again with each of its shuffles and tasks."""
    variants = cut_lineage(tag_variants(tag_names), "variants")
    weights = cut_lineage(weights.select("term", "weight"), "weights")
    spoken = spoken_words(queries, variants)
    qwords = cut_lineage(query_words(spoken, variants), "query-words")
    matched = cut_lineage(matched_tags(qwords, variants), "matched")
    return tag_groups(matched, weights).unionByName(named_terms(spoken, matched, weights.select("term")))


def score(groups: DataFrame, postings: DataFrame, weights: DataFrame, near: float = 0.0) -> DataFrame:
    """(query, item, score): the weighted share of its groups each item covers, to six places, ties upward. A group weighs as
    its rarest term. Scores below ``near`` of their query's best may be left out, as a task does with those so far below the best
    that it has met; no score at or above that is. A few queries are told to all tasks, and the postings of what they ask for dealt by item; many are dealt by query,
    and hits are summed where they are made, if the other side fits a broadcast."""
    groups = cut_lineage(groups)
    weighed = groups.groupBy("query", "grp", "term").agg(F.max("credit").alias("credit")).join(weights.select("term", "weight"), "term", "left").fillna(0.0, ["weight"])
    few = groups.limit(FEW + 1).count() <= FEW
    if not few:
        weighed = weighed.repartition(_tasks(groups), "query")
    whole, mine = W.partitionBy("query", "grp"), W.partitionBy("query")
    first = F.row_number().over(whole.orderBy("term")) == 1
    sized = weighed.withColumns({"size": F.max("weight").over(whole), "_first": first})
    sized = sized.withColumn("total", F.sum(F.when(F.col("_first"), F.col("size"))).over(mine)).select("query", "grp", "term", "credit", "size", "total")
    if few:
        shares = _few_shares(cut_lineage(sized, "sized-groups"), postings, near)
    else:
        best = sized.join(postings.select("item", "term").distinct(), "term").groupBy("query", "item", "grp", "size", "total").agg(F.max("credit").alias("credit"))
        sums = best.groupBy("query", "item", "total").agg(F.sum(F.col("credit") * F.col("size")).alias("s"))
        shares = sums.filter("s > 0").select("query", "item", (F.col("s") / F.col("total")).alias("share"))
    return shares.select("query", "item", (half_up(F.round("share", 12) * 1_000_000) / 1_000_000).alias("score"))


def _few_shares(sized: DataFrame, postings: DataFrame, near: float) -> DataFrame:
    """(query, item, share) of at most FEW rows of query groups. An item's terms that are asked for come in one row; what they hit
    is summed over the queries for CELLS items and queries at a time, so hits are never rows."""
    spark = sized.sparkSession
    rows = sized.collect()
    ids: dict = {}
    at = lambda kind, key: ids.setdefault(kind, {}).setdefault(key, len(ids[kind]))
    ids.update(term={}, grp={}, query={})
    hit = np.array([(at("term", r["term"]), at("grp", (r["query"], r["grp"])), at("query", r["query"])) for r in rows], dtype=np.int64).reshape(-1, 3)
    order = np.argsort(hit[:, 0], kind="stable")
    credit = np.array([r["credit"] for r in rows], dtype=float)[order]
    grp = hit[order, 1]
    uses = np.bincount(hit[:, 0], minlength=len(ids["term"]))
    starts = np.cumsum(uses) - uses
    size, asker, total = np.zeros(len(ids["grp"])), np.zeros(len(ids["grp"]), dtype=np.int64), np.zeros(len(ids["query"]))
    size[hit[:, 1]], asker[hit[:, 1]], total[hit[:, 2]] = [r["size"] for r in rows], hit[:, 2], [r["total"] for r in rows]
    several = len(ids["grp"]) < len(rows)  # of a group's terms that an item has, the best counts
    queries, nq, ng = list(ids["query"]), len(ids["query"]), len(ids["grp"])
    kind = to_arrow_type(sized.schema["query"].dataType)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, best = pa.array(queries, kind), np.zeros(nq)
        for batch in batches:
            lengths, terms = batch.column("_terms").value_lengths().to_numpy(), batch.column("_terms").flatten().to_numpy()
            ends = np.cumsum(lengths)
            hits = np.cumsum(np.concatenate([[0], uses[terms]]))
            a = 0
            while a < len(lengths):
                begin = ends[a] - lengths[a]
                b = max(a + 1, min(a + max(1, CELLS // nq), int(np.searchsorted(hits[ends], hits[begin] + CELLS, "right"))))
                t, owner = terms[begin:ends[b - 1]], np.repeat(np.arange(b - a), lengths[a:b])
                n = uses[t]
                place = np.repeat(starts[t] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                o, g, c = np.repeat(owner, n), grp[place], credit[place]
                if several:
                    key = o * ng + g
                    by = np.lexsort((c, key))
                    by = by[np.append(key[by][1:] != key[by][:-1], True)] if len(by) else by
                    o, g, c = o[by], g[by], c[by]
                sums = np.bincount(o * nq + asker[g], weights=c * size[g], minlength=(b - a) * nq)
                best = np.maximum(best, sums.reshape(-1, nq).max(axis=0) / total)
                found = np.flatnonzero((sums > 0) & (sums.reshape(-1, nq) / total >= near * best - ROUNDED).ravel())
                q = found % nq
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), batch.column("item").take(pa.array(a + found // nq)), pa.array(sums[found] / total[q])],
                                                 names=["query", "item", "share"])
                a = b

    kept = StructType([sized.schema["query"], postings.schema["item"], StructField("share", DoubleType())])
    if not rows:
        return spark.createDataFrame([], kept)
    terms = spark.createDataFrame(list(ids["term"].items()), StructType([sized.schema["term"], StructField("_t", LongType())]))
    asked = postings.select("item", "term").join(F.broadcast(terms), "term")  # at most FEW rows
    held = asked.repartition(_tasks(sized), "item").groupBy("item").agg(F.collect_set("_t").alias("_terms"))
    return held.select("item", "_terms").mapInArrow(shares, kept)


SORTS = ("match", "popular", "newest", "oldest", "price-asc", "price-desc", "value-asc", "value-desc", "name")


def sort_results(results: DataFrame, sort: str, items: DataFrame, first: int | None = None) -> DataFrame:
    """Ranked results, the ``first`` of each query or all: by match, or by another key among those within three quarters of the
    best. Unknown keys come last, ties go by number. items(item, number, cents, value, released, name).

    The first are cut inside every map task; all are numbered by ranges, so no query's results are sorted in one task."""
    if sort not in SORTS:
        raise ValueError(f"no order {sort!r}")
    if sort != "match":
        results = cut_lineage(results, "results")  # read for the best of each query and for those near it
        best = results.groupBy("query").agg(F.max("score").alias("_b"))
        best = cut_lineage(best, "best")
        results = results.join(best, "query").filter(F.col("_b").isNull() | (F.col("score") >= STRONG_MATCH * F.col("_b"))).drop("_b")
    rows = results.join(items, "item")
    key = {"match": F.col("score").desc_nulls_last(), "popular": F.asc("number"), "newest": F.col("released").desc_nulls_last(),
           "oldest": F.col("released").asc_nulls_last(), "price-asc": F.col("cents").asc_nulls_last(), "price-desc": F.col("cents").desc_nulls_last(),
           "value-asc": F.col("value").asc_nulls_last(), "value-desc": F.col("value").desc_nulls_last(), "name": F.col("name").asc_nulls_last()}[sort]
    order = [key, F.asc("number")]
    if first is not None:
        return top_n(rows, "query", order, first, "place")
    return number_rows(rows, order, "place", ["query"]).withColumn("place", F.col("place") + 1)


def name_search(names: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, item): items a query's text is in the name or another name of. names(item, name), queries(query, text)."""
    asked = queries.select("query", F.lower(F.trim("text")).alias("q"))
    return contains_join(names.withColumn("_low", F.lower("name")), asked, "_low").select("query", "item").distinct()


def random_searches(terms: DataFrame, tag_names: DataFrame, least: int = 15) -> DataFrame:
    """(term, text): how a person would ask for each term that makes a good search. terms(term, category, d)."""
    good = terms.filter(F.col("d") >= least)
    spoken = F.lower(F.replace("name", F.lit("-"), F.lit(" ")))
    tags = (good.join(tag_names, "term").withColumn("text", spoken).filter(
        F.col("text").rlike("^[a-z' ]+$") & ~F.col("text").rlike(JARGON) & ~F.col("text").isin(AMBIGUOUS) & (F.size(F.split("text", " ")) <= 4)))
    token = good.filter(F.col("term").startswith("token:") & (F.length("term") > 7)).withColumn(
        "text", F.concat(F.lit("makes "), F.lower(F.expr("substring(term, 7)")), F.lit(" tokens")))
    plain = good.filter(F.col("category").isin(2, 3) & F.col("term").rlike("^[A-Za-z' ]+$")).withColumn("text", F.lower("term"))
    return tags.select("term", "text").unionByName(token.select("term", "text")).unionByName(plain.select("term", "text")).distinct()


def pick_random(searches: DataFrame, seed: int, n: int = 1) -> DataFrame:
    """n searches, each term equally likely however many ways it can be said, by hash."""
    drawn = lambda *c: F.md5(F.concat_ws(":", F.lit(str(seed)), *c)).asc()
    one = top_n(searches, "term", [drawn("term", "text")], 1).drop("rank")
    return one.orderBy(drawn("term")).limit(n)


def main_terms(groups: DataFrame) -> DataFrame:
    return groups.filter("credit = 1").select("query", "term").distinct()


def exact_names(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query, item): queries that are, word for word, a name; these are looked up and not parsed. Texts are made distinct on either
    side and the items of a name listed, so that hits, which can be many times the tables, are never shuffled."""
    low = lambda c: F.lower(F.trim(c))
    asked = queries.groupBy("query").agg(F.array_distinct(F.collect_list(low(F.col("text")))).alias("_texts"))
    asked = asked.filter(F.size("_texts") > 0).select("query", "_texts", F.explode("_texts").alias("_q"))
    named = names.groupBy("item").agg(F.array_distinct(F.collect_list(F.lower("name"))).alias("_names"))
    single = listed(named.filter(F.size("_names") == 1).select(F.col("_names")[0].alias("_q"), "item"), ["_q"], "item")
    # of an item with several names, and a query with several texts, only the first shared text gives the pair
    several = cut_lineage(named.filter(F.size("_names") > 1).select("item", "_names", F.explode("_names").alias("_q")), "several-names")
    hits = asked.join(single, "_q").select("query", F.explode("listed").alias("item"))
    if several.isEmpty():
        return hits
    first = (F.size("_texts") == 1) | (F.array_min(F.array_intersect("_texts", "_names")) == F.col("_q"))
    return hits.unionByName(asked.join(several, "_q").filter(first).select("query", "item"))


def answer(queries: DataFrame, names: DataFrame, tag_names: DataFrame, weights: DataFrame, postings: DataFrame) -> DataFrame:
    """(query, item, score, way): a whole search. A query that is a name, word for word, finds that item; any other is parsed and
    scored; one whose words name no feature finds the items it is part of the name of. score is null but for parsed queries.
    names(item, name), postings(term, item), queries(query, text)."""
    texts, askers = different_texts(queries)
    named = cut_lineage(exact_names(texts, names))
    rest = texts.join(named.select("query").distinct(), "query", "left_anti")
    groups = cut_lineage(parse(rest, tag_names, weights))
    scored = score(groups, postings, weights)
    left = rest.join(groups.select("query").distinct(), "query", "left_anti")
    none = F.lit(None).cast("double").alias("score")
    found = (named.select("query", "item", none, F.lit("name").alias("way"))
             .unionByName(scored.select("query", "item", "score", F.lit("features").alias("way")))
             .unionByName(name_search(names, left).select("query", "item", none, F.lit("part of a name").alias("way"))))
    return for_askers(found, askers)
