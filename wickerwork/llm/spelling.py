"""Spelling variants of words by an index of variable-length grams.

Words are counted over all texts in the JVM; the rest works on the vocabulary. A gram grows from two characters to three and four
only where the shorter one is frequent, so that no list of the index is long for want of a longer gram; how many frequent grams are
kept is bounded, whatever the vocabulary. Each word is decomposed into the longest grams that start at its places, without those
that lie inside an earlier one. For each word the most grams that one edit can touch are known from its own decomposition, hence how
many grams a word one edit away must share with it: its rarest grams, one more than an edit can touch, are merged over the lists of
the index at the places an edit can move them to, pairs of which either lacks too many of the other's grams go, and the edit distance
verifies what is left.

Nulls and odd rows: a null text has no words; a null doc_id is written as an empty string before the colon; rows that repeat count
as often as they are there. An empty table, or one without frequent words, gives no rows. Extra columns are not read."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wickerwork.operators.ranking import salted_join
from wickerwork.session import cut_lineage

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST, LONGEST = 2, 4
#: Words must be this long for the first and the last gram never to be touched by the same edit.
LEAST_LENGTH = 2 * LONGEST - 2
#: A gram of so many words at most is never lengthened, however small the vocabulary.
RARE = 16
#: Frequent grams of each length are this many at most: the threshold grows with the vocabulary.
MOST_FREQUENT = 20_000


def damaged(doc_id: Column, run: Column, one_in: int) -> Column:
    """The run, or in one of ``one_in`` pairs of document and run, as a hash has it, the run without one of its code points."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % one_in == 0, cut).otherwise(run)


def word_counts(docs: DataFrame, one_in: int = 199, least: int = 5, length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n) of all texts, with A-Z in lower case and the damage of ``damaged``, from ``least`` occurrences on."""
    raw = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    low = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    words = raw.select("doc_id", low.alias("run")).select(damaged(F.col("doc_id"), F.col("run"), one_in).alias("word"))
    return words.filter(F.length("word") >= length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def frequent_grams(words: DataFrame, most: int = MOST_FREQUENT, rare: int = RARE) -> set[str]:
    """The grams that are lengthened: those in more places of words than an even share of ``most`` would be, so that there are at
    most ``most`` of each length below the longest."""
    padded = words.select(F.concat(F.lit("^"), "word", F.lit("$")).alias("p"))
    places = padded.agg(F.coalesce(F.sum(F.length("p")), F.lit(0))).first()[0]

    def of_length(k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length("p") - (k - 1)), lambda i: F.substring("p", i, F.lit(k)))

    grams = [of_length(k) for k in range(SHORTEST, LONGEST)]
    counted = padded.select(F.explode(F.concat(*grams)).alias("gram")).groupBy("gram").count()
    return {r.gram for r in counted.filter(F.col("count") > max(rare, places // most)).collect()}


def decompose(word: str, frequent: set[str]) -> tuple[list[int], list[str]]:
    """Places and grams of a word between ``^`` and ``$``: the longest gram of the dictionary from each place, but for those that
    end no later than an earlier one."""
    padded, reach = f"^{word}$", 0
    places, grams = [], []
    for i in range(len(padded) - SHORTEST + 1):
        size = SHORTEST
        while size < LONGEST and i + size < len(padded) and padded[i:i + size] in frequent:
            size += 1
        if i + size > reach:
            reach = i + size
            places.append(i)
            grams.append(padded[i:reach])
    return places, grams


def most_touched(places: list[int], grams: list[str]) -> int:
    """How many of the grams one insertion, deletion or replacement can take away at most.

    An edit at p touches the grams that hold p, and those after it that end within LONGEST of it, as a gram that holds the edit
    may grow over them. Insertions touch no more than a replacement of the character before or after. A gram that an edit does
    not touch is found in the other word at the same place, or moved by the difference in length."""
    starts, ends = places, [i + len(g) for i, g in zip(places, grams)]
    most, low = 0, 0
    for p in range(1, ends[-1] - 1):
        while ends[low] <= p:  # ends grow, so what lies before p is never touched again
            low += 1
        k = low
        while k < len(starts) and (starts[k] <= p or ends[k] <= p + LONGEST):
            k += 1
        most = max(most, k - low)
    return most


def gram_bits(grams: list[str]) -> int:
    """A bit of 64 for each gram, by its hash, as a signed number."""
    bits = 0
    for g in grams:
        bits |= 1 << (zlib.crc32(g.encode()) & 63)
    return bits - (bits >> 63 << 64)


def gram_index(words: DataFrame, frequent: set[str]) -> DataFrame:
    """(word, n, bits, touched, gram, place): a row for each of a word's rarest grams, one more than an edit can touch. ``bits``
    has one for each of its grams, so that the bits another word lacks are no more than the grams it lacks."""
    schema = "word string, n long, places array<int>, grams array<string>, touched int, bits long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [decompose(w, frequent) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([m[0] for m in made], pa.list_(pa.int32())),
                 pa.array([m[1] for m in made], pa.list_(pa.string())), pa.array([most_touched(*m) for m in made], pa.int32()),
                 pa.array([gram_bits(m[1]) for m in made], pa.int64())],
                names=["word", "n", "places", "grams", "touched", "bits"])

    parts = cut_lineage(words.select("word", "n").mapInArrow(run, schema), "spelling-grams")
    rows = parts.select("word", "touched", F.explode(F.arrays_zip("places", "grams")).alias("g")).select(
        "word", "touched", F.col("g.places").alias("place"), F.col("g.grams").alias("gram"))
    lists = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("listed"))
    by_rarity = W.partitionBy("word").orderBy("listed", "gram", "place")
    # a gram may be in many of the words, so its rows are spread
    rarest = (salted_join(rows, lists, ["gram"]).withColumn("_k", F.row_number().over(by_rarity)).filter(F.col("_k") <= F.col("touched") + 1)
              .select("word", "gram", "place"))
    return parts.select("word", "n", "bits", "touched").join(rarest, "word")


def near_words(words: DataFrame, frequent: set[str]) -> DataFrame:
    """(word, n, near, near_n), both ways: words of ``words`` that differ by one inserted, deleted or replaced code point."""
    index = cut_lineage(gram_index(words, frequent).withColumn("size", F.length("word")), "spelling-index")
    # a gram stays where it is, or is one further in the longer word if it lies behind the edit
    moves = F.array(*[F.struct(F.lit(d).alias("place"), F.lit(s).alias("size")) for d, s in ((0, 0), (0, 1), (1, 1))])
    probe = index.withColumn("m", F.explode(moves)).select(
        "gram", (F.col("place") + F.col("m.place")).alias("place"), (F.col("size") + F.col("m.size")).alias("size"), F.col("m.size").alias("longer"),
        F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("bits").alias("a_bits"), F.col("touched").alias("a_touched"))
    met = probe.join(index, ["gram", "place", "size"]).filter((F.col("longer") == 1) | (F.col("a") < F.col("word")))
    # neither word may lack more of the other's grams than an edit of that one can touch
    lacks = lambda one, other: F.bit_count(F.col(one).bitwiseAND(F.bitwise_not(F.col(other))))
    enough = (lacks("a_bits", "bits") <= F.col("a_touched")) & (lacks("bits", "a_bits") <= F.col("touched"))
    links = (met.filter(enough).filter(F.levenshtein("a", "word", 1) == 1)
             .select("a", "a_n", F.col("word").alias("b"), F.col("n").alias("b_n")).distinct())
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
                             F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))))
    return links.select(both.alias("l")).select("l.*")


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last one, the steps doubled in each round. A form is five times as
    frequent as its word, so there are few rounds."""
    at = cut_lineage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = cut_lineage(at.join(ahead, "root", "left"), "spelling-roots")
        if moved.filter(F.col("further").isNotNull()).isEmpty():
            return at
        at = moved.select("word", F.coalesce("further", "root").alias("root"))


def spelling_variants(docs: DataFrame, least: int = 5, length: int = LEAST_LENGTH, times: int = 5, one_in: int = 199) -> DataFrame:
    """One row per frequent word: word, form, root, n, n_near, form_n.

    ``form`` is its near word of largest n (ties: the smallest in code point order) if that is at least ``times`` the word's own,
    else null; ``root`` the last of its forms, itself if it has none."""
    if length < LEAST_LENGTH:
        raise ValueError(f"words of under {LEAST_LENGTH} code points may share no gram with a near word")
    if times < 2:
        raise ValueError("forms must be more frequent than their words")
    words = cut_lineage(word_counts(docs, one_in, least, length), "spelling-words")
    near = near_words(words, frequent_grams(words))
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near"))).alias("b"))
    known = words.join(best, "word", "left")
    good = -F.col("b.n") >= times * F.col("n")
    rows = cut_lineage(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("b.near")).alias("form"),
                                    F.when(good, -F.col("b.n")).alias("form_n")), "spelling-forms")
    roots = last_forms(rows.filter(F.col("form").isNotNull()))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
