"""Near-duplicate documents by a forest of sorted MinHash signatures, links confirmed on full shingle sets.

Documents of equal sets are one node. Each tree orders the signatures by its own sequence of positions; nodes that agree on its
first four values share a region. A region that is too dense is cut at the next depth, and again, so depth follows density;
in each final region, neighbours in sorted order, which share the longest prefixes, are candidates. What cutting a dense region
would part is held together by hubs: the members on the heaviest path down the tree, nearest to what most of its members
have in common, are candidates of every member. Both kinds grow with the number of rows, never with its square.

These leave out pairs of a dense region. So once they have joined what they can, all nodes of dense regions are joined again by
the rarest shingles of their full sets: two sets over the threshold share one of the few rarest of either, so no pair is lost.

Candidates whose compact sketches rule the threshold out go. The rest are confirmed in rounds, the likeliest of each node
first; pairs that a round has already joined into one component need no further look."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickerwork.llm.common import bound_batches, map_texts, small_batches, tidy
from wickerwork.session import cut_lineage

#: Words of a shingle and percent of similarity, unless a caller says otherwise.
WORDS = 5
PERCENT = 80

HASHES = 128
TREES = 16
#: Depths at which a region can end; the first is the least prefix that makes two nodes neighbours.
DEPTHS = (4, 8, 12, 16)
#: A region of more rows is cut at the next depth; at the last, it is dealt into parts of about this size.
DENSE = 32
#: Neighbours on either side, in sorted order, that a node of a dense region is compared with at first; in a sparse one, all.
NEIGHBOURS = 16
#: Hubs of a dense region, and the trees whose dense regions have hubs.
HUBS = 4
HUB_TREES = 6
#: Bits of the filter that passes over texts no pair needs: 8 MB, whatever the corpus.
FILTER_WORDS = 1 << 20
#: How far the estimate may lie below the threshold: five of its standard deviations at 0.80, 0.045 each, and more above.
SLACK = 0.23
#: Candidates of a node that the first and the second round confirm; the last round confirms all that are left.
ROUNDS = (2, 6)
#: Counters of how often shingles occur, as a power of two: they only order the shingles, so that sharing one is no fault.
COUNTER_BITS = 22
CACHE_WORDS = 100_000
_SEED = 977

_FIELDS = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("key", T.BinaryType()),
                        T.StructField("sig", T.ArrayType(T.ShortType())), T.StructField("bits", T.ArrayType(T.LongType()))])


class Shingler:
    """64-bit hashes of a text's distinct shingles, ascending. A-Z count as lower case; words end at ASCII white space."""

    def __init__(self, words: int) -> None:
        self.words = words
        self.known: dict[bytes, int] = {}
        self.factors = np.random.default_rng(_SEED).integers(1, 1 << 63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        known = self.known
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        hashed = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.words, len(words))
        total = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            total += hashed[i:len(words) - n + 1 + i] * self.factors[i]
        total ^= total >> np.uint64(31)
        total *= np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
        return np.unique(total)


def signature(shingles: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16 bits of each minimum, and two bits of each packed into four words."""
    least = np.full(HASHES, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 4096):
        np.minimum(least, np.multiply.outer(factors, shingles[at:at + 4096]).min(axis=1), out=least)
    mixed = (least ^ (least >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    sig = (mixed >> np.uint64(48)).astype(np.uint16)
    bits = np.packbits(np.concatenate([sig & 1, (sig >> 1) & 1]).astype(np.uint8)).view("<i8")
    return sig.view(np.int16), bits


def _factors() -> np.ndarray:
    return np.random.default_rng(_SEED + 1).integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id with the size of its set, a digest of the set, its signature and its bits; nulls for empty sets."""
    def make():
        shingler, factors = Shingler(words), _factors()

        def work(texts):
            rows = []
            for text in texts:
                shingles = shingler(text)
                if len(shingles):
                    sig, bits = signature(shingles, factors)
                    rows.append((len(shingles), hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), sig, bits))
                else:
                    rows.append((0, None, None, None))
            return list(zip(*rows))
        return work

    return map_texts(docs, "text", ["doc_id"], _FIELDS, make)


def _trees() -> list[list[int]]:
    """Positions by depth of each tree; the first four of different trees do not overlap."""
    rng = np.random.default_rng(_SEED + 2)
    order = rng.permutation(HASHES)
    first = DEPTHS[0]
    out = []
    for tree in range(TREES):
        head = order[first * tree:first * (tree + 1)]
        rest = rng.permutation(np.setdiff1d(order, head))
        out.append([int(x) for x in [*head, *rest[:DEPTHS[-1] - first]]])
    return out


def _forest(nodes: DataFrame) -> DataFrame:
    """A row for each node and tree, with a hash of the tree's prefix at every depth."""
    carried = nodes.select("node", "n", "bits", "sig")
    schema = T.StructType([*carried.schema.fields[:3], T.StructField("tree", T.IntegerType()),
                           *[T.StructField(f"p{k}", T.LongType()) for k in range(len(DEPTHS))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, factor = _trees(), np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            sig = batch.column(3).flatten().to_numpy().view(np.uint16).reshape(-1, HASHES).astype(np.uint64)
            for tree, places in enumerate(trees):
                prefix = np.full(len(sig), (tree + 1) * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF, np.uint64)
                hashes = []
                for depth, place in enumerate(places, 1):
                    prefix = (prefix ^ sig[:, place] ^ (prefix >> np.uint64(29))) * factor
                    if depth in DEPTHS:
                        hashes.append(pa.array((prefix ^ (prefix >> np.uint64(32))).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.full(len(sig), tree, np.int32)), *hashes], names=schema.names)

    return carried.mapInArrow(tidy(run), schema)


def _regions(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of the forest that share a region with another, staged, and those of them in dense regions with the sizes of their
    regions at every depth. ``root`` is the component a node is known to be in, at first its own."""
    forest = _forest(nodes)
    crowd = forest.groupBy("p0").agg(F.count(F.lit(1)).alias("c0")).filter("c0 > 1")
    rows = cut_lineage(forest.join(crowd, "p0").withColumn("root", F.col("node")), "forest")
    dense = rows.filter(F.col("c0") > DENSE)
    for k in range(1, len(DEPTHS)):
        counts = dense.groupBy(f"p{k}").agg(F.count(F.lit(1)).alias(f"c{k}"))
        dense = dense.join(counts, f"p{k}")
    return rows, cut_lineage(dense, "dense")


def _candidates(rows: DataFrame, dense: DataFrame, percent: int) -> DataFrame:
    """Pairs (node, other, estimate) of different components worth a look, each once for either order it was found in."""
    last = len(DEPTHS) - 1
    parts = F.ceil(F.col(f"c{last}") / DENSE)
    region = F.xxhash64(F.col(f"p{last}"), F.pmod(F.xxhash64("node"), parts))
    for k in range(last, 0, -1):
        region = F.when(F.col(f"c{k}") <= DENSE, F.col(f"p{k}")).otherwise(region)
    own = ["node", "root", "n", "bits"]
    other = [F.col(f"o.{c}").alias(f"o_{c}") for c in own]
    columns = [*own, *[f"p{k}" for k in range(1, len(DEPTHS))]]
    reach = lambda k: F.lit(k).alias("reach")
    placed = (rows.filter(F.col("c0") <= DENSE).select(F.col("p0").alias("region"), *columns, reach(DENSE - 1))
              .unionByName(dense.select(region.alias("region"), *columns, reach(NEIGHBOURS))))
    order = W.partitionBy("region").orderBy(*columns[len(own):], "node")
    ahead = F.slice(F.collect_list(F.struct(*own)).over(order.rowsBetween(1, DENSE - 1)), F.lit(1), F.col("reach"))
    found = placed.withColumn("ahead", ahead).select(*own, F.explode("ahead").alias("o")).select(*own, *other)
    for k in (0, 1):  # hubs of dense regions at the first two depths
        crowded = dense.filter((F.col("tree") < HUB_TREES) & (F.col(f"c{k}") > DENSE))
        weight = F.struct(*[f"c{j}" for j in range(last, k, -1)], -F.col("node"))
        hubs = (crowded.groupBy(f"p{k}", F.pmod(F.xxhash64("node", F.lit(k)), F.lit(HUBS)).alias("part"))
                .agg(F.max(F.struct(weight.alias("w"), *own)).alias("o")).select(f"p{k}", *other))
        found = found.unionByName(crowded.select(f"p{k}", *own).join(hubs, f"p{k}").select(*own, *[f"o_{c}" for c in own]))
    unlike = F.lit(0)
    for i in range(2 * HASHES // 64):
        unlike = unlike + F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("o_bits")[i]))
    estimate = 1 - unlike / HASHES  # two bits of a place that differs are one bit apart on average
    sized = 100 * F.least("n", "o_n") >= percent * F.greatest("n", "o_n")
    return (found.filter((F.col("root") != F.col("o_root")) & sized).select("node", F.col("o_node").alias("other"), estimate.alias("estimate"))
            .filter(F.col("estimate") >= percent / 100 - SLACK).distinct())


def _in_components(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _filter_of(nodes: DataFrame) -> np.ndarray:
    """A bit for the hash of every node, in FILTER_WORDS words: of fixed size, so it may be collected and sent. Where many nodes
    fill it, it lets more texts pass, never fewer."""
    bit = F.expr("shiftleft(1L, cast(pmod(shiftrightunsigned(xxhash64(node), 32), 64) as int))")
    words = nodes.groupBy(F.pmod(F.xxhash64("node"), F.lit(FILTER_WORDS)).cast("int").alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(FILTER_WORDS, np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out


def _full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node and its shingles' hashes, ascending, read anew from whole texts. ``wanted`` has node and key.

    Texts are not shuffled: a filter passes over most of those that no pair needs, and the join is on what is made of the rest."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(_filter_of(wanted))
    h = F.xxhash64("doc_id")
    hashed = docs.select(F.col("doc_id").alias("node"), F.pmod(h, F.lit(FILTER_WORDS)).cast("int").alias("at"),
                         F.pmod(F.shiftrightunsigned(h, 32), F.lit(64)).cast("long").alias("bit"), F.col("text").cast("binary").alias("text"))
    schema = T.StructType([hashed.schema["node"], T.StructField("key", T.BinaryType()), T.StructField("shingles", T.BinaryType())])

    # filter and sets are one step: two would take two Python processes a task, each of which lives on
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, shingler = sent.value, Shingler(words)
        for part in small_batches(batches):
            good = (bits[part.column(1).to_numpy()] >> part.column(2).to_numpy()) & 1
            part = part.filter(pa.array(good == 1))
            sets = [shingler(t.as_py()).tobytes() for t in part.column(3)]
            keys = [hashlib.blake2b(x, digest_size=16).digest() for x in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=schema.names)

    made = hashed.filter(F.col("node").isNotNull()).mapInArrow(tidy(run), schema)
    return made.join(wanted, ["node", "key"]).select("node", "shingles")  # of one id's texts, the node's own


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending sets."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (node, other) with 100 * intersection >= percent * union."""
    with_other = pairs.join(sets.select(F.col("node").alias("other"), F.col("shingles").alias("b")), "other")
    both = with_other.join(sets.select("node", F.col("shingles").alias("a")), "node").select("node", "other", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = common(a, b)
                good.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["node", "other"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(tidy(run), "node long, other long")


def _rarity(sets: DataFrame) -> np.ndarray:
    """How often the shingles of each counter occur, of fixed size whatever the corpus."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            tokens = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(0)] or [np.zeros(0, np.uint64)])
            counts += np.bincount((tokens >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["at", "n"])

    found = sets.select("shingles").mapInArrow(tidy(run), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << COUNTER_BITS, np.int64)
    out[found["at"].to_numpy()] = found["n"].to_numpy()
    return out


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """node, root, n and its rarest shingles (token) with their places, as many as a larger or equal set over the threshold can
    do without, and one. ``short`` marks those that a set needs against larger ones. ``sets`` has node, root and shingles."""
    sent = sets.sparkSession.sparkContext.broadcast(_rarity(sets))
    names = ["node", "root", "n", "token", "place", "short"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        for batch in batches:
            taken, sizes, tokens, places, short = [], [], [], [], []
            for x in batch.column(2):
                token = np.frombuffer(x.as_buffer(), np.uint64)
                n = len(token)
                rarest = token[np.lexsort((token, counts[(token >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]))]
                most, few = n - -(-percent * n // 100) + 1, n - -(-2 * percent * n // (100 + percent)) + 1
                place = np.arange(most, dtype=np.int32)
                taken.append(most)
                sizes.append(n)
                tokens.append(rarest[:most].view(np.int64))
                places.append(place)
                short.append(np.arange(most) < few)
            if taken:
                row = pa.array(np.repeat(np.arange(len(taken)), taken))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(np.repeat(np.array(sizes, np.int32), taken)),
                                                  *[pa.array(np.concatenate(c)) for c in (tokens, places, short)]], names=names)

    return sets.select("node", "root", "shingles").mapInArrow(tidy(run), "node long, root long, n int, token long, place int, short boolean")


def _rare_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Every pair (node, other) of different components (root, o_root) that can be over the threshold, with the number of rare
    shingles they were met by (estimate). ``sets`` has node, root and shingles.

    A shingle whose sets are all of one component makes no pair. Of others, the largest component's sets are met by the rest
    only, so that a large family that is joined already costs as many pairs as there are sets outside it."""
    rows = cut_lineage(_prefixes(sets, percent), "prefixes")
    most = (rows.groupBy("token", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("token")
            .agg(F.max(F.struct("k", "root"))["root"].alias("most"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").select("token", "most"))
    shared = cut_lineage(rows.join(most, "token"), "postings")
    a, b = shared.filter("root <> most").alias("a"), shared.alias("b")
    smaller = F.struct("a.n", "a.node") < F.struct("b.n", "b.node")
    after = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))  # what they can share from this shingle on
    sized = 100 * F.least("a.n", "b.n").cast("long") >= percent * F.greatest("a.n", "b.n").cast("long")
    enough = (100 + percent) * after.cast("long") >= percent * (F.col("a.n") + F.col("b.n")).cast("long")
    once = (F.col("b.root") == F.col("b.most")) | (F.col("a.node") < F.col("b.node"))
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.root") != F.col("b.root")) & once & sized & enough
                 & F.when(smaller, F.col("a.short")).otherwise(F.col("b.short")))
    flip = F.col("a.node") < F.col("b.node")
    ends = [F.when(flip, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}")).alias(name)
            for c, x, y, name in (("node", "a", "b", "node"), ("node", "b", "a", "other"), ("root", "a", "b", "root"), ("root", "b", "a", "o_root"))]
    return met.select(*ends).groupBy("node", "other", "root", "o_root").agg(F.count(F.lit(1)).alias("estimate"))


def _best_of_components(pairs: DataFrame) -> DataFrame:
    """The likeliest pair of every two components."""
    return (pairs.groupBy(F.least("root", "o_root").alias("a"), F.greatest("root", "o_root").alias("b"))
            .agg(F.max(F.struct("estimate", "node", "other")).alias("p")).select("p.node", "p.other"))


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node it is linked with, for every node of ``edges`` (node, other).

    Every node hooks onto its smallest neighbour, paths are shortened, and the graph shrinks to the roots, at least by half a
    round, until no edge is left."""
    ends = F.least("node", "other").alias("node"), F.greatest("node", "other").alias("other")
    edges = cut_lineage(edges.filter("node <> other").select(*ends).distinct(), "edges")
    found: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other")))
        hooks = cut_lineage(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")), "hooks")
        for _ in range(2):
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            hooks = hooks.join(up, "root").select("node", F.col("higher").alias("root"))
        hooks = cut_lineage(hooks, "roots")
        edges = cut_lineage(_lifted(edges, hooks), "edges")
        found = hooks if found is None else cut_lineage(_composed(found, hooks), "components")
    return found if found is not None else edges.select("node", F.col("other").alias("root"))


def _composed(found: DataFrame, hooks: DataFrame) -> DataFrame:
    higher = hooks.select(F.col("node").alias("root"), F.col("root").alias("higher"))
    lifted = found.join(higher, "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
    return lifted.unionByName(hooks.join(found.select("node"), "node", "left_anti").select("node", "root"))


def _lifted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct pairs of the roots of either end, where they differ."""
    a = roots.select("node", F.col("root").alias("a"))
    b = roots.select(F.col("node").alias("other"), F.col("root").alias("b"))
    joined = pairs.join(a, "node", "left").join(b, "other", "left")
    return (joined.select(F.coalesce("a", "node").alias("x"), F.coalesce("b", "other").alias("y")).filter("x <> y")
            .select(F.least("x", "y").alias("node"), F.greatest("x", "y").alias("other")).distinct())


def _likeliest(pairs: DataFrame, most: int) -> DataFrame:
    """The ``most`` pairs of each node with the highest estimates. A node has a bounded number of pairs."""
    order = W.partitionBy("node").orderBy(F.col("estimate").desc(), "other")
    return pairs.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= most).drop("_rank")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    a = roots.select("node", F.col("root").alias("_a"))
    b = roots.select(F.col("node").alias("other"), F.col("root").alias("_b"))
    joined = pairs.join(a, "node", "left").join(b, "other", "left")
    return joined.filter(F.coalesce("_a", "node") != F.coalesce("_b", "other")).drop("_a", "_b")


def _joined(pairs: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``roots`` after the links among ``pairs``."""
    links = cut_lineage(_confirmed(pairs.select("node", "other"), sets, percent), "links")
    return cut_lineage(_composed(roots, components(_lifted(links, roots))), "components")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id it is linked with, itself included), kept.

    Texts without words (null, empty) have no shingles and are linked with nothing; a text of fewer than ``words`` words is one
    shingle. Rows that share a doc_id all get the smallest component of any of them. A null id is linked with nothing, its
    component is null, and it is kept."""
    docs = docs.select("doc_id", "text")
    sketch = cut_lineage(sketches(docs, words), "sketches")
    filled = sketch.filter(F.col("doc_id").isNotNull() & F.col("key").isNotNull())
    classes = cut_lineage(filled.groupBy("key").agg(F.min("doc_id").alias("node")), "classes")
    nodes = (filled.join(classes, "key").filter(F.col("doc_id") == F.col("node"))
             .select("node", F.col("n_shingles").alias("n"), "bits", "sig", "key").dropDuplicates(["node", "key"]))
    rows, dense = _regions(nodes)
    pairs = cut_lineage(_candidates(rows, dense, percent), "candidates")
    crowded = cut_lineage(dense.select("node").distinct(), "crowded")
    touched = pairs.select("node").union(pairs.select("other")).union(crowded).distinct()
    sets = cut_lineage(_full_sets(docs, classes.join(touched, "node", "left_semi").select("node", "key"), words), "sets")
    roots = components(cut_lineage(_confirmed(_likeliest(pairs, ROUNDS[0]), sets, percent), "links"))
    # most nodes of a dense region are one component by now, and their pairs need not be made again
    pairs = cut_lineage(_candidates(_in_components(rows, roots), _in_components(dense, roots), percent), "candidates")
    roots = _joined(_likeliest(pairs, ROUNDS[1]), roots, sets, percent)
    roots = _joined(_apart(pairs, roots), roots, sets, percent)
    pairs = cut_lineage(_rare_pairs(sets.join(_in_components(crowded.withColumn("root", F.col("node")), roots), "node"), percent), "rare-pairs")
    roots = _joined(_best_of_components(pairs), roots, sets, percent)
    roots = _joined(_apart(pairs, roots), roots, sets, percent)
    members = filled.select("doc_id", "key").join(classes, "key").select("doc_id", "node")
    labels = (members.join(roots, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("root", "node")).alias("component_id")))
    component = F.coalesce("component_id", "doc_id")
    return sketch.select("doc_id", "n_shingles").join(labels, "doc_id", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents without those that have a linked one of smaller doc_id; columns and texts as they were."""
    gone = near_duplicates(docs, words, percent).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
