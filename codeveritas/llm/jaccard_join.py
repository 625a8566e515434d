"""Exact n-gram Jaccard join by a grouped prefix join, and its connected components.

A document is its set of distinct WIDTH-word shingles, as 64-bit identifiers.  Sets with a Jaccard
similarity of at least PERCENT share a shingle within their prefixes, the first
n - ceil(n * PERCENT / 100) + 1 shingles in one order of all shingles.  That order puts shingles
that are heavy anywhere last, so prefixes hold rare ones; any order gives the same result.

* Documents with equal sets form a class, which needs no comparison; classes with an identical
  prefix and size form a group.  Only groups enter the join on prefix shingles.
* Group pairs pass a size filter and a bound on the overlap that their places in the prefixes
  leave; pairs that remain are expanded to classes and pass a second bound, from bitmaps of the
  parities of the sets: |x & y| <= (|x| + |y| - bits that differ) / 2.  All bounds are safe.
* What is left is verified on the whole texts.

Only components are asked for, so a pair whose members are known to be connected needs no
verification.  In a first round a group meets the PARTNERS groups it shares most lists with, among the
first and the preceding group of each of its lists, in order of size, and a class the first class of
its group.  In a second round a class outside of the largest component of a list meets the classes
of that component beside it.  The last round takes all pairs of a list that still lie in different
components; as these have a member outside of the list's largest component, a list of thousands of near
copies costs what its few outsiders cost.

Defined results: text without words, or null, has an empty set and is alone; with fewer than WIDTH
words the whole sequence is the one shingle; rows that share an id, null ids and repeated rows
follow `base.identified` (a null id counts as larger than any other); an empty table gives an empty
result; other columns are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_and_read
from .base import LOWER, NULL_ID, blocks, identified, original_id
from .components import components
from .qgrams import mix, pair
from .text_stats import Block

WIDTH = 5
PERCENT = 80

#: Words of a bitmap (64 bits each).
BITMAP = 16

#: Bits of the bitmap that keeps texts without a pair from being exchanged (a fixed 1 MB).
SIEVE_BITS = 23

#: Partners that a group, or class, meets in the first rounds; pairs beyond them are left to the last round.
PARTNERS = 6

#: A shingle in so many different sets of one Arrow batch counts as heavy; the heaviest are kept.
HEAVY_IN_BATCH = 2
MOST_HEAVY = 1 << 20


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts and the text of each, in order of (text, shingle)."""
    block = Block(texts, LOWER)
    ids, first = block.shingles(width)
    doc = block.doc[first]
    words = block.word_hashes()
    few = np.flatnonzero((block.n_words > 0) & (block.n_words < width))
    short = np.zeros(len(few), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width - 1):
            has = block.n_words[few] > k
            at = block.first_word[few[has]] + k
            short[has] = pair(short[has] + np.uint64(k + 1), words[at])
        short = mix(short + np.uint64(width))
    ids, doc = np.concatenate((ids, short)), np.concatenate((doc, few))
    order = np.lexsort((ids, doc))
    ids, doc = ids[order], doc[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (doc[1:] != doc[:-1])
    return ids[new], doc[new]


def _cuts(doc: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(doc, np.arange(n + 1))


def _digest(values: np.ndarray, size: int) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=size).digest()


def heavy_shingles(rows: DataFrame, least: int, most: int) -> np.ndarray:
    """Shingles that are in `least` different sets of some batch; the `most` heaviest, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            found, seen = [], set()
            for _, texts in blocks(iter([whole])):
                ids, doc = shingle_sets(texts)
                cuts = _cuts(doc, len(texts))
                fresh = np.zeros(len(texts), bool)
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    if b > a and (d := _digest(ids[a:b], 16)) not in seen:
                        seen.add(d)
                        fresh[k] = True
                found.append(ids[fresh[doc]])
            if found:
                ids, counts = np.unique(np.concatenate(found), return_counts=True)
                some = counts >= least
                yield pa.RecordBatch.from_arrays([pa.array(ids[some].view(np.int64)), pa.array(counts[some])], names=["shingle", "n"])

    counted = rows.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "shingle").limit(most).select("shingle").toArrow()
    return np.sort(top["shingle"].to_numpy().view(np.uint64))


def _facts(heavy, percent: int):
    """Per document: size, digests of set and group, bitmap; the prefix where it is new in its batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = heavy.value
        for whole in batches:
            groups = set()
            for batch, texts in blocks(iter([whole])):
                ids, doc = shingle_sets(texts)
                place = np.searchsorted(late, ids)
                last = np.zeros(len(ids), bool)
                if len(late):
                    last = late[np.minimum(place, len(late) - 1)] == ids
                ranked = ids[np.lexsort((ids, last, doc))]
                cuts = _cuts(doc, len(texts))
                size = np.diff(cuts)
                bits = np.zeros((len(texts), BITMAP * 64), np.uint8)
                np.add.at(bits, (doc, (mix(ids) >> np.uint64(54)).astype(np.int64)), 1)
                maps = np.packbits(bits & 1, axis=1).view(np.int64)
                set1, set2, group, prefix = [], [], [], []
                for a, b in zip(cuts[:-1], cuts[1:]):
                    n = int(b - a)
                    whole_set = np.frombuffer(_digest(ids[a:b], 16), np.int64)
                    head = ranked[a : a + n - -(-n * percent // 100) + 1] if n else ranked[:0]
                    g = int(np.frombuffer(_digest(np.append(head, np.uint64(n)), 8), np.int64)[0])
                    set1.append(int(whole_set[0]))
                    set2.append(int(whole_set[1]))
                    group.append(g)
                    prefix.append(head.view(np.int64) if n and g not in groups else None)
                    groups.add(g)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("node"), pa.array(size.astype(np.int64)), pa.array(set1), pa.array(set2), pa.array(group),
                     *[pa.array(maps[:, k]) for k in range(BITMAP)], pa.array(prefix, pa.list_(pa.int64()))],
                    names=["id", "node", "n", "set1", "set2", "grp", *[f"b{k}" for k in range(BITMAP)], "prefix"],
                )

    return run


def _similar(percent: int):
    """Keeps pairs of texts whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, left in blocks(batches, "left"):
            right = [x or b"" for x in batch.column("right").cast(pa.binary()).to_pylist()]
            ids, doc = shingle_sets(left + right)
            cuts = _cuts(doc, 2 * len(left))
            keep = []
            for k in range(len(left)):
                x, y = ids[cuts[k] : cuts[k + 1]], ids[cuts[k + len(left)] : cuts[k + len(left) + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _overlap(x, y, percent: int):
    """The least overlap of similar sets of these sizes, as a column."""
    return F.ceil((x + y) * float(percent) / (100 + percent) - 1e-9)


def _may_overlap(n1, n2, words, percent: int):
    """The bound from bitmaps of the parities of two sets, given as pairs of words."""
    differ = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in words), F.lit(0))
    return n1 + n2 - differ >= 2 * _overlap(n1, n2, percent)


def _plausible(n1, p1, n2, p2, percent: int):
    """Size filter, and the overlap that is left if the shared shingle is the first one of both."""
    left = 1 + F.least(n1 - 1 - p1, n2 - 1 - p2)
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (left >= _overlap(n1, n2, percent))


def _mostly_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """`texts` (node, text) without most of those that are not among `nodes`, before any exchange.

    A bitmap of SIEVE_BITS bits, whatever the number of nodes, holds their hashes; where it fills up
    it lets more through, and the join that follows decides.
    """
    place = F.shiftrightunsigned(F.xxhash64("node"), 64 - SIEVE_BITS)
    words = nodes.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, cast(pmod(shiftrightunsigned(xxhash64(node), %d), 64) as int))" % (64 - SIEVE_BITS)).alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (SIEVE_BITS - 6), np.uint64)
    bitmap[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("place").to_numpy().astype(np.int64)
            keep = (shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            yield batch.select(["node", "text"]).filter(pa.array(keep.astype(bool)))

    return texts.select("node", "text", place.alias("place")).mapInArrow(run, "node long, text string")


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among distinct pairs of classes: bitmaps first, then whole texts."""
    bits = [f"b{k}" for k in range(BITMAP)]
    one = classes.select(F.col("node").alias("a"), F.col("n").alias("n1"), *[F.col(b).alias(f"x{b}") for b in bits])
    two = classes.select(F.col("node").alias("b"), F.col("n").alias("n2"), *[F.col(b).alias(f"y{b}") for b in bits])
    both = pairs.join(one, "a").join(two, "b")
    both = both.filter(_may_overlap(F.col("n1"), F.col("n2"), [(F.col(f"x{b}"), F.col(f"y{b}")) for b in bits], percent))
    left_over = write_and_read(both.select("a", "b"), "pairs")
    needed = write_and_read(_mostly_of(texts, left_over.selectExpr("explode(array(a, b)) as node")), "pair-texts")
    left = needed.select(F.col("node").alias("a"), F.col("text").alias("left"))
    right = needed.select(F.col("node").alias("b"), F.col("text").alias("right"))
    whole = left_over.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return whole.mapInArrow(_similar(percent), "a long, b long")


def _closest(met: DataFrame, own: str) -> DataFrame:
    """Of each row's partners (own, other; once for each list they share) the PARTNERS most frequent."""
    order = Window.partitionBy(own).orderBy(F.desc("count"), "other")
    return met.groupBy(own, "other").count().withColumn("place", F.row_number().over(order)).filter(F.col("place") <= PARTNERS)


def _merged(member: DataFrame, links: DataFrame) -> DataFrame:
    """`member` (node, component, ...) after links between nodes: only the components that links join, each
    pair of them once, go through the rounds that find the new ones."""
    ends = member.select("node", "component")
    joined = links.join(ends.select(F.col("node").alias("a"), F.col("component").alias("x")), "a")
    joined = joined.join(ends.select(F.col("node").alias("b"), F.col("component").alias("y")), "b")
    up = components(joined.select(F.col("x").alias("a"), F.col("y").alias("b")))
    up = up.select(F.col("node").alias("component"), F.col("component").alias("root"))
    return write_and_read(
        member.join(up, "component", "left").withColumn("component", F.coalesce("root", "component")).drop("root"), "members")


def _open_lists(placed: DataFrame) -> DataFrame:
    """Rows of the lists that hold several components, with the largest of them as `mode`."""
    weights = placed.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("w"))
    modes = weights.groupBy("shingle").agg(F.max_by("component", F.struct("w", "component")).alias("mode"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    return placed.join(modes.select("shingle", "mode"), "shingle")


def _pair(x, y):
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def node_of() -> Column:
    """One number for each row of `base.identified`: its id where ids are unique."""
    return F.when(F.col("tie") == 0, F.col("id")).otherwise(F.xxhash64("id", "tie"))


def _labelled(rows: DataFrame, percent: int) -> DataFrame:
    """node, id, n, component (a node of it) of each row of `base.identified`."""
    texts = rows.select(node_of().alias("node"), "id", "text")
    heavy = rows.sparkSession.sparkContext.broadcast(heavy_shingles(texts, HEAVY_IN_BATCH, MOST_HEAVY))
    schema = "id long, node long, n long, set1 long, set2 long, grp long, " + ", ".join(f"b{k} long" for k in range(BITMAP))
    facts = write_and_read(texts.mapInArrow(_facts(heavy, percent), f"{schema}, prefix array<long>"), "shingle-facts")

    # Classes of equal sets, by their least node; the empty set is no class.
    narrow = facts.drop("prefix")
    classes = write_and_read(
        narrow.filter("n > 0").groupBy("set1", "set2").agg(F.min(F.struct("node", "n", "grp", *[f"b{k}" for k in range(BITMAP)])).alias("c")).select("set1", "set2", "c.*"),
        "classes",
    )
    groups = classes.groupBy("grp").agg(F.min("node").alias("hub"))
    texts = texts.select("node", "text")

    # Lists of groups by prefix shingle, without the shingles of one group only.
    posted = facts.filter("prefix is not null").select("grp", "n", F.posexplode("prefix").alias("p", "shingle"))
    by_size = Window.partitionBy("shingle").orderBy("n", "grp", "p")
    before = by_size.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = by_size.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    entry = F.struct("grp", "n", "p")
    lists = (
        posted.withColumn("prev", F.lag(entry).over(by_size)).withColumn("head", F.first(entry).over(before))
        .withColumn("least", F.min("grp").over(whole)).withColumn("most", F.max("grp").over(whole))
        .filter("least <> most").filter("prev is null or prev.grp <> grp")
        .select("shingle", "grp", "n", "p", "prev", "head")
    )
    lists = write_and_read(lists, "shingle-lists")
    # Of the preceding and of the first groups of its lists, a group meets those it shares most lists with.
    met = None
    for other in ("prev", "head"):
        o = lambda f, other=other: F.col(f"{other}.{f}")
        some = lists.filter(F.col(other).isNotNull() & (o("grp") != F.col("grp")) & _plausible(F.col("n"), F.col("p"), o("n"), o("p"), percent))
        some = some.select("grp", o("grp").alias("other"))
        met = some if met is None else met.unionByName(some)
    near = _closest(met, "grp").select(*_pair(F.col("grp"), F.col("other")))
    g1 = groups.select(F.col("grp").alias("a"), F.col("hub").alias("h1"))
    g2 = groups.select(F.col("grp").alias("b"), F.col("hub").alias("h2"))
    between = near.distinct().join(g1, "a").join(g2, "b").select(*_pair(F.col("h1"), F.col("h2")))
    within = classes.select("node", "grp").join(groups, "grp").filter("node <> hub").select(*_pair(F.col("node"), F.col("hub")))
    first = write_and_read(between.unionByName(within).distinct(), "first-pairs")
    alone = classes.select("node", "grp", "n", F.col("node").alias("component"))
    member = _merged(alone, write_and_read(_verified(first, classes, texts, percent), "first-links"))

    # Lists, and groups, whose members are not all connected yet, with the bitmaps of their rows.
    placed = lists.select("shingle", "grp", "p").unionByName(
        groups.join(member.groupBy("grp").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi"), "grp")
        .select(F.col("grp").alias("shingle"), "grp", F.lit(0).cast("int").alias("p"))
    )
    bits = [f"b{k}" for k in range(BITMAP)]
    open_rows = _open_lists(placed.join(member, "grp").select("shingle", "node", "n", "p", "component"))
    open_rows = write_and_read(open_rows.join(classes.select("node", *bits), "node"), "open-rows")

    def may_link(suffix: str):
        other = {c: F.col(f"{c}{suffix}") for c in ("n", "p", "component", *bits)}
        return (
            (other["component"] != F.col("component")) & _plausible(other["n"], other["p"], F.col("n"), F.col("p"), percent)
            & _may_overlap(other["n"], F.col("n"), [(other[b], F.col(b)) for b in bits], percent)
        )

    # Second round: rows outside the largest component of a list meet its closest rows by size, before and after.
    rest = Window.partitionBy("shingle").orderBy("n", "node")
    row = F.when(F.col("component") == F.col("mode"), F.struct("node", "n", "p", "component", *bits))
    beside = open_rows.withColumn("below", F.last(row, True).over(rest.rowsBetween(Window.unboundedPreceding, -1)))
    beside = beside.withColumn("above", F.first(row, True).over(rest.rowsBetween(1, Window.unboundedFollowing))).filter("component <> mode")
    met = None
    for side in ("below", "above"):
        some = beside.select("node", "n", "p", "component", *bits, *[F.col(f"{side}.{c}").alias(f"{c}_o") for c in ("node", "n", "p", "component", *bits)])
        some = some.filter(F.col("node_o").isNotNull() & may_link("_o")).select("node", F.col("node_o").alias("other"))
        met = some if met is None else met.unionByName(some)
    second = _closest(met, "node").select(*_pair(F.col("node"), F.col("other"))).distinct().join(first, ["a", "b"], "left_anti")
    second = write_and_read(second, "second-pairs")
    member = _merged(member, write_and_read(_verified(second, classes, texts, percent), "second-links"))

    # Third round: all other pairs of a list that lie in different components.
    relabelled = open_rows.select("shingle", "node", "n", "p").join(member.select("node", "component"), "node")
    still = write_and_read(_open_lists(relabelled).join(classes.select("node", *bits), "node"), "still-open")
    odd = still.filter("component <> mode").select("shingle", *[F.col(c).alias(f"{c}_o") for c in ("node", "n", "p", "component", *bits)])
    rest = odd.join(still.drop("mode"), "shingle").filter(may_link("_o"))
    third = rest.select(*_pair(F.col("node_o"), F.col("node"))).distinct().join(first.unionByName(second), ["a", "b"], "left_anti")
    more = write_and_read(_verified(third, classes, texts, percent), "third-links")

    # A copy is where its class is; the empty set is alone.
    member = _merged(member, more)
    labels = classes.select("set1", "set2", "node").join(member.select("node", "component"), "node").drop("node")
    labelled = narrow.join(labels, ["set1", "set2"], "left")
    return labelled.select("id", "node", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("node")).alias("component"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable by links), members (of it)."""
    labelled = _labelled(identified(docs, id_col, text_col), percent)
    # The label is a node; the result names the least id of the component.
    least = labelled.groupBy("component").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    shown = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return labelled.join(least, "component").select(
        shown("id").alias(id_col), F.col("n").alias("n_shingles"), shown("component_id").alias("component_id"), "members"
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """`docs` with the document of the least id of each component only, all columns kept."""
    carry = [c for c in docs.columns if c not in (id_col, text_col)]
    rows = identified(docs, id_col, text_col, carry)
    labelled = _labelled(rows, percent)
    chosen = labelled.groupBy("component").agg(F.min(F.struct("id", "node")).alias("c")).select(F.col("c.node").alias("node"))
    kept = original_id(rows.withColumn("node", node_of()).join(write_and_read(chosen, "chosen"), "node", "left_semi"))
    source = {id_col: F.col("id"), text_col: F.col("text")}
    return kept.select(*[source.get(c, F.col(f"carried.`{c}`") if carry else None).alias(c) for c in docs.columns])
