"""Documents whose sets of word shingles have a Jaccard similarity of at least a threshold, joined by T-occurrence search.

A document x can only be similar to y if y occurs in T = ceil(t |x|) of the inverted lists of x's shingles. DivideSkip
merges the short lists of x and probes the long ones for the candidates found: with T - 1 lists left to probing, one
occurrence in the |x| - T + 1 others makes a candidate, and the number of them bounds the overlap. The steps, each a distributed job:

1. Sets. A text becomes a sorted array of 64-bit shingle hashes. Equal sets are one class.
2. List lengths. Every shingle is counted over all classes; long lists (the most frequent shingles) are named.
3. Short lists. Each class writes its first |x| - T + 1 shingles, long lists last, to the lists; sorting merges them.
4. Candidates. In a list, each class is paired with its neighbour; what that leaves in different components is paired in full,
   if sizes and positions allow. A group of near copies is thus joined by a chain, not by all its pairs. Pairs that
   occur together in too few short lists to reach the overlap are dropped.
5. Probing. A pair's sets are brought together; binary search of one in the other gives the exact overlap.
6. Components of the links that hold.

Python sees one document, one batch or one partition's packed fingerprints at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyweave.lineage import cut, cut_observed
from keyweave.llm.columns import column, spaced_words
from keyweave.llm.components import components, few

_MULTIPLIERS = np.random.RandomState(5).randint(1, 2**63 - 1, 64, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
BLOCK = 1_000_000  # shingles that a task holds at a time: 8 MB
SEEN_SETS = 200_000  # sets that a task remembers, not to send copies twice
MOST_NAMED = 1 << 20  # long lists that are sent to the tasks, at most: 8 MB
MOST_BITS = 1 << 27  # of the filter that is sent to the tasks, at most: 16 MB
BITMAP = 32_768  # bits of one of Spark's bitmaps


@dataclass(frozen=True)
class Similarity:
    """Sets are similar if 100 * intersection >= percent * union."""

    shingle: int = 5
    percent: int = 80
    #: A list of more classes than this is long.
    long_list: int = 32

    def needed(self, size: int) -> int:
        return -(-self.percent * size // 100)


def shingle_set(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words; of the whole sequence if it is shorter; none without words."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    width = min(k, n)
    mixed = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        mixed += one[j : n - width + 1 + j] * _MULTIPLIERS[j]
    mixed ^= mixed >> np.uint64(33)
    mixed *= np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def class_of(shingles: np.ndarray) -> int:
    """One number for equal sets."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - 2**63


def _documents(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[object, np.ndarray]]:
    for batch in batches:
        ids = batch.column(0)
        for i, text in enumerate(batch.column(1)):
            yield ids[i], shingle_set(spaced_words(text.as_py()), k)


def _new_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[int, np.ndarray]]:
    """The sets of a task; copies are left out as long as the task remembers them."""
    seen: set[int] = set()
    for _, shingles in _documents(batches, k):
        if not len(shingles) or (own := class_of(shingles)) in seen:
            continue
        if len(seen) >= SEEN_SETS:
            seen.clear()
        seen.add(own)
        yield own, shingles


def _measure(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Id, size and class of each text. A batch has thousands of texts, so their sets aren't held."""
    for batch in batches:
        sizes, classes = [], []
        for _, shingles in _documents(iter([batch]), k):
            sizes.append(len(shingles))
            classes.append(class_of(shingles) if len(shingles) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64())], ["id", "size", "cls"])


def sets_of(docs: DataFrame, k: int) -> DataFrame:
    """(id, size, cls) of each document; cls is null for the empty set."""
    id_type = docs.schema[0].dataType.simpleString()
    return docs.mapInArrow(lambda batches: _measure(batches, k), f"id {id_type}, size bigint, cls bigint")


def _pack(batches: Iterator[pa.RecordBatch], k: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The fingerprints of the sets, packed by buckets. A block of them is held twice at most."""
    held: list[np.ndarray] = []
    n = 0

    def packed() -> pa.RecordBatch:
        marks = np.concatenate(held)
        held.clear()
        marks.sort()
        bounds = np.searchsorted(marks, np.arange(buckets, dtype=np.uint64) << np.uint64(32))
        low = marks.astype(np.uint32)  # the lower half
        parts = [x.tobytes() for x in np.split(low, bounds[1:])]
        own = [i for i, x in enumerate(parts) if x]
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([parts[i] for i in own], pa.binary())], ["bucket", "marks"])

    for _, shingles in _new_sets(batches, k):
        held.append(fingerprints(shingles, buckets))
        n += len(shingles)
        if n >= BLOCK:
            yield packed()
            n = 0
    if held:
        yield packed()


def long_lists(docs: DataFrame, rule: Similarity, buckets: int) -> np.ndarray:
    """The fingerprints of the shingles with the longest lists, sorted; at most MOST_NAMED.

    Shingles travel as 32-bit fingerprints, packed by buckets of their leading bits. Any set of named lists gives right
    results, for it only orders the shingles; so fingerprints that coincide do no harm.
    """
    k = rule.shingle

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for bucket, marks in zip(batch.column(0), batch.column(1), strict=True):
                held.setdefault(bucket.as_py(), []).append(np.frombuffer(marks.as_py(), np.uint32))
        for bucket, parts in held.items():
            marks, counts = np.unique(np.concatenate(parts), return_counts=True)
            named = counts > rule.long_list
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((marks[named].astype(np.uint64) | np.uint64(bucket << 32)).astype(np.int64)),
                    pa.array(np.log2(counts[named]).astype(np.int32)),
                ],
                ["mark", "magnitude"],
            )

    packed = docs.mapInArrow(lambda batches: _pack(batches, k, buckets), "bucket bigint, marks binary").repartition(buckets, "bucket")
    named = cut(packed.mapInArrow(count, "mark bigint, magnitude int"), "long-lists")
    left, least = MOST_NAMED, 99
    for row in named.groupBy("magnitude").count().orderBy(F.desc("magnitude")).collect():  # at most 64 rows
        left -= row["count"]
        if left < 0:
            break
        least = row["magnitude"]
    marks = named.where(F.col("magnitude") >= least).select("mark").toArrow().column("mark").to_numpy()  # at most MOST_NAMED
    return np.sort(marks.astype(np.uint64))


def fingerprints(shingles: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket, by the leading 32 bits, and the other 32 bits of each hash."""
    low = np.uint64(0xFFFFFFFF)
    return (((shingles >> np.uint64(32)) * np.uint64(buckets)) & ~low) | (shingles & low)


def _is_named(marks: np.ndarray, named: np.ndarray) -> np.ndarray:
    if not len(named):
        return np.zeros(len(marks), bool)
    return named[np.minimum(np.searchsorted(named, marks), len(named) - 1)] == marks


def short_lists(docs: DataFrame, rule: Similarity, buckets: int, named: np.ndarray) -> DataFrame:
    """The entries (shingle, size, cls, at) of lists with two classes or more, `at` being the place in the class's order."""
    sent = docs.sparkSession.sparkContext.broadcast(named)  # bounded by MOST_NAMED
    k, names = rule.shingle, ["shingle", "cls", "size", "at"]

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def batch() -> pa.RecordBatch:
            columns = [np.concatenate([x[i] for x in held]) for i in range(4)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

        for own, shingles in _new_sets(batches, k):
            size = len(shingles)
            merged = size - rule.needed(size) + 1
            is_long = _is_named(fingerprints(shingles, buckets), sent.value)
            order = np.concatenate((shingles[~is_long][:merged], shingles[is_long]))[:merged]
            held.append((order.view(np.int64), np.full(merged, own), np.full(merged, size, np.int32), np.arange(merged, dtype=np.int32)))
            n += merged
            if n >= 100_000:
                yield batch()
                held, n = [], 0
        if held:
            yield batch()

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by shingle, size and cls: each class once, if its neighbour is in the same list."""
        last, joined = None, False  # the row held back, and whether the row before it is of its list
        for batch in batches:
            rows = [batch.column(i).to_numpy() for i in range(4)]
            if last is not None:
                rows = [np.concatenate((a, b)) for a, b in zip(last, rows, strict=True)]
            if not len(rows[0]):
                continue
            same = (rows[0][1:] == rows[0][:-1]) & (rows[1][1:] == rows[1][:-1])
            rows = [r[np.concatenate(([True], ~same))] for r in rows]
            after = rows[0][1:] == rows[0][:-1]
            before = np.concatenate(([joined], after))
            keep = before[:-1] | after
            last, joined = [r[-1:] for r in rows], bool(before[-1])
            yield pa.RecordBatch.from_arrays([pa.array(r[:-1][keep]) for r in rows], names)
        if joined:
            yield pa.RecordBatch.from_arrays([pa.array(r) for r in last], names)

    schema = "shingle bigint, cls bigint, size int, at int"
    dealt = docs.mapInArrow(entries, schema).repartition("shingle").sortWithinPartitions("shingle", "size", "cls")
    return cut(dealt.mapInArrow(shared, schema), "short-lists")


def _possible(rule: Similarity, x: str, y: str) -> Column:
    """Whether sizes, and the places of a first common shingle, allow the overlap."""
    size = lambda a: F.col(f"{a}.size")
    left = lambda a: F.col(f"{a}.size") - F.col(f"{a}.at")
    fits = 100 * F.least(size(x), size(y)) >= rule.percent * F.greatest(size(x), size(y))
    return fits & ((100 + rule.percent) * F.least(left(x), left(y)) >= rule.percent * (size(x) + size(y)))


def _as_pair(x: str, y: str) -> list[Column]:
    a, b = F.col(f"{x}.cls"), F.col(f"{y}.cls")
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def neighbours(lists: DataFrame, rule: Similarity, salts: int) -> DataFrame:
    """Pairs of classes next to each other in a list, and of each class with the list's hub.

    A long list is dealt to `salts` chains, whose heads make one more. The hub is the class with the fewest rarer shingles
    before this one; in a group of edited copies that is the least edited one, to which most others are similar.
    """
    row = F.struct("cls", "size", "at")
    salted = lists.select("shingle", "size", "cls", row.alias("y"), F.pmod(F.xxhash64("cls"), F.lit(salts)).alias("salt"))
    chain = Window.partitionBy("shingle", "salt").orderBy("size", "cls")
    heads = Window.partitionBy("shingle").orderBy("size", "cls")
    linked = salted.withColumn("x", F.lag("y").over(chain))
    first = linked.where("x IS NULL").withColumn("x", F.lag("y").over(heads))
    hubs = lists.groupBy("shingle").agg(F.min(F.struct("at", "size", "cls")).alias("hub"))
    hubs = hubs.select("shingle", F.struct("hub.cls", "hub.size", "hub.at").alias("x"))
    starred = salted.join(hubs, "shingle").where("x.cls <> y.cls")
    pairs = linked.select("x", "y").union(first.select("x", "y")).where("x IS NOT NULL").union(starred.select("x", "y"))
    return pairs.where(_possible(rule, "x", "y")).select(*_as_pair("x", "y")).distinct()


def across(lists: DataFrame, roots: DataFrame, rule: Similarity) -> DataFrame:
    """All possible pairs of a list whose classes are in different components.

    In each list the classes of its commonest component aren't paired with each other, and only sizes in neighbouring
    bands meet, so a list costs the number of its other classes times that of the classes near them in size.
    """
    placed = lists.join(roots, lists["cls"] == roots["node"], "left").select(
        "shingle", "cls", "size", "at", F.coalesce("root", "cls").alias("root")
    )
    counted = placed.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("n"))
    commonest = counted.groupBy("shingle").agg(F.max(F.struct("n", "root")).alias("top"), F.count(F.lit(1)).alias("roots"))
    commonest = cut(commonest.where("roots > 1").select("shingle", F.col("top.root").alias("top")), "mixed-lists")
    mixed = placed.join(commonest, "shingle")
    band = F.floor(F.log("size") / log(100 / rule.percent) + 1e-9).cast("int")
    row = F.struct("cls", "size", "at", "root", (F.col("root") == F.col("top")).alias("common"))
    right = mixed.select("shingle", band.alias("band"), row.alias("y"))
    left = mixed.where("root <> top").select("shingle", F.explode(F.sequence(band - 1, band + 1)).alias("band"), row.alias("x"))
    met = left.join(right, ["shingle", "band"]).where("x.root <> y.root AND (y.common OR x.cls < y.cls)")
    return met.where(_possible(rule, "x", "y")).select(*_as_pair("x", "y")).distinct()


def reaching(pairs: DataFrame, prefixes: DataFrame, rule: Similarity) -> DataFrame:
    """The pairs that occur together in enough short lists.

    Of two classes, the one whose short lists end first in the order has all its other shingles after them, so the overlap
    is at most the number of common short lists and those others: T - 1 of its own size.
    """
    x = prefixes.select(F.col("cls").alias("a"), F.struct("size", "shingles").alias("x"))
    y = prefixes.select(F.col("cls").alias("b"), F.struct("size", "shingles").alias("y"))
    met = F.size(F.array_intersect("x.shingles", "y.shingles"))
    probed = F.floor((rule.percent * F.greatest("x.size", "y.size") + 99) / 100) - 1
    enough = (100 + rule.percent) * (met + probed) >= rule.percent * (F.col("x.size") + F.col("y.size"))
    return pairs.join(x, "a").join(y, "b").where(enough).select("a", "b")


def _make_again(batches: Iterator[pa.RecordBatch], k: int, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Class and set of the texts whose place is in the filter, a block of shingles at a time."""
    classes: list[int] = []
    held: list[bytes] = []
    n = 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(held, pa.binary())], ["cls", "shingles"])

    for batch in batches:
        place = batch.column(2).to_numpy()
        found = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1
        for _, shingles in _documents(iter([batch.filter(pa.array(found.astype(bool)))]), k):
            classes.append(class_of(shingles))
            held.append(shingles.tobytes())
            n += len(shingles)
            if n >= BLOCK:
                yield made()
                classes, held, n = [], [], 0
    if held:
        yield made()


def needed_sets(docs: DataFrame, members: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(cls, shingles) of the given classes, made again from one document of each.

    A filter of bounded size tells the tasks which documents those are, so most texts are passed over; a join drops
    the few that it lets through by chance.
    """
    found = members.join(classes, "cls").groupBy("cls").agg(F.min("id").alias("id"))
    chosen, seen = cut_observed(few(found), "chosen", n=F.count(F.lit(1)))
    bits, n = BITMAP, seen["n"]
    while bits < MOST_BITS and bits < 16 * n:
        bits *= 2
    at = F.pmod(F.xxhash64("id"), F.lit(bits))
    maps = chosen.groupBy(F.floor(at / BITMAP).alias("k")).agg(F.bitmap_construct_agg(at % BITMAP).alias("bits"))
    filled = np.zeros(bits // 8, np.uint8)
    for row in maps.collect():  # MOST_BITS bits in all at most, 16 MB, whatever the number of classes
        filled[row["k"] * BITMAP // 8 : (row["k"] + 1) * BITMAP // 8] = np.frombuffer(row["bits"], np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(filled)

    made = docs.withColumn("at", at).mapInArrow(lambda batches: _make_again(batches, k, sent.value), "cls bigint, shingles binary")
    return cut(made.join(chosen.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]), "needed-sets")


def _probe(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            few, many = sorted((np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)), key=len)
            both = int(np.count_nonzero(many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few))
            keep.append(100 * both >= percent * (len(few) + len(many) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def links_among(pairs: DataFrame, sets: DataFrame, rule: Similarity) -> DataFrame:
    """The pairs (a, b) that are similar."""
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y"))
    brought = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    percent = rule.percent
    return brought.mapInArrow(lambda batches: _probe(batches, percent), "a bigint, b bigint")


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_similar(df: DataFrame, id: str = "doc_id", text: str = "text", rule: Similarity = Similarity()) -> tuple[DataFrame, DataFrame]:
    """Membership (id, size, cls) of every row, and the links (a, b) between classes, enough of them for all components.

    A class is one set of shingles, `cls` its number (64 bits of a hash, so two sets are taken for one with a chance of
    some n^2 / 2^65). Empty and null texts have size 0, no class and no links. A text of fewer words than a
    shingle is one shingle, its whole sequence. Links within a group that a chain already holds together aren't searched
    for. Rows are kept as they are, repeated ones too, and fall in one class; ids may be null or repeated. No other
    column is read, so their names don't matter.
    """
    k, buckets = rule.shingle, 4 * _partitions(df.sparkSession)
    docs = df.select(column(id).alias("id"), column(text).cast("string").alias("text"))
    members = cut(sets_of(docs, k), "sets")
    lists = short_lists(docs, rule, buckets, long_lists(docs, rule, buckets))
    # A class has at most its own short lists, here those that it shares.
    prefixes = cut(lists.groupBy("cls").agg(F.first("size").alias("size"), F.collect_list("shingle").alias("shingles")), "prefixes")

    def held(pairs: DataFrame) -> DataFrame:
        if pairs.isEmpty():
            return pairs
        classes = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
        return cut(links_among(pairs, needed_sets(docs, members, classes, k), rule), "links")

    near = cut(reaching(neighbours(lists, rule, buckets), prefixes, rule), "neighbour-pairs")
    first = held(near)
    far = across(lists, components(first), rule).join(near, ["a", "b"], "left_anti")
    second = held(cut(reaching(far, prefixes, rule), "other-pairs"))
    return members, first.union(second)


def similar_groups(df: DataFrame, id: str = "doc_id", text: str = "text", rule: Similarity = Similarity()) -> DataFrame:
    """(id, n_shingles, component_id) of every row: the smallest id that links lead to, its own if there are none.

    Nulls, empty texts and repeated rows: as in `join_similar`; a null id takes part in links but is never the smallest.
    """
    members, links = join_similar(df, id, text, rule)
    roots = components(links)
    classes = members.where("cls IS NOT NULL").groupBy("cls").agg(F.min("id").alias("least"))
    rooted = cut(classes.join(roots, F.col("cls") == F.col("node"), "left").select("cls", "least", "root"), "classes")
    of_root = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("least_of_root"))
    placed = rooted.join(of_root, "root", "left").select("cls", F.coalesce("least_of_root", "least").alias("component_id"))
    return members.join(placed, "cls", "left").select(
        F.col("id").alias(id), F.col("size").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")
    )


def one_of_each_group(df: DataFrame, id: str = "doc_id", text: str = "text", rule: Similarity = Similarity()) -> DataFrame:
    """The rows of `df` without near copies: of each group one row stays, that with the smallest (id, class).

    An id may name several rows with different texts. They are told apart by the class of their text, made again for the rows of
    such ids alone, so each text stays or goes with its own group. Of rows that agree in id and class the one with the
    smallest text stays; so do, for each id, one row of its empty texts. A row with a null id can't be named, so it stays.
    """
    named = df.where(column(id).isNotNull())
    members, links = join_similar(named, id, text, rule)
    roots = components(links)
    grouped = members.where("cls IS NOT NULL").join(roots, F.col("cls") == F.col("node"), "left")
    chosen = grouped.groupBy(F.coalesce("root", "cls")).agg(F.min(F.struct("id", "cls")).alias("first")).select("first.id", "first.cls")
    kept = cut(chosen.union(members.where("cls IS NULL").select("id", "cls").distinct()), "kept")
    several = cut(members.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "several")
    sole = kept.join(several, "id", "left_anti").select(F.col("id").alias("_kept_id"))
    alone = named.join(sole, column(id) == F.col("_kept_id"), "left_semi")
    if several.isEmpty():
        return alone.unionByName(df.where(column(id).isNull()))
    again = several.select(F.col("id").alias("_kept_id"))
    rows = named.join(again, column(id) == F.col("_kept_id"), "left_semi")
    whole = F.struct(*[column(c) for c in df.columns])
    classed = _with_class(rows.select(column(id).alias("id"), column(text).cast("string").alias("text"), whole.alias("row")), rule.shingle)
    least = classed.groupBy("id", "cls").agg(F.min_by("row", F.struct("text", F.xxhash64("row"))).alias("row"))
    wanted = kept.select(F.col("id").alias("i"), F.col("cls").alias("c"))
    found = least.join(wanted, (F.col("id") == F.col("i")) & F.col("cls").eqNullSafe(F.col("c")), "left_semi").select("row.*")
    return alone.unionByName(found).unionByName(df.where(column(id).isNull()))


def _with_class(rows: DataFrame, k: int) -> DataFrame:
    """Add `cls`, as `sets_of` numbers the classes, to rows with a `text`."""

    @F.arrow_udf(returnType="bigint")
    def of(texts: pa.Array) -> pa.Array:
        found = (shingle_set(spaced_words(t.as_py()), k) for t in texts)
        return pa.array([class_of(s) if len(s) else None for s in found], pa.int64())

    return rows.withColumn("cls", of("text"))
