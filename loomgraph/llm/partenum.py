"""Exact n-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct word shingles. Sizes fall into bands such that linked sets lie in the same or in
neighbouring bands; a set signs for its own band and for the one below. For a band, linked sets differ in at most k
elements. The element domain is hashed into n1 groups of three partitions, n1 > k / 2, so two linked sets have a group
with at most one differing element, and agree on two of its three partitions: one signature per group and pair of
partitions, three per group, finds them.

Signatures whose elements are all frequent (or that have none) link by chance. A set leaves them out if it has fewer of
them than the agreeing signatures that every link of it is sure to have; else it keeps them. No link is lost by it,
whatever counts as frequent.

Equal sets are one class. Classes that share signatures are compared in blocks of about 256: those whose lists of
sharers begin with the same class lie in the same blocks, so a group of near copies is compared block by block, by one
matrix product each, and what shares a signature by chance a few at a time. Each block is compared with itself and with
the first block of every list it is in. What is linked then needs no more comparing; what a list holds beside its largest
component is compared with all of the list. So a group of near copies takes as many block pairs as it has blocks. Only
links that join something new leave a block pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import append, column, joined_text, mixed, prepare
from loomgraph.llm.components import connected_components
from loomgraph.session import materialize

SLICE = 1 << 20
BLOCK = 256
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.array([code + 32 if 65 <= code <= 90 else code for code in range(256)], np.uint8)
_GAP = np.array([code == 32 or 9 <= code <= 13 for code in range(256)], bool)
_LETTERS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _powers(base: int, count: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(0, count - 1), base, np.uint64))])[:count]


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of every word of a lower-cased (A-Z) text; words are what white space leaves."""
    inside = ~_GAP[raw]
    edges = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_LETTERS[_LOWER[raw]] * _powers(_BASE, len(raw)))])
        hashes = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(raw) + 1)[starts]
        return mixed(hashes + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), starts


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its n-word shingles; of all its words if they are fewer, none if none."""
    begin, count = 0, len(offsets) - 1
    while begin < count:
        end = begin + 1
        while end < count and offsets[end + 1] - offsets[begin] <= SLICE:
            end += 1
        # texts do not touch: a gap is put between them
        lengths = np.diff(offsets[begin: end + 1])
        spaced = np.full(int(lengths.sum()) + end - begin, 32, np.uint8)
        firsts = offsets[begin:end] - offsets[begin] + np.arange(end - begin)
        target = np.arange(int(lengths.sum())) + np.repeat(np.arange(end - begin), lengths)
        spaced[target] = raw[offsets[begin]: offsets[end]]
        hashes, places = word_hashes(spaced)
        bounds = np.searchsorted(places, np.append(firsts, len(spaced)))
        with np.errstate(over="ignore"):
            rolled = np.zeros(len(hashes), np.uint64)
            for step in range(n):
                rolled[: len(hashes) - step] += hashes[step:] * np.uint64(pow(0xD6E8FEB86659FD93, step + 1, 1 << 64))
            rolled = mixed(rolled)
        for at in range(end - begin):
            first, last = bounds[at], bounds[at + 1]
            if last - first >= n:
                yield np.unique(rolled[first: last - n + 1])
            elif last > first:
                with np.errstate(over="ignore"):
                    weights = _powers(0xD6E8FEB86659FD93, 2 * n)[1: last - first + 1]
                    yield mixed((hashes[first:last] * weights).sum(keepdims=True) + np.uint64(last - first))
            else:
                yield np.zeros(0, np.uint64)
        begin = end


class Bands:
    """Size bands and their signature schemes for a threshold of num / 100."""

    def __init__(self, percent: int, slack: float = 0.05):
        self.percent, self.slack = percent, slack
        self.lows = [1]

    def of(self, size: int) -> int:
        while self.lows[-1] <= size:
            self.lows.append(self.lows[-1] * 100 // self.percent + 1)
        return int(np.searchsorted(self.lows, size, "right")) - 1

    def distance(self, small: int) -> int:
        """The most elements in which a set of this size and a larger or equal one that it links to can differ."""
        large = small * 100 // self.percent
        return max((100 - self.percent) * (small + other) // (100 + self.percent) for other in (small, large))

    def groups(self, band: int) -> int:
        high = self.lows[band] * 100 // self.percent
        return (self.distance(high) // 2 + 1) + int(self.slack * (self.distance(high) // 2))

    def sure(self, band: int, size: int) -> int:
        """How many signatures a set of this size has in common, at least, with every set it links to by this band."""
        high = self.lows[band] * 100 // self.percent
        small = min(size, high)
        # as the larger of a link, its distance is bounded by the smaller one's size and its own
        far = max(self.distance(small), (100 - self.percent) * (size + small) // (100 + self.percent))
        # the first differing element of a group takes two of its three signatures, a second one the third
        groups = self.groups(band)
        return max(0, 3 * groups - 2 * far if far <= groups else 2 * groups - far)


def signatures(elements: np.ndarray, frequent: np.ndarray, bands: Bands) -> np.ndarray:
    """The 64-bit signatures of a set. `frequent` marks its frequent elements."""
    size, made = len(elements), []
    own = bands.of(size)
    with np.errstate(over="ignore"):
        values = mixed(elements + np.uint64(0x2545F4914F6CDD1D))
        for band in (own, own - 1) if own else (own,):
            groups = bands.groups(band)
            parts = (mixed(elements ^ np.uint64(band * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(3 * groups)).astype(np.int64)
            sums = np.zeros(3 * groups, np.uint64)
            np.add.at(sums, parts, values)
            rare = np.bincount(parts[~frequent], minlength=3 * groups).reshape(-1, 3)
            sums = sums.reshape(-1, 3)
            # the pair of partitions that leaves out one of the three
            signed = np.stack([sums[:, (out + 1) % 3] * np.uint64(3) + sums[:, (out + 2) % 3] * np.uint64(5) for out in range(3)], axis=1)
            strong = np.stack([rare[:, (out + 1) % 3] + rare[:, (out + 2) % 3] > 0 for out in range(3)], axis=1)
            names = np.arange(3 * groups, dtype=np.uint64).reshape(-1, 3) + np.uint64(band << 40)
            signed = mixed(signed ^ mixed(names))
            weak = int((~strong).sum())
            made.append(signed[strong] if weak < bands.sure(band, size) else signed.ravel())
    return np.concatenate(made)


def _describe(n: int, text_col: str):
    """n_shingles, class (128 bits of the set), key (64 of them); and elements frequent in the batch."""
    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        sizes, names, keys, all_sets = [], [], [], []
        for elements in shingle_sets(*joined_text(batch, text_col), n):
            name = xxhash.xxh3_128_digest(elements.tobytes())
            sizes.append(len(elements))
            names.append(name)
            keys.append(int.from_bytes(name[:8], "little", signed=True))
            all_sets.append(elements)
        heavy = [None] * batch.num_rows
        if all_sets:
            values, counts = np.unique(np.concatenate(all_sets), return_counts=True)
            heavy[0] = [{"element": int(value), "n": int(count)} for value, count in
                        zip(values[counts >= 2].astype(np.int64), counts[counts >= 2])]
        kind = pa.list_(pa.struct([("element", pa.int64()), ("n", pa.int64())]))
        return [pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(keys, pa.int64()), pa.array(heavy, kind)]

    return compute


_DESCRIBED = [
    T.StructField("n_shingles", T.LongType()), T.StructField("_class", T.BinaryType()), T.StructField("_key", T.LongType()),
    T.StructField("_heavy", T.ArrayType(T.StructType([T.StructField("element", T.LongType()), T.StructField("n", T.LongType())]))),
]


def _sign(text_col: str, n: int, percent: int, frequent):
    """(signature, key) rows; copies sign once per task while their keys fit in memory."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, common, seen = Bands(percent), frequent.value, set()
        for batch in batches:
            parts, keys, size = [], [], 0
            for elements in shingle_sets(*joined_text(batch, text_col), n):
                if not len(elements):
                    continue
                key = int.from_bytes(xxhash.xxh3_128_digest(elements.tobytes())[:8], "little", signed=True)
                if key in seen:
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(key)
                at = np.minimum(np.searchsorted(common, elements), max(0, len(common) - 1))
                marks = common[at] == elements if len(common) else np.zeros(len(elements), bool)
                parts.append(signatures(elements, marks, bands))
                keys.append(key)
                size += len(parts[-1])
                if size >= 200_000:
                    yield _signed(parts, keys)
                    parts, keys, size = [], [], 0
            if parts:
                yield _signed(parts, keys)

    return run


def _signed(parts: list[np.ndarray], keys: list[int]) -> pa.RecordBatch:
    owners = np.repeat(np.array(keys, np.int64), [len(part) for part in parts])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), pa.array(owners)], names=["sig", "_key"])


def _grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Sorted rows in pieces that never cut a run of equal values of the first column (all longs)."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        arrays = [column(batch, name).to_numpy() for name in names]
        first = arrays[0]
        cut = int(np.searchsorted(first == first[-1], True)) if first[0] != first[-1] else 0
        if held and held[-1][0][-1] != first[0]:
            yield [np.concatenate(parts) for parts in zip(*held)]
            held = []
        if cut:
            held.append([array[:cut] for array in arrays])
            yield [np.concatenate(parts) for parts in zip(*held)]
            held = []
        held.append([array[cut:] for array in arrays])
    if held:
        yield [np.concatenate(parts) for parts in zip(*held)]


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Member lists of shared signatures, each distinct list once per piece: (list, key, the list's least key)."""
    for sig, key in _grouped(batches, ["sig", "_key"]):
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
        sig, key = sig[new], key[new]
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        counts = np.diff(np.append(starts, len(sig)))
        with np.errstate(over="ignore"):
            names = mixed(np.add.reduceat(mixed(key.view(np.uint64)), starts) + counts.astype(np.uint64)).view(np.int64)
        _, chosen = np.unique(np.where(counts > 1, names, 0), return_index=True)
        chosen = chosen[counts[chosen] > 1]
        if not len(chosen):
            continue
        rows = np.concatenate([np.arange(starts[at], starts[at] + counts[at]) for at in chosen])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(names[chosen], counts[chosen])), pa.array(key[rows]), pa.array(np.repeat(key[starts[chosen]], counts[chosen]))],
            names=["list", "_key", "hub"],
        )


def linked_pairs(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that span the components of a few sets."""
    if len(sets) == 2:
        one, two = sets
        if 100 * min(len(one), len(two)) < percent * max(len(one), len(two)):
            return []
        common = len(np.intersect1d(one, two, assume_unique=True))
        return [(0, 1)] if 100 * common >= percent * (len(one) + len(two) - common) else []
    sizes = np.array([len(elements) for elements in sets])
    every, codes, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owners = np.repeat(np.arange(len(sets)), sizes)
    # only elements of two sets or more can be common
    shared = uses[codes] > 1
    every, codes, owners = every[uses > 1], (np.cumsum(uses > 1) - 1)[codes[shared]], owners[shared]
    common = np.zeros((len(sets), len(sets)), np.float64)
    for begin in range(0, len(every), 16384):  # bounds the dense matrix
        inside = (codes >= begin) & (codes < begin + 16384)
        dense = np.zeros((len(sets), min(16384, len(every) - begin)), np.float32)
        dense[owners[inside], codes[inside] - begin] = 1
        common += dense @ dense.T
    whole = sizes[:, None] + sizes[None, :] - common
    links = np.argwhere(np.triu(100 * common >= percent * whole, 1))
    parent = list(range(len(sets)))

    def root(at: int) -> int:
        while parent[at] != at:
            parent[at] = parent[parent[at]]
            at = parent[at]
        return at

    kept = []
    for one, two in links.tolist():
        a, b = root(one), root(two)
        if a != b:
            parent[a] = b
            kept.append((one, two))
    return kept


BITS = 1 << 26


def _bitmap(blocks: DataFrame) -> np.ndarray:
    """One bit for each residue of the keys that meet others: 8 MB whatever the input; it only thins out what is joined."""
    place = F.pmod("_key", F.lit(BITS))
    parts = (
        blocks.select(place.alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits")).collect()
    )
    made = np.zeros(BITS // 8 + (1 << 13), np.uint8)
    for row in parts:
        bits = np.frombuffer(row["bits"], np.uint8)
        made[row["bucket"] * len(bits): (row["bucket"] + 1) * len(bits)] |= bits
    return made


def _marked(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Spark's bitmap places: 0 alone in the first bucket of 32,768 bits, 1 on from the second."""
    places = keys % BITS
    places = np.where(places > 0, places + 32767, 0)
    return (bitmap[places >> 3] >> (places & 7)) & 1


def _verify(text_col: str, n: int, percent: int):
    """Compare the sets of each block pair; rows come sorted by pair."""
    def links(names, texts):
        offsets = np.concatenate([[0], np.cumsum([len(text) for text in texts])]).astype(np.int64)
        sets = list(shingle_sets(np.frombuffer(b"".join(texts), np.uint8), offsets, n))
        return [(names[a], names[b]) for a, b in linked_pairs(sets, percent)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, texts = None, [], []
        for batch in batches:
            found = []
            rows = zip(column(batch, "one").to_pylist(), column(batch, "two").to_pylist(), column(batch, "_class").to_pylist(),
                       column(batch, "_text").cast(pa.binary()).to_pylist())
            for one, two, name, text in rows:
                if (one, two) != now:
                    if len(names) > 1:
                        found += links(names, texts)
                    now, names, texts = (one, two), [], []
                names.append(name)
                texts.append(text)
            yield _linked(found)
        if len(names) > 1:
            yield _linked(links(names, texts))

    return run


def _linked(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], names=["a", "b"])


def jaccard_components(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = 4, percent: int = 85,
                       most_frequent: int = 200_000) -> DataFrame:
    """The id column, n_shingles and component_id (the least id that links reach, its own included) of every row.

    Rows link if the Jaccard similarity of their shingle sets is at least percent / 100; equal sets always do. Null,
    empty and blank texts have no shingles and link with nothing. Equal rows link like others. A null id is ignored
    in component_id unless all ids of a component are null. Other columns are left behind; an empty table gives none.
    `most_frequent` bounds the broadcast list of frequent shingles; it changes the cost, never the links.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    described = append(rows, _describe(n, "_text"), _DESCRIBED).drop("_text")
    info = materialize(described)
    heavy = info.filter(F.col("_heavy").isNotNull()).select(F.inline("_heavy")).groupBy("element").agg(F.sum("n").alias("n"))
    top = heavy.filter(F.col("n") >= 64).orderBy(F.desc("n"), "element").limit(most_frequent).select("element").toPandas()
    frequent = spark.sparkContext.broadcast(np.sort(top["element"].to_numpy(np.int64).view(np.uint64)))

    signed = rows.select("_text").mapInArrow(_sign("_text", n, percent, frequent), "sig long, _key long")
    shared = signed.repartition("sig").sortWithinPartitions("sig", "_key").mapInArrow(_lists, "list long, _key long, hub long")
    lists = materialize(shared.distinct())

    # classes whose lists begin with the same class live in the same blocks, and so do those that share a list with them
    homes = lists.groupBy("_key").agg(F.min("hub").alias("home"))
    shared_home = lists.join(homes, "_key").groupBy("list").agg(F.min("home").alias("home"))
    homes = lists.join(shared_home, "list").groupBy("_key").agg(F.min("home").alias("home"))
    crowd = homes.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).alias("_blocks"))
    blocks = materialize(homes.join(crowd, "home").select("_key", F.xxhash64("home", F.pmod(F.xxhash64("_key"), "_blocks")).alias("block")))
    placed = materialize(lists.join(blocks, "_key").groupBy("list", "block").agg(F.count("*").alias("n")))
    sent = spark.sparkContext.broadcast(_bitmap(blocks))

    def compared(pairs: DataFrame) -> DataFrame:
        texts = (
            rows.select("_text").mapInArrow(_wanted("_text", n, sent), "_text string, _class binary, _key long")
            .join(blocks, "_key").groupBy("_key", "_class").agg(F.min("_text").alias("_text"), F.first("block").alias("block"))
        )
        sides = pairs.withColumn("block", F.explode(F.array_distinct(F.array("one", "two"))))
        meeting = sides.join(texts, "block").select("one", "two", "_class", "_text").repartition("one", "two").sortWithinPartitions("one", "two")
        return materialize(meeting.mapInArrow(_verify("_text", n, percent), "a binary, b binary"))

    # first each block with itself, and with the first block of every list it is in
    first = Window.partitionBy("list")
    star = placed.withColumn("one", F.min("block").over(first)).filter(F.col("block") != F.col("one")).select("one", F.col("block").alias("two"))
    own = placed.filter(F.col("n") > 1).select(F.col("block").alias("one"), F.col("block").alias("two"))
    near = materialize(star.unionByName(own).distinct())
    links = compared(near)
    # then what a list holds beside its largest component so far, with all of the list
    far = materialize(_unsettled(lists, blocks, placed, info, connected_components(links, "a", "b")).join(near, ["one", "two"], "left_anti"))
    if not far.isEmpty():
        links = links.unionByName(compared(far))

    roots = connected_components(links, "a", "b")
    members = info.filter(F.col("n_shingles") > 0).groupBy("_class").agg(F.min("_id").alias("_low"))
    rooted = members.join(roots.withColumnRenamed("member", "_class"), "_class", "left")
    low = rooted.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("_low").alias("_lowest"))
    labels = rooted.join(low, "root", "left").select("_class", F.coalesce("_lowest", "_low").alias("component_id"))
    out = info.select("_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("_class")).alias("_class"))
    return out.join(labels, "_class", "left").select(
        F.col("_id").alias(id_col), "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"),
    )


def _unsettled(lists: DataFrame, blocks: DataFrame, placed: DataFrame, info: DataFrame, roots: DataFrame) -> DataFrame:
    """(one, two): the blocks that a member outside its list's largest component is in, with every block of the list.

    Two members of a list that are not linked yet have one at least outside that component, so no pair is left out; lists
    whose members are all linked, like those of a group of near copies, give none.
    """
    classes = info.filter(F.col("n_shingles") > 0).select("_key", "_class").distinct()
    named = classes.join(roots.withColumnRenamed("member", "_class"), "_class", "left").select("_key", F.coalesce("root", "_class").alias("part"))
    # keys are 64 bits of a class: classes that share one count as a part of their own unless they are linked
    parts = named.groupBy("_key").agg(F.min("part").alias("least"), F.max("part").alias("most")).select(
        "_key", F.when(F.col("least") == F.col("most"), F.col("least")).otherwise(F.col("_key").cast("string").cast("binary")).alias("part")
    )
    members = lists.select("list", "_key").join(parts, "_key").join(blocks, "_key")
    sizes = members.groupBy("list", "part").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("list").agg(F.count("*").alias("parts"), F.max_by("part", F.struct("n", "part")).alias("largest")).filter(F.col("parts") > 1)
    outside = members.join(largest, "list").filter(F.col("part") != F.col("largest")).select("list", F.col("block").alias("_one")).distinct()
    pairs = outside.join(placed.select("list", F.col("block").alias("_two")), "list")
    return pairs.select(F.least("_one", "_two").alias("one"), F.greatest("_one", "_two").alias("two")).distinct()


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one row of each group of linked rows: that of the least id (nulls last), of equal ids the one of the
    least text. Rows without words are linked with nothing and stay. All columns pass through."""
    numbered = materialize(docs.withColumn("_row", F.monotonically_increasing_id()))
    places = numbered.select("_row", F.col(id_col).alias("_doc"), F.col(text_col).alias("_copy"))
    order = F.struct(F.col("_doc").isNull().alias("late"), "_doc", F.xxhash64("_copy").alias("hash"), "_row")
    ranks = places.select("_row", order.alias("_order"))
    labels = jaccard_components(numbered, text_col, "_row", n, percent)
    linked = labels.join(ranks, "_row")
    best = linked.groupBy("component_id").agg(F.min("_order").alias("_order")).select(F.col("_order._row").alias("_row"))
    return numbered.join(best, "_row", "left_semi").drop("_row")


def _wanted(text_col: str, n: int, bitmap):
    """(text, class, key) of the texts whose key may meet others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [xxhash.xxh3_128_digest(elements.tobytes()) for elements in shingle_sets(*joined_text(batch, text_col), n)]
            keys = np.array([int.from_bytes(name[:8], "little", signed=True) for name in names], np.int64)
            chosen = pa.array(np.flatnonzero(_marked(bitmap.value, keys)))
            yield pa.RecordBatch.from_arrays(
                [column(batch, text_col).take(chosen), pa.array(names, pa.binary()).take(chosen), pa.array(keys).take(chosen)],
                names=[text_col, "_class", "_key"],
            )

    return run
