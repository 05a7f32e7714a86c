"""Document fingerprints by winnowing, in DataFrame functions only.

Words are hashed in k-grams, one beginning at every word; each window of w consecutive grams gives its least hash, the
rightmost of equals. A selected gram keeps its position. Any run of w + k - 1 words that two texts share therefore leaves
a common print. Short texts, and those with a very long word, have grams of characters besides, so that short texts and
texts without white space have prints that survive an edit.

A print is one long: 33 bits of hash above 30 bits of the position counted from the end of the scale, so that the plain
minimum of a window is the least hash and, among equals, the rightmost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, W = 5, 4
# shorter texts, and texts with a longer word, are also told by grams of characters, which do not need white space
SHORT, LONG_WORD = 256, 40
_PLACES = (1 << 30) - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value computed once, also where it is used inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), "")


def characters(text: Column) -> Column:
    """The characters of a text but white space, marked so that none is taken for a word."""
    signs = F.array_remove(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", ""), ""), "")
    return F.transform(signs, lambda sign: F.concat(F.lit("\u0001"), sign))


def prints(text: Column, k: int = K, w: int = W) -> Column:
    """The selected grams of a text in order: of k words, and, if it is short or has a very long word, of k characters, too.

    Fewer than k words or characters, but not none, are one gram; an empty text has none.
    """
    def grams(found: Column) -> Column:
        last = F.greatest(F.size(found) - k, F.lit(0))
        gram = lambda at: F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.slice(found, at + 1, F.lit(k))), 31), 30)
        return F.when(F.size(found) > 0, F.transform(F.sequence(F.lit(0), last), lambda at: gram(at) + (F.lit(_PLACES) - at)))

    def chosen(packed: Column) -> Column:
        last = F.greatest(F.size(packed) - w, F.lit(0))
        return F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda at: F.array_min(F.slice(packed, at + 1, F.lit(w)))))

    def selected(found: Column) -> Column:
        made = _let(grams(found), lambda packed: F.when(packed.isNotNull(), chosen(packed)))
        return F.coalesce(made, F.array().cast("array<bigint>"))

    def both(found: Column) -> Column:
        unspaced = (F.char_length(text) < SHORT) | F.exists(found, lambda word: F.char_length(word) > LONG_WORD)
        signs = F.coalesce(F.when(unspaced, characters(text)), F.array().cast("array<string>"))
        return F.concat(selected(found), _let(signs, selected))

    return _let(words(text), both)


def hashes(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda packed: F.shiftright(packed, 30)))


def positions(found: Column) -> Column:
    """The number of the word, or character, each print starts at."""
    return F.transform(found, lambda packed: (F.lit(_PLACES) - packed.bitwiseAND(_PLACES)).cast("int"))


def printed(found: Column) -> Column:
    """`hash@position` of every print, hashes in hexadecimal."""
    entry = lambda packed: F.concat(F.hex(F.shiftright(packed, 30)), F.lit("@"), F.lit(_PLACES) - packed.bitwiseAND(_PLACES))
    return F.array_join(F.transform(found, entry), " ")


def likeness(one: Column, two: Column) -> Column:
    """Jaccard similarity of the hashes of two print lists; two empty ones are alike."""
    def of(a: Column, b: Column) -> Column:
        both = F.size(F.array_intersect(a, b))
        return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))

    return _let(hashes(one), lambda a: _let(hashes(two), lambda b: of(a, b)))


def fingerprint(docs: DataFrame, text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """`docs` with `prints`. Null and empty texts have none; equal texts have equal ones, however long; rows are told each
    for itself, and an empty table stays empty. An input column `prints` is replaced."""
    return docs.withColumn("prints", prints(F.col(text_col), k, w))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None) -> tuple[DataFrame, Column]:
    """doc_id, text and what a window needs to see each row's next one by falling id; after the last comes the first.

    Rows are dealt into blocks of neighbouring ids by quantiles, and the first row of each block is also sent, as a
    guest, to the block before it: so every row meets its successor in its own block and texts are shuffled once.
    Rows without id come last, spread and ordered by text hash; equal ids are ordered by text hash, then text.
    Returns the rows (guests are marked in `guest`) and the window.
    """
    spark = docs.sparkSession
    blocks = blocks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    share = F.pmod(F.xxhash64(text), F.lit(1 << 40)) / float(1 << 40)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("_hash", F.xxhash64("text"))
    rows = rows.withColumn("_key", F.coalesce(F.col("doc_id").cast("double"), F.lit(-1e300) * (F.lit(1.0) + F.lit(1.0) * share)))
    cuts = rows.agg(F.percentile_approx("_key", [at / blocks for at in range(1, blocks)], 20 * blocks)).first()[0] or []
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    rows = Bucketizer(splits=splits, inputCol="_key", outputCol="_bucket").transform(rows) if len(splits) > 2 else rows.withColumn("_bucket", F.lit(0.0))
    rows = rows.withColumn("block", F.col("_bucket").cast("int")).drop("_bucket")
    order = F.struct("_key", F.coalesce("doc_id", F.lit(-(1 << 63))), "_hash")
    heads = sorted((row["block"], row["head"]) for row in rows.groupBy("block").agg(F.max(order).alias("head")).collect())  # one per block
    targets = {block: heads[(at + 1) % len(heads)][0] for at, (block, _) in enumerate(heads)}
    known = spark.createDataFrame(
        [(block, head[2], head[0], targets[block]) for block, head in heads], "block int, _hash long, _key double, target int"
    )
    joined = rows.join(F.broadcast(known), ["block", "_hash", "_key"], "left")
    own, guest = F.struct("block", F.lit(False).alias("guest")), F.struct(F.col("target").alias("block"), F.lit(True).alias("guest"))
    spread = joined.withColumn("_place", F.explode(F.when(F.col("target").isNull(), F.array(own)).otherwise(F.array(own, guest))))
    made = spread.select("doc_id", "text", "_hash", "_key", F.col("_place.block").alias("block"), F.col("_place.guest").alias("guest"))
    window = Window.partitionBy("block").orderBy(
        "guest", F.desc("_key"), F.desc_nulls_last("doc_id"), F.desc("_hash"), F.desc("text")
    )
    return made, window


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of every text and of its edit, and likenesses.

    The edit replaces the last floor(n_chars / 2) code points by as many of the next document's first, or all it has.
    A null text is empty. Columns: doc_id, n_chars, edited, prints, edited_prints, near_edited, near_next. Other
    columns of the input are left behind; a lone row is its own successor; an empty table gives no rows.
    """
    rows, window = with_next(docs, id_col, text_col)
    paired = rows.withColumn("_next", F.lead("text").over(window))
    half = F.floor(F.char_length("text") / 2).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), F.char_length("text") - half)
    edited = F.concat(kept, F.substring(F.coalesce("_next", F.lit("")), F.lit(1), half))
    told = paired.select(
        "doc_id", "guest", "block", "_key", "_hash", "text", F.char_length("text").cast("long").alias("n_chars"), edited.alias("edited"),
        prints(F.col("text"), k, w).alias("prints"),
    )
    told = told.withColumn("_next_prints", F.lead("prints").over(window)).filter(~F.col("guest"))
    told = told.withColumn("edited_prints", prints(F.col("edited"), k, w))
    return told.select(
        "doc_id", "n_chars", "edited", "prints", "edited_prints",
        likeness(F.col("prints"), F.col("edited_prints")).alias("near_edited"),
        likeness(F.col("prints"), F.col("_next_prints")).alias("near_next"),
    )
