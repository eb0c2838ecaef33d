"""Audit of how filters interact: what each one removes in every order, from additive counts of failure masks.

Every document gets one bit per filter that it fails.  All the figures of all
orders follow from the numbers of documents by part and mask, which add up, so one
aggregation answers every order.

One filter, exact duplicates, needs other documents.  A blocked counting Bloom
sketch goes first: the 64-bit hash of a text names a block of 32,768 counters and
``PROBES`` of them; partial counts are merged by counter, and the counters that at least two
documents share become one bitmap a block.  A text with a counter of its own
is guaranteed unique and leaves.  Only texts that may be repeated are shuffled whole,
to find the smallest id of each text itself, not of its hash.  There are
``COUNTERS`` counters a document, so the sketch grows with the table and clears the same share at every size.

Copies of one text, whatever their share of the rows, meet as partial
aggregates: counts by part, mask and label for each hash with the smallest id.  Texts that
share a hash but are not equal, if there are any, are told apart by the text.

Defined results: null text counts as empty; a null part is the empty string.  A null id
counts as the largest.  Rows with the id of a text's first document do not
fail as its duplicates, so repeated rows of that id all stay; each row counts.  A
document has a label if any row of ``labels`` with its id has it, none with a null id.  An empty table
gives no rows.  Extra columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.llm.sieve import sieve
from sondage.plans.durable import materialise

COUNTERS, PROBES = 16, 2
#: Counters of a block: what a bitmap of ``bitmap_construct_agg`` holds.
BLOCK = 1 << 15
_LAST = (1 << 63) - 1
_SPACES = "\t\n\x0b\x0c\r"


def text_filters(text: Column) -> dict[str, Column]:
    """The failure conditions that a text decides alone, by letter; the text is not null."""
    words = F.filter(F.split(F.translate(text, _SPACES, " " * len(_SPACES)), " "), lambda w: w != "")
    count, kinds = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": count < 100,
        "B": kinds * 100 < count * 80,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 10,
        "D": text.rlike("[#$%&*|]"),
    }


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def _sketch(rows: DataFrame, blocks: int) -> DataFrame:
    """``(block, bits)``: the counters that at least two rows of ``(hash)`` share."""
    counted = rows.select(_block(F.col("hash"), blocks).alias("block"), F.explode(F.array_distinct(_places(F.col("hash")))).alias("place"))
    shared = counted.groupBy("block", "place").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return shared.groupBy("block").agg(F.bitmap_construct_agg(F.col("place")).alias("bits"))


def _block(value: Column, blocks: int) -> Column:
    return F.pmod(F.shiftright(value, 30), F.lit(blocks))


def _places(value: Column) -> Column:
    return F.array(*[F.shiftright(value, 15 * i).bitwiseAND(F.lit(BLOCK - 1)) for i in range(PROBES)])


def _is_set(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (place.bitwiseAND(F.lit(7)) + 1).cast("int"))) != 0


def maybe_repeated(rows: DataFrame) -> DataFrame:
    """``rows``, which have a ``hash``, with ``maybe``: false if no other row has this hash for certain."""
    blocks = max(1, -(-COUNTERS * rows.count() // BLOCK))
    sketch = materialise(_sketch(rows, blocks), "sketch")
    held = rows.withColumn("block", _block(F.col("hash"), blocks)).join(sketch, "block", "left")
    hit = F.col("bits").isNotNull()
    for i in range(PROBES):
        hit = hit & _is_set(F.col("bits"), _places(F.col("hash"))[i])
    return held.select(*rows.columns, F.coalesce(hit, F.lit(False)).alias("maybe"))


def first_ids(df: DataFrame, maybe: DataFrame, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """The smallest id of each text that may be repeated: ``(hash, first)``, and ``(hash, text, first)`` where a hash has several texts.

    ``maybe`` has the hashes of such texts; only rows with one of them are shuffled.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    bodies = df.select(text_hash(body).alias("hash"), body.alias("text"), F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("owner"))
    some = sieve(bodies, F.col("hash"), maybe.select("hash").distinct())
    firsts = materialise(some.groupBy("hash", "text").agg(F.min("owner").alias("first")), "first-ids")
    kinds = firsts.groupBy("hash").agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first"))
    several = firsts.join(kinds.where("texts > 1").select("hash"), "hash")
    return kinds.where("texts = 1").select("hash", "first"), several


def mask_counts(
    df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "lang",
    marks: Mapping[str, str] = {"good": "quality", "toxic": "toxic"},
) -> DataFrame:
    """``(part, mask, n, ...)``: documents per part and set of failed filters, and those with each label of ``marks``.

    Bit i of ``mask`` stands for the i-th letter; the last one, E, for a text that a smaller id has.
    """
    rows = materialise(_masked(df, text, key, part).drop("text"), "masks")
    copy_bit = 1 << len(text_filters(F.lit("")))
    marked = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("owner")).agg(
        *[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(name) for name, c in marks.items()])
    joined = materialise(_with_marks(maybe_repeated(rows), marked), "flags")
    by = ["part", "mask", *marks]
    alone = joined.where(~F.col("maybe")).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))

    doubtful = joined.where("maybe")
    firsts, several = first_ids(df, doubtful, text, key)
    # Copies meet as counts: rows, the smallest id and how many rows have it.
    ids = doubtful.groupBy("hash", *by, "owner").agg(F.count(F.lit(1)).alias("n"))
    groups = ids.groupBy("hash", *by).agg(F.sum("n").alias("n"), F.min(F.struct("owner", "n")).alias("least"))
    tied = groups.join(firsts, "hash").select(
        *by, "n", F.when(F.col("least.owner") == F.col("first"), F.col("least.n")).otherwise(F.lit(0)).alias("stays"))
    found = alone.unionByName(_split(tied, by, copy_bit))
    if several.take(1):
        # Texts that differ and share a hash: these few rows go with their texts.
        several = materialise(several, "collisions")
        some = sieve(_masked(df, text, key, part), F.col("hash"), several.select("hash").distinct()).join(several, ["hash", "text"])
        each = _with_marks(some.drop("text"), marked).groupBy(*by).agg(
            F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("owner") == F.col("first"), 1)).alias("stays"))
        found = found.unionByName(_split(each, by, copy_bit))
    return found.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(name)).alias(name) for name in marks])


def _split(groups: DataFrame, by: list[str], copy_bit: int) -> DataFrame:
    """Counts of the rows that stay and of those that fail as copies."""
    two = F.array(F.struct(F.lit(0).alias("bit"), F.col("stays").alias("n")),
                  F.struct(F.lit(copy_bit).alias("bit"), (F.col("n") - F.col("stays")).alias("n")))
    cut = groups.select(*by, F.inline(two)).where("n > 0")
    return cut.withColumn("mask", F.col("mask") + F.col("bit")).groupBy(*by).agg(F.sum("n").alias("n"))


def _masked(df: DataFrame, text: str, key: str, part: str) -> DataFrame:
    """``(owner, nameless, part, hash, mask, text)`` per row, with the bits of the filters that the text decides alone."""
    body = F.coalesce(F.col(text), F.lit(""))
    named = df.select(
        F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("owner"), F.col(key).isNull().alias("nameless"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_hash(body).alias("hash"), body.alias("text"),
        *[c.alias(f"_{letter}") for letter, c in text_filters(body).items()])
    bits = [F.when(F.col(f"_{letter}"), 1 << i).otherwise(0) for i, letter in enumerate(text_filters(body))]
    return named.select("owner", "nameless", "part", "hash", sum(bits[1:], bits[0]).alias("mask"), "text")


def _with_marks(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """``rows`` with a 0 or 1 for each label of ``marked (owner, ...)``."""
    names = marked.columns[1:]
    return rows.join(marked, "owner", "left").select(
        *rows.drop("nameless").columns, *[F.when(F.col("nameless"), 0).otherwise(F.coalesce(n, F.lit(0))).alias(n) for n in names])


def interactions(counts: DataFrame, letters: str = "ABCDE", marks: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """One row per part, order of the filters and step, from :func:`mask_counts`.

    A part has at most ``2 ** len(letters)`` masks, so a row per part, step and mask is bounded.
    """
    steps = []
    for order in permutations(letters):
        before = 0
        for step, letter in enumerate(order):
            bit = 1 << letters.index(letter)
            steps.append(("".join(order), step + 1, bit, before))
            before |= bit
    names = ["filter_order", "step", "bit", "before"]
    orders = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in steps])
    # The filter that comes first among those a document fails removes it: each of them in an equal share of the orders.
    share = F.lit(len(steps) // len(letters)) / F.bit_count("mask")
    n, mask, bit, before = (F.col(c) for c in ("n", "mask", "bit", "before"))
    fails, earlier = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) != 0
    removed = fails & ~earlier

    def total(condition: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast("long")

    return counts.select("*", F.inline(orders)).groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier, n).alias("kept"), total(removed, n).alias("removed"), total(fails & earlier, n).alias("redundant"),
        total(mask == bit, n).alias("unique_fails"), *[total(removed, F.col(m)).alias(f"{m}_lost") for m in marks],
        F.coalesce(F.round(F.sum(F.when(fails, n * share))), F.lit(0)).cast("long").alias("shapley"))
