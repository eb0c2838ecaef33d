"""Mixing of sources to target weights by repetition.

Word counts are summed per source.  Sources in code-point order, null last,
weigh 1, 2, 3 and so on in turn and share the total; a target stops at
``MAX_REPEAT`` times its source's size, and the excess is shared anew by weight.
That water filling has a closed form: in the order of size over weight the
saturated sources come first, so one running sum finds the level.

A document is taken floor(rate) times, and once more if a number drawn from
the hash of the seed and its id lies below the fraction.  No copy depends on
the place of a row, so reruns agree.

Defined results: null or empty text has size 0; a source of size 0 has target 0 and is not
taken; null is a source of its own; a null id draws by the word ``null``;
repeated rows draw alike.  Only one row per source is ordered; nothing is
gathered per source but sums, whatever its share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.plans.durable import materialise
from sondage.plans.ordering import number_rows, running

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
_DRAWS = float(1 << 52)


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def draw(key: str, seed: str) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 hash."""
    name = F.concat(F.lit(f"{seed}-"), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") / F.lit(_DRAWS)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``(source, source_size, target)`` per source of a ``(source, size)`` table."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = number_rows(totals.withColumn("absent", F.col("source").isNull()), ["absent", "source"], name="place")
    turn = F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int")
    weighed = ranked.select(
        "source", "absent", "source_size",
        F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), turn + 1).alias("weight"),
    ).withColumn("ratio", F.col("source_size") / F.col("weight")).withColumn("cap", F.col("source_size") * max_repeat)
    level = materialise(
        running(weighed, ["ratio", "absent", "source"], sums={"cap_sum": "cap", "weight_sum": "weight"}), "mix-level")
    all_of = level.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w")).first()
    total, weight = all_of["t"] or 0, all_of["w"] or 0
    share = (F.lit(total) - F.col("cap_sum") + F.col("cap")) / (F.lit(weight) - F.col("weight_sum") + F.col("weight"))
    # The first source, in this order, that its share does not fill sets the level; its rank decides, one row comes back.
    first = level.withColumn("share", share).where(F.col("cap") > F.col("share") * F.col("weight"))
    lowest = first.agg(F.min_by("share", "rn").alias("share")).first()["share"]
    target = F.col("cap").cast("double")
    if lowest is not None:
        target = F.least(target, F.lit(lowest) * F.col("weight"))
    return level.select("source", "source_size", target.alias("target"))


def with_copies(sized: DataFrame, targets: DataFrame, key: str = "doc_id", seed: str = "mix") -> DataFrame:
    """Add ``source_size``, ``target`` and ``copies`` to a table that has ``source``, ``size`` and ``key``."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    extra = (draw(key, seed) < rate - whole).cast("long")
    named = targets.select(F.col("source").alias("_source"), "source_size", "target")
    joined = sized.join(named, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    return joined.withColumn("copies", whole.cast("long") + extra)


def mix(
    df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id",
    weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = "mix",
) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it.  Columns and names stay as they are."""
    sizes = df.select(F.col(source).cast("string").alias("source"), word_count(text).alias("size"))
    targets = materialise(source_targets(sizes, weights, max_repeat), "mix-targets")
    sized = df.select(F.struct("*").alias("row"), F.col(source).cast("string").alias("source"),
                      F.col(key).alias("key"), F.lit(0).alias("size"))
    taken = with_copies(sized, targets, "key", seed)
    times = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return taken.select("row", times.alias("_copy")).select("row.*")
