"""Exact Jaccard join of shingle sets by PartEnum signatures.

Sets of similar size share a size band.  Inside a band a wanted similarity
bounds the number k of shingles two sets may differ in.  The shingles' domain
is cut into n1 groups of n2 parts: of k differences some group has at most
k // n1 = k2, so some choice of n2 - k2 of its parts holds none.  Each such
choice gives one signature, the hash of the shingles there; two sets as similar as
wanted always share one.

Equal sets are one set from the start.  Sets that share a signature are first
compared with one leader: whoever links to it belongs to its component and
needs no more pairs inside it, so a group of n near copies costs n pairs.  While
such rounds join many sets they go on, with new leaders.  What is left of
the groups, sets that share a signature but no component, is compared pair by
pair in blocks of bounded size on parity bitmaps: bit h counts, modulo 2, the shingles
that hash to it, so two bitmaps differ in no more bits than the sets in
shingles.  Only pairs that this bound lets through leave their task, and
are verified on the shingles themselves: at first the closest pair of any two
components, which joins most that belong together, and then all that are left.

Sets are identified by 64-bit hashes (of shingles and of whole sets): among a
billion sets the chance that any two different ones are taken for one is about 3 %.

Defined results: null and empty texts and texts without words have no
shingles and stay alone; a text of fewer words than a shingle has the whole sequence as one.  A
null id is never the smallest unless a component has no other; repeated rows are equal sets.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.llm.batches import small_batches, tidy
from sondage.llm.components import components
from sondage.llm.sieve import sieve
from sondage.llm.words import Hasher, mix, pieces, word_hashes
from sondage.plans.durable import materialise

#: Rounds with leaders go on while a round joins this share of the sets at hand.
WORTH = 0.05
#: Rows of a block, and bits of the smallest and the largest parity bitmap.
BLOCK_ROWS = 1024
BITS = 256, 16384
#: Distinct sets a task remembers, so that copies send their signatures once a task.
REMEMBERED = 500_000
#: Signatures that go back to Spark at once.
SIGNATURE_ROWS = 500_000
_LAST = (1 << 63) - 1
_TAG = np.uint64(0x9E3779B97F4A7C15)


def _times(count: int) -> np.uint64:
    return np.uint64(int(count) * int(_TAG) & (1 << 64) - 1)


def shingle_sets(column: pa.Array, width: int, hasher: Hasher):
    """The sorted distinct shingle hashes of each text, some megabytes at a time."""
    for piece in pieces(column):
        yield from _piece_sets(piece, width, hasher)


def _piece_sets(column: pa.Array, width: int, hasher: Hasher):
    words, offsets = word_hashes(column, hasher)
    factors = mix(np.arange(1, width + 1, dtype=np.uint64) * _TAG) | np.uint64(1)
    full = max(len(words) - width + 1, 0)
    sums = np.zeros(full, dtype=np.uint64)
    for j in range(width):
        sums += words[j : j + full] * factors[j]
    sums = mix(sums)
    for at, to in zip(offsets[:-1], offsets[1:]):
        count = to - at
        if count >= width:
            yield np.unique(sums[at : to - width + 1])
        elif count:
            yield mix((words[at:to] * factors[:count]).sum(keepdims=True) + _times(count))
        else:
            yield np.zeros(0, dtype=np.uint64)


def set_hash(shingles: np.ndarray) -> int:
    """One signed long for a whole set; 0 for the empty one."""
    if not len(shingles):
        return 0
    total = mix(shingles).sum(keepdims=True) + _times(len(shingles))
    return int(mix(total).view(np.int64)[0])


class Signatures:
    """Size bands and signatures for Jaccard similarities of ``percent`` or more."""

    def __init__(self, percent: int):
        self.percent = percent
        self.tops = [0, 1]
        self.plans: dict[int, tuple] = {}

    def band(self, size: int) -> int:
        while self.tops[-1] < size:
            self.tops.append((self.tops[-1] + 1) * 100 // self.percent)
        return int(np.searchsorted(self.tops, size))

    def _plan(self, band: int) -> tuple | None:
        """Edges of the domain's parts and the chosen parts of each signature, for sets of ``band`` and the one below."""
        if band not in self.plans:
            self.band(self.tops[-1] + 1) if band >= len(self.tops) else None
            k = (self.tops[band - 1] + self.tops[band]) * (100 - self.percent) // (100 + self.percent)
            # (groups, differences left to a group, parts of a group)
            n1, k2, n2 = (1, k, k + 2) if k < 3 else (k // 2 + 1, 1, 3)
            parts = n1 * n2
            edges = (np.arange(parts + 1, dtype=np.float64) * (2.0**64 / parts))[1:-1].astype(np.uint64)
            picks = np.array(list(combinations(range(n2), n2 - k2)))
            chosen = (np.arange(n1)[:, None, None] * n2 + picks[None]).reshape(-1, n2 - k2)
            tags = mix(np.arange(len(chosen), dtype=np.uint64) * _TAG + np.uint64(band * 7919 + 1))
            factors = mix(np.arange(1, n2 - k2 + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
            # Without a difference only equal sets are left, which are one set already.
            self.plans[band] = (edges, chosen, tags, factors) if k else None
        return self.plans[band]

    def of(self, shingles: np.ndarray) -> np.ndarray:
        own = self.band(len(shingles))
        sums = np.zeros(len(shingles) + 1, dtype=np.uint64)
        np.cumsum(mix(shingles + _TAG), out=sums[1:])
        out = []
        for band in (own, own + 1):
            plan = self._plan(band)
            if plan is None:
                continue
            edges, chosen, tags, factors = plan
            cut = np.concatenate(([0], np.searchsorted(shingles, edges), [len(shingles)]))
            parts = sums[cut[1:]] - sums[cut[:-1]]
            out.append(mix((parts[chosen] * factors).sum(axis=1) + tags))
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def parity(shingles: np.ndarray) -> bytes:
    """The parity bitmap of a set: about two bits a shingle, a power of two."""
    bits = min(max(1 << int(2 * len(shingles) - 1).bit_length(), BITS[0]), BITS[1])
    return np.packbits(np.bincount((mix(shingles) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def _fold(bitmaps: list[bytes], size: int) -> np.ndarray:
    """Bitmaps of ``size`` bytes as rows of words; a larger one is folded, which adds up its parities."""
    out = np.empty((len(bitmaps), size), dtype=np.uint8)
    for i, b in enumerate(bitmaps):
        row = np.frombuffer(b, dtype=np.uint8)
        out[i] = row if len(row) == size else np.bitwise_xor.reduce(row.reshape(-1, size), axis=0)
    return out.view(np.uint64)


def _near(sets, sizes, parts, bitmaps, sides, percent, closest):
    """The pairs of one block whose bitmaps do not rule out a link: (smaller set, larger set).

    With ``closest``, only the closest such pair of each two components.
    """
    words = _fold(bitmaps, min(map(len, bitmaps)))
    within = sides.min() == sides.max()
    left = np.flatnonzero(sides == sides.min())
    found = []
    for at, i in enumerate(left):
        others = left[at + 1 :] if within else np.flatnonzero(sides != sides[i])
        others = others[parts[others] != parts[i]]
        if not len(others):
            continue
        apart = np.bitwise_count(words[others] ^ words[i]).sum(axis=1, dtype=np.int64)
        both = sizes[others] + sizes[i]
        low = np.minimum(sizes[others], sizes[i])
        close = (apart * (100 + percent) <= both * (100 - percent)) & (low * 100 >= (both - low) * percent)
        others, apart, both = others[close], apart[close], both[close]
        found.append(np.stack([np.full(len(others), i), others, apart * 1000000 // both]))
    if not found:
        return np.zeros((2, 0), dtype=np.int64)
    i, j, apart = np.concatenate(found, axis=1)
    if closest and len(i):
        low, high = np.minimum(parts[i], parts[j]), np.maximum(parts[i], parts[j])
        order = np.lexsort((apart, high, low))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
        i, j = i[order[new]], j[order[new]]
    return np.stack([np.minimum(sets[i], sets[j]), np.maximum(sets[i], sets[j])])


def _identity(text: str, key: str):
    return F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("owner"), F.xxhash64(F.col(text)).alias("body")


def sets(df: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """``(owner, body, n_shingles, set)`` per row; ``set`` identifies its shingle set."""

    def run(batches):
        hasher = Hasher(3)
        for batch in tidy(batches):
            found = [(len(s), set_hash(s)) for s in shingle_sets(batch.column(2), width, hasher)]
            sizes, hashes = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(hashes, pa.int64())],
                ["owner", "body", "n_shingles", "set"])

    return df.select(*_identity(text, key), F.col(text).alias("text")).mapInArrow(
        run, "owner long, body long, n_shingles long, `set` long")


def _shared(df: DataFrame, text: str, width: int, percent: int) -> DataFrame:
    """``(signature, set)`` of the signatures that more than one set has."""

    def make(batches):
        hasher, signatures, met = Hasher(3), Signatures(percent), set()
        for batch in tidy(batches):
            held, owners, lengths, waiting = [], [], [], 0

            def ready():
                return pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(held).view(np.int64)), pa.array(np.repeat(np.array(owners, dtype=np.int64), lengths))],
                    ["signature", "set"])

            for shingles in shingle_sets(batch.column(0), width, hasher):
                name = set_hash(shingles)
                if not name or name in met:
                    continue
                if len(met) >= REMEMBERED:
                    met.clear()
                met.add(name)
                found = signatures.of(shingles)
                held.append(found)
                owners.append(name)
                lengths.append(len(found))
                waiting += len(found)
                if waiting >= SIGNATURE_ROWS:
                    yield ready()
                    held, owners, lengths, waiting = [], [], [], 0
            if held:
                yield ready()

    def keep_shared(batches):
        """Sorted rows in; one row per (signature, set) of the signatures with two sets at least."""
        waiting, known = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            sign, name = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if waiting is not None:
                sign, name = np.concatenate((waiting[:1], sign)), np.concatenate((waiting[1:], name))
            new = np.ones(len(sign), dtype=bool)
            new[1:] = (sign[1:] != sign[:-1]) | (name[1:] != name[:-1])
            if known is not None:
                new[0] = (sign[0], name[0]) != known
            sign, name = sign[new], name[new]
            if not len(sign):
                continue
            twin = np.zeros(len(sign), dtype=bool)
            twin[1:] = sign[1:] == sign[:-1]
            twin[:-1] |= twin[1:]
            twin[0] |= known is not None and known[0] == sign[0]
            # The last row may still find a twin in the next batch.
            last = len(sign) - 1
            if twin[last]:
                waiting, known, take = None, (sign[last], name[last]), np.flatnonzero(twin)
            else:
                waiting, known, take = np.array([sign[last], name[last]]), None, np.flatnonzero(twin[:last])
            if len(take):
                yield pa.RecordBatch.from_arrays([pa.array(sign[take]), pa.array(name[take])], ["signature", "set"])

    made = df.select(F.col(text).alias("text")).mapInArrow(make, "signature long, `set` long")
    dealt = made.repartition("signature").sortWithinPartitions("signature", "set")
    return materialise(dealt.mapInArrow(keep_shared, "signature long, `set` long"), "signatures")


def _shingles(df: DataFrame, wanted: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """``(set, n, shingles, bitmap)`` of the sets whose first ``(owner, body)`` is in ``wanted``."""

    def run(batches):
        hasher = Hasher(3)
        for batch in tidy(batches):
            found = list(shingle_sets(batch.column(1), width, hasher))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(map(len, found)), pa.int32()),
                 pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64())),
                 pa.array(list(map(parity, found)), pa.binary())], ["set", "n", "shingles", "bitmap"])

    some = sieve(df.select(*_identity(text, key), F.col(text).alias("text")), F.col("owner"), wanted.select("owner"))
    # Repeated rows go while they are texts: the join has them together already.
    joined = some.join(wanted, ["owner", "body"]).dropDuplicates(["owner", "body"]).select("set", "text")
    return joined.mapInArrow(run, "`set` long, n int, shingles array<long>, bitmap binary")


def _links(pairs: DataFrame, shingles: DataFrame, percent: int, passed: bool = False) -> DataFrame:
    """The pairs ``(a, b)`` that are as similar as wanted, by their shingles; before, by the bitmaps unless they ``passed``."""
    if not passed:
        bits = shingles.select("set", "bitmap", "n")

        @F.pandas_udf("boolean")
        def close(x: pd.Series, y: pd.Series, both: pd.Series) -> pd.Series:
            apart = [int(np.bitwise_count(np.bitwise_xor(*_fold([u, v], min(len(u), len(v))))).sum()) for u, v in zip(x, y)]
            return pd.Series(np.array(apart, dtype=np.int64) * (100 + percent) <= both.to_numpy() * (100 - percent), dtype=bool)

        left = bits.select(F.col("set").alias("a"), F.col("bitmap").alias("x"), F.col("n").alias("nx"))
        right = bits.select(F.col("set").alias("b"), F.col("bitmap").alias("y"), F.col("n").alias("ny"))
        both = F.col("nx") + F.col("ny")
        pairs = pairs.join(left, "a").join(right, "b").where(close("x", "y", both)).select("a", "b")
    # Most sets are in no pair that is left: theirs stay where they are.
    pairs = materialise(pairs, "close")
    asked = sieve(shingles.select("set", "shingles"), F.col("set"), pairs.select(F.explode(F.array("a", "b")).alias("set")))
    left = asked.select(F.col("set").alias("a"), F.col("shingles").alias("x"))
    right = asked.select(F.col("set").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(left, "a").join(right, "b")
        .select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("sum"))
        .where(F.col("both") * 100 >= (F.col("sum") - F.col("both")) * percent).select("a", "b"))


def _merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``(set, n, component, weight)`` after the links."""
    a = labels.select(F.col("set").alias("a"), F.col("component").alias("ca"))
    b = labels.select(F.col("set").alias("b"), F.col("component").alias("cb"))
    merged = components(links.join(a, "a").join(b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    moved = labels.join(merged.withColumnRenamed("component", "root"), F.col("component") == F.col("node"), "left")
    moved = moved.select("set", "n", F.coalesce("root", "component").alias("component"))
    weights = moved.groupBy("component").agg(F.count(F.lit(1)).alias("weight"))
    return materialise(moved.join(weights, "component").select("set", "n", "component", "weight"), "labels")


def _undecided(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """``groups`` with labels, without the signatures whose sets are of one component."""
    rows = groups.join(labels, "set")
    many = rows.groupBy("signature").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return materialise(rows.join(many.where("low != high").select("signature"), "signature"), "open")


def _block_pairs(rows: DataFrame, shingles: DataFrame, percent: int, closest: bool) -> DataFrame:
    """``(a, b)``: pairs of one signature and two components that the bitmaps let through."""
    sizes = rows.groupBy("signature").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    # Every row goes to the pairs of blocks that hold its own.
    own = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    dealt = (
        rows.join(sizes, "signature").join(shingles.select("set", "bitmap"), "set")
        .withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("signature", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                "own", "set", "n", "component", "bitmap"))
    keys = ["signature", "i", "j"]

    def compare(batches):
        held, at = [], None
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def decided():
            columns = list(zip(*held))
            pairs = _near(*(np.array(c) for c in columns[:3]), columns[3], np.array(columns[4]), percent, closest)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], schema=schema)

        for batch in batches:
            signs, first, second, own, names, n, part, bitmaps = (c.to_pylist() for c in batch.columns)
            for k, row in zip(zip(signs, first, second), zip(names, n, part, bitmaps, own)):
                if k != at:
                    if len(held) > 1:
                        yield decided()
                    held, at = [], k
                held.append(row)
        if len(held) > 1:
            yield decided()

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long").distinct()


def join(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """``(owner, body, n_shingles, component)`` per row of ``df``.

    Two texts link when the Jaccard similarity of their sets of ``width``-word
    shingles is ``percent`` / 100 or more; ``component`` names the sets that links
    join (null for a set without shingles).  ``owner`` is the id (the largest
    long for null) and ``body`` a hash of the text.
    """
    with small_batches(df.sparkSession):
        members = materialise(sets(df, text, key, width), "sets")
        groups = _shared(df, text, width, percent)
        first = members.where("n_shingles > 0").groupBy("set").agg(
            F.min(F.struct("owner", "body")).alias("at"), F.min("n_shingles").alias("n"))
        wanted = materialise(
            groups.select("set").distinct().join(first, "set").select("set", "at.owner", "at.body", "n"), "candidates")
        shingles = materialise(_shingles(df, wanted.select("owner", "body", "set"), text, key, width), "shingles")
    labels = wanted.select("set", "n", F.col("set").alias("component"), F.lit(1).cast("long").alias("weight"))
    while True:
        rows = _undecided(groups, labels)
        # Leaders come from the smallest components: what is large has its links already.
        leaders = rows.groupBy("signature").agg(F.min(F.struct("weight", "set", "component", "n")).alias("lead")).select(
            "signature", "lead.set", "lead.component", "lead.n")
        l, r = leaders.alias("l"), rows.alias("r")
        pairs = l.join(r, "signature").where("l.component != r.component").where(
            F.least("l.n", "r.n") * 100 >= F.greatest("l.n", "r.n") * percent).select(
            F.least("l.set", "r.set").alias("a"), F.greatest("l.set", "r.set").alias("b")).distinct()
        links = materialise(_links(pairs, shingles, percent), "links")
        joined, at_hand = links.count(), rows.select("set").distinct().count()
        if joined:
            labels = _merge(labels, links)
        # A leader has met all the sets of its signature.
        groups = rows.select("signature", "set").join(leaders.select("signature", "set"), ["signature", "set"], "left_anti")
        if joined <= WORTH * at_hand:
            break
    # First the closest pair of any two components; then, of those still apart, every pair.
    for closest in (True, False):
        rows = _undecided(groups, labels)
        links = materialise(_links(_block_pairs(rows, shingles, percent, closest), shingles, percent, True), "links")
        if links.take(1):
            labels = _merge(labels, links)
    named = members.join(labels.select("set", "component"), "set", "left")
    alone = F.when(F.col("n_shingles") > 0, F.coalesce("component", "set"))
    return named.select("owner", "body", "n_shingles", alone.alias("component"))


def classes(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """``(owner, body, n_shingles, smallest)`` per row: ``smallest`` is the smallest owner of the component."""
    found = materialise(join(df, text, key, width, percent), "classes")
    least = found.where("component is not null").groupBy("component").agg(F.min("owner").alias("smallest"))
    return found.join(least, "component", "left").select(
        "owner", "body", "n_shingles", F.coalesce("smallest", "owner").alias("smallest"))


def one_of_each(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """Of linked rows the one of smallest id, then body; rows that link with nothing stay, but repeated ones of an id once."""
    found = materialise(join(df, text, key, width, percent), "classes")
    alone = F.col("component").isNull()
    first = found.where(~alone).groupBy("component").agg(F.min(F.struct("owner", "body")).alias("first"))
    stays = first.select("first.owner", "first.body", F.lit(False).alias("alone")).unionAll(
        found.where(alone).select("owner", "body", F.lit(True)).distinct())
    rows = df.select(*_identity(text, key), F.col(key).isNull().alias("nameless"), F.struct("*").alias("row"))
    # Without an id no row repeats another.
    single = F.when(F.col("alone") & F.col("nameless"), F.monotonically_increasing_id())
    return rows.join(stays, ["owner", "body"]).withColumn("single", single).dropDuplicates(["owner", "body", "single"]).select("row.*")
