"""Quality scores by a logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A token is a longest run of letters, digits and bytes beyond ASCII, or of other
marks; case counts.  Tokens and pairs of neighbours are hashed to ``2**BITS``
places, and a text is its sparse vector of counts, scaled to length 1.  A score is the
logistic function of the sparse dot product with the weights.

Training takes at most ``FIT_ROWS / 2`` labelled ids of each class (a sample by
hash of the id, written once as sparse vectors), dealt to ``SHARDS`` shards.  In each of
``ROUNDS`` rounds every shard goes through its rows in a task of its own, one update a
row, from the state that all shards ended the round before with; what each
adds to the gradient sums and to the squares is added up, at most ``2**BITS``
places a shard.  A class of which only a part was taken has its odds put back in
the constant.  Everything else covers all rows: the tables behind the sample and the scores.

Defined results: null and empty texts have no tokens and score by the constant alone.
Without labelled documents of both classes every score is the share of label 1, 0
without labels.  Labels that are null or not 0 or 1 count for nothing; of several labels of one id
the most frequent counts, 1 on a tie; of several texts of one id one, by hash.
Repeated rows score alike.  A text longer than a block is counted block by block; only its
counts, at most ``2**BITS``, stay in memory.  Extra columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.llm.batches import small_batches
from sondage.llm.sieve import sieve
from sondage.llm.words import Hasher, mix, text_bytes, word_blocks
from sondage.plans.durable import materialise

BITS = 20
FIT_ROWS = 32768
SHARDS = 8
ROUNDS = 4
#: Step size, its start, and the two penalties; the constant has none.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.1, 0.1
_PAIR = np.uint64(0xD6E8FEB86659FD93)
_KINDS = np.full(256, 2, dtype=np.uint8)
_KINDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KINDS[[0x20, *range(0x09, 0x0E)]] = 0


def vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of ``(text, place, count)``, sorted, of the tokens and pairs; every text that has tokens lies in one block."""
    offsets = text_bytes(column)[1]
    held, last, before = None, -1, np.zeros(0, dtype=np.uint64)
    for hashes, begin in word_blocks(column, Hasher(7, fold=False), _KINDS):
        if not len(hashes):
            continue
        owner = np.searchsorted(offsets, begin, side="right") - 1
        joined = np.concatenate((before, hashes))
        pairs = mix(joined[:-1] * _PAIR + mix(joined[1:]))
        owners = np.concatenate((np.full(len(before), last), owner))
        same = owners[1:] == owners[:-1]
        place = (np.concatenate((hashes, pairs[same])) >> np.uint64(64 - BITS)).astype(np.int64)
        key, count = np.unique(np.concatenate((owner, owners[1:][same])) << BITS | place, return_counts=True)
        if held is not None:
            key, back = np.unique(np.concatenate((held[0], key)), return_inverse=True)
            count = np.bincount(back, np.concatenate((held[1], count))).astype(np.int64)
        # The last text may go on in the next block.
        last, before = int(owner[-1]), hashes[-1:]
        edge = int(np.searchsorted(key, last << BITS))
        held = key[edge:], count[edge:]
        if edge:
            yield key[:edge] >> BITS, key[:edge] & (1 << BITS) - 1, count[:edge]
    if held is not None:
        yield held[0] >> BITS, held[0] & (1 << BITS) - 1, held[1]


def _texts(text: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each text of a block begins, and the values of its places."""
    edge = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
    size = np.sqrt(np.add.reduceat(count.astype(np.float64) ** 2, edge))
    return edge, count / np.repeat(size, np.diff(np.append(edge, len(text))))


class Leader:
    """State of the updates: by place, the last one being the constant, gradient sums ``z`` and sums of squares ``n``."""

    def __init__(self):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, places) -> np.ndarray:
        z, n = self.z[places], self.n[places]
        free = np.arange(len(self.z))[places] == 1 << BITS
        l1, l2 = np.where(free, 0, L1), np.where(free, 0, L2)
        return np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + l2))

    def update(self, places: np.ndarray, values: np.ndarray, target: int) -> None:
        """One row; ``places`` differ from each other."""
        places, values = np.append(places, 1 << BITS), np.append(values, 1.0)
        w = self.weights(places)
        g = (1 / (1 + np.exp(-np.clip(w @ values, -30, 30))) - target) * values
        n = self.n[places]
        self.z[places] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[places] = n + g * g


class Model:
    """Weights by place (None where nothing could be trained) with the constant, and the share of label 1."""

    def __init__(self, weights: np.ndarray | None = None, constant: float = 0.0, share: float = 0.0):
        self.weights, self.constant, self.share = weights, constant, share

    def score(self, column: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.full(len(column), self.share)
        total = np.full(len(column), self.constant)
        for text, place, count in vectors(column):
            edge, value = _texts(text, count)
            total[text[edge]] += np.add.reduceat(self.weights[place] * value, edge)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _sample(documents: DataFrame, marks: DataFrame) -> DataFrame:
    """``(key, target, text)`` of a table ``(key, text)`` for the chosen ids ``(key, target)``."""
    texts = documents.join(F.broadcast(marks), "key")
    return texts.select("key", "target", F.xxhash64("text").alias("mark"), "text")


def _rows(batches):
    for batch in batches:
        places, values = [np.zeros(0, dtype=np.int32)] * batch.num_rows, [np.zeros(0, dtype=np.float32)] * batch.num_rows
        for text, place, count in vectors(batch.column(3)):
            edge, value = _texts(text, count)
            for i, a, b in zip(text[edge], edge, np.append(edge[1:], len(text))):
                places[i], values[i] = place[a:b].astype(np.int32), value[a:b].astype(np.float32)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))],
            ["key", "target", "mark", "places", "values"])


def _round(rows: DataFrame, state: Leader) -> list:
    """What each shard adds: ``(shard, places, z, n)`` in the order of the shards."""
    start = rows.sparkSession.sparkContext.broadcast((state.z, state.n))

    def run(batches):
        at, leader = None, None

        def ended():
            touched = np.flatnonzero(leader.n != start.value[1])
            return pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int32()), *[pa.array([x], pa.list_(kind)) for x, kind in (
                    (touched, pa.int64()), ((leader.z - start.value[0])[touched], pa.float64()),
                    ((leader.n - start.value[1])[touched], pa.float64()))]],
                ["shard", "places", "z", "n"])

        for batch in batches:
            shard, target = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(batch.num_rows):
                if shard[i] != at:
                    if leader is not None:
                        yield ended()
                    at, leader = shard[i], Leader()
                    leader.z, leader.n = start.value[0].copy(), start.value[1].copy()
                leader.update(*[batch.column(c)[i].values.to_numpy() for c in (2, 3)], target[i])
        if leader is not None:
            yield ended()

    dealt = rows.repartition("shard").sortWithinPartitions("shard", "place").select("shard", "target", "places", "values")
    added = dealt.mapInArrow(run, "shard int, places array<long>, z array<double>, n array<double>").toArrow()
    start.destroy()
    order = np.argsort(added["shard"].to_numpy())
    return [[added[c][int(i)].values.to_numpy() for c in ("places", "z", "n")] for i in order]


def fit(documents: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> Model:
    """The model of all documents that ``labels (key, label)`` marks."""
    spark = documents.sparkSession
    marks = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("target")).where(
        "key IS NOT NULL AND target IN (0, 1)")
    marks = marks.groupBy("key").agg((F.avg("target") >= 0.5).cast("int").alias("target"))
    bodies = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    ids = sieve(bodies.select("key"), F.col("key"), materialise(marks, "marks"))
    present = materialise(marks.join(ids, "key", "left_semi"), "labelled")
    number = {r[0]: r[1] for r in present.groupBy("target").count().collect()}
    if len(number) < 2:
        return Model(share=float(max(number, default=0)))
    order = F.xxhash64(F.lit("quality"), F.col("key"))
    # At most FIT_ROWS ids: a broadcast of bounded size.
    chosen = [present.where(F.col("target") == c).orderBy(order, "key").limit(FIT_ROWS // 2) for c in (0, 1)]
    chosen = materialise(chosen[0].unionAll(chosen[1]), "chosen")
    with small_batches(spark):
        made = _sample(bodies, chosen).mapInArrow(
            _rows, f"key {marks.schema['key'].dataType.simpleString()}, target int, mark long, places array<int>, values array<float>")
        one = made.groupBy("key").agg(F.min(F.struct("mark", "target", "places", "values")).alias("x"))
        rows = materialise(one.select(
            F.pmod(order, F.lit(SHARDS)).cast("int").alias("shard"), order.alias("place"), "x.target", "x.places", "x.values"), "vectors")
        state = Leader()
        for _ in range(ROUNDS):
            for places, z, n in _round(rows, state):
                state.z[places] += z
                state.n[places] += n
    weights = state.weights(slice(None))
    taken = {c: min(number[c], FIT_ROWS // 2) for c in number}
    constant = weights[-1] + np.log(number[1] / taken[1]) - np.log(number[0] / taken[0])
    return Model(weights[:-1].astype(np.float32), float(constant), number[1] / (number[0] + number[1]))


def scores(df: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, score)`` per row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(batch.column(1)))], ["k", "score"])

    kind = df.schema[key].dataType.simpleString()
    found = df.select(F.col(key).alias("k"), F.col(text).alias("body")).mapInArrow(run, f"k {kind}, score double")
    # Written at once: a few bytes a row, and the texts go to Python in small batches.
    with small_batches(df.sparkSession):
        return materialise(found, "scores").withColumnRenamed("k", key)
