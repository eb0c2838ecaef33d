"""Toxicity scores from class-conditional Kneser-Ney models of bytes.

Two models, of toxic and of ordinary text, predict each byte of a word from the
four before it.  Their highest order has counts of its own class; every lower
order, which decides about rare expressions, has the Kneser-Ney continuation
counts that both classes share.  Counts come from all labelled rows, as one aggregate per
5-gram, so they grow with the labels.

What a task needs to score is the difference of the two log-likelihoods of
each 5-gram, and of each context with an unseen byte (there the shared part
cancels out).  The most frequent of both, at most ``MOST_GRAMS`` and
``MOST_CONTEXTS``, are broadcast under their whole keys.  Where there are more,
each text keeps sums over the words that these settle and a list of the other
words; the distinct 5-grams those wait for are joined with all differences, and
their values return to the rows: the commonest, at most ``MOST_ANSWERS``, by
broadcast and the others by a join in which no 5-gram has many rows.  Every
counted 5-gram is used whatever their number; only the broadcasts are bounded.

A text's features are length-normalised differences: over the whole text and
over its most toxic words.  A logistic regression turns them into a score; it is
fitted on at most ``FIT_ROWS / 2`` labelled ids of each class (a sample by hash of the id)
against models that have not seen those rows, and its constant is then moved
from the odds of the sample to those of all ids kept apart.  Where one class has no id kept apart,
the score is the logistic function of the length-normalised difference of the whole text, as of ``EVIDENCE`` bytes.

Defined results: null and empty texts have all features 0 and get the score that goes with
those (without a regression: the share of toxic labels).  Without counts of both classes every score is the share of
toxic labels, 0 without labels.  Labels that are
null count for nothing; several labels of one id all count in the models, and the regression takes
the label that most of them have, toxic on a tie; repeated rows score alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondage.llm.batches import small_batches, tidy
from sondage.llm.sieve import sieve, sieve_flag
from sondage.llm.words import text_bytes
from sondage.plans.durable import materialise

ORDER = 5
DISCOUNT = 0.75
MOST_GRAMS = 1 << 22
MOST_CONTEXTS = 1 << 21
MOST_ANSWERS = 1 << 20
FIT_ROWS = 8192
RIDGE = 1.0
#: Bytes that a text counts for where no regression can be fitted: some forty words.
EVIDENCE = 256
#: Bytes of text that are taken together: some fifteen arrays of eight bytes a symbol.
BLOCK = 1 << 18

#: Bytes of words, in lower case; 0x20 stands for what is between words.
_WORD = np.full(256, 0x20, dtype=np.uint8)
_WORD[97:123] = np.arange(97, 123)
_WORD[65:91] = np.arange(97, 123)
_WORD[128:] = np.arange(128, 256)


def grams(column: pa.Array):
    """Yields, by blocks of texts: the text of each symbol, its 5-gram as a long, and where words begin.

    The symbols are the bytes of words and the blank after each word.  A
    5-gram does not reach beyond the blank before its word.
    """
    data, offsets = text_bytes(column)
    texts, at = len(offsets) - 1, 0
    while at < texts:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, side="right")) - 1)
        # A blank after each text ends its last word.
        size = np.diff(offsets[at : to + 1])
        shift = np.arange(to - at)
        part = np.full(int(size.sum()) + to - at, 0x20, dtype=np.uint8)
        owner = np.repeat(shift, size + 1)
        body = np.ones(len(part), dtype=bool)
        body[np.cumsum(size + 1) - 1] = False
        part[body] = _WORD[data[offsets[at] : offsets[to]]]
        inside = part != 0x20
        before = np.concatenate(([False], inside[:-1]))
        take = inside | before
        starts = inside & ~before
        place = np.arange(len(part))
        first = np.maximum.accumulate(np.where(starts, place, 0))
        key = part.astype(np.int64)
        for j in range(1, ORDER):
            back = np.concatenate((np.full(min(j, len(part)), 0x20, dtype=np.uint8), part[:-j]))[: len(part)].astype(np.int64)
            reach = place - j - first
            key |= np.where(reach >= 0, back, np.where(reach == -1, 0x20, 0)) << (8 * j)
        kept = np.flatnonzero(take)
        yield at, owner[kept] + at, key[kept], starts[kept]
        at = to


def count_grams(labelled: DataFrame) -> DataFrame:
    """``(gram, c0, c1, f0, f1)`` of a table ``(text, toxic, fit)``: counts per class, over all rows and over those with ``fit``."""

    def run(batches):
        for batch in tidy(batches):
            toxic, fit = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            cell = toxic.astype(np.int64) * 2 + fit.astype(np.int64)
            for _, owner, key, _ in grams(batch.column(0)):
                seen, counts = np.unique(key << 2 | cell[owner], return_counts=True)
                cells = seen & 3
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seen >> 2), *[pa.array(np.where(keep, counts, 0)) for keep in
                                            (cells < 2, cells >= 2, cells == 1, cells == 3)]],
                    ["gram", "c0", "c1", "f0", "f1"])

    rows = labelled.select("text", "toxic", "fit").mapInArrow(run, "gram long, c0 long, c1 long, f0 long, f1 long")
    return rows.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("c0", "c1", "f0", "f1")])


def _shared(types: DataFrame) -> DataFrame:
    """``(low, shared)``: Kneser-Ney probability of each 4-gram's last byte, from the continuations of the distinct 5-grams."""
    below = types.select("gram")
    levels = {}
    for order in range(ORDER - 1, 0, -1):
        below = below.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1)).alias("gram")).agg(
            F.count(F.lit(1)).alias("n"))
        levels[order] = below
    all_of = W.partitionBy(F.lit(0))  # at most 256 rows
    known = levels[1].select("gram", ((F.col("n") + 0.5) / (F.sum("n").over(all_of) + 128)).alias("p"))
    for order in range(2, ORDER):
        context = W.partitionBy(F.shiftright("gram", 8))
        here = levels[order].select(
            "gram", "n", F.sum("n").over(context).alias("total"), F.count(F.lit(1)).over(context).alias("kinds"),
            F.col("gram").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1)).alias("below"))
        known = here.join(known.withColumnRenamed("gram", "below"), "below").select(
            "gram", ((F.col("n") - DISCOUNT + DISCOUNT * F.col("kinds") * F.col("p")) / F.col("total")).alias("p"))
    return known.select(F.col("gram").alias("low"), F.col("p").alias("shared"))


def _differences(counts: DataFrame, zero: str, one: str) -> tuple[DataFrame, DataFrame]:
    """``(gram, n, value)`` of the 5-grams and of the contexts: log-likelihood of toxic less that of ordinary."""
    types = counts.where((F.col(zero) > 0) | (F.col(one) > 0))
    context = W.partitionBy(F.shiftright("gram", 8))
    here = types.select("gram", zero, one, *[x for c in (zero, one) for x in (
        F.sum(c).over(context).alias(f"t_{c}"), F.count(F.when(F.col(c) > 0, 1)).over(context).alias(f"k_{c}"))])

    def rest(c):
        return F.when(F.col(f"t_{c}") > 0, F.lit(DISCOUNT) * F.col(f"k_{c}") / F.col(f"t_{c}")).otherwise(F.lit(1.0))

    def likely(c):
        own = F.when(F.col(f"t_{c}") > 0, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"t_{c}")).otherwise(F.lit(0.0))
        return own + rest(c) * F.col("shared")

    low = F.col("gram").bitwiseAND(F.lit((1 << 8 * (ORDER - 1)) - 1))
    seen = here.withColumn("low", low).join(_shared(types), "low").select(
        "gram", (F.col(zero) + F.col(one)).alias("n"), (F.log(likely(one)) - F.log(likely(zero))).cast("float").alias("value"))
    unseen = here.groupBy(F.shiftright("gram", 8).alias("gram")).agg(
        F.sum(F.col(zero) + F.col(one)).alias("n"), F.first(F.log(rest(one)) - F.log(rest(zero))).cast("float").alias("value"))
    return materialise(seen, "differences"), materialise(unseen, "contexts")


class Known:
    """Values by key, of the most frequent ``(gram, n, value)`` rows, at most ``most``; ``whole`` if that is all."""

    def __init__(self, rows: DataFrame, most: int):
        # Powers of 2**(1/8): some 500 steps at most come back.
        step = F.floor(F.log2("n") * 8)
        sizes = sorted((tuple(r) for r in rows.groupBy(step.alias("step")).count().collect()), reverse=True)
        total, low = 0, None
        for at, size in sizes:
            if total + size > most:
                break
            total, low = total + size, at
        self.whole = total == sum(size for _, size in sizes)
        taken = F.lit(low is not None) & (step >= F.lit(low if low is not None else 0))
        self.rest = rows.where(~taken)
        got = rows.where(taken).select("gram", "value").toArrow()
        keys = got["gram"].to_numpy()
        order = np.argsort(keys)
        self.keys, self.values = keys[order], got["value"].to_numpy()[order]

    def __getstate__(self):
        return self.whole, self.keys, self.values

    def __setstate__(self, state):
        self.whole, self.keys, self.values = state

    def look(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the sorted keys are here, and their values."""
        if not len(self.keys):
            return np.zeros(len(key), dtype=bool), np.zeros(len(key))
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[at] == key, self.values[at].astype(np.float64)


class Tables:
    """The differences of a pair of models: what is broadcast, and the tables of all."""

    def __init__(self, parts: tuple[DataFrame, DataFrame]):
        self.grams, self.contexts = Known(parts[0], MOST_GRAMS), Known(parts[1], MOST_CONTEXTS)
        self.every_context = parts[1]
        #: Whether no text has to wait for a join.
        self.whole = self.grams.whole and self.contexts.whole

    def __getstate__(self):
        return self.grams, self.contexts, self.whole

    def __setstate__(self, state):
        self.grams, self.contexts, self.whole = state

    def difference(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of sorted keys, and which of them only the join knows."""
        hit, value = self.grams.look(key)
        miss = np.flatnonzero(~hit)
        known, rest = self.contexts.look(key[miss] >> 8)
        value[miss] = np.where(known, rest, 0)
        open_keys = np.zeros(len(key), dtype=bool)
        open_keys[miss] = ~known & (not self.contexts.whole) if self.grams.whole else True
        value[open_keys] = 0
        return value, open_keys

    def answers(self, waiting: DataFrame) -> DataFrame:
        """``(gram, n, value)`` of the distinct 5-grams of a table ``(gram)``: n is how many rows ask."""
        asked = waiting.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        seen = self.grams.rest.select("gram", F.col("value").alias("own"))
        back = self.every_context.select(F.col("gram").alias("context"), F.col("value").alias("other"))
        return asked.join(seen, "gram", "left").withColumn("context", F.shiftright("gram", 8)).join(back, "context", "left").select(
            "gram", "n", F.coalesce("own", "other", F.lit(0.0).cast("float")).alias("value"))


FEATURES = 7
#: Of a text's settled words: sum of their values, the two best, the best per byte, sum of excesses.  Of all words: bytes, number.
_STATE = 7
#: What a row keeps until the join has answered; the words and 5-grams are numbered within the row.
_WAITING = {"state": "array<double>", "waits_value": "array<double>", "waits_length": "array<bigint>",
            "waits_word": "array<bigint>", "waits_gram": "array<bigint>"}


def _regression(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and weights (the constant first) of a ridge logistic regression, by Newton steps."""
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1
    z = np.hstack([np.ones((len(x), 1)), (x - centre) / scale])
    w = np.zeros(z.shape[1])
    w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    penalty = np.full(len(w), RIDGE)
    penalty[0] = 0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        curve = np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve((z * curve[:, None]).T @ z + np.diag(penalty) + 1e-9 * np.eye(len(w)), z.T @ (p - y) + penalty * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, w


def _add(state: np.ndarray, value: float, length: int) -> None:
    """Takes one more settled word into a state that has its bytes and number."""
    state[0] += value
    state[1], state[2] = (value, state[1]) if value > state[1] else (state[1], max(state[2], value))
    state[3] = max(state[3], value / length)
    state[4] += max(value - 2, 0)


def states(column: pa.Array, tables: Tables):
    """States of all texts; then, of the words that wait: text, value so far, bytes; then pairs of such a word and a 5-gram it waits for."""
    out = np.zeros((len(column), _STATE))
    out[:, 1:4] = -np.inf
    words_open, pairs, taken = [], [], 0
    for at, owner, key, starts in grams(column):
        if not len(key):
            continue
        distinct, places = np.unique(key, return_inverse=True)
        known, waits = tables.difference(distinct)
        value, wait = known[places], waits[places]
        begin = np.flatnonzero(starts)
        words = np.add.reduceat(value, begin)
        length = np.diff(np.append(begin, len(key)))
        text = owner[begin]
        edge = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
        out[text[edge], 5] = np.add.reduceat(length, edge)
        out[text[edge], 6] = np.diff(np.append(edge, len(text)))
        if wait.any():
            late = np.logical_or.reduceat(wait, begin)
            number = np.cumsum(late) - 1 + taken
            taken += int(late.sum())
            words_open.append((text[late], words[late], length[late]))
            where = np.flatnonzero(wait)
            pairs.append((number[np.searchsorted(begin, where, side="right") - 1], key[where]))
            words, length, text = words[~late], length[~late], text[~late]
            if not len(text):
                continue
            edge = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
        who = text[edge]
        count = np.diff(np.append(edge, len(text)))
        best = words[np.lexsort((-words, text))]
        out[who, 0] = np.add.reduceat(words, edge)
        out[who, 1] = best[edge]
        out[who, 2] = np.where(count > 1, best[np.minimum(edge + 1, len(best) - 1)], -np.inf)
        out[who, 3] = np.maximum.reduceat(words / length, edge)
        out[who, 4] = np.add.reduceat(np.maximum(words - 2, 0), edge)
    kinds = ((np.int64, np.float64, np.int64), (np.int64, np.int64))
    return out, *[tuple(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, dtype=kind) for i, kind in enumerate(k))
                  for parts, k in zip((words_open, pairs), kinds)]


def _features(state: np.ndarray) -> np.ndarray:
    """One row per state; all zeros for a text without words."""
    out = np.zeros((len(state), FEATURES))
    out[:, 0] = state[:, 0] / np.maximum(state[:, 5], 1)
    out[:, 1:4] = np.sqrt(np.maximum(state[:, 1:4], 0))
    out[:, 4] = state[:, 4] / np.maximum(state[:, 6], 1)
    out[:, 5] = np.log1p(state[:, 4])
    out[:, 6] = np.log1p(state[:, 6])
    return out


def _lists(parts: np.ndarray, groups: np.ndarray, n: int) -> pa.Array:
    """Values in the order of their groups, as one list per group."""
    ends = np.searchsorted(groups, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(parts))


def features(df: DataFrame, tables: Tables) -> DataFrame:
    """``df`` with its last column, a text, replaced by ``found``: the features."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(tables)
    names = df.columns[:-1]
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1])

    def listed(found):
        return pa.array(list(found), pa.list_(pa.float64()))

    def at_once(batches):
        for batch in tidy(batches):
            found = _features(states(batch.column(len(names)), shared.value)[0])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], listed(found)], [*names, "found"])

    if tables.whole:
        return df.mapInArrow(at_once, f"{head}, found array<double>")

    def first(batches):
        for batch in tidy(batches):
            n = batch.num_rows
            state, (text, value, length), (word, gram) = states(batch.column(len(names)), shared.value)
            begin = np.searchsorted(text, np.arange(n))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], listed(state), _lists(value, text, n), _lists(length, text, n),
                 _lists((word - begin[text[word]]).astype(np.int64), text[word], n), _lists(gram, text[word], n)],
                [*names, *_WAITING])

    with small_batches(spark):
        held = materialise(df.mapInArrow(first, f"{head}, {', '.join(f'{a} {b}' for a, b in _WAITING.items())}").withColumn(
            "row_number", F.monotonically_increasing_id()), "states")
    asked = held.select(F.explode(F.array_distinct("waits_gram")).alias("gram"))
    answers = materialise(tables.answers(asked), "answers")
    common = Known(answers, MOST_ANSWERS)
    common_here = spark.sparkContext.broadcast(common)

    def others(batches):
        for batch in batches:
            lists = batch.column(1)
            row = np.repeat(batch.column(0).to_numpy(), lists.value_lengths().to_numpy().astype(np.int64))
            gram = lists.flatten().to_numpy()
            distinct, places = np.unique(gram, return_inverse=True)
            take = ~common_here.value.look(distinct)[0][places]
            yield pa.RecordBatch.from_arrays([pa.array(row[take]), pa.array(gram[take])], ["row_number", "gram"])

    # Apart from the common answers, so that no 5-gram has many rows.
    if common.whole:
        told = held.withColumn("told", F.lit(None).cast("array<struct<gram:bigint,value:float>>"))
    else:
        single = held.where(F.size("waits_gram") > 0).select("row_number", F.array_distinct("waits_gram").alias("grams"))
        pairs = single.mapInArrow(others, "row_number long, gram long").join(common.rest.select("gram", "value"), "gram")
        told = held.join(pairs.groupBy("row_number").agg(F.collect_list(F.struct("gram", "value")).alias("told")), "row_number", "left")

    def finish(batches):
        for batch in tidy(batches):
            every = common_here.value
            columns = {c: batch.column(c) for c in (*_WAITING, "told")}
            state = np.array(columns["state"].to_pylist(), dtype=np.float64).reshape(batch.num_rows, _STATE)
            for i in np.flatnonzero(columns["waits_value"].value_lengths().to_numpy()):
                value, length, word, gram = (columns[c][i].values.to_numpy() for c in list(_WAITING)[1:])
                distinct, places = np.unique(gram, return_inverse=True)
                hit, known = every.look(distinct)
                if columns["told"][i].is_valid:
                    extra = columns["told"][i].values
                    keys, more = extra.field("gram").to_numpy(), extra.field("value").to_numpy()
                    at = np.searchsorted(distinct, keys)
                    known[at], hit[at] = more, True
                assert hit.all()
                value = value.copy()
                np.add.at(value, word, known[places])
                for v, n in zip(value, length):
                    _add(state[i], v, n)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], listed(_features(state))], [*names, "found"])

    return told.select(*[F.col(f"`{c}`") for c in names], *_WAITING, "told").mapInArrow(finish, f"{head}, found array<double>")


class Model:
    def __init__(self, tables: Tables | None, centre=None, scale=None, weights=None, share: float = 0.0):
        self.tables, self.centre, self.scale, self.weights, self.share = tables, centre, scale, weights, share

    def score(self, found: np.ndarray) -> np.ndarray:
        """Scores of rows of features."""
        if self.weights is None:
            plain = 1 / (1 + np.exp(-np.clip(EVIDENCE * found[:, 0], -30, 30)))
            return np.where(found[:, FEATURES - 1] > 0, plain, self.share)
        z = (found - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + z @ self.weights[1:], -30, 30)))

    def __getstate__(self):
        return self.__dict__ | ({} if self.tables is None or self.tables.whole else {"tables": None})


def fit(documents: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", toxic: str = "toxic") -> Model:
    """The models of all rows of ``labels (key, toxic)``, and the regression on a bounded sample of them."""
    spark = documents.sparkSession
    marks = labels.select(F.col(key).alias("key"), F.col(toxic).cast("int").alias("toxic")).where(
        "key IS NOT NULL AND toxic IN (0, 1)")
    # One in three labels is kept apart from the models that the regression is fitted against.
    marks = marks.withColumn("fit", F.pmod(F.crc32(F.concat(F.lit("fit-"), F.col("key").cast("string"))), F.lit(3)) != 0)
    marks = materialise(marks, "marks")
    share = marks.agg(F.avg("toxic")).first()[0] or 0.0
    bodies = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    labelled = sieve(bodies, F.col("key"), marks.select("key")).join(marks, "key")
    with small_batches(spark):
        counts = materialise(count_grams(labelled.select("text", (F.col("toxic") == 1).alias("toxic"), "fit")), "grams")
    all_of = counts.agg(*[F.sum(c) for c in ("c0", "c1", "f0", "f1")]).first()
    if not all(all_of[:2]):
        return Model(None, share=float(share))
    # Held-apart ids that have a document, one row each; the first of both classes by hash.
    held = marks.where(~F.col("fit")).groupBy("key").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    ids = sieve(bodies.select("key"), F.col("key"), held)
    held = materialise(held.join(ids, "key", "left_semi"), "held-apart")
    number = {r[0]: r[1] for r in held.groupBy("toxic").count().collect()}
    every = Tables(_differences(counts, "c0", "c1"))
    if len(number) < 2 or not all(all_of[2:]):
        return Model(every, share=float(share))
    order = F.xxhash64(F.lit("sample"), F.col("key"))
    sample = [r for c in (0, 1) for r in held.where(F.col("toxic") == c).orderBy(order, "key").limit(FIT_ROWS // 2).collect()]
    chosen = spark.createDataFrame(sample, held.schema)
    tables = Tables(_differences(counts, "f0", "f1"))
    # At most FIT_ROWS ids: a broadcast of bounded size.  Of a repeated id's texts, one by hash.
    texts = bodies.join(F.broadcast(chosen), "key").select("key", "toxic", F.xxhash64("text").alias("mark"), "text")
    with small_batches(spark):
        rows = features(texts, tables).groupBy("key").agg(F.min(F.struct("mark", "toxic", "found")).alias("x")).select(
            "x.toxic", "x.found").collect()
    y = np.array([r[0] for r in rows], dtype=float)
    x = np.array([r[1] for r in rows])
    order = np.lexsort((*x.T, y))
    centre, scale, weights = _regression(x[order], y[order])
    # The sample has its own odds of the classes; the constant goes back to those of all held-apart ids.
    weights[0] += np.log(number[1] / number[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return Model(every, centre, scale, weights, float(share))


def scores(df: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, score)`` per row."""
    if model.tables is None:
        return df.select(F.col(key), F.lit(float(model.share)).alias("score"))
    found = _scored(df.select(F.col(key).alias("k"), F.col(text).alias("text")), model)
    # Written at once: a few bytes a row, and the texts go to Python in small batches.
    with small_batches(df.sparkSession):
        return materialise(found, "scores").withColumnRenamed("k", key)


def _scored(df: DataFrame, model: Model) -> DataFrame:
    """``df`` with its last column, a text, replaced by ``score``."""
    found = features(df, model.tables)
    # The driver's side of the tables stays here.
    plain = Model(None, model.centre, model.scale, model.weights, model.share)

    @F.arrow_udf("double")
    def score(found: pa.Array) -> pa.Array:
        return pa.array(plain.score(found.flatten().to_numpy().reshape(len(found), FEATURES)))

    return found.withColumn("score", score("found")).drop("found")


def without_toxic(df: DataFrame, model: Model, limit: float, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that score below ``limit``."""
    if model.tables is None:
        return df.where(F.lit(float(model.share)) < limit)
    body = F.coalesce(F.col(text), F.lit(""))
    # The score hangs on the text alone.  Rows that cannot be rejected pass without a shuffle; the id keeps copies apart.
    mark = F.sha2(F.encode(F.concat_ws("\x00", F.coalesce(F.col(key).cast("string"), F.lit("null")), body), "UTF-8"), 256)
    with small_batches(df.sparkSession):
        rejected = materialise(_scored(df.select(mark.alias("__rejected"), body.alias("text")), model).where(
            F.col("score") >= limit).select("__rejected").distinct(), "rejected")
    here = df.withColumn("__mark", mark)
    doubtful = sieve_flag(here, F.col("__mark"), rejected)
    kept = here.where(doubtful).join(rejected, F.col("__mark") == F.col("__rejected"), "left_anti")
    return here.where(~doubtful).unionAll(kept).select(*[F.col(f"`{c}`") for c in df.columns])
