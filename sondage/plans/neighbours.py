"""Exact k-nearest-neighbour join without a cross join of rows.

A tree of cuts, made from a bounded sample of the base, deals base and queries into blocks of
near rows.  A first pass compares each block's queries with the base rows of the same block, which
bounds the distance of every query's k-th neighbour.  A second pass holds the block's queries against those
other blocks whose bounding box is within the bound.  Blocks meet as packed rows of two small written
tables, so no vector is copied per pair and nothing but the candidates is shuffled again.

Inside a block rows are in the order of a k-d tree of small leaves, and leaves beyond the bound are left out.
In many dimensions little can be left out and the work is quadratic, but a task never holds more than
two blocks, a bounded slice of the base and k rows per query.

Copies cost no more than one row inside a block: of equal base vectors only the k smallest keys can
be an answer, and equal queries have one answer.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondage.plans.durable import materialise

# Functions travel to the executors by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows and bytes of a block at most, and how many rows are worth a block of their own.
BLOCK_ROWS, BLOCK_BYTES, FEW_ROWS = 32768, 4 << 20, 1024
#: Sampled base rows per block, and in all, that reach the driver.
SAMPLE_ROWS, MAX_SAMPLE = 16, 16384
#: Bytes of base blocks that one task of the second pass goes through.
SLICE_BYTES = 64 << 20
#: Vectors up to this width are compared place by place, wider ones by a matrix product first.
NARROW = 8
#: Further apart than most groups that must not meet.
APART = 1e7
TIE_DIGITS = 9
#: Bits of a block's number for its part of a leaf.
PART_BITS = 12
_TIE = 2e-9


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(column), width) + 0.0


def _codes(column: pa.Array, missing: int) -> np.ndarray:
    return pc.fill_null(pc.cast(column, pa.int64()), missing).to_numpy(zero_copy_only=False)


def _order(ids: pa.Array, missing: str = "at_start") -> np.ndarray:
    """The places of the ids in their order, as Spark sorts them."""
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    if pa.types.is_struct(ids.type):
        names = [f"f{i}" for i in range(ids.type.num_fields)]
        table = pa.table(ids.flatten(), names=names)
        return pc.sort_indices(table, sort_keys=[(n, "ascending") for n in names], null_placement=missing).to_numpy()
    return pc.sort_indices(ids, null_placement=missing).to_numpy()


# -- trees of cuts ---------------------------------------------------------------------------


def _cuts(sample: np.ndarray, blocks: int) -> tuple[np.ndarray, ...]:
    """A tree with about ``blocks`` leaves: per node the place it cuts (-1: leaf), the cut, its children, its leaf and its share."""
    nodes, todo = [[-1, 0.0, -1, -1, -1, 1.0]], [(0, sample, blocks)]
    leaves = 0
    while todo:
        at, rows, parts = todo.pop()
        nodes[at][5] = len(rows) / max(len(sample), 1)
        if parts > 1 and len(rows) > 1:
            spread = rows.max(axis=0) - rows.min(axis=0)
            # Ties go to the left; where the middle is the largest value the cut lies below it.
            for j in np.argsort(-spread)[:8]:
                values = np.sort(rows[:, j])
                cut = values[(len(values) - 1) // 2]
                if cut == values[-1]:
                    cut = values[max(np.searchsorted(values, cut) - 1, 0)]
                left = rows[:, j] <= cut
                if left.any() and not left.all():
                    part = min(max(round(parts * left.mean()), 1), parts - 1)
                    nodes[at][:4] = [int(j), float(cut), len(nodes), len(nodes) + 1]
                    todo += [(len(nodes), rows[left], part), (len(nodes) + 1, rows[~left], parts - part)]
                    nodes += [[-1, 0.0, -1, -1, -1, 0.0], [-1, 0.0, -1, -1, -1, 0.0]]
                    break
        if nodes[at][0] < 0:
            nodes[at][4], leaves = leaves, leaves + 1
    place, cut, left, right, leaf, share = zip(*nodes)
    return np.array(place), np.array(cut), np.array(left), np.array(right), np.array(leaf), np.array(share)


def _leaf(tree, x: np.ndarray) -> np.ndarray:
    """The node of the leaf of each row."""
    place, cut, left, right, *_ = tree
    at, rows = np.zeros(len(x), dtype="int64"), np.arange(len(x))
    while len(rows):
        rows = rows[place[at[rows]] >= 0]
        here = at[rows]
        at[rows] = np.where(x[rows, place[here]] <= cut[here], left[here], right[here])
    return at


def _sizes(n: int, leaf: int) -> list[int]:
    """Rows of the leaves of :func:`_sorted`; they follow from the number of rows."""
    parts = [n]
    while parts and max(parts) > leaf:
        parts = [p for m in parts for p in ((m // 2, m - m // 2) if m > leaf else (m,))]
    return parts


def _sorted(x: np.ndarray, leaf: int) -> np.ndarray:
    """Rows in the order of a k-d tree, halved at the place of the largest spread."""
    parts = [np.arange(len(x))]
    while parts and max(map(len, parts)) > leaf:
        out = []
        for rows in parts:
            if len(rows) > leaf:
                v = x[rows]
                j = (v.max(axis=0) - v.min(axis=0)).argmax()
                rows = rows[np.argpartition(v[:, j], len(rows) // 2)]
                out += [rows[:len(rows) // 2], rows[len(rows) // 2:]]
            else:
                out.append(rows)
        parts = out
    return np.concatenate(parts) if parts else np.arange(0)


# -- comparing blocks ------------------------------------------------------------------------


class _Rows:
    """Rows of one block in the order of their leaves, with the boxes of these."""

    def __init__(self, x: np.ndarray, fold: np.ndarray, leaf: int):
        self.x, self.fold = x, fold
        sizes = _sizes(len(x), leaf) if len(x) else []
        self.ends = np.cumsum(sizes, dtype="int64")
        self.starts = self.ends - sizes
        if len(x):
            self.low, self.high = np.minimum.reduceat(x, self.starts), np.maximum.reduceat(x, self.starts)


def _leaf_rows(width: int) -> int:
    return 64 if width <= NARROW else 256


def _exact(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of pairs of rows, added up place by place."""
    total = np.zeros(np.broadcast_shapes(q.shape, b.shape)[:-1])
    for j in range(q.shape[-1]):
        total += (q[..., j] - b[..., j]) ** 2
    return np.sqrt(total)


class _Search:
    """The nearest base rows so far of a block's queries: bound of the last place, and the candidates within it."""

    def __init__(self, queries: _Rows, need: int, group: bool, same: bool, bound: np.ndarray | None = None):
        self.q, self.need, self.group, self.same = queries, need, group, same
        self.bound = np.full(len(queries.x), np.inf) if bound is None else bound.copy()
        self.best = np.full((len(queries.x), need), np.inf)
        self.found: list[tuple] = []

    def compare(self, base: _Rows, block: int, rank: np.ndarray) -> None:
        """Search one block; ``rank`` has the places of its rows in the order of their ids."""
        q = self.q
        if not len(q.x) or not len(base.x):
            return
        gap = np.zeros((len(q.starts), len(base.starts)))
        for j in range(q.x.shape[1]):
            gap += np.maximum(np.maximum(base.low[None, :, j] - q.high[:, None, j], q.low[:, None, j] - base.high[None, :, j]), 0.0) ** 2
        gap = np.sqrt(gap) * (1 - 1e-12)
        for i in range(len(q.starts)):
            rows = slice(q.starts[i], q.ends[i])
            near = np.argsort(gap[i], kind="stable")
            reach, step, at, got = gap[i][near], 2, 0, []
            while at < len(near):
                last = np.searchsorted(reach, self.bound[rows].max() + _TIE, side="right")
                part = near[at:min(at + step, last)]
                if not len(part):
                    break
                got.append(self._leaves(rows, base, part))
                at, step = at + len(part), step * 2 if q.x.shape[1] <= NARROW else 8
            self._keep(rows, got, block, rank)

    def _leaves(self, rows: slice, base: _Rows, leaves: np.ndarray):
        """Candidates ``(query, base row, distance, rounded)`` among some leaves; the bound sinks."""
        leaves = np.sort(leaves)
        if len(leaves) == leaves[-1] - leaves[0] + 1:
            places = np.arange(base.starts[leaves[0]], base.ends[leaves[-1]])
        else:
            places = np.concatenate([np.arange(base.starts[k], base.ends[k]) for k in leaves])
        x, b = self.q.x[rows], base.x[places]
        barred = None
        if self.group:
            equal = self.q.fold[rows, None] == base.fold[None, places]
            barred = ~equal if self.same else equal
        if x.shape[1] <= NARROW:
            d = _exact(x[:, None, :], b[None, :, :])
            if barred is not None:
                d[barred] = np.inf
            rounded = np.round(d, TIE_DIGITS)
            limit = self._sink(rows, rounded)
            at, to = np.nonzero((rounded <= limit[:, None]) & np.isfinite(d))
            return at, places[to], d[at, to], rounded[at, to]
        # The product is off by no more than a few roundings of the largest square; candidates are priced again.
        middle = b.mean(axis=0)
        xc, bc = x - middle, b - middle
        xx, bb = (xc * xc).sum(axis=1), (bc * bc).sum(axis=1)
        off = 8 * (x.shape[1] + 4) * np.finfo(float).eps * (xx[:, None].max() + bb.max())
        rough = xx[:, None] + bb[None, :] - 2 * (xc @ bc.T)
        if barred is not None:
            rough[barred] = np.inf
        limit = self.bound[rows]
        if rough.shape[1] > self.need:
            upper = np.partition(rough, self.need - 1, axis=1)[:, self.need - 1]
            limit = np.minimum(limit, np.sqrt(np.maximum(upper + off, 0.0)) + _TIE)
        at, to = np.nonzero((rough <= ((limit + _TIE) ** 2)[:, None] + off) & np.isfinite(rough))
        d = _exact(x[at], b[to])
        rounded = np.round(d, TIE_DIGITS)
        # The best of each query as a table, for the bound.
        order = np.lexsort((rounded, at))
        first = np.searchsorted(at[order], np.arange(len(x)))
        nth = np.arange(len(order)) - first[at[order]]
        top = order[nth < self.need]
        table = np.full((len(x), self.need), np.inf)
        table[at[top], nth[nth < self.need]] = rounded[top]
        limit = self._sink(rows, table)
        good = (rounded <= limit[at]) & np.isfinite(d)
        return at[good], places[to[good]], d[good], rounded[good]

    def _sink(self, rows: slice, rounded: np.ndarray) -> np.ndarray:
        if rounded.shape[1] > self.need:
            rounded = np.partition(rounded, self.need - 1, axis=1)[:, :self.need]
        both = np.sort(np.hstack([self.best[rows], rounded]), axis=1)[:, :self.need]
        self.best[rows] = both
        self.bound[rows] = np.minimum(self.bound[rows], both[:, -1])
        return self.bound[rows]

    def _keep(self, rows: slice, got: list, block: int, rank: np.ndarray) -> None:
        """Of one leaf of queries the ``need`` first candidates each, by distance and id."""
        got = [g for g in got if len(g[0])]
        if not got:
            return
        at, to, d, rounded = (np.concatenate(x) for x in zip(*got))
        order = np.lexsort((rank[to], rounded, at))
        order = order[(rounded <= self.bound[rows][at])[order]]
        if not len(order):
            return
        at = at[order]
        nth = np.arange(len(at)) - np.searchsorted(at, at)
        order, at = order[nth < self.need], at[nth < self.need]
        self.found.append((at + rows.start, to[order], d[order], rounded[order], np.full(len(order), block)))

    def result(self):
        """``(query, base row, distance, block)`` of all candidates that are still within the bound."""
        if not self.found:
            none = np.arange(0)
            return none, none, none.astype(float), none
        at, to, d, rounded, block = (np.concatenate(x) for x in zip(*self.found))
        good = rounded <= self.bound[at]
        return at[good], to[good], d[good], block[good]


def _distinct(x: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of each distinct (vector, fold), and which of these each row is."""
    every = np.ascontiguousarray(np.hstack([x, fold[:, None].astype("float64")]))
    _, first, which = np.unique(every.view(f"V{every.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
    return first, which.ravel()


# -- the join --------------------------------------------------------------------------------


def nearest(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    key: str,
    vector: str,
    group: str | None = None,
    same_group: bool = False,
    exclude_self: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(query, neighbour, distance, rank)`` for the ``k`` nearest base rows of each query.

    Both inputs hold ``key`` and an array<double> ``vector``.  With ``group`` a
    query only sees base rows of *other* groups (cross-validation folds), or
    with ``same_group`` only those of its own; ``exclude_self`` drops the base row with the query's own key.  Order:
    distance rounded to ``TIE_DIGITS``, then key.  A key may be a struct, which takes what the caller needs of
    both sides to the result without a join.
    """
    spark = base.sparkSession
    vec, fold = F.col(vector).cast("array<double>"), (F.col(group) if group else F.lit(None)).cast("long")
    if same_group:
        # A place of its own keeps the groups' blocks apart; inside a group it adds nothing.
        vec = F.concat(vec, F.array(F.coalesce(fold.cast("double"), F.lit(-1.0)) * F.lit(APART)))
    need = k + (1 if exclude_self else 0)

    def side(df):
        # The cast lets the fields of a struct be null, as in what the tasks return.
        kind = df.schema[key].dataType.simpleString()
        return df.select(F.col(key).cast(kind).alias("id"), vec.alias("vec"), fold.alias("fold"))

    asked, points = side(queries), side(base)
    number = F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 40)).alias("number")
    kinds = asked.schema["id"].dataType.simpleString(), points.schema["id"].dataType.simpleString()
    total, width = points.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if not total:
        nothing = F.lit(None).cast(points.schema["id"].dataType).alias("neighbour")
        return asked.limit(0).select(F.col("id").alias("query"), nothing, F.lit(0.0).alias("distance"), F.lit(1).alias("rank"))
    spots = points.select(number, "vec")
    if queries is not base:
        # Blocks are as large as the larger side asks for, and the cuts suit both.
        total = max(total, asked.count())
        spots = spots.unionAll(asked.select(number, "vec"))
    cores = spark.sparkContext.defaultParallelism
    per_block = max(1, min(block_rows, BLOCK_BYTES // (8 * width), max(FEW_ROWS, math.ceil(total / (4 * cores)))))
    blocks = math.ceil(total / per_block)
    tree = _cuts(np.zeros((0, width)), 1)
    if blocks > 1:
        wanted = min(MAX_SAMPLE, SAMPLE_ROWS * blocks)
        some = spots.where(F.col("number") % max(1, total // wanted) == 0).limit(4 * wanted).select("vec").toArrow()
        rows = _matrix(some.column(0), width)
        tree = _cuts(rows[np.isfinite(rows).all(axis=1)], blocks)
    # A leaf that values cannot divide is dealt by the hash.
    parts = np.clip(np.round(tree[5] * total / per_block / 2), 1, 1 << PART_BITS).astype("int64")
    single = len(parts) == 1 and parts[0] == 1

    @F.arrow_udf("long")
    def block_of(v: pa.Array, number: pa.Array) -> pa.Array:
        at = _leaf(tree, _matrix(v, width))
        return pa.array((tree[4][at] << PART_BITS) + number.to_numpy() % parts[at])

    def dealt(df):
        block = F.lit(0).cast("long") if single else block_of("vec", number)
        # So many partitions that all cores have some, and that a written file has few of the large rows.
        return df.withColumn("block", block).repartition(1 if single else max(min(4 * cores, blocks), blocks // 8), "block").groupBy("block")

    leaf = _leaf_rows(width)

    def meet(of, q: pa.Table, b: pa.Table) -> pa.Table:
        block, (q, qx, qf), (b, bx, bf) = of[0].as_py(), loaded(q, -2), loaded(b, -1)
        # Of equal base rows only the smallest ids can be an answer.
        rank = np.empty(len(bx), dtype="int64")
        rank[_order(b.column("id"))] = np.arange(len(bx))
        _, which = _distinct(bx, bf)
        order = np.lexsort((rank, which))
        nth = np.arange(len(order)) - np.searchsorted(which[order], which[order])
        kept = order[nth < need]
        kept = kept[_sorted(bx[kept], leaf)]
        first, which = _distinct(qx, qf)
        sort = _sorted(qx[first], leaf)
        place = np.empty(len(sort), dtype="int64")
        place[sort] = np.arange(len(sort))
        which, first = place[which], first[sort]
        rows, own = _Rows(qx[first], qf[first], leaf), _Rows(bx[kept], bf[kept], leaf)
        search = _Search(rows, need, group is not None, same_group)
        search.compare(own, block, rank[kept])
        at, to, d, _ = search.result()
        # Equal queries ask as the one with the smallest id.
        asks = np.empty(len(qx), dtype="int64")
        asks[_order(q.column("id"), "at_end")] = np.arange(len(qx))
        order = np.lexsort((asks, which))
        ids = q.column("id").combine_chunks()
        names = ids.take(pa.array(order[np.searchsorted(which[order], np.arange(len(first)))]))
        answers = pa.StructArray.from_arrays(
            [names.take(pa.array(at)), b.column("id").combine_chunks().take(pa.array(kept[to])), pa.array(d)], ["query", "neighbour", "distance"])
        members = pa.StructArray.from_arrays([ids, names.take(pa.array(which))], ["member", "query"])

        def listed(values, n):
            return pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), values)

        def box(x, side):
            return pa.array([getattr(x, side)(axis=0).tolist() if len(x) else None], pa.list_(pa.float64()))

        packed = {
            "block": pa.array([block]), "answers": listed(answers, len(answers)), "members": listed(members, len(members)),
            "q_ids": listed(names, len(names)), "q_x": pa.array([rows.x.tobytes()]),
            "q_fold": pa.array([rows.fold.tobytes()]), "q_bound": pa.array([search.bound.tobytes()]), "q_reach": pa.array([float(search.bound.max(initial=-1.0))]),
            "q_low": box(rows.x, "min"), "q_high": box(rows.x, "max"),
            "b_ids": listed(b.column("id").combine_chunks().take(pa.array(kept)), len(kept)), "b_x": pa.array([own.x.tobytes()]), "b_fold": pa.array([own.fold.tobytes()]),
            "b_low": box(own.x, "min"), "b_high": box(own.x, "max")}
        return pa.table(packed)

    def loaded(table: pa.Table, missing: int):
        """Rows with finite vectors; others are at no distance from anything."""
        x = _matrix(table.column("vec"), width)
        good = np.isfinite(x).all(axis=1)
        if not good.all():
            table, x = table.filter(pa.array(good)), x[good]
        return table, x, _codes(table.column("fold").combine_chunks(), missing)

    answer = f"query {kinds[0]}, neighbour {kinds[1]}, distance double"
    pairs = f"query: {kinds[0]}, neighbour: {kinds[1]}, distance: double"
    met = materialise(dealt(asked).cogroup(dealt(points)).applyInArrow(
        meet, f"block long, answers array<struct<{pairs}>>, members array<struct<member: {kinds[0]}, query: {kinds[0]}>>, q_ids array<{kinds[0]}>, q_x binary, q_fold binary, q_bound binary, q_reach double, "
        f"q_low array<double>, q_high array<double>, b_ids array<{kinds[1]}>, b_x binary, b_fold binary, b_low array<double>, b_high array<double>"), "knn-blocks")
    answers = met.select(F.inline("answers"))
    if not single:
        def unpack(x, fold):
            return _Rows(np.frombuffer(x).reshape(-1, width), np.frombuffer(fold, dtype="int64"), leaf)

        def search_others(batches):
            state = None
            for batch in batches:
                for i in range(batch.num_rows):
                    block = batch.column("block")[i].as_py()
                    if state is None or state[0] != block:
                        yield from flushed(state)
                        state = (block, _Search(unpack(batch.column("q_x")[i].as_py(), batch.column("q_fold")[i].as_py()), need, group is not None, same_group,
                                                np.frombuffer(batch.column("q_bound")[i].as_py())),
                                 batch.column("q_ids")[i].values, {})
                    ids = batch.column("b_ids")[i].values
                    rank = np.empty(len(ids), dtype="int64")
                    rank[_order(ids)] = np.arange(len(ids))
                    other = batch.column("b_block")[i].as_py()
                    state[3][other] = ids
                    state[1].compare(unpack(batch.column("b_x")[i].as_py(), batch.column("b_fold")[i].as_py()), other, rank)
            yield from flushed(state)

        def flushed(state):
            if state is None:
                return
            _, search, ids, known = state
            at, to, d, of = search.result()
            for other in np.unique(of):
                here = of == other
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at[here])), known[other].take(pa.array(to[here])), pa.array(d[here])], ["query", "neighbour", "distance"])

        # Few rows, each a block; the base is read again for every part of the queries.
        left = met.where("q_low IS NOT NULL").select("block", "q_ids", "q_x", "q_fold", "q_bound", "q_reach", "q_low", "q_high")
        right = met.where("b_low IS NOT NULL").select(F.col("block").alias("b_block"), "b_ids", "b_x", "b_fold", "b_low", "b_high").coalesce(
            max(1, math.ceil(total * (8 * width + 24) / SLICE_BYTES)))
        within = (F.col("block") != F.col("b_block")) & _within()
        others = left.join(right, within).select("block", "q_ids", "q_x", "q_fold", "q_bound", "b_block", "b_ids", "b_x", "b_fold").mapInArrow(
            search_others, answer)
        answers = answers.unionAll(materialise(others, "knn-others"))
    order = W.partitionBy("query").orderBy(F.round("distance", TIE_DIGITS), "neighbour")
    answers = answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= need)
    # Hand the answer of each distinct query to all its copies.
    out = met.select(F.inline("members")).join(answers, "query").select(F.col("member").alias("query"), "neighbour", "distance", "rank")
    if not exclude_self:
        return out
    again = F.row_number().over(W.partitionBy("query").orderBy("rank"))
    return out.where(F.col("neighbour") != F.col("query")).withColumn("rank", again).where(F.col("rank") <= k)


def _within() -> Column:
    """Whether two boxes are no further apart than the queries reach."""
    sides = F.zip_with(
        F.zip_with("q_low", "b_high", lambda q, b: F.greatest(q - b, F.lit(0.0))),
        F.zip_with("b_low", "q_high", lambda b, q: F.greatest(b - q, F.lit(0.0))), lambda a, b: a * a + b * b)
    gap = F.sqrt(F.aggregate(sides, F.lit(0.0), lambda s, v: s + v))
    return gap * F.lit(1 - 1e-12) <= F.col("q_reach") + F.lit(_TIE)


def unit_vectors(df: DataFrame, vector: str, query_side: bool) -> DataFrame:
    """Scale to length one with two spare places, so that ``1 - d*d/2`` is the cosine.

    A zero vector gets its own direction (a different one per side), which
    makes its cosine with anything zero.
    """
    values = F.col(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x))
    spare = F.array(F.lit(0.0), F.lit(1.0)) if query_side else F.array(F.lit(1.0), F.lit(0.0))
    scaled = F.when(norm > 0, F.concat(F.transform(values, lambda x: x / norm), F.array(F.lit(0.0), F.lit(0.0))))
    return df.withColumn(vector, F.coalesce(scaled, F.concat(values, spare)))
