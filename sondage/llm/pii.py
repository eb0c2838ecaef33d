"""Personal data: patterns, and a skip-chain conditional random field that carries their labels to similar tokens.

Patterns give the base spans.  Tokens with a digit or an at sign are the nodes
of a field over the labels none, email, ip, card and phone.  Neighbouring nodes share
a chain potential; distant nodes with the same long number (or its last seven digits), or the
same address or local part of one, share a skip potential.  Nodes of base spans are observed.
Loopy message passing over each document then labels, say, a phone
number's last part where it comes again without its prefix.  It goes on until the messages stand still, and
at least as long as evidence needs along the longest skip path.

All potentials are counted over the whole corpus, piece by piece, with the base labels
as observations: shapes per label, label pairs of neighbours and of skip
partners.  Shapes are hashed to ``SHAPES`` values, so the model's size is fixed.
A node gets a span of its own if its label has a posterior of ``SURE`` and a skip path leads from it
to a base span of that label.

Defined results: null and empty texts have no spans.  Partners are linked one
after the other and each with the first that is observed, not all with all, so a token that fills a
document costs no more than its length; only the first kind of link is counted for the potentials.  Repeated rows give repeated results.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.plans.durable import materialise

KINDS = ("email", "ip", "card", "phone")
SHAPES = 1 << 16
SURE = 0.9
#: Sweeps per link of the longest skip path, beside ``LEAST``: damped messages take two a link on average.
SWEEPS = 3
LEAST = 12
STILL = 1e-4
#: After those sweeps each step is so much smaller, so that messages that swing come to rest.
COOLING = 0.95
_PAIRS = (len(KINDS) + 1) ** 2

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
#: A match can only begin where a run of digits does, and none begins later in a run that failed.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_RUN = re.compile(r"[0-9]+|[^\W\d_]+|[^0-9a-zA-Z]")
_EDGE = "()[]{}<>\"'.,;:!?*&%$#|-"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str):
    """As the leftmost search finds them: an address begins where the run of its characters before the sign does."""
    at = text.find("@")
    free = 0
    while at >= 0:
        start = at
        # The run before the sign, in steps: it may be long.
        low = max(free, at - 64)
        while True:
            cut = None
            for hit in _NOT_LOCAL.finditer(text, low, start):
                cut = hit.end()
            if cut is not None:
                start = cut
                break
            start = low
            if low == free:
                break
            low = max(free, low - 1024)
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` by kind and start, in code points."""
    found = []
    if "@" in text:
        found += [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def _shape(token: str) -> int:
    """All runs of digits, letters and signs with their lengths up to five, and whether a long number checks."""
    parts = []
    for run in _RUN.findall(token):
        kind = "9" if run[0].isdigit() else "a" if run[0].isalpha() else run[0]
        parts.append(f"{kind}{min(len(run), 5)}")
    digits = "".join(c for c in token if "0" <= c <= "9")
    checked = 13 <= len(digits) <= 19 and luhn(digits)
    return zlib.crc32(f"{' '.join(parts)} {min(len(digits), 20)} {checked}".encode()) % SHAPES


def _names(token: str) -> list[str]:
    """What makes tokens similar: long numbers, their ends, addresses and local parts."""
    digits = "".join(c for c in token if "0" <= c <= "9")
    out = ["#" + digits, "~" + digits[-7:]] if len(digits) >= 7 else []
    plain = token.strip(_EDGE).lower()
    if len(plain) >= 7 and ("@" in plain or not digits or len(digits) < 7):
        out += ["=" + plain, "=" + plain.split("@")[0]] if "@" in plain else ["=" + plain]
    return out


def nodes(text: str, spans: list[tuple[int, int, int]]):
    """Starts, ends, shapes and labels (0: none) of the nodes, then as flat pairs chain edges, skip edges, and skip edges to the first observed."""
    starts, ends, shapes, labels, chain = [], [], [], [], []
    if not _MARK.search(text):
        return starts, ends, shapes, labels, chain, [], []
    owners = sorted((a, b, k + 1) for k, a, b in spans)
    at, seen = 0, {}
    before = -2
    for place, m in enumerate(_TOKEN.finditer(text)):
        token = m[0]
        if not _MARK.search(token):
            continue
        i = len(starts)
        while at < len(owners) and owners[at][1] <= m.start():
            at += 1
        label = 0
        for a, b, k in owners[at : at + 4]:
            if a < m.end() and m.start() < b:
                label = label or k
        starts.append(m.start())
        ends.append(m.end())
        shapes.append(_shape(token))
        labels.append(label)
        if before == place - 1:
            chain += [i - 1, i]
        before = place
        for name in _names(token):
            seen.setdefault(name, []).append(i)
    skip, hub = set(), set()
    for found in seen.values():
        first = next((i for i in found if labels[i]), None)
        skip.update((i, j) for i, j in zip(found, found[1:]) if i != j)
        if first is not None:
            hub.update((min(i, first), max(i, first)) for i in found if i != first)
    return starts, ends, shapes, labels, chain, *[[i for pair in sorted(x) for i in pair] for x in (skip, hub - skip)]


_READ = ("starts array<int>, ends array<int>, shapes array<int>, labels array<int>, chain array<int>, skip array<int>, hub array<int>, "
         "kinds array<int>, span_starts array<int>, span_ends array<int>")


def read(df: DataFrame, text: str, key: str) -> DataFrame:
    """Base spans and nodes of every row: the only pass over the texts."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(10)]
            for value in batch.column(1):
                body = value.as_py() or ""
                spans = base_spans(body) if _MARK.search(body) else []
                for held, part in zip(out, (*nodes(body, spans), *(zip(*spans) if spans else ((), (), ())))):
                    held.append(part)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.list_(pa.int32())) for c in out]],
                ["k", *[p.split()[0] for p in _READ.split(", ")]])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("text")).mapInArrow(run, f"k {kind}, {_READ}")


class Field:
    """Log-potentials from corpus counts."""

    def __init__(self, rows):
        n = len(KINDS) + 1
        shape, chain, skip = np.zeros((SHAPES, n)), np.ones((n, n)), np.ones((n, n))
        for what, code, count in rows:
            target = (shape, chain, skip)[what]
            target[code // n, code % n] += count
        total = shape.sum(axis=0) + 1
        share = total / total.sum()
        self.unary = np.log((shape + share) / (shape.sum(axis=1, keepdims=True) + 1)).astype(np.float32)
        self.chain, self.skip = map(self._lift, (chain, skip))

    @staticmethod
    def _lift(counts: np.ndarray) -> np.ndarray:
        """How much more often two labels meet than they would by chance."""
        counts = counts + counts.T
        total = counts.sum()
        return np.log(counts * total / np.outer(counts.sum(axis=1), counts.sum(axis=0)))

    def infer(self, shapes, labels, chain, skip, longest: int) -> np.ndarray:
        """Posteriors of each node's label, by loopy message passing; ``longest`` is the length of the longest skip path."""
        n, kinds = len(shapes), len(KINDS) + 1
        own = self.unary[shapes].astype(np.float64)
        seen = labels > 0
        own[seen] = -30.0
        own[seen, labels[seen]] = 0.0
        a, b = np.concatenate([chain[0::2], skip[0::2]]), np.concatenate([chain[1::2], skip[1::2]])
        table = np.concatenate([np.repeat(self.chain[None], len(chain) // 2, 0), np.repeat(self.skip[None], len(skip) // 2, 0)])
        source, target = np.concatenate([a, b]), np.concatenate([b, a])
        table = np.concatenate([table, table.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        messages = np.zeros((len(source), kinds))
        least, sweep, step = LEAST + SWEEPS * longest, 0, 0.5
        while True:
            belief = own.copy()
            np.add.at(belief, target, messages)
            sent = belief[source] - messages[back]
            both = sent[:, :, None] + table
            top = both.max(axis=1, keepdims=True)
            new = np.log(np.exp(both - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            change = step * (new - messages)
            messages = messages + change
            sweep += 1
            if sweep >= least:
                if np.abs(change).max() < STILL:
                    break
                step *= COOLING
        belief = own.copy()
        np.add.at(belief, target, messages)
        belief = np.exp(belief - belief.max(axis=1, keepdims=True))
        return belief / belief.sum(axis=1, keepdims=True)

    def added(self, shapes, labels, chain, skip, hub) -> list[tuple[int, int]]:
        """``(kind, node)`` of the labels that similar tokens bring."""
        skip = np.concatenate([skip, hub])
        if not len(skip) or not (labels > 0).any():
            return []
        # Labels that reach a node over skip edges from base spans.
        reach = np.zeros((len(labels), len(KINDS) + 1), dtype=bool)
        partners = {}
        for i, j in zip(skip[0::2].tolist(), skip[1::2].tolist()):
            partners.setdefault(i, []).append(j)
            partners.setdefault(j, []).append(i)
        longest = 0
        for k in range(1, len(KINDS) + 1):
            edge, links = np.flatnonzero(labels == k).tolist(), 0
            reach[edge, k] = True
            while edge:
                longest, links = max(longest, links), links + 1
                further = []
                for i in edge:
                    for j in partners.get(i, ()):
                        if not reach[j, k]:
                            reach[j, k] = True
                            further.append(j)
                edge = further
        open_nodes = np.flatnonzero((labels == 0) & reach[:, 1:].any(axis=1))
        if not len(open_nodes):
            return []
        posterior = self.infer(shapes, labels, chain, skip, longest)
        return [(k - 1, int(i)) for i in open_nodes for k in range(1, len(KINDS) + 1)
                if reach[i, k] and posterior[i, k] >= SURE]


def train(found: DataFrame) -> Field:
    """The field of a table of :func:`read`; at most ``5 * SHAPES + 2 * 25`` counts come back."""
    n = len(KINDS) + 1
    shape = found.select(F.explode(F.arrays_zip("shapes", "labels")).alias("x")).select(
        F.lit(0).alias("what"), (F.col("x.shapes") * n + F.col("x.labels")).alias("code"))
    parts = [shape]
    for what, name in ((1, "chain"), (2, "skip")):
        ends = [F.element_at("labels", F.element_at(name, F.col("p") * 2 + e) + 1) for e in (1, 2)]
        places = F.sequence(F.lit(0), F.expr(f"size({name}) div 2 - 1").cast("int"))
        parts.append(found.where(F.size(name) > 0).select("labels", name, F.explode(places).alias("p")).select(
            F.lit(what).alias("what"), (ends[0] * n + ends[1]).alias("code")))
    counts = parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("what", "code").count()
    return Field(sorted(tuple(r) for r in counts.collect()))


def spans(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, base, all)`` per row: lists of spans as ``kind:start:end`` by kind and start."""
    found = materialise(read(df, text, key), "pii")
    shared = df.sparkSession.sparkContext.broadcast(train(found))

    def run(batches):
        field = shared.value
        for batch in batches:
            base, every = [], []
            for row in batch.to_pylist():
                own = list(zip(row["kinds"], row["span_starts"], row["span_ends"]))
                extra = []
                if row["skip"]:
                    arrays = [np.array(row[c], dtype=np.int64) for c in ("shapes", "labels", "chain", "skip", "hub")]
                    extra = [(k, row["starts"][i], row["ends"][i]) for k, i in field.added(*arrays)]
                for held, part in ((base, own), (every, sorted(own + extra))):
                    held.append([f"{KINDS[k]}:{a}:{b}" for k, a, b in part])
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(every, kind)], ["k", "base", "all"])

    kind = df.schema[key].dataType.simpleString()
    return found.mapInArrow(run, f"k {kind}, base array<string>, all array<string>").withColumnRenamed("k", key)
