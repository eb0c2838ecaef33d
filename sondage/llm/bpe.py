"""Byte-pair encoding by a depth-first walk over the trie of distinct words.

A word is a path of symbols.  Every node of the trie keeps the last token of the
encoding of its path; the token before it is the state of the node that many symbols
higher, so shared prefixes are encoded once.  A child's last token is the one
token that ends there and may follow the state above it: two tokens may be
neighbours if and only if merging their symbols in rank order does not cross
the border between them, and a sequence of tokens is the encoding if and only if
all its neighbours may be.  The trie needs no nodes in memory: in sorted order
the words visit it depth first, and a stack holds the states of the path.

Texts never leave their task.  A Python worker remembers the pieces it has
encoded, in two generations of bounded size, which saves time but changes
nothing.  The vocabulary (a fixed file) is broadcast.

Decoding takes an array of ids, from wherever it comes, and looks the names of
its tokens up in Arrow: such a vocabulary has no decoder of its own, so the tokens are joined by blanks.

Defined results: null text counts as empty and has no tokens.  Special tokens
in a text are recognised, as the tokenizer file says.  A word takes time in proportion to its
length, and texts go by groups of ``GROUP`` characters, a longer one alone.  Repeated rows come back alike.
Null ids decode as an empty array of them; an id outside the vocabulary is an error.  An
input column called ``ids`` (``decoded``) is replaced.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.llm.batches import give_back, small_batches, tidy
from sondage.plans.durable import materialise

#: Pieces a worker remembers per generation, and pairs of tokens whose neighbourhood it knows.
MAX_PIECES = 150_000
MAX_PAIRS = 200_000
#: Characters of text that are encoded together.
GROUP = 1_000_000
_INF = float("inf")
_END = "</w>"
#: Characters whose normal form, case and class no version of Unicode changes between the libraries.
_PLAIN = regex.compile("[\\x00-\\x1b\\x20-\\x84\\x86-\\u0220\\u2010-\\u2027\\u2030-\\u205e\\u20a0-\\u20bf]*+")


class Vocabulary:
    """Tokens, merges and word pattern of a ``tokenizers`` file with word ends and a byte alphabet."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != _END or steps[0]["type"] != "Split":
            raise ValueError("not a byte-pair vocabulary with word ends")
        self.text = text
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            a, b, c = self.ids[left], self.ids[right], self.ids[left + right]
            self.rank[a, b] = rank
            self.parts[c] = (a, b, rank)
        if any(self.parts.get(x, (0, 0, -1))[2] >= r for a, b, r in self.parts.values() for x in (a, b)):
            raise ValueError("a merge comes before the tokens it joins")
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.longest = max(len(t.removesuffix(_END)) for t in self.ids)
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        # The printable stand-ins of the 256 bytes, by their published rule.
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(kept)]
        self.stand_in = {**{b: chr(b) for b in kept}, **{b: chr(256 + i) for i, b in enumerate(rest)}}

        # By the last three symbols: the sizes a token that ends so can have, the largest first.
        sizes: dict[str, set[int]] = {}
        for token in self.ids:
            body = token.removesuffix(_END)
            if len(body) > 2:
                sizes.setdefault(token[len(body) - 3 :], {1}).add(len(body))
        for key, found in sizes.items():
            if key[1:] in self.ids:
                found.add(2)
        self.sizes = {k: tuple(sorted(v, reverse=True)) for k, v in sizes.items()}
        self.edges: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self.allowed: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}

    def symbols(self, word: str) -> str:
        stand_in = self.stand_in
        return "".join([stand_in[b] for b in word.encode()])

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens along the left (0) or right (1) edge, smallest first, with the rank that consumes each."""
        known = self.edges.get((token, side))
        if known is None:
            known, at, until = [], token, _INF
            while True:
                known.append((at, until))
                if at not in self.parts:
                    break
                until, at = self.parts[at][2], self.parts[at][side]
            known.reverse()
            self.edges[token, side] = known
        return known

    def _border(self, a: int, b: int, joined: bool) -> bool:
        """Whether no merge crosses the border of ``a b`` before both are complete, nor after unless they are ``joined``."""
        left, right = self._edge(a, 1), self._edge(b, 0)
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            done = x_until == y_until == _INF
            if done and joined:
                return True
            across = self.rank.get((x, y))
            # At equal rank the leftmost pair is merged first.
            if across is not None and across < x_until and across <= y_until:
                return False
            if done:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def reached(self, token: int) -> bool:
        """Whether merging can produce the token at all, so that it is its own encoding."""
        known = self.whole.get(token)
        if known is None:
            a, b, _ = self.parts.get(token, (-1, -1, 0))
            known = a < 0 or (self.reached(a) and self.reached(b) and self._border(a, b, True))
            self.whole[token] = known
        return known

    def follows(self, a: int, b: int) -> bool:
        """Whether ``b`` may stand after ``a`` (-1: at the start)."""
        key = (a + 1) << 20 | b
        known = self.allowed.get(key)
        if known is None:
            if len(self.allowed) > MAX_PAIRS:
                self.allowed.clear()
            known = self.allowed[key] = self.reached(b) and (a < 0 or self._border(a, b, False))
        return known

    def walk(self, words: Iterable[str]) -> Iterator[list[int]]:
        """The tokens of each of the sorted words (as stand-ins of their bytes)."""
        ids, allowed, follows = self.ids.get, self.allowed.get, self.follows
        sizes, small = self.sizes.get, (2, 1)
        # The path: last token plus one (0 at the root) and its size, by depth.
        last, size = [0], [0]
        before, top = "", 0
        for word in words:
            n = len(word)
            shared, most = 0, min(n - 1, top)
            while shared < most and word[shared] == before[shared]:
                shared += 1
            before, top = word, n - 1
            del last[shared + 1 :], size[shared + 1 :]
            for d in range(shared + 1, n + 1):
                if d < n:
                    stop, path = d, word
                    choice = sizes(word[d - 3 if d > 3 else 0 : d], small)
                else:
                    stop, path = d + len(_END), word + _END
                    choice = sizes(path[d - 3 if d > 3 else 0 :], small)
                for k in choice:
                    if k > d:
                        continue
                    token = ids(path[d - k : stop])
                    if token is None:
                        continue
                    above = last[d - k]
                    may = allowed(above << 20 | token)
                    if may or (may is None and follows(above - 1, token)):
                        last.append(token + 1)
                        size.append(k)
                        break
                else:
                    raise ValueError("a byte is missing from the vocabulary")
            tokens, d = [], n
            while d:
                tokens.append(last[d] - 1)
                d -= size[d]
            tokens.reverse()
            yield tokens

    def __getstate__(self):
        return self.text

    def __setstate__(self, text):
        self.__init__(text)


class Encoder:
    """Texts to ids, with the pieces this worker has met: each one's ids as four bytes an id."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.special = {name: np.int32(i).tobytes() for name, i in vocabulary.special.items()}
        self.slow = None

    def _pieces(self, text: str) -> list[str]:
        """Normal text between white space; a piece that rare characters may change is cut to its words already."""
        if _PLAIN.fullmatch(text):
            return unicodedata.normalize("NFC", text).lower().split()
        # Rare characters: the library's own normal form and word pattern decide.
        if self.slow is None:
            from tokenizers import Regex, Tokenizer, pre_tokenizers

            spec = json.loads(self.v.text)["pre_tokenizer"]["pretokenizers"][0]
            split = pre_tokenizers.Split(Regex(spec["pattern"]["Regex"]), spec["behavior"].lower(), spec["invert"])
            self.slow = Tokenizer.from_str(self.v.text).normalizer, split
        normal, split = self.slow
        return ["\0" + word for word, _ in split.pre_tokenize_str(normal.normalize_str(text))]

    def _words(self, piece: str) -> list[str]:
        return [piece[1:]] if piece[0] == "\0" else self.v.pattern.findall(piece)

    def learn(self, pieces: set[str]) -> None:
        """Make sure that all the pieces are known."""
        fresh = pieces.difference(self.ids)
        if len(self.ids) + len(fresh) > MAX_PIECES:
            self.older, self.ids, fresh = self.ids, {}, set(pieces)
        for piece in fresh.intersection(self.older):
            self.ids[piece] = self.older[piece]
        fresh.difference_update(self.ids)
        words = {piece: self._words(piece) for piece in fresh}
        forms = {word: word if word.isascii() and word.isprintable() else self.v.symbols(word) for found in words.values() for word in found}
        order = sorted(forms, key=forms.__getitem__)
        ids_of = {word: array("i", ids).tobytes() for word, ids in zip(order, self.v.walk([forms[w] for w in order]))}
        for piece, found in words.items():
            self.ids[piece] = ids_of[found[0]] if len(found) == 1 else b"".join([ids_of[w] for w in found])

    def rest(self) -> None:
        """Between tasks only the newer generation stays."""
        self.older = {}
        give_back()

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of each text."""
        cut = []
        for text in texts:
            at, parts = 0, []
            for mark in self.v.marks.finditer(text or ""):
                parts += [self._pieces(text[at : mark.start()]), mark[0]]
                at = mark.end()
            cut.append([*parts, self._pieces((text or "")[at:])])
        self.learn(set().union(*[part for parts in cut for part in parts if isinstance(part, list)]))
        known, out = self.ids.__getitem__, []
        for parts in cut:
            out.append(b"".join([self.special[part] if isinstance(part, str) else b"".join(map(known, part)) for part in parts]))
        ends = np.zeros(len(out) + 1, dtype=np.int32)
        np.cumsum([len(x) // 4 for x in out], out=ends[1:])
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(out), dtype=np.int32)))


class Decoder:
    """Arrays of ids to the texts of their tokens, or of their numbers, joined by blanks."""

    def __init__(self, vocabulary: Vocabulary):
        top = max(vocabulary.names) + 1
        self.names = pa.array([vocabulary.names.get(i) for i in range(top)], pa.large_string())
        self.numbers = pa.array(list(map(str, range(top))), pa.large_string())

    def _joined(self, ids: pa.Array, texts: pa.Array) -> Iterator[pa.Array]:
        ids, at = ids.fill_null(pa.scalar([], ids.type)), 0
        ends = np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GROUP, side="right")))
            part = ids.slice(at, to - at)
            flat = part.flatten()
            inside = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(texts)))
            found = texts.take(pc.if_else(inside, flat, None))
            if found.null_count:
                raise ValueError("an id is not in the vocabulary")
            offsets = np.concatenate(([0], ends[at:to] - (ends[at - 1] if at else 0)))
            yield pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found), pa.scalar(" ", pa.large_string()))
            at = to

    def decode(self, ids: pa.Array) -> Iterator[pa.Array]:
        """The tokens, some ``GROUP`` of them at a time."""
        return self._joined(ids, self.names)

    def spell(self, ids: pa.Array) -> Iterator[pa.Array]:
        """The ids themselves in decimal."""
        return self._joined(ids, self.numbers)


def _groups(column: pa.Array) -> Iterator[list[str | None]]:
    """The texts of a batch, some ``GROUP`` characters at a time."""
    group, held = [], 0
    for i in range(len(column)):
        text = column[i].as_py()
        group.append(text)
        held += len(text or "")
        if held >= GROUP:
            yield group
            group, held = [], 0
    if group:
        yield group


def _here(vocabulary: Vocabulary, kind: type):
    """The encoder or decoder of this Python worker: the broadcast value lives as long as the worker."""
    held = vocabulary.__dict__.setdefault("held", {})
    if kind not in held:
        held[kind] = kind(vocabulary)
    return held[kind]


def load(path: str) -> Vocabulary:
    """The vocabulary of a tokenizer file of the driver; it travels to the tasks by broadcast."""
    with open(path, encoding="utf-8") as file:
        return Vocabulary(file.read())


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """Add ``ids`` (array of int)."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _here(shared.value, Encoder)
        for column in batches:
            # Results go back group by group: only their total must match the input.
            for group in _groups(column):
                yield encoder.encode(group)
        encoder.rest()

    return df.withColumn("ids", run(F.col(text)))


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """Add ``decoded``: the text of the ids."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = _here(shared.value, Decoder)
        for column in batches:
            for part in decoder.decode(column):
                yield part.cast(pa.string())

    return df.withColumn("decoded", run(F.col(ids)))


def encoded(df: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """``df`` without its text, and ``n_tokens``, ``ids`` and ``decoded_sha256``: what the ids decode to, as a hash.

    Columns of these names are replaced.  Written at once, so that few texts at a time go to Python.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    new = ("n_tokens", "ids", "decoded_sha256")
    rest = df.select(*[F.col(f"`{c}`") for c in df.columns if c != text and c not in new], F.col(f"`{text}`").alias("body"))
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest.schema.fields[:-1])

    def run(batches):
        encoder, decoder = _here(shared.value, Encoder), _here(shared.value, Decoder)
        for batch in tidy(batches):
            at = 0
            for group in _groups(batch.column(batch.num_columns - 1)):
                ids = encoder.encode(group)
                hashes = [hashlib.sha256(x.as_buffer()).hexdigest() for part in decoder.decode(ids) for x in part]
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(at, len(group)) for c in batch.columns[:-1]], pc.list_value_length(ids).cast(pa.int64()), ids,
                     pa.array(hashes, pa.string())], [*batch.schema.names[:-1], *new])
                at += len(group)
        encoder.rest()

    with small_batches(df.sparkSession):
        found = materialise(rest.mapInArrow(run, f"{head}n_tokens long, ids array<int>, decoded_sha256 string"), "encoded")
    shared.destroy()
    return found


def digests(df: DataFrame, vocabulary: Vocabulary, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256)`` per row: the encoding, and the decoding of its ids, as hashes."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        encoder, decoder = _here(shared.value, Encoder), _here(shared.value, Decoder)
        for batch in tidy(batches):
            at = 0
            for group in _groups(batch.column(1)):
                ids = encoder.encode(group)
                hashes = [[hashlib.sha256(x.as_buffer()).hexdigest() for part in parts for x in part]
                          for parts in (decoder.spell(ids), decoder.decode(ids))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(group)), pc.list_value_length(ids).cast(pa.int64()),
                     pa.array(hashes[0], pa.string()), pa.array(hashes[1], pa.string())],
                    ["k", "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(group)
        encoder.rest()

    kind = df.schema[key].dataType.simpleString()
    got = df.select(F.col(key).alias("k"), F.col(text).alias("body")).mapInArrow(
        run, f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return got.withColumnRenamed("k", key)
