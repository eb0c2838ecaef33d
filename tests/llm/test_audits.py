"""Repair of conversations, filter audit and quality scores against brute force."""

import hashlib
import heapq
import random
import re
import time
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sondage.llm import filteraudit, quality, repair, words
from sondage.llm.queries import op11_conversation_repair
from sondage.llm.words import Hasher

SPACES = " \t\n\x0b\x0c\r"
GRAMMAR = re.compile("(s?(ua)+)?")
PREFIX = re.compile("s?(ua)*u?")


def cheapest(rows):
    """Least (cost, audit) over all edits by uniform-cost search; rows are (role, text, fault).  And what it makes."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, initials, out = heapq.heappop(queue)
        if at == len(rows) and GRAMMAR.fullmatch(initials):
            return cost, audit, list(out)
        # What may follow hangs on the place and, of the initials, on the last one alone.
        if (at, initials[-1:], audit) in done:
            continue
        done.add((at, initials[-1:], audit))
        steps = [(5, "I", at, role[0], (f"{role}:",)) for role in ("user", "assistant") if audit.count("I") < 4]
        if at < len(rows):
            role, text, fault = rows[at]
            steps.append((2, "D", at + 1, "", ()))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                steps.append((more, "K", at + 1, role[:1] or "?", (f"{role}:{text}",)))
                steps += [(more + 1, "R", at + 1, new[0], (f"{new}:{text}",)) for new in ("user", "assistant")]
        for price, edit, to, initial, line in steps:
            if PREFIX.fullmatch(initials + initial):
                heapq.heappush(queue, (cost + price, audit + edit, to, initials + initial, out + line))
    raise AssertionError


def brute_audit(rows):
    """``{conv: (gaps, blank, duplicate, truncated, illegal, cost, audit, hash)}`` of (conv, turn, role, text) rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        here = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv))
        seen, marked = set(), []
        for _, _, role, text in here:
            body = text.rstrip(SPACES)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [t for some, t, *_ in here if some]
        faults = Counter(m[2] for m in marked)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, lines = cheapest(marked)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["blank"], faults["duplicate"],
                     faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Fine.", "Why?", "no end", "", " \n", None, f"Own {turn}!", "Dots.  ", "é?\t"])
            for _ in range(rng.choice([1, 1, 1, 2])):
                rows.append((conv, rng.choice([turn, turn, turn + 2, None]), role, text))
    return rows


def test_automaton_nodes_equal_brute_force():
    """Every word of up to four letters: the least cost and audit from the start to the end."""
    role = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    found = [""]
    for _ in range(3):
        found += [w + x for w in found for x in "dsuaoSUAO" if len(w + x) <= 3]
    for word, node in repair.walk(sorted({w[::-1] for w in found})):
        rows = [(role.get(x.lower(), "user"), f"t{i}", "blank" if x == "d" else "truncated" if x.isupper() else "") for i, x in enumerate(word[::-1])]
        assert node[0][repair.END] == cheapest(rows)[:2], word


@pytest.mark.parametrize(("chunk", "fan", "longest"), [(64, 256, 8), (3, 2, 14)])
def test_repair_equals_brute_force(spark, monkeypatch, chunk, fan, longest):
    """The second case cuts conversations into many chunks of several levels, with few common words."""
    monkeypatch.setattr(repair, "CHUNK", chunk)
    monkeypatch.setattr(repair, "FAN", fan)
    monkeypatch.setattr(repair, "COMMON", 10)
    rows = conversations(chunk, 40, longest)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("chunk", F.lit("x")).withColumn("conv", F.lit(1))
    got = {r[0]: tuple(r[1:]) for r in repair.audit(df.select("conv_id"), df).collect()}
    assert got == brute_audit(rows)


def test_repair_of_turns_that_lie_far_apart(spark):
    rows = [(1, 2**63 - 1, "user", "a."), (1, 0, "assistant", "b."), (2, -(2**62), "user", "a."), (2, 2**62, "assistant", "b."),
            (3, -(2**63), "user", "a."), (3, -1, "assistant", "b."), (3, None, "user", "c."), (4, 1, "user", "a."), (4, 4, "assistant", "b.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r[0]: tuple(r[1:]) for r in repair.audit(df.select("conv_id"), df).collect()}
    assert got == brute_audit(rows)


def test_repair_of_long_runs_of_spaces(spark):
    """A run inside a text is passed once, not once from each of its places."""
    run = " \n" * 250000
    rows = [(1, 0, "user", f"a{run}b."), (1, 1, "assistant", f"a.{run}"), (1, 2, "user", f"a.{run}b"), (1, 3, "user", run)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    start = time.monotonic()
    got = {r[0]: tuple(r[1:]) for r in repair.audit(df.select("conv_id"), df).collect()}
    assert got == brute_audit(rows)
    assert time.monotonic() - start < 60


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([(7, 1, "user", "a."), (None, 1, "user", "a.")], "conv_id long, turn long, role string, text string")
    got = repair.audit(df, df.where("false")).collect()
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {r[0]: tuple(r[1:]) for r in got} == {7: empty, None: empty}
    assert repair.audit(df.where("false"), df.where("false")).count() == 0


def test_rows_of_one_turn_keep_the_order_of_the_table(spark, tmp_path):
    """Turns that several rows share, null ones too: the query takes such rows as they stand in the files, copies beside their row."""
    rng = random.Random(3)
    rows = [(c, rng.choice([0, 0, 1, None]), rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["z. ", "Why?", "open", f"Own {i}."]))
            for c in [*range(30), None] for i in range(6)]
    rng.shuffle(rows)
    columns = zip(("conv_id", "turn", "role", "text"), zip(*rows))
    pq.write_table(pa.table({n: pa.array(v, pa.string() if n in ("role", "text") else pa.int64()) for n, v in columns}), tmp_path / "conversations.parquet")
    damaged = []
    for c, t, role, text in rows:
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        damaged += [(c, t, "user" if hit == 4 else role, "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text)] * {0: 0, 3: 2}.get(hit, 1)
    ordered = sorted(damaged, key=lambda r: (r[1] is not None, r[1] or 0))
    expected, gaps = brute_audit([(c, i, role, text) for i, (c, _, role, text) in enumerate(ordered)]), brute_audit(damaged)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = {r[0]: tuple(r[1:]) for r in op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == {c: (gaps[c][0], *expected[c][1:]) if c in expected else empty for c in {r[0] for r in rows}}
    # The order by role and text would be another one.
    assert any(gaps[c][1:] != expected[c][1:] for c in expected)


def test_damage_is_by_crc(spark):
    rows = [(c, t, "assistant", "One. Two?") for c in (None, *range(30)) for t in (None, 1, 2)]
    got = Counter(map(tuple, repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    expected = Counter()
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else "One Two" if kind == 2 else text)
        expected[row] += 0 if kind == 0 else 2 if kind == 3 else 1
    assert got == +expected


def brute_filters(rows, labels):
    """Rows are (id, text, part)."""
    docs = []
    first = {}
    last = 1 << 63
    for i, text, _ in rows:
        first[text or ""] = min(first.get(text or "", last), last if i is None else i)
    for i, text, part in rows:
        text = text or ""
        found = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(found) < 100, "B": 100 * len(set(found)) < 80 * len(found), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": (last if i is None else i) > first[text]}
        marks = [q for k, *q in labels if k == i and i is not None]
        docs.append((part or "", {k for k, v in fails.items() if v}, any(q == 1 for q, _ in marks), any(t == 1 for _, t in marks)))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            gone = [set(order[: order.index(min(order, key=lambda k: (k not in d[1], order.index(k))))]) if d[1] else None for d in mine]
            for step, letter in enumerate(order):
                before = set(order[:step])
                removed = [d for d in mine if letter in d[1] and not d[1] & before]
                shapley[letter] += len(removed)
                out[part, "".join(order), step + 1] = [
                    sum(not d[1] & (before | {letter}) for d in mine), len(removed), sum(letter in d[1] and bool(d[1] & before) for d in mine),
                    sum(d[1] == {letter} for d in mine), sum(d[2] for d in removed), sum(d[3] for d in removed), letter]
            assert len(gone) == len(mine)
        for key, row in out.items():
            if key[0] == part:
                row[6] = shapley[row[6]]
    return {k: tuple(v) for k, v in out.items()}


LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("collide", [False, True])
def test_filter_audit_equals_brute_force(spark, monkeypatch, collide):
    """With ``collide``, many different texts share a hash."""
    if collide:
        monkeypatch.setattr(filteraudit, "text_hash", lambda text: F.pmod(F.xxhash64(text), F.lit(5)))
    rng = random.Random(3)
    pool = [" ".join(rng.choice(["a", "bb", "Ccc", "$", "dé"] + [f"w{j}" for j in range(rng.choice([3, 400]))]) for _ in range(rng.choice([3, 99, 100, 200])))
            for _ in range(12)] + ["", None, "ABC", "x|y", " \t\n", "word " * 100, " ".join(f"u{j}" for j in range(120))]
    rows = [(i, rng.choice(pool), rng.choice(["en", "de", None])) for i in range(80)]
    rows += [(None, pool[0], "en"), (None, pool[0], "en"), (5, rows[5][1], "de"), (5, "own text of a repeated id", "en"), (999, "x " * 50_000, "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 70, 2)] + [(4, 1, 1), (None, 1, 1), (100_000, 1, 1)]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, text string, lang string, hash string, part string, mask int")
    counts = filteraudit.mask_counts(df, spark.createDataFrame(labels, LABELS))
    got = {tuple(r[:3]): tuple(r[3:]) for r in filteraudit.interactions(counts).collect()}
    assert got == brute_filters(rows, labels)


def test_filter_audit_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filteraudit.interactions(filteraudit.mask_counts(df, spark.createDataFrame([], LABELS))).count() == 0


def test_sketch_clears_only_unique_hashes(spark):
    rows = spark.range(20000).select(F.xxhash64(F.pmod("id", F.lit(19000))).alias("hash"), "id")
    found = {r["id"]: r["maybe"] for r in filteraudit.maybe_repeated(rows).collect()}
    assert len(found) == 20000
    assert all(found[i] for i in range(20000) if i < 1000 or i >= 19000)
    assert sum(found.values()) < 2000 + 0.04 * 18000


def plain_vector(text):
    tokens = re.findall(r"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+", (text or "").encode().decode("latin-1"))
    hasher = Hasher(7, fold=False)

    def of(token):
        data = np.frombuffer(token.encode("latin-1"), dtype=np.uint8)
        return hasher.spans(data, np.array([0]), np.array([len(data)]))

    hashes = [of(t) for t in tokens]
    both = hashes + [words.mix(a * quality._PAIR + words.mix(b)) for a, b in zip(hashes, hashes[1:])]
    return Counter(int(h[0] >> np.uint64(64 - quality.BITS)) for h in both)


@pytest.mark.parametrize("block", [1 << 20, 16])
def test_vectors_count_tokens_and_pairs(monkeypatch, block):
    monkeypatch.setattr(words, "BLOCK", block)
    texts = ["One two!! TWO two", None, "", " ", "é,é,é $$$ a1", "x", "long text of many words, many words of it.\n" * 9, "a"]
    got = {i: Counter() for i in range(len(texts))}
    for text, place, count in quality.vectors(pa.array(texts, pa.string())):
        for i, p, c in zip(text.tolist(), place.tolist(), count.tolist()):
            assert p not in got[i]
            got[i][p] = c
    assert got == {i: plain_vector(t) for i, t in enumerate(texts)}


def test_updates_follow_the_leader():
    """Each weight minimises the regularised sum of what the updates have gathered."""
    rng = np.random.default_rng(1)
    leader, z, n = quality.Leader(), {}, {}
    for _ in range(200):
        places = rng.choice(50, 5, replace=False)
        values, target = rng.random(5), int(rng.integers(2))
        every = [*zip(places.tolist(), values), (1 << quality.BITS, 1.0)]

        def weight(p):
            zi, l1, l2 = z.get(p, 0.0), *((0, 0) if p == 1 << quality.BITS else (quality.L1, quality.L2))
            return 0 if abs(zi) <= l1 else -(zi - (l1 if zi > 0 else -l1)) / ((quality.BETA + n.get(p, 0.0) ** 0.5) / quality.ALPHA + l2)

        w = {p: weight(p) for p, _ in every}
        off = 1 / (1 + np.exp(-sum(w[p] * v for p, v in every))) - target
        for p, v in every:
            g = off * v
            sigma = ((n.get(p, 0.0) + g * g) ** 0.5 - n.get(p, 0.0) ** 0.5) / quality.ALPHA
            z[p], n[p] = z.get(p, 0.0) + g - sigma * w[p], n.get(p, 0.0) + g * g
        leader.update(places, values, target)
    assert all(np.isclose(leader.z[p], v) for p, v in z.items()) and all(np.isclose(leader.n[p], v) for p, v in n.items())


def test_quality_learns_what_marks_bad_texts(spark, monkeypatch):
    monkeypatch.setattr(quality, "FIT_ROWS", 200)
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(2000)]
    rows = []
    for i in range(600):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]
        bad = i % 5 == 0
        rows.append((i, " ".join(w + "$$$" if bad and rng.random() < 0.5 else w for w in body), 0 if bad else 1))
    rows += [(None, "a b", 1), (5, "repeated id", None), (7, None, 1), (1000, "", None), (1001, "word " * 400_000, None)]
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t, _ in rows], "doc_id long, text string, target string, places int, k int")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i is None or i % 2 == 0] + [(2, 1), (4, None), (6, 9), (77777, 0)], "doc_id long, quality int")
    got = quality.scores(df, quality.fit(df, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    held = [(r["score"] >= 0.5, r["doc_id"] % 5 != 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 600 and r["doc_id"] % 2]
    assert sum(a == b for a, b in held) > 0.97 * len(held)
    empty = {r["score"] for r in got if r["doc_id"] in (7, 1000)}
    assert len(empty) <= 2


def test_quality_without_two_classes(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for marks, expected in (([], 0.0), ([(1, 1)], 1.0), ([(1, 0)], 0.0), ([(9, 1)], 0.0)):
        labels = spark.createDataFrame(marks, "doc_id long, quality int")
        assert {r["score"] for r in quality.scores(df, quality.fit(df, labels)).collect()} == {expected}
    assert quality.scores(df.where("false"), quality.fit(df, spark.createDataFrame([], "doc_id long, quality int"))).count() == 0
