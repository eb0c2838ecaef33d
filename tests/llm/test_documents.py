"""The operators on documents against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sondage.llm import bpe, jaccard, linededup, mixing, pii, queries, shards, tokencount, toxicity
from sondage.plans.durable import scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SPACES = " \t\n\x0b\x0c\r"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def corpus(seed=1, n=120):
    """Random texts with copies, near copies, shared lines, nulls and one long text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    line = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 14)))
    common = [line() for _ in range(4)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.15 and texts:
            texts.append(rng.choice(texts))
        elif kind < 0.45 and texts:
            parts = (rng.choice(texts) or "x").split(" ")
            for _ in range(rng.randint(1, 3)):
                parts[rng.randrange(len(parts))] = rng.choice(vocabulary)
            texts.append(" ".join(parts))
        else:
            texts.append("\n".join(rng.choice(common) if rng.random() < 0.3 else line() for _ in range(rng.randint(1, 12))))
    texts += [None, "", " ", "\n\n", "A", "a", "one two three", "One  two\tthree", "\n".join(line() for _ in range(4000))]
    return [(i, t, rng.choice(["x", "y", None])) for i, t in enumerate(texts)]


def brute_components(rows, width, percent):
    sets = {}
    for i, text, *_ in rows:
        w = words(text)
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(max(len(w) - width + 1, 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = [i for i in sorted(sets) if sets[i]]
    for at, i in enumerate(ids):
        for j in ids[at + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_jaccard_links_what_brute_force_links(table, width, percent):
    rows = corpus(width)
    got = {r["owner"]: (r["n_shingles"], r["smallest"])
           for r in jaccard.classes(table(rows), width=width, percent=percent).collect()}
    assert got == brute_components(rows, width, percent)


def test_jaccard_with_leaders_that_do_not_link(table):
    """Copies that are near one base but not near each other: the blocks have to find the links."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        parts = list(base)
        for _ in range(rng.randint(0, 3)):
            parts[rng.randrange(60)] = f"v{rng.randrange(1000)}"
        rows.append((i, " ".join(parts)))
    got = {r["owner"]: (r["n_shingles"], r["smallest"]) for r in jaccard.classes(table(rows), width=4, percent=85).collect()}
    assert got == brute_components(rows, 4, 85)


def test_signatures_of_similar_sets_meet():
    rng = np.random.default_rng(2)
    for percent in (60, 80, 85, 95):
        signatures = jaccard.Signatures(percent)
        for size in [*range(1, 40), 100, 333, 1000]:
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            most = int(size * (100 - percent) / (100 + percent))
            b = np.unique(np.concatenate([a[most:], rng.integers(0, 2**63, most, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if set(a) != set(b) and 100 * both >= percent * (len(a) + len(b) - both):
                assert set(signatures.of(a)) & set(signatures.of(b)), (percent, size)


def test_one_of_each_keeps_clean_rows_and_columns(table):
    rows = [(3, "a b c d e f g h"), (1, "a b c d e f g h"), (1, "a b c d e f g h"), (5, "q r s t u v w x"), (6, None), (None, "z y x w v u")]
    kept = jaccard.one_of_each(table(rows))
    assert kept.columns == table(rows).columns
    assert sorted((str(r["doc_id"]), r["owner"]) for r in kept.collect()) == sorted((str(i), "o") for i in (1, 5, 6, None))


def test_one_of_each_with_null_and_repeated_ids(table):
    near = [" ".join(f"{p}{i}" for i in range(59)) + f" end{e}" for p in "vw" for e in "ab"]
    rows = [(None, near[0]), (None, near[1]), (7, near[2]), (7, near[3]), (7, near[3]), (None, ""), (None, ""), (None, None), (8, ""), (8, "")]
    kept = [(r["doc_id"], (r["text"] or "")[:1]) for r in jaccard.one_of_each(table(rows)).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(None, "v"), (7, "w"), (None, ""), (None, ""), (None, ""), (8, "")]))


def brute_lines(rows):
    first = {}
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            key = line.strip(SPACES).translate(LOWER)
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        keys = [line.strip(SPACES).translate(LOWER) for line in lines]
        out.append((i, "\n".join(x for x, k in zip(lines, keys) if len(k) < 10 or first[k] == i)))
    return out


def test_line_dedup_keeps_first_owners(table):
    rows = [(i, t) for i, t, _ in corpus(9)] + [(500, "Shared line of words\n  SHARED LINE of words\t\nshort"), (2, "another text of the id"), (2, "another text of the id")]
    got = linededup.deduplicate(table(rows))
    assert set(table(rows).columns) < set(got.columns)
    assert sorted((r["doc_id"], r["kept"]) for r in got.collect()) == sorted(brute_lines(rows))


def test_line_dedup_null_id_comes_last(table):
    got = linededup.deduplicate(table([(None, "a line of some length"), (9, "a line of some length\nown line of nine")]))
    assert {r["doc_id"]: r["n_dropped"] for r in got.collect()} == {None: 1, 9: 0}


def thue_morse(n, sep):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return sep.join(word), sep.join(word.translate(str.maketrans("ab", "ba")))


def test_complements_of_thue_morse_stay_apart(table):
    """Strings that every polynomial hash modulo a power of two takes for one."""
    pair = thue_morse(1024, "")
    assert {r["n_dropped"] for r in linededup.deduplicate(table(list(enumerate(pair)))).collect()} == {0}
    texts = [f"one two three {a} four five six {b}" for a, b in (pair, pair[::-1], (pair[0], pair[0]))]
    texts += [t for n in (64, 2048) for t in thue_morse(n, " ")]
    rows = list(enumerate(texts))
    got = {r["owner"]: (r["n_shingles"], r["smallest"]) for r in jaccard.classes(table(rows), width=4, percent=85).collect()}
    assert got == brute_components(rows, 4, 85)


def test_line_bitmaps_are_small(table):
    rows = [(0, "\n".join(f"line number {i} here" for i in range(3000))), (1, "\n".join(f"line number {i} here" for i in range(3000)))]
    found = linededup.keep_bitmaps(table(rows)).collect()
    assert [(r["owner"], r["n_dropped"]) for r in found] == [(1, 3000)] and len(found[0]["bitmap"]) < 60


def test_mix_reaches_its_targets(spark, table):
    rng = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 30))), rng.choice("aabbbbbbbbbbbbc")) for i in range(4000)]
    df = table(rows)
    sizes = df.select("source", mixing.word_count("text").alias("size"))
    targets = {r["source"]: (r["source_size"], r["target"]) for r in mixing.source_targets(sizes).collect()}
    total = sum(s for s, _ in targets.values())
    assert sum(t for _, t in targets.values()) == pytest.approx(total)
    assert all(t <= 3 * s + 1e-9 for s, t in targets.values())
    taken = {}
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    for r in mixed.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + len((r["text"] or "").split())
    for source, (_, target) in targets.items():
        assert taken[source] == pytest.approx(target, rel=0.1)
    assert sorted(r["doc_id"] for r in mixing.mix(df).collect()) == sorted(r["doc_id"] for r in mixed.collect())


def test_bpe_is_the_librarys(table):
    vocabulary = bpe.load(public_tokenizers.path("word_bpe_49k.json"))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(2)
    letters = "abcdefghinort  '1é.,\n!ÄßΣ"
    rows = [(i, t) for i, t, _ in corpus(3, 30)]
    rows += [(1000 + i, "".join(rng.choice(letters) for _ in range(rng.randint(1, 200)))) for i in range(200)]
    rows += [(2000, "x<|endoftext|>y <|startoftext|>"), (2001, "it's ''s'TIS ΑΣ Σ\x1cq\x85b\xa0c​ ½²٣日本🤣é"), (2002, "ab" * 20000)]
    got = {r["doc_id"]: r for r in bpe.digests(table(rows), vocabulary).collect()}
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encoded = {r["doc_id"]: r["ids"] for r in bpe.encode(table(rows[:40]), vocabulary).collect()}
    assert all(encoded[i] == library.encode(t or "", add_special_tokens=False).ids for i, t in rows[:40])


def test_bpe_decodes_any_ids(spark, monkeypatch):
    """Ids that no text has as well, in parts smaller than a row; null ids and columns of the same names."""
    monkeypatch.setattr(bpe, "GROUP", 7)
    vocabulary = bpe.load(public_tokenizers.path("word_bpe_49k.json"))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(8)
    rows = [(i, [rng.randrange(49000) for _ in range(rng.choice([0, 1, 3, 20]))], "old") for i in range(60)] + [(60, None, "old"), (61, [5], "x")]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>, decoded string")
    got = bpe.decode(df, vocabulary)
    assert got.columns == df.columns
    assert [r["decoded"] for r in got.orderBy("doc_id").collect()[:61]] == [
        library.decode(ids or [], skip_special_tokens=False) for _, ids, _ in rows[:61]]
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([([1 << 20],)], "ids array<int>"), vocabulary).collect()
    both = bpe.decode(bpe.encode(df.select("doc_id", F.lit("A word, twice: word.").alias("text"), "ids"), vocabulary), vocabulary)
    assert both.first()["decoded"] == library.decode(library.encode("A word, twice: word.", add_special_tokens=False).ids, skip_special_tokens=False)


def test_bpe_of_one_long_word_takes_linear_time():
    """A million characters without a break."""
    vocabulary = bpe.load(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(1)
    word = "".join(rng.choice("abcdefgh") for _ in range(1_000_000))
    times = []
    for n in (250_000, 1_000_000):
        start = time.process_time()
        ids = next(vocabulary.walk([word[:n]]))
        times.append(time.process_time() - start)
    assert "".join(vocabulary.names[i] for i in ids) == word + "</w>"
    assert times[1] < 8 * times[0] + 1


def test_bpe_forgets_without_changing(monkeypatch):
    vocabulary = bpe.load(public_tokenizers.path("word_bpe_49k.json"))
    texts = [t for _, t, _ in corpus(6, 40)]
    whole = bpe.Encoder(vocabulary).encode(texts).to_pylist()
    monkeypatch.setattr(bpe, "MAX_PIECES", 20)
    small = bpe.Encoder(vocabulary)
    assert [small.encode([t])[0].as_py() for t in texts] == whole


def brute_spans(text):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text or ""):
            digits = "".join(c for c in m[0] if c in "0123456789")
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_are_those_of_the_patterns(table):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("ab1.25-+@ (0)%_é") for _ in range(rng.randint(1, 200)))) for i in range(800)]
    rows += [(900, None), (901, ""), (902, "a" * 50000), (903, "1" * 50000), (904, "x@" * 3000), (905, "1.1.1.1" * 2), (906, "001.2.3.4")]
    got = {r["doc_id"]: r for r in pii.spans(table(rows)).collect()}
    for i, text in rows:
        assert got[i]["base"] == brute_spans(text)
        assert set(got[i]["base"]) <= set(got[i]["all"])


def test_pii_query_counts_each_kind(spark, table, tmp_path):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("0123456789 -+().@a") for _ in range(rng.randint(1, 200)))) for i in range(200)]
    rows += [(300, "a@b.c or x@y.z, 1.2.3.4, 4111 1111 1111 1111, +1 (202) 555-0143"), (301, None), (302, ""), (303, "256.1.1.1"), (None, "a@b.c")]
    table(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r[0]: tuple(r)[1:6] for r in queries.op8_pii(spark, str(tmp_path)).collect()}
    assert got[300][:4] == (2, 1, 1, 1)
    for i, text in rows:
        base = brute_spans(text)
        counts = [sum(x.startswith(f"{kind}:") for x in base) for kind in pii.KINDS]
        assert got[i] == (*counts, hashlib.sha256(",".join(base).encode()).hexdigest())


def test_similar_tokens_get_the_label(table):
    rows = [(i, f"call +1 (2{i % 10}3) 555-7{i:03d} now") for i in range(100)]
    rows += [(200, "call +1 (213) 555-7209 or again 555-7209 please"), (201, "number 555-7209 alone"), (202, "clean words only")]
    got = {r["doc_id"]: r for r in pii.spans(table(rows)).collect()}
    assert got[200]["all"] == ["phone:5:22", "phone:32:40"]
    assert got[201]["all"] == [] and got[202]["all"] == []


def test_labels_reach_every_occurrence_of_a_long_document(table):
    rows = [(i, f"call +1 (2{i % 10}3) 555-7{i:03d} now") for i in range(100)]
    again = " ".join(["or 555-7209 please"] * 60)
    rows += [(200, f"call +1 (213) 555-7209 {again}"), (201, f"{again} call +1 (213) 555-7209")]
    got = {r["doc_id"]: r for r in pii.spans(table(rows)).collect()}
    for i in (200, 201):
        assert len(got[i]["base"]) == 1 and len(got[i]["all"]) == 61


def test_evidence_goes_along_chains_of_any_length():
    """Links that no first occurrence shortens: each node shares a name with the one before only."""
    n = 40
    field = pii.Field([(2, 6 * k, 100000) for k in range(5)])
    shapes, labels = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    labels[0] = 4
    skip = np.array([x for i in range(n - 1) for x in (i, i + 1)])
    none = np.zeros(0, dtype=np.int64)
    assert field.added(shapes, labels, none, skip, none) == [(3, i) for i in range(1, n)]


def test_long_tokens_have_partners_and_shapes():
    local = "ab" * 120 + "1"
    text = f"write {local}@example.com or {local} again"
    assert pii.nodes(text, pii.base_spans(text))[5] == [0, 1]
    assert pii._shape("a1" * 5 + "b") != pii._shape("a1" * 5 + "b-9")


def test_counts_follow_separators_over_blocks(spark, table):
    rows = [(i, t) for i, t, _ in corpus(12, 60)] + [(None, "last one")]
    folder = scratch_path(spark, "flat")
    tokencount.write_flat(table(rows), folder)
    for block in (2, 6, 64, 1 << 20):
        got = [r["n_tokens"] for r in tokencount.count(spark, folder, block_bytes=block).orderBy("ordinal").collect()]
        assert got == [len(words(t)) for _, t in rows], block


def test_tokens_after_the_last_separator_are_a_document(spark, tmp_path):
    np.array([5, 6, 0, 0, 7], "<u2").tofile(tmp_path / "part-00000-a")
    np.array([8, 0, 9, 9, 0], "<u2").tofile(tmp_path / "part-00001-b")
    for block in (2, 4, 1024):
        got = [(r["ordinal"], r["n_tokens"]) for r in tokencount.count(spark, f"file://{tmp_path}", block_bytes=block).orderBy("ordinal").collect()]
        assert got == [(0, 2), (1, 0), (2, 1), (3, 1), (4, 2)]


def test_slots_are_a_permutation():
    for count in (1, 2, 3, 5, 100, 1000, 4097):
        assert sorted(shards.slots(np.arange(count), count, "k")) == list(range(count))
    assert list(shards.slots(np.arange(100), 100, "k")) != list(shards.slots(np.arange(100), 100, "l"))


def test_shards_hold_every_token_once(spark, table):
    rows = [(i, t) for i, t, _ in corpus(15, 50)] + [(3, "a repeated id"), (3, "a repeated id"), (None, "null id")]
    layout = shards.write(table(rows), scratch_path(spark, "shards"), "key", 8, 16)
    found = shards.read(spark, layout, rows=5).collect()
    assert sorted(r["slot"] for r in found) == list(range(layout.count))
    got = {}
    for r in found:
        assert r["shard"] == r["slot"] // 16
        got[r["owner"]] = got.get(r["owner"], 0) + r["n_tokens"]
    expected = {}
    for i, t in rows:
        if words(t):
            i = (1 << 63) - 1 if i is None else i
            expected[i] = expected.get(i, 0) + len(words(t))
    assert got == expected
    part = shards.read(spark, layout, 10, 40, rows=7).collect()
    whole = {r["slot"]: r for r in found}
    assert sorted(r["slot"] for r in part) == list(range(10, 40)) and all(whole[r["slot"]] == r for r in part)


def test_toxic_words_are_learned(spark, table):
    rng = random.Random(3)
    stems = ["lowei", "vequ", "grum"]
    rows, labels = [], []
    for i in range(900):
        parts = ["".join(rng.choice(["an", "er", "th", "ing", "sa", "to"]) for _ in range(rng.randint(1, 4))) for _ in range(60)]
        toxic = i % 7 == 0
        if toxic:
            for _ in range(2):
                parts[rng.randrange(60)] = rng.choice(stems) + rng.choice(["an", "er", "th", "sa", "to", "ing"])
        rows.append((i, " ".join(parts)))
        labels.append((i, int(toxic)))
    rows += [(2000, None), (2001, ""), (2002, "\x00 ... !!"), (5, "again the id five")]
    marks = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, toxic int")
    model = toxicity.fit(table(rows), marks)
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(table(rows[:-1]), model).collect()}
    held = [(got[i], y) for i, y in labels if i % 3 == 0]
    assert sum((s >= 0.3) == bool(y) for s, y in held) / len(held) > 0.97
    assert got[2000] == got[2001] == got[2002] < 0.3 and all(0 <= s <= 1 for s in got.values())
    kept = toxicity.without_toxic(table(rows), model, 0.3)
    assert kept.columns == table(rows).columns and {2000, 2001} < {r["doc_id"] for r in kept.collect()}


def toxic_corpus(n=400):
    """Texts of four scripts with rare words; every 7th is toxic."""
    rng = random.Random(4)
    parts = ["an", "er", "th", "ing", "sä", "то", "日本", "ñu"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(40)]
        if i % 7 == 0:
            words[rng.randrange(40)] = rng.choice(["lowei", "vequ", "grüm"]) + rng.choice(parts)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 7 == 0)))
    return [*rows, (2000, None), (2001, " .. "), (None, "lowei an"), (3, "vequ er th"), (3, "vequ er th")], labels


@pytest.mark.parametrize("most", [(300, 100, 20), (1 << 22, 50, 1 << 20), (0, 0, 0)])
def test_toxicity_uses_every_gram_whatever_the_tables_hold(spark, table, monkeypatch, most):
    rows, labels = toxic_corpus()
    marks = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, toxic int")

    def found(model):
        return sorted(((str(r["doc_id"]), r["score"]) for r in toxicity.scores(table(rows), model).collect()))

    whole = toxicity.fit(table(rows), marks)
    expected = found(whole)
    assert whole.tables.whole
    for name, value in zip(("MOST_GRAMS", "MOST_CONTEXTS", "MOST_ANSWERS"), most):
        monkeypatch.setattr(toxicity, name, value)
    model = toxicity.fit(table(rows), marks)
    assert len(model.tables.grams.keys) <= most[0] and not model.tables.whole
    got = found(model)
    assert [k for k, _ in got] == [k for k, _ in expected]
    assert [s for _, s in got] == pytest.approx([s for _, s in expected], abs=1e-6)
    kept = toxicity.without_toxic(table(rows), model, 0.3)
    assert kept.columns == table(rows).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == [k for k, s in expected if s < 0.3]


def test_rare_toxic_labels_are_in_the_regression(spark, table, monkeypatch):
    """Few toxic ids among many, one id repeated many times: the sample has both classes and each id once."""
    rows, labels = toxic_corpus()
    labels = [(i, y) for i, y in labels if y == 0 or i % 14 == 0]
    repeated = next(i for i, y in labels if y == 0 and zlib.crc32(f"fit-{i}".encode()) % 3 == 0)
    rows += [(repeated, dict((r[0], r[1]) for r in rows)[repeated])] * 300
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    seen = []
    regression = toxicity._regression
    monkeypatch.setattr(toxicity, "_regression", lambda x, y: seen.append(y) or regression(x, y))
    monkeypatch.setattr(toxicity, "FIT_ROWS", 12)
    toxicity.fit(table(rows), marks)
    apart = [y for i, y in labels if zlib.crc32(f"fit-{i}".encode()) % 3 == 0]
    assert sum(apart) * 6 < len(apart)
    assert (seen[0].sum(), len(seen[0])) == (min(6, sum(apart)), min(6, sum(apart)) + 6)


def test_toxicity_without_toxic_ids_apart_is_not_constant(spark, table):
    rows, labels = toxic_corpus()
    labels = [(i, y) for i, y in labels if y == 0 or zlib.crc32(f"fit-{i}".encode()) % 3]
    model = toxicity.fit(table(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(table(rows[:400]), model).collect()}
    toxic, clean = ([got[i] for i, y in labels if y == c] for c in (1, 0))
    assert min(toxic) > 0.3 and np.mean(np.array(clean) < 0.3) > 0.9


def test_toxicity_without_labels(spark, table):
    rows = [(1, "a b"), (2, None)]
    for marks, score in (([], 0.0), ([(1, 1)], 1.0), ([(1, None), (2, 0)], 0.0)):
        model = toxicity.fit(table(rows), spark.createDataFrame(marks, "doc_id long, toxic int"))
        assert {r["score"] for r in toxicity.scores(table(rows), model).collect()} == {score}


def test_empty_tables(spark, table):
    empty = table([])
    vocabulary = bpe.load(public_tokenizers.path("word_bpe_49k.json"))
    assert jaccard.classes(empty).count() == 0 and jaccard.one_of_each(empty).count() == 0
    assert linededup.deduplicate(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert bpe.digests(empty, vocabulary).count() == 0 and pii.spans(empty).count() == 0
    folder = scratch_path(spark, "flat")
    tokencount.write_flat(empty, folder)
    assert tokencount.count(spark, folder).count() == 0
    assert shards.read(spark, shards.write(empty, scratch_path(spark, "shards"), "k")).count() == 0
    model = toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.scores(empty, model).count() == 0
