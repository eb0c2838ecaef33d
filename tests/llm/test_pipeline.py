"""The pipeline on tables with nulls, repeated rows, empty tables and columns named like the operators' own."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sondage.llm.queries import VOCABULARY
from test_documents import brute_components, brute_lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_dropped int, ids string, row int"


@pytest.fixture
def tables(spark, tmp_path):
    """A folder with ``documents`` and ``labels`` of the rows."""

    def make(rows, labels):
        full = [(i, t, "en", s, len(t or ""), "k", 7, "i", 1) for i, t, s in rows]
        spark.createDataFrame(full, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return make


def staged(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        out.append(docs)
    return out


def test_stages_equal_brute_force(spark, tables):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeghi") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    common = [line(9) for _ in range(3)]
    rows, labels = [], []
    for i in range(150):
        toxic = i % 6 == 0
        body = "\n".join(line(rng.randint(8, 30)) for _ in range(3))
        if rng.random() < 0.3:
            body += "\n" + rng.choice(common)
        if toxic:
            body = body.replace(" ", " zzxzz wvwv ", 4)
        elif rng.random() < 0.2 and rows:
            body = rng.choice([t for j, t, _ in rows if j % 6] or [body]) + rng.choice(["", " end"])
        rows.append((i, body, rng.choice(["x", "y", None])))
        labels.append((i, int(toxic)))
    rows += [(None, rows[1][1], "x"), (None, None, None), (1000, "", "y"), (1001, None, "y"), (3, rows[3][1], "x"), (1002, " ".join(vocabulary), "z")]
    clean, lined, single, mixed, encoded = staged(spark, tables(rows, labels))
    for df in (clean, lined, single, mixed):
        assert df.columns == [n.split()[0] for n in SCHEMA.split(", ")]
    left = [(r["doc_id"], r["text"], r["source"]) for r in clean.collect()]
    assert sorted(map(str, left)) == sorted(str(r) for r in rows if r[0] is None or r[0] >= 150 or r[0] % 6)

    big = [(1 << 62 if i is None else i, t, s) for i, t, s in left]
    expected = [(None if i == 1 << 62 else i, None if t is None and not k else k) for (i, k), (_, t, _) in zip(brute_lines(big), big)]
    got = [(r["doc_id"], r["text"], r["n_chars"]) for r in lined.collect()]
    assert sorted(str(r[:2]) for r in got) == sorted(map(str, expected))
    assert all(n == len(t or "") for _, t, n in got)

    numbered = [(i, t) for i, (_, t, _) in enumerate(sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")))]
    parts = brute_components(numbered, 5, 80)
    kept = [(r["doc_id"], r["text"]) for r in single.collect()]
    groups = {c for n, c in parts.values() if n}
    assert len([t for _, t in kept if (t or "").split()]) == len(groups)
    assert {n for n, _ in kept if n is not None} <= {i for i, *_ in got}

    took = [(r["doc_id"], r["text"]) for r in mixed.collect()]
    assert {str(r) for r in took} <= {str(r) for r in kept} and len(took) <= 3 * len(kept)
    library = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    want = []
    for i, t in took:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), ids, hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_tokens"], r["ids"], r["decoded_sha256"])) for r in encoded.collect())


def test_run_of_empty_tables(spark, tables):
    assert corpus_pipeline.run(spark, tables([], [])).count() == 0
