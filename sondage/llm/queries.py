"""The operators on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondage.llm import bpe, filteraudit, hamming, jaccard, linededup, mixing, permutations, pii, quality, repair, shards, tokencount, toxicity
from sondage.llm.registry import query, table
from sondage.plans.durable import materialise, scratch_path
from sondage.plans.ordering import number_rows

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
VOCABULARY = "word_bpe_49k.json"


@query("op6_source_mix", f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source),
level AS (
  SELECT *, source_size * {mixing.MAX_REPEAT} AS cap,
    sum(source_size) OVER () AS t, sum(weight) OVER () AS w,
    sum(source_size * {mixing.MAX_REPEAT}) OVER o AS cap_sum, sum(weight) OVER o AS weight_sum, row_number() OVER o AS rn
  FROM sources
  WINDOW o AS (ORDER BY source_size::DOUBLE / weight, source IS NULL, source ROWS UNBOUNDED PRECEDING)),
shared AS (
  SELECT *, (t - cap_sum + cap)::BIGINT::DOUBLE / (w - weight_sum + weight)::BIGINT::DOUBLE AS share FROM level),
lowest AS (SELECT min_by(share, rn) AS share FROM shared WHERE cap > share * weight),
targets AS (
  SELECT source, source_size,
    CASE WHEN l.share IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, l.share * weight) END AS target
  FROM shared, lowest l),
rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('mix-' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
""")
def op6_source_mix(spark, sf_dir):
    """Words the mix takes of every document."""
    documents = table(spark, sf_dir, "documents")
    sized = materialise(documents.select("doc_id", "source", mixing.word_count("text").alias("size")), "sizes")
    targets = materialise(mixing.source_targets(sized), "targets")
    return mixing.with_copies(sized, targets).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op7_line_dedup", f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
numbered AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM split),
keyed AS (SELECT *, translate(trim(line, {_SPACES}), {_LOWER}) AS key FROM numbered),
firsts AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= {linededup.MIN_CHARS} GROUP BY key),
marked AS (
  SELECT k.*, f.first IS NOT NULL AND k.doc_id <> f.first AS dropped FROM keyed k LEFT JOIN firsts f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""")
def op7_line_dedup(spark, sf_dir):
    """What line deduplication keeps of every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    body = F.coalesce(F.col("text"), F.lit(""))
    return linededup.deduplicate(documents).select(
        "doc_id",
        (F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


@query("op10_bpe")
def op10_bpe(spark, sf_dir):
    """Ids and decoded text of every document, as hashes."""
    import public_tokenizers

    vocabulary = bpe.load(public_tokenizers.path(VOCABULARY))
    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)


@query("op3_ngram_jaccard")
def op3_ngram_jaccard(spark, sf_dir):
    """Shingles and component of every document: 4 words, 85 %."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    last = F.lit((1 << 63) - 1)
    return jaccard.classes(documents, width=4, percent=85).select(
        F.nullif("owner", last).alias("doc_id"), "n_shingles", F.nullif("smallest", last).alias("component_id"))


@query("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    """Score of every document; labels of a quarter of the ids are held out."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out)
    model = toxicity.fit(documents, labels)
    return toxicity.scores(documents, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op8_pii")
def op8_pii(spark, sf_dir):
    """Counts of base spans, their hash, and all spans of every document."""
    found = pii.spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # A second argument of the lambda, default or not, would be the place in the array.
    counts = [F.size(F.filter("base", lambda x: x.startswith(f"{k}:"))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(F.encode(F.array_join("base", ","), "UTF-8"), 256).alias("base_sha256"),
        F.array_join("all", ",").alias("spans"))


@query("op4_permutation_index")
def op4_permutation_index(spark, sf_dir):
    """The 20 nearest embeddings found of every 20th one."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return permutations.search(vectors, vectors.where("vec_id % 20 = 0"), 20)


HAMMING_K = 10
_HALF = "list_sum(list_transform(range(32), lambda i: CASE WHEN embedding[{0} + i + 1] > 0 THEN 1::BIGINT << i ELSE 0::BIGINT END))::BIGINT"


@query("op2_hamming_topk", f"""
WITH codes AS (
  SELECT vec_id, {_HALF.format(0)} AS a, {_HALF.format(32)} AS b FROM embeddings
  WHERE len(embedding) = 64 AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, (bit_count(xor(q.a, c.a)) + bit_count(xor(q.b, c.b)))::INTEGER AS distance
  FROM codes q JOIN codes c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= {HAMMING_K}
""")
def op2_hamming_topk(spark, sf_dir):
    """The nearest sign codes of every 50th embedding, exactly."""
    codes = table(spark, sf_dir, "embeddings").select("vec_id", hamming.sign_code("embedding", 8).alias("code"))
    found = hamming.search(codes, codes.where("vec_id % 50 = 0"), HAMMING_K, "vec_id", "code", 8)
    return found.withColumnRenamed("score", "distance")


_WORDS = "len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT"


@query("op5_separator_scan", f"SELECT doc_id, {_WORDS} AS n_tokens FROM documents")
def op5_separator_scan(spark, sf_dir):
    """Tokens of every document, counted in flat files that hold nothing but ids and separators."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = scratch_path(spark, "flat")
    tokencount.write_flat(documents, folder)
    last = F.lit((1 << 63) - 1)
    owners = number_rows(documents.select(F.coalesce("doc_id", last).alias("owner")), ["owner"], name="place")
    return tokencount.count(spark, folder).join(owners, F.col("ordinal") == F.col("place") - 1).select(
        F.nullif("owner", last).alias("doc_id"), "n_tokens")


ORDER_KEY, SEQUENCE, PER_SHARD = "epoch-1", 256, 1 << 14


def _feistel_sql(inner: str) -> str:
    """One pass of the permutation in SQL, over ``(i, x, n, w)``."""
    step = f"SELECT i, n, w, x >> w AS l, x & ((1::BIGINT << w) - 1) AS r FROM ({inner})"
    for xor, factor in shards.round_keys(ORDER_KEY):
        step = (f"SELECT i, n, w, r AS l, xor(l, ((xor(r, {xor}::BIGINT) * {factor}::BIGINT) >> 15) & ((1::BIGINT << w) - 1)) AS r "
                f"FROM ({step})")
    return f"SELECT i, (l << w) | r AS x, n, w FROM ({step})"


@query("op9_training_order", f"""
WITH RECURSIVE sized AS (SELECT doc_id, {_WORDS} AS words FROM documents),
cut AS (
  SELECT doc_id, unnest(range((words + {SEQUENCE - 1}) // {SEQUENCE})) AS chunk, words FROM sized),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, chunk) - 1 AS i, count(*) OVER () AS n FROM cut),
walk AS (
  {_feistel_sql("SELECT i, i AS x, n, greatest(1, (length(bin(n - 1)) + 1) // 2) AS w FROM numbered")}
  UNION ALL
  {_feistel_sql("SELECT * FROM walk WHERE x >= n")})
SELECT x AS slot, (x // {PER_SHARD})::BIGINT AS shard, doc_id, chunk::INTEGER AS chunk,
  least({SEQUENCE}, words - {SEQUENCE} * chunk)::INTEGER AS n_tokens
FROM walk JOIN numbered USING (i) WHERE x < walk.n
""")
def op9_training_order(spark, sf_dir):
    """All sequences as the shard files hold them."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    layout = shards.write(documents, scratch_path(spark, "shards"), ORDER_KEY, SEQUENCE, PER_SHARD)
    last = F.lit((1 << 63) - 1)
    return shards.read(spark, layout).select(
        "slot", "shard", F.nullif("owner", last).alias("doc_id"), F.col("place").alias("chunk"), "n_tokens")


@query("op12_quality")
def op12_quality(spark, sf_dir):
    """Score of every document; labels of a third of the ids are held out."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out)
    return quality.scores(documents, quality.fit(documents, labels)).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


_STRINGS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


@query("op13_filter_audit", f"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {_STRINGS} AS words FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM docs GROUP BY text),
marks AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN d.doc_id > f.first THEN 16 ELSE 0 END AS mask
  FROM docs d JOIN firsts f USING (text) LEFT JOIN marks m ON d.doc_id = m.doc_id),
counts AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask),
orders AS (
  SELECT '' AS o, 'ABCDE' AS rest
  UNION ALL
  SELECT o || substr(rest, i, 1), substr(rest, 1, i - 1) || substr(rest, i + 1) FROM orders, range(1, 6) AS t(i) WHERE i <= length(rest)),
steps AS (
  SELECT o AS filter_order, i::INTEGER AS step, (1 << (ascii(substr(o, i::INTEGER, 1)) - 65)) AS bit,
    coalesce(list_sum(list_transform(range(1, i), lambda j: 1 << (ascii(substr(o, j::INTEGER, 1)) - 65))), 0)::INTEGER AS before
  FROM orders, range(1, 6) AS t(i) WHERE length(o) = 5),
found AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (WHERE mask & (bit | before) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM found
""")
def op13_filter_audit(spark, sf_dir):
    """What five filters remove in each of their 120 orders, by language."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    counts = filteraudit.mask_counts(documents, table(spark, sf_dir, "labels"))
    return filteraudit.interactions(counts)


@query("op11_conversation_repair", """
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
hashed AS (
  SELECT *, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1))))) % 20 AS kind
  FROM named),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, range(2) AS t(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, substr(role, 1, 1) AS initial,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
    regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS body FROM placed),
marked AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN again THEN 'duplicate'
    WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen),
faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM marked GROUP BY conv_id),
fits(q, dest, role) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
kept(q, initial, dest) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
starts AS (
  SELECT q, q AS at, 0 AS cost, '' AS audit, NULL::VARCHAR AS line FROM fits
  UNION ALL SELECT q, dest, 5, 'I', role || ':' FROM fits),
edits AS (
  SELECT q, 'D' AS edit, NULL::VARCHAR AS initial, q AS dest, 2 AS cost, 'D' AS audit, NULL::VARCHAR AS line, NULL::VARCHAR AS new_role FROM fits
  UNION ALL
  SELECT s.q, 'K', k.initial, k.dest, s.cost, s.audit || 'K', s.line, NULL FROM starts s JOIN kept k ON k.q = s.at
  UNION ALL
  SELECT s.q, 'R', NULL, f.dest, s.cost + 1, s.audit || 'R', s.line, f.role FROM starts s JOIN fits f ON f.q = s.at),
dp AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS pos, 0 AS state, 0 AS cost, '' AS audit, NULL::VARCHAR AS body FROM marked
  UNION ALL
  SELECT d.conv_id, m.pos, e.dest, d.cost + e.cost + CASE WHEN e.edit <> 'D' AND m.fault = 'truncated' THEN 5 ELSE 0 END,
    d.audit || e.audit,
    nullif(concat_ws(chr(10), d.body, e.line, CASE WHEN e.edit <> 'D' THEN coalesce(e.new_role, m.role) || ':' || m.text END), '')
  FROM dp d JOIN marked m ON m.conv_id IS NOT DISTINCT FROM d.conv_id AND m.pos = d.pos + 1 JOIN edits e ON e.q = d.state
    AND (e.edit = 'D' OR (m.fault NOT IN ('blank', 'duplicate') AND (e.edit = 'R' OR e.initial = m.initial)))
  QUALIFY row_number() OVER (PARTITION BY d.conv_id, e.dest ORDER BY d.cost + e.cost + CASE WHEN e.edit <> 'D' AND m.fault = 'truncated' THEN 5 ELSE 0 END, d.audit || e.audit) = 1),
ended AS (
  SELECT d.conv_id, d.cost + CASE state WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END AS cost,
    audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit,
    coalesce(concat_ws(chr(10), body, CASE state WHEN 1 THEN 'user:' || chr(10) || 'assistant:' WHEN 2 THEN 'assistant:' END), '') AS body
  FROM dp d JOIN faults f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.n = d.pos),
best AS (SELECT * FROM ended QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
""")
def op11_conversation_repair(spark, sf_dir):
    """Faults, cheapest audit and repair of every conversation, after damage by hash."""
    conversations = repair.with_place(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "text", repair.PLACE)
    return repair.audit(conversations, repair.damage(conversations))
