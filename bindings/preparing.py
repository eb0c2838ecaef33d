"""Encoding, imputation, cleaning, splitting and resampling."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from bindings.profiling import EVENT_FEATURES, rounded
from bindings.registry import query
from bindings.tables import CONST, DOC, DUP, EVENT, LINE, LINE_FEATURES, NULLS
from sondage.functions.scalars import right_closed_bin
from sondage.operators import prepare


@query("label_encode", f"""WITH {NULLS}, d AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx
   FROM (SELECT DISTINCT coalesce(priority, 'missing') AS label FROM nulls))
  SELECT o_orderkey, priority, idx AS priority_idx FROM nulls JOIN d ON coalesce(priority, 'missing') = label""")
def _(t):
    return prepare.label_encode(t.null().select("o_orderkey", "priority"), "priority")


@query("impute_median", f"""WITH {NULLS} SELECT o_orderkey, round(coalesce(price, (SELECT median(price) FROM nulls)), 4) AS price FROM nulls""")
def _(t):
    return rounded(prepare.impute_median(t.null().select("o_orderkey", "price"), ["price"]), 4, "price")


@query("impute_mode", f"""WITH {NULLS} SELECT o_orderkey, coalesce(priority, (SELECT priority FROM nulls WHERE priority IS NOT NULL
   GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS priority FROM nulls""")
def _(t):
    return prepare.impute_mode(t.null().select("o_orderkey", "priority"), ["priority"])


@query("standard_scale", f"""WITH {EVENT} SELECT event_id, round((value - avg(value) OVER ()) / stddev_pop(value) OVER (), 5) + 0 AS value,
   round((hour - avg(hour) OVER ()) / stddev_pop(hour) OVER (), 5) + 0 AS hour FROM event""")
def _(t):
    df = prepare.standard_scale(t.event().select("event_id", "value", "hour"), ["value", "hour"])
    return df.select("event_id", *[(F.round(c, 5) + 0.0).alias(c) for c in ("value", "hour")])


@query("one_hot", f"""WITH {NULLS} SELECT o_orderkey, coalesce((o_orderstatus = 'F')::INT, 0) AS "o_orderstatus_F",
  coalesce((o_orderstatus = 'O')::INT, 0) AS "o_orderstatus_O", coalesce((o_orderstatus = 'P')::INT, 0) AS "o_orderstatus_P" FROM nulls""")
def _(t):
    return prepare.one_hot(t.null().select("o_orderkey", "o_orderstatus"), "o_orderstatus")


@query("feature_names", f"""WITH {DOC}, x AS (SELECT 0 AS g, 'n_chars' AS feature UNION ALL SELECT DISTINCT 1, 'lang_' || lang FROM doc
   UNION ALL SELECT DISTINCT 2, 'source_' || source FROM doc)
  SELECT row_number() OVER (ORDER BY g, feature) - 1 AS position, feature FROM x""")
def _(t):
    return prepare.feature_names(t.doc(), ["n_chars"], ["lang", "source"])


@query("class_weights", f"""WITH {DOC}, c AS (SELECT quality, count(*) AS n_c FROM doc GROUP BY 1)
  SELECT quality, n_c, round((SELECT sum(n_c) FROM c) / ((SELECT count(*) FROM c) * n_c)::DOUBLE, 6) AS weight FROM c""")
def _(t):
    return rounded(prepare.class_weights(t.doc(), "quality"), 6, "weight")


@query("log1p_skewed", f"""WITH {DOC}, s AS (SELECT min(n_chars) > 0 AND count(DISTINCT n_chars) > 10 AND
   abs(skewness(n_chars) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0))) > 1.5 AS hit FROM doc)
  SELECT doc_id, round(CASE WHEN hit THEN ln(1.0::DOUBLE + n_chars) ELSE n_chars END, 6) AS n_chars FROM doc, s""")
def _(t):
    df, _ = prepare.log1p_skewed(t.doc().select("doc_id", "n_chars"), ["n_chars"])
    return rounded(df, 6, "n_chars")


@query("clip_iqr", """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
  SELECT event_id, round(least(greatest(value, a - 1.5 * (b - a)), b + 1.5 * (b - a)), 4) AS value FROM events, q""")
def _(t):
    return rounded(prepare.clip_iqr(t.events.select("event_id", "value"), ["value"])[0], 4, "value")


@query("drop_duplicates", f"WITH {DUP} SELECT DISTINCT * FROM dup")
def _(t):
    return prepare.drop_duplicates(t.dup())


FIXED = f"""{NULLS}, src AS (SELECT price, priority, o_orderstatus FROM nulls UNION ALL SELECT price, priority, o_orderstatus FROM nulls),
 m AS (SELECT median(price) AS med FROM src),
 md AS (SELECT priority AS mode FROM src WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
 ded AS (SELECT DISTINCT coalesce(price, med) AS price, coalesce(priority, mode) AS priority, o_orderstatus FROM src, m, md),
 sk AS (SELECT min(price) > 0 AND count(DISTINCT price) > 10 AND
   abs(skewness(price) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0))) > 1.5 AS hit FROM ded),
 lg AS (SELECT CASE WHEN hit THEN ln(1.0::DOUBLE + price) ELSE price END AS price, priority, o_orderstatus FROM ded, sk),
 fq AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM lg),
 fixed AS (SELECT round(least(greatest(price, a - 1.5 * (b - a)), b + 1.5 * (b - a)), 4) AS price, priority, o_orderstatus FROM lg, fq)"""


def _source(t):
    rows = t.null().select("price", "priority", "o_orderstatus")
    return rows.unionAll(rows)


@query("auto_fix", f"WITH {FIXED} SELECT * FROM fixed")
def _(t):
    clean, _ = prepare.auto_fix(_source(t), "o_orderstatus", aggressive=True)
    return rounded(clean, 4, "price")


@query("auto_fix_log", f"""WITH {FIXED}, c AS (SELECT o_orderstatus, count(*) AS n FROM ded GROUP BY 1)
  SELECT 1 AS step, 'price' AS feature, 'Filled price (numeric) missing values with median.' AS change
  UNION ALL SELECT 2, 'priority', 'Filled priority (categorical) missing values with mode.'
  UNION ALL SELECT 3, '*', printf('Removed %d duplicate rows.', (SELECT count(*) FROM src) - (SELECT count(*) FROM ded))
  UNION ALL SELECT 4, 'price', 'Applied log transform to skewed feature: price.' FROM sk WHERE hit
  UNION ALL SELECT 5, 'price', printf('Clipped %d outliers in price to IQR bounds.', n) FROM (SELECT count(*) AS n FROM lg, fq
     WHERE price < a - 1.5 * (b - a) OR price > b + 1.5 * (b - a)) WHERE n > 0
  UNION ALL SELECT 6, 'o_orderstatus', printf('Class imbalance detected (ratio: %.1f). Consider SMOTE or class weights in model training.', r)
     FROM (SELECT max(n) / min(n)::DOUBLE AS r FROM c) WHERE r > 3""")
def _(t):
    return prepare.auto_fix(_source(t), "o_orderstatus", aggressive=True)[1]


@query("fix_summary", f"""WITH {FIXED}
  SELECT 'n_rows' AS metric, (SELECT count(*) FROM src) AS before, (SELECT count(*) FROM fixed) AS after
  UNION ALL SELECT 'missing_total', (SELECT 2 * count(*) - count(price) - count(priority) FROM src), 0
  UNION ALL SELECT 'duplicate_rows', (SELECT count(*) FROM src) - (SELECT count(*) FROM (SELECT DISTINCT * FROM src)),
     (SELECT count(*) FROM lg) - (SELECT count(*) FROM (SELECT DISTINCT least(greatest(price, a - 1.5 * (b - a)), b + 1.5 * (b - a)), priority, o_orderstatus FROM lg, fq))""")
def _(t):
    src = _source(t)
    return prepare.fix_summary(src, prepare.auto_fix(src, "o_orderstatus", aggressive=True)[0])


@query("stratified_split", """SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5('42-' || event_id), event_id)
  <= ceil(count(*) OVER (PARTITION BY event_type) * 0.2::DOUBLE) AS is_test FROM events""")
def _(t):
    return prepare.stratified_split(t.events.select("event_id", "event_type"), "event_id", "event_type")


@query("kfold_assign", """SELECT event_id, event_type, ((row_number() OVER (PARTITION BY event_type ORDER BY md5('42-' || event_id), event_id)
  - 1) % 5)::INT AS fold FROM events""")
def _(t):
    return prepare.kfold_assign(t.events.select("event_id", "event_type"), "event_id", "event_type")


@query("smote", """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT label, count(*) AS n_c FROM e GROUP BY 1),
  r AS (SELECT vec_id, e.label, v, n_c, (SELECT max(n_c) FROM c) - n_c AS need,
    row_number() OVER (PARTITION BY e.label ORDER BY md5('42-' || vec_id), vec_id) AS rn FROM e JOIN c ON e.label = c.label),
  rr AS (SELECT vec_id, label, v, n_c, need // n_c + (rn <= need % n_c)::INT AS copies FROM r WHERE need > 0 AND n_c > 1),
  cp AS (SELECT vec_id, label, v, n_c, unnest(range(1, copies + 1)) AS copy FROM rr),
  pk AS (SELECT *, ('0x' || substr(md5('42-pick-' || vec_id || '-' || copy), 1, 8))::BIGINT % least(5, n_c - 1) + 1 AS rk,
    ('0x' || substr(md5('42-gap-' || vec_id || '-' || copy), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS gap FROM cp),
  nn AS (SELECT a.vec_id, b.vec_id AS neighbour, b.v AS w, row_number() OVER (PARTITION BY a.vec_id
    ORDER BY round(list_distance(a.v, b.v), 9), b.vec_id) AS rk FROM rr a JOIN rr b ON a.label = b.label AND a.vec_id <> b.vec_id)
  SELECT pk.vec_id AS source, copy::INT AS copy, label, neighbour, round(v[1] + (w[1] - v[1]) * gap, 5) AS first_value,
    round(list_sum(v) + (list_sum(w) - list_sum(v)) * gap, 4) AS total FROM pk JOIN nn ON pk.vec_id = nn.vec_id AND pk.rk = nn.rk""")
def _(t):
    out = prepare.smote(t.embeddings, "vec_id", "embedding", "label")
    return out.select(
        "source", "copy", "label", "neighbour", F.round(F.col("embedding")[0], 5).alias("first_value"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("inject_missing", """SELECT event_id, CASE WHEN row_number() OVER (ORDER BY md5('42-' || event_id), event_id)
  <= floor(count(*) OVER () * 0.05::DOUBLE) THEN NULL ELSE value END AS value FROM events""")
def _(t):
    return prepare.inject_missing(t.events.select("event_id", "value"), "event_id", "value")


@query("inject_noise", """WITH s AS (SELECT stddev_samp(value) * 0.5 AS s FROM events), u AS (SELECT event_id, value,
   greatest(('0x' || substr(md5('42-value-' || event_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE, 1e-12) AS u1,
   ('0x' || substr(md5('42-value-' || event_id), 9, 8))::BIGINT / 4294967296.0::DOUBLE AS u2 FROM events)
  SELECT event_id, round(value + sqrt(-2.0 * ln(u1)) * cos(2 * pi() * u2) * s, 5) AS value FROM u, s""")
def _(t):
    return rounded(prepare.inject_noise(t.events.select("event_id", "value"), "event_id", ["value"]), 5, "value")


@query("bin_cut", """SELECT CASE WHEN l_quantity > -1 AND l_quantity <= 12 THEN '0-12' WHEN l_quantity > 12 AND l_quantity <= 24 THEN '13-24'
  WHEN l_quantity > 24 AND l_quantity <= 48 THEN '25-48' WHEN l_quantity > 48 AND l_quantity <= 72 THEN '49-72' END AS bin, count(*) AS n
  FROM lineitem GROUP BY 1""")
def _(t):
    place = right_closed_bin(F.col("l_quantity"), [-1, 12, 24, 48, 72], ["0-12", "13-24", "25-48", "49-72"])
    return t.lineitem.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("batch_prep", f"""WITH {DOC} SELECT doc_id, (1 + (SELECT count(DISTINCT lang) + count(DISTINCT source) FROM doc))::INT AS width,
  round((n_chars - avg(n_chars) OVER ()) / stddev_samp(n_chars) OVER (), 4) AS n_chars_scaled FROM doc""")
def _(t):
    df = prepare.as_doubles(t.doc(), ["n_chars"])
    fitted = prepare.preparation(["n_chars"], ["lang", "source"]).fit(df)
    parts = vector_to_array("features")
    return fitted.transform(df).select("doc_id", F.size(parts).alias("width"), F.round(parts[0], 4).alias("n_chars_scaled"))
