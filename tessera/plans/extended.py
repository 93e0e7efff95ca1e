"""Queries of entities, evidence, learning, image, text and file operators, registered beside the others."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.functions import images as I
from tessera.functions import scalars as S
from tessera.functions import signals as G
from tessera.functions import sqlfunctions
from tessera.functions import text as X
from tessera.operators import entities as E
from tessera.operators import evidence as D
from tessera.operators import learning as N
from tessera.operators.logs import activate_models
from tessera.plans.registry import ORACLE_SQL, _ranked, query
from tessera.sources import files
from tessera.sources.views import ITEMS_SQL, PREF_SQL, items, pref_events, table

# --- entities ------------------------------------------------------------------------------------------------

_DIGEST = """sha256(concat_ws(':', CAST(count(*) AS VARCHAR), CAST(sum(CAST('0x' || substr(sha256(CAST({m} AS VARCHAR)), 1, 12) AS BIGINT)) AS VARCHAR),
  CAST(sum(CAST('0x' || substr(sha256(CAST({m} AS VARCHAR)), 13, 12) AS BIGINT)) AS VARCHAR)))"""


@query(f"SELECT l_suppkey AS entity, {_DIGEST.format(m='l_orderkey')} AS cluster_id, count(*) AS n FROM lineitem GROUP BY 1")
def e10_cluster_ids(spark, sf_dir):
    return E.with_cluster_id(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity"), "l_orderkey"), "entity", "l_orderkey")


@query("SELECT l_suppkey AS entity, count(*) AS n, min(l_partkey) AS cover FROM lineitem GROUP BY 1")
def e11_entity_summary(spark, sf_dir):
    return E.entity_summary(table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "entity"), "entity", F.col("l_partkey"))


_LABELS = f"""om AS (SELECT o_custkey AS cluster_id, o_orderkey AS member FROM orders),
  nm AS (SELECT o_custkey + CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END AS cluster_id, o_orderkey AS member FROM orders),
  old AS (SELECT DISTINCT o_custkey AS cluster_id, CASE WHEN o_custkey % 3 = 0 THEN 'n' || o_custkey ELSE 'Unknown' END AS label,
    CASE WHEN o_custkey % 3 = 0 THEN 'confirmed' WHEN o_custkey % 7 = 0 THEN 'needs_review' ELSE 'unlabeled' END AS status, CAST(o_custkey % 5 AS INTEGER) AS revision FROM orders),
  rec AS (SELECT o_orderkey AS member FROM orders WHERE o_orderkey % 31 = 0), hist AS (SELECT c_custkey AS cluster_id, CAST(c_custkey % 6 AS INTEGER) AS revision FROM customer WHERE c_custkey % 4 = 0),
  was AS (SELECT cluster_id, {_DIGEST.format(m='member')} AS was FROM om GROUP BY 1), now AS (SELECT cluster_id, {_DIGEST.format(m='member')} AS now FROM nm GROUP BY 1),
  named AS (SELECT DISTINCT nm.cluster_id FROM nm JOIN om USING (member) JOIN old ON old.cluster_id = om.cluster_id WHERE label <> 'Unknown' OR status = 'needs_review'),
  f AS (SELECT now.cluster_id, label, status, old.revision, h.revision AS past, coalesce(was = now, FALSE) AND now.cluster_id NOT IN (SELECT nm.cluster_id FROM nm JOIN rec USING (member)) AS kept,
    now.cluster_id IN (SELECT cluster_id FROM named) OR h.revision IS NOT NULL AS seen
    FROM now LEFT JOIN was USING (cluster_id) LEFT JOIN old USING (cluster_id) LEFT JOIN hist h USING (cluster_id)),
  labels AS (SELECT cluster_id, CASE WHEN kept THEN label ELSE 'Unknown' END AS label, CASE WHEN kept THEN status WHEN seen THEN 'needs_review' ELSE 'unlabeled' END AS status,
    CAST(CASE WHEN kept THEN revision ELSE greatest(coalesce(past, 0), coalesce(revision, 0)) + CAST(seen OR revision IS NOT NULL AS INTEGER) END AS INTEGER) AS revision, kept,
    CASE WHEN seen OR revision IS NOT NULL THEN 'evidence_changed' ELSE 'indexed' END AS reason FROM f)"""


def _labels(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key, member = F.col("o_custkey"), F.col("o_orderkey").alias("member")
    named = key % 3 == 0
    old = o.select(
        key.alias("cluster_id"), F.when(named, F.concat(F.lit("n"), key.cast("string"))).otherwise("Unknown").alias("label"),
        F.when(named, "confirmed").when(key % 7 == 0, "needs_review").otherwise("unlabeled").alias("status"), (key % 5).cast("int").alias("revision"),
    ).distinct()
    moved = o.select((key + F.when(F.col("o_orderkey") % 29 == 0, 1).otherwise(0)).alias("cluster_id"), member)
    history = c.where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("cluster_id"), (F.col("c_custkey") % 6).cast("int").alias("revision"))
    return old, o.select(key.alias("cluster_id"), member), moved, o.where("o_orderkey % 31 = 0").select(member), history


@query(f"WITH {_LABELS} SELECT cluster_id, label, status, revision, kept FROM labels")
def e12_reconcile_labels(spark, sf_dir):
    return E.reconcile_labels(*_labels(spark, sf_dir))[0]


@query(f"""WITH {_LABELS} SELECT cluster_id, label, status, revision, reason FROM labels WHERE NOT kept
  UNION ALL SELECT cluster_id, label, 'needs_review', revision + 1, 'invalidated' FROM old WHERE cluster_id NOT IN (SELECT cluster_id FROM labels WHERE kept)""")
def e12_label_events(spark, sf_dir):
    return E.reconcile_labels(*_labels(spark, sf_dir))[1]


@query(f"""WITH {_LABELS}, hit AS (SELECT DISTINCT cluster_id FROM om JOIN rec USING (member))
  SELECT cluster_id, CASE WHEN h THEN 'Unknown' ELSE label END AS label, CASE WHEN h THEN 'needs_review' ELSE status END AS status, revision + CAST(h AS INTEGER) AS revision
  FROM (SELECT *, cluster_id IN (SELECT cluster_id FROM hit) AS h FROM old)""")
def e13_invalidate_labels(spark, sf_dir):
    old, members, _, changed, _ = _labels(spark, sf_dir)
    return E.invalidate_labels(old, members, changed)


@query(f"""WITH {_LABELS} SELECT cluster_id, count(*) FILTER (o.member IS NULL) AS missing, count(*) FILTER (n.member IS NULL) AS foreign
  FROM om o FULL JOIN nm n USING (cluster_id, member) GROUP BY 1 HAVING count(*) FILTER (o.member IS NULL OR n.member IS NULL) > 0""".replace("o FULL JOIN nm n USING (cluster_id, member)", "o FULL JOIN nm n ON o.cluster_id = n.cluster_id AND o.member = n.member").replace("SELECT cluster_id, count", "SELECT coalesce(o.cluster_id, n.cluster_id) AS cluster_id, count"))
def e14_evidence_mismatch(spark, sf_dir):
    _, stored, evidence, _, _ = _labels(spark, sf_dir)
    return E.evidence_mismatch(stored, evidence)


# --- evidence ------------------------------------------------------------------------------------------------


@query(f"""WITH r AS ({ORACLE_SQL['c1_search']}) SELECT query_id, CAST(count(*) AS INTEGER) AS n, string_agg(item_id, ',' ORDER BY rank) AS items, sha256(string_agg(item_id, ',' ORDER BY rank)) AS digest, TRUE AS valid
  FROM r GROUP BY 1""")
def j2_evidence_bundles(spark, sf_dir):
    return D.evidence_bundles(_ranked(spark, sf_dir), 10)


_PAYLOAD = "'<evidence>' || replace(replace(replace(coalesce(html, ''), '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e') || '</evidence>'"


@query(f"SELECT page_id, length(p) AS n_chars, sha256(p) AS digest FROM (SELECT page_id, {_PAYLOAD} AS p FROM pages)")
def j4_prompt_payloads(spark, sf_dir):
    return D.prompt_payloads(table(spark, sf_dir, "pages"), "page_id", F.col("html")).select("page_id", F.length("payload").cast("long").alias("n_chars"), "digest")


_HOLDOUT = """c AS (SELECT o_orderkey // 2 AS case_id, CASE o_orderkey % 5 WHEN 0 THEN 'tie' WHEN 1 THEN 'left' ELSE 'right' END AS winner, o_custkey AS l, (o_orderkey * 7) % 90 AS r, o_custkey % 4 AS g FROM orders),
  p AS (SELECT l_orderkey // 2 AS case_id, l_linenumber % 3 AS method FROM lineitem), s AS (SELECT case_id, g, l AS d FROM c UNION ALL SELECT case_id, g, r FROM c)"""


@query(f"""WITH {_HOLDOUT} SELECT DISTINCT case_id, 'repeated' AS violation FROM c GROUP BY case_id HAVING count(*) > 1
  UNION ALL SELECT DISTINCT case_id, 'winner' FROM c WHERE winner = 'tie' UNION ALL SELECT DISTINCT case_id, 'same_digest' FROM c WHERE l = r
  UNION ALL SELECT DISTINCT case_id, 'group' FROM s WHERE d IN (SELECT d FROM s GROUP BY d HAVING min(g) <> max(g))
  UNION ALL SELECT DISTINCT case_id, 'coverage' FROM c WHERE case_id NOT IN (SELECT case_id FROM p GROUP BY 1 HAVING count(DISTINCT method) = 3)""")
def j6_validate_holdout(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    case = F.floor(F.col("o_orderkey") / 2)
    winner = F.when(F.col("o_orderkey") % 5 == 0, "tie").when(F.col("o_orderkey") % 5 == 1, "left").otherwise("right")
    cases = o.select(case.alias("case_id"), winner.alias("winner"), F.col("o_custkey").cast("long").alias("left_digest"), ((F.col("o_orderkey") * 7) % 90).cast("long").alias("right_digest"), (F.col("o_custkey") % 4).alias("group"))
    made = li.select(F.floor(F.col("l_orderkey") / 2).alias("case_id"), (F.col("l_linenumber") % 3).alias("method"))
    return D.validate_holdout(cases, made, made.select("method"))


_MODELS = f"""{PREF_SQL}, e AS (SELECT user_id, count(*) AS n, sum(event_id) AS digest FROM pref GROUP BY 1),
  m AS (SELECT user_id AS model_id, user_id, CASE WHEN user_id % 5 = 0 THEN 1 ELSE 2 END AS v, n + CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS n, digest + CASE WHEN user_id % 7 = 0 THEN 1 ELSE 0 END AS digest FROM e)"""


@query(f"WITH {_MODELS} SELECT model_id, CASE WHEN v <> 2 THEN 'schema' WHEN m.n <> e.n THEN 'count' WHEN m.digest <> e.digest THEN 'digest' END AS reason FROM m JOIN e USING (user_id)")
def j9_stale_models(spark, sf_dir):
    e = pref_events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("digest"))
    drift = lambda k: F.when(F.col("user_id") % k == 0, 1).otherwise(0)
    models = e.select(F.col("user_id").alias("model_id"), "user_id", (2 - drift(5)).alias("schema_version"), (F.col("n") + drift(3)).alias("n"), (F.col("digest") + drift(7)).alias("digest"))
    return D.stale_models(models, e, 2)


@query("""WITH p AS (SELECT event_id, user_id AS context, event_id % 40 AS l, (event_id * 7 + 3) % 40 AS r FROM events),
  k AS (SELECT *, least(l, r) AS a, greatest(l, r) AS b FROM p) SELECT event_id FROM k x WHERE event_id % 2 = 0
  AND NOT EXISTS (SELECT 1 FROM k y WHERE y.event_id % 2 = 1 AND y.context = x.context AND y.a = x.a AND y.b = x.b)""")
def k10_unseen_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("context"), (F.col("event_id") % 40).alias("left_no"), ((F.col("event_id") * 7 + 3) % 40).alias("right_no"))
    return D.unseen_pairs(p.where("event_id % 2 = 0"), p.where("event_id % 2 = 1")).select("event_id")


_IMPORT_ID = """sha256('{"preferred_no":' || preferred_no || ',"rejected_no":' || rejected_no || ',"user_id":' || user_id || '}')"""


@query(f"""WITH {PREF_SQL}, n AS (SELECT DISTINCT user_id, preferred_no, rejected_no, {_IMPORT_ID} AS import_id FROM pref)
  SELECT * FROM n WHERE preferred_no IN (SELECT vec_id FROM embeddings) AND rejected_no IN (SELECT vec_id FROM embeddings)
  AND import_id NOT IN (SELECT {_IMPORT_ID} FROM pref WHERE event_id % 3 = 0)""")
def k12_import_pairs(spark, sf_dir):
    e = pref_events(spark, sf_dir)
    there = e.where("event_id % 3 = 0").select(X.canonical_sha256("user_id", "preferred_no", "rejected_no").alias("import_id"))
    known = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_no"))
    return D.import_pairs(e.select("user_id", "preferred_no", "rejected_no"), known, there).select("user_id", "preferred_no", "rejected_no", "import_id")


@query("""SELECT o_orderkey AS model_id, o_custkey AS user_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS active FROM orders""")
def k9_model_history(spark, sf_dir):
    m = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("model_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at"))
    return activate_models(m, ["user_id"]).select("model_id", "user_id", "active")


# --- learning ------------------------------------------------------------------------------------------------


def k7_online_weights(spark, sf_dir):
    seven = [((F.col("event_id") * k + 11) % 21 - 10) / 10.0 for k in (3, 5, 7, 9, 13, 15, 17)]
    e = pref_events(spark, sf_dir).where("choice = 'preferred'").select("user_id", "ts", "event_id", F.array(*seven).alias("features"))
    return N.online_weights(e)


def _features(spark, sf_dir):
    i = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_no"), S.unit("embedding").alias("vec"), "label")
    ask = i.where("item_no = 0").select("vec").first()  # the query: one vector
    asked = F.array(*(F.lit(float(x)) for x in ask[0])) if ask else F.lit(None).cast("array<double>")
    got = i.withColumn("asked", asked).withColumn("p", N.project(F.col("vec"), 64, 16)).withColumn("q", N.project(F.col("asked"), 64, 16))
    cosine = S.dot("vec", "asked")
    return got.select("item_no", N.contextual_features(F.col("p"), F.col("q"), cosine, [F.col("label") % 2 == 0, F.col("label").isNull()]).alias("features"), cosine.alias("cosine"))


def i23_i24_features(spark, sf_dir):
    return _features(spark, sf_dir)


def k8_pair_events(spark, sf_dir):
    e = pref_events(spark, sf_dir).where("choice = 'preferred'").select("event_id", "preferred_no", "rejected_no")
    return N.pair_events(e, _features(spark, sf_dir))


def k3_k4_fit_and_score(spark, sf_dir):
    """Score of each item: its cosine and, learned from all events, the mean of the model times its features."""
    mean, _, _ = N.fit_preference(k8_pair_events(spark, sf_dir), 35)
    weights = F.array(*(F.lit(float(x)) for x in mean))
    learned = S.dot("features", weights)
    return _features(spark, sf_dir).select("item_no", (F.col("cosine") + learned).alias("score"), learned.alias("residual"))


for _f in (k7_online_weights, i23_i24_features, k8_pair_events, k3_k4_fit_and_score):
    query()(_f)

_PAIRS = "p AS (SELECT event_id % 50 AS problem, event_id AS left_no, event_id + 1 AS right_no, (event_id % 97 - 48) / 20.0 AS margin, (event_id % 13) / 4.0 AS variance FROM events)"


def _pairs(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select((e % 50).alias("problem"), e.alias("left_no"), (e + 1).alias("right_no"), ((e % 97 - 48) / 20.0).alias("margin"), ((e % 13) / 4.0).alias("variance"))


@query(f"""WITH {_PAIRS}, u AS (SELECT *, 1 / (1 + exp(-margin / sqrt(1 + pi() * variance / 8))) AS q FROM p), h AS (SELECT *, -(q * ln(q) + (1 - q) * ln(1 - q)) AS entropy FROM u)
  SELECT problem, round(max(entropy), 9) AS entropy FROM h GROUP BY 1""")
def g8_most_uncertain(spark, sf_dir):
    return N.most_uncertain(_pairs(spark, sf_dir), "problem", F.col("margin"), F.col("variance")).select("problem", F.round("entropy", 9).alias("entropy"))


@query(f"""WITH {_PAIRS}, r AS (SELECT problem, left_no, right_no, CAST(row_number() OVER (PARTITION BY problem ORDER BY abs(margin) * variance DESC, left_no, right_no) AS INTEGER) AS rank FROM p)
  SELECT * FROM r WHERE rank <= 16""")
def g7_shortlist(spark, sf_dir):
    p = _pairs(spark, sf_dir).withColumns({"entropy": F.abs("margin"), "member_variance": F.col("variance")})
    return N.shortlist(p, "problem").select("problem", "left_no", "right_no", "rank")


@query("SELECT doc_id, sha256('7:' || doc_id) AS shuffle_key FROM documents")
def g9_hash_shuffle(spark, sf_dir):
    return N.hash_shuffle(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7)


@query("SELECT CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, round(sum(CAST(embedding[i] AS DOUBLE) * CAST(embedding[j] AS DOUBLE)), 6) + 0.0 AS value FROM embeddings, range(1, 65) a(i), range(1, 65) b(j) GROUP BY 1, 2")
def m3_gram(spark, sf_dir):
    return N.gram(table(spark, sf_dir, "embeddings"), "embedding", 64).select("i", "j", (F.round("value", 6) + 0.0).alias("value"))


def _word_counts():
    """A model that needs no weights: characters and blanks of a text."""
    return lambda frame: pd.DataFrame({"doc_id": frame["doc_id"], "vector": [np.array([len(t or ""), (t or "").count(" ")], float) for t in frame["text"]]})


@query("SELECT doc_id, CAST(length(text) AS DOUBLE) AS chars, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS blanks, 'counts-1' AS model FROM documents")
def a14_m1_apply_model(spark, sf_dir):
    done = N.apply_model(table(spark, sf_dir, "documents").select("doc_id", "text"), _word_counts, "doc_id long, vector array<double>", "counts-1")
    return done.select("doc_id", F.get("vector", F.lit(0)).alias("chars"), F.get("vector", F.lit(1)).alias("blanks"), "model")


def _numbers():
    """A detector: each number of a text is one row."""

    def found(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.assign(hit=frame["props"].str.findall(r"[0-9]+")).explode("hit").dropna(subset=["hit"])
        return pd.DataFrame({"event_id": rows["event_id"], "hit": rows["hit"].astype(str)})

    return found


@query("SELECT event_id, unnest(regexp_extract_all(props, '[0-9]+')) AS hit FROM events")
def m2_detections(spark, sf_dir):
    return N.apply_model(table(spark, sf_dir, "events").select("event_id", "props"), _numbers, "event_id long, hit string", "numbers-1").select("event_id", "hit")


@query("SELECT a.vec_id, CAST(bit_count(xor(CAST(a.vec_id AS BIGINT), CAST(a.label AS BIGINT))) AS INTEGER) AS distance, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def m4_sql_functions(spark, sf_dir):
    sqlfunctions.register(spark)
    table(spark, sf_dir, "embeddings").createOrReplaceTempView("m4_embeddings")
    return spark.sql("""SELECT a.vec_id, hamming64(CAST(a.vec_id AS BIGINT), CAST(a.label AS BIGINT)) AS distance, round(cosine(CAST(a.embedding AS ARRAY<DOUBLE>), CAST(b.embedding AS ARRAY<DOUBLE>)), 9) AS cosine
      FROM m4_embeddings a JOIN m4_embeddings b ON b.vec_id = a.vec_id + 1""")


# --- images --------------------------------------------------------------------------------------------------

_LUMA = "l AS (SELECT vec_id, list_transform(embedding, lambda x: ((CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT) % 256) + 256) % 256) AS luma FROM embeddings)"


def _luma(spark, sf_dir):
    level = F.transform("embedding", lambda x: F.pmod(F.floor(x.cast("double") * 1024), F.lit(256)).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", level.alias("luma"))


@query(f"WITH {_LUMA} SELECT vec_id, array_to_string(list_transform(luma, lambda x: CAST(x > list_sum(luma) / 64.0 AS INTEGER)), '') AS bits FROM l")
def i11_average_hash(spark, sf_dir):
    return _luma(spark, sf_dir).select("vec_id", F.array_join(S.average_hash(F.col("luma")).cast("array<string>"), "").alias("bits"))


@query(f"WITH {_LUMA} SELECT vec_id, array_to_string(list_transform(list_filter(range(1, 64), lambda i: i % 8 <> 0), lambda i: CAST(luma[i + 1] > luma[i] AS INTEGER)), '') AS bits FROM l")
def i12_row_difference_hash(spark, sf_dir):
    return _luma(spark, sf_dir).select("vec_id", F.array_join(I.row_difference_hash(F.col("luma"), 8).cast("array<string>"), "").alias("bits"))


@query(f"""WITH {_LUMA}, t AS (SELECT vec_id, [list_sum(list_transform(range(0, 64), lambda i: luma[i + 1] * 4 * cos(pi() * (i // 8 + 0.5) * (k // 2) / 8) * cos(pi() * (i % 8 + 0.5) * (k % 2) / 8))) for k in range(0, 4)] AS c FROM l)
  SELECT vec_id, array_to_string(list_transform(c, lambda x: CAST(x > list_median(c) AS INTEGER)), '') AS bits FROM t""".replace("list_median(c)", "list_aggregate(c, 'median')"))
def i13_perceptual_hash(spark, sf_dir):
    return _luma(spark, sf_dir).select("vec_id", F.array_join(I.perceptual_hash("luma").cast("array<string>"), "").alias("bits"))


@query(f"""WITH {_LUMA}, b AS (SELECT vec_id, list_transform(range(0, 16), lambda k: list_sum(list_transform([0, 1, 8, 9], lambda d: luma[(k // 4) * 16 + (k % 4) * 2 + d + 1]))) AS s FROM l)
  SELECT vec_id, array_to_string(list_transform(s, lambda x: CAST(x > list_aggregate(s, 'median') AS INTEGER)), '') AS bits FROM b""")
def i14_wavelet_hash(spark, sf_dir):
    return _luma(spark, sf_dir).select("vec_id", F.array_join(I.wavelet_hash(F.col("luma"), 4).cast("array<string>"), "").alias("bits"))


@query(f"""WITH {_LUMA}, e AS (SELECT vec_id, unnest(luma) AS g, unnest(list_transform(range(0, 64), lambda i: luma[i + 1 + CASE WHEN i % 8 = 0 THEN 1 ELSE -1 END] + luma[i + 1 + CASE WHEN i % 8 = 7 THEN -1 ELSE 1 END]
    + luma[i + 1 + CASE WHEN i < 8 THEN 8 ELSE -8 END] + luma[i + 1 + CASE WHEN i > 55 THEN -8 ELSE 8 END] - 4 * luma[i + 1])) AS d FROM l)
  SELECT vec_id, round(var_pop(d), 6) AS blur, round(avg(g), 6) AS brightness, round(stddev_pop(g), 6) AS contrast, round(avg(CAST(g >= 250 AS INTEGER)), 6) AS over, round(avg(CAST(g <= 5 AS INTEGER)), 6) AS under,
  round(entropy(g), 6) AS entropy FROM e GROUP BY 1""")
def i16_pixel_signals(spark, sf_dir):
    s = _luma(spark, sf_dir).select("vec_id", I.pixel_signals(F.col("luma"), 8).alias("s"))
    return s.select("vec_id", *(F.round(f"s.{n}", 6).alias(n) for n in ("blur", "brightness", "contrast", "over", "under", "entropy")))


#: (signal, step, modulus, scale): the signals of line p are ((p * step) % modulus) * scale; null where p is divisible by 11
_SIGNALS = {
    "blur_combined": (7, 101, 0.01), "brightness_mean": (13, 256, 1.0), "contrast_score": (5, 64, 1.0), "overexposed_ratio": (3, 97, 0.01), "underexposed_ratio": (9, 89, 0.01),
    "entropy": (17, 71, 0.1), "salient_sharpness": (31, 1999, 1.0), "motion_anisotropy": (19, 100, 0.01), "edge_width_pix": (23, 90, 0.1), "focus_ratio": (29, 80, 0.1),
    "horizon_tilt_deg": (37, 200, 0.1), "composition": (41, 100, 0.01), "worst_clip_dark": (43, 100, 0.01), "worst_clip_bright": (47, 100, 0.01), "color_noise": (53, 100, 0.01),
    "color_cast": (59, 40, 1.0), "dynamic_range": (61, 120, 1.0), "width": (67, 2000, 1.0), "height": (71, 2000, 1.0), "file_size": (73, 90000, 1.0),
}
_OPTIONAL = ("salient_sharpness", "edge_width_pix", "focus_ratio", "horizon_tilt_deg", "composition", "color_noise", "color_cast", "dynamic_range")


def _v2_sql(profile: int) -> str:
    t = {k: v[profile] for k, v in I.THRESHOLDS.items()}
    signals = ", ".join(
        (f"CASE WHEN p % 11 <> 0 THEN {body} END" if n in _OPTIONAL else body) + f" AS {n}" for n, body in ((n, f"((p * {a}) % {m}) * CAST({s} AS DOUBLE)") for n, (a, m, s) in _SIGNALS.items())
    )
    tests = f"""very_blurry: coalesce(salient_sharpness < {t['very_subject_sharp']}, FALSE) OR blur_combined < {t['very_blur_combined']}
      motion_blur: NOT very AND moving
      subject_blurry: NOT very AND NOT moving AND salient_sharpness < {t['subject_sharp']}
      horizon_severe: horizon_tilt_deg > {t['horizon_severe_deg']}
      underexposed: brightness_mean < {t['dark_mean']} OR underexposed_ratio >= {t['dead_shadow']} OR (worst_clip_dark >= {t['dead_shadow']} AND brightness_mean < {t['dark_mean'] * 3})
      overexposed: brightness_mean > {t['bright_mean']} OR overexposed_ratio >= {t['dead_highlight']} OR (worst_clip_bright >= {t['dead_highlight']} AND brightness_mean > {t['bright_mean'] - 20})
      low_information: entropy < {t['low_entropy']}
      too_small: greatest(width, height) < {t['min_long_side']}
      tiny_file: file_size > 0 AND file_size < {t['min_file_size']}
      horizon_tilt: horizon_tilt_deg > {t['horizon_tilt_deg']} AND NOT horizon_tilt_deg > {t['horizon_severe_deg']}
      low_contrast: contrast_score < {t['low_contrast']}
      color_noise: color_noise > {t['color_noise_high']}
      color_cast: color_cast > {t['color_cast_high']}
      flat_tone: dynamic_range < {t['dynamic_range_low']}"""
    said = dict(line.strip().split(": ", 1) for line in tests.splitlines())
    flags = ", ".join(f"CASE WHEN {said[n]} THEN '{n}' END" for n in I.PENALTIES)
    off = " + ".join(f"CASE WHEN list_contains(flags, '{n}') THEN {p} ELSE 0 END" for n, p in I.PENALTIES.items())
    return f"""WITH s AS (SELECT p_partkey AS p, {signals.replace('(p *', '(p_partkey *').replace('p %', 'p_partkey %')} FROM part),
      b AS (SELECT *, {said['very_blurry']} AS very, coalesce(motion_anisotropy > {t['motion_anisotropy']} AND edge_width_pix > {t['edge_width_pix']} AND salient_sharpness < {t['subject_sharp']} AND coalesce(focus_ratio < 5, TRUE), FALSE) AS moving FROM s),
      f AS (SELECT *, list_filter([{flags}], lambda x: x IS NOT NULL) AS flags FROM b),
      q AS (SELECT *, least(greatest(blur_combined * 35 + greatest(25 - abs(brightness_mean - 128) / 128 * 25, 0) + least(contrast_score / 64 * 20, 20) + least(entropy / 7 * 10, 10)
        + coalesce(composition, 0.5) * 10 + {t['score_adjust']} - ({off}), 0), 100) AS score, len(list_filter(flags, lambda x: x IN {I.HARD})) > 0 AS hard FROM f)
      SELECT p AS p_partkey, array_to_string(flags, ',') AS flags, round(score, 3) AS quality_score, hard OR score < {t['score_floor']} AS auto_reject,
        CASE WHEN hard THEN flags[1] WHEN score < {t['score_floor']} THEN 'low_quality' END AS reject_reason FROM q"""


def part_signals(spark, sf_dir):
    p = F.col("p_partkey")
    value = lambda n, a, m, s: F.when((p % 11 != 0) | F.lit(n not in _OPTIONAL), ((p * a) % m) * F.lit(float(s)))
    return table(spark, sf_dir, "part").select(p, *(value(n, *how).alias(n) for n, how in _SIGNALS.items()))


def _v2(spark, sf_dir, profile):
    return I.quality_v2(part_signals(spark, sf_dir), profile).select("p_partkey", F.array_join("flags", ",").alias("flags"), "quality_score", "auto_reject", "reject_reason")


@query(_v2_sql(0))
def i18_quality_v2_standard(spark, sf_dir):
    return _v2(spark, sf_dir, "standard")


@query(_v2_sql(1))
def i18_quality_v2_advanced(spark, sf_dir):
    return _v2(spark, sf_dir, "advanced")


@query("""WITH p AS (SELECT p_partkey AS k, p_brand AS camera, CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS lens, p_size::DOUBLE AS focal, CASE WHEN p_partkey % 3 <> 0 THEN (p_partkey % 9)::DOUBLE END AS ap FROM part)
  SELECT a.k AS p_partkey, round(((a.camera = b.camera)::INTEGER + coalesce((a.lens = b.lens)::INTEGER, 0) + greatest(1 - abs(a.focal - b.focal) / 25, 0)
    + CASE WHEN a.ap IS NULL OR b.ap IS NULL THEN 0 ELSE greatest(1 - abs(a.ap - b.ap) / 4, 0) END)
    / (2 + (a.lens IS NOT NULL AND b.lens IS NOT NULL)::INTEGER + (a.ap IS NOT NULL AND b.ap IS NOT NULL)::INTEGER), 6) AS sim FROM p a JOIN p b ON b.k = a.k + 1""")
def i5_meta_sim(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(
        k, F.col("p_brand").alias("camera"), F.when(k % 5 != 0, F.col("p_type")).alias("lens"), F.concat(F.col("p_size").cast("string"), F.lit("mm")).alias("focal"),
        F.when(k % 3 != 0, F.concat(F.lit("f/"), (k % 9).cast("string"))).alias("aperture"),
    )
    names = ("camera", "lens", "focal", "aperture")
    after = p.select((k - 1).alias("p_partkey"), *(F.col(n).alias(f"next_{n}") for n in names))
    return p.join(after, "p_partkey").select("p_partkey", F.round(I.meta_sim({n: F.col(n) for n in names}, {n: F.col(f"next_{n}") for n in names}), 6).alias("sim"))


@query("""WITH c AS (SELECT c_custkey AS k, c_acctbal::DOUBLE / 200 AS lat, c_nationkey::DOUBLE AS lon FROM customer)
  SELECT a.k AS c_custkey, round(exp(-sqrt((a.lat - b.lat) ** 2 + ((a.lon - b.lon) * cos(radians((a.lat + b.lat) / 2))) ** 2) / 20), 9) AS sim FROM c a JOIN c b ON b.k = a.k + 1""")
def i6_gps_sim(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal").cast("double") / 200).alias("lat"), F.col("c_nationkey").cast("double").alias("lon"))
    after = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return c.join(after, "c_custkey").select("c_custkey", F.round(S.gps_sim("lat", "lon", "lat2", "lon2", 20.0), 9).alias("sim"))


@query(f"""WITH {ITEMS_SQL} SELECT a.item_no, round(least(greatest(list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: p[1] * p[2])), 0), 1), 6) AS sim FROM items a JOIN items b ON b.item_no = a.item_no + 1""")
def i3_hist_sim(spark, sf_dir):
    i = items(spark, sf_dir).select("item_no", "vec")
    after = i.select((F.col("item_no") - 1).alias("item_no"), F.col("vec").alias("next_vec"))
    return i.join(after, "item_no").select("item_no", F.round(S.hist_sim("vec", "next_vec"), 6).alias("sim"))


@query(f"""WITH {ITEMS_SQL} SELECT item_no, quality_score / 100 AS quality, round(least(ln(1 + greatest(blur_score, 0)) / ln(901), 1), 9) AS sharpness, CASE WHEN item_no % 5 = 0 THEN 0.5 ELSE least((item_no % 300) / 255, 1) END AS brightness,
  CASE WHEN item_no % 5 = 0 THEN 0.0 ELSE least((item_no % 80) / 64, 1) END AS contrast, CAST(400 + item_no % 300 > (400 + item_no * 7 % 300) * 1.08 AS DOUBLE) AS landscape,
  CAST(400 + item_no * 7 % 300 > (400 + item_no % 300) * 1.08 AS DOUBLE) AS portrait FROM items""")
def i21_item_features(spark, sf_dir):
    n = F.col("item_no")
    told = F.when(n % 5 != 0, F.to_json(F.struct((n % 300).alias("brightness"), (n % 80).alias("contrast"))))
    f = items(spark, sf_dir).select("item_no", I.item_features(F.lit(None).cast("double"), F.col("quality_score"), F.col("blur_score"), told, 400 + n % 300, 400 + n * 7 % 300).alias("f"))
    names = ("quality", "sharpness", "brightness", "contrast", "landscape", "portrait")
    return f.select("item_no", *((F.round(F.get("f", F.lit(k)), 9) if name == "sharpness" else F.get("f", F.lit(k))).alias(name) for k, name in enumerate(names, 1)))


@query(f"""WITH {ITEMS_SQL} SELECT item_id, concat_ws('; ', 'meaning ' || CAST(round(blur_score) AS BIGINT), CASE WHEN item_no % 3 = 0 THEN 'aesthetic ' || CAST(round(quality_score) AS BIGINT) END, 'technical ' || CAST(round(quality_score) AS BIGINT)) AS reasons FROM items""")
def i36_reasons(spark, sf_dir):
    known = G.reasons(F.col("blur_score"), F.when(F.col("item_no") % 3 == 0, F.col("quality_score")), F.col("quality_score"))
    return items(spark, sf_dir).select("item_id", F.array_join(known, "; ").alias("reasons"))


# --- texts ---------------------------------------------------------------------------------------------------

_PLAIN = "lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')))"
_COUNTS = ", ".join("(" + " + ".join(f"CAST(regexp_matches(t, '{X.term_pattern(w)}') AS INTEGER)" for w in terms) + ")" for terms in X.CONCEPTS.values())


@query(f"""WITH c AS (SELECT doc_id, [{_COUNTS}] AS n FROM (SELECT doc_id, {_PLAIN} AS t FROM documents))
  SELECT doc_id, array_to_string(n, ',') AS counts, CASE WHEN list_sum(n) > 0 THEN round(list_max(n) / sqrt(list_sum(list_transform(n, lambda x: x * x))), 9) END AS top FROM c""")
def i26_concept_vector(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(X.concept_counts(F.col("text")).cast("array<string>"), ",").alias("counts"), F.round(F.array_max(X.concept_vector(F.col("text"))), 9).alias("top"))


@query("""SELECT doc_id, CAST(NOT contains(text, w2) AS INTEGER) AS missing, sha256(trim(regexp_replace(replace(text, 'the', ' '), ' +', ' ', 'g'), ' ')) AS rest FROM (SELECT doc_id, text, 'zq' || doc_id AS w2 FROM documents)""".replace("CAST(NOT contains(text, w2) AS INTEGER)", "CAST(NOT contains(text, w2) AS INTEGER) + CAST(NOT contains(text, 'the') AS INTEGER)"))
def i28_uncovered(spark, sf_dir):
    spans = F.array(F.lit("the"), F.concat(F.lit("zq"), F.col("doc_id").cast("string")))
    u = table(spark, sf_dir, "documents").select("doc_id", X.uncovered(F.col("text"), spans).alias("u"))
    return u.select("doc_id", F.size("u.missing").alias("missing"), F.sha2("u.rest", 256).alias("rest"))


@query()
def i29_redact_paths(spark, sf_dir):
    done = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.redact_paths(F.col("text")).alias("r"))
    return done.select("conv_id", "turn", F.col("r.text").alias("text"), F.col("r.n").alias("n"))


@query("""SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}') AS digest FROM documents""")
def i31_canonical_sha256(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.canonical_sha256("source", "n_chars", "lang", "doc_id").alias("digest"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS valid FROM events")
def i32_json_field(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))


@query("SELECT event_id, CASE event_id % 3 WHEN 2 THEN epoch_us(ts) ELSE epoch_us(date_trunc('second', ts)) END AS micros FROM events")
def i33_event_time(spark, sf_dir):
    e, third = table(spark, sf_dir, "events"), F.col("event_id") % 3
    exif = F.when(third == 0, F.date_format("ts", "yyyy:MM:dd HH:mm:ss")).otherwise("none")
    stamp = F.when(third == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("bad")
    return e.select("event_id", F.unix_micros(S.event_time(exif, stamp, F.col("ts"))).alias("micros"))


# --- files ---------------------------------------------------------------------------------------------------


@query()
def a1_scan_files(spark, sf_dir):
    return files.scan_files(spark, sf_dir, ["parquet"])


@query()
def a2_content_digests(spark, sf_dir):
    return files.content_digests(spark, sf_dir, ["parquet"])
