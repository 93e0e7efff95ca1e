"""Queries of entities, posterior draws, pair suggestions, streamed weights and request constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tessera.functions import requests, sqlfunctions
from tessera.functions import scalars as S
from tessera.functions import signals as G
from tessera.operators import acquisition, agglomeration, catalog, curation, evidence, learning
from tessera.plans.extended import _luma, _ranked, _v2_sql, part_signals
from tessera.plans.registry import ORACLE_SQL, query
from tessera.sources.views import ITEMS_SQL, items, items_dup, pref_events, table
from tessera.streaming import weights

RANK = 4
DIM = 2 * RANK + 3
POOL = 40


@query()
def e8_e9_cluster_mentions(spark, sf_dir):
    """Every item and its noisy copies are mentions; their parents are spread so that copies may meet."""
    mentions = items_dup(spark, sf_dir).select("collection_id", "item_no", (F.col("item_no") % 7).alias("parent"), "vec")
    return agglomeration.cluster_mentions(mentions)


def _pools(spark, sf_dir):
    """Candidates in pools of 40 neighbouring items; the pool's first item is what is asked for."""
    i = items(spark, sf_dir).select("item_no", "collection_id", S.unit("vec").alias("vec"), "auto_reject", F.floor(F.col("item_no") / POOL).alias("problem"))
    asked = i.where(F.col("item_no") % POOL == 0).select("problem", F.col("vec").alias("asked"))
    both = i.join(asked, "problem").withColumn("p", learning.project(F.col("vec"), 64, RANK)).withColumn("q", learning.project(F.col("asked"), 64, RANK)).withColumn("cosine", S.dot("vec", "asked"))
    features = learning.contextual_features(F.col("p"), F.col("q"), F.col("cosine"), [F.col("auto_reject"), F.col("auto_reject").isNull()])
    return both.select("problem", "item_no", F.col("item_no").alias("item_id"), F.col("collection_id").alias("grp"), F.col("cosine").alias("base"), "cosine", features.alias("features"))


def _models(spark, sf_dir):
    """A model for each pool from the comparisons whose preferred item is in it."""
    pools = _pools(spark, sf_dir)
    shown = pref_events(spark, sf_dir).where("choice = 'preferred'").select("event_id", "preferred_no", "rejected_no")
    pairs = learning.pair_events(shown, pools.select("item_no", "features", "cosine")).withColumn("problem", F.floor(F.col("preferred_no") / POOL))
    return learning.fit_by_key(pairs, "problem", DIM).select("problem", "mean", "covariance")


@query()
def k5_posterior_draws(spark, sf_dir):
    return acquisition.posterior_draws(_models(spark, sf_dir), "problem", 16, seed=7)


@query()
def k6_suggest_pairs(spark, sf_dir):
    """The next comparison for every pool that has a model; pairs already compared are not shown again."""
    candidates = _pools(spark, sf_dir).select("problem", "item_id", "grp", "base", "features")
    shown = pref_events(spark, sf_dir).select(F.floor(F.col("preferred_no") / POOL).alias("problem"), F.col("preferred_no").alias("left_id"), F.col("rejected_no").alias("right_id"))
    return acquisition.suggest_pairs(candidates, _models(spark, sf_dir), shown, k=6, cap=2, seed=11)


@query()
def l3_stream_weights(spark, sf_dir):
    """The weights of k7_online_weights, from the same events as a stream of several files."""
    seven = [((F.col("event_id") * k + 11) % 21 - 10) / 10.0 for k in (3, 5, 7, 9, 13, 15, 17)]
    e = pref_events(spark, sf_dir).where("choice = 'preferred'").select("user_id", "ts", "event_id", F.array(*seven).alias("features"))
    return weights.weights_of(e, "weights", 6)


_KINDS = "'夜景', '海边', 'old town', 'birds'"


@query(f"""WITH o AS (SELECT o_orderkey AS i, o_orderkey % 8 AS t, o_orderkey % 50 + 1 AS a, o_orderkey % 101 AS q, o_orderkey % 10 + 1 AS g, o_custkey % 9 + 1 AS k, lower(o_orderpriority) AS who FROM orders)
  SELECT i, CASE WHEN t > 4 THEN NULL WHEN t = 3 THEN a % 20 + a % 20 + 1 WHEN t = 4 THEN k + 5 ELSE a END AS target_count,
    CASE WHEN t > 4 THEN NULL WHEN t < 2 THEN CAST(q AS DOUBLE) ELSE 0.0 END AS min_quality, CASE WHEN t > 4 THEN NULL WHEN t < 2 THEN g ELSE 1 END AS max_per_group,
    CASE WHEN t > 4 THEN NULL ELSE t <> 1 END AS exclude_rejects, CASE WHEN t > 4 THEN NULL WHEN t = 2 THEN who || ':' || a ELSE '' END AS people,
    CASE WHEN t > 4 THEN NULL WHEN t = 3 THEN 'landscape:' || (a % 20 + 1) || ',portrait:' || (a % 20) WHEN t = 4 THEN 'landscape:5,portrait:' || k ELSE '' END AS categories,
    CASE t WHEN 5 THEN 'total_conflict' WHEN 6 THEN 'unknown_condition' WHEN 7 THEN 'inexact_category' END AS error, t <> 2 AS content FROM o""")
def i27_request_constraints(spark, sf_dir):
    """Requests in both languages made from orders: counts, limits, labels, categories, numerals and three kinds of conflict."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("i"), (F.col("o_orderkey") % 8).alias("t"), (F.col("o_orderkey") % 50 + 1).alias("a"), (F.col("o_orderkey") % 101).alias("q"), (F.col("o_orderkey") % 10 + 1).alias("g"),
        (F.col("o_custkey") % 9 + 1).alias("k"), "o_orderpriority",
    )
    kind = F.expr(f"element_at(array({_KINDS}), CAST(k % 4 + 1 AS INT))")
    say = lambda text, *x: F.format_string(text, *x)
    a, q, g = F.col("a"), F.col("q"), F.col("g")
    text = (
        F.when(F.col("t") == 0, say("选 %d 张%s，质量至少 %d，相似组最多 %d 张", a, kind, q, g)).when(F.col("t") == 1, say("Pick %d photos of %s, quality at least %d,\n maximum %d per similarity group, include blurry", a, kind, q, g))
        .when(F.col("t") == 2, say("选%d张，至少%d张有“%s”", a, a, F.col("o_orderpriority"))).when(F.col("t") == 3, say("%d张人像，%d张风景", a % 20, a % 20 + 1))
        .when(F.col("t") == 4, say("%s张人5张风景", F.substring(F.lit(requests.NUMERALS), F.col("k") + 1, F.lit(1)))).when(F.col("t") == 5, say("选%d张%s，选%d张", a, kind, a + 1))
        .when(F.col("t") == 6, say("pick %d photos of %s, no selfies", a, kind)).otherwise(say("选9张，至少%d张风景，%s", a, kind))
    )
    found = requests.extract_constraints(o.select("i", text.alias("text"))).withColumn("content", requests.has_semantic_content(F.col("text")))
    said = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return found.select(
        "i", F.col("target_count").cast("long").alias("target_count"), "min_quality", F.col("max_per_group").cast("long").alias("max_per_group"), "exclude_rejects", said("person_minimums").alias("people"),
        said("category_counts").alias("categories"), "error", "content",
    )


@query(f"""SELECT a.vec_id, a.bits AS average, b.bits AS difference, c.bits AS perceptual, d.bits AS wavelet, CAST(bit_count(a.vec_id) AS INTEGER) AS ones
  FROM ({ORACLE_SQL["i11_average_hash"]}) a JOIN ({ORACLE_SQL["i12_row_difference_hash"]}) b USING (vec_id) JOIN ({ORACLE_SQL["i13_perceptual_hash"]}) c USING (vec_id) JOIN ({ORACLE_SQL["i14_wavelet_hash"]}) d USING (vec_id)""")
def m4_sql_hashes(spark, sf_dir):
    """The four hashes called from SQL."""
    sqlfunctions.register(spark)
    _luma(spark, sf_dir).createOrReplaceTempView("m4_luma")
    bits = lambda call, name: f"array_join(CAST({call} AS ARRAY<STRING>), '') AS {name}"
    return spark.sql(f"""SELECT vec_id, {bits("average_hash(luma)", "average")}, {bits("difference_hash(luma, 8)", "difference")}, {bits("perceptual_hash(luma)", "perceptual")},
      {bits("wavelet_hash(luma, 4)", "wavelet")}, hamming64(CAST(vec_id AS BIGINT), 0L) AS ones FROM m4_luma""")


@query(f"""SELECT s.*, a.quality_score AS advanced_score, a.reject_reason AS advanced_reason,
    round(100 * (0.36 * least(1.0, ln(1 + p_size * 20) / ln(901.0)) + 0.23 * greatest(0, 1 - abs(p_size * 5 - 127.5) / 127.5) + 0.17 * least(1.0, p_size / 64.0) + 0.14 * least(1.0, p_size / 7.5) + 0.10 * least(1.0, p_partkey % 3000 / 2200.0)), 3) AS v1
  FROM ({_v2_sql(0)}) s JOIN ({_v2_sql(1)}) a USING (p_partkey) JOIN part USING (p_partkey)""")
def m4_sql_quality(spark, sf_dir):
    """Both quality scores called from SQL, the second with both profiles."""
    sqlfunctions.register(spark)
    part_signals(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").createOrReplaceTempView("m4_signals")
    given = ", ".join(sqlfunctions.V2_SIGNALS)
    return spark.sql(f"""SELECT p_partkey, array_join(s.flags, ',') AS flags, s.quality_score, s.auto_reject, s.reject_reason, a.quality_score AS advanced_score, a.reject_reason AS advanced_reason, v1
      FROM (SELECT p_partkey, quality_v2('standard', {given}) AS s, quality_v2('advanced', {given}) AS a, quality_v1(p_size * 20, p_size * 5, p_size, p_size, p_partkey % 3000) AS v1 FROM m4_signals)""")


def _numbers(text):
    import re

    for m in re.finditer("[0-9]+", text):
        yield m.group(), m.start()


@query("""SELECT page_id, hit, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) AS BIGINT) AS nth, sum(length(hit)) OVER (PARTITION BY page_id) AS digits
  FROM (SELECT page_id, unnest(regexp_extract_all(url, '[0-9]+')) AS hit, generate_subscripts(regexp_extract_all(url, '[0-9]+'), 1) AS i FROM pages)""")
def m2_lateral_detections(spark, sf_dir):
    """A detector as a table function: each number of a url is a row of the page."""
    sqlfunctions.register_detector(spark, "numbers_of", _numbers, "hit string, place int")
    table(spark, sf_dir, "pages").select("page_id", "url").createOrReplaceTempView("m2_pages")
    return spark.sql("""SELECT page_id, hit, CAST(row_number() OVER (PARTITION BY page_id ORDER BY place) AS BIGINT) AS nth, sum(length(hit)) OVER (PARTITION BY page_id) AS digits
      FROM m2_pages, LATERAL numbers_of(url)""")


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'saved to [path]' WHEN 1 THEN 'see http://example.com/a/' || c_custkey ELSE c_mktsegment END AS text, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS n FROM customer""")
def m4_sql_redact(spark, sf_dir):
    """Paths are taken out of texts by SQL; addresses and plain words stay."""
    sqlfunctions.register(spark)
    table(spark, sf_dir, "customer").createOrReplaceTempView("m4_customer")
    return spark.sql("""SELECT c_custkey, r.text, r.n FROM (SELECT c_custkey, redact_paths(CASE c_custkey % 3 WHEN 0 THEN concat('saved to /home/ann/', c_name, '.txt')
      WHEN 1 THEN concat('see http://example.com/a/', c_custkey) ELSE c_mktsegment END) AS r FROM m4_customer)""")


_LIBRARY = """i AS (SELECT o_custkey AS collection_id, o_orderkey AS item_id, o_orderkey AS k, CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice END AS q, o_orderkey % 11 > 0 AS blur, o_orderkey % 13 > 0 AS ph,
  o_orderkey % 17 > 0 AS dh, o_orderkey % 5 = 0 AS rej, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey // 9 END AS g, o_orderkey % 4 > 0 AND o_orderkey % 19 > 0 AND o_orderkey % 23 > 0 AS emb, 'e' || (o_orderkey % 31 // 30) AS ep,
  o_orderkey % 6 > 0 AND o_orderkey % 29 > 0 AS ent, CASE WHEN o_orderkey % 37 > 0 THEN 'f' || (o_orderkey % 41 // 40) END AS fp FROM orders)"""


@query(f"""WITH {_LIBRARY}, a AS (SELECT collection_id, count(*) AS items, count(*) FILTER (q IS NOT NULL AND blur AND ph AND dh) AS analyzed, count(*) FILTER (rej) AS rejected, count(DISTINCT g) AS groups, count(*) FILTER (emb) AS embedded,
    CASE WHEN count(DISTINCT ep) FILTER (emb) = 1 THEN max(ep) FILTER (emb) END AS embedding_provider, count(*) FILTER (ent) AS processed, CASE WHEN count(DISTINCT fp) FILTER (ent) = 1 THEN max(fp) FILTER (ent) END AS entity_provider FROM i GROUP BY 1),
  m AS (SELECT collection_id, count(*) AS n FROM i JOIN lineitem ON l_orderkey = item_id GROUP BY 1), s AS (SELECT user_id AS collection_id, count(*) AS n FROM events GROUP BY 1)
  SELECT c_custkey AS collection_id, coalesce(items, 0) AS items, coalesce(analyzed, 0) AS analyzed, coalesce(rejected, 0) AS rejected, coalesce(groups, 0) AS groups, coalesce(embedded, 0) AS embedded, embedding_provider,
    coalesce(m.n, 0) AS mentions, coalesce(processed, 0) AS processed, entity_provider, coalesce(s.n, 0) AS selections
  FROM customer LEFT JOIN a ON a.collection_id = c_custkey LEFT JOIN m ON m.collection_id = c_custkey LEFT JOIN s ON s.collection_id = c_custkey""")
def d1_library_overview(spark, sf_dir):
    """Customers as collections, orders as items with stale and current derived values, lines as mentions, events as selections."""
    k = F.col("o_orderkey")
    some = lambda n, value: F.when(k % n > 0, value)
    named = lambda letter, n: F.concat(F.lit(letter), F.floor(k % n / (n - 1)).cast("string"))
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("collection_id"), k.alias("item_id"), some(7, F.col("o_totalprice")).alias("quality_score"), some(11, F.lit(1.0)).alias("blur_score"), some(13, k).alias("phash"), some(17, k).alias("dhash"),
        (k % 5 == 0).alias("auto_reject"), F.when(k % 3 == 0, F.floor(k / 9)).alias("group_id"), (k * 3).alias("file_size"), (k * 5).alias("mtime"), some(4, F.lit("v")).alias("embedding_path"),
        (k * 3 + (k % 19 == 0).cast("long")).alias("embedding_size"), (k * 5).alias("embedding_mtime"), F.when(k % 23 > 0, F.sha2(k.cast("string"), 256)).otherwise("G" * 64).alias("embedding_sha"), named("e", 31).alias("embedding_provider"),
        (k % 6 > 0).alias("processed"), (k * 3).alias("entity_size"), F.when(k % 29 > 0, k * 5).alias("entity_mtime"), some(37, named("f", 41)).alias("entity_provider"),
    )
    collections = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("collection_id"))
    mentions = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"))
    return catalog.library_overview(collections, orders, mentions, table(spark, sf_dir, "events").select(F.col("user_id").alias("collection_id")))


@query("""WITH c AS (SELECT DISTINCT o_custkey AS problem, o_orderkey AS item_id, o_orderpriority AS grp, o_orderstatus AS cat, o_orderkey % 4 AS l FROM orders),
  r AS (SELECT DISTINCT o_custkey AS problem, o_orderkey + CASE WHEN o_orderkey % 67 = 0 THEN 1 ELSE 0 END AS item_id FROM orders WHERE o_orderkey % 9 = 0),
  q AS (SELECT problem, count(*) AS asked, count(c.item_id) AS there FROM r LEFT JOIN c USING (problem, item_id) GROUP BY 1),
  h AS (SELECT problem, count(*) FILTER (cat = 'O') AS o, count(*) FILTER (l = 1) AS l FROM c GROUP BY 1), m AS (SELECT problem, sum(least(n, 2)) AS room FROM (SELECT problem, grp, count(*) AS n FROM c GROUP BY 1, 2) GROUP BY 1)
  SELECT problem, CASE WHEN coalesce(asked, 0) > 6 OR coalesce(asked, 0) > coalesce(there, 0) THEN 'required_items_infeasible' WHEN coalesce(o, 0) < 3 THEN 'category_quota_infeasible'
    WHEN coalesce(l, 0) < 2 OR coalesce(room, 0) < 6 THEN 'infeasible' ELSE 'feasible' END AS status FROM h FULL JOIN m USING (problem) FULL JOIN q USING (problem)""")
def g5_selection_feasibility(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("problem"), k.alias("item_id"), F.col("o_orderpriority").alias("grp"), F.col("o_orderstatus").alias("category"), F.array((k % 4).cast("string")).alias("labels"))
    required = o.where("item_id % 9 = 0").select("problem", (F.col("item_id") + (F.col("item_id") % 67 == 0).cast("int")).alias("item_id"))
    return catalog.selection_feasibility(o, required, 6, 2, {"O": 3}, {"1": 2})


@query(f"""WITH {ITEMS_SQL} SELECT item_id, concat_ws('; ', CASE WHEN item_no % 3 > 0 THEN 'semantic similarity ' || printf('%.3f', item_no % 1000 / 1000.0) END, 'quality ' || printf('%.1f', quality_score) || '/100',
    'passes reject and collection constraints', CASE WHEN item_no % 4 > 0 THEN 'personal preference fit ' || printf('%.3f', item_no % 500 / 500.0) || ' from ' || (item_no % 4) || ' comparisons' END) AS plain,
  CASE WHEN item_no % 4 > 0 THEN 'learned contextual utility residual ' || printf('%+.3f', item_no % 500 / 500.0 - 0.5) || ' from ' || (item_no % 4) || ' comparisons' ELSE 'passes reject and collection constraints' END AS learned FROM items""")
def i36_grounded_reasons(spark, sf_dir):
    n = F.col("item_no")
    meaning, fit, seen = F.when(n % 3 > 0, n % 1000 / 1000.0), n % 500 / 500.0, (n % 4).cast("int")
    plain = G.grounded_reasons(meaning, F.col("quality_score"), fit, seen)
    learned = G.grounded_reasons(meaning, F.col("quality_score"), fit - 0.5, seen, contextual=True)
    return items(spark, sf_dir).select("item_id", F.array_join(plain, "; ").alias("plain"), F.element_at(learned, -1).alias("learned"))


@query(f"""WITH r AS ({ORACLE_SQL["c1_search"]}), s AS (SELECT query_id, item_id, rank, 'm' || CASE WHEN rank = 7 AND query_id LIKE '%40' THEN 1 ELSE 0 END AS p FROM r),
  e AS (SELECT query_id, count(*) AS n, '{{"evidence":[' || string_agg('{{"item_id":"' || item_id || '","rank":' || rank || ',"score":' || CAST(rank AS DOUBLE) / 2 || '}}', ',' ORDER BY rank) || '],"schema":"evidence/1"}}' AS j,
    bool_or(p <> 'm0') AS other, bool_or(item_id LIKE '%9') AS outside FROM s GROUP BY 1)
  SELECT query_id, CAST(n AS BIGINT) AS n, sha256('{{"query":"like ' || query_id || '","schema":"evidence/1"}}') AS query_digest, sha256(j) AS evidence_digest, concat_ws(',', CASE WHEN outside THEN 'outside_candidates' END, CASE WHEN other THEN 'provider' END) AS violations FROM e""")
def j2_evidence_snapshots(spark, sf_dir):
    ranked = _ranked(spark, sf_dir).select("query_id", "item_id", "rank", (F.col("rank") / 2).alias("score"), F.when((F.col("rank") == 7) & F.col("query_id").endswith("40"), "m1").otherwise("m0").alias("provider"))
    queries = ranked.select("query_id").distinct().withColumns({"query": F.concat(F.lit("like "), "query_id"), "provider": F.lit("m0")})
    found = evidence.evidence_snapshots(queries, ranked.where("item_id not like '%9'").select("query_id", "item_id"), ranked, 10)
    return found.select("query_id", "n", "query_digest", "evidence_digest", F.array_join("violations", ",").alias("violations"))


@query("""WITH q AS (SELECT DISTINCT conv_id FROM conversations), e AS (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY 1, 2),
  l AS (SELECT conv_id, string_agg('"' || turn || '"', ',' ORDER BY turn) AS ids, string_agg('{"caption":"\\u003cb\\u003e \\u0026 ' || role || ' in [path]","item_id":' || turn || ',"rank":' || turn || ',"score":0.5}', ',' ORDER BY turn) AS rows, count(*) AS n FROM e GROUP BY 1)
  SELECT conv_id AS query_id, sha256('CONTROL {"allowed_ids":[' || ids || ']}' || chr(10) || 'TASK {"query":"what is in [path]"}' || chr(10) || '<BEGIN_EVIDENCE>{"evidence":[' || rows || ']}<END_EVIDENCE>') AS digest, CAST(n + 1 AS BIGINT) AS redacted FROM l""")
def j4_prompt_packages(spark, sf_dir):
    """Turns as evidence of their conversation; markup and local paths in captions and in the question are made harmless."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    queries = c.select(F.col("conv_id").alias("query_id")).distinct().withColumn("query", F.concat(F.lit("what is in /home/ann/"), F.col("query_id").cast("string")))
    caption = F.concat(F.lit("<b> & "), "role", F.lit(" in /home/ann/"), F.col("turn").cast("string"))
    rows = c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.col("turn").alias("item_id"), caption.alias("caption"), F.lit(0.5).alias("score"))
    return evidence.prompt_packages(queries, rows).select("query_id", F.sha2("payload", 256).alias("digest"), "redacted")


@query(f"""WITH {ITEMS_SQL}, x AS (SELECT item_no, collection_id, file_name AS path, CASE WHEN item_no % 13 > 0 THEN quality_score END AS q, CASE WHEN item_no % 5 > 0 THEN capture_ts END AS t, auto_reject FROM items),
  r AS (SELECT 'path' AS mode, item_no, collection_id, row_number() OVER (PARTITION BY collection_id ORDER BY path) AS place, count(*) OVER (PARTITION BY collection_id) AS total FROM x
    UNION ALL SELECT 'quality', item_no, collection_id, row_number() OVER (PARTITION BY collection_id ORDER BY q DESC NULLS LAST, path), count(*) OVER (PARTITION BY collection_id) FROM x WHERE NOT auto_reject
    UNION ALL SELECT 'capture_time', item_no, collection_id, row_number() OVER (PARTITION BY collection_id ORDER BY t NULLS LAST, path), count(*) OVER (PARTITION BY collection_id) FROM x)
  SELECT mode, collection_id, item_no, CAST(place AS INTEGER) AS place, total FROM r WHERE place > 5 AND place <= 25""")
def g1_list_items(spark, sf_dir):
    """The second to fifth page of five of every collection, in each listing order; by quality without rejected items."""
    i = items(spark, sf_dir).select(
        "item_no", "collection_id", F.col("file_name").alias("path"), "auto_reject", F.when(F.col("item_no") % 13 > 0, F.col("quality_score")).alias("quality_score"), F.when(F.col("item_no") % 5 > 0, F.col("capture_ts")).alias("capture_ts")
    )
    pages = [curation.list_items(i, m, 20, 5, include_rejects=m != "quality", tie="item_no").select(F.lit(m).alias("mode"), "collection_id", "item_no", "place", "total") for m in curation.LISTINGS]
    return reduce(lambda a, b: a.unionByName(b), pages)
