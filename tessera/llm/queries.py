"""One registered query for each numbered operator, and DuckDB SQL where it can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import audit, decontamination, html, lm, merkle, ordinal, packing, repeats, sharding, simhash, substring, topk, toxicity
from tessera.llm.inputs import remainder, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of all documents, learned from the labels whose crc32(doc_id) mod 3 is not 1."""
    ratings = table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 3) != 1).select("doc_id", ordinal.rating().alias("grade"))
    return ordinal.grade(table(spark, sf_dir, "documents"), ratings).withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), use=remainder(F.col("doc_id"), 3) != 1)
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_known_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves and proofs of all documents; every fifth crc32 is checked against a copy with lower-case text."""
    docs = table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    changed = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    claimed = F.when(changed, merkle.leaves(docs, merkle.lower_ascii(F.col("text")))).otherwise(merkle.leaves(docs))
    proven = merkle.manifest(docs.select("doc_id", "source", merkle.leaves(docs).alias("leaf"), claimed.alias("claimed")))
    found = proven.select("doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("proof")).alias("proof_sha256"), merkle.folded(F.col("claimed"), F.col("proof")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign(table(spark, sf_dir, "documents"), 16)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality, op2_toxicity, op3_topk, op4_repeats, op5_substring, op6_html, op7_lm, op8_decontamination, op9_simhash, op10_packing, op11_merkle, op12_audit,
        op13_sharding,
    )
}

OP3_SQL = """
WITH t AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (SELECT DISTINCT vec_id AS query_id, v AS qv FROM t WHERE vec_id % 100 = 0),
s AS (
  SELECT query_id, vec_id, CAST(list_sum(list_transform(list_zip(qv, v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q, t WHERE vec_id <> query_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""

OP4_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
w AS (SELECT doc_id, p, substr(h, CAST(2 * p + 1 AS BIGINT), 100) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM n)),
f AS (SELECT k, min(doc_id) AS m FROM w GROUP BY k),
hit AS (SELECT doc_id, p FROM w JOIN f USING (k) WHERE m < doc_id),
bytes AS (SELECT doc_id, p, substr(h, CAST(2 * p + 1 AS BIGINT), 2) AS b FROM (SELECT doc_id, h, unnest(range(0, n)) AS p FROM n)),
mark AS (
  SELECT bytes.doc_id, bytes.p, b,
         max(hit.p) OVER (PARTITION BY bytes.doc_id ORDER BY bytes.p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM bytes LEFT JOIN hit ON hit.doc_id = bytes.doc_id AND hit.p = bytes.p
),
run AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), FALSE) AS head FROM mark),
a AS (
  SELECT doc_id, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed, CAST(count(*) FILTER (head) AS BIGINT) AS n_spans,
         string_agg(b, '' ORDER BY p) FILTER (NOT gone) AS kept
  FROM run GROUP BY doc_id
)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM n LEFT JOIN a USING (doc_id)
"""

OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
),
k AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d)),
f AS (SELECT k, min(doc_id) AS m FROM k GROUP BY k),
hit AS (SELECT doc_id, p FROM k JOIN f USING (k) WHERE m < doc_id),
word AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
mark AS (
  SELECT word.doc_id, word.p, word,
         max(hit.p) OVER (PARTITION BY word.doc_id ORDER BY word.p ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM word LEFT JOIN hit ON hit.doc_id = word.doc_id AND hit.p = word.p
),
a AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM mark GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""


def _op8_sql() -> str:
    """Every diagonal with enough equal words is compared, without seeds."""
    words = r"regexp_extract_all(lower(text), '([\p{L}\p{N}]+)', 1)"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
b AS (SELECT DISTINCT item_id, {words} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
dw AS (SELECT doc_id, unnest(range(0, len(w))) AS p, unnest(w) AS word FROM d),
bw AS (SELECT item_id, len(w) AS n, unnest(range(0, len(w))) AS p, unnest(w) AS word FROM b),
hits AS (
  SELECT doc_id, item_id, dw.p - bw.p AS diagonal FROM dw JOIN bw USING (word)
  GROUP BY doc_id, item_id, diagonal, n HAVING count(*) >= ceil(least({decontamination.WINDOW}, n) * {decontamination.SIMILAR})
),
pairs AS (
  SELECT doc_id, item_id, len(b.w) AS n, least({decontamination.WINDOW}, len(b.w)) AS width,
         list_transform(range(0, len(b.w)), lambda j: CASE WHEN j + diagonal >= 0 AND d.w[j + diagonal + 1] = b.w[j + 1] THEN 1 ELSE 0 END) AS eq
  FROM hits JOIN d USING (doc_id) JOIN b USING (item_id)
),
found AS (
  SELECT doc_id, item_id, n, width, list_sum(eq) AS matched,
         list_max(list_transform(range(1, n - width + 2), lambda s: list_sum(eq[s:s + width - 1]))) AS best
  FROM pairs
)
SELECT doc_id, item_id, CAST(max(matched) AS BIGINT) AS matched, CAST(max(n) AS BIGINT) AS item_words, CAST(max(best) AS BIGINT) AS best
FROM found WHERE best >= ceil(width * {decontamination.SIMILAR}) GROUP BY doc_id, item_id
"""


#: crc32 of the decimal doc_id, byte by byte and bit by bit (3988292384 is the polynomial, 4294967295 the start and the final mask).
CRC_SQL = """xor(list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i AS BIGINT), 1)) AS BIGINT)),
    lambda c, b: list_reduce(range(0, 8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"""


def _op11_sql(levels: int = 6) -> str:
    """Both trees level by level, up to 16 ** levels leaves each."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    field = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')".format
    head = " || ".join(field(c) for c in merkle.FIELDS[:-1])
    leaf, other = (f"sha256({head} || {field(t)})" for t in ("text", f"translate(text, '{upper}', '{lower}')"))
    steps = [
        f"""d AS (SELECT doc_id, source, {leaf} AS leaf, CASE WHEN {CRC_SQL} % 5 = 0 THEN {other} ELSE {leaf} END AS claimed FROM documents),
l AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
             row_number() OVER () AS id FROM d)""",
        "a0 AS (SELECT g, i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM l)",
    ]
    for tree, start in (("a", None), ("b", f"b0 AS (SELECT 0 AS g, g AS i, h, count(*) OVER () AS n FROM a{levels})")):
        steps += [start] if start else []
        for k in range(levels):
            steps.append(
                f"""{tree}{k + 1} AS (SELECT g, i // 16 AS i, CASE WHEN first(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE first(h) END AS h, CAST(ceil(first(n) / 16) AS BIGINT) AS n
  FROM {tree}{k} GROUP BY g, i // 16)"""
            )
            steps.append(
                f"""{tree}s{k} AS (SELECT x.g, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS left_, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS right_
  FROM {tree}{k} x JOIN {tree}{k} y ON x.g = y.g AND x.i // 16 = y.i // 16 WHERE x.n > 1 GROUP BY x.g, x.i)"""
            )
    steps.append("p0 AS (SELECT doc_id, leaf, claimed AS f, '' AS proof, g, i, id FROM l)")
    at = 0
    for tree in "ab":
        g, i = ("p.g", "p.i") if tree == "a" else ("0", "p.g")
        for k in range(levels):
            node = f"{i} // {16**k}"
            steps.append(
                f"""p{at + 1} AS (SELECT p.doc_id, p.leaf, CASE WHEN s.g IS NULL THEN p.f ELSE sha256(s.left_ || p.f || s.right_) END AS f, p.proof || coalesce(s.left_ || s.right_, '') AS proof, p.g, p.i, p.id
  FROM p{at} p LEFT JOIN {tree}s{k} s ON s.g = {g} AND s.i = {node})"""
            )
            at += 1
    return f"""WITH {", ".join(steps)}
SELECT p.doc_id, p.leaf, u.h AS subroot, r.h AS root, sha256(p.proof) AS proof_sha256, p.f AS folded_root, p.f = r.h AS verified
FROM p{at} p JOIN a{levels} u ON u.g = p.g CROSS JOIN b{levels} r
"""


OP12_SQL = r"""
WITH letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[ 	-
]+'), lambda w: w <> '') AS w FROM documents
), m AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic
  FROM d LEFT JOIN m USING (doc_id)
), c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
steps AS (
  SELECT part, fails, n, good, toxic, filter_order, step, substr(filter_order, CAST(step AS BIGINT), 1) AS x,
         list_min(list_filter(range(1, 6), lambda s: contains(fails, substr(filter_order, CAST(s AS BIGINT), 1)))) AS goes
  FROM c, orders, (SELECT unnest(range(1, 6)) AS step)
), r AS (
  SELECT part, filter_order, x, CAST(step AS INTEGER) AS step, CAST(coalesce(sum(n) FILTER (goes IS NULL OR goes > step), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (goes = step), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (goes < step AND contains(fails, x)), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (fails = x), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(good) FILTER (goes = step), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (goes = step), 0) AS BIGINT) AS toxic_lost
  FROM steps GROUP BY part, filter_order, x, step
)
SELECT * EXCLUDE (x), CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r
"""


ORACLE_SQL = {"op3_topk": OP3_SQL, "op4_repeats": OP4_SQL, "op5_substring": OP5_SQL, "op8_decontamination": _op8_sql(), "op11_merkle": _op11_sql(), "op12_audit": OP12_SQL}
