"""Bundles of ranked evidence, prompts, holdout checks, stale models and imported pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import canonical_sha256, escaped, redact_paths
from tessera.operators.entities import set_digest


def evidence_bundles(ranked: DataFrame, top: int = 20) -> DataFrame:
    """query_id, items, digest, valid: up to `top` ranked rows of each query in order, with the digest of their line.

    A bundle with a repeated item or rank is not valid. A bundle holds at most `top` rows, ties included.
    """
    order = Window.partitionBy("query_id").orderBy("rank", "item_id")
    kept = ranked.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= top)
    grouped = kept.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rn", "item_id"))), lambda x: x["item_id"]).alias("items"),
        (F.count_distinct("item_id") == F.count(F.lit(1))).alias("_once"), (F.count_distinct("rank") == F.count(F.lit(1))).alias("_ranks"),
    )
    return grouped.select("query_id", F.size("items").alias("n"), F.array_join("items", ",").alias("items"), F.sha2(F.array_join("items", ","), 256).alias("digest"), (F.col("_once") & F.col("_ranks")).alias("valid"))


def prompt_payloads(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """key, payload, digest: a text between boundaries that it cannot close itself; null is empty."""
    payload = F.concat(F.lit("<evidence>"), escaped(F.coalesce(text, F.lit(""))), F.lit("</evidence>"))
    return rows.select(key, payload.alias("payload"), F.sha2(payload, 256).alias("digest"))


#: Names the form of the digests below.
EVIDENCE_SCHEMA = "evidence/1"


def evidence_snapshots(queries: DataFrame, candidates: DataFrame, ranked: DataFrame, top: int = 20) -> DataFrame:
    """query_id, n, query_digest, candidate_digest, evidence_digest, violations: what a bundle rests on, as three digests.

    queries: query_id, query, provider; candidates: query_id, item_id; ranked: query_id, rank, item_id, score, provider. The
    query and the first `top` rows of evidence, in order, are canonical JSON; candidates are a set of any size and are summed
    up, never listed. violations: repeated_item, repeated_rank, outside_candidates, provider, path (a local path in the name
    of the provider). A query without evidence has the digest of none.
    """
    spark_json = lambda *columns: F.sha2(F.to_json(F.struct(*columns)), 256)
    asked = queries.select("query_id", F.col("provider").alias("_provider"), spark_json(F.coalesce("query", F.lit("")).alias("query"), F.lit(EVIDENCE_SCHEMA).alias("schema")).alias("query_digest"))
    pool = set_digest(candidates.distinct(), "query_id", "item_id", "candidate_digest").select("query_id", "candidate_digest")
    order = Window.partitionBy("query_id").orderBy("rank", "item_id")
    kept = ranked.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= top)
    known = candidates.select("query_id", "item_id", F.lit(True).alias("_known")).distinct()
    rows = kept.join(known, ["query_id", "item_id"], "left").join(asked.select("query_id", "_provider"), "query_id")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_rn", F.to_json(F.struct("item_id", "rank", "score")).alias("j")))), lambda x: x["j"])
    told = rows.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), lines.alias("lines"), (F.count_distinct("item_id") < F.count(F.lit(1))).alias("_item"), (F.count_distinct("rank") < F.count(F.lit(1))).alias("_rank"),
        F.bool_or(F.col("_known").isNull()).alias("_outside"), F.bool_or(~F.col("provider").eqNullSafe(F.col("_provider"))).alias("_other"),
    )
    found = asked.join(pool, "query_id", "left").join(told, "query_id", "left")
    flags = {"repeated_item": F.col("_item"), "repeated_rank": F.col("_rank"), "outside_candidates": F.col("_outside"), "provider": F.col("_other"), "path": redact_paths(F.col("_provider"))["n"] > 0}
    whole = F.concat(F.lit('{"evidence":['), F.array_join(F.coalesce("lines", F.array().cast("array<string>")), ","), F.lit(f'],"schema":"{EVIDENCE_SCHEMA}"}}'))
    return found.select(
        "query_id", F.coalesce("n", F.lit(0)).alias("n"), "query_digest", "candidate_digest", F.sha2(whole, 256).alias("evidence_digest"),
        F.array_compact(F.array(*(F.when(f, name) for name, f in flags.items()))).alias("violations"),
    )


def _safe(text: Column) -> Column:
    return F.replace(F.replace(escaped(text), F.lit("\u2028"), F.lit("\\u2028")), F.lit("\u2029"), F.lit("\\u2029"))


def prompt_packages(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, payload, redacted: allowed ids, the task and the evidence as JSON, local paths taken out, boundaries safe.

    queries: query_id, query; evidence: query_id, rank, item_id, caption, score, a bounded list a query (evidence_snapshots
    checks it). Texts of the evidence cannot close the boundary: &, <, > and line separators are escaped. redacted counts
    the paths taken out. A query without evidence has an empty list.
    """
    clean = evidence.withColumn("_c", redact_paths(F.coalesce("caption", F.lit(""))))
    row = F.struct("rank", "item_id", F.to_json(F.struct(F.col("_c.text").alias("caption"), "item_id", "rank", "score")).alias("j"))
    listed = clean.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.sum("_c.n").alias("hits"))
    both = queries.withColumn("_q", redact_paths(F.coalesce("query", F.lit("")))).join(listed, "query_id", "left")
    names = F.transform(F.coalesce("rows", F.array().cast(listed.schema["rows"].dataType)), lambda r: r["item_id"].cast("string"))
    items = F.array_join(F.transform(F.coalesce("rows", F.array().cast(listed.schema["rows"].dataType)), lambda r: r["j"]), ",")
    task = _safe(F.to_json(F.struct(F.col("_q.text").alias("query"))))
    payload = F.concat(
        F.lit("CONTROL "), _safe(F.to_json(F.struct(names.alias("allowed_ids")))), F.lit("\nTASK "), task, F.lit('\n<BEGIN_EVIDENCE>{"evidence":['), _safe(items), F.lit("]}<END_EVIDENCE>")
    )
    return both.select("query_id", payload.alias("payload"), (F.coalesce("hits", F.lit(0)) + F.col("_q.n")).cast("long").alias("redacted"))


def validate_holdout(cases: DataFrame, predictions: DataFrame, methods: DataFrame) -> DataFrame:
    """case_id, violation: what is wrong with a holdout.

    cases: case_id, winner, left_digest, right_digest, group; predictions: case_id, method; methods: method.
    Checks: repeated ids, winners other than left or right, pairs of one digest, digests in two groups,
    methods without a prediction for a case.
    """
    said = lambda df, name: df.select("case_id", F.lit(name).alias("violation")).distinct()
    repeated = cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    sides = cases.select("case_id", "group", F.explode(F.array("left_digest", "right_digest")).alias("digest"))
    split = sides.groupBy("digest").agg(F.min("group").alias("_a"), F.max("group").alias("_b")).where("_a <> _b").select("digest")
    listed = methods.select("method").distinct()
    had = predictions.select("case_id", "method").distinct().join(listed, "method", "left_semi").groupBy("case_id").agg(F.count(F.lit(1)).alias("_n"))
    due = cases.select("case_id").distinct().join(had, "case_id", "left").where(F.coalesce("_n", F.lit(0)) < listed.count())
    found = [
        said(repeated, "repeated"), said(cases.where(~F.coalesce(F.col("winner").isin("left", "right"), F.lit(False))), "winner"),
        said(cases.where("coalesce(left_digest = right_digest, true)"), "same_digest"), said(sides.join(split, "digest", "left_semi"), "group"),
        said(due, "coverage"),
    ]
    for other in found[1:]:
        found[0] = found[0].unionByName(other)
    return found[0]


def stale_models(models: DataFrame, events: DataFrame, schema_version: int) -> DataFrame:
    """model_id, reason of the models that their events no longer bear: schema, count or digest (null: current).

    models: model_id, user_id, schema_version, n, digest; events: user_id, n, digest as they are now.
    """
    now = events.select("user_id", F.col("n").alias("_n"), F.col("digest").alias("_digest"))
    reason = (
        F.when(~F.coalesce(F.col("schema_version") == schema_version, F.lit(False)), "schema").when(F.coalesce("n", F.lit(0)) != F.coalesce("_n", F.lit(0)), "count")
        .when(~F.col("digest").eqNullSafe(F.col("_digest")), "digest")
    )
    return models.join(now, "user_id", "left").select("model_id", reason.alias("reason"))


def unseen_pairs(pairs: DataFrame, shown: DataFrame) -> DataFrame:
    """Pairs not shown before in their context, in either order of the two items."""
    key = lambda df: df.withColumns({"_low": F.least("left_no", "right_no"), "_high": F.greatest("left_no", "right_no")})
    return key(pairs).join(key(shown).select("context", "_low", "_high").distinct(), ["context", "_low", "_high"], "left_anti").drop("_low", "_high")


def import_pairs(pairs: DataFrame, items: DataFrame, events: DataFrame) -> DataFrame:
    """Events to append: pairs of two known, different items under an id that only the pair decides, unless it is there."""
    known = lambda df, key: df.join(items.select(F.col("item_no").alias(key)), key, "left_semi")
    good = known(known(pairs.where("preferred_no <> rejected_no"), "preferred_no"), "rejected_no").distinct()
    named = good.withColumn("import_id", canonical_sha256("user_id", "preferred_no", "rejected_no"))
    return named.join(events.select("import_id"), "import_id", "left_anti")


def budget_violations(evidence: DataFrame, max_bytes: int = 128 * 1024 * 1024, max_pixels: int = 50_000_000) -> DataFrame:
    """run_id, rule (bytes or pixels), found: runs whose evidence is over a budget; unknown sizes count as 0.

    evidence: run_id, file_size, width, height.
    """
    total = evidence.groupBy("run_id").agg(F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.col("width").cast("long") * F.col("height")), F.lit(0)).alias("pixels"))
    rules = F.array(F.struct(F.lit("bytes").alias("rule"), F.col("bytes").alias("found"), F.lit(max_bytes).alias("most")), F.struct(F.lit("pixels").alias("rule"), F.col("pixels").alias("found"), F.lit(max_pixels).alias("most")))
    return total.select("run_id", F.explode(rules).alias("r")).where("r.found > r.most").select("run_id", "r.rule", "r.found")
