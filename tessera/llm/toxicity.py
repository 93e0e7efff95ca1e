"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Two lexicons are counted from labelled training rows: whole words and word beginnings whose share of toxic
documents stands out. A second part of the rows, which the lexicons have not seen, trains the trees; the
calibration is fitted on the scores that each half of that part gets from trees of the other half. The features of a text are densities of lexicon words, their nearness to second-person words, capitals,
punctuation and obfuscation rates. Only the text is an input of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.shared import materialize
from tessera.llm.inputs import documents, remainder

#: Labelled rows that training reads at most, about: a larger table is thinned by a hash of doc_id.
SAMPLE_ROWS = 16_000
#: Terms of the learned lexicons at most, the most telling first.
LEXICON_TERMS = 4_000
MIN_TOXIC, MIN_Z = 3, 3.0
#: Tasks that read the bounded sample in every round of the trees.
TREE_TASKS = 8
PREFIXES = (4, 5)
THRESHOLD = 0.7

#: Common insults, known before any label is seen.
INSULTS = frozenset(
    "bastard clown cretin disgusting dumb garbage idiot imbecile jerk loser moron pathetic scum stupid trash ugly worthless".split()
)
#: Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
)
#: Characters written in place of letters.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, ".": None, "-": None, "_": None})

NEAR = 5
WORD = re.compile(r"\w+")
MIXED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[0-9@$!*._\-]++[^\W\d_]++)++")  # begins where letters begin: linear
SPELLED = re.compile(r"\b\w(?:[ .\-]\w){3,}\b")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
MARKS = re.compile(r"[^\w\s]")

FEATURES = (
    "log_words", "word_hits", "word_density", "stem_hits", "stem_density", "weight", "weight_density",
    "near_second", "second_density", "capitals", "marks", "shouts", "mixed", "hidden",
)


def terms(word: str) -> list[str]:
    """The word and its beginnings, which end in an asterisk."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def features(text: str, words: dict[str, float], stems: dict[str, float]) -> list[float]:
    """The FEATURES of one whole text; all 0 for an empty one."""
    low = text.lower()
    found = WORD.findall(low)
    n = len(found)
    at = [i for i, w in enumerate(found) if w in words or w[:4] in stems or w[:5] in stems]
    in_words = in_stems = near = 0
    weight = 0.0
    for i in at:
        w = found[i]
        in_words += w in words
        own = max((stems[w[:k]] for k in PREFIXES if len(w) > k and w[:k] in stems), default=0.0)
        in_stems += own > 0
        weight += max(own, words.get(w, 0.0))
        near += any(x in SECOND_PERSON for x in found[max(0, i - NEAR) : i + NEAR + 1])
    mixed = MIXED.findall(low)
    hidden = sum(x.translate(LOOKALIKES) in words for x in mixed)
    hidden += sum(re.sub(r"\W", "", x) in words for x in SPELLED.findall(low))
    per = 1 / max(n, 1)
    chars = 1 / max(len(text), 1)
    return [
        math.log1p(n), in_words, in_words * per, in_stems, in_stems * per, weight, weight * per,
        near, sum(map(SECOND_PERSON.__contains__, found)) * per, len(UPPER.findall(text)) * chars,
        len(MARKS.findall(text)) * chars, (text.count("!") + text.count("?")) * per, len(mixed) * per, float(hidden),
    ]


def with_features(docs: DataFrame, words: dict[str, float], stems: dict[str, float], *keep: str) -> DataFrame:
    """The kept columns and one double column for each feature; both lexicons are bounded and broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast((words, stems))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, stems = sent.value
        for batch in batches:
            made = pd.DataFrame([features(t, words, stems) for t in batch["text"]], columns=list(FEATURES), dtype="float64")
            yield pd.concat([batch[list(keep)].reset_index(drop=True), made], axis=1)

    kept = [f for f in docs.schema.fields if f.name in keep]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), *(f"{x} double" for x in FEATURES)])
    return docs.select(*(f.name for f in kept), "text").mapInPandas(run, schema)


def lexicons(rows: DataFrame, limit: int = LEXICON_TERMS) -> tuple[dict[str, float], dict[str, float]]:
    """(words, stems): log odds of the terms that far more toxic than other documents hold; bounded by limit."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch["text"], batch["toxic"], strict=True):
                own = {t for w in set(WORD.findall(text.lower())) for t in terms(w)}
                (toxic if y else clean).update(own)
        both = toxic.keys() | clean.keys()
        yield pd.DataFrame([(t, toxic[t], clean[t]) for t in both], columns=["term", "toxic", "clean"])

    total = rows.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    n_toxic, n_clean = (total["t"] or 0), total["n"] - (total["t"] or 0)
    fixed = dict.fromkeys(INSULTS, 3.0)
    if not n_toxic or not n_clean:
        return fixed, {}
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("c") + 0.5) / (n_clean + 1.0))
    z = odds / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    best = (
        rows.select("text", "toxic")
        .mapInPandas(count, "term string, toxic long, clean long")
        .groupBy("term")
        .agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
        .where(F.col("t") >= MIN_TOXIC)
        .select("term", odds.alias("odds"), z.alias("z"))
        .where((F.col("z") >= MIN_Z) & (F.col("odds") > 1))
        .orderBy(F.col("z").desc(), "term")
        .limit(limit)
        .collect()
    )
    words = fixed | {r["term"]: r["odds"] for r in best if r["term"][-1] != "*"}
    return words, {r["term"][:-1]: r["odds"] for r in best if r["term"][-1] == "*"}


def _trees() -> GBTClassifier:
    return GBTClassifier(labelCol="toxic", featuresCol="features", maxIter=12, maxDepth=3, stepSize=0.3, minInstancesPerNode=2, seed=7)


class Model:
    """Lexicons, trees and calibration; apply() scores a DataFrame of texts."""

    def __init__(self, words: dict, stems: dict, trees=None, isotonic=None, base: float = 0.0) -> None:
        self.words, self.stems, self.trees, self.isotonic, self.base = words, stems, trees, isotonic, base
        self.assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")

    def margin(self, rows: DataFrame, trees=None) -> DataFrame:
        """rows, which hold the features, with `raw`, the trees' probability."""
        out = (trees or self.trees).transform(self.assembler.transform(rows))
        return out.withColumn("raw", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")

    def apply(self, docs: DataFrame, *keep: str) -> DataFrame:
        """The kept columns and score, 0 to 1; docs has `text` without nulls."""
        rows = with_features(docs, self.words, self.stems, *keep)
        if self.trees is None:  # one class only: the fixed insults order the texts around the base rate
            score = F.least(F.lit(self.base) + F.col("weight_density"), F.lit(1.0))
            return rows.select(*keep, score.alias("score"))
        step = self.isotonic.transform(self.margin(rows)).withColumnRenamed("prediction", "step")
        # within a step of the calibration the trees' order is kept
        return step.select(*keep, F.least(F.greatest(0.98 * F.col("step") + 0.02 * F.col("raw"), F.lit(0.0)), F.lit(1.0)).alias("score"))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, use: Column | None = None) -> Model:
    """A model from at most about sample_rows labelled documents; use: which doc_id may be learned from.

    Rows with a null doc_id or label are left out; repeated labels of a document count by their largest.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(use) if use is not None else known
    n = known.count()
    share = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, sample_rows / max(n, 1))))
    sample = known.where(share).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = materialize(documents(docs).join(F.broadcast(sample), "doc_id").where("doc_id is not null"), "labelled")
    half = F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(2))
    words, stems = lexicons(rows.where(half == 0))
    total = rows.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    base = ((total["t"] or 0) + 0.5) / (total["n"] + 1.0)
    featured = materialize(with_features(rows.withColumn("part", half), words, stems, "doc_id", "toxic", "part"), "features")
    model = Model(words, stems, base=base)
    grown = model.assembler.transform(featured.where("part = 1")).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(2))).coalesce(TREE_TASKS)
    held = {(r["fold"], r["toxic"]): r["count"] for r in grown.groupBy("fold", "toxic").count().collect()}
    if len({y for _, y in held}) < 2:
        return model
    model.trees = _trees().fit(grown)
    if len(held) == 4:  # each fold is scored by the trees of the other
        folds = [model.margin(grown.where(F.col("fold") == k).drop("features"), _trees().fit(grown.where(F.col("fold") != k))) for k in (0, 1)]
        fresh = folds[0].unionByName(folds[1])
    else:  # a fold without one of the classes: too few labels to hold any out
        fresh = model.margin(grown.drop("features"))
    steps = fresh.groupBy("raw").agg(F.avg("toxic").alias("toxic"), F.count(F.lit(1)).cast("double").alias("rows"))
    model.isotonic = IsotonicRegression(labelCol="toxic", featuresCol="raw", weightCol="rows").fit(steps)
    return model


def score(docs: DataFrame, labels: DataFrame, use: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row of docs.

    A null text is an empty one and is scored like any text; repeated rows get a row each; a null doc_id is
    kept; without labels of both classes, fixed insults alone order the texts; an empty table gives no rows;
    very long texts and words take time in proportion to their length.
    """
    model = train(docs, labels, use=use)
    return model.apply(documents(docs), "doc_id").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is under the threshold, with all their columns; rows with a null doc_id stay.

    Rows that repeat a doc_id share its largest score.
    """
    gone = score(docs, labels, threshold=threshold).where("predicted = 1 and doc_id is not null").select(F.col("doc_id").alias("_toxic")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_toxic"], "left_anti")
