"""Quality classifier: a sparse rule ensemble over text statistics.

Shallow trees of a forest are fitted on the statistics of labelled documents; every path from a root is a conjunctive rule.
A lasso logistic regression over the rules' indicators keeps a few with weights, and these become one Spark column
expression, so that scoring is a map over documents without Python.

Defined results: null text counts as empty; an empty text has all ratios 0 and gets a score like any other. Labels are the
least non-null label of a document id. Without two classes of labels every score is the smoothed share of label 1. Repeated rows
get equal scores. Extra columns stay; columns named as an output are replaced.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimen.llm.base import as_small, id_hash, written

#: About so many labelled documents at most are used to fit (all, if there are fewer).
LABELLED_ROWS = 20_000
TREES, DEPTH, LASSO, SEED = 24, 3, 0.0005, 7

# The statistics, as SQL over __t (the text), __n (its code points, 1 at least), __w (its words) and __l (its lines).
STATISTICS = {
    "log_chars": r"ln(1 + length(__t))",
    "upper": r"length(regexp_replace(__t, r'[^\p{Lu}]+', '')) / __n",
    "symbols": r"length(regexp_replace(__t, r'[^#*$%&|<>~^=_@+{}\\]+', '')) / __n",
    "stops": r"length(regexp_replace(__t, r'[^.,;:!?]+', '')) / __n",
    "shouts": r"length(regexp_replace(__t, r'[^!?]+', '')) / __n",
    "digits": r"length(regexp_replace(__t, r'[^0-9]+', '')) / __n",
    "letters_a_word": r"(__n - size(__w)) / greatest(size(__w), 1)",
    "distinct_words": r"size(array_distinct(__w)) / greatest(size(__w), 1)",
    "distinct_lines": r"size(array_distinct(__l)) / greatest(size(__l), 1)",
    "words_a_line": r"size(__w) / greatest(size(__l), 1)",
}


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the column __stats, array<double> in the order of STATISTICS."""
    own = docs.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    own = own.withColumns({"__w": F.split(F.trim("__t"), "[ \t\n\x0b\f\r]+"), "__l": F.split("__t", "\n"), "__n": F.greatest(F.length("__t"), F.lit(1))})
    return own.withColumn("__stats", F.array(*[F.expr(f"cast({sql} as double)") for sql in STATISTICS.values()])).drop("__t", "__w", "__l", "__n")


@dataclass(frozen=True)
class Rules:
    """Conjunctions of (statistic, is_over, bound) with weights."""

    rules: tuple[tuple[tuple[int, bool, float], ...], ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self, stats: str = "__stats") -> Column:
        """The chance of label 1 as a column expression. The rules are a lambda over the statistics, so that these are computed once, also where a filter on the score is pushed below them."""

        def chance(values: Column) -> Column:
            total = F.lit(self.intercept)
            for rule, weight in zip(self.rules, self.weights, strict=True):
                total = total + F.when(holds(rule, values), weight).otherwise(0.0)
            return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

        return F.get(F.transform(F.array(F.col(stats)), chance), F.lit(0))


def holds(rule: tuple[tuple[int, bool, float], ...], stats: str | Column = "__stats") -> Column:
    """Whether all conditions of a rule hold."""
    found = F.lit(True)
    for place, over, bound in rule:
        value = F.get(stats, F.lit(place))
        found = found & ((value > bound) if over else (value <= bound))
    return found


def paths(tree: str) -> list[tuple[tuple[int, bool, float], ...]]:
    """All paths from the root in a tree's printed form; an inner one is a rule too."""
    found, at = [], []
    for line in tree.splitlines():
        if m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            at = [x for x in at if x[0] < len(m[1])] + [(len(m[1]), (int(m[2]), m[3] == ">", float(m[4])))]
            found.append(tuple(sorted(set(x[1] for x in at))))
    return found


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, rows: int = LABELLED_ROWS, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Rules:
    """Fits the ensemble on documents that have a label and where usable holds (a condition on the id column _label_id), about rows of them, chosen by a hash of the id."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_label_id")).agg((F.min(label) > 0).cast("double").alias("label"))
    if usable is not None:
        known = known.where(usable)
    there = known.count()
    if there > rows:
        known = known.where(F.pmod(F.xxhash64("_label_id"), F.lit(1_000_000)) < int(1_000_000 * rows / there))
    known = as_small(known, min(there, 2 * rows), 32)
    table = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).join(known, F.col("_doc") == F.col("_label_id"))
    table = written(statistics(table, "_text").select(F.col("_label_id").alias("doc"), "__stats", "label"), "labelled")
    seen, good = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    prior = (good + 1) / (seen + 2)
    if good in (0, seen):
        return Rules((), (), math.log(prior / (1 - prior)))
    table = table.repartition(max(1, min(12, seen // 2000)), "doc").cache()
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=5, featureSubsetStrategy="onethird", seed=SEED)
    trees = forest.fit(table.select("label", array_to_vector("__stats").alias("features"))).trees
    rules = sorted({p for tree in trees for p in paths(tree.toDebugString)})
    if not rules:
        table.unpersist()
        return Rules((), (), math.log(prior / (1 - prior)))
    fired = table.select("label", array_to_vector(F.array(*[holds(r).cast("double") for r in rules])).alias("features"))
    lasso = LogisticRegression(featuresCol="features", labelCol="label", elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=60).fit(fired)
    table.unpersist()
    weights = [float(x) for x in lasso.coefficients.toArray()]
    chosen = [(r, x) for r, x in zip(rules, weights, strict=True) if abs(x) > 1e-6]
    return Rules(tuple(r for r, _ in chosen), tuple(x for _, x in chosen), float(lasso.intercept))


def classify(docs: DataFrame, model: Rules, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """docs with score (double, 0 to 1) and predicted (1 if score >= threshold, else 0)."""
    scored = statistics(docs.drop("score", "predicted"), text).withColumn("score", model.score()).drop("__stats")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def learnable(doc_id: str = "_label_id", folds: int = 5, held: int = 0) -> Column:
    """Whether an id is outside the held-out fold."""
    return id_hash(doc_id) % folds != held
