"""Quality classifier: a sparse ensemble of rules over text statistics.

A forest of shallow trees is grown on labelled documents; each path from a root
to a node is a rule, a conjunction of bounds on statistics. A lasso logistic
regression over the rules' truth values leaves few of them with a weight. What
is left is compiled into one column expression, so that scoring any number of
documents is a projection.

Training uses at most ``TRAIN_ROWS`` labelled documents, those whose ids have the
smallest hashes; statistics, forest and regression are Spark jobs.

Statistics come from the text alone. Defined results: a null or empty text has
statistics of 0 and gets the score they lead to; without labels of both classes
every score is the share of label 1 (0.5 without any); null labels are left
out; of several labels of one id the largest counts; rows with a null id are
scored and never learned from; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblode.functions.text import let
from joblode.llm.ratio import with_words, words_of
from joblode.llm.registry import case, documents
from joblode.session import staged

TRAIN_ROWS = 20_000
TREES, DEPTH, LASSO, STEPS, SEED = 20, 3, 0.001, 200, 7
FOLDS, HELD_OUT = 5, 0
ACCEPT = 0.3


@dataclass(frozen=True)
class Model:
    """Rules as tuples of (statistic, at most?, bound), each with its weight."""

    intercept: float
    rules: dict[tuple, float] = field(default_factory=dict)
    constant: float | None = None

    def score(self, of: Callable[[str], Column] = F.col) -> Column:
        """The score, 0 to 1, of a row whose statistics ``of`` gives by name."""
        if self.constant is not None:
            return F.lit(self.constant)
        total = reduce(lambda a, b: a + b, [F.when(holds(r, of), F.lit(w)).otherwise(0.0) for r, w in self.rules.items()],
                       F.lit(self.intercept))
        return 1 / (1 + F.exp(-total))


def holds(rule: tuple, of: Callable[[str], Column] = F.col) -> Column:
    tests = [of(s) <= F.lit(b) if most else of(s) > F.lit(b) for s, most, b in rule]
    return reduce(lambda a, b: a & b, tests)


def statistics(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """Numbers of a text with its words and lines."""
    chars, count = F.greatest(F.char_length(text), F.lit(1)), F.greatest(F.size(words), F.lit(1))
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / chars
    return {
        "s_words": F.log1p(F.size(words).cast("double")),
        "s_word_chars": F.char_length(F.array_join(words, "")) / count,
        "s_distinct": F.size(F.array_distinct(words)) / count,
        "s_symbols": share(r"[#*$%&|<>]"),
        "s_upper": share("[A-ZÀ-Þ]"),
        "s_digits": share("[0-9]"),
        "s_marks": share("[!?]"),
        "s_stops": share("[.,;:]"),
        "s_line_words": F.size(words) / F.greatest(F.size(lines), F.lit(1)),
        "s_new_lines": F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
    }


STATISTICS = (
    "s_words", "s_word_chars", "s_distinct", "s_symbols", "s_upper", "s_digits", "s_marks", "s_stops",
    "s_line_words", "s_new_lines")


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return with_words(docs, text).withColumns(statistics(text, F.col("_words"), F.split(text, "\n"))).drop("_words")


def score_of(text: Column, model: Model) -> Column:
    """The score of a text as one expression, in which words, lines and statistics are computed once.

    A filter on it may move below any projection without repeating them.
    """
    def from_words(words: Column, lines: Column) -> Column:
        numbers = F.struct(*[c.alias(n) for n, c in statistics(text, words, lines).items()])
        return let(numbers, lambda known: model.score(lambda name: known[name]))
    return let(words_of(text), lambda words: let(F.split(text, "\n"), lambda lines: from_words(words, lines)))


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def paths(node, names: tuple[str, ...], above: tuple = ()) -> list[tuple]:
    """All paths of a tree, each with the tightest bound per statistic and side."""
    if not is_split(node):
        return []
    split = node.split()
    name, bound = names[split.featureIndex()], float(split.threshold())
    found = []
    for child, most in ((node.leftChild(), True), (node.rightChild(), False)):
        tests = {(s, m): b for s, m, b in above}
        old = tests.get((name, most))
        tests[name, most] = bound if old is None else (min if most else max)(old, bound)
        rule = tuple(sorted((s, m, b) for (s, m), b in tests.items()))
        found += [rule, *paths(child, names, rule)]
    return found


def is_split(node) -> bool:
    return node.getClass().getSimpleName() == "InternalNode"


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id",
          text_col: str = "text") -> Model:
    """Learns from ``labels`` (doc_id, label 0 or 1); ids of the held-out fold are never used."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("double").alias("label"))
             .filter("doc_id IS NOT NULL AND label IS NOT NULL").filter(~held_out())
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # at most ``rows`` pairs of numbers
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sample = staged(with_statistics(texts.join(F.broadcast(chosen), "doc_id")).select("label", *STATISTICS),
                    "quality-sample")
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return Model(0.0, constant=counts.get(1.0, 0) / total if total else 0.5)
    sample = sample.coalesce(2)
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED,
        featureSubsetStrategy="0.6", minInstancesPerNode=max(1, min(20, total // 100)), cacheNodeIds=False).fit(
        sample.select("label", array_to_vector(F.array(*STATISTICS)).alias("features")))
    found = sorted({p for tree in forest.trees for p in paths(tree._java_obj.rootNode(), STATISTICS)})
    if not found:
        return Model(0.0, constant=counts.get(1.0, 0) / total)
    truth = F.array(*[holds(r).cast("double") for r in found])
    lasso = LogisticRegression(featuresCol="features", labelCol="label", elasticNetParam=1.0, regParam=LASSO,
                               standardization=False, maxIter=STEPS).fit(
        sample.select("label", array_to_vector(truth).alias("features")))
    weights = lasso.coefficients.toArray().tolist()
    return Model(float(lasso.intercept), {r: w for r, w in zip(found, weights) if w})


def _scored(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """(row, score): each row of ``docs`` as a struct, so that its columns may have any name."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    return with_statistics(rows).select("row", model.score().alias("score"))


def scored(docs: DataFrame, model: Model, text_col: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a score."""
    return _scored(docs, model, text_col).select("row.*", F.col("score").alias(score))


def keep_good(docs: DataFrame, model: Model, least: float = ACCEPT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.filter(score_of(text, model) >= least)


def quality_labels(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))


@case("op3_quality_rules")
def op3(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, quality_labels(spark, sf_dir))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score",
                                      (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
