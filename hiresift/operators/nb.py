"""Multinomial naive Bayes on additive counts: train, update, predict, test-then-train.

A model is two count tables, (token, label, n) and (label, docs, tokens). Classes are named
up front (``classes``), so per-class values sit in one array column in that order and a token
needs one row only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hiresift.dims import DEFAULT
from hiresift.functions.text import folded
from hiresift.operators import chunks
from hiresift.operators.order import running
from hiresift.session import cut
from hiresift.sources.versions import Versions

ALPHA = 1.0
# Scores are compared after rounding, so that the order of summation cannot decide a near tie.
DIGITS = 9
# Texts without a label are counted apart.
NO_LABEL = "\x00"


def tokenised(
    docs: DataFrame, text: Column, label: Column | None = None, ordered: bool = False, chunk_tokens: int = chunks.CHUNK_TOKENS
) -> DataFrame:
    """The texts as written chunks (``chunks.chunked``), for training and for prediction: they are split into words once.

    With ``ordered`` the chunks follow the ids, which takes a shuffle of the texts.
    """
    label = F.lit(None).cast("string") if label is None else label
    if ordered:  # dealt before the texts are split: Spark reads the rows twice to find the ranges
        docs = docs.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id").sortWithinPartitions("id")
    rows = docs.select("id", label.alias("label"), folded(text).alias("t0"))
    return chunks.chunked(rows.select("*", F.lit(0).alias("mark"), F.coalesce("label", F.lit(NO_LABEL)).alias("cell")), tokens=chunk_tokens)


def train_counts(docs: DataFrame, text: Column, label: Column) -> tuple[DataFrame, DataFrame]:
    """Token counts (token, label, n) and label counts (label, docs, tokens)."""
    return counts_of(tokenised(docs.withColumn("id", F.lit(0)), text, label))


def counts_of(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The counts of ``tokenised`` texts."""
    label = F.when(F.col("cell") != NO_LABEL, F.col("cell")).alias("label")
    token_counts = chunks.counts_by_cell(words).select("token", label, "n")
    texts = chunks.texts_of(words).select(F.explode(F.arrays_zip("labels", "lengths")).alias("t"))
    label_counts = texts.groupBy(F.col("t.labels").alias("label")).agg(
        F.count("*").alias("docs"), F.sum(F.col("t.lengths").cast("long")).alias("tokens")
    )
    return token_counts, label_counts


def saved(model: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Store the counts and read them back, as predictions read a stored model."""
    return cut(model[0]), cut(model[1])


def add_counts(
    model: tuple[DataFrame, DataFrame], more: tuple[DataFrame, DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """Incremental update: counts of two parts add up."""
    token_counts = model[0].unionByName(more[0]).groupBy("token", "label").agg(F.sum("n").alias("n"))
    label_counts = model[1].unionByName(more[1]).groupBy("label").agg(
        F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")
    )
    return token_counts, label_counts


def _by_class(value: Column | str, classes: list[str], label: str = "label") -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.array(*[
        F.coalesce(F.sum(F.when(F.col(label) == c, value)), F.lit(0)) for c in classes
    ])


def best_class(
    log_counts: list[Column], length: Column, docs: Column, tokens: Column, vocab: Column,
    classes: list[str],
) -> Column:
    """Class of the highest score, ties by name; null if no class was seen.

    score = log(share of class) + sum of log(count + alpha) - length * log(tokens + alpha * V)
    """
    total = F.aggregate(docs, F.lit(0).cast("bigint"), lambda a, x: a + x)
    scored = []
    for i, name in enumerate(classes):
        # the guard covers a class of empty texts only, where the length factor decides nothing
        size = F.greatest(tokens[i] + ALPHA * vocab, F.lit(ALPHA))
        score = F.ln(docs[i] / total) + log_counts[i] - length * F.ln(size)
        scored.append(F.when(
            docs[i] > 0, F.struct((-F.round(score, DIGITS)).alias("neg"), F.lit(name).alias("label"))
        ))
    return F.array_min(F.array_compact(F.array(*scored)))["label"]


def predict(
    model: tuple[DataFrame, DataFrame], docs: DataFrame, text: Column,
    classes: list[str] | None = None,
) -> DataFrame:
    """id, predicted; without any training row everything is "unknown"."""
    return predicted_or_unknown(model, tokenised(docs, text), classes)


def predicted_or_unknown(model: tuple[DataFrame, DataFrame], words: DataFrame, classes: list[str] | None = None) -> DataFrame:
    out = predict_words(model, words, classes)
    return out.select("id", F.coalesce("predicted", F.lit("unknown")).alias("predicted"))


def _per_text(words: DataFrame, met: DataFrame, classes: list[str], learning: bool) -> DataFrame:
    """id, label, length, new, s0, s1, ...: the sum of n * log(count + alpha) for each class, and how many tokens no earlier text holds.

    The counts are those that ``met`` gives for the chunk; with ``learning`` and those of the earlier texts of the chunk.
    """
    names = list(classes)

    def work(t: chunks.Texts) -> pa.Table:
        code, text, n = t.pairs()
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        many = np.diff(np.append(starts, len(code)))
        out = {"id": t.ids, "label": t.labels, "length": t.lengths.sum(axis=0)}
        # the first text of a token, where no earlier chunk and no model holds it
        out["new"] = np.bincount(text[starts[t.first[code[starts]]]] if len(code) else text, minlength=t.size)
        of = pc.index_in(t.labels, value_set=pa.array(names, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)[text]
        for i in range(len(names)):
            known = t.counts[code, i]
            if learning:
                here = np.where(of == i, n, 0)
                upto = np.cumsum(here) - here
                known = known + (upto - np.repeat(upto[starts], many))
            out[f"s{i}"] = t.sums(text, n * np.log(known + ALPHA))
        return pa.table(out)

    schema = "id long, label string, length long, new long, " + ", ".join(f"s{i} double" for i in range(len(names)))
    return chunks.by_chunk(words, met, len(names), work, schema)


def _as_stored(token_counts: DataFrame) -> DataFrame:
    """token, cells, ns of token counts."""
    pairs = F.collect_list(F.struct(F.coalesce("label", F.lit(NO_LABEL)).alias("label"), "n"))
    return token_counts.groupBy("token").agg(pairs.alias("p")).select("token", F.col("p.label").alias("cells"), F.col("p.n").alias("ns"))


def predict_words(model: tuple[DataFrame, DataFrame], docs: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """id, predicted, majority of ``tokenised`` texts.

    The model meets the different tokens of each chunk, not the tokens of each text.
    """
    classes = DEFAULT.classes if classes is None else classes
    k = range(len(classes))
    token_counts, label_counts = model
    vocab = token_counts.agg(F.count_distinct("token"))
    sums = label_counts.agg(_by_class("docs", classes).alias("docs"), _by_class("tokens", classes).alias("tokens"))
    # the texts learn nothing from each other
    asked = docs.withColumns({"cells": F.array().cast("array<string>"), "ns": F.array().cast("array<bigint>")})
    rows = _per_text(docs, chunks.meet(asked, classes, _as_stored(token_counts)), classes, learning=False)
    rows = rows.withColumn("sums", sums.select(F.struct("docs", "tokens")).scalar())
    rows = rows.select("*", "sums.*").withColumn("vocab", vocab.scalar())
    label = best_class(
        [F.col(f"s{i}") for i in k], F.col("length"),
        F.col("docs"), F.col("tokens"), F.coalesce("vocab", F.lit(0)), classes,
    )
    return rows.select("id", label.alias("predicted"), majority(F.col("docs"), classes).alias("majority"))


def majority(docs: Column, classes: list[str]) -> Column:
    """The class with the most documents, ties by name."""
    ranked = F.array(*[F.struct((-docs[i]).alias("n"), F.lit(c).alias("c")) for i, c in enumerate(classes)])
    return F.array_min(ranked)["c"]


def prequential(
    docs: DataFrame, text: Column, label: Column, classes: list[str] | None = None,
    start: tuple[DataFrame, DataFrame] | None = None, chunk_tokens: int = chunks.CHUNK_TOKENS,
) -> DataFrame:
    """As ``prequential_words``, from texts."""
    return prequential_words(tokenised(docs, text, label, ordered=True, chunk_tokens=chunk_tokens), classes, start)


def prequential_words(
    words: DataFrame, classes: list[str] | None = None, start: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """id, label, predicted: each row is predicted from all earlier rows, then learnt; with ``start``, a model, on top of its counts.

    ``words`` are ``tokenised`` texts in order. Earlier counts of a token come from two levels: the counts of the earlier chunks,
    and those of the earlier texts of its chunk. A token of every text has one row for each chunk.
    """
    classes = DEFAULT.classes if classes is None else classes
    k = range(len(classes))
    zero = F.lit(0)
    met = chunks.meet(words, classes, None if start is None else _as_stored(start[0]))
    # written, as the rows are read once more to find the ranges of the running sums
    state = cut(_per_text(words, met, classes, learning=True))
    state = state.select(
        "*", *[F.when(F.col("label") == c, 1).otherwise(0).alias(f"d{i}") for i, c in enumerate(classes)],
        *[F.when(F.col("label") == c, F.col("length")).otherwise(0).alias(f"w{i}") for i, c in enumerate(classes)])
    # vocabulary size before a row: tokens whose first text came earlier
    state = running(state, "id", ["new", *[f"d{i}" for i in k], *[f"w{i}" for i in k]], before=True)
    old_docs, old_tokens, old_vocab = ([zero] * len(classes), [zero] * len(classes), zero)
    if start is not None:
        sums = start[1].agg(_by_class("docs", classes).alias("d"), _by_class("tokens", classes).alias("w")).select(F.struct("d", "w")).scalar()
        state = state.withColumn("_old", sums).withColumn("_vocab", start[0].agg(F.count_distinct("token")).scalar())
        old_docs, old_tokens, old_vocab = [F.col("_old.d")[i] for i in k], [F.col("_old.w")[i] for i in k], F.col("_vocab")
    predicted = best_class(
        [F.col(f"s{i}") for i in k], F.col("length"),
        F.array(*[F.col(f"run_d{i}") + old_docs[i] for i in k]), F.array(*[F.col(f"run_w{i}") + old_tokens[i] for i in k]),
        F.col("run_new") + old_vocab, classes,
    )
    return state.select("id", "label", predicted.alias("predicted"))


def accuracy(scored: DataFrame) -> DataFrame:
    """Rows, rows with a prediction, hits and accuracy; the first row has no prediction."""
    return scored.agg(
        F.count("*").alias("n_rows"),
        F.count("predicted").alias("n_scored"),
        F.count_if(F.col("predicted") == F.col("label")).alias("n_correct"),
    ).withColumn("accuracy", F.round(F.col("n_correct") / F.nullif("n_scored", F.lit(0)), 6))


def accuracy_curve(scored: DataFrame, every: int = 50) -> DataFrame:
    """Running accuracy after every ``every`` rows."""
    rows = scored.select(
        "id", F.lit(1).alias("trained"), F.col("predicted").isNotNull().cast("int").alias("scored"),
        F.coalesce((F.col("predicted") == F.col("label")).cast("int"), F.lit(0)).alias("correct"),
    )
    out = running(rows, "id", ["trained", "scored", "correct"], before=False)
    return out.where(F.col("run_trained") % every == 0).select(
        F.col("run_trained").alias("trained"),
        F.round(F.col("run_correct") / F.nullif("run_scored", F.lit(0)), 6).alias("accuracy"),
    )


def training_run(scored: DataFrame, run_id: str, run_date: str) -> DataFrame:
    """One row for the run table from test-then-train predictions: parameters, accuracy, rows per category."""
    per_class = scored.groupBy("label").agg(
        F.count("*").alias("n"), F.count("predicted").alias("p"),
        F.count_if(F.col("predicted") == F.col("label")).alias("c"),
    )
    acc = F.sum("c") / F.nullif(F.sum("p"), F.lit(0))
    fixed = F.create_map(
        F.lit("accuracy"), F.coalesce(acc, F.lit(0.0)),
        F.lit("total_jobs_trained"), F.sum("n").cast("double"),
    )
    counts = F.map_from_entries(F.collect_list(F.struct(
        F.concat(F.lit("category_"), "label"), F.col("n").cast("double")
    )))
    params = F.create_map(
        F.lit("total_jobs"), F.sum("n").cast("string"),
        F.lit("num_categories"), F.count("*").cast("string"),
    )
    return per_class.agg(
        F.lit(run_id).alias("run_id"), F.lit(run_date).alias("run_date"),
        F.lit("MultinomialNB").alias("model_type"), F.lit("BagOfWords").alias("feature_type"),
        params.alias("params"), F.map_concat(fixed, counts).alias("metrics"),
    )


def run_history(runs: DataFrame) -> DataFrame:
    """All runs with accuracy, rows and date, the latest first; of one date the greatest run id first."""
    return runs.orderBy(F.coalesce("run_date", F.lit("unknown")).desc(), F.desc("run_id")).select(
        F.substring("run_id", 1, 8).alias("run_id"),
        F.coalesce(F.try_element_at("metrics", F.lit("accuracy")), F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.try_element_at("metrics", F.lit("total_jobs_trained")), F.lit(0.0)).alias("jobs"),
        F.coalesce("run_date", F.lit("unknown")).alias("run_date"),
    )


class StoredModel:
    """A model with its token counts, label counts and test-then-train accuracy, published together in versions."""

    TOKENS, LABELS = "token string, label string, n long", "label string, docs long, tokens long"
    ACCURACY = "trained long, scored long, correct long"

    def __init__(self, spark: SparkSession, folder: str):
        self.versions = Versions(spark, folder)

    def counts(self, content: dict | None = None) -> tuple[DataFrame, DataFrame]:
        content = self.versions.last()[1] if content is None else content
        return (self.versions.load(content.get("tokens", []), self.TOKENS), self.versions.load(content.get("labels", []), self.LABELS))

    def accuracy(self, content: dict | None = None) -> DataFrame:
        """One row: rows trained, rows scored, hits, accuracy (0 before any row was scored)."""
        content = self.versions.last()[1] if content is None else content
        sums = self.versions.load(content.get("accuracy", []), self.ACCURACY).agg(*[
            F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("trained", "scored", "correct")])
        ratio = F.coalesce(F.col("correct") / F.nullif("scored", F.lit(0)), F.lit(0.0))
        return sums.withColumn("accuracy", F.round(ratio, 6))

    def train(self, docs: DataFrame, text: Column, label: Column, classes: list[str] | None = None) -> DataFrame:
        """Train anew and publish the model in place of the last one; returns the test-then-train predictions."""
        words = tokenised(docs, text, label, ordered=True)
        scored = cut(prequential_words(words, classes))
        new = self._written(counts_of(words), scored)
        self.versions.change(lambda content: {"seen": content.get("seen", {})} | new)
        return scored

    def _written(self, counts: tuple[DataFrame, DataFrame], scored: DataFrame) -> dict:
        hits = scored.agg(F.count("*").alias("trained"), F.count("predicted").alias("scored"),
                          F.count_if(F.col("predicted") == F.col("label")).alias("correct"))
        return {"tokens": [self.versions.write("tokens", counts[0])], "labels": [self.versions.write("labels", counts[1])],
                "accuracy": [self.versions.write("accuracy", hits.coalesce(1))]}

    def update(
        self, docs: DataFrame, text: Column, label: Column, classes: list[str] | None = None, batch: tuple[str, int] | None = None
    ) -> int:
        """Score each row with all that was learnt before it, learn it, and publish; returns the version.

        The tables are written anew as sums, so a model stays as large as its vocabulary. ``batch`` is the name of a stream and a
        number of it; one that was taken in before changes nothing.
        """
        made: list[DataFrame] = []

        def work(content: dict) -> dict | None:
            seen = content.get("seen", {})
            if batch and seen.get(batch[0], -1) >= batch[1]:
                return None
            old = self.counts(content)
            if not made:  # once, also where another writer is faster
                made.append(tokenised(docs, text, label, ordered=True))
            scored = prequential_words(made[0], classes, old if content else None)
            new = self._written(add_counts(old, counts_of(made[0])), scored)
            new["accuracy"] = [*content.get("accuracy", []), *new["accuracy"]]
            return content | new | {"seen": seen | ({batch[0]: batch[1]} if batch else {})}
        return self.versions.change(work)[0]
