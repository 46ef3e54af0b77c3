"""Model evaluation: repeated stratified splits, accuracy, macro F1, per-class report."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hiresift.dims import DEFAULT
from hiresift.functions.text import folded
from hiresift.operators import chunks, nb
from hiresift.session import cut

SEEDS = (0, 1, 2, 3, 4)
TEST_SHARE = 0.2
_PREFIX = 3


def stratified_split(docs: DataFrame, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """docs (id, label) -> id, label, seed: the test rows of each split.

    A row's place in its class is the order of md5(seed:id); the first 20 % of each class are
    test rows. If a class has a single row the split ignores the classes.

    Ranking a whole class in one task would not scale, so the order is cut by hash prefix: rows
    per (class, prefix) tell in which prefix the border lies, and only there rows are ranked.
    """
    hashed = docs.select(
        "id", "label", F.explode(F.array(*map(F.lit, seeds))).alias("seed")
    ).withColumn("h", F.md5(F.concat_ws(":", F.col("seed").cast("string"), F.col("id").cast("string"))))
    smallest = docs.groupBy("label").agg(F.count("*").alias("n")).agg(F.min("n")).scalar()
    hashed = hashed.withColumn("smallest", smallest)
    # one common stratum unless every class has two rows
    hashed = hashed.withColumn("stratum", F.when(F.col("smallest") >= 2, F.col("label")).otherwise(F.lit("")))
    hashed = hashed.withColumn("p", F.substring("h", 1, _PREFIX)).drop("smallest")
    cells = hashed.groupBy("seed", "stratum", "p").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("seed", "stratum").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("seed", "stratum")
    cells = cells.select(
        "seed", "stratum", "p", "n",
        F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"),
        F.round(F.sum("n").over(whole) * TEST_SHARE).cast("bigint").alias("quota"),
    ).where(F.col("before") < F.col("quota"))
    near = hashed.join(cells, ["seed", "stratum", "p"])
    inside = near.where(F.col("before") + F.col("n") <= F.col("quota"))
    border = near.where(F.col("before") + F.col("n") > F.col("quota"))
    rank = F.row_number().over(Window.partitionBy("seed", "stratum", "p").orderBy("h", "id"))
    border = border.withColumn("rn", rank).where(F.col("before") + F.col("rn") <= F.col("quota"))
    return inside.select("id", "label", "seed").unionByName(border.select("id", "label", "seed"))


def evaluate(
    docs: DataFrame, parts: dict[str, Column], inputs: dict[str, list[str]], label: Column,
    classes: list[str] | None = None, seeds: tuple[int, ...] = SEEDS, chunk_tokens: int = chunks.CHUNK_TOKENS,
) -> DataFrame:
    """input, seed, id, label, predicted, majority: predictions for the test rows of all splits.

    An input is some of the parts, one after the other with a blank between; each part is split into words once, in chunks of texts. Counts are
    additive, and a row knows by a mask in which splits it is a test row: counts by part, label and mask give the counts of all models, which
    meet the different tokens of each chunk (``chunks.meet``).
    """
    classes = DEFAULT.classes if classes is None else classes
    k, names, n_splits = len(classes), list(parts), len(seeds)
    chosen = [[names.index(p) for p in use] for use in inputs.values()]
    # the masks that are there: 2 to the number of seeds at most
    held = stratified_split(docs.select("id", label.alias("label")), seeds).groupBy("id").agg(
        F.sum(_bit(F.col("seed"), seeds)).cast("int").alias("mark"))
    texts = docs.select("id", label.alias("label"), *[folded(t).alias(f"t{i}") for i, t in enumerate(parts.values())])
    rows = texts.join(held, "id", "left").withColumn("mark", F.coalesce("mark", F.lit(0)))
    cell = F.concat_ws("|", F.col("mark").cast("string"), F.coalesce("label", F.lit(nb.NO_LABEL)))
    words = chunks.chunked(rows.withColumn("cell", cell), len(names), chunk_tokens)

    sums = chunks.texts_of(words).select("labels", "marks", F.slice("lengths", 1, F.size("labels")).alias("l0"), *[
        F.slice("lengths", i * F.size("labels") + 1, F.size("labels")).alias(f"l{i}") for i in range(1, len(names))])
    sums = sums.select(F.explode(F.arrays_zip("labels", "marks", *[f"l{i}" for i in range(len(names))])).alias("t")).groupBy("t.labels", "t.marks").agg(
        F.count("*").alias("docs"), *[F.sum(F.col(f"t.l{i}").cast("long")).alias(f"l{i}") for i in range(len(names))])
    # one row for each class and mask
    sums = sums.where(F.col("labels").isin(classes)).collect()
    cells = [(p, r["marks"], r["labels"]) for p in range(len(names)) for r in sums]
    # a cell counts for its class in the inputs that have its part and the splits in which its rows are no test rows
    width = len(chosen) * n_splits * k
    columns = np.array([[(i * n_splits + s) * k + classes.index(name) if p in use and not mark >> s & 1 else -1
                         for i, use in enumerate(chosen) for s in range(n_splits)] for p, mark, name in cells], np.int64).reshape(len(cells), len(chosen) * n_splits)

    def total(of: Callable) -> list[list[list[int]]]:
        """For each input and split the sum over the training rows of each class."""
        return [[[sum(of(r, use) for r in sums if r["labels"] == c and not r["marks"] >> s & 1) for c in classes] for s in range(n_splits)] for use in chosen]

    cell_names = [f"{mark}|{name}" if len(names) == 1 else f"{p}|{mark}|{name}" for p, mark, name in cells]
    met = cut(chunks.meet(words, cell_names, columns=columns, width=width))
    seen = [F.count_if(F.exists(F.slice("counts", g * k + 1, k), lambda n: n > 0)).alias(f"v{g}") for g in range(len(chosen) * n_splits)]
    vocab = met.where("first").agg(*seen).first()
    n_docs, n_tokens = total(lambda r, use: r["docs"]), total(lambda r, use: sum(r[f"l{i}"] for i in use))
    # one row for each input and split
    models = docs.sparkSession.createDataFrame(
        [(name, s, n_docs[i][s], n_tokens[i][s], vocab[i * n_splits + s]) for i, name in enumerate(inputs) for s in range(n_splits)],
        "input string, s int, docs array<long>, tokens array<long>, vocab long")
    input_names = list(inputs)

    def work(t: chunks.Texts) -> pa.Table:
        logs = np.log(t.counts + nb.ALPHA)
        out = []
        for i, use in enumerate(chosen):
            code, text, n = t.pairs(use)
            length = t.lengths[use].sum(axis=0)
            for s in range(n_splits):
                tested = (t.marks >> s & 1).astype(bool)
                mine = tested[text]
                at = (i * n_splits + s) * k
                which = np.flatnonzero(tested)
                some, times, theirs = text[mine], n[mine], logs[code[mine], at:at + k]
                held = {f"s{c}": t.sums(some, times * theirs[:, c])[which] for c in range(k)}
                out.append(pa.table({
                    "input": [input_names[i]] * len(which), "s": np.full(len(which), s, np.int32), "id": t.ids.take(pa.array(which)),
                    "label": t.labels.take(pa.array(which)), "length": length[which], **held}))
        return pa.concat_tables([x.cast(out[0].schema.set(0, pa.field("input", pa.string()))) for x in out])

    schema = "input string, s int, id long, label string, length long, " + ", ".join(f"s{c} double" for c in range(k))
    scored = chunks.by_chunk(words, met, width, work, schema, len(names)).join(F.broadcast(models), ["input", "s"])
    predicted = nb.best_class([F.col(f"s{i}") for i in range(k)], F.col("length"), F.col("docs"), F.col("tokens"), F.col("vocab"), classes)
    most = nb.majority(F.col("docs"), classes)
    return scored.select(
        "input", F.array(*map(F.lit, seeds))[F.col("s")].alias("seed"), "id", "label", F.coalesce(predicted, most).alias("predicted"), most.alias("majority"))


def _bit(seed: Column, seeds: tuple[int, ...]) -> Column:
    out = F.lit(0)
    for i, s in enumerate(seeds):
        out = F.when(seed == s, F.lit(1 << i)).otherwise(out)
    return out


def class_report(scored: DataFrame, *by: str, rows: Column | None = None) -> DataFrame:
    """Per class precision, recall, F1 and support over true and predicted labels together; ``rows`` sums up rows counted before."""
    confusion = scored.groupBy(*by, "label", "predicted").agg((F.count("*") if rows is None else F.sum(rows)).alias("n"))
    sides = confusion.select(*by, F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).alias("called"),
                 F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).alias("support"), F.col("n").alias("called"),
                 F.lit(0).alias("hit")),
    )).alias("s")).select(*by, "s.*")
    sums = sides.groupBy(*by, "class").agg(
        F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hit").alias("hit")
    )
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    hit, called, support = F.col("hit"), F.col("called"), F.col("support")
    return sums.select(
        *by, "class",
        ratio(hit, called).alias("precision"),
        ratio(hit, support).alias("recall"),
        ratio(2 * hit, called + support).alias("f1"),
        "support",
    )


def with_averages(report: DataFrame) -> DataFrame:
    """The class report plus its macro and weighted averages."""
    measures = ["precision", "recall", "f1"]
    total = F.sum("support")
    macro = report.agg(
        F.lit("macro avg").alias("class"), *[F.avg(m).alias(m) for m in measures], total.alias("support")
    )
    weighted = report.agg(
        F.lit("weighted avg").alias("class"),
        *[(F.sum(F.col(m) * F.col("support")) / total).alias(m) for m in measures],
        total.alias("support"),
    )
    return report.unionByName(macro).unionByName(weighted)


def summary(scored: DataFrame, n_jobs: Column | int | None = None) -> DataFrame:
    """Per input: accuracy with its spread over the splits, baseline accuracy, macro F1, and the number of postings it stands for."""
    confusion = cut(scored.groupBy("input", "seed", "label", "predicted", "majority").agg(F.count("*").alias("n")))
    per_split = confusion.groupBy("input", "seed").agg(
        (F.sum(F.when(F.col("predicted") == F.col("label"), F.col("n")).otherwise(0)) / F.sum("n")).alias("acc"),
        (F.sum(F.when(F.col("majority") == F.col("label"), F.col("n")).otherwise(0)) / F.sum("n")).alias("base"),
    )
    f1 = class_report(confusion, "input", "seed", rows=F.col("n")).groupBy("input", "seed").agg(F.avg("f1").alias("f1"))
    return per_split.join(f1, ["input", "seed"]).groupBy("input").agg(
        F.avg("acc").alias("accuracy"), F.stddev_pop("acc").alias("accuracy_std"),
        F.avg("base").alias("baseline_accuracy"), F.avg("f1").alias("macro_f1"),
        F.count("*").alias("n_splits"),
    ).withColumn("n_jobs", F.lit(n_jobs).cast("long"))
