"""Quality rules whose failures are judged by host.

Every document gets base counts and a verdict of its own. Failures are then summed by host, a beta
prior is fitted to the hosts' rates by moments, and a host whose shrunken rate is too high loses its
other documents too. Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiresift.session import cut

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every whole text.

    Words of repeated three-word windows are found by sorting (hash, position) inside the row, and only where
    the window hashes are not all different; nothing is shuffled. Null text: no words, no lines.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    split = text.withColumn("w", F.filter(F.split("t", SPACE), lambda w: w != "")).withColumn(
        "l", F.filter(F.split("t", "\n"), lambda line: F.regexp_replace(line, SPACE, "") != ""))
    counted = split.select(
        "doc_id", "source", "w", F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"))
    windows = counted.withColumn("h", F.when(F.col("n_words") >= 3, F.expr(
        "transform(slice(w, 1, size(w) - 2), (x, i) -> xxhash64(x, w[i + 1], w[i + 2]))")))
    marked = windows.withColumn("s", F.when(
        F.size(F.array_distinct("h")) < F.size("h"),
        F.expr("array_sort(transform(h, (x, i) -> named_struct('h', x, 'i', i)))")))
    repeated = marked.withColumn("p", F.expr("""array_sort(transform(filter(s, (x, j) ->
        (j > 0 AND s[j - 1].h = x.h) OR (j < size(s) - 1 AND s[j + 1].h = x.h)), x -> x.i))"""))
    covered = F.expr("""aggregate(transform(p, (x, j) -> if(j = 0, 3, least(3, x - p[j - 1]))), 0L, (a, x) -> a + x)""")
    return repeated.select("doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                           F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _prior(row) -> tuple[float, float]:
    """Mean and strength a + b of the beta prior, from one row of sums over hosts.

    The observed variance of rates is m (1 - m) (i + (1 - i) / (strength + 1)), where i is the mean of 1 / n.
    """
    m = row["x"] / row["n"] if row["n"] else 0.0
    if not 0 < m < 1:
        return m, 1.0
    excess = row["v"] / (m * (1 - m)) - row["i"]
    strength = (1 - row["i"]) / excess - 1 if excess > 0 else 1000.0
    return m, min(1000.0, max(1.0, strength))


def judge(docs: DataFrame, min_words: int = 50, max_repeat: int = 50, max_rate: float = 0.6,
          max_symbols: int = 25, salts: int = 32) -> DataFrame:
    """One row per document: the base counts, base_failed, rule_failed, host_rate and kept.

    base_failed: under min_words words, or over max_repeat percent of words in repeated windows.
    rule_failed (counted by host): base_failed, or symbols over max_symbols percent of the word characters.
    kept is false for base_failed and for all documents of a host whose shrunken failure rate exceeds max_rate.
    The prior is Beta(a, b) by the method of moments over hosts, with at least one document's weight. Documents
    without a source belong to no host and are judged alone. Null ids, repeated rows and extra columns do no
    harm; no rows give no rows.

    A host may hold a third of all rows: its sums are partial aggregates, and the join back goes by
    (host, salt), with the few verdicts copied to every salt. The counts are written once, without texts.
    """
    words, repeat = F.col("n_words"), F.col("n_repeat_words")
    failed = (words < min_words) | (100 * repeat > max_repeat * words)
    counts = cut(base_counts(docs).withColumn("base_failed", failed).withColumn(
        "rule_failed", F.col("base_failed") | (100 * F.col("n_symbols") > max_symbols * F.col("word_chars"))))
    hosts = counts.filter(F.col("source").isNotNull()).groupBy(F.col("source").alias("host")).agg(
        F.count("*").cast("double").alias("n"), F.sum(F.col("rule_failed").cast("double")).alias("x"))
    rate = F.col("x") / F.col("n")
    m, k = _prior(hosts.agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.var_pop(rate).alias("v"),
                            F.avg(1 / F.col("n")).alias("i")).first())
    verdicts = hosts.select("host", ((F.col("x") + m * k) / (F.col("n") + k)).alias("host_rate"))
    spread_out = verdicts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = counts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(salts)).cast("int"))
    joined = salted.join(spread_out, (F.col("source") == F.col("host")) & (salted.salt == spread_out.salt), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= max_rate)).alias("kept"),
        "source", "rule_failed", "host_rate")
