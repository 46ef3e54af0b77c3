"""Features: TF-IDF, one-hot skills, scaled salary, job-type dummies, bag of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hiresift.dims import DEFAULT, STOP_WORDS, Dims
from hiresift.functions.skills import onehot_name
from hiresift.functions.text import combined_text, long_words, parse_tags, str_array, words_and_hyphens
from hiresift.session import cut
from hiresift.sources.versions import Versions


# So many terms may stand as literals in a plan.
LITERALS = 5000


def document_words(docs: DataFrame, text: Column, stop_words: list[str]) -> DataFrame:
    """id and words: the words of each text in their order, without stop words."""
    return docs.select("id", F.filter(long_words(text), lambda w: ~w.isin(stop_words)).alias("words"))


def _pairs(words: str, among: list[str] | None = None) -> Column:
    """Pairs of neighbours, of the given words only."""
    rest = F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))

    def pair(a: Column, b: Column) -> Column:
        # the last word has no right neighbour, which makes its pair null
        both = F.concat(a, F.lit(" "), b)
        return both if among is None else F.when(a.isin(among) & b.isin(among), both)

    return F.array_compact(F.zip_with(words, rest, pair))


def tfidf_vocabulary(
    jobs: DataFrame, max_features: int = 500, stop_words: list[str] | None = None
) -> DataFrame:
    """term, n, df, idf of the most frequent terms, ties by name.

    Occurrences are counted per task first, so only (term, count) pairs are shuffled, and pairs of frequent words alone (``_fit``).
    Document frequencies are counted for the chosen terms alone.
    """
    return _fit(jobs, max_features, stop_words)[0]


def tfidf_weights(
    jobs: DataFrame, max_features: int = 500, stop_words: list[str] | None = None
) -> DataFrame:
    """id, term, n, weight: length-normalised TF-IDF over the vocabulary."""
    vocabulary, counts = _fit(jobs, max_features, stop_words)
    return weights_of(counts, vocabulary)


def weights_of(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """id, term, n, weight of term counts under a vocabulary (term, idf), whose size max_features bounds."""
    raw = counts.join(F.broadcast(vocabulary.select("term", "idf")), "term").withColumn("raw", F.col("n") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("id")))
    return raw.select("id", "term", "n", (F.col("raw") / norm).alias("weight"))


def _fit(jobs: DataFrame, max_features: int, stop_words: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """The vocabulary, and (id, term, n) of its terms. Texts are split once, and their words are written.

    A pair is no more frequent than its words, so where enough words are more frequent than a word, none of its pairs is
    among the most frequent terms: only pairs of frequent words are counted.
    """
    words = cut(_words(jobs, stop_words))
    singles = cut(words.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("total")))
    pairs = words.select(F.explode(_pairs("words", _frequent(singles, max_features))).alias("term"))
    total = singles.unionByName(pairs.groupBy("term").agg(F.count("*").alias("total")))
    top = cut(total.orderBy(F.desc("total"), "term").limit(max_features))
    counts = cut(_term_counts(words, top))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln((1 + F.col("size")) / (1 + F.col("df"))) + 1
    size = jobs.agg(F.count("*")).scalar()
    vocabulary = F.broadcast(top).join(df, "term").withColumn("size", size).select("term", F.col("total").alias("n"), "df", idf.alias("idf"))
    return vocabulary, counts


def _frequent(singles: DataFrame, max_features: int) -> list[str] | None:
    """The words that may stand in one of the most frequent terms; None if all may, or if they are more than LITERALS."""
    first = singles.orderBy(F.desc("total")).limit(max_features).agg(F.count("*").alias("n"), F.min("total").alias("least")).first()
    if first.n < max_features:
        return None
    found = singles.where(F.col("total") >= first.least).select("term").limit(LITERALS + 1).collect()
    return [r.term for r in found] if len(found) <= LITERALS else None


def _words(jobs: DataFrame, stop_words: list[str] | None) -> DataFrame:
    text = combined_text(F.col("title"), F.col("description"), F.col("tags"))
    return document_words(jobs, text, STOP_WORDS if stop_words is None else stop_words)


def _term_counts(words: DataFrame, top: DataFrame) -> DataFrame:
    """(id, term, n) of the terms of a vocabulary. A small one is looked up before there is a row for each term."""
    chosen = [r.term for r in top.select("term").limit(LITERALS + 1).collect()]
    if len(chosen) > LITERALS:
        terms = words.select("id", F.explode(F.concat("words", _pairs("words"))).alias("term")).join(top.select("term"), "term", "left_semi")
    else:
        plain = [t for t in chosen if " " not in t]
        pairs = [t for t in chosen if " " in t]
        among = sorted({w for t in pairs for w in t.split(" ")})
        of = F.filter("words", lambda t: t.isin(plain))
        if pairs:
            of = F.concat(of, F.filter(_pairs("words", among), lambda t: t.isin(pairs)))
        terms = words.select("id", F.explode(of).alias("term"))
    return terms.groupBy("id", "term").agg(F.count("*").alias("n"))


def skill_onehot(jobs: DataFrame, dims: Dims = DEFAULT) -> DataFrame:
    """All columns plus one 0/1 column per vocabulary item, by exact tag."""
    tagged = jobs.withColumn("_tags", parse_tags(F.col("tags")))
    return tagged.select(*jobs.columns, *[
        F.array_contains("_tags", s).cast("int").alias(onehot_name(s)) for s in dims.skills
    ])


def skill_pairs(jobs: DataFrame, dims: Dims = DEFAULT) -> DataFrame:
    """The long form of the one-hot columns: (id, skill)."""
    vocabulary = str_array(dims.skills)
    return jobs.select("id", F.explode(F.array_intersect(vocabulary, parse_tags(F.col("tags")))).alias("skill"))


SALARIES = ("salary_min", "salary_max")


def salary_bounds(jobs: DataFrame) -> DataFrame:
    """One row: least and greatest value of both salary columns."""
    return jobs.agg(*[f(F.coalesce(c, F.lit(0.0))).alias(f"{c}_{n}") for c in SALARIES for n, f in (("lo", F.min), ("hi", F.max))])


def salary_scaled(jobs: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Both salary columns scaled to 0..1 by the bounds, by default their own; a constant column gives 0.

    Values beyond stored bounds scale beyond 0..1.
    """
    bounds = salary_bounds(jobs) if bounds is None else bounds
    out = jobs.withColumn("_b", bounds.select(F.struct("*")).scalar())
    for c in SALARIES:
        value, lo, hi = F.coalesce(c, F.lit(0.0)), F.col(f"_b.{c}_lo"), F.col(f"_b.{c}_hi")
        out = out.withColumn(f"{c}_scaled", F.when(hi == lo, F.lit(0.0)).otherwise((value - lo) / (hi - lo)))
    return out.drop("_b")


def jobtype_dummies(jobs: DataFrame, values: list[str], other: bool = False) -> DataFrame:
    """One boolean column for each of the given job types in place of the original column; with ``other`` one for the rest."""
    keep = [c for c in jobs.columns if c != "job_type"]
    kinds = [F.coalesce(F.col("job_type") == v, F.lit(False)).alias(f"type_{v}") for v in values]
    if other:
        kinds.append((~F.coalesce(F.col("job_type"), F.lit("")).isin(values)).alias("type_other"))
    return jobs.select(*keep, *kinds)


class FeatureModel:
    """What the features of a posting depend on, fitted once and stored: vocabulary with idf, salary bounds, number of postings.

    Postings that come later are transformed like those it was fitted on. A fit is published as a new version.
    """

    TERMS = "pos int, term string, n long, df long, idf double"
    BOUNDS = ", ".join(f"{c}_{n} double" for c in SALARIES for n in ("lo", "hi"))

    def __init__(self, spark: SparkSession, folder: str):
        self.versions = Versions(spark, folder)

    def fit(self, jobs: DataFrame, max_features: int = 500, stop_words: list[str] | None = None) -> DataFrame:
        """Fit and publish; returns the term counts (id, term, n) of the fitted postings, which ``transform`` takes in place of their texts."""
        vocabulary, counts = _fit(jobs, max_features, stop_words)
        # at most max_features rows
        placed = vocabulary.withColumn("pos", (F.row_number().over(Window.partitionBy().orderBy("term")) - 1))
        new = {"terms": [self.versions.write("terms", placed.select("pos", "term", "n", "df", "idf").coalesce(1))],
               "bounds": [self.versions.write("bounds", salary_bounds(jobs).coalesce(1))],
               "max_features": max_features, "stop_words": stop_words}
        self.versions.change(lambda content: new)
        return counts

    def vocabulary(self) -> DataFrame:
        return self.versions.load(self.versions.last()[1]["terms"], self.TERMS)

    def bounds(self) -> DataFrame:
        return self.versions.load(self.versions.last()[1]["bounds"], self.BOUNDS)

    def transform(self, jobs: DataFrame, counts: DataFrame | None = None) -> DataFrame:
        """id, both scaled salaries, tfidf (term, weight in term order), and features: the sparse vector (size, indices, values)."""
        content = self.versions.last()[1]
        terms = self.vocabulary()
        if counts is None:
            counts = _term_counts(_words(jobs, content["stop_words"]), terms)
        weights = weights_of(counts, terms).join(F.broadcast(terms.select("term", "pos")), "term")
        rows = weights.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "term", "weight"))).alias("w"))
        out = salary_scaled(jobs.select("id", *SALARIES), self.bounds()).select("id", *[f"{c}_scaled" for c in SALARIES])
        out = out.join(rows, "id", "left").withColumn("w", F.coalesce("w", F.array().cast(rows.schema["w"].dataType)))
        size = terms.agg(F.count("*").cast("int")).scalar()
        return out.withColumn("_size", size).select(
            "id", *[f"{c}_scaled" for c in SALARIES],
            F.transform("w", lambda t: F.struct(t["term"].alias("term"), t["weight"].alias("weight"))).alias("tfidf"),
            F.struct(F.col("_size").alias("size"), F.col("w.pos").alias("indices"), F.col("w.weight").alias("values")).alias("features"))


def bag_of_words(docs: DataFrame, text: Column, *keep: str) -> DataFrame:
    """id, kept columns, token, n."""
    toks = docs.select("id", *keep, F.explode(words_and_hyphens(text)).alias("token"))
    return toks.groupBy("id", *keep, "token").agg(F.count("*").alias("n"))
