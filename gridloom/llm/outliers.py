"""Quality rules by robust multivariate outliers: minimum covariance determinant per language and source.

Statistics of each whole text (words are runs of other characters than space and \\t to \\r) are turned to logarithms:
mean word length, symbols, repeated lines and repeated words by share. For each language and source the minimum
covariance determinant estimate of their centre and scatter comes from concentration steps: from medians and
quartiles, keep the COVERAGE of rows nearest by Mahalanobis distance, take these rows' mean and covariance, again.
Nearest rows are found by counts of binned distances, and moments are sums, so no group of rows meets in one task.
A text is rejected if its squared distance is over CUTOFF or a base rule fails it. FLOORS are added to the scatter,
as most texts have no symbol or repetition at all: below these spreads a difference says nothing.

Everything is DataFrame expressions. A null or empty text has no words and fails the base rule; null languages and
sources are groups of their own; a group without a row that passes the base rules rejects nothing further. Repeated
rows repeat. Columns beyond doc_id, text, lang and source aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import stored

COVERAGE, STEPS = 0.75, 4
#: Chi-squared with 4 degrees of freedom: its 0.9999 quantile; what makes the covariance of its nearest 75 % consistent.
CUTOFF, CONSISTENT = 23.51, 1.486
FLOORS = (0.12, 0.5, 1.0, 1.0)
BINS = 4000
_P = range(4)
SPACES = "[\\x20\\x09-\\x0D]+"


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row's whole text."""
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(lang as string) lang", "cast(source as string) source", "coalesce(cast(text as string), '') text")
    words = docs.select(
        "doc_id", "lang", "source",
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        F.expr("filter(split(text, '\\n', -1), x -> length(translate(x, ' \\t\\n\\u000b\\f\\r', '')) > 0)").alias("lines"),
        F.array_remove(F.split("text", SPACES), "").alias("words"),
    )
    hashes = words.select(
        "doc_id", "lang", "source", "n_symbols", "word_chars", F.size("words").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    windows = hashes.withColumn("win", F.expr("CASE WHEN n_words >= 9 THEN transform(sequence(1, cast(n_words as int) - 7), i -> xxhash64(slice(h, i, 8))) END")).drop("h")
    windows = windows.withColumn("some", F.expr("size(array_distinct(win)) < size(win)"))
    # begins of windows found twice or more, in order; only for texts that have some
    ranked = windows.withColumn("ranked", F.expr("CASE WHEN some THEN array_sort(transform(win, (v, i) -> struct(v, i))) END")).drop("win")
    begins = ranked.withColumn("begins", F.expr("""
        CASE WHEN some THEN array_sort(transform(filter(transform(ranked, (x, j) -> struct(x.i as i,
            coalesce(get(ranked, j - 1).v = x.v, false) or coalesce(get(ranked, j + 1).v = x.v, false) as twice)), x -> x.twice), x -> x.i)) END""")).drop("ranked")  # fmt: skip
    repeated = "CASE WHEN some THEN aggregate(begins, struct(0L as n, -8 as last), (s, b) -> struct(s.n + least(8, b - s.last) as n, b as last), s -> s.n) ELSE 0L END"
    return begins.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.expr(repeated).alias("n_repeat_words"))


def _vectors(stats: DataFrame) -> DataFrame:
    x = ("ln(greatest(word_chars, 1) / n)", "ln(1 + 1000 * n_symbols / n)", "ln(1 + 1000 * n_dup_lines / n)", "ln(1 + 100 * n_repeat_words / n)")
    return (
        stats.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))
        .withColumn("n", F.expr("greatest(n_words, 1)")).withColumns({f"x{i}": F.expr(e) for i, e in enumerate(x)}).drop("n")
        .withColumn("cell", F.to_json(F.struct("lang", "source")))
    )


def _factored(params: DataFrame) -> DataFrame:
    """params (cell, m0.., s00..) with the lower triangle l00.. of the scatter's Cholesky factor."""
    for i in _P:
        for j in range(i + 1):
            rest = F.col(f"s{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            params = params.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    return params.select("cell", *(f"m{i}" for i in _P), *(f"l{i}{j}" for i in _P for j in range(i + 1)))


def _distances(rows: DataFrame, params: DataFrame) -> DataFrame:
    """rows with `distance`, squared; null where the cell has no estimate."""
    rows = rows.join(params, "cell", "left")
    for i in _P:
        rows = rows.withColumn(f"z{i}", (F.col(f"x{i}") - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * F.col(f"z{k}") for k in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    total = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in _P), F.lit(0.0))
    return rows.withColumn("distance", total).drop(*(f"m{i}" for i in _P), *(f"z{i}" for i in _P), *(f"l{i}{j}" for i in _P for j in range(i + 1)))


def estimates(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The estimate of each cell, from rows (cell, x0..x3)."""
    mid = [F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 2000).alias(f"q{i}") for i in _P]
    params = rows.groupBy("cell").agg(*mid).select(
        "cell", *(F.col(f"q{i}")[1].alias(f"m{i}") for i in _P),
        *((F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2) + FLOORS[i] ** 2 if i == j else F.lit(0.0)).alias(f"s{i}{j}") for i in _P for j in range(i + 1)),
    )
    params = stored(spark, _factored(params), "scatter")
    for _ in range(STEPS):
        near = _distances(rows, params).withColumn("bin", F.expr(f"cast(least({BINS}, 64 * log2(1 + distance)) as int)"))
        counts = near.groupBy("cell", "bin").count()
        w = Window.partitionBy("cell")
        cut = counts.withColumn("upto", F.sum("count").over(w.orderBy("bin"))).withColumn("all", F.sum("count").over(w))
        cut = cut.where(F.col("upto") >= F.ceil(COVERAGE * F.col("all"))).groupBy("cell").agg(F.min("bin").alias("cut"))
        cut = stored(spark, cut, "cuts")  # a table, so that the join may split a hot cell
        near = near.join(cut, "cell").where("bin <= cut")
        sums = near.groupBy("cell").agg(F.count("*").alias("n"), *(F.avg(f"x{i}").alias(f"m{i}") for i in _P), *(F.avg(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"e{i}{j}") for i in _P for j in range(i + 1)))
        params = sums.select("cell", *(f"m{i}" for i in _P), *(((F.col(f"e{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * CONSISTENT + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"s{i}{j}") for i in _P for j in range(i + 1)))
        params = stored(spark, _factored(params), "scatter")
    return params


def judged(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The statistics of each row of docs with base_failed, distance and kept; see the module."""
    rows = _vectors(stored(spark, statistics(docs), "statistics"))
    found = _distances(rows, estimates(spark, rows.where("not base_failed").select("cell", *(f"x{i}" for i in _P))))
    return found.selectExpr("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", f"not base_failed and coalesce(distance <= {CUTOFF}, true) kept", "distance")
