"""Quality rules: base counts per document, then robust multivariate outliers by minimum covariance determinant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, doc_key, id_or_null, materialize, text_or_empty

#: Below it a document fails; repeated words above that percentage, too.
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: Rows that a (language, source) needs for an estimate of its own; smaller ones are judged by their language's, or by that of all rows.
MIN_ROWS = 200
#: Share of rows that an estimate rests on; mean change of a group's log-determinant at which C-steps count as converged, and
#: the most steps (quantile sketches can make the last changes go back and forth).
KEPT_SHARE, SETTLED, MOST_STEPS = 0.75, 1e-3, 20
#: The statistics and the least standard deviation that each counts with.
STATS = {"s_words": 0.7, "s_length": 0.12, "s_symbols": 0.35, "s_lines": 0.7, "s_repeats": 0.08}
#: Chi-square of five degrees of freedom: the median, and the rejection bound (a chance of 1e-6).
MEDIAN, BOUND = 4.3515, 36.0


def base_counts(docs: DataFrame, *keep: Column) -> DataFrame:
    """`keep` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text, within the row.

    Windows of three words are compared by 64-bit hashes: sorted with their places, equal neighbours repeat.
    """
    out = docs.select(*keep, text_or_empty().alias("x"))
    out = out.withColumn("w", F.array_remove(F.split("x", "[\\x20\\x09-\\x0D]+"), ""))
    lines = F.filter(F.split("x", "\n", -1), lambda y: F.btrim(y, F.lit(SPACE)) != "")
    out = out.withColumn("lines", lines).withColumn("wh", F.transform("w", lambda y: F.xxhash64(y)))
    names = [c for c in out.columns if c not in ("x", "w", "lines", "wh")]
    out = out.select(
        *names,
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.char_length("x") - F.char_length(F.regexp_replace("x", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "wh",
    )
    triples = F.transform(F.slice("wh", F.lit(1), F.greatest(F.size("wh") - 2, F.lit(0))), lambda y, i: F.struct(F.xxhash64(y, F.get("wh", i + 1), F.get("wh", i + 2)).alias("h"), i.alias("i")))
    out = out.withColumn("tri", F.sort_array(triples)).drop("wh")
    n = F.greatest(F.size("tri") - 1, F.lit(0))
    same = F.zip_with(F.slice("tri", F.lit(1), n), F.slice("tri", F.lit(2), n), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2)))
    out = out.withColumn("hit", F.filter(same, lambda y: y.isNotNull())).drop("tri")
    return out.withColumn("n_repeat_words", F.size(F.array_distinct(F.flatten("hit"))).cast("long")).drop("hit")


def _statistics(rows: DataFrame) -> DataFrame:
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return rows.select(
        "*",
        F.log1p("n_words").alias("s_words"),
        F.log(chars / n).alias("s_length"),
        F.log1p(100 * F.col("n_symbols") / chars).alias("s_symbols"),
        F.log1p("n_dup_lines").alias("s_lines"),
        (F.col("n_repeat_words") / n).alias("s_repeats"),
    )


def _grouped(rows: DataFrame) -> DataFrame:
    """Columns g and own: each row in the group that judges it (own), and once more in each wider pool that judges others.

    A group is lang and source; one of less than MIN_ROWS is judged by all rows of its lang, and where those are too few
    by all rows of the table.
    """
    name = lambda *c: F.concat_ws("\x1f", *(F.coalesce(F.col(x), F.lit("\x1e")) if isinstance(x, str) else x for x in c))
    sizes = materialize(rows.groupBy("lang", "source").agg(F.count("*").alias("rows")), "sizes")
    langs = sizes.groupBy(F.col("lang").alias("ll")).agg(F.sum("rows").alias("of_lang"), F.min("rows").alias("least"))
    world = langs.agg(F.max(F.col("of_lang") < MIN_ROWS).alias("few"))
    own = sizes.join(langs, F.col("lang").eqNullSafe(F.col("ll"))).crossJoin(world)
    pool, every = name("lang", F.lit("\x1d*")), F.lit("*")
    g = F.when(F.col("rows") >= MIN_ROWS, name("lang", "source")).when(F.col("of_lang") >= MIN_ROWS, pool).otherwise(every)
    used = F.array(F.when((F.col("of_lang") >= MIN_ROWS) & (F.col("least") < MIN_ROWS), pool), F.when(F.col("few"), every))
    own = own.select(F.col("lang").alias("gl"), F.col("source").alias("gs"), g.alias("judge"), F.array_distinct(F.array_compact(F.concat(F.array(g), used))).alias("pools"))
    own = materialize(own, "groups")
    out = rows.join(own, rows.lang.eqNullSafe(F.col("gl")) & rows.source.eqNullSafe(F.col("gs"))).withColumn("g", F.explode("pools"))
    return out.withColumn("own", F.col("g") == F.col("judge")).drop("gl", "gs", "judge", "pools")


def _with_distance(rows: DataFrame, est: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance `dist` of each row to its group's estimate, by forward substitution."""
    out = rows.join(est, "g")
    names = list(STATS)
    for i, s in enumerate(names):
        z = F.col(s) - F.col(f"m{i}")
        for j in range(i):
            z = z - F.col(f"l{i}{j}") * F.col(f"z{j}")
        out = out.withColumn(f"z{i}", z / F.col(f"l{i}{i}"))
    total = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, len(names))), F.col("z0") * F.col("z0"))
    return out.select(*rows.columns, total.alias("dist"))


def _estimate(rows: DataFrame) -> DataFrame:
    """Mean m and Cholesky factor l of each group's covariance, from partial sums; least variances are added."""
    names = list(STATS)
    aggs = [F.avg(s).alias(f"m{i}") for i, s in enumerate(names)]
    aggs += [F.covar_pop(names[i], names[j]).alias(f"c{i}{j}") for i in range(len(names)) for j in range(i + 1)]
    est = rows.groupBy("g").agg(*aggs)
    for j in range(len(names)):
        left = F.col(f"c{j}{j}") + F.lit(STATS[names[j]] ** 2)
        for k in range(j):
            left = left - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        est = est.withColumn(f"l{j}{j}", F.sqrt(F.greatest(left, F.lit(STATS[names[j]] ** 2 / 4))))
        for i in range(j + 1, len(names)):
            part = F.col(f"c{i}{j}")
            for k in range(j):
                part = part - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            est = est.withColumn(f"l{i}{j}", part / F.col(f"l{j}{j}"))
    kept = ["g"] + [f"m{i}" for i in range(len(names))] + [f"l{i}{j}" for i in range(len(names)) for j in range(i + 1)]
    return materialize(est.select(*kept), "estimate")


def _start(rows: DataFrame) -> DataFrame:
    """First estimate: medians, and deviations of the middle rows, without correlation."""
    names = list(STATS)
    q = rows.groupBy("g").agg(*(F.percentile_approx(s, [0.1, 0.5, 0.9], 1000).alias(f"q{i}") for i, s in enumerate(names)))
    cols = [F.get(f"q{i}", F.lit(1)).alias(f"m{i}") for i in range(len(names))]
    cols += [(F.greatest((F.get(f"q{i}", F.lit(2)) - F.get(f"q{i}", F.lit(0))) / 2.563, F.lit(STATS[s])) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, s in enumerate(names) for j in range(i + 1)]
    return materialize(q.select("g", *cols), "estimate")


def mcd_distances(rows: DataFrame) -> DataFrame:
    """rows (with g and the statistics) and `dist`: squared robust distance by fast-MCD C-steps per group.

    From medians and the spread of the middle rows, each step keeps the KEPT_SHARE of a group's rows nearest to its
    estimate and estimates anew from those, until determinants fall no more. It is a regularised estimate: STATS adds a
    least variance to each statistic, so a group whose rows are all alike rejects no near neighbour. As the nearest rows
    vary less than all, distances are set in proportion so that their median is that of the chi-square distribution, where
    that makes them smaller. All are grouped partial sums and quantile sketches over narrow rows, so a group of any size
    is never gathered; the driver sees one row a step.
    """
    est, before = _start(rows), float("inf")
    spread = sum(F.log(f"l{i}{i}") for i in range(len(STATS)))
    for _ in range(MOST_STEPS):
        far = _with_distance(rows, est)
        bound = materialize(far.groupBy("g").agg(F.percentile_approx("dist", KEPT_SHARE, 1000).alias("bound")), "bound")
        est = _estimate(far.join(bound, "g").filter("dist <= bound"))
        now, groups = est.agg(F.sum(2 * spread), F.count("*")).first()
        if not groups or abs(before - now) <= SETTLED * groups:
            break
        before = now
    far = _with_distance(rows, est)
    middle = materialize(far.groupBy("g").agg(F.percentile_approx("dist", 0.5, 1000).alias("middle")), "bound")
    ratio = F.greatest(F.col("middle") / MEDIAN, F.lit(1.0))
    return far.join(middle, "g").withColumn("dist", F.col("dist") / ratio).drop("middle")


def _judged(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    rows = base_counts(docs, doc_key().alias("d"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.xxhash64(text, F.col("lang"), F.col("source")).alias("t"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rows = materialize(rows.withColumn("base_failed", failed), "counts")
    good = materialize(_statistics(_grouped(rows.filter("not base_failed"))), "statistics")
    judged = mcd_distances(good).filter("own").withColumn("kept", F.col("dist") <= BOUND)
    out = ["d", "t", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select(*out, "kept", "dist").unionByName(rows.filter("base_failed").select(*out, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("dist")))


def judge_documents(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Words are runs of `[^\\x20\\x09-\\x0D]`; null texts have none and fail. Documents that pass the base rules are kept
    unless their transformed statistics lie beyond BOUND from the robust estimate of their lang and source (null counts
    as a value of its own), or of the wider pool that holds a small group. Repeated rows come out alike; very long texts
    are counted within their row; other columns don't matter, whatever their names; an empty table gives no rows.
    """
    return _judged(docs).select(id_or_null("d").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, unchanged."""
    gone = materialize(_judged(docs).filter("not kept").select(F.col("d").alias("__sl_d"), F.col("t").alias("__sl_t")).distinct(), "rejected")
    base = docs.withColumn("__sl_d", doc_key()).withColumn("__sl_t", F.xxhash64(text_or_empty(), F.col("lang"), F.col("source")))
    return base.join(gone, ["__sl_d", "__sl_t"], "left_anti").select(*docs.columns)
