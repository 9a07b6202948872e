"""Quality rules: robust multivariate outliers per language and source, with DataFrame functions only.

Every whole text gives simple counts.  Five of their ratios, transformed to be roughly normal and rounded
to whole thousandths, form its statistic vector.  For each (language, source) a minimum covariance
determinant estimate is made: from several starts (medians with median deviations, and small seeded random
subsets) two concentration steps each keep the half of the vectors that is nearest and take its mean and
covariance; of the starts the one with the lowest determinant goes on until its determinant falls no more.  The
covariance of that half is made consistent for normal data, and vectors within the 97.5 % quantile give
the final, reweighted mean and covariance.  A document is rejected when its squared Mahalanobis distance is
above ``CUTOFF``.

Estimates count each distinct vector of a group once, so thousands of copies of one text cannot pull the
estimate onto themselves.  Groups with fewer than ``LEAST_VECTORS`` distinct vectors use the estimate of
their language, then that of all documents.  ``FLOORS`` regularise each covariance, also where determinants
are compared: most statistics of clean texts are constant, and short clean texts vary more than long ones.
Sums are over whole numbers and quantiles are exact, so results don't depend on how rows are dealt out.  No
step collects rows; the driver only sees whether tables are empty and how many groups still change.

Defined results: a null text has no words and fails the base rules; a very long text is counted whole, in
one row; null languages and sources are groups of their own; repeated rows each get the same verdict; where
no vector exists at all nothing but the base rules rejects; an empty table gives an empty result; further
columns, whatever their names, are ignored by ``rate`` and kept as they are by ``keep_good``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, settle, words_of

#: Rounding of the statistics: whole numbers of this fraction.
SCALE = 1000
#: Added to each statistic's spread: mean word length, then square roots of four ratios.  A text that is odd in
#: one statistic alone passes the cutoff at 5.1 floors.
FLOORS = {"q_length": 0.35, "q_symbols": 0.035, "q_marks": 0.06, "q_capitals": 0.06, "q_repeats": 0.1}
#: Squared distance from which on a document is an outlier: for five normal statistics, one in 10,000.
CUTOFF = 25.74
#: The 97.5 % quantile of chi square with five degrees, and what makes covariances of the nearest half and of
#: the vectors within that quantile consistent: share / P(chi square with seven degrees <= the share's quantile with five).
WITHIN, HALF_FACTOR, WITHIN_FACTOR = 12.8325, 1.9122, 1.0555
#: Random starts besides the medians, vectors in each, steps before the best start is chosen, and most steps after.
RANDOM_STARTS, START_VECTORS, FIRST_STEPS, MOST_STEPS = 4, 12, 2, 30
LEAST_VECTORS = 30
MIN_WORDS = 50
#: Groups whose estimates (a few hundred bytes each) are broadcast; more are joined by a shuffle.
MOST_BROADCAST_GROUPS = 20_000
SYMBOLS = "[#*$%&|<>]"

DIMS = list(FLOORS)


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def _repeated_words(shingles: Column, width: int = 3) -> Column:
    """Positions within ``width`` of a shingle that occurs twice or more, given each position's shingle hash."""
    placed = F.array_sort(F.transform(shingles, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(*[x["i"] + k for k in range(width)])))))

    return F.when(F.size(F.array_distinct(shingles)) == F.size(shingles), 0).otherwise(_let(placed, covered))


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` (from _prepared) with the base counts and the statistic vector (columns q_...), without q_text."""
    text = F.coalesce(F.col("q_text"), F.lit(""))
    out = docs.withColumn("q_words", words_of(F.col("q_text")))
    words = F.col("q_words")
    n = F.size(words)
    shingles = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    out = out.withColumns(
        {
            "q_n_words": n.cast("long"),
            "q_word_chars": F.length(F.array_join(words, "")).cast("long"),
            "q_n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "q_n_marks": F.regexp_count(text, F.lit(r"[!?;:=~^\\/@_{}\[\]()\"+]")).cast("long"),
            "q_n_capitals": F.regexp_count(text, F.lit("[A-Z]")).cast("long"),
            "q_shingles": F.coalesce(shingles, F.array().cast("array<bigint>")),
            "q_lines": lines,
        }
    )
    out = out.withColumns(
        {
            "q_n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
            "q_n_repeat_words": _repeated_words(F.col("q_shingles")).cast("long"),
        }
    ).drop("q_words", "q_shingles", "q_lines", "q_text")
    failed = (F.col("q_n_words") < MIN_WORDS) | (100 * F.col("q_n_repeat_words") > 50 * F.col("q_n_words"))
    per_char = lambda c: F.sqrt(F.col(c) / F.greatest(F.col("q_word_chars"), F.lit(1)))
    vector = {
        "q_length": F.col("q_word_chars") / F.greatest(F.col("q_n_words"), F.lit(1)),
        "q_symbols": per_char("q_n_symbols"),
        "q_marks": per_char("q_n_marks"),
        "q_capitals": per_char("q_n_capitals"),
        "q_repeats": F.sqrt(F.col("q_n_repeat_words") / F.greatest(F.col("q_n_words"), F.lit(1))),
    }
    return out.withColumns({k: F.round(SCALE * v).cast("long") for k, v in vector.items()} | {"q_base_failed": failed})


def _group(lang: Column, source: Column) -> Column:
    mark = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))
    return F.concat_ws("\u0001", mark(lang), mark(source))


def _with_distance(vectors: DataFrame) -> DataFrame:
    """The column d2 from an estimate's m_i and k_i_j; one flat expression, so filters on it stay small."""
    white = ["(" + " + ".join(f"k_{i}_{j} * ({DIMS[j]} - m_{j})" for j in range(i + 1)) + ")" for i in range(len(DIMS))]
    return vectors.withColumn("d2", F.expr(" + ".join(f"{z} * {z}" for z in white)))


def _estimates(chosen: DataFrame, factor: float = 1.0) -> DataFrame:
    """Mean m_i, inverse Cholesky factor k_i_j and logarithm of the determinant of each (q_group, q_start)'s
    covariance times ``factor``, floors added."""
    p, pairs = len(DIMS), [(i, j) for i in range(len(DIMS)) for j in range(i + 1)]
    sums = [F.expr(f"sum({a})").alias(f"s_{i}") for i, a in enumerate(DIMS)]
    products = [F.expr(f"sum({DIMS[i]} * {DIMS[j]})").alias(f"p_{i}_{j}") for i, j in pairs]
    out = chosen.groupBy("q_group", "q_start").agg(F.count("*").alias("n"), *sums, *products)
    # one select, in which later columns refer to earlier ones; floors keep pivots positive, greatest() guards rounding
    steps = [f"s_{i} / n AS m_{i}" for i in range(p)]
    for i, j in pairs:
        cov = f"{factor!r}D * (p_{i}_{j} / n - m_{i} * m_{j})"
        if i == j:
            cov = f"greatest({cov}, 0D) + {(SCALE * FLOORS[DIMS[i]]) ** 2!r}D"
        cov = " - ".join([cov, *[f"l_{i}_{k} * l_{j}_{k}" for k in range(j)]])
        steps.append(f"sqrt(greatest({cov}, 1e-6D)) AS l_{i}_{i}" if i == j else f"({cov}) / l_{j}_{j} AS l_{i}_{j}")
    for i, j in pairs:
        below = " + ".join(["0D", *[f"l_{i}_{k} * k_{k}_{j}" for k in range(j, i)]])
        steps.append(f"({1.0 if i == j else 0.0}D - ({below})) / l_{i}_{i} AS k_{i}_{j}")
    steps.append("2 * (" + " + ".join(f"ln(l_{i}_{i})" for i in range(p)) + ") AS log_det")
    return out.selectExpr("*", *steps).select("q_group", "q_start", "log_det", *ESTIMATE)


#: Columns of an estimate.
ESTIMATE = [f"m_{i}" for i in range(len(DIMS))] + [f"k_{i}_{j}" for i in range(len(DIMS)) for j in range(i + 1)]


def _nearest_half(measured: DataFrame, hint) -> DataFrame:
    """The vectors whose d2 is at most their group's median, which is exact on a fine scale of its logarithm."""
    measured = measured.withColumn("rank", F.floor(200 * F.log1p("d2")))
    half = measured.groupBy("q_group", "q_start").agg(F.percentile("rank", F.lit(0.5)).alias("half"))
    return measured.join(hint(half), ["q_group", "q_start"]).where("rank <= half").select("q_group", "q_start", *DIMS)


def _medians(levels: DataFrame, hint) -> DataFrame:
    """The start (q_start 0) from medians and median deviations."""
    medians = [F.percentile(a, F.lit(0.5)).alias(f"m_{i}") for i, a in enumerate(DIMS)]
    centre = settle(levels.groupBy("q_group").agg(*medians))
    apart = levels.join(hint(centre), "q_group")
    apart = apart.groupBy("q_group").agg(*[F.percentile(F.abs(F.col(a) - F.col(f"m_{i}")), F.lit(0.5)).alias(f"a_{i}") for i, a in enumerate(DIMS)])
    scale = [F.sqrt(F.pow(1.4826 * F.col(f"a_{i}"), 2) + (SCALE * FLOORS[a]) ** 2) for i, a in enumerate(DIMS)]
    p = len(DIMS)
    factors = [(1 / scale[i] if i == j else F.lit(0.0)).alias(f"k_{i}_{j}") for i in range(p) for j in range(i + 1)]
    return centre.join(apart, "q_group").select("q_group", F.lit(0).alias("q_start"), F.lit(None).cast("double").alias("log_det"), *[f"m_{i}" for i in range(p)], *factors)


def _random_starts(levels: DataFrame, counts: DataFrame, hint) -> DataFrame:
    """Estimates of RANDOM_STARTS seeded subsets of about START_VECTORS vectors of each group."""
    drawn = levels.join(hint(counts), "q_group").withColumn("q_start", F.explode(F.array(*[F.lit(i + 1) for i in range(RANDOM_STARTS)])))
    draw = F.pmod(F.xxhash64("q_start", *DIMS), F.lit(1 << 40)) / float(1 << 40)
    return _estimates(drawn.where(draw * F.col("count") < START_VECTORS))


def fit(counted: DataFrame, least: int = LEAST_VECTORS) -> tuple[DataFrame, DataFrame]:
    """(estimates by q_group, map from (lang, source) group to the q_group that stands for it)."""
    vectors = settle(counted.where("not q_base_failed").select("q_own", "q_lang", *DIMS).distinct())
    wide = vectors.select("q_lang", *DIMS).distinct()
    everything = wide.select(*DIMS).distinct().withColumn("q_group", F.lit("*"))
    levels = vectors.select(F.col("q_own").alias("q_group"), *DIMS)
    levels = levels.unionByName(wide.select(F.concat(F.lit("*"), "q_lang").alias("q_group"), *DIMS)).unionByName(everything)
    levels = settle(levels)
    counts = settle(levels.groupBy("q_group").count())
    # a hot group's vectors stay where they are while groups are few: what is joined has a row for each group
    hint = F.broadcast if counts.count() <= MOST_BROADCAST_GROUPS else lambda df: df
    large = counts.where(F.col("count") >= least).select("q_group")
    fitted = settle(levels.join(hint(counts.where((F.col("count") >= least) | (F.col("q_group") == "*")).select("q_group")), "q_group"))

    def step(now: DataFrame) -> DataFrame:
        return _estimates(_nearest_half(_with_distance(fitted.join(hint(now), "q_group")), hint))

    now = settle(_medians(fitted, hint).unionByName(_random_starts(fitted, counts, hint)))
    for _ in range(FIRST_STEPS):
        now = settle(step(now))
    lowest = now.groupBy("q_group").agg(F.min(F.struct("log_det", "q_start")).alias("best")).select("q_group", "best.q_start")
    moving = settle(now.join(hint(lowest), ["q_group", "q_start"]))
    reached = [moving]  # the estimates of each step, of the groups whose determinant fell
    for _ in range(MOST_STEPS):
        was = moving.select("q_group", F.col("log_det").alias("was"))
        after = settle(step(moving))  # settled first: a filter that is pushed below would spell log_det out whole
        moving = settle(after.join(was, "q_group").where(F.col("log_det") < F.col("was") - 1e-9).drop("was"))
        if moving.isEmpty():
            break
        reached.append(moving)
    last = reduce(DataFrame.unionByName, reached)
    now = settle(last.groupBy("q_group").agg(F.min(F.struct("log_det", "q_start", *ESTIMATE)).alias("best")).select("q_group", "best.*"))
    half = _estimates(_nearest_half(_with_distance(fitted.join(hint(now), "q_group")), hint), HALF_FACTOR)
    within = _with_distance(fitted.join(hint(settle(half)), "q_group")).where(F.col("d2") <= WITHIN)
    estimate = settle(_estimates(within.select("q_group", "q_start", *DIMS), WITHIN_FACTOR).select("q_group", *ESTIMATE))
    groups = counted.select("q_own", "q_lang").distinct()
    own, lang = large.withColumnRenamed("q_group", "own"), large.withColumnRenamed("q_group", "lang")
    groups = groups.join(own, F.col("q_own") == F.col("own"), "left").join(lang, F.concat(F.lit("*"), "q_lang") == F.col("lang"), "left")
    stands = groups.select("q_own", F.coalesce("own", "lang", F.lit("*")).alias("q_group"))
    return estimate, stands


def _prepared(docs: DataFrame) -> DataFrame:
    """(row, q_text, q_lang, q_own)."""
    mark = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))
    return carried(docs, q_text=F.col("text"), q_lang=mark, q_own=_group(F.col("lang"), F.col("source")))


def verdicts(counted: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``counted`` (from with_counts) with q_d2 and q_kept."""
    estimate, stands = fit(counted)
    by_group = settle(stands.join(estimate, "q_group", "left").drop("q_group"))
    if by_group.count() <= MOST_BROADCAST_GROUPS:
        by_group = F.broadcast(by_group)
    out = _with_distance(counted.join(by_group, "q_own", "left"))
    kept = ~F.col("q_base_failed") & (F.coalesce("d2", F.lit(0.0)) <= cutoff)
    return out.select(*counted.columns, F.col("d2").alias("q_d2"), kept.alias("q_kept"))


def rate(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, d2) for each row."""
    slim = _prepared(docs).withColumn("row", F.col("row.doc_id"))
    out = verdicts(settle(with_counts(slim)), cutoff)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2"]
    return out.select(F.col("row").alias("doc_id"), *[F.col(f"q_{x}").alias(x) for x in names])


def keep_good(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that pass, columns as they are."""
    counted = settle(with_counts(_prepared(docs)))  # texts included: they are read and counted once
    return verdicts(counted, cutoff).where("q_kept").select("row.*")
