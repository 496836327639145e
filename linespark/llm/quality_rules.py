"""Quality rules: fixed limits, then robust multivariate outliers by minimum covariance determinant (MCD).

All of it is DataFrame functions.  Text statistics come from one pass over the texts; everything after that works on one
small row of numbers for each document.  For each language and source the MCD is sought by concentration steps from two
fixed starts: take the ``coverage`` share of documents nearest to the present centre, take their mean and covariance,
repeat, and keep the start with the smaller determinant.  With half of the documents as coverage a group may be junk up to
almost a half.  The covariance of the nearer half is scaled to that of a whole normal population, so the limit is a fixed
chi-square quantile and no quantile of the documents' own distances, which junk could raise.  A step is two aggregations that
combine before the shuffle; its joins go by group and salt, as the whole table is a group of its own and a language or source
may hold most rows.  Groups of under ``min_group`` documents use the estimate of their language, languages with fewer that of
the whole table, which is there however few documents it has.
"""

from __future__ import annotations

from math import exp, gamma
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, keep, safe_columns

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
COVERAGE = 0.5
STEPS = 4
#: Ten documents for each dimension of the covariance.
MIN_GROUP = 50
#: Share of a normal population that the distance limit would reject; texts have heavier tails than that.
TAIL = 1e-12
#: Spread, in each transformed statistic, that is never taken for abnormal: the covariance gets its square on the diagonal.
FLOORS = (0.5, 0.075, 0.25, 0.35, 0.6)
#: Estimates that are sent to every task when rows with whole texts are judged; more of them are joined by salted shuffle.
FEW_GROUPS = 10_000
DIM = len(FLOORS)
ANY = "\u0000any"
#: The rows of a group are dealt over so many join keys, and its estimate is there once for each.
SALTS = 64
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Documents with more repeated windows than this find their places by sorting instead of by search; the result is the same.
FEW = 48


def text_stats(docs: DataFrame) -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (null text: as empty, all 0).

    Words are runs of anything but white space (space and U+0009 to U+000D). Windows of three words count as equal when
    their 64-bit hashes are.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, f"{SPACE}+"), "")
    kept = [c for c in docs.columns]
    with_words = docs.select(*kept, words.alias("_w"), F.size(words).alias("_n"), F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE[1:-1]}]")).alias("_lines"))
    window = lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    hashed = with_words.select(
        *kept, F.size("_w").cast("bigint").alias("n_words"), F.char_length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(0), F.col("_n") - 3), window)).otherwise(F.array().cast("array<bigint>")).alias("_h"))
    ordered = hashed.withColumn("_s", F.sort_array("_h"))
    equal = F.filter("_s", lambda x, i: x == F.get("_s", i - 1))
    found = ordered.withColumn("_dup", F.when(F.size("_s") > 0, F.array_distinct(equal)).otherwise(F.array().cast("array<bigint>")))
    by_search = F.filter(F.transform("_h", lambda x, i: F.when(F.array_contains("_dup", x), i)), lambda i: i.isNotNull())

    def by_sort() -> Column:
        pairs = F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        # The array of one element binds the sorted pairs to a name, so that they are made once for each document.
        return F.element_at(F.transform(F.array(pairs), lambda p: F.filter(F.transform(p, lambda e, k: F.when(
            (F.get(p, k - 1)["x"] == e["x"]) | (F.get(p, k + 1)["x"] == e["x"]), e["i"])), lambda i: i.isNotNull())), 1)

    at = F.when(F.size("_dup") <= FEW, by_search).otherwise(by_sort())
    placed = found.withColumn("_at", F.when(F.size("_dup") > 0, at).otherwise(F.array().cast("array<int>")))
    covered = F.size(F.array_distinct(F.flatten(F.transform("_at", lambda i: F.array(i, i + 1, i + 2)))))
    return placed.select(*kept, *STATS[:-1], covered.cast("bigint").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _vector() -> list[Column]:
    per = lambda c: F.col(c) / F.col("n_words")
    return [F.log(F.col("n_words")), F.log(per("word_chars")), F.log1p(100 * per("n_symbols")), F.log1p(100 * per("n_dup_lines")), F.log1p(100 * per("n_repeat_words"))]


def chi2_quantile(p: float, dim: int = DIM) -> float:
    """Wilson and Hilferty's approximation."""
    a = 2 / (9 * dim)
    return dim * (1 - a + NormalDist().inv_cdf(p) * a ** 0.5) ** 3


def consistency(coverage: float, dim: int = DIM) -> float:
    """Covariance of a normal population over that of its ``coverage`` share nearest to the centre."""
    if coverage >= 1:
        return 1.0
    x = chi2_quantile(coverage, dim)
    return coverage / (coverage - x ** (dim / 2) * exp(-x / 2) / (2 ** (dim / 2) * gamma(dim / 2 + 1)))


X = [f"_x{i}" for i in range(DIM)]
LOWER = [(i, j) for i in range(DIM) for j in range(i + 1)]


def _factor(moments: DataFrame, scale: float = 1.0) -> DataFrame:
    """Mean ``_m*`` and Cholesky factor ``_l*`` of the scaled covariance, from sums of products; ``_det`` is the log determinant."""
    cov = {f"_c{i}{j}": scale * (F.col(f"_q{i}{j}") / F.col("_k") - F.col(f"_m{i}") * F.col(f"_m{j}")) + (FLOORS[i] ** 2 if i == j else 0) for i, j in LOWER}
    out = moments.withColumns({f"_m{i}": F.col(f"_t{i}") / F.col("_k") for i in range(DIM)}).withColumns(cov)
    for j in range(DIM):  # one column of the factor after the other
        out = out.withColumn(f"_l{j}{j}", F.sqrt(F.greatest(F.col(f"_c{j}{j}") - sum((F.col(f"_l{j}{k}") ** 2 for k in range(j)), F.lit(0.0)), F.lit(1e-9))))
        out = out.withColumns({f"_l{i}{j}": (F.col(f"_c{i}{j}") - sum((F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"_l{j}{j}") for i in range(j + 1, DIM)})
    return out.withColumn("_det", 2 * sum((F.log(f"_l{i}{i}") for i in range(DIM)), F.lit(0.0)))


FITTED = [*(f"_m{i}" for i in range(DIM)), *(f"_l{i}{j}" for i, j in LOWER)]


def _with_distance(df: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance ``_d`` by forward substitution."""
    for i in range(DIM):
        df = df.withColumn(f"_y{i}", (F.col(f"_x{i}") - F.col(f"_m{i}") - sum((F.col(f"_l{i}{k}") * F.col(f"_y{k}") for k in range(i)), F.lit(0.0))) / F.col(f"_l{i}{i}"))
    return df.withColumn("_d", sum((F.col(f"_y{i}") ** 2 for i in range(DIM)), F.lit(0.0)))


def _moments() -> list[Column]:
    return [F.count("*").alias("_k"), *(F.sum(x).alias(f"_t{i}") for i, x in enumerate(X)), *(F.sum(F.col(X[i]) * F.col(X[j])).alias(f"_q{i}{j}") for i, j in LOWER)]


def _salted(estimates: DataFrame) -> DataFrame:
    """Each estimate once for each salt: groups times ``SALTS`` rows."""
    return estimates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def fit_mcd(vectors: DataFrame, coverage: float = COVERAGE, steps: int = STEPS) -> DataFrame:
    """MCD of stored rows ``_key, _salt, _x0 ...``: one row per key with mean, factor and ``_size``; the salt deals a key's rows over tasks.

    The quantile of distances is read off a bounded sketch of all rows (``approx_percentile``, accuracy 10,000).
    """
    quantile = lambda c: F.percentile_approx(c, F.lit(coverage), F.lit(10_000))
    on, scale = ["_key", "_salt"], consistency(coverage)
    centre = vectors.groupBy("_key").agg(*(F.percentile_approx(x, F.lit(0.5), F.lit(10_000)).alias(f"_m{i}") for i, x in enumerate(X)))
    spread = (vectors.join(_salted(centre), on).groupBy("_key", *(f"_m{i}" for i in range(DIM)))
              .agg(*(F.percentile_approx(F.abs(F.col(x) - F.col(f"_m{i}")), F.lit(0.5), F.lit(10_000)).alias(f"_a{i}") for i, x in enumerate(X))))
    by_median = spread.select("_key", F.lit(0).alias("_start"), *(f"_m{i}" for i in range(DIM)),
                              *(F.sqrt((1.4826 * F.col(f"_a{i}")) ** 2 + FLOORS[i] ** 2).alias(f"_l{i}{j}") if i == j else F.lit(0.0).alias(f"_l{i}{j}") for i, j in LOWER))
    by_mean = _factor(vectors.groupBy("_key").agg(*_moments())).select("_key", F.lit(1).alias("_start"), *FITTED)
    fitted = keep(by_median.unionByName(by_mean))
    for _ in range(steps):
        limits = _with_distance(vectors.join(_salted(fitted), on)).groupBy("_key", "_start").agg(quantile("_d").alias("_near"))
        near = _with_distance(vectors.join(_salted(fitted.join(limits, ["_key", "_start"])), on)).filter("_d <= _near")
        fitted = keep(_factor(near.groupBy("_key", "_start").agg(*_moments()), scale).select("_key", "_start", *FITTED, "_det"))
    best = fitted.groupBy("_key").agg(F.min_by(F.struct(*FITTED), F.struct("_det", "_start")).alias("_f")).select("_key", "_f.*")
    return keep(best.join(vectors.groupBy("_key").agg(F.count("*").alias("_size")), "_key"))


def judge(docs: DataFrame, coverage: float = COVERAGE, steps: int = STEPS, min_group: int = MIN_GROUP, tail: float = TAIL,
          carry_text: bool = False) -> DataFrame:
    """Add the statistics, ``base_failed``, ``kept`` and ``distance`` (in units of the limit; null for base failures) to every document.

    Needs ``text``, ``lang`` and ``source``; null and empty texts fail the base rules, null ``lang`` or ``source`` is a group of its own,
    repeated rows are judged alike, extra columns are carried along. Without any group of ``min_group`` documents the whole table is the group.
    Raises if a result column is already there. ``text`` is carried along only with ``carry_text``, for which the statistics are made twice.
    """
    safe_columns(docs, [*STATS, "base_failed", "kept", "distance"])
    named = [c for c in docs.columns if c != "text"]
    stats = keep(_with_salt(text_stats(docs).select(*named, *STATS).withColumn("base_failed", base_failed())))
    if not carry_text:
        return verdicts(stats, coverage, steps, min_group, tail).select(*named, *STATS, "base_failed", "kept", "distance")
    chosen = keep(estimates(stats, coverage, steps, min_group))
    # The statistics are made a second time beside the text: whole texts are neither stored nor dealt by language and source.
    # They are generated, so that a filter on the verdict does not repeat them.
    again = text_stats(docs).withColumn("base_failed", base_failed()).select(*docs.columns, F.explode(F.array(F.struct(*STATS, "base_failed"))).alias("_s"))
    return _measured(again.select(*docs.columns, "_s.*"), chosen, tail).select(*docs.columns, *STATS, "base_failed", "kept", "distance")


def _with_salt(stats: DataFrame) -> DataFrame:
    """Salts in turn, also for rows that are equal; the row numbers may differ from run to run, so this is stored before use."""
    return stats.withColumn("_salt", (F.monotonically_increasing_id() % SALTS).cast("int"))


def verdicts(stats: DataFrame, coverage: float = COVERAGE, steps: int = STEPS, min_group: int = MIN_GROUP, tail: float = TAIL) -> DataFrame:
    """``kept`` and ``distance`` for a stored table of statistics."""
    if "_salt" not in stats.columns:
        stats = keep(_with_salt(stats))
    return _measured(stats, estimates(stats, coverage, steps, min_group), tail)


def estimates(stats: DataFrame, coverage: float = COVERAGE, steps: int = STEPS, min_group: int = MIN_GROUP) -> DataFrame:
    """``lang, source`` and the estimate by which its documents are judged, for each language and source that has documents to judge."""
    lang, source = F.coalesce("lang", F.lit("\u0000null")), F.coalesce("source", F.lit("\u0000null"))
    levels = F.array(F.concat_ws("\u0001", lang, source), F.concat_ws("\u0001", lang, F.lit(ANY)), F.concat_ws("\u0001", F.lit(ANY), F.lit(ANY)))
    good = stats.filter(~F.col("base_failed"))
    vectors = good.select("_salt", F.explode(levels).alias("_key"), *(v.alias(x) for v, x in zip(_vector(), X)))
    fitted = fit_mcd(vectors, coverage, steps).filter((F.col("_size") >= min_group) | (F.col("_key") == f"{ANY}\u0001{ANY}"))
    # Each (language, source) takes the first level that has enough documents; the rows then join once.
    groups = good.groupBy("lang", "source").agg(F.count("*").alias("_n")).select("lang", "source", F.posexplode(levels).alias("_level", "_key"))
    return groups.join(fitted, "_key").groupBy("lang", "source").agg(F.min_by(F.struct(*FITTED), "_level").alias("_f")).select("lang", "source", "_f.*")


def _measured(rows: DataFrame, chosen: DataFrame, tail: float) -> DataFrame:
    """Rows with statistics joined to the estimate of their language and source: ``distance`` and ``kept``.

    Rows that hold whole texts stay where they are while there are at most ``FEW_GROUPS`` estimates (counted; some 200 bytes each). More estimates than
    that are copied once for each salt, and rows go by language, source and salt, so that the texts of a hot source do not meet in one task.
    """
    if "text" in rows.columns:
        if chosen.count() <= FEW_GROUPS:
            chosen = F.broadcast(chosen)
        else:
            rows, chosen = rows.withColumn("_salt", (F.monotonically_increasing_id() % SALTS).cast("int")), _salted(chosen).withColumnRenamed("_salt", "_of")
    same = rows["lang"].eqNullSafe(chosen["lang"]) & rows["source"].eqNullSafe(chosen["source"])
    if "_of" in chosen.columns:
        same = same & (rows["_salt"] == chosen["_of"])
    joined = rows.join(chosen, same, "left").drop(chosen["lang"]).drop(chosen["source"])
    measured = _with_distance(joined.withColumns({x: F.when(~F.col("base_failed"), v) for v, x in zip(_vector(), X)}))
    return measured.withColumn("distance", F.col("_d") / chi2_quantile(1 - tail)).withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= 1))
