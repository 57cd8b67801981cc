"""Quality rules: robust multivariate outliers, with Spark's own functions only.

Each text gives counts; transformed, they form a vector.  For each language and source a
minimum-covariance-determinant estimate (centre and scatter of the three quarters of the
documents that lie closest together) is found by concentration steps from two starts, of
which the smaller determinant wins.  A document goes if it fails the base rule or if its
squared Mahalanobis distance passes a cutoff.

A concentration step is one grouped pass over the vectors: sums for each group and bin of
distance, then a running total over the bins (some 2,000 a group at most).  Vectors are whole
numbers of 1/256, so sums are exact and reruns agree.

A null or empty text has no words and fails.  A null language or source is a value of its own.
Groups of fewer than MIN_ROWS documents take their language's estimate, languages of fewer that of all
documents; a table of fewer in all rejects nothing beyond the base rule.  Repeated rows count each.  Further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checked, read, row_key, stage, without

#: Rows below which a group has no estimate of its own.
MIN_ROWS = 50
#: Share of a group's rows that the estimate rests on.
SUPPORT = 0.75
#: 0.75 over the chance that a chi-square of 7 degrees lies below the 0.75 quantile of 5 degrees (6.626).
CONSISTENCY = 1.41
#: Concentration goes on until no logarithm of a determinant falls by more than SETTLED, for STEPS steps at most.
SETTLED, STEPS = 0.01, 8
#: Squared distance beyond which a document goes: a chi-square of 5 degrees passes it once in ten million.
CUTOFF = 41.0
#: Least standard deviations of the five coordinates, in their (logarithmic) units.
FLOORS = (0.08, 0.35, 0.9, 0.6, 0.5)
P, UNIT = len(FLOORS), 256

_SPACE = r"[ \t\n\x0B\f\r]"
_WORDS = rf"array_remove(split(t, r'{_SPACE}+'), '')"
# Hashes of the windows with their positions, sorted; neighbours with equal hashes and words are repeats;
# then each repeat adds the words that the one before it has not covered.
_SAME = "x.h = {0}.h and w[x.i] = w[{0}.i] and w[x.i + 1] = w[{0}.i + 1] and w[x.i + 2] = w[{0}.i + 2]"
_REPEATS = f"""case when size(w) < 4 then 0L else
  transform(array(transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))), h ->
    case when size(array_distinct(h)) = size(h) then 0L else
      transform(array(sort_array(transform(h, (x, i) -> named_struct('h', x, 'i', i)))), s ->
        aggregate(
          sort_array(transform(
            filter(s, (x, k) -> ({_SAME.format("get(s, k - 1)")}) or ({_SAME.format("get(s, k + 1)")})),
            x -> x.i)),
          named_struct('n', 0L, 'last', -3),
          (a, x) -> named_struct('n', a.n + least(3, x - a.last), 'last', x),
          a -> a.n))[0] end)[0] end"""
_LINES = rf"filter(split(t, '\n'), l -> l rlike r'[^ \t\n\x0B\f\r]')"
STATS = rf"""transform(array(coalesce(text, '')), t -> named_struct(
  'word_chars', cast(length(translate(t, ' \t\n\u000B\u000C\r', '')) as bigint),
  'n_symbols', cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint),
  'lines', transform(array({_LINES}), x -> cast(size(x) - size(array_distinct(x)) as bigint))[0],
  'words', transform(array({_WORDS}), w -> named_struct('n', cast(size(w) as bigint), 'repeats', {_REPEATS}))[0]))[0]"""

STAT_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(key, doc id, language, source, the five counts, base_failed) for each row of docs."""
    out = docs.select(row_key(text_col, id_col).alias("key"), F.col(id_col), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text_col).alias("text"))
    out = out.withColumn("s", F.expr(STATS)).select(
        "key", id_col, "lang", "source", F.col("s.words.n").alias("n_words"), F.col("s.word_chars").alias("word_chars"), F.col("s.n_symbols").alias("n_symbols"),
        F.col("s.lines").alias("n_dup_lines"), F.col("s.words.repeats").alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def vectors(stats: DataFrame) -> DataFrame:
    """The coordinates x1 .. x5 of each row that has words, in whole units of 1/256."""
    logs = (
        "ln(word_chars / n_words)", "ln(1 + 100 * n_symbols / word_chars)", "ln(1 + 1000 * n_dup_lines / n_words)",
        "ln(1 + 100 * n_repeat_words / n_words)", "ln(n_words)",
    )
    return stats.where("n_words > 0").withColumns({f"x{i + 1}": F.expr(f"cast(round({UNIT} * {e}) as bigint)") for i, e in enumerate(logs)})


def _pairs():
    return [(i, j) for i in range(1, P + 1) for j in range(1, i + 1)]


def _factored(est: DataFrame) -> DataFrame:
    """est with the Cholesky factor l{i}{j} of its scatter and the logarithm of its determinant."""
    for j in range(1, P + 1):
        inner = sum((F.col(f"l{j}{k}") ** 2 for k in range(1, j)), F.lit(0.0))
        est = est.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"c{j}{j}") - inner, F.lit(FLOORS[j - 1] ** 2 / 100))))
        est = est.withColumns({f"l{i}{j}": (F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(1, j)), F.lit(0.0))) / F.col(f"l{j}{j}") for i in range(j + 1, P + 1)})
    return est.withColumn("log_det", sum((2 * F.ln(f"l{j}{j}") for j in range(1, P + 1)), F.lit(0.0)))


def _distance(rows: DataFrame) -> DataFrame:
    """rows, joined with factored estimates, with the squared Mahalanobis distance d2."""
    for i in range(1, P + 1):
        rest = sum((F.col(f"l{i}{k}") * F.col(f"y{k}") for k in range(1, i)), F.lit(0.0))
        rows = rows.withColumn(f"y{i}", (F.col(f"x{i}") / UNIT - F.col(f"m{i}") - rest) / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", sum((F.col(f"y{i}") ** 2 for i in range(1, P + 1)), F.lit(0.0)))


def _moments(prefix: str = "") -> dict:
    """Centre and scatter (with the floors) from the sums n, s{i}, s{i}{j} of whole units."""
    mean = {f"m{i}": F.expr(f"s{i} / n / {UNIT}") for i in range(1, P + 1)}
    cov = {}
    for i, j in _pairs():
        raw = F.expr(f"(s{i}{j} - s{i} * s{j} / n) / n / {UNIT * UNIT}")
        cov[f"c{i}{j}"] = raw * CONSISTENCY + (F.lit(FLOORS[i - 1] ** 2) if i == j else F.lit(0.0))
    return mean | cov


def _sums():
    one = [F.count("*").alias("n"), *(F.sum(f"x{i}").cast("double").alias(f"s{i}") for i in range(1, P + 1))]
    return one + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).cast("double").alias(f"s{i}{j}") for i, j in _pairs()]


def estimates(x: DataFrame, keys: list[str]) -> DataFrame:
    """A factored estimate for each value of keys with MIN_ROWS rows or more."""
    quarter = [F.expr(f"percentile(cast(x{i} / 8 as bigint), array(0.25, 0.5, 0.75))").alias(f"q{i}") for i in range(1, P + 1)]  # of few distinct values
    first = x.groupBy(*keys).agg(*_sums(), *quarter).where(F.col("n") >= MIN_ROWS)
    from_means = first.select(*keys, F.lit(0).alias("start"), F.col("n").alias("rows"), *[v.alias(k) for k, v in _moments().items()])
    medians = {f"m{i}": F.col(f"q{i}")[1] * 8 / UNIT for i in range(1, P + 1)}
    spreads = {f"c{i}{j}": ((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) * 8 / UNIT / 1.349) ** 2 + FLOORS[i - 1] ** 2 if i == j else F.lit(0.0) for i, j in _pairs()}
    from_medians = first.select(*keys, F.lit(1).alias("start"), F.col("n").alias("rows"), *[v.alias(k) for k, v in (medians | spreads).items()])
    est = stage(_factored(from_means.unionByName(from_medians)), "estimates")
    for _ in range(STEPS):
        near = _distance(x.select(*keys, *[f"x{i}" for i in range(1, P + 1)]).join(checked(est, 50_000), keys))
        bins = near.withColumn("bin", F.floor(F.ln(1 + F.least("d2", F.lit(1e12))) * 64).cast("int")).groupBy(*keys, "start", "rows", "bin").agg(*_sums())
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys, "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        core = bins.withColumn("before", before).where(F.col("before") < F.ceil(F.col("rows") * SUPPORT))
        names = ["n", *(f"s{i}" for i in range(1, P + 1)), *(f"s{i}{j}" for i, j in _pairs())]
        total = core.groupBy(*keys, "start", "rows").agg(*[F.sum(c).alias(c) for c in names])
        before_it, est = est, stage(_factored(total.select(*keys, "start", "rows", *[v.alias(k) for k, v in _moments().items()])), "estimates")
        was = before_it.select(*[F.col(k).alias(f"w_{k}") for k in (*keys, "start")], F.col("log_det").alias("was"))
        fell = est.join(was, [F.col(k) == F.col(f"w_{k}") for k in (*keys, "start")]).agg(F.max(F.col("was") - F.col("log_det"))).first()[0]
        if fell is None or fell <= SETTLED:
            break
    columns = [c for c in est.columns if c not in (*keys, "start")]
    best = est.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct("log_det", "start")).alias("e"))
    return best.select(*keys, "e.*")


def verdicts(stats: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """stats with distance2 (null where no estimate holds) and kept."""
    named = stats.withColumns({"g_lang": F.coalesce(F.concat(F.lit("v"), "lang"), F.lit("n")), "g_source": F.coalesce(F.concat(F.lit("v"), "source"), F.lit("n"))})
    named = stage(vectors(named).select("key", id_col, "g_lang", "g_source", *STAT_COLUMNS, "base_failed", *[f"x{i}" for i in range(1, P + 1)]), "vectors")
    by_group = estimates(named, ["g_lang", "g_source"])
    by_lang = estimates(named, ["g_lang"])
    whole = estimates(named.withColumn("g_all", F.lit(0)), ["g_all"])
    es = [f"m{i}" for i in range(1, P + 1)] + [f"l{i}{j}" for i, j in _pairs()]
    rows = named.join(checked(by_group.select("g_lang", "g_source", F.struct(*es).alias("e1")), 50_000), ["g_lang", "g_source"], "left")
    rows = rows.join(checked(by_lang.select("g_lang", F.struct(*es).alias("e2")), 50_000), ["g_lang"], "left")
    rows = rows.join(F.broadcast(whole.select(F.struct(*es).alias("e3"))), how="left")  # one row, or none
    rows = _distance(rows.withColumn("e", F.coalesce("e1", "e2", "e3")).select("*", "e.*"))
    rows = rows.select("key", id_col, *STAT_COLUMNS, "base_failed", F.col("d2").alias("distance2"))
    wordless = stats.where("n_words = 0").select("key", id_col, *STAT_COLUMNS, "base_failed", F.lit(None).cast("double").alias("distance2"))
    rows = rows.unionByName(wordless)
    return rows.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance2") <= CUTOFF, F.lit(True)))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that the rules reject."""
    found = verdicts(stage(statistics(docs, id_col, text_col), "statistics"), id_col)
    return without(docs, stage(found.where("not kept").select("key", id_col).distinct(), "rejected"), text_col, id_col)


def op5(spark, sf_dir: str) -> DataFrame:
    found = verdicts(stage(statistics(read(spark, sf_dir, "documents")), "statistics"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")
