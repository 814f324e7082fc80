"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Every rule is a measure of a whole text, in thousandths; a text is rejected where a
measure reaches the rule's cutoff for the text's stratum (its language). Cutoffs
come from labelled documents: on those labelled good, rejecting at a cutoff is a
binomial trial, and the exact (Clopper-Pearson) test certifies a cutoff when so few
false rejections would be seen only rarely, at level :data:`DELTA`, if their true rate
were above the rule's share of :data:`ALPHA`. Cutoffs are tested from the most
lenient one on and testing stops at the first that fails, which needs no
correction inside a rule; across rules and strata the level is divided by their
number (Bonferroni). So with probability 1 - DELTA all strata together lose at most
ALPHA of their good documents. Of the certified cutoffs a rule takes the one that
rejects most documents labelled bad, each good one counting :data:`GOOD_COST` times;
a stratum with too few labels to certify anything keeps all its documents. Equal
texts are one trial, however many documents hold them; texts that are merely alike
count each, so the guarantee takes these for independent.

All measures come from one scan without an exchange: arrays and higher-order
functions inside a row. What is joined and counted is a table of a few numbers for
each document.

Defined results: a null text has no words and fails the base rule; a null stratum is
one of its own; documents with several labels, and equal texts with several, count as
good if any says so; null labels are left out; a very long text is measured whole; an empty table gives no rows; other columns are ignored by
:func:`verdicts` and carried by :func:`keep_good`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.llm.words import word_array
from rasterloom.session import stored

ALPHA = 0.03
DELTA = 0.05
GOOD_COST = 10
#: Words of a window, words a document needs, and the percentage of repeated words it may have.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: Cutoffs are broadcast up to this many strata (some 60 bytes each).
BROADCAST_STRATA = 100_000
RULES = ("symbols", "dup_lines", "repeats", "capitals", "shouts", "stutter")
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_measures(docs: DataFrame, text_col: str, prefix: str = "") -> DataFrame:
    """``docs`` with the base counts and the measure of each rule, as new columns named with ``prefix``."""
    p = lambda name: prefix + name
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.withColumn(p("words"), word_array(text))
    rows = rows.withColumn(p("marks"), F.transform(p("words"), lambda w: F.xxhash64(w)))
    m = F.col(p("marks"))
    ahead = lambda i, k: F.get(m, i + k)
    # a window is known by the hash of its words' hashes; windows that would pass the end are cut off
    window = F.transform(m, lambda x, i: F.xxhash64(x, *[ahead(i, k) for k in range(1, WINDOW)]))
    rows = rows.withColumn(p("windows"), F.slice(window, 1, F.greatest(F.size(m) - (WINDOW - 1), F.lit(0))))
    w = F.col(p("windows"))
    rows = rows.withColumn(p("n_repeat_words"), F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_repeated(w)).cast("long"))
    rows = rows.withColumn(p("lines"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    lines = F.col(p("lines"))
    stats = {
        "n_words": F.size(p("words")).cast("long"),
        "word_chars": F.length(F.array_join(p("words"), "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_capitals": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
        "n_shouts": F.regexp_count(text, F.lit("!")).cast("long"),
        "n_stutters": F.size(F.filter(m, lambda x, i: x == ahead(i, 1))).cast("long"),
    }
    rows = rows.withColumns({p(k): v for k, v in stats.items()}).drop(*map(p, ("words", "marks", "windows", "lines")))
    share = lambda a, b: F.when(F.col(p(b)) > 0, F.least(F.lit(1000), F.floor(1000 * F.col(p(a)) / F.col(p(b))))).otherwise(F.lit(0)).cast("int")
    pairs = zip(RULES, ("n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_shouts", "n_stutters"), ("word_chars", "n_lines", "n_words", "word_chars", "n_words", "n_words"), strict=True)
    failed = (F.col(p("n_words")) < LEAST_WORDS) | (100 * F.col(p("n_repeat_words")) > MOST_REPEATED * F.col(p("n_words")))
    return rows.withColumns({p(rule): share(a, b) for rule, a, b in pairs} | {p("base_failed"): failed})


def _repeated(windows: Column) -> Column:
    """Words that lie in a window found twice or more: windows sorted, equal neighbours' places, their union's length."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = F.filter(
        F.transform(F.array(placed), lambda s: F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])))[0],
        lambda i: i.isNotNull(),
    )
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(
        F.sort_array(twice),
        start,
        lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).alias("n")),
        lambda acc: acc["n"],
    )


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """Probability of at most k successes in n trials: terms summed from their logarithms."""
    from math import log, log1p

    first = n * F.lit(log1p(-p))
    start = F.struct(first.cast("double").alias("t"), F.exp(first).alias("s"))
    step = lambda acc, i: F.struct((acc["t"] + F.log((n - i + 1) / i) + F.lit(log(p) - log1p(-p))).alias("t"), (acc["s"] + F.exp(acc["t"] + F.log((n - i + 1) / i) + F.lit(log(p) - log1p(-p)))).alias("s"))
    return F.when(k == 0, F.exp(first)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), start, step, lambda acc: acc["s"]))


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum and a column _q_cut_<rule> each (null: the rule rejects nothing): a row for each stratum with a certified cutoff.

    measured: doc_id, mark (a hash of the text), stratum, base_failed and the rules. labels: doc_id, quality (1 good, 0 bad).
    """
    quality = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    held = measured.where("not base_failed").join(quality, "doc_id")
    held = held.groupBy("stratum", "mark").agg(F.max("quality").alias("quality"), *[F.max(r).alias(r) for r in RULES])
    values = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("value")) for r in RULES]))
    seen = held.select("stratum", "quality", values.alias("v")).groupBy("stratum", F.col("v.rule").alias("rule"), F.col("v.value").alias("value"))
    seen = seen.agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("quality") == 1, 0).otherwise(1)).alias("bad"))
    from_top = Window.partitionBy("stratum", "rule").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    strata = seen.agg(F.count_distinct(F.coalesce(F.concat(F.lit("="), "stratum"), F.lit("-")))).scalar()
    rate = alpha / len(RULES)
    tried = seen.withColumn("k", F.sum("good").over(from_top)).withColumn("b", F.sum("bad").over(from_top)).withColumn("n", F.sum("good").over(Window.partitionBy("stratum", "rule")))
    tried = tried.withColumn("tests", strata * len(RULES))
    # above the rate itself no test can pass, so long sums are never begun
    tried = tried.withColumn("p", F.when(F.col("k") > rate * F.col("n"), F.lit(1.0)).otherwise(binomial_tail(F.col("k"), F.col("n"), rate)))
    passed = tried.withColumn("worst", F.max("p").over(from_top)).where(F.col("worst") <= delta / F.col("tests"))
    gain = F.col("b") - GOOD_COST * F.col("k")
    best = passed.where(gain > 0).groupBy("stratum", "rule").agg(F.max(F.struct(gain.alias("gain"), "value")).alias("best"))
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("best.value"))).alias(f"_q_cut_{r}") for r in RULES])


def apply_cutoffs(rows: DataFrame, cuts: DataFrame, stratum: str, prefix: str = "") -> DataFrame:
    """``rows`` with the column kept; cuts: a stored table, a row for each stratum."""
    known = cuts.withColumnRenamed("stratum", "_q_stratum")
    known = F.broadcast(known) if cuts.count() <= BROADCAST_STRATA else known
    joined = rows.join(known, F.col(stratum).eqNullSafe(F.col("_q_stratum")), "left")
    hit = F.lit(False)
    for r in RULES:
        hit = hit | F.coalesce(F.col(prefix + r) >= F.col(f"_q_cut_{r}"), F.lit(False))
    return joined.withColumn(prefix + "kept", ~F.col(prefix + "base_failed") & ~hit).drop("_q_stratum", *[f"_q_cut_{r}" for r in RULES])


def measured(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), F.col(text_col).alias("text"))
    return stored(spark, with_measures(rows, "text").select("doc_id", F.xxhash64("text").alias("mark"), "stratum", *_STATS, *RULES, "base_failed"), "measures", rows=docs.count(), per_file=2048)


def verdicts(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the measures."""
    rows = measured(spark, docs, id_col, text_col, stratum_col)
    return apply_cutoffs(rows, stored(spark, cutoffs(rows, labels), "cutoffs", rows=1_000_000), "stratum").select("doc_id", *_STATS, "base_failed", "kept", "stratum", *RULES)


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that pass; measured again on the way, so that no text is stored or shuffled."""
    cuts = stored(spark, cutoffs(measured(spark, docs, id_col, text_col, stratum_col), labels), "cutoffs", rows=1_000_000)
    # a filter that moved below the measures would compute them anew inside each other's lambdas: a column
    # that is not deterministic keeps it above
    fenced = with_measures(docs, text_col, "_q_").withColumn("_q_fence", F.monotonically_increasing_id())
    rows = apply_cutoffs(fenced, cuts, stratum_col, "_q_")
    return rows.where("_q_kept and _q_fence >= 0").select(*docs.columns)
