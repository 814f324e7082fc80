"""Mixing sources to target weights by weighted fair queueing.

Every source is a flow and its documents, in a seeded shuffled order, are the
packets. Serving a document costs its number of words; a pass over all the
documents of a source is an epoch, and a source may be served for at most
``max_epochs`` of them. The virtual finish time of a packet is the number of
words its source has been served by then, divided by the source's target. All
packets are range-sorted by it, and the sorted list is cut where the total budget
is spent. The targets sum to the budget, so that is virtual time 1; a document
that its source's target parts is two packets, so every source ends within one
word of its target.

Scale: the running sums need no window over a whole source. Documents are dealt
into slices of a source by the leading bits of their shuffle hash, a small table
of slice totals gives each slice its start, and a window runs inside a slice
only. The ranges of the sort are equal spans of virtual time, which hold equal
numbers of words since the sources are served side by side; their totals give each
range its start in the same way. Identical rows are first counted, so a document repeated a million times
is one row until the end.

Defined results: a null text is an empty document of size 0 and takes 0; a null
source is a source of its own, last in order; rows that repeat (id, source,
size) share what their group takes, the earlier of them filling up first; an
empty table gives an empty mix; other columns are ignored by :func:`mix_plan` and
carried unchanged by :func:`mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.llm.prefix import starts
from rasterloom.llm.words import word_array, word_count
from rasterloom.session import local_table, stored

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: The mix asks for this share of all words, in hundredths.
BUDGET_PERCENT = 150
#: No source is served for more passes than this over its documents.
MAX_EPOCHS = 2
#: Documents in a slice of a source, about.
SLICE_ROWS = 8192
#: Targets of up to this many sources are found on the driver and broadcast (some 50 bytes each); of more, by a table of sources.
DRIVER_SOURCES = 100_000
SEED = "mix-1"


def water_fill(sizes: list[int], weights: list[int], total: float, cap: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``cap`` times its size.

    What a capped share gives up is shared by weight among the others until none
    is above. In order of cap per weight the capped ones are a prefix, so one
    pass over that order finds the water level.
    """
    order = sorted(range(len(sizes)), key=lambda i: cap * sizes[i] / weights[i])
    target = [0.0] * len(sizes)
    left, weight = float(total), float(sum(weights))
    for place, i in enumerate(order):
        if cap * sizes[i] * weight <= left * weights[i]:
            target[i] = float(cap * sizes[i])
            left -= target[i]
            weight -= weights[i]
        else:
            for k in order[place:]:
                target[k] = left * weights[k] / weight
            break
    return target


def source_targets(spark: SparkSession, sized: DataFrame, weights=WEIGHTS, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, source_rows, target: one row for each source of ``sized`` (source, size, copies); broadcast where it is small."""
    grouped = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("source_rows"))
    totals = grouped.limit(DRIVER_SOURCES + 1).collect()
    if len(totals) > DRIVER_SOURCES:
        return stored(spark, _targets_by_table(stored(spark, grouped, "mix-sources"), weights, budget_percent, max_epochs), "mix-targets")
    totals.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    sizes = [r.source_size for r in totals]
    w = [weights[i % len(weights)] for i in range(len(totals))]
    target = water_fill(sizes, w, sum(sizes) * budget_percent / 100, max_epochs)
    rows = [(r.source, r.source_size, r.source_rows, t) for r, t in zip(totals, target, strict=True)]
    return F.broadcast(local_table(spark, rows, "source string, source_size long, source_rows long, target double"))


def _targets_by_table(totals: DataFrame, weights, budget_percent: int, max_epochs: int) -> DataFrame:
    """:func:`water_fill` over a table: two sorts of a row for each source."""
    total = (totals.agg(F.sum("source_size")).first()[0] or 0) * budget_percent / 100
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(nth, F.lit(len(weights))) + 1).cast("int"))
    rows = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("place", F.row_number().over(by_level)).withColumn("rest", F.lit(total) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("open", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    level = rows.where(F.col("cap") * F.col("open") > F.col("rest") * F.col("weight")).agg(F.min(F.struct("place", "rest", "open")).alias("free")).first().free
    share = F.when(F.col("place") < level.place, F.col("cap")).otherwise(F.lit(level.rest) * F.col("weight") / F.lit(level.open)) if level else F.col("cap")
    return rows.select("source", "source_size", "source_rows", share.alias("target"))


def mix_plan(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slice_rows: int = SLICE_ROWS, seed: str = SEED) -> DataFrame:
    """What the mix takes of each distinct (doc_id, source, size).

    doc_id, source, size, copies (rows that repeat it), source_size, target,
    taken (words that all its copies give, passes added), finish (virtual time of
    its first pass).
    """
    sized = stored(
        spark,
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
        .groupBy("doc_id", "source", "size")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("place", F.md5(F.concat_ws("/", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")))),
        "mix-sizes", rows=docs.count(), per_file=32 * 1024,
    )
    targets = source_targets(spark, sized)
    hashed = F.conv(F.substring("place", 1, 8), 16, 10).cast("long")
    rows = sized.join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source")))
    rows = rows.withColumn("slice", F.floor(hashed * F.ceil(F.col("source_rows") / slice_rows) / F.lit(1 << 32)).cast("long"))
    amount = F.col("size") * F.col("copies")
    per_slice = rows.groupBy("source", "slice").agg(F.sum(amount).alias("slice_size"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    firsts = per_slice.select(
        F.col("source").alias("s_source"), F.col("slice").alias("s_slice"), F.coalesce(F.sum("slice_size").over(before), F.lit(0)).alias("slice_start")
    )
    rows = rows.join(firsts, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("slice") == F.col("s_slice")))
    inside = Window.partitionBy("source", "slice").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("amount", amount).withColumn("first", F.col("slice_start") + F.sum(amount).over(inside) - amount)
    kept = ["doc_id", "source", "size", "copies", "source_size", "target"]
    n_rows = sized.count()
    rows = stored(spark, rows.select(*kept, "place", "amount", "first"), "mix-order", rows=n_rows, per_file=32 * 1024)
    budget = targets.agg(F.coalesce(F.sum(F.floor("target")), F.lit(0))).first()[0]
    served = truncated(packets(rows), budget, max(1, n_rows // slice_rows))
    given = served.groupBy(*kept, "place").agg(F.sum("taken").alias("taken"), F.min("finish").alias("finish")).drop("place")
    return given.unionByName(rows.where("amount = 0").select(*kept, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("double").alias("finish")))


def packets(rows: DataFrame) -> DataFrame:
    """The passes over each row's words, each with its virtual finish time; a pass that its source's target parts is two packets."""
    budget = F.floor("target").cast("long")
    rows = rows.where("amount > 0 and target > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(MAX_EPOCHS - 1))))
    begin = F.col("first") + F.col("source_size") * F.col("pass")
    head = F.greatest(F.lit(0).cast("long"), F.least(F.col("amount"), budget - begin))
    packet = lambda words, end: F.struct(words.alias("words"), (end / F.col("target")).alias("finish"))
    both = F.array(packet(head, begin + head), packet(F.col("amount") - head, begin + F.col("amount")))
    return rows.withColumn("p", F.explode(F.filter(both, lambda x: x["words"] > 0))).select("*", "p.words", "p.finish").drop("p", "amount", "first")


def truncated(rows: DataFrame, budget: int, ranges: int) -> DataFrame:
    """The packets in order of their finish time, with what the budget leaves of each as ``taken``.

    The order is cut into ``ranges`` equal spans of virtual time up to the budget's end, which hold equal numbers of words.
    """
    rows = rows.withColumn("range", F.floor(F.col("finish") * ranges).cast("long"))
    first = starts(rows.groupBy("range").agg(F.sum("words").alias("n")), "range", "n").select(F.col("range").alias("r_range"), F.col("start").alias("r_start"))
    inside = Window.partitionBy("range").orderBy("finish", "source", "place", "doc_id", "pass").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("before", F.sum("words").over(inside) - F.col("words")).join(first, F.col("range") == F.col("r_range"))
    left = F.lit(budget) - F.col("r_start") - F.col("before")
    return rows.withColumn("taken", F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), left)))


def per_copy(taken: Column, size: Column, nth: Column) -> Column:
    """Words that the ``nth`` (from 1) of a group's identical rows gives: each fills up before the next."""
    most = size * MAX_EPOCHS
    return F.greatest(F.lit(0), F.least(most, taken - most * (nth - 1))).cast("long")


def mix_rows(plan: DataFrame) -> DataFrame:
    """One row for each input row: doc_id, source, size, source_size, target, taken, finish."""
    return plan.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "doc_id", "source", "size", "source_size", "target", per_copy(F.col("taken"), F.col("size"), F.col("nth")).alias("taken"), "finish"
    )


def mix(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", ordered: bool = False) -> DataFrame:
    """The mix itself: a row of ``docs`` for each pass; ordered: sorted by virtual finish time, which moves the texts once more.

    A pass that the budget cuts short keeps the leading words of the text, joined
    by single spaces; whole passes keep the text as it is. Documents without
    words take nothing and are not in the mix.
    """
    plan = mix_plan(spark, docs, id_col=id_col, text_col=text_col, source_col=source_col).where("taken > 0")
    p = plan.select(F.col("doc_id").alias("_m_id"), F.col("source").alias("_m_source"), F.col("size").alias("_m_size"), F.col("copies").alias("_m_copies"), F.col("taken").alias("_m_taken"), F.col("finish").alias("_m_finish"), (F.col("source_size") / F.col("target")).alias("_m_round"))
    sized = docs.withColumn("_d_size", word_count(F.col(text_col)))
    same = F.col(id_col).eqNullSafe(F.col("_m_id")) & F.col(source_col).eqNullSafe(F.col("_m_source")) & (F.col("_d_size") == F.col("_m_size"))
    both = sized.join(p, same)
    repeated = Window.partitionBy("_m_id", "_m_source", "_m_size").orderBy(F.xxhash64(F.col(text_col).cast("binary")))
    single = both.where("_m_copies = 1").withColumn("_m_nth", F.lit(1))
    several = both.where("_m_copies > 1").withColumn("_m_nth", F.row_number().over(repeated))
    rows = single.unionByName(several).withColumn("_m_mine", per_copy(F.col("_m_taken"), F.col("_m_size"), F.col("_m_nth")))
    rows = rows.withColumn("_m_pass", F.explode(F.sequence(F.lit(0), F.lit(MAX_EPOCHS - 1))))
    rows = rows.withColumn("_m_words", F.least(F.col("_m_size"), F.col("_m_mine") - F.col("_m_size") * F.col("_m_pass"))).where("_m_words > 0")
    cut = F.array_join(F.slice(word_array(F.col(text_col)), 1, F.col("_m_words").cast("int")), " ")
    rows = rows.withColumn(text_col, F.when(F.col("_m_words") < F.col("_m_size"), cut).otherwise(F.col(text_col)))
    if ordered:
        rows = rows.orderBy(F.col("_m_finish") + F.col("_m_pass") * F.col("_m_round"), id_col)
    return rows.select(*docs.columns)
