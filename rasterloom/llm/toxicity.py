"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models over hashed features;
a later model also takes the logits of the earlier categories. It must learn from
such predictions as it will meet, so in training these are out-of-fold: each
labelled document's logit comes from a model that has seen neither it nor a copy of
it (folds go by the text). A category's cutoff lies a little above the least one at
which out-of-fold false alarms stay within :data:`FALSE_ALARMS`, and not below
:data:`LEAST_CUTOFF`.

Training uses a bounded sample of labelled rows, :data:`SAMPLE`, taken by a hash of
the id; scoring is one pass over all whole texts and shuffles nothing.

Defined results: a null text or one without words scores by its lack of features; a
very long text is scored whole, in pieces of bounded size, white space or not;
null labels leave their row out of training; without both classes in the labels a
category's probability is its rate and nothing is rejected; rows that repeat score
alike; an empty table gives no rows; other columns are ignored by :func:`score` and
carried by :func:`reject`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import linear
from rasterloom.llm.held import held
from rasterloom.session import ship

#: Labelled rows that training takes, at most.
SAMPLE = 12_000
FOLDS = 4
FALSE_ALARMS = 0.001
LEAST_CUTOFF = 0.2
#: Chain over the labels table: name, label column, value that is the category.
CHAIN = (("poor", "quality", 0), ("toxic", "toxic", 1))


class Chain:
    def __init__(self, names: list[str], models: list[linear.Model], cutoffs: list[float]):
        self.names, self.models, self.cutoffs = names, models, cutoffs

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        """A column for each category, each predicted with the logits of those before."""
        done = np.zeros((len(logits), 0))
        for k, model in enumerate(self.models):
            done = np.column_stack([done, logits[:, k] + np.clip(done, -8, 8) @ model.dense])
        return linear.sigmoid(done)


def fit_chain(rows: list[np.ndarray], labels: np.ndarray, fold: np.ndarray, names: list[str]) -> Chain:
    """labels: 0 or 1, a column for each category in order."""
    models, cutoffs, before = [], [], np.zeros((len(rows), 0))
    for k in range(len(names)):
        y = labels[:, k].astype(float)
        held = np.zeros(len(rows))
        for f in range(FOLDS):
            train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            m = linear.fit([rows[i] for i in train], y[train], before[train])
            held[test] = m.logits([rows[i] for i in test]) + before[test] @ m.dense
        models.append(linear.fit(rows, y, before))
        clean = np.sort(linear.sigmoid(held[y == 0]))
        alarm = float(clean[min(len(clean) - 1, int((1 - FALSE_ALARMS) * len(clean)))]) if len(clean) else 1.0
        cutoffs.append(max(LEAST_CUTOFF, alarm + 0.1 * min(alarm, 1 - alarm)) if len(clean) and y.any() else 2.0)
        before = np.column_stack([before, np.clip(held, -8, 8)])
    return Chain(names, models, cutoffs)


def training_rows(spark: SparkSession, docs: DataFrame, picked: DataFrame, columns: list[str], id_col: str, text_col: str):
    """(features, columns, fold) of the picked ids, which are bounded: their features come to the driver.

    An id that several rows hold counts once, with the least of their feature lists.
    """
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                row, feature = linear.features(batch.column("text"))
                ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
                flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(feature, pa.int32()))
                yield pa.RecordBatch.from_arrays([flat, *[batch.column(c) for c in ("id", *columns, "fold")]], ["features", "id", *columns, "fold"])

    picked = F.broadcast(picked.select(F.col("doc_id").alias("_p_id"), *[F.col(c).cast("double").alias(f"_p_{c}") for c in columns]))  # a bounded sample
    joined = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(picked, F.col("doc_id") == F.col("_p_id"))
    rows = joined.select("text", F.col("_p_id").cast("string").alias("id"), *[F.col(f"_p_{c}").alias(c) for c in columns], F.pmod(F.crc32(F.coalesce("text", F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int").alias("fold"))
    made = rows.mapInArrow(run, "features array<int>, id string, " + ", ".join(f"{c} double" for c in columns) + ", fold int")
    one = made.groupBy("id").agg(F.min(F.struct("features", *columns, "fold")).alias("r")).select("r.*")
    # the scan's order is no property of the data: the rows are put in one of their own
    table = one.toArrow()
    features = [np.asarray(x.values) for x in table.column("features")]
    values = np.column_stack([table.column(c).to_numpy() for c in columns])
    order = sorted(range(len(features)), key=lambda i: (len(features[i]), features[i].tobytes(), values[i].tobytes()))
    fold = table.column("fold").to_numpy()
    return [features[i] for i in order], values[order], fold[order]


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` of the rows, one for each doc_id, and never more, by a hash of the id: the same rows each time, whatever the partitions."""
    n = rows.count()
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30))
    return rows.where(place < int((1 << 30) * min(1.0, 0.95 * most / max(1, n)))).orderBy(place, "doc_id").limit(most) if n > most else rows


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chain=CHAIN, sample: int = SAMPLE) -> Chain:
    names = [c[0] for c in chain]
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(chain[0][1]).isNotNull())
    for _, column, _ in chain[1:]:
        marked = marked.where(F.col(column).isNotNull())
    marked = marked.groupBy("doc_id").agg(*[F.max((F.col(column) == value).cast("int")).alias(name) for name, column, value in chain])
    rows, values, fold = training_rows(spark, docs, bounded(marked, sample), names, id_col, text_col)
    return fit_chain(rows, values, fold, names)


def score(spark: SparkSession, docs: DataFrame, model: Chain, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, p_<category> for each category, rejected, from one pass over the texts."""
    ship(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_scoring(model, ["doc_id"]), f"doc_id {kind}, " + ", ".join(f"p_{n} double" for n in model.names) + ", rejected boolean")


def _scorer(key: bytes):
    import pickle

    def make():
        chain = pickle.loads(key)
        return chain, linear.Scorer(chain.models)

    return held("toxicity", key, make)


def _scoring(model: Chain, carry: list[str]):
    import pickle

    key = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, scorer = _scorer(key)
        for batch in batches:
            p = chain.probabilities(scorer.logits(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in carry], *[pa.array(p[:, k]) for k in range(p.shape[1])], pa.array(p[:, -1] >= chain.cutoffs[-1])],
                [*carry, *[f"p_{n}" for n in chain.names], "rejected"],
            )

    return run


def reject(spark: SparkSession, docs: DataFrame, model: Chain, *, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the last category rejects; the verdict is a column for a moment and moves no text."""
    import pickle

    ship(spark)
    key = pickle.dumps(model)

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        chain, scorer = _scorer(key)
        return pa.array(chain.probabilities(scorer.logits(texts))[:, -1] < chain.cutoffs[-1])

    return docs.where(clean(F.col(text_col).cast("string")))
