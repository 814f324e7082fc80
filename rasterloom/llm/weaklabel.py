"""Quality from weak labels: overlapping heuristics, a label model, a linear scorer.

Each heuristic votes good, bad or nothing on a whole text. Texts are counted by
their pattern of votes, over all documents; expectation maximisation on that
bounded table (three to the power of the heuristics) estimates how often each
heuristic is right on good and on bad texts, and from that the posterior of every
pattern. A hashed linear scorer then learns the posteriors on a bounded sample,
:data:`SAMPLE`, and scores every text, so that what the heuristics miss but their
targets share is found as well. Two passes over the texts; only vote counts are
shuffled.

Defined results: a null text or one without words gets the votes of an empty text; a
very long text is read whole, in pieces of bounded size (what spans a cut between two
pieces counts in both);
rows that repeat score alike; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import bytescan, linear
from rasterloom.llm.held import held
from rasterloom.llm.toxicity import bounded, training_rows
from rasterloom.session import local_table, ship

#: Documents that train the scorer, at most.
SAMPLE = 12_000
GOOD, BAD, NONE = 1, 2, 0
SYMBOLS = "#*$%&|<>"
#: Rounds of expectation maximisation; it stops before when nothing moves.
ROUNDS = 200
#: A text is kept from this probability of being good on.
CUTOFF = 0.5


class Tally:
    """What the heuristics look at, gathered from the pieces of a batch of texts."""

    def __init__(self, n: int):
        zero = lambda: np.zeros(n, np.int64)
        self.chars, self.chunks, self.symbols, self.odd, self.marks = zero(), zero(), zero(), zero(), zero()
        self.capitals, self.shouts, self.stutters, self.stops, self.lines = zero(), zero(), zero(), zero(), zero()
        self.distinct, self.distinct_lines = bytescan.Distinct(n), bytescan.Distinct(n)

    def watch(self, p: bytescan.Piece, marks: np.ndarray) -> None:
        """marks: the hashes of the piece's chunks."""
        at, a, b = p.rows, p.starts, p.ends
        self.chars[at] += p.per_segment(np.flatnonzero((p.flat & 0xC0) != 0x80))
        self.chunks[at] += p.per_segment(a)
        self.symbols[at] += p.count(*SYMBOLS.encode())
        self.odd[at] += p.count(*(SYMBOLS + "!0123456789").encode())
        self.shouts[at] += p.count(ord("!"))
        self.stops[at] += p.count(ord("."), ord("?"))
        self.capitals[at] += p.per_segment(a[linear.capitals(p)])
        if len(a):
            ends_odd = (p.kind[b - 1] == bytescan.MARK) & ((b - a == 1) | (p.kind[b - 2] == bytescan.MARK))
            self.marks[at] += p.per_segment(a[ends_odd])
            again = np.flatnonzero(marks[1:] == marks[:-1])
            again = again[p.segment(a[again]) == p.segment(a[again + 1])]
            self.stutters[at] += p.per_segment(a[again])
        self.distinct.add(p, a, marks)
        begin, end = p.runs(p.flat != 10)
        first = np.searchsorted(a, begin)  # a line counts if a chunk begins in it: chunks never span lines
        full = (first < len(a)) & (np.append(a, len(p.flat))[first] < end)
        self.lines[at] += p.per_segment(begin[full])
        self.distinct_lines.add(p, begin[full], p.hashes(begin[full], end[full]))

    def votes(self) -> np.ndarray:
        """Each heuristic's vote on each text, in the order of :data:`NAMES`.

        Six look for one defect each and are silent without it; three judge the text
        as a whole and may call it good.
        """
        n = np.maximum(self.chunks, 1)
        repeats = self.lines - self.distinct_lines.counts
        odd = self.odd / np.maximum(self.chars, 1)
        capitals, stutter, stops = self.capitals / n, self.stutters / n, self.stops / n
        different = self.distinct.counts / n**0.9
        bad = np.stack([
            self.symbols > 0.3 * n, self.marks > 0.3 * n, capitals > 0.4, self.shouts > 0.3 * n, stutter > 0.3, (self.lines >= 4) & (repeats > 0.6 * self.lines),
            odd > 0.3, (self.chunks >= 40) & (stutter > 0.15), self.chunks < 2,
        ], axis=1)
        good = np.zeros_like(bad)
        good[:, DETECTORS:] = np.stack([odd < 0.03, (stutter < 0.08) & (different > 0.4), (capitals < 0.2) & (stops > 0.01) & (stops < 0.5) & (self.chunks >= 5)], axis=1)
        out = np.where(bad, BAD, np.where(good, GOOD, NONE))
        out[self.chunks == 0] = [NONE] * (len(NAMES) - 1) + [BAD]
        return out


def votes(column) -> np.ndarray:
    """A row of votes for each text of an Arrow column."""
    tally = Tally(len(column))
    for p in bytescan.pieces(column):
        tally.watch(p, p.hashes(p.starts, p.ends))
    return tally.votes()


NAMES = ("symbols", "marks", "capitals", "shouts", "stutter", "repeated_lines", "plain_characters", "variety", "sentences")
#: The first of these look for a defect each.
DETECTORS = 6


def codes_of(v: np.ndarray) -> np.ndarray:
    return v @ 3 ** np.arange(len(NAMES))


def votes_of(code: int) -> list[int]:
    return [code // 3**k % 3 for k in range(len(NAMES))]


class LabelModel:
    """Share of good texts; for each class and heuristic, how often it finds its defect, or how often its vote says good.

    A detector's silence is an outcome, a judge's silence says nothing.
    """

    def __init__(self, prior: float, finds: np.ndarray, says_good: np.ndarray):
        self.prior, self.finds, self.says_good = prior, finds, says_good

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes."""
        found, judged = patterns[:, :DETECTORS] == BAD, patterns[:, DETECTORS:]
        odds = np.full(len(patterns), np.log(self.prior / (1 - self.prior)))
        odds += np.where(found, np.log(self.finds[1] / self.finds[0]), np.log((1 - self.finds[1]) / (1 - self.finds[0]))).sum(axis=1)
        bad, good = self.says_good
        odds += np.where(judged == GOOD, np.log(good / bad), np.where(judged == BAD, np.log((1 - good) / (1 - bad)), 0.0)).sum(axis=1)
        return linear.sigmoid(odds)

    def accuracies(self) -> dict[str, float]:
        """For each heuristic: how often it is right when it votes."""
        share = np.array([1 - self.prior, self.prior])
        detectors = share[0] * self.finds[0] / (share @ self.finds)
        judges = share[0] * (1 - self.says_good[0]) + share[1] * self.says_good[1]
        return dict(zip(NAMES, [*detectors.tolist(), *judges.tolist()], strict=True))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray) -> LabelModel:
    """From vote patterns and how many texts show them; it starts from a text being bad as soon as one heuristic says so."""
    q = np.where((patterns == BAD).any(axis=1), 0.1, 0.95)
    found, judged = patterns[:, :DETECTORS] == BAD, patterns[:, DETECTORS:]
    for _ in range(ROUNDS):
        weight = np.stack([counts * (1 - q), counts * q])
        total = weight.sum(axis=1, keepdims=True)
        finds = (weight @ found + 0.1) / (total + 10.0)
        g, b = weight @ (judged == GOOD), weight @ (judged == BAD)
        prior = float(np.clip((total[1, 0] + 1) / (counts.sum() + 2), 1e-3, 1 - 1e-3))
        model = LabelModel(prior, np.clip(finds, 1e-4, 1 - 1e-4), np.clip((g + 1) / (g + b + 2), 1e-3, 1 - 1e-3))
        new = model.posterior(patterns)
        done = np.abs(new - q).max(initial=0) < 1e-6
        q = new
        if done:
            break
    return model


def fit(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[LabelModel, linear.Model]:
    """The label model from all documents and the scorer from a sample of them."""
    import pyarrow as pa

    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(codes_of(votes(batch.column("text"))), pa.int32())], ["doc_id", "code"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    coded = rows.mapInArrow(run, f"doc_id {kind}, code int")
    table = sorted(coded.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect())  # at most 3 ** 9 rows
    patterns = np.array([votes_of(r.code) for r in table], int).reshape(-1, len(NAMES))
    model = expectation_maximisation(patterns, np.array([r.n for r in table], float))
    good = model.posterior(patterns) if len(table) else np.zeros(0)
    posteriors = local_table(spark, [(r.code, float(p)) for r, p in zip(table, good, strict=True)], "code int, good double")
    # only the sample's texts are voted on again
    ids = F.broadcast(bounded(rows.where("doc_id is not null").select("doc_id").distinct(), sample).withColumnRenamed("doc_id", "_s_id"))
    again = rows.join(ids, F.col("doc_id") == F.col("_s_id"), "left_semi").mapInArrow(run, f"doc_id {kind}, code int")
    picked = again.groupBy("doc_id").agg(F.min("code").alias("code")).join(F.broadcast(posteriors), "code")
    features, values, _ = training_rows(spark, docs, picked, ["good"], id_col, text_col)
    return model, linear.fit(features, values[:, 0])


def _scorer(key: bytes):
    import pickle

    def make():
        label_model, model = pickle.loads(key)
        codes = np.array([votes_of(c) for c in range(3 ** len(NAMES))])
        return linear.Scorer([model]), label_model.posterior(codes)

    return held("weak labels", key, make)


def score(spark: SparkSession, docs: DataFrame, label_model: LabelModel, model: linear.Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, votes (one letter for each heuristic), posterior, score, kept."""
    import pickle

    import pyarrow as pa

    ship(spark)
    key = pickle.dumps((label_model, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, posteriors = _scorer(key)
        for batch in batches:
            tally = Tally(batch.num_rows)
            s = linear.sigmoid(scorer.logits(batch.column("text"), tally.watch)[:, 0])
            v = tally.votes()
            letters = np.frombuffer(b"-gb", np.uint8)[v].tobytes().decode()
            shown = [letters[k : k + len(NAMES)] for k in range(0, len(letters), len(NAMES))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(shown, pa.string()), pa.array(posteriors[codes_of(v)]), pa.array(s), pa.array(s >= CUTOFF)],
                ["doc_id", "votes", "posterior", "score", "kept"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, votes string, posterior double, score double, kept boolean")
