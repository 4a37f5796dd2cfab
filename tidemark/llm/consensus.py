"""Consensus of several annotators by iteratively reweighted voting.

Two steps alternate until the weights are stable: every item's weighted consensus, and every annotator's accuracy,
measured on the consensus of the others (the annotator's own vote left out) and smoothed towards the pooled accuracy.
The votes of an item are packed into one row once; a round then reads the rows where they lie, and all that moves is
one partial sum per annotator and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import maybe_broadcast, written

#: The statuses an annotator may give.
STATUSES = ("candidate", "defer", "quarantine")
K = len(STATUSES)
#: Pseudo-votes that draw an annotator's accuracy to the pooled one, and the least share taken for possible.
SMOOTH, LOW = 4.0, 0.005
#: Rounds after which a consensus that still moves is given as it is, and said to be unsettled.
ROUNDS, STABLE = 100, 1e-4
#: Up to this many annotators their codes are broadcast; more are joined.
BROADCAST = 1_000_000


def status_of(c: F.Column) -> F.Column:
    """A status in its usual spelling, or null where it is none of the known ones."""
    plain = F.lower(F.regexp_replace(c, r"^[\s\p{Z}\p{P}]+|[\s\p{Z}\p{P}]+$", ""))
    return F.when(plain.isin(*STATUSES), plain)


def current_votes(votes: DataFrame) -> DataFrame:
    """One row (item, annotator, status, volatility, review) per item and annotator.

    A vote delivered twice counts once (the first delivery); of several votes of an annotator on an item the
    one with the later ``voted_at`` holds, ties by the larger ``vote_id``. Votes without item or annotator
    are left out. Volatility outside 0..1 counts as not given. A failed vote (nothing given) never replaces one.
    """
    v = votes.select(
        F.col("aggregate_key").alias("item"),
        F.col("auditor_id").alias("annotator"),
        "vote_id",
        "voted_at",
        "received_at",
        status_of(F.col("status_suggestion")).alias("status"),
        F.when(F.col("volatility_estimate").between(0.0, 1.0), F.col("volatility_estimate")).alias("volatility"),
        F.col("needs_human_review").alias("review"),
    ).filter(F.col("item").isNotNull() & F.col("annotator").isNotNull())
    given = v.filter(F.col("status").isNotNull() | F.col("volatility").isNotNull() | F.col("review").isNotNull())
    # max_by keeps one row per item and annotator before the shuffle; an equal delivery has an equal order but for its arrival.
    order = F.struct(F.coalesce(F.unix_micros("voted_at"), F.lit(-(2**62))), F.coalesce("vote_id", F.lit(-1)), -F.coalesce(F.unix_micros("received_at"), F.lit(0)))
    best = F.max_by(F.struct("status", "volatility", "review"), order).alias("v")
    return given.groupBy("item", "annotator").agg(best).select("item", "annotator", "v.*")


class Votes:
    """The packed votes of a batch of items as flat arrays: the row of each vote, annotator code, status (-1 none), estimate, review mark."""

    def __init__(self, b: pa.RecordBatch):
        sizes = np.diff(b.column(1).offsets.to_numpy())
        flat = [b.column(i).flatten() for i in range(1, 5)]
        self.items = b.num_rows
        self.row = np.repeat(np.arange(b.num_rows), sizes)
        self.who, self.vote, self.review = (flat[i].to_numpy(zero_copy_only=False) for i in (0, 1, 3))
        self.volatility = flat[2].to_numpy(zero_copy_only=False)

    def tally(self, weight: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights that each vote gives each status, and their sums per item with the log shares of the statuses."""
        rated = self.vote >= 0
        given = np.where(rated[:, None], weight[self.who, np.where(rated, self.vote, 0)], 0.0)
        sums = np.stack([np.bincount(self.row, weights=given[:, s], minlength=self.items) for s in range(K)], 1)
        return given, sums + np.log(prior)


class Consensus:
    """The results of reweighted voting: ``items``, ``annotators``, ``rounds``, ``settled`` and ``alpha``.

    An annotator's accuracy is kept per status given: the share in which such votes meet each status of the others'
    consensus. A vote weighs for each status by the log of that share against the status's share overall, so someone
    who always gives the same status weighs nothing, however often it fits.
    """

    def __init__(self, votes: DataFrame, rounds: int = ROUNDS):
        given = written(current_votes(votes), "votes")
        names = given.select("annotator").distinct().orderBy("annotator").toArrow().column(0).to_pylist()
        self.names = names
        codes = votes.sparkSession.createDataFrame(list(zip(names, range(len(names)))), "annotator string, code int")
        coded = given.join(maybe_broadcast(codes, len(names), BROADCAST), "annotator")
        status = F.coalesce(*[F.when(F.col("status") == s, F.lit(i)) for i, s in enumerate(STATUSES)], F.lit(-1)).cast("tinyint")
        review = F.coalesce(F.col("review").cast("tinyint"), F.lit(-1)).cast("tinyint")
        # An item holds one vote per annotator at most, so its row is bounded by the number of annotators.
        packed = coded.groupBy("item").agg(F.sort_array(F.collect_list(F.struct(F.col("code"), status.alias("s"), F.coalesce("volatility", F.lit(float("nan"))).alias("v"), review.alias("r")))).alias("p"))
        named = {"code": "who", "s": "vote", "v": "volatility", "r": "review"}
        self.packed = written(packed.select("item", *[F.col(f"p.{f}").alias(n) for f, n in named.items()]), "items")
        self.prior = np.full(K, 1.0 / K)
        start = np.full((K, K), np.log(0.15))
        np.fill_diagonal(start, np.log(0.7))
        self.weight = np.tile(start, (max(1, len(names)), 1, 1))
        self.met = np.zeros((max(1, len(names)), K, K))
        self.settled = False
        for self.rounds in range(1, rounds + 1):
            self.met = self._left_out()
            whole = self.met.sum(0)
            prior = (whole.sum(0) + 1) / (whole.sum() + K)
            pooled = (whole + 1) / (whole.sum(1, keepdims=True) + K)
            share = (self.met + SMOOTH * pooled) / (self.met.sum(2, keepdims=True) + SMOOTH)
            weight = np.log(np.maximum(share, LOW)) - np.log(prior)
            moved = np.abs(weight - self.weight).max()
            self.weight, self.prior = weight, prior
            if moved < STABLE:
                self.settled = True
                break
        seen = self.met.sum((1, 2))
        right = np.trace(self.met, axis1=1, axis2=2)
        overall = right.sum() / seen.sum() if seen.sum() else 0.7
        self.seen = seen
        self.accuracy = (right + SMOOTH * overall) / (seen + SMOOTH)
        self._agreement: tuple[float | None, float] | None = None

    def _left_out(self) -> np.ndarray:
        """Per annotator, status given and status: summed shares of the status in the consensus of the others on the same items."""
        weight, prior = self.weight, self.prior

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met = np.zeros_like(weight)
            for b in batches:
                v = Votes(b)
                given, sums = v.tally(weight, prior)
                rest = sums[v.row] - given
                p = np.exp(rest - rest.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                rated = v.vote >= 0
                use = rated & (np.bincount(v.row, weights=rated, minlength=v.items)[v.row] > 1)
                cell = v.who[use].astype(np.int64) * K + v.vote[use]
                for s in range(K):
                    met[:, :, s] += np.bincount(cell, weights=p[use, s], minlength=len(weight) * K).reshape(-1, K)
            at = np.flatnonzero(met.sum(2).ravel())
            flat = met.reshape(-1, K)[at]
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(flat[:, s]) for s in range(K))], names=["cell", *(f"m{s}" for s in range(K))])

        sums = self.packed.mapInArrow(run, "cell long, " + ", ".join(f"m{s} double" for s in range(K)))
        got = sums.groupBy("cell").agg(*[F.sum(f"m{s}").alias(f"m{s}") for s in range(K)]).toArrow()
        out = np.zeros((len(weight) * K, K))
        if got.num_rows:
            out[got.column(0).to_numpy()] = np.stack([got.column(s + 1).to_numpy() for s in range(K)], 1)
        return out.reshape(weight.shape)

    def _expected(self) -> tuple[float | None, float]:
        """Krippendorff's alpha for nominal values with missing ratings (None without items rated twice), and the disagreement that chance gives."""
        if self._agreement is None:

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros(K + 1)
                for b in batches:
                    v = Votes(b)
                    n = np.stack([np.bincount(v.row, weights=v.vote == s, minlength=v.items) for s in range(K)], 1)
                    n = n[n.sum(1) >= 2]
                    m = n.sum(1)
                    total += [*n.sum(0), ((m * m - (n * n).sum(1)) / (m - 1)).sum()]
                yield pa.RecordBatch.from_arrays([pa.array([float(x)]) for x in total], names=[f"t{i}" for i in range(K + 1)])

            t = self.packed.mapInArrow(run, ", ".join(f"t{i} double" for i in range(K + 1)))
            r = t.agg(*[F.sum(c) for c in t.columns]).first()
            n = np.array([x or 0.0 for x in r[:K]])
            pairs = n.sum() * (n.sum() - 1)
            chance = (n.sum() ** 2 - (n * n).sum()) / pairs if pairs > 0 else 0.0
            alpha = None if not n.sum() else 1.0 if chance == 0 else 1.0 - (r[K] / n.sum()) / chance
            self._agreement = (alpha, float(chance))
        return self._agreement

    @property
    def alpha(self) -> float | None:
        return self._expected()[0]

    def statuses(self) -> DataFrame:
        """item, status, annotators (who gave a status): the consensus alone, without agreement and estimates."""
        return self.items(False).select("item", "status", "annotators")

    def items(self, agreement: bool = True) -> DataFrame:
        """item, status, volatility, review, annotators (who gave a status), agreement, margin.

        Status ties go to the status with more votes, then to the alphabetically first. Volatility is the median of the
        estimates given, review the majority (a tie asks for review), both weighted by the annotators' accuracy;
        agreement is corrected by the chance that the votes of all items give and null below two ratings.
        """
        weight, prior, accuracy = self.weight, self.prior, self.accuracy
        chance = self._expected()[1] if agreement else 0.0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = Votes(b)
                _, sums = v.tally(weight, prior)
                n = np.stack([np.bincount(v.row, weights=v.vote == s, minlength=v.items) for s in range(K)], 1)
                m = n.sum(1)
                score = np.round(sums, 9)
                order = np.lexsort((np.broadcast_to(np.arange(K), score.shape), -n, -score), axis=1)
                first, second = order[:, 0], order[:, 1]
                at = np.arange(v.items)
                margin = np.round(score[at, first] - score[at, second], 6)
                w = accuracy[v.who]
                with np.errstate(divide="ignore", invalid="ignore"):
                    observed = (m * m - (n * n).sum(1)) / (m * (m - 1))
                    agree = np.round(1 - observed / chance, 6) if chance else np.ones(v.items)
                yes = np.bincount(v.row, weights=w * (v.review == 1), minlength=v.items)
                no = np.bincount(v.row, weights=w * (v.review == 0), minlength=v.items)
                asked = np.bincount(v.row, weights=v.review >= 0, minlength=v.items) > 0
                none = m == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        pa.array(np.array(STATUSES, object)[first], pa.string(), mask=none),
                        _medians(v, w),
                        pa.array(yes >= no, mask=~asked),
                        pa.array(m.astype(np.int64)),
                        pa.array(agree, mask=m < 2),
                        pa.array(margin, mask=none),
                    ],
                    names=["item", "status", "volatility", "review", "annotators", "agreement", "margin"],
                )

        return self.packed.mapInArrow(run, "item string, status string, volatility double, review boolean, annotators long, agreement double, margin double")

    def annotators(self) -> DataFrame:
        """annotator, votes compared, leave-one-out smoothed accuracy, whether the voting settled."""
        spark = self.packed.sparkSession
        rows = [(a, int(round(n)), float(round(p, 6)), self.settled) for a, n, p in zip(self.names, self.seen, self.accuracy)]
        return spark.createDataFrame(rows, "annotator string, votes long, reliability double, settled boolean")


def _medians(v: Votes, weight: np.ndarray) -> pa.Array:
    """Weighted (lower) median of the estimates of each item, null without any."""
    known = np.flatnonzero(~np.isnan(v.volatility))
    order = known[np.lexsort((v.volatility[known], v.row[known]))]
    row, w = v.row[order], weight[order]
    total = np.bincount(row, weights=w, minlength=v.items)
    before = np.concatenate([[0.0], np.cumsum(total)])[:-1]
    reached = np.cumsum(w) - before[row] >= total[row] / 2 - 1e-12
    at = np.flatnonzero(reached)
    rows, first = np.unique(row[at], return_index=True)
    out = np.zeros(v.items)
    out[rows] = v.volatility[order[at[first]]]
    none = np.ones(v.items, bool)
    none[rows] = False
    return pa.array(np.round(out, 6), mask=none)
