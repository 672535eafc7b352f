"""Weak supervision in SQL: labelers vote 1, -1 or abstain (0); expectation-maximisation estimates their accuracies.

For each true label a labeler has a probability of each vote (Dawid and Skene, 1979), abstaining included, so a rule
that sees one defect alone can outweigh many that look for others, and one that is often wrong weighs little. Nothing
is fixed beforehand but the start: the share of votes in favour, which keeps the two labels from changing places. Only the table of vote patterns is iterated on. It
has at most 3^k rows for k labelers, whatever the corpus, and the whole estimation is one SQL expression over it. The
fitted numbers come back as one row and go into the scoring expression as literals.
"""

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 25
#: In the first guess a vote against counts as so many in favour.
AGAINST = 2


@dataclass
class Votes:
    """The share of label 1, and for each labeler the probabilities of the votes -1, 0, 1 under label 1 and 0."""

    prior: float
    good: list[list[float]]
    bad: list[list[float]]

    def posterior(self, votes: list[Column]) -> Column:
        """Probability of label 1 given the votes."""
        odds = F.lit(log(self.prior / (1 - self.prior)))
        for vote, g, b in zip(votes, self.good, self.bad, strict=True):
            against, none, favour = (log(x / y) for x, y in zip(g, b, strict=True))
            odds = odds + F.when(vote == 1, favour).when(vote == -1, against).otherwise(none)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


    def reliabilities(self, names: list[str]) -> list[tuple[str, float, float, float]]:
        """For each labeler: its name, how often it votes, and how often it is right in favour and against."""
        out = []
        for name, g, b in zip(names, self.good, self.bad, strict=True):
            share = [self.prior * x + (1 - self.prior) * y for x, y in zip(g, b, strict=True)]
            out.append((name, share[0] + share[2], self.prior * g[2] / share[2], (1 - self.prior) * b[0] / share[0]))
        return out


def em_sql(k: int, rounds: int = ROUNDS) -> str:
    """SQL over column ``pats`` (array of ``v`` votes and ``n`` rows): a struct of prior, good and bad.

    The state is the posterior of each pattern. An array of one element binds a round's estimates, so that they are
    computed once. Each count starts at one.
    """
    plus = "0D, (x, y) -> x + y"
    mass = lambda y: f"aggregate(zip_with(pats, q, (p, y) -> p.n * {y}), {plus})"
    hits = lambda y: f"aggregate(zip_with(pats, q, (p, y) -> IF(p.v[k] = j, p.n * {y}, 0D)), {plus})"
    table = lambda y: f"transform(sequence(0, {k - 1}), k -> transform(sequence(-1, 1), j -> ({hits(y)} + 1) / ({mass(y)} + 3)))"
    estimates = f"named_struct('prior', ({mass('y')} + 1) / ({mass('1')} + 2), 'good', {table('y')}, 'bad', {table('(1 - y)')})"
    evidence = f"aggregate(transform(p.v, (v, k) -> ln(m.good[k][v + 1] / m.bad[k][v + 1])), {plus})"
    posterior = f"transform(pats, p -> 1 / (1 + exp(-(ln(m.prior / (1 - m.prior)) + {evidence}))))"
    votes = lambda sign: f"CAST(size(filter(p.v, v -> v = {sign})) AS DOUBLE)"
    guess = f"transform(pats, p -> ({votes(1)} + 1) / ({votes(1)} + {AGAINST} * {votes(-1)} + 2))"
    settled = f"aggregate(sequence(1, {rounds}), {guess}, (q, i) -> aggregate(array({estimates}), q, (z, m) -> {posterior}))"
    return f"transform(array({settled}), q -> {estimates})[0]"


def fit(rows: DataFrame, votes: list[str]) -> Votes:
    """Estimate from rows with a vote in each of the named columns. No rows: even odds between the labels."""
    patterns = rows.groupBy(*votes).agg(F.count("*").cast("double").alias("n"))
    packed = patterns.select(F.struct(F.array(*[F.col(v).cast("int") for v in votes]).alias("v"), "n").alias("p"))
    one = packed.agg(F.sort_array(F.collect_list("p")).alias("pats"))
    got = one.select(F.expr(em_sql(len(votes))).alias("fit")).first().fit
    return Votes(min(max(got.prior, 1e-6), 1 - 1e-6), [list(x) for x in got.good], [list(x) for x in got.bad])
