"""Column algebra shared by the operators: rounding rules, weights, and the two-sample comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIOR_GAMES = 100.0
DESIGN_EFFECT = 2.0


def half_even(x: Column) -> Column:
    """Nearest whole number, ties to even."""
    return F.rint(x)


def half_up(x: Column) -> Column:
    """Nearest whole number, ties upward."""
    return F.floor(x + 0.5)


def cents(amount: Column) -> Column:
    """Money amount (number or decimal string) to integer cents, ties to even; null for none or no number."""
    return half_even(amount.try_cast("double") * 100).cast("int")


def rarity(n: Column, plays: Column) -> Column:
    """Weight of an item within a group of ``n`` baskets: ln(n / max(plays, 1)) squared."""
    return F.pow(F.log(n / F.greatest(plays, F.lit(1))), 2)


def idf(n: Column, d: Column) -> Column:
    """Weight of a search term on ``d`` of ``n`` items; 0 for a term on none."""
    return F.when(d > 0, F.pow(1 + F.log(n / d), 2)).otherwise(F.lit(0.0))


def share(k: Column, n: Column) -> Column:
    """k / n, null when n is 0."""
    return F.try_divide(k, n)


def compare(k1: Column, n1: Column, k2: Column, n2: Column, rate: Column,
            prior: float = PRIOR_GAMES, design: float = DESIGN_EFFECT) -> tuple[Column, Column]:
    """(lift, evidence) of k1 wins in n1 games against k2 in n2. The lift shrinks both sides toward ``rate``
    by ``prior`` games; the evidence is the raw difference in standard errors, a game counting 1/design (null where a side
    has no games)."""
    shrunk = lambda k, n: (k + rate * prior) / (n + prior)
    lift = shrunk(k1, n1) - shrunk(k2, n2)
    one = F.lit(1.0)
    spread = F.sqrt(design * rate * (1 - rate) * (share(one, n1) + share(one, n2)))
    return lift, share(share(k1, n1) - share(k2, n2), spread)


def phi(both: Column, a: Column, b: Column, n: Column) -> Column:
    """Correlation of two yes/no columns from their counts; 0 when either never varies."""
    a, b, both, n = (c.cast("double") for c in (a, b, both, n))
    spread = F.sqrt(a * (n - a) * b * (n - b))
    return F.when(spread > 0, (both * n - a * b) / spread).otherwise(F.lit(0.0))


def match_points(wins: Column, draws: Column) -> Column:
    return wins * 5 + draws


def points_per_game(games: Column, wins: Column, draws: Column) -> Column:
    return F.coalesce(share(match_points(wins, draws), games), F.lit(0.0))


def round_amount(x: Column) -> Column:
    """The 1, 2 or 5 times a power of ten nearest to x on a log scale (the smaller on a tie)."""
    base = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    steps = F.array(*[F.struct(F.abs(F.log(m * base / x)).alias("gap"), (m * base).alias("amount"))
                      for m in (1.0, 2.0, 5.0, 10.0)])
    return F.array_min(steps)["amount"]


def mask_of(present: Column, names: list[str]) -> Column:
    """Bit mask of which of ``names`` an array column holds, the first name in bit 0."""
    total = F.lit(0)
    for bit, name in enumerate(names):
        total = total + F.when(F.array_contains(present, name), F.lit(1 << bit)).otherwise(F.lit(0))
    return total
