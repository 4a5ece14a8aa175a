"""Column expressions for shares, ratios, bins, hashes and ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Fixed value: the smallest share either side of a stability index may have.
SHARE_FLOOR = 1e-6


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def share(count: Column, total: Column) -> Column:
    """A bin's share of its side, floored after normalising and not renormalised."""
    return F.greatest(F.coalesce(F.try_divide(count.cast("double"), total.cast("double")), F.lit(0.0)), F.lit(SHARE_FLOOR))


def psi_term(reference: Column, current: Column) -> Column:
    return (current - reference) * F.log(current / reference)


def safe_ratio(numerator: Column | str, denominator: Column | str, default: float | None = None) -> Column:
    ratio = F.try_divide(col(numerator).cast("double"), col(denominator).cast("double"))
    return ratio if default is None else F.coalesce(ratio, F.lit(float(default)))


def right_closed_bin(value: Column | str, bins: int) -> Column:
    """0-based bin of ``value`` in ``bins`` equal right-closed bins on [0, 1].

    The edges are the doubles i/bins spaced as ``linspace`` spaces them, so a value equal
    to an edge lands in the bin below it. A sum of comparisons stays inside codegen.
    """
    step = 1.0 / bins
    hits = [(col(value) > F.lit(i * step)).cast("int") for i in range(1, bins)]
    total = F.lit(0)
    for hit in hits:
        total = total + hit
    return total


def clipped_log_loss(label: Column | str, probability: Column | str) -> Column:
    # Fixed value: the double-precision epsilon scores are kept away from 0 and 1 by.
    eps = 2.220446049250313e-16
    p = F.least(F.greatest(col(probability), F.lit(eps)), F.lit(1.0 - eps))
    return -F.when(col(label) == 1, F.log(p)).otherwise(F.log(F.lit(1.0) - p))


def kolmogorov_p(statistic: Column, reference_rows: Column, current_rows: Column, terms: int = 100) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value.

    Below 0.18 the series needs many terms to say 1 within double precision, so 1 is given.
    """
    n, m = reference_rows.cast("double"), current_rows.cast("double")
    lam = F.sqrt(n * m / (n + m)) * statistic
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, j: acc - F.pow(F.lit(-1.0), j) * F.exp(lam * lam * j * j * -2.0) * 2.0,
    )
    return F.when(lam < 0.18, F.lit(1.0)).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def hash_bits(keys: Sequence[Column | str], seed: int | str, portable: bool = False) -> Column:
    """A 48-bit non-negative hash of the keys and seed, the same on every partitioning.

    ``portable`` uses md5, which other engines can repeat; the default is xxhash64.
    """
    if portable:
        text = F.concat_ws("|", *[col(k).cast("string") for k in keys], F.lit(str(seed)))
        return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")
    return F.shiftrightunsigned(F.xxhash64(*[col(k) for k in keys], F.lit(str(seed))), 16)


def hash_uniform(keys: Sequence[Column | str], seed: int | str, portable: bool = False) -> Column:
    """A repeatable draw in (0, 1) for each row."""
    return (hash_bits(keys, seed, portable).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def hash_normal(keys: Sequence[Column | str], seed: int | str, portable: bool = False) -> Column:
    """A repeatable standard normal draw for each row (Box-Muller)."""
    u = hash_uniform(keys, f"{seed}-a", portable)
    v = hash_uniform(keys, f"{seed}-b", portable)
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0 * 3.141592653589793) * v)


def short_digest(text: Column, length: int = 8) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def digest_id(prefix: str, middle: Column, text: Column, length: int = 8) -> Column:
    """``prefix-middle-digest``: an id that a second evaluation of the same facts repeats."""
    return F.concat(F.lit(f"{prefix}-"), middle, F.lit("-"), short_digest(text, length))


def canonical_json(columns: Sequence[str]) -> Column:
    """Compact JSON of the columns in name order with nulls kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def payload_digest(columns: Sequence[str]) -> Column:
    return F.sha2(canonical_json(columns), 256)
