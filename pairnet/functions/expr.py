"""Column expressions (all JVM-side built-ins; no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The Unicode White_Space characters (tab, LF, VT, FF, CR,
# space, NEL, no-break space, ogham space, en quad .. hair space, line and
# paragraph separators, narrow no-break space, medium math space,
# ideographic space).
WHITE_SPACE = ("\t\n\x0b\x0c\r \x85\xa0\u1680"
               + "".join(chr(c) for c in range(0x2000, 0x200B))
               + "\u2028\u2029\u202f\u205f\u3000")


def strip_ws(c: ColumnOrName) -> Column:
    """Remove white space of any kind (tab, CR, no-break space...) at both ends.

    Plain ``trim`` removes spaces only; ``trim`` with the White_Space set
    does the same as a ``(?U)^\\s+|\\s+$`` regex without a regex per row.
    """
    return F.trim(_c(c).cast("string"), F.lit(WHITE_SPACE))


def norm_id(c: ColumnOrName, normalize: bool = True) -> Column:
    """Identifier as a join key: text, stripped, lower case (or as is)."""
    if not normalize:
        return _c(c).cast("string")
    return F.lower(strip_ws(c))


def pair_key(a: ColumnOrName, b: ColumnOrName, normalize: bool = True) -> tuple[Column, Column]:
    """Direction-free key of a pair: (smaller, larger); NULLs are skipped."""
    x, y = norm_id(a, normalize), norm_id(b, normalize)
    return F.least(x, y), F.greatest(x, y)


def strip_prefix(c: ColumnOrName, organism: int | str) -> Column:
    """Remove a leading ``<organism>.`` once, at the start only."""
    return F.regexp_replace(_c(c), rf"^{organism}\.", "")


def safe_div(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Division giving NULL on a zero divisor (ANSI ``/`` raises)."""
    return F.try_divide(_c(a), _c(b))


def all_not_null(cols) -> Column:
    """True when every listed column is not NULL (NaN counts as a value)."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & _c(c).isNotNull()
    return cond


def hist_bin(x: ColumnOrName, lo: ColumnOrName, hi: ColumnOrName, bins: int) -> Column:
    """Equal-width bin index in [0, bins) over [lo, hi], last bin closed.

    The first guess ``floor((x-lo)/(hi-lo)*bins)`` is corrected against the
    bin edges ``lo + i*(hi-lo)/bins`` so that a value lying on an edge lands
    in the bin that starts there. A zero range is widened to ``lo-0.5 ..
    hi+0.5``.
    """
    x, lo, hi = _c(x), _c(lo), _c(hi)
    lo2 = F.when(lo == hi, lo - 0.5).otherwise(lo)
    hi2 = F.when(lo == hi, hi + 0.5).otherwise(hi)
    step = (hi2 - lo2) / F.lit(bins)
    guess = F.floor((x - lo2) / (hi2 - lo2) * F.lit(bins)).cast("long")
    guess = F.least(F.greatest(guess, F.lit(0)), F.lit(bins - 1))

    def edge(i: Column) -> Column:
        return F.when(i >= F.lit(bins), hi2).otherwise(i.cast("double") * step + lo2)

    down = F.when((x < edge(guess)) & (guess > 0), guess - 1).otherwise(guess)
    up = F.when((x >= edge(down + 1)) & (down < F.lit(bins - 1)), down + 1).otherwise(down)
    return up
