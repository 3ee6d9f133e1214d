"""Pages of a newest-first listing at any depth (REL-2).

``offset`` brings every row before the page to one task. Here the page's place is found by counting:
the sort key is cut into at most ``BINS`` equal ranges, rows are counted per range (combined
map-side, one row per range reaches the driver), the range that holds the wanted place is cut again,
and so on until it holds few rows or one value; then the next part of the key takes over. What is left to sort is
the page and at most ``ENOUGH`` rows on either side of it. A reader who has the page before needs no
counting: ``page_after`` starts behind its last row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = 1024     # ranges per histogram, the rows that one counting job returns
ENOUGH = 4096   # rows of a range that need no further cut
LOWEST = -(1 << 63)  # stands for null, which is last in descending order


def _ordinal(df: DataFrame, name: str) -> tuple[Column, callable]:
    """A sort column as a whole number, and the way back for a pushed-down bound."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.IntegralType):
        number, back = c.cast("long"), lambda n: F.lit(n)
    elif isinstance(kind, T.DateType):
        number, back = F.unix_date(c).cast("long"), lambda n: F.date_from_unix_date(F.lit(n).cast("int"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        number, back = F.unix_micros(c.cast("timestamp")), lambda n: F.timestamp_micros(F.lit(n)).cast(kind)
    else:
        raise TypeError(f"pages need whole numbers, dates or timestamps to sort by, {name} is {kind.simpleString()}")
    return F.coalesce(number, F.lit(LOWEST)), back


def _cut(lo: int, hi: int, width: int, b: int) -> tuple[int, int]:
    """The numbers of ``lo .. hi`` whose quotient by ``width``, rounded towards zero, is ``b``."""
    first = b * width if b > 0 else (b - 1) * width + 1
    last = (b + 1) * width - 1 if b >= 0 else b * width
    return max(lo, first), min(hi, last)


class _Places:
    """Finds the ranges of the sort key that hold given places; histograms are kept between calls."""

    def __init__(self, df: DataFrame, numbers: list[Column], enough: int, bins: int):
        self.numbers, self.enough, self.bins, self.seen = numbers, enough, bins, {}
        self.rows = df.select(*[n.alias(f"_k{i}") for i, n in enumerate(numbers)])

    def _once(self, key, job):
        if key not in self.seen:
            self.seen[key] = job()
        return self.seen[key]

    def total(self) -> int:
        return self._once("total", self.rows.count)

    def find(self, place: int) -> tuple[list[int], list[int], int]:
        """(lowest, highest, before): key bounds of a range holding the row at ``place`` (from 0) and
        the number of rows before that range. A bound may be shorter than the key."""
        inside, fixed, before, held = self.rows, [], 0, self.total()
        for i in range(len(self.numbers)):
            c = F.col(f"_k{i}")
            lo, hi = self._once((*fixed, "ends"), lambda: tuple(inside.agg(F.min(c), F.max(c)).first()))
            while lo < hi and held > self.enough:
                width = -(-(hi - lo + 1) // self.bins)
                counts = self._once((*fixed, lo, hi), lambda: sorted(
                    ((b, n) for b, n in inside.where(c.between(lo, hi)).groupBy(F.call_function("div", c, F.lit(width)))
                     .count().collect()), reverse=True))
                for b, held in counts:
                    if before + held > place:
                        break
                    before += held
                lo, hi = _cut(lo, hi, width, b)
            if held <= self.enough or i + 1 == len(self.numbers):
                return [*fixed, lo], [*fixed, hi], before
            inside, fixed = inside.where(c == lo), [*fixed, lo]
        raise AssertionError("a sort key has at least one part")


def _at_most(numbers: list[Column], bound: list[int], strict: bool = False) -> Column:
    """The key, as far as the bound reaches, is no greater than it (or smaller)."""
    c, b = numbers[0], bound[0]
    if len(bound) == 1:
        return c < F.lit(b) if strict else c <= F.lit(b)
    return (c < F.lit(b)) | ((c == F.lit(b)) & _at_most(numbers[1:], bound[1:], strict))


def page(df: DataFrame, page_no: int, size: int, at: str, key: str, enough: int = ENOUGH, bins: int = BINS) -> DataFrame:
    """Rows ``page_no * size`` and on, ``size`` of them, by (``at``, ``key``) descending; a null is
    last. ``key`` should be unique: rows that agree in both are in no order, and a page inside such a
    run sorts the whole run. ``at`` and ``key`` are whole numbers, dates or timestamps. Pages that begin within
    the first ``enough`` rows are a plain top-k; for the others the table's key is counted now."""
    order = [F.col(at).desc(), F.col(key).desc()]
    start = page_no * size
    if start + size <= enough:
        return df.orderBy(*order).offset(start).limit(size)
    numbers, ways = zip(*(_ordinal(df, c) for c in (at, key)))
    places = _Places(df, list(numbers), enough, bins)
    if start >= places.total():
        return df.limit(0)
    _, top, before = places.find(start)
    bottom, _, _ = places.find(min(start + size, places.total()) - 1)
    rows = df.where(_at_most(numbers, top)).where(~_at_most(numbers, bottom, strict=True))
    if bottom[0] > LOWEST:  # said of the column itself, so that it reaches the scan
        rows = rows.where(F.col(at).between(ways[0](bottom[0]), ways[0](top[0])))
    return rows.orderBy(*order).offset(start - before).limit(size)


def page_after(df: DataFrame, last: tuple, size: int, at: str, key: str) -> DataFrame:
    """The ``size`` rows that follow the row whose (``at``, ``key``) is ``last``: a top-k per task, however deep."""
    numbers = [_ordinal(df, c)[0] for c in (at, key)]
    one = df.sparkSession.range(1).select(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip((at, key), last)])
    bound = list(one.select(*numbers).first())
    rows = df.where(_at_most(numbers, bound, strict=True))
    if last[0] is not None:
        rows = rows.where(F.col(at).isNull() | (F.col(at) <= F.lit(last[0]).cast(df.schema[at].dataType)))
    return rows.orderBy(F.col(at).desc(), F.col(key).desc()).limit(size)
