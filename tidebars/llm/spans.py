"""Places of regular-expression matches, in built-in functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_RUN = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _sums(values: Column) -> Column:
    """Running sums of a short array."""
    start = F.array().cast("array<int>")
    return F.aggregate(
        values, start, lambda done, x: F.array_append(done, x + F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)))
    )


def running_sums(values: Column) -> Column:
    """Running sums of an int array of any length.

    Sums inside runs of 64 values and over the runs' totals: appending to one array
    alone would copy it for each value.
    """
    first = F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(_RUN))
    inside = F.transform(first, lambda i: _sums(F.slice(values, i + 1, F.lit(_RUN))))

    def joined(runs: Column) -> Column:
        totals = F.transform(runs, lambda r: F.coalesce(F.try_element_at(r, F.lit(-1)), F.lit(0)))
        return let(
            _sums(totals),
            lambda ends: F.flatten(F.transform(runs, lambda r, i: F.transform(r, lambda x: x + F.when(i > 0, F.try_element_at(ends, i)).otherwise(0)))),
        )

    return let(inside, joined)


def match_spans(text: Column, pattern: Column | str, *groups: int) -> Column:
    """``start, end, found`` and texts of ``groups`` of each leftmost non-overlapping match.

    ``start`` and ``end`` (exclusive) count code points. The pattern may not match the
    empty text. Texts without a match are told apart before they are cut.
    """
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = [F.regexp_extract_all(text, p, F.lit(g)) for g in (0, *groups)]
    names = ["found", *[f"group{g}" for g in groups]]
    gaps = F.transform(F.split(text, p, -1), lambda x: F.length(x))
    parts = F.arrays_zip(gaps.alias("gap"), *[f.alias(n) for f, n in zip(found, names, strict=True)])

    def placed(zipped: Column) -> Column:
        steps = F.transform(zipped, lambda z: z["gap"] + F.coalesce(F.length(z["found"]), F.lit(0)))
        rows = lambda ends: F.transform(
            zipped,
            lambda z, i: F.struct(
                (ends[i] - F.length(z["found"])).alias("start"), ends[i].alias("end"), *[z[n].alias(n) for n in names]
            ),
        )
        return F.filter(let(running_sums(steps), rows), lambda s: s["found"].isNotNull())

    kind = "array<struct<start:int,end:int," + ",".join(f"{n}:string" for n in names) + ">>"
    return F.when(text.rlike(pattern) if isinstance(pattern, str) else F.regexp_like(text, p), let(parts, placed).cast(kind)).otherwise(
        F.array().cast(kind)
    )
