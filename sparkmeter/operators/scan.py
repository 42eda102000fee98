"""Running values over long sequences without one task for each sequence.

A sequence is cut into chunks. Each chunk's contribution (a sum, a last value) is an aggregate with map-side combine; the few
contributions of a sequence are scanned by a window, and what a chunk inherits is added to the running values
inside it. Sums and last values are associative, so the result is the one of a single pass, and a task holds a chunk at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def prefix(rows: DataFrame, scope: list[str], order: list[str], chunk: str, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with running sums (a row's own value included) and last known values (a row's own left out).

    ``chunk`` never falls along ``order``; its values say where a sequence is cut, whatever they are.
    """
    sums, lasts = sums or {}, lasts or {}
    marked = rows.withColumns({f"_s_{n}": F.coalesce(c.cast("long"), F.lit(0)) for n, c in sums.items()} | {f"_l_{n}": c for n, c in lasts.items()})
    at = F.struct(*order)
    parts = [F.sum(f"_s_{n}").alias(f"_c_{n}") for n in sums] + [F.max_by(f"_l_{n}", F.when(F.col(f"_l_{n}").isNotNull(), at)).alias(f"_c_{n}") for n in lasts]
    before = Window.partitionBy(*scope).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.groupBy(*scope, chunk).agg(*parts)
    carried = carried.select(
        *[F.col(c).alias(f"_k_{c}") for c in [*scope, chunk]],
        *[F.coalesce(F.sum(f"_c_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums],
        *[F.last(f"_c_{n}", ignorenulls=True).over(before).alias(f"_b_{n}") for n in lasts],
    )
    same = F.lit(True)
    for c in [*scope, chunk]:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    inside = Window.partitionBy(*scope, chunk).orderBy(*order)
    upto, earlier = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow), inside.rowsBetween(Window.unboundedPreceding, -1)
    found = marked.join(carried, same)
    found = found.withColumns({n: F.sum(f"_s_{n}").over(upto) + F.col(f"_b_{n}") for n in sums} | {n: F.coalesce(F.last(f"_l_{n}", ignorenulls=True).over(earlier), F.col(f"_b_{n}")) for n in lasts})
    return found.select(*rows.columns, *sums, *lasts)
