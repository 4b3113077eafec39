"""All matches of a pattern with their code-point offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Matches that one step of the running sum takes together.
RUN = 64


def starts(sizes: Column) -> Column:
    """The sums of all sizes before each place of an integer array.

    A fold copies its array at every step, so it runs over runs of ``RUN`` places and then over the runs: a text
    with n matches costs about n * RUN + (n / RUN)^2 copies and not n^2.
    """
    grow = lambda s, x: F.struct((s.at + x).alias("at"), F.concat(s.out, F.array(s.at)).alias("out"))
    running = lambda values, first: F.aggregate(values, F.struct(first.alias("at"), F.array().cast("array<int>").alias("out")), grow, lambda s: s.out)
    last = F.floor((F.size(sizes) - 1) / RUN).cast("int")
    runs = F.when(F.size(sizes) > 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.slice(sizes, k * RUN + 1, F.lit(RUN)))).otherwise(F.array().cast("array<array<int>>"))
    totals = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda a, x: a + x))
    return F.flatten(F.zip_with(runs, running(totals, F.lit(0)), running))


def with_spots(df: DataFrame, wanted: dict[str, tuple[Column, str]]) -> DataFrame:
    """``df`` with an array of (o, m) for each name of ``wanted`` (a text and a pattern): offset and match, in order.

    A match starts after all text between matches and all earlier matches, so a pattern must not match the empty string.
    A null text has a null array.
    """
    cut = df.withColumns({f"_{part}_{name}": made for name, (text, pattern) in wanted.items() for part, made in (("gaps", F.split(text, pattern, -1)), ("found", F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))})
    sizes = {}
    for name in wanted:
        gap = F.transform(F.slice(f"_gaps_{name}", 1, F.size(f"_found_{name}")), F.length)
        sizes[f"_sizes_{name}"] = F.zip_with(gap, F.transform(f"_found_{name}", F.length), lambda g, m: F.struct(g.alias("g"), (g + m).alias("all")))
    offsets = lambda name: F.zip_with(starts(F.col(f"_sizes_{name}.all")), F.col(f"_sizes_{name}.g"), lambda s, g: s + g)
    return cut.withColumns(sizes).select(*df.columns, *(F.arrays_zip(offsets(name).alias("o"), F.col(f"_found_{name}").alias("m")).alias(name) for name in wanted))


def groups_of(match: Column, pattern: str, groups: dict[str, int] | None) -> list[Column]:
    """Named groups, read from the match alone: the pattern must not look around itself."""
    return [F.regexp_extract(match, pattern, k).alias(n) for n, k in (groups or {}).items()]


def find_all(df: DataFrame, text: Column, pattern: str, groups: dict[str, int] | None = None) -> DataFrame:
    """``df`` once for each match: ``ord`` (from 0), ``o`` (offset), ``m`` (the match) and the named groups."""
    # An inner explode would ask the patterns again in a filter before it; the outer one's row without a match goes here.
    out = with_spots(df, {"_spots": (text, pattern)}).select(*df.columns, F.posexplode_outer("_spots").alias("ord", "_x")).filter("_x is not null")
    return out.select(*df.columns, "ord", F.col("_x.o").alias("o"), F.col("_x.m").alias("m"), *groups_of(F.col("_x.m"), pattern, groups))
