"""Ordered per-key state over long histories as a parallel prefix of composed functions.

What a row does to a key's state is a function from a family that is closed under
composition, held in a few columns: a smoothed rate is an affine map, a bounded level a shift
between two bounds. The state after a row is the composition of all functions up to it. Rows
are cut into blocks of time and those into pieces; inside a piece each function is composed with
the one 1, 2, 4, ... rows before, then the same is done with the pieces of a block and with the
blocks of a key. All of it is windows over built-in expressions, and a key with most of the
rows spreads over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binflow.session import cut

#: Rows of a piece; a power of two. All rows pass through log2(PIECE) windows, one in PIECE through the rest.
PIECE = 16


@dataclass(frozen=True)
class Family:
    """Functions of one kind. `compose(g, f)` gives the fields of "first g, then f" for two struct
    columns; `apply(f, state)` the state after f."""

    fields: tuple[str, ...]
    compose: Callable[[Column, Column], Sequence[Column]]
    apply: Callable[[Column, Column], Column]

    def of(self, columns: Sequence[Column]) -> Column:
        return F.struct(*[c.cast("double").alias(n) for c, n in zip(columns, self.fields, strict=True)])

    def then(self, g: str, f: str) -> Column:
        """First g, then f, for two struct columns of which g may be null."""
        return F.when(F.col(g).isNull(), F.col(f)).otherwise(self.of(self.compose(F.col(g), F.col(f))))

    def after(self, f: str, state: Column) -> Column:
        """The state after f; the state itself where f is null."""
        return F.when(F.col(f).isNull(), state).otherwise(self.apply(F.col(f), state))


def _composed(rows: DataFrame, parts: list[str], order: Sequence[str], longest: int, family: Family) -> DataFrame:
    """`f` of each row composed with those before it in its part; `longest`: rows of a part at most."""
    along, step = Window.partitionBy(*parts).orderBy(*order), 1
    kept = [c for c in rows.columns if c != "f"]
    while step < longest:
        rows = rows.withColumn("g", F.lag("f", step).over(along)).select(*kept, family.then("g", "f").alias("f"))
        step *= 2
    return rows


def _longest(rows: DataFrame, parts: list[str]) -> int:
    return rows.groupBy(*parts).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def prefixes(rows: DataFrame, key: str, order: Sequence[str], block: str, family: Family, function: Column) -> DataFrame:
    """(key, order columns, until, before) of each row, as in `scanned`."""
    small = rows.select(key, block, *order, function.alias("_function"))
    return scanned(small, key, order, block, family, F.col("_function")).select(key, *order, "until", "before")


def scanned(rows: DataFrame, key: str, order: Sequence[str], block: str, family: Family, function: Column) -> DataFrame:
    """`rows` with the composition of their key's functions up to each row, `until`, and up to the
    row before, `before`, null for a key's first row. What else a row holds goes along, so that
    nothing has to be joined to it again. Rows without a key or a block are left out.

    `block` rises with the order columns, which tell a key's rows apart.
    """
    inside = Window.partitionBy(key, block).orderBy(*order)
    numbered = rows.select("*", function.alias("f"), F.row_number().over(inside).alias("_row"), F.lead(F.lit(1)).over(inside).alias("_more"))
    ends = (F.col("_row") % PIECE == 0) | F.col("_more").isNull()
    small = numbered.select(*rows.columns, "f", F.floor((F.col("_row") - 1) / PIECE).alias("_piece"), ends.alias("_ends"))
    first = cut(_composed(small, [key, block, "_piece"], order, PIECE, family))
    sums = first.where("_ends").select(key, block, "_piece", "f")
    second = cut(_composed(sums, [key, block], ["_piece"], _longest(sums, [key, block]), family))
    totals = cut(second.groupBy(key, block).agg(F.max_by("f", "_piece").alias("f")))
    third = _composed(totals, [key], [block], _longest(totals, [key]), family)
    blocks = third.select(key, block, F.lag("f").over(Window.partitionBy(key).orderBy(block)).alias("g"))
    pieces = second.withColumn("f", F.lag("f").over(Window.partitionBy(key, block).orderBy("_piece"))).join(blocks, [key, block])
    start = F.when(F.col("f").isNull(), F.col("g")).otherwise(family.then("g", "f"))
    pieces = pieces.select(key, block, "_piece", start.alias("g"))
    within = Window.partitionBy(key, block, "_piece").orderBy(*order)
    out = first.join(pieces, [key, block, "_piece"]).withColumn("h", F.lag("f").over(within))
    return out.select(*rows.columns, family.then("g", "f").alias("until"), F.when(F.col("h").isNull(), F.col("g")).otherwise(family.then("g", "h")).alias("before"))


def time_block(micros: str, hours: int) -> Column:
    return F.floor(F.col(micros) / (3_600_000_000 * hours))
