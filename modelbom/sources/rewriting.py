"""Nested texts at any depth in one expression: breadth-first walks and top-down rewriting.

An expression cannot recurse, but ``aggregate`` over a sequence is a loop. Its length is the depth of the
row's own text, so no depth is fixed in the plan, nothing is collected, and each level costs one pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from modelbom.functions.text import let

__all__ = ["PIECE", "PIECES", "depth", "descend", "let", "piece", "rewrite"]

#: A piece of a text being written: a finished part, or a JSON value still to be written in its place.
PIECE = "struct<done:boolean,name:string,flag:string,text:string>"
PIECES = f"array<{PIECE}>"


def depth(text: Column) -> Column:
    """How deep objects and lists of a JSON text are nested; 0 for a scalar."""
    marks = F.regexp_replace(text, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^\[\]{}"]++', "")
    steps = F.transform(F.split(marks, ""), lambda c: F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    deepest = F.aggregate(
        steps, start, lambda s, x: F.struct((s["now"] + x).alias("now"), F.greatest(s["most"], s["now"] + x).alias("most"))
    )
    return F.coalesce(deepest["most"], F.lit(0))


def piece(done: bool, text: Column, name: Column | str = "", flag: Column | str = "") -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        F.lit(done).alias("done"), as_column(name).cast("string").alias("name"),
        as_column(flag).cast("string").alias("flag"), as_column(text).cast("string").alias("text"),
    )


def rewrite(text: Column, name: Column, expand: Callable[[Column], Column]) -> Column:
    """The text that ``expand`` makes of a JSON value, level by level.

    ``expand`` gives the pieces of one unfinished piece: finished parts and, in their places, the values
    one level below. Every round expands all unfinished pieces; the rounds are one more than the depth.
    """
    def level(pieces: Column, _: Column) -> Column:
        return F.flatten(F.transform(pieces, lambda p: F.when(p["done"], F.array(p).cast(PIECES)).otherwise(expand(p).cast(PIECES))))

    def written(t: Column) -> Column:
        start = F.array(piece(False, t, name)).cast(PIECES)
        pieces = F.aggregate(F.sequence(F.lit(0), depth(t)), start, level)
        return F.when(t.isNotNull(), F.array_join(F.transform(pieces, lambda p: p["text"]), ""))

    return let(text, written)


def descend(start: Column, rounds: Column, below: Callable[[Column], Column], type_: str) -> Column:
    """All elements below ``start`` (an array of ``type_``), level by level: ``below`` gives the children of one."""
    def level(state: Column, _: Column) -> Column:
        new = F.flatten(F.transform(state["edge"], below)).cast(f"array<{type_}>")
        return F.struct(new.alias("edge"), F.concat(state["all"], new).alias("all"))

    nothing = F.array().cast(f"array<{type_}>")
    begin = F.struct(start.cast(f"array<{type_}>").alias("edge"), nothing.alias("all"))
    return F.aggregate(F.sequence(F.lit(0), rounds), begin, level)["all"]
