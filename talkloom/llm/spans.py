"""Spans of regular expressions in code points, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

SPAN = "array<struct<s:int,e:int,v:string,left:string,right:string>>"
PLACED = "array<struct<at:int,rows:array<struct<m:string,gap:string,next:string>>>>"
#: Matches that are walked with one growing array.
RUN = 128
#: The last word before a span and the first word after it.
LAST_WORD, FIRST_WORD = r"([^\s]+)\s*$", r"^\s*([^\s]+)"


def spans(text: Column, pattern: str, context: bool = False) -> Column:
    """Leftmost non-overlapping matches as structs of start, end (exclusive), text and, if asked for, the words around.

    Splitting at the same pattern gives the pieces between the matches; running lengths of pieces and
    matches are the positions.  They are summed over runs of RUN matches first, as a growing array is
    copied at each step: a text of very many matches takes time in proportion to them.  The second pass
    runs only where the first one found anything.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.lit(None).cast("string")

    def around(piece: Column, rule: str, tail: bool) -> Column:
        near = F.right(piece, F.lit(80)) if tail else F.substring(piece, 1, 80)
        return F.lower(F.regexp_extract(near, rule, 1)) if context else none

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        one = F.struct(start.alias("s"), end.alias("e"), x["m"].alias("v"), around(x["gap"], LAST_WORD, True).alias("left"), around(x["next"], FIRST_WORD, False).alias("right"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def walk(rows: Column, at: Column) -> Column:
        return F.aggregate(rows, F.struct(at.alias("at"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])

    def placed(acc: Column, b: Column) -> Column:
        size = F.aggregate(b, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["m"]))
        return F.struct((acc["at"] + size).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), b.alias("rows")))).alias("out"))

    pieces = F.split(text, pattern, -1)
    parts = F.arrays_zip(found.alias("m"), F.slice(pieces, 1, F.size(found)).alias("gap"), F.slice(pieces, 2, F.size(found)).alias("next"))
    rows = F.transform(parts, lambda x: F.struct(x["m"].alias("m"), x["gap"].alias("gap"), x["next"].alias("next")))
    # the one-element array names the rows, so that they are not made again for each run
    count = lambda r: F.sequence(F.lit(0), F.floor((F.size(r) - 1) / RUN).cast("int"))
    runs = F.flatten(F.transform(F.array(rows), lambda r: F.transform(count(r), lambda k: F.slice(r, k * RUN + 1, RUN))))
    none_placed = F.struct(F.lit(0).alias("at"), F.array().cast(PLACED).alias("out"))
    walked = F.flatten(F.transform(F.aggregate(runs, none_placed, placed, lambda acc: acc["out"]), lambda x: walk(x["rows"], x["at"])))
    return F.when(F.size(found) > 0, walked).otherwise(F.array().cast(SPAN))


def tagged(found: Column, kind: str, place: int) -> Column:
    """Spans as sortable structs (place of the kind, start, end, kind)."""
    return F.transform(found, lambda x: F.struct(F.lit(place).alias("p"), x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("kind")))


def joined(tags: Column, by_start: bool) -> Column:
    """kind:start:end, comma-joined; by kind then start, or by start then kind."""
    order: Callable = (lambda x: F.struct(x["s"], x["p"], x["e"], x["kind"].alias("kind"))) if by_start else (lambda x: F.struct(x["p"], x["s"], x["e"], x["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(F.transform(tags, order)), lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def apart(a: Column, b: Column) -> Column:
    return (a["e"] <= b["s"]) | (b["e"] <= a["s"])
