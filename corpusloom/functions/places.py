"""Places that a free text names, and whether two people have a place or region in common."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ARABIC, Lexicon, normalize


def places_of(c: Column, cities: tuple[str, ...] = (), noise: tuple[str, ...] = (), lex: Lexicon = ARABIC) -> Column:
    """Distinct normalised places between separators. Words of noise at a place's head go; a joined "and" goes
    where what is left is a known city and the whole is not."""
    known = F.array(*[F.lit(x) for x in cities]).cast("array<string>")

    def place(p: Column) -> Column:
        w = F.filter(F.split(normalize(F.trim(p), lex), r"\s+"), lambda x: x != "")
        first = F.array_position(F.transform(w, lambda x: ~x.isin(*noise) if noise else F.lit(True)), True)
        name = F.when(first > 0, F.array_join(F.slice(w, first.cast("int"), F.greatest(F.size(w), F.lit(1))), " ")).otherwise("")
        rest = name.substr(F.lit(2), F.length(name))
        joined = F.startswith(name, F.lit("و")) & F.array_contains(known, rest) & ~F.array_contains(known, name)
        return F.when(joined, rest).otherwise(name)

    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[،,\-؛;/]"), place), lambda x: x != ""))


def regions_of(places: Column, regions: dict[str, str]) -> Column:
    """Distinct regions of places; a place of no known region is its own."""
    if not regions:
        return F.array_distinct(places)
    table = F.create_map(*[F.lit(x) for pair in regions.items() for x in pair])
    return F.array_distinct(F.transform(places, lambda p: F.coalesce(F.try_element_at(table, p), p)))


def nothing_in_common(a: Column, b: Column, regions: dict[str, str]) -> Column:
    """Whether both name places, but share neither a place nor a region."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b) & ~F.arrays_overlap(regions_of(a, regions), regions_of(b, regions))
