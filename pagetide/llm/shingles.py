"""Word shingles as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetide.functions.once import let
from pagetide.llm.shared import words

WIDTH = 5


def shingles(text: Column, width: int = WIDTH) -> Column:
    """Distinct runs of `width` lower-case words, blank-joined; a shorter text is one run, an empty one none."""

    def runs(w: Column) -> Column:
        last = F.greatest(F.size(w) - (width - 1), F.lit(1))
        return F.when(F.size(w) > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(w, i, F.lit(width)), " "))))

    return F.coalesce(let(words(F.lower(text)), runs), F.array().cast("array<string>"))


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Distinct 64-bit hashes of the same runs, without building them."""

    def runs(w: Column) -> Column:
        def run(i: Column) -> Column:
            return F.xxhash64(*(F.get(w, i + k) for k in range(width)))

        last = F.greatest(F.size(w) - width, F.lit(0))
        return F.when(F.size(w) > 0, F.array_distinct(F.transform(F.sequence(F.lit(0), last), run)))

    # words are hashed first: a run then hashes five numbers
    hashed = F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))
    return F.coalesce(let(hashed, runs), F.array().cast("array<bigint>"))
