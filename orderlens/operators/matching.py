"""Matching of column names with standard fields.

All functions are column expressions over one name or over an array of names, so they run
next to the data for any number of files.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions import looks_numeric, normalize_name, strip
from ..functions.text import normalized_literal

_ALIASES = {
    field: sorted({normalized_literal(alias) for alias in aliases})
    for field, aliases in vocab.FIELD_ALIASES.items()
}


# A name that neither contains an alias nor lies inside one scores zero for every field. The
# tests below find such names cheaply: digits occur in no alias, and an alias with wide
# characters needs a name with wide characters.
_ALL = sorted({alias for aliases in _ALIASES.values() for alias in aliases})
_LONGEST = max(map(len, _ALL))
_ALL_TEXT = "\n".join(_ALL)  # a normalised name holds no line break
_NARROW = "|".join(re.escape(alias) for alias in _ALL if alias.isascii())
_WIDE = "|".join(re.escape(alias) for alias in _ALL if not alias.isascii())


def _promising(name: Column) -> Column:
    inside = F.length(name).between(3, _LONGEST) & ~name.rlike(r"\d") & F.lit(_ALL_TEXT).contains(name)
    return inside | name.rlike(_NARROW) | (name.rlike(r"[^\x00-\x7f]") & name.rlike(_WIDE))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def match_score(name: Column, field: str) -> Column:
    """How well an already normalised name matches a field: 0 to 100.

    An exact alias scores 100. Otherwise longer overlaps score higher, and an alias inside
    the name counts for more than the name inside an alias.
    """
    aliases = _ALIASES[field]
    # A literal array; one split text needs far fewer calls to build than one literal each.
    longer = F.split(F.lit("\n".join(alias for alias in aliases if len(alias) >= 2)), "\n")

    def capped(text: Column) -> Column:
        return F.least(F.length(text), F.lit(vocab.SCORE_LENGTH_CAP))

    def overlap(alias: Column) -> Column:
        return F.when(name.contains(alias), capped(alias) + vocab.ALIAS_IN_NAME_BASE).when(
            (F.length(name) >= 3) & alias.contains(name), capped(name) + vocab.NAME_IN_ALIAS_BASE
        ).otherwise(F.lit(0))

    best = F.array_max(F.transform(longer, overlap))
    if field == "unit_price":
        best = F.when(name.contains("金额") & ~name.contains("单价"), F.lit(0)).otherwise(best)
    if field == "total_amount":
        best = F.when(name.contains("单价") | name.contains("价格"), F.lit(0)).otherwise(best)
    exact = F.lit(vocab.EXACT_SCORE)
    return F.when(name == "", F.lit(0)).when(name.isin(*aliases), exact).otherwise(best)


def _scores(name: Column) -> Column:
    """Scores of a normalised name for all fields, as structs (score, rank, field).

    ``rank`` falls in field order, so the largest struct is the best field and the earlier
    field wins a tie.
    """
    return F.array(*[
        F.struct(match_score(name, field).alias("score"), F.lit(-position).alias("rank"),
                 F.lit(field).alias("field"))
        for position, field in enumerate(vocab.STANDARD_FIELDS)
    ])


def field_scores(column_name: Column) -> Column:
    """Scores of one column name for all fields."""
    return _let(normalize_name(column_name), _scores)


def header_score(cells: Column) -> Column:
    """Struct (score, matched): how much a row of cells looks like a header.

    Most cells below a header cannot match any field; one regular expression leaves them out
    before the scores are computed.
    """
    def hits(filled: Column) -> Column:
        """Best match of each cell that can match at all."""
        names = F.filter(F.transform(filled, normalize_name), _promising)
        return F.transform(names, lambda name: F.array_max(_scores(name)))

    def points(filled: Column, best: Column) -> Column:
        accepted = F.filter(best, lambda match: match["score"] >= vocab.ACCEPT_SCORE)
        matched = F.size(F.array_distinct(F.transform(accepted, lambda match: match["field"])))
        exact = F.size(F.filter(best, lambda match: match["score"] == vocab.EXACT_SCORE))
        text_cells = F.size(F.filter(filled, lambda cell: ~looks_numeric(cell)))
        score = (
            matched * vocab.HEADER_FIELD_POINTS
            + exact * vocab.HEADER_EXACT_POINTS
            + F.least(F.size(filled), F.lit(vocab.HEADER_CELL_CAP))
            + text_cells
        )
        return F.struct(
            F.when(F.size(filled) > 0, score).otherwise(F.lit(-1)).alias("score"),
            matched.alias("matched"))

    filled = F.filter(cells, lambda cell: strip(cell) != "")
    return _let(filled, lambda row: _let(hits(row), lambda best: points(row, best)))


def suggested_mapping(names: Column) -> Column:
    """Array of structs (score, source, field): the one-to-one mapping of column names.

    Candidates are taken from the best score down; each column and each field is used once.
    """
    candidates = F.flatten(F.transform(names, lambda name: F.transform(
        F.filter(field_scores(name), lambda match: match["score"] >= vocab.ACCEPT_SCORE),
        lambda match: F.struct(match["score"].alias("score"), name.alias("source"),
                               match["field"].alias("field")))))
    best_first = F.reverse(F.array_sort(candidates))

    def take(chosen: Column, candidate: Column) -> Column:
        clash = F.exists(chosen, lambda other: (other["source"] == candidate["source"])
                         | (other["field"] == candidate["field"]))
        return F.when(clash, chosen).otherwise(F.array_append(chosen, candidate))

    nothing = F.filter(best_first, lambda _: F.lit(False))
    return F.aggregate(best_first, nothing, take)


def suggest_mapping(headers: DataFrame, names: str = "names") -> DataFrame:
    """Suggested mapping for a table of headers (one array of names per row)."""
    others = headers.columns
    return headers.select(*others, F.inline(suggested_mapping(F.col(names)))).select(
        *others, "field", "source", "score")


def unique_names(cells: Column) -> Column:
    """Column names of a header row: blanks are numbered, repeats get a suffix."""
    base = F.transform(cells, lambda cell, i: F.coalesce(
        F.nullif(strip(cell), F.lit("")),
        F.concat(F.lit(vocab.UNNAMED_COLUMN), (i + 1).cast("string"))))

    def suffixed(names: Column) -> Column:
        def named(name: Column, i: Column) -> Column:
            earlier = F.size(F.filter(F.slice(names, 1, i), lambda other: other == name))
            return F.when(earlier == 0, name).otherwise(
                F.concat(name, F.lit("_"), (earlier + 1).cast("string")))
        return F.transform(names, named)

    return _let(base, suffixed)
