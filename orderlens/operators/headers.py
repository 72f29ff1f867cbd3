"""Location of delimiter and header row at the head of each file."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import vocab
from ..functions import strip
from .matching import header_score
from .staging import stage


def _quoted_cells(line: Column, mark: str) -> Column:
    """The cells of a line with one delimiter, quotes included."""
    escaped = "\\" + mark if mark == "|" else mark
    pattern = rf'{escaped}("[^"]*+(?:""[^"]*+)*+"[^{escaped}]*|[^{escaped}]*)'
    return F.regexp_extract_all(F.concat(F.lit(mark), line), F.lit(pattern), F.lit(1))


def cell_count(line: Column, mark: str) -> Column:
    """Number of cells of a line; only lines with quotes have to be cut for it."""
    plain = F.length(line) - F.length(F.replace(line, F.lit(mark), F.lit(""))) + 1
    return F.when(line.contains('"'), F.size(_quoted_cells(line, mark))).otherwise(plain)


def ends_inside(line: Column, mark: str) -> Column:
    """The line ends inside a quoted cell that it opened. A line that starts inside one is a line with a quote before it."""
    escaped = "\\" + mark if mark == "|" else mark
    quoted = r'"[^"]*+(?:""[^"]*+)*+'
    return line.rlike(rf'(?s)^(?:(?:{quoted}"[^{escaped}]*+|[^"{escaped}][^{escaped}]*+|){escaped})*+{quoted}$')


def split_cells(line: Column, delimiter: Column) -> Column:
    """Cells of a delimited line; missing-value words and empty cells become NULL.

    A cell may be quoted, with doubled quotes and line breaks inside. Each delimiter has a pattern of its
    own, and only the pattern of the line's delimiter is applied.
    """
    def of_mark(mark: str) -> Column:
        plain_split = F.split(line, "\\" + mark if mark == "|" else mark, -1)
        return F.when(line.contains('"'), _quoted_cells(line, mark)).otherwise(plain_split)

    raw = reduce(lambda rest, mark: F.when(delimiter == mark, of_mark(mark)).otherwise(rest),
                 reversed(vocab.DELIMITERS[:-1]), of_mark(vocab.DELIMITERS[-1]))

    def plain(cell: Column) -> Column:
        inner = F.regexp_replace(cell, r'(?s)^"(.*)"([^"]*)$', "$1$2")
        text = F.when(cell.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(cell)
        return F.when(~text.isin(*vocab.MISSING_CELLS), text)

    return F.transform(raw, plain)


def filled_count(cells: Column) -> Column:
    return F.size(F.filter(cells, lambda cell: strip(cell) != ""))


def find_headers(head: DataFrame, keys: list[str], position: str, cells: str) -> DataFrame:
    """Header row of each group of leading rows.

    ``head`` holds a bounded number of rows per group (the search window). Among rows that
    match at least two fields the best score wins, the later row on a tie. If there is none,
    the names are unfamiliar: then the first row with two cells whose next rows have about
    as many cells, else the first row with two cells, else the first row.

    Returns one row per group: position and cells of the header, its 1-based row number
    among the leading rows, score and number of matched fields, the width and how many of the leading rows fit it.
    """
    group = Window.partitionBy(*keys).orderBy(position)
    rows = head.withColumns({
        "_score": header_score(F.col(cells)), "_filled": filled_count(F.col(cells)),
    }).withColumn("_index", F.row_number().over(group))
    following = [F.lead("_filled", k).over(group) for k in (1, 2, 3)]
    rows = rows.withColumn("_next", F.filter(F.array(*following), lambda n: n > 0))
    similar = F.size(F.filter("_next", lambda n: F.abs(n - F.col("_filled")) <= 1))
    steady = (F.size("_next") > 0) & (similar >= F.greatest(F.lit(1), F.size("_next") - 1))
    wide = F.col("_filled") >= 2
    rank = F.struct(
        F.when(F.col("_score.matched") >= 2, 3).when(wide & steady, 2).when(wide, 1).otherwise(0).alias("kind"),
        F.when(F.col("_score.matched") >= 2, F.col("_score.score")).otherwise(0).alias("score"),
        F.when(F.col("_score.matched") >= 2, F.col("_score.matched")).otherwise(0).alias("matched"),
        F.when(F.col("_score.matched") >= 2, F.col("_index")).otherwise(-F.col("_index")).alias("order"),
    )
    chosen = F.max_by(F.struct(
        F.col(position).alias("position"), F.col(cells).alias("cells"), F.col("_index").alias("row"),
        F.col("_score.score").alias("score"), F.col("_score.matched").alias("matched")), rank)
    return rows.groupBy(*keys).agg(chosen.alias("_header"), F.collect_list(
        F.struct("_index", F.size(cells).alias("cells"))).alias("_sizes")).select(
        *keys,
        F.col("_header.position").alias("header_position"),
        F.col("_header.cells").alias("header_cells"),
        F.col("_header.row").alias("header_row"),
        F.col("_header.score").alias("header_score"),
        F.col("_header.matched").alias("matched_fields"),
        # Widest row up to the header: later lines with more cells are malformed.
        F.array_max(F.transform(
            F.filter("_sizes", lambda s: s["_index"] <= F.col("_header.row")), lambda s: s["cells"])
        ).alias("width"), "_sizes",
    ).withColumn("fitting_rows", F.size(F.filter("_sizes", lambda s: s["cells"] <= F.col("width"))).cast("bigint")).drop("_sizes")


def choose_delimiters(head: DataFrame, keys: list[str], position: str, line: str,
                      delimiters: tuple[str, ...] = vocab.DELIMITERS, *,
                      widths: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Delimiter and header of each group of leading lines.

    Every delimiter is tried; the one whose header matches most fields wins, then the best header score, then the number
    of lines it keeps (up to a cap), then the width closest to a typical export, then the order of the list.
    ``head`` may hold a column ``delimiter`` already, if lines differ by delimiter. ``widths`` counts the lines of given groups by
    delimiter and number of cells (columns of ``keys``, ``delimiter, cells, lines``); without it the leading lines count. It is
    asked only for groups in which the headers of several delimiters are of equal worth; for others the counts decide nothing.
    """
    # Scoring costs far more than the few leading lines weigh: a fixed number of partitions
    # keeps adaptive execution from merging them by size. The later grouping reuses it.
    partitions = int(head.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    head = head.repartition(partitions, *keys)
    if "delimiter" not in head.columns:
        head = head.select(*keys, position, line, F.explode(F.array(*[F.lit(mark) for mark in delimiters])).alias("delimiter"))
    cells = head.withColumn("_cells", split_cells(F.col(line), F.col("delimiter")))
    filled = cells.filter(filled_count(F.col("_cells")) > 0)
    found = find_headers(filled.drop(line), [*keys, "delimiter"], position, "_cells")
    if widths is None:
        scored = found.withColumn("_kept", F.least("fitting_rows", F.lit(vocab.DELIMITER_ROW_CAP)))
    else:
        found = stage(found, "headers")
        worth = F.struct("matched_fields", "header_score")
        tied = found.withColumn("_best", worth == F.max(worth).over(Window.partitionBy(*keys))).groupBy(*keys).agg(
            F.count_if("_best").alias("_equal")).filter("_equal > 1").select(*keys)
        limits = found.select(*keys, "delimiter", "width")
        kept = widths(stage(tied, "tied")).join(limits, [*keys, "delimiter"]).filter(F.col("cells") <= F.col("width")).groupBy(
            *keys, "delimiter").agg(F.least(F.sum("lines"), F.lit(vocab.DELIMITER_ROW_CAP)).alias("_kept"))
        scored = found.join(kept, [*keys, "delimiter"], "left")
    order = F.array_position(F.array(*[F.lit(mark) for mark in delimiters]), F.col("delimiter"))
    quality = F.struct(
        "matched_fields", "header_score", F.coalesce("_kept", F.lit(0)),
        -F.abs(F.col("width") - vocab.DELIMITER_TYPICAL_COLUMNS), -order)
    values = ["delimiter", "header_position", "header_cells", "header_row", "header_score",
              "matched_fields", "width"]
    best = F.max_by(F.struct(*values), quality).alias("_best")
    return scored.groupBy(*keys).agg(best).select(*keys, "_best.*")
