"""Order exports: directories of delimited text in mixed encodings, with title rows.

One scan tests the encodings, a second one decodes every line and writes it as a table of (file, block, line, text).
Position and text are data from then on, so every later step sees the same rows, large files stay split, and
the header search reads only the blocks that hold the first filled lines; what later steps ask of the blocks is counted once. Quoted
cells may go over lines and blocks (see ``records``). The lines are split into cells once, into a second written table, where a row
holds its cells by position, one column each: names of columns are facts about files and meet the rows last, so no name of a file can
clash with a column of the loader. The written lines are deleted when the rows are there.
"""

from __future__ import annotations

import re
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import vocab
from ..functions import strip
from ..operators.headers import cell_count, choose_delimiters, split_cells
from ..operators.joins import join_dimension
from ..operators.matching import suggested_mapping, unique_names
from ..operators.staging import DENSE, discard, stage, stage_observed
from ..plans.clean import ROW
from . import records

OTHERS = "other_columns"
_LINE_BITS = 44      # a row position is the file number and the offset in the file, up to 16 TiB
_NAMED = 20          # so many files are named in an error
_UTF8 = vocab.ENCODINGS[0]
_BOM = chr(0xFEFF)
_REPLACEMENT = chr(0xFFFD)
_SPLIT_BYTES = 16 * 1024 * 1024
_HEAD_LINES = 3000   # leading lines that are put together to records for the header search, in files with line breaks in cells


def _blank_line() -> str:
    """Pattern of lines whose cells are all empty, blank or words for a missing value, whatever the delimiter."""
    marks = "".join("\\t" if mark == "\t" else f"\\{mark}" for mark in vocab.DELIMITERS)
    words = "|".join(re.escape(word) for word in sorted(vocab.MISSING_CELLS, key=len, reverse=True) if word)
    cell = rf'[^\S\t]*+"?+[^\S\t]*+(?:{words})?+[^\S\t]*+"?+[^\S\t]*+'
    return rf"^{_BOM}?+{cell}(?:[{marks}]{cell})*+$"


@dataclass(frozen=True)
class Export:
    """Rows of an export with its own column names, and one row of facts per file."""

    rows: DataFrame
    files: DataFrame

    def preview(self, rows: int = vocab.PREVIEW_ROWS) -> DataFrame:
        return self.rows.drop(ROW).limit(rows)

    def suggestions(self) -> DataFrame:
        """Suggested mapping (field, source, score) for the columns of the export."""
        names = [c for c in self.rows.columns if c not in (ROW, OTHERS)]
        header = self.rows.sparkSession.range(1).select(F.array(*[F.lit(c) for c in names]).alias("names"))
        return header.select(F.inline(suggested_mapping(F.col("names")))).select("field", "source", "score")


@contextmanager
def _java_charsets(spark: SparkSession):
    """Within it, expressions take every character set that Java knows, and put a mark for bytes they cannot read."""
    wanted = {"spark.sql.legacy.javaCharsets": "true", "spark.sql.legacy.codingErrorAction": "true"}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@contextmanager
def _larger_splits(spark: SparkSession):
    """Within it, written tables are read in splits of _SPLIT_BYTES at least, however small the splits of the files are to be."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)b?", before.strip().lower()).groups()
    if int(number) << 10 * " kmgtp".index(unit or " ") < _SPLIT_BYTES:
        spark.conf.set(key, str(_SPLIT_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _readable(code: str) -> Column:
    """The bytes of a line are text in an encoding: none was replaced, or what stands there is the mark itself."""
    text = F.decode(F.col("bytes"), code)
    return ~text.contains(_REPLACEMENT) | (F.encode(text, code) == F.col("bytes"))


def scan_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, block, line, bytes``: all lines as they lie in the files. Positions ascend within a file."""
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        (F.col("_metadata.file_block_start")
         + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).alias("line"),
        F.col("value").cast("binary").alias("bytes"))


def detect_encodings(lines: DataFrame) -> DataFrame:
    """Encoding per file with a filled line: the first of the known ones that can read every line of it.

    Only files that are not UTF-8 are decoded on trial, with one encoding after the other, and only those go on that the
    last one could not read. All of it runs in the JVM.
    """
    spark = lines.sparkSession
    present = lines.filter(F.octet_length(F.trim(F.col("bytes").cast("string"))) > 0)
    utf8 = stage(present.groupBy("file").agg(F.bool_and(F.is_valid_utf8(F.col("bytes").cast("string"))).alias("utf8")), "utf8")
    known = utf8.select("file", F.when(F.col("utf8"), F.lit(_UTF8)).alias("encoding"))
    with _java_charsets(spark):
        for code in vocab.ENCODINGS[2:]:
            left = known.filter("encoding IS NULL").select("file")
            if left.isEmpty():
                break
            tested = join_dimension(present, left, "file", "inner").groupBy("file").agg(F.bool_and(_readable(code)).alias("_reads"))
            known = stage(known.join(tested, "file", "left").select(
                "file", F.coalesce("encoding", F.when(F.col("_reads"), F.lit(code))).alias("encoding")), "encodings")
    return known


def land_text(lines: DataFrame, encodings: DataFrame) -> DataFrame:
    """``file, block, line, text, filled, opens, stays``: decoded lines, written once. Files without encoding are left out.

    A byte order mark is removed where it starts a line, as in files that were joined together.
    """
    known = join_dimension(lines, encodings.filter(F.col("encoding").isNotNull()), "file", "inner")
    with _java_charsets(lines.sparkSession):
        decoded = F.when(F.col("encoding").isin(_UTF8, "utf-8"), F.col("bytes").cast("string")).otherwise(F.expr("decode(bytes, encoding)"))
        decoded = known.select("file", "block", "line", decoded.alias("text"))
        text = decoded.withColumn("text", F.when(F.col("text").startswith(_BOM), F.substring("text", 2, 2 ** 31 - 1)).otherwise(F.col("text")))
        return stage(text.select("*", (~F.col("text").rlike(_blank_line())).alias("filled"), *records.quote_maps(F.col("text"))), "lines", DENSE)


def _block_facts(lines: DataFrame) -> DataFrame:
    """``file, block, lines, filled, opens``: one row per block, from one pass over the lines."""
    return stage(lines.groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if("filled").alias("filled"), F.max(F.col("opens") > 0).alias("opens")), "blocks")


def leading_lines(lines: DataFrame, rows: int = vocab.HEADER_SEARCH_ROWS, counted: str | None = "filled",
                  blocks: DataFrame | None = None) -> DataFrame:
    """First filled lines of every file, or with ``counted=None`` its first lines of any kind.

    Counts per block (``file, block, lines``; counted here if not given) tell how far a file must be read; the limit then applies
    within each task before any shuffle.
    """
    filled = lines.filter(counted) if counted else lines
    if blocks is None:
        blocks = filled.groupBy("file", "block").agg(F.count(F.lit(1)).alias("lines"))
    before = F.sum("lines").over(Window.partitionBy("file").orderBy("block")) - F.col("lines")
    until = stage(blocks.withColumn("_before", before).filter(F.col("_before") < rows).groupBy("file").agg(
        F.max("block").alias("_until")), "until")
    furthest = until.agg(F.max("_until")).first()[0]
    head = join_dimension(filled.filter(F.col("block") <= F.lit(furthest)), until, "file", "inner").filter(F.col("block") <= F.col("_until"))
    order = Window.partitionBy("file").orderBy("line")
    return head.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= rows).drop("_n", "_until", "filled")


def _leading_records(lines: DataFrame, marks: tuple[str, ...], blocks: DataFrame) -> DataFrame:
    """First filled records (``file, delimiter, line, text``) of files with line breaks in cells, with every delimiter."""
    head = leading_lines(lines, _HEAD_LINES, None, blocks)
    tried = head.withColumn("delimiter", F.explode(F.array(*[F.lit(mark) for mark in marks])))
    # A file and a delimiter are one stream here, and all of its leading lines one block.
    keyed = tried.withColumn("file", F.struct("file", "delimiter")).withColumn("block", F.lit(0))
    whole = records.records(records.line_states(keyed)).filter(~F.col("text").rlike(_blank_line()))
    order = Window.partitionBy("file").orderBy("line")
    return whole.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= vocab.HEADER_SEARCH_ROWS).select(
        "file.file", "file.delimiter", "line", "text")


def line_widths(lines: DataFrame, marks: tuple[str, ...] = vocab.DELIMITERS) -> DataFrame:
    """``file, delimiter, cells, lines``: how many filled lines of a file have how many cells with every delimiter."""
    counts = F.array(*[F.struct(F.lit(mark).alias("delimiter"), cell_count(F.col("text"), mark).alias("cells")) for mark in marks])
    return lines.filter("filled").select("file", F.inline(counts)).groupBy("file", "delimiter", "cells").agg(
        F.count(F.lit(1)).alias("lines"))


def _standard_names(names: Column) -> Column:
    """Names replaced by the standard fields that they suggest."""
    def standard(mapping: Column) -> Column:
        def replaced(name: Column) -> Column:
            match = F.get(F.filter(mapping, lambda m: m["source"] == name), F.lit(0))
            return F.coalesce(match["field"], name)
        return F.transform(names, replaced)

    return F.get(F.transform(F.array(suggested_mapping(names)), standard), F.lit(0))


def _straight(df: DataFrame, broken: DataFrame) -> DataFrame:
    """Rows of files without line breaks in cells."""
    return join_dimension(df, broken.withColumn("_broken", F.lit(True)), "file", "left").filter("_broken IS NULL").drop("_broken")


def _describe(lines: DataFrame, blocks: DataFrame, broken: DataFrame, encodings: DataFrame, delimiter: str | None) -> DataFrame:
    """One row per file: number, encoding, delimiter, header position and column names.

    ``broken`` lists the files that may have line breaks in cells. Their leading lines are put together to records first.
    """
    marks = (delimiter,) if delimiter else vocab.DELIMITERS
    straight = _straight(lines, broken)
    filled = _straight(blocks, broken).filter("filled > 0").select("file", "block", F.col("filled").alias("lines"))
    headers = choose_delimiters(leading_lines(straight, blocks=filled), ["file"], "line", "text", marks, widths=lambda tied: line_widths(
        join_dimension(straight, tied, "file", "inner"), marks))
    if not broken.isEmpty():
        head = _leading_records(join_dimension(lines, broken, "file", "inner"), marks, join_dimension(blocks, broken, "file", "inner"))
        headers = headers.unionByName(choose_delimiters(head, ["file"], "line", "text", marks))
    padded = F.concat("header_cells", F.array_repeat(
        F.lit(None).cast("string"), F.greatest(F.col("width") - F.size("header_cells"), F.lit(0))))
    # One row per file: as many as the driver lists when it plans the scan.
    number = F.row_number().over(Window.orderBy("file"))
    return headers.join(encodings, "file").select(
        "file", number.cast("bigint").alias("file_number"), "encoding", "delimiter", "header_position",
        "header_row", "matched_fields", "width", unique_names(padded).alias("names"))


def _refuse(files: DataFrame, reason: str) -> None:
    """Raise an error that names ``files``, if there are any."""
    named = [row["file"] for row in files.select("file").distinct().orderBy("file").limit(_NAMED + 1).collect()]
    if named:
        more = " and others" if len(named) > _NAMED else ""
        raise ValueError(f"{reason}: {', '.join(named[:_NAMED])}{more}")


def _whole_records(lines: DataFrame, broken: DataFrame, files: DataFrame) -> DataFrame:
    """``file, line, text`` of all records, with the delimiter of every file known."""
    texts = lines.filter(F.col("text") != "").select("file", "line", "text")
    if broken.isEmpty():
        return texts
    marked = join_dimension(lines, broken.join(files.select("file", "delimiter"), "file"), "file", "inner")
    states = records.line_states(marked)
    _refuse(records.unclosed(states), "a quote that is never closed, in")
    _refuse(records.overlong(states), f"a quoted cell of more than {records.LONGEST_RECORD} lines, in")
    whole = records.records(states).filter(F.col("text") != "")
    return whole if _straight(files, broken).isEmpty() else _straight(texts, broken).unionAll(whole)


def distinct_ignoring_case(names: list[str], taken: tuple[str, ...] = ()) -> list[str]:
    """Names that Spark can tell apart: of names that differ in case only, later ones get a number."""
    seen, found = {name.lower() for name in taken}, []
    for name in names:
        candidate, n = name, 2
        while candidate.lower() in seen:
            candidate, n = f"{name}_{n}", n + 1
        seen.add(candidate.lower())
        found.append(candidate)
    return found


def load_order_exports(spark: SparkSession, paths: str | list[str], *, encoding: str | None = None,
                       delimiter: str | None = None, standard_names: bool = False, others_as_map: bool = False) -> Export:
    """Read order exports: find encoding, delimiter and header of every file.

    Files may differ in all of these; their rows are lined up by column name. ``encoding``
    and ``delimiter`` replace detection. ``standard_names`` maps the columns of every file
    to standard fields before they are lined up, for files whose names differ; of several columns with one name, the
    leftmost value of a row counts. ``others_as_map`` does so too and puts all other columns in one, ``other_columns``, a map
    of names and values: then neither the plan nor the driver holds a name for each layout, however many there are.
    The rows carry their position, so that cleaning can keep the first of identical lines.

    Names are kept as they are. Of names that differ in case only, or that the position of the rows has, later ones get a number.
    Lines with more cells than the header are left out and counted per file as ``malformed_lines``. A quoted cell may hold line
    breaks, which become line feeds. Files that no known encoding reads, that hold no filled line, whose last quote is
    never closed, or with a cell of more than ``records.LONGEST_RECORD`` lines are refused by name.
    """
    lines = scan_lines(spark, paths)
    if encoding:
        present = lines.filter(F.octet_length(F.trim(F.col("bytes").cast("string"))) > 0)
        encodings = stage(present.select("file").distinct().withColumn("encoding", F.lit(encoding.lower())), "encodings")
    else:
        encodings = detect_encodings(lines)
    if encodings.isEmpty():
        raise ValueError("the files hold no lines")
    _refuse(encodings.filter("encoding IS NULL"), "in none of the known encodings; name the encoding of")
    lines = land_text(lines, encodings)
    with _larger_splits(spark):
        return _placed(spark, lines, encodings, delimiter, standard_names, others_as_map)


def _placed(spark: SparkSession, lines: DataFrame, encodings: DataFrame, delimiter: str | None, standard_names: bool,
            others_as_map: bool) -> Export:
    """The export of written ``lines``, which are deleted."""
    blocks = _block_facts(lines)
    broken = stage(blocks.filter("opens").select("file").distinct(), "broken")
    files = _describe(lines, blocks, broken, encodings, delimiter)
    renamed = _standard_names(F.col("names")) if standard_names or others_as_map else F.col("names")
    files = stage(files.withColumn("columns", renamed), "files")
    _refuse(encodings.join(files, "file", "left_anti"), "no filled line, so no header, in")

    if others_as_map:
        names = list(vocab.STANDARD_FIELDS)
    else:  # distinct column names over all files, in order of first appearance
        listed = files.select("file_number", F.posexplode("columns").alias("slot", "name"))
        first = listed.groupBy("name").agg(F.min(F.struct("slot", "file_number")).alias("at"))
        names = [row["name"] for row in first.orderBy("at", "name").select("name").collect()]
    wanted = F.array(*[F.lit(name) for name in names])
    others = F.array_distinct(F.filter("columns", lambda name: ~name.isin(*vocab.STANDARD_FIELDS))) if others_as_map else F.array().cast("array<string>")

    def slots(name: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size("columns") - 1), lambda i: F.get("columns", i) == name)

    named = F.filter(F.sequence(F.lit(0), F.size("names") - 1), lambda i: ~F.get("names", i).startswith(vocab.UNNAMED_COLUMN))
    layout = files.select("file", "file_number", "delimiter", "header_position", "width", "names", others.alias("others"),
                          F.transform(wanted, slots).alias("slots"), F.transform(others, slots).alias("other_slots"), named.alias("named"))
    # Where every name has one column at most, the cells of a row are its values, or they are taken by place.
    for slots_of in ("slots", "other_slots"):
        layout = layout.withColumn(f"{slots_of}_one", F.when(
            F.forall(slots_of, lambda of_name: F.size(of_name) <= 1), F.transform(slots_of, lambda of_name: F.get(of_name, F.lit(0)))))
    layout = layout.withColumn("straight", F.coalesce(
        F.col("slots_one") == F.sequence(F.lit(0), F.col("width") - 1), F.lit(False)) & (F.size("slots_one") == F.col("width")))

    whole = _whole_records(lines, broken, files)
    body = join_dimension(whole, layout, "file", "inner").filter(F.col("line") > F.col("header_position"))
    body = body.withColumn("cells", split_cells(F.col("text"), F.col("delimiter")))
    body = body.filter(F.exists("cells", lambda cell: cell.isNotNull()))
    same_text = F.forall(F.zip_with("names", "cells", lambda name, cell: (
        name.startswith(vocab.UNNAMED_COLUMN) | strip(F.coalesce(cell, F.lit(""))).eqNullSafe(name))), lambda same: same)
    # A row repeats the header only if its first named cell does, which settles it for almost all rows.
    first_named = F.get("named", F.lit(0))
    begins = F.coalesce(strip(F.coalesce(F.get("cells", first_named), F.lit(""))) == F.get("names", first_named), F.lit(False))
    malformed = F.size("cells") > F.col("width")

    def aligned(where: str) -> Column:
        """For every name the leftmost value of the row's columns that have it."""
        def value(of_name: Column) -> Column:
            return F.get(F.filter(F.transform(of_name, lambda slot: F.get("cells", slot)), lambda cell: cell.isNotNull()), F.lit(0))
        by_place = F.transform(f"{where}_one", lambda slot: F.get("cells", slot))
        general = F.when(F.col(f"{where}_one").isNotNull(), by_place).otherwise(F.transform(where, value))
        return F.when(F.col("straight"), F.col("cells")).otherwise(general) if where == "slots" else general

    fits = F.col("line") < (1 << _LINE_BITS)
    position = F.when(fits, F.shiftleft("file_number", _LINE_BITS).bitwiseOR(F.col("line"))).otherwise(
        F.raise_error(F.concat(F.lit("too large: "), "file")))
    entries = F.zip_with("others", aligned("other_slots"), lambda name, value: F.struct(name.alias("name"), value.alias("value")))
    rest = F.map_from_entries(F.filter(entries, lambda entry: entry["value"].isNotNull()))
    cells = body.select(
        position.alias("position"), "file", malformed.alias("malformed"), (~malformed & F.when(begins, same_text).otherwise(False)).alias("repeated"),
        F.when(~malformed, aligned("slots")).alias("values"), F.when(~malformed, rest).alias("rest"))
    value = [F.col(f"value_{i}") for i in range(len(names))]
    placed, counted = stage_observed(cells.select(
        "position", "file", "malformed", "repeated", "rest", *[F.get("values", F.lit(i)).alias(f"value_{i}") for i in range(len(names))]),
        "rows", {f"value_{i}": F.count(v) for i, v in enumerate(value)} or {"rows": F.count(F.lit(1))}, DENSE)
    kept = [i for i in range(len(names)) if counted.get(f"value_{i}")]
    discard(lines)
    held = [*kept, len(names)] if others_as_map else kept
    chosen = distinct_ignoring_case([*names, OTHERS], (ROW,)) if others_as_map else distinct_ignoring_case([names[i] for i in kept], (ROW,))
    shown = [*value, F.col("rest")]
    rows = placed.filter("NOT malformed AND NOT repeated").select(
        F.col("position").alias(ROW), *[shown[i].alias(chosen[i] if others_as_map else chosen[n]) for n, i in enumerate(held)])
    counts = placed.groupBy("file").agg(
        F.count_if(~F.col("malformed") & ~F.col("repeated")).alias("rows"),
        F.count_if(F.col("malformed")).alias("malformed_lines"))
    if others_as_map:
        filled = placed.select("file", F.explode(F.concat(F.map_keys("rest"), F.array_compact(
            F.array(*[F.when(v.isNotNull(), F.lit(name)) for v, name in zip(value, names)])))).alias("name"))
        columns = F.coalesce("columns_filled", F.lit(0)).cast("int")
        counts = counts.join(filled.groupBy("file").agg(F.count_distinct("name").alias("columns_filled")), "file", "left")
    else:
        columns = F.size(F.array_intersect("columns", F.array(*[F.lit(names[i]) for i in kept])))
    facts = files.join(counts, "file", "left").select(
        "file", F.lit("CSV").alias("file_type"), "encoding", F.lit(None).cast("string").alias("sheet"),
        "delimiter", "header_row", F.coalesce("rows", F.lit(0)).alias("rows"),
        F.coalesce("malformed_lines", F.lit(0)).alias("malformed_lines"), columns.alias("columns"))
    return Export(rows, facts)
