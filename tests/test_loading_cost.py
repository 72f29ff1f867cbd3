"""What the loader leaves out, and that this changes no result."""

import contextlib
import io
import pathlib

from pyspark.sql import functions as F

from orderlens import vocab
from orderlens.operators import headers
from orderlens.operators.staging import shared_folder
from orderlens.sources import records
from orderlens.sources.exports import load_order_exports


def test_widths_are_counted_only_where_delimiters_tie(spark):
    clear = [("clear", i, text) for i, text in enumerate(["订单号,实付金额", "O1,5", "O2,6"])]
    tie = [("tie", i, text) for i, text in enumerate(["订单号甲;乙,丙实付金额", "O1;5,1,2,3", "O2;6,1,2,3"])]
    head = spark.createDataFrame(clear + tie, "file string, line long, text string")
    asked = []

    def widths(tied):
        asked.extend(row["file"] for row in tied.collect())
        # Far more lines than the leading ones: all fit with ";", none with ",".
        return spark.createDataFrame([("tie", ";", 2, 1000), ("tie", ",", 4, 1000)], "file string, delimiter string, cells int, lines long")

    found = {row["file"]: row["delimiter"] for row in headers.choose_delimiters(head, ["file"], "line", "text", widths=widths).collect()}
    assert asked == ["tie"]
    assert found == {"clear": ",", "tie": ";"}


def test_header_search_cuts_every_leading_line_once(spark):
    """The lines that fit were counted in a second pass with a join of its own."""
    head = spark.createDataFrame([("a", i, t) for i, t in enumerate(["x;订单号;实付金额", "1;2;3", "1;2;3;4"])], "file string, line long, text string")
    found = headers.choose_delimiters(head, ["file"], "line", "text")
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        found.explain()
    assert "Join" not in text.getvalue()
    assert found.select("delimiter", "width").collect() == [(";", 3)]


def test_plain_lines_are_cut_like_quoted_ones(spark):
    texts = ["a{0}b", "{0}", "{0}{0}a{0}", "", " a {0}N/A{0}x.y*z", "a\\{0}b|,;\tc", "尾{0}"]
    rows = [(text.format(mark), mark) for text in texts for mark in vocab.DELIMITERS]
    df = spark.createDataFrame(rows, "text string, mark string")
    # A further quoted cell sends a line the other way.
    both = df.select("text", "mark", headers.split_cells(F.col("text"), F.col("mark")).alias("plain"), headers.split_cells(
        F.concat("text", "mark", F.lit('"q"')), F.col("mark")).alias("quoted"))
    for row in both.collect():
        assert row["quoted"] == [*row["plain"], "q"], row


def test_rows_by_place_in_files_of_other_order(spark, tmp_path):
    """Straight files, files in another order, short rows, doubled names and repeated headers give the same rows."""
    files = {"1.csv": "订单号,实付金额,备注\nO1,1,a\nO2,2\n订单号,实付金额,备注\n订单号,3,c\n", "2.csv": "备注,订单号,实付金额\nb,O3,4\nb,O4,5,6\n",
             "3.csv": "订单号,实付金额,order_id\n,7,K5\nO6,8,K6\n"}
    lines = "\n".join(f"O{n},9,z" for n in range(100, 140))
    files["1.csv"] = files["1.csv"].replace("订单号,实付金额,备注\n订单号,3", f"{lines}\n订单号,实付金额,备注\n订单号,3")
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    export = load_order_exports(spark, str(tmp_path), standard_names=True)
    rows = {tuple(r) for r in export.rows.select("order_id", "total_amount", "备注").collect()}
    assert rows == {("O1", "1", "a"), ("O2", "2", None), ("订单号", "3", "c"), ("O3", "4", "b"), ("K5", "7", None), ("O6", "8", None),
                    *((f"O{n}", "9", "z") for n in range(100, 140))}
    assert export.files.agg(F.sum("malformed_lines")).first()[0] == 1


def test_an_encoding_is_tried_only_where_the_one_before_fails(spark, tmp_path):
    (tmp_path / "u.csv").write_text("﻿订单号,实付金额\nO1,1\n", encoding="utf-8")
    (tmp_path / "g.csv").write_bytes("订单号,实付金额\nO2,2\n".encode("gb18030"))
    export = load_order_exports(spark, str(tmp_path))
    assert {r["encoding"] for r in export.files.collect()} == {"utf-8-sig", "gb18030"}
    assert {tuple(r) for r in export.rows.drop("_row").collect()} == {("O1", "1"), ("O2", "2")}


def test_written_lines_go_and_rows_stay(spark, tmp_path):
    """Lines and rows lay beside each other, with all cells of a row in one column, and small splits cut the written tables too."""
    (tmp_path / "a.csv").write_text('订单号,实付金额,备注\nO1,1,"a\nb"\nO2,2,\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("订单号,实付金额\nO3,3\n", encoding="utf-8")
    folder = pathlib.Path(shared_folder(spark).removeprefix("file:"))
    before, key = set(folder.iterdir()), "spark.sql.files.maxPartitionBytes"
    spark.conf.set(key, "64k")
    try:
        export = load_order_exports(spark, str(tmp_path))
        assert spark.conf.get(key) == "64k"
    finally:
        spark.conf.unset(key)
    kinds = {path.name.split("-")[1] for path in set(folder.iterdir()) - before}
    assert "rows" in kinds and "lines" not in kinds
    assert {tuple(r) for r in export.rows.drop("_row").collect()} == {("O1", "1", "a\nb"), ("O2", "2", None), ("O3", "3", None)}
    assert sorted(r["rows"] for r in export.files.collect()) == [1, 2]


def test_lines_with_breaks_are_shuffled_once(spark):
    """They were sorted twice for their states, and again for the records, with their texts."""
    lines = spark.createDataFrame([("f", 0, 0, 'a,"b', 1, 0), ("f", 0, 1, "c", 0, 1), ("f", 9, 9, 'd",e', 0, 0), ("f", 9, 10, "g,h", 0, 1)],
                                  "file string, block int, line long, text string, opens int, stays int")
    states = records.line_states(lines.withColumn("delimiter", F.lit(",")))
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        states.explain()
    assert "Window" not in text.getvalue()
    assert sorted((r["line"], r["text"]) for r in records.records(states).collect()) == [(0, 'a,"b\nc\nd",e'), (10, "g,h")]
