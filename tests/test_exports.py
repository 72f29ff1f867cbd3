import io
import json
import pathlib
import random

import pandas
import pytest
from pyspark.sql import functions as F

from orderlens.plans import derived, metrics, workflow
from orderlens.sources import dimensions, exports, records, results
from orderlens.sources.exports import load_order_exports

FIXTURE = str(pathlib.Path(__file__).parent / "fixtures" / "orders_with_titles.csv")


def plain(df):
    return [tuple(row) for row in df.collect()]


@pytest.fixture(scope="module")
def imported(spark):
    return workflow.import_orders(load_order_exports(spark, FIXTURE), year=2026)


def test_fixture_metrics(spark, imported):
    done = workflow.analyze(imported.orders, granularity="日")
    assert plain(done["summary"]) == [(2, 1, 3, 2320.0, 1160.0)]
    assert plain(done["trend"]) == [("2025-03-05", 1, 2230.0, 1), ("2025-03-08", 1, 90.0, 1)]
    assert plain(metrics.gmv_change(done["trend"]).select("change_text")) == [("-96.0%",)]
    assert plain(metrics.gmv_trend(imported.orders)) == [("2025-03", 2, 2320.0, 1)]
    assert plain(metrics.recommended_granularity(imported.orders)) == [("日",)]
    assert plain(done["categories"]) == [("未分类", 2, 2320.0, 6.0)]
    assert plain(done["users"]) == [("U31", "未知", "杭州", 2, 2320.0)]
    assert plain(done["repurchase"]) == [("未知", 1, 2.0, 2320.0, 100.0)]
    assert [(r[0], r[1], round(r[2], 2)) for r in plain(done["order_status"])] == [
        ("completed", 2, 66.67), ("refunded", 1, 33.33)]
    assert plain(done["high_value_orders"]) == []
    assert plain(done["flagged_orders"]) == [(0,)]
    assert plain(done["margin"]) == []
    assert plain(imported.missing_dimensions) == [("category（品类维度）",)]
    assert plain(imported.findings) == []
    assert plain(metrics.order_counts(imported.orders)) == [(4, 3)]
    assert not imported.has_user_level


def test_fixture_file_facts_and_preview(spark):
    export = load_order_exports(spark, FIXTURE)
    facts = export.files.first()
    assert (facts["encoding"], facts["delimiter"], facts["header_row"], facts["rows"], facts["columns"]) == (
        "utf-8-sig", ",", 3, 4, 10)
    assert export.preview(2).count() == 2


def write(folder, name, text, code="utf-8"):
    (folder / name).write_bytes(text.encode(code))
    return str(folder / name)


def rows_of(export):
    data = export.rows.orderBy("_row").drop("_row")
    return data.columns, plain(data)


def test_gb18030_with_titles(spark, tmp_path):
    path = write(tmp_path, "o.csv", "订单报表,,,\n统计周期：本周,,,\n订单号,支付时间,实付金额,订单状态\nA1,2026-07-01,99,交易成功\n", "gb18030")
    export = load_order_exports(spark, path)
    assert export.files.first()["encoding"] == "gb18030"
    assert export.files.first()["header_row"] == 3
    assert rows_of(export) == (["订单号", "支付时间", "实付金额", "订单状态"], [("A1", "2026-07-01", "99", "交易成功")])


def test_unpadded_titles_bom_and_other_delimiters(spark, tmp_path):
    text = "导出\n\n订单号;实付金额;备注\nA1;99;\"x;y\"\n订单号;实付金额;备注\nA2;1;\n"
    export = load_order_exports(spark, write(tmp_path, "o.csv", text, "utf-8-sig"))
    # The header is the later of two equally good rows, so that only what follows it is data.
    assert rows_of(export) == (["订单号", "实付金额"], [("A2", "1")])


def test_repeated_header_rows_beyond_the_search_window(spark, tmp_path):
    body = "".join(f"A{i};{i}\n" for i in range(40))
    text = "订单号;实付金额\n" + body + "订单号;实付金额\nB;2\n"
    columns, rows = rows_of(load_order_exports(spark, write(tmp_path, "o.csv", text)))
    assert columns == ["订单号", "实付金额"] and len(rows) == 41 and rows[-1] == ("B", "2")


def test_repeated_names_are_renamed_and_keep_header_rows(spark, tmp_path):
    body = "".join(f"A{i},{i},x\n" for i in range(40))
    text = "订单号,实付金额,实付金额\n" + body + "订单号,实付金额,实付金额\n"
    columns, rows = rows_of(load_order_exports(spark, write(tmp_path, "o.csv", text)))
    assert columns == ["订单号", "实付金额", "实付金额_2"] and len(rows) == 41


def test_empty_columns_rows_and_overlong_lines(spark, tmp_path):
    text = "订单号,实付金额,空,\nA1,5,NULL,\n,,,\nA2,6,,,,,extra\nA3,7,,z\n"
    columns, rows = rows_of(load_order_exports(spark, write(tmp_path, "o.csv", text)))
    assert columns == ["订单号", "实付金额", "未命名列_4"]
    assert rows == [("A1", "5", None), ("A3", "7", "z")]


def test_overlong_lines_are_counted(spark, tmp_path):
    text = "订单号,实付金额\nA1,5\nA2,6,x,y\nA3,7\n"
    facts = load_order_exports(spark, write(tmp_path, "o.csv", text)).files.first()
    assert (facts["rows"], facts["malformed_lines"]) == (2, 1)


@pytest.mark.parametrize("blank", [",", '""', "NULL,", " , ", '"",NaN'])
def test_blank_lines_do_not_use_up_the_search_window(spark, tmp_path, blank):
    text = (blank + "\n") * 45 + "订单号,实付金额\nB1,7\n" + (blank + "\n") * 3 + "B2,8\n"
    columns, rows = rows_of(load_order_exports(spark, write(tmp_path, "o.csv", text)))
    assert columns == ["订单号", "实付金额"]
    assert [row for row in rows if (row[0] or "").strip()] == [("B1", "7"), ("B2", "8")]


def test_header_behind_many_empty_splits(spark, tmp_path):
    path = write(tmp_path, "o.csv", "\n" * 200_000 + "订单号,实付金额\nB1,7\nB2,8\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        assert rows_of(load_order_exports(spark, path)) == (["订单号", "实付金额"], [("B1", "7"), ("B2", "8")])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_that_cannot_be_read_are_named(spark, tmp_path):
    write(tmp_path, "good.csv", "订单号,实付金额\nA1,5\n")
    (tmp_path / "odd.csv").write_bytes(b"a,b\n\xff\xff\xff,1\n")
    with pytest.raises(ValueError, match="odd.csv"):
        load_order_exports(spark, str(tmp_path))
    (tmp_path / "odd.csv").write_bytes(b",,\n,,\n")
    with pytest.raises(ValueError, match="odd.csv"):
        load_order_exports(spark, str(tmp_path))
    write(tmp_path, "odd.csv", '订单号,实付金额\nA1,"第一行\n第二行\n')
    with pytest.raises(ValueError, match="odd.csv"):
        load_order_exports(spark, str(tmp_path))


def test_quotes_that_are_closed_or_inside_a_cell_are_kept(spark, tmp_path):
    text = '订单号,实付金额,备注\nA1,5,"a ""b"" c"\nA2,6,27" 屏\nA3,7,"""x"""\n'
    _, rows = rows_of(load_order_exports(spark, write(tmp_path, "o.csv", text)))
    assert [row[2] for row in rows] == ['a "b" c', '27" 屏', '"x"']


def pandas_rows(text, mark):
    frame = pandas.read_csv(io.StringIO(text), header=None, sep=mark, engine="python", dtype=object, keep_default_na=False)
    return [tuple(v or None for v in row) for row in frame.itertuples(index=False)]


@pytest.mark.parametrize("split, code", [(None, "utf-8"), ("2500", "gb18030")])
def test_line_breaks_in_quoted_cells_whatever_the_splits(spark, tmp_path, split, code):
    draw = random.Random(5)
    cells = ["a", "b c", '"x\ny"', '"第一行\n\n第三行"', '"say ""no"", then\n""yes"""', '27" 屏', '"p, q"', '"\n"', "", '"long' + "\nline" * 40 + '"']
    body = "".join(f"A{i},{i}," + draw.choice(cells) + "," + draw.choice(cells) + "\n" for i in range(120))
    text = '"导出\n报表",,,\n"订单\n编号",实付金额,备注,说明\n' + body
    path = write(tmp_path, "o.csv", text, code)
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        columns, rows = rows_of(load_order_exports(spark, path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = pandas_rows(text, ",")
    assert columns == list(want[1]) and columns[0] == "订单\n编号"
    assert rows == want[2:] and len(rows) == 120


def test_states_follow_a_reader_line_by_line(spark):
    draw = random.Random(9)
    lines = ["".join(draw.choice('",;ab') for _ in range(draw.randint(0, 7))) for _ in range(400)]
    marks = {",": 0, ";": 2}
    table = spark.createDataFrame([("f", n // 7, n, t) for n, t in enumerate(lines)], "file string, block bigint, line bigint, text string").select(
        "*", *records.quote_maps(F.col("text")))
    for mark in marks:
        found = {r["line"]: (r["before"], r["after"]) for r in records.line_states(table.withColumn("delimiter", F.lit(mark))).collect()}
        inside = False
        for n, text in enumerate(lines):
            before, at, fresh = inside, 0, not inside  # fresh: at the start of a cell
            while at < len(text):
                c = text[at]
                if inside:
                    if text[at:at + 2] == '""':
                        at += 1
                    elif c == '"':
                        inside = False
                elif c == '"' and fresh:
                    inside = True
                fresh = not inside and c == mark
                at += 1
            assert found[n] == (before, inside), (n, text, mark)


def test_a_stray_quote_over_too_many_lines_is_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "LONGEST_RECORD", 30)
    path = write(tmp_path, "o.csv", '订单号,实付金额\nA1,"5\n' + "A2,6\n" * 40 + 'A3,"7"\nA4,8\n')
    with pytest.raises(ValueError, match="o.csv"):
        load_order_exports(spark, path)


def test_names_of_any_kind_load_with_every_value(spark, tmp_path):
    names = ["订单号", "实付金额", "file", "_row", "_broken", "Remark", "remark", "REMARK", "a`b", "a.b", "cells", "position", "others", "`", "$x"]
    body = "".join(",".join(f"{n}{i}" for n in range(len(names))) + "\n" for i in range(3))
    export = load_order_exports(spark, write(tmp_path, "o.csv", ",".join(names) + "\n" + body), delimiter=",")
    columns, rows = rows_of(export)
    assert columns == ["订单号", "实付金额", "file", "_row_2", "_broken", "Remark", "remark_2", "REMARK_3", *names[8:]]
    assert rows == [tuple(f"{n}{i}" for n in range(len(names))) for i in range(3)]
    assert export.files.first()["columns"] == len(names)
    export.rows.write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_the_number_of_kept_lines_decides_between_delimiters(spark, tmp_path):
    text = "订单号甲;乙,丙实付金额\n" + "".join(f"O{i};{i},1,2,3\n" for i in range(50))
    export = load_order_exports(spark, write(tmp_path, "o.csv", text))
    assert export.files.first()["delimiter"] == ";" and export.files.first()["rows"] == 50
    columns, rows = rows_of(export)
    assert columns == ["订单号甲", "乙,丙实付金额"] and rows[7] == ("O7", "7,1,2,3")


def test_many_layouts_in_one_folder(spark, tmp_path):
    for n in range(500):
        write(tmp_path, f"f{n:03}.csv", f"订单号,实付金额,列{n},备注{n % 7}\nA{n},{n},x{n},\nB{n},{n},,y{n}\n")
    export = load_order_exports(spark, str(tmp_path), others_as_map=True)
    assert export.rows.columns == ["_row", "order_id", "total_amount", "other_columns"]
    rows = {r["order_id"]: (r["total_amount"], r["other_columns"]) for r in export.rows.collect()}
    assert len(rows) == 1000
    assert all(rows[f"A{n}"] == (str(n), {f"列{n}": f"x{n}"}) and rows[f"B{n}"] == (str(n), {f"备注{n % 7}": f"y{n}"}) for n in range(500))
    assert [r["columns"] for r in export.files.select("columns").distinct().collect()] == [4]
    assert len(export.rows._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_loading_runs_no_python(spark, tmp_path):
    write(tmp_path, "a.csv", "订单号,实付金额\nA1,5\n", "gb18030")
    write(tmp_path, "b.csv", "订单号,实付金额\nA2,6\n")
    lines = exports.scan_lines(spark, str(tmp_path))
    found = exports.detect_encodings(lines)
    assert {r["encoding"] for r in found.collect()} == {"gb18030", "utf-8-sig"}
    with exports._java_charsets(spark):
        plan = lines.groupBy("file").agg(F.bool_and(exports._readable("gbk")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and spark.conf.get("spark.sql.legacy.javaCharsets") == "false"


def test_columns_with_one_name_are_merged(spark, tmp_path):
    text = "订单号,order_id,实付金额\n,K1,5\nH2,K2,6\n"
    export = load_order_exports(spark, write(tmp_path, "o.csv", text), standard_names=True)
    assert plain(export.rows.orderBy("_row").select("order_id", "total_amount")) == [("K1", "5"), ("H2", "6")]


def test_a_mark_inside_a_cell_stays(spark, tmp_path):
    text = "\ufeff订单号,实付金额,备注\nA1,5,a\ufeffb\n"
    columns, rows = rows_of(load_order_exports(spark, write(tmp_path, "o.csv", text)))
    assert columns[0] == "订单号" and rows == [("A1", "5", "a\ufeffb")]


def test_big5_needs_to_be_named(spark, tmp_path):
    path = write(tmp_path, "o.csv", "訂單,金額\nA1,測試\n", "big5")
    assert rows_of(load_order_exports(spark, path, encoding="big5", delimiter=",")) == (
        ["訂單", "金額"], [("A1", "測試")])


def test_unknown_encoding_and_empty_input(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b"a,b\n\xff\xff\xff,1\n")
    with pytest.raises(ValueError):
        load_order_exports(spark, str(tmp_path / "x.csv"))
    (tmp_path / "e.csv").write_bytes(b"\n\n")
    with pytest.raises(ValueError):
        load_order_exports(spark, str(tmp_path / "e.csv"))


def test_files_with_different_layouts_line_up(spark, tmp_path):
    write(tmp_path, "a.csv", "订单号,实付金额,状态\nA1,5,已完成\n")
    write(tmp_path, "b.csv", "标题;;\n交易状态;订单编号;支付金额\n已取消;B1;7\n", "gb18030")
    columns, rows = rows_of(load_order_exports(spark, str(tmp_path), standard_names=True))
    found = sorted(tuple(dict(zip(columns, row))[c] for c in ("order_id", "total_amount", "status")) for row in rows)
    assert found == [("A1", "5", "已完成"), ("B1", "7", "已取消")]


def test_small_splits_give_the_same_rows(spark, tmp_path):
    body = "".join(f"A{i},{i},商品{i}\n" for i in range(3000))
    path = write(tmp_path, "o.csv", "导出,,\n订单号,实付金额,商品名称\n" + body)
    whole = rows_of(load_order_exports(spark, path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        split = rows_of(load_order_exports(spark, path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert split == whole and len(whole[1]) == 3000 and whole[1][17] == ("A17", "17", "商品17")


def test_export_without_amount_is_refused(spark, tmp_path):
    export = load_order_exports(spark, write(tmp_path, "o.csv", "订单号,状态\nA1,已完成\n"))
    with pytest.raises(ValueError, match="no_amount"):
        workflow.import_orders(export)


def test_confirmed_mapping_replaces_the_suggestion(spark, tmp_path):
    export = load_order_exports(spark, write(tmp_path, "o.csv", "订单号,实付金额,另付\nA1,5,9\n"))
    done = workflow.import_orders(export, {"order_id": "订单号", "total_amount": "另付"})
    assert plain(done.orders.select("order_id", "total_amount")) == [("A1", 9.0)]
    assert "实付金额" in done.orders.columns


def test_dimensions_and_views(spark, tmp_path, imported):
    (tmp_path / "p.csv").write_text("product_id,product_name,category,brand,price,cost\nSKU01,甲,数码,B,5,3\n", "utf-8-sig")
    products = dimensions.load_products(spark, str(tmp_path / "p.csv"))
    assert plain(products) == [("SKU01", "甲", "数码", "B", 5.0, 3.0)]
    dimensions.register_views(imported.orders, spark.createDataFrame([("SKU01",)], "product_id string"))
    assert plain(spark.sql("SELECT product_name, category, cost FROM products")) == [("unknown", "未分类", None)]
    assert spark.sql("SELECT * FROM users").count() == 0
    assert spark.sql("SELECT count(*) FROM orders").first()[0] == 4
    (tmp_path / "u.csv").write_text("user_id,username,gender,age,city,user_level,registration_date\nU1,a,F,28,上海,普通,2025-03-05\n", "utf-8-sig")
    assert dimensions.load_users(spark, str(tmp_path / "u.csv")).first()["age"] == 28


def test_json_results(spark, tmp_path):
    df = spark.sql("SELECT 1 AS a, double('NaN') AS b, timestamp_ntz'2026-07-01 10:00:00' AS t, cast(null as string) AS n")
    assert json.loads(results.json_records(df).first()[0]) == {"a": 1, "b": None, "t": "2026-07-01T10:00:00", "n": None}
    results.write_results({"one": df, "two": df.select("a")}, str(tmp_path / "out"))
    assert (tmp_path / "out" / "section=two").exists()


def test_masking_and_display(spark, imported):
    done = workflow.analyze(imported.orders)
    masked = derived.mask_users(done, user_missing=True)
    assert masked["summary"].first()["unique_users"] is None
    assert masked["users"].columns == ["message"]
    assert derived.mask_users(done, user_missing=False)["users"] is done["users"]
    shown = derived.display(done["categories"], "categories")
    assert plain(shown) == [("未分类", 2, "¥2,320.00", 6.0)] and shown.columns == ["品类", "订单数", "销售额 GMV", "销量"]


def test_user_view(spark, imported):
    levels = spark.createDataFrame([("金卡", 2, 1.0, 5.0)], "user_level string, users int, avg_orders double, avg_spend double")

    def view(df, missing, has_level):
        return derived.user_view(df, missing, has_level).first()[0]

    assert view(levels, True, True) == "unavailable"
    assert view(levels, False, True) == "levels"
    assert view(levels, False, False) == "consumption"
    assert view(levels.withColumn("avg_spend", F.lit(0.0)), False, True) == "consumption"
    assert view(levels.withColumn("user_level", F.lit("未知")), False, True) == "consumption"
    assert view(levels.limit(0), False, True) == "consumption"
