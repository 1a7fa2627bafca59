"""Operators on small fixtures, with results written by hand."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import catalog, extract, files, history, messages, numbering, orders, zipcodes
from tallyloom.plans import chats as plans
from tallyloom.sources import chats as lines
from tallyloom.sources.schemas import OUTPUT_COLUMNS
from tallyloom.sources.settings import Settings
from tallyloom.sources.stock import read_catalog, read_stock
from tallyloom.sources.xlsx import read_xlsx, write_xlsx
from tallyloom.streaming import chats as streams


def values(spark, fn, given):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v string")
    return [r[0] for r in rows.select("i", fn(F.col("v")).alias("made")).orderBy("i").select("made").collect()]


def test_white_space(spark):
    assert values(spark, text.collapse, [" a\t\n b 　c\x1cd ", "", None, "　"]) == ["a b c d", "", None, ""]
    assert values(spark, text.strip, ["　 a  b\t\n", None]) == ["a  b", None]


def test_phone(spark):
    given = ["01012345678", "010 1234 5678", "+82 10-1234-5678", "02-123-4567", None, ""]
    assert values(spark, text.phone, given) == ["010-1234-5678", "010-1234-5678", *given[2:]]


def test_zip_code(spark):
    assert values(spark, text.zip_code, [None, "  ", "6234", "123-456", "abc", " 　"]) == ["", "", "06234", "123456", "abc", ""]


def test_names(spark):
    prefix = "다(x)_"
    given = ["다(x)_kim.csv", "다(x)_.csv", "kim_2026-03-12-10-17-22.jsonl", "_2026-03-12-10-17-22.jsonl"]
    assert values(spark, lambda c: text.chat_name(c, prefix), given) == ["kim", "", "kim", None]
    assert values(spark, text.file_time, ["a_2026-03-12-10-17-22.jsonl", "a.csv"]) == [datetime.datetime(2026, 3, 12, 10, 17, 22), None]
    with pytest.raises(Exception, match="2026-13"):
        values(spark, text.file_time, ["a_2026-13-12-10-17-22.jsonl"])
    assert values(spark, lambda c: text.file_time(c, strict=False), ["a_2026-13-12-10-17-22.jsonl"]) == [None]
    assert values(spark, lambda c: text.nickname(c, "P_"), ["/x/P_kim.csv", "kim.csv"]) == ["kim", "kim"]
    assert values(spark, text.live_label, ["2026-03-12T10:17:22", None, ""]) == ["2026-03-12 10:17", "-", "-"]


@pytest.mark.parametrize("slot", [numbering.SLOT, 1, 2])
def test_numbers_cross_slots(spark, monkeypatch, slot):
    monkeypatch.setattr(numbering, "SLOT", slot)
    ords = [5, 1, 1 << 20, (1 << 20) + 3, 1 << 40, 70_000, -(1 << 62), (1 << 62) + 1, 1 << 62]
    rows = spark.createDataFrame([(o, "ab"[o % 2]) for o in ords], "ord long, g string")
    assert {r["ord"]: r["n"] for r in numbering.numbered(rows, "ord").collect()} == {o: i + 1 for i, o in enumerate(sorted(ords))}
    within = {r["ord"]: r["n"] for r in numbering.numbered(rows, "ord", within=("g",)).collect()}
    assert within == {o: 1 + sum(p < o and p % 2 == o % 2 for p in ords) for o in ords}
    assert numbering.numbered(rows.limit(0), "ord").collect() == []


def test_uploads(spark):
    rows = spark.createDataFrame([("a.csv", b"1", 0), ("b.csv", b"1", 1), ("a.csv", b"2", 2), ("a.csv", b"1", 3), ("c", b"", 4), ("c", b"x", 5)], "name string, content binary, ord long")
    made = sorted((r["position"], r["display"], r["ord"]) for r in files.deduplicate_uploads(rows).collect())
    assert made == [(1, "a(1).csv", 0), (2, "a(2).csv", 2), (3, "b.csv", 1), (4, "c(1)", 4), (5, "c(2)", 5)]


def test_catalog(spark):
    given = [("A", "x"), ("B", None), ("A ", "y"), ("　A", "x"), (None, "z"), ("nan", "z"), ("C", "단일상품"), ("B", " ")]
    rows = spark.createDataFrame([(i, p, o) for i, (p, o) in enumerate(given)], "ord long, p string, o string")
    made = catalog.build(rows, "p", "o")
    assert [(r["product"], r["options"]) for r in made.orderBy("ord").collect()] == [("A", ["x", "y"]), ("B", []), ("C", ["단일상품"])]
    assert tuple(catalog.counts(made).first()) == (3, 3, 1)
    assert json.loads(catalog.to_json(made)) == {"A": ["x", "y"], "B": [], "C": ["단일상품"]}
    assert catalog.to_json(made) == json.dumps({"A": ["x", "y"], "B": [], "C": ["단일상품"]}, ensure_ascii=False, indent=2)
    back = catalog.from_rows(catalog.to_rows(made))
    assert {r["product"]: r["options"] for r in back.collect()} == {"A": ["x", "y"], "C": ["단일상품"]}
    assert tuple(catalog.counts(made.limit(0)).first()) == (0, 0, 0)


def test_order_numbers_and_items(spark):
    item = "product string, option string, volume bigint"
    shape = f"ord long, time timestamp_ntz, chat_name string, live_time timestamp_ntz, result struct<order_name:string,phone_number:string,address:string,search_address:string,items:array<struct<{item.replace(' ', ':').replace(',:', ',')}>>>"
    one = [("p", None, 1)]
    given = [(0, None, "a", None, None), (1, None, "b", None, ("n", None, None, None, [])), (2, None, "c", None, ("n", "01012345678", None, None, one * 2)), (3, None, "d", None, ("n", "12", None, None, one))]
    made = orders.explode_items(orders.number_orders(spark.createDataFrame(given, shape), "20260315"))
    assert sorted((r["order_number"], r["chat_name"], r["phone_number"]) for r in made.collect()) == [("20260315001", "c", "010-1234-5678")] * 2 + [("20260315002", "d", "12")]
    sheet = orders.sheet(made, {"x": "product", "y": "no such", "z": None, "o": "option"})
    assert sheet.columns == ["x", "y", "z", "o"]
    assert [tuple(r) for r in sheet.limit(1).collect()] == [("p", "", "", None)]
    many = spark.range(1200).select(F.col("id").alias("ord"))
    numbers = {r["order_number"] for r in orders.number_orders(many, "20260315", has_items=F.lit(True)).collect()}
    assert {"20260315001", "20260315999", "202603151000"} <= numbers


def test_zip_codes_are_asked_once(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def ask(address, folder=str(log)):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(address)
        if address == "bad":
            raise ValueError
        return {"a": "6234", "road b": "123"}.get(address)

    rows = spark.createDataFrame([(i, a) for i, a in enumerate(["a", " a　", None, "", "b", "bad", "b", "none"])], "i int, address string")
    made = zipcodes.look_up(rows, zipcodes.from_calls(ask), zipcodes.rewriter(lambda a: f"road {a}" if a == "b" else " "))
    for _ in range(2):
        assert [r["zip_code"] for r in made.orderBy("i").collect()] == ["06234", "06234", "", "", "00123", "", "00123", ""]
    said = sorted(open(f"{log}/{f}").read() for f in os.listdir(log))
    assert said == ["a", "b", "bad", "none", "road b"]
    assert tuple(zipcodes.found_missed(made).first()) == (4, 4)
    assert zipcodes.beside(made, "zip_code", "i").columns == ["i", "zip_code", "address"]
    over = zipcodes.look_up(rows.withColumn("zip_code", F.lit("x")), zipcodes.from_table(spark.createDataFrame([("a", "1"), ("a", "0")], "address string, zip_code string")))
    assert over.columns == ["i", "address", "zip_code"]
    assert [r["zip_code"] for r in over.orderBy("i").collect()] == ["00000", "00000", "", "", "", "", "", ""]


def put(path, body, encoding="utf-8-sig"):
    path.write_bytes(body.encode(encoding))
    return str(path)


def test_chats_to_orders(spark, tmp_path):
    head = "DATE,USER,MESSAGE\n"
    one = put(tmp_path / "shop_kim.csv", head + '2026-03-12 10:00:00,kim,"사과  \n대 3개"\n2026-03-12 11:00:00,kim,system hello\n2026-03-12 23:00:00,kim,사과 9\n2026-03-12 09:00:00,kim,NA\n')
    two = put(tmp_path / "shop_lee.csv", head + "2026-03-12 10:00:00,lee,hello\n")
    three = put(tmp_path / "shop_park.csv", head + "2026-03-12 10:00:00,park,fail\n")
    four = put(tmp_path / "shop_choi.csv", head + "2026-03-12 10:00:00,choi,배 2 010 1234 5678 주소: 서울\n")
    find = extract.by_catalog({"사과": ["대", "소"], "배": ["단일상품"]})

    def ask(said):
        if any(m["message"] == "fail" for m in said):
            raise RuntimeError("no answer")
        return find(said)

    known = spark.createDataFrame([("서울", "4524")], "address string, zip_code string")
    made, chats = plans.extract_orders(spark, [one, two, three, four], ask, "20260315", Settings(prefix="shop_", exclude=["system"]), "2026-03-12 09:00:00", "2026-03-12 12:00:00", zipcodes.from_table(known))
    got = sorted((r["order_number"], r["chat_name"], r["product"], r["option"], r["volume"], r["phone_number"], r["zip_code"], r["time"].hour) for r in made.collect())
    assert got == [("20260315001", "kim", "사과", "대", 3, None, "", 9), ("20260315002", "choi", "배", "단일상품", 2, "010-1234-5678", "04524", 10)]
    told = {r["file"]: ([m["message"] for m in r["messages"]], r["error"]) for r in chats.collect()}
    assert told["shop_kim.csv"] == (["사과 대 3개", "nan"], None)
    assert told["shop_park.csv"][1] == "RuntimeError: no answer"
    plans.store_run(made, chats, str(tmp_path / "db"), "7", "me", "{}", "2026-03-15")
    assert spark.read.parquet(str(tmp_path / "db/extracted_orders")).where("job_id = 7").count() == 2
    kept = spark.read.parquet(str(tmp_path / "db/training_data"))
    assert sorted(r["chat_filename"] for r in kept.collect()) == ["shop_choi.csv", "shop_kim.csv", "shop_lee.csv"]
    write_xlsx(orders.sheet(made.orderBy("order_number"), OUTPUT_COLUMNS), str(tmp_path / "sheet"), "주문내역", ("우편번호",))
    back = read_xlsx(spark, str(tmp_path / "sheet/part-00000.xlsx"), "우편번호").orderBy("ord")
    assert back.columns == ["ord", *OUTPUT_COLUMNS]
    assert [r["우편번호"] for r in back.collect()] == [None, "04524"] or [r["우편번호"] for r in back.collect()] == ["", "04524"]


def test_files_are_read_by_their_own_headers(spark, tmp_path):
    paths = [
        put(tmp_path / "a.csv", "DATE,USER,MESSAGE\n2026-03-12 10:00:00,kim,\"x, y\"\n"),
        put(tmp_path / "b.csv", "USER,MESSAGE,DATE\r\nlee,hello,2026-03-13 10:00:00\r\n", "utf-8"),
        put(tmp_path / "c.csv", "user,message\npark,\"two\nlines\"\n"),
        put(tmp_path / "d.csv", "", "utf-8"),
        put(tmp_path / "e.csv", "OTHER,DATE\n1,2026-03-14 10:00:00\n"),
    ]
    rows = {r["file"]: (r["date"], r["user"], r["message"]) for r in lines.read_chat_csv(spark, paths).collect()}
    assert rows == {"a.csv": ("2026-03-12 10:00:00", "kim", "x, y"), "b.csv": ("2026-03-13 10:00:00", "lee", "hello"), "c.csv": (None, "park", "two\nlines"), "e.csv": ("2026-03-14 10:00:00", "", "")}
    assert lines.read_chat_csv(spark, paths[3]).collect() == []


def test_csv_and_lines_in_one_run(spark, tmp_path):
    one = put(tmp_path / "shop_kim.csv", "USER,MESSAGE,DATE\nkim,사과  3,2026-03-12 10:00:00\n")
    two = put(tmp_path / "lee_2026-03-13-08-09-10.jsonl", "{'user': 'lee', 'message': '배  2'}\n{'user': 'lee', 'message': 'late', 'date': '2026-03-20 10:00:00'}\n", "utf-8")
    find = extract.by_catalog({"사과": [], "배": []})
    made, chats = plans.extract_orders(spark, [one, two], find, "20260315", Settings(prefix="shop_", exclude=["배"]), before="2026-03-15 00:00:00")
    got = sorted((r["order_number"], r["chat_name"], r["product"], r["volume"], str(r["time"])) for r in made.collect())
    assert got == [("20260315001", "kim", "사과", 3, "2026-03-12 10:00:00"), ("20260315002", "lee", "배", 2, "2026-03-13 08:09:10")]
    # lines stand as they are: white space isn't collapsed, and no message is taken for a system's
    assert {r["file"]: [m["message"] for m in r["messages"]] for r in chats.collect()} == {"shop_kim.csv": ["사과 3"], "lee_2026-03-13-08-09-10.jsonl": ["배  2"]}


def test_stored_jobs_are_listed_and_loaded(spark, tmp_path):
    folder = str(tmp_path / "db")
    path = put(tmp_path / "kim.csv", "DATE,USER,MESSAGE\n2026-03-12 10:00:00,kim,사과 3\n2026-03-12 10:01:00,kim,배 1\n")
    made, chats = plans.extract_orders(spark, [path], extract.by_catalog({"사과": [], "배": ["단일상품"]}), "20260315")
    stored = '[{"상품명": "사과", "옵션": []}, {"상품명": "배", "옵션": ["단일상품"]}]'
    for k in range(6):
        plans.store_run(made, chats, folder, f"j{k}", "me", stored, f"2026-03-15T0{k}:00:00", f"run {k}", "2026-03-12T09:30:00", "m")
    plans.store_run(made, chats, folder, "other", "you", stored, "2026-03-16T00:00:00")
    jobs = plans.jobs_of(spark, folder, "me").collect()
    assert [r["id"] for r in jobs] == ["j5", "j4", "j3", "j2", "j1"]
    assert (jobs[0]["label"], jobs[0]["total_orders"], jobs[0]["model"]) == ("run 5  |  라이브: 2026-03-12 09:30  |  2건", 2, "m")
    sheet = plans.job_sheet(spark, folder, "j2")
    assert sheet.columns == list(OUTPUT_COLUMNS) and sorted(r["상품명"] for r in sheet.collect()) == ["배", "사과"] and {r["우편번호"] for r in sheet.collect()} == {""}
    assert json.loads(plans.job_catalog(spark, folder, "j2")) == {"사과": [], "배": ["단일상품"]}
    assert plans.job_catalog(spark, folder, "none") is None


def test_prompted_extractor():
    asked = []
    ask = extract.prompted(lambda text: asked.append(text) or '{"items": []}', "catalog {catalog} chat {chat}", [{"상품명": "배", "옵션": []}])
    assert ask([{"user": "a", "message": "배 1"}]) == {"items": []}
    assert json.loads(asked[0].partition(" chat ")[2]) == [{"user": "a", "message": "배 1"}] and '"상품명": "배"' in asked[0]


def test_settings_of_both_kinds(tmp_path):
    (tmp_path / "s.json").write_text('{"prefix": "P_", "exclude": ["x"]}', encoding="utf-8")
    assert Settings.load(str(tmp_path / "s.json")) == Settings(prefix="P_", exclude=["x"])
    told = {"csv": {"filename_prefix": "P_", "exclude_messages": ["x"]}, "output": {"sheet_name": "s", "file_name": "f.xlsx"}, "output_columns": {"a": "product", "b": None}, "model": {"name": "m"}}
    want = Settings("P_", ["x"], {"a": "product", "b": None}, "s", "f.xlsx")
    assert Settings.of_sections(told) == want and Settings.of_sections({}) == Settings()
    yaml = pytest.importorskip("yaml")
    (tmp_path / "s.yaml").write_text(yaml.safe_dump(told, allow_unicode=True), encoding="utf-8")
    assert Settings.load(str(tmp_path / "s.yaml")) == want


def test_settings_in_toml(tmp_path):
    path = put(tmp_path / "s.toml", '[csv]\nfilename_prefix = "shop_"\nexclude_messages = ["system"]\n[output]\nsheet_name = "s"\n[output_columns]\n"주문번호" = "order_number"\n"빈칸" = ""\n[secrets]\nkey = "not kept"\n', "utf-8")
    s = Settings.load(path)
    assert (s.prefix, s.exclude, s.sheet, s.columns) == ("shop_", ["system"], "s", {"주문번호": "order_number", "빈칸": None})


def test_bounds_are_included_and_bad_dates_raise(spark):
    rows = spark.createDataFrame([("2026-03-12 10:00:00",), ("2026-03-12 11:00:00",), ("2026-03-12 12:00:00",), (None,)], "date string")
    assert lines.in_range(rows, "2026-03-12 10:00:00", "2026-03-12 11:00:00").count() == 2
    assert lines.in_range(rows).count() == 4
    with pytest.raises(Exception, match="not a date"):
        lines.in_range(spark.createDataFrame([("soon",)], "date string"), "2026-03-12 10:00:00").count()


def test_lines(spark, tmp_path):
    body = "\n{'user': 'a', 'message': 'it\\'s', 'date': '2026-03-12 10:00:00'}\x85{'user': None, 'message': 'b'}\nnull\n[1]\n{'user': 'c', 'message': 'd', 'date': 'soon'}\n"
    path = put(tmp_path / "x_2026-03-12-10-17-22.jsonl", body, "utf-8")
    rows = lines.read_chat_lines(spark, path)
    assert [(r["user"], r["message"], r["bad"]) for r in rows.orderBy("ord").collect()] == [("a", "it's", False), (None, "b", False), (None, None, True), (None, "[1]", False), ("c", "d", False)]
    assert [r["message"] for r in lines.lines_in_range(rows).orderBy("ord").collect()] == ["it's", "b", "[1]", "d"]
    assert [r["message"] for r in lines.lines_in_range(rows, after="2026-03-12 10:00:00").orderBy("ord").collect()] == ["it's", "b", "[1]"]
    bom = put(tmp_path / "bom.jsonl", "{'user': 'a', 'message': 'b'}\n{'user': 'a', 'message': 'c'}")
    assert [r["bad"] for r in lines.read_chat_lines(spark, bom).orderBy("ord").collect()] == [True, False]


def test_converter(spark, tmp_path):
    path = put(tmp_path / "P_kim.csv", "DATE,USER,MESSAGE\n2026-03-12 10:00:00,kim,a  b\n2026-03-12 11:30:00,kim,skip this\n")
    plans.convert(spark, path, str(tmp_path / "out"), "P_", ["skip"])
    assert os.listdir(tmp_path / "out" / "name=kim_2026-03-12-11-30-00")
    back = lines.read_chat_lines(spark, str(tmp_path / "out/*"))
    assert [(r["user"], r["message"], r["date"]) for r in back.collect()] == [("kim", "a b", "2026-03-12 10:00:00")]


def test_stock(spark, tmp_path):
    body = "상품명,옵션내용,x\n뷁,소,1\n뷁,,2\nNA,소,3\n"
    put(tmp_path / "a.csv", body, "cp949")
    put(tmp_path / "b.csv", "상품명,옵션내용\n배,007\n")
    made = plans.stock_catalog(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert [(r["product"], r["options"]) for r in made.orderBy("ord").collect()] == [("뷁", ["소"]), ("배", ["007"])]
    with pytest.raises(Exception, match="are needed"):
        read_stock(spark, put(tmp_path / "c.csv", "a,b\n1,2\n")).count()
    (tmp_path / "c.json").write_text(catalog.to_json(made), encoding="utf-8")
    again = read_catalog(spark, str(tmp_path / "c.json"))
    assert [(r["product"], r["options"]) for r in again.orderBy("ord").collect()] == [("뷁", ["소"]), ("배", ["007"])]


def test_xlsx_round_trip(spark, tmp_path):
    given = [("0123", 1, 1.5, datetime.datetime(2026, 3, 15, 12), "a<b & \"c\"\x00"), (None, None, None, None, "  ")]
    rows = spark.createDataFrame(given, "zip string, n long, x double, t timestamp, s string")
    write_xlsx(rows, str(tmp_path / "o"), text=("zip",))
    back = read_xlsx(spark, str(tmp_path / "o/*.xlsx")).orderBy("ord").collect()
    assert [tuple(r)[1:] for r in back] == [("0123", "1", "1.5", "46096.5", 'a<b & "c"'), (None, None, None, None, "  ")]
    with pytest.raises(ValueError, match="needed"):
        read_xlsx(spark, str(tmp_path / "o/*.xlsx"), "주소")
    sheet = spark.createDataFrame([("a", 1)], "`주소` string, z int")
    assert plans.code_sheet(sheet, zipcodes.from_table(spark.createDataFrame([("a", "1")], "address string, zip_code string"))).columns == ["주소", "우편번호", "z"]


def test_history(spark):
    jobs = spark.createDataFrame([(i, "u", f"2026-01-0{1 + i // 2}") for i in range(6)], "id int, user_id string, created_at string")
    assert [r["id"] for r in history.recent_jobs(jobs, "u").collect()] == [5, 4, 3, 2, 1]
    accounts = spark.createDataFrame([("u", True), ("v", False)], "user_id string, is_active boolean")
    assert history.active_account(accounts, "u").count() == 1
    assert history.active_account(accounts, "v").count() == 0
    assert history.orders_of(spark.createDataFrame([("1", "20260315999"), ("1", "202603151000")], "job_id string, order_number string"), "1").first()["order_number"] == "202603151000"


def test_messages_without_prefixes(spark):
    rows = spark.createDataFrame([(" sys a",), ("sys b",), (None,)], "message string")
    assert [r[0] for r in messages.normalised(rows, ["sys"]).collect()] == [None]
    assert [r[0] for r in messages.excluded_first(rows, ["sys"]).collect()] == ["sys a", None]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in/a.csv", "DATE,USER,MESSAGE\n2026-03-12 10:00:00,kim,one  two three\n2026-03-12 10:01:00,kim,short\n", "utf-8")
    for part in range(2):
        stream = streams.item_stream(streams.watch_chats(spark, str(tmp_path / "in")))
        streams.to_table(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).count() == 1 + part
        put(tmp_path / "in/b.csv", "DATE,USER,MESSAGE\n2026-03-12 10:00:00,lee,four five six\n", "utf-8")
    counts = streams.message_counts(streams.watch_chats(spark, str(tmp_path / "in")), late="0 seconds")
    streams.to_table(counts, str(tmp_path / "counts"), str(tmp_path / "counting")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "counts")).count() >= 0
