"""The command line, flow by flow."""

import json
import os

from tallyloom.__main__ import main
from tallyloom.sources.xlsx import read_xlsx, write_xlsx


def reworded(address):
    return "서울"


def test_flows(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    (tmp_path / "stock.csv").write_text("상품명,옵션내용\n사과,대\n배,단일상품\n", encoding="cp949")
    main(["catalog", at("stock.csv"), "--out", at("c.json")])
    assert json.loads((tmp_path / "c.json").read_text(encoding="utf-8")) == {"사과": ["대"], "배": ["단일상품"]}
    (tmp_path / "P_kim.csv").write_text("DATE,USER,MESSAGE\n2026-03-12 10:00:00,kim,사과 대 3 배 1\n", encoding="utf-8-sig")
    main(["orders", at("P_kim.csv"), "--catalog", at("c.json"), "--day", "20260315", "--out", at("sheet"), "--db", at("db"), "--job", "j", "--user", "me", "--title", "t"])
    rows = read_xlsx(spark, at("sheet/*.xlsx")).orderBy("ord").collect()
    assert [(r["주문번호"], r["상품명"], r["수량"]) for r in rows] == [("20260315001", "사과", "3"), ("20260315001", "배", "1")]
    spark.createDataFrame([("서울", "4524")], "address string, zip_code string").write.parquet(at("codes"))
    write_xlsx(spark.createDataFrame([("서울", 1), ("부산", 2)], "`주소` string, n int"), at("in"))
    main(["codes", at("in/part-00000.xlsx"), "--codes", at("codes"), "--out", at("coded")])
    assert sorted(r["우편번호"] or "" for r in read_xlsx(spark, at("coded/part-00000_우편번호.xlsx/*.xlsx"), "우편번호").collect()) == ["", "04524"]
    main(["codes", at("in/part-00000.xlsx"), "--codes", at("codes"), "--rewrite", "tests.test_main:reworded", "--out", at("again")])
    assert [r["우편번호"] for r in read_xlsx(spark, at("again/*/*.xlsx"), "우편번호").collect()] == ["04524", "04524"]
    main(["history", "--db", at("db"), "--user", "me"])
    assert capsys.readouterr().out.splitlines()[-1] == "j\tt  |  라이브: -  |  2건"
    main(["history", "--db", at("db"), "--job", "j", "--out", at("old")])
    assert sorted(r["상품명"] for r in read_xlsx(spark, at("old/orders/*.xlsx")).collect()) == ["배", "사과"]
    assert json.loads((tmp_path / "old/catalog.json").read_text(encoding="utf-8")) == {"사과": ["대"], "배": ["단일상품"]}
    main(["convert", at("P_kim.csv"), "--prefix", "P_", "--out", at("lines")])
    assert os.listdir(tmp_path / "lines" / "name=kim_2026-03-12-10-00-00")
