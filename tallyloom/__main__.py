"""python -m tallyloom orders|catalog|codes|convert|history: the flows of plans.chats from the command line."""

from __future__ import annotations

import argparse
import importlib
import json
from datetime import datetime
from pathlib import PurePath

from pyspark.sql import functions as F

from tallyloom.operators import catalog, extract, orders, zipcodes
from tallyloom.plans import chats
from tallyloom.session import session
from tallyloom.sources.schemas import ADDRESS, OPTIONS, PRODUCT, ZIP
from tallyloom.sources.settings import Settings
from tallyloom.sources.stock import read_catalog
from tallyloom.sources.xlsx import read_xlsx, write_xlsx


def named(path: str):
    """The object that module:name says."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tallyloom", description=__doc__)
    flows = top.add_subparsers(dest="flow", required=True)
    p = flows.add_parser("orders", help="chat files to a sheet of orders")
    p.add_argument("chats", nargs="+")
    p.add_argument("--catalog", required=True, help="JSON file")
    p.add_argument("--day", required=True, help="YYYYMMDD of the order numbers")
    p.add_argument("--extractor", help="module:function that takes a chat's messages; else products are found by name")
    p.add_argument("--settings", help="JSON, TOML or YAML file")
    p.add_argument("--after")
    p.add_argument("--before")
    p.add_argument("--codes", help="Parquet table of address and zip_code")
    p.add_argument("--out", required=True, help="folder of the sheet")
    p.add_argument("--quarantine", help="folder for lines that can't be read; it must not be there yet")
    p.add_argument("--db", help="folder of stored runs, to which this one is added")
    p.add_argument("--job", default="", help="id of the stored run; else the time")
    p.add_argument("--user", default="")
    p.add_argument("--title", default="")
    p.add_argument("--model", default="")
    p = flows.add_parser("catalog", help="stock lists to a catalog")
    p.add_argument("stock", nargs="+")
    p.add_argument("--out", required=True, help="JSON file")
    p = flows.add_parser("codes", help="an address sheet with postal codes")
    p.add_argument("sheet")
    p.add_argument("--codes", required=True, help="Parquet table of address and zip_code")
    p.add_argument("--rewrite", help="module:function that words an address for searching, for those that aren't found")
    p.add_argument("--out", required=True, help="folder, in which the sheet's own is named after the input")
    p = flows.add_parser("convert", help="chat files to lines of dict literals")
    p.add_argument("chats", nargs="+")
    p.add_argument("--prefix", default="")
    p.add_argument("--exclude", nargs="*", default=[])
    p.add_argument("--after")
    p.add_argument("--out", required=True, help="folder")
    p = flows.add_parser("history", help="stored runs: listed, or one of them as a sheet with its catalog")
    p.add_argument("--db", required=True, help="folder of stored runs")
    p.add_argument("--user", default="")
    p.add_argument("--job", help="id of the run to write")
    p.add_argument("--settings", help="JSON, TOML or YAML file")
    p.add_argument("--out", help="folder")
    return top


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = session()
    known = zipcodes.from_table(spark.read.parquet(a.codes)) if getattr(a, "codes", None) else None
    if a.flow == "orders":
        s = Settings.load(a.settings) if a.settings else Settings()
        # a catalog that is a file's single JSON object is read by one task already
        listed = read_catalog(spark, a.catalog).orderBy("ord").collect()
        find = named(a.extractor) if a.extractor else extract.by_catalog({r["product"]: list(r["options"]) for r in listed})
        made, said = chats.extract_orders(spark, a.chats, find, a.day, s, a.after, a.before, known, a.quarantine, lambda counts: print(json.dumps(counts)))
        # from 1000 on, numbers have more digits: shorter ones come first
        write_xlsx(orders.sheet(made.orderBy(F.length("order_number"), "order_number", "item_no"), s.columns), a.out, s.sheet, (ZIP,))
        if a.db:
            as_of = datetime.now().isoformat()
            catalog_json = json.dumps([{PRODUCT: r["product"], OPTIONS: list(r["options"])} for r in listed], ensure_ascii=False)
            chats.store_run(made, said, a.db, a.job or as_of, a.user, catalog_json, as_of, a.title, a.after, a.model)
    elif a.flow == "catalog":
        told = chats.stock_catalog(spark, a.stock)
        with open(a.out, "w", encoding="utf-8") as f:
            f.write(catalog.to_json(told))
        print(json.dumps(catalog.counts(told).first().asDict()))
    elif a.flow == "codes":
        made = chats.code_sheet(read_xlsx(spark, a.sheet, ADDRESS), known, zipcodes.rewriter(named(a.rewrite)) if a.rewrite else None)
        print(json.dumps(zipcodes.found_missed(made, ZIP).first().asDict()))
        write_xlsx(made.orderBy("ord").drop("ord"), f"{a.out}/{PurePath(a.sheet).stem}_{ZIP}.xlsx", text=(ZIP,))
    elif a.flow == "history":
        if not a.job:
            for r in chats.jobs_of(spark, a.db, a.user).collect():
                print(r["id"], r["label"], sep="\t")
            return
        s = Settings.load(a.settings) if a.settings else Settings()
        write_xlsx(chats.job_sheet(spark, a.db, a.job, s), f"{a.out}/orders", s.sheet, (ZIP,))
        told = chats.job_catalog(spark, a.db, a.job)
        if told:
            with open(f"{a.out}/catalog.json", "w", encoding="utf-8") as f:
                f.write(told)
    else:
        chats.convert(spark, a.chats, a.out, a.prefix, a.exclude, a.after)


if __name__ == "__main__":
    main()
