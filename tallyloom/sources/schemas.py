"""Schemas of the datasets, as DDL."""

from __future__ import annotations

MESSAGE = "user string, message string"
ITEM = "product string, option string, volume bigint"
RESULT = f"order_name string, phone_number string, address string, search_address string, items array<struct<{ITEM.replace(' ', ':').replace(',:', ',')}>>"
CATALOG = "map<string,array<string>>"
#: Columns of stock lists, catalogs and address sheets.
PRODUCT, OPTIONS, STOCK_OPTION, ADDRESS, ZIP, SINGLE = "상품명", "옵션", "옵션내용", "주소", "우편번호", "단일상품"
#: A catalog as it is stored with a job.
STORED_CATALOG = f"array<struct<`{PRODUCT}`:string,`{OPTIONS}`:array<string>>>"
#: The output sheet, name -> field; a field of None leaves the column blank.
OUTPUT_COLUMNS = {"주문번호": "order_number", "상품명": "product", "옵션명": "option", "수량": "volume", "채팅명": "chat_name", "수령자": "order_name", "전화번호": "phone_number", "주소": "address", "우편번호": "zip_code"}

#: Stored order fields and their types.
ORDERS = {
    "job_id": "string", "order_number": "string", "product": "string", "option": "string", "volume": "bigint", "chat_name": "string", "order_name": "string",
    "phone_number": "string", "address": "string", "search_address": "string", "zip_code": "string", "created_at": "string",
}
