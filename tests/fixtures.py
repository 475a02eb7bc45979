"""Hand-made canonical tables that exercise the semantic traps.

Orders:
  o1  Friday 2018-11-02 23:59 -> delivered 00:01 next day (midnight: 1 day);
      three item rows with a repeated position, two payments, two reviews
  o2  late delivery (15 days against 10 estimated), null category product
  o3  shipped, not delivered; untranslated category; null freight
  o4  delivered before purchase (-1 day); review with null score
  o5  canceled, no items (null product / seller rows in the detail view)
  o6  two sellers plus an unknown product and seller, 44 days (30+ bucket),
      a payment with null value, two reviews; customer zip not in geolocation
  o7  customer missing from the customer table, no payments, no reviews
  o8  one item, on time, a price tie with o1's items
Zip 01001 has two spellings of its city; customer c4 has no orders.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

from marketlens.schema import SCHEMAS


def _ts(s):
    return dt.datetime.fromisoformat(s) if s else None


ORDERS = [
    ("o1", "c1", "delivered", "2018-11-02 23:59:00", "2018-11-03 00:30:00",
     "2018-11-02 23:59:30", "2018-11-03 00:01:00", "2018-11-20 00:00:00"),
    ("o2", "c1", "delivered", "2018-01-10 10:00:00", "2018-01-10 11:00:00",
     "2018-01-11 00:00:00", "2018-01-25 09:00:00", "2018-01-20 00:00:00"),
    ("o3", "c2", "shipped", "2017-05-05 00:01:00", None, "2017-05-06 00:00:00", None,
     "2017-05-30 00:00:00"),
    ("o4", "c3", "delivered", "2017-03-01 12:00:00", "2017-03-01 13:00:00",
     "2017-03-01 14:00:00", "2017-02-28 12:00:00", "2017-03-20 00:00:00"),
    ("o5", "c3", "canceled", "2016-10-04 09:00:00", None, None, None,
     "2016-10-30 00:00:00"),
    ("o6", "c5", "delivered", "2018-06-01 08:00:00", "2018-06-01 09:00:00",
     "2018-06-02 00:00:00", "2018-07-15 10:00:00", "2018-06-20 00:00:00"),
    ("o7", "c9", "delivered", "2018-02-01 10:00:00", "2018-02-01 11:00:00",
     "2018-02-02 00:00:00", "2018-02-08 10:00:00", "2018-02-10 00:00:00"),
    ("o8", "c2", "delivered", "2018-02-03 23:00:00", "2018-02-03 23:30:00",
     "2018-02-04 00:00:00", "2018-02-04 01:00:00", "2018-02-04 00:00:00"),
]
CUSTOMERS = [
    ("c1", "u1", "01001", "sao paulo", "SP"),
    ("c2", "u1", "01001", "sao paulo", "SP"),
    ("c3", "u3", "02002", "rio", "RJ"),
    ("c4", "u4", "03003", "belo", "MG"),
    ("c5", "u5", "09999", "x", "SP"),
]
ITEMS = [
    ("o1", 1, "p1", "s1", "2018-11-05 00:00:00", "100.00", "10.0000"),
    ("o1", 2, "p1", "s1", "2018-11-05 00:00:00", "100.00", "10.0000"),
    ("o1", 2, "p2", "s1", "2018-11-05 00:00:00", "50.00", "5.5000"),
    ("o2", 1, "p3", "s2", "2018-01-12 00:00:00", "30.00", "3.0000"),
    ("o3", 1, "p4", "s2", "2017-05-07 00:00:00", "20.00", None),
    ("o4", 1, "p2", "s1", "2017-03-02 00:00:00", "70.00", "7.0000"),
    ("o6", 1, "p1", "s1", "2018-06-03 00:00:00", "100.00", "12.0000"),
    ("o6", 2, "p2", "s2", "2018-06-03 00:00:00", "40.00", "4.0000"),
    ("o6", 3, "p9", "s9", "2018-06-03 00:00:00", "10.00", "1.0000"),
    ("o7", 1, "p2", "s3", "2018-02-03 00:00:00", "60.00", "6.0000"),
    ("o8", 1, "p1", "s1", "2018-02-05 00:00:00", "100.00", "9.0000"),
]
PAYMENTS = [
    ("o1", 1, "credit_card", "150.00"), ("o1", 2, "voucher", "100.00"),
    ("o2", 1, "boleto", "33.00"), ("o3", 1, "credit_card", "20.00"),
    ("o4", 1, "credit_card", "77.00"), ("o5", 1, "voucher", "10.00"),
    ("o6", 1, "credit_card", "100.00"), ("o6", 2, "debit_card", None),
    ("o8", 1, "credit_card", "109.00"),
]
REVIEWS = [
    ("r1", "o1", 5), ("r2", "o1", 4), ("r3", "o2", 1), ("r4", "o4", None),
    ("r5", "o5", 3), ("r6", "o6", 5), ("r7", "o6", 2), ("r8", "o8", 5),
]
PRODUCTS = [("p1", "cama"), ("p2", "beleza"), ("p3", None), ("p4", "untranslated")]
TRANSLATION = [("cama", "bed"), ("beleza", "beauty")]
SELLERS = [("s1", "01001", "sao paulo", "SP"), ("s2", "02002", "rio", "RJ"),
           ("s3", "04004", "curitiba", "PR")]
GEO = [("01001", -23.5, -46.6, "sao paulo", "SP"), ("01001", -23.6, -46.7, "SAO PAULO", "SP"),
       ("02002", -22.9, -43.2, "rio", "RJ"), ("03003", -19.9, -43.9, "belo", "MG"),
       ("04004", -25.4, -49.3, "curitiba", "PR")]


def handmade_tables(spark):
    rows = {
        "orders": [(a, b, c, *map(_ts, rest)) for a, b, c, *rest in ORDERS],
        "customer": CUSTOMERS,
        "order_item": [(o, i, p, s, _ts(d), D(pr), D(f) if f else None)
                       for o, i, p, s, d, pr, f in ITEMS],
        "order_payments": [(o, n, ty, D(v) if v else None) for o, n, ty, v in PAYMENTS],
        "order_reviews": [(r, o, sc, None) for r, o, sc in REVIEWS],
        "products": PRODUCTS, "translation": TRANSLATION, "sellers": SELLERS,
        "geolocation": GEO,
    }
    return {name: spark.createDataFrame(r, SCHEMAS[name]) for name, r in rows.items()}
