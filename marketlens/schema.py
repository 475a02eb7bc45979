"""Canonical schema of the nine marketplace tables, their keys and relations.

Types: identifiers and zip prefixes are strings (leading zeros matter), dates
are ``timestamp_ntz`` (wall-clock values without zone), money is DECIMAL so that
sums are exact, review scores are integers.
"""

from __future__ import annotations

from pyspark.sql.types import (DecimalType, DoubleType, IntegerType, StringType,
                               StructField, StructType, TimestampNTZType)

S, I, TS, D = StringType(), IntegerType(), TimestampNTZType(), DoubleType()

MONEY = DecimalType(18, 2)
PRICE = DecimalType(12, 2)
FREIGHT = DecimalType(18, 4)
# result types of money aggregates (sums over many rows)
MONEY_SUM = DecimalType(38, 2)
FREIGHT_SUM = DecimalType(38, 4)


def _st(*fields):
    return StructType([StructField(n, t, nullable) for n, t, nullable in fields])


SCHEMAS: dict[str, StructType] = {
    "orders": _st(
        ("order_id", S, False), ("customer_id", S, True), ("order_status", S, True),
        ("order_purchase_timestamp", TS, True), ("order_approved_at", TS, True),
        ("order_delivered_carrier_date", TS, True),
        ("order_delivered_customer_date", TS, True),
        ("order_estimated_delivery_date", TS, True)),
    "customer": _st(
        ("customer_id", S, False), ("customer_unique_id", S, True),
        ("customer_zip_code_prefix", S, True), ("customer_city", S, True),
        ("customer_state", S, True)),
    "order_item": _st(
        ("order_id", S, False), ("order_item_id", I, True), ("product_id", S, True),
        ("seller_id", S, True), ("shipping_limit_date", TS, True),
        ("price", PRICE, True), ("freight_value", FREIGHT, True)),
    "order_payments": _st(
        ("order_id", S, False), ("payment_sequential", I, True),
        ("payment_type", S, True), ("payment_value", MONEY, True)),
    "order_reviews": _st(
        ("review_id", S, True), ("order_id", S, False), ("review_score", I, True),
        ("review_creation_date", TS, True)),
    "products": _st(("product_id", S, False), ("product_category_name", S, True)),
    "translation": _st(("product_category_name", S, False),
                       ("product_category_name_english", S, True)),
    "sellers": _st(
        ("seller_id", S, False), ("seller_zip_code_prefix", S, True),
        ("seller_city", S, True), ("seller_state", S, True)),
    "geolocation": _st(
        ("geolocation_zip_code_prefix", S, True), ("geolocation_lat", D, True),
        ("geolocation_lng", D, True), ("geolocation_city", S, True),
        ("geolocation_state", S, True)),
}

# file names of the source CSV export (translation keeps its long name there)
CSV_NAMES = {
    "orders": "orders", "customer": "customer", "order_item": "order_item",
    "order_payments": "order_payments", "order_reviews": "order_reviews",
    "products": "products", "translation": "product_category_name_translation",
    "sellers": "sellers", "geolocation": "geolocation",
}

# primary keys (table -> key columns); "zip" is the derived zip dimension
PRIMARY_KEYS: dict[str, list[str]] = {
    "orders": ["order_id"],
    "customer": ["customer_id"],
    "products": ["product_id"],
    "sellers": ["seller_id"],
    "translation": ["product_category_name"],
    "zip": ["geolocation_zip_code_prefix"],
}

# foreign keys: name -> (child table, child column, parent table, parent column)
FOREIGN_KEYS: dict[str, tuple[str, str, str, str]] = {
    "orders_customer": ("orders", "customer_id", "customer", "customer_id"),
    "payments_order": ("order_payments", "order_id", "orders", "order_id"),
    "item_order": ("order_item", "order_id", "orders", "order_id"),
    "reviews_order": ("order_reviews", "order_id", "orders", "order_id"),
    "item_product": ("order_item", "product_id", "products", "product_id"),
    "item_seller": ("order_item", "seller_id", "sellers", "seller_id"),
    "products_category": ("products", "product_category_name",
                          "translation", "product_category_name"),
    "customer_zip": ("customer", "customer_zip_code_prefix",
                     "zip", "geolocation_zip_code_prefix"),
    "sellers_zip": ("sellers", "seller_zip_code_prefix",
                    "zip", "geolocation_zip_code_prefix"),
    "geolocation_zip": ("geolocation", "geolocation_zip_code_prefix",
                        "zip", "geolocation_zip_code_prefix"),
}
