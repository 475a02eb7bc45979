"""Registry: query key -> ``f(t) -> DataFrame`` over the canonical tables.

Keys follow the blueprint names; ``_clean`` variants compute what the source
comments promise, ``_exact`` variants keep day averages fractional.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.columns import ratio
from marketlens.plans import analysis as A
from marketlens.plans import faults as D
from marketlens.plans import kpi as K
from marketlens.plans import model as M
from marketlens.plans import pipeline as P
from marketlens.plans import storage as S
from marketlens.plans import validation as V
from marketlens.plans import views as W
from marketlens.plans.grain import payments_per_order, reviews_per_order
from marketlens.schema import FOREIGN_KEYS, MONEY_SUM, PRIMARY_KEYS

T = dict[str, DataFrame]


def _payments_per_order(t: T) -> DataFrame:
    return payments_per_order(t).select("order_id",
                                        F.col("pay_sum").cast(MONEY_SUM).alias("total_paid"))


def _reviews_per_order(t: T) -> DataFrame:
    return reviews_per_order(t).select("order_id", ratio("score_sum", "score_cnt")
                                       .alias("avg_score"),
                                       F.col("score_cnt").alias("review_cnt"))


def _delivered_orders(t: T) -> DataFrame:
    return W.delivered_orders(t).withColumns({"order_paid": F.col("order_paid").cast(MONEY_SUM),
                                              "order_items": F.col("order_items").cast("bigint")})


QUERIES: dict[str, Callable[[T], DataFrame]] = {
    # V: setup checks
    **{f"pk_{tbl}": partial(V.pk_check, table=tbl) for tbl in PRIMARY_KEYS},
    **{f"fk_{rel}": partial(V.fk_check, relation=rel) for rel in FOREIGN_KEYS},
    "count_orders": V.count_orders,
    "sample_customers": V.sample_customers,
    "distinct_status": V.distinct_status,
    "orphan_orders": V.orphan_orders,
    "null_seller_audit": V.null_seller_audit,
    "constraint_report": P.constraint_report,
    **D.QUERIES,
    # I and L: what comes back from sinks and sources
    **S.QUERIES,
    # W: views, their CTE operators and sample queries
    "orders_detail": W.orders_detail,
    "customer_base": W.customer_base,
    "payment_rows": W.payment_rows,
    "delivered_orders": _delivered_orders,
    "customer_profile": W.customer_profile,
    "customer_profile_all": W.customer_profile_all,
    "customer_profile_clean": partial(W.customer_profile, clean=True),
    "payments_per_order": _payments_per_order,
    "reviews_per_order": _reviews_per_order,
    "items_per_seller": W.items_per_seller,
    "seller_profile": W.seller_profile,
    "seller_profile_clean": partial(W.seller_profile, clean=True),
    "unique_items": W.unique_items,
    "product_profile": W.product_profile,
    "top_product_rows": W.top_product_rows,
    "payment_profile": W.payment_profile,
    "payment_profile_clean": partial(W.payment_profile, clean=True),
    "top_city_by_payment": W.top_city_by_payment,
    "unique_zips": W.unique_zips,
    "zone_profile": W.zone_profile,
    "zone_profile_exact": partial(W.zone_profile, int_avg=False),
    "zone_profile_clean": W.zone_profile_clean,
    "top_zones": W.top_zones,
    # Q: business questions
    "top_states_by_customers": A.top_states_by_customers,
    "top_states_by_customers_clean": partial(A.top_states_by_customers, clean=True),
    "new_customers_growth": A.new_customers_growth,
    "top_cities_by_customers": A.top_cities_by_customers,
    "top_cities_by_orders": A.top_cities_by_orders,
    "top_categories_by_units": A.top_categories_by_units,
    "bottom_categories_by_units": A.bottom_categories_by_units,
    "avg_ticket_by_customer": A.avg_ticket_by_customer,
    "avg_ticket_by_order": A.avg_ticket_by_order,
    "top_products_net_of_freight": A.top_products_net_of_freight,
    "top_products_net_of_freight_clean": A.top_products_net_of_freight_clean,
    "top10_category_share": A.top10_category_share,
    "top10_category_share_subquery": A.top10_category_share_subquery,
    "seller_order_rank": A.seller_order_rank,
    "seller_order_rank_view": A.seller_order_rank_view,
    "top10_seller_concentration": A.top10_seller_concentration,
    "fastest_sellers_row_number": A.fastest_sellers_row_number,
    "fastest_sellers_row_number_exact": partial(A.fastest_sellers_row_number, int_avg=False),
    "fastest_sellers_row_number_all": A.fastest_sellers_row_number_all,
    "fastest_sellers_dense_rank": A.fastest_sellers_dense_rank,
    "fastest_sellers_dense_rank_top": A.fastest_sellers_dense_rank_top,
    "fastest_sellers_dense_rank_exact": partial(A.fastest_sellers_dense_rank, int_avg=False),
    "delivery_days_by_state": A.delivery_days_by_state,
    "delivery_days_by_state_exact": partial(A.delivery_days_by_state, int_avg=False),
    "delivery_days_by_category": A.delivery_days_by_category,
    "delivery_days_by_category_exact": partial(A.delivery_days_by_category, int_avg=False),
    "delivery_days_by_state_category": A.delivery_days_by_state_category,
    "delivery_days_by_state_category_exact": partial(A.delivery_days_by_state_category,
                                                     int_avg=False),
    "on_time_share": A.on_time_share,
    "late_share_by_seller_city": A.late_share_by_seller_city,
    "late_share_by_seller_state": A.late_share_by_seller_state,
    "payment_method_usage": A.payment_method_usage,
    "payment_method_usage_clean": partial(A.payment_method_usage, clean=True),
    "avg_payment_by_type": A.avg_payment_by_type,
    "multi_payment_share": A.multi_payment_share,
    "review_score_by_state": A.review_score_by_state,
    "review_score_by_category": A.review_score_by_category,
    "review_score_by_category_clean": partial(A.review_score_by_category, clean=True),
    "review_by_delivery_bucket": A.review_by_delivery_bucket,
    "review_by_delivery_bucket_exact": partial(A.review_by_delivery_bucket, int_avg=False),
    "review_by_delivery_bucket_clean": partial(A.review_by_delivery_bucket, clean=True),
    # M: star model
    **M.QUERIES,
    # K: measures
    **K.QUERIES,
}
