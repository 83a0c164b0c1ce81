"""Store expressions: prices, payment labels, dates and return deadlines."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions import values as V
from vitrine.functions.text import strip


def as_date(day: dt.date | str | Column | None) -> Column:
    """A date; without one, today in the store's time zone."""
    if day is None:
        return store_today()
    if isinstance(day, Column):
        return day.cast("date")
    return F.lit(str(day)).cast("date")


def store_today(zone: str = V.STORE_ZONE) -> Column:
    """Today in the store's time zone, fixed at query start."""
    return F.to_date(F.convert_timezone(F.current_timezone(), F.lit(zone), F.localtimestamp()))


def promo_price(price: Column, discount: Column) -> Column:
    """Price less ``discount`` percent, rounded half up in decimals (never through doubles or a division)."""
    left = F.lit(100).cast("decimal(3,0)") - discount.cast("decimal(5,2)")
    return F.round(price.cast("decimal(12,2)") * left * F.lit("0.01").cast("decimal(3,2)"), 2).cast("decimal(12,2)")


def payment_label(method: Column) -> Column:
    label = F.when(F.coalesce(method, F.lit("")) == "", V.NO_PAYMENT)
    for key, text in V.PAYMENT_LABELS.items():
        label = label.when(method == key, text)
    times = F.regexp_extract(method, "^credit_(\\d+)x", 1)
    before, after = V.CARD_LABEL.split("{n}")
    return label.when(times != "", F.concat(F.lit(before), times, F.lit(after))).otherwise(method)


def iso_date(text: Column) -> Column:
    """Calendar dates ``2025-02-28`` or ``20250228``; anything else is NULL."""
    return F.coalesce(
        F.when(text.rlike("^\\d{4}-\\d{2}-\\d{2}$"), text.try_cast("date")),
        F.when(text.rlike("^\\d{8}$"), F.try_to_date(text, "yyyyMMdd")),
    )


def sellable(status: Column) -> Column:
    return status.isin(*V.SELLABLE)


def deadlines(status: Column, delivery: Column, ordered: Column, as_of: Column) -> Column:
    """Return-right dates and advice of a delivered order; NULL when not delivered or undated.

    ``ref_source`` says which date was used, since the label always reads "estimated delivery".
    """
    ref = F.coalesce(delivery, ordered)
    repent, defect = F.date_add(ref, V.REPENTANCE_DAYS), F.date_add(ref, V.DEFECT_DAYS)
    path = F.when(as_of > defect, V.PATH_EXPIRED).when(as_of > repent, V.PATH_DEFECT).otherwise(V.PATH_OPEN)
    shown = lambda day: F.date_format(day, V.DATE_FORMAT)
    details = F.struct(
        F.concat(F.lit(V.REFERENCE_TEXT), shown(ref)).alias("referencia"),
        shown(repent).alias("arrependimento_7d_ate"),
        (as_of > repent).alias("arrependimento_7d_expirado"),
        shown(defect).alias("troca_defeito_30d_ate"),
        (as_of > defect).alias("troca_defeito_30d_expirado"),
        path.alias("caminho_sugerido"),
        shown(as_of).alias("hoje"),
        F.when(delivery.isNotNull(), "estimated_delivery").otherwise("order_date").alias("ref_source"),
    )
    return F.when((status == V.DELIVERED) & ref.isNotNull(), details)


def deadlines_note(status: Column, delivery: Column, ordered: Column) -> Column:
    delivered = F.coalesce(status == V.DELIVERED, F.lit(False))
    undated = F.coalesce(delivery, ordered).isNull()
    return F.when(~delivered, V.NOTE_NOT_DELIVERED).when(undated, V.NOTE_NO_DATE)


def tracking_key(code: Column) -> Column:
    return F.upper(strip(code))


def role_label(role: Column) -> Column:
    return F.when(role == "user", V.ROLE_CUSTOMER).otherwise(V.ROLE_AGENT)


def json_text(*columns: Column | str) -> Column:
    """One JSON object; NULL fields are kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
