"""The two tables every metric reads, and how raw CRM exports map onto them.

actions    one row per user action
donations  one row per payment line
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from donorlens.operators.cleaning import whole_number

MONEY = T.DecimalType(18, 2)

ACTIONS = T.StructType(
    [
        T.StructField("customer_id", T.LongType()),
        T.StructField("action_ts", T.TimestampNTZType()),
        T.StructField("channel_name", T.StringType()),
        T.StructField("utm_source", T.StringType()),
    ]
)

DONATIONS = T.StructType(
    [
        T.StructField("first_action_id", T.LongType()),
        T.StructField("website_id", T.LongType()),
        T.StructField("customer_id", T.LongType()),
        T.StructField("order_ts", T.TimestampNTZType()),
        T.StructField("total_price", MONEY),
        T.StructField("status", T.StringType()),
        T.StructField("is_campaign", T.BooleanType()),
        T.StructField("is_recurrent", T.BooleanType()),
    ]
)

# Payment status codes, case-sensitive.
PAID = "Paid"
NOT_PAID = "notpaid"
FAILED = "fail"

# Export column -> model column.
ACTION_COLUMNS = {
    "CustomerActionCustomerIdsMindboxId": "customer_id",
    "CustomerActionDateTimeUtc": "action_ts",
    "CustomerActionChannelName": "channel_name",
    "CustomerActionChannelUtmSource": "utm_source",
}
DONATION_COLUMNS = {
    "OrderFirstActionIdsMindboxId": "first_action_id",
    "OrderIdsWebsiteID": "website_id",
    "OrderCustomerIdsMindboxId": "customer_id",
    "OrderFirstActionDateTimeUtc": "order_ts",
    "OrderTotalPrice": "total_price",
    "OrderLineStatusIdsExternalId": "status",
    "OrderCustomFieldsNewyear": "is_campaign",
    "OrderCustomFieldsRecurrent": "is_recurrent",
}


def _conform(df: DataFrame, columns: dict[str, str], schema: T.StructType) -> DataFrame:
    """Rename to model names and cast; columns the export lacks (dropped as all-null) become null.

    All other columns follow under their own names. A name that is a model name already is an error.
    """
    source = {model: export for export, model in columns.items()}
    dtypes = dict(df.dtypes)

    def field(f: T.StructField) -> Column:
        name = source.get(f.name, f.name)
        if name not in dtypes:
            return F.lit(None).cast(f.dataType)
        if isinstance(f.dataType, T.LongType):
            return whole_number(F.col(name), dtypes[name])
        return F.col(name).try_cast(f.dataType)

    used = {source.get(f.name, f.name) for f in schema.fields}
    others = [c for c in df.columns if c not in used]
    taken = {f.name.lower() for f in schema.fields}
    if clash := [c for c in others if c.lower() in taken]:
        raise ValueError(f"columns named like model columns: {clash}")
    return df.select(*[field(f).alias(f.name) for f in schema.fields], *[F.col(f"`{c}`") for c in others])


def to_actions(raw: DataFrame) -> DataFrame:
    return _conform(raw, ACTION_COLUMNS, ACTIONS)


def to_donations(raw: DataFrame) -> DataFrame:
    return _conform(raw, DONATION_COLUMNS, DONATIONS)
