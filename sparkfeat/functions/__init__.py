from sparkfeat.functions.calendar import days_between, epoch_seconds, to_timestamp
from sparkfeat.functions.nulls import clean, column, null_if_nan
from sparkfeat.functions.text import contains_flag, first_parts, sku_family

__all__ = [
    "clean", "column", "contains_flag", "days_between", "epoch_seconds", "first_parts",
    "null_if_nan", "sku_family", "to_timestamp",
]
