from dayloom.functions.columns import (
    as_column,
    bucket_of,
    clean_number,
    cyclical,
    daily_ratio,
    day_number,
    day_of,
    days_since,
    finite,
    label_title,
    same_text,
    threshold_flag,
    weekday_of,
    whole_number,
)

__all__ = [
    "as_column",
    "bucket_of",
    "clean_number",
    "cyclical",
    "daily_ratio",
    "day_number",
    "day_of",
    "days_since",
    "finite",
    "label_title",
    "same_text",
    "threshold_flag",
    "weekday_of",
    "whole_number",
]
