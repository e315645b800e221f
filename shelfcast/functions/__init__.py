"""Column expressions. All are built-in Spark functions (JVM-side, codegen'd)."""

from shelfcast.functions.calendar import (
    DAY_NAMES, MONTH_NAMES, date_features, day_name, day_of_week, month_name, week_of_year,
)
from shelfcast.functions.numeric import denormalise, finite_or_null, ieee_status, round6, zscore
from shelfcast.functions.keyhash import fold_of, key_hash, train_flag
from shelfcast.functions.metrics import mape_agg, mse_agg, rmse_agg

__all__ = [
    "DAY_NAMES", "MONTH_NAMES", "date_features", "day_name", "day_of_week", "month_name",
    "week_of_year", "denormalise", "finite_or_null", "ieee_status", "round6", "zscore",
    "fold_of", "key_hash", "train_flag", "mape_agg", "mse_agg", "rmse_agg",
]
