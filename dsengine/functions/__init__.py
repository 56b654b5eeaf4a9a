from dsengine.functions.exprs import (  # noqa: F401
    is_missing, is_numeric_type, is_text_type, is_boolean_type, is_datetime_type,
    numeric_columns, text_columns, nan_to_null, as_double, pair_corr,
    isclose_to_rint, qname,
)
from dsengine.functions.quantiles import exact_quantiles  # noqa: F401
