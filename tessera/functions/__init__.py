"""Column-expression helpers shared by all operators."""

from tessera.functions.exprs import (  # noqa: F401
    categorical_cols,
    collect_row,
    nan_as_missing,
    nan_to_null,
    numeric_cols,
    null_if_nan,
    ref,
    round_doubles,
    sq_dist,
)
