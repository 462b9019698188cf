"""The cleaning job: keep columns -> impute -> handle outliers -> validate.

Each stage computes its statistics on the output of the previous one
(quantiles after imputation see the imputed values), one aggregate per
stage. The result is persisted once because every later step reads it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from tessera.functions.exprs import ref
from tessera.operators import clean, profile

MIN_ROWS = 10


@dataclass(frozen=True)
class CleanConfig:
    keep: list[str] | None = None          # None: every column minus the auto-remove suggestions
    imputation: str = "Mean"               # Mean | Median | KNN | Drop Rows
    outliers: str = "None"                 # None | Z-Score | IQR | Clip
    exclude: list[str] = field(default_factory=list)  # key columns never treated as features
    min_rows: int = MIN_ROWS


def default_keep(df: DataFrame) -> list[str]:
    drop = {r["column"] for r in profile.auto_remove(df).collect()}
    return [c for c in df.columns if c not in drop]


def run_clean(df: DataFrame, cfg: CleanConfig = CleanConfig(), persist: bool = False) -> DataFrame:
    keep = cfg.keep if cfg.keep is not None else default_keep(df)
    keep = list(dict.fromkeys([*[c for c in cfg.exclude if c in df.columns], *keep]))
    if not [c for c in keep if c not in cfg.exclude]:
        raise ValueError("nothing is left to clean: keep some column besides the excluded ones")
    out = df.select(*[ref(c) for c in keep])
    out = clean.impute(out, cfg.imputation, exclude=cfg.exclude)
    out = clean.remove_outliers(out, cfg.outliers, exclude=cfg.exclude)
    if persist:
        out = out.persist(StorageLevel.MEMORY_AND_DISK)
    n = out.limit(cfg.min_rows).count()
    if n < cfg.min_rows:
        raise ValueError(f"only {n} rows left after cleaning; at least {cfg.min_rows} are needed")
    return out
