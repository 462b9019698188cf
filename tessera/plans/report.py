"""Markdown report as a small DataFrame (section, ordinal, text).

The report is a list of sections, each a title and a function that yields
its lines from the facts gathered once: the labelled table's size, the
metrics row, and the per-cluster tables. All tables in it are per-cluster
aggregates, so the report is bounded by clusters x features, never by rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession

from tessera.functions.exprs import numeric_cols
from tessera.operators import results

#: metric -> (digits, how to read it)
METRICS = {
    "silhouette": (4, "from -1 to 1; points sit nearer to their own cluster than to the next one when it is high"),
    "davies_bouldin": (4, "0 is ideal; spread of neighbouring clusters relative to their distance"),
    "calinski_harabasz": (1, "grows with separation; compare runs on the same table only"),
}
CLOSING = (
    "Name the clusters after what sets their profiles apart.",
    "Let someone who knows the data confirm the names.",
    "Refit on a different sample; clusters that move are weak.",
    "A saved model scores new tables with the same statistics.",
)
MAX_NAMES = 10


@dataclass(frozen=True)
class Facts:
    rows: int
    features: list[str]
    metrics: dict
    choices: list[tuple[str, str]]
    model: str
    shares: list[Row]
    profiles: list[Row]
    descriptions: list[Row]


def _table(head: tuple[str, ...], rows) -> list[str]:
    """A Markdown table; nothing when there are no rows."""
    body = ["| " + " | ".join(str(v) for v in r) + " |" for r in rows]
    return ["| " + " | ".join(head) + " |", "|" + " --- |" * len(head), *body] if body else []


def _data(f: Facts) -> list[str]:
    shown = ", ".join(f.features[:MAX_NAMES]) + (", ..." if len(f.features) > MAX_NAMES else "")
    return [f"{f.rows} rows, {len(f.features)} numeric features: {shown}"]


def _model(f: Facts) -> list[str]:
    found = f"{f.model}: {f.metrics.get('clusters', 'unknown number of')} clusters"
    return [found + (f", {f.metrics['noise']} noise points" if f.metrics.get("noise") else "")]


def _scores(f: Facts) -> list[str]:
    return _table(("score", "value", "reading"),
                  [(k, round(f.metrics[k], d), how) for k, (d, how) in METRICS.items() if f.metrics.get(k) is not None])


def _sizes(f: Facts) -> list[str]:
    return _table(("cluster", "rows", "share"), [(r["cluster"], r["count"], f"{round(r['pct'], 1)} %") for r in f.shares])


def _profiles(f: Facts) -> list[str]:
    return _table(("cluster", *f.features), [
        (r["cluster"], *("" if r[c] is None else round(r[c], 3) for c in f.features)) for r in f.profiles])


def _words(f: Facts) -> list[str]:
    return [f"- {results.NOISE_TEXT} (label -1)" if r["cluster"] == -1 else
            f"- cluster {r['cluster']}, {r['n']} rows ({round(r['pct'], 1)} %): {r['description']}" for r in f.descriptions]


SECTIONS = (
    ("Table", _data),
    ("Preparation", lambda f: _table(("step", "choice"), f.choices)),
    ("Model", _model),
    ("Scores", _scores),
    ("Sizes", _sizes),
    ("Mean profiles", _profiles),
    ("In words", _words),
    ("What to do with it", lambda f: [f"- {t}" for t in CLOSING]),
)


def build_report(spark: SparkSession, labelled: DataFrame, key_cols: list[str], metrics: DataFrame,
                 model_name: str, imputer: str, scaler: str, outliers: str, reduction: str = "PCA",
                 date: str | None = None) -> DataFrame:
    """``date`` is printed as given; without it the report has no date, so
    that equal input gives an equal report."""
    feats = numeric_cols(labelled, exclude=[*key_cols, "cluster"])
    row = metrics.collect() if metrics is not None else []
    facts = Facts(
        labelled.count(), feats, row[0].asDict() if row else {},
        [("imputation", imputer), ("scaling", scaler), ("outliers", outliers), ("projection", reduction)], model_name,
        results.cluster_share(labelled).orderBy("cluster").collect(),
        results.cluster_profile(labelled, key_cols).orderBy("cluster").collect() if feats else [],
        results.cluster_descriptions(labelled, key_cols).orderBy("cluster").collect() if feats else [])
    lines = [(0, "# Clusters" + (f", {date}" if date else ""))]
    for n, (title, body) in enumerate(SECTIONS, 1):
        lines += [(n, f"## {title}"), *((n, t) for t in body(facts))]
    return spark.createDataFrame([(s, i, t) for i, (s, t) in enumerate(lines)], "section int, ordinal int, text string")
