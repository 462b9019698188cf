"""Secret scan by patterns and corpus-wide ownership frequency.

DataFrame functions only. Pattern matches of every whole text are the base
spans: ``assign`` (a keyword, a separator and a value of 6 or more
characters), ``access`` (AKIA and 16 or more capitals or digits) and ``hex``
(24 or more hexadecimal digits). A fourth pattern collects ``owned``
candidates: runs of 20 or more credential characters with a digit, a capital
and a small letter. The values of all candidates are hashed and counted over
the whole corpus by distinct repositories and owners. A value that at most
``max_owners`` owners have is owner-specific and live-looking; one that more
owners have is a widely copied example. Live ``owned`` candidates are added
to the spans unless they overlap a base span; base spans always stay.

Spans are in code points, end exclusive. Defined cases: a null text is
empty; a null owner or repository counts as one of its own; repeated rows
are scanned one by one; the control character U+0001, used as a mark, is
read as U+0002, which no pattern matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import free_name, materialize, table

#: Fixed values: (kind, pattern of what precedes the value, pattern of the value, least length of the value).
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 6),
    ("access", "", r"AKIA[A-Z0-9]+", 20),
    ("hex", "", r"[0-9a-f]{24,}", 24),
)
OWNED = ("owned", "", r"[A-Za-z0-9+/_-]{20,}", 20)
MARK, OTHER = "\u0001", "\u0002"
SPAN = "array<struct<start:int,ord:int,end:int,kind:string,value:string>>"


def _spans(marked: Column, kind: str, order: int, least: int) -> Column:
    """Spans of one kind from a text whose matches are written
    ``MARK before MARK value MARK``."""
    parts = F.split(marked, MARK)  # plain, before, value, plain, before, value, ..., plain
    state = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast(SPAN).alias("out"))

    def step(acc, x):
        n, value = F.char_length(x), acc["i"] % 3 == 2
        before = F.when(acc["i"] % 3 == 1, acc["at"]).otherwise(acc["from"])
        span = F.struct(acc["from"].alias("start"), F.lit(order).alias("ord"), (acc["at"] + n).alias("end"),
                        F.lit(kind).alias("kind"), x.alias("value"))
        return F.struct((acc["at"] + n).alias("at"), (acc["i"] + 1).alias("i"), before.alias("from"),
                        F.when(value & (n >= least), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    start = F.struct(state["at"].alias("at"), state["i"].alias("i"), F.lit(0).alias("from"), state["out"].alias("out"))
    found = F.aggregate(parts, start, step, lambda acc: acc["out"])
    return F.when(F.contains(marked, F.lit(MARK)), found).otherwise(F.array().cast(SPAN))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                 repo_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = 2) -> DataFrame:
    """One row per row of ``docs``: id, ``row`` (its place, for joins within
    this result), ``base`` and ``added`` spans (arrays of start, ord, end,
    kind, value) and ``live``, the spans whose value is owner-specific."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, OTHER)).otherwise(text)
    found = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("\u0000")).alias("owner"),
        F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in repo_cols)).alias("repo"),
        text.alias("text"))
    kinds = (*BASE, OWNED)
    for kind, before, value, _ in kinds:
        found = found.withColumn(f"m_{kind}", F.regexp_replace("text", f"({before})({value})", f"{MARK}$1{MARK}$2{MARK}"))
    found = found.select("id", "owner", "repo", *(
        _spans(F.col(f"m_{kind}"), kind, i, least).alias(kind) for i, (kind, _, _, least) in enumerate(kinds)))
    base = F.array_sort(F.concat("assign", "access", "hex"))
    mixed = F.filter("owned", lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]"))
    found = found.select("id", "owner", "repo", base.alias("base"), mixed.alias("owned"))
    extra = F.filter("owned", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    found = materialize(found.select("id", "owner", "repo", "base", extra.alias("owned"),
                                     F.monotonically_increasing_id().alias("row")), "secrets")

    # owners of every candidate value, combined before each shuffle
    cand = (found.where((F.size("base") > 0) | (F.size("owned") > 0))
            .select("row", "owner", "repo", F.explode(F.concat("base", "owned")).alias("s"))
            .select("row", "owner", "repo", "s", F.sha2(F.col("s.value"), 256).alias("h")))
    owners = (cand.select("h", "owner", "repo").distinct()
              .groupBy("h", "owner").agg(F.count(F.lit(1)).alias("repos"))
              .groupBy("h").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos")))
    live = (cand.join(owners.where(F.col("owners") <= max_owners).select("h"), "h", "left_semi")
            .groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("live")))
    none = F.array().cast(SPAN)
    out = found.join(live, "row", "left").withColumn("live", F.coalesce("live", none))
    return out.select(F.col("id").alias(id_col), "row", "base",
                      F.filter("live", lambda s: s["kind"] == OWNED[0]).alias("added"), "live", "owned")


def redacted(docs: DataFrame, text_col: str = "text", owner_col: str = "source",
             repo_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = 2, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every owner-specific candidate value replaced by ``mask``;
    examples that more owners share stay."""
    key, values = free_name(docs, "_key"), free_name(docs, "_live")
    keyed = docs.withColumn(key, F.sha2(F.concat_ws(
        "\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in (owner_col, *repo_cols, text_col))), 256))
    found = find_secrets(keyed, key, text_col, owner_col, repo_cols, max_owners)
    # equal texts of one owner and repository get the same answer, so one row a key is enough
    live = found.where(F.size("live") > 0).groupBy(key).agg(F.first("live").alias(values))
    text = F.col(text_col).cast("string")
    plain = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, OTHER)).otherwise(text)
    out = F.aggregate(
        F.array_sort(F.col(values)), F.struct(F.lit(0).alias("at"), F.lit("").alias("text")),
        lambda acc, s: F.when(s["end"] - F.char_length(s["value"]) < acc["at"], acc).otherwise(F.struct(
            s["end"].alias("at"),
            F.concat(acc["text"], F.substr(plain, acc["at"] + 1, s["end"] - F.char_length(s["value"]) - acc["at"]),
                     F.lit(mask)).alias("text"))),
        lambda acc: F.concat(acc["text"], F.substr(plain, acc["at"] + 1)))
    return (keyed.join(live, key, "left")
            .withColumn(text_col, F.when(F.col(values).isNull(), text).otherwise(out)).select(*docs.columns))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find_secrets(table(spark, sf_dir, "documents"))

    def number(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return got.select("doc_id", *(number(kind) for kind, *_ in BASE), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
                      _joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
                      F.size("live").cast("long").alias("n_live"),
                      (F.size("base") + F.size("owned") - F.size("live")).cast("long").alias("n_example"))
