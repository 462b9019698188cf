"""CSV scan with the loader's behaviour: encoding and separator fallbacks,
missing-value tokens, and type inference.

* The driver reads only the first ``sniff_bytes`` of the file (through the
  Hadoop FileSystem API, so any cluster path works) to choose the separator
  (comma if that yields two or more columns, otherwise a sniffed one) and
  the names. The encoding (utf-8, with or without BOM, else latin-1) is
  decided on all lines in a distributed pass.
* One distributed scan reads every column as a string; the missing-value
  tokens become NULL.
* Types come from one aggregate pass that counts, per column, the values
  that do not parse as integer / double / boolean: integer without gaps ->
  bigint, integer with gaps -> double, numeric -> double, boolean without
  gaps -> boolean, anything else (dates included) -> string.
"""

from __future__ import annotations

import csv as _csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.exprs import ref

# The tokens read as missing.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# The spellings read as booleans.
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")
#: A numeric text: what only some parsers take for a number (10D, 0x1F, 1_000) is a text.
INTEGER = r"^[+-]?[0-9]+$"
NUMBER = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"
ENCODINGS = ("utf-8", "utf-8-sig", "latin1")


def _head_bytes(spark: SparkSession, path: str, n: int) -> bytes:
    """First ``n`` bytes of the (first) file, read on the driver."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if fs.getFileStatus(p).isDirectory():
        files = [st.getPath() for st in fs.listStatus(p)
                 if st.isFile() and not st.getPath().getName().startswith(("_", "."))]
        if not files:
            raise ValueError(f"no file under {path}")
        p = sorted(files, key=lambda q: q.toString())[0]
    stream = fs.open(p)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def _decode(head: bytes, enc: str) -> str | None:
    """Decode, tolerating a multi-byte character cut at the end of the sample."""
    try:
        return head.decode(enc)
    except UnicodeDecodeError as e:
        if e.start >= len(head) - 3:
            try:
                return head[: e.start].decode(enc)
            except UnicodeDecodeError:
                return None
        return None


def _columns(text: str, sep: str) -> int:
    lines = text.splitlines()
    return len(next(_csv.reader(io.StringIO(lines[0]), delimiter=sep), [])) if lines else 0


def sniff(head: bytes) -> tuple[str, str]:
    """(encoding, separator): utf-8, utf-8 with BOM, latin-1 with a comma,
    in that order, the first giving two or more columns; otherwise a
    sniffed separator."""
    for enc in ENCODINGS:
        text = _decode(head, enc)
        if text is not None and _columns(text.lstrip("\ufeff"), ",") >= 2:
            return enc, ","
    enc = "utf-8" if _decode(head, "utf-8") is not None else "latin1"
    text = _decode(head, enc).lstrip("\ufeff")
    try:
        sep = _csv.Sniffer().sniff("\n".join(text.splitlines()[:20])).delimiter
    except _csv.Error as exc:
        raise ValueError(f"no separator found in the head of the file ({exc})") from exc
    return enc, sep


_JAVA_CHARSET = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "latin1": "ISO-8859-1"}
EXTRA = "_beyond_header"


def _whole_file_is_utf8(spark: SparkSession, path: str) -> bool:
    """Every line of every file, checked in the tasks."""
    return spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty()


def _has_quoted_newlines(spark: SparkSession, path: str) -> bool:
    """A line with an odd number of quotes is part of a record that goes on."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def header_names(names: list[str]) -> list[str]:
    """Column names from a header: empty names get their position, repeated
    names (however capitalised) a number, so that every column can be addressed."""
    out: list[str] = []
    seen: set[str] = set()
    for i, raw in enumerate(names):
        base = name = raw if raw.strip() else f"Unnamed: {i}"
        k = 0
        while name.lower() in seen:
            k += 1
            name = f"{base}.{k}"
        seen.add(name.lower())
        out.append(name)
    return out


def read_strings(spark: SparkSession, path: str, sniff_bytes: int = 65536) -> DataFrame:
    """Every column as a string. The head of the file chooses the separator
    and the names; the encoding must hold for all of its lines. Files stay
    splittable unless a quoted field holds a line break."""
    head = _head_bytes(spark, path, sniff_bytes)
    if not head.strip():
        raise ValueError("no data: the file is empty")
    enc, sep = sniff(head)
    if enc != "latin1" and not _whole_file_is_utf8(spark, path):
        enc = "latin1"
    text = head.decode("latin1" if enc == "latin1" else "utf-8", "ignore").lstrip("\ufeff")
    names = header_names(next(_csv.reader(io.StringIO(text), delimiter=sep)))
    schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(names))] + [T.StructField(EXTRA, T.StringType())])
    df = (spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("sep", sep)
          .option("quote", '"').option("escape", '"').option("encoding", _JAVA_CHARSET[enc])
          .option("multiLine", _has_quoted_newlines(spark, path)).csv(path))
    wide = df.where(F.col(EXTRA).isNotNull())
    if not wide.isEmpty():
        raise ValueError(f"a record has more fields than the {len(names)} of the header")
    return to_missing(df.select(*[F.col(f"_{i}").alias(n) for i, n in enumerate(names)]))


def to_missing(df: DataFrame) -> DataFrame:
    """Missing-value tokens -> NULL on every string column."""
    toks = F.array(*[F.lit(t) for t in NA_TOKENS])
    return df.select(*[F.when(ref(c).isNull() | F.array_contains(toks, ref(c)), F.lit(None).cast("string"))
                       .otherwise(ref(c)).alias(c) for c in df.columns])


def infer_types(df: DataFrame) -> dict[str, str]:
    """Spark type name per column of an all-string frame (one aggregate)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    bools = F.array(*[F.lit(t) for t in TRUE_TOKENS + FALSE_TOKENS])
    for i, c in enumerate(df.columns):
        v = F.trim(ref(c))
        aggs += [F.count(ref(c)).alias(f"nn{i}"),
                 F.count(F.when(ref(c).isNotNull() & (~v.rlike(INTEGER) | v.try_cast("bigint").isNull()), 1)).alias(f"bi{i}"),
                 F.count(F.when(ref(c).isNotNull() & (~v.rlike(NUMBER) | v.try_cast("double").isNull()), 1)).alias(f"bd{i}"),
                 F.count(F.when(ref(c).isNotNull() & ~F.array_contains(bools, ref(c)), 1)).alias(f"bb{i}")]
    r = df.agg(*aggs).collect()[0]
    out = {}
    for i, c in enumerate(df.columns):
        nn, n = r[f"nn{i}"], r["n"]
        if nn == 0:
            out[c] = "double"            # an all-missing column is a float column of NaN
        elif r[f"bi{i}"] == 0:
            out[c] = "bigint" if nn == n else "double"
        elif r[f"bd{i}"] == 0:
            out[c] = "double"
        elif r[f"bb{i}"] == 0 and nn == n:
            out[c] = "boolean"
        else:
            out[c] = "string"
    return out


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    out = []
    for c in df.columns:
        t = types[c]
        v = F.trim(ref(c))
        if t == "boolean":
            out.append(F.array_contains(F.array(*[F.lit(x) for x in TRUE_TOKENS]), ref(c)).alias(c))
        elif t in ("bigint", "double"):
            out.append(v.try_cast(t).alias(c))
        else:
            out.append(ref(c))
    return df.select(*out)


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read, type and validate a CSV: non-empty and at least two columns."""
    raw = read_strings(spark, path)
    if len(raw.columns) < 2:
        raise ValueError("one column only: two or more are needed")
    if raw.isEmpty():
        raise ValueError("no data: the file has a header and no rows")
    return apply_types(raw, infer_types(raw))


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """Any input path: parquet directly, CSV through :func:`load_csv`."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return load_csv(spark, path)


def preview(df: DataFrame, order_by: list[str], n: int = 20) -> DataFrame:
    return df.orderBy(*order_by).limit(n)
