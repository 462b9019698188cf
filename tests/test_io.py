import os
import tempfile

import pytest

from tessera.sinks import writers
from tessera.sources.csv import load_csv


def _write(data: bytes) -> str:
    d = tempfile.mkdtemp(prefix="tessera-test-", dir="/tmp")
    p = os.path.join(d, "f.csv")
    with open(p, "wb") as f:
        f.write(data)
    return p


def test_messy_csv(spark):
    p = _write(b"a;b;c;d;e\n1;x;2024-01-01;True;1\nNA;y;2024-01-02;False;2\n3;n/a;2024-01-03;True;\n")
    df = load_csv(spark, p)
    assert dict(df.dtypes) == {"a": "double", "b": "string", "c": "string", "d": "boolean", "e": "double"}
    assert df.where("a is null").count() == 1 and df.where("b is null").count() == 1


def test_latin1_csv(spark):
    df = load_csv(spark, _write("name,val\ncafé,1\n".encode("latin1")))
    assert df.collect()[0]["name"] == "café" and dict(df.dtypes)["val"] == "bigint"


def test_one_column_and_empty_csv_fail(spark):
    with pytest.raises(ValueError):
        load_csv(spark, _write(b"only\n1\n2\n"))
    with pytest.raises(ValueError):
        load_csv(spark, _write(b""))


def test_quotes_and_line_breaks(spark):
    df = load_csv(spark, _write(b'id,t,u\n1,"x\ny",a\n2,"say ""hi"", ok",b\n'))
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "x\ny", "a"), (2, 'say "hi", ok', "b")]


def test_record_with_too_many_fields_fails(spark):
    with pytest.raises(ValueError):
        load_csv(spark, _write(b"a,b\n1,2\n3,4,5\n"))


def test_codes_are_no_numbers(spark):
    df = load_csv(spark, _write(b"code,x,n\n10D,1,+1e3\n20F,2,.5\n30d,3,-inf\n"))
    assert dict(df.dtypes) == {"code": "string", "x": "bigint", "n": "double"}


def test_latin1_beyond_the_head(spark):
    body = b"".join(b"%d,abcdefghijklmnopqrstuvwxyz\n" % i for i in range(4000))
    df = load_csv(spark, _write(b"id,t\n" + body + "9999,caf\u00e9\n".encode("latin1")))
    assert df.where("id = 9999").collect()[0]["t"] == "caf\u00e9"


def test_any_header(spark):
    from tessera.operators import clean, encode, profile
    df = load_csv(spark, _write(b"id,sepal.length,A,a,\n1,1.5,x,2,p\n2,,y,3,q\n3,4.5,x,9,r\n"))
    assert df.columns == ["id", "sepal.length", "A", "a.1", "Unnamed: 4"]
    assert clean.impute(df, "Mean").orderBy("id").collect()[1]["sepal.length"] == 3.0
    assert {r["column"] for r in profile.describe(df).collect()} == {"id", "sepal.length", "a.1"}
    assert profile.column_overview(df, "id").count() == 5 and profile.auto_remove(df).count() > 0
    assert clean.remove_outliers(df, "IQR").count() == 2 and clean.clip_percentiles(df).count() == 3
    assert "sepal.length" in encode.preprocess(df, ["id"]).feature_names


def test_csv_round_trip(spark):
    df = spark.createDataFrame([(1, 2.5, "a"), (2, None, "b")], "k bigint, v double, s string")
    out = tempfile.mkdtemp(prefix="tessera-out-", dir="/tmp") + "/t"
    writers.write_labelled(df, out)
    back = load_csv(spark, out)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_model_save_load_scores_the_same(spark):
    from tessera.operators import encode
    from tessera.operators.kmeans import assign, kmeans_fit
    from tessera.sources import tables as T
    cf = T.customer_features(spark, "/root/testdata/sf0.001")
    enc = encode.preprocess(cf, ["c_custkey"])
    fit = kmeans_fit(enc.frame, "c_custkey", 3)
    path = tempfile.mkdtemp(prefix="tessera-model-", dir="/tmp") + "/m"
    writers.save_model(spark, path, "KMeans", {"n_clusters": 3}, enc, centres=fit.centres)
    model = writers.load_model(spark, path)
    a = {r["c_custkey"]: r["cluster"] for r in assign(enc.frame, fit.centres).collect()}
    b = {r["c_custkey"]: r["cluster"] for r in writers.score(model, cf, "c_custkey").collect()}
    assert a == b
