"""Sources: nested JSON pages, failure policy, long CSV ingest."""
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from panelforge.sources import files, ingest


def _wb_page(spark, recs):
    doc = json.dumps([{"page": 1}, recs])
    return spark.createDataFrame([(doc,)], "payload string")


def test_indicator_page_parse_and_filters(spark):
    recs = [{"country": {"value": "Austria"}, "countryiso3code": "aut", "date": "2001", "value": 1.5},
            {"country": {"value": "Nowhere"}, "countryiso3code": "xxx", "date": "2001", "value": 2.0},
            {"country": {"value": "Austria"}, "countryiso3code": "aut", "date": "2002", "value": None}]
    ents = spark.createDataFrame([("AUT",)], "Code string")
    out = ingest.ingest_indicator(_wb_page(spark, recs), "gdp", ents).collect()
    assert [(r.Country, r.Code, r.Year, r.gdp) for r in out] == [("Austria", "AUT", 2001, 1.5)]


def test_failure_policy_skip_and_fail(spark):
    base = spark.createDataFrame([("AUT", 2001)], "Code string, Year int")
    good = _wb_page(spark, [{"country": {"value": "A"}, "countryiso3code": "aut", "date": "2001", "value": 3.0}])
    empty = _wb_page(spark, [])
    out, skipped = ingest.ingest_indicators({"a": good, "b": empty}, base)
    assert skipped == ["b"] and out.first().a == 3.0
    with pytest.raises(RuntimeError):
        ingest.ingest_indicators({"b": empty}, base, on_empty="fail")


def test_odata_filter_and_empty_raises(spark):
    page = {"value": [{"SpatialDim": "AUT", "TimeDim": 2001, "Dim1": "SEX_BTSX", "Dim2": "AGEGROUP_YEARSALL",
                       "NumericValue": 10.0},
                      {"SpatialDim": "AUT", "TimeDim": 2001, "Dim1": "SEX_MLE", "Dim2": "AGEGROUP_YEARSALL",
                       "NumericValue": 99.0}]}
    df = spark.createDataFrame([(json.dumps(page),)], "payload string")
    assert [tuple(r) for r in ingest.ingest_odata(df).collect()] == [("AUT", 2001, 10.0)]
    none = spark.createDataFrame([(json.dumps({"value": []}),)], "payload string")
    with pytest.raises(RuntimeError):
        ingest.ingest_odata(none)


def test_unit_rescale_only_if_present(spark):
    df = spark.createDataFrame([(1.5,)], "per1000 double")
    assert ingest.unit_rescale(df, "per1000", "per100k").first().per100k == 150.0
    assert ingest.unit_rescale(df, "absent", "x").columns == ["per1000"]


def _write_csv(rows):
    d = tempfile.mkdtemp(prefix="pf-csv-")
    p = os.path.join(d, "m.csv")
    with open(p, "w") as f:
        f.write("location_name,year,cause_name,val,other\n")
        for r in rows:
            f.write(",".join(map(str, r)) + ",x\n")
    return p


def test_long_csv_pivot_unknown_name_and_year_filter(spark):
    p = _write_csv([("Austria", 2001, "All causes", 3), ("Austria", 2001, "A", 1), ("Austria", 2001, "B", 2),
                    ("Atlantis", 2001, "All causes", 1), ("Atlantis", 2001, "A", 5), ("Atlantis", 2001, "B", 6),
                    ("Austria", 1990, "All causes", 3), ("Austria", 1990, "A", 1), ("Austria", 1990, "B", 2)])
    dim = spark.createDataFrame([("austria", "AUT")], "name string, Code string")
    out = {r.Country: r for r in files.scan_csv_long(spark, p, dim, min_year=2000).collect()}
    assert set(out) == {"Austria", "Atlantis"}
    assert out["Austria"].Code == "AUT" and out["Atlantis"].Code is None   # unknown name kept
    assert "All causes" not in out["Austria"].asDict() and out["Austria"].A == 1.0


def test_long_csv_duplicate_key_raises(spark):
    p = _write_csv([("Austria", 2001, "All causes", 3), ("Austria", 2001, "A", 1), ("Austria", 2001, "A", 2)])
    dim = spark.createDataFrame([("austria", "AUT")], "name string, Code string")
    with pytest.raises(Exception, match="duplicate"):
        files.scan_csv_long(spark, p, dim).collect()


def test_save_and_load_by_extension(spark):
    df = spark.createDataFrame([(1, 2.5)], "a int, b double")
    base = tempfile.mkdtemp(prefix="pf-io-")
    back = files.load_table(spark, files.save_table(df, base + "/t.parquet"))
    assert back.collect() == df.collect()
    back = files.load_table(spark, files.save_table(df, base + "/t.csv"), csv_schema=df.schema)
    assert back.collect() == df.collect()


def test_malformed_rows_raise_or_are_kept_apart(spark, tmp_path):
    path = str(tmp_path / "export.csv")
    lines = ["location_name,year,cause_name,val,extra", "Aland,2001,All causes,1.5,x", "Aland,2001,b,2.5,x", "Aland,20O2,b,3,x", "Aland,2003,b,n/a,x", "Aland,,b,4,x", "Aland,2004,b,,x",
             "Aland,2004,All causes,1,x"]
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    dim = spark.createDataFrame([("Aland", "AL")], "name string, Code string")
    with pytest.raises(ValueError, match="3 malformed rows"):
        files.scan_csv_long(spark, path, dim)
    kept = files.scan_csv_long(spark, path, dim, rejects=str(tmp_path / "rejects"))
    assert sorted((r["Year"], r["b"]) for r in kept.collect()) == [(2001, 2.5), (2004, None)]
    rejects = spark.read.parquet(str(tmp_path / "rejects")).collect()
    assert sorted(r["reason"] for r in rejects) == ["val is not a double", "year is empty", "year is not a int"]
    assert all(r["file"].endswith("export.csv") for r in rejects) and any('"20O2"' in r["line"] for r in rejects)
