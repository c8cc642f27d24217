"""Stage A on hand-made rows, and sources and sinks."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import validate
from ledgerloom.operators.identity import attach_canonical, remap, split_unmapped
from ledgerloom.sources import landing
from ledgerloom.sources.contracts import CONTRACTS, FeedContract
from tests.conftest import rows_of

SIMPLE = FeedContract("t", "id", required=("id", "name"), non_null=("id", "name"))
SCHEMA = "id string, name string"


def reasons(df, contract=SIMPLE, **kw):
    gate = validate.validate_feed(df, contract, lineage=False, **kw)
    return rows_of(gate.tagged, "id", "name", "_quarantine_reason", "_valid")


def test_reasons_accumulate_in_order(frame):
    df = frame([("1", "a"), ("2", " "), (None, None), ("3", "x"), ("3", "y")], SCHEMA)
    assert reasons(df) == sorted([
        ("1", "a", None, True),
        ("2", " ", "null:name;", False),
        (None, None, "null:id;null:name;null_pk:id;", False),
        ("3", "x", "dup_pk:id;", False),
        ("3", "y", "dup_pk:id;", False),
    ], key=repr)


def test_null_keys_count_as_repeats_of_each_other(frame):
    got = reasons(frame([(None, "a"), (None, "b"), ("1", "c")], SCHEMA))
    assert [r[2] for r in got if r[0] is None] == ["null:id;null_pk:id;dup_pk:id;"] * 2


def test_hot_key_keeps_every_row(frame):
    rows = [("hot", str(i)) for i in range(500)] + [(str(i), "x") for i in range(1000)]
    df = frame(rows, SCHEMA)
    gate = validate.validate_feed(df, SIMPLE, lineage=False, repeated=landing.materialize(validate.repeated_keys(df, SIMPLE.pk)))
    assert (gate.valid.count(), gate.quarantine.count()) == (1000, 500)


def test_rows_are_counted_without_a_join(spark, frame):
    """Blank and NULL columns, repeated, hot and NULL keys, a feed without rows, and one without repeats."""
    hot = [("hot", str(i) if i % 3 else " ") for i in range(30)]
    for rows in (hot + [("1", "a"), ("2", " "), (None, "x"), (None, None), ("3", "x"), ("3", None), ("4", "y")], [], [("1", "a"), ("2", "")]):
        df = landing.materialize(frame(rows, SCHEMA))
        known = landing.materialize(validate.repeated_keys(df, SIMPLE.pk, clean=validate.clean_row(SIMPLE)))
        gate = validate.validate_feed(df, SIMPLE, lineage=False, repeated=known)
        got = validate.summarize({("s", "t"): gate})
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
        plain = validate.summarize({("s", "t"): validate.validate_feed(df, SIMPLE, lineage=False)})
        assert rows_of(got) == rows_of(plain) and got.schema["valid"].dataType == plain.schema["valid"].dataType
        assert gate.tagged.columns == [*df.columns, "_quarantine_reason", "_valid"]


def test_missing_column_fails_the_feed(frame):
    gate = validate.validate_feed(frame([("1",), ("2",)], "id string"), SIMPLE, lineage=False)
    assert gate.missing == ["name"]
    assert gate.valid.count() == 0
    assert {r["_quarantine_reason"] for r in gate.quarantine.collect()} == {"missing_columns: name"}


def test_lineage_columns_are_required(frame):
    gate = validate.validate_feed(frame([("1", "a")], SCHEMA), SIMPLE)
    assert "_record_id" in gate.missing
    status = validate.summarize({("s", "t"): gate}).first()["status"]
    assert status == "STRUCTURAL FAIL"


def test_domains(frame):
    c = FeedContract("t", "id", (), (), enums={"kind": ["a", "b"]}, minimum_zero=("n",), dates=("d",))
    df = frame([("1", "a", "1.5", "2020-01-31"), ("2", "z", "-1", "2020-02-30"), ("3", None, None, None), ("4", "b", "x", "soon")],
               "id string, kind string, n string, d string")
    got = dict(rows_of(validate.check_domains(df, c).tagged, "id", "_quarantine_reason"))
    assert got == {"1": None, "2": "domain:kind;minimum:n;type:d;", "3": None, "4": "type:n;type:d;"}


def test_references(frame):
    child = frame([("r1", "c1"), ("r2", "c9"), ("r3", None)], "id string, fk string")
    parent = frame([("c1",), ("c1",)], "id string")
    got = dict(rows_of(validate.check_references(child, "fk", parent, "id").tagged, "id", "_quarantine_reason"))
    assert got == {"r1": None, "r2": "orphan:fk;", "r3": None}


def test_freshness_of_empty_and_old_feeds(frame):
    feeds = {
        ("s", "new"): frame([("2020-01-09T00:00:00+00:00",)], "_ingestion_ts string"),
        ("s", "old"): frame([("2019-01-01T00:00:00+00:00",)], "_ingestion_ts string"),
        ("s", "none"): frame([], "_ingestion_ts string"),
    }
    got = dict(rows_of(validate.freshness(feeds, "2020-01-10", 7), "entity", "status"))
    assert got == {"new": "FRESH", "old": "STALE", "none": "EMPTY"}


def test_lineage_check_finds_a_wrong_stamp(frame):
    df = landing.stamp_lineage(frame([("1",), ("2",)], "id string"), "s", "f", "2020-01-01T00:00:00+00:00", "b", key=["id"])
    df = df.withColumn("_source_system", F.when(F.col("id") == "1", "other").otherwise(F.col("_source_system"))).drop("_batch_id")
    row = validate.check_lineage(df, "s").first()
    assert (row["n_rows"], row["wrong_source"], row["missing_columns"]) == (2, 1, 1)


def test_record_ids(frame):
    df = frame([("1",), ("2",)], "id string")
    stamp = lambda **kw: rows_of(landing.stamp_lineage(df, "s", "f", "t", "b", **kw), "_record_id")
    assert stamp(key=["id"]) == stamp(key=["id"])
    assert stamp() != stamp()


def test_unmapped_rows_are_set_apart(frame):
    mapping = frame([("C1", "company", "a", "v1"), ("C2", "company", "b", "v2")],
                    "canonical_id string, entity_type string, source_system string, vendor_id string")
    df = attach_canonical(frame([("v1",), ("v2",), ("v9",)], "vid string"), mapping, "company", "a", "vid")
    mapped, unmapped = split_unmapped(df)
    assert rows_of(mapped) == [("v1", "C1")]
    assert rows_of(unmapped, "vid", "_quarantine_reason") == [("v2", "unmapped"), ("v9", "unmapped")]


def test_remap_needs_the_right_source(frame):
    mapping = frame([("C1", "company", "a", "x"), ("C2", "company", "b", "x")],
                    "canonical_id string, entity_type string, source_system string, vendor_id string")
    df = frame([("x", "a"), ("x", "b"), ("y", "a")], "vid string, best_source string")
    assert rows_of(remap(df, mapping, {"vid": ("company", "company_id")})) == [
        ("x", "a", "C1"), ("x", "b", "C2"), ("y", "a", None)]


def test_read_feed_falls_back_and_reports(spark, frame, tmp_path):
    df = frame([("1", "a")], SCHEMA)
    df.write.parquet(str(tmp_path / "folder"))
    df.write.option("header", True).csv(str(tmp_path / "text.csv"))
    assert landing.read_feed(spark, str(tmp_path), "folder").count() == 1
    assert landing.read_feed(spark, str(tmp_path), "text").first()["name"] == "a"
    with pytest.raises(FileNotFoundError):
        landing.read_feed(spark, str(tmp_path), "nothing")


def test_broken_parquet_is_not_skipped(spark, frame, tmp_path):
    (tmp_path / "bad.parquet").write_bytes(b"not parquet")
    frame([("1", "a")], SCHEMA).write.option("header", True).csv(str(tmp_path / "bad.csv"))
    with pytest.raises(Exception, match="(?i)parquet"):
        landing.read_feed(spark, str(tmp_path), "bad").count()


def test_sinks(spark, frame, tmp_path):
    df = frame([("1", "a")], SCHEMA)
    assert landing.save_if_any(df, str(tmp_path / "q")) is True
    assert landing.save_if_any(df.limit(0), str(tmp_path / "none")) is False
    assert not (tmp_path / "none").exists()


def test_save_table_replaces_the_schema(spark, frame, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS ll_test LOCATION '{tmp_path}/db'")
    try:
        landing.save_table(frame([("1",)], "id string"), "ll_test.t")
        landing.save_table(frame([("1", "a")], SCHEMA), "ll_test.t", partition_by=["id"])
        assert sorted(landing.read_named(spark, "ll_test", "t").columns) == ["id", "name"]
    finally:
        spark.sql("DROP DATABASE ll_test CASCADE")


def test_nested_to_json(frame):
    df = frame([(["a", "b"], ("x", 1), "s"), (None, None, None)], "l array<string>, s struct<k:string,n:int>, t string")
    assert rows_of(landing.nested_to_json(df)) == sorted([('["a","b"]', '{"k":"x","n":1}', "s"), (None, None, None)], key=repr)
    assert dict(landing.nested_to_json(df, ["l"]).dtypes)["s"].startswith("struct")


def test_compact_sorts_inside_files(spark, frame, tmp_path):
    df = frame([(i * 7 % 100, i) for i in range(1000)], "k int, v int")
    back = landing.compact(df, str(tmp_path / "c"), ["k", "v"], files=4)
    assert back.count() == 1000
    files = back.groupBy(F.input_file_name().alias("f")).agg(F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("lo").collect()
    assert len(files) > 1
    assert all(a["hi"] <= b["lo"] for a, b in zip(files, files[1:]))


def test_contracts_cover_all_feeds():
    assert set(CONTRACTS) == {"companies", "funding_rounds", "investors", "investments", "people", "deals", "documents"}
