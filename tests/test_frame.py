"""Dataflow primitives, detection and clean()."""

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from burnish import CleanConfig, DataReader, DataWriter, EmailCleaner, GroupCleaner, NumericCleaner, Pipeline, PipelineConfigError, PythonCleaner, TextCleaner, UuidCleaner, clean
from burnish.functions.sql import register_all
from burnish.functions.types import logical_type, spark_type
from burnish.operators import frame
from burnish.plans.clean import default_cleaners
from burnish.plans.detect import assign
from burnish.sources.wrap import clean_table, read_csv, supports, target_name, wrap
from burnish.streaming.stream import clean_stream


@pytest.fixture()
def people(spark):
    return spark.createDataFrame([(" ada ", "LOVELACE", " Ada@X.org "), ("alan", " turing", "AT@y.org")], "first_name string, last_name string, email string")


def test_types():
    assert [logical_type(spark_type(k)) for k in ("str", "bool", "int", "float", "double")] == ["str", "bool", "int", "double", "double"]
    with pytest.raises(ValueError):
        spark_type("decimal")


def test_primitives(people):
    assert frame.cols(people) == (("first_name", "str"), ("last_name", "str"), ("email", "str"))
    swapped = frame.rename_cols(people, {"first_name": "last_name", "last_name": "first_name", "none": "x"})
    assert swapped.columns == ["last_name", "first_name", "email"] and swapped.first().first_name == "LOVELACE"
    with pytest.raises(ValueError):
        frame.rename_cols(people, {"first_name": "email"})
    out = frame.write_cols(
        people,
        [
            DataWriter("x", (), (("a", "str"),)),
            DataWriter(lambda a, b: f"{a.strip()} {b.strip()}", ("first_name", "last_name"), (("full", "str"),)),
            DataWriter(lambda v: None if v.startswith("alan") else (len(v), v[0]), ("full",), (("n", "int"), ("email", "str"))),
            DataWriter(F.upper("full"), ("full",), (("up", "str"),)),
            DataWriter("unused", (), ()),
        ],
    )
    assert out.columns == ["first_name", "last_name", "email", "a", "full", "n", "up"]
    assert [tuple(r)[2:] for r in out.collect()] == [("a", "x", "ada LOVELACE", 12, "ADA LOVELACE"), (None, "x", "alan turing", None, "ALAN TURING")]
    assert frame.remove_cols(people, ["email", "none"]).columns == ["first_name", "last_name"]
    assert [r.email for r in frame.cast_cols(people, {"email": "int"}, safe=True).collect()] == [None, None]
    assert frame.profile(people, ["email"], 1)[0].email == " Ada@X.org "
    frame.for_each(people, [DataReader(len, ("email",)), DataReader(len, ())])


def test_supports_and_wrap(people):
    assert supports(people) and not supports([1])
    with pytest.raises(TypeError):
        wrap([1])
    frame_ = wrap(pd.DataFrame({"a": [1.0, None], "b": ["x", None], "c": [1, 2], "d": [True, False]}))
    assert [tuple(r) for r in frame_.collect()] == [(1.0, "x", 1, True), (None, None, 2, False)]


def test_detection(spark):
    df = spark.createDataFrame([("1,5", "123e4567-e89b-42d3-a456-426614174000", None, 3, "x", [1])] * 30, "a string, ident string, nothing string, price int, notes string, arr array<int>")
    found = {c: (type(k).__name__ if k else None, round(s, 3)) for c, (k, s) in assign(df, df.columns, default_cleaners()).items()}
    assert found == {"a": ("NumericCleaner", 0.7), "ident": ("UuidCleaner", 0.9), "nothing": ("TextCleaner", 0.1), "price": ("NumericCleaner", 1.0), "notes": ("TextCleaner", 0.8), "arr": (None, 0.0)}
    assert UuidCleaner().get_data_type_confidence(df, ("ident",)) == 0.9 and NumericCleaner().get_data_type_confidence(df, ()) == 0.0


def test_clean(people):
    out = clean(people, use_global_config=False)
    assert out.columns[3:] == ["first_name_cleaned", "last_name_cleaned", "email_cleaned"]
    assert [tuple(r)[3:] for r in out.collect()] == [("ada", "lovelace", "ada@x.org"), ("alan", "turing", "at@y.org")]
    inplace = clean(people, use_global_config=False, inplace=True, cleaners={"email": EmailCleaner(split_components=True)}, ignore_cols=["last_name"])
    assert inplace.columns == ["first_name", "last_name", "email_local", "email_tag", "email_domain"]
    assert clean(people, clean_cols=False, rename_col_map={"email": "Mail"}).columns == ["first_name", "last_name", "Mail"]
    with pytest.raises(ValueError):
        clean(people, cleaners={"none": TextCleaner()})
    with pytest.raises(ValueError):
        clean(people.withColumn("email_cleaned", F.lit(1)), cleaners={"email": EmailCleaner()}, ignore_cols=["email_cleaned"])
    assert CleanConfig().inplace is False
    assert clean(people.limit(0), use_global_config=False).count() == 0


def test_clean_of_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text('ID,First Name,Email,Fax\n1,"Ann, B",a@b.com,N/A\nNaN,Bob,,\n')
    out = clean(read_csv(spark, str(tmp_path / "x.csv")), use_global_config=False)
    assert [(r.id_cleaned, r.first_name_cleaned, r.email_cleaned, r.fax_cleaned) for r in out.collect()] == [(1.0, "ann, b", "a@b.com", None), (None, "bob", None, None)]


def test_sql_functions(spark):
    assert "clean_email" in register_all(spark)
    row = spark.sql("SELECT clean_email('A@b.com') e, clean_numeric('$1,5') n, clean_country('IND') c, clean_datetime('19-06-2026') d, clean_bool('no') b").first()
    assert tuple(row) == ("a@b.com", 15.0, "India", "2026-06-19T00:00:00", False)


def test_tables(spark, people, tmp_path):
    assert target_name("a.b.t", "x.y.*") == "x.y.t"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS burnish_t LOCATION '{tmp_path}/db'")
    people.write.saveAsTable("burnish_t.people")
    name = clean_table(spark, "burnish_t.people", "burnish_t.clean_*".replace("*", "people"), use_global_config=False)
    assert spark.table(name).count() == 2 and "email_cleaned" in spark.table(name).columns
    spark.sql("DROP DATABASE burnish_t CASCADE")


def test_stream_equals_batch(spark, people, tmp_path):
    people.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(people.schema).parquet(str(tmp_path / "in"))
    clean_stream(source, str(tmp_path / "out"), str(tmp_path / "ck"), use_global_config=False).awaitTermination()
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(clean(people, use_global_config=False))


def test_pipeline(people):
    both = GroupCleaner(("first", "last"), lambda c: {"full": F.concat_ws(" ", c["first"], c["last"])}, ("full",))
    steps = {"first": ("first_name", TextCleaner()), "last": ("last_name", TextCleaner())}
    assert [r.full for r in Pipeline(steps, (both,)).fit_transform(people).collect()] == ["ada lovelace", "alan turing"]
    with pytest.raises(PipelineConfigError):
        Pipeline({"a": ("b", TextCleaner()), "b": ("a", TextCleaner())}).fit_transform(people)


def test_custom_cleaner(people):
    one = PythonCleaner(fn=lambda v: v.strip()[::-1])
    two = PythonCleaner(fn=lambda v: tuple(v.strip().split("@")), kinds=(("user", "str"), ("host", "str")))
    out = clean(people, cleaners={"first_name": one, "email": two}, ignore_cols=["last_name"], use_global_config=False)
    assert [(r.first_name_cleaned, r.email_user_cleaned, r.email_host_cleaned) for r in out.collect()] == [("ada", "Ada", "X.org"), ("nala", "AT", "y.org")]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=30), min_size=1, max_size=40))
def test_idempotent(spark, texts):
    """Cleaning twice is cleaning once, and nothing ever fails."""
    df = spark.createDataFrame([(t.replace("\ud800", ""),) for t in texts], "v string")
    for cleaner in default_cleaners():
        once = df.select(cleaner.clean_expr("v").cast("string").alias("v"))
        if isinstance(cleaner, (EmailCleaner, UuidCleaner)):
            twice = once.select("v", cleaner.clean_expr("v").alias("w"))
            assert all(r.v == r.w for r in twice.collect())
        else:
            once.collect()
