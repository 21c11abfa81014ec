"""Golden values of the column functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from assetflow.functions import flags, paths, text, times
from assetflow.plans.template import Template


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'long'}" for k, v in values.items()))
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    ("start", "length", "want"),
    [(1, None, "123456789"), (-1, None, "9"), (3, None, "3456789"), (-3, None, "789"), (12, None, ""), (-12, None, "0123456789"), (3, 2, "34"), (-3, 2, "78"), (3, -2, "12"), (-3, -2, "56"), (3, 12, "3456789"), (-3, -12, "0123456")],
)
def test_substr(spark, start, length, want):
    assert one(spark, text.substr(F.col("x"), start, length), x="0123456789") == want


def test_substr_code_points(spark):
    assert one(spark, text.substr(F.col("x"), 1, 3), x="äÖêÉß") == "ÖêÉ"


@pytest.mark.parametrize(
    ("path", "directory", "filename", "stem", "extension"),
    [
        ("/root/parent/child.ext", "/root/parent", "child.ext", "child", ".ext"),
        ("/root/parent/", "/root/parent", ".", ".", ""),
        ("/root/parent", "/root", "parent", "parent", ""),
        ("/root/parent.long-extension", "/root", "parent.long-extension", "parent", ".long-extension"),
        ("/root/", "/root", ".", ".", ""),
        ("/root", "/", "root", "root", ""),
        ("/", "", "/", "/", ""),
        ("", "", "", "", ""),
        ("a", "", "a", "a", ""),
        ("a/b.tar.gz", "a", "b.tar.gz", "b.tar", ".gz"),
        ("a/..", "a", "..", "..", ""),
    ],
)
def test_path_parts(spark, path, directory, filename, stem, extension):
    row = spark.createDataFrame([(path,)], "p string").select(*[f(F.col("p")) for f in (paths.directory, paths.filename, paths.stem, paths.extension)]).first()
    assert tuple(row) == (directory, filename, stem, extension)


def test_escape_and_replace(spark):
    assert one(spark, text.escape(F.col("x")), x='"abc"') == r"\"abc\""
    assert one(spark, text.escape(F.col("x")), x=r"C:\abc.txt") == r"C:\\abc.txt"
    assert one(spark, text.replace_delimited(F.col("x"), ",[h-o]{5},,"), x="abcdefghijklmnopqrstuvwxyz") == "abcdefgmnopqrstuvwxyz"
    assert one(spark, text.replace_delimited(F.col("x"), r"|^..(.*)..$|\1|"), x="ABCDEFGHIJKLMNOPQRSTUVWXYZ") == "CDEFGHIJKLMNOPQRSTUVWX"
    assert one(spark, text.replace_regex(F.col("x"), "a", "$1"), x="abc") == "$1bc"


def test_separators(spark):
    assert one(spark, text.win(F.col("x")), x="a/b") == "a\\b"
    assert one(spark, text.unix(F.col("x")), x="a\\b") == "a/b"
    assert one(spark, paths.correct_separator(F.col("x")), x="a\\\\/b//c") == "a/b/c"
    assert one(spark, paths.normalize(F.col("x")), x="/a/./b/../c") == "/a/c"
    with pytest.raises(Exception, match="too many parents"):
        one(spark, paths.normalize(F.col("x")), x="a/../..")
    assert one(spark, paths.has_base(F.col("x"), F.col("b")), x="/a/b/c", b="/a/./b") is True
    assert one(spark, paths.has_base(F.col("x"), F.col("b")), x="/a/bc", b="/a/b") is False
    assert one(spark, paths.remove_base(F.col("x"), F.col("b")), x="/a/b/c", b="/a") == "b/c"
    assert one(spark, paths.remove_base(F.col("x"), F.col("b")), x="/a/b/c", b="/x") == "/a/b/c"


@pytest.mark.parametrize(("size", "want"), [(0, "0 bytes"), (1, "1 byte"), (1024, "1024 bytes"), (1536, "1.5 KiB"), (1024**2, "1024.0 KiB"), (3 * 1024**3, "3.0 GiB"), (None, None)])
def test_human_size(spark, size, want):
    df = spark.createDataFrame([(size,)], "x long")
    assert df.select(text.human_size(F.col("x"))).first()[0] == want


def test_text_values(spark):
    assert one(spark, text.to_bool(F.col("x")), x="TrUe") is True
    with pytest.raises(Exception, match="not a boolean"):
        one(spark, text.to_bool(F.col("x")), x="yes")
    assert tuple(one(spark, text.parse_key_value(F.col("x")), x="_a1=b=c")) == ("_a1", "b=c")
    assert one(spark, text.parse_key_value(F.col("x")), x="1a=b") is None


def test_times(spark):
    t = datetime.datetime(2024, 1, 2, 3, 4, 5, 678000)
    df = spark.createDataFrame([(t,), (None,)], "t timestamp_ntz").withColumn("t", F.col("t").cast("timestamp"))
    assert [r[0] for r in df.select(times.format_millis(F.col("t"))).collect()] == ["2024-01-02 03:04:05.678", "????-??-?? ??:??:??.???"]
    assert one(spark, times.to_unix_time(times.from_sql_time(F.col("x"))), x=2208988800) == 0
    base = F.timestamp_seconds(F.lit(100))
    row = spark.range(1).select(times.was_modified(F.timestamp_seconds(F.lit(101)), base), times.was_modified(F.timestamp_seconds(F.lit(100.9)), base), times.was_modified(F.lit(None).cast("timestamp"), base)).first()
    assert tuple(row) == (True, False, False)


def test_flags(spark):
    assert one(spark, flags.has_flags(F.col("x"), 3), x=7) is True
    assert one(spark, flags.has_flags(F.col("x"), 3), x=5) is False
    assert one(spark, flags.remove_flags(F.col("x"), 3), x=7) == 4
    assert one(spark, flags.reason_string(F.col("x")), x=6) == " MC"


def test_a_variable_is_checked_once_where_it_is_used(spark):
    # Functions repeat their argument, so a check inside them is there many times.
    made = spark.createDataFrame([("a/doc_0.txt",), ("a/b.c/d",)], "path string").select(Template("{?:directory}/{?:file}.tmp").render({"?": F.col("path")}).alias("output"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("raise_error") == 2
    assert [r["output"] for r in made.collect()] == ["a/doc_0.tmp", "a/b.c/d.tmp"]
