"""Quoted delimited files in many splits equal the reading of whole files."""

import random

import pytest

from dsengine.sources.io import read_table
from dsengine.sources.quoted import read_quoted


@pytest.fixture
def small_splits(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "300b")
    yield spark
    spark.conf.set(name, before)


def whole(spark, path):
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def field(r):
    kind = r.randrange(6)
    if kind == 0:
        return ""
    if kind == 1:
        return f"plain {r.randrange(999)}"
    text = "".join(r.choice(["a", "é", "字", ",", "\n", '""', " ", "\n\n", "b,\n"]) for _ in range(r.choice([0, 3, 20, 400 if kind == 5 else 5])))
    return f'"{text}"'


@pytest.mark.parametrize("seed,end", [(1, "\n"), (2, "\n"), (3, "\r\n")])
def test_many_splits_equal_whole_files(small_splits, tmp_path, seed, end):
    r = random.Random(seed)
    for part in range(2):
        lines = ["id,a,b"] + [f"{i},{field(r)},{field(r)}" for i in range(150)]
        (tmp_path / f"{part}.csv").write_bytes((end.join(lines) + (end if part else "")).encode())
    path = str(tmp_path)
    want = whole(small_splits, path)
    got = read_quoted(small_splits, path, want.schema)
    assert small_splits.read.text(path).rdd.getNumPartitions() > 8
    assert rows(got) == rows(want)


def test_a_field_longer_than_splits_header_and_empty_lines(small_splits, tmp_path):
    long = "x,\n" * 900
    (tmp_path / "t.csv").write_text(f'"i\nd","a"\n\n1,"{long}"\n2,\n\n3,"""q"""\n4,"",5\n6\n')
    want = whole(small_splits, str(tmp_path))
    got = read_quoted(small_splits, str(tmp_path), want.schema)
    assert got.columns == ["i\nd", "a"] and rows(got) == rows(want) and got.count() == 5


@pytest.mark.parametrize("line", ['1,5" pipe', '1, "x"', '1,"a"b', '1,"open', '1,a\rb'])
def test_ill_formed_files_are_read_whole(small_splits, tmp_path, line):
    (tmp_path / "t.csv").write_text("id,a\n" + '7,"y\nz"\n' * 100 + line + "\n")
    path = str(tmp_path / "t.csv")
    assert read_quoted(small_splits, path, whole(small_splits, path).schema) is None
    assert read_table(small_splits, path).where("id = 7").count() == 100


def test_read_table_types_columns_of_many_splits(small_splits, tmp_path):
    body = "".join(f'{i},"t\n{i}",{i / 4}\n' for i in range(200))
    (tmp_path / "t.csv").write_text("id,text,x\n" + body)
    (tmp_path / "t.tsv").write_text(("id,text,x\n" + body).replace(",", "\t"))
    for name in ("t.csv", "t.tsv"):
        got = read_table(small_splits, str(tmp_path / name))
        assert dict(got.dtypes) == {"id": "bigint", "text": "string", "x": "double"}
        assert rows(got) == sorted([(i, f"t\n{i}", i / 4) for i in range(200)], key=str)
    (tmp_path / "e.csv").write_text("id,a\n")
    assert read_table(small_splits, str(tmp_path / "e.csv")).count() == 0


def test_changed_splits_are_an_error(small_splits, tmp_path):
    (tmp_path / "t.csv").write_text("id,a\n" + '7,"y\nz"\n' * 200)
    path = str(tmp_path / "t.csv")
    got = read_quoted(small_splits, path, whole(small_splits, path).schema)
    assert got.count() == 200
    small_splits.conf.set("spark.sql.files.maxPartitionBytes", "500b")
    with pytest.raises(Exception, match="splits changed"):
        got.count()
