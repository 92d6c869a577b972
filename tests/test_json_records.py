"""JSON containers read in parts equal a plain parser, whatever their shape."""

import json
import os

import pytest

from touchstone.session import new_path
from touchstone.sources import manifests as S
from touchstone.sources.json_records import _fragments, read_records
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField("label", T.StringType()), T.StructField("n", T.LongType()), T.StructField("p", T.ArrayType(T.ArrayType(T.DoubleType())))])


def put(spark, *texts):
    path = new_path(spark, "json")
    os.makedirs(path)
    for i, text in enumerate(texts):
        with open(f"{path}/f{i}.json", "w") as f:
            f.write(text)
    return path


def expected(text):
    data = json.loads(text)
    pairs = data.items() if isinstance(data, dict) else [(None, r) for r in data]
    return [(k, r.get("label"), r.get("n"), r.get("p")) for k, r in pairs]


def got(df):
    return [(r["key"], r["r"]["label"], r["r"]["n"], r["r"]["p"]) for r in df.collect()]


def same(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))


PLAIN = {f"clip {i}.mp4": {"label": "FAKE" if i % 3 else "REAL", "n": i, "p": [[1.0, 2.5], [i / 2, 9.0]] if i % 5 else []} for i in range(3000)}
ODD_NAMES = {'a"b\\c': {"label": 'say "x" \\ [', "n": 1}, "é:,": {"label": "\u4f60 \n\t", "n": None, "p": None}, "": {}, "k": {"other": 5}}


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("data", [PLAIN, list(PLAIN.values()), ODD_NAMES, list(ODD_NAMES.values())])
def test_records_equal_a_plain_parser(spark, data, indent):
    text = json.dumps(data, indent=indent)
    path = put(spark, text)
    assert _fragments(spark, path).where("NOT plain").count() == 0
    assert same(got(read_records(spark, path, RECORD)), expected(text))


def test_one_large_file_is_read_by_many_tasks(spark):
    path = put(spark, json.dumps(PLAIN))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = read_records(spark, path, RECORD)
        assert df.rdd.getNumPartitions() > 5
        assert same(got(df), expected(json.dumps(PLAIN)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


NESTED = [
    {"a": {"label": "}", "n": 1}, "b": {"label": "{", "n": 2}},
    {"a": {"label": "x", "n": 1, "more": {"deep": {"n": 9}}}, "b": {"n": 2}},
    [{"label": "x", "more": {"label": "inner"}}, {"label": "y"}],
    {"a": {"more": [{"label": "i"}, {"label": "j"}], "n": 3}},
    [{"label": 'a"}, "b": {"label": "no'}, {"n": 4}],
]


def test_braces_in_strings_and_nested_objects_are_read_whole(spark):
    texts = [json.dumps(d) for d in NESTED]
    path = put(spark, *texts, json.dumps(PLAIN))
    assert _fragments(spark, path).where("NOT plain").select("file").distinct().count() == len(NESTED)
    want = [r for t in [*texts, json.dumps(PLAIN)] for r in expected(t)]
    assert same(got(read_records(spark, path, RECORD)), want)


def test_empty_containers(spark):
    path = put(spark, "{}", "[]", " [ ]\n", "{ }\n", "")
    assert read_records(spark, path, RECORD).count() == 0


def test_parts_are_folders(spark):
    root = new_path(spark, "dfdc")
    for folder in ("dfdc_train_part_3", "part=part_7"):
        os.makedirs(f"{root}/{folder}")
        with open(f"{root}/{folder}/metadata.json", "w") as f:
            json.dump({"a.mp4": {"label": "FAKE", "split": "train", "original": "b.mp4"}, "b.mp4": {"label": "REAL", "split": "train"}}, f)
    rows = {tuple(r) for r in S.read_dfdc_metadata(spark, f"{root}/*/metadata.json").collect()}
    assert rows == {(p, *r) for p in ("dfdc_train_part_3", "part_7") for r in (("a.mp4", True, "b.mp4"), ("b.mp4", False, None))}
