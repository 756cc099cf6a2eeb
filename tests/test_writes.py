"""JSON edits that keep what they don't touch; order rules of upserts; numbered versions."""

import json
import random

import pytest

from quillspark.operators import writes as W


@pytest.mark.parametrize("text, key, value, want", [
    ('{"k": 69, "o": {"a": [1, 2.50]}, "b": true}', "added", "1", '{"k": 69, "o": {"a": [1, 2.50]}, "b": true,"added":1}'),
    ('{ "a" : 1e3 , "k":\t{"k": 1},\n "c":null }', "k", None, '{ "a" : 1e3,\n "c":null }'),
    ('{"k":1}', "k", None, "{}"), ("{ }", "k", '"x"', '{ "k":"x"}'), ('{"x,}":"{\\"k\\": 1}"}', "k", "2", '{"x,}":"{\\"k\\": 1}","k":2}'),
    ('{"a":1}', "k", None, '{"a":1}'), ("[1]", "k", "1", "[1]"), ("not json", "k", "1", "not json"), ('{"a":1,}', "k", "1", '{"a":1,}'), ("", "k", "1", ""), (None, "k", "1", None),
    ('{"k":1,"k":2,"z":0}', "k", "3", '{"k":3,"k":3,"z":0}'), ('{"k":1,"k":2,"z":0}', "k", None, '{"z":0}'), ('{"é":"ü"}', "é", "1", '{"é":1}'),
])
def test_splice(text, key, value, want):
    assert W.spliced(text, key, value) == want


def test_splice_means_the_same_as_an_edit_of_the_object():
    rng = random.Random(1)
    for _ in range(3000):
        d = {rng.choice("abkcd"): rng.choice([1, 2.5, None, True, "x,}", [1, {"k": 2}], {"k": [3]}]) for _ in range(rng.randint(0, 5))}
        text = json.dumps(d, indent=rng.choice([None, 1]))
        for value in (None, '{"z":1}'):
            e = dict(d)
            e.pop("k", None) if value is None else e.update(k=json.loads(value))
            got = json.loads(W.spliced(text, "k", value))
            assert got == e and list(got) == list(e)


def test_json_column(spark):
    df = spark.createDataFrame([('{"a": 1.0}', 7), (None, 1), ('{"n": 2}', None)], "p string, v long")
    assert [r.p for r in df.select(W.json_set("p", "n", df.v).alias("p")).collect()] == ['{"a": 1.0,"n":7}', None, '{"n": null}']
    assert [r.p for r in df.select(W.json_set("p", "n", None).alias("p")).collect()] == ['{"a": 1.0}', None, "{}"]


def test_ties_go_to_whole_rows_in_any_partitioning(spark):
    base = spark.createDataFrame([(1, "old", "old")], "id long, a string, b string")
    new = spark.createDataFrame([(i % 3, f"a{i}", f"b{i}") for i in range(60)], "id long, a string, b string")
    for f in (lambda n: W.upsert(base, n, ["id"]), lambda n: W.insert_ignore(base, n, ["id"])):
        runs = [sorted(map(tuple, f(new.repartition(p)).collect())) for p in (1, 3, 7)]
        assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 3
        assert all(a[1:] == b[1:] for _, a, b in runs[0] if a != "old")
    ordered = W.insert_ignore(base, new.withColumn("seq", new.a.substr(2, 9).cast("int")), ["id"], "seq")
    assert sorted(map(tuple, ordered.collect())) == [(0, "a0", "b0"), (1, "old", "old"), (2, "a2", "b2")]


def test_many_swaps_in_a_moment(spark, tmp_path):
    for i in range(4):
        W.swap_in(spark.range(i, i + 1), str(tmp_path), "t")
        assert [r.id for r in W.current(spark, str(tmp_path), "t").collect()] == [i]
