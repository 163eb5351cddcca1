"""Canonical JSON against Python's ``json.dumps``: controls, nesting, numbers, refusals."""

import json
import math
import random
import struct
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quarry.functions import canonical


def dumps(value, ascii):
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii, allow_nan=False)


@pytest.mark.parametrize("ascii", [False, True])
def test_every_control_and_odd_characters(spark, ascii):
    texts = [f"a{chr(c)}b{chr(c)}" for c in range(0x100)] + ["", "\\u001f", "\\\x1f", '"', " ￾\U0001f600é", "\x7f", "".join(map(chr, range(32))) * 2]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    field = canonical.quoted_ascii if ascii else canonical.quoted
    got = {r["id"]: (r["q"], r["o"], r["j"]) for r in df.select("id", field(F.col("t")).alias("q"), canonical.json_of(F.col("t"), df.schema["t"].dataType, ascii).alias("o"), canonical.json_text(field(F.col("t")), ascii).alias("j")).collect()}
    assert got == {i: (dumps(t, ascii),) * 3 for i, t in enumerate(texts)}


@pytest.mark.parametrize("ascii", [False, True])
def test_nested_values(spark, ascii):
    kind = "struct<z: map<string, array<struct<b: double, A: string>>>, `a\"b`: array<map<string, long>>, n: void, ok: boolean, `é`: decimal(20,0), e: struct<>>"
    rows = [
        ({"\U0001f600": [{"b": 1.5, "A": "x\n"}, None], "�": [], "b": None, "": [{"b": None, "A": None}]}, [{"k": 1, "K": -2, "ł": None}, None], None, True, None, ()),
        (None, None, None, None, Decimal(12345678901234567890), None),
        ({}, [], None, False, Decimal(-1), ()),
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"id int, m {kind}")
    got = {r["id"]: r["j"] for r in df.select("id", canonical.json_of(F.col("m"), df.schema["m"].dataType, ascii).alias("j")).collect()}
    names = ["z", 'a"b', "n", "ok", "é", "e"]
    plain = lambda r: {k: {} if k == "e" and v == () else v for k, v in zip(names, (int(x) if k == "é" and x is not None else x for k, x in zip(names, r, strict=True)), strict=True)}
    assert got == {i: dumps(plain(r), ascii) for i, r in enumerate(rows)}


def test_numbers(spark):
    rnd = random.Random(1)
    values = [0.0, -0.0, 1.0, -1.5, 0.1, 1 / 3, 1e15, 1e16, 123456789012345680.0, 1e22, 1e23, 2e23, 8.41e21, 2.2250738585072014e-308, 5e-324, 4.35e-322, 1e-4, 1e-5, 9.999e-5, 2.0e-3, 1.7976931348623157e308, 9007199254740993.0, 5.684341886080802e-14, 2.0**-44, 100.0, 1e100]
    values += [struct.unpack("<d", struct.pack("<Q", rnd.getrandbits(64)))[0] for _ in range(3000)] + [rnd.uniform(-1e6, 1e6) for _ in range(500)] + [round(rnd.uniform(0, 100), 3) for _ in range(500)]
    values = [v for v in values if math.isfinite(v)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double")
    got = {r["id"]: r["j"] for r in df.select("id", canonical.float_text(F.col("v")).alias("j")).collect()}
    wrong = [(v, got[i]) for i, v in enumerate(values) if got[i] != json.dumps(v)]
    assert not wrong
    assert spark.createDataFrame([(None,)], "v double").select(canonical.json_of(F.col("v"), df.schema["v"].dataType)).first()[0] == "null"


@pytest.mark.parametrize("value", [float("nan"), float("inf"), float("-inf")])
def test_numbers_that_json_lacks_are_refused(spark, value):
    df = spark.createDataFrame([(value,)], "v double")
    with pytest.raises(PySparkException):
        df.select(canonical.json_of(F.col("v"), df.schema["v"].dataType)).collect()
    name = {"nan": "NaN", "inf": "Infinity", "-inf": "-Infinity"}[str(value)]
    with pytest.raises(ValueError):
        canonical.canonical(f'{{"a": {name}}}')


def test_texts_of_unknown_keys(spark):
    texts = ['{"b": [1, 2.50, 1e3, {"é": "\\u00e9", "a": null}], "a": {"z": true, "y": {}}}', "[]", ' "x" ', "12345678901234567890123", '{"k": 1, "k": 2}', None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(canonical.json_text(F.col("t"))).collect()]
    assert got == [None if t is None else dumps(json.loads(t), False) for t in texts]


def test_texts_are_converted_a_few_at_a_time(monkeypatch):
    """A batch's texts are never all Python objects at once; nulls, empty batches and slices' ends keep their places."""
    texts = [None if i % 7 == 0 else '{"b": %d, "a": "é"}' % i for i in range(2 * canonical.SLICE + 1)]
    want = [None if x is None else canonical.canonical(x) for x in texts]
    seen = []
    real = canonical.pa.array
    monkeypatch.setattr(canonical.pa, "array", lambda x, kind: seen.append(len(x)) or real(x, kind))
    assert canonical.converted(real(texts)).to_pylist() == want
    assert max(seen) == canonical.SLICE
    assert canonical.converted(real([], canonical.pa.string())).to_pylist() == []
