"""Manifests written and read as a data source, against bytes written out; listings page by page."""

import hashlib
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quarry.functions import canonical
from quarry.sources import manifests

HEADER = {"version": 1, "dataset": "d\x01é", "zone": {"b": [1, None], "a": '"members":['}, "policy": {"members": [1], "id": "p"}}


def members(spark, n, start=0):
    ids = spark.range(start, start + n).select(F.format_string("s%05d", "id").alias("sample_id"), F.concat(F.lit('x"é\n\x1f]},'), F.col("id").cast("string")).alias("text"), (F.col("id") / 4).alias("z"))
    kind = ids.select(F.struct(*ids.columns)).schema[0].dataType
    return ids.select("sample_id", canonical.json_of(F.struct(*ids.columns), kind).alias("member"))


def plain(n, start=0):
    rows = [{"sample_id": f"s{i:05d}", "text": f'x"é\n\x1f]}},{i}'.replace("}}", "}"), "z": i / 4} for i in range(start, start + n)]
    return rows, json.dumps(HEADER | {"members": rows}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


@pytest.mark.parametrize("n", [0, 1, 700])
def test_round_trip(spark, tmp_path, n, monkeypatch):
    at = str(tmp_path / "m.json")
    made = manifests.write_manifest(members(spark, n).repartition(5), at, HEADER, n)
    rows, data = plain(n)
    assert (tmp_path / "m.json").read_bytes() == data
    assert made == {"sha256": hashlib.sha256(data).hexdigest(), "size_bytes": len(data), "members": n}
    back = manifests.read_manifest(spark, at, {"version": 1}).orderBy("sample_id").collect()
    assert [json.loads(r["member"]) for r in back] == rows and [r["sample_id"] for r in back] == [x["sample_id"] for x in rows]
    assert manifests.write_manifest(members(spark, n), at, HEADER, n) == made  # there already
    assert sorted(p.name for p in tmp_path.iterdir()) == ["m.json", "m.json.digest"]
    monkeypatch.setattr(manifests, "CHUNK", 7)
    with open(at, "rb") as f:
        assert [json.loads(m) for _, m in manifests.ManifestReader({"path": at})._members(manifests.Json(f), at)] == rows


def test_refusals(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "m.json")
    for bad, expected in ((members(spark, 3), 2), (members(spark, 3).unionByName(members(spark, 1)), 4)):
        with pytest.raises((ValueError, PySparkException)):
            manifests.write_manifest(bad, at, HEADER, expected)
    monkeypatch.setattr(manifests, "MOST_BYTES", 400)
    with pytest.raises(ValueError, match="at most"):
        manifests.write_manifest(members(spark, 30), at, HEADER, 30)
    monkeypatch.undo()
    assert list(tmp_path.iterdir()) == []
    manifests.write_manifest(members(spark, 3), at, HEADER, 3)
    with pytest.raises(PySparkException):
        manifests.write_manifest(members(spark, 3, 1), at, HEADER, 3)  # another one is there
    with pytest.raises(PySparkException):
        manifests.read_manifest(spark, at, {"version": 2}).collect()
    (tmp_path / "m.json").write_bytes((tmp_path / "m.json").read_bytes().replace(b"s00001", b"s00007"))
    with pytest.raises(PySparkException):
        manifests.read_manifest(spark, at).collect()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["m.json", "m.json.digest"]


def test_listing_pages(spark, tmp_path):
    names = [f"{a}/{b}/f{i}.txt" for a in ("a", "a b", "c") for b in ("x", "y") for i in range(4)] + ["a.txt", "b", "z/deep/er/file"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(n)
    seen, after = [], None
    while True:
        rows, after = manifests.listing_page(spark, str(tmp_path), after, 5)
        seen += [(r["name"], r["bytes"]) for r in rows]
        if after is None:
            break
    assert seen == [(n, len(n)) for n in sorted(names)]
    reader = manifests.ListingReader({"path": str(tmp_path)})
    list(reader.pushFilters([manifests.GreaterThan(("name",), "c/x/f3.txt")]))
    assert [p.path for p in reader.partitions()] == ["", "c", "z"]
    with pytest.raises(ValueError):
        manifests.listing_page(spark, str(tmp_path), None, 101)
