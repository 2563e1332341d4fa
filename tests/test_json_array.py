"""One JSON array in many byte ranges gives the same objects as a reader of whole files."""

import json
import random
from pathlib import Path

import pytest

from revisit.sources.json_array import json_objects, read_payload_array
from revisit.sources.payloads import payload_tables, read_payloads
from test_pipeline import make_payload

ODD = [
    {"a": "plain"}, {"a": 'quote " and brace } {'}, {"a": "back\\slash\\"}, {"a": "\\\\\" }", "b": {"c": {"d": "}"}}},
    {}, {"a": "ä}日本\n\t"}, {"b": [{"x": 1}, {"x": {}}, "{", "}}}"]}, {"a": "x" * 5000 + '"}'}, {"a": "}"}, {"é{": "\\u007d"},
]


@pytest.fixture
def small_splits(spark):
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("indent", [None, 2])
def test_same_objects(spark, tmp_path, small_splits, indent):
    rng = random.Random(3)
    files = [[rng.choice(ODD) for _ in range(n)] for n in (60, 1, 0)]
    for i, objects in enumerate(files):
        (tmp_path / f"{i}.json").write_text(json.dumps(objects, indent=indent, ensure_ascii=False))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(o, ensure_ascii=False) for o in ODD))
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 5
    found = {}
    for r in json_objects(spark, str(tmp_path)).collect():
        found.setdefault(r.file.rsplit("/", 1)[1], []).append((r.place, json.loads(r.body)))
    wanted = {"0.json": files[0], "1.json": files[1], "lines.json": ODD}
    assert {f: [o for _, o in sorted(rows, key=lambda x: x[0])] for f, rows in found.items()} == wanted


@pytest.mark.parametrize("text", ['[{"a": 1}, {"a": {"b": 2}', '[{"a": "open}]', '[{"a": 1}, {"b"'])
def test_torn_files_fail(spark, tmp_path, text):
    (tmp_path / "torn.json").write_text(text)
    with pytest.raises(Exception, match="incomplete JSON"):
        json_objects(spark, str(tmp_path)).collect()


def test_same_payloads_as_the_whole_reader(spark, tmp_path, small_splits):
    rng = random.Random(5)
    path = tmp_path / "export.json"
    path.write_text(json.dumps([make_payload(c, rng) for c in range(1, 5)]))
    whole = read_payloads(spark, str(path), multi_line=True)
    assert sorted(map(str, read_payload_array(spark, str(path)).collect())) == sorted(map(str, whole.collect()))


def test_text_is_copied_once_at_most(spark, tmp_path, small_splits):
    """Objects of random text, many to a byte range: the copies together stay below the file's size."""
    rng = random.Random(7)
    kept = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(kept.iterdir())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    objects = [{"referral": [{"referralinstanceid": i, "referralnotes": rng.randbytes(60).hex()}]} for i in range(6000)]
    path = tmp_path / "export.json"
    path.write_text(json.dumps(objects))
    found = payload_tables(read_payload_array(spark, str(path)))["referral"]
    assert {(r.referralinstanceid, r.referralnotes) for r in found.collect()} == {
        (o["referral"][0]["referralinstanceid"], o["referral"][0]["referralnotes"]) for o in objects
    }
    copies = sum(f.stat().st_size for d in set(kept.iterdir()) - before for f in d.rglob("*.parquet"))
    assert copies < path.stat().st_size
