"""The nested event index: written in lines, read in pieces."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from hazardlake.sources import catalogue as C

SCHEMA = "event string, tile_id string, source_split string, mgrs string, year int, doy int"


def rows(n):
    return [(f"E{i % 7} é", f"t{i:04d}", None if i % 5 == 0 else "training", f"T{i % 3}", 2018 + i % 4, i % 365) for i in range(n)]


def test_round_trip_and_one_document(spark, tmp_path):
    want = rows(500)
    C.write_nested_index(spark.createDataFrame(want, SCHEMA).repartition(5), f"{tmp_path}/index")
    text = "".join(p.read_text() for p in sorted(Path(f"{tmp_path}/index").glob("part-*")))
    doc = json.loads(text)
    assert sorted(doc) == sorted({r[0] for r in want}) and sum(len(e["tiles"]) for e in doc.values()) == 500
    got = C.read_nested_index(spark, f"{tmp_path}/index").select(*SCHEMA.replace(",", "").split()[::2]).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_empty_index(spark, tmp_path):
    C.write_nested_index(spark.createDataFrame([], SCHEMA), f"{tmp_path}/none")
    assert json.loads("".join(p.read_text() for p in Path(f"{tmp_path}/none").glob("part-*"))) == {}
    assert C.read_nested_index(spark, f"{tmp_path}/none").count() == 0


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    """An indented document, cut into blocks smaller than an event: names are carried on."""
    want = rows(3000)
    doc: dict = {}
    for r in want:
        doc.setdefault(r[0], {"year": 2020, "tiles": []})["tiles"].append(dict(zip(("tile_id", "source_split", "mgrs", "year", "doy"), r[1:])))
    doc["empty"] = {"tiles": []}
    (tmp_path / "one.json").write_text(json.dumps(doc, indent=2, ensure_ascii=False))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        df = C.read_nested_index(spark, str(tmp_path / "one.json"))
        assert spark.read.text(str(tmp_path / "one.json"), lineSep="}").rdd.getNumPartitions() > 5
        got = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert df.filter(F.col("event") == "empty").count() == 0
