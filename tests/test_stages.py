"""The stage store, the four-stage flow, and readers of untidy files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL


def test_half_written_and_outdated_stages_are_not_read(spark, tmp_path):
    from tablesmith.sources import store
    root, d = str(tmp_path / "s"), spark.range(6).withColumn("x", F.col("id") * 2)
    store.save(d, root, "clean", "f1", "t")
    folder = f"{root}/stage=clean/fingerprint=f1"
    assert store.lookup(spark, root, "clean", "f1", "t").count() == 6
    assert store.lookup(spark, root, "clean", "f1", "other") is None         # another target
    assert store.lookup(spark, root, "clean", "f2", "t") is None
    manifest = json.load(open(f"{folder}/manifest.json"))
    assert manifest["rows"] == 6 and manifest["version"] == store.STORE_VERSION

    def changed(**k):
        with open(f"{folder}/manifest.json", "w") as f:
            json.dump({**manifest, **k}, f)
        crc = f"{folder}/.manifest.json.crc"
        if os.path.exists(crc):
            os.remove(crc)
        return store.lookup(spark, root, "clean", "f1", "t")

    assert changed(version="1") is None and changed(rows=7) is None and changed(schema={"type": "struct", "fields": []}) is None
    assert changed() is not None
    d.limit(2).write.mode("overwrite").parquet(f"{folder}/data")             # rewritten behind its manifest
    assert store.lookup(spark, root, "clean", "f1", "t") is None
    store.save(d, root, "clean", "f3", "t")
    os.remove(f"{root}/stage=clean/fingerprint=f3/manifest.json")            # the writer died before its end
    assert store.lookup(spark, root, "clean", "f3", "t") is None
    assert {tuple(r) for r in store.list_stages(spark, root).collect()} == {("clean", "f1")}
    made = []
    got, reused = store.reuse_or_compute(spark, root, "clean", "f3", lambda: made.append(1) or d, "t")
    assert not reused and made == [1] and got.count() == 6
    assert store.reuse_or_compute(spark, root, "clean", "f3", lambda: made.append(1) or d, "t")[1] and made == [1]


def test_a_failed_stage_is_named_and_the_flow_resumes(spark, tmp_path, monkeypatch):
    from tablesmith.plans import stages as S
    from tablesmith.sources.tables import view
    d = view(spark, SF_SMALL, "docs").select("_rid", "lang", "n_chars", "text_len", "toxic")
    root, broken = str(tmp_path), S._train

    def fail(data, target):
        raise ValueError("no model")

    monkeypatch.setattr(S, "_train", fail)
    with pytest.raises(S.StageFailed) as e:
        S.run_stages(d, "toxic", root)
    assert e.value.stage == "training" and [x[0] for x in e.value.done] == ["raw_profile", "preprocessing", "clean_profile"]
    assert isinstance(e.value.__cause__, ValueError)
    monkeypatch.setattr(S, "_train", broken)
    rows = [tuple(r)[:2] for r in S.run_stages(d, "toxic", root).collect()]
    assert rows == [("raw_profile", "reused"), ("preprocessing", "reused"), ("clean_profile", "reused"), ("training", "success")]


def test_reader_rescues_rows_and_samples_types(spark, tmp_path, monkeypatch):
    from tablesmith.sources import io as IO
    path = tmp_path / "t.csv"
    path.write_text("id,x,day,flag,name\n1,2.5,2024-01-01,true,a\n2,3,2024-01-02,false,\n3,oops,2024-01-03,true,c\n4,1,not a day,false,d,e\n")
    monkeypatch.setattr(IO, "SAMPLE_ROWS", 2)
    df = IO.load_table(spark, str(path), rescued="_bad", schema=IO.sampled_schema(spark.read.option("header", True).csv(str(path)), 2))
    assert dict(df.dtypes) == {"id": "bigint", "x": "double", "day": "date", "flag": "boolean", "name": "string", "_bad": "string"}
    rows = {r["id"]: r for r in df.collect()}
    assert rows[1]["_bad"] is None and rows[2]["_bad"] is None and rows[2]["name"] is None
    assert rows[3]["x"] is None and rows[3]["_bad"].startswith("3,oops") and rows[3]["name"] == "c"
    assert rows[4]["_bad"].startswith("4,1") and rows[4]["day"] is None


def test_reader_of_json(spark, tmp_path):
    from tablesmith.sources import io as IO
    many = tmp_path / "many.json"
    many.write_text(json.dumps([{"a": 1, "b": "x"}, {"a": 2, "b": None}], indent=2))
    assert sorted(r["a"] for r in IO.load_table(spark, str(many), multi_line=True).collect()) == [1, 2]
    lines = tmp_path / "lines.json"
    lines.write_text('{"a": 1}\n{"a": 2\n{"a": 3}\n')
    df = IO.load_table(spark, str(lines), rescued="_bad", schema="a long")
    assert sorted((r["a"] or 0, r["_bad"]) for r in df.collect()) == [(0, '{"a": 2'), (1, None), (3, None)]
    with pytest.raises(ValueError):
        IO.load_table(spark, "x.xls")
