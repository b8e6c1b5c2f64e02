"""Record files and flow exports, novelty of gaps."""

import pytest

from flowlark import fixed
from flowlark.operators import binning
from flowlark.sources import records


def test_exports_are_put_together_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" Dur , Bytes,Label,Note\n1000,1,BENIGN,x\ninf,,benign,y\n1004,4,DDoS,z\n")
    (tmp_path / "b.csv").write_text("Bytes,Dur,Label\n7,2000,PortScan\n8,abc,nobody knows\n")
    rows, about = records.read_flow_exports(spark, f"file://{tmp_path}")
    got = {(r["__source_file"], r.bytes): r for r in rows.collect()}
    assert len(got) == 5 and about["numeric_features"] == ["bytes"] and about["unmapped_labels"] == ["nobody knows"]
    assert got["a.csv", 4.0].dur == "1004" and got["b.csv", 7.0].dur == "2000" and got["b.csv", 7.0].note is None
    assert got["a.csv", 1.0].category == "normal" and got["a.csv", 1.0].is_attack == 0 and got["b.csv", 8.0].category == "unknown"
    assert got["a.csv", 0.0].bytes == 0.0
    (tmp_path / "b.csv").write_text("Bytes,Dur,Label\n7,2000,PortScan\n8,inf,benign\n")
    rows, about = records.read_flow_exports(spark, f"file://{tmp_path}")
    assert about["numeric_features"] == ["dur", "bytes"] and sorted(r.dur for r in rows.collect()) == [0.0, 0.0, 1000.0, 1004.0, 2000.0]


@pytest.mark.parametrize("cap", [1, 7, 50, 99, 100, 500])
def test_the_cap_is_exact(spark, tmp_path, cap):
    for name, n in (("a", 100), ("b", 60)):
        (tmp_path / f"{name}.csv").write_text("v,label\n" + "".join(f"{i},benign\n" for i in range(n)))
    rows, _ = records.read_flow_exports(spark, f"file://{tmp_path}", cap)
    counts = {r["__source_file"]: r["count"] for r in rows.groupBy("__source_file").count().collect()}
    assert counts == {"a.csv": min(cap, 100), "b.csv": min(cap, 60)}


def test_exports_without_files_or_labels(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        records.read_flow_exports(spark, f"file://{tmp_path}")
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError):
        records.read_flow_exports(spark, f"file://{tmp_path}")


def test_records(spark, tmp_path):
    row = ["0"] * 43
    row[1:4] = [" TCP", "Http", "SF "]
    row[4], row[41], row[42] = "abc", " Neptune. ", "nan"
    for name in ("Train", "Test"):
        (tmp_path / f"KDD{name}+.txt").write_text(",".join(row) + "\n")
    train, _, about = records.load_records(spark, f"file://{tmp_path}")
    r = train.first()
    assert (r.protocol_type, r.service, r.flag, r.src_bytes, r.label, r.difficulty, r.category, r.is_attack) == ("tcp", "http", "sf", 0.0, "neptune", 0.0, "dos", 1)
    assert about["novel_in_test"] == [] and set(fixed.COLUMNS) <= set(train.columns)
    with pytest.raises(FileNotFoundError):
        records.load_records(spark, f"file://{tmp_path}/none")


def test_novelty_keeps_rows_without_a_score(spark):
    scored = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.5), (4, -1.0), (5, 9.0)], "flow_id long, score double")
    benign = spark.createDataFrame([(0.1,), (0.5,), (0.5,), (0.9,)], "score double")
    got = {r.flow_id: r.novelty for r in binning.novelty(scored, benign).collect()}
    assert got == {1: 0.75, 2: None, 3: 0.75, 4: 0.0, 5: 1.0}


def test_rows_without_a_stratum_are_split_too(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else "ab"[i % 2]) for i in range(300)], "flow_id long, category string")
    rows = records.stratified_split(df, 0.3).collect()
    assert len(rows) == 300 and {r.flow_id for r in rows} == set(range(300))
    for c in (None, "a", "b"):
        own = [r.is_test for r in rows if r.category == c]
        assert sum(own) == round(0.3 * len(own))
