"""Sources and sinks."""

import glob
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from rillmark import storage
from rillmark.sources import fixedwidth
from rillmark.sources.tables import export_sorted, read_jdbc, read_mappings, read_sharded, write_mappings
from rillmark.streaming.run import dump_tsv

FIELDS = [("id", "int"), ("price", "float"), ("name", 6)]


def test_fixed_width_round_trip(spark, tmp_path):
    made = spark.createDataFrame([(1, 0.5, "a b"), (-7, 2.25, "äö"), (3, -1.0, "toolong")], "id int, price float, name string").coalesce(1)
    written = fixedwidth.write_fixed(made, str(tmp_path / "out"), FIELDS).collect()
    assert [r["rows"] for r in written] == [3]
    back = fixedwidth.read_fixed(spark, str(tmp_path / "out"), FIELDS)
    assert sorted(tuple(r) for r in back.collect()) == [(-7, 2.25, "äö"), (1, 0.5, "a b"), (3, -1.0, "toolon")]


def test_fixed_width_ignores_a_cut_row(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes((5).to_bytes(4, "little") + b"\1\2")
    assert [r["value"] for r in fixedwidth.read_fixed(spark, str(tmp_path / "x.bin"), [("value", "int")]).collect()] == [5]


def test_fixed_width_files_are_read_in_ranges(spark, tmp_path):
    made = spark.range(0, 1000, 1, 1).selectExpr("cast(id as int) as id", "cast(id / 2 as float) as price", "cast(id as string) as name")
    fixedwidth.write_fixed(made, str(tmp_path / "out"), FIELDS).collect()
    with open(glob.glob(str(tmp_path / "out/*.bin"))[0], "ab") as file:
        file.write(b"cut")
    back = fixedwidth.read_fixed(spark, str(tmp_path / "out"), FIELDS, split_bytes=1000)
    assert back.rdd.getNumPartitions() == 15  # 71 rows of 14 bytes each
    assert sorted(tuple(r) for r in back.collect()) == [(i, i / 2, str(i)) for i in range(1000)]
    (tmp_path / "none").mkdir()
    (tmp_path / "none/x.bin").write_bytes(b"")
    assert fixedwidth.read_fixed(spark, str(tmp_path / "none"), FIELDS).count() == 0


def test_export_of_a_database_table(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.range(500).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(50)))
    rows.write.jdbc(url, "numbers", mode="overwrite", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    read = read_jdbc(spark, url, "numbers", key='"id"', low=0, high=500, parts=4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert read.rdd.getNumPartitions() == 4
    export_sorted(read, ["k", "id"], str(tmp_path / "e"), parts=4)
    found = spark.read.parquet(str(tmp_path / "e"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.collect()))
    for file in glob.glob(str(tmp_path / "e/*.parquet")):
        own = [(r["k"], r["id"]) for r in spark.read.parquet(file).collect()]
        assert own == sorted(own)


class Unnamed:
    """A session that names no shared folder."""

    def __init__(self, master):
        self.sparkContext = SimpleNamespace(master=master, applicationId=f"app of {master}")
        self.conf = SimpleNamespace(get=lambda name, default=None: default)


def test_storage_wants_a_shared_folder_on_clusters():
    assert storage.scratch(Unnamed("local[2]")).startswith("file:///") and storage.shared_root(Unnamed("local")) == storage.shared_root(Unnamed("local"))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            storage.scratch(Unnamed(master))


def test_scratch_is_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_root", lambda _: str(tmp_path))
    assert storage.materialize(spark.range(5)).count() == 5
    spent = storage.materialize(spark.range(5))
    kept = storage.materialize(spent)
    storage.drop(spent)
    assert kept.count() == 5 and len(list((tmp_path / "rillmark").iterdir())) == 2
    assert (tmp_path / "rillmark").exists()
    storage.clear(spark)
    assert not (tmp_path / "rillmark").exists()


def test_int_files(spark, tmp_path):
    fixedwidth.write_ints(spark, str(tmp_path / "ints"), 1000, parts=3).collect()
    assert len(glob.glob(str(tmp_path / "ints/*.bin"))) == 3
    assert sorted(r["value"] for r in fixedwidth.read_fixed(spark, str(tmp_path / "ints"), [("value", "int")]).collect()) == list(range(1000))


def test_mappings_round_trip(spark, tmp_path):
    pairs = [("a" * 36, "b" * 36), ("c" * 36, "d" * 36)]
    write_mappings(spark.createDataFrame(pairs, "ad string, c_id string"), str(tmp_path / "m"))
    assert sorted(tuple(r) for r in read_mappings(spark, str(tmp_path / "m")).collect()) == pairs


def test_sorted_export(spark, tmp_path):
    export_sorted(spark.range(1000).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(50))), ["k", "id"], str(tmp_path / "e"), parts=4)
    for file in glob.glob(str(tmp_path / "e/*.parquet")):
        rows = [(r["k"], r["id"]) for r in spark.read.parquet(file).collect()]
        assert rows == sorted(rows)
    assert spark.read.parquet(str(tmp_path / "e")).count() == 1000


def test_sharded_read_keeps_rows_of_a_key_together(spark):
    made = read_sharded(spark.range(100).withColumn("k", F.col("id") % 7), ["k"], 3).withColumn("p", F.spark_partition_id())
    assert made.groupBy("k").agg(F.countDistinct("p").alias("n")).filter("n > 1").count() == 0
    assert {r["shard"] for r in made.collect()} == {0, 1, 2}


def test_tsv(spark, tmp_path):
    dump_tsv(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "t"))
    assert "".join(open(f).read() for f in glob.glob(str(tmp_path / "t/*.csv"))) == "1\tx\n"
