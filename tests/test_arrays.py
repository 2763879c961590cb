"""Array files: headers, ranges of rows, round trips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shortlist.sources import arrays


def read(spark, path, **options):
    arrays.register(spark)
    return spark.read.format("arrays").options(**options).load(str(path))


KINDS = {
    "f8": np.linspace(-1, 1, 30).reshape(10, 3), "f4": np.arange(10, dtype="<f4"), "f2": np.arange(20, dtype="<f2").reshape(10, 2) / 3, "big": np.arange(10, dtype=">i4"), "i8": np.arange(10) - 5,
    "u1": np.arange(250, 260).astype("u1"), "yes": np.arange(10) % 3 == 0, "name": np.array([f"é{i}" * (i % 3) for i in range(10)]), "cube": np.arange(60).reshape(10, 2, 3), "none": np.zeros((10, 0)),
}


@pytest.mark.parametrize("packed,size", [(False, 1), (False, 300), (False, 10**9), (True, 1)])
def test_all_kinds_of_arrays(spark, tmp_path, packed, size):
    (np.savez_compressed if packed else np.savez)(tmp_path / "x.npz", **KINDS)
    df = read(spark, tmp_path / "x.npz", part_bytes=str(size))
    row = sum(a.dtype.itemsize * a[0].size for a in KINDS.values())
    assert df.rdd.getNumPartitions() == (1 if packed else -(-10 // max(1, size // row)))
    assert dict(df.dtypes) == {
        "row": "bigint", "f8": "array<double>", "f4": "float", "f2": "array<float>", "big": "int", "i8": "bigint", "u1": "smallint", "yes": "boolean", "name": "string",
        "cube": "array<array<bigint>>", "none": "array<double>",
    }
    got = sorted(df.collect(), key=lambda r: r.row)
    assert [r.row for r in got] == list(range(10))
    for name, a in KINDS.items():
        want = a.astype("f4").tolist() if name == "f2" else a.tolist()
        assert [r[name] for r in got] == want, name
    some = read(spark, tmp_path / "x.npz", columns="i8, f4")
    assert some.columns == ["row", "i8", "f4"] and some.agg(F.sum("i8")).first()[0] == -5


def test_single_arrays_and_folders(spark, tmp_path):
    for i in range(3):
        np.save(tmp_path / f"part{i}.npy", np.full((4, 2), float(i)))
    np.save(tmp_path / "part3.npy", np.zeros((0, 2)))
    got = {r.row: r.array for r in read(spark, tmp_path, part_bytes="32").collect()}
    assert got == {i: [i // 4.0] * 2 for i in range(12)}
    np.lib.format.open_memmap(tmp_path / "v2.npy", "w+", np.dtype("<f8"), (2,), version=(2, 0))[:] = [1, 2]
    assert [r.array for r in read(spark, f"file://{tmp_path}/v2.npy").collect()] == [1, 2]


def test_faulty_files(spark, tmp_path):
    np.savez(tmp_path / "uneven.npz", a=np.zeros(3), b=np.zeros(4))
    np.save(tmp_path / "columns.npy", np.asfortranarray(np.ones((2, 3))))
    np.save(tmp_path / "wide.npy", np.zeros(2, "u8"))
    np.save(tmp_path / "objects.npy", np.array([{}, None], object), allow_pickle=True)
    (tmp_path / "text.npy").write_text("not an array at all")
    np.save(tmp_path / "short.npy", np.zeros(100))
    (tmp_path / "short.npy").write_bytes((tmp_path / "short.npy").read_bytes()[:-8])
    for name in ("uneven.npz", "columns.npy", "wide.npy", "objects.npy", "text.npy", "short.npy"):
        with pytest.raises(Exception, match="unequal|by columns|64-bit|plain|not an array|ends before"):
            read(spark, tmp_path / name).collect()


def test_round_trip_of_a_table(spark, tmp_path):
    df = spark.range(1000).select(
        F.col("id"), (F.col("id") / 7).alias("x"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: i + F.col("id") / 3).alias("vec"), F.concat(F.lit("n"), "id").alias("name"), (F.col("id") % 2 == 0).alias("even")
    ).repartitionByRange(4, "id")
    arrays.register(spark)
    df.write.format("arrays").mode("append").option("file_rows", 150).save(str(tmp_path / "t"))
    (tmp_path / "t" / "part-000000-0000-left-behind.npz").write_bytes(b"from a lost task")
    back = read(spark, tmp_path / "t", part_bytes="2000")
    assert back.rdd.getNumPartitions() > 20
    assert sorted(tuple(r)[1:] for r in back.collect()) == sorted(tuple(r) for r in df.collect())
    assert back.filter("row <> id").count() == 0  # rows keep the order of partitions
    df.limit(10).write.format("arrays").mode("append").save(str(tmp_path / "t"))
    assert read(spark, tmp_path / "t").count() == 1010
    uneven = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, v array<double>").coalesce(1)
    with pytest.raises(Exception, match="unequal lengths"):
        uneven.write.format("arrays").mode("append").save(str(tmp_path / "u"))
