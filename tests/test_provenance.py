import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.sources import provenance


def by_hand(path, size):
    data = path.read_bytes()
    parts = [data[i : i + size] for i in range(0, len(data), size)] or [b""]
    return len(parts), hashlib.sha256("\n".join(hashlib.sha256(p).hexdigest() for p in parts).encode()).hexdigest()


def test_file_digests_by_ranges(spark, tmp_path):
    for name, size in (("a", 0), ("b", 1), ("c", 999), ("d", 1000), ("e", 1001), ("f", 5555)):
        (tmp_path / name).write_bytes(bytes(i * 7 % 251 for i in range(size)))
    got = {r.file.split("/")[-1]: r for r in provenance.file_digests(spark, [str(tmp_path)], 1000).collect()}
    assert sorted(got) == ["b", "c", "d", "e", "f"]
    for name, r in got.items():
        path = tmp_path / name
        assert (r.n_ranges, r.tree_sha256) == by_hand(path, 1000) and r.length == path.stat().st_size


def test_a_file_of_three_gibibytes(spark, tmp_path):
    path = tmp_path / "large"
    with path.open("wb") as out:
        out.seek((3 << 30) - 1)
        out.write(b"x")
    row = provenance.file_digests(spark, [str(tmp_path)]).first()
    zeros = hashlib.sha256(bytes(64 << 20)).hexdigest()
    last = hashlib.sha256(bytes((64 << 20) - 1) + b"x").hexdigest()
    assert row.length == 3 << 30 and row.n_ranges == 48
    assert row.tree_sha256 == hashlib.sha256("\n".join([zeros] * 47 + [last]).encode()).hexdigest()


@pytest.mark.parametrize("change", [
    lambda df: df.unionByName(df.limit(1)), lambda df: df.unionByName(df.limit(1)).unionByName(df.limit(1)),
    lambda df: df.filter("k > 0"), lambda df: df.withColumn("v", F.when(F.col("k") == 3, "z").otherwise(F.col("v"))),
])
def test_table_digest_sees_every_change(spark, change):
    df = spark.createDataFrame([(i, str(i % 4), None) for i in range(20)], "k int, v string, n int")
    before = provenance.table_digest(df).first()
    assert provenance.table_digest(df.orderBy(F.desc("k")).repartition(3)).first() == before
    assert provenance.table_digest(change(df)).first().digest != before.digest


def test_table_digest_of_no_rows(spark):
    row = provenance.table_digest(spark.createDataFrame([], "k int, v string")).first()
    assert (row.n_rows, row.digest) == (0, "0" * 32)
