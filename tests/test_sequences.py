"""Resumed records, streaming snapshots and repeated designs against plain computations."""
import numpy as np
import pytest
from gridweave.operators.designs import METHODS, repeated, repeated_errors, repeated_prefixes
from gridweave.randomfield.continuous import ContinuousExpansion
from gridweave.sources import records as R
from gridweave.streaming.snapshots import kept, snapshots, stepped
from pyspark.sql import functions as F


@pytest.fixture
def inputs(spark):
    return spark.createDataFrame([(c, i, float(i * 3 + len(c))) for c, n in (("a", 10), ("bb", 7)) for i in range(n)], "case string, sample_index long, x double")


def doubled(df):
    return df.select("case", "sample_index", (2 * F.col("x")).alias("y"))


def test_an_interrupted_sequence_goes_on_and_repeats_nothing(spark, inputs, tmp_path):
    path, asked = str(tmp_path / "r"), []

    def counted(df):
        asked.append(df.count())
        if len(asked) == 3:
            raise RuntimeError("killed")
        return doubled(df)

    with pytest.raises(RuntimeError, match="killed"):
        R.continued(inputs, path, counted, portion=3)
    assert R.committed(spark, path).count() == 12
    got = R.continued(inputs, path, counted, portion=3)
    assert sorted((r.case, r.sample_index, r.y) for r in got.collect()) == sorted((r.case, r.sample_index, 2 * r.x) for r in inputs.collect())
    assert asked == [6, 6, 4, 4, 1]
    R.continued(inputs, path, counted, portion=3)
    assert len(asked) == 5


def test_half_a_portion_counts_as_none(spark, inputs, tmp_path):
    path = str(tmp_path / "r")
    R.continued(inputs, path, doubled, portion=4, most=1)
    (tmp_path / "r/portion=1").mkdir()
    (tmp_path / "r/portion=1/part-0.parquet").write_bytes(b"half")
    assert R.continued(inputs, path, doubled, portion=4).count() == 17


def test_changes_and_gaps_are_refused(spark, inputs, tmp_path):
    path = str(tmp_path / "r")
    R.continued(inputs, path, doubled, portion=4, most=2)
    with pytest.raises(ValueError, match="another input"):
        R.continued(inputs.withColumn("x", F.when(F.col("sample_index") == 2, 99.0).otherwise(F.col("x"))), path, doubled)
    with pytest.raises(ValueError, match="numbered"):
        R.continued(inputs.where("sample_index <> 1"), path, doubled)
    with pytest.raises(ValueError, match="numbered"):
        R.continued(inputs.union(inputs), path, doubled)
    there = R.committed(spark, path)
    changed = there.withColumn("y", F.when(F.col("sample_index") == 1, -1.0).otherwise(F.col("y")))
    with pytest.raises(ValueError, match="changed"):
        R.verified(changed)
    for bad in (there.where("sample_index <> 1"), there.union(there)):
        with pytest.raises(ValueError, match="missing or repeated"):
            R.verified(bad)
    assert R.continued(inputs.where("false"), str(tmp_path / "none"), doubled).count() == 0


def test_batches_are_accepted_in_order_only(spark, inputs, tmp_path):
    path = str(tmp_path / "r")
    all_ = inputs.withColumn("input_hash", F.sha2(F.col("x").cast("string"), 256))
    R.accepted(all_.where("sample_index < 3"), path)
    with pytest.raises(ValueError, match="goes on at 3"):
        R.accepted(all_.where("sample_index > 3"), path)
    R.accepted(all_.where("sample_index < 5"), path)
    R.accepted(all_.where("sample_index < 5"), path)
    with pytest.raises(ValueError, match="another input"):
        R.accepted(all_.withColumn("input_hash", F.lit("x")), path)
    with pytest.raises(ValueError, match="goes on"):
        R.accepted(all_.where("sample_index = 5").union(all_.where("sample_index = 5")), path)
    assert sorted((r.case, r.done) for r in R.verified(R.committed(spark, path)).collect()) == [("a", 5), ("bb", 5)]


def test_streams_of_records_survive_a_replay(spark, inputs, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "r")
    rows = inputs.withColumn("input_hash", F.sha2(F.col("x").cast("string"), 256))
    for low, high in ((0, 4), (4, 10)):
        rows.where(f"sample_index >= {low} and sample_index < {high}").coalesce(1).write.mode("append").parquet(source)
        # A new checkpoint reads all files again, as after a lost one.
        R.record_stream(spark.readStream.schema(rows.schema).parquet(source), path, str(tmp_path / f"c{low}")).awaitTermination()
    assert R.committed(spark, path).count() == 17


def test_snapshots_of_an_array():
    values, state, seen = np.random.default_rng(1).normal(5, 2, 50), (0, 0.0, 0.0, float("inf"), float("-inf")), []
    for part in np.split(values, [0, 7, 20, 21]):
        state, rows = stepped(state, part, [1, 7, 30, 50, 60])
        seen += rows
    assert [r[0] for r in seen] == [1, 7, 30, 50]
    for n, mean, variance, std, low, high in seen:
        x = values[:n]
        assert (mean, low, high) == pytest.approx((x.mean(), x.min(), x.max())) and (variance is None if n == 1 else (variance, std) == pytest.approx((x.var(ddof=1), x.std(ddof=1))))


def test_streamed_snapshots_over_restarts(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(3, 1, (40, 2, 3))
    source, path, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "sample_id long, row int, col int, value double"
    for low, high in ((0, 13), (13, 14), (14, 40)):
        rows = [(s, r, c, float(x[s, r, c])) for s in range(low, high) for r in range(2) for c in range(3)] + [(low, 0, 0, None)]
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(source)
        kept(snapshots(spark.readStream.schema(schema).parquet(source), [1, 10, 14, 32, 64]), path, check).awaitTermination()
    got = {(r.row, r.col, r["count"]): r for r in spark.read.parquet(path).collect()}
    assert len(got) == 6 * 4
    for (r, c, n), row in got.items():
        own = x[:n, r, c]
        assert (row["mean"], row["min"], row["max"]) == pytest.approx((own.mean(), own.min(), own.max()))
        assert row["variance"] == (None if n == 1 else pytest.approx(own.var(ddof=1)))
    with pytest.raises(ValueError, match="from 1"):
        snapshots(spark.readStream.schema(schema).parquet(source), [0])


def test_repeated_designs(spark):
    expansion = ContinuousExpansion.fit(3, 4, 1.0, 0.0, 1.0, 3.0, share=0.9)
    variants = spark.createDataFrame([(0, -9.3, 0.1), (1, -9.0, 0.3)], "variant int, mean double, sigma double")
    values = repeated(variants, expansion, 3, 16, 5)
    rows = {(r.variant, r.method, r.repetition, r.sample_id): r.value for r in values.collect()}
    assert len(rows) == 2 * 2 * 3 * 16 == len(set(rows.values()))
    assert rows == {(r.variant, r.method, r.repetition, r.sample_id): r.value for r in repeated(variants.repartition(3), expansion, 3, 16, 5).collect()}
    prefixes = {(r.variant, r.method, r.repetition, r.budget): (r["mean"], r["std"]) for r in repeated_prefixes(values, [4, 16]).collect()}
    for (v, m, k, n), found in prefixes.items():
        x = np.array([rows[v, m, k, i] for i in range(n)])
        assert found == pytest.approx((x.mean(), x.std(ddof=1)), rel=1e-6)
    errors = {(r.variant, r.method, r.budget): r for r in repeated_errors(repeated_prefixes(values, [4, 16])).collect()}
    for v in (0, 1):
        reference = np.mean([prefixes[v, m, k, 16][0] for m in METHODS for k in range(3)])
        rmse = {m: np.sqrt(np.mean([(prefixes[v, m, k, 4][0] - reference) ** 2 for k in range(3)])) for m in METHODS}
        assert errors[v, "rqmc", 4].rmse_mean == pytest.approx(rmse["rqmc"]) and errors[v, "mc", 4].gain == pytest.approx(rmse["mc"] / rmse["rqmc"])
        assert errors[v, "mc", 4].repetitions == 3
    # Shifted points keep their balance: each half of an axis has half of a repetition's points.
    with pytest.raises(ValueError, match="power"):
        repeated(variants, expansion, 3, 12, 5)
