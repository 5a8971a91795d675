"""Numbers at half a step and deviations that are equal but for rounding."""

from pyspark.sql import functions as F

from callweave.operators import faces as fc
from callweave.operators import prosody as pr
from callweave.operators.shared import fixed


def test_fixed_is_the_format_of_python(spark):
    xs = [s * k / d for s in (1, -1) for d in (20, 2000, 7) for k in range(1, 400, 2)] + [0.0, -0.0, 0.0625, -0.04, 0.0005, 123456.0005]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", fixed(F.col("x"), 3).alias("a"), fixed(F.col("x"), 1, "+").alias("b")).collect()
    assert [(r["a"], r["b"]) for r in rows] == [(f"{r['x']:.3f}", f"{r['x']:+.1f}") for r in rows]


def test_report_of_a_mean_at_half_a_step(spark):
    samples = spark.createDataFrame([(1, i * 0.5, 0.0905, 0.0) for i in range(16)], "recording_id long, t double, smile double, pitch_deg double")
    assert f"baseline smile {0.0905:.3f} (sd" in fc.report(samples).first()["text"] and f"{0.0905:.3f}" == "0.090"


def test_tag_of_a_score_at_half_a_step(spark):
    z = {n: F.lit(0.85 if n == "energy" else 0.0) for n in pr.FEATURES}
    assert spark.range(1).select(pr.tag(z, F.lit(0.0)).alias("t")).first()["t"] == "{energy +0.8σ}"


def test_equal_deviations_the_earlier_first(spark):
    rows = [("r", 4, 1.2247448713915894, 3.0), ("r", 1, -1.2247448713915887, 3.0), ("r", 7, 1.3, 3.0)]
    scored = spark.createDataFrame(rows, "recording_id string, utt long, z double, duration double").select("*", *(F.col("z").alias(f"z_{n}") for n in pr.FEATURES))
    assert [r["utt"] for r in pr.top_deviations(scored, ["recording_id"], "utt").orderBy("place").collect()] == [7, 1, 4]
