"""Scalar functions against hand-computed values."""

import pytest
from pyspark.sql import functions as F

from seqengine.functions import scalars as S


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def ints(*values):
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<int>")


def test_collapse_then_blank(spark):
    frames = ints(0, 0, 3, 3, 0, 3, 5, 5, 0)
    assert one(spark, S.collapse(frames)) == [0, 3, 0, 3, 5, 0]
    assert one(spark, S.drop_blank(S.collapse(frames))) == [3, 3, 5]
    assert one(spark, S.collapse(S.collapse(frames))) == [0, 3, 0, 3, 5, 0]


def test_best_path_keeps_valid_frames(spark):
    frame = lambda k: F.array(*[F.lit(1.0 if i == k else 0.0) for i in range(4)])
    frames = F.array(*[frame(k) for k in (0, 2, 2, 0, 2, 3)])
    assert one(spark, S.best_path(frames)) == [2, 2, 3]
    assert one(spark, S.best_path(frames, F.lit(40), 8)) == [2, 2]


def test_argmax_takes_the_first(spark):
    assert one(spark, S.argmax(ints(1, 7, 7, 2))) == 1


@pytest.mark.parametrize("seconds,text", [(3725.9, "1:02:05"), (0.0, "0:00:00"), (360000.0, "100:00:00")])
def test_clock(spark, seconds, text):
    assert one(spark, S.clock(F.lit(seconds))) == text


def test_z_array(spark):
    out = one(spark, S.z_array(F.array(*[F.lit(float(v)) for v in (1, 2, 4, 8)])))
    assert out == pytest.approx([-1.0257549, -0.6527531, 0.0932505, 1.5852576], abs=1e-5)


def test_softmax_and_smooth_sum_to_one(spark):
    soft = S.softmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(1000.0)))
    assert one(spark, soft) == pytest.approx([0.0, 0.0, 1.0])
    assert sum(one(spark, S.smooth(soft, 0.3))) == pytest.approx(1.0)
    assert one(spark, S.smooth(soft, 0.3))[0] == pytest.approx(0.1)


def test_pad_and_least_steps(spark):
    assert one(spark, S.pad(F.array(F.lit(1.0)), 3)) == [1.0, 0.0, 0.0]
    assert one(spark, S.pad(F.array(F.lit(1.0), F.lit(2.0)), 1)) == [1.0, 2.0]
    assert one(spark, S.ctc_least(F.lit(2), 8)) == 32


def test_step_due(spark):
    rows = spark.range(1, 8).where(S.step_due(F.col("id"), 3, 7)).collect()
    assert [r[0] for r in rows] == [3, 6, 7]
    assert spark.range(1, 8).where(S.step_due(F.col("id"), 0, 7)).count() == 0


def test_strings(spark):
    assert one(spark, S.chars(F.lit(""))) == []
    assert one(spark, S.chars(F.lit("aß"))) == ["a", "ß"]
    assert one(spark, S.strip(F.lit("\t a b \n"))) == "a b"
    assert one(spark, S.zero_fill(F.lit(123456789), 8)) == "123456789"
    assert one(spark, S.zero_fill(F.lit(7), 8)) == "00000007"
    assert one(spark, S.words(F.lit("  a  b "))) == ["a", "b"]


def test_invert(spark):
    assert one(spark, S.invert(F.create_map(F.lit("a"), F.lit(1)))) == {1: "a"}


def test_learning_rate(spark):
    rows = spark.range(5).select(S.learning_rate(F.col("id"), 1, 4, 2, 1.0).alias("v")).collect()
    assert [r[0] for r in rows] == pytest.approx([0.01, 0.505, 1.0, 0.5, 0.0])
