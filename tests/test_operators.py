"""Signal, augmentation, metric, scoring, preparation and source operators on small fixtures."""

import json
import pickle
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqengine.operators import augment as A
from seqengine.operators import metrics as M
from seqengine.operators import planned as D
from seqengine.operators import prep as P
from seqengine.operators import score
from seqengine.operators import signal as G
from seqengine.plans.registry import QUERIES
from seqengine.sources import io


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_edit_counts_and_rates(spark):
    rows = [("the cat sat", "the bat sat on"), ("Straße", "Strase"), ("abc", ""), ("kitten", "sitting"), (" a  b ", "a b")]
    pairs = spark.createDataFrame(rows, "ref string, hyp string")
    got = M.edit_counts(pairs).collect()
    for r in got:
        assert r["char_edits"] == distance(r["ref"].strip(), r["hyp"].strip())
        assert r["word_edits"] == distance(r["ref"].split(), r["hyp"].split())
    assert (got[0]["word_edits"], got[0]["ref_words"]) == (2, 3)
    same = M.evaluate(spark.createDataFrame([("a b", "a b")], "ref string, hyp string")).first()
    assert same["character_error_rate"] == 0 and same["word_error_rate"] == 0
    off = M.evaluate(pairs, distance=False, cer=False).first()
    assert off["levenshtein_distance"] == -1 and off["character_error_rate"] == -1 and off["word_error_rate"] > 0


def test_alignment_costs_are_least():
    words = ["".join(p) for n in range(4) for p in product("ab", repeat=n)]
    for ref, hyp in product(words, words):
        chunks = M.align(ref, hyp)
        cost = sum(max(b - a, d - c) for e, a, b, c, d in chunks if e != "equal")
        assert cost == distance(ref, hyp)
        assert "".join(ref[a:b] for _, a, b, _, _ in chunks) == ref and "".join(hyp[c:d] for *_, c, d in chunks) == hyp


def test_substitution_run_counts_all_cells(spark):
    chunks = M.aligned(spark.createDataFrame([("abc", "xyz")], "ref string, hyp string"))
    assert M.substitutions(chunks).agg(F.sum("count")).first()[0] == 9
    assert M.substitutions(chunks, diagonal=True).agg(F.sum("count")).first()[0] == 3
    assert M.event_totals(chunks).collect() == [("substitute", 3)]
    with pytest.raises(Exception, match="not a category"):
        M.substitution_rates(spark.createDataFrame([("abc", "xyz")], "ref string, hyp string"), list("abc")).collect()


def test_running_best_and_best_epoch(spark):
    rows = [(0, i, "m", v) for i, v in enumerate([0.5, 0.4, 0.4, 0.3])]
    df = spark.createDataFrame(rows, "fold int, epoch int, metric string, value double")
    flags = [r["is_best"] for r in M.running_best(df, ["fold"], "epoch", "value").orderBy("epoch").collect()]
    assert flags == [True, True, False, True]
    assert M.best_epochs(df, ["fold"]).first()["epoch"] == 3
    assert M.best_epochs(df.where("false"), ["fold"]).count() == 0


def test_upsert(spark):
    old = spark.createDataFrame([("cer", 1.0), ("macs", 5.0), (None, 2.0)], "k string, v double")
    new = spark.createDataFrame([("cer", 0.5), ("wer", 0.7), ("macs", None), (None, 3.0)], "k string, v double")
    assert {r["k"]: r["v"] for r in M.upsert(old, new, ["k"]).collect()} == {"cer": 0.5, "wer": 0.7, "macs": 5.0, None: 3.0}


def test_layouts_round_trip(spark):
    steps = spark.createDataFrame([(1, 1, 3.0, 4.0), (1, 0, 1.0, 2.0), (2, 0, 5.0, 6.0)], "id int, t int, c0 double, c1 double")
    arrays = G.to_arrays(steps, ["id"], ["c0", "c1"])
    assert {r["id"]: r["values"] for r in arrays.collect()} == {1: [[1.0, 2.0], [3.0, 4.0]], 2: [[5.0, 6.0]]}
    assert sorted(G.to_steps(arrays, ["id"], ["c0", "c1"]).collect()) == sorted(steps.collect())


def test_fills_keep_what_nothing_reaches(spark):
    df = spark.createDataFrame([(0, t, float(t)) for t in range(5)], "id int, t int, v double")
    mask = F.col("t").isin(0, 2, 4)
    assert [r["filled"] for r in G.forward_fill(df, ["id"], ["t"], "v", mask).orderBy("t").collect()] == [0, 1, 1, 3, 3]
    assert [r["filled"] for r in G.backward_fill(df, ["id"], ["t"], "v", mask).orderBy("t").collect()] == [1, 1, 3, 3, 4]


def test_concat_draws_from_the_own_group(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "w string, i long")
    for r in G.concat_same_group(df, "w", "i", 3, seed=5).collect():
        assert len(r["parts"]) == 4 and r["parts"][1] == r["i"]
        assert set(r["parts"]) <= ({1, 2} if r["w"] == "a" else {3})


def test_resample_equals_interp(spark):
    values = [1.0, 4.0, 2.0, 8.0, 0.0]
    df = spark.createDataFrame([(0, t, v) for t, v in enumerate(values)] + [(1, 0, 7.0)], "id int, t int, v double")
    out = {k: [r["value"] for r in G.resample(df, ["id"], "t", "v", 9).where(F.col("id") == k).orderBy("step").collect()] for k in (0, 1)}
    assert out[0] == pytest.approx(np.interp(np.linspace(0, 4, 9), range(5), values))
    assert out[1] == [7.0] * 9


def test_splines():
    t = np.array([0.0, 1.0, 2.5, 4.0, 6.0])
    cubic = lambda q: 2 * q**3 - q**2 + 3
    q = np.linspace(0, 6, 50)
    assert A.natural_knots(t, cubic(t)[:, None])(q)[:, 0] == pytest.approx(cubic(q))
    y = np.array([0.0, 1.0, 1.5, 4.0, 4.5])
    out = A.monotone(t, y)(q)
    assert np.all(np.diff(out) >= -1e-12) and A.monotone(t, y)(t) == pytest.approx(y)


@pytest.mark.parametrize("kernel", [A.noise(0, 0.05, "laplace"), A.noise((0, 1), [0.1, 0.2], "uniform", True, False), A.drift(0.1, 40, True), A.drift((0.1, 0.2), [3, 5], per_channel=False), A.dropout(0.3, (2, 4), "mean"), A.dropout(0.3, 2, "bfill", True), A.dropout((0.1, 0.5), [1, 3], 0.0), A.time_warp(5, 4.0), A.standard()])
def test_kernels_keep_shape_and_seed(kernel):
    x = np.random.default_rng(1).standard_normal((60, 3))
    one, two = (kernel(x, np.random.default_rng(3)) for _ in range(2))
    assert one.shape == x.shape and np.array_equal(one, two) and np.isfinite(one).all()


def test_short_recordings_and_unknown_noise():
    x = np.ones((3, 2))
    with pytest.raises(ValueError):
        A.dropout(0.1, 5)(x, np.random.default_rng(0))
    assert np.array_equal(A.noise(0, 1, "cauchy")(x, np.random.default_rng(0)), x)


def test_augment_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(k, [[float(k + t)] for t in range(20)]) for k in range(6)], "id long, values array<array<double>>")
    one, two = ({r["id"]: r["values"] for r in A.augment(df.repartition(n), "id", A.noise(0, 0.1), 4).collect()} for n in (1, 5))
    assert one == two


def test_ctc_loss_equals_the_sum_over_paths():
    rng = np.random.default_rng(0)
    probs = rng.dirichlet(np.ones(3), 4)
    for labels in ([1], [1, 2], [1, 1], [2, 1]):
        total = 0.0
        for path in product(range(3), repeat=4):
            kept = [p for i, p in enumerate(path) if (i == 0 or p != path[i - 1]) and p]
            if kept == labels:
                total += np.prod([probs[t, p] for t, p in enumerate(path)])
        assert score.ctc_nll(probs, np.array(labels), alpha=0) == pytest.approx(-np.log(total))
    assert score.ctc_nll(probs, np.array([1, 1, 1]), alpha=0) == np.inf


def test_forced_alignment():
    probs = np.eye(3)[[0, 1, 1, 0, 2]] * 0.9 + 0.03
    assert [x[:2] for x in score.force_align(probs, np.array([1, 2]))] == [(1, 3), (4, 5)]
    assert score.force_align(probs[:1], np.array([1, 2])) == []


def test_prepare(spark):
    rows = [("0", "train", 0, [[0.0]], [0, 26], "w1"), ("0", "train", 1, [], [1], "w1"), ("0", "train", 2, [[0.0]] * 3, [59, 2], "w2")]
    df = spark.createDataFrame(rows, "fold string, split string, pos long, values array<array<double>>, indices array<int>, id_writer string")
    out = P.prepare(df, 2).collect()
    assert [(r["id"], r["filename"], r["label"]) for r in out] == [(0, "data/0/train/00000000.csv", "Aa")]
    out = P.prepare(df).orderBy("id").collect()
    assert [r["label"] for r in out] == ["Aa", "C"]
    checked = P.check_dataset(P.prepare(df)).first()
    assert checked["dense"] and checked["foreign_labels"] == 0


def test_zip_needs_equal_parts(spark):
    one = spark.createDataFrame([(0, "a"), (1, "b")], "pos int, x string")
    assert P.zip_positions(one, one.withColumnRenamed("x", "y"), "pos").count() == 2
    with pytest.raises(Exception, match="differ in length"):
        P.zip_positions(one, one.limit(1).withColumnRenamed("x", "y"), "pos").collect()
    with pytest.raises(Exception, match="differ in length"):
        P.zip_arrays(spark.createDataFrame([([1, 2], [1])], "a array<int>, b array<int>"), ["a", "b"]).collect()


def test_planned_scores(spark):
    df = spark.createDataFrame([("ab", "w1", 1.0), ("ab", "w2", 2.0), ("ab", "w1", 4.0), ("ab", "w1", 5.0)], "pair string, writer string, score double")
    r = D.pair_statistics(df).first()
    assert (r["count"], r["coverage"], r["median"], r["iqr"]) == (4, 2, 3.0, 2.5)
    assert spark.range(1).select(D.continuity([F.lit(2.0), F.lit(None).cast("double")], [1, 1]).alias("v")).first()[0] == 1.0


def test_fold_pickles(spark, tmp_path):
    for fold in ("b", "a"):
        d = tmp_path / fold
        d.mkdir()
        for name, value in (("all_x_dat_train_imu.pkl", [np.ones((2, 2)), np.ones((1, 2))]), ("all_train_gt.pkl", [[0, 1], [2]]), ("train_ids.pkl", [7, "w"])):
            (d / name).write_bytes(pickle.dumps(value))
    rows = io.read_fold_pickles(spark, str(tmp_path), "train").orderBy("fold", "pos").collect()
    assert [(r["fold"], r["pos"], r["id_writer"], len(r["values"])) for r in rows] == [("a", 0, "7", 2), ("a", 1, "w", 1), ("b", 0, "7", 2), ("b", 1, "w", 1)]


def test_pickles_may_not_run_code(tmp_path):
    with pytest.raises(pickle.UnpicklingError):
        io._Plain(__import__("io").BytesIO(pickle.dumps(print))).load()


def test_annotations_round_trip(spark, tmp_path):
    rows = [("0", f"data/0/train/{k:08d}.csv", k, "ä b", "w", 100) for k in range(3)]
    df = spark.createDataFrame(rows, "fold string, filename string, id long, label string, id_writer string, rate_sample_orig int")
    io.write_annotations(df, str(tmp_path / "out"), {"num_fold": 1, "writer_independent": True}, ["b", "a"])
    back = io.read_annotations(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.select(df.columns).collect())) == sorted(rows)
    info = io.read_info(spark, str(tmp_path / "out")).first()
    assert info["num_fold"] == 1 and info["categories"] == ["a", "b"]


def test_recording_csv(spark, tmp_path):
    (tmp_path / "0.csv").write_text("1.0;2.0\n3.0;4.0\n")
    rows = io.read_recordings(spark, str(tmp_path), 2).orderBy("t").collect()
    assert [(r["t"], r["c0"], r["c1"]) for r in rows] == [(0, 1.0, 2.0), (1, 3.0, 4.0)]


def test_histories_and_predictions(spark, tmp_path):
    evaluation = {"levenshtein_distance": 1.0, "average_sentence_length": 5.0, "character_error_rate": 0.5, "word_error_rate": 0.6}
    log = {"1": {"train": [{"lr": 0.1, "iters": 1, "loss": 2.0, "time": 0.1}, {"loss_avg": 2.0, "time": 1.0}], "test": []}, "2": {"train": [], "evaluation": evaluation}, "best": {"character_error_rate": [2, 0.5]}}
    (tmp_path / "train_2024.json").write_text(json.dumps(log))
    histories = io.read_histories(spark, str(tmp_path / "train_2*.json"))
    assert {(r["epoch"], r["metric"], r["value"]) for r in io.epoch_metrics(histories).collect()} == {(2, k, v) for k, v in evaluation.items()}
    assert [(r["epoch"], r["tag"], r["iters"]) for r in io.iteration_log(histories).collect()] == [(1, "train", 1)]
    (tmp_path / "p.json").write_text(json.dumps({"labels": ["a", "b"], "3": ["a", "x"]}))
    assert sorted(map(tuple, io.read_predictions(spark, str(tmp_path / "p.json")).collect())) == [(3, 0, "a", "a"), (3, 1, "b", "x")]


def test_vocabulary_files(spark, tmp_path):
    vocabulary = spark.createDataFrame([(0, ""), (1, "a")], "token_id int, token string")
    text = io.vocabulary_json(vocabulary).first()[0]
    assert json.loads(text) == {"vocab": {"": 0, "a": 1}, "idx_token": {"0": "", "1": "a"}}
    (tmp_path / "0.json").write_text(text)
    assert sorted(map(tuple, io.read_vocabulary(spark, str(tmp_path)).collect())) == [(0, ""), (1, "a")]


def test_configs_and_summaries(tmp_path):
    path = str(tmp_path / "c.yaml")
    open(path, "w").write("aug: true  # note\nlr: 1e-3\nidx_fold: -1\ndir_work: work/-1\ncategories: ['', a, b]\nlist:\n  - 1\n  - x\n")
    config = io.read_config(path)
    assert config == {"aug": True, "lr": 0.001, "idx_fold": -1, "dir_work": "work/-1", "categories": ["", "a", "b"], "list": [1, "x"]}
    folds = list(io.fold_configs(config, 2))
    assert [(f["idx_fold"], f["dir_work"]) for f in folds] == [(0, "work/0"), (1, "work/1")]
    with pytest.raises(ValueError):
        list(io.fold_configs({"idx_fold": 0}, 2))
    out = str(tmp_path / "r.json")
    assert io.read_summary(out) == {}
    io.write_summary({"b": 1, "a": 2}, out)
    assert list(io.read_summary(out)) == ["a", "b"]


def test_alignment_of_long_strings_keeps_bits_alone():
    import tracemalloc

    ref = "abcdefghij" * 500
    hyp = ref.replace("j", "x")[3:]
    tracemalloc.start()
    chunks = M.align(ref, hyp)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(max(b - a, d - c) for e, a, b, c, d in chunks if e != "equal") == 503
    assert peak < 40 << 20  # a table of costs has 100 MB


def test_equal_pairs_are_aligned_once(spark, tmp_path):
    names = spark.createDataFrame([("beech",)] * 5 + [("tree",)] * 3 + [(None,)], "p_name string")
    names.write.parquet(f"{tmp_path}/part.parquet")
    out = QUERIES["align_chars"](spark, str(tmp_path))
    assert {tuple(r) for r in out.collect()} == {("equal", 5 * 3 + 3 * 2), ("substitute", 5 * 2 + 3 * 2)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2
