"""Run records, sinks and tokenizer files; motion features; sweeps; and that fits see the training part alone."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from seqengine.functions import tables
from seqengine.operators import encode as E
from seqengine.operators import metrics as M
from seqengine.operators import network as N
from seqengine.operators import planned as D
from seqengine.operators import prep as P
from seqengine.operators import score
from seqengine.operators import vocab as V
from seqengine.plans.registry import QUERIES
from seqengine.sources import io

WORDS = ["the", "then", "there", "other", "mother", "Straße", "straßen", "weather", "whether", "he, she", "that's", "über", "übers"]


def labels(spark, words=WORDS):
    return spark.createDataFrame([(w,) for w in words], "label string")


def test_bpe_file_is_the_librarys(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    made = E.get_tokenizer("bpe").train(labels(spark), ["x", "y"], 45)
    made.save(str(tmp_path / "bpe.json"))
    library = tokenizers.Tokenizer.from_file(str(tmp_path / "bpe.json"))
    back = E.get_tokenizer("bpe").load(str(tmp_path / "bpe.json"))
    assert back.tokens == made.tokens and back.merges == made.merges and library.get_vocab_size() == made.size
    rows = labels(spark).select("label", back.encode(F.col("label")).alias("ids")).collect()
    assert all(r["ids"] == library.encode(r["label"]).ids for r in rows)
    with pytest.raises(ValueError):
        E.get_tokenizer("unigram").load(str(tmp_path / "bpe.json"))


def test_bpe_merges_equal_the_trainer():
    tokenizers = pytest.importorskip("tokenizers")
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("abcdeß", k=rng.randint(2, 9))) for _ in range(400)})
    model = tokenizers.Tokenizer(tokenizers.models.BPE())
    model.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    model.train_from_iterator(words, tokenizers.trainers.BpeTrainer(vocab_size=120, min_frequency=1, special_tokens=["<PAD>"], show_progress=False))
    tokens, _ = V.bpe_merges({w: 1 for w in words}, 120)
    assert tokens == [t for t, _ in sorted(model.get_vocab().items(), key=lambda x: x[1])]


def test_unigram_file_is_read_by_the_library(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    made = E.get_tokenizer("unigram").train(labels(spark), [], 40)
    made.save(str(tmp_path / "unigram.json"))
    library = tokenizers.Tokenizer.from_file(str(tmp_path / "unigram.json"))
    back = E.get_tokenizer("unigram").load(str(tmp_path / "unigram.json"))
    assert back.tokens == made.tokens and library.get_vocab_size() == made.size
    score_of = dict(back.pieces)
    for r in labels(spark).select("label", back.encode(F.col("label")).alias("ids")).collect():
        theirs = library.encode(r["label"]).tokens
        assert sum(score_of[back.tokens[i]] for i in r["ids"]) == pytest.approx(sum(score_of[t] for t in theirs))


def test_sweep_equals_single_fits(spark):
    rows = V.sweep(labels(spark), [30, 45]).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["token_id"]):
        got.setdefault((r["tokenizer"], r["size"]), []).append(r["token"])
    for n in (30, 45):
        assert got["bpe", n] == V.fit_bpe(labels(spark), n)[0]
        assert got["unigram", n] == [t for t, _ in V.fit_unigram(labels(spark), n)]
        assert got["bigram", n] == [r["token"] for r in V.bigram_vocab(labels(spark), [], size=n).orderBy("token_id").collect()]


def test_run_is_written_and_resumed(spark, tmp_path):
    run = io.Run(spark, str(tmp_path), "train_2001", frequency=2, seed=5)
    for epoch, cer in enumerate((0.5, 0.25, 0.25)):
        for i, loss in enumerate((4.0, 2.0, 3.0)):
            run.iteration(epoch, i, loss, 0.1, float(i))
        assert run.summarize(epoch) == 3.0
        run.evaluation(epoch, {"levenshtein_distance": 1.0, "average_sentence_length": 2.0, "character_error_rate": cer, "word_error_rate": 1 - cer}, ["a", 'b"c'], [f"x{epoch}", "y"])
    run.save()
    again = io.Run.resume(spark, str(tmp_path), "train_2001")
    assert again.epochs == run.epochs and again.predictions == run.predictions and again.epoch_seed(7) == run.epoch_seed(7) != run.epoch_seed(8)
    path = f"{tmp_path}/train_2001_history"
    read = io.read_histories(spark, f"{path}/part-*").orderBy("epoch").collect()
    assert [(r["epoch"], r["evaluation"]["character_error_rate"]) for r in read] == [(0, 0.5), (1, 0.25), (2, 0.25)]
    assert [(x["iters"], x["loss"], x["loss_avg"]) for x in read[0]["train"]] == [(2, 2.0, None), (None, None, 3.0)]
    document = json.loads(spark.read.text(path).first()[0])
    assert document["best"]["character_error_rate"] == [1, 0.25] and document["best"]["word_error_rate"] == [0, 0.5]
    preds = io.read_predictions(spark, f"{tmp_path}/train_2001_preds/part-*").collect()
    assert {tuple(r) for r in preds} == {(e, i, y, p) for e in range(3) for i, (y, p) in enumerate(zip(["a", 'b"c'], [f"x{e}", "y"]))}


def test_epochs_are_routed(spark):
    rows = [(0, -1, "character_error_rate", 0.3), (0, 1, "character_error_rate", 0.2), (0, 2, "character_error_rate", 0.1), (0, 1, "word_error_rate", 0.5), (0, 2, "word_error_rate", 0.6), (0, -1, "word_error_rate", 0.7)]
    metrics = spark.createDataFrame(rows, "fold int, epoch int, metric string, value double")
    assert {(r["metric"], r["value"]) for r in P.routed_epochs(metrics, True).collect()} == {("character_error_rate", 0.3), ("word_error_rate", 0.7)}
    assert {(r["metric"], r["value"]) for r in P.routed_epochs(metrics.where("epoch >= 0"), False).collect()} == {("character_error_rate", 0.1), ("word_error_rate", 0.6)}


def test_token_frequency_document(spark, tmp_path):
    tokens = spark.createDataFrame([("a",), ("a",), ("bc",), ('"',)], "token string")
    histogram = M.token_histogram(tokens)
    io.write_token_frequencies(histogram, M.length_shares(histogram), M.share_summary(histogram), str(tmp_path / "f"))
    document = json.loads(spark.read.text(str(tmp_path / "f")).first()[0])
    assert document["ratio_token"] == {"a": 0.5, "bc": 0.25, '"': 0.25} and document["ratio_length"] == {"1": 0.75, "2": 0.25}
    assert document["mean"] == pytest.approx(1 / 3) and document["std"] == pytest.approx(math.sqrt(1 / 72))


def test_log_lines_are_appended(tmp_path):
    for text in ("one", "two"):
        io.run_log(str(tmp_path / "log"), "t").info(text)
    lines = (tmp_path / "log").read_text().splitlines()
    assert [x.rsplit("| ", 1)[1] for x in lines] == ["one", "two"]


def test_chunked_ids_are_dense(spark):
    rows = [(k % 3 or None, v) for k, v in enumerate(random.Random(1).sample(range(1000), 200))]
    df = spark.createDataFrame(rows, "k int, v int")
    plain = {tuple(r) for r in P.dense_ids(df, ["k"], ["v"]).collect()}
    assert {tuple(r) for r in P.dense_ids(df, ["k"], ["v"], chunk=F.expr("v div 50")).collect()} == plain


def test_shuffle_order_is_the_seeds(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    got = [r[0] for r in P.shuffled(df.repartition(5), "k", 42, 3).collect()]
    marks = {r[0]: r[1] for r in df.select("k", F.xxhash64("k", F.lit(42), F.lit(3))).collect()}
    assert got == sorted(marks, key=lambda k: (marks[k], k)) != [r[0] for r in P.shuffled(df, "k", 42, 4).collect()]


def test_pauses_and_similarity(spark):
    steps = spark.createDataFrame([(1, t, float(x)) for t, x in enumerate([0, 0, 0, 5, 9, 9])], "id int, t int, f double")
    got = [r["pause_1"] for r in D.pauses(steps, ["id"], ["f"], [1]).orderBy("t").collect()]
    quiet = [1, 1, 1, 0, 0, 1]
    assert got == pytest.approx([sum(quiet[max(0, k - 1) : k + 2]) / len(quiet[max(0, k - 1) : k + 2]) for k in range(6)])
    frames = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [1.0, 1.0]), (1, 2, [0.0, 0.0]), (1, 3, [1.0, 2.0])], "id int, t int, feature array<double>")
    assert [r["similarity"] for r in D.frame_similarity(frames, ["id"]).orderBy("t").collect()] == [pytest.approx(math.sqrt(0.5)), None, None, None]


def test_pair_statistics_by_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice("xyz"), float(rng.randint(0, 9))) for _ in range(300)]
    import numpy as np

    for r in D.pair_statistics(spark.createDataFrame(rows, "pair string, writer string, score double")).collect():
        v = [s for p, _, s in rows if p == r["pair"]]
        q = np.percentile(v, [25, 50, 75])
        assert (r["count"], r["coverage"]) == (len(v), len({w for p, w, _ in rows if p == r["pair"]})) and r["median"] == pytest.approx(q[1]) and r["iqr"] == pytest.approx(q[2] - q[0])


def test_motion_unigram_is_reestimated():
    frequency = {"abab": 5, "abc": 3, "cc": 2}
    pieces = [(V.PAD, 0.0), ("a", -2.0), ("b", -2.0), ("c", -2.0), ("ab", -1.0), ("abc", -3.0), ("cc", -3.0)]
    smooth = {"ab": 0.9, "bc": 0.01, "cc": 0.5}
    made = D.fit_motion_unigram(frequency, pieces, smooth, 1.0, 6)
    assert made[0] == (V.PAD, 0.0) and {"a", "b", "c", "ab"} <= {t for t, _ in made} and "abc" not in {t for t, _ in made}
    assert sum(math.exp(s) for t, s in made if t != V.PAD) == pytest.approx(1)


def test_fits_see_the_training_part_alone(spark):
    """What is learned from a fold's training rows doesn't change with its other rows, and applies to them."""
    train, rest = WORDS[:9], ["qqqq", "zzz"]
    rows = spark.createDataFrame([("0", "train", w) for w in train] + [("0", "val", w) for w in rest], "fold string, split string, label string")
    part = P.select_fold(rows, 0).where("split = 'train'").select("label")
    for fit in (lambda x: V.fit_bpe(x, 40), lambda x: V.fit_unigram(x, 40), lambda x: [tuple(r) for r in V.bigram_vocab(x, [], size=40).orderBy("token_id").collect()]):
        assert fit(part) == fit(labels(spark, train)) != fit(rows.select("label"))
    pairs = lambda x: {tuple(r) for r in D.pair_statistics(x).collect()}
    scored = rows.select("split", F.substring("label", 1, 2).alias("pair"), F.col("fold").alias("writer"), F.length("label").cast("double").alias("score"))
    assert pairs(scored.where("split = 'train'")) == {r for r in pairs(scored) if r[0] not in ("qq", "zz")}


def test_network_cost_of_one_stage(monkeypatch):
    monkeypatch.setitem(N.ENCODERS, "one", ((1,), (4,)))
    cost, frames = N.encoder_cost(2, "one", 10)
    conv = 2 * 2 * 4
    assert frames == 5 and cost.params == conv + 4 + sum(8 * k + 8 for k in (1, 3, 5)) + 8 * 4 + 4 and cost.macs == 5 * (conv + 8 * 9 + 32)
    assert N.ratio("blconv_b") == 8 and N.network_cost(13, "blconv_b", "bilstm_b").params > N.network_cost(13, "blconv_s", "bilstm_s").params
    with pytest.raises(ValueError):
        N.network_cost(13, "other", "bilstm_b")


def test_evaluation_step(spark):
    letters = ["", "a", "b"]
    rows = [([[0.1, 0.8, 0.1], [0.1, 0.8, 0.1], [0.9, 0.0, 0.1], [0.0, 0.1, 0.9], [0.0, 0.9, 0.1]], 8, [1, 2, 0])]
    batch = spark.createDataFrame(rows, "frames array<array<double>>, len_seq int, ids array<int>")
    got = score.evaluation_step(batch, lambda ids: E.decode_ids(ids, letters), ratio=2).first()
    assert got["character_error_rate"] == 0.0 and got["average_sentence_length"] == 2.0


def test_table_functions(spark):
    tables.register(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM explode_tokens(array(7, 8))").collect()] == [(0, 7), (1, 8)]
    assert spark.sql("SELECT * FROM explode_tokens(cast(null AS array<int>))").count() == 0
    assert {tuple(r) for r in spark.sql("SELECT * FROM align_chars('abc', 'axc')").collect()} == {("equal", "a", "a"), ("substitute", "b", "x"), ("equal", "c", "c")}


def test_pair_statistics_of_counted_rows(spark):
    rows = [("ab", "w1", 2.0, 3), ("ab", "w2", 5.0, 1), ("ab", "w2", 7.0, 4), ("cd", "w1", 1.0, 2)]
    counted = spark.createDataFrame(rows, "pair string, writer string, score double, times long")
    each = counted.select("pair", "writer", "score", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    assert {tuple(r) for r in D.pair_statistics(counted, times="times").collect()} == {tuple(r) for r in D.pair_statistics(each).collect()}


def test_repeated_words_are_cut_into_bigrams_once(spark, tmp_path):
    spark.createDataFrame([("en", "alpha beta alpha"), ("fr", "alpha")], "lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["pair_stats"](spark, str(tmp_path))
    assert {r["pair"]: r["count"] for r in out.collect()} == {"al": 3, "lp": 3, "ph": 3, "ha": 3, "be": 1, "et": 1, "ta": 1}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 3
