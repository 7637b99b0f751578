"""Scoring of posterior matrices: CTC loss and forced alignment, and the inference hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _states(labels: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels between blanks, and whether each state may be reached from two before."""
    path = np.full(2 * len(labels) + 1, blank)
    path[1::2] = labels
    skip = np.zeros(len(path), bool)
    skip[3::2] = path[3::2] != path[1:-2:2]
    return path, skip


def ctc_nll(probs: np.ndarray, labels: np.ndarray, blank: int = 0, alpha: float = 1e-6) -> float:
    """Negative log-likelihood of labels by the forward algorithm; infinite where no path fits."""
    if alpha:
        probs = (1 - alpha) * probs + alpha / probs.shape[1]
        probs = probs / probs.sum(axis=1, keepdims=True)
    logs = np.log(probs)
    path, skip = _states(labels, blank)
    state = np.full(len(path), -np.inf)
    state[:2] = logs[0, path[:2]]
    for row in logs[1:]:
        one = np.r_[-np.inf, state[:-1]]
        two = np.where(skip, np.r_[-np.inf, -np.inf, state[:-2]][: len(path)], -np.inf)
        state = np.logaddexp(np.logaddexp(state, one), two) + row[path]
    return float(-np.logaddexp.reduce(state[-2:]))


def ctc_loss(rows: DataFrame, key: str, blank: int = 0, alpha: float = 1e-6) -> DataFrame:
    """rows(key, frames, ids) as key and loss, each row's over its label count (at least 1); their mean is the batch's loss.

    Frames are taken over their total; a row without frames has an infinite loss.
    """

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in stream:
            losses = []
            for frames, ids in zip(part["frames"], part["ids"]):
                probs = np.array([np.asarray(f, float) for f in frames])
                losses.append(ctc_nll(probs / probs.sum(axis=1, keepdims=True), np.asarray(ids, int), blank, alpha) / max(1, len(ids)) if len(probs) else float("inf"))
            yield pd.DataFrame({key: part[key], "loss": losses})

    return rows.select(key, "frames", "ids").mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, loss double")


def force_align(probs: np.ndarray, labels: np.ndarray, blank: int = 0) -> list[tuple[int, int, float]]:
    """First frame, past-the-end frame and mean probability of each label on the best path; [] if none fits."""
    if not len(labels) or not len(probs):
        return []
    with np.errstate(divide="ignore"):
        logs = np.log(probs)
    path, skip = _states(labels, blank)
    state = np.full(len(path), -np.inf)
    state[:2] = logs[0, path[:2]]
    came = np.zeros((len(probs), len(path)), np.int8)
    for t in range(1, len(probs)):
        two = np.where(skip, np.r_[-np.inf, -np.inf, state[:-2]][: len(path)], -np.inf)
        options = np.stack([state, np.r_[-np.inf, state[:-1]], two])
        came[t] = options.argmax(axis=0)
        state = options.max(axis=0) + logs[t, path]
    at = len(path) - 1 if state[-1] >= state[-2] else len(path) - 2
    if state[at] == -np.inf:
        return []
    frames: list[list[int]] = [[] for _ in labels]
    for t in range(len(probs) - 1, -1, -1):
        if at % 2:
            frames[at // 2].append(t)
        at -= int(came[t, at])
    return [(f[-1], f[0] + 1, float(probs[f[::-1], y].mean())) for f, y in zip(frames, labels)]


def forced_alignment(rows: DataFrame, key: str, blank: int = 0, ratio: int = 1) -> DataFrame:
    """rows(key, frames, ids) as one row a label on the best path: key, place, label, first, end, confidence.

    Ends are in steps of the recording, frames times `ratio`; a recording that
    no path fits has no rows.
    """

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in stream:
            out = []
            for k, frames, ids in zip(part[key], part["frames"], part["ids"]):
                probs = np.array([np.asarray(f, float) for f in frames])
                out += [(k, i, int(y), a * ratio, b * ratio, c) for i, (y, (a, b, c)) in enumerate(zip(ids, force_align(probs, np.asarray(ids, int), blank)))]
            yield pd.DataFrame(out, columns=[key, "place", "label", "first", "end", "confidence"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "frames", "ids").mapInPandas(run, f"{key} {kind}, place int, label int, first int, end int, confidence double")


def gelu(values: Column) -> Column:
    """Gaussian error linear unit, x * P(X <= x), of a column of numbers."""
    from math import erf, sqrt

    @F.pandas_udf(T.DoubleType())
    def unit(column: pd.Series) -> pd.Series:
        return column.astype(float).map(lambda x: x * 0.5 * (1 + erf(x / sqrt(2))))

    return unit(values)


def patches(length: Column, kernel: int = 2, stride: int = 2) -> Column:
    """Steps left after one strided convolution without padding."""
    return (F.floor((length - kernel) / stride) + 1).cast("long")


def infer(recordings: DataFrame, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], values: Column, width: int, batch: int = 64) -> DataFrame:
    """recordings with `frames`, the output of a model on flat values of `width` numbers.

    `make_model` runs once a Python worker and returns a function from a (rows,
    width) batch to a (rows, classes) one.
    """
    from pyspark.ml.functions import predict_batch_udf

    predict = predict_batch_udf(make_model, return_type=T.ArrayType(T.FloatType()), batch_size=batch, input_tensor_shapes=[[width]])
    return recordings.withColumn("frames", predict(values))


def evaluation_step(batch: DataFrame, decode: Callable[[Column], Column], group: Sequence[str] = (), ratio: int = 1, blank: int = 0) -> DataFrame:
    """The metric bundle of batch(frames, len_seq, ids): best paths of the valid frames, decoded like the labels, then compared."""
    from seqengine.functions.scalars import best_path, drop_blank
    from seqengine.operators.metrics import evaluate

    hyp = decode(best_path(F.col("frames"), F.col("len_seq"), ratio))
    pairs = batch.select(*group, decode(drop_blank(F.col("ids"), blank)).alias("ref"), hyp.alias("hyp"))
    return evaluate(pairs, group)
