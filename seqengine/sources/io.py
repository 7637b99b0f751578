"""Readers and writers of datasets, vocabularies, metric histories and configurations."""

from __future__ import annotations

import hashlib
import io
import json
import logging
import pickle
from collections.abc import Iterator, Sequence
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHANNELS = 13
ANNOTATION = "struct<filename:string,id:bigint,label:string,id_writer:string,rate_sample_orig:int>"
INFO = "struct<idxs_channel:array<int>,num_channel:int,rate_sample_target:int,sensors:array<string>,time_build:string,num_fold:int,writer_independent:boolean>"
EVALUATION = "struct<levenshtein_distance:double,average_sentence_length:double,character_error_rate:double,word_error_rate:double>"
ITERATION = "struct<lr:double,iters:int,loss:double,time:double,loss_avg:double>"


def load_tables(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


class _Plain(pickle.Unpickler):
    """Unpickles lists, numbers, strings and arrays alone."""

    _allowed = {("numpy", "ndarray"), ("numpy", "dtype")}

    def find_class(self, module: str, name: str) -> Any:
        if (module, name) in self._allowed or (name in ("_reconstruct", "scalar", "_frombuffer") and module.startswith("numpy")):
            return super().find_class(module, name)
        raise pickle.UnpicklingError(f"not allowed: {module}.{name}")


def read_fold_pickles(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """Recordings of `<folder>/<fold>/`: fold, split, pos, values, indices, id_writer.

    A fold is named by its directory, in order of name.  The three lists of a
    fold must have equal lengths.  A fold is read by one task.
    """
    names = {f"all_x_dat_{split}_imu.pkl": "values", f"all_{split}_gt.pkl": "indices", f"{split}_ids.pkl": "id_writer"}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + ",".join(names) + "}").load(folder)
    parts = files.select(F.element_at(F.split("path", "/"), -2).alias("fold"), F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def unpack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = {names[n]: _Plain(io.BytesIO(bytes(c))).load() for n, c in zip(rows["name"], rows["content"])}
        if set(found) != set(names.values()) or len({len(v) for v in found.values()}) != 1:
            raise ValueError(f"fold {key[0]}: the parts differ in length or are missing")
        values = [[[float(x) for x in step] for step in seq] for seq in found["values"]]
        return pd.DataFrame({"fold": key[0], "split": split, "pos": range(len(values)), "values": values, "indices": [list(map(int, g)) for g in found["indices"]], "id_writer": [str(i) for i in found["id_writer"]]})

    return parts.groupBy("fold").applyInPandas(unpack, "fold string, split string, pos long, values array<array<double>>, indices array<int>, id_writer string")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an annotation document: fold and the annotation's fields."""
    schema = f"info {INFO}, categories array<string>, annotations map<string,array<{ANNOTATION}>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select(F.explode("annotations").alias("fold", "rows")).select("fold", F.inline("rows"))


def read_info(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"info {INFO}, categories array<string>").option("multiLine", True).json(path).select("info.*", "categories")


def write_annotations(annotations: DataFrame, path: str, info: dict[str, Any], categories: Sequence[str]) -> None:
    """One JSON document with the annotations of every fold in order of id, written by Spark as text."""
    fields = ["filename", "id", "label", "id_writer", "rate_sample_orig"]
    folds = annotations.groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("id", F.struct(*fields).alias("a")))).alias("rows"))
    folds = folds.select("fold", F.to_json(F.transform("rows", lambda r: r["a"])).alias("body"))
    joined = folds.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("fold").cast("string").alias("fold"), "body"))), lambda r: F.concat(F.lit('"'), r["fold"], F.lit('": '), r["body"])), ", ").alias("all"))
    head = f'{{"info": {json.dumps(info, ensure_ascii=False)}, "categories": {json.dumps(sorted(categories), ensure_ascii=False)}, "annotations": {{'
    joined.select(F.concat(F.lit(head), "all", F.lit("}}")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_recordings(spark: SparkSession, path: str, channels: int = CHANNELS) -> DataFrame:
    """Recording CSV files in the long layout: filename, t, c0...; t is the line's place."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("filename"), F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), "\r?\n")).alias("t", "line"))
    cells = F.split("line", ";")
    return rows.where("line <> ''").select("filename", "t", *[cells[k].cast("float").alias(f"c{k}") for k in range(channels)])


def write_recordings(steps: DataFrame, path: str, keys: Sequence[str] = ("split", "fold")) -> None:
    """Long recordings as Parquet by split and fold: few large files, and folds prune."""
    steps.write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_vocabulary(vocabulary: DataFrame, path: str, keys: Sequence[str] = ("tokenizer", "size", "fold")) -> None:
    vocabulary.write.mode("overwrite").partitionBy(*keys).json(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Character and bigram vocabulary files: token_id, token."""
    rows = spark.read.schema("vocab map<string,int>").option("multiLine", True).json(path)
    return rows.select(F.explode("vocab").alias("token", "token_id")).select("token_id", "token")


def vocabulary_json(vocabulary: DataFrame, inverse: str = "idx_token") -> DataFrame:
    """One row with the file's JSON: token to id, and id to token under string keys."""
    pairs = F.array_sort(F.collect_list(F.struct("token_id", "token")))
    rows = vocabulary.agg(pairs.alias("p"))
    forward = F.map_from_entries(F.transform("p", lambda x: F.struct(x["token"], x["token_id"])))
    back = F.map_from_entries(F.transform("p", lambda x: F.struct(x["token_id"].cast("string"), x["token"])))
    return rows.select(F.to_json(F.struct(forward.alias("vocab"), back.alias(inverse))).alias("value"))


def read_histories(spark: SparkSession, pattern: str) -> DataFrame:
    """Metric histories by path pattern: path, epoch, train, test, evaluation; the key `best` is left out."""
    schema = T.MapType(T.StringType(), T.StringType())
    rows = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema).alias("m"))
    epochs = rows.select("path", F.explode("m").alias("epoch", "body")).where("epoch <> 'best'")
    body = F.from_json("body", f"train array<{ITERATION}>, test array<{ITERATION}>, evaluation {EVALUATION}")
    return epochs.select("path", F.col("epoch").cast("int").alias("epoch"), body.alias("b")).select("path", "epoch", "b.*")


def epoch_metrics(histories: DataFrame) -> DataFrame:
    """Long metrics of the epochs that were evaluated: path, epoch, metric, value."""
    names = ["levenshtein_distance", "average_sentence_length", "character_error_rate", "word_error_rate"]
    flat = histories.where("evaluation is not null").select("path", "epoch", "evaluation.*")
    return flat.unpivot(["path", "epoch"], names, "metric", "value")


def iteration_log(histories: DataFrame) -> DataFrame:
    """Logged iterations: path, epoch, tag, iters, lr, loss, time; the summary row of an epoch is left out."""
    both = [histories.select("path", "epoch", F.lit(tag).alias("tag"), F.inline(tag)) for tag in ("train", "test")]
    return both[0].unionByName(both[1]).where("iters is not null").drop("loss_avg")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction files: epoch, idx, label, pred."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    sides = rows.select(F.try_element_at("m", F.lit("labels")).alias("labels"), F.explode("m").alias("epoch", "preds")).where("epoch <> 'labels'")
    zipped = F.arrays_zip(F.col("labels").alias("label"), F.col("preds").alias("pred"))
    return sides.select(F.col("epoch").cast("int").alias("epoch"), F.posexplode(zipped).alias("idx", "z")).select("epoch", "idx", "z.label", "z.pred")


def read_config(path: str) -> dict[str, Any]:
    """A flat YAML file: scalars and flow or block lists of scalars."""
    out: dict[str, Any] = {}
    key = None
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        text = line.split(" #")[0].rstrip() if not line.lstrip().startswith("#") else ""
        if not text.strip():
            continue
        if text.lstrip().startswith("- ") and key:
            out[key] = [*(out[key] or []), _scalar(text.lstrip()[2:])]
        else:
            key, _, value = text.partition(":")
            key, value = key.strip(), value.strip()
            out[key] = [_scalar(x) for x in value[1:-1].split(",") if x.strip()] if value.startswith("[") else _scalar(value)
    return out


def _scalar(text: str) -> Any:
    text = text.strip()
    if text[:1] in "'\"" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text in ("", "null", "~"):
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def write_config(config: dict[str, Any], path: str) -> None:
    Path(path).write_text("".join(f"{k}: {json.dumps(v, ensure_ascii=False)}\n" for k, v in config.items()), encoding="utf-8")


def fold_configs(config: dict[str, Any], folds: int, keys: Sequence[str] = ("dir_work", "dir_tokenizer", "tokenizer")) -> Iterator[dict[str, Any]]:
    """A configuration for each fold: -1 in the named settings becomes the fold, which must be -1 before."""
    if config.get("idx_fold") != -1:
        raise ValueError("idx_fold must be -1")
    for fold in range(folds):
        yield {k: v.replace("-1", str(fold)) if k in keys and isinstance(v, str) else fold if k == "idx_fold" else v for k, v in config.items()}


def read_summary(path: str) -> dict[str, Any]:
    """A results file, or an empty one if there is none."""
    return json.loads(Path(path).read_text(encoding="utf-8")) if Path(path).exists() else {}


def write_summary(results: dict[str, Any], path: str) -> None:
    """Results with sorted keys, put in place in one step."""
    part = Path(f"{path}.tmp")
    part.write_text(json.dumps(results, ensure_ascii=False, indent=2, sort_keys=True), encoding="utf-8")
    part.replace(path)


def write_histories(histories: DataFrame, path: str) -> None:
    """Metric histories (path, epoch, train, test, evaluation) as one JSON object a run, with the best epoch of each metric, a line a run.

    Null parts of an epoch are left out.  Ties of the best take the first epoch.
    """
    body = F.struct(F.col("epoch").cast("string").alias("key"), F.to_json(F.struct("train", "test", "evaluation")).alias("value"))
    runs = histories.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("epoch", body.alias("e")))).alias("rows"))
    best = epoch_metrics(histories).groupBy("path", "metric").agg(F.min(F.struct("value", "epoch")).alias("b"))
    entry = F.concat(F.to_json(F.struct(F.col("metric").alias("m"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("metric").alias("m")))) - 6), F.lit(": ["), F.col("b.epoch").cast("string"), F.lit(", "), F.col("b.value").cast("string"), F.lit("]"))
    best = best.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(entry)), ", ").alias("best"))
    lines = F.array_join(F.transform("rows", lambda r: F.concat(F.lit('"'), r["e"]["key"], F.lit('": '), r["e"]["value"])), ", ")
    joined = runs.join(best, "path", "left")
    joined.select(F.concat(F.lit("{"), lines, F.when(F.col("best").isNotNull(), F.concat(F.lit(', "best": {'), "best", F.lit("}"))).otherwise(F.lit("")), F.lit("}")).alias("value")).write.mode("overwrite").text(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """predictions(epoch, idx, label, pred) as one JSON object: the labels, and each epoch's predictions in order of idx."""
    each = predictions.groupBy("epoch").agg(F.array_sort(F.collect_list(F.struct("idx", "label", "pred"))).alias("r"))
    both = each.select(F.col("epoch").cast("string").alias("key"), F.transform("r", lambda x: x["pred"]).alias("texts"), F.transform("r", lambda x: x["label"]).alias("labels"))
    first = both.agg(F.min(F.struct(F.col("key").cast("int"), "labels")).alias("f")).select(F.lit("labels").alias("key"), F.col("f.labels").alias("texts"))
    pairs = first.unionByName(both.select("key", "texts")).agg(F.map_from_entries(F.collect_list(F.struct("key", "texts"))).alias("m"))
    pairs.select(F.to_json("m").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def token_frequencies(histogram: DataFrame, lengths: DataFrame, summary: DataFrame) -> DataFrame:
    """The token-frequency document as one row: ratio_token and ratio_length maps, mean and std.

    From token_histogram, length_shares and share_summary.
    """
    shares = histogram.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("token").cast("string"), "ratio")))).alias("ratio_token"))
    by_length = lengths.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("length").cast("string"), "ratio")))).alias("ratio_length"))
    return shares.join(by_length).join(summary.select("mean", "std")).select(F.to_json(F.struct("ratio_token", "ratio_length", "mean", "std")).alias("value"))


def write_token_frequencies(histogram: DataFrame, lengths: DataFrame, summary: DataFrame, path: str) -> None:
    token_frequencies(histogram, lengths, summary).coalesce(1).write.mode("overwrite").text(path)


def run_log(path: str, name: str = "seqengine") -> logging.Logger:
    """A logger that appends lines with time and level to a file of the driver."""
    log = logging.getLogger(f"{name}:{path}")
    log.setLevel(logging.INFO)
    if not log.handlers:
        handler = logging.FileHandler(path, encoding="utf-8")
        handler.setFormatter(logging.Formatter("%(asctime)s | %(levelname)s | %(message)s"))
        log.addHandler(handler)
    return log


def tokenizer_json(model: dict[str, Any]) -> str:
    """A tokenizer file of the common JSON format around a model: <PAD> special, cut at white space and marks."""
    pad = {"id": 0, "content": "<PAD>", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
    parts = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [pad], "normalizer": None, "pre_tokenizer": {"type": "Whitespace"}, "post_processor": None, "decoder": {"type": "BPEDecoder", "suffix": "</w>"}}
    return json.dumps({**parts, "model": model}, ensure_ascii=False, indent=2)


def save_bpe(tokens: Sequence[str], merges: Sequence[tuple[str, str]], path: str) -> None:
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
    Path(path).write_text(tokenizer_json({**model, "vocab": {t: i for i, t in enumerate(tokens)}, "merges": [list(m) for m in merges]}), encoding="utf-8")


def save_unigram(pieces: Sequence[tuple[str, float]], path: str) -> None:
    Path(path).write_text(tokenizer_json({"type": "Unigram", "unk_id": None, "vocab": [list(p) for p in pieces], "byte_fallback": False}), encoding="utf-8")


def load_tokenizer(path: str) -> tuple[str, list[str], list[Any]]:
    """Kind, tokens in id order, and merges (BPE) or pieces with scores (Unigram) of a tokenizer file; merges may be pairs or one string."""
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    if model["type"] == "BPE":
        tokens = [t for t, _ in sorted(model["vocab"].items(), key=lambda x: x[1])]
        return "bpe", tokens, [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    if model["type"] == "Unigram":
        return "unigram", [t for t, _ in model["vocab"]], [(t, float(x)) for t, x in model["vocab"]]
    raise ValueError(f"unknown tokenizer model: {model['type']}")


class Run:
    """A run's record: its epochs' iterations, summaries and evaluations, kept as tables and written as history and predictions.

    Every `frequency`-th iteration is logged; the state, with the seed of the
    epoch, can be written and resumed.
    """

    def __init__(self, spark: SparkSession, folder: str, tag: str = "train", frequency: int = 1, seed: int = 0):
        self.spark, self.folder, self.tag, self.frequency, self.seed = spark, folder, tag, frequency, seed
        self.epochs: dict[int, dict[str, Any]] = {}
        self.predictions: list[tuple[int, int, str, str]] = []

    def iteration(self, epoch: int, number: int, loss: float, lr: float = -1.0, time: float = 0.0, part: str = "train") -> None:
        kept = self.epochs.setdefault(epoch, {"train": [], "test": [], "evaluation": None, "losses": {"train": [], "test": []}})
        kept["losses"][part].append(loss)
        if (number + 1) % self.frequency == 0:
            kept[part].append({"lr": lr, "iters": number + 1, "loss": loss, "time": time})

    def summarize(self, epoch: int, time: float = 0.0, part: str = "train") -> float:
        """The mean loss of an epoch, kept as its last row."""
        losses = self.epochs[epoch]["losses"][part]
        mean = sum(losses) / len(losses)
        self.epochs[epoch][part].append({"loss_avg": mean, "time": time})
        return mean

    def evaluation(self, epoch: int, metrics: dict[str, float], labels: Sequence[str] = (), preds: Sequence[str] = ()) -> None:
        self.epochs.setdefault(epoch, {"train": [], "test": [], "evaluation": None, "losses": {"train": [], "test": []}})["evaluation"] = metrics
        self.predictions += [(epoch, i, y, p) for i, (y, p) in enumerate(zip(labels, preds))]

    def epoch_seed(self, epoch: int) -> int:
        """The seed of an epoch's random expressions, so that a resumed run draws as an unbroken one."""
        return int.from_bytes(hashlib.blake2b(f"{self.seed}:{epoch}".encode(), digest_size=7).digest(), "big")

    def histories(self) -> DataFrame:
        rows = [(self.tag, e, x["train"], x["test"], x["evaluation"]) for e, x in sorted(self.epochs.items())]
        return self.spark.createDataFrame(rows, f"path string, epoch int, train array<{ITERATION}>, test array<{ITERATION}>, evaluation {EVALUATION}")

    def save(self) -> None:
        write_histories(self.histories(), f"{self.folder}/{self.tag}_history")
        if self.predictions:
            write_predictions(self.spark.createDataFrame(self.predictions, "epoch int, idx int, label string, pred string"), f"{self.folder}/{self.tag}_preds")
        Path(self.folder, f"{self.tag}_state.json").write_text(json.dumps({"seed": self.seed, "frequency": self.frequency, "epochs": self.epochs, "predictions": self.predictions}), encoding="utf-8")

    @classmethod
    def resume(cls, spark: SparkSession, folder: str, tag: str = "train") -> Run:
        state = json.loads(Path(folder, f"{tag}_state.json").read_text(encoding="utf-8"))
        run = cls(spark, folder, tag, state["frequency"], state["seed"])
        run.epochs = {int(e): x for e, x in state["epochs"].items()}
        run.predictions = [tuple(p) for p in state["predictions"]]
        return run
