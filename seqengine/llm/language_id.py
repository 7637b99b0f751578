"""Language identification with labelled spans (operator 7).

Words are maximal runs of letters.  The scripts of a word's letters, by code
point range, narrow its candidate languages to those seen with that script in
training; each candidate gets a score a word from a character 1-4-gram naive
Bayes model.  A Viterbi pass over the words of a text, with a penalty for each
switch, labels spans, so mixed-language text gets one label a span.  The label
with most letters is the document's language and its share is the score.

The model is fitted on a bounded sample of labelled documents (`PER_LANGUAGE`
documents a language, the ones with the smallest hashes); predictions cover
every word of every text and never see lang, source or doc_id.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqengine.llm.shared import freeing

PER_LANGUAGE = 400
FEATURES = 1 << 16
SWITCH = 6.0
CLIP = 12.0
CACHE_BYTES = 32 << 20  # of the tokens that a task keeps, with `ENTRY` for each
ENTRY = 200
LEARN = 1 << 14  # tokens whose grams are held at a time
BATCH = 2 << 20  # bytes of text whose paths advance together
FEW = 16
FIT_CHARS = 20_000  # of a text that the fit reads

#: First code point, last code point and name of script ranges.
SCRIPTS = (
    (0x0041, 0x024F, "latin"),
    (0x0370, 0x03FF, "greek"),
    (0x0400, 0x052F, "cyrillic"),
    (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"),
    (0x0600, 0x077F, "arabic"),
    (0x0900, 0x097F, "devanagari"),
    (0x0E00, 0x0E7F, "thai"),
    (0x1E00, 0x1EFF, "latin"),
    (0x3040, 0x30FF, "kana"),
    (0x3400, 0x9FFF, "han"),
    (0xAC00, 0xD7AF, "hangul"),
)
_LETTERS = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> list[str]:
    """Maximal runs of letters; numeric characters such as fractions and Roman numerals are none."""
    out = []
    for run in _LETTERS.findall(text):
        if run.isalpha():
            out.append(run)
        else:
            out += "".join(c if c.isalpha() else " " for c in run).split()
    return out


def script_of(word: str) -> str:
    """The script of most of a word's letters, the earliest range on a tie."""
    if word and "A" <= min(word) and max(word) <= "\u024f":
        return "latin"
    found = Counter(next((name for first, last, name in SCRIPTS if first <= ord(c) <= last), "other") for c in word)
    return max(found, key=found.__getitem__) if found else "other"


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1-4-grams of padded words, and the word of each."""
    joined = np.array([ord(c) for c in "".join(f"\x02{w}\x03" for w in words)], np.uint64)
    length = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), length)
    out, who = [], []
    value = np.zeros(len(joined), np.uint64)
    for n in range(1, 5):
        value = value[: len(joined) - n + 1] * np.uint64(0x100000001B3) + joined[n - 1 :] + np.uint64(n)
        inside = owner[: len(joined) - n + 1] == owner[n - 1 :]
        h = value[inside] * np.uint64(0x9E3779B97F4A7C15)
        out.append((h >> np.uint64(48)).astype(np.int64))
        who.append(owner[: len(joined) - n + 1][inside])
    return np.concatenate(out), np.concatenate(who)


class Model:
    """Log-probabilities (FEATURES, languages) and the scripts of each language."""

    def __init__(self, languages: list[str], weights: np.ndarray, scripts: dict[str, list[bool]]):
        self.languages, self.weights, self.scripts = languages, weights, scripts

    @classmethod
    def fit(cls, rows: list[tuple[str, str]]) -> Model:
        """From (lang, text) rows."""
        languages = sorted({lang for lang, _ in rows})
        count = np.full((FEATURES, max(1, len(languages))), 0.5)
        scripts: dict[str, list[bool]] = {}
        for k, lang in enumerate(languages):
            seen = Counter(w for x, text in rows if x == lang for w in letter_runs(text.lower()))
            if not seen:
                continue
            words = list(seen)
            gram, who = _grams(words)
            count[:, k] += np.bincount(gram, np.array([seen[w] for w in words], float)[who], FEATURES)
            total = sum(seen.values())
            for name, n in Counter(script_of(w) for w in seen.elements()).items():
                if n >= 0.01 * total:
                    scripts.setdefault(name, [False] * len(languages))[k] = True
        return cls(languages, np.log(count / count.sum(axis=0)).astype(np.float32), scripts)

    def score(self, words: list[str]) -> np.ndarray:
        """(words, languages): log-likelihood relative to the best, with non-candidates at -2 * CLIP."""
        gram, who = _grams(words)
        total = np.stack([np.bincount(who, self.weights[gram, k], len(words)) for k in range(len(self.languages))], axis=1)
        allowed = np.array([self.scripts.get(script_of(w), [True] * len(self.languages)) for w in words])
        total = np.where(allowed, total, -np.inf)
        total -= total.max(axis=1, keepdims=True)
        return np.where(allowed, np.maximum(total, -CLIP), -2 * CLIP).astype(np.float32)


class Labeller:
    """Scores words once and runs Viterbi for a batch of texts at a time."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, int] = {}
        self.held = 0
        self.scores = np.zeros((0, len(model.languages)), np.float32)
        self.letters = np.zeros(0, np.int64)

    def _learn(self, tokens: set[str]) -> None:
        """Score the letter runs of new blank-separated tokens; a token's words count together."""
        if self.held > CACHE_BYTES:
            self.known, self.held, self.scores, self.letters = {}, 0, self.scores[:0].copy(), self.letters[:0].copy()
        new = [t for t in tokens if t not in self.known]
        if not new:
            return
        at = len(self.scores)
        score = np.zeros((len(new), len(self.model.languages)), np.float32)
        letters = np.zeros(len(new), np.int64)
        for first in range(0, len(new), LEARN):
            runs = [letter_runs(t.lower()) for t in new[first : first + LEARN]]
            letters[first : first + LEARN] = [sum(map(len, r)) for r in runs]
            if flat := [w for r in runs for w in r]:
                np.add.at(score, np.repeat(np.arange(first, first + len(runs)), [len(r) for r in runs]), self.model.score(flat))
        self.held += sum(map(len, new)) + len(new) * (ENTRY + 4 * score.shape[1])
        self.known.update((t, at + k) for k, t in enumerate(new))
        self.scores = np.concatenate([self.scores, score])
        self.letters = np.concatenate([self.letters, letters])

    def paths(self, texts: list[str]) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
        """Of each text its tokens, their letters and the label index of each (-1 without letters)."""
        cut = [t.split() for t in texts]
        self._learn(set().union(*cut) if cut else set())
        known = self.known
        index = [np.array([known[t] for t in tokens], np.int64) for tokens in cut]
        letters = [self.letters[x] for x in index]
        index = [x[n > 0] for x, n in zip(index, letters)]
        labels = viterbi([self.scores[x] for x in index], SWITCH)
        out = []
        for tokens, n, label in zip(cut, letters, labels):
            full = np.full(len(tokens), -1)
            full[n > 0] = label
            out.append((tokens, n, full))
        return out


def viterbi(scores: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """The best state path of each (steps, states) score matrix; a switch costs `switch`.

    Sequences advance together, the longest first, so a step is one array
    operation over those that still run; once those have at most `FEW` values,
    each goes on by itself.  Sums are in double precision either way.  Ties take
    the lower state and stay.
    """
    order = sorted(range(len(scores)), key=lambda k: -len(scores[k]))
    length = np.array([len(scores[k]) for k in order])
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
    if not len(order) or not length[0]:
        return out
    states = scores[order[0]].shape[1]
    start = np.r_[0, np.cumsum(length)]
    flat = np.concatenate([scores[k] for k in order]).astype(float)
    came = np.zeros(flat.shape, np.int16)
    active = np.searchsorted(-length, -np.arange(length[0]), "left")  # sequences longer than t
    alone = max(1, int(np.searchsorted(-active * states, -FEW)))  # the first step that each takes by itself
    best = flat[start[: active[0]]].copy()
    own = np.arange(states, dtype=np.int16)[None, :]
    for t in range(1, min(alone, length[0])):
        best = best[: active[t]]
        top = best.argmax(axis=1)
        other = best[np.arange(len(best)), top] - switch
        jump = other[:, None] > best
        at = start[: active[t]] + t
        came[at] = np.where(jump, top[:, None].astype(np.int16), own)
        new = np.where(jump, other[:, None], best) + flat[at]
        # Finished sequences keep their last values in place for the way back.
        flat[at] = new
        best = new
    state = np.zeros(len(order), np.int64)
    label = np.zeros(len(flat), np.int64)
    some = length > 0
    state[some] = flat[(start[1:] - 1)[some]].argmax(axis=1)
    for k in range(int(active[alone]) if alone < length[0] else 0):
        state[k] = _alone(flat[start[k] + alone : start[k + 1]], best[k], switch, label[start[k] + alone : start[k + 1]], came[start[k] + alone])
    for t in range(min(alone, length[0]) - 1, -1, -1):
        n = active[t]
        ends = length[:n] - 1 == t
        at = start[:n] + t
        if t < length[0] - 1:
            follow = ~ends
            state[:n][follow] = came[at[follow] + 1, state[:n][follow]]
        label[at] = state[:n]
    for k, i in enumerate(order):
        out[i] = label[start[k] : start[k + 1]]
    return out


def _alone(rows: np.ndarray, before: np.ndarray, switch: float, label: np.ndarray, came: np.ndarray) -> int:
    """Go on with one sequence from its values before: its labels, the way into its first row, and the state there."""
    best, ways = before.tolist(), []
    for row in rows.tolist():
        high = max(best)
        top, other = best.index(high), high - switch
        ways.append([top if other > x else k for k, x in enumerate(best)])
        best = [(other if other > x else x) + y for x, y in zip(best, row)]
    at = best.index(max(best))
    path = [at]
    for way in ways[:0:-1]:
        at = way[at]
        path.append(at)
    label[:] = path[::-1]
    came[:] = ways[0]
    return path[-1]


def fit(documents: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on at most `per_language` documents of each language.

    Only rows with text, lang and crc32(doc_id as text) mod 3 other than 1 are
    learned from; the ones with the smallest hashes are taken, up to `FIT_CHARS`
    characters of each.  Ranks within 64 parts of a language, then within 8 and
    over what is left of them, keep a bounded number of narrow rows in each task.
    """
    usable = documents.where("text is not null and lang is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    usable = usable.select("doc_id", F.col("lang").alias("fit_lang"), "text", F.xxhash64("text").alias("key"))
    mark = F.xxhash64(F.col("doc_id"), F.lit("language"))
    ranked = usable.select("doc_id", "fit_lang", "key", mark.alias("mark"), F.pmod(mark, F.lit(64)).alias("salt"))
    for parts in (64, 8, 1):  # the smallest of a language are among those of its parts
        by = W.partitionBy("fit_lang", F.pmod("salt", F.lit(parts))).orderBy("mark", "doc_id", "key")
        ranked = ranked.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= per_language)
    chosen = ranked.select("doc_id", "fit_lang", "key").distinct()
    rows = usable.join(F.broadcast(chosen), ["doc_id", "fit_lang", "key"]).groupBy("doc_id", "fit_lang", "key").agg(F.first(F.substring("text", 1, FIT_CHARS)).alias("text")).collect()
    return Model.fit([(r["fit_lang"], r["text"]) for r in sorted(rows, key=lambda r: (r["fit_lang"], r["doc_id"], r["key"]))])


def _judge(labeller: Labeller, texts: list[str | None], found: list | None = None) -> tuple[list[str], list[float]]:
    """Language and share of each text; `found` also gets the spans."""
    names = labeller.model.languages
    if not names:
        if found is not None:
            found += [[] for _ in texts]
        return ["und"] * len(texts), [0.0] * len(texts)
    pred, score = [], []
    for tokens, letters, label in labeller.paths([x or "" for x in texts]):
        weight = np.bincount(label[label >= 0], letters[label >= 0], len(names))
        total = weight.sum()
        pred.append(names[int(weight.argmax())] if total else "und")
        score.append(float(weight.max() / total) if total else 0.0)
        if found is not None:
            found.append(_spans(tokens, label, names))
    return pred, score


def _predict(model: Model, spans: bool):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from seqengine.llm.wordhash import batches

        labeller = Labeller(model)
        for batch in batches(stream, limit=BATCH):
            found = [] if spans else None
            pred, score = _judge(labeller, batch.column(1).to_pylist(), found)
            arrays = [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            if spans:
                arrays.append(pa.array(found, pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(arrays, ["row", "lang_pred", "score", "spans"][: len(arrays)])

    return run


def _spans(tokens: list[str], label: np.ndarray, names: list[str]) -> list[dict]:
    """Runs of equal label over the tokens with letters: first token, tokens with letters, language."""
    at = np.flatnonzero(label >= 0)
    if not len(at):
        return []
    cut = np.flatnonzero(np.r_[True, label[at][1:] != label[at][:-1]])
    size = np.diff(np.r_[cut, len(at)])
    return [{"first": int(at[c]), "words": int(n), "lang": names[label[at[c]]]} for c, n in zip(cut, size)]


def predict(documents: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score and with `spans` the labelled spans of every text.

    Null texts and texts without letters are `und` with score 0, as all are
    under a model without languages.  Repeated rows stay; other columns are
    ignored.  Ties take the first language in code point order.
    """
    columns = documents.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    kind = columns.schema["doc_id"].dataType.simpleString()
    extra = ", spans array<struct<first:int,words:int,lang:string>>" if spans else ""
    return columns.mapInArrow(freeing(_predict(model, spans)), f"row {kind}, lang_pred string, score double{extra}").withColumnRenamed("row", "doc_id")


def keep_identified(documents: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of documents whose text has an identified language with a share of at least `least`."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from seqengine.llm.wordhash import batches

        labeller = Labeller(model)
        for batch in batches(stream, limit=BATCH):
            verdict = _judge(labeller, batch.column("text").to_pylist())
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in zip(*verdict)], pa.bool_()))

    return documents.mapInArrow(freeing(run), documents.schema)
