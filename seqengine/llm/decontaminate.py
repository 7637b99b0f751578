"""Benchmark decontamination by BM25 and block-max WAND (operator 10).

Test items are indexed by word: a posting has the item and its BM25 impact as a
share of the item's own total, so a passage that holds the whole item scores 1
for it.  Items stand in blocks of `BLOCK`, and each term keeps its largest
impact in each block that has it.  A passage is a run of 2M words, a new one
every M, M being the least power of 4 that the item's words don't exceed, so any
copy of an item lies in one passage, and a long item changes nothing for others.

Every passage is a query of its distinct words.  The sum of block maxima bounds
all scores of a block and is an array sum over some passages; only blocks whose bound
reaches the threshold are opened, and in these a document-at-a-time WAND finds
every item above it.  Verification: the five-word shingles of the item's
question (all but its last sentence) and the words of its answer (the last
sentence) must be in the passage by 0.8 or more each.

The index is bounded: a benchmark of more than `INDEX_ITEMS` items or
`INDEX_WORDS` words is taken in parts of that size, and the documents are read
once a part.  Document frequencies and the mean length are those of the whole
benchmark, so parts change no score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqengine.llm.shared import freeing
from seqengine.llm.wordhash import PLAIN, batches, shingles, words

K1, B = 1.2, 0.75
BLOCK = 8
INDEX_ITEMS, INDEX_WORDS = 20_000, 4_000_000
CELLS = 1 << 20  # bounds held at a time
THRESHOLD = 0.6
SHINGLE = 5
OVERLAP = 0.8
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item: the last sentence is the answer; a single one is both."""
    parts = [p for p in _SENTENCE.split(text) if re.search(r"\w", p)]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


def _hashes(texts: list[str]) -> list[np.ndarray]:
    word, _, _, rows = words(pa.array(texts, pa.string()), PLAIN)
    return [word[rows[i] : rows[i + 1]] for i in range(len(texts))]


class Statistics:
    """Of all items that have words: their number, mean length and each term's document frequency."""

    def __init__(self) -> None:
        self.n, self.words = 0, 0
        self.terms, self.df = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, texts: list[str]) -> None:
        each = [w for w in _hashes(texts) if len(w)]
        self.n += len(each)
        self.words += sum(map(len, each))
        terms = np.concatenate([self.terms, *(np.unique(w) for w in each)])
        weight = np.concatenate([self.df, np.ones(len(terms) - len(self.df), np.int64)])
        self.terms, number = np.unique(terms, return_inverse=True)
        self.df = np.bincount(number, weight, len(self.terms)).astype(np.int64)


class Index:
    """The BM25 inverted index of (item_id, text) items that have words, of at most `longest` words each."""

    def __init__(self, items: list[tuple[int, str]], statistics: Statistics | None = None, longest: int | None = None):
        if statistics is None:
            statistics = Statistics()
            statistics.add([t for _, t in items])
        pairs = [(i, t, w) for (i, t), w in zip(items, _hashes([t for _, t in items])) if len(w)]
        self.ids = [i for i, _, _ in pairs]
        self.longest = longest or max((len(w) for _, _, w in pairs), default=1)
        parts = [split_item(t) for _, t, _ in pairs]
        self.question = [np.unique(shingles(w, SHINGLE)) for w in _hashes([q for q, _ in parts])]
        self.answer = [np.unique(w) for w in _hashes([a for _, a in parts])]
        n = len(pairs)
        size = np.array([len(w) for _, _, w in pairs], float)
        each = [np.unique(w, return_counts=True) for _, _, w in pairs]
        term = np.concatenate([t for t, _ in each]) if n else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(n), [len(t) for t, _ in each]) if n else np.zeros(0, int)
        tf = np.concatenate([c for _, c in each]).astype(float) if n else np.zeros(0)
        self.terms, number, count = np.unique(term, return_inverse=True, return_counts=True)
        df = statistics.df[np.searchsorted(statistics.terms, self.terms)] if n else count
        idf = np.log1p((statistics.n - df + 0.5) / (df + 0.5))
        impact = idf[number] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / (statistics.words / statistics.n))) if n else tf
        own = np.bincount(item, impact, n)
        impact = impact / own[item] if n else impact
        order = np.lexsort((item, number))
        self.items, self.impacts = item[order], impact[order]
        self.at = np.r_[0, np.cumsum(count)]
        self.blocks = -(-n // BLOCK)
        # The blocks of each term, one behind the other, with the largest impact in each.
        number, block = number[order], self.items // BLOCK
        start = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (block[1:] != block[:-1])]) if n else np.zeros(0, int)
        self.block, owner = block[start], number[start]
        top = np.maximum.reduceat(self.impacts, start) if n else np.zeros(0)
        self.top = (top * 1.00001).astype(np.float32)  # a bound stays one in single precision
        self.block_at = np.searchsorted(owner, np.arange(len(self.terms) + 1))
        # The same entries by block: their terms, and where their postings begin and end.
        self.entry = np.lexsort((owner, self.block))
        self.entry_term = owner[self.entry]
        self.entry_at = np.searchsorted(self.block[self.entry], np.arange(self.blocks + 1))
        self.begin, self.end = start, np.r_[start[1:], len(self.items)]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.terms >> np.uint64(44)).astype(np.int64)] = True

    def lookup(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are index terms, and their terms."""
        at = np.flatnonzero(self.seen[(word >> np.uint64(44)).astype(np.int64)])
        term = np.searchsorted(self.terms, word[at])
        good = self.terms[np.minimum(term, len(self.terms) - 1)] == word[at]
        return at[good], term[good]

    def wand(self, terms: np.ndarray, block: int, least: float) -> list[tuple[int, float]]:
        """Items of a block whose score for the distinct terms is at least `least`, in order.

        Cursors stand on the terms' postings in order of item; the first prefix
        of them whose block maxima reach `least` fixes the pivot, and cursors
        before it skip there at once.
        """
        a, b = self.entry_at[block], self.entry_at[block + 1]
        at = a + np.searchsorted(self.entry_term[a:b], terms)
        at = at[at < b][self.entry_term[at[at < b]] == terms[at < b]]
        entry = self.entry[at]
        high = (block + 1) * BLOCK
        cursors = []  # the item, the place among the term's items of the block, these items, their impacts, the bound
        for x, y, top in zip(self.begin[entry].tolist(), self.end[entry].tolist(), self.top[entry].tolist()):
            items = self.items[x:y].tolist()
            cursors.append([items[0], 0, items, x, top])
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, None
            for c in cursors:
                bound += c[4]
                if bound >= least:
                    pivot = c[0]
                    break
            if pivot is None:
                break
            if cursors[0][0] == pivot:
                score = sum(float(self.impacts[c[3] + c[1]]) for c in cursors if c[0] == pivot)
                if score >= least - 1e-9:
                    out.append((pivot, score))
                go = pivot + 1
            else:
                go = pivot
            for c in cursors:
                while c[0] < go:
                    c[1] += 1
                    c[0] = c[2][c[1]] if c[1] < len(c[2]) else high
            cursors = [c for c in cursors if c[1] < len(c[2])]
        return out

    def candidates(self, word: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, int, np.ndarray]]:
        """(row, first word, block, distinct terms) of passages whose block bound reaches the threshold."""
        if not len(self.ids) or not len(word):
            return []
        m = self.longest
        at, term = self.lookup(word)
        if not len(at):
            return []
        row = np.searchsorted(rows, at, "right") - 1
        half = (at - rows[row]) // m  # a passage is two halves, half k and k + 1
        order = np.lexsort((at, term, row))
        same = (row[order][1:] == row[order][:-1]) & (term[order][1:] == term[order][:-1])
        before = np.full(len(at), -9)
        before[order[1:][same]] = half[order[:-1][same]]
        base = np.r_[0, np.cumsum((np.diff(rows) + m - 1) // m)]
        cell = base[row] + half
        uses = [(cell[use] - late, term[use]) for late in (0, 1) if (use := (before < half - late) & (half >= late)).any()]
        where, used = np.concatenate([w for w, _ in uses]), np.concatenate([t for _, t in uses])  # as the first half of passage k, or the second half of passage k - 1
        order = np.argsort(where, kind="stable")
        where, used = where[order], used[order]
        size = self.block_at[used + 1] - self.block_at[used]
        done = np.r_[0, np.cumsum(size)]
        starts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        ends, passages = np.r_[starts[1:], len(where)], where[starts]
        out, p = [], 0
        while p < len(starts):  # as many passages as bounds and block entries fit
            fit = np.searchsorted(passages, passages[p] + max(1, CELLS // self.blocks)), np.searchsorted(done[ends], done[starts[p]] + CELLS, "right")
            q = max(p + 1, int(min(fit)))
            x, y = starts[p], ends[q - 1]
            entry = np.arange(done[y] - done[x]) - np.repeat(done[x:y] - done[x], size[x:y]) + np.repeat(self.block_at[used[x:y]], size[x:y])
            low = int(where[x])
            flat = np.repeat(where[x:y] - low, size[x:y]) * self.blocks + self.block[entry]
            bound = np.bincount(flat, self.top[entry])
            for k in np.flatnonzero(bound >= THRESHOLD).tolist():
                c, block = low + k // self.blocks, k % self.blocks
                r = int(np.searchsorted(base, c, "right") - 1)
                first = int(rows[r] + (c - base[r]) * m)
                last = min(first + 2 * m, int(rows[r + 1]))
                a, b = np.searchsorted(at, (first, last))
                out.append((r, first, block, np.unique(term[a:b])))
            p = q
        return out

    def matches(self, word: np.ndarray, rows: np.ndarray) -> dict[tuple[int, int], tuple[float, float, float]]:
        """Verified (row, item): best score, question and answer overlap over the row's passages."""
        found: dict[tuple[int, int], tuple[float, float, float]] = {}
        for r, first, block, terms in self.candidates(word, rows):
            hits = self.wand(terms, block, THRESHOLD)
            if not hits:
                continue
            part = word[first : min(first + 2 * self.longest, rows[r + 1])]
            grams = np.unique(shingles(part, SHINGLE))
            for item, score in hits:
                question = self.question[item]
                short = len(question) == 1
                q = float(np.isin(question, grams).mean()) if not short else float(self._holds(part, item))
                a = float(np.isin(self.answer[item], part).mean())
                if q >= OVERLAP and a >= OVERLAP:
                    found[r, item] = max(found.get((r, item), (0.0, 0.0, 0.0)), (score, q, a))
        return found

    def _holds(self, part: np.ndarray, item: int) -> bool:
        """Whether a passage has the words of a question of one shingle, in a row and of whatever number."""
        want = self.question[item]
        return any(np.isin(want, shingles(part, n)).all() for n in range(1, SHINGLE + 1))


def _indexes(benchmark: DataFrame) -> Iterator[list[Index]]:
    """The index in parts of bounded size, an index for each length; null ids and texts without words are no items."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct().orderBy("item_id", "text")

    def parts() -> Iterator[list[tuple[int, str]]]:
        part, size = [], 0
        for row in items.toLocalIterator():
            part.append((row[0], row[1]))
            size += 1 + row[1].count(" ")
            if len(part) == INDEX_ITEMS or size >= INDEX_WORDS:
                yield part
                part, size = [], 0
        if part:
            yield part

    statistics = Statistics()
    for part in parts():
        statistics.add([t for _, t in part])
    for part in parts():
        by: dict[int, list[tuple[int, str]]] = {}
        for pair, word in zip(part, _hashes([t for _, t in part])):
            if len(word):
                by.setdefault(1 << 2 * (((len(word) - 1).bit_length() + 1) // 2), []).append(pair)
        yield [Index(group, statistics, longest) for longest, group in sorted(by.items())]


def _matches(indexes: list[Index], word: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, tuple[float, float, float]]]:
    """Verified (row, item_id, figures) over the indexes of a part, in order."""
    return sorted((r, index.ids[i], figures) for index in indexes for (r, i), figures in index.matches(word, rows).items())


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every document and test item it holds: doc_id, item_id, score, question_overlap, answer_overlap.

    Null texts hold nothing; repeated rows give repeated results, as do two
    items with one id whose texts differ; items with equal scores are all
    reported; an empty table on either side gives an empty result.  Other
    columns are ignored.
    """
    columns = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = columns.schema["doc_id"].dataType.simpleString()
    schema = f"row {kind}, item_id long, score double, question_overlap double, answer_overlap double"
    spark = documents.sparkSession

    def pairs(indexes: list[Index]) -> DataFrame:
        sent = spark.sparkContext.broadcast(indexes)

        def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches(stream):
                word, _, _, rows = words(batch.column(1), PLAIN)
                found = _matches(sent.value, word, rows)
                if found:
                    arrays = [batch.column(0).take(pa.array([r for r, _, _ in found], pa.int64())), pa.array([i for _, i, _ in found], pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays + [pa.array([v[k] for _, _, v in found], pa.float64()) for k in range(3)], ["row", "item_id", "score", "question_overlap", "answer_overlap"])

        return columns.mapInArrow(freeing(run), schema)

    parts = [pairs(indexes) for indexes in _indexes(benchmark)] or [spark.createDataFrame([], schema)]
    return reduce(DataFrame.unionAll, parts).withColumnRenamed("row", "doc_id")


def keep_clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents whose text holds no test item."""
    for indexes in _indexes(benchmark):
        sent = documents.sparkSession.sparkContext.broadcast(indexes)

        def run(stream: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches(stream):
                word, _, _, rows = words(batch.column(batch.schema.get_field_index("text")), PLAIN)
                bad = {r for r, _, _ in _matches(sent.value, word, rows)}
                yield batch.filter(pa.array([r not in bad for r in range(batch.num_rows)], pa.bool_()))

        documents = documents.mapInArrow(freeing(run), documents.schema)
    return documents
