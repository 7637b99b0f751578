"""MinHash near-dedup by a signature-coordinate inverted join (operator 9).

1. Every text becomes the set of its 3-word shingles (64-bit hashes) and a
   signature of `COORDINATES` minima.  Texts with equal sets are one class.
2. Each class is posted under every (coordinate, value) pair.  Postings travel
   as packed arrays, one row a bucket and task, and are counted per pair value.
3. Prefix and skip merging: a class with fewer than `matches` values that any
   other class shares can reach no partner and is skipped; of the others only
   the rarest `shared - matches + 1` values are merged, as two classes with
   that many common values have one of these in common.
4. Classes that meet under a prefix value form a coarse group, which is merged
   block against block, so no task holds more than two blocks; in a group of
   several blocks these hold sets of like sizes, and only blocks whose sizes
   permit the threshold meet.  Signatures alone meet so: the collisions of each
   pair are counted along the postings, and only texts with a pair of `matches`
   or more follow, whose full shingle sets decide 100 * intersection >=
   threshold * union.  First blocks meet themselves; then of what links don't
   join yet the best pair of each two components in a block pair is tried, and
   last all pairs still apart.  A block pair returns a spanning forest of its
   links, never all pairs.
5. Connected components of the links give component_id.

`matches` is the largest count that a pair at the threshold misses with a
probability below `MISS`.  No cap applies: every posting list is merged whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqengine.llm.shared import among, components, discard, freeing, written
from seqengine.llm.wordhash import batches, mix, shingles, words

COORDINATES, MISS = 64, 1e-8
BLOCK = 256
LONG = 32  # a coordinate with more than one in so many pairs in its postings is merged as a whole
BUCKET_BYTES = 24 << 20
_rng = np.random.default_rng(9)
_MULTIPLY = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64)


def matches_for(percent: int) -> int:
    """Equal coordinates that a pair at the threshold has but for a probability of MISS."""
    share, missed = percent / 100, 0.0
    for count in range(COORDINATES + 1):
        missed += comb(COORDINATES, count) * share**count * (1 - share) ** (COORDINATES - count)
        if missed >= MISS:
            return max(1, count)
    return COORDINATES


def signature(items: np.ndarray) -> np.ndarray:
    """The minimum of each of COORDINATES hash functions over a set that isn't empty."""
    low = np.empty(COORDINATES, np.uint32)
    for k in range(0, len(items), 1 << 14):
        part = ((items[None, k : k + (1 << 14)] * _MULTIPLY[:, None] + _ADD[:, None]) >> np.uint64(32)).min(axis=1).astype(np.uint32)
        low = part if not k else np.minimum(low, part)
    return low


def _features(size: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            word, _, _, rows = words(batch.column(1))
            count, key, sig = [], [], []
            for i in range(batch.num_rows):
                items = np.unique(shingles(word[rows[i] : rows[i + 1]], size))
                count.append(len(items))
                key.append(np.array([items.sum(dtype=np.uint64), mix(items).sum(dtype=np.uint64)]).tobytes() if len(items) else None)
                sig.append(signature(items).tobytes() if len(items) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "set_key", "signature"])

    return run


def _post(buckets: int):
    """Classes to one row a bucket: the packed (coordinate-value, class) postings."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if not batch.num_rows:
                continue
            rep = batch.column(0).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, COORDINATES)
            token = ((np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32))[None, :] | sig).ravel()
            where = (mix(token) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            cut = np.searchsorted(where[order], np.arange(buckets + 1))
            owner = np.repeat(rep, COORDINATES)[order]
            token = token[order]
            some = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int64()), pa.array([token[cut[k] : cut[k + 1]].tobytes() for k in some], pa.binary()), pa.array([owner[cut[k] : cut[k + 1]].tobytes() for k in some], pa.binary())],
                ["bucket", "tokens", "owners"],
            )

    return run


def _count(table: pa.Table) -> pa.Table:
    """Of one bucket, the postings whose value at least two classes have, with that count."""
    token = np.frombuffer(b"".join(table.column("tokens").to_pylist()), np.uint64)
    owner = np.frombuffer(b"".join(table.column("owners").to_pylist()), np.int64)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    many = np.repeat(np.diff(np.r_[start, len(token)]), np.diff(np.r_[start, len(token)]))
    keep = many > 1
    return pa.table({"rep": owner[keep], "token": token[keep].astype(np.int64), "many": many[keep].astype(np.int64)})


def collisions(signatures: np.ndarray) -> np.ndarray:
    """Equal coordinates of each pair of signatures, counted along the postings of every coordinate and value.

    Where near copies make a coordinate's lists so long that most of its pairs
    are in them, these are merged as a whole.
    """
    n = len(signatures)
    whole, long = np.zeros((n, n), np.int32), np.zeros(COORDINATES, bool)
    for k, column in enumerate(np.ascontiguousarray(signatures.T)):
        size = np.unique(column, return_counts=True)[1]
        long[k] = LONG * int((size * (size - 1)).sum()) > n * n
        if long[k]:
            whole += column[:, None] == column
    np.fill_diagonal(whole, 0)
    some = np.flatnonzero(~long)
    token = ((some.astype(np.uint64) << np.uint64(32))[None, :] | signatures[:, some]).ravel()
    who = np.repeat(np.arange(n), len(some))
    order = np.argsort(token, kind="stable")
    token, who = token[order], who[order]
    pairs = [np.zeros(0, np.int64)]
    at, step = np.arange(len(token)), 1
    while len(at):
        at = at[at + step < len(token)]
        at = at[token[at] == token[at + step]]  # tokens are sorted: a run that ended stays ended
        pairs.append(who[at] * n + who[at + step])
        step += 1
    count = np.bincount(np.concatenate(pairs), minlength=n * n).astype(np.int32).reshape(n, n)
    return whole + count + count.T


def jaccard_forest(ids: np.ndarray, sets: list[np.ndarray], percent: int, signatures: np.ndarray, split: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets of distinct, sorted items, as pairs of ids.

    A link has 100 * intersection >= percent * union.  Only pairs with enough
    equal coordinates are compared, and no pair that links join already.
    `split`: only the part before it is compared with the part after it.
    """
    enough = collisions(signatures) >= matches_for(percent)
    if split is not None:
        enough[:split, :split] = False
        enough[split:, split:] = False
    root = list(range(len(sets)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(enough, 1)))):
        if find(i) == find(j):
            continue
        small, large = sorted((sets[i], sets[j]), key=len)
        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
        common = int(np.count_nonzero(large[at] == small))
        if 100 * common >= percent * (len(small) + len(large) - common):
            root[find(j)] = find(i)
            out.append((int(ids[i]), int(ids[j])))
    return out


def _verify(size: int, percent: int):
    """Of one block pair, the links that full shingle sets confirm."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("rep", "ascending")])
        ids = table.column("rep").to_numpy()
        sets: list[np.ndarray] = []
        for batch in batches(iter(table.select(["text"]).combine_chunks().to_batches())):
            word, _, _, rows = words(batch.column(0))
            sets += [np.unique(shingles(word[rows[i] : rows[i + 1]], size)) for i in range(batch.num_rows)]
        side = table.column("side").to_numpy()
        signatures = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(-1, COORDINATES)
        some = np.flatnonzero([len(s) > 0 for s in sets])  # a text without words shares its doc_id with another
        if not len(some):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        split = None if side[0] == side[-1] else int(np.searchsorted(side[some], 1))
        found = jaccard_forest(ids[some], [sets[k] for k in some], percent, signatures[some], split)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def near_duplicates(documents: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """Near-duplicate classes of documents(doc_id, text): doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id reachable over links with
    100 * intersection >= percent * union of `size`-word shingle sets.  A null
    or wordless text has an empty set and is linked with nothing.  Equal rows
    stay as many rows as there are, and rows that share a doc_id are one node:
    the links of any of its texts count; a null doc_id keeps a null component_id and
    is linked with nothing.  Other columns are ignored.  An empty table gives an
    empty result.
    """
    spark = documents.sparkSession
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    features = written(documents.mapInArrow(freeing(_features(size)), "doc_id long, n_shingles long, set_key binary, signature binary"), "features")
    classes = written(features.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min("signature").alias("signature"), F.first("n_shingles").alias("size")), "classes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, 1 + classes.count() * COORDINATES * 16 // BUCKET_BYTES)
    posted = classes.select("rep", "signature").mapInArrow(freeing(_post(buckets)), "bucket long, tokens binary, owners binary")
    shared = posted.groupBy("bucket").applyInArrow(_count, "rep long, token long, many long")
    matches = matches_for(percent)
    lists = shared.groupBy("rep").agg(F.collect_list(F.struct("many", "token")).alias("values"))
    prefix = lists.where(F.size("values") >= matches).select("rep", F.explode(F.slice(F.array_sort("values"), 1, F.size("values") - (matches - 1))).alias("v"))
    prefix = written(prefix.select("rep", F.col("v.token").alias("token")), "prefix")
    first = prefix.groupBy("token").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1")
    coarse = written(components(prefix.join(first, "token").select(F.col("rep").alias("a"), F.col("hub").alias("b"))), "coarse")
    links = _links(documents, coarse, classes, size, percent)
    found = written(components(links), "components")
    discard(coarse)
    discard(prefix)
    classes = classes.select("set_key", "rep").join(found.select(F.col("id").alias("rep"), F.col("component").alias("linked")), "rep", "left")
    # Only classes of several documents, or linked ones, differ from a document's own id.
    several = features.where("doc_id is not null").groupBy("set_key").agg(F.count("*").alias("n"))
    moved = classes.join(several, "set_key").where("n > 1 or linked is not null").select("set_key", F.coalesce("linked", "rep").alias("component"))
    return (
        features.select("doc_id", "n_shingles", "set_key")
        .join(moved, "set_key", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _outstanding(percent: int, best: bool):
    """Of one block pair, by signatures alone, the rows that have a pair to verify: of two roots, with enough collisions, and with `best` the first such pair of two roots."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("rep", "ascending")])
        side, root = table.column("side").to_numpy(), table.column("root").to_numpy()
        count = collisions(np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(-1, COORDINATES))
        near = (count >= matches_for(percent)) & (root[:, None] != root[None, :])
        if side[0] != side[-1]:
            near &= side[:, None] != side[None, :]
        i, j = np.nonzero(np.triu(near, 1))
        if best:
            order = np.argsort(-count[i, j], kind="stable")
            i, j = i[order], j[order]
            roots = np.stack([np.minimum(root[i], root[j]), np.maximum(root[i], root[j])], 1)
            first = np.unique(roots, axis=0, return_index=True)[1]
            i, j = i[first], j[first]
        return table.take(pa.array(np.unique(np.concatenate([i, j]))))

    return run


_PAIR = ["component", "low", "high", "x", "y"]


def _members(coarse: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The coarse groups' classes with their block, its size span, and the blocks of that span (blocks), of the next (up) and of the one before (down)."""
    groups = coarse.groupBy("component").agg(F.count("*").alias("n"))
    rows = coarse.join(groups, "component").join(classes.select(F.col("rep").alias("id"), "signature", "size"), "id")
    # Sets that reach the threshold are in one span or in two that are next to each other.
    span = F.expr(f"if(n <= {BLOCK}, 0L, cast(floor(log(size) / (log(100D / {percent}) + 1e-6D)) as bigint))")
    rows = rows.select("component", F.col("id").alias("rep"), "signature", span.alias("span"))
    bins = rows.groupBy("component", "span").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    beside = lambda by, name: bins.select("component", (F.col("span") + by).alias("span"), F.col("blocks").alias(name))
    bins = bins.join(beside(-1, "up"), ["component", "span"], "left").join(beside(1, "down"), ["component", "span"], "left").na.fill(0, ["up", "down"])
    return rows.join(bins, ["component", "span"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))


#: The block pairs of a row but its block's with itself: in its span, with the next span and with the one before.
_OTHERS = """concat(
    transform(filter(sequence(0L, blocks - 1), o -> o <> block), o -> struct(span as low, span as high, least(block, o) as x, greatest(block, o) as y, cast(block > o as int) as side)),
    if(up > 0, transform(sequence(0L, up - 1), o -> struct(span as low, span + 1 as high, block as x, o as y, 0 as side)), array()),
    if(down > 0, transform(sequence(0L, down - 1), o -> struct(span - 1 as low, span as high, o as x, block as y, 1 as side)), array()))"""


def _links(documents: DataFrame, coarse: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) within the coarse groups, block against block."""
    texts = documents.select(F.col("doc_id").alias("rep"), "text")
    member = written(_members(coarse, classes, percent), "members")

    def linked(rows: DataFrame, best: bool) -> DataFrame:
        rows = rows.select("rep", "signature", "root", "side", *_PAIR)
        some = rows.groupBy(*_PAIR).applyInArrow(_outstanding(percent, best), rows.schema).drop("root")
        some = written(some, "outstanding")
        found = among(texts, "rep", some.select("rep")).hint("merge").join(some, "rep").groupBy(*_PAIR).applyInArrow(_verify(size, percent), "a long, b long")
        found = written(found, "links")
        discard(some)
        return found

    itself = member.select("*", F.col("span").alias("low"), F.col("span").alias("high"), F.col("block").alias("x"), F.col("block").alias("y"), F.lit(0).alias("side"))
    links = linked(itself.withColumn("root", F.col("rep")), False)
    wide = member.where("blocks > 1 or up > 0 or down > 0")
    for best in (True, False) if wide.limit(1).count() else ():
        roots = components(links).withColumnRenamed("id", "rep")
        rooted = wide.join(roots.withColumnRenamed("component", "linked"), "rep", "left").withColumn("root", F.coalesce("linked", "rep"))
        # A group that links join already has no pair left to try.
        apart = rooted.groupBy("component").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("component")
        rooted = written(rooted.join(apart, "component"), "rooted")
        links = links.unionAll(linked(rooted.select("rep", "signature", "root", "component", F.inline(F.expr(_OTHERS))), best))
        discard(rooted)
    discard(member)
    return links
