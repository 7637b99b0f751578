"""Line dedup by an exact set-similarity join (operator 6), in DataFrame functions only.

A line is the set of its blank-separated tokens.  It is removed if an earlier
line, by (doc_id, line number), has a set of Jaccard similarity 0.8 or more;
equal sets are the extreme case.  Lines without tokens are never removed.

1. Token rarity: all tokens of all documents are counted into `BUCKETS` hash
   buckets, whose levels (one byte each) are the only thing sent to the driver.
2. Lines with equal sets become one class, at the first of their positions.
   Its tokens are ordered by (level, hash), rarest first; the prefix of
   n - ceil(0.8 n) + 1 tokens is kept.  Two sets at 0.8 share a prefix token.
3. Postings of prefix tokens are joined under the length filter (sizes within
   0.8, by size class), the positional filter (the overlap still possible from
   the shared prefix places) and a parity filter (the bits in which two parity
   sketches differ are at most the symmetric difference allowed).  A sketch has
   64 bits, and 256 for sets of more than 64 tokens; all filters are plain
   comparisons of longs, so the join is compiled.
   Tokens are dealt in passes, so the shuffle of a part of them is on disk at once.
4. First each list's earliest class of a size class meets the others, one pair
   a posting of the shorter prefix below; then the classes that this did not remove meet all earlier ones,
   the smaller set of a pair by its first n - ceil(8 n / 9) + 1 tokens alone.
   Full token sets verify every pair, so a large group of near copies costs
   pairs in proportion to its lines, and no link that decides a removal is lost.
"""

from __future__ import annotations

from functools import reduce
from math import log2

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqengine.llm.shared import among, discard, written

BUCKETS = 1 << 16
LEVELS_AN_OCTAVE = 8
PASSES, PASS_PAIRS, PASS_POSTINGS = 8, 400_000, 6_000_000  # pairs are verified, and postings joined, in up to so many passes of about this size or more
QUARTERS = (-(1 << 62), 0, 1 << 62)  # hashes at which the quarters of a sorted set end
WIDE = ("wide1", "wide2", "wide3")  # sketches of the first three quarters of a set of more than 64 tokens
LEAST_TOKENS = 4  # below this no set reaches 0.8 without being equal

#: Blank-separated tokens of a line as a sorted array of distinct hashes.
_TOKENS = "sort_array(array_distinct(transform(array_remove(split({line}, ' '), ''), w -> xxhash64(w))))"
_KEY = "xxhash64({tokens})"


def token_levels(documents: DataFrame) -> list[int]:
    """For each bucket how often its tokens occur, in eighths of an octave."""
    words = documents.select(F.explode(F.split(F.expr("replace(text, '\n', ' ')"), " ")).alias("w")).where("w <> ''")
    counts = words.groupBy(F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int").alias("bucket")).count()
    levels = [0] * BUCKETS
    for bucket, count in counts.collect():
        levels[bucket] = min(127, int(LEVELS_AN_OCTAVE * log2(count + 1)) // 2)
    return levels


def _lines(documents: DataFrame, levels: list[int]) -> DataFrame:
    """Every line with tokens: doc, line, its set's keys k1 and k2, size n, parity sketch (of all, and of quarters in `WIDE`) and prefix.

    A prefix token is its level above 56 bits of its hash, so that plain order
    of longs is the rarity order.
    """
    rows = documents.select("doc", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    # The filter reads the line, not its tokens: pushed below them it would compute them twice.
    tokens = rows.where("trim(content) <> ''").select("doc", "line", F.expr(_TOKENS.format(line="content")).alias("tokens")).withColumn("n", F.size("tokens"))
    table = f"from_json('{levels}', 'array<bigint>')"
    ranked = F.expr(f"slice(sort_array(transform(tokens, t -> shiftleft(get({table}, cast(t & {BUCKETS - 1} as int)), 56) | (t & 72057594037927935))), 1, n - (4 * n + 4) div 5 + 1)")
    parity = lambda of: F.expr(f"aggregate({of}, 0L, (a, t) -> a ^ shiftleft(1L, cast((t >> 20) & 63 as int)))")
    long = F.col("n") > 64
    # Tokens are in the order of their hashes, so a quarter is a slice.
    tokens = tokens.withColumns({f"end{k}": F.when(long, F.expr(f"size(filter(tokens, t -> t < {at}L))")) for k, at in enumerate(QUARTERS)})
    wide = [F.when(long, parity(f"slice(tokens, {begin} + 1, end{k} - {begin})")).alias(name) for k, (begin, name) in enumerate(zip(("0", "end0", "end1"), WIDE))]
    several = F.col("n") >= LEAST_TOKENS
    keys = [F.expr(_KEY.format(tokens="tokens")).alias("k1"), F.xxhash64(F.lit(6), "tokens").alias("k2")]
    return tokens.select("doc", "line", *keys, "n", F.when(several, parity("tokens")).alias("parity"), *wide, F.when(several, ranked).alias("prefix"))


def _classes(lines: DataFrame) -> DataFrame:
    """One row a token set, numbered by first position: id, k1, k2, doc, line, copies, n, parity, wide1 to wide3, prefix.

    The range exchange puts first positions in order, so ids ascend with them.
    """
    grouped = lines.groupBy("k1", "k2").agg(F.min(F.struct("doc", "line")).alias("first"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n", "parity", *WIDE, "prefix")])
    ordered = grouped.select("first.doc", "first.line", "k1", "k2", "copies", "n", "parity", *WIDE, "prefix").repartitionByRange("doc", "line", "k1").sortWithinPartitions("doc", "line", "k1")
    return ordered.withColumn("id", F.monotonically_increasing_id())


def _postings(classes: DataFrame, part: int, parts: int) -> DataFrame:
    """A row a prefix token of a pass: token (31 bits of its hash), place, size class and the class's columns."""
    rows = classes.where("prefix is not null").select("id", "n", "parity", *WIDE, "open", F.posexplode("prefix").alias("place", "t"))
    token = F.expr("cast(t & 2147483647 as int)")
    rows = rows.where((token % parts) == part) if parts > 1 else rows
    return rows.select(token.alias("token"), "id", "parity", *WIDE, F.expr("shiftleft(cast(n as bigint), 32) | shiftleft(place, 1) | open").alias("packed"))


def _side(postings: DataFrame, side: str) -> DataFrame:
    """Postings with the packed columns apart, their names begun by `side`."""
    columns = {"token": "token", "id": "id", "parity": "parity", **{c: c for c in WIDE}, "n": "cast(packed >> 32 as int)", "place": "cast((packed >> 1) & 2147483647 as int)", "open": "packed & 1"}
    return postings.selectExpr(*(f"{e} as {side}{name}" for name, e in columns.items()))


#: The bits in which the sketches of four quarters differ; the fourth is what the others leave of the whole.
_WIDE_BITS = " + ".join(f"bit_count({x})" for x in (*(f"x{c} ^ y{c}" for c in WIDE), " ^ ".join(f"{side}{c}" for c in ("parity", *WIDE) for side in "xy")))
#: Length, positional and parity filters; the overlap needed is ceil(0.8 / 1.8 * (xn + yn)).
_FILTERS = (
    "yid <> xid and 5 * least(xn, yn) >= 4 * greatest(xn, yn)"
    " and least(xn - xplace, yn - yplace) >= (4 * (xn + yn) + 8) div 9"
    " and bit_count(xparity ^ yparity) * 9 <= xn + yn"
    f" and (xwide1 is null or ywide1 is null or ({_WIDE_BITS}) * 9 <= xn + yn)"
)


def _verified(documents: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The later classes (id) of pairs (xid, yid) whose full token sets have similarity 0.8 or more."""
    ends = pairs.select(F.explode(F.array("xid", "yid")).alias("id")).distinct()
    where = written(classes.select("id", "doc", "line", "k1").join(ends, "id").groupBy("doc").agg(F.collect_list(F.struct("id", "line", "k1")).alias("want")), "where")
    texts = among(documents, "doc", where.select("doc")).hint("merge").join(where, "doc").select(F.split("text", "\n").alias("lines"), F.explode("want").alias("w"))
    lines = texts.select("w.id", "w.k1", F.get("lines", F.col("w.line")).alias("content")).where("content is not null")
    # A generator's output keeps the filter above it.
    sets = lines.select("id", "k1", F.explode(F.array(F.expr(_TOKENS.format(line="content")))).alias("tokens")).where(F.expr(_KEY.format(tokens="tokens") + " = k1")).dropDuplicates(["id"])
    sets = written(sets.select("id", "tokens"), "sets")
    discard(where)
    common = F.size(F.array_intersect("xt", "yt"))
    passes = min(PASSES, 1 + pairs.count() // PASS_PAIRS)
    found = []
    for k in range(passes):  # a pass's shuffle is freed before the next one's
        part = pairs.where(F.pmod(F.xxhash64("xid"), F.lit(passes)) == k)
        both = part.join(sets.select(F.col("id").alias("xid"), F.col("tokens").alias("xt")).hint("merge"), "xid").join(sets.select(F.col("id").alias("yid"), F.col("tokens").alias("yt")).hint("merge"), "yid")
        found.append(written(both.where(5 * common >= 4 * (F.size("xt") + F.size("yt") - common)).select(F.col("xid").alias("id")).distinct(), "later"))
    discard(sets)
    return reduce(DataFrame.unionAll, found)


def _met(postings: DataFrame) -> DataFrame:
    """Within the tokens' one exchange, each list's earliest class of a size class meets the others: xid, yid."""
    dealt = _side(_short(postings).repartition("token"), "x").withColumn("span", F.expr("cast(floor(log(xn) / log(1.25D)) as int)"))
    hub = F.first(F.struct("xid", "xparity", *[f"x{c}" for c in WIDE], "xn", "xplace")).over(W.partitionBy("xtoken", "span").orderBy("xid").rowsBetween(W.unboundedPreceding, 0))
    met = dealt.withColumn("y", hub).select("*", *[F.col(f"y.x{c}").alias(f"y{c}") for c in ("id", "parity", *WIDE, "n", "place")])
    return met.where(_FILTERS).select("xid", "yid").distinct()


def _short(postings: DataFrame) -> DataFrame:
    """The postings that the smaller set of a pair needs: at 0.8 they share 8 / 9 of its tokens, so its first n - ceil(8 n / 9) + 1."""
    return postings.where("((packed >> 1) & 2147483647) <= (packed >> 32) - (8 * (packed >> 32) + 8) div 9")


def _paired(postings: DataFrame) -> DataFrame:
    """The open classes of each list meet all earlier ones: xid, yid; x is the larger set, of equal ones the later."""
    match = f"xtoken = ytoken and (yn < xn or yn = xn and yid < xid) and if(yid < xid, xopen, yopen) = 1 and {_FILTERS}"
    both = _side(postings, "x").join(_side(_short(postings), "y").hint("merge"), F.expr(match))
    return both.select(F.greatest("xid", "yid").alias("xid"), F.least("xid", "yid").alias("yid")).distinct()


def _once(parts: list[DataFrame], name: str) -> DataFrame:
    """The distinct pairs of tables of `written`, which are deleted."""
    if len(parts) == 1:
        return parts[0]
    out = written(reduce(DataFrame.unionAll, parts).distinct(), name)
    for part in parts:
        discard(part)
    return out


def removed_lines(documents: DataFrame) -> DataFrame:
    """The lines to remove, from documents(doc, text): doc, line, k1."""
    lines = written(_lines(documents, token_levels(documents)), "lines")
    classes = written(_classes(lines), "classes")

    postings = classes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    passes = min(PASSES, 1 + max(0, postings) // PASS_POSTINGS)
    fresh = classes.withColumn("open", F.lit(1))
    star = _once([written(_met(_postings(fresh, k, passes)), "star") for k in range(passes)], "star")
    gone = _verified(documents, classes, star)

    marked = classes.join(gone.select("id", F.lit(0).alias("o")).hint("merge"), "id", "left").withColumn("open", F.coalesce("o", F.lit(1)))
    marked = written(marked.select("id", "n", "parity", *WIDE, "open", "prefix"), "marked")
    rest = _once([written(_paired(_postings(marked, k, passes)), "rest") for k in range(passes)], "rest")
    discard(marked)
    new = written(rest.join(star, ["xid", "yid"], "left_anti"), "new")
    discard(rest)
    late = _verified(documents, classes, new)

    removed = gone.unionAll(late).withColumn("out", F.lit(True))
    info = classes.select("id", "k1", "k2", "copies", F.col("doc").alias("fd"), F.col("line").alias("fl")).join(removed, "id", "left").where("out or copies > 1")
    info = written(info.drop("id", "copies"), "info")
    # An occurrence is kept if it is its class's first and the class stays.
    out = among(lines.select("doc", "line", "k1", "k2"), "k1", info.select("k1")).join(info.hint("merge"), ["k1", "k2"]).where("out or doc <> fd or line <> fl").select("doc", "line", "k1").distinct()
    out = written(out, "removed")
    for table in (star, new, classes, lines, info):
        discard(table)
    return out


def dedup_lines(documents: DataFrame) -> DataFrame:
    """documents with a column `text` without the lines that repeat an earlier one, and n_lines, n_removed.

    Earlier means a smaller (doc_id, line number); a null doc_id is smallest.
    Rows that share a doc_id are one document: their equal rows lose the same
    lines, and of different texts lines at one number are ordered by hash.  A
    null text stays null with 0 lines; empty lines stay.  n_lines counts lines
    with tokens.  Every other column stays, but n_lines and n_removed replace
    any of these names; an empty table gives an empty result.
    """
    documents = documents.drop("n_lines", "n_removed")
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    narrow = documents.select(place.alias("doc"), F.col("text").cast("string").alias("text")).where("text is not null")
    gone = removed_lines(narrow).groupBy("doc").agg(F.collect_set(F.struct("line", "k1")).alias("__gone")).withColumnRenamed("doc", "__key")
    # One struct holds the row, so its names cannot meet those made here.
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("__row"), F.col("text").cast("string").alias("text"), place.alias("__doc"))
    joined = whole.hint("merge").join(gone, F.col("__doc") == F.col("__key"), "left")
    key = _KEY.format(tokens=_TOKENS.format(line="c"))
    # The line's number is looked up first, so that only lines at such a number are cut to tokens again.
    kept = f"filter(__lines, (c, i) -> trim(c) = '' or not array_contains(__at, i) or not array_contains(__gone, struct(i as line, {key} as k1)))"
    split = joined.withColumn("__lines", F.split("text", "\n")).withColumn("__at", F.col("__gone.line")).withColumn("__kept", F.expr(f"if(__gone is null, __lines, {kept})"))
    results = {
        "text": F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join("__kept", "\n")),
        "n_lines": F.coalesce(F.expr("size(filter(__lines, c -> trim(c) <> ''))"), F.lit(0)).cast("long"),
        "n_removed": F.coalesce(F.size("__lines") - F.size("__kept"), F.lit(0)).cast("long"),
    }
    return split.select(*[results["text"].alias(c) if c == "text" else F.col("__row")[c].alias(c) for c in documents.columns], results["n_lines"].alias("n_lines"), results["n_removed"].alias("n_removed"))
