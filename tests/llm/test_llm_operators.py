"""Operators on hostile tables, and the registered queries against brute force on the smallest tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqengine.llm import decontaminate, language_id, line_dedup, media, near_dedup, quotation, queries, sentencepiece_codec, shared, substring_dedup, token_codes, warc

P = pytest.importorskip("public_tokenizers")
SMALL = "/root/testdata/sf0.001"
small = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")
CLASH = "rep string, n string, doc string, id string, component string, line int, k1 string, token string, __gone string, n_lines string, ids string, bucket string"
LINE = "the quick brown fox jumps over the lazy dog near the old river bank"
PASSAGE = " ".join(f"word{k}" for k in range(70))


@pytest.fixture(scope="module")
def hostile(spark):
    """Null ids and texts, empty, wordless, very long, repeated and tied rows, and clashing columns."""
    rows = [
        (None, LINE), (None, None), (0, None), (1, ""), (2, " \n\t "), (3, LINE), (3, LINE), (4, f"{LINE}\n{LINE} x\nother words in this line"),
        (5, "a " * 60_000), (6, f"x {PASSAGE} y"), (7, PASSAGE), (8, f"Start. {PASSAGE}\n{LINE}"), (3, "another text of document three"), (9, "12 34 !!"),
    ]
    names = CLASH.count(",") + 1
    return spark.createDataFrame([(d, t, "en", *[None] * names) for d, t in rows], f"doc_id long, text string, lang string, {CLASH}")


@pytest.fixture(scope="module")
def empty(hostile):
    return hostile.where("false")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_near_dedup(hostile, empty):
    got = near_dedup.near_duplicates(hostile).collect()
    assert len(got) == hostile.count() and near_dedup.near_duplicates(empty).count() == 0
    by = {(r["doc_id"], r["n_shingles"]): r for r in got}
    assert {r["component_id"] for r in got if r["doc_id"] in (6, 7)} == {6}
    assert by[0, 0]["component_id"] == 0 and by[5, 1]["n_shingles"] == 1
    assert sum(r["doc_id"] is None for r in got) == 2 and all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)


def test_near_dedup_sends_texts_of_candidates_alone(spark, monkeypatch):
    """In a coarse group of all texts, in blocks of 8, only texts with a candidate follow their signatures, and the classes are brute force's."""
    rng = np.random.default_rng(9)
    rows = []
    for d in range(70):
        text = [f"w{k}" for k in rng.integers(0, 10**6, int(rng.integers(60, 400)))]
        if d % 7 == 6:
            text = [*rows[d - int(rng.integers(1, 6))][1].split(" "), f"end{d}"]
        rows.append((d, " ".join(text)))
    sent: list[int] = []
    keep, join = near_dedup.written, near_dedup.components

    def written(df, name, **options):
        out = keep(df, name, **options)
        sent.extend([out.count()] * (name == "outstanding"))
        return out

    everyone = spark.range(len(rows)).select("id", F.lit(0).cast("long").alias("component"))
    calls: list[int] = []
    monkeypatch.setattr(near_dedup, "written", written)
    monkeypatch.setattr(near_dedup, "components", lambda edges: [calls.append(1), everyone if len(calls) == 1 else join(edges)][1])
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in (words(t) for _, t in rows)]
    root = list(range(len(rows)))
    for b in range(len(rows)):
        for a in range(b):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                root = [root[a] if r == root[b] else r for r in root]
    assert got == dict(enumerate(root)) and len(set(root)) == 60
    assert 20 <= sum(sent) <= 60  # with signatures and texts together each text was sent once a block


def test_near_dedup_leaves_groups_that_links_join(spark, monkeypatch):
    """A large group of copies that one round connects sends no signature in the next ones."""
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in rng.integers(0, 10**6, 200)]
    rows = [(d, " ".join([*base, f"end{d}"])) for d in range(60)]
    sent: list[int] = []
    keep = near_dedup.written

    def written(df, name, **options):
        out = keep(df, name, **options)
        sent.extend([out.count()] * (name == "rooted"))
        return out

    monkeypatch.setattr(near_dedup, "written", written)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1
    assert sent == [60, 0]  # blocks apart, then one group


def test_line_dedup(hostile, empty):
    got = line_dedup.dedup_lines(hostile)
    assert set(got.columns) == {*hostile.columns, "n_lines", "n_removed"} and line_dedup.dedup_lines(empty).count() == 0
    rows = got.select("doc_id", "text", "n_lines", "n_removed").collect()
    assert len(rows) == hostile.count()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(tuple(r[1:]))
    assert by[0] == [(None, 0, 0)] and by[2] == [(" \n\t ", 1, 0)]
    assert (LINE, 1, 0) in by[None] and by[4] == [("other words in this line", 3, 2)]  # the null id comes first
    assert by[3].count(("", 1, 1)) == 2 and by[8] == [(f"Start. {PASSAGE}", 2, 1)] or by[8][0][2] == 2


def test_line_dedup_of_long_lines(spark, monkeypatch):
    """Long lines of common words: few pairs reach the full sets, in several passes too, and the result is brute force's."""
    rng = np.random.default_rng(6)
    rows = []
    for d in range(240):
        tokens = [f"w{k}" for k in rng.choice(1500, int(rng.integers(90, 400)), replace=False)]
        if d % 12 == 11:  # nearly an earlier line, on either side of 0.8
            old = rows[int(rng.integers(0, d))][1].split(" ")
            tokens = [f"n{d}x{k}" if k < len(old) * (0.05 if d % 24 == 11 else 0.15) else w for k, w in enumerate(old)]
        rows.append((d, " ".join(tokens)))
    seen: list[int] = []
    verified = line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda documents, classes, pairs: [seen.append(pairs.count()), verified(documents, classes, pairs)][1])
    monkeypatch.setattr(line_dedup, "PASS_POSTINGS", 4000, raising=False)
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [set(t.split(" ")) for _, t in rows]
    want = {d: int(any(5 * len(s & e) >= 4 * len(s | e) for e in sets[:d])) for d, s in enumerate(sets)}
    assert got == want and 0 < sum(want.values()) < 20 and sum(seen) <= 60


def test_line_pairs_meet_by_the_short_prefix(spark):
    """All pairs at 0.8, by force, are met though the smaller set has about half its postings; open ones are the later."""
    rng, sets = random.Random(6), []
    for g in range(40):
        base = [f"b{g}_{k}" for k in range(rng.randrange(4, 60))]
        for _ in range(6):
            n = round(len(base) * rng.choice([0, 0.1, 0.2]))
            sets.append(rng.sample(base, len(base) - n) + [f"x{rng.randrange(10**6)}" for _ in range(rng.choice([0, round(len(base) * 0.1)]))])
    documents = spark.createDataFrame([(d, " ".join(x)) for d, x in enumerate(sets)], "doc long, text string")
    classes = line_dedup._classes(line_dedup._lines(documents, line_dedup.token_levels(documents)))
    number = {r["doc"]: r["id"] for r in classes.select("doc", "id").collect()}
    want = {(number[y], number[x]) for y in number for x in range(y) if x in number and 5 * len(set(sets[x]) & set(sets[y])) >= 4 * len(set(sets[x]) | set(sets[y]))}
    postings = line_dedup._postings(classes.withColumn("open", F.lit(1)), 0, 1)
    assert len(want) > 100 and want <= {tuple(r) for r in line_dedup._paired(postings).collect()}
    assert line_dedup._short(postings).count() < 0.75 * postings.count()
    late = line_dedup._postings(classes.withColumn("open", F.when(F.col("id") % 2 == 0, 1).otherwise(0)), 0, 1)
    assert {p for p in want if p[0] % 2 == 0} <= {tuple(r) for r in line_dedup._paired(late).collect()}


def test_long_line_pairs_meet_in_a_compiled_join(spark):
    """All pairs of long sets at 0.8, by force, pass the sketches of quarters, few others do, and no filter is interpreted."""
    rng, sets = random.Random(7), []
    for _ in range(20):
        base = [f"w{k}" for k in rng.sample(range(1500), rng.randrange(65, 300))]
        for share in (0, 0.04, 0.1, 0.11):
            n = round(len(base) * share)
            sets.append(base[n:] + [f"x{rng.randrange(10**6)}" for _ in range(n)])
    documents = spark.createDataFrame([(d, " ".join(x)) for d, x in enumerate(sets)], "doc long, text string")
    classes = line_dedup._classes(line_dedup._lines(documents, line_dedup.token_levels(documents)))
    number = {r["doc"]: r["id"] for r in classes.select("doc", "id").collect()}
    want = {(number[y], number[x]) for y in number for x in range(y) if x in number and 5 * len(set(sets[x]) & set(sets[y])) >= 4 * len(set(sets[x]) | set(sets[y]))}
    pairs = line_dedup._paired(shared.written(line_dedup._postings(classes.withColumn("open", F.lit(1)), 0, 1), "postings"))
    got = {tuple(r) for r in pairs.collect()}
    assert len(want) > 60 and want <= got and len(got) < 2 * len(want) + 60
    assert "lambda" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_substring_dedup(hostile, empty):
    got = {r["doc_id"]: r for r in substring_dedup.repeating_documents(hostile).collect()}
    assert set(got) == {6, 7, 8} and all(r["longest_words"] >= 70 and r["class_id"] == 6 and r["links"] == 2 for r in got.values())
    assert substring_dedup.repeating_documents(empty).count() == 0 and substring_dedup.repeated_passages(empty).count() == 0


def test_substring_classes_of_copies(spark):
    """Equal texts are one passage as a whole; a passage links classes; documents apart stay apart."""
    fill = lambda c, n: " ".join(f"{c}{k}" for k in range(n))
    rows = [*((d, fill("a", 60)) for d in range(10, 20)), (3, f"{fill('a', 60)} {fill('b', 55)}"), (4, f"x {fill('b', 55)}"), (5, fill("c", 80)), (6, fill("c", 49)), (7, fill("d", 49)), (8, fill("d", 49)), (9, fill("e", 50)), (9, fill("e", 50))]
    got = {r["doc_id"]: tuple(r[1:]) for r in substring_dedup.repeating_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{d: (3, 1, 60, 1) for d in range(10, 20)}, 3: (3, 2, 60, 2), 4: (3, 1, 55, 1)}


@pytest.mark.parametrize("between", [24, 80])
def test_substring_dedup_past_holders_of_its_parts(spark, between):
    """Documents in between hold 45 of a passage's 60 words, first or last, and never the passage."""
    passage = [f"p{k}" for k in range(60)]
    held = lambda d, part: (d, " ".join([*(f"x{d}_{k}" for k in range(30)), *part, *(f"y{d}_{k}" for k in range(30))]))
    rows = [held(1, passage), *(held(d, passage[:45] if d % 2 else passage[15:]) for d in range(2, 2 + between)), held(999, passage)]
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r["doc_id"], r["other"], r["first_word"], r["words"]) for r in found} == {(1, 999, 30, 60), (999, 1, 30, 60)}


def test_substring_dedup_of_an_edited_passage_past_holders_of_its_parts(spark):
    """As above, and the last document has another word in the middle; its values are as hot, and no run of 50 words is equal."""
    passage = [f"p{k}" for k in range(60)]
    held = lambda d, part: (d, " ".join([*(f"x{d}_{k}" for k in range(30)), *part, *(f"y{d}_{k}" for k in range(30))]))
    parts = [passage[:45], passage[15:], [*passage[:30], "new", *passage[31:45]], [*passage[15:30], "new", *passage[31:]]]
    rows = [held(1, passage), *(held(d, parts[d % 4]) for d in range(2, 402)), held(999, [*passage[:30], "new", *passage[31:]])]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = substring_dedup.repeated_passages(documents).collect()
    assert {(1, 999, 30, 60), (999, 1, 30, 60)} <= {(r["doc_id"], r["other"], r["first_word"], r["words"]) for r in found}
    assert {r["doc_id"]: r["class_id"] for r in substring_dedup.repeating_documents(documents).collect() if r["doc_id"] in (1, 999)} == {1: 1, 999: 1}


def test_substring_dedup_in_passes(spark, monkeypatch):
    rng = random.Random(11)
    shared = [" ".join(f"s{k}x{rng.randrange(10**6)}" for _ in range(60)) for k in range(3)]
    rows = []
    for k in range(120):
        own = [" ".join(f"o{rng.randrange(10**6)}" for _ in range(25)) for _ in range(2)]
        part = shared[k % 3].split()
        if k % 2:
            part[rng.randrange(60)] = f"edit{k}"
        rows.append((k, f"{own[0]} {' '.join(part)} {own[1]}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, substring_dedup.repeating_documents(docs).collect()))
    tables = []
    keep = substring_dedup.written
    monkeypatch.setattr(substring_dedup, "written", lambda df, name, **o: (tables.append(name), keep(df, name, **o))[1])
    monkeypatch.setattr(substring_dedup, "PASS_PAIRS", 100)
    monkeypatch.setattr(substring_dedup, "PASS_WINDOWS", 50)
    assert sorted(map(tuple, substring_dedup.repeating_documents(docs).collect())) == whole
    assert len(whole) == 120 and len({r[1] for r in whole}) == 3
    assert tables.count("passages") > 2 and tables.count("left") > 1


def test_rows_among_ids(spark, monkeypatch):
    rows = spark.range(2000).select("id", F.col("id").cast("string").alias("text"))
    ids = rows.where("id % 100 = 7").select((F.col("id")).alias("other"))
    for marks, most in ((1 << 24, 20), (256, 400)):
        monkeypatch.setattr(shared, "MARKS", marks)
        kept = {r["id"] for r in shared.among(rows, "id", ids).collect()}
        assert kept >= set(range(7, 2000, 100)) and len(kept) <= most
    assert shared.among(rows, "id", ids.limit(0)).count() == 0


def test_token_segments(hostile, empty):
    path = P.path("byte_bpe_50k.json")
    got = token_codes.read_documents(token_codes.token_segments(hostile, path, P.PATTERN)).collect()
    assert len(got) == hostile.count() and token_codes.read_documents(token_codes.token_segments(empty, path, P.PATTERN)).count() == 0
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.cumsum([0, *[r["n_tokens"] for r in ordered]])[:-1].tolist()
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in ordered]
    assert ids == sorted(ids) and min(r["n_tokens"] for r in got) == 1


def test_media(hostile, empty):
    got = media.media_features(media.media_table(hostile), tensors=True).collect()
    assert len(got) == hostile.count() and media.media_features(media.media_table(empty)).count() == 0
    null = next(r for r in got if r["doc_id"] == 0)
    assert (null["n_bytes"], null["payload_bytes"], null["payload_sha256"]) == (0, 64, hashlib.sha256(bytes(64)).hexdigest())
    assert all(len(r["rgb"]) == r["height"] * r["width"] * 3 for r in got)
    assert len({r["feature"] for r in got if r["n_bytes"] == len(LINE)}) == 1


def test_language(hostile, empty):
    model = language_id.fit(hostile)
    got = {(r["doc_id"], r["lang_pred"]) for r in language_id.predict(hostile, model, spans=True).collect()}
    assert (0, "und") in got and (9, "und") in got and (7, "en") in got
    nothing = language_id.fit(empty)
    assert {r["lang_pred"] for r in language_id.predict(hostile, nothing).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0
    kept = language_id.keep_identified(hostile, model)
    assert kept.columns == hostile.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {None, 3, 4, 5, 6, 7, 8}


def test_decontamination(spark, hostile, empty):
    bench = spark.createDataFrame([(1, f"{PASSAGE}."), (2, None), (None, "x"), (3, "!!"), (4, PASSAGE.upper())], "item_id long, text string")
    got = decontaminate.contaminated(hostile, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(d, i) for d in (6, 7, 8) for i in (1, 4)}
    assert decontaminate.contaminated(hostile, bench.where("false")).count() == 0 and decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.keep_clean(hostile, bench).count() == hostile.count() - 3


def test_sentencepiece(hostile, empty):
    model = P.path("piece_bpe_32k.model")
    done = sentencepiece_codec.encode_checked(hostile, model)
    assert set(done.columns) == {*hostile.columns, "n_tokens", "lossless"}
    rows = done.select("text", "n_tokens", "lossless").collect()
    assert all(r["lossless"] for r in rows) and {r["n_tokens"] for r in rows if not r["text"]} == {0}
    assert sentencepiece_codec.encode_checked(empty, model).count() == 0
    marked = hostile.where("doc_id = 7").withColumn("text", F.lit("a \u2581b"))
    assert not sentencepiece_codec.encode_checked(marked, model).first()["lossless"]
    digests = sentencepiece_codec.decode_digests(sentencepiece_codec.encode_column(hostile, model), model)
    assert digests.where("lossless").count() == hostile.count()


def test_quotes_link_messages(spark):
    rows = [
        (1, 0, "user", "First thing. Second thing here!"), (1, 1, "assistant", "An answer, it is."), (1, 2, "user", "> second THING here\n>> deep quote\nI meant that."), (1, 2, "user", "> second THING here\n>> deep quote\nI meant that."),
        (1, 3, "assistant", ">  nowhere said\nyes"), (None, 0, None, None), (None, None, "user", "> First thing.\nno"), (2, 5, "user", "first thing"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, position string")
    got = {(r["conv_id"], r["turn"]): r for r in quotation.linked_messages(df).collect()}
    assert len(got) == 7
    assert got[1, 2]["answers"] == 0 and got[1, 2]["jumps"] and got[1, 2]["own"] == "I meant that."
    assert got[1, 3]["answers"] == 2 and got[1, 1]["answers"] == 0 and got[1, 0]["answers"] is None
    assert got[None, 0]["position"] == 1 and got[None, None]["position"] == 0 and got[2, 5]["answers"] is None
    chat = {r["conv_id"]: r["chat"] for r in quotation.chat_parts(quotation.linked_messages(df)).collect()}
    assert "<|user|><|answers 0|>\nI meant that.<|end|>" in chat[1] and ">" not in chat[1].replace("|>", "")
    assert quotation.chat_parts(quotation.linked_messages(df.where("false"))).count() == 0


def test_deeper_quotes_link_messages(spark):
    rows = [(1, 0, "a", "First thing."), (1, 1, "b", "Second thing."), (1, 2, "a", "Third one."), (1, 3, "b", ">> first thing\nbare"), (1, 4, "a", "> second thing\n>>> first thing\nboth"), (1, 5, "b", "> unknown\n>> Third one\nfallen")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    messages = quotation.linked_messages(df)
    got = {r["turn"]: (r["answers"], r["jumps"], [tuple(x) for x in r["sources"] or []]) for r in messages.collect()}
    assert got[3] == (0, True, [(2, 0)]) and got[4] == (1, True, [(1, 1), (3, 0)]) and got[5] == (2, True, [(2, 2)])
    assert got[2] == (1, False, [])
    assert "<|b|><|answers 0|>\nbare<|end|>" in quotation.chat_parts(messages).first()["chat"]


def test_quoted_corpus_equals_sql(spark, tmp_path):
    """Random threads in which messages quote earlier ones, to any depth, in part and in other case."""
    import random

    import duckdb

    rng = random.Random(8)
    said = ["Rain is due.", "Take the bus!", "Why not?", "It was fine; really.", "Yes.", "Bring bread, please.", "No way."]
    rows = []
    for conv in range(12):
        texts = []
        for turn in range(rng.randint(2, 14)):
            lines = []
            for _ in range(rng.randint(0, 2) if texts else 0):
                lines += [f"{'>' * rng.randint(1, 2)} {line.upper() if rng.random() < 0.3 else line}" for line in rng.choice(texts).split("\n")]
            lines.append(" ".join(rng.choices(said, k=rng.randint(1, 3))) + (f" Note {conv} {turn}." if rng.random() < 0.7 else ""))
            texts.append("\n".join(lines))
            rows.append((conv, turn, rng.choice(["user", "assistant"]), texts[-1]))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = queries.op2_quotation_linking(spark, str(tmp_path))
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES['op2_quotation_linking']})").fetchall()
    assert sorted(want) == sorted(map(tuple, got.select(columns).collect()))
    assert quotation.linked_messages(spark.read.parquet(f"{tmp_path}/conversations.parquet")).where("jumps").count() > 10


def test_intermediate_tables_are_deleted(spark):
    from pathlib import Path as Folder

    from seqengine.llm import shared

    with shared.intermediates():
        table = shared.written(spark.range(3).toDF("x"), "short")
        assert table.count() == 3
    assert not Folder(table.written_path.removeprefix("file://")).exists()


def test_long_conversations_are_placed_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(quotation, "CHUNK", 4)
    df = spark.range(30).selectExpr("1L as conv_id", "id * 2 as turn", "'user' as role", "cast(id as string) as text")
    got = quotation.linked_messages(df).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(30)) and [r["answers"] for r in got] == [None, *range(0, 58, 2)]


def test_fixity_audit(spark):
    df = spark.createDataFrame([(None, None, None, 1), (1, "u", "<p>", 1), (1, "u", "<p>", 1), *[(k, f"u{k}", "x" * k, 1) for k in range(2, 400)]], "page_id long, url string, html string, key int")
    files = warc.warc_files(df)
    one = warc.tree(files)
    assert warc.audit(one, one).count() == 0
    got = {r["page_id_a"] for r in warc.audit(one, warc.tree(warc.replicate(files, warc.flip_marked))).collect()}
    want = {k for k in [None, *range(1, 400)] if hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()[0] == "0"}
    assert got == want
    cut = warc.audit(one, warc.tree(warc.replicate(files, lambda x: x[:-10])))
    assert cut.count() == files.count()
    none = warc.tree(warc.warc_files(df.where("false")))
    assert warc.audit(none, none).count() == 0

    def second_record_gone(content):
        at = [(a, n) for a, n, _ in warc.parse(content)]
        return content[: at[1][0]] + content[at[1][0] + at[1][1] :] if len(at) > 1 else content

    gone = warc.audit(one, warc.tree(warc.replicate(files, second_record_gone))).collect()
    held = {r["page_id_a"] for r in gone if r["first_a"] is not None}
    every = [[f.get("warc-page-id") for _, _, f in warc.parse(bytes(r["content"]))] for r in files.collect()]
    assert held == {None if p == "" else int(p) for pages in every for p in pages[1:]}  # all ranges behind it moved
    grown = warc.audit(one, warc.tree(warc.replicate(files, lambda x: x + b"tail")))
    assert grown.count() == files.count()  # what follows the last record
    lost = warc.audit(one, warc.tree(files.where("part = 0 and file = 0"))).collect()
    assert len(lost) == sum(map(len, every)) - len(next(e for r, e in zip(files.collect(), every) if (r["part"], r["file"]) == (0, 0)))


@small
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(columns).collect())


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@small
def test_op1_finds_every_repeated_run(spark, texts):
    holders = defaultdict(set)
    for d, r in texts.items():
        w = words(r["text"])
        for k in range(len(w) - 49):
            holders[tuple(w[k : k + 50])].add(d)
    want = set().union(*(v for v in holders.values() if len(v) > 1), set())
    got = {r["doc_id"] for r in queries.op1_substring_dedup(spark, SMALL).collect()}
    assert want <= got


@small
def test_op4_equals_the_library(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    start, want = 0, set()
    for d in sorted(texts):
        ids = [*library.encode(texts[d]["text"] or "", add_special_tokens=False).ids, 2]
        want.add((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert {tuple(r) for r in queries.op4_token_binary(spark, SMALL).collect()} == want


@small
def test_op5_digests(spark, texts):
    for r in queries.op5_media_columns(spark, SMALL).collect():
        raw = (texts[r["doc_id"]]["text"] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


@small
def test_op7_held_out_accuracy(spark, texts):
    rows = [r for r in queries.op7_language_id(spark, SMALL).collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    assert np.mean([r["lang_pred"] == texts[r["doc_id"]]["lang"] for r in rows]) > 0.97


@small
def test_op10_finds_every_whole_item(spark, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    want = {(d, i) for d, r in texts.items() for i, t in items.items() if t in (r["text"] or "")}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op10_benchmark_decontamination(spark, SMALL).collect()}
    assert want <= got and len(got) <= len(want) + 2


@small
def test_pipeline_stages_keep_documents_without_id(hostile, spark):
    import corpus_pipeline

    docs = hostile.withColumn("n_chars", F.length("text")).unionAll(hostile.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long")).withColumn("n_chars", F.length("text")))
    lost = {"language_id": 1, "line_dedup": 1}  # of three without id, one has no text
    for name, stage in corpus_pipeline.STAGES:
        got = [r["text"] for r in stage(spark, docs, SMALL).where("doc_id is null").select("text").collect()]
        assert len(got) == 3 - lost.get(name, 0) and {LINE, PASSAGE} <= set(got)


@small
def test_pipeline_stages_by_force(spark, texts, tmp_path):
    """Each stage on its predecessor's rows: who goes, and what the texts become."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "decontaminate", "sentencepiece"]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        columns = docs.columns
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r["doc_id"]: r for r in docs.collect()}
        assert set(after) <= set(before) and (number == 4 or docs.columns == columns)
        if name == "language_id":
            assert all(not re.search(r"[^\W\d_]", before[d] or "") for d in set(before) - set(after))
        elif name == "line_dedup":
            seen = []
            for d in sorted(before):
                kept = []
                for line in before[d].split("\n"):
                    tokens = set(line.split(" ")) - {""}
                    if not tokens or not any(5 * len(tokens & s) >= 4 * len(tokens | s) for s in seen if 5 * min(len(s), len(tokens)) >= 4 * max(len(s), len(tokens))):
                        kept.append(line)
                    seen += [tokens] * bool(tokens)
                assert ("\n".join(kept).replace(" ", "").replace("\n", "") == "") == (d not in after)
                assert d not in after or (after[d]["text"] == "\n".join(kept) and after[d]["n_chars"] == len("\n".join(kept)))
        elif name == "near_dedup":
            sets = {d: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else set() for d, t in before.items()}
            root = {d: d for d in before}
            pairs = [(a, b) for a in before for b in before if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and sets[a]]
            for _ in pairs:
                for a, b in pairs:
                    root[a] = root[b] = min(root[a], root[b])
            assert set(after) == {d for d in before if root[d] == d}
        elif name == "decontaminate":
            items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            assert not any(t in r["text"] for r in after.values() for t in items)
            assert len(before) - len(after) <= sum(any(t in x for t in items) for x in before.values()) + 2
        else:
            assert set(after) == set(before) and all(r["lossless"] and r["n_tokens"] == len(r["ids"]) for r in after.values())


def test_substring_pairs_are_made_without_texts_in_their_shuffle(spark, monkeypatch):
    """Texts meet their windows before: no pass over pairs, runs apart, joins them again."""
    rng = random.Random(12)
    part = [" ".join(f"s{k}x{rng.randrange(10**6)}" for _ in range(60)) for k in range(2)]
    rows = [(k, " ".join([*(f"o{rng.randrange(10**6)}" for _ in range(25)), part[k % 2]])) for k in range(80)]
    plans: list[str] = []
    keep = substring_dedup.written
    monkeypatch.setattr(substring_dedup, "written", lambda df, name, **o: (plans.append(df._jdf.queryExecution().executedPlan().toString()) if name == "pairs" else None, keep(df, name, **o))[1])
    got = substring_dedup.repeating_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 80 and {r["class_id"] for r in got} == {0, 1}
    assert len(plans) >= 3 and not any("Join" in x for x in plans)
