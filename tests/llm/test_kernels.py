"""Kernels against brute force, exact round trips and properties; no Spark."""

import random
import re
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from seqengine.llm import decontaminate, language_id, media, near_dedup, quotation, sentencepiece_codec, shared, substring_dedup, token_codes, warc, wordhash

P = pytest.importorskip("public_tokenizers")
TEXTS = ["", " ", "a  b", "Der Hund, the dog!", "x" * 5000, "é ß 你好 \x00 tab\tnew\nline", " lead and trail ", "don't we'll 1st ½", "a b  c"]


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_words_are_runs_between_blanks():
    rows = [*TEXTS, None, "The THE the"]
    word, begin, end, at = wordhash.words(pa.array(rows, pa.string()))
    seen = {}
    for i, text in enumerate(rows):
        want = plain_words(text or "")
        assert at[i + 1] - at[i] == len(want)
        for h, w in zip(word[at[i] : at[i + 1]].tolist(), want):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_words_of_slices_and_empty_columns():
    column = pa.array(["a b", "c", "d e f"], pa.string())
    assert np.array_equal(wordhash.words(column.slice(1))[0], wordhash.words(pa.array(["c", "d e f"], pa.string()))[0])
    assert len(wordhash.words(pa.array([], pa.string()))[0]) == 0


def test_pieces_of_a_text_change_no_word(monkeypatch):
    column = pa.array(["one two  three", None, "", "a" * 50, "x " * 30, "end", "ab" * 9 + " " + "c" * 40])
    want = wordhash.words(column)
    for size in (1, 3, 8, 17):
        monkeypatch.setattr(wordhash, "PIECE", size)
        assert all((a == b).all() for a, b in zip(wordhash.words(column), want))


def test_short_sequences_are_one_shingle():
    word = wordhash.words(pa.array(["a b c d"], pa.string()))[0]
    assert len(wordhash.shingles(word, 3)) == 2 and len(wordhash.shingles(word[:2], 3)) == 1 and len(wordhash.shingles(word[:0], 3)) == 0
    assert wordhash.shingles(word[:2], 3)[0] not in wordhash.shingles(word, 3)


def test_batches_keep_rows():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["x" * 10, None, "y" * 100, "z"])})
    parts = list(wordhash.batches(iter([batch]), limit=12))
    assert pa.Table.from_batches(parts).column(0).to_pylist() == batch.column(0).to_pylist() and len(parts) > 1


def test_forest_spans_the_links_of_brute_force():
    rng = random.Random(0)
    sets = [np.array(sorted(rng.sample(range(30), rng.randint(1, 25))), np.uint64) for _ in range(40)]
    sets += [sets[0], np.append(sets[1], np.uint64(99))]
    for split in (None, 20):
        found = near_dedup.jaccard_forest(np.arange(len(sets)), sets, 60, np.stack([near_dedup.signature(x) for x in sets]), split)
        links = {(i, j) for i, j in product(range(len(sets)), repeat=2) if i < j and (split is None or (i < split) != (j < split)) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))}

        def classes(edges):
            root = list(range(len(sets)))
            for _ in sets:
                for a, b in edges:
                    root[a] = root[b] = min(root[a], root[b])
            return root

        assert classes(found) == classes(links) and len(found) < len(sets)


def test_collisions_are_counted_per_pair():
    rng = np.random.default_rng(3)
    signatures = rng.integers(0, 3, (20, near_dedup.COORDINATES)).astype(np.uint32)
    want = (signatures[:, None, :] == signatures[None, :, :]).sum(axis=2)
    np.fill_diagonal(want, 0)
    assert (near_dedup.collisions(signatures) == want).all()


def test_collisions_of_near_copies_are_not_added_pair_by_pair(monkeypatch):
    rng = np.random.default_rng(6)
    signatures = np.tile(rng.integers(0, 1 << 32, near_dedup.COORDINATES, dtype=np.uint32), (300, 1))
    changed = rng.random(signatures.shape) < np.linspace(0, 1, near_dedup.COORDINATES)
    signatures[changed] = rng.integers(0, 1 << 32, int(changed.sum()), dtype=np.uint32)
    listed = []
    keep = np.concatenate
    monkeypatch.setattr(near_dedup.np, "concatenate", lambda parts, *rest: [listed.append(sum(map(len, parts))), keep(parts, *rest)][1])
    monkeypatch.setattr(near_dedup.np, "add", None)  # nothing is added at single places
    got = near_dedup.collisions(signatures)
    expected = (signatures[:, None, :] == signatures[None, :, :]).sum(axis=2)
    np.fill_diagonal(expected, 0)
    assert np.array_equal(got, expected)
    assert sum(listed) < 300 * 300  # of near a million equal pairs


def test_match_count_rarely_misses():
    assert near_dedup.matches_for(85) > near_dedup.matches_for(80) > 20


@pytest.mark.parametrize("n,least", [(10, 3), (200, 46), (46, 46), (45, 46), (90, 1)])
def test_compact_windows_are_the_cartesian_tree(n, least):
    value = np.random.default_rng(n).integers(0, 1 << 62, n, dtype=np.uint64)
    want = set()

    def grow(a, b):
        if b - a + 1 >= least:
            m = a + int(np.argmin(value[a : b + 1]))
            want.add((a, m, b))
            grow(a, m - 1)
            grow(m + 1, b)

    grow(0, n - 1)
    assert set(zip(*map(np.ndarray.tolist, substring_dedup.compact_windows(value, least)))) == want


def test_interval_join_counts_different_functions():
    f, left, right = (np.array(x) for x in ([0, 0, 1, 2], [0, 5, 3, 8], [9, 20, 12, 30]))
    want = [x for x in range(40) if len({k for k, a, b in zip(f, left, right) if a <= x <= b}) >= 3]
    got = [x for a, b in substring_dedup.covered(f, left, right, 3) for x in range(a, b + 1)]
    assert got == want


def shingled(text):
    return wordhash.shingles(wordhash.words(pa.array([text], pa.string()))[0], 5)


def test_equal_runs_are_those_of_brute_force():
    rng = random.Random(1)
    texts = ["a " * 60, "a b " * 40, *(" ".join(rng.choices("ab", k=40)) for _ in range(6)), " ".join(f"w{k}" for k in range(12)) + " x " + " ".join(f"w{k}" for k in range(12))]
    for x, y in product(texts, repeat=2):
        a, b = shingled(x).tolist(), shingled(y).tolist()
        want = set()
        for i, j in product(range(len(b)), range(len(a))):
            if b[i] == a[j] and (i == 0 or j == 0 or b[i - 1] != a[j - 1]):
                n = next((k for k in range(min(len(b) - i, len(a) - j)) if b[i + k] != a[j + k]), min(len(b) - i, len(a) - j))
                want |= {(i, j, n)} if n >= 7 else set()
        assert set(map(tuple, substring_dedup.equal_runs(shingled(x), shingled(y), 7).tolist())) == want


def whole_windows(text):
    """Packed windows of three functions that cover a text."""
    return np.array([f | (len(text) - 1) << 31 for f in range(3)], np.int64)


def test_a_phrase_that_stands_earlier_breaks_no_passage():
    passage = [f"p{k}" for k in range(60)]
    fill = lambda c, n: [f"{c}{k}" for k in range(n)]
    one = shingled(" ".join([*fill("a", 30), *passage[26:34], *fill("b", 40), *passage, *fill("c", 30)]))
    two = shingled(" ".join([*fill("d", 20), *passage, *fill("e", 20)]))
    assert substring_dedup.passages(one, two, whole_windows(two), 46) == [(20, 56, 78, 56)]
    assert substring_dedup.passages(two, one, whole_windows(one), 46) == [(78, 56, 20, 56)]


@pytest.mark.parametrize("length,inserted", [(90, 6), (90, 10), (60, 3), (100, 12), (100, 40), (300, 50)])
def test_inserted_clauses_within_the_similarity(length, inserted):
    """A clause in the middle of a passage, held against the similarity of the whole passages by force."""
    passage = [f"p{k}" for k in range(length)]
    fill = lambda c, n: [f"{c}{k}" for k in range(n)]
    longer = [*passage[: length // 2], *fill("new", inserted), *passage[length // 2 :]]
    x, y = set(zip(*(passage[k:] for k in range(5)))), set(zip(*(longer[k:] for k in range(5))))
    alike = len(x & y) >= 0.8 * len(x | y)
    one, two = shingled(" ".join([*fill("a", 40), *passage, *fill("b", 40)])), shingled(" ".join([*fill("c", 30), *longer, *fill("d", 30)]))
    whole = (30, length + inserted - 4, 40, length - 4)
    assert (whole in substring_dedup.passages(one, two, whole_windows(two), 46)) == alike
    assert ((40, length - 4, 30, length + inserted - 4) in substring_dedup.passages(two, one, whole_windows(one), 46)) == alike


def test_packed_postings_come_back_and_are_small():
    rng = np.random.default_rng(3)
    rows = np.zeros(500, substring_dedup._POSTING)
    rows["token"], rows["doc"] = rng.integers(0, 1 << 63, 500), np.sort(rng.integers(0, 50, 500)) + (7 << 33)
    rows["l"], rows["m"], rows["r"] = np.sort(rng.integers(0, 900, (3, 500)), axis=0)
    batch = substring_dedup._dealt(4, rows["token"], rows, rows[:3], rows[:0])
    table = pa.Table.from_batches([batch])
    back = substring_dedup._unpacked(table, "postings", substring_dedup._POSTING)
    assert np.array_equal(np.sort(back), np.sort(rows))
    assert np.array_equal(substring_dedup._unpacked(table, "pairs", substring_dedup._POSTING), rows[:3])
    assert len(substring_dedup._unpacked(table, "hot", substring_dedup._POSTING)) == 0
    assert sum(len(x) for x in batch.column(1).to_pylist()) < 0.6 * rows.nbytes


def test_runs_of_single_shingles_are_the_equal_runs():
    rng = random.Random(4)
    for _ in range(40):
        a = np.array(rng.sample(range(30), 20))
        b = np.array([rng.choice([int(x), 40 + k]) for k, x in enumerate(np.roll(a, rng.randrange(20)))] + [int(a[3])])
        there = np.array([int(np.flatnonzero(a == x)[0]) if x in a else -1 for x in b])
        want = substring_dedup.equal_runs(a.astype(np.uint64), b.astype(np.uint64), 4)
        assert sorted(substring_dedup._single_runs(a, there, 4).tolist()) == sorted(want.tolist())
    assert substring_dedup._single_runs(np.array([1, 2, 1]), np.array([0, -1]), 1) is None


def test_forms_with_a_passage_are_hopeful():
    """Pairs of forms in which verification finds a passage, with edits, parts in another order, wide gaps and repeats."""
    rng, found = random.Random(5), 0
    for _ in range(60):
        base, forms = rng.sample(range(1, 900), 200), []
        for _ in range(8):
            at, one = rng.randrange(90), []
            part = base[at : at + rng.randrange(46, 120)]
            if rng.random() < 0.4:
                cut = rng.randrange(len(part))
                part = part[cut:] + part[:cut]
            if rng.random() < 0.2:
                part = part[:20] + part
            edits = rng.choice([0, 0.01, 0.03, 0.1])
            for x in part:
                if rng.random() < edits:
                    one += [rng.choice([0, rng.randrange(900, 950)])] * rng.choice([1, 5, 5, 90])
                one += [x] * (rng.random() >= edits / 2)
            forms.append(np.array(one))
        sets = [np.unique(x[x > 0]) for x in forms]
        table = substring_dedup._Forms(forms, sets, 1000)
        for x, y in product(range(8), repeat=2):
            a, b = substring_dedup._as_text(forms[x], 0), substring_dedup._as_text(forms[y], 1)
            if substring_dedup.verified(a, b, [(0, len(b) - 1)], 46):
                found += 1
                assert len(table.hopeful(x, np.array([y]), 46))
    assert found > 1000


def test_forms_of_a_template_are_told_apart_without_verifying_each_pair(monkeypatch):
    """80 filled forms share 26 words of each 36, which is no passage; fillings stand in two forms, in other slots; two forms are alike."""
    slot = lambda d, k: f"{d // 2}_{(k // 36 + d % 2) % 5}_{k % 36}"
    contexts = [shingled(" ".join(f"t{k}" if k % 36 < 26 else slot(d, k) for k in range(180))) for d in range(80)]
    contexts.append(np.concatenate([contexts[7], shingled("another end than its")]))
    calls, verified = [], substring_dedup.verified
    monkeypatch.setattr(substring_dedup, "verified", lambda *x: calls.append(1) or verified(*x))
    n = len(contexts)
    assert substring_dedup.linked_contexts(np.arange(n), -1 - np.arange(n), contexts, 46) == [(7, 80)]
    assert len(calls) < 100


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 65535, 65536, 2**32 - 1], list(range(3000))])
def test_dac_reads_all_and_one(ids):
    reader = token_codes.DacReader(token_codes.dac_encode(np.array(ids, np.uint32)))
    assert reader.all().tolist() == ids and [reader[i] for i in range(len(ids))] == ids
    with pytest.raises(IndexError):
        reader[len(ids)]


def test_each_different_chunk_is_looked_up_once(monkeypatch):
    from tokenizers import Tokenizer

    path, asked = P.path("byte_bpe_50k.json"), []

    class Counted(token_codes.Aging):
        def __getitem__(self, key):
            asked.append(key)
            return super().__getitem__(key)

    monkeypatch.setattr(token_codes, "GATHER", 7, raising=False)
    encoder = token_codes.ChunkEncoder(path, P.PATTERN, 2)
    encoder.later = Counted(100, lambda c: encoder._chunk(" ", c))
    rng, many = random.Random(4), ["the", "dog,", "é", "x\ty", "你好", "don't", "1st"]
    texts = [" ".join(rng.choices(many, k=k)) for k in (0, 1, 2, 3, 50, 400)] + ["alone", "", "a b"]
    codes = encoder.encode(texts)
    library = Tokenizer.from_file(path)
    assert [np.frombuffer(c, "<u4").tolist() for c in codes] == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert sorted(asked) == sorted([*many, "b"])


def test_chunks_encode_as_the_library():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [*TEXTS, "a \n b", "\n\n x", "  z", "a.b,c! d", "​ a", "İ ﬁ. ǅ,", "tail  x", "\x85 y"]
    encoder = token_codes.ChunkEncoder(path, P.PATTERN, 2)
    for text, code in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(code, "<u4").tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]


def test_added_tokens_encode_as_the_library():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y", "<|endoftext", "no marker"]
    for text, code in zip(texts, token_codes.ChunkEncoder(path, P.PATTERN, 2).encode(texts)):
        assert np.frombuffer(code, "<u4").tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]


def test_small_caches_change_nothing():
    words = [f"w{k % 7}" for k in range(60)]
    cache = token_codes.Aging(3, lambda w: w.encode())
    assert [cache[w] for w in words] == [w.encode() for w in words] and len(cache) <= 3


@pytest.mark.parametrize("n", [64, 128, 384, 64 * 77])
def test_media_payloads_round_trip(n, monkeypatch):
    payload = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    image = media.decode(media.encode(payload))
    assert media.payload_of(image, n) == payload
    monkeypatch.setattr(media, "_scan_fast", lambda *a: False)
    slow = media.decode(media.encode(payload))
    assert all((a.blocks == b.blocks).all() for a, b in zip(image.components, slow.components))


def test_media_rejects_other_data():
    for data in (b"", b"GIF89a", b"\xff\xd8\xff\xd9"):
        with pytest.raises(ValueError):
            media.decode(data)
    with pytest.raises(ValueError):
        media.encode(b"x" * 63)


def test_grey_pixels_equal_the_cosine_sum():
    image = media.Image()
    image.width = image.height = 8
    image.quantise[0] = np.arange(1, 65)
    c = media.Component(1, 1, 0)
    c.row, c.blocks = 1, np.random.default_rng(0).integers(-3, 4, (1, 64)).astype(np.int16)
    image.components = [c]
    coefficients = np.zeros((8, 8))
    for k, at in enumerate(media.ZIGZAG):
        coefficients[at // 8, at % 8] = c.blocks[0, k] * (k + 1)
    scale = lambda u: np.sqrt(1 / 8) if u == 0 else 0.5
    want = [[128 + sum(scale(u) * scale(v) * coefficients[u, v] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) for y in range(8)] for x in range(8)]
    assert np.abs(media.pixels(image)[..., 0] - np.clip(want, 0, 255)).max() <= 0.51


def test_chroma_is_upsampled():
    rgb = media.pixels(media.decode(media.encode(bytes(384))))
    assert rgb.shape == (16, 16, 3) and rgb.dtype == np.uint8


def viterbi_by_force(scores, switch):
    n, k = scores.shape
    return max((sum(scores[t, p[t]] for t in range(n)) - switch * sum(a != b for a, b in zip(p, p[1:])), p) for p in product(range(k), repeat=n))[0]


def test_language_viterbi_is_best():
    rng = np.random.default_rng(0)
    many = [rng.integers(-9, 1, (n, 3)).astype(np.float32) for n in (0, 1, 5, 6, 2, 6)]
    for scores, path in zip(many, language_id.viterbi([m.copy() for m in many], 4.0)):
        assert len(path) == len(scores)
        if len(path):
            got = sum(scores[t, p] for t, p in enumerate(path)) - 4.0 * (np.diff(path) != 0).sum()
            assert got == pytest.approx(viterbi_by_force(scores, 4.0))


def test_numeric_characters_are_no_letters():
    assert language_id.letter_runs("½ ²³ Ⅷ ① x² straße 12 a_b") == ["x", "straße", "a", "b"]


def test_many_languages_keep_their_numbers():
    scores = np.full((3, 200), -5.0, np.float32)
    scores[:, 130] = 0
    assert [x.tolist() for x in language_id.viterbi([scores], 6.0)] == [[130, 130, 130]]


def test_small_language_caches_change_nothing(monkeypatch):
    model = language_id.Model.fit([("en", "the river and the house"), ("de", "der Fluss und das Haus")])
    texts = ["the river", "das Haus und the river", "Fluss Fluss", ""]
    want = language_id._judge(language_id.Labeller(model), texts)
    monkeypatch.setattr(language_id, "CACHE_BYTES", 1)
    labeller = language_id.Labeller(model)
    assert [language_id._judge(labeller, [t]) for t in texts] == [([a], [b]) for a, b in zip(*want)]


def test_languages_spans_and_scripts():
    rows = [("en", "the dog and the cat with that house"), ("de", "der hund und die katze mit dem haus"), ("ru", "собака и кошка")] * 3
    labeller = language_id.Labeller(language_id.Model.fit(rows))
    names = labeller.model.languages
    texts = ["the dog and the cat der hund und die katze", "кошка", "12 ... !", ""]
    paths = labeller.paths(texts)
    assert [s["lang"] for s in language_id._spans(paths[0][0], paths[0][2], names)] == ["en", "de"]
    pred, score = language_id._judge(labeller, [*texts, None])
    assert pred[1:] == ["ru", "und", "und", "und"] and score[1:] == [1.0, 0.0, 0.0, 0.0]
    assert language_id._judge(language_id.Labeller(language_id.Model.fit([])), ["a"]) == (["und"], [0.0])
    assert language_id.script_of("кот") == "cyrillic" and language_id.script_of("é") == "latin"


def best_by_force(text, scores, unknown):
    best = {0: 0}
    for end in range(1, len(text) + 1):
        options = [best[s] + scores[text[s:end]] for s in range(end) if text[s:end] in scores]
        if text[end - 1] not in scores:
            options.append(best[end - 1] + unknown)
        best[end] = max(options)
    return best[len(text)]


def test_sentencepiece_viterbi_is_best():
    pieces = [("▁", -9, 1), ("a", -3, 2), ("b", -4, 3), ("ab", -5, 4), ("▁a", -6, 5), ("aba", -9, 6), ("cb", -7, 7)]
    codec = sentencepiece_codec.Codec(pieces, list(range(100, 356)))
    scores = {p: s for p, s, _ in pieces}
    value = {i: s for _, s, i in pieces}
    for word in map("".join, product("abc", repeat=5)):
        text = "▁" + word
        ids = codec.viterbi(text)
        assert codec.decode(ids) == word
        got = sum(value.get(i, codec.unknown) for i in ids)
        assert got == best_by_force(text, scores, codec.unknown)


def test_sentencepiece_decodes_what_it_encodes():
    codec = sentencepiece_codec.Codec.load(P.path("piece_bpe_32k.model"))
    for text in TEXTS:
        assert codec.decode(codec.encode(text).tolist()) == text
    assert codec.decode(codec.encode("a▁b").tolist()) == "a b"
    whole = codec.viterbi("▁" + "the dog  and\nthe cat".replace(" ", "▁"))
    assert codec.encode("the dog  and\nthe cat").tolist() == whole


def test_sentencepiece_score_is_not_below_the_librarys():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    raw = open(path, "rb").read()
    at = raw.rindex(b"\x18\x02 \x80\xfa\x01")  # the model type in the trainer's part: 2 is BPE, 1 unigram
    library = sentencepiece.SentencePieceProcessor(model_proto=raw[: at + 1] + b"\x01" + raw[at + 2 :])
    codec = sentencepiece_codec.Codec.load(path)
    score = lambda ids: sum(library.get_score(int(i)) for i in ids)
    words = "the house and unbelievable Straße naïve recursion contributions wonderfully".split()
    assert all(score(codec.encode(w)) >= score(library.encode(w)) for w in words)
    assert sum(codec.encode(w).tolist() == library.encode(w) for w in words) >= len(words) - 2


def items():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(60)]
    return [(i, " ".join(rng.choices(vocabulary, k=rng.randint(8, 25))).capitalize() + ". " + " ".join(rng.choices(vocabulary, k=4)) + ".") for i in range(40)], vocabulary


def test_wand_finds_what_scoring_all_finds():
    rows, vocabulary = items()
    index = decontaminate.Index(rows)
    rng = random.Random(4)
    for least in (0.2, 0.5, 0.9):
        for _ in range(30):
            words = wordhash.words(pa.array([" ".join(rng.choices(vocabulary, k=40))]), wordhash.PLAIN)[0]
            terms = np.unique(index.lookup(words)[1])
            score = np.zeros(len(rows))
            for t in terms:
                a, b = index.at[t], index.at[t + 1]
                score[index.items[a:b]] += index.impacts[a:b]
            got = dict(x for block in range(index.blocks) for x in index.wand(terms, block, least))
            assert set(got) == set(np.flatnonzero(score >= least - 1e-9)) and all(got[i] == pytest.approx(score[i]) for i in got)


def test_block_bounds_lose_no_copy():
    rows, vocabulary = items()
    index = decontaminate.Index(rows)
    rng = random.Random(5)
    texts, want = [], []
    for k in range(60):
        pad = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 90))) for _ in range(2)]
        texts.append(f"{pad[0]} {rows[k % 40][1].upper() if k % 3 else rows[k % 40][1]} {pad[1]}" if k % 2 else pad[0])
        want.append({k % 40} if k % 2 else set())
    word, _, _, at = wordhash.words(pa.array(texts), wordhash.PLAIN)
    found = index.matches(word, at)
    for r in range(60):
        assert want[r] <= {i for row, i in found if row == r}
        if not want[r]:
            assert not {i for row, i in found if row == r}


def test_parts_and_small_bounds_change_nothing(monkeypatch):
    rows, vocabulary = items()
    rng = random.Random(6)
    texts = [" ".join(rng.choices(vocabulary, k=60)) + " " + rows[k % 40][1] for k in range(30)]
    word, _, _, at = wordhash.words(pa.array(texts), wordhash.PLAIN)
    all_items = decontaminate.Statistics()
    for k in range(0, 40, 7):
        all_items.add([t for _, t in rows[k : k + 7]])
    whole = {(r, i): x for r, i, x in decontaminate._matches([decontaminate.Index(rows, all_items, 64)], word, at)}
    monkeypatch.setattr(decontaminate, "CELLS", 5)
    parts = {(r, i): x for k in range(0, 40, 9) for r, i, x in decontaminate._matches([decontaminate.Index(rows[k : k + 9], all_items, 64)], word, at)}
    assert len(whole) >= 30 and set(parts) == set(whole) and all(parts[k] == pytest.approx(whole[k]) for k in whole)


def test_items_split_into_question_and_answer():
    assert decontaminate.split_item("What is it? A dog.") == ("What is it?", "A dog.")
    assert decontaminate.split_item("One only") == ("One only", "One only")
    assert decontaminate.Index([]).matches(*(wordhash.words(pa.array(["a"]))[k] for k in (0, 3))) == {}


def test_warc_records_parse_back():
    rows = [(1, "http://a/\r\nb", "<p>é</p>\r\n\r\nWARC/1.0"), (None, None, None), (2, "u", "")]
    content = b"".join(warc.record_bytes(*r) for r in rows)
    parsed = list(warc.parse(content))
    assert [f["warc-page-id"] for *_, f in parsed] == ["1", "", "2"]
    assert sum(size for _, size, _ in parsed) == len(content)
    assert list(warc.parse(b"")) == [] and sum(s for _, s, _ in warc.parse(content[:-30])) == len(content) - 30


def test_a_task_leaves_no_words_in_its_worker():
    path = P.path("piece_bpe_32k.model")
    codec = sentencepiece_codec.Codec.load(path)
    batch = pa.RecordBatch.from_pydict({"text": ["words of a task", None, ""]})
    rows = pa.Table.from_batches(shared.freeing(sentencepiece_codec._checked(path))(iter([batch]))).to_pylist()
    assert [(r["text"], r["n_tokens"] > 0, r["lossless"]) for r in rows] == [("words of a task", True, True), (None, False, True), ("", False, True)]
    assert not codec.known


def test_language_scores_are_learned_in_pieces():
    import tracemalloc

    model = language_id.Model.fit([("en", "the words of a text"), ("de", "die Worte eines Textes")])
    tokens = {f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}word{chr(97 + k // 676 % 26)}{chr(97 + k // 17576)}" for k in range(120_000)} | {"1", "a-b"}
    labeller = language_id.Labeller(model)
    tracemalloc.start()
    labeller._learn(tokens)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 << 20
    some = sorted(tokens)[::997] + ["1", "a-b"]
    alone = language_id.Labeller(model)
    for t in some:
        alone._learn({t})
    assert all((labeller.scores[labeller.known[t]] == alone.scores[alone.known[t]]).all() and labeller.letters[labeller.known[t]] == alone.letters[alone.known[t]] for t in some)


def test_units_are_a_row_a_document_and_windows_are_cut_to_those_marked():
    rng = np.random.default_rng(5)
    windows = []
    for k in range(60):
        hot = np.zeros(300, substring_dedup._HOT)
        hot["token"], hot["l"] = rng.integers(0, 400, 300), np.arange(300)
        hot["m"], hot["r"] = hot["l"] + 5, hot["l"] + 60
        windows.append([hot[:100].tobytes(), hot[100:].tobytes()])
    first, count, component = [[100] if k % 3 else None for k in range(60)], [[54] if k % 3 else None for k in range(60)], [7 if k % 3 else None for k in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array(windows, pa.list_(pa.binary())), pa.array(first, pa.list_(pa.int32())), pa.array(count, pa.list_(pa.int32())), pa.array(component, pa.int64())], list("abcde"))
    units = list(substring_dedup._units(iter([batch])))
    assert sum(x.num_rows for x in units) == 60  # a row a document, however many windows it has
    want = []
    for k in range(60):
        for token, left, m, r in np.frombuffer(b"".join(windows[k]), substring_dedup._HOT).tolist():
            want.append((k, token, left, m, r, 7 if k % 3 and 100 <= m < 150 else -1 - k))
    small = pytest.MonkeyPatch()
    small.setattr(substring_dedup, "UNITS", 1000)  # some documents at a time
    try:
        sides: dict[int, tuple[int, int, int]] = {}
        for part in substring_dedup._sides(iter(units)):
            for token, low, high, n in zip(*(c.to_pylist() for c in part.columns)):
                was = sides.get(token, (low, high, 0))
                sides[token] = (min(low, was[0]), max(high, was[1]), n + was[2])
        mine = lambda t: [w for w in want if w[1] == t]
        assert sides == {t: (min(w[5] for w in mine(t)), max(w[5] for w in mine(t)), len(mine(t))) for t in {w[1] for w in want}}
        marks = np.zeros(substring_dedup.MARKS >> 6, np.int64)
        for t in (3, 63, 64, 300):
            marks[t >> 6] |= np.array([1 << (t & 63)], np.uint64).view(np.int64)[0]
        got = [row for part in substring_dedup._marked(marks)(iter(units)) for row in zip(*(c.to_pylist() for c in part.columns))]
    finally:
        small.undo()
    assert sorted(got) == sorted(w for w in want if w[1] in (3, 63, 64, 300))


def test_contexts_of_all_passes_are_those_of_one_however_documents_are_dealt():
    """Each window comes in one pass alone, with the shingles around its minimum by force, and equal ones stand under the smallest node."""
    rng = random.Random(8)
    common = [f"c{k}" for k in range(300)]
    texts = [" ".join([f"o{d}x{k}" for k in range(rng.randrange(40))] + common) for d in range(12)]
    item = [wordhash.shingles(wordhash.words(pa.array([t]))[0], 5) for t in texts]
    windows, want = [], set()
    for d in range(12):
        begin = len(item[d]) - 296
        rows = [{"token": 8 * t + 1, "l": begin + 10 * t, "m": begin + 10 * t + 20, "r": begin + 10 * t + 100, "unit": 3 if t % 2 else -1 - d} for t in range(15)]
        rows.append({"token": 999, "l": 0, "m": begin + 150, "r": len(item[d]) - 1, "unit": -1 - d})
        windows.append(rows)
        for w in rows:
            want.add((w["token"], 0 if w["unit"] == 3 else d, w["unit"], item[d][max(w["l"], w["m"] - 150) : min(w["r"], w["m"] + 150) + 1].tobytes()))
    kind = pa.list_(pa.struct([("token", pa.int64()), ("l", pa.int32()), ("m", pa.int32()), ("r", pa.int32()), ("unit", pa.int64())]))
    for order in (list(range(12)), list(range(12))[::-1]):
        batch = pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), pa.array([texts[d] for d in order]), pa.array([windows[d] for d in order], kind)], ["node", "text", "windows"])
        got = [[row for part in substring_dedup._contexts(50, k, 3)(iter([batch])) for row in zip(*(c.to_pylist() for c in part.columns))] for k in range(3)]
        assert sorted(x for part in got for x in part) == sorted(want)
        assert all(part for part in got) and not {x[0] for x in got[0]} & {x[0] for x in got[1]}
