"""Encoding and decoding against the sentencepiece library, for the given vocabulary and for small ones built here."""

import hashlib
import random
import struct

import pytest

from lumenweave.llm import pieces

sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path(pieces.VOCABULARY)
PARTS = [" ", "  ", "▁", "a", "the", "ing", "\n", "\t", "é", "世", "𝄞", "\x00", "<s>", "</s>", "<unk>", "<0x41>", "xxxxx", "1", "ﬁ", "​", "🙂", "é", "q" * 40, " " * 70]


def number(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def model(entries, prefix=1, squeeze=0, fallback=0, kind=2):
    """A model file of (piece, score, type)."""
    block = lambda n, data: number(n << 3 | 2) + number(len(data)) + data
    out = b""
    for p, s, t in entries:
        out += block(1, block(1, p.encode()) + number(2 << 3 | 5) + struct.pack("<f", s) + number(3 << 3) + number(t))
    integers = lambda x: b"".join(number(n << 3) + number(v) for n, v in x.items())
    return out + block(2, integers({3: kind, 35: fallback})) + block(3, block(1, b"identity") + integers({3: prefix, 4: squeeze, 5: 1}))


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def agree(own, library, texts):
    ids = library.encode(texts, add_bos=True, add_eos=True)
    assert own.encode(texts, True, True) == [packed(x) for x in ids]
    own.words.clear()
    assert [own.encode([t], True, True)[0] for t in texts[:200]] == [packed(x) for x in ids[:200]]
    assert [own.decode(packed(x)) for x in ids] == library.decode(ids)
    return ids


def random_texts(seed, parts=PARTS, n=3000):
    r = random.Random(seed)
    return ["", " ", "  ", " x", "x ", "\n", *("".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(n))]


def test_random_texts_with_the_given_vocabulary():
    agree(pieces.loaded(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH), random_texts(1))


def test_heap_and_rows_give_the_same():
    own = pieces.loaded(PATH)
    words = list({w for t in random_texts(2) for w in own.cut.findall(own.normal(t))})
    assert own.learn(words) == {w: packed(own.ids(w)) for w in words}


def test_long_words_and_texts():
    own, library = pieces.loaded(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    r = random.Random(3)
    agree(own, library, ["".join(r.choice("aeinrst") for _ in range(50_000)), "ab " * 30_000, "世" * 5000, " " * 5000])
    assert not any(len(w) > pieces.SHORT for w in own.words)


def test_any_ids_decode_as_in_the_library():
    own, library = pieces.loaded(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    r = random.Random(4)
    rows = [[r.choice([r.randrange(32000), r.randrange(3), r.randrange(3, 259), 259]) for _ in range(r.randint(0, 12))] for _ in range(5000)]
    assert [own.decode(packed(x)) for x in rows] == library.decode(rows)


LETTERS = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *((c, -50.0 - i, 1) for i, c in enumerate("▁abc"))]


@pytest.mark.parametrize("more", [
    [("ab", -1.0, 1), ("bc", -1.0, 1), ("abc", -0.5, 1), ("▁a", -3.0, 1), ("cc", -2.0, 1)],  # ties, a merge better than its parts
    [("ab", -1.0, 5), ("abc", -2.0, 1), ("▁ab", -4.0, 5), ("▁abc", -5.0, 1)],  # pieces that are not to be used
    [("a b", -1.0, 4), ("ab", -2.0, 1), ("cab", 0.0, 4), ("b▁c", -3.0, 1)],  # symbols of the user, a piece across words
    [("zy", -1.0, 1), ("zyx", -2.0, 1), ("xz", -3.0, 1)],  # characters that are parts of pieces only
])
@pytest.mark.parametrize("prefix,squeeze", [(1, 0), (0, 0), (1, 1)])
def test_small_vocabularies(more, prefix, squeeze):
    data = model(LETTERS + more, prefix, squeeze)
    texts = random_texts(5, ["a", "b", "c", " ", "ab", "abc", "z", "y", "x", "?", "é"], 1500)
    agree(pieces.vocabulary(data), sentencepiece.SentencePieceProcessor(model_proto=data), texts)


def test_other_models_are_an_error():
    with pytest.raises(ValueError):
        pieces.vocabulary(model(LETTERS, kind=1))


def rows_of(spark, texts, extra=""):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' as ids", "1 as decoded", "true as same_ids")


@pytest.mark.parametrize("check", ["words", "texts", None])
def test_tables(spark, check):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [None, "", "one two", "one two", " leading  and trailing ", "世界 🙂\n", "the " * 20_000]
    rows = pieces.decoded(pieces.encoded(rows_of(spark, texts), PATH, check=check), PATH, check=True)
    got = {r.doc_id: r for r in rows.collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert bytes(got[i].ids) == packed(ids) and got[i].decoded == library.decode(ids) == (t or "") and got[i].same_text
        assert check is None or got[i].same_ids


def test_empty_repeated_and_null(spark):
    assert not pieces.decoded(pieces.encoded(rows_of(spark, ["a"]).limit(0), PATH), PATH).collect()
    rows = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    got = pieces.encoded(rows, PATH).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "None"] and len({bytes(r.ids) for r in got}) == 1
    assert pieces.decoded(spark.createDataFrame([(1, None)], "k int, ids binary"), PATH).collect()[0].decoded is None


def test_a_word_that_differs_is_told(spark, monkeypatch):
    own = pieces.loaded(PATH)
    own.words.clear()
    honest = pieces.Vocabulary.learn
    monkeypatch.setattr(pieces.Vocabulary, "learn", lambda self, words: {w: packed([5]) if w == "▁wrong" else x for w, x in honest(self, words).items()})
    import pyarrow as pa

    for _ in range(2):  # not kept from one batch to the next
        out = next(pieces._encoded(PATH, True, True, "words", [pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["is wrong", "is right"]})]))
        assert out.column("same_ids").to_pylist() == [False, True]
    own.words.clear()


def test_query(spark):
    from lumenweave.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op13_pieces"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.agrees
        assert r.ids_sha256 == hashlib.sha256(packed(ids)).hexdigest() and r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
