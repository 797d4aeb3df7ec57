import random

import public_tokenizers
from tokenizers import Tokenizer

from lumenweave.llm import tokencount as tc

PATH = public_tokenizers.path(tc.VOCABULARY)
PARTS = ["word", " ", "  ", "\n", "\n\n", "\t", "\x1c", "\x85", " ", " ", "　", "​", "'s", "don't", "123", "É", "漢字", "🙂", "é", "<|endoftext|>", "%%%", "x" * 30, "\r\n", " a", "!"]


def reference(texts):
    t = Tokenizer.from_file(PATH)
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def random_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_cut_is_exact():
    texts = random_texts(3000, 1)
    count = tc.counter(PATH)
    assert [sum(count(tc.pretokens(t))) for t in texts] == reference(texts)
    assert all("".join(tc.pretokens(t)) == t for t in texts)


def test_matches_library(spark):
    texts = [None, "", " ", "same text", "same text", "word " * 2000, "y" * 5000] + random_texts(200, 2)
    rows = [(None if i == 3 else i // 2, t, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block long")
    want = sorted(((d if d is not None else -1), len((t or "").encode()), n, n > 512) for (d, t, _), n in zip(rows, reference(texts)))
    for size in (tc.BLOCK, 300):
        got = tc.token_counts(docs, PATH, block=size).collect()
        assert sorted(((r.doc_id if r.doc_id is not None else -1), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert tc.token_counts(docs.limit(0), PATH).count() == 0


def test_sample_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: r.n_tokens for r in tc.token_counts(docs, PATH).collect()}
    assert got == dict(zip([r.doc_id for r in rows], reference([r.text for r in rows])))
