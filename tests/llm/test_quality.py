import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lumenweave.llm import quality
from lumenweave.llm.ngrams import discounts

SCHEMA = "doc_id long, text string, lang string, accepted string"


def plain_trigram(sequences):
    """Interpolated modified Kneser-Ney in dictionaries over padded sequences; gives a function of (a, b, word)."""
    counts = [Counter(g for s in sequences for g in zip(s, s[1:], s[2:]))]
    for _ in range(2):
        counts.append(Counter(g[1:] for g in counts[-1]))
    levels = []
    for c in counts[::-1]:
        d = discounts([sum(n == k for n in c.values()) for k in (1, 2, 3, 4)])
        total, taken = Counter(), defaultdict(float)
        for g, n in c.items():
            total[g[:-1]] += n
            taken[g[:-1]] += d[min(n, 3) - 1]
        levels.append((c, d, total, taken))

    def p(*words):
        out = 1 / (len(levels[0][0]) + 1)
        for n, (c, d, total, taken) in enumerate(levels, 1):
            g = words[-n:]
            if total[g[:-1]]:
                out = (c[g] - d[min(c[g], 3) - 1] if c[g] else 0) / total[g[:-1]] + taken[g[:-1]] / total[g[:-1]] * out
        return out

    return p


def plain_tokens(text):
    """(token, shape) pairs, by a pattern."""
    out, last, run = [], None, 0
    for x in re.findall(r"[A-Za-z\x80-\U0010ffff]+|[0-9]+|[^A-Za-z0-9\x80-\U0010ffff \t-\r]+", text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in x)
        ups, size = sum("A" <= c <= "Z" for c in x), len(x.encode())
        shape = "digits" if x[0].isdigit() and x.isascii() else "marks" if not x[0].isalpha() and x[0].isascii() else "upper" if ups > 1 and 2 * ups > size else "title" if "A" <= x[0] <= "Z" else "lower"
        run = run + 1 if low == last else 0
        last = low
        again = None if not run else "chant" if run >= quality.CHANT else "again"
        out.append((f"<{again}>",) * 2 if again else (low.upper() if shape == "upper" else low, f"<{shape}>"))
    return out


def test_whole_classifier_matches_plain_one(spark, monkeypatch):
    monkeypatch.setattr(quality, "ENOUGH", 5)
    r = random.Random(4)
    words = "ab cd ef gh ij Kl MN 12 345 x7 é ü, -- ...".split()
    text = lambda: " ".join(r.choice(words) if r.random() < 0.8 else r.choice(["zz", f"q{r.randint(0, 99)}w", "ab ab ab ab ab ab ab ab"]) for _ in range(r.randint(0, 40)))
    docs = [(i, text(), r.choice(["en", "en", "de", None])) for i in range(200)] + [(300, None, "en"), (301, "", "xx"), (7, "ab again", "en"), (None, "ab", "de"), (302, "AB cd " * 4000, "en")]
    labels = [(i, int(i % 3 > 0)) for i in range(150)] + [(302, 1), (None, 1)]
    most = 60
    table = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, lang string, own_text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.classify(table, marks, most=most).collect()

    ids = spark.createDataFrame([(i,) for i, q in labels if q and i is not None], "i long").distinct().selectExpr("i", "xxhash64(i) h", "pmod(xxhash64(i, 1), 5) fifth").collect()
    learnt = {x.i for x in sorted(ids, key=lambda x: (x.h, x.i))[:most] if x.fifth}
    trusted = {x.i for x in ids}
    cut = {k: plain_tokens(t or "") for k, (_, t, _) in enumerate(docs)}
    train = [k for k, d in enumerate(docs) if d[0] in learnt]
    times = Counter(w for k in train for w, _ in cut[k])
    folded = {k: ["<s>", "<s>", *(w if times[w] >= quality.RARE else shape for w, shape in x), "</s>"] for k, x in cut.items()}
    p = plain_trigram([folded[k] for k in train])
    perplexity = {k: 10 ** (-sum(math.log10(p(*x[i - 2 : i + 1])) for i in range(2, len(x))) / (len(x) - 2)) for k, x in folded.items()}
    held = defaultdict(list)
    for k, (i, _, lang) in enumerate(docs):
        if i in trusted and i not in learnt:
            for name in (lang or "", "every"):
                held[name].append(perplexity[k])
    limit = {n: float(np.quantile(x, quality.QUANTILE)) * quality.STRETCH for n, x in held.items() if n == "every" or len(x) >= quality.ENOUGH}
    assert {"en", "de", ""} <= set(limit)
    want = sorted((d[0] or -1, d[1] or "", perplexity[k], limit.get(d[2] or "", limit["every"])) for k, d in enumerate(docs))
    rows = sorted((x.doc_id or -1, x.text or "", x.perplexity, x.accepted) for x in got)
    assert [x[:2] for x in rows] == [x[:2] for x in want]
    for x, w in zip(rows, want):
        assert x[2] == pytest.approx(w[2], rel=1e-9)
        assert x[3] == (w[2] <= w[3]) or abs(w[2] / w[3] - 1) < 1e-3
    assert 0 < sum(x[3] for x in rows) < len(rows)


def prose(r, n):
    """Words of which none follows itself."""
    words, out = ["the", "of", "river", "stone", "bridge", "walks", "under", "a", "quiet", "and"], [""]
    while len(out) <= n:
        out.append(r.choice([w for w in words if w != out[-1]]))
    return " ".join(w + r.choice(["", "", "", ",", "."]) for w in out[1:])


def test_junk_goes_and_clean_text_stays(spark):
    r = random.Random(2)
    docs = [(i, prose(r, 80), "en" if i % 2 else "de") for i in range(600)]
    junk = [" ".join(w + "&&&" for w in prose(r, 60).split()), prose(r, 60).upper().replace(" ", "!! "), "stone " * 100, "| x7 | q9 | zz |" * 20]
    docs += [(1000 + i, j, "en") for i, j in enumerate(junk)] + [(2000, None, None), (2001, "", "xx"), (0, docs[0][1], "de")]
    labels = spark.createDataFrame([(i, 1) for i in range(500)] + [(1000, 0), (None, 1), (1, 1)], "doc_id long, quality int")
    got = quality.classify(spark.createDataFrame([(*d, "z") for d in docs], SCHEMA), labels)
    assert got.columns == ["doc_id", "text", "lang", "perplexity", "accepted"]
    rows = got.collect()
    assert len(rows) == len(docs)
    assert not any(x.accepted for x in rows if 1000 <= x.doc_id < 2000)
    assert sum(x.accepted for x in rows if 500 <= x.doc_id < 600) >= 97


def test_no_labels_and_no_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "some text", "en", "")], SCHEMA)
    assert [x.accepted for x in quality.classify(docs, labels).collect()] == [True]
    assert quality.classify(docs.limit(0), labels).count() == 0
