import random

import numpy as np
import pytest

from lumenweave.llm import quality


def test_quantiles_of_all_trusted_texts_not_learnt_from(spark):
    r = random.Random(6)
    words = {"en": "the river of stone walks under a bridge".split(), "fr": "la pierre du pont sous un fleuve calme".split()}
    docs = [(i, " ".join(r.choice(words["fr" if i % 10 == 0 else "en"]) for _ in range(r.choice([40, 400]))), "fr" if i % 10 == 0 else "en") for i in range(800)]
    labels = spark.createDataFrame([(i, int(i < 700)) for i in range(800)], "doc_id long, quality int")
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    _, _, learnt = quality.train(table, labels, 100)
    own = {x.own_id for x in learnt.collect()}
    assert own and len(own) <= 100
    got = {x.doc_id: x for x in quality.classify(table, labels, most=100).collect()}
    for lang in ("en", "fr"):
        values = [got[i].perplexity for i, _, k in docs[:700] if k == lang and i not in own]
        assert len(values) >= quality.ENOUGH
        limit = float(np.quantile(values, quality.QUANTILE)) * quality.STRETCH
        found = quality.thresholds(spark.createDataFrame([(x.doc_id, x.lang, x.perplexity) for x in got.values()], "doc_id long, lang string, perplexity double"), labels, learnt)
        assert found[lang] == pytest.approx(limit, rel=1e-3)
        assert all(x.accepted == (x.perplexity <= found[lang]) for x in got.values() if x.lang == lang)
