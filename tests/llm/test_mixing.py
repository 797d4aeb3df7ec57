import random

import numpy as np
import pytest

from lumenweave.llm import mixing

SCHEMA = "doc_id long, text string, source string, lang string, topic string, kept string"


def rows_of(n, seed):
    r = random.Random(seed)
    return [(i, "w " * r.randint(0, 60), r.choice("aaaaab"), r.choice(["en", "en", "de", None]), r.choice("xyz"), "?") for i in range(n)]


def plain(rows, targets, power, budget):
    """By dictionaries: shares raked in turn, then probabilities by bisection."""
    cells = {}
    for _, text, s, la, t, _ in rows:
        k = (s or "", la or "", t or "")
        cells[k] = cells.get(k, 0) + len((text or "").split()) + 1
    total = sum(cells.values())
    goals = []
    for i, m in enumerate(mixing.MARGINS):
        have = {}
        for k, n in cells.items():
            have[k[i]] = have.get(k[i], 0) + n
        given = targets.get(m, {})
        left, others = max(0, 1 - sum(given.values())), sum(n**power for v, n in have.items() if v not in given)
        raw = {v: given[v] if v in given else left * n**power / others for v, n in have.items()}
        goals.append({v: x / sum(raw.values()) for v, x in raw.items()})
    share = {k: n / total for k, n in cells.items()}
    for _ in range(mixing.ROUNDS):
        for i, goal in enumerate(goals):
            now = {}
            for k, x in share.items():
                now[k[i]] = now.get(k[i], 0) + x
            share = {k: x * goal[k[i]] / now[k[i]] if now[k[i]] else 0 for k, x in share.items()}
    low, high = 0.0, 1e9
    for _ in range(200):
        s = (low + high) / 2
        if sum(min(1, s * share[k] / n) * n for k, n in cells.items()) < budget * total:
            low = s
        else:
            high = s
    return {k: min(1, high * share[k] / n) for k, n in cells.items()}


@pytest.mark.parametrize("most", [mixing.MOST_CELLS, 2])
@pytest.mark.parametrize("targets", [{}, {"lang": {"de": 3, "en": 1, "": 1}, "source": {"a": 1, "b": 1}}, {"lang": {"de": 0.5, "not there": 0.2}, "topic": {"x": 0.1}}])
def test_probabilities(spark, monkeypatch, most, targets):
    monkeypatch.setattr(mixing, "MOST_CELLS", most)
    if most == 2:
        monkeypatch.setattr(mixing, "ROUNDS", 6)
    rows = rows_of(300, 1) + [(None, None, None, None, None, "?"), (5, "w", "a", "en", "x", "?")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df, targets or None, budget=0.4).collect()
    assert len(got) == len(rows)
    want = plain(rows, targets, mixing.POWER, 0.4)
    for r in got:
        assert r.probability == pytest.approx(want[r.mix_source, r.mix_lang, r.mix_topic], rel=1e-4, abs=1e-6)


def test_sample_meets_budget_and_repeats(spark):
    rows = rows_of(4000, 2)
    df = spark.createDataFrame(rows + rows[:50], SCHEMA).drop("topic")
    a = mixing.mix(df).collect()
    kept = sum(r.mix_tokens for r in a if r.kept) / sum(r.mix_tokens for r in a)
    assert abs(kept - mixing.BUDGET) < 0.03
    fate = {}
    for r in a:
        assert fate.setdefault(r.doc_id, r.kept) == r.kept
    assert mixing.mix(df.limit(0)).count() == 0


def test_full_cells():
    share, tokens = np.array([0.6, 0.3, 0.1, 0.0]), np.array([10.0, 100.0, 100.0, 50.0])
    p = mixing.calibrated(share, tokens, 70.0)
    assert p[0] == 1 and p[3] == 0 and (p * tokens).sum() == pytest.approx(70)
    assert p[1] * tokens[1] / (p[2] * tokens[2]) == pytest.approx(3)
    assert mixing.calibrated(share, tokens, 1e6).tolist() == [1, 1, 1, 0]


def test_topics_by_form(spark):
    texts = {"| a | b | c | d |": "table", "Under the MIT License": "license", "a@b.org": "contact", "few words": "short", "w " * 400: "prose", "w " * 4000: "long", None: "short"}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.text: (r.mix_topic, r.mix_source, r.mix_lang) for r in mixing.mix(docs).collect()}
    assert got == {t: (x, "", "") for t, x in texts.items()}
