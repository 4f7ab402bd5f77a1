"""Beyond the n-grams that are broadcast, op9 and the pipeline's first stage score by the models of all n-grams."""

import random

import numpy as np
import pytest

import corpus_pipeline
from sectorflow.llm import quality


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    vocabulary = {x: ["".join(r.choice("abcdefghijklmnoprstuvwz") for _ in range(r.randrange(2, 9))) for _ in range(150)] for x in ("en", "de", None)}
    line = lambda x, n: " ".join(r.choice(vocabulary[x]) for _ in range(n))
    rows = [(line(x, r.randrange(50, 200)), x) for x in vocabulary for _ in range(40)]
    rows += [("".join(chr(r.randrange(33, 900)) for _ in range(700)), "en"), ("fail " * 300, "de"), (line("en", 9), "de"), ("", "en"), (None, "en"), ("too short", "xx"), (line("en", 3), None)]
    rows += [(" ".join("".join(chr(r.randrange(33, 126)) for _ in range(6)) for _ in range(90)), "de"), (line("de", 90) + " " + line("en", 90), "en")]
    return spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id long, text string, lang string").repartition(3).cache()


@pytest.mark.parametrize("most", [3000, 3])
def test_verdicts_are_those_of_whole_models(docs, monkeypatch, most):
    columns = ["doc_id", "_q_score", "_q_base_failed", "_q_kept", *(f"_q_{k}" for k in quality.FIELDS)]
    whole = quality.judge(docs, ["doc_id", "text"]).select(*columns).orderBy("doc_id").collect()
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda *a: fit(*a, most=most))
    monkeypatch.setattr(quality, "PART", 2000, raising=False)
    assert quality.judge(docs, ["doc_id", "text"]).select(*columns).orderBy("doc_id").collect() == whole
    assert sum(x["_q_score"] is not None for x in whole) > 120 and 0 < sum(x["_q_kept"] for x in whole) < 129


def test_asked_n_grams_have_the_probabilities_of_whole_models(docs, monkeypatch):
    monkeypatch.setattr(quality, "PART", 2000, raising=False)
    whole, cut = quality.fit(docs), quality.fit(docs, most=600)
    r = np.random.default_rng(4)
    for name in ("en", "de", None):
        seen = whole[name][1].levels[-1][0]
        codes = np.unique(np.r_[seen[::7], r.integers(0, 1 << quality.GRAM_BITS, 200), seen[::9] ^ (r.integers(1, 255, len(seen[::9])) << 32), seen[::11] ^ 1])
        asked = docs.sparkSession.createDataFrame([(name, int(c)) for c in codes], "lang string, gram long")
        got = {x["gram"]: (x["short"], x["long"]) for x in cut.ask(asked).collect()}
        want = np.c_[whole[name][0].log_p(codes & (1 << 8 * quality.SHORTER) - 1), whole[name][1].log_p(codes)]
        assert np.allclose([got[int(c)] for c in codes], want, rtol=1e-12, atol=0)


def test_the_pipeline_keeps_what_whole_models_keep(docs, monkeypatch):
    r = random.Random(8)
    mixed = [(900 + i, "".join(r.sample(x["text"], len(x["text"]))), "en") for i, x in enumerate(docs.where("lang = 'en' and doc_id < 4").collect())]
    more = docs.union(docs.sparkSession.createDataFrame(mixed, docs.schema))  # the letters of kept texts in any order
    run = lambda: sorted(tuple(x) for x in corpus_pipeline.quality_rules(docs.sparkSession, more, "").collect())
    whole, fit = run(), quality.fit
    monkeypatch.setattr(quality, "fit", lambda *a: fit(*a, most=3))
    assert run() == whole and 0 < len(whole) < 129 and len(mixed) == 4 and max(x[0] for x in whole) < 900
