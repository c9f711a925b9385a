"""Shuffles that once moved every row of a large table."""
import math
from collections import Counter

import pytest

ROWS = [(1, ["a", "b", "a", "the"]), (2, ["the", "b", "c", None]), (3, []), (4, None), (5, ["the"]), (6, ["Ä", "a", "ä", ""])]


def _plain(rows):
    docs = {}
    for k, ws in rows:
        docs.setdefault(k, Counter()).update(w for w in ws or [] if w is not None)
    df = Counter(w for d in docs.values() for w in d)
    out = {}
    for k, d in docs.items():
        ws = {w: n * (math.log((1 + len(docs)) / (1 + df[w])) + 1) for w, n in d.items()}
        norm = math.sqrt(sum(x * x for x in ws.values()))
        out.update({(k, w): round(x / norm, 9) for w, x in ws.items()})
    return out


@pytest.mark.parametrize("more", [[], [(1, ["b", "x"]), (None, ["the"]), (None, ["q", "the"]), (5, ["the", "the"])]])
@pytest.mark.parametrize("common", [0, 2, 1 << 16])
def test_tfidf_of_common_and_rare_terms(spark, monkeypatch, more, common):
    from lexikon.operators import models as M
    monkeypatch.setattr(M, "COMMON_TERMS", common)
    df = spark.createDataFrame(ROWS + more, "k int, words array<string>")
    found = M.tfidf(df, "k", "words").collect()
    assert len(found) == len({(r["k"], r["term"]) for r in found})
    assert {(r["k"], r["term"]): round(r["weight"], 9) for r in found} == _plain(ROWS + more)


def test_tfidf_counts_terms_without_a_shuffle_and_moves_no_common_term_to_its_frequency(spark):
    from lexikon.operators import models as M
    df = spark.createDataFrame(ROWS, "k int, words array<string>")
    assert "Exchange" not in M._term_counts(df, "k", "words")._jdf.queryExecution().executedPlan().toString()
    out = M.tfidf(df, "k", "words")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan and "isnull(df" in plan
    assert plan.count("RepartitionByExpression") == 1
