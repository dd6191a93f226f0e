import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from basketry.llm import lmscore

SCORED, LEARNED, DELETED = lmscore.SCORED, lmscore.LEARNED, lmscore.DELETED


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w] + [""]


def direct(rows):
    """Counts, base scores, and scores by weights fitted on unrounded estimates."""
    pairs = [(list(zip([None, *w[:-1]], w)), role) for w, role in ((tokens(t), r) for _, t, r in rows)]

    def counted(roles):
        chosen = [p for p, r in pairs if r in roles]
        words, both = Counter(x for p in chosen for _, x in p), Counter(x for p in chosen for x in p)
        words[None] = len(chosen)
        return words, both, sum(len(p) for p in chosen)
    words, both, n = counted((LEARNED, DELETED))
    v, uniform = len(words) - 1, 1 / len(words)
    lw, lb, ln = counted((LEARNED,))

    def parts(h, x, words, both, n):
        return words[h], (both[h, x] / words[h] if words[h] else 0.0), words[x] / max(n, 1)

    def klass(c):
        return 0 if not c else 1 + int(math.log2(c))
    events = Counter()
    for p, role in pairs:
        for h, x in p if role == DELETED else ():
            c, a, b = parts(h, x, lw, lb, ln)
            events[klass(c), a, b] += 1

    def fitted(events, w):
        p = np.array([(a, b, uniform) for _, a, b in events])
        m = np.array(list(events.values()), float)
        for _ in range(lmscore.ROUNDS):
            s = p * w
            s /= s.sum(axis=1, keepdims=True)
            w = np.maximum((s * m[:, None]).sum(axis=0) / m.sum(), 1e-6)
            w /= w.sum()
        return w
    general = fitted(events, np.array(lmscore.START)) if events else np.array(lmscore.START)
    weights = {k: fitted({e: m for e, m in events.items() if e[0] == k}, general) for k in {e[0] for e in events}}
    out = []
    for p, _ in pairs:
        base = sum(math.log10((words[x] + 1) / (n + v + 1)) for _, x in p)
        score = 0.0
        for h, x in p:
            c, a, b = parts(h, x, words, both, n)
            w = weights.get(klass(c), general)
            score += math.log10(w[0] * a + w[1] * b + w[2] * uniform)
        out.append((len(p), sum(words[x] > 0 for _, x in p), n, base, score))
    return out


@pytest.mark.parametrize("batch, span", [(300, 100), (10 ** 6, 10 ** 6)])
def test_against_direct_counts(spark, monkeypatch, batch, span):
    monkeypatch.setattr(lmscore, "BATCH", batch)
    monkeypatch.setattr(lmscore, "RANGE", span)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()]
    rows = [(i, t, [SCORED, LEARNED, LEARNED, DELETED][zlib.crc32(str(i).encode()) % 4]) for i, t in enumerate(texts)]
    rows += [(100, None, LEARNED), (101, "", SCORED), (101, "", SCORED), (None, "The the\x0bTHE é", SCORED), (102, " \n", DELETED)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, text string, role int, score string")
    got = sorted((r.id is None, r.id or 0, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lmscore.score(df).collect())
    want = sorted((r[0] is None, r[0] or 0, *d) for r, d in zip(rows, direct(rows)))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    # weights are learned from estimates rounded to a quarter of a power of two
    assert np.allclose([g[6] for g in got], [w[6] for w in want], rtol=0.02, atol=0.05)


def test_without_deleted_or_learned(spark):
    df = spark.createDataFrame([(1, "a b", SCORED), (2, "a", LEARNED)], "id long, text string, role int")
    got = {r.id: r for r in lmscore.score(df).collect()}
    assert got[1].n_known == 2 and got[1].train_tokens == 2
    assert np.isclose(got[2].base_score, 2 * math.log10(2 / 5))
    only = lmscore.score(df.filter("id = 1")).first()
    assert only.n_known == 0 and only.train_tokens == 0 and only.score < 0
    assert lmscore.score(df.limit(0)).count() == 0


def test_model_beats_the_base(spark):
    from basketry.llm import queries

    rows = queries.QUERIES["op3_lm_score"](spark, "/root/testdata/sf0.01").filter("held_out").collect()
    assert sum(r.score for r in rows) > 0.95 * sum(r.base_score for r in rows)
