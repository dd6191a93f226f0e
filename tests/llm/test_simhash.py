import random
import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from basketry.llm import simhash


def plain_print(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]
    if not words:
        return 0
    hashes = [xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_groups(prints, k):
    """For each place the smallest place it is connected with."""
    values, parent = np.array(prints, np.uint64), list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= k):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


TEXTS = ["", None, " \t\n ", "one", "ONE", "one two", "one\x0btwo  three", "a b c d e f g", "a b c d e f g " * 4000,
         "é É ünïcode", "x\xa0y z w", "same " * 30]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) % 2 ** 64 == plain_print(text)


def test_groups_of_documents(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(100, "same " * 30, "y"), (100, "same " * 30, "y"), (None, "one", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string")
    got = sorted(((r.doc_id, r.fingerprint % 2 ** 64, r.component_id) for r in simhash.group(docs).collect()), key=str)
    prints = [plain_print(r[1]) for r in rows]
    roots = plain_groups(prints, 2)
    least = {}
    for r, root in zip(rows, roots):
        least[root] = min([x for x in (least.get(root), r[0]) if x is not None], default=None)
    assert got == sorted(((r[0], p, least[root]) for r, p, root in zip(rows, prints, roots)), key=str)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))
    assert simhash.one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("k, crowd", [(1, 3), (2, 3), (2, 30), (2, 4096), (3, 4096)])
def test_links_lose_nothing(spark, k, crowd):
    rand, prints = random.Random(k), []
    base = [rand.getrandbits(64) for _ in range(30)]
    for _ in range(400):
        p = rand.choice(base)
        for _ in range(rand.choice([0, 0, 1, 1, 2, 3])):
            p ^= 1 << rand.randrange(64)
        prints.append(p)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in set(prints)], "fingerprint long")
    found = {r.node % 2 ** 64: r.root % 2 ** 64 for r in simhash.components(simhash.links(df, k, crowd)).collect()}
    want = plain_groups(prints, k)
    mine = [found.get(p, p) for p in prints]
    assert [[a == b for b in mine] for a in mine[:60]] == [[a == b for b in want] for a in want[:60]]
    assert len(set(mine)) == len(set(want))


def test_crowded_runs_over_batches():
    """A bucket that spans Arrow batches is found whole, whatever the cuts."""
    import pyarrow as pa

    keys = np.repeat(np.arange(5), [1, 7, 40, 2, 1])
    prints = np.arange(len(keys)).astype(np.int64) * 0 + np.arange(len(keys))
    for size in (1, 3, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i:i + size]), pa.array(prints[i:i + size])], names=["k", "f"])
                   for i in range(0, len(keys), size)]
        rows = [(a, b) for out in simhash._bucket_links(64, 10)(iter(batches)) for a, b in zip(*[c.to_pylist() for c in out.columns])]
        assert {a for a, b in rows if b is None} == set(range(8, 48))
        joined = {x for a, b in rows if b is not None for x in (a, b)}
        assert joined == set(range(1, 8)) | {48, 49}
