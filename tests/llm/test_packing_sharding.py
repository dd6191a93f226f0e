import zlib
from collections import Counter

import numpy as np
import pytest

from basketry.llm import packing, queries, sharding


@pytest.mark.parametrize("select", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [(100, 100, 10_000), (100, 4, 10_000), (100, 100, 3_000)])
def test_best_fit_keeps_every_capacity(select, capacity):
    lengths = np.random.default_rng(1).integers(1, 60, 500)
    lengths[:3] = 100
    sequence, offset = packing.best_fit(lengths, capacity, (1.0, 0.2, 0.2), select)
    for s in range(sequence.max() + 1):
        mine = np.flatnonzero(sequence == s)
        mine = mine[np.argsort(offset[mine])]
        assert (offset[mine] == np.cumsum(lengths[mine]) - lengths[mine]).all()
        assert len(mine) == 1 or (lengths[mine].sum() <= capacity[0] and len(mine) <= capacity[1]
                                  and (lengths[mine] ** 2).sum() <= capacity[2])
    if capacity == (100, 100, 10_000):
        assert sequence.max() + 1 <= 1.03 * lengths.sum() / 100 + 1


def test_pack_places_every_row(spark):
    rows = [(i % 90, int(n)) for i, n in enumerate(np.random.default_rng(2).integers(1, 4097, 300))] + [(None, 7), (None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, length long")
    got = packing.pack(df, group=60).collect()
    assert Counter((r.doc_id, r.length) for r in got) == Counter(rows)
    ends = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 4096
    assert packing.pack(df.limit(0)).count() == 0


@pytest.mark.parametrize("n, shards, block", [(1000, 40, 100), (7, 10, 3), (0, 4, 10), (500, 3, 1000)])
def test_shards_have_exact_sizes(spark, n, shards, block):
    rows = [(None if i % 3 == 0 else i, "same" if i % 3 == 0 else str(i), 1) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int")
    got = sharding.shuffle(df, shards, block).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(r[:2] for r in rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r["_slot"])
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_matrix_sums_and_mean():
    made = np.array([sharding.matrix([30, 50, 20], [40, 25, 35], seed) for seed in range(400)])
    assert (made.sum(axis=2) == [30, 50, 20]).all() and (made.sum(axis=1) == [40, 25, 35]).all()
    assert np.abs(made.mean(axis=0) - np.outer([30, 50, 20], [40, 25, 35]) / 100).max() < 0.6


def test_hypergeometric_beyond_numpy():
    drawn = [sharding.hypergeometric(6 * 10 ** 9, 4 * 10 ** 9, 1000, np.random.default_rng(i)) for i in range(2000)]
    assert abs(np.mean(drawn) - 600) < 2 and abs(np.std(drawn) - 15.5) < 1.2


def test_places_are_uniform(spark):
    """Rows of one source are spread over shards and slots like any others."""
    df = spark.range(4000).selectExpr("id AS doc_id", "if(id < 1300, 'hot', 'x') AS source")
    got = [(r.shard, r.slot) for r in sharding.shuffle(df, 4, 500).collect() if r.source == "hot"]
    by_shard = Counter(s for s, _ in got)
    assert all(abs(v - 325) < 80 for v in by_shard.values())
    assert abs(np.mean([slot for _, slot in got]) - 499.5) < 40


def test_shards_are_written_with_their_texts(spark, tmp_path, monkeypatch):
    """Folders hold every document, whole and in the order of slots, and the digests are theirs."""
    rows = [(i if i % 7 else None, f"text {i} " * (1 + 3000 * (i == 5)) if i % 11 else None, "hot") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(sharding, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    got = queries.op8_shard(spark, str(tmp_path)).collect()
    kept = spark.read.parquet(f"{tmp_path}/shards").collect()
    assert Counter((r.doc_id, r.text, r.source) for r in kept) == Counter(rows)
    assert Counter(r.shard for r in kept) == {s: 8 if s < 20 else 7 for s in range(40)}
    for folder in tmp_path.glob("shards/shard=*"):
        slots = [r.slot for r in spark.read.parquet(str(folder)).collect()]
        assert slots == list(range(len(slots)))
    told = Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got)
    assert told == Counter((r.doc_id, len(r.text or "") + 16, zlib.crc32((r.text or "").encode()), r.shard, r.slot)
                           for r in kept)


def test_sequences_are_written_with_their_ids(spark):
    """Every document's ids stand in the sequences, equal rows and nulls too, and the limits bind."""
    rows = [(i % 50 or None, f"word {i % 5} and more " * (1 + i % 40)) for i in range(200)] + [(7, None)] * 3
    rows += [(8, "the same long text " * 3000)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = queries.tokenizer_path("word_bpe_49k.json")
    made = packing.pack_documents(docs, path, 1, most=5, cost=4096 ** 2 // 2)
    kept = made.collect()
    for s in kept:
        sizes = [p.length for p in s.placed]
        assert [p.offset for p in s.placed] == [sum(sizes[:i]) for i in range(len(sizes))]
        assert s.width == 2 and len(s.ids) == 2 * sum(sizes) <= 2 * 4096 and len(sizes) <= 5
        assert len(sizes) == 1 or sum(n * n for n in sizes) <= 4096 ** 2 // 2
    found = Counter((p.doc_id, p.piece, p.start, bytes(s.ids[2 * p.offset:2 * (p.offset + p.length)]))
                    for s in kept for p in s.placed)
    cut = Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in packing.pieces(docs, path, 1).collect())
    assert found == cut
    told = Counter((r.doc_id, r.piece, r.start, r.ids_crc32) for r in packing.placements(made).collect())
    assert told == Counter({(d, p, s, zlib.crc32(np.frombuffer(i, "<u2").astype("<u4"))): n
                            for (d, p, s, i), n in cut.items()})


def test_documents_are_cut_as_the_tokenizer_says(spark):
    """Against ids taken straight from the tokenizer, for ids of other types and names too; no rows give no rows."""
    path = queries.tokenizer_path("word_bpe_49k.json")
    encode = packing.encoder(path).tokenizer.encode
    rows = [("a", "one two three " * 3000, 1), ("b", None, 2), (None, "", 3), ("c", "short", 4)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, place int")
    want = []
    for key, text, _ in rows:
        ids = [*encode(text or "", add_special_tokens=False).ids, 1]
        want += [(key, k, start, len(ids[start:start + 4096]), zlib.crc32(np.array(ids[start:start + 4096], "<u4")))
                 for k, start in enumerate(range(0, len(ids), 4096))]
    got = packing.placements(packing.pack_documents(docs, path, 1)).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)
    assert packing.placements(packing.pack_documents(docs.limit(0), path, 1)).collect() == []


def test_best_fit_against_plain_lists():
    """The same choices as a loop over lists of open sequences, by the smallest norm of what is left."""
    rand = np.random.default_rng(5)
    for capacity in ((50, 4, 900), (50, 50, 2500)):
        lengths, weights = rand.integers(1, 51, 120), (1.0, 0.3, 0.2)
        bins = []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            need = np.array([lengths[i], 1, lengths[i] ** 2])
            fits = [b for b in bins if (b["room"] >= need).all()]
            rest = [sum((w * x / c) ** 2 for w, x, c in zip(weights, b["room"] - need, capacity)) for b in fits]
            chosen = fits[int(np.argmin(rest))] if fits else {"room": np.array(capacity), "has": []}
            if not fits:
                bins.append(chosen)
            chosen["room"] = chosen["room"] - need
            chosen["has"].append(int(lengths[i]))
        sequence, _ = packing.best_fit(lengths, capacity, weights)
        made = [sorted(lengths[sequence == s].tolist()) for s in range(sequence.max() + 1)]
        assert sorted(made) == sorted(sorted(b["has"]) for b in bins)
