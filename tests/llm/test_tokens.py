import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from basketry.llm import packing, tokens
from basketry.llm.common import tokenizer_path

ODD = ["", " ", "a", " a", "a ", "a  b", "a\n\nb", "a \n b", "\na\n", "x y z　 w", "it's don't I'LL we've", "a\tb \tc\t d",
       "<|endoftext|> a b", "a <|endoftext|>b", "123 4 56  7", "é é ΣΑΣ Σ", "a\x1cb \x1d c", "日本 語 x",
       "a\r\nb \r\n c", " ́x y", "\x85a\xa0 b\xa0c \x1f \x1c", "½ ²3 ªº µ×÷ß İI", "word " * 3000, "x" * 5000]
FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@pytest.mark.parametrize("name", FILES)
def test_encoder_gives_the_tokenizers_ids(name):
    path, rand = tokenizer_path(name), random.Random(5)
    plain, own = Tokenizer.from_file(path), tokens.Encoder(path)
    assert own.pattern is not None
    for top in (256, 0x3000):
        ODD.extend("".join(rand.choice([chr(rand.randrange(top)), *" \n'abstm"]) for _ in range(50)) for _ in range(500))
    for text in ODD:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    own.pattern = None  # the way for other tokenizers
    for text in ODD:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def expected(rows, path, end):
    plain, out, start = Tokenizer.from_file(path), [], 0
    for key, text in rows:
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [end], "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_files_come_back(spark, tmp_path):
    path = tokenizer_path(FILES[0])
    rows = [(i, t) for i, t in enumerate(ODD[:24])] + [(50, None), (51, "again"), (51, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "doc_id", "'x' AS id", "1 AS part")
    folder = f"file://{tmp_path}/ids"
    tokens.write_ids(docs, path, 2, folder, partitions=3)
    from pyspark.sql import functions as F

    got = tokens.read_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids"))
    assert sorted(map(tuple, got.collect())) == sorted(expected(rows, path, 2))
    one = tokens.read_ids(spark, folder, only=7).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
    assert [tuple(r) for r in one] == [x for x in expected(rows, path, 2) if x[0] == 7]
    assert tokens.read_ids(spark, folder, only=999).count() == 0


def test_no_documents(spark, tmp_path):
    folder = f"file://{tmp_path}/ids"
    tokens.write_ids(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path(FILES[0]), 2, folder)
    assert tokens.read_ids(spark, folder).count() == 0


def test_pieces(spark):
    path = tokenizer_path(FILES[1])
    rows = [(0, "word " * 25), (1, None), (2, ""), (3, "a b c"), (3, "a b c")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, length int")
    got = packing.pieces(docs, path, 1, length=10).orderBy("doc_id", "piece").collect()
    assert [(r.doc_id, r.piece, r.start, r.length) for r in got] == [
        (0, 0, 0, 10), (0, 1, 10, 10), (0, 2, 20, 6), (1, 0, 0, 1), (2, 0, 0, 1), (3, 0, 0, 4), (3, 0, 0, 4)]
    assert all(len(r.ids) == 2 * r.length for r in got)
