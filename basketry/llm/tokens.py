"""Token ids of texts, and a compressed file format for them.

``token_ids`` encodes whole texts with a tokenizer file of the tokenizers library.
A tokenizer splits a text into pieces and its model encodes each on its own, so frequent
pieces are encoded once and remembered. Texts that contain one of the tokenizer's special
strings are encoded whole.

The file format is a Parquet table of blocks, written and read by Spark only, so it
lives in any store Spark can reach and survives lost executors. A block holds
consecutive documents in the order of their ids. Each document's ids, as little-endian
unsigned integers of 2 or 4 bytes, are one zstandard frame, compressed on its own
with a dictionary shared by all of them; an index of byte offsets and id counts gives
access to single documents. The dictionary is trained on the id arrays of a bounded
sample and stored beside the blocks under its hash, which every block repeats.

Edge cases: a null text is an empty one, which has the end id only. Rows of equal id
stand next to each other, ordered by text; null ids come first. An empty table
gives a file without blocks, and a sample too small to train on gives no dictionary.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.llm.common import scratch_path, small_batches, worker_cache

REMEMBERED = 300_000  # pieces kept per Python worker: about 60 MB
SAMPLE = 2000  # documents the dictionary is trained on, at most
SAMPLE_BYTES = 4_000_000  # and of their ids
DICTIONARY = 110 * 1024  # bytes of the dictionary
BLOCK = 1 << 18  # ids of a block, one document at least

DOUBLE_SPACE = re.compile(r"^[ \n]|[ \n]$|\s[ \n]|[ \n]\s")
PIECE = re.compile(r"(?<=\S)(?=[ \n]\S)")
# The pattern of byte-level pre-tokenizers that name none: a fixed value.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# What classes of characters hold below U+0100, for use inside brackets.
LATIN = {r"\p{L}": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"\p{N}": "0-9\xb2\xb3\xb9\xbc-\xbe",
         r"\s": "\t-\r \x85\xa0"}


def latin_pattern(pattern: str) -> re.Pattern:
    """A pre-tokenizer's pattern for texts of characters below U+0100."""
    out, inside = "", False
    for part in re.findall(r"\\p\{[LN]\}|\\[sS]|.", pattern, re.S):
        if part in LATIN:
            out += LATIN[part] if inside else f"[{LATIN[part]}]"
        elif part == r"\S":
            out += "[^" + LATIN[r"\s"] + "]"
        else:
            inside = part == "[" or inside and part != "]"
            out += part
    return re.compile(out)


class Encoder(dict):
    """Ids of texts as little-endian unsigned 32-bit integers; it remembers pieces.

    Texts of characters below U+0100 are split by the tokenizer's own pattern, and its model
    encodes each new piece. Other texts are cut at white space first; cuts with other
    characters go through the whole tokenizer. If the tokenizer is of a kind for which that is not known to
    be right, or a probe differs, every cut does.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.cuts: dict[str, bytes] = {}
        self.prepare(path)

    def prepare(self, path: str) -> None:
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as file:
            kind = json.load(file)
        before = kind["pre_tokenizer"] or {}
        steps = before.get("pretokenizers", [before])
        patterns = [x["pattern"]["Regex"] for x in steps if x.get("type") == "Split"]
        patterns += [BYTE_LEVEL for x in steps if x.get("type") == "ByteLevel" and x["use_regex"]]
        rules = kind["normalizer"] or {}
        rules = [x["type"] for x in rules.get("normalizers", [rules] if rules else [])]
        self.pattern = None
        if len(patterns) != 1 or not set(rules) <= {"NFC", "Replace", "Lowercase"}:
            return
        self.lower, self.model = "Lowercase" in rules, self.tokenizer.model
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.table = {c: byte_level.pre_tokenize_str(chr(c))[0][0] for c in range(256)}
        self.pattern = latin_pattern(patterns[0])
        probe = "".join(f"{chr(c)}a {chr(c)} \n{chr(c)}1{chr(c)}{chr(c)}Z'll" for c in range(256))
        if self.latin(probe) != self.whole(probe):
            self.pattern = None

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", [t.id for t in self.model.tokenize(piece.translate(self.table))]).tobytes()
        if len(piece) <= 48:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids

    def latin(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pattern.findall(text.lower() if self.lower else text)))

    def cut(self, part: str) -> bytes:
        ids = self.cuts.get(part)
        if ids is None:
            ids = self.latin(part) if self.pattern and below_256(part) else self.whole(part)
            if len(part) <= 48:
                if len(self.cuts) >= REMEMBERED // 4:
                    self.cuts.clear()
                self.cuts[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.special and self.special.search(text):
            return self.whole(text)
        if self.pattern and below_256(text):
            return self.latin(text)
        if DOUBLE_SPACE.search(text):
            return b"".join(map(self.cut, PIECE.split(text)))
        head, *rest = text.replace("\n", " \n").split(" ")
        return self.cut(head) + b"".join([self.cut(p if p[:1] == "\n" else " " + p) for p in rest])


def below_256(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, one per Python worker."""
    cache = worker_cache()
    if ("encoder", path) not in cache:
        cache["encoder", path] = Encoder(path)
    return cache["encoder", path]


def token_ids(documents: DataFrame, path: str, end: int | None, text: str = "text",
              ids: str = "ids") -> DataFrame:
    """Documents with their texts replaced by ``ids``: binary, 4 bytes an id."""
    small_batches(documents.sparkSession)
    kept = documents.withColumn(text, F.coalesce(text, F.lit("")))
    place = kept.columns.index(text)
    schema = documents.withColumn(text, F.lit(b"")).withColumnRenamed(text, ids).schema
    tail = b"" if end is None else np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            columns = batch.columns
            columns[place] = pa.array([encode(t.as_py()) + tail for t in columns[place]], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
    return kept.mapInArrow(run, schema)


def _trained(sample: list[bytes]) -> bytes:
    """A zstandard dictionary for serialized id arrays; empty if there is too little."""
    import zstandard

    total, size = [], 0
    for ids in sample:
        total.append(ids[:SAMPLE_BYTES - size])
        size += len(total[-1])
        if size >= SAMPLE_BYTES:
            break
    try:
        return zstandard.train_dictionary(min(DICTIONARY, size // 8), total).as_bytes()
    except zstandard.ZstdError:
        return b""


def bytes_of_id(path: str) -> int:
    """Bytes of a serialized id."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 65536 else 4


def write_ids(documents: DataFrame, path: str, end: int, folder: str, id: str = "doc_id",
              text: str = "text", partitions: int | None = None) -> None:
    """Write the ids of all documents, in ascending order of ``id``, below ``folder``.

    ``folder/dictionary`` has one row (hash, dictionary, width, tokenizer),
    ``folder/blocks`` the blocks.
    """
    spark = documents.sparkSession
    width = bytes_of_id(path)
    docs = documents.select(F.col(id).alias("id"), text_or_empty(text).alias("text"))
    share = min(1.0, SAMPLE / max(1, docs.count()))
    chosen = F.shiftrightunsigned(F.xxhash64("id", "text"), 11) < F.lit(int(share * 2 ** 53))
    small = docs.filter(chosen).limit(2 * SAMPLE).select(
        F.lit(0).alias("id"), F.substring("text", 1, SAMPLE_BYTES).alias("text"))
    sample = [np.frombuffer(r["ids"], "<u4").astype(f"<u{width}").tobytes()
              for r in token_ids(small, path, end).select(
                  F.substring("ids", 1, 4 * SAMPLE_BYTES // SAMPLE * 8).alias("ids")).collect()]
    dictionary = _trained(sample)
    name = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(name, bytearray(dictionary), width, path.rsplit("/", 1)[-1])],
                          "hash string, dictionary binary, width int, tokenizer string").coalesce(1).write.parquet(
        f"{folder}/dictionary")
    parts = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                              spark.sparkContext.defaultParallelism)
    small_batches(spark)
    ordered = docs.repartitionByRange(parts, "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=3, dict_data=data, write_content_size=True,
                                        write_checksum=True, write_dict_id=False).compress
        encode, part = encoder(path).encode, TaskContext.get().partitionId()
        before = block = 0
        ids, frames, counts = [], [], []

        def flush() -> pa.RecordBatch:
            ends = np.cumsum([len(f) for f in frames], dtype="<u8")
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([block], pa.int32()),
                pa.array([before], pa.int64()), pa.array([sum(counts)], pa.int64()),
                pa.array([ids], pa.list_(pa.int64())), pa.array([ends.tobytes()], pa.binary()),
                pa.array([np.array(counts, "<u8").tobytes()], pa.binary()),
                pa.array([b"".join(frames)], pa.binary()), pa.array([name])],
                names=["part", "block", "before", "total", "ids", "ends", "counts", "frames", "hash"])

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = np.frombuffer(encode(value.as_py()) + tail, "<u4")
                ids.append(key)
                counts.append(len(tokens))
                frames.append(pack(tokens.astype(f"<u{width}").tobytes()))
                if sum(counts[-64:]) >= BLOCK or len(counts) % 64 == 0 and sum(counts) >= BLOCK:
                    yield flush()
                    before, block = before + sum(counts), block + 1
                    ids, frames, counts = [], [], []
        if counts:
            yield flush()

    blocks = ordered.withColumn("id", F.col("id").cast("long")).mapInArrow(
        run, "part int, block int, before long, total long, ids array<long>, ends binary, "
             "counts binary, frames binary, hash string")
    blocks.withColumn("first", F.array_min("ids")).withColumn("last", F.array_max("ids")).write.option(
        "compression", "none").parquet(f"{folder}/blocks")


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def read_ids(spark: SparkSession, folder: str, only: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents in a folder, or of those with
    the id ``only``: then only blocks that can hold it are read, and of them only its
    frames are decompressed. ``start`` counts the ids of all documents before."""
    name, dictionary, width, _ = spark.read.parquet(f"{folder}/dictionary").first()
    dictionary = bytes(dictionary)
    if hashlib.sha256(dictionary).hexdigest() != name:
        raise ValueError(f"the dictionary in {folder} does not have its hash")
    blocks = spark.read.parquet(f"{folder}/blocks")
    # ids before each part: one row per partition that wrote
    totals = blocks.groupBy("part").agg(F.sum("total").alias("total"))
    starts = totals.select("part", F.coalesce(F.sum("total").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    if only is not None:
        blocks = blocks.filter((F.col("first") <= only) & (F.col("last") >= only))
    placed = blocks.join(starts, "part").select(
        (F.col("base") + F.col("before")).alias("start"), "ids", "ends", "counts", "frames", "hash")
    small_batches(spark, 32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        unpack = zstandard.ZstdDecompressor(dict_data=data).decompress
        for batch in batches:
            for start, ids, ends, counts, frames, hash in zip(*(c.to_pylist() for c in batch.columns)):
                if hash != name:
                    raise ValueError(f"a block in {folder} was written with another dictionary")
                ends, counts = np.frombuffer(ends, "<u8"), np.frombuffer(counts, "<u8").astype(np.int64)
                starts = start + np.cumsum(counts) - counts
                begins = np.r_[0, ends[:-1].astype(np.int64)]
                wanted = [i for i, key in enumerate(ids) if only is None or key == only]
                for some in (wanted[i:i + 256] for i in range(0, len(wanted), 256)):
                    made = [np.frombuffer(unpack(frames[begins[i]:ends[i]]), f"<u{width}").astype("<u4").tobytes()
                            for i in some]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([ids[i] for i in some], pa.int64()), pa.array(starts[some]),
                        pa.array(counts[some]), pa.array(made, pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"])
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def fresh_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "token-ids")
