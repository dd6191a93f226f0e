"""Languages of texts and of the spans in them.

The model is a count of character trigrams (with word ends) by language, hashed into a fixed
number of places, and of the scripts each language is written in. Every word is scored for
the languages that use its script; words in a script no language uses have no candidates and
count for none. A Viterbi pass over the words, with a penalty for every switch, labels spans. A
text's language is the one with most letters; its score is the share of all letters that
lie in spans and words of that language.

Most texts are in one language throughout. That is recognised exactly: if no stretch of words
gains as much by other languages as one switch costs, the best path never switches. Only
other texts go through the word-by-word recursion, many at a time.

Training counts are summed by Spark. What reaches the driver is languages x places; the
number of languages is checked. Texts are handled in bounded pieces of many or parts of
one, so memory does not grow with a text beyond its words.

Edge cases: null texts and texts without letters are ``und`` with score 0. A text with letters but
no scored word gets the language with most training letters, with score 0. Without training rows
everything is ``und``. Ties go to the language that comes first by name. All columns are kept;
added ones whose names are taken get underscores before them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import blocks, free_name, small_batches, worker_cache

PLACES = 1 << 15  # trigram counts per language
PENALTY = 12.0  # nats for a switch of language
SMOOTHING = 0.5
SCRIPT_SHARE = 0.01  # of a language's letters that make a script one of its own
LANGUAGES = 1000  # at most
CHARACTERS = 1 << 20  # of a text handled at once
LABELLED = 1 << 22  # characters of the texts that are labelled together
UNKNOWN = "und"
# Unicode blocks by script (first, last): fixed values.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "sinhala": [(0xD80, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "ethiopic": [(0x1200, 0x137F)],
    "khmer": [(0x1780, 0x17FF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)],
}
OTHER = len(SCRIPTS)  # letters of any other script


def tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 2 for letters, 1 for marks, 0 for others; and the script."""
    cache = worker_cache()
    if "characters" not in cache:
        kind = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            major = unicodedata.category(chr(c))[0]
            kind[c] = 2 if major == "L" else major == "M"
        script = np.full(0x110000, OTHER, np.uint8)
        for i, ranges in enumerate(SCRIPTS.values()):
            for first, last in ranges:
                script[first:last + 1] = i
        cache["characters"] = kind, script
    return cache["characters"]


def lowered(text: str) -> str:
    """Lower case with as many characters as before."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower()[0] for c in text)


def cut(text: str, most: int = CHARACTERS) -> Iterator[str]:
    """A text in pieces of about ``most`` characters, cut before white space if there is any."""
    begin = 0
    while len(text) - begin > most:
        end = max(text.rfind(" ", begin + 1, begin + most), text.rfind("\n", begin + 1, begin + most))
        end = end if end > 0 else begin + most
        yield text[begin:end]
        begin = end
    yield text[begin:] if begin else text


def words_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a lower-cased text: places of the trigrams around every letter or mark in a word,
    the index there of each word's first, and where words begin and end in the text."""
    kind, _ = tables()
    code = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    inside = kind[code] > 0
    at = np.flatnonzero(inside)
    if not len(at):
        return np.empty(0, np.int64), at, at, at
    first = np.r_[True, np.diff(at) > 1]
    last = np.r_[first[1:], True]
    before = np.where(first, 0, code[at - 1]).astype(np.uint32)
    after = np.where(last, 0, code[np.minimum(at + 1, len(code) - 1)]).astype(np.uint32)
    mixed = (before * np.uint32(0x9E3779B1)) ^ (code[at] * np.uint32(0x85EBCA77)) ^ (after * np.uint32(0xC2B2AE3D))
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (mixed >> np.uint32(17)).astype(np.int64) % PLACES, np.flatnonzero(first), at[first], at[last] + 1


def train(rows: DataFrame, lang: str = "lang", text: str = "text") -> dict:
    """The model from all rows whose language and text are not null."""
    spark = rows.sparkSession
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, script = tables()
        counts: dict[str, np.ndarray] = {}

        def emptied() -> Iterator[pa.RecordBatch]:
            for name, n in counts.items():
                place = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(place)), pa.array(place), pa.array(n[place])], names=["lang", "place", "n"])
            counts.clear()
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                if name not in counts and len(counts) == 64:
                    yield from emptied()
                mine = counts.setdefault(name, np.zeros(PLACES + OTHER + 1, np.int64))
                for piece in cut(value.as_py()):
                    places, *_ = words_of(lowered(piece))
                    mine[:PLACES] += np.bincount(places, minlength=PLACES)
                    code = np.frombuffer(piece.encode("utf-32-le"), "<u4")
                    mine[PLACES:] += np.bincount(script[code[tables()[0][code] > 0]], minlength=OTHER + 1)
        yield from emptied()

    known = rows.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, text)
    counts = known.mapInArrow(run, "lang string, place long, n long").groupBy("lang", "place").agg(
        F.sum("n").alias("n")).persist()
    try:
        names = sorted(r[0] for r in counts.select("lang").distinct().limit(LANGUAGES + 1).collect())
        if len(names) > LANGUAGES:
            raise ValueError(f"more than {LANGUAGES} languages")
        found = counts.toArrow()  # languages x places, at most
    finally:
        counts.unpersist()
    n = np.zeros((len(names), PLACES + OTHER + 1))
    number = {name: i for i, name in enumerate(names)}
    n[[number[x] for x in found["lang"].to_pylist()], found["place"].to_numpy()] = found["n"].to_numpy()
    trigrams, scripts = n[:, :PLACES], n[:, PLACES:]
    letters = scripts.sum(axis=1, keepdims=True)
    score = np.log((trigrams + SMOOTHING) / (trigrams.sum(axis=1, keepdims=True) + SMOOTHING * PLACES))
    return {"names": names, "score": score.T.astype(np.float32).copy(),
            "uses": (scripts >= SCRIPT_SHARE * np.maximum(letters, 1)).T & (scripts.T > 0),
            "common": int(letters.argmax()) if names else -1}


def word_scores(model: dict, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(scores by word and language, whether the word has candidates, begin, end) of a text's words."""
    _, script = tables()
    parts, offset = [], 0
    for piece in cut(text, max(1 << 14, CHARACTERS // max(1, len(model["names"]) // 4))):
        low = lowered(piece)
        places, first, begin, end = words_of(low)
        if len(begin):
            score = np.add.reduceat(model["score"][places], first, axis=0, dtype=np.float64)
            code = np.frombuffer(low.encode("utf-32-le", "replace"), "<u4")
            uses = model["uses"][script[code[begin]]]
            some = uses.any(axis=1)
            score = np.where(uses, score, score.min(axis=1, keepdims=True) - 1000.0)
            score[~some] = 0.0
            parts.append((score, some, begin + offset, end + offset))
        offset += len(piece)
    if not parts:
        none = np.empty(0, np.int64)
        return np.empty((0, len(model["names"]))), none.astype(bool), none, none
    return tuple(np.concatenate(x) for x in zip(*parts))


def constant_paths(scores: np.ndarray, docs: np.ndarray, penalty: float) -> np.ndarray:
    """By document: its best single language if the best path never leaves it, else -1.
    ``docs`` has the ends of the documents, each of one word at least."""
    begins = np.r_[0, docs[:-1]]
    best = np.add.reduceat(scores, begins, axis=0).argmax(axis=1)
    owner = np.repeat(np.arange(len(docs)), np.diff(np.r_[0, docs]))
    rows = np.arange(len(scores))
    own = scores[rows, best[owner]]
    others = scores.copy()
    others[rows, best[owner]] = -np.inf
    gain = np.cumsum(np.maximum(others.max(axis=1), -1e300) - own) if scores.shape[1] > 1 else np.zeros(len(scores))
    # the largest sum of consecutive gains: running sum less its least value before, per document
    before = np.r_[0.0, gain[:-1]]
    apart = gain.max() - min(gain.min(), 0.0) + 1.0
    least = np.minimum.accumulate(before - owner * apart) + owner * apart
    return np.where(np.maximum.reduceat(gain - least, begins) < penalty - 1e-3, best, -1)


def best_paths(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The best label of every word of several documents, by Viterbi, all at once."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    sizes = np.array([len(scores[i]) for i in order])
    flat = np.concatenate([scores[i] for i in order])
    begins = np.r_[0, np.cumsum(sizes)[:-1]]
    came = np.empty(flat.shape, np.int16)  # the label before, for each label
    labels = np.arange(flat.shape[1], dtype=np.int16)
    value = flat[begins].copy()
    for t in range(1, sizes[0]):
        n = int(np.searchsorted(-sizes, -t, "left"))  # documents longer than t words
        best = value[:n].argmax(axis=1)
        switch = value[np.arange(n), best] - penalty
        stay = value[:n] >= switch[:, None]
        came[begins[:n] + t] = np.where(stay, labels, best[:, None])
        value[:n] = np.where(stay, value[:n], switch[:, None]) + flat[begins[:n] + t]
    path = np.empty(len(flat), np.int16)
    label = value.argmax(axis=1).astype(np.int16)
    path[begins + sizes - 1] = label
    for t in range(sizes[0] - 1, 0, -1):
        n = int(np.searchsorted(-sizes, -t, "left"))
        label[:n] = came[begins[:n] + t, label[:n]]
        path[begins[:n] + t - 1] = label[:n]
    out: list[np.ndarray] = [None] * len(scores)
    for i, a, n in zip(order, begins, sizes):
        out[i] = path[a:a + n]
    return out


def label(model: dict, texts: list[str | None], penalty: float = PENALTY) -> list[tuple[str, float, list[dict]]]:
    """(language, score, spans) of each text; a span is (begin, end, lang) in characters."""
    return [m[:3] for m in label_and_share(model, texts, penalty)]


def label_and_share(model: dict, texts: list[str | None],
                    penalty: float = PENALTY) -> list[tuple[str, float, list[dict], float]]:
    """The same with the share of letters in any of the languages, the score being that of the main one."""
    kind, _ = tables()
    found = []
    scored = [word_scores(model, t or "") for t in texts] if model["names"] else [None] * len(texts)
    full = [i for i, s in enumerate(scored) if s is not None and len(s[0])]
    paths: dict[int, np.ndarray] = {}
    if full:
        ends = np.cumsum([len(scored[i][0]) for i in full])
        same = constant_paths(np.concatenate([scored[i][0] for i in full]), ends, penalty)
        paths = {i: np.full(len(scored[i][0]), c, np.int16) for i, c in zip(full, same.tolist()) if c >= 0}
        mixed = [i for i, c in zip(full, same.tolist()) if c < 0]
        if mixed:
            paths |= dict(zip(mixed, best_paths([scored[i][0] for i in mixed], penalty)))
    for i, text in enumerate(texts):
        if i not in paths or not (kind[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")] == 2).any():
            found.append((UNKNOWN, 0.0, [], 0.0))
            continue
        _, some, begin, end = scored[i]
        path, size = paths[i], end - begin
        letters = np.bincount(path[some], size[some], minlength=len(model["names"]))
        edge = np.flatnonzero(np.r_[True, np.diff(path) != 0])
        stop = np.r_[edge[1:], len(path)] - 1
        spans = [{"begin": int(begin[a]), "end": int(end[b]), "lang": model["names"][path[a]]}
                 for a, b in zip(edge, stop)] if some.any() else []
        best = int(letters.argmax()) if some.any() else model["common"]
        found.append((model["names"][best], float(letters[best] / size.sum()), spans, float(letters.sum() / size.sum())))
    return found


def identify(documents: DataFrame, model: dict, text: str = "text", penalty: float = PENALTY,
             share: bool = False) -> DataFrame:
    """Documents with ``lang_pred``, ``score`` and ``spans`` (begin, end, lang), in characters; if asked for,
    with ``share``, of letters in any of the languages."""
    spark = documents.sparkSession
    small_batches(spark, 1024)
    shared = spark.sparkContext.broadcast(model)
    names = [free_name(documents, c) for c in ("lang_pred", "score", "spans", "share")]
    schema = documents.select(
        "*", F.lit("").alias(names[0]), F.lit(0.0).alias(names[1]),
        F.array().cast("array<struct<begin:int,end:int,lang:string>>").alias(names[2]),
        *[F.lit(0.0).alias(names[3])] * share).schema
    place = documents.columns.index(text)
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, made = batch.column(place).to_pylist(), []
            for a, b in blocks((len(t or "") for t in texts), LABELLED):
                made += label_and_share(shared.value, texts[a:b], penalty)
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64()),
                pa.array([m[2] for m in made], span),
                *[pa.array([m[3] for m in made], pa.float64())] * share], names=schema.names)
    return documents.mapInArrow(run, schema)
