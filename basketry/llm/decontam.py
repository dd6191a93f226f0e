r"""Benchmark passages found in documents, and taken out of them.

A window is ``n`` consecutive words of a benchmark item (all its words, if it has
fewer). The windows, normalised, travel to every task as a hash set. Documents
are read once: only words that are the anchor of a window (its longest word) open
the windows around them, and those are looked up, word for word, in the set. All
of that happens inside the row that holds the text, without a shuffle; only the
hits are joined with the small table of windows to name the items.

The set holds ``bound`` windows at most, which is checked. A larger benchmark is
joined by hashes of all document windows in a shuffle instead, with the same
result. Everything runs as DataFrame functions.

Edge cases: a null text has no words and no hits. Items without words (null,
empty, only punctuation) have no windows; equal windows of several items count
for each of them. A null item id stands for nothing and is skipped. Rows of equal
id are treated one by one. Empty tables give no hits. All columns of the
documents are kept; added ones whose name is taken get underscores before it.
Rows are numbered as they are read, so documents should come from files or a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import ascii_lower, free_name, written

# Between words: ASCII other than digits and letters. Texts are lower-cased (A-Z)
# before they are compared, not before they are cut.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
BOUND = 50_000  # windows in the hash set: a few MB
HIT = "struct<at:int,size:int,window:array<string>>"


def words_of(text: Column) -> Column:
    """Words of a text; none for null."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS, -1)
    return F.filter(parts, lambda w: w != "")


def windows_of(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Distinct windows: window, size, anchor, at (the words before the anchor)
    and items, the sorted ids that have the window."""
    words = benchmark.filter(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words"))
    words = words.filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(1)))
    windows = words.select("item", F.explode(
        F.transform(starts, lambda i: F.slice("words", i, n))).alias("window"))
    windows = windows.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))
    longest = F.array_max(F.transform("window", lambda w: F.length(w)))
    anchor = F.filter("window", lambda w: F.length(w) == longest)[0]
    return windows.select(
        "window", "items", F.size("window").alias("size"), anchor.alias("anchor"),
        (F.array_position("window", anchor) - 1).cast("int").alias("at"))


def find(documents: DataFrame, windows: DataFrame, text: str = "text", bound: int = BOUND) -> DataFrame:
    """Documents with ``n_words`` and ``hits``: sorted array of (at, size, window)
    of all windows found; ``at`` counts words from 0."""
    n_words, hits, words = (free_name(documents, c) for c in ("n_words", "hits", "words"))
    docs = documents.withColumn(words, words_of(F.col(text))).withColumn(n_words, F.size(words))
    few = windows.select("window", "size", "anchor", "at").limit(bound + 1).collect()
    if len(few) <= bound:
        return docs.withColumn(hits, _looked_up(words, few)).drop(words)
    sizes = [r[0] for r in windows.select("size").distinct().collect()]  # as many as words in a window
    row = free_name(documents, "row")
    docs = written(docs.withColumn(row, F.monotonically_increasing_id()).drop(words), "rows")
    found = _joined(docs.select(row, words_of(F.col(text)).alias("words")), row, windows, sizes)
    return docs.join(found.withColumnRenamed("hits", hits), row, "left").withColumn(
        hits, F.coalesce(hits, F.array().cast(f"array<{HIT}>"))).drop(row)


def _listed(values: set[str] | set[int]) -> str:
    return ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in sorted(values))


def _looked_up(words: str, windows: list) -> Column:
    """The hits in an array of words. Words hold no quote or backslash, so they
    can stand in SQL; a long IN list is a hash set in the plan."""
    nothing = F.array().cast(f"array<{HIT}>")
    if not windows:
        return nothing
    reach = {(w["size"], w["at"]) for w in windows}  # as many as words in a window, squared
    reach = ", ".join(f"struct({size} AS size, {at} AS at)" for size, at in sorted(reach))
    texts = _listed({" ".join(w["window"]) for w in windows})
    anchors = _listed({w["anchor"] for w in windows})
    opened = f"""
      flatten(transform(
        filter(sequence(0, size(`{words}`) - 1), i -> get(`{words}`, i) IN ({anchors})),
        i -> transform(
          filter(array({reach}), r -> i >= r.at AND i - r.at + r.size <= size(`{words}`)),
          r -> named_struct('at', i - r.at, 'size', r.size,
                            'window', slice(`{words}`, i - r.at + 1, r.size)))))"""
    kept = f"array_sort(array_distinct(filter({opened}, h -> array_join(h.window, ' ') IN ({texts}))))"
    return F.when(F.expr(f"exists(`{words}`, w -> w IN ({anchors}))"), F.expr(kept)).otherwise(nothing)


def _joined(docs: DataFrame, row: str, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """The hits per row from a join of all windows of all documents."""
    def of(n: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size("words") - n, F.lit(0)))
        return F.when(F.size("words") >= n, F.transform(starts, lambda i: F.struct(
            i.alias("at"), F.lit(n).alias("size"), F.slice("words", i + 1, n).alias("window")))
        ).otherwise(F.array().cast(f"array<{HIT}>"))
    every = F.flatten(F.array(*map(of, sizes)))
    spread = docs.select(row, F.explode(every).alias("hit"))
    table = windows.select(F.xxhash64("window").alias("hash"), "window")
    both = spread.join(table, (F.xxhash64("hit.window") == table["hash"])
                       & (F.col("hit.window") == table["window"]), "left_semi")
    return both.groupBy(row).agg(F.sort_array(F.collect_set("hit")).alias("hits"))


def name_items(found: DataFrame, windows: DataFrame, bound: int = BOUND) -> DataFrame:
    """What ``find`` gave, with ``items`` (sorted ids of the items found) for its hits."""
    items, row, hit = (free_name(found, c) for c in ("items", "row", "hit"))
    numbered = found.withColumn(row, F.monotonically_increasing_id())
    spread = numbered.withColumn(hit, F.explode_outer("hits"))
    named = windows.select(F.col("window").alias(f"{hit}_window"), F.col("items").alias(f"{hit}_items"))
    if windows.limit(bound + 1).count() <= bound:
        named = F.broadcast(named)
    both = spread.join(named, F.col(f"{hit}.window") == F.col(f"{hit}_window"), "left")
    return both.groupBy(row).agg(
        *[F.first(F.col(f"`{c}`")).alias(c) for c in found.columns],
        F.sort_array(F.array_distinct(F.flatten(F.collect_set(f"{hit}_items")))).alias(items)).drop(row)


def covered(hits: Column) -> Column:
    """How many words the windows in ``hits`` (sorted) cover together."""
    def step(acc: Column, h: Column) -> Column:
        end = F.greatest(acc["end"], h["at"] + h["size"])
        return F.struct(end.alias("end"), (acc["n"] + end - F.least(
            F.greatest(acc["end"], h["at"]), end)).alias("n"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(hits, start, step, lambda acc: acc["n"])


def spans_of(hits: Column) -> Column:
    """The windows in ``hits`` (sorted) merged into disjoint spans (at, end) of words."""
    def span(at: Column, end: Column) -> Column:
        return F.array(F.struct(at.alias("at"), end.alias("end")))

    def step(acc: Column, h: Column) -> Column:
        last, end = F.try_element_at(acc, F.lit(-1)), h["at"] + h["size"]
        return F.when((F.size(acc) > 0) & (h["at"] <= last["end"]), F.concat(
            F.slice(acc, 1, F.size(acc) - 1), span(last["at"], F.greatest(last["end"], end)))
        ).otherwise(F.concat(acc, span(h["at"], end)))
    return F.aggregate(hits, F.array().cast("array<struct<at:int,end:int>>"), step)


def _with(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def without_spans(text: Column, spans: Column) -> Column:
    """A text without the words in ``spans``, and without what stands between and after them."""
    def joined(x: Column) -> Column:
        # words are counted without the empty one that stands before a leading break
        first = F.when(F.get(x["words"], F.lit(0)) == "", 1).otherwise(0)
        parts = F.zip_with(x["words"], x["breaks"], lambda w, b: F.concat(w, F.coalesce(b, F.lit(""))))

        def kept(y: Column) -> Column:
            begins = F.concat(F.array(F.lit(0)), F.transform(x["spans"], lambda s: s["end"] + first))
            ends = F.concat(F.transform(x["spans"], lambda s: s["at"] + first), F.array(F.size(y)))
            return F.array_join(F.flatten(F.zip_with(
                begins, ends, lambda b, e: F.slice(y, b + 1, F.greatest(e - b, F.lit(0))))), "")
        return _with(parts, kept)
    return _with(F.struct(
        F.split(text, BREAKS, -1).alias("words"),
        F.regexp_extract_all(text, F.lit(f"({BREAKS})"), 1).alias("breaks"), spans.alias("spans")), joined)


def clean(documents: DataFrame, benchmark: DataFrame, text: str = "text", n: int = WINDOW,
          most: float = 0.5, bound: int = BOUND) -> DataFrame:
    """Documents without their benchmark passages, with their own columns only.

    A document of which more than ``most`` of the words are hit goes; from the
    others the hit words are taken out. Documents without a hit stay as they are.
    """
    windows = written(windows_of(benchmark, n), "windows")
    found = find(documents, windows, text, bound)
    n_words, hits = found.columns[-2:]

    def verdict(h: Column) -> Column:
        cut = F.when(F.size(h) > 0, without_spans(F.col(text), spans_of(h))).otherwise(F.col(text))
        return F.struct((covered(h) <= most * F.greatest(F.col(n_words), F.lit(1))).alias("keep"), cut.alias("text"))
    # exploding none or one row decides once; a filter would look for hits again
    kept = F.filter(F.transform(F.array(F.col(hits)), verdict), lambda v: v["keep"])
    out = free_name(found, "kept")
    return found.withColumn(out, F.explode(kept)).withColumn(text, F.col(f"{out}.text")).select(
        *[F.col(f"`{c}`") for c in documents.columns])
