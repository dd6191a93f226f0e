"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import chat, decontam, langid, lmscore, mips, packing, quality, repair, sharding, simhash, tokens, vecdedup, vectorcodes
from basketry.llm.common import crc_of_id, free_name, read_table, tokenizer_path, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function
    return wrap


PROBE_ID, PROBE_TEXT = -7, r"\### Assistant: </turn> ok"  # fixed values


@query(r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'),
                                  (-7, 1, 'assistant', '\### Assistant: </turn> ok')) v),
sized AS (
  SELECT *, length(text) + (length(text) - length(replace(text, '\', '')))
    - 5 * (length(text) - length(replace(text, '</turn>', ''))) // 7
    - 2 * (length(text) - length(replace(text, '### ', ''))) // 4 AS escaped FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + escaped + 14) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id""")
def op1_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations rebuilt, rendered, and read back from the rendered text."""
    rows = read_table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE_TEXT).alias("text"))
    events = rows.unionByName(probe).select(
        "conv_id", F.col("turn").alias("seq"), F.col("turn").alias("target"),
        F.lit("message").alias("kind"), "role", "text")
    out = chat.render(chat.reconstruct(events)).select(
        "conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"),
        F.array_join(chat.trained_texts(F.col("mask")), "").alias("loss"))
    told = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(told, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


@query(r"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
starts AS (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS win, least(len(w), 10) AS n FROM starts),
docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
spread AS (
  SELECT rid, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n),
seen AS (
  SELECT s.rid, s.i, s.n, x.item FROM spread s JOIN docs d USING (rid)
  JOIN windows x ON x.n = s.n AND x.win = array_to_string(d.w[s.i:s.i + s.n - 1], ' ')),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM seen) GROUP BY rid),
named AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT rid, item FROM seen) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)""")
def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows in every document."""
    windows = written(decontam.windows_of(read_table(spark, folder, "benchmark")), "windows")
    found = decontam.find(read_table(spark, folder, "documents"), windows)
    light = found.select("doc_id", F.col("n_words").cast("long"), "hits",
                         decontam.covered(F.col("hits")).cast("long").alias("n_hit"))
    return decontam.name_items(light, windows).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


@query()
def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    rows = simhash.group(read_table(spark, folder, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
                       "component_id")


@query()
def op10_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all documents, written to files and read back from them."""
    out = tokens.fresh_folder(spark)
    tokens.write_ids(read_table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"), 2, out)
    return tokens.read_ids(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query()
def op7_pack(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in written sequences of 4096 tokens. The checksums are of what the sequences hold."""
    docs = read_table(spark, folder, "documents")
    return packing.placements(packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), 1))


@query()
def op8_shard(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, whole, shuffled into 40 written shards. The digests are of what the shards hold."""
    docs = read_table(spark, folder, "documents")
    shard, slot = free_name(docs, "shard"), free_name(docs, "slot")
    kept = sharding.write_shards(sharding.shuffle(docs), shard, slot)
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return kept.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), F.col(shard).alias("shard"), F.col(slot).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


@query("""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""")
def op5_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best partners of every hundredth vector among all."""
    found = mips.search_all(read_table(spark, folder, "embeddings"), F.col("id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query()
def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from those not held out."""
    docs = read_table(spark, folder, "documents")
    held = F.coalesce(F.pmod(crc_of_id(F.col("doc_id")), F.lit(5)) == 0, F.lit(False))
    learned = docs.filter(F.pmod(crc_of_id(F.col("doc_id")), F.lit(5)) != 0).select("lang", "text")
    found = langid.identify(docs.select("doc_id", "text"), langid.train(learned))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query()
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Log weight of every document, and whether it is selected."""
    weighed = quality.weigh(read_table(spark, folder, "documents").select("doc_id", "text"),
                            read_table(spark, folder, "labels")).select("doc_id", "labelled", "log_weight")
    return quality.select(written(weighed, "weights")).select("doc_id", "log_weight", "key", "selected")


@query()
def op3_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    """Log probabilities of all documents. Of seven parts one is only scored, and one deleted while
    weights are learned; documents without an id are only scored."""
    part = F.pmod(crc_of_id(F.col("doc_id")), F.lit(7))
    role = F.when(part.isNull() | (part == 2), lmscore.SCORED).when(part == 6, lmscore.DELETED).otherwise(lmscore.LEARNED)
    rows = read_table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", role.alias("role"))
    return lmscore.score(rows).select(
        F.col("id").alias("doc_id"), (F.col("role") == lmscore.SCORED).alias("held_out"), "n_tokens", "n_known",
        "train_tokens", "base_score", "score")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults put in by a hash of conversation and turn; nulls are one space."""
    space = F.lit(" ")
    kind = F.crc32(F.concat(*[F.coalesce(x, space) for x in (
        F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))])) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    return rows.filter(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("_")).drop("_")


def _repair_sql() -> str:
    """The cheapest edits row by row, without runs: per state a text of 12 digits of cost, the audit, a mark, and the
    repaired rows. The least of such texts is the cheapest, and of equal costs that of the least audit."""
    mark = "chr(31)"

    def add(v: str, cost: str, edit: str, line: str | None = None) -> str:
        at = f"strpos({v}, {mark})"
        told = (f"lpad(CAST(CAST(left({v}, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || substr({v}, 13, {at} - 13) || "
                f"'{edit}' || substr({v}, {at})")
        return f"({told})" if line is None else f"({told} || CASE WHEN {at} < length({v}) THEN chr(10) ELSE '' END || {line})"

    def edited(v: str, keeps: str, new: str) -> str:
        kept = f"CASE WHEN NOT gone AND initial = '{keeps}' THEN {add(v, 'late', 'K', "role || ':' || text")} END"
        given = f"CASE WHEN NOT gone THEN {add(v, '2 + late', 'R', f"'{new}:' || text")} END"
        return f"{kept}, {given}"
    to_user = ", ".join(edited(f"w{i}", "u", "user") for i in (0, 1, 3))
    blanks = " || ".join(f"chr({i})" for i in (32, 9, 10, 11, 12, 13))
    return rf"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, CAST(i AS BIGINT) AS v FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END FROM bits WHERE k < 8),
codes AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
hashed AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(key) + 1), lambda i: CAST(ascii(key[i]) AS BIGINT))),
    lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1]))) % 20 AS kind FROM keyed, codes),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hashed),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    rtrim(text, {blanks}) AS body FROM damaged),
told AS (
  SELECT *, body = '' AS blank, body <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate,
    CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '?' END AS initial FROM placed),
marked AS MATERIALIZED (
  SELECT *, blank OR duplicate AS gone, NOT (blank OR duplicate) AND right(body, 1) NOT IN ('.', '!', '?') AS truncated,
    CAST(right(body, 1) NOT IN ('.', '!', '?') AS INTEGER) AS late,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM told),
sizes AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id),
steps AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000000' || {mark} AS v0, CAST(NULL AS VARCHAR) AS v1, CAST(NULL AS VARCHAR) AS v2,
    CAST(NULL AS VARCHAR) AS v3 FROM sizes
  UNION ALL
  SELECT conv_id, i, {add('w0', '3', 'D')},
    least({add('w1', '3', 'D')}, CASE WHEN NOT gone AND initial = 's' THEN {add('w0', 'late', 'K', "role || ':' || text")} END),
    least({add('w2', '3', 'D')}, {to_user}),
    least({add('w3', '3', 'D')}, {edited('w2', 'a', 'assistant')})
  FROM (
    SELECT *, least(v3, {add('w2', '2', 'I', "'assistant:'")}) AS w3 FROM (
      SELECT m.*, v0 AS w0, v1 AS w1, v3, least(v2, {add('v0', '2', 'I', "'user:'")}, {add('v1', '2', 'I', "'user:'")},
        {add('v3', '2', 'I', "'user:'")}) AS w2
      FROM steps s JOIN marked m ON m.conv_id IS NOT DISTINCT FROM s.conv_id AND m.i = s.i + 1))),
ended AS (
  SELECT conv_id, least(v0, v3, {add('w2', '2', 'I', "'assistant:'")}) AS v FROM (
    SELECT s.conv_id, v0, v3, least(v2, {add('v1', '2', 'I', "'user:'")}) AS w2
    FROM steps s JOIN sizes z ON z.conv_id IS NOT DISTINCT FROM s.conv_id AND z.n = s.i))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(left(v, 12) AS BIGINT), 0) AS cost,
  coalesce(substr(v, 13, strpos(v, {mark}) - 13), '') AS audit,
  sha256(coalesce(substr(v, strpos(v, {mark}) + 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sizes z ON z.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""


@query(_repair_sql())
def op13_repair(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, damaged and then repaired."""
    given = read_table(spark, folder, "conversations")
    made = repair.repair(damaged(given))
    told = made.audits.join(repair.digests(made.rows).toDF("conv", "repaired_sha256"),
                            F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv")
    every = given.select(F.col("conv_id").alias("conv")).distinct()
    found = every.join(told, F.col("conv").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit(b""), 256)
    return found.select(F.col("conv").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def _codes_sql() -> str:
    """K-means by rows of (vector, part, position), with one table of entries a round."""
    steps = ["""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (
  SELECT r, (i - 1) // (len(v) // 8) AS part, (i - 1) % (len(v) // 8) AS pos, v[i] AS x
  FROM (SELECT r, v, unnest(range(1, len(v) + 1)) AS i FROM kept)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, pos, x AS c FROM x WHERE r <= 16)"""]
    for i in range(7):
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT r, part, min(struct_pack(d := d, entry := entry)) AS best FROM (
    SELECT r, part, entry, sum((x - c) * (x - c)) AS d FROM x JOIN c{i} USING (part, pos) GROUP BY r, part, entry)
  GROUP BY r, part)""")
        if i < 6:
            steps.append(f"""
s{i} AS (SELECT part, best.entry AS entry, pos, sum(x) AS s, count(*) AS n FROM x JOIN a{i} USING (r, part) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (
  SELECT part, entry, pos, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM c{i} LEFT JOIN s{i} USING (part, entry, pos))""")
    return ",".join(steps) + """,
coded AS (
  SELECT r, string_agg(format('{:02x}', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM a6 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM c6) AS codebooks_sha256
FROM kept JOIN coded USING (r)"""


@query(_codes_sql())
def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of all vectors, their errors and the codebooks' digest."""
    return vectorcodes.compress(read_table(spark, folder, "embeddings")).withColumnRenamed("id", "vec_id").drop("label")


@query("""
WITH RECURSIVE kept AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
sized AS (SELECT *, sqrt(list_dot_product(v, v)) AS norm FROM kept),
linked AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM sized a JOIN sized b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
reached AS (SELECT r AS a, r AS b FROM kept UNION SELECT x.a, l.b FROM reached x JOIN linked l ON x.b = l.a),
found AS (SELECT x.a AS r, min(k.vec_id) AS component_id FROM reached x JOIN kept k ON k.r = x.b GROUP BY x.a),
counted AS (SELECT a AS r, count(*) AS n_links FROM linked GROUP BY a),
alone AS (
  SELECT vec_id, 0 AS n_links, vec_id AS component_id FROM embeddings
  WHERE label IS NULL OR embedding IS NULL OR len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0
    OR len(list_filter(embedding, lambda x: x <> 0)) = 0),
told AS (SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id FROM kept JOIN found USING (r) LEFT JOIN counted USING (r)
         UNION ALL SELECT * FROM alone)
SELECT *, vec_id IS NOT DISTINCT FROM component_id AS kept FROM told""")
def op11_vector_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all vectors within their labels."""
    return vecdedup.near_duplicates(read_table(spark, folder, "embeddings")).withColumnRenamed("id", "vec_id")
