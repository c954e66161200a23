"""Queries and SQL of the training-data operators, for ``__spark_entry__``."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.llm import audit, bpe, chat, hmm, iblt, jaccard, mixing, pieces, quality, ranked, sharding, suffix, vptree
from tallybrook.llm.common import remainder, table

# ---- mixing ----

#: Domains stand in for a column that ``documents`` lacks: five sources each.
MIX_DOMAINS = ("web", "books", "code", "reference")
MIX_WEIGHTS = {"web": 4, "books": 3, "code": 2, "reference": 1, "web/en": 6, "web/de": 2, "web/fr": 2, "books/en": 3}
MIX_EPOCHS, MIX_SEED = 3, 20


def with_domain(docs: DataFrame) -> DataFrame:
    number = F.coalesce(F.expr("try_cast(regexp_extract(source, '([0-9]+)', 1) as int)"), F.lit(0))
    return docs.withColumn("domain", F.element_at(F.array(*map(F.lit, MIX_DOMAINS)), F.expr("1").cast("int") + F.least(F.floor(number / 5).cast("int"), F.lit(3))))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(with_domain(table(spark, sf_dir, "documents")), ("domain", "lang", "source"), MIX_WEIGHTS, max_epochs=MIX_EPOCHS, seed=MIX_SEED)
    return out.select("doc_id", "domain", "lang", "source", F.col("mix_tokens").alias("tokens"), F.col("mix_epoch").alias("epoch"), F.col("mix_take").alias("take_tokens"), F.col("mix_budget").alias("leaf_budget"))


def _mix_sql() -> str:
    weight = "CASE name " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in MIX_WEIGHTS.items()) + " ELSE 1 END"
    domains = "[" + ", ".join(f"'{d}'" for d in MIX_DOMAINS) + "]"
    parts = [
        f"""rows_ AS (SELECT doc_id, lang, source, {domains}[1 + least(coalesce(try_cast(regexp_extract(source, '([0-9]+)', 1) AS INT), 0) // 5, 3)] AS domain,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(tokens)::HUGEINT AS tokens, sum(tokens)::HUGEINT * {MIX_EPOCHS} AS cap FROM rows_ GROUP BY ALL),
s0 AS (SELECT *, (SELECT sum(tokens)::HUGEINT FROM leaf) AS b0 FROM leaf)"""
    ]
    levels = ["domain", "lang", "source"]
    for d in range(3):
        own, above = ", ".join(levels[: d + 1]), ", ".join(levels[:d]) or "1"
        name = " || '/' || ".join(levels[: d + 1])
        parts.append(f"""g{d} AS (SELECT {own}, {name} AS name, sum(cap)::HUGEINT AS c, any_value(b{d}) AS b FROM s{d} GROUP BY {own}),
w{d} AS (SELECT *, ({weight})::HUGEINT AS w FROM g{d}),
o{d} AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY {above} ORDER BY c::DOUBLE / w, {levels[d]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS bef,
  sum(w) OVER (PARTITION BY {above} ORDER BY c::DOUBLE / w, {levels[d]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS rw FROM w{d}),
f{d} AS (SELECT *, c * rw <= (b - bef) * w AS full_ FROM o{d}),
a{d} AS (SELECT {own}, CASE WHEN full_ THEN c ELSE (b - coalesce(sum(c) FILTER (full_) OVER p, 0)::HUGEINT) * w // (sum(w) FILTER (NOT full_) OVER p)::HUGEINT END AS b{d + 1}
  FROM f{d} WINDOW p AS (PARTITION BY {above})),
s{d + 1} AS (SELECT s{d}.*, b{d + 1} FROM s{d} JOIN a{d} USING ({own}))""")
    return (
        "WITH "
        + ",\n".join(parts)
        + f""",
plan AS (SELECT domain, lang, source, b3::BIGINT AS leaf_budget, (b3 // greatest(tokens, 1))::BIGINT AS whole, (b3 % greatest(tokens, 1))::BIGINT AS rem FROM s3),
j AS (SELECT r.*, leaf_budget, whole, rem, coalesce(sum(r.tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{MIX_SEED}|' || whole || '|' || doc_id), doc_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos_ FROM rows_ r JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, tokens, e::BIGINT AS epoch, tokens AS take_tokens, leaf_budget FROM (SELECT *, unnest(range(whole)) AS e FROM j WHERE whole > 0)
UNION ALL SELECT doc_id, domain, lang, source, tokens, whole, least(tokens, rem - pos_), leaf_budget FROM j WHERE pos_ < rem"""
    )


# ---- chat ----


def op4_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.withColumn("mask", spans)


_CHAT_SQL = f"""
WITH m AS (SELECT DISTINCT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
k AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) - 1) // {chat.PART_MESSAGES} AS part FROM m),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM m WHERE role <> 'system'),
r AS (SELECT k.*, perspective, role = perspective AS own,
  CASE WHEN role = 'system' THEN '<|system|>' WHEN role = perspective THEN '<|assistant|>' ELSE '<|user name=' || role || '|>' END AS head,
  text || '<|end|>' || chr(10) AS body FROM k JOIN p ON k.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, role, md5(text) ROWS UNBOUNDED PRECEDING) AS e FROM r),
g AS (SELECT conv_id, perspective, part, count(*)::INT AS n_turns, (count(*) FILTER (own))::INT AS n_own, string_agg(head || body, '' ORDER BY turn NULLS FIRST, role, md5(text)) AS rendered,
  coalesce(string_agg((e - length(body))::VARCHAR || '-' || e::VARCHAR, ',' ORDER BY turn NULLS FIRST, role, md5(text)) FILTER (own), '') AS mask FROM o GROUP BY ALL)
SELECT conv_id, perspective, part, coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS part_base,
  n_turns, n_own, rendered, mask FROM g
"""

# ---- sharding ----

SHARDS, SHARD_SEED = 24, 6


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharding.interleave(rows, SHARDS, SHARD_SEED, ties=("size", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")




def _crc_table() -> list[int]:
    """What CRC-32 adds for each byte, for SQL that has no such function."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        out.append(c)
    return out


_SHARD_SQL = f"""
WITH h AS (SELECT doc_id, source, strlen(coalesce(text, '')) + 8 AS size, hex(encode(coalesce(text, ''))) AS hx FROM documents),
d AS (SELECT doc_id, source, size::BIGINT AS size, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(hx), 2), lambda i: ('0x' || substr(hx, i, 2))::BIGINT)), lambda c, b: xor(c >> 8, {_crc_table()}[1 + (xor(c, b) & 255)])), 4294967295)::BIGINT AS text_crc32 FROM h),
r AS (SELECT *, coalesce('=' || source, '') AS s, md5('{SHARD_SEED}|' || coalesce(doc_id::VARCHAR, '')) AS k FROM d),
f AS (SELECT *, (2 * row_number() OVER (PARTITION BY s ORDER BY k, doc_id, size, text_crc32) - 1)::DOUBLE / (2 * count(*) OVER (PARTITION BY s))::DOUBLE AS frac FROM r),
p AS (SELECT *, row_number() OVER (ORDER BY frac, s, k, doc_id, size, text_crc32) - 1 AS pos, count(*) OVER () AS n FROM f),
z AS (SELECT *, (pos * {SHARDS} // n)::INT AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, (pos - (shard * n + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard, source FROM z
"""

# ---- quality ----


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    out = quality.classify(docs, labels.filter(remainder("doc_id", 3) != 1))
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


# ---- nearest neighbours ----

#: Share of its k-th best distance within which a query still looks into a branch; recall against brute force is in the README.
ANN_FACTOR = 0.9


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vptree.neighbours(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5, ANN_FACTOR)


# ---- similarity join ----


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


# ---- language model ----


def op5_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"), remainder("doc_id", 5) == 1, seed=5)


# ---- fingerprints ----


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(table(spark, sf_dir, "documents"))


# ---- repeated strings ----


#: Bytes that a passage of over 50 words has at least; shorter ones are too common by chance.
PASSAGE_BYTES = 256


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is asked for, then ``passage_words``: the words of the longest run of repeated strings of PASSAGE_BYTES, 0 for none."""
    some, none = suffix.repeated(table(spark, sf_dir, "documents").select("doc_id", "text"), length=400, shorter=PASSAGE_BYTES)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    facts = lambda df, rest: df.withColumn("rest", rest).select(
        "doc_id",
        F.octet_length(raw).cast("long").alias("n_bytes"),
        F.aggregate("repeat_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("n_removed"),
        F.size("repeat_spans").cast("long").alias("n_spans"),
        F.sha2("rest", 256).alias("kept_sha256"),
        "passage_words",
    )
    words = lambda df, n: df.withColumn("passage_words", n)
    return facts(words(some, suffix.longest_run("text", "passage_spans")), suffix.kept("text", "repeat_spans")).unionByName(facts(words(none, F.lit(0).cast("long")), raw))


# ---- pieces ----

PIECE_SAMPLES, PIECE_SEED = 2, 1


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = pieces.Vocabulary.load()
    out = pieces.encode(table(spark, sf_dir, "documents"), vocabulary, PIECE_SAMPLES, PIECE_SEED, texts=True)
    return out.select(F.expr("try_cast(key as bigint)").alias("doc_id"), "sample", "n_pieces", "log_prob", "perturbed", "log_inclusion", F.xxhash64("ids").alias("ids_hash"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


# ---- byte-level pieces ----


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(table(spark, sf_dir, "documents"), bpe.load_ranks())
    return out.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


# ---- filters ----


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_AUDIT_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS later FROM t),
l AS (SELECT doc_id, coalesce(max(quality) = 1, false) AS good, coalesce(max(toxic) = 1, false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, (CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END)
  || (CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) THEN 'C' ELSE '' END)
  || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN later THEN 'E' ELSE '' END) AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM w LEFT JOIN l USING (doc_id)),
g AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
o AS (SELECT unnest(string_split('{" ".join(map("".join, permutations(audit.FILTERS)))}', ' ')) AS filter_order),
s AS (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM g, o),
x AS (SELECT *, contains(fails, filter_order[step]) AS bad, step > 1 AND regexp_matches(fails, '[' || left(filter_order, step - 1) || '_]') AS gone FROM s),
r AS (SELECT part, filter_order, step, filter_order[step] AS letter, sum(n) FILTER (NOT bad AND NOT gone) AS kept, sum(n) FILTER (bad AND NOT gone) AS removed, sum(n) FILTER (bad AND gone) AS redundant,
  sum(n) FILTER (fails = filter_order[step]) AS unique_fails, sum(n) FILTER (bad AND NOT gone AND good) AS good_lost, sum(n) FILTER (bad AND NOT gone AND toxic) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley FROM r
"""

# ---- ranked search ----


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_RANKED_SQL = f"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{ranked.UPPER}', '{ranked.LOWER}'), '{ranked.TERM}')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
z AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY ALL),
c AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM z),
m AS (SELECT doc_id, 25 + (75 * n * nn) // ll AS m FROM z, c),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{ranked.UPPER}', '{ranked.LOWER}'), '{ranked.TERM}')) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY term, nn),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""

# ---- pipeline ----


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_pieces": op1_pieces,
    "op2_fingerprints": op2_fingerprints,
    "op3_mixing": op3_mixing,
    "op4_chat_rotation": op4_chat_rotation,
    "op6_sharding": op6_sharding,
    "op5_hmm": op5_hmm,
    "op7_neighbours": op7_neighbours,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_quality": op10_quality,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_filter_audit": op12_filter_audit,
    "op13_ranked_search": op13_ranked_search,
    "pipeline": pipeline,
}
ORACLES = {"op3_mixing": _mix_sql(), "op4_chat_rotation": _CHAT_SQL, "op6_sharding": _SHARD_SQL, "op12_filter_audit": _AUDIT_SQL, "op13_ranked_search": _RANKED_SQL}
