"""Registered queries of the operators, and SQL where it can express one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.llm import bpe, chat_parts, decontaminate, pages_cut, periodic, pii, quality_fm, quality_rules, secrets, simhash, spelling, suffix_dedup, warc

#: The vocabulary file of op9 among the public tokenizers of the box.
TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"), words=4, radius=4)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op8_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_cut.extract(_table(spark, sf_dir, "pages"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: The conversation that op11 adds to the table: its texts consist of another template's control strings.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], rows.schema)
    turns = chat_parts.format_turns(chat_parts.text_parts(rows.unionByName(more)))
    return chat_parts.digests(chat_parts.read_back(turns))


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one document in ten repeats a stretch of its words up to its end, as op12's contract says."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    chosen = docs.select("doc_id", "text", h.alias("h"))
    listed = chosen.filter("h % 10 = 0").select("doc_id", words.alias("w"), F.expr("h div 10").alias("g"))
    cut = listed.select("*", F.size("w").alias("n")).filter("n > 0").select("doc_id", "w", "n", "g", F.expr("cast(g % n as int)").alias("a"))
    period = cut.select("*", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)").alias("p"))
    tail = "slice(flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)"
    return chosen.filter(r"h % 10 <> 0 or coalesce(text, '') not rlike '[^\\x20\\x09-\\x0D]'").select("doc_id", "text").unionByName(period.select("doc_id", F.expr(f"array_join(concat(slice(w, 1, a), {tail}), ' ')").alias("text")))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(with_repeats(_table(spark, sf_dir, "documents")))
    # greatest length / period by cross products; runs are in order of start and period, the first of equals stays
    best = F.expr("aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), (m, r) -> if(m is null or r.length * m.period > m.length * r.period, r, m))")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    digests = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.concat(lines, F.when(F.size("runs") > 0, "\n").otherwise("")).alias("lines"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return digests.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), "collapsed_sha256")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_quality_fm": op4_quality_fm,
    "op5_secrets": op5_secrets,
    "op6_simhash": op6_simhash,
    "op7_pii": op7_pii,
    "op8_extract": op8_extract,
    "op9_bpe": op9_bpe,
    "op10_decontaminate": op10_decontaminate,
    "op11_chat": op11_chat,
    "op12_periodic": op12_periodic,
    "op13_spelling": op13_spelling,
}

OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
windows AS (
  SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
named AS (SELECT doc_id, i, [ws[i], ws[i + 1], ws[i + 2]] AS g FROM windows),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM named),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (
  SELECT w.doc_id, w.source, len(ws)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id)),
j AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 2 * n_words AS strict_failed FROM c),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed OR strict_failed) AS f FROM j GROUP BY source),
s AS (SELECT count(*) AS h, sum(n)::DOUBLE AS n, sum(f)::DOUBLE AS f, sum(n::DOUBLE * n) AS nn, sum(f::DOUBLE * f / n) AS ff FROM h),
r AS (SELECT f / n AS m, CASE WHEN f > 0 AND f < n AND n - nn / n - (h - 1) > 0
  THEN ((ff - f * f / n) / (f / n * (1 - f / n)) - (h - 1)) / (n - nn / n - (h - 1)) ELSE 0 END AS rho FROM s),
k AS (SELECT m, CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 1.0), 10000.0) ELSE 10000.0 END AS k FROM r),
bad AS (SELECT source, (f + m * k) / (n + k) * 100 >= 10 AS bad FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (bad AND strict_failed) AS kept
FROM j JOIN bad ON j.source IS NOT DISTINCT FROM bad.source
"""

OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM m
"""

#: The formatted length counts the three marks of a turn and one backslash for each control string.
OP11_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(r) + length(t) + length('<|turn|><|says|><|end|>')
    + len(regexp_extract_all(r, '<\\*(\||s>|/s>|<SYS>>|</SYS>>)|\[\\*(INST\]|/INST\])'))
    + len(regexp_extract_all(t, '<\\*(\||s>|/s>|<SYS>>|</SYS>>)|\[\\*(INST\]|/INST\])')) AS chars FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLES = {"op1_warc": OP1_SQL, "op3_quality_rules": OP3_SQL, "op11_chat": OP11_SQL}
