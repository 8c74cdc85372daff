"""Registered queries of the training-data operators: thin, whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, chat, decontam, htmltree, linedup, longmatch, merkle, packing, phrases, quality, repair, simhash, toxicity
from ledgerlens.llm.common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", planted), (-7, 1, "assistant", planted)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(convs.unionByName(extra), tokenizer_path("byte_bpe_50k.json")))


def op2_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return simhash.near_duplicates(docs, shingle=4, max_bits=4).select("doc_id", "fingerprint", "component_id")


def op3_rindex_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = longmatch.remove_repeats(table(spark, sf_dir, "documents"))
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return rows.select("doc_id", "n_bytes", lost.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


def op4_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op5_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())
    return rows.select(F.col("id").alias("doc_id"), (F.length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_html_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltree.extract(table(spark, sf_dir, "pages"))


def op7_toxicity_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linedup.dedup(docs, exact_bytes=1).select("doc_id", "removed_lines", F.length("text").cast("long").alias("kept_chars"),
                                      F.sha2("text", 256).alias("kept_sha256"))


def op9_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merkle.with_next(table(spark, sf_dir, "documents"), "doc_id", "text")
    rows = rows.withColumn("edited", merkle.half_edited(F.col("text"), F.col("next_text")))
    for text, out in (("text", "fingerprint"), ("edited", "edited_fingerprint"), ("next_text", "next_fingerprint")):
        rows = merkle.with_fingerprint(rows, text, out)
    return rows.select(
        F.col("id").alias("doc_id"), F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", merkle.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        merkle.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(repair.damage(table(spark, sf_dir, "conversations"))).drop("n_rows")


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_simhash_neardup": op2_simhash_neardup,
    "op3_rindex_dedup": op3_rindex_dedup,
    "op4_quality_knn": op4_quality_knn,
    "op5_bpe_automaton": op5_bpe_automaton,
    "op6_html_tree": op6_html_tree,
    "op7_toxicity_weak": op7_toxicity_weak,
    "op8_line_dedup": op8_line_dedup,
    "op9_merkle_fingerprints": op9_merkle_fingerprints,
    "op10_decontamination": op10_decontamination,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_phrase_mining": op12_phrase_mining,
    "op13_packing": op13_packing,
}

_OP9_TREE = """
  listed_{t} AS (
    SELECT id, {t} AS txt, CASE WHEN {t} = '' THEN '' ELSE list_aggregate(list_transform(string_split({t}, chr(10)), lambda p:
      CASE WHEN p = '' THEN ';' ELSE
        substr(sha256(p), 1, 20) || '=' || list_aggregate(list_transform(
          string_split(regexp_replace(p, '([nr.,;:!?|])([ \\t\\n\\x0B\\f\\r])', '\\1' || chr(1) || '\\2', 'g'), chr(1)),
          lambda c: substr(md5(c), 1, 6)), 'string_agg', ',')
        || CASE WHEN substr(sha256(p), 1, 1) < '4' THEN '|' ELSE ';' END END), 'string_agg', '') END AS body
    FROM rows_),
  bodies_{t} AS (
    SELECT id, txt, coalesce(list_aggregate(list_transform(list_filter(string_split(body, '|'), lambda s: s <> ''),
      lambda s: substr(sha256(s), 1, 20) || ':' || s), 'string_agg', '|'), '') AS body FROM listed_{t}),
  tree_{t} AS (
    SELECT id, sha256(body) || '/' || body AS fp,
      list_distinct(list_filter(string_split(translate(sha256(body) || '/' || body, '/|:;=', ',,,,,'), ','), lambda x: x <> '')) AS nodes
    FROM bodies_{t})"""
_OP9 = ("""
WITH base AS (SELECT doc_id AS id, coalesce(text, '') AS text,
    coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id NULLS FIRST, text),
             first_value(coalesce(text, '')) OVER (ORDER BY doc_id NULLS FIRST, text)) AS next_text FROM documents),
  rows_ AS (SELECT *, substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2) AS edited
    FROM base),"""
    + ",".join(_OP9_TREE.replace("{t}", t).replace("\\\\", "\\") for t in ("text", "edited", "next_text")) + """
SELECT r.id AS doc_id, length(r.text) AS n_chars, sha256(r.edited) AS edited_sha256, a.fp AS fingerprint,
  b.fp AS edited_fingerprint,
  CASE WHEN a.fp = b.fp THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a.nodes, b.nodes)) / (len(a.nodes) + len(b.nodes)) END AS near_edited,
  CASE WHEN a.fp = c.fp THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a.nodes, c.nodes)) / (len(a.nodes) + len(c.nodes)) END AS near_next
FROM rows_ r JOIN tree_text a USING (id) JOIN tree_edited b USING (id) JOIN tree_next_text c USING (id)
""")

_OP1 = r"""
WITH rows_ AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
  escaped AS (SELECT *, replace(replace(replace(role, '\', '\\'), '<turn>', '\<turn>'), '</turn>', '\</turn>') AS r,
    replace(replace(replace(text, '\', '\\'), '<turn>', '\<turn>'), '</turn>', '\</turn>') AS t FROM rows_)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<turn>' || replace(r, chr(10), '\n') || chr(10) || t || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

#: Damage, faults, then cheapest edits row by row from four places in the role grammar (0 start, 1 system, 2 user, 3 assistant);
#: more than one insertion between two rows never pays.  ``done`` holds the repaired lines so far.
_CRC = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({s}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: "
        "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295)")
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_INSERTED = """(SELECT conv_id, i, state, cost, audit, done FROM {t} UNION ALL
    SELECT conv_id, i, CASE state WHEN 2 THEN 3 ELSE 2 END, cost + 3, audit || 'I', list_append(done, CASE state WHEN 2 THEN 'assistant:' ELSE 'user:' END) FROM {t})"""
_OP11 = """
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
  kinds AS (SELECT *, """ + _CRC.replace("{s}", "k") + """ % 20 AS kind FROM keyed),
  damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
      CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM kinds, LATERAL (SELECT unnest(CASE kind WHEN 0 THEN []::INT[] WHEN 3 THEN [1, 2] ELSE [1] END)) AS c(copy)),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
      trim(text, """ + _BLANKS + """) AS ink FROM damaged),
  faults AS (SELECT *, CASE WHEN ink = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(ink, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
      left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM numbered),
  facts AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
      count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
      count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faults GROUP BY conv_id),
  tops AS (
    SELECT conv_id, 0::BIGINT AS i, 0 AS state, 0 AS cost, '' AS audit, []::VARCHAR[] AS done FROM facts
    UNION ALL
    SELECT conv_id, i, state, best.cost, best.audit, best.done FROM (
      SELECT conv_id, i, state, min(struct_pack(cost := cost, audit := audit, done := done)) AS best FROM (
        SELECT t.conv_id, f.i, e.state, t.cost + e.cost AS cost, t.audit || e.letter AS audit,
          CASE e.letter WHEN 'D' THEN t.done WHEN 'K' THEN list_append(t.done, f.role || ':' || f.text)
            ELSE list_append(t.done, CASE t.state WHEN 2 THEN 'assistant:' ELSE 'user:' END || f.text) END AS done
        FROM """ + _INSERTED.replace("{t}", "tops") + """ t JOIN faults f ON f.conv_id IS NOT DISTINCT FROM t.conv_id AND f.i = t.i + 1,
          LATERAL (SELECT t.state, 4, 'D'
            UNION ALL SELECT CASE t.state WHEN 2 THEN 3 ELSE 2 END, 3 + 3 * (f.fault = 'truncated')::INT, 'R' WHERE f.fault NOT IN ('blank', 'duplicate')
            UNION ALL SELECT CASE f.initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, 3 * (f.fault = 'truncated')::INT, 'K'
              WHERE f.fault NOT IN ('blank', 'duplicate') AND (f.initial = 's' AND t.state = 0 OR f.initial = 'u' AND t.state <> 2
                OR f.initial = 'a' AND t.state = 2)) AS e(state, cost, letter))
      GROUP BY conv_id, i, state)),
  ends AS (SELECT t.conv_id, min(struct_pack(cost := cost, audit := audit, done := done)) AS best
    FROM """ + _INSERTED.replace("{t}", "tops") + """ t JOIN facts f ON f.conv_id IS NOT DISTINCT FROM t.conv_id AND f.n = t.i
    WHERE state IN (0, 3) GROUP BY t.conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit,
  sha256(coalesce(array_to_string(best.done, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""

_OP12 = r"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
  pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\n\x0B\x0C\r]')) AS p FROM texts),
  worded AS (SELECT lang, row_number() OVER () AS piece, list_filter(string_split_regex(p, '[ \t]+'), lambda w: w <> '') AS ws FROM pieces),
  words AS (SELECT lang, piece, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w1 FROM worded),
  places AS (SELECT lang, w1, lead(w1, 1) OVER p AS w2, lead(w1, 2) OVER p AS w3, lead(w1, 3) OVER p AS w4, lead(w1, 4) OVER p AS w5
    FROM words WINDOW p AS (PARTITION BY piece ORDER BY i)),
  counts AS MATERIALIZED (
    SELECT lang, 1 AS m, w1 AS phrase, count(*) AS f FROM places GROUP BY ALL
    UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM places WHERE w2 IS NOT NULL GROUP BY ALL
    UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM places WHERE w3 IS NOT NULL GROUP BY ALL
    UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM places WHERE w4 IS NOT NULL GROUP BY ALL
    UNION ALL SELECT lang, 5, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5, count(*) FROM places WHERE w5 IS NOT NULL GROUP BY ALL),
  totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE m = 1 GROUP BY lang),
  found AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM counts WHERE m >= 2 AND f >= 100),
  inside AS (SELECT DISTINCT s.lang, s.phrase FROM (SELECT lang, a, unnest([array_to_string(ws[i:j], ' ')]) AS phrase
      FROM found, LATERAL (SELECT unnest(range(1, m)) AS i), LATERAL (SELECT unnest(range(i + 1, m + 1)) AS j) WHERE j - i + 1 < m) s
    JOIN found f ON f.lang = s.lang AND f.phrase = s.phrase WHERE 100 * s.a >= 100 * f.a),
  kept AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = f.lang AND i.phrase = f.phrase)),
  cuts AS MATERIALIZED (SELECT kept.lang, phrase, a, n, k, kept.lang || chr(0) || array_to_string(ws[1:k], ' ') AS p1,
      kept.lang || chr(0) || array_to_string(ws[k + 1:m], ' ') AS p2
    FROM kept JOIN totals t ON t.lang = kept.lang, LATERAL (SELECT unnest(range(1, m)) AS k)),
  keyed AS MATERIALIZED (SELECT lang || chr(0) || phrase AS p, f FROM counts WHERE f >= 100),
  lefts AS MATERIALIZED (SELECT cuts.*, f AS l FROM cuts JOIN keyed ON p = p1),
  scored AS (SELECT lefts.*, f AS r, (1000::HUGEINT * a * n // (l::HUGEINT * f))::BIGINT AS score FROM lefts JOIN keyed ON p = p2),
  weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
  ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM weakest)
SELECT * FROM ranked WHERE rank <= 2000
"""

#: DuckDB SQL of the queries that SQL can express on whole tables.
ORACLES: dict[str, str] = {
    "op1_chat_format": _OP1,
    "op9_merkle_fingerprints": _OP9,
    "op11_conversation_repair": _OP11,
    "op12_phrase_mining": _OP12,
}
