"""Queries over the corpus tables, one for each operator, and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from barspan.llm.chat import END, SEP, TURN, chains, parse_turns, reply_trees, unescape
from barspan.llm.common import table
from barspan.llm.line_dedup import line_dedup
from barspan.llm.maxent_lm import lm_scores
from barspan.llm.mixing import mixing_rates, mixing_sample
from barspan.llm.ngram_join import ngram_join
from barspan.llm.packing import best_fit_packing
from barspan.llm.pivot_dedup import pivot_dedup
from barspan.llm.pu_quality import quality_scores
from barspan.llm.quality_rules import RULES, STOP_WORDS, quality_rules
from barspan.llm.repair import damage, repair_report
from barspan.llm.token_cache import token_counts
from barspan.llm.warc import responses_of_pages, warc_derivatives
from barspan.llm.whitening import whiten


def vocabulary(name: str) -> str:
    """Where the installed package of public vocabularies keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ngram_join(spark, sf_dir):
    return ngram_join(table(spark, sf_dir, "documents"))


#: Pairs that share a shingle, by an inverted index, and components by recursion.
OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos, len(ws) AS n FROM w),
g AS (SELECT doc_id, pos, n, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS g5
      FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
s AS (SELECT DISTINCT doc_id, g5 AS g FROM g WHERE g5 IS NOT NULL UNION SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS src, y.doc_id AS dst, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT src, dst FROM b JOIN c x ON x.doc_id = src JOIN c y ON y.doc_id = dst WHERE 100 * i >= 80 * (x.n + y.n - i)),
r AS (SELECT src AS doc_id, src AS low FROM l UNION SELECT l.dst, r.low FROM r JOIN l ON l.src = r.doc_id),
m AS (SELECT doc_id, min(low) AS low FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(m.low, d.doc_id) AS component_id
FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
"""


def op3_warc_derivatives(spark, sf_dir):
    derived = warc_derivatives(responses_of_pages(table(spark, sf_dir, "pages")))
    h = lambda name: F.col("headers")[name]
    return derived.select(
        "source_id", "warc_type", "record_id", h("WARC-Refers-To").alias("refers_to"), h("WARC-Target-URI").alias("target_uri"), h("WARC-Date").alias("warc_date"),
        h("X-Source-Content-Type").alias("source_content_type"), h("WARC-Block-Digest").alias("block_digest"), h("Content-Length").cast("long").alias("content_length"), "block",
    )


def op4_mixing(spark, sf_dir):
    return mixing_sample(*mixing_rates(table(spark, sf_dir, "documents")))


def op5_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_best_fit_packing(spark, sf_dir):
    return best_fit_packing(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_line_dedup(spark, sf_dir):
    kept = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), digest.alias("kept_sha256"))


OP7_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, count(DISTINCT doc_id) AS n, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (n IS NOT NULL AND doc_id <> top) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (n IS NULL OR doc_id = top), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY doc_id
"""


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of what the formatted conversations say, taken from them alone."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for batch in batches:
        rows = []
        for conv_id, formatted, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            turns = parse_turns(formatted)
            loss = "".join(unescape(formatted[s["start"] : s["stop"]]) for s in spans)
            rows.append((conv_id, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(formatted)))
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(names))


def op8_reply_trees(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    every = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    formatted = reply_trees(chains(every), branches=1)
    return formatted.select("tree_id", "formatted", "loss_spans").mapInArrow(
        _read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def _inserted(c: str) -> str:
    """Backslashes that the template puts into a text: one for each of its control strings."""
    controls = (r"\\\\", r"<\|[^|<>\n]{1,40}\|>", "</?s>", "<</?SYS>>", r"\[/?INST\]")
    return " + ".join(f"len(regexp_extract_all({c}, '{x}'))" for x in controls)


_MARK_CHARS = len(TURN + SEP + END)
OP8_SQL = f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({_MARK_CHARS} + length(role) + length(text) + {_inserted('role')} + {_inserted('text')}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


def op9_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents")).drop("failed_rules")


def _rule_sql(r) -> str:
    sign = ">" if r.above else "<"
    return f"(100 * {r.part} {sign} {r.percent} * {r.whole} AND n_words >= {r.least_words})"


OP9_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
      FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
win AS (SELECT doc_id, pos, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o
        || ' ' || lead(word, 4) OVER o || ' ' || lead(word, 5) OVER o || ' ' || lead(word, 6) OVER o || ' ' || lead(word, 7) OVER o AS k
        FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
rep AS (SELECT doc_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win WHERE k IS NOT NULL) WHERE c >= 2),
cov AS (SELECT doc_id, count(DISTINCT pos + o) AS n_repeat_words FROM rep, range(8) AS t(o) GROUP BY doc_id),
wc AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars,
       count(*) FILTER (word IN ({", ".join(f"'{x}'" for x in STOP_WORDS)})) AS n_stop_words FROM w GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
lc AS (SELECT doc_id, count(*) AS n_text_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
       count(*) FILTER (regexp_matches(line, '^[\x20\x09-\x0D]*[-*•]')) AS n_bullet_lines,
       count(*) FILTER (regexp_matches(line, '(\.\.\.|…)[\x20\x09-\x0D]*$')) AS n_ellipsis_lines
       FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
      length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
      coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_stop_words, 0) AS n_stop_words,
      coalesce(n_text_lines, 0) AS n_text_lines, coalesce(n_bullet_lines, 0) AS n_bullet_lines, coalesce(n_ellipsis_lines, 0) AS n_ellipsis_lines
      FROM d LEFT JOIN wc ON d.doc_id = wc.doc_id LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN lc ON d.doc_id = lc.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND NOT ({" OR ".join(map(_rule_sql, RULES))}) AS kept FROM b
"""

def op10_pivot_dedup(spark, sf_dir):
    return pivot_dedup(table(spark, sf_dir, "embeddings"))


#: Cosines of all pairs with equal labels, and components by recursion.
OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
u AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
l AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0
      WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
r AS (SELECT src AS vec_id, src AS low FROM l UNION SELECT l.dst, r.low FROM r JOIN l ON l.src = r.vec_id),
c AS (SELECT vec_id, min(low) AS low FROM r GROUP BY vec_id),
n AS (SELECT src AS vec_id, count(*) AS n_links FROM l GROUP BY src)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, coalesce(c.low, e.vec_id) AS component_id, e.vec_id = coalesce(c.low, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON e.vec_id = n.vec_id LEFT JOIN c ON e.vec_id = c.vec_id
"""


def op11_structure_repair(spark, sf_dir):
    given = table(spark, sf_dir, "conversations")
    report = repair_report(damage(given), "place").withColumnRenamed("conv_id", "of")
    every = given.select("conv_id").distinct().join(report, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    none = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return every.select("conv_id", *[F.coalesce(c, none.get(c, F.lit(0).cast("long"))).alias(c) for c in report.columns if c != "of"])


#: Edits by dynamic programming over rows, the state of least (cost, audit) carried by recursion; crc32 bit by bit.
OP11_SQL = r"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS k FROM conversations),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)),
        lambda s, b: list_reduce(list_prepend(xor(s, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) % 20 AS code FROM o),
g AS (SELECT conv_id, turn, role AS was, text AS said, copy, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
        CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM h, range(2) AS t(copy) WHERE code <> 0 AND (copy = 0 OR code = 3)),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, was, said, copy) AS n FROM g),
f AS (SELECT conv_id, turn, n, role, text, left(role, 1) AS x,
        CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'd'
             WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault,
        concat(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n), left(role, 1)) AS two FROM p),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
        count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (n > 1 AND two NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
-- Least (cost, audit) of each state before the next row, with the turns that may be put in there: q0 nothing, qs, qu, qa.
e AS (SELECT conv_id, 1 AS n, {'c': 0, 'a': ''} AS q0, {'c': 1000000000, 'a': ''} AS qs, {'c': 2, 'a': 'I'} AS qu, {'c': 4, 'a': 'II'} AS qa FROM c
      UNION ALL
      SELECT conv_id, n, q0, qs, qu2, least(qa2, {'c': qu2.c + 2, 'a': qu2.a || 'I'}) FROM (
        SELECT conv_id, n, q0, qs, qa1, qa1 AS qa2, least(qu1, {'c': q0.c + 2, 'a': q0.a || 'I'}, {'c': qs.c + 2, 'a': qs.a || 'I'}, {'c': qa1.c + 2, 'a': qa1.a || 'I'}) AS qu2 FROM (
          SELECT e.conv_id, e.n + 1 AS n, {'c': q0.c + 3, 'a': q0.a || 'D'} AS q0,
            least({'c': qs.c + 3, 'a': qs.a || 'D'}, {'c': q0.c + k + CASE WHEN x = 's' THEN 0 ELSE 1000000000 END, 'a': q0.a || 'K'}) AS qs,
            least({'c': qu.c + 3, 'a': qu.a || 'D'}, {'c': q0.c + k + u, 'a': q0.a || ue}, {'c': qs.c + k + u, 'a': qs.a || ue}, {'c': qa.c + k + u, 'a': qa.a || ue}) AS qu1,
            least({'c': qa.c + 3, 'a': qa.a || 'D'}, {'c': qu.c + k + v, 'a': qu.a || ve}) AS qa1
          FROM e JOIN (SELECT conv_id, n, x, CASE fault WHEN 't' THEN 1 WHEN '' THEN 0 ELSE 1000000000 END AS k, CASE WHEN x = 'u' THEN 0 ELSE 2 END AS u, CASE WHEN x = 'a' THEN 0 ELSE 2 END AS v,
                CASE WHEN x = 'u' THEN 'K' ELSE 'R' END AS ue, CASE WHEN x = 'a' THEN 'K' ELSE 'R' END AS ve FROM f) r
          ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.n = e.n))),
b AS (SELECT c.*, least(q0, qa) AS best FROM c JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id AND e.n = c.n + 1),
a AS (SELECT conv_id, i, substr(best.a, i, 1) AS edit FROM (SELECT conv_id, best, unnest(range(1, length(best.a) + 1)) AS i FROM b)),
y AS (SELECT a.conv_id, i, edit, count(*) FILTER (edit <> 'I') OVER w AS n, count(*) FILTER (edit <> 'D') OVER w AS k FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
z AS (SELECT y.conv_id, i, y.k, edit, f.role, f.text, max(CASE WHEN y.k = 1 AND edit = 'K' AND f.x = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY y.conv_id) AS s
      FROM y LEFT JOIN f ON edit <> 'I' AND f.conv_id IS NOT DISTINCT FROM y.conv_id AND f.n = y.n WHERE edit <> 'D'),
t AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (k - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY i) AS told, count(*) AS turns FROM z GROUP BY conv_id)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(told, '')) AS repaired_sha256, coalesce(turns, 0) AS repaired_turns
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM d.conv_id
"""


def op12_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_lm_scoring(spark, sf_dir):
    return lm_scores(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_ngram_join": op2_ngram_join,
    "op3_warc_derivatives": op3_warc_derivatives,
    "op4_mixing": op4_mixing,
    "op5_token_counts": op5_token_counts,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_line_dedup": op7_line_dedup,
    "op8_reply_trees": op8_reply_trees,
    "op9_quality_rules": op9_quality_rules,
    "op10_pivot_dedup": op10_pivot_dedup,
    "op11_structure_repair": op11_structure_repair,
    "op12_whitening": op12_whitening,
    "op13_lm_scoring": op13_lm_scoring,
}
SQL = {
    "op2_ngram_join": OP2_SQL,
    "op7_line_dedup": OP7_SQL,
    "op8_reply_trees": OP8_SQL,
    "op9_quality_rules": OP9_SQL,
    "op10_pivot_dedup": OP10_SQL,
    "op11_structure_repair": OP11_SQL,
}
