"""Registered queries of the training-data operators and their DuckDB text."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marktwert.llm import common as C
from marktwert.llm import (chat_format, conversation_repair, decontaminate, html_extract, language_id, line_dedup,
                           mixing, near_dedup, spotsigs, substring_dedup, token_alignment, toxicity, warc)
from marktwert.session import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_register
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with repeated lines and paragraphs cut out; the removed spans
    as ``start-end`` pairs of the original text."""
    out = substring_dedup.dedup(spark, C.documents(spark, sf_dir).select("doc_id", "text"))
    spans = F.transform("removed", lambda s: F.concat_ws("-", s["start"], s["end"]))
    cut = F.aggregate("removed", F.lit(0), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", F.size("removed").cast("long").alias("n_removed"),
                      cut.cast("long").alias("chars_removed"), F.concat_ws(",", spans).alias("removed_spans"), "text")


@_register
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir).select("doc_id", "text")
    labels = C.documents(spark, sf_dir, "labels").select("doc_id", "toxic")
    field = toxicity.train(spark, docs.where(~C.held_out("doc_id")), labels)
    offsets = F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"]))
    return toxicity.tag(spark, docs, field).select(
        "doc_id", C.held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"), F.concat_ws(",", offsets).alias("toxic_spans"))


@_register
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.neighbours(spark, C.documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@_register
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and number -1, whose texts hold control strings."""
    rows = C.documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)],
                                "conv_id long, turn long, role string, text string")
    out = chat_format.read_back(chat_format.format_conversations(rows.union(own)))
    return out.select("conv_id", "n_turns", F.sha2(F.encode("said", "utf-8"), 256).alias("turns_sha256"),
                      F.length("learned").cast("long").alias("loss_chars"),
                      F.sha2(F.encode("learned", "utf-8"), 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"))


@_register
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(spark, C.documents(spark, sf_dir).select("doc_id", "text"),
                                      C.documents(spark, sf_dir, "benchmark"))
    items = F.array_sort("_items")
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"),
                      F.size(items).cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
                      (F.col("_n_hit") > 0).alias("contaminated"))


@_register
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write ``pages`` as archives, read them back: responses with payload,
    revisits by their headers alone."""
    path = shared_path(spark, "llm", f"warc-{uuid.uuid4().hex}")
    warc.write(C.documents(spark, sf_dir, "pages"), path)
    response = warc.read(spark, path).where("record_type = 'response'").withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    revisit = warc.read(spark, path, payload=False).where("record_type = 'revisit'").withColumn(
        "digest", F.regexp_replace("payload_digest", "^sha256:", ""))
    return response.unionByName(revisit).select(
        warc.page_number("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
        "record_type", warc.page_number("refers_to").alias("refers_to"))


@_register
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.near_duplicates(spark, C.documents(spark, sf_dir), shingle=2)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id",
                      F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


@_register
def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.main_text(spark, C.documents(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


@_register
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir).select("doc_id", "source", "text")
    return mixing.mix(spark, docs).select("doc_id", "source", "size", "source_size", "target", "taken")


@_register
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    model = language_id.train(spark, docs.where(~C.held_out("doc_id")))
    out = language_id.identify(spark, docs.select("doc_id", "text"), model)
    return out.select("doc_id", C.held_out("doc_id").alias("held_out"), "lang_pred", "score", "languages")


@_register
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep bitmaps of all documents (runs of kept lines) and what they keep."""
    out = line_dedup.keep_bitmaps(spark, C.documents(spark, sf_dir).select("doc_id", "text"))
    runs = F.transform("keep", lambda r: F.concat_ws("+", r["start"], r["length"]))
    return out.select("doc_id", "n_lines", "n_dropped",
                      F.sha2(F.encode(line_dedup.kept_text(), "utf-8"), 256).alias("kept_sha256"),
                      F.concat_ws(",", runs).alias("keep"))


@_register
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation after planted damage."""
    rows = C.documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = conversation_repair.repair(conversation_repair.damage(rows))
    said = F.transform("repaired", lambda r: F.concat_ws(":", r["role"], r["text"]))
    found = fixed.select(F.col("conv_id").alias("_conv"), *conversation_repair.COUNTS[1:], "audit",
                         F.concat_ws("\n", said).alias("_said"))
    out = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in conversation_repair.COUNTS[1:]],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.sha2(F.encode(F.coalesce("_said", F.lit("")), "utf-8"), 256).alias("repaired_sha256"))


@_register
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_alignment.alignment(spark, C.documents(spark, sf_dir).select("doc_id", "text"))
    return out.withColumnRenamed("groups", "groups_sha256")


@_register
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _escaped(column: str) -> str:
    """DuckDB form of ``chat_format.escape``."""
    out = f"replace({column}, '\\', '\\\\')"
    for c in chat_format.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


ORACLE["op4_chat_format"] = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
        coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS learned,
        sum(length({_escaped('role')}) + length({_escaped('text')})
            + {len(chat_format.START) + len(chat_format.END) + 2}) AS formatted_chars
      FROM c GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256,
       CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""

ORACLE["op5_decontamination"] = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
             regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item,
        regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bi AS (SELECT item, ws, least(10, len(ws)) AS k, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i
       FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(ws[i:i + k - 1], ' ') AS w FROM bi),
di AS (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i
       FROM d, (SELECT DISTINCT k FROM win) WHERE len(ws) >= k),
hit AS (SELECT di.r, di.i, di.k, win.item FROM di JOIN win
        ON win.k = di.k AND win.w = array_to_string(di.ws[di.i:di.i + di.k - 1], ' ')),
n AS (SELECT r, count(DISTINCT p) AS n_hit
      FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(it.items, '')) AS items_sha256,
       coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN it USING (r)
"""

ORACLE["op6_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT page_id, n, digest, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM f
"""

ORACLE["op7_near_dedup"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r,
             regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, r, list_distinct(CASE WHEN len(ws) >= 2
             THEN list_transform(range(1, len(ws)), lambda i: concat(ws[i], ' ', ws[i + 1]))
             WHEN len(ws) = 1 THEN ws ELSE [] END) AS g FROM d),
e AS (SELECT doc_id, r, len(g) AS n, unnest(g) AS x FROM s),
c AS (SELECT a.r AS a, b.r AS b FROM e a JOIN e b ON a.x = b.x AND a.r < b.r
      WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM c UNION SELECT b, a FROM c),
walk AS (SELECT r AS a, r AS b FROM d UNION SELECT w.a, l.b FROM walk w JOIN l ON w.b = l.a),
m AS (SELECT w.a AS r, min(d.doc_id) AS component_id FROM walk w JOIN d ON d.r = w.b GROUP BY w.a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM s JOIN m USING (r)
"""

ORACLE["op9_mixing"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, md5('1|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key,
             CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size,
        [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight FROM s),
t AS (SELECT sum(source_size) AS total FROM s),
fill AS (SELECT 0 AS step, CAST(total AS HUGEINT) AS remaining, (SELECT CAST(sum(weight) AS HUGEINT) FROM w) AS share FROM t
  UNION ALL
  SELECT step + 1,
    (SELECT total FROM t) - coalesce((SELECT sum(3 * source_size) FROM w WHERE 3 * source_size * share < weight * remaining), 0),
    (SELECT sum(weight) FROM w WHERE 3 * source_size * share >= weight * remaining)
  FROM fill WHERE step < 60 AND share > 0
    AND (SELECT sum(weight) FROM w WHERE 3 * source_size * share >= weight * remaining) < share),
f AS (SELECT remaining, share FROM fill ORDER BY step DESC LIMIT 1),
g AS (SELECT source, source_size, 3 * source_size * share < weight * remaining AS capped, weight, remaining, share FROM w, f),
h AS (SELECT source, source_size,
        CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE)
             ELSE CAST(weight AS DOUBLE) * CAST(remaining AS DOUBLE) / CAST(share AS DOUBLE) END AS target,
        CASE WHEN capped THEN CAST(3 * source_size AS HUGEINT) ELSE weight * remaining // share END AS budget FROM g),
k AS (SELECT d.doc_id, d.source, d.size, h.source_size, h.target,
        CASE WHEN h.source_size > 0 THEN h.budget // h.source_size ELSE 0 END AS epochs,
        CASE WHEN h.source_size > 0 THEN h.budget % h.source_size ELSE 0 END AS rest,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, source, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, rest - (upto - size))) AS BIGINT) AS taken FROM k
"""

ORACLE["op11_line_dedup"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, r, i, ls[i] AS line,
        translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM (SELECT doc_id, r, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
k AS (SELECT key, max(doc_id) AS top FROM l WHERE length(key) >= 20
      GROUP BY key HAVING count(DISTINCT doc_id) + max(CAST(doc_id IS NULL AS INT)) >= 3),
m AS (SELECT l.*, k.key IS NOT NULL AND l.doc_id IS DISTINCT FROM k.top AS lost FROM l LEFT JOIN k USING (key)),
runs AS (SELECT r, min(i) - 1 AS start, count(*) AS n
         FROM (SELECT r, i, i - row_number() OVER (PARTITION BY r ORDER BY i) AS g FROM m WHERE NOT lost) GROUP BY r, g)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(lost AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256,
       coalesce((SELECT string_agg(start || '+' || n, ',' ORDER BY start) FROM runs WHERE runs.r = m.r), '') AS keep
FROM m GROUP BY doc_id, r
"""

ORACLE["op12_conversation_repair"] = r"""
WITH RECURSIVE
c AS (SELECT conv_id, turn, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, coalesce(role, ' ') AS role,
        coalesce(text, ' ') AS text,
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
k AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
          list_transform(range(1, length(key) + 1), lambda j: CAST(unicode(key[j]) AS BIGINT))),
          lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
            lambda x, j: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS kind FROM c),
d AS (SELECT g, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM k),
o AS (SELECT g, turn, role, text, left(role, 1) AS initial,
        row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
e AS (SELECT *, row_number() OVER (PARTITION BY g, role, text ORDER BY i) AS nth FROM o),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN nth > 1 THEN 'd'
          WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
        lag(initial) OVER (PARTITION BY g ORDER BY i) || initial AS step FROM e),
n AS (SELECT g, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
        count(*) FILTER (fault = 't') AS truncated,
        count(*) FILTER (step IS NOT NULL AND step NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY g),
ins(s, t, letters, said) AS (VALUES (0, 0, '', []), (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']),
        (1, 1, '', []), (1, 2, 'I', ['user:']), (1, 3, 'II', ['user:', 'assistant:']),
        (2, 2, '', []), (2, 3, 'I', ['assistant:']), (3, 3, '', []), (3, 2, 'I', ['user:'])),
ed(edit, s, initial, role, t, price) AS (VALUES ('D', 0, '', '', 0, 3), ('D', 1, '', '', 1, 3), ('D', 2, '', '', 2, 3),
        ('D', 3, '', '', 3, 3), ('K', 0, 's', '', 1, 0), ('K', 0, 'u', '', 2, 0), ('K', 1, 'u', '', 2, 0), ('K', 2, 'a', '', 3, 0),
        ('K', 3, 'u', '', 2, 0), ('R', 0, '', 'user', 2, 2), ('R', 1, '', 'user', 2, 2), ('R', 2, '', 'assistant', 3, 2),
        ('R', 3, '', 'user', 2, 2)),
dp AS (SELECT n.g, CAST(0 AS BIGINT) AS i, ins.t AS s, CAST(2 * length(letters) AS BIGINT) AS cost, letters AS audit,
         CAST(ins.said AS VARCHAR[]) AS said FROM n, ins WHERE ins.s = 0
  UNION ALL
  SELECT g, i, s, cost, audit, said FROM (
    SELECT dp.g, f.i, ins.t AS s,
           dp.cost + ed.price + CASE WHEN ed.edit <> 'D' AND f.fault = 't' THEN 1 ELSE 0 END + 2 * length(ins.letters) AS cost,
           dp.audit || ed.edit || ins.letters AS audit,
           dp.said || CASE ed.edit WHEN 'D' THEN CAST([] AS VARCHAR[]) WHEN 'K' THEN [f.role || ':' || f.text]
                      ELSE [ed.role || ':' || f.text] END || CAST(ins.said AS VARCHAR[]) AS said
    FROM dp JOIN f ON f.g = dp.g AND f.i = dp.i + 1
    JOIN ed ON ed.s = dp.s AND (ed.edit = 'D' OR (f.fault NOT IN ('b', 'd') AND (ed.edit = 'R' OR ed.initial = f.initial)))
    JOIN ins ON ins.s = ed.t)
  QUALIFY row_number() OVER (PARTITION BY g, i, s ORDER BY cost, audit) = 1),
best AS (SELECT dp.g, cost, audit, said FROM dp JOIN n ON n.g = dp.g AND n.n = dp.i WHERE s IN (0, 3)
         QUALIFY row_number() OVER (PARTITION BY dp.g ORDER BY cost, audit) = 1),
ids AS (SELECT DISTINCT conv_id, g FROM c)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN n USING (g) LEFT JOIN best USING (g)
"""
