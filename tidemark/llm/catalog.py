"""The corpus queries, one per operator, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '~')) AS key FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(rank % 3 + 1)::INTEGER]::DOUBLE AS w, 2 * source_size AS cap FROM s),
l AS (SELECT *, 1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS pool, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS rest
  FROM w WINDOW o AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT pool, rest FROM l WHERE cap * rest > pool * w ORDER BY cap / w, rank LIMIT 1),
t AS (SELECT source, source_size::BIGINT AS source_size, CASE WHEN f.pool IS NULL THEN cap ELSE least(cap, f.pool * w / f.rest) END AS target
  FROM w LEFT JOIN f ON true),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
 CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END::BIGINT AS taken
FROM p"""


@query("op1_mix_sources", MIX_SQL)
def op1_mix_sources(spark, folder):
    from tidemark.llm.mixing import mix

    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
r AS (SELECT doc_id, g.s, row_number() OVER (PARTITION BY doc_id ORDER BY f.c, g.s) AS pos, n.n
  FROM g JOIN n USING (doc_id) JOIN (SELECT s, count(*) AS c FROM g GROUP BY s) f USING (s)),
p AS (SELECT doc_id, s, n FROM r WHERE pos <= n - ceil(0.75 * n) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.s = b.s AND a.doc_id < b.doc_id
  WHERE 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)),
e AS (SELECT a, b FROM c JOIN g x ON x.doc_id = a JOIN g y ON y.doc_id = b AND y.s = x.s GROUP BY a, b, na, nb
  HAVING 100 * count(*) >= 75 * (na + nb - count(*))),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS id, doc_id AS root FROM n UNION SELECT k.b, reach.root FROM reach JOIN both_ways k ON k.a = reach.id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.root, w.doc_id)::BIGINT AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT id, min(root) AS root FROM reach GROUP BY id) m ON m.id = w.doc_id"""


@query("op4_ngram_jaccard", JACCARD_SQL)
def op4_ngram_jaccard(spark, folder):
    from tidemark.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, folder, "documents"))


LEAKS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS k, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS s
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM b WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks WHERE len(ws) >= k)),
h AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.k = bw.k),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""


@query("op5_decontaminate", LEAKS_SQL)
def op5_decontaminate(spark, folder):
    from tidemark.llm.decontaminate import overlap

    return overlap(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("spans")


@query("op9_shard_packing")
def op9_shard_packing(spark, folder):
    from tidemark.llm.sharding import pack

    rows = pack(table(spark, folder, "documents"))
    return rows.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


@query("op6_toxicity_crf")
def op6_toxicity_crf(spark, folder):
    from tidemark.llm.toxicity import toxicity

    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels")).drop("spans")


NEAREST_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""


@query("op7_nearest_vectors", NEAREST_SQL)
def op7_nearest_vectors(spark, folder):
    from tidemark.llm.nearest import EVERY, nearest

    vectors = table(spark, folder, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


@query("op10_quality_bytes")
def op10_quality_bytes(spark, folder):
    from tidemark.llm.quality import quality

    return quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def _licence_sql() -> str:
    from tidemark.llm.licenses import licence_sql

    return licence_sql()


@query("op2_license_scan", _licence_sql())
def op2_license_scan(spark, folder):
    from tidemark.llm.licenses import licence_scan

    rows = licence_scan(table(spark, folder, "documents"))
    return rows.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


def _lines_sql() -> str:
    from tidemark.llm.lines import LINES_SQL

    return LINES_SQL


@query("op3_line_dedup", _lines_sql())
def op3_line_dedup(spark, folder):
    from tidemark.llm.lines import line_report

    return line_report(table(spark, folder, "documents"))


@query("op8_secret_scan")
def op8_secret_scan(spark, folder):
    from tidemark.llm.secrets import secret_scan

    rows = secret_scan(table(spark, folder, "documents").withColumn("path", F.col("source")))
    return rows.select("doc_id", "place", "nth", F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("n_chars"), "score", "secret")


REPAIR_SQL = r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (SELECT *, xor(list_reduce(list_transform(string_split(key, ''), lambda c: ord(c)::BIGINT), lambda h, b:
  list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(h, b)), 4294967295::BIGINT), 4294967295) % 20 AS kind FROM k),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM d),
f AS (SELECT *, rpad(role, 1, ' ')[1] AS init, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
  WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n
  FROM (SELECT *, lag(init) OVER (PARTITION BY conv_id ORDER BY pos) || init AS pair FROM f) GROUP BY conv_id),
ins(s, t, cost, letters, added) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']),
  (3, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']), (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])),
turns(s, init, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
walk AS (SELECT conv_id, 0::BIGINT AS pos, 0 AS s, 0 AS cost, '' AS audit, []::VARCHAR[] AS kept FROM facts
 UNION ALL
 SELECT conv_id, pos, s, cost, audit, kept FROM (
  SELECT w.conv_id, f.pos, e.t AS s, w.cost + i.cost + e.cost AS cost, w.audit || i.letters || e.letter AS audit, w.kept || i.added || e.made AS kept,
   row_number() OVER (PARTITION BY w.conv_id, e.t ORDER BY w.cost + i.cost + e.cost, w.audit || i.letters || e.letter) AS best
  FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos + 1 JOIN ins i ON i.s = w.s,
  LATERAL (SELECT i.t AS t, 2 AS cost, 'D' AS letter, []::VARCHAR[] AS made
   UNION ALL SELECT m.t, CASE WHEN f.fault = 'truncated' THEN 5 ELSE 0 END, 'K', [f.role || ':' || f.text] FROM turns m WHERE m.s = i.t AND m.init = f.init AND f.fault NOT IN ('blank', 'duplicate')
   UNION ALL SELECT m.t, CASE WHEN f.fault = 'truncated' THEN 6 ELSE 1 END, 'R', [CASE m.init WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.text] FROM turns m
    WHERE m.s = i.t AND m.init <> 's' AND f.fault NOT IN ('blank', 'duplicate')) e)
 WHERE best = 1),
done AS (SELECT w.conv_id, w.cost + i.cost AS cost, w.audit || i.letters AS audit, w.kept || i.added AS kept,
  row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + i.cost, w.audit || i.letters) AS best
  FROM walk w JOIN facts ON facts.conv_id IS NOT DISTINCT FROM w.conv_id AND facts.n = w.pos JOIN ins i ON i.s = w.s AND i.t IN (0, 3))
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
 coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(kept, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM c.conv_id AND done.best = 1"""


@query("op11_conversation_repair", REPAIR_SQL)
def op11_conversation_repair(spark, folder):
    from tidemark.llm.conversations import damaged, repair

    rows = table(spark, folder, "conversations")
    lines = F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
    return repair(damaged(rows), rows).withColumn("repaired_sha256", F.sha2(F.array_join(lines, "\n"), 256)).drop("repaired")


@query("op13_suffix_dedup")
def op13_suffix_dedup(spark, folder):
    from tidemark.llm.suffixes import suffix_dedup

    rows = suffix_dedup(table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


COLLOCATION_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS s(k))),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 10),
h AS MATERIALIZED (SELECT lang, phrase, a, cut, lang || '/' || array_to_string(ws[1:cut], ' ') AS head, lang || '/' || array_to_string(ws[cut + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
q AS MATERIALIZED (SELECT lang || '/' || phrase AS key, a FROM f WHERE k < 3),
s AS MATERIALIZED (SELECT lang, phrase, h.a, x.a AS l, y.a AS r, (1000000 * h.a * h.a) // (x.a * y.a) AS score, cut FROM h JOIN q x ON x.key = head JOIN q y ON y.key = tail),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, array_to_string(ws[pos:pos + 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest([1, 2]) AS pos FROM c WHERE k = 3) GROUP BY ALL),
r AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM b LEFT JOIN i USING (lang, phrase) WHERE i.longer IS NULL OR 100 * i.longer < 50 * a)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM r JOIN n USING (lang) WHERE rank <= 2000"""


@query("op12_phrase_collocations", COLLOCATION_SQL)
def op12_phrase_collocations(spark, folder):
    from tidemark.llm.collocations import collocations

    return collocations(table(spark, folder, "documents"))
