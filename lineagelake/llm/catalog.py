"""The registered query of each corpus operator, with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineagelake.llm.common import table

#: Rules (host and path, whether it allows) of the registered url query: fixed values.
URL_RULES = [("com/en/", False), ("example.com/en/7", True), ("net/de/", True), ("example.net/de/8", False), ("org/es/", False)]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lineagelake.llm.url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lineagelake.llm.line_dedup import drop_repeated_runs

    return drop_repeated_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lineagelake.llm.language_id import fit, identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.expr("crc32(cast(doc_id as string)) % 4 = 2")
    docs = docs.withColumn("held_out", F.coalesce(held, F.lit(False)))
    model = fit(docs.filter("not held_out"), order=F.xxhash64("doc_id"))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lineagelake.llm.ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lineagelake.llm.media import image_copies, render_vectors

    return image_copies(render_vectors(table(spark, sf_dir, "embeddings")))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lineagelake.llm.substring_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source and lang stand in for host and path: documents has no urls."""
    from lineagelake.llm.quality import classify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return classify(docs, table(spark, sf_dir, "labels"), site=F.col("source"), path=F.col("lang"))


def op8_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lineagelake.llm.token_codes import read_index, write_codes

    codes = write_codes(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_index(codes)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lineagelake.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lineagelake.llm.common import written
    from lineagelake.llm.mixing import mix, words_in

    docs = written(table(spark, sf_dir, "documents").select("doc_id", "source", words_in(F.col("text")).alias("size"), F.xxhash64("text").alias("digest")))
    return mix(docs, size="size").select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def damaged(rows: DataFrame) -> DataFrame:
    """The damage of the registered query: (conv_id, turn, role, text, gone); null ids, turns, roles and texts are read as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = rows.select("conv_id", "turn", kind.alias("kind"), space("role").alias("role"), space("text").alias("text"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), "kind")
    return rows.withColumn("i", F.explode(F.expr("sequence(1, if(kind = 3, 2, 1))"))).drop("i", "kind")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lineagelake.llm.conversations import repair

    return repair(damaged(table(spark, sf_dir, "conversations")), gone="gone", turns=False)[0]


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lineagelake.llm.neighbours import nearest

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.filter("vec_id % 20 = 0"), k=20)


#: Letters and least length of the words of the registered query; each so many (by hash) loses a letter.
WORD_LETTERS, WORD_LEAST, NOISE = "A-Za-z\u00c0-\u00ff", 7, 31


def noisy_words(docs: DataFrame) -> DataFrame:
    """(word, n): the registered query's words with two or more occurrences. A null doc_id reads as an empty string."""
    from lineagelake.llm.spelling import runs_of

    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs_of(F.col("text"), WORD_LETTERS, WORD_LEAST)).alias("run"))
    run = run.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"), F.length("run").alias("l"))
    cut = F.expr("concat(substr(run, 1, cast(h % l as int)), substr(run, cast(h % l as int) + 2))")
    words = run.select(F.when(F.col("h") % NOISE == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= WORD_LEAST)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter("n >= 2")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lineagelake.llm.spelling import group_variants

    return group_variants(noisy_words(table(spark, sf_dir, "documents").select("doc_id", "text")))


OP1_SQL = r"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN
           translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
         ELSE '' END AS host,
         CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
rules(rule, verdict) AS (VALUES ('com/en/', 'block'), ('example.com/en/7', 'allow'), ('net/de/', 'allow'), ('example.net/de/8', 'block'), ('org/es/', 'block')),
cut AS (SELECT rule, verdict, split_part(rule, '/', 1) AS rhost, substr(rule, strpos(rule, '/')) AS rpath FROM rules),
hits AS (
  SELECT p.page_id, arg_max(c.rule, 1000 * length(c.rule) + length(c.rhost)) AS rule, arg_max(c.verdict, 1000 * length(c.rule) + length(c.rhost)) AS verdict
  FROM parts p JOIN cut c ON (p.host = c.rhost OR ends_with(p.host, '.' || c.rhost)) AND starts_with(p.path, c.rpath)
  GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN hits h ON p.page_id = h.page_id
"""

OP2_SQL = r"""
WITH cut AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i, len(l) AS n FROM cut),
wins AS (
  SELECT doc_id, i, n, line, lead(line, 1) OVER w AS l1, lead(line, 2) OVER w AS l2 FROM lines
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
windows AS (
  SELECT doc_id, i, 3 AS k, [line, l1, l2] AS win FROM wins WHERE i <= n - 3
  UNION ALL SELECT doc_id, i, 2, [line, l1] FROM wins WHERE i <= n - 2 AND length(line) + length(l1) >= 300
  UNION ALL SELECT doc_id, i, 1, [line] FROM wins WHERE length(line) >= 300),
firsts AS (SELECT doc_id, i, k, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS r FROM windows),
gone AS (SELECT DISTINCT doc_id, i + d AS i FROM firsts, (VALUES (0), (1), (2)) t(d) WHERE r > 1 AND d < k),
kept AS (
  SELECT l.doc_id, string_agg(CASE WHEN g.i IS NULL THEN l.line END, chr(10) ORDER BY l.i) AS text, any_value(l.n) AS n_lines, count(g.i) AS n_removed
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(k.n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(k.n_removed, 0) AS INTEGER) AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

#: CRC-32 of the hexadecimal bytes h, by a table that the reflected polynomial gives.
CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""
CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"""

OP11_SQL = (
    r"""
WITH RECURSIVE """
    + CRC_TABLE
    + r""",
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS h
  FROM conversations),
kinds AS (SELECT conv_id, turn, role, text, """
    + CRC
    + r""" % 20 AS kind FROM keyed, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, range(2) c(copy) WHERE kind != 0 AND (copy = 0 OR kind = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, substr(role, 1, 1) AS x
  FROM damaged),
counted AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM placed),
turns AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
         lag(x) OVER (PARTITION BY conv_id ORDER BY i) || x AS pair
  FROM counted),
moves(state, x, after) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
filled(before, state, cost, letters, added) AS (
  SELECT s, s, 0, '', '' FROM range(4) r(s)
  UNION ALL
  SELECT before, CASE WHEN state = 2 THEN 3 ELSE 2 END, cost + 2, letters || 'I', added || chr(10) || CASE WHEN state = 2 THEN 'assistant:' ELSE 'user:' END
  FROM filled WHERE cost < 6),
edits AS (
  SELECT before, state, cost + 3 AS cost, letters || 'D' AS letters, added, 'D' AS edit, '' AS x, '' AS named FROM filled
  UNION ALL SELECT f.before, m.after, f.cost, f.letters || 'K', f.added, 'K', m.x, '' FROM filled f JOIN moves m ON f.state = m.state
  UNION ALL SELECT f.before, m.after, f.cost + 2, f.letters || 'R', f.added, 'R', '', CASE m.x WHEN 'u' THEN 'user' ELSE 'assistant' END
            FROM filled f JOIN moves m ON f.state = m.state WHERE m.x != 's'),
layers(conv_id, i, state, best) AS (
  SELECT conv_id, 0::BIGINT, 0::BIGINT, {'cost': 0::BIGINT, 'audit': '', 'made': ''} FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT l.conv_id, t.i, e.state,
         min({'cost': l.best.cost + e.cost + CASE WHEN e.edit != 'D' AND t.fault = 'truncated' THEN 1 ELSE 0 END, 'audit': l.best.audit || e.letters,
              'made': l.best.made || e.added || CASE e.edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || t.role || ':' || t.text ELSE chr(10) || e.named || ':' || t.text END})
  FROM layers l JOIN turns t ON l.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i = l.i + 1
  JOIN edits e ON e.before = l.state AND (e.edit = 'D' OR t.fault NOT IN ('blank', 'duplicate')) AND (e.edit != 'K' OR e.x = t.x)
  GROUP BY l.conv_id, t.i, e.state),
lengths AS (
  SELECT c.conv_id, count(t.i) AS n, coalesce(max(t.turn) - min(t.turn) + 1 - count(DISTINCT t.turn), 0) AS gaps, count(*) FILTER (t.fault = 'blank') AS blank,
         count(*) FILTER (t.fault = 'duplicate') AS duplicate, count(*) FILTER (t.fault = 'truncated') AS truncated, count(*) FILTER (t.pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN turns t ON c.conv_id IS NOT DISTINCT FROM t.conv_id GROUP BY c.conv_id),
ends AS (
  SELECT l.conv_id, min({'cost': l.best.cost + f.cost, 'audit': l.best.audit || f.letters, 'made': l.best.made || f.added}) AS best
  FROM layers l JOIN lengths n ON l.conv_id IS NOT DISTINCT FROM n.conv_id AND l.i = n.n JOIN filled f ON f.before = l.state AND f.state IN (0, 3) GROUP BY l.conv_id)
SELECT n.conv_id, n.gaps, n.blank, n.duplicate, n.truncated, n.illegal, e.best.cost AS cost, e.best.audit AS audit, sha256(substr(e.best.made, 2)) AS repaired_sha256
FROM lengths n JOIN ends e ON n.conv_id IS NOT DISTINCT FROM e.conv_id
"""
)

OP13_SQL = (
    r"""
WITH RECURSIVE """
    + CRC_TABLE
    + r""",
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]{7,}')) AS run
  FROM documents),
grouped AS (SELECT id, run, hex(encode(id || ':' || run)) AS h, count(*) AS n FROM runs GROUP BY id, run),
hashed AS (SELECT run, n, length(run) AS l, """
    + CRC
    + r""" AS crc FROM grouped, crc_table),
made AS (SELECT CASE WHEN crc % 31 = 0 THEN substr(run, 1, crc % l) || substr(run, crc % l + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT x.word, y.word AS near, y.n AS near_n FROM cuts x JOIN cuts y ON x.i = y.i AND x.rest = y.rest AND x.word != y.word
  UNION SELECT x.word, y.word, y.n FROM cuts x JOIN words y ON x.rest = y.word
  UNION SELECT y.word, x.word, x.n FROM cuts x JOIN words y ON x.rest = y.word),
best AS (SELECT word, count(*) AS n_near, min({'less': -near_n, 'near': near}) AS best FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN -b.best.less >= 10 * w.n THEN b.best.near END AS form, CASE WHEN -b.best.less >= 10 * w.n THEN -b.best.less END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
chains(word, held) AS (SELECT word, word FROM forms UNION ALL SELECT c.word, f.form FROM chains c JOIN forms f ON c.held = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.held AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN chains c ON f.word = c.word JOIN forms e ON c.held = e.word AND e.form IS NULL
"""
)

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_line_dedup": op2_line_dedup,
    "op3_language_id": op3_language_id,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_image_copies": op5_image_copies,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_token_codes": op8_token_codes,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_source_mixing": op10_source_mixing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES = {"op1_url_filter": OP1_SQL, "op2_line_dedup": OP2_SQL, "op11_conversation_repair": OP11_SQL, "op13_spelling_variants": OP13_SQL}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
