"""Documents, pages and conversations as logs, issue pages and usage records."""

from __future__ import annotations

from pyspark.sql import functions as F

from crashlens.functions import frames, text
from crashlens.operators import choices, rollups, sequences
from crashlens.plans.base import Query, table
from crashlens.sources import fragments, shared


def _usage(s, d):
    """Turns as an agent's usage: characters as tokens, a quarter of them cached."""
    size = F.char_length("text")
    return table(s, d, "conversations").select("conv_id", F.col("role").alias("model"), size.alias("input_tokens"), F.floor(size / 4).alias("cached_input_tokens"), F.col("turn").alias("output_tokens"))


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


add(
    "key_normalize",
    lambda s, d: table(s, d, "part").select("p_partkey", text.normal_key(F.concat(F.lit(" T:|"), F.replace("p_name", F.lit(" "), F.lit("|\n ")), F.lit("|"))).alias("key"), F.array_join(text.state_top3(F.concat_ws("\n", "p_name", "p_brand", F.lit(" "), "p_type")), ",").alias("state"), text.first_segment(F.concat_ws("\n", "p_brand", "p_type")).alias("head")),
    "SELECT p_partkey, 'T: ' || p_name AS key, p_name || ',' || p_brand || ',' || p_type AS state, p_brand AS head FROM part",
)
add(
    "log_tail",
    lambda s, d: table(s, d, "documents").select("doc_id", F.md5(text.tail(F.col("text"), 5, 300)).alias("tail")),
    "SELECT doc_id, md5(right(array_to_string(list_slice(string_split(coalesce(text, ''), chr(10)), -5, -1), chr(10)), 300)) AS tail FROM documents",
)
def _usages(s, d):
    """Parts as usage summaries in three forms, or in none."""
    n, m, k = (F.format_number(c, 0) for c in (F.col("p_partkey") * 1000 + 1, F.col("p_size") * 1001, F.col("p_partkey") * 7 + 1))
    line = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("Tokens: "), n, F.lit(" input, "), m, F.lit(" cached input, "), k, F.lit(" output"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("input: "), n, F.lit(" and output: "), k))
    line = F.coalesce(line.when(F.col("p_partkey") % 4 == 2, F.concat(n, F.lit(" input, "), k, F.lit(" output"))), F.lit("none"))
    return table(s, d, "part").withColumn("u", text.usage(F.concat(F.lit("x\n"), line, F.when(F.col("p_size") % 3 > 0, F.concat(F.lit("\nCost: $"), "p_size", F.lit(".25"))).otherwise(""))))


add(
    "number_parse",
    lambda s, d: _usages(s, d).select("p_partkey", text.number(F.format_number(F.col("p_partkey") * 12345, 0)).alias("n"), "u.*"),
    """SELECT p_partkey, p_partkey * 12345 AS n, CASE WHEN p_partkey % 4 < 3 THEN p_partkey * 1000 + 1 ELSE 0 END AS input, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS BIGINT) * 1001 ELSE 0 END AS cached,
    CASE WHEN p_partkey % 4 < 3 THEN p_partkey * 7 + 1 ELSE 0 END AS output, CASE WHEN p_size % 3 > 0 THEN p_size + 0.25::DOUBLE ELSE 0 END AS cost FROM part""",
)
add(
    "html_to_text",
    lambda s, d: table(s, d, "pages").select("page_id", F.char_length(text.html_text("html")).cast("long").alias("n_chars"), F.md5(F.regexp_replace(text.html_text("html"), r"[ \t\n]+", " ")).alias("text")),
    r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br\s*/?>', chr(10), 'g'), '(?is)<a\b[^>]*>(.*?)</a>', '\1', 'g'), '(?s)<[^>]+>', '', 'g') AS t FROM pages),
    b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(t, '=', '='), '&', '&'), '/', '/'), '<', '<'), '>', '>'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&nbsp;', ' '), '&amp;', '&') AS t FROM a),
    c AS (SELECT page_id, trim(regexp_replace(regexp_replace(t, '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ') AS t FROM b) SELECT page_id, length(t) AS n_chars, md5(regexp_replace(t, '[ \t\n]+', ' ', 'g')) AS text FROM c""",
)
add(
    "keyval_parse",
    lambda s, d: table(s, d, "part").select("p_partkey", text.key_values(F.concat_ws("\n", F.when(F.col("p_size") % 4 > 0, "Detailed Report: http://x"), F.when(F.col("p_size") % 5 > 0, F.concat(F.lit("Crash Type: "), "p_type")), F.concat(F.lit("  Brand: "), "p_brand"), F.lit("no pair"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Brand: "), "p_name")))).alias("m")).select("p_partkey", F.expr("m['Crash Type']").alias("crash_type"), F.expr("m['Brand']").alias("brand"), F.size("m").cast("long").alias("n")),
    "SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN p_type END AS crash_type, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END AS brand, CAST(1 + CAST(p_size % 4 > 0 AS INTEGER) + CAST(p_size % 5 > 0 AS INTEGER) AS BIGINT) AS n FROM part",
)
add(
    "link_dedupe",
    lambda s, d: table(s, d, "pages").select("page_id", F.array_join(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)), " ").alias("links")),
    """WITH l AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS x FROM pages), u AS (SELECT page_id, x[i] AS l, min(i) AS i FROM l, unnest(range(1, len(x) + 1)) AS t(i) GROUP BY ALL)
    SELECT page_id, coalesce((SELECT string_agg(l, ' ' ORDER BY i) FROM u WHERE u.page_id = l.page_id), '') AS links FROM l""",
)
#: SQL that both engines run: a script with quoted strings, of which not all hold the needle.
SCRIPT = """'var x = "a' || p_size || '"; y = "' || CASE WHEN p_partkey % 3 > 0 THEN 'Detailed Report: ' ELSE 'report ' END || chr(92) || '"' || p_name || chr(92) || '" end' || chr(92) || chr(92) || '"; "b"'"""
add(
    "quoted_block",
    lambda s, d: table(s, d, "part").select("p_partkey", text.quoted_block(F.expr(SCRIPT), "Detailed Report:").alias("block")),
    rf"""SELECT p_partkey, nullif(regexp_extract({SCRIPT}, '"((?:\\.|[^"\\])*Detailed Report:(?:\\.|[^"\\])*)"', 1), '') AS block FROM part""",
)
add(
    "dedupe_first_wins",
    lambda s, d: sequences.first_wins(table(s, d, "documents").withColumn("h", F.md5(F.coalesce("text", F.lit("")))), ["h"], ["doc_id"]).select("doc_id"),
    "SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(coalesce(text, ''))",
)
add(
    "left_default",
    lambda s, d: choices.with_default(table(s, d, "documents").select("doc_id"), table(s, d, "labels"), ["doc_id"], "quality").join(table(s, d, "labels").select("doc_id", "toxic"), "doc_id", "left").select("doc_id", "quality", F.when(F.col("toxic").isNull(), "no_data").otherwise("data").alias("state")),
    "SELECT d.doc_id, coalesce(CAST(quality AS VARCHAR), '-') AS quality, CASE WHEN toxic IS NULL THEN 'no_data' ELSE 'data' END AS state FROM documents d LEFT JOIN labels USING (doc_id)",
)
add(
    "shared_set_sizes",
    lambda s, d: table(s, d, "documents").select("doc_id", frames.shared_count(F.split("text", " "), F.array(*(F.lit(x) for x in ("the", "of", "de", "la", "und", "and")))).alias("shared")),
    "SELECT doc_id, len(list_intersect(list_distinct(string_split(coalesce(text, ''), ' ')), ['the', 'of', 'de', 'la', 'und', 'and'])) AS shared FROM documents",
)
add(
    "usage_cost",
    lambda s, d: rollups.usage_cost(_usage(s, d), s.createDataFrame([("user", 1.25, 0.125, 10.0), ("assistant", 2.0, 0.5, 8.0)], "model string, input double, cached double, output double"), (1.0, 0.25, 4.0), ["conv_id"]).withColumn("cost", F.round("cost", 9)),
    """WITH u AS (SELECT conv_id, role, CAST(sum(length(text)) AS BIGINT) AS i, CAST(sum(length(text) // 4) AS BIGINT) AS c, CAST(sum(turn) AS BIGINT) AS o FROM conversations GROUP BY ALL),
    v AS (SELECT *, CASE role WHEN 'user' THEN (i - c) * 1.25 + c * 0.125 + o * 10 WHEN 'assistant' THEN (i - c) * 2.0 + c * 0.5 + o * 8 ELSE (i - c) * 1.0 + c * 0.25 + o * 4 END / 1000000 AS cost FROM u)
    SELECT conv_id, CAST(coalesce(sum(i), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(c), 0) AS BIGINT) AS cached_input_tokens, CAST(coalesce(sum(o), 0) AS BIGINT) AS output_tokens, CAST(round(coalesce(sum(cost), 0), 9) AS DOUBLE) AS cost FROM v GROUP BY 1""",
)
add(
    "first_session_record",
    lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.min(F.when(F.col("role") == "assistant", F.struct("turn", "text"))).alias("x")).select("conv_id", F.md5("x.text").alias("first_reply")),
    "SELECT conv_id, md5(arg_min(text, turn) FILTER (WHERE role = 'assistant')) AS first_reply FROM conversations GROUP BY 1",
)


def _lines(s, d):
    return table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


LINES = "l AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, string_split(text, chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(i))"
add(
    "hunk_islands",
    lambda s, d: sequences.islands(_lines(s, d), ["doc_id"], "pos", "char_length(line) > 60"),
    f"""WITH {LINES}, n AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM l WHERE length(line) > 60) SELECT doc_id, min(pos) AS start, max(pos) AS "end", count(*) AS n FROM n GROUP BY doc_id, g""",
)
add(
    "continuation_blocks",
    lambda s, d: sequences.islands(_lines(s, d), ["doc_id"], "pos", "not endswith(line, '.')"),
    f"""WITH {LINES}, n AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM l WHERE NOT suffix(line, '.')) SELECT doc_id, min(pos) AS start, max(pos) AS "end", count(*) AS n FROM n GROUP BY doc_id, g""",
)
DIFF = "'diff --git a/zlib/x.c b/zlib/x.c\n--- a/zlib/x.c\n+++ b/zlib/x.c\n@@ -1 +1 @@ int f(int a)\n-a\n+b\ndiff --git a/src/' || p_size || '.c b/src/' || p_size || '.c\n--- a/src/' || p_size || '.c\n+++ b/src/' || p_size || '.c\n@@ -1 +1 @@ static int g(void)\n+c\n'"
add(
    "section_filter",
    lambda s, d: table(s, d, "part").select("p_partkey", F.expr(DIFF.replace("\n", "\\n")).alias("diff")).select("p_partkey", F.char_length(text.without_artifacts(F.col("diff"))).cast("long").alias("kept"), F.array_join(text.diff_files(F.col("diff")), ",").alias("files"), F.array_join(text.diff_functions(F.col("diff")), ",").alias("functions")),
    "SELECT p_partkey, CAST(89 + 4 * length(CAST(p_size AS VARCHAR)) AS BIGINT) AS kept, 'src/' || CAST(p_size AS VARCHAR) || '.c,zlib/x.c' AS files, 'f,g' AS functions FROM part",
)


def _appended(s, d):
    """Pages as records of source code, appended twice: some first, then all."""
    rows = table(s, d, "pages").select(
        (F.col("page_id") % 5).cast("string").alias("kind"), F.col("html").alias("spelling"), F.struct(F.col("url").alias("file"), (F.col("page_id") % 3).alias("line"), F.char_length("html").cast("long").alias("column")).alias("location"), "page_id"
    )
    folder = shared.folder(s, "array")
    for batch, part in enumerate((rows.where("kind < '3'"), rows)):
        fragments.append(part.withColumn("batch", F.lit(batch)), folder, batch, ["page_id"])
    kept = fragments.located(fragments.repaired(s, folder))
    return kept.select(F.get_json_object("text", "$.page_id").cast("long").alias("page_id"), F.get_json_object("text", "$.batch").cast("int").alias("batch"), "kind", F.md5("spelling").alias("spelling"), "line")


add(
    "appended_arrays",
    _appended,
    """WITH r AS (SELECT page_id, CASE WHEN page_id % 5 < 3 THEN 0 ELSE 1 END AS batch, CAST(page_id % 5 AS VARCHAR) AS kind, coalesce(html, '') AS spelling, page_id % 3 AS line, coalesce(url, '') AS url FROM pages)
    SELECT page_id, batch, kind, md5(spelling) AS spelling, line FROM r QUALIFY row_number() OVER (PARTITION BY kind, spelling, line, url ORDER BY batch, page_id) = 1""",
)
