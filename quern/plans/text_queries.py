"""Queries over documents, pages and conversations: segmentation, wordings, filters, merges, checks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import checks, filters, merge, recut, segments, sessions
from quern.plans.registry import query
from quern.session import scratch

LINES = r"""lines AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS idx, t AS text FROM (
  SELECT doc_id, i, trim(s, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM (
    SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM (
      SELECT doc_id, string_split(replace(regexp_replace(text, '([.!?;])(\s)', '\1' || chr(1) || '\2', 'g'), chr(10), chr(1)), chr(1)) AS parts FROM documents)))
  WHERE length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')) >= 3)"""
SENTENCES = r"""sentences AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS idx, t AS text FROM (
  SELECT doc_id, i, trim(s, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM (
    SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM (
      SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([.!?]+)\s+', '\1' || chr(1), 'g'), '\n[ \t]*\n', chr(1), 'g'), chr(1)) AS parts FROM documents)))
  WHERE length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')) >= 3)"""
COLLAPSED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(f"WITH {LINES} SELECT doc_id, idx, text FROM lines")
def g11_split_lines(t):
    return segments.lines_and_terminals(t.documents).select("doc_id", F.col("idx").cast("long").alias("idx"), "text")


@query(rf"WITH {SENTENCES} SELECT doc_id, idx, text, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS BIGINT) AS n_words FROM sentences")
def g3_sentences(t):
    return segments.sentences(t.documents).select("doc_id", F.col("idx").cast("long").alias("idx"), "text", text.n_words(F.col("text")).cast("long").alias("n_words"))


@query(rf"WITH {LINES} SELECT text_sha256, n_rows, n_docs FROM (SELECT sha256({COLLAPSED}) AS text_sha256, count(*) AS n_rows, count(DISTINCT doc_id) AS n_docs FROM lines GROUP BY 1) WHERE n_docs >= 2")
def a19_repeated_wordings(t):
    """Which wordings repeat across documents, all of them."""
    return segments.wordings(segments.lines_and_terminals(t.documents)).where("n_docs >= 2").select("text_sha256", "n_rows", "n_docs")


@query("SELECT sha256(text) AS content_sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def a1_exact_dedup(t):
    files = t.documents.where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("content_sha256"))
    return merge.one_per_content(files, "content_sha256", "doc_id")


@query("SELECT count(*) AS n, count(DISTINCT lang) AS langs, count(DISTINCT source) AS sources, count(DISTINCT sha256(text)) AS texts FROM documents")
def a2_distinct(t):
    return t.documents.agg(F.count("*").alias("n"), F.countDistinct("lang").alias("langs"), F.countDistinct("source").alias("sources"), F.countDistinct(F.sha2("text", 256)).alias("texts"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def a3_value_counts(t):
    return t.documents.groupBy("lang", "source").agg(F.count("*").alias("n"))


@query(rf"WITH {LINES} SELECT doc_id, idx, lower(text) AS key FROM lines QUALIFY row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id, idx) = 1")
def a18_dedup_keep_first(t):
    pieces = segments.lines_and_terminals(t.documents)
    return merge.keep_first(pieces, [F.lower("text")], ["doc_id", "idx"]).select("doc_id", F.col("idx").cast("long").alias("idx"), F.lower("text").alias("key"))


@query(rf"""WITH {LINES}, {SENTENCES}, b AS (SELECT 'lines' AS grammar, * FROM lines UNION ALL SELECT 'sentences', * FROM sentences),
n AS (SELECT grammar, text, lead(text) OVER (PARTITION BY grammar, doc_id ORDER BY idx) AS after FROM b)
SELECT grammar, count(*) AS units, CAST(sum(CASE WHEN NOT regexp_matches(text, '[.!?;:]$') AND coalesce(regexp_matches(after, '^[a-z]'), false) THEN 1 ELSE 0 END) AS BIGINT) AS mid_breaks,
CAST(sum(CASE WHEN len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) <= 3 THEN 1 ELSE 0 END) AS BIGINT) AS fragments FROM n GROUP BY 1""")
def a17_compare_grammars(t):
    return segments.compared(t.documents)


@query(rf"""WITH {LINES} SELECT count(*) AS rows, count(DISTINCT doc_id) AS files, count(DISTINCT sha256({COLLAPSED})) AS wordings FROM lines""")
def a35_corpus_stats(t):
    pieces = segments.lines_and_terminals(t.documents)
    return pieces.agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("files"), F.countDistinct(text.text_digest(F.col("text"))).alias("wordings"))


@query(rf"""WITH {LINES} SELECT doc_id, idx, sha256({COLLAPSED}) AS text_sha, count(*) OVER (PARTITION BY sha256({COLLAPSED})) AS n_dup_text FROM lines""")
def a32_duplicate_counts(t):
    """How often each unit's wording occurs, carried on the unit."""
    found = segments.duplicate_counts(segments.lines_and_terminals(t.documents))
    return found.select("doc_id", F.col("idx").cast("long").alias("idx"), F.col("text_sha256").alias("text_sha"), "n_dup_text")


@query(rf"""WITH {LINES} SELECT substring(sha256(concat_ws(':', 'src', doc_id)), 1, 16) AS file_id, substring(sha256(concat_ws(':', substring(sha256(concat_ws(':', 'src', doc_id)), 1, 16), '', idx)), 1, 16) AS clause_id,
doc_id, idx, CAST(length(text) AS BIGINT) AS n_chars, sha256({COLLAPSED}) AS text_sha256 FROM lines""")
def g13_clause_rows(t):
    """Units as rows of a published table, under content-addressed ids."""
    file_id = text.key_digest(F.lit("src"), F.col("doc_id"))
    pieces = segments.lines_and_terminals(t.documents).withColumn("file_id", file_id)
    return pieces.select("file_id", text.key_digest(F.col("file_id"), F.lit(None).cast("string"), F.col("idx")).alias("clause_id"), "doc_id", F.col("idx").cast("long").alias("idx"), F.length("text").cast("long").alias("n_chars"), text.text_digest(F.col("text")).alias("text_sha256"))


@query("SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j1_new_files(t):
    return merge.not_yet(t.documents, t.labels, ["doc_id"]).select("doc_id", "lang")


@query("SELECT d.doc_id, d.source, d.lang, d.n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE x.doc_id % 4 = 0 AND x.doc_id = d.doc_id AND x.source = d.source AND x.lang = d.lang AND x.n_chars = d.n_chars)")
def j2_composite_anti(t):
    keys = ["doc_id", "source", "lang", "n_chars"]
    return merge.not_yet(t.documents.select(*keys), t.documents.where("doc_id % 4 = 0"), keys)


def _states(t):
    d = t.documents.select("doc_id", "source", "n_chars")
    return d.where("doc_id % 3 <> 0").withColumn("version", F.lit(1)), d.where("doc_id % 2 = 0").withColumn("version", F.lit(2))


STATES = "e AS (SELECT doc_id, source, n_chars, 1 AS version FROM documents WHERE doc_id % 3 <> 0), i AS (SELECT doc_id, source, n_chars, 2 AS version FROM documents WHERE doc_id % 2 = 0)"


@query(f"WITH {STATES} SELECT * FROM e UNION ALL SELECT * FROM i WHERE doc_id NOT IN (SELECT doc_id FROM e)")
def j3_append(t):
    old, new = _states(t)
    return merge.merged(old, new, "doc_id", "source", "append")


@query(f"WITH {STATES}, s AS (SELECT DISTINCT source || '/' || n_chars % 50 AS g FROM i) SELECT * FROM e WHERE source || '/' || n_chars % 50 NOT IN (SELECT g FROM s) UNION ALL SELECT * FROM i")
def j4_sync(t):
    old, new = _states(t)
    group = F.concat_ws("/", "source", (F.col("n_chars") % 50).cast("string"))
    return merge.merged(old.withColumn("g", group), new.withColumn("g", group), "doc_id", "g", "sync").drop("g")


@query(f"WITH {STATES} SELECT * FROM i")
def k2_replace(t):
    old, new = _states(t)
    return merge.merged(old, new, "doc_id", "source", "replace")


@query(f"WITH {STATES}, m AS (SELECT * FROM e UNION ALL SELECT * FROM i WHERE doc_id NOT IN (SELECT doc_id FROM e)) SELECT (SELECT count(*) FROM e) AS kept, CAST(0 AS BIGINT) AS replaced, count(*) - (SELECT count(*) FROM e) AS added, count(*) AS total FROM m")
def k2_merge_stats(t):
    old, new = _states(t)
    return merge.merge_stats(old, new, "doc_id", "source", "append")


@query("""SELECT doc_id, CASE WHEN n_chars = 0 OR n_chars % 17 = 0 THEN 'empty' WHEN length(text) > 5000 THEN 'too large' WHEN n_chars % 13 = 0 THEN 'missing repo/path' WHEN n_chars % 11 = 0 THEN 'missing sha' END AS reason FROM documents""")
def p2_skip_reason(t):
    content = F.when(F.col("n_chars") % 17 == 0, "").otherwise(F.col("text"))
    repo, sha = F.when(F.col("n_chars") % 13 != 0, F.col("source")), F.when(F.col("n_chars") % 11 != 0, F.col("lang"))
    return t.documents.select("doc_id", filters.skip_reason(content, repo, F.col("source"), sha, 5000).alias("reason"))


def _case(column: str, pairs: dict, test: str) -> str:
    return " ".join(f"WHEN {test.format(column=column, key=k)} THEN '{v}'" for k, v in pairs.items())


PATH = "CASE page_id % 8 WHEN 0 THEN 'Docs/CLAUDE.md' WHEN 1 THEN concat('.cursor/rules/', page_id, '.md') WHEN 2 THEN concat('a/', page_id, '.mdc') WHEN 3 THEN concat('x', chr(92), 'y', chr(92), 'AGENTS.MD') WHEN 4 THEN '.roo/rules-code/a.txt' WHEN 5 THEN 'b/c.instructions.md' ELSE url END"


@query(rf"""WITH p AS (SELECT page_id, replace({PATH}, '\', '/') AS w FROM pages), b AS (SELECT page_id, w, lower(w) AS l, string_split(lower(w), '/')[-1] AS base FROM p)
SELECT page_id, CASE {_case('base', filters.BASENAMES, "{column} = '{key}'")} {_case('base', filters.SUFFIXES, "ends_with({column}, '{key}')")} {_case('l', filters.FRAGMENTS, "contains({column}, '{key}')")} ELSE string_split(w, '/')[-1] END AS kind FROM b""")
def p3_classify_path(t):
    path = F.expr(PATH)
    return t.pages.select("page_id", filters.file_type(path).alias("kind"))


@query(rf"WITH {LINES} SELECT doc_id, idx FROM lines WHERE len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) >= 6 AND idx % 3 <> 0")
def p4_chosen_units(t):
    pieces = segments.lines_and_terminals(t.documents).withColumn("type", F.when(F.col("idx") % 3 == 0, "heading").when(F.col("idx") % 3 == 1, "statement").otherwise("clause"))
    return filters.chosen_units(pieces, min_words=6).select("doc_id", F.col("idx").cast("long").alias("idx"))


@query(rf"""WITH {LINES} SELECT type IN ('heading', 'code', 'table_header', 'table_row', 'lead_in', 'markup', 'field_meta', 'block') AS is_structural, count(*) AS n FROM (SELECT CASE idx % 4 WHEN 0 THEN 'heading' WHEN 1 THEN 'lead_in' WHEN 2 THEN 'clause' ELSE 'statement' END AS type FROM lines) GROUP BY 1""")
def p1_structural(t):
    kind = F.when(F.col("idx") % 4 == 0, "heading").when(F.col("idx") % 4 == 1, "lead_in").when(F.col("idx") % 4 == 2, "clause").otherwise("statement")
    return segments.lines_and_terminals(t.documents).groupBy(filters.is_structural(kind).alias("is_structural")).agg(F.count("*").alias("n"))


@query("SELECT doc_id AS key, 'blank text' AS problem FROM (SELECT doc_id, CASE WHEN n_chars % 19 = 0 THEN ' ' ELSE text END AS text FROM documents) WHERE text IS NULL OR trim(text) = '' UNION ALL SELECT doc_id, 'not a rule' FROM labels WHERE quality = 0")
def p5_problems(t):
    d = t.documents.withColumn("text", F.when(F.col("n_chars") % 19 == 0, " ").otherwise(F.col("text")))
    rules = d.join(t.labels.select("doc_id", (F.col("quality") == 1).alias("is_rule")), "doc_id", "left").select("doc_id", "text", "is_rule")
    return filters.problems(rules, "doc_id", ["text"])


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND n_chars BETWEEN 200 AND 900")
def p8_user_predicate(t):
    return t.documents.where(F.expr("lang = 'en' AND n_chars BETWEEN 200 AND 900")).select("doc_id", "n_chars")


CODE_PATH = "CASE doc_id % 5 WHEN 0 THEN 'a.py' WHEN 1 THEN 'b.md' WHEN 2 THEN 'c.ts' WHEN 3 THEN 'bin/run' ELSE 'd.JSON' END"


@query(f"WITH p AS (SELECT doc_id, {CODE_PATH} AS path, CASE WHEN doc_id % 15 = 3 THEN '#!/bin/sh' || chr(10) || text ELSE text END AS content FROM documents) SELECT doc_id, CASE WHEN path IN ('b.md', 'd.JSON') THEN false ELSE path IN ('a.py', 'c.ts') OR starts_with(content, '#!') END AS is_code FROM p")
def p10_is_code(t):
    content = F.when(F.col("doc_id") % 15 == 3, F.concat(F.lit("#!/bin/sh\n"), F.col("text"))).otherwise(F.col("text"))
    return t.documents.select("doc_id", filters.is_code(F.expr(CODE_PATH), content).alias("is_code"))


@query("SELECT page_id FROM pages WHERE regexp_full_match(url, 'http://m\\..*') OR starts_with(url, 'https://blog')")
def p11_noise(t):
    return t.pages.where(filters.noise(F.col("url"), [r"http://m\..*"], ["https://blog"])).select("page_id")


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS collapsed, trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents")
def f1_f4_text_forms(t):
    return t.documents.select("doc_id", text.collapse(F.col("text")).alias("collapsed"), text.slug(F.col("text")).alias("slug"))


@query(r"SELECT p_partkey, regexp_replace('  ' || (CASE p_partkey % 4 WHEN 0 THEN '- ' WHEN 1 THEN '12. ' WHEN 2 THEN '* ' ELSE '' END) || p_name, '^\s*(?:[-*+]|\d+[.)])\s+', '') AS plain FROM part")
def f2_markers(t):
    mark = F.expr("CASE p_partkey % 4 WHEN 0 THEN '- ' WHEN 1 THEN '12. ' WHEN 2 THEN '* ' ELSE '' END")
    return t.part.select("p_partkey", text.drop_marker(F.concat(F.lit("  "), mark, "p_name")).alias("plain"))


@query(r"""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower('"' || p_type || '" - ' || p_name || ' (x y)'), '["''`]', '', 'g'), '\s*\([^()]*\)\s*$', ''), '[\s\-_/]+', ' ', 'g'), '^[ .;:]+|[ .;:]+$', '', 'g') AS normal FROM part""")
def f3_norm(t):
    raw = F.concat(F.lit('"'), "p_type", F.lit('" - '), "p_name", F.lit(" (x y)"))
    return t.part.select("p_partkey", text.norm(raw).alias("normal"))


@query(rf"WITH {LINES} SELECT doc_id, idx, CAST(length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) AS BIGINT) AS n_alnum, regexp_matches(text, '[:：][*_ \t\r\"'']*$') AS lead_in FROM lines")
def f8_f11_unit_tests(t):
    return segments.lines_and_terminals(t.documents).select("doc_id", F.col("idx").cast("long").alias("idx"), text.n_alnum(F.col("text")).cast("long").alias("n_alnum"), text.is_lead_in(F.col("text")).alias("lead_in"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || ' … ' || (length(text) - 100) || ' more' ELSE text END AS short, string_split(text, chr(10))[1] AS first FROM documents")
def f15_truncate(t):
    return t.documents.select("doc_id", text.truncated(F.col("text"), 100).alias("short"), text.first_line(F.col("text")).alias("first"))


@query(r"SELECT doc_id, list_distinct(regexp_extract_all('R' || doc_id || ' and R7, xR9 R' || doc_id, '\bR(\d+)\b', 1)) IS NOT NULL AS ok, len(list_distinct(regexp_extract_all('R' || doc_id || ' and R7, xR9 R' || doc_id, '\bR(\d+)\b', 1))) AS n FROM documents")
def f20_rule_ids(t):
    ids = text.rule_ids(F.concat(F.lit("R"), F.col("doc_id"), F.lit(" and R7, xR9 R"), F.col("doc_id")))
    return t.documents.select("doc_id", ids.isNotNull().alias("ok"), F.size(ids).cast("long").alias("n"))


@query("SELECT doc_id, substring(text, 11, 40) AS part, CAST(length(text) AS BIGINT) AS n, CAST(len(string_split(substring(text, 1, CAST(length(text) // 2 AS INT)), chr(10))) AS BIGINT) AS line FROM documents")
def f23_j19_offsets(t):
    return t.documents.select("doc_id", F.substring("text", 11, 40).alias("part"), F.length("text").cast("long").alias("n"), segments.line_of(F.col("text"), F.floor(F.length("text") / 2).cast("int")).cast("long").alias("line"))


@query("SELECT doc_id, sha256(text) AS whole, substring(sha256(concat_ws(':', source, lang, doc_id)), 1, 16) AS id FROM documents")
def f24_digests(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("whole"), text.key_digest(F.col("source"), F.col("lang"), F.col("doc_id")).alias("id"))


@query("""SELECT source, doc_id // 64 AS project, sha256(string_agg(doc_id || ':' || sha256(text), chr(10) ORDER BY doc_id)) AS fingerprint, count(*) AS files FROM documents GROUP BY ALL""")
def a23_fingerprint(t):
    """One hash for an ordered set of files, a project's: a hash of their hashes."""
    line = F.concat_ws(":", "doc_id", F.sha2("text", 256))
    one = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", line.alias("line")))), lambda x: x["line"]), "\n")
    return t.documents.groupBy("source", F.expr("doc_id div 64").alias("project")).agg(F.sha2(one, 256).alias("fingerprint"), F.count("*").alias("files"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), e AS (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS line FROM l)
SELECT doc_id, line, greatest(1, line - 8) AS first, least(len(lines), line + 2) AS last, array_to_string(lines[greatest(1, line - 8):least(len(lines), line + 2)], chr(10)) AS context FROM e""")
def w2_context(t):
    return segments.contexts(t.documents).select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("line", "first", "last")), "context")


@query(r"""WITH l AS (SELECT doc_id, string_split(replace(text, 'the ', '```' || chr(10)), chr(10)) AS lines FROM documents), e AS (SELECT doc_id, unnest(lines) AS own, generate_subscripts(lines, 1) AS line FROM l)
SELECT doc_id, line, sum(CASE WHEN regexp_matches(own, '^\s*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) % 2 = 1 OR regexp_matches(own, '^\s*(```|~~~)') AS fenced FROM e""")
def w4_fence_parity(t):
    d = t.documents.withColumn("text", F.replace("text", F.lit("the "), F.lit("```\n")))
    return segments.fence_parity(d).select("doc_id", F.col("line").cast("long").alias("line"), "fenced")


@query("""WITH a AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') || chr(10) || 'new' ELSE coalesce(text, '') END AS t, doc_id % 3 = 0 AS changed, text FROM documents),
n AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ls, t NOT IN (SELECT coalesce(text, '') FROM documents) AS fresh FROM a)
SELECT doc_id, len(ls) AS n_units, md5(array_to_string(ls, '|')) AS digest, fresh FROM n WHERE len(ls) > 0""")
def z5_recut(t):
    """All documents cut once; then a third of them changes, and only the new contents are cut again."""
    store = scratch(t.spark, "cuts")
    docs = t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    changed = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\nnew"))).otherwise(F.col("text")))

    def cut(contents):
        lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
        return contents.select("sha", F.posexplode(lines).alias("idx", "unit"))

    recut.recut(docs, store, "lines-1", cut)
    before = [r["part"] for r in recut.manifest(docs, store).select("part").distinct().collect()]
    recut.recut(changed, store, "lines-1", cut)
    found = recut.units(changed, store, "lines-1").groupBy("doc_id").agg(F.count("*").alias("n_units"), F.sort_array(F.collect_list(F.struct("idx", "unit"))).alias("us"), F.first("part").alias("part"))
    return found.select("doc_id", "n_units", F.md5(F.array_join(F.transform("us", lambda u: u["unit"]), "|")).alias("digest"), (~F.col("part").isin(before)).alias("fresh"))


@query("""WITH p AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), l AS (SELECT doc_id, unnest(ls) AS own, generate_subscripts(ls, 1) AS line FROM p),
x AS (SELECT doc_id, line, length(own) % 4 AS level, sum(length(own) + 1) OVER (PARTITION BY doc_id ORDER BY line) - length(own) - 1 AS pos FROM l),
h AS (SELECT doc_id, pos, level, 'h' || line AS title FROM x WHERE level > 0),
k AS (SELECT x.doc_id, x.pos, (SELECT max(h.pos) FROM h WHERE h.doc_id = x.doc_id AND h.level = 1 AND h.pos <= x.pos) AS p1, (SELECT max(h.pos) FROM h WHERE h.doc_id = x.doc_id AND h.level <= 2 AND h.pos <= x.pos) AS p2, (SELECT max(h.pos) FROM h WHERE h.doc_id = x.doc_id AND h.pos <= x.pos) AS p3 FROM x)
SELECT k.doc_id AS doc, CAST(k.pos AS BIGINT) AS off, coalesce((SELECT string_agg(title, ' > ' ORDER BY h.pos) FROM h WHERE h.doc_id = k.doc_id AND h.pos IN (p1, p2, p3)), '') AS path FROM k""")
def j18_breadcrumb(t):
    """Lines of all documents stand for headings (the level by their length), and each line asks for its path."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    sizes = F.transform(lines, lambda x: F.length(x))
    own = t.documents.select("doc_id", F.posexplode(sizes).alias("i", "size"))
    before = F.sum(F.col("size") + 1).over(Window.partitionBy("doc_id").orderBy("i")) - F.col("size") - 1
    placed = own.select(F.col("doc_id").alias("doc"), (F.col("i") + 1).alias("line"), (F.col("size") % 4).cast("int").alias("level"), before.alias("pos"))
    heads = placed.where("level > 0").select("doc", "pos", "level", F.concat(F.lit("h"), "line").alias("title"))
    return segments.breadcrumbs(placed.select("doc", F.col("pos").alias("off")), heads)


@query("WITH b AS (SELECT doc_id, sha256(text) AS v FROM documents WHERE doc_id % 7 <> 0), a AS (SELECT doc_id, sha256(CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END) AS v FROM documents WHERE doc_id % 5 <> 0) SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'created' WHEN a.doc_id IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM b FULL JOIN a ON a.doc_id = b.doc_id WHERE b.doc_id IS NULL OR a.doc_id IS NULL OR a.v <> b.v")
def j20_diff(t):
    sha = F.sha2("text", 256).alias("v")
    before = t.documents.where("doc_id % 7 <> 0").select("doc_id", sha)
    after = t.documents.where("doc_id % 5 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("v"))
    return merge.changes(before, after, "doc_id", "v")


@query("SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'xx' ELSE d.lang END AS lang, d.source FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def k10_point_update(t):
    updates = t.labels.select("doc_id", F.when(F.col("toxic") == 1, "xx").alias("lang"))
    return merge.updated(t.documents.select("doc_id", "lang", "source"), updates, "doc_id", ["lang"])


REPLY = "conversations WHERE role = 'assistant'"


@query(rf"SELECT conv_id, turn, regexp_matches(text, '^\s*The') AS starts, regexp_matches(text, '\.\s*$') AS ends FROM {REPLY}")
def m1_m8_starts_ends(t):
    return t.conversations.where("role = 'assistant'").select("conv_id", "turn", checks.starts_with(F.col("text"), "The").alias("starts"), checks.ends_with(F.col("text"), ".").alias("ends"))


@query(rf"""WITH p AS (SELECT conv_id, turn, replace(lower(regexp_replace(regexp_replace(regexp_replace(text, '`[^`\n]*`', ' ', 'g'), '<[^<>\n]+>', ' ', 'g'), '"[^"\n]*"', ' ', 'g')), 'the and', ' ') AS t FROM {REPLY} AND text NOT LIKE '%/%')
SELECT conv_id, turn, NOT regexp_matches(' ' || t || ' ', '[^\p{{L}}\p{{N}}](the|is)[^\p{{L}}\p{{N}}]') AS avoids FROM p""")
def m3_forbidden(t):
    replies = t.conversations.where("role = 'assistant' AND NOT text LIKE '%/%'")
    return replies.select("conv_id", "turn", checks.avoids(F.col("text"), ("the", "is"), ("the and",)).alias("avoids"))


@query(r"SELECT conv_id, turn, false AS chinese FROM conversations")
def m4_chinese(t):
    return t.conversations.select("conv_id", "turn", checks.in_chinese(F.col("text")).alias("chinese"))


FILE = "CASE doc_id % 3 WHEN 0 THEN '# license: free' || chr(10) || '# ' || text WHEN 1 THEN '# ' || text ELSE text END"


@query(rf"""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'a.md' ELSE 'a.py' END AS path, {FILE} AS content FROM documents), l AS (SELECT *, string_split(content, chr(10)) AS lines FROM f)
SELECT doc_id, CASE WHEN path = 'a.py' THEN starts_with(trim(lines[1]), '#') AND contains(lines[1], 'license:') END AS declares,
CASE WHEN path = 'a.py' THEN len(list_filter(lines[1:3], lambda x: starts_with(trim(x), '#') AND NOT contains(x, 'license:') AND len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')) >= 5)) > 0 END AS describes FROM l""")
def m5_m6_top_lines(t):
    path, content = F.expr("CASE WHEN doc_id % 4 = 0 THEN 'a.md' ELSE 'a.py' END"), F.expr(FILE)
    return t.documents.select("doc_id", checks.declares(path, content, "license:").alias("declares"), checks.describes(path, content, "license:").alias("describes"))


@query("SELECT doc_id, CASE WHEN strpos(text, 'the') > 0 THEN replace(substring(text, 1, strpos(text, 'the') - 1) || 'THE' || substring(text, strpos(text, 'the') + 3), ' ', '_') END AS edited FROM documents WHERE contains(text, ' ')")
def m11_edits(t):
    edits = F.array(F.struct(F.lit("the").alias("old"), F.lit("THE").alias("new"), F.lit(False).alias("every")), F.struct(F.lit(" ").alias("old"), F.lit("_").alias("new"), F.lit(True).alias("every")))
    return t.documents.where(F.contains("text", F.lit(" "))).select("doc_id", checks.edited(F.col("text"), edits).alias("edited"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS own, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) SELECT doc_id, line FROM l QUALIFY max(CASE WHEN regexp_matches(own, 'password|AKIA') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 1""")
def w16_grep_trailing(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "own"))
    return sessions.with_trailing(lines, "doc_id", "pos", F.col("own").rlike("password|AKIA")).select("doc_id", (F.col("pos") + 1).cast("long").alias("line"))


@query(r"""SELECT source, count(*) AS files, CAST(sum(CASE WHEN regexp_matches(text, 'Traceback|command not found') THEN 1 ELSE 0 END) AS BIGINT) AS crashes FROM documents GROUP BY source""")
def f19_crash_texts(t):
    return t.documents.groupBy("source").agg(F.count("*").alias("files"), F.sum(text.is_crash(F.col("text")).cast("long")).alias("crashes"))


@query("SELECT doc_id, source, n_chars FROM documents ORDER BY source, n_chars DESC, doc_id LIMIT 100")
def t1_sorted_head(t):
    """A head of a total order (the limit is the feature)."""
    return t.documents.select("doc_id", "source", "n_chars").orderBy("source", F.desc("n_chars"), "doc_id").limit(100)


@query("SELECT split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1) AS top, count(*) AS n FROM pages GROUP BY 1")
def a24_top_folder(t):
    return t.pages.groupBy(F.substring_index(F.regexp_replace("url", "^[a-z]+://", ""), "/", 1).alias("top")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS total, count(l.doc_id) AS done, count(*) FILTER (quality = 1) AS yes, count(*) FILTER (quality = 0) AS no, count(*) FILTER ((quality = 1) = (n_chars > 300)) AS agree FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def a33_annotation_progress(t):
    q = F.col("quality")
    both = t.documents.select("doc_id", "n_chars").join(t.labels.withColumn("judged", F.lit(1)), "doc_id", "left")
    return both.agg(F.count("*").alias("total"), F.count("judged").alias("done"), F.count_if(q == 1).alias("yes"), F.count_if(q == 0).alias("no"), F.count_if((q == 1) == (F.col("n_chars") > 300)).alias("agree"))
