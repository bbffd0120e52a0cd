"""Queries whose operators run Python; where no SQL form exists, tests hold them against invariants and plain versions."""

from pyspark.sql import functions as F

from quern.operators import python_backed, semantic
from quern.plans import grammar_cases
from quern.plans.registry import query


@query()
def g1_segment(t):
    return python_backed.segmented(t.documents)


@query()
def g14_clauses_in_context(t):
    return python_backed.clauses_in_context(t.documents)


@query(grammar_cases.sql())
def g2_g10_grammar_cases(t):
    """Units of known documents: all documents put together anew from their lines as blocks of each kind, whose units SQL knows; and small ones, one for
    each rule of the grammar, with units written by hand (their offsets are left to the tests: -1)."""
    words = lambda line: F.trim(F.regexp_replace(line, "[^A-Za-z]+", " "))
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), words), lambda x: F.length(F.replace(x, F.lit(" "), F.lit(""))) >= 3)

    def block(x, n):
        made = None
        for k, (template, _) in enumerate(grammar_cases.BLOCKS):
            own = F.concat(*(p for i, part in enumerate(template.split("{x}")) for p in ([x] if i else []) + [F.lit(part)]))
            hit = n % len(grammar_cases.BLOCKS) == k
            made = F.when(hit, own) if made is None else made.when(hit, own)
        return made

    built = t.documents.select(F.concat(F.lit("doc "), "doc_id").alias("name"), F.array_join(F.transform(lines, block), "\n\n").alias("text"))
    cases = t.spark.createDataFrame([(name, text) for name, text, _ in grammar_cases.CASES], "name string, text string")
    # each on its own: together they are in enough pieces for all cores, of which only those of the documents hold work
    found = python_backed.segmented(built, "name").unionByName(python_backed.segmented(cases, "name"))
    start = F.when(F.col("name").startswith("doc "), F.col("char_start")).otherwise(-1).cast("long")
    return found.select("name", F.col("idx").cast("long").alias("idx"), "type", "text", start.alias("char_start"), "heading_path")


# Both lists of marks are put into the texts, which hold none: a fence for each "the ", a heading for each "and ".
MARKED = "replace(replace(text, 'the ', chr(10) || '```' || chr(10)), 'and ', chr(10) || '## and' || chr(10))"


@query(f"""WITH l AS (SELECT doc_id, string_split({MARKED}, chr(10)) AS lines FROM documents), e AS (SELECT doc_id, unnest(lines) AS own, generate_subscripts(lines, 1) AS line FROM l),
f AS (SELECT doc_id, own, line, starts_with(trim(own), '```') OR sum(CASE WHEN starts_with(trim(own), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) % 2 = 1 AS code FROM e),
p AS (SELECT doc_id, own, line, row_number() OVER w AS k, count(*) OVER (PARTITION BY doc_id) AS n, lag(line) OVER w AS above FROM f WHERE NOT code WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
b AS (SELECT *, greatest(1, k - 8, coalesce(max(CASE WHEN own = '## and' THEN k END) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1)) AS lo,
  least(n, k + 2, coalesce(min(CASE WHEN own = '## and' THEN k END) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n)) AS hi FROM p)
SELECT b.doc_id, b.line, min(x.line) AS first, max(x.line) AS last, string_agg(CASE WHEN x.k > b.lo AND x.line <> x.above + 1 THEN '    ⋯' || chr(10) ELSE '' END || x.own, chr(10) ORDER BY x.k) AS context
FROM b JOIN p x ON x.doc_id = b.doc_id AND x.k BETWEEN b.lo AND b.hi GROUP BY b.doc_id, b.line""")
def w2_prose_context(t):
    """The whole context window: code left out, headings bound it, gaps are marked."""
    return python_backed.prose_contexts(t.documents.select("doc_id", F.expr(MARKED).alias("text")))


@query(r"""WITH r AS (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '[/`"<>]', ' ', 'g'), '\s+', ' ', 'g') AS text FROM conversations WHERE role = 'assistant' AND regexp_matches(text, '\b(he|she|they)\b'))
SELECT conv_id, turn, CAST(1 AS BIGINT) AS n_lines, '1: ' || trim(regexp_replace(text, '\b(he|she|they)\b', 'one', 'g')) AS fixed FROM r""")
def m2_rephrased(t):
    """Replies on one line, without marks that take text out of own prose; a forbidden word and the line as it should read."""
    replies = t.conversations.where("role = 'assistant'").withColumn("text", F.regexp_replace(F.regexp_replace("text", '[/`"<>]', " "), r"\s+", " "))
    found = python_backed.rephrased(replies, ["conv_id", "turn"], "text", r"\b(?:he|she|they)\b", "one")
    return found.select("conv_id", "turn", "n_lines", F.array_join("fixed", "|").alias("fixed"))


@query()
def f5_plain_text(t):
    return python_backed.plain_text(t.documents, "doc_id", "text")


# The stub answers "yes" unless the SHA-256 of the text, a number of base 16, is a multiple of 3; so is then the sum of its digits.
YES = "list_sum(list_transform(string_split(sha256({text}), ''), lambda x: strpos('0123456789abcdef', x) - 1)) % 3 <> 0"


FENCED = "replace(replace(coalesce(text, ''), 'the ', chr(10) || ' ```sh' || chr(10)), 'and ', chr(10) || '~~~' || chr(10))"


@query(f"""WITH k AS (SELECT doc_id, list_transform(string_split({FENCED}, chr(10)), lambda x: CASE WHEN starts_with(trim(x), '```') THEN 'b' WHEN starts_with(trim(x), '~~~') THEN 't' ELSE 'n' END) AS ks FROM documents)
SELECT doc_id, list_reduce(ks, lambda a, x: CASE WHEN a[1] = 'n' AND x = 'n' THEN a || '0' WHEN a[1] = 'n' THEN x || a[2:] || '1' WHEN x = a[1] THEN 'n' || a[2:] || '1' ELSE a || '1' END, 'n')[2:] AS mask FROM k""")
def w4_fence_mask(t):
    """Lines inside code where two kinds of fences stand in all texts: only its own mark closes one."""
    return python_backed.fence_masks(t.documents.select("doc_id", F.expr(FENCED.replace("chr(10)", "'\\n'")).alias("text")))


@query(f"SELECT doc_id, text, {YES.format(text="coalesce(text, '')")} AS is_rule FROM documents")
def l1_sem_filter(t):
    return semantic.sem_filter(t.documents.select("doc_id", "text"), "doc_id", "text", semantic.Stub)


@query(f"SELECT p_partkey || '#' || rep AS item, CASE WHEN {YES.format(text="coalesce(p_name, '')")} THEN 'yes' ELSE 'no' END AS answer FROM part, (VALUES (1), (2), (3)) r(rep)")
def l2_replicates(t):
    items = semantic.replicated(t.part.select("p_partkey", "p_name"), 3).withColumn("item", F.concat_ws("#", F.col("p_partkey").cast("string"), F.col("rep").cast("string")))
    return semantic.asked(items, "item", "p_name", semantic.Stub, 5)


def shouts(lines):
    return any("!!" in line for line in lines)


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS own, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
SELECT doc_id, CAST(line AS INT) AS first, CAST(line AS INT) AS last, 'line' AS note FROM l WHERE contains(own, '!!')""")
def m18_locate(t):
    """Where a check fails: all places of a text; here lines that shout."""
    return python_backed.violations(t.documents, "doc_id", "text", shouts).select("doc_id", "first", "last", "note")


def claims_both(lines):
    """Fails where one line opens and another closes, as two do that contradict each other."""
    return any("the" in line for line in lines) and any(line.endswith("?") for line in lines)


@query("""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), n AS (SELECT doc_id, list_filter(ls, lambda x: contains(x, 'the')) AS a, list_filter(ls, lambda x: ends_with(x, '?')) AS b FROM l)
SELECT doc_id, len(a) > 0 AND len(b) > 0 AS fails FROM n""")
def m18_joint(t):
    """Faults of two lines together: whether a place was found, which then holds one line of each kind or one that is both."""
    found = python_backed.violations(t.documents, "doc_id", "text", claims_both)
    whole = found.withColumn("ok", F.size("lines") <= 2).groupBy("doc_id").agg(F.min("ok").alias("ok"))
    return t.documents.select("doc_id").join(whole, "doc_id", "left").select("doc_id", F.coalesce("ok", F.lit(False)).alias("fails"))


RULES = [("drops", "if check($K, 'R'):\n    drop($K)", "lines", 2), ("checks", "check($ANY, $FLAG)", "width", 1000), ("functions", "def $F(*_any):\n    ...\n    return $X", "statements", 9)]


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, CASE WHEN l_suppkey % 2 = 0 THEN l_partkey ELSE l_partkey + 1 END || ')') AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT l_orderkey || '.py' AS path, 'drops' AS rule, CAST(2 * k AS INT) AS line, CAST(l_partkey AS VARCHAR) AS hole, 2 AS measure, false AS broken FROM l WHERE l_returnflag = 'R' AND l_suppkey % 2 = 0
UNION ALL SELECT l_orderkey || '.py', 'checks', CAST(2 * k AS INT), chr(39) || l_returnflag || chr(39), CAST(20 + length(CAST(l_partkey AS VARCHAR)) AS INT), false FROM l
UNION ALL SELECT DISTINCT l_orderkey || '.py', 'functions', 1, 'order', CAST(2 * n + 2 AS INT), 2 * n + 2 > 9 FROM l""")
def m23_patterns(t):
    """Code put together from the lines of all orders: a match binds $K twice, so a line that drops another number is none."""
    other = F.when(F.col("l_suppkey") % 2 == 0, F.col("l_partkey")).otherwise(F.col("l_partkey") + 1)
    line = F.concat(F.lit("    if check("), "l_partkey", F.lit(", '"), "l_returnflag", F.lit("'):\n        drop("), other, F.lit(")\n"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    rows = rows.repartition(t.spark.sparkContext.defaultParallelism, "l_orderkey")  # few bytes, much work: not to be merged by size
    files = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("own")))).alias("own"))
    content = F.concat(F.lit("def order():\n"), F.array_join(F.transform("own", lambda x: x["own"]), ""), F.lit("    return 1\n"))
    found = python_backed.pattern_matches(files.select(F.concat("l_orderkey", F.lit(".py")).alias("path"), content.alias("content")), RULES)
    hole = F.coalesce(F.col("holes")["K"], F.col("holes")["FLAG"], F.col("holes")["F"])
    return found.select("path", "rule", "line", hole.alias("hole"), "measure", "broken")


@query()
def w15_seeded_order(t):
    lists = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("lines"))
    return python_backed.shuffled(lists, "l_orderkey", "lines")


@query("""WITH n AS (SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + 2 AS INT) AS lines FROM documents) SELECT doc_id || '.py' AS path, 'f' AS name, 1 AS line, lines FROM n WHERE lines > 10""")
def m7_long_functions(t):
    code = F.concat(F.lit("def f():\n    x = '''"), F.col("text"), F.lit("'''\n"))
    return python_backed.long_functions(t.documents.select(F.concat(F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), code.alias("content")), 10)
