"""Small documents, one for each rule of the grammar, with the units that they must give: written by hand, never taken from a run."""

#: name, text, units as (type, text, heading path).
CASES: list[tuple[str, str, list[tuple[str, str, str]]]] = [
    ("atx heading", "# Guide\n\nRead this first. Ask when unsure.\n", [("heading", "# Guide", ""), ("clause", "Read this first.", "Guide"), ("clause", "Ask when unsure.", "Guide")]),
    ("nested headings", "# Guide\n## Style\nUse short names.\n# Other\nKeep it simple.\n", [
        ("heading", "# Guide", ""), ("heading", "## Style", "Guide"), ("statement", "Use short names.", "Guide > Style"), ("heading", "# Other", ""), ("statement", "Keep it simple.", "Other")]),
    ("setext heading", "Layout\n------\n\nFolders come first", [("heading", "Layout\n------", ""), ("statement", "Folders come first", "")]),
    ("wrapped prose", "a line that\ngoes on below.\n", [("statement", "a line that\ngoes on below.", "")]),
    ("fenced code", "```py\n# comment here\n```\nRun it twice.\n", [("code", "```py\n# comment here\n```", ""), ("statement", "Run it twice.", "")]),
    ("tilde fence", "~~~\nabc def\n~~~\nRun it twice.\n", [("code", "~~~\nabc def\n~~~", ""), ("statement", "Run it twice.", "")]),
    ("indented code", "See below.\n\n    make all\n", [("statement", "See below.", ""), ("code", "make all", "")]),
    ("table", "| name | rule |\n|---|---|\n| tests | always |\n| docs | often |\n", [("table_header", "| name | rule |", ""), ("table_row", "| tests | always |", ""), ("table_row", "| docs | often |", "")]),
    ("ascii lead-in", "Before a commit:\n\n- run the tests\n- read the diff\n", [("lead_in", "Before a commit:", ""), ("statement", "- run the tests", ""), ("statement", "- read the diff", "")]),
    ("full-width lead-in", "提交之前：\n", [("lead_in", "提交之前：", "")]),
    ("full-width terminals", "先写测试。再写代码！\n", [("clause", "先写测试。", ""), ("clause", "再写代码！", "")]),
    ("markup only", "<project_rules>\n", [("markup", "<project_rules>", "")]),
    ("bold label alone", "**Coding Rules**\n", [("heading", "**Coding Rules**", "")]),
    ("bold item of a list", "- **Check it daily**\n", [("statement", "- **Check it daily**", "")]),
    ("abbreviations and versions", "Prefer e.g. python v3.1.2 over run.sh there.\n", [("statement", "Prefer e.g. python v3.1.2 over run.sh there.", "")]),
    ("long sides of a semicolon", "Write the failing test first; then make the test pass.\n", [("clause", "Write the failing test first;", ""), ("clause", "then make the test pass.", "")]),
    ("short sides of a semicolon", "build it; test it; ship\n", [("statement", "build it; test it; ship", "")]),
    ("front matter", "---\nname: helper\ndescription: Call it when the build breaks.\n---\nFix the cause.\n", [
        ("field_meta", "name: helper", ""), ("field", "description: Call it when the build breaks.", ""), ("statement", "Fix the cause.", "")]),
    ("fence opened by prose", "1. Answer in this form: ```\nResult: abc\n```。\n2. Name each file.\n", [
        ("statement", "1. Answer in this form: ```", ""), ("code", "Result: abc\n```。", ""), ("statement", "2. Name each file.", "")]),
    ("balanced fences stay", "Put code in ```\n\n```sh\nls -la\n```\n\nRead the output.\n", [("statement", "Put code in ```", ""), ("code", "```sh\nls -la\n```", ""), ("statement", "Read the output.", "")]),
    ("too few letters", "ok\n\n--\n\nyes it is\n", [("statement", "yes it is", "")]),
    ("empty", "", []),
    ("white space", " \n\t\n", []),
]


#: What becomes of a line of a document, by its place among the lines that hold letters: the block, and its units as (type, what stands before the unit in the
#: block, text); x is the line's words.
BLOCKS: list[tuple[str, list[tuple[str, str, str]]]] = [
    ("# {x}", [("heading", "", "# {x}")]),
    ("{x} one. Then {x} two.", [("clause", "", "{x} one."), ("clause", "{x} one. ", "Then {x} two.")]),
    ("- {x}", [("statement", "", "- {x}")]),
    ("```\n{x}\n```", [("code", "", "```\n{x}\n```")]),
    ("| {x} | b |\n|---|---|\n| c | {x} |", [("table_header", "", "| {x} | b |"), ("table_row", "| {x} | b |\n|---|---|\n", "| c | {x} |")]),
    ("{x} as follows:", [("lead_in", "", "{x} as follows:")]),
    ("> {x} is quoted here", [("statement", "", "> {x} is quoted here")]),
    ("{x}\n---", [("heading", "", "{x}\n---")]),
]


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def filled(template: str) -> str:
    """A template as an SQL expression of x."""
    return "(" + " || x || ".join(map(quoted, template.split("{x}"))) + ")"


def words_sql(line: str) -> str:
    return f"trim(regexp_replace({line}, '[^A-Za-z]+', ' ', 'g'))"


def sql() -> str:
    """The expected units as rows: name, idx, type, char_start, text, heading_path; those of the cases, and those of all documents put together from their lines."""
    units = [(n, k, *u) for n, (_, us) in enumerate(BLOCKS) for k, u in enumerate(us)]
    block = "CASE n % {} {} END".format(len(BLOCKS), " ".join(f"WHEN {n} THEN {filled(b)}" for n, (b, _) in enumerate(BLOCKS)))
    each = " UNION ALL ".join(f"SELECT name, n, {k} AS k, '{kind}' AS type, pos + length({filled(before)}) AS char_start, {filled(text)} AS text FROM b WHERE n % {len(BLOCKS)} = {n}" for n, k, kind, before, text in units)
    cases = ", ".join(f"({quoted(name)}, {i}, {quoted(kind)}, {quoted(unit)}, {quoted(path)})" for name, _, us in CASES for i, (kind, unit, path) in enumerate(us, 1))
    return f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
x AS (SELECT 'doc ' || doc_id AS name, {words_sql("line")} AS x, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n FROM l WHERE length(replace({words_sql("line")}, ' ', '')) >= 3),
b0 AS (SELECT *, {block} AS block FROM x),
b AS (SELECT *, sum(length(block) + 2) OVER (PARTITION BY name ORDER BY n) - length(block) - 2 AS pos FROM b0),
u AS ({each}),
h AS (SELECT name, n, x AS title, CASE WHEN n % {len(BLOCKS)} = 0 THEN 1 ELSE 2 END AS level FROM b WHERE n % {len(BLOCKS)} IN (0, 7)),
p AS (SELECT u.*, (SELECT max_by(title, n) FROM h WHERE h.name = u.name AND level = 1 AND h.n < u.n) AS t1, (SELECT max(n) FROM h WHERE h.name = u.name AND level = 1 AND h.n < u.n) AS n1,
  (SELECT max_by(title, n) FROM h WHERE h.name = u.name AND level = 2 AND h.n < u.n) AS t2, (SELECT max(n) FROM h WHERE h.name = u.name AND level = 2 AND h.n < u.n) AS n2 FROM u)
SELECT name, row_number() OVER (PARTITION BY name ORDER BY n, k) AS idx, type, text, char_start,
  CASE WHEN n % {len(BLOCKS)} = 0 THEN '' WHEN n % {len(BLOCKS)} = 7 THEN t1 WHEN n2 > n1 THEN t1 || ' > ' || t2 ELSE t1 END AS heading_path FROM p
UNION ALL SELECT name, CAST(idx AS BIGINT), type, text, CAST(-1 AS BIGINT), heading_path FROM (VALUES {cases}) v(name, idx, type, text, heading_path)"""
