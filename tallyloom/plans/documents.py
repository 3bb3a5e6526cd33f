"""Layout, document checks, quizzes and extractors over tables made from the documents.

Each document stands for a page, a specification, a quiz or a file, whose contents are
expressions of its id that both engines evaluate. Where the SQL can't read such a text
as the query does, it says what the text was made from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.catalog import query, table
from tallyloom.functions.text import thousands
from tallyloom.operators import documents as D
from tallyloom.operators import layout as L
from tallyloom.session import ship_package

NL = "chr(10)"


def made(spark, sf_dir, columns: dict[str, str], per: int = 0) -> DataFrame:
    """A row of these columns per document, or `per` of them, numbered k from 0."""
    docs = ship_package(spark).read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.selectExpr("doc_id", f"explode(sequence(0L, {per - 1}L)) AS k") if per else docs
    return docs.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def made_sql(columns: dict[str, str], per: int = 0) -> str:
    rows = f"(SELECT doc_id, k FROM documents, range({per}) t(k))" if per else "documents"
    return f"(SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {rows})"


def joined(*parts: str) -> str:
    return " || ".join(parts)


# ---------------------------------------------------------------- layout


def box(k: str, right: int, down: int) -> dict[str, str]:
    """Corners of block k of a page, spread by two factors."""
    x0, y0 = f"(doc_id * 37 + {k} * {right}) % 400", f"(doc_id * 53 + {k} * {down}) % 700"
    return {"x0": x0, "y0": y0, "x1": f"({x0}) + 20 + (doc_id * 7 + {k} * 13) % 180", "y1": f"({y0}) + 15 + (doc_id * 11 + {k} * 29) % 120"}


def doubles(columns: dict[str, str]) -> dict[str, str]:
    return {c: f"CAST({e} AS DOUBLE)" for c, e in columns.items()}


PICTURE = box("k", 101, 197)
OF_LINE = box("(k % 4)", 101, 197)
BLOCKS = {"page": "doc_id", "block_id": "'p' || doc_id || '_' || k", "hint": "CASE k % 2 WHEN 0 THEN 'bild' ELSE 'tabelle' END", **doubles(PICTURE), "text": "''"}
TEXTS = {"page": "doc_id", "block_id": "'t' || doc_id || '_' || k", "hint": "'text'", **doubles(box("k", 103, 193)), "text": "'Text ' || k"}
LINES = {
    "page": "doc_id", "line_no": "k", **doubles({"x0": f"({OF_LINE['x0']}) + k * 9", "y0": f"({OF_LINE['y1']}) + (doc_id + k * 7) % 60 - 5", "x1": f"({OF_LINE['x0']}) + k * 9 + 100", "y1": f"({OF_LINE['y1']}) + (doc_id + k * 7) % 60 + 7"}),
    "text": "CASE (doc_id + k) % 4 WHEN 0 THEN 'Abbildung ' || k WHEN 1 THEN 'Foto ' || k WHEN 2 THEN 'Schaubild ' || k ELSE 'Tabelle ' || k END",
}
B_SQL, T_SQL, L_SQL = (f"SELECT * FROM {made_sql(c, n)}" for c, n in ((BLOCKS, 4), (TEXTS, 6), (LINES, 8)))


def blocks(spark, sf_dir):
    return made(spark, sf_dir, BLOCKS, 4)


@query(f"WITH b AS ({B_SQL}), t AS ({T_SQL}) SELECT block_id, text FROM t WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.page = t.page AND least(t.x1, b.x1) > greatest(t.x0, b.x0) AND least(t.y1, b.y1) > greatest(t.y0, b.y0) AND (least(t.x1, b.x1) - greatest(t.x0, b.x0)) * (least(t.y1, b.y1) - greatest(t.y0, b.y0)) / ((t.x1 - t.x0) * (t.y1 - t.y0)) > 0.5)")
def layout_overlap_anti(spark, sf_dir):
    return L.free_text(made(spark, sf_dir, TEXTS, 6), blocks(spark, sf_dir)).select("block_id", "text")


CAPTION_SQL = f"WITH b AS ({B_SQL}), l AS ({L_SQL}) SELECT b.block_id, coalesce(arg_min(l.text, (l.y0 - b.y1, -line_no)), '') AS caption FROM b LEFT JOIN l ON l.page = b.page AND greatest(0, least(b.x1, l.x1) - greatest(b.x0, l.x0)) / (b.x1 - b.x0) >= 0.3 AND l.y0 - b.y1 BETWEEN 0 AND 40 GROUP BY 1"


@query(CAPTION_SQL)
def layout_nearest_caption(spark, sf_dir):
    return L.captions(blocks(spark, sf_dir), made(spark, sf_dir, LINES, 8)).select("block_id", "caption")


@query(f"WITH b AS ({B_SQL}) SELECT block_id, hint = 'bild' AND (x1 - x0) * (y1 - y0) / (595.0 * 842.0) < 0.05 AND (x0 < 119 OR x1 > 476) AND (y0 < 168.4 OR y1 > 673.6) AS noise FROM b")
def layout_noise(spark, sf_dir):
    return blocks(spark, sf_dir).select("block_id", L.is_noise().alias("noise"))


@query(f"SELECT block_id, CASE WHEN regexp_matches(lower(caption), 'diagramm|abbildung|chart|grafik|schaubild') THEN 'diagramm' ELSE 'bild' END AS kind FROM ({CAPTION_SQL})")
def layout_classify(spark, sf_dir):
    return layout_nearest_caption(spark, sf_dir).select("block_id", L.picture_kind(F.col("caption")).alias("kind"))


@query(f"WITH b AS ({B_SQL}) SELECT page, block_id, row_number() OVER (PARTITION BY page ORDER BY round_even(y0, 1), round_even(x0, 1), block_id) AS place FROM b")
def layout_reading_order(spark, sf_dir):
    return L.reading_order(blocks(spark, sf_dir)).select("page", "block_id", "place")


PARTS = {
    "block_id": "'b' || doc_id", "typ": "CASE doc_id % 4 WHEN 0 THEN 'bild' WHEN 1 THEN 'tabelle' WHEN 2 THEN 'text' END", "quelldateireferenz": "'b' || doc_id || '.png'", "caption": "CASE WHEN doc_id % 3 > 0 THEN 'Foto ' || doc_id END",
    "beschreibung": "CASE WHEN doc_id % 5 > 0 THEN 'x' END", "akzeptiert": "CASE WHEN doc_id % 6 > 0 THEN doc_id % 6 > 2 END", "verworfen": "CASE WHEN doc_id % 7 > 0 THEN doc_id % 7 = 3 END",
}


@query(f"""SELECT block_id, '{{"typ":"' || coalesce(typ, '') || '","quelldateireferenz":"' || quelldateireferenz || '","caption":"' || coalesce(caption, '') || '"' || CASE WHEN typ IN ('bild', 'tabelle') THEN ',"beschreibung":"' || coalesce(beschreibung, '') || '"' || CASE WHEN NOT akzeptiert THEN ',"qualitaet":"niedrig"' ELSE '' END ELSE '' END || '}}' AS entry FROM {made_sql(PARTS)} WHERE NOT coalesce(verworfen, false)""")
def layout_manifest(spark, sf_dir):
    return L.manifest(made(spark, sf_dir, PARTS))


# ---------------------------------------------------------------- specifications

HAS = lambda n: f"(doc_id + {n}) % 7 > 0"
NODES, STATES, STOPS, SAMPLES = "(doc_id % 4 + 1)", "(doc_id % 5)", "(doc_id % 3)", "(doc_id % 4)"
some = lambda condition, text: f"CASE WHEN {condition} THEN {text} ELSE '' END"
head = lambda cells: f"'|{'|'.join('abcd'[:cells])}|' || {NL} || '|{'|'.join(['---'] * cells)}|' || {NL}"
BODIES = {
    2: joined(*[some(f"{SAMPLES} > {r}", f"'### Beispiel {r}' || {NL}") for r in range(4)]),
    3: joined(head(4), *[some(f"{STATES} > {r}", f"'| f{r} | ' || {some(f'(doc_id + {r}) % 3 > 0', chr(39) + 'str' + chr(39))} || ' | - | x |' || {NL}") for r in range(5)]),
    4: joined(head(2), *[some(f"{NODES} > {r}", f"'| `k{r}` | ' || doc_id || ' |' || {NL}") for r in range(4)], some("doc_id % 5 = 0", f"'| extra | y |' || {NL}")),
    5: joined(f"'- fertig → END' || {NL} || '- sonst → k0' || {NL}", some("doc_id % 4 = 0", f"'- fehlt -> nirgends' || {NL}")),
    6: joined(head(2), *[some(f"{STOPS} > {r}", f"'| z{r} | n |' || {NL}") for r in range(3)]),
    7: some("doc_id % 3 > 0", f"'recursion_limit = ' || doc_id || {NL}"),
    8: joined(f"'```mermaid' || {NL}", *[some(f"{NODES} > {r}", f"'k{r} -->' || {some(f'(doc_id + {r}) % 2 = 0', chr(39) + '|weiter|' + chr(39))} || ' k' || (({r} + 1) % {NODES}) || {NL}") for r in range(4)], f"'```' || {NL}"),
    9: some("doc_id % 2 = 0", f"'keine' || {NL}"),
}
TITLE = some("doc_id % 5 > 0", f"'# Titel ' || doc_id || {NL}")
SPEC = {"doc_id": "doc_id", "text": joined(TITLE, *[some(HAS(n), joined(f"'## {n}. Teil ' || (doc_id % {n}) || {NL}", *([BODIES[n]] if n in BODIES else []))) for n in range(1, 11)])}


def spec(spark, sf_dir):
    return made(spark, sf_dir, SPEC)


@query("SELECT doc_id, n AS number, 'Teil ' || (doc_id % n) AS title FROM documents, range(1, 11) t(n) WHERE (doc_id + n) % 7 > 0")
def md_sections(spark, sf_dir):
    return D.md_sections(spec(spark, sf_dir)).select("doc_id", "number", "title")


@query(f"""SELECT doc_id, 3 AS number, r AS "row", 'f' || r || ';' || CASE WHEN (doc_id + r) % 3 > 0 THEN 'str' ELSE '' END || ';-;x' AS cells FROM documents, range(5) t(r) WHERE {HAS(3)} AND r < {STATES}
UNION ALL SELECT doc_id, 4, r, CASE WHEN r < {NODES} THEN '`k' || r || '`;' || doc_id ELSE 'extra;y' END FROM documents, range(5) t(r) WHERE {HAS(4)} AND (r < {NODES} OR r = {NODES} AND doc_id % 5 = 0)
UNION ALL SELECT doc_id, 6, r, 'z' || r || ';n' FROM documents, range(3) t(r) WHERE {HAS(6)} AND r < {STOPS}""")
def md_tables(spark, sf_dir):
    return D.md_table_rows(D.md_sections(spec(spark, sf_dir)), "doc_id", "number").select("doc_id", "number", "row", F.array_join("cells", ";").alias("cells"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN 'Titel ' || doc_id ELSE 'Ohne' END AS title FROM documents")
def md_title(spark, sf_dir):
    return spec(spark, sf_dir).select("doc_id", D.md_title(F.col("text"), "Ohne").alias("title"))


@query(f"SELECT doc_id, 'k' || r AS source, 'k' || ((r + 1) % {NODES}) AS target, CASE WHEN (doc_id + r) % 2 = 0 THEN 'weiter' ELSE '' END AS label FROM documents, range(4) t(r) WHERE {HAS(8)} AND r < {NODES}")
def mermaid_edges(spark, sf_dir):
    return D.mermaid_edges(spec(spark, sf_dir)).select("doc_id", "source", "target", "label")


@query(f"""WITH p AS (SELECT doc_id, {NODES} AS m, {', '.join(f'{HAS(n)} AS h{n}' for n in range(1, 11))} FROM documents),
f AS (SELECT p.*, (SELECT coalesce(string_agg(n::VARCHAR, ', ' ORDER BY n), '') FROM range(1, 11) t(n) WHERE (p.doc_id + n) % 7 = 0) AS gaps,
  (SELECT coalesce(string_agg('f' || r, ', ' ORDER BY r), '') FROM range(5) t(r) WHERE r < p.doc_id % 5 AND (p.doc_id + r) % 3 = 0) AS poor,
  CASE WHEN h2 THEN doc_id % 4 ELSE 0 END AS samples, CASE WHEN h6 THEN doc_id % 3 ELSE 0 END AS stops,
  concat_ws(', ', CASE WHEN NOT h4 THEN 'k0' END, CASE WHEN doc_id % 4 = 0 THEN 'nirgends' END) AS lost,
  (SELECT string_agg('k' || r, '>' ORDER BY r) FROM range(4) t(r) WHERE r < p.m) AS ring FROM p)
SELECT doc_id, CASE gaps WHEN '' THEN 'OK' ELSE 'BEFUND' END AS status, 'A1' AS "check", gaps AS detail FROM f
UNION ALL SELECT doc_id, CASE WHEN NOT h3 OR doc_id % 5 = 0 THEN 'WARN' WHEN poor = '' THEN 'OK' ELSE 'BEFUND' END, 'A2', CASE WHEN h3 THEN poor ELSE '' END FROM f
UNION ALL SELECT doc_id, CASE WHEN samples >= 2 THEN 'OK' ELSE 'BEFUND' END, 'A5', samples::VARCHAR FROM f
UNION ALL SELECT doc_id, CASE WHEN h9 AND doc_id % 2 = 0 THEN 'OK' ELSE 'BEFUND' END, 'A6', '' FROM f
UNION ALL SELECT doc_id, CASE WHEN h7 AND doc_id % 3 > 0 THEN 'OK' ELSE 'BEFUND' END, 'A7', '' FROM f
UNION ALL SELECT doc_id, CASE WHEN NOT h4 OR NOT h8 THEN 'WARN' WHEN doc_id % 5 > 0 THEN 'OK' ELSE 'BEFUND' END, 'B6', CASE WHEN h4 AND h8 AND doc_id % 5 = 0 THEN 'extra' ELSE '' END FROM f
UNION ALL SELECT doc_id, CASE WHEN h5 AND lost = '' THEN 'OK' ELSE 'WARN' END, 'B4', CASE WHEN h5 THEN lost ELSE '' END FROM f
UNION ALL SELECT doc_id, 'INFO', 'D1', ring FROM f WHERE h8
UNION ALL SELECT doc_id, CASE WHEN NOT h8 THEN 'WARN' WHEN stops >= 1 THEN 'OK' ELSE 'BEFUND' END, 'D1', CASE WHEN h8 THEN '1/' || stops ELSE '' END FROM f""")
def spec_lint(spark, sf_dir):
    return D.spec_lint(spec(spark, sf_dir))


# ---------------------------------------------------------------- quizzes

LENGTHS = [f"(1 + (doc_id * {j + 1} + k * {j}) % 4)" for j in range(4)]
OPTION = [f"trim(repeat('w ', CAST({n} AS INT)))" for n in LENGTHS]
QUESTION = {"quiz": "doc_id", "no": "k + 1", "text": "'Frage ' || (k + 1)", "options": f"CASE WHEN (doc_id + k) % 11 = 0 THEN ARRAY({', '.join(OPTION[:3])}) ELSE ARRAY({', '.join(OPTION)}) END", "correct": "CAST(CASE WHEN (doc_id * 3 + k) % 13 = 0 THEN 4 ELSE (doc_id + k) % 4 END AS INT)", "explanation": "CASE WHEN k % 2 = 0 THEN 'weil ' || k ELSE '' END"}
IN_QUIZ = "NOT (doc_id % 6 = 0 AND k = 9)"
Q_SQL = f"(SELECT * FROM {made_sql(QUESTION | {'doc_id': 'doc_id', 'k': 'k'}, 10)} WHERE {IN_QUIZ})".replace("ARRAY(", "list_value(")


def quiz(spark, sf_dir):
    return made(spark, sf_dir, QUESTION | {"doc_id": "doc_id", "k": "k"}, 10).where(IN_QUIZ).drop("doc_id", "k")


@query(f"WITH q AS {Q_SQL} SELECT quiz, 0::BIGINT AS no, count(*) || ' questions' AS problem FROM q GROUP BY 1 HAVING count(*) <> 10 UNION ALL SELECT quiz, no, 'options' FROM q WHERE len(options) <> 4 UNION ALL SELECT quiz, no, 'correct' FROM q WHERE correct NOT BETWEEN 0 AND 3")
def quiz_structural(spark, sf_dir):
    return D.quiz_structure(quiz(spark, sf_dir))


@query(f"""WITH q AS {Q_SQL}, s AS (SELECT quiz, correct, list_transform(options, lambda o: len(string_split(o, ' '))) AS n FROM q WHERE len(options) = 4 AND correct BETWEEN 0 AND 3)
SELECT quiz, longest, counted, longest / counted::DOUBLE > 0.4 AS biased FROM (SELECT quiz, count(*) FILTER (WHERE list_position(n, list_max(n)) - 1 = correct AND list_min(n) < list_max(n)) AS longest, count(*) AS counted FROM s GROUP BY 1)""")
def quiz_word_balance(spark, sf_dir):
    return D.quiz_balance(quiz(spark, sf_dir))


@query(f"""WITH q AS {Q_SQL} SELECT quiz, '<h1>Q</h1><script>[' || string_agg('{{"text":"' || text || '","options":["' || array_to_string(options, '","') || '"],"correct":' || correct || ',"explanation":"' || explanation || '"}}', ',' ORDER BY no) || ']</script>' AS html FROM q GROUP BY 1""")
def quiz_html(spark, sf_dir):
    return D.quiz_html(quiz(spark, sf_dir), "<h1>{{TITLE}}</h1><script>{{QUESTIONS}}</script>", "Q")


@query(f"""WITH q AS {Q_SQL}, p AS (SELECT quiz FROM q GROUP BY 1 HAVING count(*) <> 10 UNION ALL SELECT quiz FROM q WHERE len(options) <> 4 UNION ALL SELECT quiz FROM q WHERE correct NOT BETWEEN 0 AND 3),
n AS (SELECT quiz, coalesce(n, 0) AS n FROM (SELECT DISTINCT quiz FROM q) LEFT JOIN (SELECT quiz, count(*) AS n FROM p GROUP BY 1) USING (quiz))
SELECT quiz, r::BIGINT AS round, n - r + 1 AS issues, n - r + 1 = 0 OR r = 3 AS done FROM n, range(1, 4) t(r) WHERE r <= n + 1""")
def quiz_loop(spark, sf_dir):
    """Checker and repair in turns, for every quiz: a round mends one problem; it ends without problems, or after three rounds."""
    rows = quiz(spark, sf_dir)
    n = D.quiz_structure(rows).groupBy("quiz").agg(F.count("*").alias("n"))
    every = rows.select("quiz").distinct().join(n, "quiz", "left").fillna(0, ["n"])
    turns = every.select("quiz", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(3), F.col("n") + 1))).alias("round"))
    left = F.col("n") - F.col("round") + 1
    return turns.select("quiz", "round", left.alias("issues"), ((left == 0) | (F.col("round") == 3)).alias("done"))


# ---------------------------------------------------------------- files

DQ, SQ, BACK, OPEN, CLOSE = "chr(34)", "chr(39)", "chr(92)", "chr(123)", "chr(125)"
JSON_NL = f"{BACK} || 'n'"  # a line break within a JSON string
TRIPLE = f"{DQ} || {DQ} || {DQ}"


def command(name: str, value: str) -> str:
    return joined(BACK, f"'{name}'", OPEN, value, CLOSE)


NOTEBOOK = joined(
    f"""'{{"cells": [{{"cell_type": "markdown", "source": ["# Kopf ' || doc_id || '"'""", f"""', "' || {JSON_NL} || 'Text"]}}, {{"cell_type": "code", "source": ["import m' || doc_id || '"'""", f"""', "' || {JSON_NL} || 'x = 1"]}}, {{"cell_type": "code", "source": []}}'""",
    some("doc_id % 2 = 0", """', {"cell_type": "markdown", "source": ["Ende"]}'"""), "']}'",
)
#: Of each kind: the file's text, its title, its excerpt.
FILES = {
    "csv": (
        joined(f"'x' || doc_id || ',y' || {NL}", *[some(f"doc_id % 4 > {r}", f"'{r},' || doc_id || {NL}") for r in range(3)]),
        "'x' || doc_id || ',y'",
        joined("'Spalten: x' || doc_id || ',y | Zeile 1: '", some("doc_id % 4 > 0", "'0,' || doc_id"), "' | ' || least(3, doc_id % 4) || ' Zeilen'"),
    ),
    "py": (
        f"CASE doc_id % 3 WHEN 0 THEN {joined(TRIPLE, chr(39) + 'Titel ' + chr(39), 'doc_id', NL, chr(39) + 'mehr' + chr(39), NL, TRIPLE, NL, chr(39) + 'import os' + chr(39), NL)} WHEN 1 THEN {joined(chr(39) + '# Kopf ' + chr(39), 'doc_id', NL, chr(39) + 'import a' + chr(39), 'doc_id', NL, chr(39) + 'from b import c' + chr(39))} ELSE {joined(chr(39) + 'x = 1' + chr(39), NL)} END",
        "CASE doc_id % 3 WHEN 0 THEN 'Titel ' || doc_id WHEN 1 THEN 'Kopf ' || doc_id ELSE '' END",
        "CASE doc_id % 3 WHEN 0 THEN 'Titel ' || doc_id || ' mehr' WHEN 1 THEN 'import a' || doc_id || ' | from b import c' ELSE '' END",
    ),
    "ipynb": (
        NOTEBOOK,
        "'Kopf ' || doc_id",
        joined(f"'# Kopf ' || doc_id || {NL} || 'Text'", some("doc_id % 2 = 0", "' | Ende'"), "' | Imports: import m' || doc_id"),
    ),
    "xml": (
        joined("'<r' || (doc_id % 9)", f"' xmlns=' || {DQ} || 'u' || {DQ} || '>'", *[some(f"doc_id % 13 > {r}", f"'<c{r}/>'") for r in range(12)], "'</r' || (doc_id % 9) || '>'"),
        "'r' || (doc_id % 9)",
        joined("'Root: r' || (doc_id % 9) || ' | Kinder: '", *[some(f"doc_id % 13 > {r}", f"'{', ' if r else ''}c{r}'") for r in range(10)]),
    ),
    "svg": (
        joined(f"'<svg xmlns=' || {DQ} || 'http://www.w3.org/2000/svg' || {DQ} || '>'", some("doc_id % 2 = 0", "'<title>T' || doc_id || '</title>'"), *[some(f"doc_id % 13 > {r}", f"'<text>t{r}</text>'") for r in range(12)], "'</svg>'"),
        some("doc_id % 2 = 0", "'T' || doc_id"),
        joined(*[some(f"doc_id % 13 > {r}", f"'{' | ' if r else ''}t{r}'") for r in range(10)]),
    ),
    "tex": (
        joined(command("title", "'Buch ' || doc_id"), *[some(f"doc_id % 7 > {r}", command("section", f"'Teil {r}'")) for r in range(6)]),
        "'Buch ' || doc_id",
        f"CASE WHEN doc_id % 7 = 0 THEN {command('title', chr(39) + 'Buch ' + chr(39) + ' || doc_id')} ELSE {joined(*[some(f'doc_id % 7 > {r}', chr(39) + (' → ' if r else '') + f'Teil {r}' + chr(39)) for r in range(5)])} END",
    ),
    "yaml": (
        joined(*[some(f"(doc_id + {r}) % 3 > 0", f"'k{r}: ' || doc_id") + f" || {NL}" for r in range(18)]),
        "CASE WHEN doc_id % 3 > 0 THEN 'k0: ' || doc_id ELSE 'k1: ' || doc_id END",
        f"CASE doc_id % 3 {' '.join(f'WHEN {m} THEN ' + joined(*[chr(39) + (' | ' if i else '') + f'k{r}: ' + chr(39) + ' || doc_id' for i, r in enumerate([r for r in range(15) if (m + r) % 3 > 0][:5])]) for m in range(3))} END",
    ),
    "eml": (
        joined(some("doc_id % 4 > 0", f"'Subject: Hallo ' || doc_id || {NL}"), f"'From: wer' || doc_id || '@example.org' || {NL} || {NL} || 'Text'"),
        some("doc_id % 4 > 0", "'Hallo ' || doc_id"),
        joined("'Von: wer' || doc_id || '@example.org | Betreff: '", some("doc_id % 4 > 0", "'Hallo ' || doc_id")),
    ),
}
EXTRACTORS = {"csv": D.csv_excerpt, "tex": D.tex_excerpt, "yaml": D.yaml_excerpt, "py": D.source_excerpt, "ipynb": D.notebook_excerpt, "xml": lambda t: D.excerpt_udf(D.xml_excerpt)(t), "svg": lambda t: D.excerpt_udf(D.xml_excerpt)(t), "eml": D.mail_excerpt}


def _add_extractors() -> None:
    for kind, (text, title, excerpt) in FILES.items():

        def extract(spark, sf_dir, kind=kind, text=text):
            files = made(spark, sf_dir, {"path": f"doc_id || '.{kind}'", "text": text})
            return files.select("path", EXTRACTORS[kind](F.col("text")).alias("e")).select("path", "e.title", "e.excerpt")

        extract.__name__ = f"extract_{kind}"
        query(f"SELECT doc_id || '.{kind}' AS path, {title} AS title, {excerpt} AS excerpt FROM documents")(extract)


_add_extractors()


@query(f"SELECT doc_id AS nb, 'import m' || doc_id || {NL} || 'x = 1' AS code, '# Kopf ' || doc_id || {NL} || 'Text' || CASE WHEN doc_id % 2 = 0 THEN {NL} || {NL} || '---' || {NL} || 'Ende' ELSE '' END AS markdown FROM documents")
def nb_split(spark, sf_dir):
    code, notes = D.notebook_parts(F.col("raw"))
    return made(spark, sf_dir, {"nb": "doc_id", "raw": NOTEBOOK}).select("nb", code.alias("code"), notes.alias("markdown"))


# ---------------------------------------------------------------- model answers and styles

FENCE = f"'```json' || {NL}"
#: Of each mode, for even and odd ids: the answer and the value that is found in it.
ANSWERS = {
    "array_first": ((joined(FENCE, "'[1, {\"a\": ' || doc_id || '}]'", NL, "'```'"), "'[1,{\"a\":' || doc_id || '}]'"), ("'vorher {\"a\": 1} nachher'", "'{\"a\":1}'")),
    "object_or_default": (("'nichts ' || doc_id", "'{\"completeness\":0.5,\"depth\":0.5}'"), ("'so: {\"depth\": ' || doc_id || '} gut'", "'{\"depth\":' || doc_id || '}'")),
    "think_and_fence": ((joined("'<think>{\"x\": 2}</think>'", FENCE, "'{\"a\": ' || doc_id || '}'", NL, "'```'"), "'{\"a\":' || doc_id || '}'"), ("'{\"b\": ' || doc_id || '} Ende'", "'{\"b\":' || doc_id || '}'")),
    "strict": (("'{\"a\": ' || doc_id || '} mehr'", "NULL"), ("' [' || doc_id || ', 2] '", "'[' || doc_id || ',2]'")),
    "widest_array": (("'vorher [' || doc_id || ',[2]] nachher'", "'[' || doc_id || ',[2]]'"), ("'[kaputt ' || doc_id", "'[]'")),
    "any": (("'Antwort: {\"b\": [' || doc_id || ']} ok'", "'{\"b\":[' || doc_id || ']}'"), ("'nichts'", "NULL")),
}
of_mode = lambda which: "CASE doc_id % 12 " + " ".join(f"WHEN {6 * odd + m} THEN {cases[odd][which]}" for m, cases in enumerate(ANSWERS.values()) for odd in (0, 1)) + " END"
MODE = "CASE doc_id % 6 " + " ".join(f"WHEN {m} THEN '{name}'" for m, name in enumerate(ANSWERS)) + " END"


@query(f"SELECT doc_id, {MODE} AS mode, {of_mode(1)} AS found FROM documents")
def llm_json_parse(spark, sf_dir):
    return D.parse_answers(made(spark, sf_dir, {"doc_id": "doc_id", "mode": MODE, "answer": of_mode(0)})).select("doc_id", "mode", "found")


RUN = {"p": "doc_id", "b": "doc_id % 2 = 0", "i": "doc_id % 3 = 0", "u": "doc_id % 5 = 0", "pt": "CASE WHEN doc_id % 7 > 0 THEN CAST(9 + doc_id % 6 AS DOUBLE) + CASE WHEN doc_id % 4 = 0 THEN 0.5 ELSE 0.0 END END", "mono": "doc_id % 11 = 0", "align": "CASE doc_id % 5 WHEN 0 THEN 'left' WHEN 1 THEN 'center' WHEN 2 THEN 'right' WHEN 3 THEN 'justify' END", "indent": "CAST(doc_id % 3 AS DOUBLE)"}


@query(f"SELECT p, '[' || concat_ws(', ', CASE WHEN b THEN 'B' END, CASE WHEN i THEN 'I' END, CASE WHEN u THEN 'U' END, CASE WHEN pt <> 11 THEN regexp_replace(pt::VARCHAR, '\\.0$', '') || 'pt' END, CASE WHEN mono THEN 'mono' END, CASE WHEN align IN ('center', 'right', 'justify') THEN align END, CASE WHEN indent > 0 THEN 'indent' END) || ']' AS hints FROM {made_sql(RUN)}")
def fmt_hints(spark, sf_dir):
    return made(spark, sf_dir, RUN).select("p", D.format_hints(*[F.col(n) for n in ("b", "i", "u", "pt", "mono", "align", "indent")]).alias("hints"))


@query("SELECT c_custkey, replace(format('{:,}', round(c_acctbal)::BIGINT), ',', '.') AS shown FROM customer")
def fmt_number(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", thousands(F.round("c_acctbal")).alias("shown"))


STYLE = lambda shift: f"CASE (doc_id + k{shift}) % 3 WHEN 0 THEN 'Normal' WHEN 1 THEN 'Titel' ELSE 'Text' END"


@query(f"""SELECT doc_id, k AS "index", CASE WHEN k < 4 THEN {STYLE('')} ELSE '?' END AS old_style, {STYLE(' * 2')} AS style FROM documents, range(6) t(k) WHERE k >= 4 OR {STYLE('')} <> {STYLE(' * 2')}""")
def style_changes(spark, sf_dir):
    old = made(spark, sf_dir, {"doc_id": "doc_id", "index": "k", "style": STYLE("")}, 4)
    return D.style_changes(old, made(spark, sf_dir, {"doc_id": "doc_id", "index": "k", "style": STYLE(" * 2")}, 6))
