"""File inventory on pseudo-paths: each document stands for a file."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.catalog import query, table
from tallyloom.functions import text as X
from tallyloom.operators import inventory as I
from tallyloom.sources import keywords as K

STEMS = ["'Untitled' || doc_id", "'Kopie von ' || doc_id", "'bericht(' || doc_id || ')'", "'plan_v' || (doc_id % 5)", "'plan_FINAL_' || doc_id", "'plan_Final_' || doc_id", "'a#' || doc_id", "'doppelt  ' || doc_id", "'x..' || doc_id", "'kapitel_' || doc_id", "'kapitel-' || doc_id", "'notiz ' || doc_id"]
EXTS = [".docx", ".pdf", ".py", ".ipynb", ".txt", ".png", ".md", ".csv", ".pyc", ".odt"]
#: The same expressions give the files in both engines.
FILES_SQL = (
    "SELECT doc_id, lang, folder, stem, ext, stem || ext AS name, folder || '/' || stem || ext AS path, n_chars AS size, modified, sha256 FROM ("
    "SELECT doc_id, lang, n_chars, source || '/' || lang || CASE WHEN doc_id % 13 = 0 THEN '/a/b/c/d/e/f' WHEN doc_id % 11 = 0 THEN '/a/b/c' WHEN doc_id % 17 = 0 THEN '/.git' WHEN doc_id % 97 = 0 THEN '/solo' || doc_id ELSE '' END AS folder, "
    "CASE doc_id % 12 " + " ".join(f"WHEN {k} THEN {e}" for k, e in enumerate(STEMS)) + " END AS stem, "
    "CASE doc_id % 10 " + " ".join(f"WHEN {k} THEN '{e}'" for k, e in enumerate(EXTS)) + " END AS ext, "
    "'2024-' || lpad(cast(1 + doc_id % 12 AS {s}), 2, '0') || '-' || lpad(cast(1 + doc_id % 28 AS {s}), 2, '0') AS modified, {sha} AS sha256 FROM documents) f"
)
DUCK_FILES = FILES_SQL.format(s="VARCHAR", sha="sha256(text)")
VISIBLE = "name NOT IN ('.DS_Store', 'Thumbs.db', 'desktop.ini', '.gitkeep') AND NOT regexp_matches('/' || path, '/\\.[^/]*/') AND name NOT LIKE '~%'"
FLAGS = r"""regexp_matches(stem, '(?i)^(Untitled\d*|Copy of |Kopie von |.*\(\d+\)$|Neues Dokument|Dokument\d*|Unbenannt\d*|Mappe\d*|Tabelle\d*|Präsentation\d*)') AS generic,
regexp_matches(stem, '(_final|_v\d+|_neu|_alt|_aktuell|_Kopie|_copy|_backup|_old|_new|_FINAL|_V\d+|_NEU|_ALT)') AS versioned,
regexp_matches(name, '[#%&!@$^]|  +|\.\.') AS bad_chars"""
CTE = f"WITH files AS ({DUCK_FILES}), seen AS (SELECT *, {FLAGS} FROM files WHERE {VISIBLE})"
listed = lambda xs: ", ".join(f"'{x}'" for x in xs)
FOLDERS = f""", fo AS (SELECT folder, depth, n_files, CASE WHEN t / n_files >= 0.7 THEN 'unterricht' WHEN c / n_files >= 0.7 THEN 'code' WHEN t > 0 AND c > 0 THEN 'gemischt' ELSE 'unbestimmt' END AS domain
FROM (SELECT folder, len(string_split(folder, '/'))::BIGINT AS depth, count(*) AS n_files, (count(*) FILTER (WHERE ext IN ({listed(I.TEACHING)})))::DOUBLE AS t, (count(*) FILTER (WHERE ext IN ({listed(I.CODE)})))::DOUBLE AS c FROM seen GROUP BY folder))"""
ISSUES = f""", iss AS (
SELECT 'R-U02' AS rule, 'S2' AS severity, folder AS path FROM fo WHERE depth > 6
UNION ALL SELECT 'R-U02', 'S3', folder FROM fo WHERE depth > 4 AND depth <= 6
UNION ALL SELECT 'R-U03', 'S3', folder FROM fo WHERE n_files = 1
UNION ALL SELECT 'R-U04', 'S4', folder FROM (SELECT DISTINCT array_to_string(string_split(folder, '/')[1:k], '/') AS folder FROM files, range(1, 20) t(k) WHERE k <= len(string_split(folder, '/'))) p WHERE NOT EXISTS (SELECT 1 FROM seen WHERE path LIKE p.folder || '/%')
UNION ALL SELECT 'R-U05', 'S1', folder FROM (SELECT folder, sha256 FROM seen GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'R-U07', 'S2', folder FROM (SELECT folder, ext, count(*) AS n FROM seen GROUP BY ALL) JOIN fo USING (folder) WHERE n_files >= 5 AND n / n_files::DOUBLE < 0.2 AND n <= 2 AND NOT CASE domain WHEN 'unterricht' THEN ext IN ({listed(I.WITH_TEACHING)}) WHEN 'code' THEN ext IN ({listed(I.WITH_CODE)}) ELSE ext IN ({listed(I.WITH_TEACHING + I.WITH_CODE)}) END
UNION ALL SELECT 'R-U08', 'S4', path FROM seen WHERE bad_chars UNION ALL SELECT 'R-U09', 'S2', path FROM seen WHERE versioned
UNION ALL SELECT 'R-C01', 'S1', path FROM seen WHERE generic UNION ALL SELECT 'R-C04', 'S4', path FROM seen WHERE ext IN ('.pyc', '.pyo'))"""


def files(spark, sf_dir):
    return spark.sql(FILES_SQL.format(s="STRING", sha="sha2(text, 256)").replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))


def seen(spark, sf_dir):
    f = files(spark, sf_dir).where(I.visible(F.col("path")))
    return f.select("*", *I.name_flags(F.col("stem"), F.col("name")))


@query(f"{CTE} SELECT path, name, ext, size, sha256 FROM seen")
def inv_scan(spark, sf_dir):
    return seen(spark, sf_dir).select("path", "name", "ext", "size", "sha256")


@query(f"{CTE} SELECT path, generic, versioned, bad_chars FROM seen")
def inv_name_flags(spark, sf_dir):
    return seen(spark, sf_dir).select("path", "generic", "versioned", "bad_chars")


@query(f"{CTE} SELECT path, CASE WHEN rn > 1 THEN stem || '__dup' || rn ELSE stem END AS unique_stem FROM (SELECT path, stem, row_number() OVER (PARTITION BY stem ORDER BY path) AS rn FROM seen)")
def inv_dedup_names(spark, sf_dir):
    return I.deduplicated_names(seen(spark, sf_dir)).select("path", "unique_stem")


@query(f"{CTE} SELECT ext, count(*) AS n FROM seen WHERE ext IN ({listed(I.LEGACY)}) AND name NOT LIKE '~%' GROUP BY 1")
def inv_legacy_formats(spark, sf_dir):
    return seen(spark, sf_dir).where(F.col("ext").isin(list(I.LEGACY))).groupBy("ext").agg(F.count("*").alias("n"))


@query(f"{CTE} SELECT CASE WHEN lower(ext) IN ({listed(I.READABLE)}) THEN 'voll' WHEN lower(ext) IN ({listed(I.PARTLY)}) THEN 'teilweise' WHEN lower(ext) IN ({listed(I.UNREADABLE)}) THEN 'nein' ELSE 'unbekannt' END AS readable, count(*) AS n FROM seen GROUP BY 1")
def inv_readability(spark, sf_dir):
    return seen(spark, sf_dir).groupBy(I.readability(F.col("ext")).alias("readable")).agg(F.count("*").alias("n"))


@query(f"{CTE} SELECT path FROM seen WHERE ext IN ('.png', '.pdf') OR (ext NOT IN ({listed(I.NO_EXTRACTOR)}) AND size > 0 AND ext IN ({listed(I.EXTRACTED)}))")
def inv_candidates(spark, sf_dir):
    text_ok = (extract_state(F.col("ext"), F.col("size")) == "ok")
    return seen(spark, sf_dir).where(text_ok | F.col("ext").isin(I.IMAGES) | (F.col("ext") == ".pdf")).select("path")


def extract_state(ext, size, most: int = 50 * 1024 * 1024):
    return F.when(ext.isin(I.NO_EXTRACTOR), "binär").when(~ext.isin(I.EXTRACTED), "kein_extraktor").when(size > most, "zu_gross").when(size == 0, "leer").otherwise("ok")


@query(f"{CTE} SELECT CASE WHEN ext IN ({listed(I.NO_EXTRACTOR)}) THEN 'binär' WHEN ext NOT IN ({listed(I.EXTRACTED)}) THEN 'kein_extraktor' WHEN size > 52428800 THEN 'zu_gross' WHEN size = 0 THEN 'leer' ELSE 'ok' END AS status, count(*) AS n FROM seen GROUP BY 1")
def extract_status(spark, sf_dir):
    return seen(spark, sf_dir).groupBy(extract_state(F.col("ext"), F.col("size")).alias("status")).agg(F.count("*").alias("n"))


@query(f"{CTE} SELECT path, CASE WHEN ext = '.png' THEN 'vision' WHEN ext NOT IN ({listed(I.NO_EXTRACTOR)}) AND ext IN ({listed(I.EXTRACTED)}) AND size > 0 THEN CASE WHEN doc_id % 3 > 0 AND ext IN ('.docx', '.pdf', '.odt') THEN 'hybrid' ELSE 'text' END WHEN ext = '.pdf' THEN 'pdf' ELSE 'keine' END AS channel FROM seen")
def channel_route(spark, sf_dir):
    """Images go to vision, texts with pictures are hybrid, a PDF without text is rendered, the rest is passed over."""
    f, images = seen(spark, sf_dir), F.col("doc_id") % 3
    ok = extract_state(F.col("ext"), F.col("size")) == "ok"
    route = F.when(F.col("ext").isin(I.IMAGES), "vision").when(ok & (images > 0) & F.col("ext").isin(".docx", ".pdf", ".odt"), "hybrid").when(ok, "text").when(F.col("ext") == ".pdf", "pdf").otherwise("keine")
    return f.select("path", route.alias("channel"))


@query(f"{CTE}{FOLDERS} SELECT folder, n_files, domain FROM fo")
def inv_domain(spark, sf_dir):
    return I.folders(seen(spark, sf_dir)).select("folder", "n_files", "domain")


@query(f"{CTE}, p AS (SELECT DISTINCT array_to_string(string_split(folder, '/')[1:k], '/') AS folder FROM seen, range(1, 20) t(k) WHERE k <= len(string_split(folder, '/'))) SELECT p.folder, count(seen.path) AS n_files FROM p LEFT JOIN seen USING (folder) GROUP BY 1")
def inv_files_per_folder(spark, sf_dir):
    f = seen(spark, sf_dir)
    return I.all_folders(f).join(f.select("folder", "path"), "folder", "left").groupBy("folder").agg(F.count("path").alias("n_files"))


@query(f"{CTE}, p AS (SELECT DISTINCT array_to_string(string_split(folder, '/')[1:k], '/') AS folder FROM files, range(1, 20) t(k) WHERE k <= len(string_split(folder, '/'))) SELECT folder FROM p WHERE NOT EXISTS (SELECT 1 FROM seen WHERE path LIKE p.folder || '/%')")
def inv_recursive_empty(spark, sf_dir):
    """Folders with no file below: an equality anti-join on every folder above a file."""
    f = files(spark, sf_dir)
    return I.all_folders(f).join(I.all_folders(seen(spark, sf_dir)), "folder", "left_anti")


@query(f"{CTE} SELECT folder, arg_max(name, (size, name)) AS largest, arg_min(name, (modified, name)) AS oldest, arg_max(name, (modified, name)) AS newest FROM seen GROUP BY 1")
def inv_folder_extremes(spark, sf_dir):
    by = lambda f, c: f("name", F.struct(c, "name"))
    return seen(spark, sf_dir).groupBy("folder").agg(by(F.max_by, "size").alias("largest"), by(F.min_by, "modified").alias("oldest"), by(F.max_by, "modified").alias("newest"))


@query(f"""{CTE}, v AS (SELECT folder, count(*) AS n_files, count(*) FILTER (WHERE contains(stem, '_')) AS v1, count(*) FILTER (WHERE contains(stem, '-')) AS v2, count(*) FILTER (WHERE contains(stem, ' ')) AS v3, count(*) FILTER (WHERE NOT contains(stem, '_') AND NOT contains(stem, '-') AND NOT contains(stem, ' ')) AS v4 FROM seen GROUP BY 1),
s AS (SELECT folder, n_files, CASE greatest(v1, v2, v3, v4) WHEN v1 THEN '_' WHEN v2 THEN '-' WHEN v3 THEN ' ' ELSE '_' END AS separator FROM v),
p AS (SELECT folder, string_split(stem, separator)[1] AS prefix, count(*) AS n, count(*) FILTER (WHERE contains(stem, separator)) AS r FROM seen JOIN s USING (folder) GROUP BY ALL HAVING count(*) >= 2),
k AS (SELECT folder, sum(r)::BIGINT AS hits, count(*) AS prefixes FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY folder ORDER BY n DESC, prefix) <= 10) GROUP BY 1)
SELECT folder, separator, coalesce(prefixes, 0) AS prefixes, coalesce(hits, 0) AS hits, round(coalesce(hits, 0) / n_files::DOUBLE, 2) AS confidence FROM s LEFT JOIN k USING (folder)""")
def inv_naming_pattern(spark, sf_dir):
    return I.naming_pattern(seen(spark, sf_dir))


@query(f"""{CTE}, v AS (SELECT folder, count(*) FILTER (WHERE contains(stem, '_')) AS v1, count(*) FILTER (WHERE contains(stem, '-')) AS v2, count(*) FILTER (WHERE contains(stem, ' ')) AS v3, count(*) FILTER (WHERE NOT contains(stem, '_') AND NOT contains(stem, '-') AND NOT contains(stem, ' ')) AS v4 FROM seen GROUP BY 1),
s AS (SELECT folder, CASE greatest(v1, v2, v3, v4) WHEN v1 THEN '_' WHEN v2 THEN '-' WHEN v3 THEN ' ' ELSE '_' END AS separator FROM v),
f AS (SELECT seen.*, separator, string_split(stem, separator)[1] AS prefix FROM seen JOIN s USING (folder)),
p AS (SELECT folder, prefix, count(*) AS n FROM f GROUP BY ALL HAVING count(*) >= 2),
k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY folder ORDER BY n DESC, prefix) <= 10)
SELECT folder, name FROM f WHERE NOT (contains(stem, separator) AND EXISTS (SELECT 1 FROM k WHERE k.folder = f.folder AND k.prefix = f.prefix))""")
def inv_naming_outliers(spark, sf_dir):
    return I.naming_outliers(seen(spark, sf_dir))


@query(f"{CTE}{FOLDERS}{ISSUES} SELECT * FROM iss")
def inv_issues(spark, sf_dir):
    return I.issues(seen(spark, sf_dir), inv_recursive_empty(spark, sf_dir))


@query(f"{CTE}{FOLDERS}{ISSUES} SELECT severity, rule, count(*) AS n, least(count(*), 50) AS shown FROM iss GROUP BY 1, 2")
def inv_issue_rollup(spark, sf_dir):
    return I.issues(seen(spark, sf_dir), inv_recursive_empty(spark, sf_dir)).groupBy("severity", "rule").agg(F.count("*").alias("n")).withColumn("shown", F.least("n", F.lit(50)))


@query(f"{CTE} SELECT count(*) AS n_files, count(DISTINCT folder) AS n_folders, sum(size)::BIGINT AS bytes, max(len(string_split(folder, '/')))::BIGINT AS max_depth FROM seen")
def inv_totals(spark, sf_dir):
    return seen(spark, sf_dir).agg(F.count("*").alias("n_files"), F.count_distinct("folder").alias("n_folders"), F.sum("size").alias("bytes"), F.max(F.size(F.split("folder", "/"))).cast("long").alias("max_depth"))


@query(f"""{CTE}, p AS (SELECT DISTINCT array_to_string(string_split(folder, '/')[1:k], '/') AS folder FROM seen, range(1, 20) t(k) WHERE k <= len(string_split(folder, '/'))),
e AS (SELECT folder, name, false AS is_dir, path FROM seen UNION ALL SELECT regexp_replace(folder, '/[^/]*$', ''), regexp_extract(folder, '[^/]*$'), true, folder FROM p WHERE contains(folder, '/')),
n AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY is_dir DESC, lower(name), name) AS k FROM e)
SELECT folder, k AS place, 0::BIGINT AS below, name, is_dir FROM n WHERE k <= 30
UNION ALL SELECT a.folder, a.k, b.k, b.name, b.is_dir FROM n a JOIN n b ON b.folder = a.path WHERE a.is_dir AND a.k <= 30 AND b.k <= 8""")
def inv_preview(spark, sf_dir):
    return I.preview(seen(spark, sf_dir))


@query(f"{CTE} SELECT DISTINCT folder FROM seen WHERE CASE WHEN EXISTS (SELECT 1 FROM seen WHERE folder = 'src1/de') THEN folder = 'src1/de' ELSE contains(lower(folder), 'src1/de') END")
def inv_folder_search(spark, sf_dir):
    """An exact match wins, else all that contain the term."""
    return I.found_folders(seen(spark, sf_dir).select("folder").distinct(), "src1/de")


@query(f"{CTE}{FOLDERS}{ISSUES}, t AS (SELECT CASE WHEN bool_or(folder = 'src1/de') THEN 'src1/de' WHEN count(*) FILTER (WHERE contains(lower(folder), 'src1/de')) = 1 THEN min(folder) FILTER (WHERE contains(lower(folder), 'src1/de')) END AS folder FROM fo) SELECT iss.* FROM iss, t WHERE starts_with(iss.path, t.folder)")
def inv_folder_issues(spark, sf_dir):
    """What is wrong in the folder that a search finds, and below."""
    f = seen(spark, sf_dir)
    return I.folder_issues(I.issues(f, inv_recursive_empty(spark, sf_dir)), f.select("folder").distinct(), "src1/de")


@query(f"{CTE} SELECT path, CASE WHEN size = 0 THEN 'leer' WHEN ext IN ({listed(I.NO_EXTRACTOR)}) THEN 'binär' ELSE 'offen' END AS category FROM seen WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND path NOT LIKE 'src0/%'")
def inv_leftovers(spark, sf_dir):
    """Files that no run has processed, outside the excluded folder, by why."""
    done = table(spark, sf_dir, "labels").select("doc_id")
    rest = seen(spark, sf_dir).join(done, "doc_id", "left_anti").where(~F.col("path").startswith("src0/"))
    return rest.select("path", F.when(F.col("size") == 0, "leer").when(F.col("ext").isin(I.NO_EXTRACTOR), "binär").otherwise("offen").alias("category"))


@query(f"{CTE}{FOLDERS} SELECT folder, to_json({{'folder': folder, 'depth': depth, 'n_files': n_files, 'domain': domain}})::VARCHAR AS record FROM fo")
def inv_export_json(spark, sf_dir):
    """Folders as JSON: the compact export, without file lists."""
    return I.folders(seen(spark, sf_dir)).select("folder", F.to_json(F.struct("folder", "depth", "n_files", "domain")).alias("record"))


DUPLICATES = "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1"


@query(DUPLICATES)
def dup_exact(spark, sf_dir):
    """Groups of equal files: how many, and the first."""
    return I.duplicate_groups(table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256")), "sha256", "doc_id")


@query(f"SELECT d.doc_id, g.first_id FROM documents d JOIN ({DUPLICATES}) g ON g.sha256 = sha256(d.text)")
def dup_members(spark, sf_dir):
    """Each file of such a group with the group's first."""
    return I.duplicate_members(table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256")), "sha256", "doc_id").select("doc_id", "first_id")


@query(f"{CTE} SELECT s.name, f.path, CASE WHEN f.path IS NULL THEN 'fehlt' ELSE 'ok' END AS status FROM (SELECT CASE WHEN doc_id % 7 = 0 THEN 'kein_' || name ELSE name END AS name FROM seen) s LEFT JOIN (SELECT name, min(path) AS path FROM seen GROUP BY 1) f USING (name)")
def join_lookup_missing(spark, sf_dir):
    """Names to paths; a name without a file is an error row."""
    f = seen(spark, sf_dir)
    asked = f.select(F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("kein_"), "name")).otherwise(F.col("name")).alias("name"))
    found = asked.join(f.groupBy("name").agg(F.min("path").alias("path")), "name", "left")
    return found.withColumn("status", F.when(F.col("path").isNull(), "fehlt").otherwise("ok"))


@query("SELECT doc_id, 'missing' AS problem FROM documents WHERE doc_id % 9 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'unknown' FROM labels WHERE doc_id % 9 = 0")
def validate_assignment(spark, sf_dir):
    known = table(spark, sf_dir, "documents").where("doc_id % 9 <> 0").select("doc_id")
    return I.assignment_gaps(known, table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query("""WITH i AS (SELECT source AS folder, lpad(doc_id::VARCHAR, 9, '0') AS path, lang AS cluster FROM documents JOIN labels USING (doc_id)),
v AS (SELECT folder, cluster, count(*) AS n, min(path) AS lead FROM i GROUP BY ALL), b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY folder ORDER BY n DESC, lead) = 1)
SELECT d.doc_id, coalesce(b.cluster, '_sonstige') AS target, b.lead FROM documents d LEFT JOIN b ON b.folder = d.source WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)""")
def neighbour_vote(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    indexed = docs.join(labels, "doc_id").select(F.col("source").alias("folder"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), F.col("lang").alias("cluster"))
    rest = docs.join(labels, "doc_id", "left_anti").select("doc_id", F.col("source").alias("folder"))
    return I.neighbour_vote(indexed, rest).select("doc_id", "target", "lead")


@query("WITH l AS (SELECT conv_id AS batch, turn AS step, role AS source, text AS target FROM conversations) SELECT row_number() OVER (ORDER BY step DESC) AS \"order\", target AS source, source AS target FROM l WHERE batch = (SELECT max(batch) FROM l)")
def oplog_undo_plan(spark, sf_dir):
    log = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("batch"), F.col("turn").alias("step"), F.col("role").alias("source"), F.col("text").alias("target"))
    return I.undo_plan(log)


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def ckpt_pending(spark, sf_dir):
    """What a checkpoint has not seen yet."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("SELECT doc_id, array_to_string(list_sort(list_distinct([lang, source, 'korpus', lang])), ',') AS keywords FROM documents")
def kw_merge(spark, sf_dir):
    """Sorted union of old and new keywords."""
    old, new = F.array("lang", "source"), F.array(F.lit("korpus"), "lang")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(F.array_union(old, new)), ",").alias("keywords"))


KW_KIND = "CASE doc_id % 3 WHEN 0 THEN '.docx' WHEN 1 THEN '.pdf' ELSE '.png' END"


@query(f"""WITH k AS (SELECT doc_id, doc_id || {KW_KIND} AS path, lang || ', korpus' AS newest, array_to_string(list_sort(list_distinct([source, lang, 'korpus'])), ', ') AS joint FROM documents)
SELECT path, CASE doc_id % 3 WHEN 2 THEN newest ELSE joint END AS keywords, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN left(joint, 120) ELSE 'Text ' || doc_id END AS description, 'ok' AS status FROM k""")
def kw_files(spark, sf_dir):
    """Every whole text as a document, a PDF or a picture; keywords are written to each file twice, then read from it."""
    docs = table(spark, sf_dir, "documents").selectExpr(f"doc_id || {KW_KIND} AS path", "text", "array(source, lang) AS first", "array(lang, 'korpus', ' ', lang) AS second", "'Text ' || doc_id AS about")
    return K.text_keywords(docs, ["first", "second"], description="about")


@query(f"{CTE} SELECT path, CASE WHEN b < 1024 THEN printf('%.1f B', b) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024) ELSE printf('%.1f MB', b / 1048576) END AS shown, CASE WHEN b < 1024 THEN printf('%.0fB', b) WHEN b < 1048576 THEN printf('%.0fKB', b / 1024) ELSE printf('%.0fMB', b / 1048576) END AS brief FROM (SELECT path, size::DOUBLE * 37 + 1 AS b FROM seen)")
def fmt_size(spark, sf_dir):
    b = F.col("size") * 37.0 + 1
    return seen(spark, sf_dir).select("path", X.size_text(b).alias("shown"), X.size_text(b, 0, "").alias("brief"))


def clean_sql(text: str, most: int) -> str:
    shown = f"lower({text})"
    for x, y in X.UMLAUTS:
        shown = f"replace({shown}, '{x}', '{y}')"
    return f"left(regexp_replace(regexp_replace({shown}, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), {most})"


LONG_STEM = "'Übung größer ' || stem || ' ' || lang || '-' || sha256"


@query(f"{CTE} SELECT path, {clean_sql('stem', 40)} AS clean_name, {clean_sql(LONG_STEM, 40)} AS folder_name, {clean_sql(LONG_STEM, 60)} AS file_name FROM seen")
def name_normalise(spark, sf_dir):
    """Names by the contract: 40 characters for folders, 60 for files."""
    long = F.expr(LONG_STEM)
    return seen(spark, sf_dir).select("path", X.file_name(F.col("stem")).alias("clean_name"), X.file_name(long, 40).alias("folder_name"), X.file_name(long, 60).alias("file_name"))
