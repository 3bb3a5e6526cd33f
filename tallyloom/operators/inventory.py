"""File inventory: flags, folders, naming patterns, issues, votes, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.store import store

#: Extensions by how well they can be read.
READABLE = [
    ".ipynb", ".py", ".js", ".ts", ".jsx", ".tsx", ".html", ".css", ".scss", ".less", ".ino", ".cpp", ".c", ".h", ".hpp", ".md", ".txt", ".rst", ".log", ".ini",
    ".cfg", ".toml", ".yaml", ".yml", ".csv", ".tsv", ".json", ".xml", ".docx", ".pptx", ".xlsx", ".svg", ".sh", ".bat", ".ps1", ".r", ".jl", ".lua", ".rb",
    ".php", ".sql", ".tex", ".bib",
]
PARTLY = [
    ".pdf", ".zip", ".tar", ".gz", ".7z", ".rar",
]
UNREADABLE = [
    ".pth", ".pkl", ".joblib", ".h5", ".hdf5", ".onnx", ".sps", ".hex", ".bin", ".dat", ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp", ".ico", ".tiff",
    ".mp4", ".avi", ".mov", ".mkv", ".wmv", ".flv", ".mp3", ".wav", ".flac", ".ogg", ".aac", ".wma", ".exe", ".dll", ".so", ".dylib", ".o", ".obj", ".class",
    ".pyc", ".pyo",
]
TEACHING = [
    ".docx", ".pdf", ".pptx", ".odt", ".odp", ".ods",
]
CODE = [
    ".ipynb", ".py", ".js", ".ts", ".jsx", ".tsx", ".html", ".css", ".ino", ".cpp", ".c", ".h", ".csv", ".json", ".pth", ".pkl", ".h5", ".onnx", ".joblib",
]
WITH_TEACHING = [
    ".docx", ".pdf", ".pptx", ".odt", ".odp", ".ods", ".xlsx", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".mp4", ".wav",
]
WITH_CODE = [
    ".ipynb", ".py", ".js", ".ts", ".jsx", ".tsx", ".html", ".css", ".json", ".csv", ".tsv", ".xlsx", ".pth", ".pkl", ".h5", ".onnx", ".joblib", ".txt", ".md",
    ".yaml", ".yml", ".toml", ".cfg", ".ini", ".sh", ".bat", ".pyc", ".pyo",
]
ARTEFACTS = [".pyc", ".pyo"]
IMAGES = [
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp", ".ico", ".tiff",
]
NO_EXTRACTOR = [
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp", ".ico", ".tiff", ".mp4", ".avi", ".mov", ".mkv", ".wmv", ".flv", ".mp3", ".wav", ".flac", ".ogg", ".aac",
    ".wma", ".pth", ".pkl", ".joblib", ".h5", ".hdf5", ".onnx", ".exe", ".dll", ".so", ".dylib", ".zip", ".tar", ".gz", ".7z", ".rar",
]
EXTRACTED = [
    ".docx", ".pptx", ".xlsx", ".xls", ".odt", ".ods", ".odp", ".pdf", ".ipynb", ".py", ".txt", ".md", ".rst", ".log", ".csv", ".tsv", ".json", ".yaml", ".yml",
    ".html", ".htm", ".svg", ".xml", ".rtf", ".tex", ".eml", ".js", ".ts", ".css", ".jsx", ".tsx", ".c", ".cpp", ".h", ".hpp", ".ino", ".r", ".jl", ".sql",
    ".sh", ".bat", ".ps1", ".lua", ".rb", ".php", ".ini", ".cfg", ".toml",
]
IGNORED_FILES = [".DS_Store", "Thumbs.db", "desktop.ini", ".gitkeep"]
LEGACY = {".odt": "Writer", ".ods": "Calc", ".odp": "Impress", ".doc": "Word", ".ppt": "PowerPoint", ".xls": "Excel"}

#: Names that say nothing, names that hide versions, characters that cause trouble.
GENERIC = r"(?iu)^(Untitled\d*|Copy of |Kopie von |.*\(\d+\)$|Neues Dokument|Dokument\d*|Unbenannt\d*|Mappe\d*|Tabelle\d*|Präsentation\d*)"
VERSIONED = r"(_final|_v\d+|_neu|_alt|_aktuell|_Kopie|_copy|_backup|_old|_new|_FINAL|_V\d+|_NEU|_ALT)"
TROUBLE = r"[#%&!@$^]|  +|\.\."


def readability(ext: Column) -> Column:
    e = F.lower(ext)
    return F.when(e.isin(READABLE), "voll").when(e.isin(PARTLY), "teilweise").when(e.isin(UNREADABLE), "nein").otherwise("unbekannt")


def name_flags(stem: Column, name: Column) -> list[Column]:
    """generic and versioned look at the stem, trouble at the whole name."""
    return [stem.rlike(GENERIC).alias("generic"), stem.rlike(VERSIONED).alias("versioned"), name.rlike(TROUBLE).alias("bad_chars")]


def visible(path: Column) -> Column:
    """Neither an ignored file nor below a hidden folder, and no lock file."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    hidden = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.startswith("."))
    return ~name.isin(IGNORED_FILES) & ~hidden & ~name.startswith("~")


def domain(teaching: Column, code: Column, total: Column) -> Column:
    return F.when(total == 0, "leer").when(teaching / total >= 0.7, "unterricht").when(code / total >= 0.7, "code").when((teaching > 0) & (code > 0), "gemischt").otherwise("unbestimmt")


def folders(files: DataFrame) -> DataFrame:
    """folder, depth, n_files, domain of each folder with files."""
    teaching, code = F.count_if(F.col("ext").isin(TEACHING)), F.count_if(F.col("ext").isin(CODE))
    return files.groupBy("folder").agg(F.size(F.split(F.first("folder"), "/")).cast("long").alias("depth"), F.count("*").alias("n_files"), domain(teaching, code, F.count("*")).alias("domain"))


def all_folders(files: DataFrame) -> DataFrame:
    """Every folder on a path to a file."""
    parts = F.split("folder", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return files.select("folder").distinct().select(F.explode(ups).alias("folder")).distinct()


def _naming(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(folder, n_files, separator; files with separator and prefix; folder, prefix, with_rest of the ten most frequent prefixes that occur twice)."""
    has = lambda s: F.count_if(F.contains("stem", F.lit(s)))
    none = F.count_if(~F.contains("stem", F.lit("_")) & ~F.contains("stem", F.lit("-")) & ~F.contains("stem", F.lit(" ")))
    votes = files.groupBy("folder").agg(has("_").alias("v1"), has("-").alias("v2"), has(" ").alias("v3"), none.alias("v4"), F.count("*").alias("n_files"))
    best = F.greatest("v1", "v2", "v3", "v4")
    sep = votes.select("folder", "n_files", F.when(F.col("v1") == best, "_").when(F.col("v2") == best, "-").when(F.col("v3") == best, " ").otherwise("_").alias("separator"))
    parts = files.join(sep, "folder").withColumn("prefix", F.expr("substring_index(stem, separator, 1)"))
    counts = parts.groupBy("folder", "prefix").agg(F.count("*").alias("n"), F.count_if(F.expr("contains(stem, separator)")).alias("with_rest")).where("n >= 2")
    return sep, parts, counts.withColumn("rn", F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("n"), "prefix"))).where("rn <= 10")


def naming_pattern(files: DataFrame) -> DataFrame:
    """folder, separator, prefixes (the ten most frequent that occur twice), hits, confidence.

    The separator with most votes splits the stems; ties go by the order _, -,
    space, none. Counts are aggregated before they are ranked, and of a folder's
    prefixes no more than ten leave a task's sort.
    """
    sep, _, kept = _naming(files)
    hits = kept.groupBy("folder").agg(F.sum("with_rest").alias("hits"), F.count("*").alias("prefixes"))
    out = sep.join(hits, "folder", "left").fillna(0, ["hits", "prefixes"])
    return out.select("folder", "separator", "prefixes", "hits", F.round(F.col("hits") / F.col("n_files"), 2).alias("confidence"))


def naming_outliers(files: DataFrame) -> DataFrame:
    """folder, name of the files that don't follow their folder's pattern: another prefix, or nothing behind it; all of them where a folder has none."""
    _, parts, kept = _naming(files)
    follows = parts.where(F.expr("contains(stem, separator)")).join(kept.select("folder", "prefix"), ["folder", "prefix"], "left_semi").select("path")
    return parts.join(follows, "path", "left_anti").select("folder", "name")


def entries(files: DataFrame) -> DataFrame:
    """folder, name, is_dir, path of what lies in every folder."""
    below = all_folders(files).where(F.contains("folder", F.lit("/")))
    parent = F.expr("substring_index(folder, '/', size(split(folder, '/')) - 1)")
    dirs = below.select(parent.alias("folder"), F.element_at(F.split("folder", "/"), -1).alias("name"), F.lit(True).alias("is_dir"), F.col("folder").alias("path"))
    return files.select("folder", "name", F.lit(False).alias("is_dir"), "path").unionByName(dirs)


def preview(files: DataFrame, most: int = 30, most_below: int = 8) -> DataFrame:
    """folder, place, below (0, or the place within a folder that is an entry), name, is_dir: the first entries of every folder, and of each folder among them.

    Folders first, then by name without regard to case. Of a folder's entries no more
    than `most` leave a task's sort.
    """
    ordered = lambda n: F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("is_dir"), F.lower("name"), "name"))
    every = store(entries(files), "entries").df
    first = store(every.withColumn("_n", ordered(most)).where(F.col("_n") <= most), "first").df
    inner = every.withColumn("_n", ordered(most_below)).where(F.col("_n") <= most_below).select(F.col("folder").alias("path"), F.col("name").alias("_name"), F.col("is_dir").alias("_dir"), F.col("_n").alias("_below"))
    nested = first.where("is_dir").join(inner, "path").select("folder", F.col("_n").cast("long").alias("place"), F.col("_below").cast("long").alias("below"), F.col("_name").alias("name"), F.col("_dir").alias("is_dir"))
    return first.select("folder", F.col("_n").cast("long").alias("place"), F.lit(0).cast("long").alias("below"), "name", "is_dir").unionByName(nested)


def found_folders(folders: DataFrame, term: str) -> DataFrame:
    """folder: the one that is the term, else all that have it in their path, whatever the case."""
    found = folders.where(F.contains(F.lower("folder"), F.lit(term.lower()))).withColumn("_exact", (F.col("folder") == term).cast("int"))
    best = found.agg(F.max("_exact").alias("_best"))
    return found.crossJoin(F.broadcast(best)).where("_exact = _best").select("folder")


def folder_issues(problems: DataFrame, folders: DataFrame, term: str) -> DataFrame:
    """problems whose path begins with the path of the one folder that the term finds, folders beside it of a longer name included; none where it finds several."""
    one = found_folders(folders, term).agg(F.count("*").alias("_n"), F.min("folder").alias("_folder")).where("_n = 1")
    return problems.crossJoin(F.broadcast(one)).where(F.startswith("path", F.col("_folder"))).drop("_n", "_folder")  # one row at most


def issues(files: DataFrame, empty: DataFrame) -> DataFrame:
    """rule, severity, path: one branch per rule over files and folders, which are stored once; empty: folder of those with no file below."""
    files = store(files, "files").df
    f = store(folders(files), "folders").df
    hit = lambda df, rule, severity, path: df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col(path).alias("path"))
    types = files.groupBy("folder", "ext").agg(F.count("*").alias("n")).join(f, "folder")
    allowed = F.when(F.col("domain") == "unterricht", F.col("ext").isin(WITH_TEACHING)).when(F.col("domain") == "code", F.col("ext").isin(WITH_CODE)).otherwise(F.col("ext").isin(WITH_TEACHING + WITH_CODE))
    same = files.groupBy("folder", "sha256").agg(F.count("*").alias("n")).where("n > 1")
    out = [
        hit(f.where("depth > 6"), "R-U02", "S2", "folder"),
        hit(f.where("depth > 4 and depth <= 6"), "R-U02", "S3", "folder"),
        hit(f.where("n_files = 1"), "R-U03", "S3", "folder"),
        hit(empty, "R-U04", "S4", "folder"),
        hit(same, "R-U05", "S1", "folder"),
        hit(types.where((F.col("n_files") >= 5) & (F.col("n") / F.col("n_files") < 0.2) & (F.col("n") <= 2) & ~allowed), "R-U07", "S2", "folder"),
        hit(files.where("bad_chars"), "R-U08", "S4", "path"),
        hit(files.where("versioned"), "R-U09", "S2", "path"),
        hit(files.where("generic"), "R-C01", "S1", "path"),
        hit(files.where(F.col("ext").isin(ARTEFACTS)), "R-C04", "S4", "path"),
    ]
    every = out[0]
    for o in out[1:]:
        every = every.unionByName(o)
    return every


def deduplicated_names(files: DataFrame) -> DataFrame:
    """files with unique_stem: __dupN from the second of a name on, in path order.

    Rows are dealt by ranges of name and path and numbered within each range; what
    earlier ranges have of a name is added. So a name that very many files have is no
    hot task.
    """
    spark = files.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = store(files.repartitionByRange(parts, "stem", "path").withColumn("_range", F.spark_partition_id()), "names").df
    before = Window.partitionBy("stem").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("stem", "_range").agg(F.count("*").alias("_c")).select(F.col("stem").alias("_stem"), F.col("_range").alias("_at"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    n = F.row_number().over(Window.partitionBy("stem", "_range").orderBy("path")) + F.col("_before")
    named = dealt.join(offsets, F.col("stem").eqNullSafe(F.col("_stem")) & (F.col("_range") == F.col("_at"))).withColumn("_n", n)
    return named.select(*files.columns, F.when(F.col("_n") > 1, F.concat("stem", F.lit("__dup"), F.col("_n").cast("string"))).otherwise(F.col("stem")).alias("unique_stem"))


def duplicate_groups(files: DataFrame, digest: str, key: str) -> DataFrame:
    """digest, n, first_id of each digest that two files or more have; null digests are no group."""
    return files.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.count("*").alias("n"), F.min(key).alias("first_id")).where("n > 1")


def duplicate_members(files: DataFrame, digest: str, key: str) -> DataFrame:
    """digest, key, first_id of every file in such a group: a row per file, so a group of any size is in no single row."""
    groups = store(duplicate_groups(files, digest, key), "groups").df  # two plain tables: a frequent digest can be split
    return files.join(groups, digest).select(digest, key, "first_id")


def neighbour_vote(indexed: DataFrame, rest: DataFrame, fallback: str = "_sonstige") -> DataFrame:
    """For each row of rest: the cluster most frequent in its folder, the one met first on a tie, and its first file.

    indexed: folder, path, cluster; votes are counted per folder, not per pair.
    """
    votes = indexed.where("cluster is not null").groupBy("folder", "cluster").agg(F.count("*").alias("n"), F.min("path").alias("lead"))
    best = votes.groupBy("folder").agg(F.min(F.struct((-F.col("n")).alias("m"), "lead", "cluster")).alias("b"))
    out = rest.join(best, "folder", "left")
    return out.select(*rest.columns, F.coalesce("b.cluster", F.lit(fallback)).alias("target"), F.col("b.lead").alias("lead"))


def assignment_gaps(known: DataFrame, assigned: DataFrame, key: str) -> DataFrame:
    """key, problem: known but not assigned, or assigned but not known."""
    missing = known.join(assigned, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    return missing.unionByName(assigned.join(known, key, "left_anti").select(key, F.lit("unknown").alias("problem")))


def undo_plan(log: DataFrame) -> DataFrame:
    """order, source, target: the last batch of an operation log, last step first, with source and target exchanged.

    Steps are dealt by ranges and numbered within each; the later ranges' counts are
    added, a row per range. Equal steps go by source, then target.
    """
    parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = log.agg(F.max("batch").alias("_last"))
    rows = log.join(F.broadcast(last), F.col("batch") == F.col("_last")).select("step", "source", "target")
    order = [F.col("step").desc(), F.col("source"), F.col("target")]
    dealt = store(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "steps").df
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_c"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # of `parts` rows at most
    offsets = counts.select(F.col("_range").alias("_at"), F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"))
    n = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    return dealt.join(F.broadcast(offsets), F.col("_range") == F.col("_at")).select(n.cast("long").alias("order"), F.col("target").alias("source"), F.col("source").alias("target"))
