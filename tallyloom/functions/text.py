"""Column expressions for text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Whitespace-separated tokens; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r\f]+"), lambda w: w != "")


def letter_tokens(text: Column) -> Column:
    """Lower-case runs of letters."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), "")


def clean(text: Column) -> Column:
    """Join hyphenated line ends, turn newlines into spaces, collapse white space."""
    joined = F.regexp_replace(text, r"-\s*\n\s*", "")
    return F.trim(F.regexp_replace(F.regexp_replace(joined, "\n", " "), r"\s+", " "))


def between_markers(text: Column, start: str, end: str) -> Column:
    """Text strictly between the line that has `start` and the marker `end`; unchanged if either is missing."""
    at = F.instr(text, start)
    line = F.expr(f"locate('\n', {_name(text)}, instr({_name(text)}, '{start}'))")
    stop = F.expr(f"locate('{end}', {_name(text)}, instr({_name(text)}, '{start}') + 1)")
    return F.when((at > 0) & (line > 0) & (stop > line), F.substring(text, line + 1, stop - line - 1)).otherwise(text)


def _name(column: Column) -> str:
    return column._jc.toString()


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Replace {key} for each given key; unknown placeholders stay."""
    for key, value in values.items():
        template = F.replace(template, F.lit("{" + key + "}"), value)
    return template


def placeholders(template: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{([a-z_]+)\}"), F.lit(1))))


#: How German letters are written in file names.
UMLAUTS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"))


def file_name(text: Column, most: int = 40) -> Column:
    """Lower case a-z, 0-9 and underscores, at most `most` characters."""
    out = F.lower(text)
    for a, b in UMLAUTS:
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(out, "[^a-z0-9]+", "_")
    return F.substring(F.regexp_replace(out, "^_+|_+$", ""), 1, most)


def size_text(size: Column, digits: int = 1, gap: str = " ") -> Column:
    """Bytes in the largest unit below 1024, up to TB; exact halves go to the even digit."""
    shown = lambda power, unit: F.format_string(f"%.{digits}f{gap}{unit}", F.bround(size / 1024.0**power, digits))
    out = shown(4, "TB")
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(size < 1024.0 ** (power + 1), shown(power, unit)).otherwise(out)
    return out


def thousands(value: Column) -> Column:
    """Whole numbers with points between thousands."""
    return F.replace(F.format_number(value, 0), F.lit(","), F.lit("."))


def parse_tokens(text: Column) -> Column:
    """The items of a list like ['a','b'], with or without quotes and brackets."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(text), r"^\[", ""), r"\]$", "")
    items = F.transform(F.split(inner, ","), lambda s: F.regexp_replace(F.regexp_replace(F.trim(s), "^['\"]", ""), "['\"]$", ""))
    return F.filter(items, lambda s: s != "")


def excerpt(text: Column) -> tuple[Column, Column]:
    """(title, excerpt) of plain text: from the first ten lines, without empty ones."""
    lines = F.filter(F.transform(F.slice(F.split(text, "\n"), 1, 10), lambda s: F.trim(s)), lambda s: s != "")
    heads = F.filter(lines, lambda s: s.startswith("#"))
    title = F.when(F.size(heads) > 0, F.trim(F.regexp_replace(F.get(heads, F.lit(0)), "^#+", ""))).otherwise(F.coalesce(F.get(lines, F.lit(0)), F.lit("")))
    return F.substring(title, 1, 120), F.substring(F.array_join(F.slice(lines, 1, 5), " | "), 1, 300)


#: What an HTML page has that is no text.
NO_TEXT = (r"(?s)<!--.*?-->", r"(?is)<(script|style|template)\b[^>]*>.*?</(script|style|template)\s*>", r"(?is)<!doctype[^>]*>")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def html_text(html: Column) -> Column:
    """The pieces of text between tags, without white space around them, joined by a space; the commonest entities are resolved."""
    for pattern in NO_TEXT:
        html = F.regexp_replace(html, pattern, "")
    pieces = F.filter(F.transform(F.split(html, r"<[^>]*>"), stripped), lambda s: s != "")
    text = F.array_join(pieces, " ")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def html_parts(html: Column) -> tuple[Column, Column, Column]:
    """(title, else the first heading; 300 characters of text; the first 300 characters as they stand), from the first 10,000 characters."""
    head = F.substring(html, 1, 10_000)
    title = stripped(F.regexp_extract(head, r"(?is)<title[^>]*>(.*?)</title>", 1))
    heading = html_text(F.regexp_extract(head, r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    return F.substring(F.when(title != "", title).otherwise(heading), 1, 120), F.substring(html_text(head), 1, 300), F.substring(head, 1, 300)


def json_parts(text: Column, most: int = 5000) -> tuple[Column, Column]:
    """(title, excerpt) of a JSON text, of which `most` characters are read: the first key and ten keys, or a list's length; nulls where that is no JSON."""
    read = F.substring(text, 1, most)
    keys, n = F.slice(F.json_object_keys(read), 1, 10), F.json_array_length(read)
    shown = F.array_join(keys, ", ")
    scalar = F.when(~read.rlike(r"^\s*[\[{]"), F.get_json_object(read, "$"))
    title = F.when(keys.isNotNull(), F.coalesce(F.get(keys, F.lit(0)), F.lit(""))).when(n.isNotNull(), F.concat(n.cast("string"), F.lit(" Einträge"))).when(scalar.isNotNull(), "")
    excerpt = F.when(keys.isNotNull(), F.concat(F.lit("Keys: "), shown)).when(n.isNotNull(), F.concat(F.lit("Array mit "), n.cast("string"), F.lit(" Einträgen"))).otherwise(scalar)
    return title, F.substring(excerpt, 1, 300)


def quoted(path: Column) -> Column:
    """A path for a URL: all but letters, digits, _.-~ and / as percent signs and bytes."""
    out = F.url_encode(path)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def rows_to_text(rows: Column) -> Column:
    """Rows of cells as lines with bars between cells; null is empty."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | ")), "\n")


def in_order(strings: Column, locale: str) -> Column:
    """An array of strings in the order of a locale; those that it holds equal by code point."""
    keyed = F.transform(strings, lambda s: F.struct(F.collate(s, locale).alias("k"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x.getField("s"))
