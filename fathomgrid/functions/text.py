"""Scalar functions on texts, paths and names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by file extension.
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "py": "python", "go": "go", "java": "java", "rs": "rust", "php": "php", "rb": "ruby", "c": "c", "cpp": "cpp", "cs": "csharp", "swift": "swift", "kt": "kotlin", "md": "markdown"}
#: Labels of nodes.
EMBEDDABLE = ("file", "function", "class", "method", "interface", "type_alias", "enum")
SYMBOLS = ("function", "class", "method", "interface", "type_alias", "enum")
CALLABLE = ("function", "method")


def docid(hash_: Column) -> Column:
    """The first six digits of a content hash."""
    return F.substring(hash_, 1, 6)


def normalize_docid(text: Column) -> Column:
    """Trimmed, without matching quotes and a leading #, in lower case."""
    bare = F.regexp_replace(F.trim(text), r"^(['\"])(.*)\1$", "$2")
    return F.lower(F.regexp_replace(bare, "^#", ""))


def is_docid(text: Column) -> Column:
    return normalize_docid(text).rlike("^[0-9a-f]{6,}$")


def title(body: Column, path: Column) -> Column:
    """The first heading of a Markdown text (behind one that says Notes, the next second-level one), else the file's name without its extension."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")
    first = F.trim(F.regexp_extract(body, r"(?m)^##?[ \t]+(.+)$", 1))
    second = F.trim(F.regexp_extract(body, r"(?m)^##[ \t]+(.+)$", 1))
    heading = F.when(first.isin("Notes", "📝 Notes") & (second != ""), second).otherwise(first)
    return F.when(F.lower(path).endswith(".md") & (heading != ""), heading).otherwise(stem)


def slug_path(path: Column) -> Column:
    """Lower-case path of letters, digits and $, joined by dashes; ___ parts folders and the last extension stays. Null where the name has no usable character."""
    segments = F.split(F.lower(F.replace(path, F.lit("___"), F.lit("/"))), "/")
    dashed = lambda s: F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{N}$]+", "-"), "^-+|-+$", "")
    last = F.element_at(segments, -1)
    ext = F.regexp_extract(last, r"(\.[a-z0-9]+)$", 1)
    name = F.concat(dashed(F.left(last, F.length(last) - F.length(ext))), ext)
    folders = F.transform(F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0))), dashed)
    usable = F.regexp_replace(F.element_at(F.filter(F.split(path, "/"), lambda s: s != ""), -1), r"\.[^.]+$", "").rlike(r"[\p{L}\p{N}$]")
    return F.when(usable, F.array_join(F.filter(F.concat(folders, F.array(name)), lambda s: s != ""), "/"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language(path: Column) -> Column:
    """The language of a path's extension; null for others."""
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(names, extension(path))


def is_code_file(path: Column) -> Column:
    return F.coalesce(language(path).isNotNull() & (language(path) != "markdown"), F.lit(False))


def is_test_path(path: Column) -> Column:
    p = F.lower(path)
    return p.contains("/test/") | p.contains("/tests/") | p.contains("__tests__") | p.contains(".test.") | p.contains(".spec.") | p.rlike(r"(^|[\\/._-])(test|spec)([\\/._-]|$)")


def virtual_path(scheme: str, collection: Column, path: Column) -> Column:
    return F.concat(F.lit(f"{scheme}://"), collection, F.lit("/"), path)


def virtual_parts(text: Column) -> Column:
    """(collection, path) of a virtual path; null where it is none."""
    return F.when(text.rlike("^[a-z]+://[^/]+/.*$"), F.struct(F.regexp_extract(text, "^[a-z]+://([^/]+)/", 1).alias("collection"), F.regexp_extract(text, "^[a-z]+://[^/]+/(.*)$", 1).alias("path")))


def node_id(label: Column, path: Column, name: Column) -> Column:
    return F.concat_ws(":", label, path, name)


def node_parts(id_: Column) -> Column:
    """(label, path, name): the first part, the last and what stands between."""
    parts = F.split(id_, ":")
    return F.struct(F.get(parts, F.lit(0)).alias("label"), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), ":").alias("path"), F.element_at(parts, -1).alias("name"))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def camel_parts(word: Column) -> Column:
    spaced = F.regexp_replace(F.regexp_replace(word, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(spaced, r"\s+"), lambda s: s != "")


def snake_parts(word: Column) -> Column:
    return F.filter(F.split(word, "_"), lambda s: s != "")


def kebab_parts(word: Column) -> Column:
    return F.filter(F.split(word, "-"), lambda s: s != "")


def normalize_identifiers(name: Column) -> Column:
    """Parts of camel and snake case, lower case, longer than one character and unlike the name, without repeats."""
    parts = F.transform(F.flatten(F.transform(camel_parts(name), snake_parts)), F.lower)
    return F.array_distinct(F.filter(parts, lambda p: (F.length(p) > 1) & (p != F.lower(name))))


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def full_text_terms(query: Column) -> Column:
    """Terms of a query by white space, reduced to letters, digits and apostrophes."""
    bare = F.transform(F.split(F.lower(query), r"\s+"), lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}']", ""))
    return F.filter(bare, lambda t: t != "")


def lines(body: Column, start: int, count: int) -> Column:
    """`count` lines from line `start` (1-based) on."""
    return F.array_join(F.slice(F.split(body, "\n"), start, count), "\n")


def number_lines(body: Column, start: int = 1) -> Column:
    return F.array_join(F.transform(F.split(body, "\n"), lambda s, i: F.concat((i + start).cast("string"), F.lit(": "), s)), "\n")


def truncate_lines(body: Column, keep: int) -> Column:
    all_ = F.split(body, "\n")
    rest = F.size(all_) - keep
    return F.when(rest > 0, F.concat(F.array_join(F.slice(all_, 1, keep), "\n"), F.lit("\n[... truncated "), rest.cast("string"), F.lit(" more lines]"))).otherwise(body)


def snippet(body: Column, query_terms: list[str], most: int = 500) -> Column:
    """(line, header, text): the first line with most of the terms, with one line before and two after it."""
    all_ = F.split(body, "\n")
    score = lambda s: sum((F.lower(s).contains(t).cast("int") for t in query_terms), F.lit(0))
    scores = F.transform(all_, score)
    best = F.array_position(scores, F.array_max(scores)).cast("int")
    start = F.greatest(best - 1, F.lit(1))
    stop = F.least(F.size(all_), best + 2)
    text = F.array_join(F.slice(all_, start, stop - start + 1), "\n")
    cut = F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)
    count = stop - start + 1
    header = F.format_string("@@ -%d,%d @@ (%d before, %d after)", start, count, start - 1, F.size(all_) - stop)
    return F.struct(best.alias("line"), header.alias("header"), cut.alias("text"))


def highlight(text: Column, words: list[str], before: str = "**", after: str = "**") -> Column:
    """Words of three characters or more, in any letter case, between marks."""
    import re

    for w in (w for w in words if len(w) >= 3):
        text = F.regexp_replace(text, f"(?i)({re.escape(w)})", f"{before}$1{after}")
    return text


def escape_csv(text: Column) -> Column:
    return F.when(text.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(text, F.lit("")))


def escape_xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def format_bytes(n: Column) -> Column:
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    return F.when(n < kb, F.format_string("%d B", n.cast("long"))).when(n < mb, F.format_string("%.1f KB", n / kb)).when(n < gb, F.format_string("%.1f MB", n / mb)).otherwise(F.format_string("%.1f GB", n / gb))


def time_ago(at: Column, now: Column) -> Column:
    s = F.timestamp_diff("SECOND", F.date_trunc("second", at).cast("timestamp_ntz"), now.cast("timestamp_ntz"))
    of = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(unit))
    return F.when(s < 60, of(1, "s ago")).when(s < 3600, of(60, "m ago")).when(s < 86400, of(3600, "h ago")).otherwise(of(86400, "d ago"))


def format_score(score: Column) -> Column:
    return F.concat(F.lpad(F.round(score * 100).cast("int").cast("string"), 3, " "), F.lit("%"))


def uri_path(path: Column) -> Column:
    """Each segment percent-encoded."""
    return F.array_join(F.transform(F.split(path, "/"), lambda s: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))), "/")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 for unlike lengths and for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def format_eta(seconds: Column) -> Column:
    """Seconds as 5s, 2m 5s or 3h 2m; fractions are cut off."""
    s = F.floor(seconds)
    text = lambda c: c.cast("string")
    return F.when(s < 60, F.concat(text(s), F.lit("s"))).when(s < 3600, F.concat(text(F.floor(s / 60)), F.lit("m "), text(s % 60), F.lit("s"))).otherwise(F.concat(text(F.floor(s / 3600)), F.lit("h "), text(F.floor(s % 3600 / 60)), F.lit("m")))


def label_of_kind(kind: Column) -> Column:
    """The label of a parsed symbol: its own kind where nodes have that label, else a function (so for constants and variables)."""
    return F.when(kind.isin("class", "interface", "type_alias", "enum", "method"), kind).otherwise("function")


def normal_separators(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def is_absolute(path: Column) -> Column:
    """Whether a path begins at a root: /x, C:\\x or C:/x."""
    return path.rlike(r"^(/|[A-Za-z]:([\\/]|$))")


def relative_to(path: Column, prefix: Column) -> Column:
    """The part of a path below a folder ('' for the folder itself); null where it isn't below."""
    p, f = normal_separators(path), F.regexp_replace(normal_separators(prefix), "/+$", "")
    return F.when(p == f, "").when(F.startswith(p, F.concat(f, F.lit("/"))), F.substr(p, F.length(f) + 2))


def resolve(*parts: Column) -> Column:
    """Paths one after the other, each below the ones before unless absolute; '.' and '..' are carried out. /c/x counts as C:/x where a drive letter stands alone."""
    whole = None
    for part in parts:
        p = F.regexp_replace(normal_separators(part), r"^/([a-zA-Z])(?=/[a-zA-Z]:|$)", "$1:")
        whole = p if whole is None else F.when(is_absolute(p), p).otherwise(F.concat(whole, F.lit("/"), p))
    drive = F.regexp_extract(whole, r"^([A-Za-z]:)", 1)
    up = lambda done, x: F.when(x.isin("", "."), done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, x))
    steps = F.aggregate(F.split(F.regexp_replace(whole, r"^[A-Za-z]:", ""), "/"), F.array().cast("array<string>"), up)
    return F.concat(drive, F.lit("/"), F.array_join(steps, "/"))
