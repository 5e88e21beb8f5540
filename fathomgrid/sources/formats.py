"""Result rows as JSON, CSV, Markdown, XML and plain file lists, rendered as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomgrid.functions.text import docid, escape_csv, escape_xml

CSV_HEADER = "docid,score,file,title,context,line,snippet"


def _id(hash_: Column) -> Column:
    return F.concat(F.lit("#"), docid(hash_))


def json_row(hash_: Column, score: Column, path: Column, title: Column, context: Column, snippet: Column) -> Column:
    """One JSON object with the score to two places; a null context or snippet is left out."""
    return F.to_json(F.struct(_id(hash_).alias("docid"), F.round(score, 2).alias("score"), path.alias("file"), title.alias("title"), context.alias("context"), snippet.alias("snippet")))


def csv_row(hash_: Column, score: Column, path: Column, title: Column, context: Column, line: Column, snippet: Column) -> Column:
    return F.concat_ws(",", _id(hash_), F.format_string("%.4f", score.cast("double")), escape_csv(path), escape_csv(title), escape_csv(context), line.cast("string"), escape_csv(snippet))


def files_row(hash_: Column, score: Column, path: Column, context: Column) -> Column:
    tail = F.when(context.isNotNull(), F.concat(F.lit(',"'), F.replace(context, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise("")
    return F.concat(_id(hash_), F.lit(","), F.format_string("%.2f", score.cast("double")), F.lit(","), path, tail)


def markdown_row(hash_: Column, path: Column, title: Column, context: Column, content: Column) -> Column:
    line = F.when(context.isNotNull(), F.concat(F.lit("**context:** "), context, F.lit("\n"))).otherwise("")
    return F.concat(F.lit("---\n# "), F.coalesce(F.nullif(title, F.lit("")), path), F.lit("\n\n**docid:** `"), _id(hash_), F.lit("`\n"), line, F.lit("\n"), content, F.lit("\n"))


def xml_row(hash_: Column, path: Column, title: Column, context: Column, content: Column) -> Column:
    mark = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f' {name}="'), escape_xml(c), F.lit('"'))).otherwise("")
    return F.concat(F.lit('<file docid="'), _id(hash_), F.lit('"'), mark("name", path), mark("title", title), mark("context", context), F.lit(">\n"), escape_xml(content), F.lit("\n</file>"))


FORMATS = ("json", "csv", "files", "md", "xml")


def render(results: DataFrame, form: str = "json") -> DataFrame:
    """results (hash, score, path, title, context, line, snippet) as one text column `row`; an unknown form is an error."""
    c = {n: F.col(n) for n in ("hash", "score", "path", "title", "context", "line", "snippet")}
    rows = {
        "json": lambda: json_row(c["hash"], c["score"], c["path"], c["title"], c["context"], c["snippet"]),
        "csv": lambda: csv_row(c["hash"], c["score"], c["path"], c["title"], c["context"], c["line"], c["snippet"]),
        "files": lambda: files_row(c["hash"], c["score"], c["path"], c["context"]),
        "md": lambda: markdown_row(c["hash"], c["path"], c["title"], c["context"], c["snippet"]),
        "xml": lambda: xml_row(c["hash"], c["path"], c["title"], c["context"], c["snippet"]),
    }
    if form not in rows:
        raise ValueError(f"format {form!r} is none of {', '.join(FORMATS)}")
    return results.select(rows[form]().alias("row"))


def write_text(rows: DataFrame, path: str, form: str = "json") -> None:
    """Rendered rows as text files, one row after another, written by the executors."""
    render(rows, form).write.mode("overwrite").text(path)
