"""Texts and symbols in overlapping pieces, and texts that describe symbols."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomgrid.functions.text import token_estimate

#: How good a place is to cut a text; the sizes are those of 900 tokens of four characters, with an overlap of 15 % and a window of 200 tokens.
CUTS = (("# ", 100), ("## ", 90), ("### ", 80), ("#### ", 70), ("##### ", 60), ("###### ", 50))
FENCE, RULE, BLANK, ITEM, LINE = 80, 60, 20, 5, 1
SIZE, OVERLAP, WINDOW, DECAY = 3600, 540, 800, 0.7

_LINE_START = re.compile(r"\n(?=(#{1,6}(?!#))|(```)|((?:---|\*\*\*|___)\s*\n)|(\n)|([-*]\s|\d+\.\s))?")


def break_points(text: str) -> tuple[list[int], list[int]]:
    """(positions, scores) of all line ends, in order, each with the score of what follows it."""
    at, score = [], []
    for m in _LINE_START.finditer(text):
        heading, fence, rule, blank, item = m.groups()
        at.append(m.start())
        score.append(110 - 10 * len(heading) if heading else FENCE if fence else RULE if rule else BLANK if blank is not None else ITEM if item else LINE)
    return at, score


def fences(text: str) -> list[tuple[int, int]]:
    """(start, end) of fenced code; one that isn't closed lasts to the end."""
    marks = [m.start() for m in re.finditer(r"\n```", text)]
    closed = [(a, b + 4) for a, b in zip(marks[::2], marks[1::2])]
    return closed + ([(marks[-1], len(text))] if len(marks) % 2 else [])


def best_cut(at: list[int], score: list[int], closed: list[tuple[int, int]], target: int, window: int = WINDOW) -> int:
    """The place within `window` before the target with the best score, which falls with the square of the distance; never inside a fence; the earliest of equals."""
    best, place = -1.0, target
    for i in range(bisect_left(at, target - window), bisect_right(at, target)):
        if any(a < at[i] < b for a, b in closed):
            continue
        value = score[i] * (1 - ((target - at[i]) / window) ** 2 * DECAY)
        if value > best:
            best, place = value, at[i]
    return place


def chunks(text: str, size: int = SIZE, overlap: int = OVERLAP, window: int = WINDOW) -> list[tuple[int, str]]:
    """(position, piece): pieces of at most `size` characters that overlap; a short text is one piece."""
    if len(text) <= size:
        return [(0, text)]
    (at, score), closed = break_points(text), fences(text)
    out, start = [], 0
    while True:
        target = min(start + size, len(text))
        end = best_cut(at, score, closed, target, window) if target < len(text) else target
        end = end if start < end <= target else target
        out.append((start, text[start:end]))
        if end >= len(text):
            return out
        start = end - overlap if end - overlap > start else end


def chunk_by_tokens(text: str, count: Callable[[str], int], size: int = 900, overlap: int = 135) -> list[tuple[int, str]]:
    """As chunks, measured in tokens: first cut at three characters a token; a piece that is still too long is cut again at its own measured ratio, a little below."""
    out = []
    for at, piece in chunks(text, size * 3, overlap * 3, 600):
        n = count(piece)
        if n <= size:
            out.append((at, piece))
            continue
        room = max(1, int(size * len(piece) / n * 0.95))
        out += [(at + a, p) for a, p in chunks(piece, room, min(room // 6, overlap * 3), max(1, room // 5))]
    return out


def chunk_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP, window: int = WINDOW) -> DataFrame:
    """(id, seq, pos, text) of all documents; a null text has no piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, n, at, piece) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t is not None for n, (at, piece) in enumerate(chunks(t, size, overlap, window))]
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.string()))], names=[id_col, "seq", "pos", "piece"])

    return documents.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, f"{id_col} long, seq int, pos long, piece string")


def symbol_chunks(symbols: DataFrame, most_tokens: int = 512, overlap_tokens: int = 50) -> DataFrame:
    """(id, chunk, first, last, content) of symbols (id, start_line, content): one piece up to most_tokens (four characters each), else the first five lines and windows of lines that overlap, all as array expressions."""
    all_ = F.split("content", "\n")
    n = F.size(all_)
    per_line = F.greatest(F.lit(1.0), token_estimate(F.col("content")) / n)
    step = F.greatest(F.lit(1), F.ceil(most_tokens / per_line)).cast("int")
    back = F.least(F.greatest(F.lit(0), F.ceil(overlap_tokens / per_line)), step - 1).cast("int")
    head = F.least(F.lit(5), n)
    span = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))  # noqa: E731  0-based, end excluded
    rest = F.when(n > head, F.transform(F.sequence(head, n - 1, step), lambda i: span(F.greatest(F.lit(0), i - back), F.least(n, i + step)))).otherwise(F.array().cast("array<struct<a:int,b:int>>"))
    parts = F.when(token_estimate(F.col("content")) <= most_tokens, F.array(span(F.lit(0), n))).otherwise(F.concat(F.array(span(F.lit(0), head)), rest))
    rows = symbols.where("content is not null").withColumn("_all", all_).select("id", "start_line", "_all", F.posexplode(parts).alias("chunk", "p"))
    return rows.select("id", "chunk", (F.col("start_line") + F.col("p.a")).alias("first"), (F.col("start_line") + F.col("p.b") - 1).alias("last"), F.array_join(F.slice("_all", F.col("p.a") + 1, F.col("p.b") - F.col("p.a")), "\n").alias("content"))


def callsites(edges: DataFrame, nodes: DataFrame, files: DataFrame, around: int = 20, most: int = 10) -> DataFrame:
    """(target, rel_no, caller, first, last, content): the lines around a call, at most `most` calls per target. edges (rel_no, source, target, line), files (file_path, content)."""
    w = Window.partitionBy("target").orderBy("rel_no")
    some = edges.where("rel_type = 'calls' and target is not null and line is not null").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    joined = some.join(nodes.select(F.col("id").alias("source"), "file_path", F.col("name").alias("caller")), "source").join(files.select("file_path", "content"), "file_path")
    all_ = F.split("content", "\n")
    first, last = F.greatest(F.lit(1), F.col("line") - around), F.least(F.size(all_), F.col("line") + around)
    return joined.where(F.col("line") <= F.size(all_)).select("target", "rel_no", "caller", first.alias("first"), last.alias("last"), F.array_join(F.slice(all_, first, last - first + 1), "\n").alias("content"))


def node_text(nodes: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """(id, text): kind, name and signature of a symbol with up to `most` names (least first) of what it calls, what calls it, the types it uses and its members."""
    names = nodes.select("id", "name")

    def related(rel_type: str, own: str, other: str, title: str) -> DataFrame:
        e = edges.where((F.col("rel_type") == rel_type) & F.col(own).isNotNull() & F.col(other).isNotNull()).select(F.col(own).alias("of"), F.col(other).alias("id")).distinct().join(names, "id")
        top = e.withColumn("n", F.row_number().over(Window.partitionBy("of").orderBy("name", "id"))).where(F.col("n") <= most)
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]), ", ")
        return top.groupBy(F.col("of").alias("id")).agg(F.concat(F.lit(f"{title}: "), joined).alias(title.replace(" ", "_")))

    parts = [("calls", "source", "target", "calls"), ("calls", "target", "source", "called by"), ("uses_type", "source", "target", "uses types"), ("member_of", "target", "source", "members")]
    rows = nodes
    for p in parts:
        rows = rows.join(related(*p), "id", "left")
    head: Column = F.concat_ws(" ", F.initcap(F.replace("label", F.lit("_"), F.lit(" "))), F.when(F.col("class_name").isNotNull() & (F.col("label") == "method"), F.concat_ws(".", "class_name", "name")).otherwise(F.col("name")))
    text = F.concat_ws(". ", head, F.concat(F.lit("with signature "), "signature"), *[p[3].replace(" ", "_") for p in parts], F.concat(F.lit("Location: "), "file_path"), F.concat(F.lit("line "), F.col("start_line").cast("string")))
    return rows.select("id", text.alias("text"))
