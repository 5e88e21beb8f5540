"""Text that was decoded with the wrong character encoding: found and restored through the garbled forms of the corpus' own words.

Every distinct word (and every distinct character) of the corpus is encoded
and decoded along all chains of encodings; the forms are hash-joined with the
words that occur, and the words of each document with the matches. A match
says that the word is a garbled form of another, which is put back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgrid.plans.durable import materialize

#: Encodings in which texts are written, and those with which they are read by mistake.
WRITTEN = ("utf-8", "cp1252", "latin-1", "iso8859-15", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "cp437", "cp850", "mac_roman")
READ = ("cp1252", "latin-1", "utf-8", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "cp437", "cp850", "mac_roman")
#: All characters beyond ASCII of the code pages: what a text consists of after a misreading.
MISREAD = sorted({c for r in READ if r != "utf-8" for c in bytes(range(0x80, 0x100)).decode(r, "replace")} - {"\ufffd"})

#: A word: letters and digits of ASCII, and all characters beyond it (a garbled letter may be any of those).
_WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")
_RUN = re.compile(r"[\u0080-\U0010ffff]+")
_LOST = "�"


def _read(raw: bytes, how: str, errors: str) -> str:
    """Decode as lenient programs do: bytes without a character in a code page become control characters."""
    try:
        return raw.decode(how)
    except UnicodeDecodeError:
        if how == "utf-8":
            return raw.decode(how, "replace") if errors == "replace" else ""
        return "".join(_byte(b, how) for b in raw)


@lru_cache(maxsize=1 << 14)
def _byte(b: int, how: str) -> str:
    try:
        return bytes([b]).decode(how)
    except UnicodeDecodeError:
        return chr(b)


def _write(text: str, how: str) -> bytes | None:
    try:
        return text.encode(how)
    except UnicodeEncodeError:
        if how == "utf-8":
            return None
        out = bytearray()
        for c in text:
            try:
                out += c.encode(how)
            except UnicodeEncodeError:
                if 0x80 <= ord(c) < 0xA0:
                    out.append(ord(c))
                else:
                    return None
        return bytes(out)


def garbled_forms(word: str) -> dict[str, list[str]]:
    """Form -> chains, likeliest first, for all chains of one encoding read as another. Forms that equal the word, and plain ASCII ones, are left out. Repeated misreadings are undone one after the other, so that they need no forms of their own."""
    forms: dict[str, list[str]] = {}
    for w in WRITTEN:
        raw = _write(word, w)
        if raw is None:
            continue
        for r in READ:
            form = _read(raw, r, "replace") if r != w else word
            if r != "utf-8" or _LOST in form:  # what reads as UTF-8 without loss is the original, not the form
                forms.setdefault(form, []).append(f"{w}>{r}")
    forms.pop(word, None)
    forms.pop("", None)
    return {f: c for f, c in forms.items() if not f.isascii()}


@dataclass(frozen=True)
class Repair:
    """rarer: along chains that keep the length, a form must be so much rarer than its original, as either could be the other's form."""

    rarer: float = 2.0


#: A word with a character beyond ASCII, as the engine's regular expression.
_FOREIGN = r"(?<![0-9A-Za-z\x{80}-\x{10ffff}])[0-9A-Za-z]*+[\x{80}-\x{10ffff}][0-9A-Za-z\x{80}-\x{10ffff}]*+"


def tokens(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, token): the distinct words with a character beyond ASCII of each text."""
    some = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").rlike(r"[^\x00-\x7f]"))
    return some.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_FOREIGN), F.lit(0)))).alias("token"))


def all_forms(words: DataFrame) -> DataFrame:
    """(form, word, chain, n, unit) of every distinct word, and of every character in it or in a code page as a unit (along chains from UTF-8 to a code page, under which a character has a form of its own of two characters or more); n counts the texts that have the word."""

    def characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({c for w in b.column(0).to_pylist() for c in w if c > "\x7f"}), pa.string())], names=["word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for w, n, unit in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if _LOST not in w:
                    for f, chains in garbled_forms(w).items():
                        if unit:
                            out += [(f, w, c, n, True) for c in chains if len(f) > 1 and c.startswith("utf-8>")]
                        elif len(w) > 1 or _LOST in f:  # a character that stands alone is a word only where it is lost
                            out.append((f, w, chains[0], n, False))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_()))], names=["form", "word", "chain", "n", "unit"])

    code_pages = words.sparkSession.createDataFrame([(c,) for c in MISREAD], "word string")
    each = words.mapInArrow(characters, "word string").unionByName(code_pages).distinct().withColumn("n", F.lit(0).cast("long"))
    every = words.withColumn("unit", F.lit(False)).unionByName(each.withColumn("unit", F.lit(True)))
    return every.mapInArrow(run, "form string, word string, chain string, n long, unit boolean")


def originals(words: DataFrame, forms: DataFrame, units: Table, how: Repair) -> DataFrame:
    """(token, word) of the words (word, n) that are a form of another, each with its likeliest original; null where lost characters fit several.

    The words meet the forms in a hash join. A chain from UTF-8 lengthens the
    text and can't be taken for its own reverse; other chains count only if
    the form is rarer than the original. A word that is no form as a whole
    may still consist of the forms of single characters along one chain.
    """
    asked = words.select(F.col("word").alias("form"), F.col("n").alias("n_form"))
    wide = F.col("chain").startswith("utf-8>")
    good = forms.where("not unit").join(asked, "form").where(wide | (F.col("n") >= how.rarer * F.greatest("n_form", F.lit(1))))
    order = F.struct(F.col("word").contains(_LOST).cast("int"), (~wide).cast("int"), -F.col("n"), "word", "chain")
    best = good.groupBy("form").agg(F.min_by("word", order).alias("word"), F.min("word").alias("_lo"), F.max("word").alias("_hi"))
    sure = ~(F.col("form").contains(_LOST) & (F.col("_lo") != F.col("_hi")))  # lost characters fit several words
    whole = best.select(F.col("form").alias("token"), F.when(sure, F.col("word")).alias("word"))
    shared = words.sparkSession.sparkContext.broadcast(units)  # single characters: at most one row per code point and chain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(t, w) for t in b.column(0).to_pylist() if (w := shared.value.parts(t)) is not None]
            cols = list(zip(*found)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["token", "word"])

    rest = asked.select(F.col("form").alias("token")).join(whole.select("token"), "token", "left_anti")
    return whole.unionByName(rest.mapInArrow(run, "token string, word string"))


def fixes(words: DataFrame, how: Repair = Repair()) -> DataFrame:
    """(token, word): the garbled ones among the distinct words (word, n) and what they were written as; null where that is not to be told.

    Originals that are garbled in their turn are looked up again, whether or
    not they occur, until none is new: each look-up undoes one misreading of
    any encoding. It ends, since an original is shorter than its form or
    occurs more often, and none has lost characters.
    """
    forms = materialize(all_forms(words), "forms")
    units = Table([tuple(r) for r in forms.where("unit").groupBy("form", "chain").agg(F.min("word").alias("word")).select("form", "word", "chain").collect()])  # at most one row per code point and chain
    every = new = materialize(originals(words, forms, units, how), "fixes")
    while True:
        again = new.where("word rlike '[^\\x00-\\x7f]'").select("word").distinct().join(words, "word", "left_anti").withColumn("n", F.lit(0).cast("long"))
        again = again.join(every.select(F.col("token").alias("word")), "word", "left_anti")
        new = materialize(originals(again, forms, units, how), "fixes")
        if new.isEmpty():
            break
        every = every.unionByName(new)
    found = every.select("token", "word", F.lit(True).alias("more"))
    step = every.select(F.col("token").alias("word"), F.col("word").alias("next"))
    while True:
        found = materialize(found.join(step, "word", "left").select("token", F.coalesce("next", "word").alias("word"), (F.col("more") & F.col("next").isNotNull()).alias("more")), "fixes")
        if found.where("more").isEmpty():
            return found.select("token", "word")


class Table:
    """The forms of single characters, by chain."""

    def __init__(self, rows: list[tuple]):
        self.unit: dict[str, dict[str, str]] = {}
        for f, w, c in rows:
            self.unit.setdefault(c, {})[f] = w
        self.longest = {c: max(map(len, t)) for c, t in self.unit.items()}

    def _run(self, run: str) -> str | None:
        """The original of a run of characters that consists of forms of one chain."""
        for chain, forms in self.unit.items():
            out, i, most = [], 0, self.longest[chain]
            while i < len(run):
                for n in range(min(most, len(run) - i), 1, -1):
                    if (w := forms.get(run[i : i + n])) is not None:
                        out.append(w)
                        i += n
                        break
                else:
                    break
            if i == len(run) and out:
                return "".join(out)
        return None

    def parts(self, token: str) -> str | None:
        """The original of a word each of whose runs beyond ASCII consists of forms of one chain."""
        good = True

        def one(m: re.Match) -> str:
            nonlocal good
            got = self._run(m.group())
            good &= got is not None
            return got or m.group()

        out = _RUN.sub(one, token)
        return out if good else None


def _in_code(line: str, at: int) -> bool:
    """Whether a place in a line stands between code marks."""
    return line.count("`", 0, at) % 2 == 1 and "`" in line[at:]


def restore(text: str | None, found: dict[str, str | None]) -> tuple[bool, str | None, int]:
    """(affected, restored text, garbled words that stay), from the garbled words of the text and their originals."""
    if not text or not found:
        return False, text, 0
    affected, left = False, 0
    lines = text.split("\n")
    for k, line in enumerate(lines):
        if line.isascii():
            continue
        bad = [(m.start(), m.group(), _in_code(line, m.start())) for m in _WORD.finditer(line) if m.group() in found]
        # a line that was misread is misread throughout; one that is garbled only in code marks shows it on purpose
        if all(code for *_, code in bad):
            continue
        affected, out, end = True, [], 0
        for at, token, _ in bad:
            word = found[token]
            left += word is None
            out += [line[end:at], token if word is None else word]
            end = at + len(token)
        left += sum(m.group() not in found and (_LOST in m.group() or any("\x80" <= c < "\xa0" for c in m.group())) for m in _WORD.finditer(line))
        lines[k] = "".join(out) + line[end:]
    return affected, "\n".join(lines), left


def repair(documents: DataFrame, how: Repair = Repair(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_left) of the affected documents: the text with every verified original put back, and the number of garbled words that could not be restored.

    Null, empty and plain ASCII texts are never affected. Words that a line
    shows only in code marks are left alone. The distinct words beyond ASCII
    of each text are hash-joined with the garbled words of the corpus; only
    texts that have one are touched. Rows without an identifier are left out.
    """
    words = materialize(tokens(documents, id_col, text_col).groupBy(F.col("token").alias("word")).agg(F.count(F.lit(1)).alias("n")), "words")
    found = fixes(words, how)
    pairs = tokens(documents, id_col, text_col).where("doc_id is not null").join(found, "token")
    hit = materialize(pairs.groupBy("doc_id").agg(F.collect_set(F.struct("token", "word")).alias("found")), "hit")  # at most the words of one text
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(hit, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            for i, t, f in zip(ids, b.column(1).to_pylist(), b.column(2).to_pylist()):
                affected, text, left = restore(t, {x["token"]: x["word"] for x in f})
                if affected:
                    out.append((i, text, left))
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64()))], names=["doc_id", "text", "n_left"])

    return texts.mapInArrow(run, "doc_id long, text string, n_left long")
