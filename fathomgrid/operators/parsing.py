"""Symbols, imports and calls of source files, by rules of lines per language."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgrid.plans.durable import materialize
from fathomgrid.plans.skew import hot_keys, lookup_join

_NAME = r"([A-Za-z_$][\w$]*)"
#: Per extension: (kind, pattern of a line whose first group is the name), the pattern of an exported line, those of imports, and how a symbol ends.
RULES: dict[str, tuple[list[tuple[str, str]], str, list[str], str]] = {
    "ts": ([("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\*?\s+{_NAME}"), ("class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{_NAME}"), ("interface", rf"^\s*(?:export\s+)?interface\s+{_NAME}"), ("type_alias", rf"^\s*(?:export\s+)?type\s+{_NAME}\s*[=<]"), ("enum", rf"^\s*(?:export\s+)?(?:const\s+)?enum\s+{_NAME}"), ("function", rf"^\s*(?:export\s+)?const\s+{_NAME}\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>")], r"^\s*export\b", [r"from\s+['\"]([^'\"]+)['\"]", r"^\s*import\s+['\"]([^'\"]+)['\"]", r"require\(['\"]([^'\"]+)['\"]\)"], "brace"),
    "js": ([("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\*?\s+{_NAME}"), ("class", rf"^\s*(?:export\s+)?(?:default\s+)?class\s+{_NAME}")], r"^\s*export\b", [r"from\s+['\"]([^'\"]+)['\"]", r"^\s*import\s+['\"]([^'\"]+)['\"]", r"require\(['\"]([^'\"]+)['\"]\)"], "brace"),
    "go": ([("function", rf"^func\s+{_NAME}"), ("method", rf"^func\s*\([^)]*\)\s*{_NAME}"), ("class", rf"^type\s+{_NAME}\s+struct\b"), ("interface", rf"^type\s+{_NAME}\s+interface\b"), ("type_alias", rf"^type\s+{_NAME}\s+(?!struct|interface)")], r"^(?:func|type)\s+(?:\([^)]*\)\s*)?[A-Z]", [r"^\s*(?:import\s+)?(?:\w+\s+)?\"([^\"]+)\"\s*$"], "brace"),
    "java": ([("class", rf"^\s*(?:[\w@]+\s+)*class\s+{_NAME}"), ("interface", rf"^\s*(?:[\w@]+\s+)*interface\s+{_NAME}"), ("enum", rf"^\s*(?:[\w@]+\s+)*enum\s+{_NAME}"), ("method", rf"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+[\w<>\[\], ?]+\s+{_NAME}\s*\(")], r"^\s*public\b", [r"^import\s+(?:static\s+)?([\w.*]+);"], "brace"),
    "rs": ([("function", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+{_NAME}"), ("class", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+{_NAME}"), ("enum", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+{_NAME}"), ("interface", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+{_NAME}")], r"^\s*pub\b", [r"^\s*use\s+([\w:]+)"], "brace"),
    "php": ([("function", rf"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?{_NAME}"), ("class", rf"^\s*(?:(?:final|abstract|readonly)\s+)*class\s+{_NAME}"), ("interface", rf"^\s*interface\s+{_NAME}")], r"^(?!\s*private)", [r"^\s*use\s+([\w\\]+)"], "brace"),
    "rb": ([("function", r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)"), ("class", r"^\s*(?:class|module)\s+([A-Z]\w*)")], r"", [r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]"], "end"),
}
#: Words that stand before a bracket but are no calls.
NO_CALLS = frozenset("if for foreach while switch catch return function fn func def class new match elseif unless until and or not in isset empty array list print echo exit die sizeof super self typeof await".split())
#: The extensions that a relative import tries, in this order, and TypeScript's own types.
EXTENSIONS = ".ts .tsx .js .jsx .mjs .cjs .py .go .rs .java .kt .kts .swift .c .cpp .cc .cxx .h .hpp .rb .php .scala .sc .lua .vue .svelte".split()
BUILTIN_TYPES = frozenset("string number boolean void null undefined any unknown never object symbol bigint String Number Boolean Object Array Map Set Promise Date RegExp Error Function".split())
HERITAGE = {"extends", "implements"}
_TYPED = re.compile(r"[(,]\s*(?:(?:public|private|protected|readonly)\s+)*(?:\.\.\.)?[A-Za-z_$][\w$]*\??\s*:\s*((?:[^,()=<>]|<[^()=]*?>(?![\w$]))+)")
_VARIABLE = re.compile(r"\b(?:const|let|var)\s+[A-Za-z_$][\w$]*\s*:\s*([^=;]+)")
_METHOD = re.compile(r"^\s*(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*([A-Za-z_$][\w$]*)\s*(?:<[^(]*>)?\(")
_CALL = re.compile(r"(?<![\w$.])([A-Za-z_$][\w$]*)\s*\(|\.([A-Za-z_]\w*)\s*\(")
_OPENS = re.compile(r"^\s*(?:if|unless|while|until|for|case|begin|def|class|module)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$")


@dataclass
class File:
    """symbols: (id, kind, name, first, last, exported, class); imports: (module, line); calls: (source id, name, line, confidence); types: (source id, extends, implements or uses_type, name, line)."""

    symbols: list[tuple] = field(default_factory=list)
    imports: list[tuple] = field(default_factory=list)
    calls: list[tuple] = field(default_factory=list)
    types: list[tuple] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


def _end(lines: list[str], at: int, how: str) -> int:
    """The last line of a symbol that begins at a line."""
    depth, opened = 0, False
    for i in range(at, len(lines)):
        code = re.sub(r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|//.*|#(?!\{).*", "", lines[i])
        if how == "brace":
            depth += code.count("{") - code.count("}")
            opened = opened or "{" in code
            if opened and depth <= 0 or not opened and code.rstrip().endswith(";"):
                return i
        else:
            depth += len(_OPENS.findall(code)) - len(re.findall(r"^\s*end\b", code))
            if depth <= 0:
                return i
    return len(lines) - 1


def _python(path: str, text: str) -> File:
    out = File()
    tree = ast.parse(text)

    def visit(body: list, owner: str | None, inside: str | None) -> None:
        for n in body:
            mine = inside
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(n, ast.ClassDef) else "method" if owner else "function"
                mine = f"{kind}:{path}:{n.name}"
                out.symbols.append((mine, kind, n.name, n.lineno, n.end_lineno, False, owner))
                visit(n.body, n.name if kind == "class" else owner, mine)
            elif isinstance(n, ast.Import):
                out.imports += [(a.name, n.lineno) for a in n.names]
            elif isinstance(n, ast.ImportFrom):
                out.imports.append(("." * n.level + (n.module or ""), n.lineno))
            if not isinstance(n, ast.ClassDef):
                for c in ast.walk(n):
                    if isinstance(c, ast.Call) and isinstance(c.func, (ast.Name, ast.Attribute)):
                        out.calls.append((mine or f"file:{path}:{path.rsplit('/', 1)[-1]}", c.func.id if isinstance(c.func, ast.Name) else c.func.attr, c.lineno, 0.5))

    visit(tree.body, None, None)
    out.calls = sorted(set(out.calls), key=lambda c: (c[2], c[1], c[0]))
    return out


def _signature(lines: list[str], at: int) -> str:
    """The code from a line on, as far as its first bracket closes or a block opens outside of it."""
    out, depth, opened = [], 0, False
    for line in lines[at:]:
        code = re.sub(r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|//.*", "", line)
        for n, c in enumerate(code):
            depth += (c == "(") - (c == ")")
            opened = opened or c == "("
            if opened and depth == 0 or c in "{;" and depth == 0:
                return "\n".join([*out, code[: n + 1]])
        out.append(code)
    return "\n".join(out)


def _bare(types: str) -> list[str]:
    """Names of a list of types, without their type arguments."""
    while (fewer := re.sub(r"<[^<>]*>", "", types)) != types:
        types = fewer
    return [m.group(1) for t in types.split(",") if (m := re.match(rf"\s*(?:[\w$]+\.)*{_NAME}", t))]


def _types(lines: list[str], kinds: list[tuple[str, str]], path: str) -> Iterator[tuple[str | None, str, str, int]]:
    """(source id, type of edge, name, line) of a TypeScript file: bases of classes, and the types of parameters and variables but the language's own. A source of None is the symbol around the line."""
    for i, line in enumerate(lines):
        kind, name = next(((k, m.group(1)) for k, p in kinds if (m := re.match(p, line))), (None, None))
        found: list[str] = []
        if kind == "class":
            head = " ".join(_signature(lines, i).split("{")[0].split())
            head = re.sub(r"^.*?\bclass\s+[\w$]+", "", head)
            while (fewer := re.sub(r"<[^<>]*>", "", head)) != head:
                head = fewer
            m = re.match(r"\s*(?:extends\s+(.+?))?\s*(?:\bimplements\s+(.+))?$", head)
            for of, listed in zip(("extends", "implements"), m.groups() if m else ()):
                yield from ((f"class:{path}:{name}", of, t, i + 1) for t in (_bare(listed)[: 1 if of == "extends" else None] if listed else ()))
        elif kind == "function" or kind is None and (m := _METHOD.match(line)) and m.group(1) not in NO_CALLS and re.match(r"\s*(?::[^;]*)?\{", line.rpartition(")")[2]):
            found += _TYPED.findall(_signature(lines, i))
        found += _VARIABLE.findall(re.sub(r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|//.*", "", line))
        yield from ((None, "uses_type", t, i + 1) for x in found for t in re.findall(rf"(?<![\w$.]){_NAME}(?!\s*[:(])", x) if t not in BUILTIN_TYPES | {"keyof", "typeof", "readonly", "infer", "true", "false"})


def parse_file(path: str, text: str | None) -> File:
    """Symbols, imports, calls and, of TypeScript, names of types; a call belongs to the narrowest symbol around its line. A file that can't be read as its language has an error and nothing else; an unknown extension has nothing."""
    ext = path.rpartition(".")[2].lower() if path else ""
    text = (text or "").removeprefix("﻿").replace("\r\n", "\n")
    if ext == "py":
        try:
            return _python(path, text)
        except (SyntaxError, ValueError, RecursionError) as e:
            return File(errors=[f"{type(e).__name__}: {e}"])
    if ext not in RULES:
        return File()
    kinds, exported, imports, how = RULES[ext]
    lines, out = text.split("\n"), File()
    shown = re.compile(exported) if exported else None
    for i, line in enumerate(lines):
        for kind, pattern in kinds:
            if m := re.match(pattern, line):
                last = _end(lines, i, how)
                owner = next((s[2] for s in reversed(out.symbols) if s[1] == "class" and s[3] <= i + 1 <= s[4]), None)
                if kind == "function" and owner and ext in ("php", "rb"):
                    kind = "method"
                out.symbols.append((f"{kind}:{path}:{m.group(1)}", kind, m.group(1), i + 1, last + 1, bool(shown is None or shown.match(line)), owner if kind == "method" else None))
                break
        for pattern in imports:
            out.imports += [(m.group(1), i + 1) for m in re.finditer(pattern, line)]
        code = re.sub(r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|//.*", "", line)
        if any(re.match(p, line) for _, p in kinds):
            continue
        for m in _CALL.finditer(code):
            name = m.group(1) or m.group(2)
            if name not in NO_CALLS:
                out.calls.append((None, name, i + 1, 0.6 if ext == "php" else 0.55 if ext == "rb" else 0.5))
    bare = f"file:{path}:{path.rsplit('/', 1)[-1]}"
    around = lambda n: min(((s[4] - s[3], s[0]) for s in out.symbols if s[3] <= n <= s[4]), default=(0, bare))[1]
    out.calls = [(around(n), name, n, c) for _, name, n, c in out.calls]
    if ext == "ts":
        out.types = [(s or around(n), of, name, n) for s, of, name, n in _types(lines, kinds, path)]
    return out


_SCHEMA = "file_path string, what string, id string, kind string, name string, first int, last int, exported boolean, owner string, confidence double"


def parse_files(files: DataFrame) -> DataFrame:
    """Rows of files (file_path, content): what is symbol, import, call, extends, implements, uses_type or error; see File for what fills the columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = parse_file(path or "", text)
                rows += [(path, "symbol", *s, None) for s in f.symbols]
                rows += [(path, "import", None, None, m, n, n, None, None, None) for m, n in f.imports]
                rows += [(path, "call", s, None, name, n, n, None, None, c) for s, name, n, c in f.calls]
                rows += [(path, of, s, None, name, n, n, None, None, None) for s, of, name, n in f.types]
                rows += [(path, "error", None, None, e, None, None, None, None, None) for e in f.errors]
            cols = list(zip(*rows)) or [[]] * 10
            types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[c.split()[0] for c in _SCHEMA.split(", ")])

    return files.select("file_path", "content").mapInArrow(run, _SCHEMA)


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (file_path, name, first) with the file each one means, null where none is met: (file_path, module, line, resolved).

    A relative module is the path of a file without its extension, or of a
    folder with an index file; the order of EXTENSIONS decides, files before
    folders. Every other module, and a relative one that isn't met, is the
    first .ts or .js file whose path ends with the last part of the module,
    least path first. Where files have a repo_id, only files of the importing
    file's repository count.
    Paths and ends are joined by equality: each file gives its own stems.
    """
    ends = F.array(*[F.lit(e) for e in EXTENSIONS])
    parts = lambda c: F.split(c, "/")
    up = lambda done, x: F.when(x.isin("", "."), done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    path = F.concat(F.regexp_replace("file_path", "[^/]*$", ""), F.col("module"))
    base = F.regexp_extract("module", "([^/]*)/*$", 1)
    files = files.where("file_path is not null").select("file_path", (F.col("repo_id") if "repo_id" in files.columns else F.lit("")).alias("repo"))
    files = files.groupBy("file_path").agg(F.coalesce(F.min("repo"), F.lit("")).alias("repo"))
    wanted = imports.select("file_path", F.col("name").alias("module"), F.col("first").alias("line")).join(files, "file_path", "left")
    wanted = wanted.withColumns({"stem": F.when(F.col("module").startswith("."), F.array_join(F.aggregate(parts(path), F.array().cast("array<string>"), up), "/")), "base": F.when(base != "", base)})
    own = files.withColumnRenamed("file_path", "path").withColumns({"ext": F.regexp_extract("path", r"(\.[^./]+)$", 1), "at": F.array_join(F.filter(parts(F.col("path")), lambda x: ~x.isin("", ".")), "/")})
    own = own.withColumns({"rank": F.array_position(ends, F.col("ext")), "stem": F.expr("left(at, length(at) - length(ext))")}).where("rank > 0")
    folder = own.where(F.col("stem").rlike("(^|/)index$")).select("repo", F.regexp_replace("stem", "/?index$", "").alias("stem"), (F.col("rank") + len(EXTENSIONS)).alias("rank"), "path")
    near = own.select("repo", "stem", "rank", "path").unionByName(folder).groupBy("repo", "stem").agg(F.min_by("path", F.struct("rank", "path")).alias("near"))
    last = own.where(F.col("ext").isin(".ts", ".js")).select("repo", "path", F.regexp_extract("stem", "([^/]*)$", 1).alias("last")).where("last <> ''")
    far = last.select("repo", "path", F.explode(F.expr("transform(sequence(1, length(last)), i -> substring(last, i))")).alias("base")).groupBy("repo", "base").agg(F.min("path").alias("far"))
    return wanted.join(near, ["repo", "stem"], "left").join(far, ["repo", "base"], "left").select("file_path", "module", "line", F.coalesce("near", "far").alias("resolved"))


def resolve_import_symbols(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """imports (file_path, module, line, resolved) with the first exported symbol of the file that is meant, by line, then identifier: (file_path, module, line, symbol), null where the file is not met or exports none."""
    first = nodes.where("is_exported = 1 and label <> 'file'").groupBy(F.col("file_path").alias("resolved")).agg(F.min_by("id", F.struct("start_line", "id")).alias("symbol"))
    return imports.join(first, "resolved", "left").select("file_path", "module", "line", "symbol")


def resolve_types(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rel_type, source, target, line) of rows (what, id, name, first): bases are the class of that name, else the interface; a used type also an alias, else an enum. The least identifier counts; a name that isn't met is left out."""
    order = F.array_position(F.array(*[F.lit(k) for k in ("class", "interface", "type_alias", "enum")]), F.col("label"))
    known = nodes.select("name", "id", order.alias("rank")).where("rank > 0")
    pick = lambda rows: rows.groupBy("name").agg(F.min_by("id", F.struct("rank", "id")).alias("target"))
    heir = F.col("what").isin(*HERITAGE)
    rows = names.select(F.col("what"), F.col("id").alias("source"), "name", F.col("first").alias("line"))
    both = rows.where(heir).join(pick(known.where("rank <= 2")), "name").unionByName(rows.where(F.col("what") == "uses_type").join(pick(known), "name"))
    return both.select(F.col("what").alias("rel_type"), "source", "target", "line")


def nodes_of(rows: DataFrame) -> DataFrame:
    """Nodes of parsed rows; of an identifier given twice, the first place counts."""
    sym = rows.where("what = 'symbol'")
    nodes = sym.groupBy("id").agg(*[F.min_by(c, "first").alias(c) for c in ("file_path", "kind", "name", "last", "exported", "owner")], F.min("first").alias("start_line"))
    return nodes.select("id", F.col("kind").alias("label"), "name", "file_path", "start_line", F.col("last").alias("end_line"), F.col("exported").cast("int").alias("is_exported"), F.col("owner").alias("class_name"))


def edges_of(rows: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(rel_type, source, target, confidence, line) of parsed rows, resolved against nodes and files, which may hold more than those parsed: calls to a callable of the same file (confidence 1) or else the least of that name anywhere (0.5; unresolved calls have target null), defines and member_of of the rows' own symbols, and imports, extends, implements, uses_type and instantiates where they are met."""
    able = nodes.where("label in ('function', 'method')")
    local = able.groupBy("file_path", "name").agg(F.min("id").alias("near"))
    far = able.groupBy("name").agg(F.min("id").alias("far"))
    named = rows.where("what = 'call'").select("file_path", F.col("id").alias("source"), "name", F.col("first").alias("line"))
    calls = named.join(local, ["file_path", "name"], "left")
    calls = lookup_join(calls, far, "name", hot_keys(named.select("name"), "name"))
    made = calls.select(F.lit("calls").alias("rel_type"), "source", F.coalesce("near", "far").alias("target"), F.when(F.col("near").isNotNull(), 1.0).when(F.col("far").isNotNull(), 0.5).alias("confidence"), "line")
    own = nodes.join(rows.where("what = 'symbol'").select("id").distinct(), "id", "left_semi")
    edge = lambda t, a, b: own.select(F.lit(t).alias("rel_type"), a.alias("source"), b.alias("target"), F.lit(1.0).alias("confidence"), F.col("start_line").alias("line"))
    file = lambda c: F.concat_ws(":", F.lit("file"), c, F.element_at(F.split(c, "/"), -1))
    file_id = file("file_path")
    met = resolve_imports(rows.where("what = 'import'"), files).where("resolved is not null")
    imports = met.select(F.lit("imports").alias("rel_type"), file_id.alias("source"), file("resolved").alias("target"), F.lit(1.0).alias("confidence"), "line")
    types = resolve_types(rows.where("what in ('extends', 'implements', 'uses_type')"), nodes).withColumn("confidence", F.lit(1.0))
    classes = nodes.where("label = 'class'").groupBy("name").agg(F.min("id").alias("target"))
    instances = named.join(classes, "name").select(F.lit("instantiates").alias("rel_type"), "source", "target", F.lit(1.0).alias("confidence"), "line")
    member = edge("member_of", F.col("id"), F.concat_ws(":", F.lit("class"), "file_path", "class_name")).where(F.col("source").startswith("method:"))
    return made.unionByName(edge("defines", file_id, F.col("id"))).unionByName(member).unionByName(imports).unionByName(types).unionByName(instances)


def graph_of(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of source files."""
    rows = materialize(parse_files(files), "parsed")
    nodes = nodes_of(rows)
    return nodes, edges_of(rows, nodes, files)
