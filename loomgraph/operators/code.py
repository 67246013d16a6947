"""Source code to nodes and edges.

Python files are parsed by the standard library, file by file within tasks. Other languages are read by declarations
that stand on a line of their own, with one set of patterns for each suffix, in Spark's expressions. What follows parsing
(targets of imports and calls, imported classes, doc comments) are joins and windows over the records.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ids import code_id
from ..functions.text import cut_at_word, extension, file_name, stem
from .docs import numbered_lines
from .paths import stored

RECORD = "kind string, id string, label string, file_type string, source string, target string, relation string, confidence string, weight double, source_file string, line int, signature string, name string, nth int"
# Comments that give a reason, and the least length of a docstring that does.
REASONS = ("# NOTE:", "# IMPORTANT:", "# HACK:", "# WHY:", "# RATIONALE:", "# TODO:", "# FIXME:")
MIN_DOCSTRING = 20
MAX_SIGNATURE = 200


def make_id(*parts: str) -> str:
    """The same id as functions.ids.code_id gives, for use within tasks."""
    joined = "_".join(p.strip("_.") for p in parts if p)
    return re.sub("[^a-zA-Z0-9]+", "_", joined).strip("_").lower()


def parse_python(path: str, text: str) -> list[dict]:
    """Records of one file: nodes, edges, and calls and imported names that joins resolve later."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    stem_, rows, seen = re.sub(r"(?<=.)\.[^.]+$", "", path.rsplit("/", 1)[-1]), [], set()
    file_id = make_id(stem_)

    def add(kind: str, **values) -> None:
        rows.append({"kind": kind, "source_file": path, "nth": len(rows)} | values)

    def node(id_: str, label: str, line: int | None, **more) -> None:
        """A file's first declaration of a name is the one that counts."""
        if id_ not in seen:
            seen.add(id_)
            add("node", **{"id": id_, "label": label, "line": line, "file_type": "code"} | more)

    def edge(source: str, target: str, relation: str, line: int, confidence: str = "EXTRACTED", weight: float = 1.0) -> None:
        add("edge", source=source, target=target, relation=relation, line=line, confidence=confidence, weight=weight)

    def reason(said: str, line: int, of: str) -> None:
        id_ = make_id(stem_, "rationale", str(line))
        node(id_, said[:80].replace("\n", " ").strip(), line, file_type="rationale")
        edge(id_, of, "rationale_for", line)

    def docstring(owner: ast.AST, of: str) -> None:
        said = (ast.get_docstring(owner, clean=False) or "").strip()
        if len(said) > MIN_DOCSTRING:
            reason(said, owner.body[0].lineno, of)

    def signature(f) -> str:
        head = f"{'async ' if isinstance(f, ast.AsyncFunctionDef) else ''}def {f.name}({ast.unparse(f.args)})" + (f" -> {ast.unparse(f.returns)}" if f.returns else "")
        return re.sub(r"\s+", " ", head)[:MAX_SIGNATURE]

    def calls(f, id_: str) -> None:
        """Calls in the function's body; the bodies of functions within it are their own."""
        left = [*f.body]
        while left:
            x = left.pop()
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                left += x.decorator_list
                continue
            if isinstance(x, ast.Call):
                name = x.func.id if isinstance(x.func, ast.Name) else x.func.attr if isinstance(x.func, ast.Attribute) else ""
                if name:
                    add("call", source=id_, name=name, line=x.lineno)
            left += ast.iter_child_nodes(x)

    def walk(body: list, owner: str | None) -> None:
        for x in body:
            if isinstance(x, ast.ClassDef):
                id_ = make_id(stem_, x.name)
                node(id_, x.name, x.lineno)
                edge(file_id, id_, "contains", x.lineno)
                docstring(x, id_)
                for base in x.bases:
                    name = re.split(r"[\[.]", ast.unparse(base))[0 if "[" in ast.unparse(base) else -1]
                    base_id = make_id(stem_, name)
                    if base_id not in seen:
                        base_id = make_id(name)
                        node(base_id, name, None, source_file="")
                    edge(id_, base_id, "extends", x.lineno)
                walk(x.body, id_)
            elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                id_ = make_id(owner, x.name) if owner else make_id(stem_, x.name)
                node(id_, f".{x.name}()" if owner else f"{x.name}()", x.lineno, signature=signature(x))
                edge(owner or file_id, id_, "method" if owner else "contains", x.lineno)
                docstring(x, id_)
                calls(x, id_)
            elif isinstance(x, ast.Import):
                for name in x.names:
                    edge(file_id, make_id(name.name.split(".")[-1]), "imports", x.lineno)
            elif isinstance(x, ast.ImportFrom):
                module = (x.module or "").split(".")[-1]
                if module:
                    edge(file_id, make_id(module), "imports_from", x.lineno)
                for name in x.names:
                    add("import", name=name.name, target=module, line=x.lineno)
            else:
                for part in ("body", "orelse", "finalbody", "handlers", "cases"):
                    inner = getattr(x, part, None)
                    walk(inner if isinstance(inner, list) else [], owner)

    node(file_id, path.rsplit("/", 1)[-1], 1)
    docstring(tree, file_id)
    walk(tree.body, None)
    for n, line in enumerate(text.splitlines(), 1):
        if line.strip().startswith(REASONS):
            reason(line.strip(), n, file_id)
    return rows


def python_records(files: DataFrame) -> DataFrame:
    """Records of Python files (source_file, text)."""
    kinds = {"string": object, "int": "Int32", "double": "float64"}
    columns = {name: kinds[kind] for name, kind in (c.split() for c in RECORD.split(", "))}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for path, text in zip(pdf.source_file, pdf.text) for r in parse_python(path, text or "")]
            yield pd.DataFrame({name: pd.Series([r.get(name) for r in rows], dtype=kind) for name, kind in columns.items()})

    return files.select("source_file", "text").mapInPandas(run, RECORD)


# What declares a type or a function, or imports, in other languages; a group named by the declared name.
_NAME = r"([A-Za-z_][A-Za-z0-9_]*)"
_MODS = r"^\s*(?:(?:public|private|protected|internal|static|final|abstract|sealed|override|open|export|default|async|pub|data|virtual|inline|extern|unsafe|partial)\s+)*"
_TYPES = r"(?:class|interface|enum|struct|trait|protocol|object|record|union|module|namespace)"
_C = {"type": _MODS + r"(?:class|struct|enum|union|namespace)\s+" + _NAME, "function": r"^(?:[A-Za-z_][\w:<>*&,\s]*\s[*&]*)" + _NAME + r"\s*\([^;]*$", "import": r'^\s*#\s*include\s*[<"]([^>"]+)[>"]'}
_JVM = {"type": _MODS + _TYPES + r"\s+" + _NAME, "function": _MODS + r"(?:fun\s+|def\s+|[\w<>\[\],.?]+\s+)" + _NAME + r"\s*\([^;]*\{?\s*$", "import": r"^\s*import\s+(?:static\s+)?([\w.]+)"}
_JS = {"type": _MODS + r"(?:class|interface|enum)\s+" + _NAME, "function": _MODS + r"(?:function\s*\*?\s*|(?:const|let|var)\s+)" + _NAME + r"\s*(?:\(|=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>)", "import": r"""^\s*import\b.*?['"]([^'"]+)['"]"""}
LANGUAGES = {
    **dict.fromkeys((".c", ".h", ".cc", ".cpp", ".cxx", ".hpp"), _C),
    **dict.fromkeys((".java", ".kt", ".kts", ".scala"), _JVM),
    **dict.fromkeys((".js", ".ts", ".tsx"), _JS),
    ".cs": _JVM | {"import": r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;"},
    ".php": {"type": _MODS + _TYPES + r"\s+" + _NAME, "function": _MODS + r"function\s+&?" + _NAME + r"\s*\(", "import": r"^\s*use\s+([\w\\]+)"},
    ".go": {"type": r"^\s*type\s+" + _NAME + r"\s+", "function": r"^func\s+(?:\([^)]*\)\s*)?" + _NAME + r"\s*[\[(]", "import": r'^\s*(?:import\s+)?(?:\w+\s+)?"([\w./-]+)"\s*$'},
    ".rs": {"type": _MODS + r"(?:struct|enum|trait|mod)\s+" + _NAME, "function": _MODS + r"fn\s+" + _NAME, "import": r"^\s*(?:pub\s+)?use\s+([\w:]+)"},
    ".rb": {"type": r"^\s*(?:class|module)\s+" + _NAME, "function": r"^\s*def\s+(?:self\.)?" + _NAME, "import": r"""^\s*require(?:_relative)?\s+['"]([^'"]+)['"]"""},
    ".swift": {"type": _MODS + r"(?:class|struct|enum|protocol|extension)\s+" + _NAME, "function": _MODS + r"func\s+" + _NAME, "import": r"^\s*import\s+(\w+)"},
    ".lua": {"type": r"^\s*" + _NAME + r"\s*=\s*\{\}\s*$", "function": r"^\s*(?:local\s+)?function\s+(?:\w+[.:])?" + _NAME, "import": r"""require\s*\(?\s*['"]([^'"]+)['"]"""},
    ".zig": {"type": r"^\s*(?:pub\s+)?const\s+" + _NAME + r"\s*=\s*(?:packed\s+|extern\s+)?(?:struct|enum|union)\b", "function": r"^\s*(?:pub\s+)?fn\s+" + _NAME, "import": r"""@import\("([^"]+)"\)"""},
    ".ps1": {"type": r"^\s*class\s+" + _NAME, "function": r"(?i)^\s*function\s+([\w-]+)", "import": r"(?i)^\s*(?:using\s+module|import-module)\s+([\w./-]+)"},
    **dict.fromkeys((".ex", ".exs"), {"type": r"^\s*defmodule\s+([\w.]+)", "function": r"^\s*defp?\s+" + _NAME, "import": r"^\s*(?:import|alias|use|require)\s+([\w.]+)"}),
}
# How types name what they are built on, by suffix; the first group holds names parted by commas.
BASES = {
    "extends": r"(?:class|interface|trait|object)\s+\w+(?:\s*[<\[(][^{]*?[>\])])?\s+extends\s+([\w.<>\[\]]+)",
    "implements": r"\bimplements\s+([\w.<>, ]+)",
    "colon": r"(?:class|struct|interface|protocol|enum)\s+\w+(?:<[^>]*>)?(?:\([^)]*\))?\s*:\s*(?:public\s+|private\s+|protected\s+)?([\w.<>, ()]+)",
    "ruby": r"^\s*class\s+\w+\s*<\s*([\w:]+)",
}


def declarations(files: DataFrame) -> DataFrame:
    """Declared types, functions and imports of files in other languages: source_file, line_no, kind, name."""
    lines = numbered_lines(files.where(extension(F.col("source_file")).isin(*LANGUAGES))).withColumn("ext", extension(F.col("source_file")))
    found = []
    for kind in ("type", "function", "import"):
        name = F.lit("")
        for pattern in {p[kind] for p in LANGUAGES.values()}:
            name = F.when(F.col("ext").isin(*[e for e, p in LANGUAGES.items() if p[kind] == pattern]), F.regexp_extract("line", pattern, 1)).otherwise(name)
        found.append(F.struct(F.lit(kind).alias("kind"), name.alias("name")))
    first = F.get(F.filter(F.array(*found), lambda x: (x["name"] != "") & ~x["name"].isin("if", "for", "while", "switch", "return", "catch", "else", "new")), F.lit(0))
    return lines.withColumn("d", first).where("d is not null").select("source_file", "line_no", "line", F.col("d.kind").alias("kind"), F.col("d.name").alias("name"))


def declared_records(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of files in other languages. A function belongs to the last type declared above it, else to its file."""
    rows = declarations(files)
    base = stem(F.col("source_file"))
    file_id = code_id(base)
    above = F.last(F.when(F.col("kind") == "type", F.col("name")), ignorenulls=True).over(W.partitionBy("source_file").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow))
    indented = F.col("line").rlike(r"^\s")
    owner = F.when((F.col("kind") == "function") & indented, above)
    rows = rows.withColumn("owner", owner)
    owner_id = F.when(F.col("owner").isNotNull(), code_id(base, F.col("owner"))).otherwise(file_id)
    short = F.regexp_replace(F.regexp_replace("name", r"\.(?:h|hpp|js|ts|zig|lua|php|rb)$", ""), r"^.*[./:\\]", "")
    target = F.when(F.col("kind") == "import", code_id(short)).when(F.col("owner").isNotNull(), code_id(owner_id, F.col("name"))).otherwise(code_id(base, F.col("name")))
    label = F.when(F.col("kind") == "type", F.col("name")).when(F.col("owner").isNotNull(), F.concat(F.lit("."), "name", F.lit("()"))).otherwise(F.concat("name", F.lit("()")))
    relation = F.when(F.col("kind") == "import", "imports").when(F.col("owner").isNotNull(), "method").otherwise("contains")
    at = F.concat(F.lit("L"), "line_no")
    ord_ = F.concat("source_file", F.lit(":"), F.lpad(F.col("line_no").cast("string"), 8, "0"))
    hubs = files.where(extension(F.col("source_file")).isin(*LANGUAGES)).select(file_id.alias("id"), file_name(F.col("source_file")).alias("label"), "source_file", F.lit("L1").alias("source_location"), F.lit(None).cast("string").alias("signature"), F.concat("source_file", F.lit(":")).alias("ord"))
    sign = F.when(F.col("kind") == "function", F.substring(F.regexp_replace(F.regexp_replace(F.trim("line"), r"\s+", " "), r"\s*\{\s*$", ""), 1, MAX_SIGNATURE))
    nodes = hubs.unionByName(rows.where("kind <> 'import'").select(target.alias("id"), label.alias("label"), "source_file", at.alias("source_location"), sign.alias("signature"), ord_.alias("ord")))
    edges = rows.select(F.when(F.col("kind") == "import", file_id).otherwise(owner_id).alias("source"), target.alias("target"), relation.alias("relation"), "source_file", at.alias("source_location"), ord_.alias("ord"))
    types = rows.where("kind = 'type'")
    named = lambda pattern: F.filter(F.transform(F.split(F.regexp_extract("line", pattern, 1), ","), lambda x: F.regexp_replace(F.trim(x), r"[<(\[].*$", "")), lambda x: x != "")
    links = F.concat(
        F.transform(named(BASES["extends"]), lambda x: F.struct(F.lit("extends").alias("relation"), x.alias("base"))),
        F.transform(named(BASES["implements"]), lambda x: F.struct(F.lit("implements").alias("relation"), x.alias("base"))),
        F.transform(named(BASES["colon"]), lambda x, i: F.struct(F.when(i == 0, "extends").otherwise("implements").alias("relation"), x.alias("base"))),
        F.transform(F.when(F.col("source_file").endswith(".rb"), named(BASES["ruby"])).otherwise(F.array().cast("array<string>")), lambda x: F.struct(F.lit("extends").alias("relation"), x.alias("base"))),
    )
    heirs = types.select("source_file", "line_no", "name", F.explode(links).alias("l")).select("source_file", "line_no", "name", "l.relation", F.regexp_replace("l.base", r"^.*[.:]", "").alias("base"))
    # A base that the file declares is meant; a placeholder stands for any other.
    own = types.groupBy("source_file", F.col("name").alias("base")).agg(F.lit(True).alias("own"))
    heirs = heirs.join(own, ["source_file", "base"], "left")
    base_id = F.when(F.col("own"), code_id(base, F.col("base"))).otherwise(code_id(F.col("base")))
    heir_edges = heirs.select(code_id(base, F.col("name")).alias("source"), base_id.alias("target"), "relation", "source_file", at.alias("source_location"), ord_.alias("ord"))
    placeholders = heirs.where("own is null").select(code_id(F.col("base")).alias("id"), F.col("base").alias("label"), F.lit("").alias("source_file"), F.lit(None).cast("string").alias("source_location"), F.lit(None).cast("string").alias("signature"), F.lit("").alias("ord"))
    confidence = lambda df: df.withColumns({"confidence": F.lit("EXTRACTED"), "weight": F.lit(1.0)})
    return nodes.unionByName(placeholders).withColumn("file_type", F.lit("code")), confidence(edges.unionByName(heir_edges))


def call_edges(records: DataFrame) -> DataFrame:
    """Calls within a file to what is declared there, once for each pair: source, target, relation, confidence, weight."""
    name = F.lower(F.regexp_replace(F.regexp_replace("label", r"\(\)$", ""), r"^\.", ""))
    key = F.when(F.col("kind") == "call", F.lower("name")).otherwise(name)
    # Files are parsed once: what a file declares and what it calls meet in one pass over its records.
    rows = records.where("kind = 'call' or kind = 'node' and file_type = 'code'").select("kind", "source_file", key.alias("key"), "id", "nth", "source", "line")
    target = F.max_by("id", F.when(F.col("kind") == "node", F.col("nth"))).over(W.partitionBy("source_file", "key"))
    found = rows.withColumn("target", target).where("kind = 'call' and source <> target").groupBy("source_file", "source", "target").agg(F.min("line").alias("line"))
    return found.select("source", "target", F.lit("calls").alias("relation"), F.lit("INFERRED").alias("confidence"), F.lit(0.8).alias("weight"), "source_file", "line")


def _entities(records: DataFrame) -> DataFrame:
    words = F.size(F.filter(F.split("label", r"\s+"), lambda w: w != ""))
    return records.where("kind = 'node' and file_type = 'code' and source_file <> ''").where(~F.col("label").rlike(r"(\)|\.py)$") & (words <= 5))


def imported_classes(records: DataFrame) -> DataFrame:
    """`uses` edges from each class of a file to what the file imports by name from another. Files are parsed once: classes and imports are stored."""
    rows = records.where("kind = 'import' or kind = 'node' and file_type = 'code' and source_file <> ''")
    records = stored(rows.select("kind", "id", "label", "file_type", "source_file", "name", "target", "line", "nth"), "classes")
    known = _entities(records).where(~F.col("label").startswith("_")).groupBy(stem(F.col("source_file")).alias("module"), F.col("label").alias("name")).agg(F.max_by("id", "nth").alias("target"))
    imports = records.where("kind = 'import'").select("source_file", "name", F.col("target").alias("module"), "line")
    local = _entities(records).select("source_file", F.col("id").alias("source")).distinct()
    found = imports.join(known, ["module", "name"]).join(local, "source_file")
    return found.select("source", "target", F.lit("uses").alias("relation"), F.lit("INFERRED").alias("confidence"), F.lit(0.8).alias("weight"), "source_file", "line").distinct()


def clean_comment(text: Column) -> Column:
    """A comment without its marks and annotations, on one line, cut at 200 characters."""
    bare = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), r"^[\s*/]+", ""), "^#", "")))
    kept = F.filter(bare, lambda x: (x != "") & ~x.startswith("@") & ~x.startswith("<"))
    return cut_at_word(F.array_join(kept, " "), 200)


# Suffixes with block comments, and line comments by suffix with the mark they start with.
BLOCK_COMMENTS = (".java", ".kt", ".kts", ".scala", ".php", ".js", ".ts", ".tsx", ".c", ".cpp", ".h", ".hpp")
LINE_COMMENTS = {".go": "//", ".rs": "///", ".cs": "///", ".swift": "///", ".rb": "#"}
MIN_COMMENT = 10


def doc_comments(files: DataFrame) -> DataFrame:
    """Doc comments: source_file, line (of their start), text."""
    ext = extension(F.col("source_file"))
    pattern = r"(?s)/\*\*\s*(.*?)\*/"
    block = files.where(ext.isin(*BLOCK_COMMENTS))
    # The text before the n-th comment is what splitting at comments leaves before it.
    parts, bodies, marks = F.split("text", pattern), F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    breaks = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
    upto = lambda i: F.aggregate(F.slice(parts, 1, i + 1), F.lit(0), lambda s, x: s + breaks(x)) + F.aggregate(F.when(i > 0, F.slice(marks, F.lit(1), i)).otherwise(F.array().cast("array<string>")), F.lit(0), lambda s, x: s + breaks(x))
    found = block.select("source_file", F.explode(F.transform(bodies, lambda b, i: F.struct((upto(i) + 1).alias("line"), clean_comment(b).alias("text")))).alias("c")).select("source_file", "c.line", "c.text")
    mark = F.create_map(*[F.lit(x) for kv in LINE_COMMENTS.items() for x in kv])[ext]
    lines = files.where(ext.isin(*LINE_COMMENTS)).select("source_file", mark.alias("mark"), F.posexplode(F.split("text", "\n")).alias("at", "line_text"))
    lines = lines.withColumn("comment", F.col("line_text").startswith(F.col("mark")))
    order = W.partitionBy("source_file").orderBy("at")
    lines = lines.withColumn("run", F.sum((~F.col("comment")).cast("int")).over(order))
    runs = lines.where("comment").groupBy("source_file", "run").agg(F.min("at").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line_text"))), lambda x: x["line_text"]), "\n").alias("body"))
    found = found.unionByName(runs.select("source_file", (F.col("at") + 1).alias("line"), clean_comment(F.col("body")).alias("text")))
    return found.where(F.length("text") >= MIN_COMMENT)


def described(nodes: DataFrame, comments: DataFrame) -> DataFrame:
    """(id, description): each comment goes to the next node at or below its line in the file; of several the first stays.

    A forward as-of join as a window over nodes and comments together.
    """
    line = F.regexp_extract("source_location", "^L([0-9]+)$", 1)
    at = nodes.where(line != "").select("source_file", line.cast("int").alias("line"), F.lit(1).alias("is_node"), "id", F.lit(None).cast("string").alias("text"))
    said = comments.select("source_file", "line", F.lit(0).alias("is_node"), F.lit(None).cast("string").alias("id"), "text")
    order = W.partitionBy("source_file").orderBy("line", "is_node", "id").rowsBetween(W.currentRow, W.unboundedFollowing)
    met = at.unionByName(said).withColumn("next", F.first("id", ignorenulls=True).over(order)).where("is_node = 0 and next is not null")
    return met.groupBy(F.col("next").alias("id")).agg(F.min_by("text", "line").alias("description"))
