"""Symbols and typed edges of source files by line patterns of several languages, as JVM expressions over exploded lines.

There is no parser here: authority ``heuristic`` marks what a line pattern says, ``lexical`` a bare shared identifier. Lines are split
and matched inside one projection, so a file's text is read once and never shuffled; windows run over a file's few edge rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a line that defines, imports, calls or extends looks like (Go, Python, TypeScript, JavaScript, Rust, Java, C).
DEFINES = r"^\s*(?:export\s+|default\s+|pub(?:\([a-z]+\))?\s+|public\s+|private\s+|protected\s+|static\s+|final\s+|abstract\s+|async\s+)*(?:def|class|func(?:\s+\([^)]*\))?|function|fn|type|interface|struct|enum|trait|impl|record|const|let)\s+([A-Za-z_]\w{2,})"
IMPORTS = r"^\s*(?:import|from|use|require|#include)\s+[\"'<({]*\s*([\w./:@\-]{3,})"
CALLS = r"\b([A-Za-z_]\w{2,})\s*\("
INHERITS = r"(?:\bextends\s+|\bimplements\s+|^\s*class\s+\w+\s*\(\s*)([A-Za-z_]\w{2,})"
IDENTIFIER = r"\b([A-Za-z_]\w{2,})\b"
# Words that look like calls or imports and are none.
NO_CALL = ("if", "for", "while", "switch", "return", "catch", "def", "func", "function", "class", "and", "not", "with", "elif", "print")
IMPORT_STOP = ("import", "from", "use", "as", "package", "export", "require", "include", "type", "const", "static", "pub", "crate", "super", "self", "mod", "extern", "with", "select", "default")
MOST_EDGES = 512  # of a file


def lines(files: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """(path, line, code): lines from 1, without comments that begin them."""
    rows = files.where(F.col(text_col).isNotNull()).select(F.col(path_col).alias("path"), F.posexplode(F.split(text_col, "\n")).alias("i", "code"))
    return rows.where(~F.col("code").rlike(r"^\s*(?://|#(?!include)|/?\*|--)")).select("path", (F.col("i") + 1).alias("line"), "code")


def occurrences(files: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """(path, line, kind, name, at): definitions, imports, inheritance, calls and references of each line, each name once a kind and line;
    ``at`` is the column of its first place. A name that a line defines, imports or calls is no reference of that line."""
    code = F.col("code")
    one = lambda rx: F.filter(F.array(F.regexp_extract(code, rx, 1)), lambda x: x != "")
    defined, imported = one(DEFINES), F.filter(one(IMPORTS), lambda x: ~F.lower(x).isin(*IMPORT_STOP))
    inherited = F.array_distinct(F.regexp_extract_all(code, F.lit(INHERITS), F.lit(1)))
    called = F.array_except(F.filter(F.array_distinct(F.regexp_extract_all(code, F.lit(CALLS), F.lit(1))), lambda x: ~x.isin(*NO_CALL)), F.concat(defined, inherited))
    is_import = code.rlike(r"^\s*(?:import|from|use|require|#include)\s")
    named = F.array_except(F.array_distinct(F.regexp_extract_all(code, F.lit(IDENTIFIER), F.lit(1))), F.concat(defined, called, inherited))
    named = F.when(is_import, F.array().cast("array<string>")).otherwise(named)
    typed = lambda kind, names: F.transform(names, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
    every = F.concat(typed("definition", defined), typed("import", imported), typed("inheritance", inherited), typed("call", called), typed("reference", named))
    rows = lines(files, path_col, text_col).select("path", "line", "code", F.explode(every).alias("o"))
    return rows.select("path", "line", "o.kind", "o.name", F.instr("code", F.col("o.name")).alias("at"))


def _authority(kind: Column) -> tuple[Column, Column]:
    """How an edge was found and how far it is trusted."""
    return F.when(kind == "reference", "lexical").otherwise("heuristic"), F.when(kind == "definition", 0.9).when(kind.isin("call", "inheritance"), 0.7).when(kind == "import", 0.6).otherwise(0.4)


def typed_edges(files: DataFrame, path_col: str, text_col: str, most: int = MOST_EDGES) -> DataFrame:
    """(file, line, position, from, to, kind, authority, confidence): edges from the definition that encloses a line (the last one before it,
    else '<file>') to what the line names, the first ``most`` of a file by line and column. Kinds: call, reference, import, inheritance, definition."""
    o = occurrences(files, path_col, text_col)
    before = Window.partitionBy("path").orderBy("line", F.when(F.col("kind") == "definition", 0).otherwise(1), "at", "name").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = F.coalesce(F.last(F.when(F.col("kind") == "definition", F.col("name")), True).over(before), F.lit("<file>"))
    o = o.withColumn("from", F.when(F.col("kind") == "definition", F.lit("<file>")).otherwise(inside))
    position = F.row_number().over(Window.partitionBy("path").orderBy("line", "at", "kind", "name"))
    authority, confidence = _authority(F.col("kind"))
    e = o.withColumn("position", position).where(F.col("position") <= most)
    return e.select(F.col("path").alias("file"), "line", "position", "from", F.col("name").alias("to"), "kind", authority.alias("authority"), confidence.alias("confidence"))


def heuristic_symbols(files: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """(path, name, kind): every identifier of three bytes or more on a line that defines something is a def, those of all other lines
    are refs unless they are defs of the file; identifiers of import lines, without keywords, are imports too."""
    low = F.lower(F.trim("code"))
    # How lines that define begin.
    starts = r"^(?:def |class |function |fn |func |pub fn |export (?:function|const|class|interface|type|default) |type |interface |const |let |struct |impl |enum |async def )"
    rows = files.where(F.col(text_col).isNotNull()).select(F.col(path_col).alias("path"), F.explode(F.split(text_col, "\n")).alias("code"))
    names = F.array_distinct(F.regexp_extract_all("code", F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))
    rows = rows.select("path", (low.rlike(starts) | low.contains(" implements ")).alias("defines"), low.rlike(r"^(?:import|from|use) ").alias("imports"), F.explode(F.filter(names, lambda x: F.octet_length(x) >= 3)).alias("name"))
    flags = rows.groupBy("path", "name").agg(F.bool_or("defines").alias("d"), F.bool_or(F.col("imports") & ~F.lower("name").isin(*IMPORT_STOP)).alias("i"))
    kinds = F.array_compact(F.array(F.when(F.col("d"), "def").otherwise("ref"), F.when(F.col("i"), "import")))
    return flags.select("path", "name", F.explode(kinds).alias("kind"))
