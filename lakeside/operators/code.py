"""Declarations, types, imports and slices of source text; all in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.storage import written
from . import ingest
from .ingest import _found, _lines

#: Words that open a declaration, and the kind of what they declare.
OPENERS = {"class": "class", "struct": "struct", "enum": "enum", "trait": "trait", "interface": "interface", "protocol": "protocol", "extension": "extension", "actor": "class", "def": "function", "func": "function", "function": "function", "fn": "function"}
_MODIFIERS = "export default public private protected internal open final static abstract async override pub mutating"
DECLARED = rf"^(\s*)(?:(?:{'|'.join(_MODIFIERS.split())})\s+)*({'|'.join(OPENERS)})\s+([A-Za-z_]\w*)"
# Names of types that every program uses.
PLAIN_TYPES = frozenset("String Int Bool Double Float Any Self None True False List Dict Set Tuple Optional Union Array Map Vec Option Result Box Void Object Promise Record".split())
PACKAGE_STEMS = ("__init__", "index", "mod")


def symbols(src: DataFrame) -> DataFrame:
    """path, line, name, kind, depth (indents of four), signature (200 characters at most) of each declaration, one a line."""
    m = F.regexp_extract
    hit = _lines(src).filter(F.col("text").rlike(DECLARED))
    return hit.select("path", "line", m("text", DECLARED, 3).alias("name"), F.element_at(F.create_map(*[F.lit(x) for kv in OPENERS.items() for x in kv]), m("text", DECLARED, 2)).alias("kind"), F.floor(F.length(F.replace(m("text", DECLARED, 1), F.lit("\t"), F.lit("    "))) / 4).cast("int").alias("depth"), F.left(F.trim("text"), F.lit(200)).alias("signature"))


def type_uses(src: DataFrame) -> DataFrame:
    """Capitalised names after a colon or an arrow, each once a line: path, line, name, kind uses_type."""
    hits = _lines(src).select("path", "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?::|->)\s*(?:\w+\.)*([A-Z]\w*)")))).alias("name"))
    return hits.filter(~F.col("name").isin(*sorted(PLAIN_TYPES))).withColumn("kind", F.lit("uses_type"))


def module_stems(files: DataFrame) -> DataFrame:
    """path and the names that import it: its stem, and its folder's name where the stem stands for a package."""
    stem = X.stem(F.col("path"))
    folder = F.element_at(F.split(X.dir_name(F.col("path")), "/"), -1)
    names = F.when(stem.isin(*PACKAGE_STEMS) & (folder != ""), F.array(stem, folder)).otherwise(F.array(stem))
    return files.select("path", F.explode(names).alias("stem"))


def import_scope(imports: DataFrame, files: DataFrame) -> DataFrame:
    """file, qualifier (the imported name) and target file of each import (path, name)."""
    stems = module_stems(files).select(F.col("path").alias("target"), F.col("stem").alias("qualifier"))
    return imports.select(F.col("path").alias("file"), F.col("name").alias("qualifier")).distinct().join(stems, "qualifier").filter("file <> target")


def resolved_calls(src: DataFrame, symbols: DataFrame) -> DataFrame:
    """path, line, name, qualifier, kind, target of the calls of all files (path, content, each path once), by the rules of ``lookup.resolve_edges``.

    ``symbols``: id, name, file.  A call meets its name once: names that one file declares are settled by that, qualified
    ones by the imports of their own file; only calls of names with several files need the imports of others.
    """
    calls = ingest.call_edges(src.select("path", "content", ingest.imported_names(F.col("content")).alias("imports")))
    own = F.coalesce("qualifier", F.lit("")).isin("", "self", "cls", "this", "super")
    asked = F.when(own, "").when(F.array_contains("imports", F.col("qualifier")), F.col("qualifier"))
    calls = calls.select("path", "line", "name", "qualifier", "kind", asked.alias("asked"))
    per = symbols.filter("file is not null").groupBy("name", "file").agg(F.min("id").alias("id"))
    stems = module_stems(per.select(F.col("file").alias("path")).distinct()).select(F.col("path").alias("file"), "stem")
    # of the files that a name, or a name with a stem, may stand for the first two: the calling file itself is none of a stem's
    offered = per.select("name", F.lit("").alias("asked"), "file", "id").unionByName(per.join(stems, "file").filter("stem not in ('', 'self', 'cls', 'this', 'super')").select("name", F.col("stem").alias("asked"), "file", "id"))
    w = Window.partitionBy("name", "asked").orderBy("id", "file")
    two = offered.withColumn("rn", F.row_number().over(w)).filter("rn <= 2").groupBy("name", "asked").agg(F.max(F.when(F.col("rn") == 1, F.col("file"))).alias("first"), F.max(F.when(F.col("rn") == 2, F.col("file"))).alias("second"))
    met = calls.join(two, ["name", "asked"], "left")
    several = two.filter("asked = '' and second is not null").select("name")
    target = F.when(F.col("asked") != "", F.when(F.col("first") != F.col("path"), F.col("first")).otherwise(F.col("second"))).otherwise(F.col("first"))
    out = ["path", "line", "name", "qualifier", "kind"]
    if several.isEmpty():
        return met.select(*out, target.alias("target"))
    met = written(met)
    shared = per.join(several, "name")
    here = shared.select(F.col("file").alias("path"), "name", F.lit(1).alias("rank"), "id", F.col("file").alias("target"))
    uses = import_scope(src.select("path", F.explode(ingest.imported_names(F.col("content"))).alias("name")), src.select("path")).select(F.col("file").alias("path"), F.col("target").alias("file")).distinct()
    there = shared.join(uses, "file").select("path", "name", F.lit(2).alias("rank"), "id", F.col("file").alias("target"))
    best = here.unionByName(there).groupBy("path", "name").agg(F.min_by("target", F.struct("rank", "id")).alias("target"))
    unclear = F.coalesce((F.col("asked") == "") & F.col("second").isNotNull(), F.lit(False))
    return met.filter(~unclear).select(*out, target.alias("target")).unionByName(met.filter(unclear).join(best, ["path", "name"], "left").select(*out, "target"))


def bracket_delta(c: Column) -> Column:
    """Opening less closing brackets."""
    return F.length(F.translate(c, ")]}", "")) - F.length(F.translate(c, "([{", ""))


def ident_tokens(c: Column) -> Column:
    """Identifiers of a line, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"([A-Za-z_]\w*)"), F.lit(1)))


def arity(c: Column) -> Column:
    """Parameters in the first bracketed list after a name; null without one."""
    inside = F.regexp_extract(c, r"[A-Za-z_]\w*\s*\(([^()]*)\)", 1)
    n = F.when(F.trim(inside) == "", 0).otherwise(F.length(inside) - F.length(F.replace(inside, F.lit(","), F.lit(""))) + 1)
    return F.when(c.rlike(r"[A-Za-z_]\w*\s*\([^()]*\)"), n)


def signature_slice(lines: Column, at: Column, most: int = 6) -> Column:
    """A declaration from its line on until its brackets balance, ``most`` lines at most, an ellipsis if they don't."""
    cuts = [F.array_join(F.slice(lines, at, F.lit(k)), "\n") for k in range(1, most + 1)]
    return reduce(lambda rest, cut: F.when(bracket_delta(cut) <= 0, cut).otherwise(rest), reversed(cuts), F.concat(cuts[-1], F.lit("…")))


def outline(src: DataFrame) -> DataFrame:
    """path, idx, name, kind, signature of the declarations of each file, in order."""
    at = symbols(src).join(src.select("path", F.split("content", "\n").alias("lines")), "path")
    order = Window.partitionBy("path").orderBy("line")
    return at.select("path", (F.row_number().over(order) - 1).alias("idx"), "name", "kind", signature_slice(F.col("lines"), F.col("line")).alias("signature"))


def declaration_chunks(src: DataFrame, most: int = 400) -> DataFrame:
    """Chunks that begin at top-level declarations and what precedes the first: path, idx, start_line, end_line, symbol; long ones in windows of ``most`` lines."""
    tops = symbols(src).filter("depth = 0").select("path", F.col("line").alias("start_line"), "name")
    sized = src.select("path", F.size(F.split("content", "\n")).alias("n"))
    first = sized.select("path", F.lit(1).alias("start_line"), F.lit(None).cast("string").alias("name")).join(tops.filter("start_line = 1").select("path"), "path", "left_anti")
    order = Window.partitionBy("path").orderBy("start_line")
    cut = tops.unionByName(first).join(sized, "path").withColumn("end_line", F.coalesce(F.lead("start_line").over(order) - 1, F.col("n")))
    parts = cut.select("path", "name", "end_line", F.explode(F.sequence("start_line", "end_line", F.lit(most))).alias("start_line"))
    return parts.select("path", (F.row_number().over(order) - 1).alias("idx"), "start_line", F.least("end_line", F.col("start_line") + most - 1).alias("end_line"), F.col("name").alias("symbol"))


def text_usages(src: DataFrame, names: list[str]) -> DataFrame:
    """path, line, name of lines that hold a name as a whole word."""
    found = F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.array_contains(ident_tokens(F.col("text")), n))
    return _lines(src).select("path", "line", F.explode(found).alias("name"))


__all__ = ["_found", "arity", "bracket_delta", "declaration_chunks", "ident_tokens", "import_scope", "module_stems", "outline", "resolved_calls", "signature_slice", "symbols", "text_usages", "type_uses"]
