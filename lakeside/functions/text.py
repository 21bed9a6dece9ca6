"""Column functions on text, paths and names.  All stay in the JVM."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_table() -> tuple[str, str]:
    """Letters with one-letter folded forms, from the Unicode database."""
    pairs = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        if c in "đĐ":
            base = "d"
        if len(base) == 1 and base != c:
            pairs[c] = base
    return "".join(pairs), "".join(pairs.values())


FOLD_FROM, FOLD_TO = _fold_table()


def fold_text(c: Column) -> Column:
    """Lower case without diacritics; the barred d folds to d."""
    return F.translate(F.lower(F.translate(c, FOLD_FROM, FOLD_TO)), "̣̀́̂̃̈̉̊̌̆̄̇", "")


def fold_literal(s: str) -> str:
    out = "".join(x for x in unicodedata.normalize("NFKD", s) if not unicodedata.combining(x)).lower()
    return out.replace("đ", "d")


def alnum_tokens(c: Column, least: int = 2) -> Column:
    """Runs of letters, marks and digits of at least ``least`` characters."""
    return F.filter(F.split(c, r"[^\p{L}\p{M}\p{N}]+"), lambda t: F.length(t) >= least)


def symbol_tokens(c: Column) -> Column:
    """Set of lower-case parts of an identifier, split at case and acronym boundaries."""
    s = F.regexp_replace(c, r"([\p{Ll}])([\p{Lu}])", "$1 $2")
    s = F.regexp_replace(s, r"([\p{Lu}]+)([\p{Lu}][\p{Ll}])", "$1 $2")
    s = F.regexp_replace(s, r"(?<=\p{Lu}\d)(?=[\p{Lu}][\p{Ll}])", " ")
    return F.array_distinct(F.filter(F.split(F.lower(s), r"[^\p{L}\p{M}\p{N}]+"), lambda t: t != ""))


def path_tokens(path: Column) -> Column:
    """For each alphanumeric run of a path: the folded run, then its folded parts (so a run of one part stands twice)."""
    runs = alnum_tokens(path, 1)
    return F.flatten(F.transform(runs, lambda r: F.concat(F.array(fold_text(r)), F.transform(symbol_tokens(r), fold_text))))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"[^.]\.([^.]*)$", 1))


def dir_name(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def top_dir(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise("")


def trunc_head(c: Column, n: int) -> Column:
    """The first characters, an ellipsis in place of the rest."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n - 1)), F.lit("…"))).otherwise(c)


def trunc_tail(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.lit("…"), F.right(c, F.lit(n - 1)))).otherwise(c)


def est_tokens(c: Column) -> Column:
    return F.ceil(F.length(c) / 4).cast("long")


def normalize_query(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


# Languages by file name and extension.
BASE_NAMES = {"makefile": "bash", "dockerfile": "bash", "justfile": "bash", "gemfile": "text", "podfile": "text"}
EXTENSIONS = {
    "swift": "swift", "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "tsx", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "go": "go", "rs": "rust", "json": "json",
    "yaml": "yaml", "yml": "yaml", "html": "html", "htm": "html", "css": "css", "sh": "bash", "bash": "bash", "zsh": "bash", "md": "markdown", "markdown": "markdown", "txt": "text", "toml": "text",
}
# Kinds of files by extension.
KIND_TAGS = {
    "code": "py ts tsx js jsx swift go rs sh rb java kt c cc cpp m mm mjs",
    "doc": "md txt rst adoc html",
    "data": "json jsonl csv tsv yaml yml xml sql",
    "config": "toml ini conf cfg env",
}
# Names of secrets.
SECRET_NAMES = (".env", "credentials", "secret", "id_rsa", "id_ed25519", ".pem", ".key", ".p12", ".pfx", ".keystore")
# Names of raw declaration nodes and their common kinds.
NORM_KINDS = {
    "function": "function_declaration function_definition function_item function_expression function_signature generator_function_declaration arrow_function operator_declaration",
    "method": "method_definition method_declaration method_signature protocol_function_declaration",
    "initializer": "init_declaration deinit_declaration",
    "subscript": "subscript_declaration",
    "class": "class_declaration abstract_class_declaration class_definition",
    "struct": "struct_declaration struct_item",
    "enum": "enum_declaration enum_item",
    "union": "union_item",
    "protocol": "protocol_declaration",
    "interface": "interface_declaration",
    "trait": "trait_item",
    "extension": "extension_declaration impl_item",
    "type": "typealias_declaration type_alias_declaration type_declaration type_item associatedtype_declaration ambient_declaration",
    "variable": "property_declaration public_field_definition field_declaration lexical_declaration variable_declaration var_declaration var_spec assignment",
    "property": "pair",
    "constant": "const_declaration const_spec const_item static_item",
    "module": "mod_item internal_module module",
    "macro": "macro_definition macro_declaration",
    "heading": "heading",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def language(path: Column) -> Column:
    return F.coalesce(_lookup(BASE_NAMES, F.lower(base_name(path))), _lookup(EXTENSIONS, extension(path)))


def kind_tag(path: Column) -> Column:
    return F.coalesce(_lookup({e: k for k, es in KIND_TAGS.items() for e in es.split()}, extension(path)), F.lit("other"))


def norm_kind(raw: Column, decl: Column) -> Column:
    word = F.regexp_extract(decl, r"\b(struct|enum|actor|extension|protocol|interface|class)\b", 1)
    mapped = _lookup({r: k for k, rs in NORM_KINDS.items() for r in rs.split()}, raw)
    return F.when(raw.isin("class_declaration", "extension_declaration") & (word != ""), word).otherwise(F.coalesce(mapped, raw))


def is_secret_name(name: Column) -> Column:
    low = F.lower(name)
    return reduce(lambda a, b: a | b, [low.startswith(p) | low.endswith(p) for p in SECRET_NAMES]) | low.contains("secret")


def is_test_like(path: Column) -> Column:
    """Test paths by place and name (ranking)."""
    return path.rlike(r"^(tests|test|__tests__)/|/(tests|test|__tests__)/|\.(test|spec)\.|_test\.") | F.lower(path).contains(".mock.") | F.lower(base_name(path)).rlike("^test[-_]")


def is_test_path(path: Column) -> Column:
    """Test paths by any mention (impact and coverage)."""
    return path.rlike("(?i)(test|spec)")


# Words of directories for old things.
ARCHIVE_WORDS = ("archive", "archived", "legacy", "deprecated", "attic", "old", "backup", "backups", "snapshot", "snapshots")


def archive_segments(path: Column) -> Column:
    """Directories of a path with a word for old things; the file name does not count."""
    dirs = F.slice(F.split(F.lower(path), "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    words = F.array(*[F.lit(w) for w in ARCHIVE_WORDS])
    return F.size(F.filter(dirs, lambda d: F.arrays_overlap(F.split(d, r"[^\p{L}\p{N}]+"), words)))


def identifier_like(c: Column) -> Column:
    """One word that looks like code: with a joiner, a capital inside, or a capital first."""
    return c.rlike(r"^\S{2,}$") & (c.rlike(r"[_:./\\-]") | c.rlike(r"[a-z][A-Z]") | c.rlike(r"^[A-Z][A-Za-z0-9]+$"))


def norm_route(raw: Column) -> Column:
    """Path of a route without host, query, fragment and closing slashes; null unless it has two segments or a known root."""
    p = F.regexp_replace(F.trim(raw), r"^https?://[^/]+", "")
    gone = (p == "") & F.trim(raw).rlike(r"^https?://")
    p = F.regexp_replace(p, r"[?#][\s\S]*$", "")
    p = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))
    p = F.regexp_replace(p, r"(?<=.)/+$", "")
    known = p.rlike(r"(?i)^/(api|graphql|auth|health|status|webhook|oauth)(/|$)") | p.rlike(r"^/v\d*(/|$)")
    return F.when(~gone & (F.length(p) > 1) & ~p.contains(" ") & (p.rlike(r"^/[^/]*/.") | known), p)


def _glob(pattern: str, star: str) -> str:
    return "".join(star if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)


def ignored_by(path: Column, patterns: list[str]) -> Column:
    """Whether an ignore pattern covers a path: ``dir/`` a directory of it, one with a slash the whole path, else its name; lines with ! count for nothing."""
    out = F.lit(False)
    for raw in patterns:
        p = raw.strip().removeprefix("/")
        if not p or raw.startswith(("!", "#")):
            continue
        if p.endswith("/"):
            body = _glob(p[:-1], "[^/]*")
            hit = path.rlike(f"^{body}/") if "/" in p[:-1] else path.rlike(f"(^|/){body}/")
        elif "/" in p:
            hit = path.rlike(f"^{_glob(p, '.*')}$")
        else:
            hit = base_name(path).rlike(f"^{_glob(p, '.*')}$")
        out = out | hit
    return out
