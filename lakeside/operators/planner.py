"""Around a search: atoms to probe paths with, the path probe, checks of a model's replies, the loop of a planner."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.storage import written
from . import fts

# Words (folded) that mark a query for a command, and the atoms that such queries add.
COMMAND_WORDS = ("lenh", "command", "cli", "tool", "tien ich", "cong cu")
COMMAND_ATOMS = ("ctl", "cli", "cmd")
# Function words, English and Vietnamese (folded), that no variant of a question holds.
VARIANT_STOPWORDS = frozenset("the a an of to in for on at by with from into and or but is are was were be been it its that this one when while as do does va cua cho trong cac mot khi la bi dang con nao theo de voi thanh nhung moi tung".split())
SPACES = r"[\t\n\x0B\f\r ]+"
EDGES = ".,;:!?\"'(){}[]<>"
SHAPED = (r"[_/.:\-]", r"[a-zA-Z][0-9]|[0-9][a-zA-Z]|[a-z][A-Z]|[A-Z]{2,}")
TERM = r"^[A-Za-z0-9][A-Za-z0-9 _\-]*$"


def folded_words(query: Column) -> Column:
    return F.filter(F.split(X.fold_text(query), fts.TOKEN_SPLIT), lambda t: t != "")


def command_atoms(query: Column) -> Column:
    """ctl, cli and cmd for a query that asks for a command or tool, else none."""
    hay = F.concat(F.lit(" "), F.array_join(folded_words(query), " "), F.lit(" "))
    asks = reduce(lambda x, y: x | y, [F.contains(hay, F.lit(f" {w} ")) for w in COMMAND_WORDS])
    return F.when(asks, F.array(*[F.lit(a) for a in COMMAND_ATOMS])).otherwise(F.array().cast("array<string>"))


def protected_tokens(query: Column, most: int = 12) -> Column:
    """Words that a translation must leave as they are (joined, mixed with digits, capitals inside or in a row), each once, in order."""
    words = F.transform(F.split(query, SPACES), lambda w: F.btrim(w, F.lit(EDGES)))
    shaped = lambda w: (F.length(w) >= 2) & reduce(lambda x, y: x | y, [w.rlike(p) for p in SHAPED])
    return F.slice(F.array_distinct(F.filter(words, shaped)), 1, most)


def _singular(t: Column) -> Column:
    n = F.length(t)
    ies = F.endswith(t, F.lit("ies")) & (n >= 5)
    plain = F.endswith(t, F.lit("s")) & ~F.endswith(t, F.lit("ss"))
    return F.when(n < 4, F.lit(None)).when(ies, F.concat(F.left(t, n - 3), F.lit("y"))).when(plain, F.left(t, n - 1))


def _stem(t: Column) -> Column:
    n = F.length(t)
    return F.when(n >= 5, F.coalesce(*[F.when(F.endswith(t, F.lit(s)) & (n - len(s) >= 3), F.left(t, n - len(s))) for s in fts.SUFFIXES]))


def _present(xs: Column, least: int) -> Column:
    return F.filter(xs, lambda a: a.isNotNull() & (F.length(a) >= least))


def _atoms(words: Column) -> Column:
    """Words of two characters and more, each followed by its singular."""
    return _present(F.flatten(F.transform(_present(words, 2), lambda w: F.array(w, _singular(w)))), 3)


def probe_atoms(queries: DataFrame, most: int = 24) -> DataFrame:
    """id, atoms of the path probe of each query (id, query, terms, guessed): (atom, weak, championless), ``most`` at most, each atom in the first group that has it.

    Words of the lexicon's ``terms`` and of the folded query come first, then ``guessed`` words, stems of the
    first group, beginnings and ends of long words, initials of neighbouring words.
    """
    none = F.array().cast("array<string>")
    stop = F.array(*[F.lit(w) for w in sorted(fts.VN_STOPWORDS)])
    apart = lambda c: F.filter(F.split(F.lower(c), fts.TOKEN_SPLIT), lambda t: t != "")
    told = lambda c: _atoms(F.flatten(F.transform(F.slice(F.coalesce(c, none), 1, 12), apart)))
    # a column a step: a lambda computes what stands in it again for every element
    q = queries.select("id", folded_words(F.col("query")).alias("folded"), told("terms").alias("told"), told("guessed").alias("guesses"))
    q = q.withColumn("base", F.array_distinct(F.concat("told", F.filter(_atoms(F.col("folded")), lambda a: ~F.array_contains(stop, a)))))
    q = q.withColumn("words", F.filter("folded", lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t)))
    ends = lambda t: F.flatten(F.transform(F.sequence(F.lit(4), F.least(F.lit(7), F.length(t) - 1)), lambda n: F.array(F.left(t, n), F.right(t, n))))
    parts = F.flatten(F.transform(F.filter("words", lambda t: F.length(t) >= 8), ends))
    firsts = F.transform("words", lambda w: F.left(w, F.lit(1)))
    q = q.withColumn("bare", F.concat("guesses", _present(F.transform("base", _stem), 3), parts)).withColumn("firsts", firsts)
    spells = lambda n: F.when(F.size("firsts") >= n, F.transform(F.sequence(F.lit(1), F.size("firsts") - (n - 1)), lambda i: F.array_join(F.slice("firsts", i, n), ""))).otherwise(none)
    initials = F.filter(F.concat(spells(3), spells(4)), lambda a: a.rlike(r"^\p{L}+$"))
    q = q.withColumn("named", F.slice(F.array_distinct(F.concat("base", "bare", initials)), 1, most))
    weak = lambda a: ~F.array_contains("base", a)
    return q.select("id", F.transform("named", lambda a: F.struct(a.alias("atom"), weak(a).alias("weak"), (weak(a) & F.array_contains("bare", a)).alias("championless"))).alias("atoms"))


def path_probe(post: DataFrame, sized: DataFrame, atoms: list[str], rare: int = 15, each: int = 20) -> DataFrame:
    """atom, id, score of the files that each atom's probe brings, ``each`` at most.

    An atom begins a token of the file's path; with it one of its companions begins a folded token.  Companions are the
    three rarest and five commonest other atoms, of atoms in more than ``rare`` paths first the four rarest that occur at
    all.  The first try that finds files counts; the path alone is the last one of a rare atom.
    """
    clauses = [(a, f) for f in ("path", "folded") for a in atoms]
    spark, width = post.sparkSession, len(atoms)
    part = written(fts.clause_scores(post, clauses, {"path": fts.WEIGHTS["path"], "folded": fts.WEIGHTS["folded"]}, sized=sized))  # each step below reads it
    # the atoms of a query: a few rows by construction
    names = spark.createDataFrame(list(enumerate(atoms)), "k int, atom string")
    found = part.groupBy("clause").agg(F.count(F.lit(1)).alias("df"))
    df = names.join(found.filter(F.col("clause") < width).select(F.col("clause").alias("k"), F.col("df").alias("path_df")), "k", "left").join(found.filter(F.col("clause") >= width).select((F.col("clause") - width).alias("k"), F.col("df").alias("text_df")), "k", "left").fillna(0, ["path_df", "text_df"])
    a, b = df.alias("a"), df.alias("b")
    w = Window.partitionBy("k").orderBy("text_df", "other_atom")
    others = a.join(b, F.expr("a.k <> b.k")).select("a.k", "a.path_df", F.col("b.k").alias("other"), F.col("b.atom").alias("other_atom"), F.col("b.text_df").alias("text_df"))
    placed = others.withColumn("at", F.row_number().over(w)).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("k"))).withColumn("nth", F.sum((F.col("text_df") > 0).cast("int")).over(w))
    blend = placed.filter("at <= 3 or at > of - 5").select("k", "other", F.lit(1).alias("try"))
    tight = placed.filter((F.col("path_df") > rare) & (F.col("text_df") > 0) & (F.col("nth") <= 4)).select("k", "other", F.lit(0).alias("try"))
    anchor = part.filter(F.col("clause") < width).select(F.col("clause").alias("k"), "id", F.col("score").alias("named"))
    said = part.filter(F.col("clause") >= width).select((F.col("clause") - width).alias("other"), "id", F.col("score").alias("said"))
    both = anchor.join(F.broadcast(tight.unionByName(blend)), "k").join(said, ["other", "id"]).groupBy("k", "try", "id", "named").agg(F.sum("said").alias("said"))
    alone = anchor.join(F.broadcast(df.filter(F.col("path_df") <= rare).select("k")), "k", "left_semi").select("k", F.lit(2).alias("try"), "id", "named", F.lit(0.0).alias("said"))
    tries = both.unionByName(alone, allowMissingColumns=True)
    first = tries.groupBy("k").agg(F.min("try").alias("try"))
    order = Window.partitionBy("k").orderBy(F.desc("score"), "id")
    hits = tries.join(first, ["k", "try"], "left_semi").withColumn("score", F.round(F.col("named") + F.col("said"), 9)).withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= each)
    return hits.join(F.broadcast(names), "k").select("atom", "id", "score")


def _once(low: str) -> Callable[[Column, Column], Column]:
    """Whether an element is the first of its lower-case form, of which ``low`` holds all."""
    return lambda t, i: F.array_position(low, F.lower(t)) == i + 1


def checked_replies(replies: DataFrame, most: int = 12, most_names: int = 16) -> DataFrame:
    """id, terms, names of a translator's JSON reply to a query (id, raw, query); nulls where it breaks the contract.

    The JSON may lack its closing signs.  Every protected word of the query must be among its english_terms, their
    parts, or its protected_tokens; terms have 2 to 64 plain characters, names 40, each once whatever its case.
    """
    fields = "english_terms|protected_tokens|filename_terms"
    plain = F.regexp_replace(F.when(F.octet_length("raw") <= 8192, F.col("raw")), r"\x1B\[[0-9;?]*[A-Za-z]", "")
    # a column a step: a lambda computes what stands in it again for every element
    r = replies.select("id", F.regexp_replace(plain, rf'"\s*({fields})\s*"\s*:', '"$1":').alias("tidy"), protected_tokens(F.col("query")).alias("required"))
    r = r.withColumn("opened", F.when(F.contains("tidy", F.lit("{")), F.substring("tidy", F.instr("tidy", "{"), F.length("tidy"))))
    closed = F.nullif(F.regexp_extract("opened", r"^[\s\S]*\}", 0), F.lit(""))
    r = r.withColumn("value", F.coalesce(*[F.try_parse_json(c) for c in (closed, *(F.concat("opened", F.lit(s)) for s in ("}", "]}", '"]}')))]))
    listed = lambda name: F.coalesce(F.transform(F.filter(F.try_variant_get("value", f"$.{name}", "array<variant>"), lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.trim(v.cast("string"))), F.array().cast("array<string>"))
    fits = lambda n: lambda t: F.length(t).between(2, n) & t.rlike(TERM)
    r = r.select("id", "required", listed("english_terms").alias("said"), listed("protected_tokens").alias("kept"), F.filter(listed("filename_terms"), fits(40)).alias("files"))
    known = F.concat("said", "kept", F.flatten(F.transform("said", lambda t: F.split(t, fts.TOKEN_SPLIT))))
    r = r.select("id", (F.size(F.array_except("required", known)) == 0).alias("whole"), F.filter("said", fits(64)).alias("fit"), "files")
    r = r.withColumn("low", F.transform("fit", F.lower)).withColumn("terms", F.slice(F.filter("fit", _once("low")), 1, most))
    r = r.withColumn("taken", F.transform("terms", F.lower)).withColumn("more", F.filter("files", lambda t: ~F.array_contains("taken", F.lower(t))))
    r = r.withColumn("more_low", F.transform("more", F.lower)).withColumn("names", F.slice(F.filter("more", _once("more_low")), 1, most_names))
    good = F.col("whole") & (F.size("terms") > 0)
    return r.select("id", F.when(good, F.col("terms")).alias("terms"), F.when(good, F.col("names")).alias("names"))


def variants(questions: DataFrame, most: int = 32) -> DataFrame:
    """id, variants of a question (id, question): neighbouring words in pairs, the last pair first, without function words, each once, ``most`` at most."""
    stop = F.array(*[F.lit(w) for w in sorted(VARIANT_STOPWORDS)])
    q = questions.select("id", F.filter(F.split("question", fts.TOKEN_SPLIT), lambda t: F.length(t) >= 2).alias("words"))
    q = q.withColumn("plain", F.transform("words", lambda w: ~F.array_contains(stop, X.fold_text(w))))
    at = F.when(F.size("words") >= 2, F.reverse(F.sequence(F.lit(1), F.size("words") - 1))).otherwise(F.array().cast("array<int>"))
    chosen = F.filter(at, lambda i: F.element_at("plain", i) & F.element_at("plain", i + 1))
    q = q.withColumn("pairs", F.transform(chosen, lambda i: F.concat_ws(" ", F.element_at("words", i), F.element_at("words", i + 1))))
    q = q.withColumn("low", F.transform("pairs", F.lower))
    return q.select("id", F.slice(F.filter("pairs", _once("low")), 1, most).alias("variants"))


def decision(reply: str, most: int = 3) -> tuple[list[str], bool]:
    """Queries that a planner's reply asks for (none: it wants to answer), and whether it was malformed."""
    low, high = reply.find("{"), reply.rfind("}")
    try:
        said = json.loads(reply[low : high + 1]) if 0 <= low < high else None
    except ValueError:
        said = None
    action = str(said["action"]).strip().lower() if isinstance(said, dict) and isinstance(said.get("action"), str) else None
    if action != "search":
        return [], action != "answer"
    listed = said.get("queries")
    asked = [*(listed if isinstance(listed, list) else []), said.get("query")]
    return [q.strip() for q in asked if isinstance(q, str) and q.strip()][:most], False


@dataclass
class Report:
    rounds: int = 0
    tried: list[str] = field(default_factory=list)
    growth: list[int] = field(default_factory=list)
    malformed: int = 0
    stopped: str = "round_cap"


def plan(own: list[str], decide: Callable[[list[str], int], str], collect: Callable[[str, int], int], has_room: Callable[[], bool], left: Callable[[], float], rounds: int = 4, own_each: int = 2) -> Report:
    """Rounds of searches until the planner answers, time or room is over, or two rounds bring nothing.

    ``own``: the question's variants, two a round, a file each; ``decide``: the planner's reply to the queries tried so
    far; ``collect``: adds a query's evidence, so many files at most, and says how many; ``left``: seconds.
    """
    report, seen, barren, waiting = Report(), set(), 0, list(own)

    def search(query: str, files: int) -> int:
        norm = " ".join(query.lower().split())
        if len(norm) < 3 or "<" in norm or norm in seen:
            return 0
        seen.add(norm)
        if left() <= 0.2:
            return 0
        report.tried.append(query)
        return collect(query, files)

    for number in range(1, rounds + 1):
        if left() <= 2:
            report.stopped = "deadline"
            return report
        report.rounds = number
        now, waiting = waiting[:own_each], waiting[own_each:]
        added = sum(search(q, 1) for q in now)
        if has_room():
            try:
                reply = decide(report.tried, number)
            except OSError:
                try:  # once more, if time allows
                    reply = decide(report.tried, number) if left() >= 5 else None
                except OSError:
                    reply = None
            if reply is None:
                report.stopped = "planner_error"
                return report
            queries, bad = decision(reply)
            report.malformed += bad
            added += sum(search(q, 2) for q in queries)
        else:
            queries = None
        report.growth.append(added)
        barren = barren + 1 if added == 0 else 0
        if queries == []:
            report.stopped = "answer"
        elif queries is not None and barren >= 2:
            report.stopped = "no_new_evidence"
        elif not has_room():
            report.stopped = "pack_full"
        else:
            continue
        return report
    return report


def answer(pack: list[dict], synthesize: Callable[[list[dict]], dict] | None = None) -> dict:
    """What a model makes of a pack of evidence; without one, or if it fails, the pack and the limitation."""
    why = "no model is set up"
    if synthesize is not None:
        try:
            return {**synthesize(pack), "evidence": pack, "degraded": False}
        except (OSError, ValueError) as e:
            why = f"the model failed: {e}"
    return {"answer": None, "evidence": pack, "degraded": True, "limitations": [why]}


def main_checkout(root: Column, common: Column) -> Column:
    """Folder that all work trees of a repository share: the parent of its common .git; without one the root itself."""
    full = F.when(common.startswith("/"), common).otherwise(F.concat(root, F.lit("/"), common))
    parts = F.filter(F.split(full, "/"), lambda p: (p != "") & (p != "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    parent = F.concat(F.lit("/"), F.array_join(F.slice(up, 1, F.greatest(F.size(up) - 1, F.lit(0))), "/"))
    return F.when(F.element_at(F.concat(F.array(F.lit("")), up), -1) == ".git", parent).otherwise(root)


def repository_key(checkout: Column) -> Column:
    return F.left(F.sha2(checkout.cast("binary"), 256), F.lit(12))


def common_folder(root: str) -> str | None:
    """The common .git of a checkout or of a work tree, read from its files; None outside a repository."""
    git = Path(root, ".git")
    if git.is_dir():
        return str(git)
    if not git.is_file():
        return None
    m = re.match(r"gitdir:\s*(.+)", git.read_text().strip())
    own = (git.parent / m[1]).resolve() if m else None
    link = own / "commondir" if own else None
    return str((own / link.read_text().strip()).resolve()) if link and link.is_file() else str(own) if own else None


def bump_epoch(spark: SparkSession, path: str) -> str:
    """A new nonce of the vectors at ``path``: readers keep what they hold while it is the same."""
    nonce = uuid.uuid4().hex[:16].upper()
    spark.createDataFrame([(nonce,)], "epoch string").coalesce(1).write.mode("overwrite").parquet(path)
    return nonce


def signature(vectors: DataFrame, epochs: DataFrame | None = None) -> DataFrame:
    """One row: the epoch if there is one, else a legacy fingerprint of the number of vectors and the largest id."""
    legacy = vectors.agg(F.concat(F.lit("legacy:"), F.count(F.lit(1)).cast("string"), F.lit(":"), F.coalesce(F.max("vec_id"), F.lit(0)).cast("string")).alias("old"))
    if epochs is None:
        return legacy.select(F.col("old").alias("signature"))
    return legacy.crossJoin(epochs.agg(F.max("epoch").alias("epoch"))).select(F.coalesce("epoch", "old").alias("signature"))  # one row each
