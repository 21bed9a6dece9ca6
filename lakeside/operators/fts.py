"""Fielded full-text ranking: postings, BM25F over prefix clauses, folded legs, record relevance."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold_literal, fold_text, path_tokens
from ..sources.storage import written

# Function words left out of queries (Vietnamese ones in folded form).
VN_STOPWORDS = frozenset("cac con dang trong that roi kem cho voi cua mot nhung khi nhu van chi toi theo den ra vao len tren duoi giua ngoai vay thi ma la va hoac hay neu vi boi do da se rat qua lam nen cung deu moi tung bi co khong duoc nay kia day gi ai thu".split())
EN_STOPWORDS = frozenset("the an of to in for on at by with from into and or but is are was were be been it its that this one when while as do does over under inside".split())
# Derivational suffixes, in the order they are tried.
SUFFIXES = "ational ation ition tion sion ison ments ment ities ity ness ings ing ied ies ful ous ive ize ise ely ers ors es ed ly al ic er or e s y".split()
WEIGHTS = {"content": 1.0, "path": 2.5, "symbol": 5.0, "folded": 0.6}
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def singular(word: str) -> str | None:
    if word.endswith("ies") and len(word) >= 5:
        return word[:-3] + "y"
    return word[:-1] if word.endswith("s") and not word.endswith("ss") and len(word) >= 4 else None


def stem(word: str) -> str | None:
    fits = (word[: -len(s)] for s in SUFFIXES if word.endswith(s) and len(word) - len(s) >= 3)
    return next(fits, None) if len(word) >= 5 else None


def acronyms(words: list[str]) -> list[str]:
    """Initials of three and four words in a row."""
    words = [w for w in words if len(w) >= 2]
    found = ("".join(w[0] for w in words[i : i + n]) for n in (3, 4) for i in range(len(words) - n + 1))
    return list(dict.fromkeys(a for a in found if a.isalpha()))


def query_clauses(query: str) -> list[tuple[str, str | None]]:
    """(prefix, column or None for all) of a query: its content words (12 at most), up to 10 variants, up to 6 acronyms for paths."""
    words = [w for w in re.split(r"[\W_]+", query) if len(w) >= 2]
    content = [w for w in words if fold_literal(w) not in VN_STOPWORDS | EN_STOPWORDS]
    first = [w.lower() for w in (content or words)[:12]]
    variants: list[str] = []
    for w in first:
        variants += [v for v in (singular(w), stem(w)) if v and v not in first and v not in variants]
    variants = variants[:10]
    out: list[tuple[str, str | None]] = [(w, None) for w in dict.fromkeys(first)] + [(v, None) for v in variants]
    return out + [(a, "path") for a in acronyms(first)[:6] if a not in first and a not in variants]


def postings(docs: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """id, field, token, tf: a row for each place of a token, so tf is 1.  Tokens are lower-case runs of letters and digits.

    Nothing is dealt or sorted: a query keeps the rows of its clauses as the texts are read, and only these are grouped.
    """
    cols = F.array(*[F.struct(F.lit(f).alias("field"), F.split(F.lower(c), TOKEN_SPLIT).alias("tokens")) for f, c in fields.items()])
    long = docs.select("id", F.explode(cols).alias("f")).select("id", "f.field", F.explode("f.tokens").alias("token"))
    return long.filter("token <> ''").withColumn("tf", F.lit(1).cast("long"))


def index_fields(content: Column, path: Column, symbols: Column) -> dict[str, Column]:
    """The four fields of the index: content, tokens of the path and of the symbols' names, all of it folded."""
    return {"content": content, "path": F.array_join(path_tokens(path), " "), "symbol": F.array_join(path_tokens(symbols), " "), "folded": fold_text(F.concat_ws(" ", content, path, symbols))}


def lengths(post: DataFrame) -> DataFrame:
    return post.groupBy("id").agg(F.sum("tf").alias("len"))


def clause_scores(post: DataFrame, clauses: list[tuple[str, str | None]], weights: dict[str, float], k1: float = 1.2, b: float = 0.75, sized: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """clause (its position), id, score of all that match a clause: each clause a phrase of its own, tf weighted by field, length over all fields.

    Clauses are prefixes, with ``exact`` whole tokens.  ``sized``: ``lengths`` of all fields.  What matches is written once,
    a row a clause and document, since its frequencies and scores both read it.
    """
    spark = post.sparkSession
    sized = lengths(post) if sized is None else sized
    total = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"))
    token = F.col("token")
    asked = reduce(lambda x, y: x | y, [(token == p) if exact else token.startswith(p) for p in dict.fromkeys(p for p, _ in clauses)])
    wanted = spark.createDataFrame([(i, p, f) for i, (p, f) in enumerate(clauses)], "clause int, prefix string, only string")
    # the clauses of one query: a few rows by construction
    hit = post.filter(asked & F.col("field").isin(*weights)).join(F.broadcast(wanted), F.expr(("token = prefix" if exact else "startswith(token, prefix)") + " and (only is null or only = field)"))
    at = lambda f, w: F.coalesce(F.sum(F.when(F.col("field") == f, F.col("tf"))), F.lit(0)) * F.lit(float(w))
    tf = written(hit.groupBy("clause", "id").agg(reduce(lambda x, y: x + y, [at(f, w) for f, w in weights.items()]).alias("tf")))
    df = tf.groupBy("clause").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    scored = tf.join(F.broadcast(df), "clause").join(sized, "id").crossJoin(total)  # df: a row a clause; total: one row
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return scored.select("clause", "id", part.alias("score"))


def bm25f(post: DataFrame, clauses: list[tuple[str, str | None]], weights: dict[str, float], k1: float = 1.2, b: float = 0.75, sized: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """id, score of all that match a clause: the sum of ``clause_scores``."""
    return clause_scores(post, clauses, weights, k1, b, sized, exact).groupBy("id").agg(F.sum("score").alias("score"))


def folded_variants(query: str) -> list[tuple[str, str | None]]:
    """Clauses on the folded field alone: each content word without its marks, and its singular."""
    words = [w for w, f in query_clauses(query) if f is None]
    folded = [fold_literal(w) for w in words]
    return [(w, "folded") for w in dict.fromkeys([*folded, *filter(None, map(singular, folded))])]


def snippet(text: Column, prefixes: list[str], width: int = 24) -> Column:
    """About ``width`` words around the first that begins with a prefix, such words marked, cut ends shown."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    hit = lambda w: reduce(lambda x, y: x | y, [F.lower(w).startswith(p.lower()) for p in prefixes])
    first = F.array_position(F.transform(words, hit), F.lit(True))
    start = F.greatest(F.lit(1), F.least(first - F.lit(width // 2), F.size(words) - F.lit(width - 1))).cast("int")
    marked = F.transform(F.slice(words, start, F.lit(width)), lambda w: F.when(hit(w), F.concat(F.lit("«"), w, F.lit("»"))).otherwise(w))
    before, after = F.when(start > 1, "… ").otherwise(""), F.when(start + width <= F.size(words), " …").otherwise("")
    return F.when(F.size(words) > 0, F.concat(before, F.array_join(marked, " "), after)).otherwise("")


def tail_fill(first: DataFrame, second: DataFrame, limit: int) -> DataFrame:
    """The second leg's hits after the first leg's, without those already there: id, score, tier."""
    tail = second.join(first, "id", "left_anti").withColumn("tier", F.lit(1))
    return first.withColumn("tier", F.lit(0)).unionByName(tail).orderBy("tier", F.desc("score"), "id").limit(limit)


def phrase_hits(docs: DataFrame, text: Column, query: str) -> DataFrame:
    """id and number of the query's neighbouring folded word pairs (16 at most) that stand side by side."""
    words = [fold_literal(w) for w in re.split(r"[\W_]+", query) if w]
    pairs = list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))[:16]
    hay = F.concat(F.lit(" "), F.array_join(F.filter(F.split(fold_text(text), TOKEN_SPLIT), lambda t: t != ""), " "), F.lit(" "))
    n = sum((F.when(hay.contains(f" {p} "), 1).otherwise(0) for p in pairs), F.lit(0))
    return docs.select("id", n.alias("n_pairs")).filter("n_pairs > 0")


def record_relevance(records: DataFrame, query: str) -> DataFrame:
    """Adds ``relevance``: 2 for each folded query word that begins a word of the title, 1 for the body, 2 for the whole phrase in the title."""
    terms = list(dict.fromkeys(f for f in (fold_literal(w) for w in re.split(r"[\W_]+", query)) if len(f) >= 2))[:12]

    def hay(c: str) -> Column:
        return F.concat(F.lit(" "), F.array_join(F.filter(F.split(fold_text(F.col(c)), TOKEN_SPLIT), lambda t: t != ""), " "), F.lit(" "))

    h = records.withColumn("hay_t", hay("title")).withColumn("hay_p", hay("payload"))
    score = F.lit(0)
    for t in terms:
        score = score + F.when(F.contains("hay_t", F.lit(" " + t)), 2).otherwise(0) + F.when(F.contains("hay_p", F.lit(" " + t)), 1).otherwise(0)
    if len(terms) > 1:
        score = score + F.when(F.contains("hay_t", F.lit(" " + " ".join(terms))), 2).otherwise(0)
    return h.withColumn("relevance", score.cast("double")).drop("hay_t", "hay_p")


def substring_filter(docs: DataFrame, text: Column, terms: list[str]) -> DataFrame:
    """id and number of terms (3 characters and more, 12 at most) contained in the text, cases folded, or in the text without marks."""
    terms = [t.lower() for t in terms if len(t) >= 3][:12]
    low, plain = F.lower(text), fold_text(text)
    n = sum((F.when(low.contains(t) | plain.contains(fold_literal(t)), 1).otherwise(0) for t in terms), F.lit(0))
    return docs.select("id", n.alias("n_terms")).filter("n_terms > 0")


def clause_table(spark: SparkSession, query: str) -> DataFrame:
    return spark.createDataFrame(query_clauses(query), "prefix string, only string")
