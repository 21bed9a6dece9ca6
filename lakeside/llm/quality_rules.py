"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Base rules are fixed.  The others compare a document's rates with thresholds that follow
its own language and source: a sketch counts, for each (lang, source) and rate, values by
bucket (exact below 64, then 64 buckets for each power of two, so within 1/64).  Sketches
merge by adding counts: in tasks before the shuffle, and from (lang, source) to lang to
all documents.  A group's quantile is averaged with its language's, and that with all
documents', as if ``prior`` further documents had those: small groups lean on the larger
one, large groups on themselves, by one formula for every size.  A threshold lies ``reach``
quartile distances above the upper quartile and never below a floor, so a rate that is
usual in a group, or that no clean text exceeds, rejects nothing.

Results: null, blank and very short texts fail the base rules; null lang or source is a
group of its own; repeated rows get equal verdicts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, trim, written
from .hashing import Buffer
from .text_counts import counts

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COLUMNS = (*BASE, "n_upper", "n_letters")
#: Rates, each times 10,000 and rounded down, and the least threshold of each.
RATES = {
    "symbol_rate": ("10000 * n_symbols div greatest(word_chars, 1)", 500),
    "upper_rate": ("10000 * n_upper div greatest(n_letters, 1)", 4000),
    "dup_line_rate": ("10000 * n_dup_lines div greatest(n_words, 1)", 1000),
    "repeat_rate": ("10000 * n_repeat_words div greatest(n_words, 1)", 1500),
    "word_length": ("100 * word_chars div greatest(n_words, 1)", 1500),
}


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source and the counts of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf = Buffer.of(batch.column(3))
            for lo, hi in buf.blocks(1 << 20):
                c = counts(buf.part(lo, hi))
                yield pa.record_batch([*(batch.column(i).slice(lo, hi - lo) for i in range(3)), *(pa.array(c[k], pa.int64()) for k in COLUMNS)], ["doc_id", "lang", "source", *COLUMNS])
        trim()

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    return spread(base).mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COLUMNS))


def sketch(rates: DataFrame, keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(keys, rate, bucket, n): the quantile sketch of every group and rate."""
    long = rates.select(*keys, F.expr("stack({}, {}) as (rate, value)".format(len(RATES), ", ".join(f"'{r}', {r}" for r in RATES))))
    shift = "greatest(length(bin(value)) - 7, 0)"
    return long.withColumn("bucket", F.expr(f"({shift}) * 128 + shiftright(value, {shift})")).groupBy(*keys, "rate", "bucket").agg(F.count(F.lit(1)).alias("n"))


def quartiles(merged: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, rate, total, q50, q75): a quantile is the upper end of its bucket."""
    by = ", ".join([*keys, "rate"])
    ranked = merged.selectExpr("*", f"sum(n) over (partition by {by} order by bucket) as upto", f"sum(n) over (partition by {by}) as total")
    value = "shiftleft((bucket % 128) + 1L, cast(bucket div 128 as int)) - 1"
    return ranked.groupBy(*keys, "rate").agg(F.max("total").alias("total"), *(F.expr(f"min({value}) filter (where 100 * upto >= {q} * total)").alias(f"q{q}") for q in (50, 75)))


def thresholds(sk: DataFrame, reach: int = 4, prior: int = 50) -> DataFrame:
    """lang, source, and of each rate the threshold t_<rate>; coarser sketches are sums of finer ones."""
    fine = quartiles(sk, ("lang", "source"))
    by_lang = quartiles(sk.groupBy("lang", "rate", "bucket").agg(F.sum("n").alias("n")), ("lang",))
    overall = quartiles(sk.groupBy("rate", "bucket").agg(F.sum("n").alias("n")), ())
    floor = F.create_map(*[F.lit(x) for r, (_, least) in RATES.items() for x in (r, least)])
    a, b, c = fine.alias("a"), by_lang.alias("b"), overall.alias("c")
    both = a.join(b, F.expr("a.lang <=> b.lang and a.rate = b.rate")).join(c, F.expr("a.rate = c.rate"))

    def pick(q: str) -> str:
        by_lang = f"((b.total * b.{q} + {prior} * c.{q}) div (b.total + {prior}))"
        return f"((a.total * a.{q} + {prior} * {by_lang}) div (a.total + {prior}))"

    chosen = both.selectExpr("a.lang", "a.source", "a.rate", f"({pick('q75')}) + {reach} * (({pick('q75')}) - ({pick('q50')})) as t")
    return chosen.withColumn("t", F.greatest("t", floor[F.col("rate")])).groupBy("lang", "source").pivot("rate", list(RATES)).agg(F.max("t")).withColumnsRenamed({r: f"t_{r}" for r in RATES})


def judge(docs: DataFrame, reach: int = 4, prior: int = 50, **columns) -> DataFrame:
    """doc_id, lang, source, the base counts, rates, base_failed and kept of every row."""
    counted = written(count_words(docs, **columns))
    rated = counted.selectExpr("*", *(f"{sql} as {name}" for name, (sql, _) in RATES.items()), "n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed")
    t = thresholds(sketch(rated), reach, prior).withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    joined = rated.join(t, F.expr("lang <=> t_lang and source <=> t_source"), "left")
    fine = " and ".join(f"{r} <= t_{r}" for r in RATES)
    return joined.withColumn("kept", F.expr(f"not base_failed and ({fine})")).drop("t_lang", "t_source")
