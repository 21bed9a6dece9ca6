"""The training-data operators against brute force, round trips and held-out labels."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakeside.llm import ann, bpe, chat, external, html_main, ngram_join, packing, quality_gam, quality_rules, queries, suffix_dedup, token_files
from lakeside.llm.word_cache import WordEncoder

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"
TEXTS = [None, "", " ", "one", LONG, LONG, LONG + " end", "x " * 400, LONG.upper() + "!", "été à Noël — 中文 " * 5, "a" * 300, LONG[:60], "hello <|endoftext|> there <|startoftext|>", " ".join(["mot"] * 40_000), "\n\n \t" + LONG + "\n" + LONG, "<|im_end|> \\<| ok", " ".join(f"w{i}" for i in range(3000))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}", len(t or ""), i) for i, t in enumerate(TEXTS)]
    rows += [(4, LONG, "en", "s0", len(LONG), 1), (None, LONG + " more words here", "de", None, 9, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, bucket int").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_bpe_equals_library_and_decodes(docs, none):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rank = {t: i for i, t in enumerate(bpe.load_ranks(path))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=rank, special_tokens={})
    out = bpe.decode_documents(bpe.encode_documents(docs, path, public_tokenizers.PATTERN), path).collect()
    want = sorted((repr(r.doc_id), tuple(enc.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in docs.collect())
    assert sorted((repr(r.doc_id), tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.decoded)) for r in out) == want
    assert bpe.encode_documents(none, path, public_tokenizers.PATTERN).count() == 0


def test_replay_on_random_strings():
    tokens = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    replay = bpe.MergeReplay(tokens)
    enc = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=replay.rank, special_tokens={})
    rng = random.Random(5)
    words = ["".join(rng.choices("aeinrst éßñ中", k=rng.randint(1, 40))) for _ in range(800)]
    for w, ids in zip(words, replay.encode([w.encode() for w in words]), strict=True):
        assert (ids if w.encode() not in replay.rank else [replay.rank[w.encode()]]) == enc.encode_ordinary(w)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_word_encoder_equals_library(name):
    path = public_tokenizers.path(name)
    lib = Tokenizer.from_file(path)
    enc = WordEncoder(path, kept=500)
    pool = [chr(c) for c in range(0x180)] + list("̧́가ΩΣσİ　 ..,'") * 3
    rng = random.Random(2)
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 50))) for _ in range(800)] + [t or "" for t in TEXTS] + ["a  b", "a\n \nb", " a ", "<|endoftext|>", "hello <|endoftext|> there", "a <|startoftext|>b", "<|ENDOFTEXT|> x", "x \x00 y. z"]
    got = [np.frombuffer(b, "<u2" if enc.width == 2 else "<u4").tolist() for b in enc.encode(texts)]
    assert got == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_bpe_replays_recurring_words_once(monkeypatch):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    replay = bpe.MergeReplay(bpe.load_ranks(path))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=replay.rank, special_tokens={})
    rng = random.Random(6)
    odd = [b"", b"\0", b"\0\0a", b"", bytes(range(256)), *(bytes(rng.choices(b"abc\0\xc3\xa9 t", k=rng.randint(0, 30))) for _ in range(500)), b""]
    assert replay.encode(odd) == [enc._encode_single_piece(w) if w else [] for w in odd] and replay.encode([]) == []
    monkeypatch.setattr(bpe, "KEPT_WORDS", 50)
    monkeypatch.setattr(bpe, "spread", lambda df: df)
    given = []

    class Counted(bpe.MergeReplay):
        def packed(self, words):
            given.extend(words)
            return super().packed(words)

        def encode(self, words):
            given.extend(words)
            return super().encode(words)

    monkeypatch.setitem(bpe._loaded, path, (Counted(bpe.load_ranks(path)), {}))
    monkeypatch.setattr(bpe, "keyed", lambda df, *columns: df)
    common = [f" qxz{a}vwk{b}" for a in "bcdfg" for b in "hjlmn"]
    texts = ["".join(common) + "".join(f" jq{a}zx{k}" for a in "bcdfghjklm") + "." for k in "abcdefghij"]
    batches = [pa.record_batch([[k], [t]], ["doc_id", "text"]) for k, t in enumerate(texts)]

    class Table:
        def mapInArrow(self, run, schema):
            return list(run(iter(batches)))

    out = bpe.encode_documents(Table(), path, public_tokenizers.PATTERN)
    assert [np.frombuffer(b.column(1)[0].as_py(), "<u4").tolist() for b in out] == [enc.encode_ordinary(t) for t in texts]
    assert max(Counter(given).values()) == 1


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_word_encoder_gives_the_library_each_run_once(name):
    path = public_tokenizers.path(name)
    lib, enc = Tokenizer.from_file(path), WordEncoder(path)
    rng = random.Random(5)
    stems = ["".join(rng.choices("abcdefgh", k=9)) for _ in range(60)]
    signs = ["".join(map(chr, (c, d))) for c in range(33, 127) for d in (35, c) if not chr(c).isalnum()]
    texts = [" ".join(rng.choice(stems) + rng.choice([".\n", ",", "\n", "-", rng.choice(signs)]) + rng.choice(stems).title() for _ in range(400)) for _ in range(5)]
    given = []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return lib.encode_batch_fast(texts, **options)

    enc.tokenizer = Counted()
    kind = "<u2" if enc.width == 2 else "<u4"
    assert [np.frombuffer(b, kind).tolist() for b in enc.encode(texts)] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert 2 * sum(map(len, given)) < sum(map(len, texts))  # 60 words, and their capitals
    every = "".join(map(chr, range(0x21, 0x250)))
    odd = [f"x {a}{b}{c} y" for a in "aé." for b in every for c in "zÖ,\n"] + [" ".join(every), "a\n\nb. c.\n\nd", "x it's.\nI'll y,'s z", "a.\u0301b c,\u00d7d e-\u00aaf"]
    assert [np.frombuffer(b, kind).tolist() for b in WordEncoder(path).encode(odd)] == [e.ids for e in lib.encode_batch(odd, add_special_tokens=False)]
    assert enc.encode([]) == [] and len(enc.encode(["<|endoftext|>"])) == 1


def brute_spans(rows, length):
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        if doc is not None:
            earlier = [(t or "").encode() for d, t in rows if d is not None and d < doc]
            for i in range(len(b) - length + 1):
                if any(b[i : i + length] in e for e in earlier):
                    gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((repr(doc), len(b), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_dedup_brute_force(docs, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = suffix_dedup.repeated_spans(docs, bucket_bytes=100).collect()
    assert sorted((repr(r.doc_id), r.n_bytes, sum(s["end"] - s["start"] for s in r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got) == brute_spans(rows, 50)
    assert suffix_dedup.repeated_spans(none).count() == 0
    assert "row" in suffix_dedup.repeated_spans(docs, carry=("lang", "bucket")).columns


@pytest.mark.parametrize("queue_bytes", [48 << 20, 3000])
def test_suffix_dedup_random(spark, queue_bytes):
    """The same with all in memory and with nearly all on disk, a shard being many times the queue's share of memory."""
    rng = random.Random(3)
    parts = ["".join(rng.choices("ab ", k=rng.randint(20, 90))) for _ in range(8)]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 6)))) for i in range(40)]
    got = suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), queue_bytes=queue_bytes).collect()
    assert sorted((repr(r.doc_id), r.n_bytes, sum(s["end"] - s["start"] for s in r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got) == brute_spans(rows, 50)


def test_queues_on_disk():
    rng = np.random.default_rng(6)
    kind = np.dtype([("k", "S4"), ("v", "<i8")])
    q = external.SortedQueue(kind, "k", limit=2000)
    rows = np.zeros(5000, kind)
    rows["k"] = rng.integers(97, 101, (5000, 4)).astype(np.uint8).view("S4").ravel()
    rows["v"] = np.arange(5000)
    for part in np.array_split(rows, 37):
        q.push(part)
    out = np.concatenate(list(q.blocks(100)))
    assert len(q.runs) > 10 and (out["k"][1:] >= out["k"][:-1]).all() and sorted(out["v"]) == list(range(5000))


@pytest.mark.parametrize("limit", [0, 4000, 1 << 20])
def test_induction_brute_force(limit):
    """Masks of random tuples, level by level, against comparison of their strings."""
    rng = np.random.default_rng(7)
    n, length, width = 700, 12, 5
    ctx = rng.choice(np.array([97, 98], np.uint8), (n, width + length), p=[0.8, 0.2])
    ctx[rng.random(n) < 0.5] = ctx[rng.integers(0, 9, n)][rng.random(n) < 0.5][0]
    high = rng.integers(0, width + 1, n)
    low = (high * rng.random(n)).astype(int)
    rows = np.zeros(n, external.tuple_type(width))
    rows["left"], rows["low"], rows["high"], rows["doc"], rows["id"] = ctx[:, :width], low, high, rng.integers(0, 60, n), np.arange(n)
    right = ctx[:, width:]
    rows = rows[np.lexsort(right.T[::-1])]
    right = right[rows["id"]]
    differs = right[1:] != right[:-1]
    rows["lcp"] = np.r_[0, np.where(differs.any(axis=1), differs.argmax(axis=1), length)]
    mask = np.zeros(n, np.uint64)
    external.induce(iter(np.array_split(rows, 9)), mask, length, width, limit)
    for x in range(width + 1):
        first = {}
        ok = [r for r in rows if r["low"] <= x <= r["high"]]
        for r in ok:
            s = ctx[r["id"], width - x : width - x + length].tobytes()
            first[s] = min(first.get(s, 99), r["doc"])
        want = {int(r["id"]) for r in ok if first[ctx[r["id"], width - x : width - x + length].tobytes()] < r["doc"]}
        assert want == set(np.flatnonzero((mask >> np.uint64(x)) & np.uint64(1)).tolist())


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi\n<|im_end|>"), (1, 1, "assistant", "a\\b<|<\\|\\\\"), (2, 1, None, None), (2, 0, "us\ner<|", "x"), (2, 0, "us\ner<|", "x"), (None, None, "assistant", "z"), (3, 0, "system", "s"), (3, 1, "user", "u"), (3, 2, "assistant", "v")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    for conv, r in got.items():
        mine = sorted(((t is not None, t or 0, role or "", x or "") for c, t, role, x in rows if c == conv))
        assert [(t["role"], t["text"]) for t in r.turns] == [(role, x) for _, _, role, x in mine]
        assert r.trained_text == "".join(x for _, _, role, x in mine if role == "assistant")
        assert r.formatted.count("<|im_start|>") == len(mine)
    assert got[1].valid and got[3].valid and not got[2].valid
    assert chat.format_conversations(df.limit(0)).count() == 0


PAGE = """<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><header><p>Site name</p></header><nav><a href=x>Home</a></nav>
<aside class="sidebar">See this too</aside><article><h1>Head &amp; more</h1><p>One <b>bold</b>\n  word<br>next<p>Two &eacute;<ul><li>item</ul><form>Name <input></form>
<div class="share-links">Share it</div><section id="comments"><p>Nice post</p></section></article><footer>&copy; x</footer></body></html>"""


def test_html_main(spark):
    assert html_main.main_text(PAGE) == "Head & more\nOne bold word next\nTwo é\nitem"
    long = "The cat is in the house and it was on the mat for a day with all of us. " * 4
    plain = f"<body><div>Menu</div><p>{long}</p><p>Short one.</p><p>{long}</p><div><a href=a>Link one</a> <a href=b>Link two</a></div></body>"
    assert html_main.main_text(plain) == "\n".join([long.strip(), "Short one.", long.strip()])
    df = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", PAGE), (3, "u", PAGE)], "page_id long, url string, html string")
    assert sorted(len(r.text) for r in html_main.extract(df).collect())[:2] == [0, 0]
    assert html_main.extract(df.limit(0)).count() == 0


class Article(HTMLParser):
    """Blocks of text inside article, by the library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks, self.text = False, [], []

    def flush(self):
        words = "".join(self.text).split()
        self.text = []
        if words and self.inside:
            self.blocks.append(" ".join(words))

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "ul", "li", "div", "article"):
            self.flush()
            self.inside = self.inside or tag == "article"
        elif tag == "br":
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "ul", "li", "div", "article"):
            self.flush()
            self.inside = self.inside and tag != "article"

    def handle_data(self, data):
        self.text.append(data)


def article_of(page):
    a = Article()
    a.feed(page)
    return "\n".join(a.blocks)


def test_html_equals_the_articles_of_the_pages(spark, sf):
    """All pages of the table have one article; without its mark, or any, densities and neighbours find it."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumn("text", F.lit("other")).withColumn("n_chars", F.lit(0))
    html_of = {r.page_id: r.html for r in pages.collect()}
    got = html_main.extract(pages).collect()
    assert len(got) == len(html_of) and all(r.text == article_of(html_of[r.page_id]) for r in got)
    bare = {i: re.sub(r' class="[^"]*"', "", re.sub(r"<(/?)(?:article|footer|nav|main|aside|header)\b", r"<\1div", h)) for i, h in html_of.items()}
    texts = {i: html_main.main_text(h) for i, h in bare.items()}
    assert all(set(article_of(h).split("\n")) <= set(texts[i].split("\n")) for i, h in html_of.items())
    assert sum(texts[i] == article_of(h) for i, h in html_of.items()) >= 0.9 * len(html_of)
    assert html_main.share_of_reasons(list(html_of.values()))["density"] > 0.5 * sum(map(len, texts.values()))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>Short page.</p>", "Short page."),
        ("<p>" + "这是一个测试页面内容" * 50 + "</p>", "这是一个测试页面内容" * 50),
        ("<article><p>The cat is in the house and it was on the mat.</p><section class='search-results-study'><p>Findings of the study.</p></section><section class='related-work'><p>Others too.</p></section></article>", "The cat is in the house and it was on the mat.\nFindings of the study.\nOthers too."),
        ("<div class='post-notice-board'><p>The board is in the house and it was on the mat for a day with all of us.</p></div>", "The board is in the house and it was on the mat for a day with all of us."),
        ("<p>A <button>x and on</p><p>The rest of it is here.</p>", "A x and on\nThe rest of it is here."),
        ("<p>A <button>x</button> and on</p><p>The rest of it is here.</p>", "A and on\nThe rest of it is here."),
        ("", ""),
        ("<p></p><!-- a", ""),
    ],
)
def test_html_small_pages(page, text):
    assert html_main.main_text(page) == text


@pytest.mark.parametrize("piece", ["<a x='", '<a "<a >" ', "<b>", "<button>", "<i><div></i>", "<svg>", "<", "&amp;", "<p>a "])
def test_html_is_linear(piece):
    page = piece * (1_000_000 // len(piece))
    began = time.time()
    html_main.main_text(page)
    assert time.time() - began < 10


def test_html_marked_part_is_evidence():
    long = "The cat is in the house and it was on the mat for a day with all of us. " * 4
    teaser = "Read of the day in our town and what it was for us all to be there then."
    card = f"<body><div>Menu</div><article class=card><p>{teaser}</p></article><div>{long}</div><div>Said so.</div><div>{long}</div><footer>x</footer></body>"
    assert html_main.main_text(card) == "\n".join([teaser, long.strip(), "Said so.", long.strip()])
    outside = f"<body><div>Menu</div><article><p>{long}</p><p>{long}</p></article><div>{long}</div><div>Tags</div><footer>x</footer></body>"
    assert html_main.main_text(outside) == "\n".join([long.strip()] * 3)


def test_html_few_stop_words_are_undecided():
    finnish = "Kissa istui talossa koko aamun ja katseli ikkunasta sadetta kunnes aurinko paistoi taas pihalle. " * 3
    assert html_main.main_text(f"<body><div>Valikko</div><div>{finnish}</div><div>{finnish}</div><footer>x</footer></body>") == "\n".join([finnish.strip()] * 2)
    long = "The cat is in the house and it was on the mat for a day with all of us. " * 4
    table = "Oslo 12, Bergen 14, Trondheim 9, Stavanger 13, Drammen 11, Fredrikstad 12, Kristiansand 14, Sandnes 13"
    assert html_main.main_text(f"<body><div>{long}</div><pre>{table}</pre><div>{long}</div></body>") == "\n".join([long.strip(), table, long.strip()])


def test_ann_recall_and_odd_rows(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    odd = spark.createDataFrame([(-20, None), (-40, [0.0] * 64), (-60, [float("nan")] * 64), (-80, [1.0]), (-100, [None] * 64)], "vec_id long, embedding array<float>")
    got = ann.nearest_neighbours(df.unionByName(odd))
    rows = df.collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(float)
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:20]
        mine = sorted(found[ids[i]])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert all(abs(m[2] - s[np.flatnonzero(ids == m[1])[0]]) < 1e-9 for m in mine)
        hit, total = hit + len({m[1] for m in mine} & set(ids[order])), total + 20
    assert hit / total >= 0.9
    assert ann.nearest_neighbours(df.limit(0)).count() == 0


def test_ann_ties_copies_and_precision(spark):
    """Everything visited and rescored, so the result is exact: copies, ties, repeated ids, doubles."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(12, 6))
    rows = [(i, base[i % 12].tolist()) for i in range(240)] + [(i, (base[0] * (1 + i * 1e-12)).tolist()) for i in range(300, 320)]
    rows += [(40, base[4].tolist()), (40, base[5].tolist()), (60, base[0].tolist())]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<double>, vector string, h1 int")
    got = {}
    for r in ann.nearest_neighbours(df, coverage=1.0, rerank=1000, shard_rows=7, shard_queries=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    once = {(i, tuple(v)) for i, v in rows}
    for query in {i for i, _ in rows if i % 20 == 0}:
        want = []
        for v in (v for i, v in once if i == query):
            score = sorted((-float((np.array(w) * np.array(v)).sum()), i) for i, w in once if i != query)
            want += [(k + 1, i, -s) for k, (s, i) in enumerate(score[:20])]
        assert sorted(got[query]) == sorted(want)


def test_ann_visits_few_lists_of_clusters(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 4000)] + 0.2 * rng.normal(size=(4000, 16))).astype(np.float32)
    index = ann.Index.fit(x, 120, coverage=0.95)
    assert index.n_probe < 30
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    hit = 0
    found = {}
    for r in ann.nearest_neighbours(df).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for i in range(0, 4000, 20):
        s = x.astype(float) @ x[i].astype(float)
        hit += len(found[i] & set([j for j in np.argsort(-s, kind="stable") if j != i][:20]))
    assert hit >= 0.9 * 20 * 200


def test_ann_finds_near_copies_and_rare_rows(spark):
    """Rows unlike most: many near copies of one vector, a few in directions of their own."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1, 64)) / 8
    x = np.concatenate([rng.normal(size=(4000, 64)) / 8, v + 1e-3 * rng.normal(size=(2000, 64)), np.c_[np.zeros((100, 56)), rng.normal(size=(100, 8))]])
    x[:4000, 56:] = 0
    x = (x / np.linalg.norm(x, axis=1, keepdims=True))[rng.permutation(6100)].astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = {}
    for r in ann.nearest_neighbours(df).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    shares = []
    for i in range(0, 6100, 20):
        s = x.astype(float) @ x[i].astype(float)
        shares.append(len(found[i] & set([j for j in np.argsort(-s, kind="stable") if j != i][:20])) / 20)
    assert np.mean(shares) >= 0.98 and np.quantile(shares, 0.02) >= 0.8


def test_quality_counts_and_verdicts(docs, none, spark, sf):
    got = {(r.doc_id, r.n_words): r for r in quality_rules.judge(docs).collect()}
    for r in docs.collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        times = Counter(grams)
        rep = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        g = got[(r.doc_id, len(w))]
        assert (g.word_chars, g.n_symbols, g.n_dup_lines) == (sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)))
        assert g.n_repeat_words == len(rep) and g.base_failed == (len(w) < 10 or 100 * len(rep) > 20 * len(w))
        assert not (g.base_failed and g.kept)
    assert quality_rules.judge(none).count() == 0
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    j = quality_rules.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id").filter("not base_failed")
    assert j.filter("quality = 1 and not kept").count() <= 0.03 * j.filter("quality = 1").count()


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    comp = [d for d, _ in rows]
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                a, b = sets[i], sets[j]
                if a and b and comp[i] != comp[j] and 100 * len(a & b) >= 75 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    return sorted((d, len(s), c) for (d, _), s, c in zip(rows, sets, comp, strict=True))


@pytest.mark.parametrize("limit", [1000, 4])
def test_ngram_join_brute_force(spark, limit):
    rng = random.Random(11)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(3, 60))] for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "ab"), (3, "AB"), (4, "ab")]
    for i in range(5, 90):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"n{rng.randint(0, 9)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.similar_documents(df, region_limit=limit)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows)


def test_voronoi_regions_brute_force():
    """Regions of clusters split and copy border points; links connect what all pairs connect."""
    rng = np.random.default_rng(12)
    centres = [rng.choice(1 << 40, 200, replace=False) for _ in range(8)]
    sets = []
    for i in range(240):
        c = np.r_[centres[i % 8][:160], centres[(i + 1) % 8][:40]] if i % 3 else centres[i % 8]
        sets.append(np.unique(np.r_[rng.choice(c, int(len(c) * rng.uniform(0.85, 1)), replace=False), rng.choice(1 << 40, rng.integers(0, 10))]).astype(np.uint64))
    counts = Counter()
    links = ngram_join.join_region(sets, ngram_join.Metric(75, 100), counts=counts)

    def classes(pairs):
        up = list(range(len(sets)))
        for i, j in pairs:
            old, new = up[i], up[j]
            up = [min(old, new) if u in (old, new) else u for u in up]
        return up

    every = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))]
    assert set(links) | {(j, i) for i, j in links} <= set(every) | {(j, i) for i, j in every}
    assert classes(links) == classes(every) and len(set(classes(every))) < 200
    assert counts["regions split"] >= 1 and counts["pivots"] < 240


@pytest.mark.parametrize("n", [20_000])
def test_near_misses_of_one_text_cost_linear_time(n):
    """Each pair has a similarity of 0.69: all of them leave before any distance is taken."""
    rng = np.random.default_rng(13)
    shared = rng.choice(1 << 50, 163, replace=False)
    sets = [np.sort(np.r_[shared, rng.integers(1 << 50, 1 << 60, 37)]).astype(np.uint64) for _ in range(n)]
    counts = Counter()
    began = time.time()
    assert ngram_join.join_region(sets, ngram_join.Metric(75, 100), counts=counts) == []
    assert counts["points joined"] == 0 and time.time() - began < 30


def test_ngram_join_odd_rows(docs, none):
    got = ngram_join.similar_documents(docs).collect()
    assert len(got) == docs.count() and all(r.component_id is None for r in got if r.doc_id is None)
    assert ngram_join.similar_documents(none).count() == 0


def test_token_files(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    manifest, read = token_files.token_output(docs, path, 2, file_bytes=4000)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in docs.collect()))
    got = sorted(read.collect(), key=lambda r: r.start)
    start = 0
    for g, (has, d, _, t) in zip(got, rows, strict=True):
        ids = lib.encode(t, add_special_tokens=False).ids + [2]
        assert (g.doc_id, g.start, np.frombuffer(g.ids, "<u4").tolist()) == (d if has else None, start, ids)
        start += len(ids)
    assert manifest.count() > 1
    data = bytearray(token_files.MAGIC + bytes([2, 0]) + token_files.frame(b"\0" * 8 + b"\1\0"))
    assert next(token_files.read_records(bytes(data)))[1].tolist() == [1]
    data[-6] ^= 1
    with pytest.raises(ValueError):
        list(token_files.read_records(bytes(data)))
    assert token_files.token_output(none, path, 2)[1].count() == 0


def test_gam_tables_equal_a_plain_loop():
    """Scores are the sum of the tables' entries, looked up one by one; a step fits the two best cuts of brute force."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(400, 4)), 1)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] > 0.2) ^ (rng.random(400) < 0.05)).astype(float)
    m = quality_gam.Gam(bins=8, rounds=30, pairs=3, pair_bins=4).fit(x, y)
    for row, score in zip(x, m.score(x), strict=True):
        b = [sum(v >= e for e in edges) for v, edges in zip(row, m.edges, strict=True)]
        f = m.base + sum(t[k] for t, k in zip(m.tables, b, strict=True)) + sum(t[m.fold[i][b[i]], m.fold[j][b[j]]] for i, j, t in m.pairs)
        assert abs(score - 1 / (1 + np.exp(-f))) < 1e-9
    assert np.mean((m.score(x) >= 0.5) == (y == 1)) > 0.8 and len(m.pairs) == 3
    g, h = rng.normal(size=6), rng.random(6) + 0.5

    def gain(parts):
        return sum(g[i:j].sum() ** 2 / (h[i:j].sum() + m.ridge) for i, j in parts)

    first = max(range(1, 6), key=lambda c: gain([(0, c), (c, 6)]))
    cuts = [[(0, c), (c, first), (first, 6)] for c in range(1, first)] + [[(0, first), (first, c), (c, 6)] for c in range(first + 1, 6)]
    best = max(cuts, key=gain)
    want = np.concatenate([[g[i:j].sum() / (h[i:j].sum() + m.ridge)] * (j - i) for i, j in best])
    assert np.allclose(m._tree(g, h), want)


def test_classifier_odd_rows(spark, docs):
    labels = spark.createDataFrame([(1, None, 0), (1, 1, 0), (4, 0, 0), (4, 1, None), (None, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality_gam.classify(docs.withColumn("score", F.lit("x")).withColumn("features", F.lit(1)), labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    same = {r.score for r in got if r.doc_id == 4}
    assert len(same) == 1  # repeated rows have one score


def test_classifier_held_out(spark, docs, none, sf):
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_gam.classify(d, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.9 * len(got)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in got)
    assert {r.score for r in quality_gam.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_gam.classify(none, labels).count() == 0


def test_packing(spark, docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    tied = spark.createDataFrame([(None, LONG), (None, LONG), (7, LONG)], "doc_id long, text string")
    for df in (docs, docs.select("doc_id", "text").unionByName(tied)):
        want = sorted(((repr(r.doc_id), tuple([*lib.encode(r.text or "", add_special_tokens=False).ids, 1])) for r in df.collect()))
        rows = packing.pack_documents(df, path, 1, size=64, n_open=2, least_cut=4).collect()
        by_seq = {}
        for r in rows:
            by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for p in by_seq.values():
            p.sort()
            assert [o for o, _ in p] == [sum(n for _, n in p[:i]) for i in range(len(p))] and sum(n for _, n in p) <= 64
        assert sum(sum(n for _, n in p) < 60 for p in by_seq.values()) <= 1
        # each document's pieces, and rows that share a doc_id together, hold exactly its ids
        pieces = {}
        for r in rows:
            pieces.setdefault((repr(r.doc_id), r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
        need = {}
        for d, ids in want:
            need.setdefault((d, len(ids)), []).append(ids)
        assert pieces.keys() == need.keys()
        for key, texts in need.items():
            have = sorted(pieces[key])
            assert sum(n for _, n, _ in have) == sum(map(len, texts))
            for start, n, crc in have:
                assert crc in {zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()) for ids in texts}
            if len(texts) == 1:
                assert [s for s, _, _ in have] == [sum(n for _, n, _ in have[:i]) for i in range(len(have))]
    assert packing.pack_documents(none, path, 1).count() == 0


def test_queries_and_pipeline(spark, sf):
    import corpus_pipeline

    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "ngram_join", "suffix_dedup", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert 0 < out.count() <= docs.count()
    assert set(queries.QUERIES) >= {"op2_suffix_dedup", "op7_ngram_join"}
    assert queries.op3_chat(spark, sf).filter(F.col("conv_id") == -1).first().n_turns == 2
