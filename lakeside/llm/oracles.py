"""SQL for DuckDB of the training-data queries that SQL can express.

They assume what the tables hold: doc_ids and conv_ids are not null, doc_ids are unique.
"""

from __future__ import annotations

from .chat import CHATML
from .quality_rules import BASE, RATES

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def suffix_dedup_sql(length: int = 50, block: int = 1000) -> str:
    """Every ``length``-byte string with the smallest doc_id that holds it; bytes as pairs of hex digits, cut in blocks."""
    two = 2 * length
    return f"""with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
b as (select doc_id, unnest(range(0, length(h) // 2, {block})) as at_byte, h from d),
c as (select doc_id, at_byte, substring(h, 2 * at_byte + 1, {2 * block + two - 2}) as part from b),
p as (select doc_id, at_byte, part, unnest(range(0, least({block}, length(part) // 2))) as i from c),
g as (select doc_id, at_byte + i as pos, substring(part, 2 * i + 1, 2) as byte, substring(part, 2 * i + 1, {two}) as gram from p),
f as (select doc_id, pos, byte, length(gram) = {two} and min(doc_id) over (partition by gram) < doc_id as hit from g),
r as (select *, max(hit::int) over (partition by doc_id order by pos rows between {length - 1} preceding and current row) as gone from f),
s as (select *, gone = 1 and coalesce(lag(gone) over (partition by doc_id order by pos), 0) = 0 as begins from r),
o as (select doc_id, count(*) as n_bytes, sum(gone) as n_removed, count(*) filter (begins) as n_spans, string_agg(byte, '' order by pos) filter (gone = 0) as kept from s group by doc_id)
select d.doc_id, coalesce(n_bytes, 0)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256
from d left join o on o.doc_id = d.doc_id"""


def chat_sql() -> str:
    """Lengths of the marks and of the escapes are added up; the order of roles is checked pair by pair."""
    t = CHATML
    said = "<|im_end|><|im_start|>assistant ok"
    steps = ", ".join(f"'{s}>{r}'" for s, roles in t.follows.items() for r in roles)
    trained = ", ".join(f"'{r}'" for r in t.trained)
    final = ", ".join(f"'{r}'" for r in t.final)

    def longer(c: str, mark: str) -> str:
        return f"(length({c}) - length(replace({c}, {mark}, ''))) // length({mark})"

    escaped = {c: f"length({c}) + {longer(c, 'chr(92)')} + {longer(c, chr(39) + '<|' + chr(39))}" for c in ("role", "text")}
    marks = len(t.begin) + len(t.after_role) + len(t.end)
    return f"""with a as (select conv_id, turn, role, text from conversations union all select * from (values (-1, 0, 'user', '{said}'), (-1, 1, 'assistant', '{said}'))),
n as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from a),
t as (select *, row_number() over w as k, coalesce(lag(role) over w, 'start') || '>' || role as step from n window w as (partition by conv_id order by turn nulls first, role, text)),
c as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by k) as said, coalesce(string_agg(text, '' order by k) filter (role in ({trained})), '') as trained, sum({marks} + {escaped['role']} + 2 * ({longer('role', 'chr(10)')}) + {escaped['text']}) as formatted_chars, bool_and(step in ({steps})) and arg_max(role, k) in ({final}) as valid from t group by conv_id)
select conv_id, n_turns, sha256(said) as turns_sha256, length(trained)::bigint as loss_chars, sha256(trained) as loss_sha256, formatted_chars::bigint as formatted_chars, valid from c"""


def quality_rules_sql(window: int = 5, reach: int = 4, prior: int = 50) -> str:
    """The counts by regular expressions; sketches are counts by bucket, so their quantiles are exact integers here too."""
    def count(c: str) -> str:
        return f"length(text) - length(regexp_replace(text, '{c}', '', 'g'))"

    gram = " || ' ' || ".join(["word", *(f"lead(word, {k}) over w" for k in range(1, window))])
    rates = ", ".join(f"{sql.replace(' div ', ' // ')} as {name}" for name, (sql, _) in RATES.items())
    stacked = " union all ".join(f"select lang, source, '{r}' as rate, {r} as value from rated" for r in RATES)
    floors = " ".join(f"when '{r}' then {least}" for r, (_, least) in RATES.items())

    def quantiles(name: str, keys: str) -> str:
        by = f"{keys}, rate" if keys else "rate"
        value = "((bucket % 128 + 1) << (bucket // 128)::int) - 1"
        return f"""{name}_n as (select {by}, bucket, sum(n) as n from sketch group by {by}, bucket),
{name}_r as (select *, sum(n) over (partition by {by} order by bucket) as upto, sum(n) over (partition by {by}) as total from {name}_n),
{name} as (select {by}, max(total) as total, min({value}) filter (100 * upto >= 50 * total) as q50, min({value}) filter (100 * upto >= 75 * total) as q75 from {name}_r group by {by})"""

    def pick(q: str) -> str:
        by_lang = f"((b.total * b.{q} + {prior} * c.{q}) // (b.total + {prior}))"
        return f"((a.total * a.{q} + {prior} * {by_lang}) // (a.total + {prior}))"

    return f"""with d as (select doc_id, lang, source, coalesce(text, '') as text from documents),
w as (select doc_id, regexp_extract_all(text, '{WORD}') as words from d),
u as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as k from w),
g as (select doc_id, k, {gram} as gram from u window w as (partition by doc_id order by k)),
h as (select doc_id, k, gram is not null and count(*) over (partition by doc_id, gram) > 1 as again from g),
v as (select doc_id, max(again::int) over (partition by doc_id order by k rows between {window - 1} preceding and current row) as covered from h),
rep as (select doc_id, sum(covered) as n_repeat_words from v group by doc_id),
l as (select doc_id, unnest(string_split(text, chr(10))) as line from d),
dup as (select doc_id, count(*) - count(distinct line) as n_dup_lines from l where regexp_matches(line, '{WORD}') group by doc_id),
counted as (select d.doc_id, lang, source, len(words)::bigint as n_words, length(regexp_replace(text, '{SPACE}', '', 'g')) as word_chars, {count('[#*$%&|<>]')} as n_symbols, {count('[A-Z]')} as n_upper, {count('[A-Za-z]')} as n_letters, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words from d join w on w.doc_id = d.doc_id left join rep on rep.doc_id = d.doc_id left join dup on dup.doc_id = d.doc_id),
rated as (select *, {rates}, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from counted),
long as ({stacked}),
cut as (select *, greatest(length(bin(value)) - 7, 0) as shift from long),
sketch as (select lang, source, rate, shift * 128 + (value >> shift::int) as bucket, count(*) as n from cut group by all),
{quantiles('fine', 'lang, source')},
{quantiles('by_lang', 'lang')},
{quantiles('overall', '')},
chosen as (select a.lang, a.source, a.rate, greatest({pick('q75')} + {reach} * ({pick('q75')} - {pick('q50')}), case a.rate {floors} end) as t from fine a join by_lang b on a.lang is not distinct from b.lang and a.rate = b.rate join overall c on a.rate = c.rate),
over as (select distinct r.doc_id from rated r join chosen t on r.lang is not distinct from t.lang and r.source is not distinct from t.source and (case t.rate {' '.join(f"when '{r}' then r.{r}" for r in RATES)} end) > t.t)
select r.doc_id, {', '.join('r.' + c for c in BASE)}, base_failed, not base_failed and o.doc_id is null as kept from rated r left join over o on o.doc_id = r.doc_id"""


def ngram_join_sql(width: int = 5, percent: int = 75) -> str:
    """All pairs that share a shingle, then the closure of their links; for small tables."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    gram = " || ' ' || ".join(["word", *(f"lead(word, {k}) over w" for k in range(1, width))])
    return f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{WORD}') as words from documents),
u as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as k from w where len(words) >= {width}),
g as (select doc_id, {gram} as gram from u window w as (partition by doc_id order by k) union all select doc_id, array_to_string(words, ' ') from w where len(words) between 1 and {width - 1}),
s as (select distinct doc_id, gram from g where gram is not null),
n as (select doc_id, count(*) as n_shingles from s group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as both_have from s a join s b on a.gram = b.gram and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from pairs join n p on p.doc_id = x join n q on q.doc_id = y where 100 * both_have >= {percent} * (p.n_shingles + q.n_shingles - both_have)),
ways as (select x, y from links union all select y, x from links),
reach as (select doc_id, doc_id as at_doc from n union select doc_id, y from reach join ways on x = at_doc)
select w.doc_id, coalesce(n_shingles, 0)::bigint as n_shingles, coalesce(r.component_id, w.doc_id) as component_id
from w left join n on n.doc_id = w.doc_id left join (select doc_id, min(at_doc) as component_id from reach group by doc_id) r on r.doc_id = w.doc_id"""


ORACLES = {"op2_suffix_dedup": suffix_dedup_sql(), "op3_chat": chat_sql(), "op6_quality_rules": quality_rules_sql(), "op7_ngram_join": ngram_join_sql()}
