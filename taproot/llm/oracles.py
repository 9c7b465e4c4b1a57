"""The same results in SQL, where SQL can express them."""

from __future__ import annotations

from taproot.llm.chat import _FIND
from taproot.llm.licence_texts import NOTICES, SPELLINGS, TEXTS
from taproot.llm.licences import _COPYRIGHT
from taproot.llm.quality import RULES

_WORD = r"'[^\x20\x09-\x0D]+'"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = f"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), {_WORD})"
_CUT = f"regexp_extract_all(coalesce(text, ''), {_WORD})"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _escaped(x: str) -> str:
    return f"regexp_replace(replace({x}, '\\', '\\\\'), {_quoted(_FIND)}, '\\1\\\\\\2', 'g')"


CHAT = f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
 m as (select *, role is distinct from lag(role) over (partition by conv_id order by turn, role, text) as head from t),
 n as (select *, length({_escaped('text')}) + case when not head then 6 when role = 'user' then 13 when role = 'assistant' then 9 else 19 + length({_escaped('role')}) end as chars from m)
select conv_id, count(*) as n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' order by turn, role, text)) as turns_sha256,
 cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
 sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
 cast(3 + sum(chars) as bigint) as formatted_chars, count(*) filter (where head) as n_messages
from n group by conv_id
"""

NEAR = f"""
with recursive d as (select doc_id, {_FOLDED} as w from documents),
 s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)),
 n as (select doc_id, count(*) as n from s group by doc_id),
 p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
 l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 75 * (a.n + b.n - c)),
 e as (select x, y from l union select y, x from l),
 r as (select doc_id, doc_id as root from d union select r.doc_id, e.y from r join e on e.x = r.root)
select d.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(r.root) as component_id from d join r on r.doc_id = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id
"""


def _quality() -> str:
    rules = list(RULES)
    sums = ", ".join(f"sum(cast({test} as int)) as {r}" for r, test in RULES.items())
    mean = ", ".join(f"sum({r}) / sum(n) as {r}" for r in rules)
    spread = ", ".join(f"sum(h.n * pow(h.{r} / h.n - m.{r}, 2)) / any_value(m.n) as {r}" for r in rules)
    weight = ", ".join(
        f"case when v.{r} - m.{r} * (1 - m.{r}) * m.hosts / m.n > 0 then least(1e6, greatest(1.0, (m.{r} * (1 - m.{r}) - v.{r}) / (v.{r} - m.{r} * (1 - m.{r}) * m.hosts / m.n))) else 1e6 end as {r}" for r in rules
    )
    worst = "greatest(" + ", ".join(f"(h.{r} + m.{r} * k.{r}) / (h.n + k.{r})" for r in rules) + ")"
    return f"""
with d as (select doc_id, source, coalesce(text, '') as t, {_CUT} as w from documents),
 g as (select doc_id, i, count(*) over (partition by doc_id, array_to_string(w[i:i + 4], ' ')) as c from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)),
 r as (select doc_id, count(distinct j) as n from (select doc_id, unnest(range(i, i + 5)) as j from g where c > 1) group by doc_id),
 x as (select doc_id, unnest(string_split(t, chr(10))) as line from d),
 y as (select doc_id, count(*) - count(distinct line) as n from x where regexp_matches(line, {_WORD}) group by doc_id),
 b as (select d.doc_id, source as host, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(y.n, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words
  from d left join r on r.doc_id = d.doc_id left join y on y.doc_id = d.doc_id),
 h as (select host, count(*) as n, {sums} from b where host is not null group by host),
 m as (select sum(n) as n, count(*) as hosts, {mean} from h),
 v as (select {spread} from h, m),
 k as (select {weight} from m, v),
 z as (select h.host, {worst} >= 0.5 as host_rejected from h, m, k)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, coalesce(host_rejected, false) as host_rejected,
 not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and not coalesce(host_rejected, false) as kept from b left join z on z.host = b.host
"""


REPEATS = f"""
with d as (select doc_id, row_number() over () as id, {_CUT} as w from documents),
 g as (select id, i, count(*) over (partition by array_to_string(w[i:i + 34], ' ')) as c from (select id, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35)),
 r as (select distinct id, unnest(range(i, i + 35)) as j from g where c > 1),
 k as (select d.id, unnest(range(1, len(w) + 1)) as j, unnest(w) as word from d),
 o as (select k.id, count(*) filter (where r.j is not null) as n_removed, coalesce(string_agg(k.word, ' ' order by k.j) filter (where r.j is null), '') as kept from k left join r on r.id = k.id and r.j = k.j group by k.id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join o on o.id = d.id
"""


def _canonical(x: str) -> str:
    out = f"translate(coalesce({x}, ''), '{_UP}', '{_LOW}')"
    out = f"regexp_replace({out}, {_quoted(_COPYRIGHT)}, ' ', 'g')"
    out = f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')"
    for usual, others in SPELLINGS.items():
        out = f"regexp_replace({out}, '\\b(?:{'|'.join(others)})\\b', '{usual}', 'g')"
    return out


def _licences() -> str:
    def known(texts):
        return "select distinct sha256(" + _canonical("t") + ") as digest, licence from (values " + ", ".join(f"({_quoted(t)}, {_quoted(n)})" for t, n in texts.items()) + ") as v(t, licence)"

    return f"""
with whole as ({known(TEXTS)}), notices as ({known(NOTICES)}),
 d as (select doc_id, row_number() over () as id, text, sha256({_canonical('text')}) as canonical_sha256 from documents),
 lines as (select id, unnest(string_split(coalesce(text, ''), chr(10))) as line from d),
 hits as (select id, licence from (select id, sha256({_canonical('line')}) as digest from lines where regexp_matches(line, '(?i)licen[cs]|public domain|\\bcc ')) l join notices on notices.digest = l.digest),
 n as (select id, count(*) as n, string_agg(distinct licence, ',' order by licence) as names from hits group by id)
select d.doc_id, canonical_sha256, whole.licence, coalesce(n.n, 0) as n_notices, coalesce(n.names, '') as notices from d left join whole on whole.digest = canonical_sha256 left join n on n.id = d.id
"""


LEAKS = f"""
with d as (select doc_id, row_number() over () as id, {_FOLDED} as w from documents), b as (select item_id, row_number() over () as id, {_FOLDED} as w from benchmark),
 q as (select distinct id, least(5, len(w)) as k, array_to_string(w[i:i + 4], ' ') as g from (select id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from b where len(w) > 0)),
 ks as (select distinct k from q),
 s as (select distinct id, k, array_to_string(w[i:i + k - 1], ' ') as g from (select id, k, w, unnest(range(1, len(w) - k + 2)) as i from d, ks where len(w) >= k)),
 n as (select id, count(*) as n from q group by id),
 c as (select s.id as d, q.id as b, count(*) as c from s join q on q.k = s.k and q.g = s.g group by 1, 2)
select d.doc_id, b.item_id, n.n as n_item, c.c as n_found, c.c / n.n as containment from c join n on n.id = c.b join d on d.id = c.d join b on b.id = c.b where 100 * c.c >= 75 * n.n
"""

_WEIGHT = "case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end::double"
MIX = f"""
with sized as (select doc_id, source, cast(len({_CUT}) as bigint) as size from documents),
 s as (select source, cast(sum(size) as bigint) as n, {_WEIGHT} as w from sized group by source),
 c as (select *, 3.0::double * n as most from s where n > 0),
 o as (select *, row_number() over (order by most / w, source nulls last) as k, coalesce(sum(most) over (order by most / w, source nulls last rows between unbounded preceding and 1 preceding), 0.0)::double as full_before,
  sum(w) over (order by most / w, source nulls last rows between current row and unbounded following) as ws, (sum(n) over ())::double as total from c),
 f as (select min(k) as k from o where (total - full_before) * w / ws <= most),
 l as (select total - full_before as rest, ws from o, f where o.k = f.k),
 g as (select s.source, s.n, coalesce(case when f.k is null or o.k < f.k then o.most else l.rest * s.w / l.ws end, 0.0) as target from s left join o on o.source is not distinct from s.source left join f on true left join l on true),
 d as (select row_number() over () as id, doc_id, size, source, md5(concat(coalesce(cast(doc_id as string), ''), ':17'))[1:15] as key from sized),
 q as (select d.*, g.n, g.target, sum(size) over (partition by d.source order by key, doc_id, size, id) as upto from d join g on g.source is not distinct from d.source where size > 0 and target > 0),
 t as (select q.*, r, (upto + r * n) / target as finish from q, (select unnest([0, 1, 2]) as r) x),
 a as (select id, size, row_number() over w as place, sum(size) over w as upto from t window w as (order by finish, key, doc_id, size, r, id)),
 cut as (select coalesce(max(place), 0) as place from a where upto - size / 2.0 <= (select sum(size) from sized)),
 took as (select id, sum(a.size) as taken from a, cut where a.place <= cut.place group by id)
select d.doc_id, d.size, g.n as source_size, g.target, cast(coalesce(took.taken, 0) as bigint) as taken from d join g on g.source is not distinct from d.source left join took on took.id = d.id
"""

ORACLES = {
    "op1_chat_formatting": CHAT,
    "op2_ngram_jaccard_join": NEAR,
    "op3_quality_rules": _quality(),
    "op6_mixing": MIX,
    "op7_substring_dedup": REPEATS,
    "op8_license_scans": _licences(),
    "op9_benchmark_decontamination": LEAKS,
}
