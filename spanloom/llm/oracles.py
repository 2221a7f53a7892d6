"""SQL, for DuckDB, of the queries that SQL can express. The others are held against brute force in the tests."""

from __future__ import annotations

import re

from .chat import TRAINED, TURN
from .license_scan import CONTAINED, PHRASES, TEMPLATES, block_step
from .mixing import STEPS, step_sql
from .quality import COMMON, MAX_CLASS, MAX_COMMON, MIN_CLASS_WORDS, MIN_COMMON_WORDS

_DUCK = {"range": "unnest(range({0}, {1} + 1))", "hash": "('0x' || substr(md5({0}), {1}, 8))::bigint", "div": "({0} // {1})", "pick": "list_extract([{0}], {1})", "same": "{0} is not distinct from {1}"}
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _mix() -> str:
    hashed = lambda at: f"('0x' || substr(md5('mix|' || coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, ''))), {at}, 8))::bigint"
    steps = [("sized", f"select doc_id as id, source, len({_WORDS})::bigint as size, {hashed(1)} as h1, {hashed(9)} as h2, 0 as rid from documents")]
    for name, sql in STEPS:
        sql = re.sub(r"(\d)D\b", r"\1::double", step_sql(sql, _DUCK, "mix"))
        steps.append((name, re.sub(r"\{(\w+)\}", r"\1", sql)))
    return "with " + ",\n".join(f"{n} as ({s})" for n, s in steps) + "\nselect id as doc_id, size, source_size, target, taken from mixed"


_EXACT = """select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id is not distinct from max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))"""


def _jsd(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists of counts."""
    a, b = f"({p}[k] / list_sum({p}))", f"({q}[k] / list_sum({q}))"
    part = lambda x: f"case when {x} > 0 then {x} * log2({x} / (({a} + {b}) / 2)) else 0 end"
    return f"case when list_sum({p}) > 0 and list_sum({q}) > 0 then sqrt(greatest(0, list_sum(list_transform(range(1, len({p}) + 1), lambda k: ({part(a)} + {part(b)}) / 2)))) else 0 end"


_QUALITY = rf"""
with doc as (select row_number() over () as rid, doc_id, lang, coalesce(text, '') as text, {_WORDS} as words from documents),
word as (select rid, lang, unnest(words) as w, generate_subscripts(words, 1) as i from doc),
top as (select * from (select lang, lower(w) as w, count(*) as n, row_number() over (partition by lang order by count(*) desc, lower(w)) as k from word group by 1, 2) where k <= {COMMON}),
ref as (select t.lang, list(t.w order by t.k) as ws, list_append(list(t.n::double order by t.k), (any_value(a.n) - sum(t.n))::double) as ref_common from top t join (select lang, count(*) as n from word group by 1) a on a.lang is not distinct from t.lang group by 1),
hit as (select rid, k, count(*) as n from word join top on top.lang is not distinct from word.lang and top.w = lower(word.w) group by 1, 2),
gram as (select rid, i, w || ' ' || lead(w) over o || ' ' || lead(w, 2) over o as g from word window o as (partition by rid order by i)),
again as (select rid, i, count(*) over (partition by rid, g) as n from gram where g is not null),
cover as (select rid, count(distinct j) as n_repeat_words from (select rid, unnest([i, i + 1, i + 2]) as j from again where n > 1) group by 1),
line as (select rid, count(*) - count(distinct l) as n_dup_lines from (select rid, unnest(string_split(text, chr(10))) as l from doc) where regexp_matches(l, '[^\x20\x09-\x0D]') group by 1),
base as (
  select d.rid, doc_id, lang, len(words)::bigint as n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::bigint as word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) as upper, length(text) - length(regexp_replace(text, '\p{{N}}', '', 'g')) as digit, length(text) - length(regexp_replace(text, '[!-/:-@\[-`{{-~]', '', 'g')) as mark
  from doc d left join line using (rid) left join cover using (rid)),
classed as (select *, [n_symbols::double, mark - n_symbols, digit, upper, greatest(0, word_chars - mark - digit - upper)] as classes from base),
counted as (select rid, k, sum(n)::double as n from (select rid, k, n from hit union all select rid, unnest(range(1, {COMMON} + 1)), 0 from doc) group by 1, 2),
common as (select c.rid, list_append(list(c.n order by c.k)[1:len(any_value(r.ws))], any_value(b.n_words) - sum(c.n)) as common from counted c join base b using (rid) left join ref r on r.lang is not distinct from b.lang group by 1),
sums as (select lang, [sum(classes[1]), sum(classes[2]), sum(classes[3]), sum(classes[4]), sum(classes[5])] as ref_classes from classed group by 1),
far as (
  select c.*, case when n_words >= {MIN_CLASS_WORDS} then {_jsd('classes', 'ref_classes')} else 0 end as class_distance, case when n_words >= {MIN_COMMON_WORDS} then {_jsd('common', 'ref_common')} else 0 end as common_distance,
    n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed
  from classed c join common using (rid) left join sums s on s.lang is not distinct from c.lang left join ref r on r.lang is not distinct from c.lang)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and class_distance <= {MAX_CLASS} and common_distance <= {MAX_COMMON} as kept, round(class_distance, 6) as class_distance, round(common_distance, 6) as common_distance from far
"""

_TURN = "'" + TURN.replace("\n", "' || chr(10) || '").replace("{0}", "' || coalesce(role, '') || '").replace("{1}", "' || coalesce(text, '') || '") + "'"
_CHAT = f"""
with step as (select conv_id // 2 as pair_id, conv_id % 2 as side, conv_id, role, text, {_TURN} as shown, row_number() over (partition by conv_id order by turn, role, text) as k from conversations),
pair as (select pair_id, max(conv_id) filter (where side = 0) as chosen_id, max(conv_id) filter (where side = 1) as rejected_id, count(*) filter (where side = 0) as n0, count(*) filter (where side = 1) as n1 from step group by 1),
differ as (select pair_id, min(k) as k from step a join step b using (pair_id, k) where a.side = 0 and b.side = 1 and (a.role is distinct from b.role or a.text is distinct from b.text) group by 1),
common as (select p.*, coalesce(d.k - 1, least(n0, n1)) as n_common from pair p left join differ d using (pair_id))
select c.pair_id, chosen_id, rejected_id, n_common,
  coalesce(string_agg(shown, '' order by k) filter (where side = 0 and k <= n_common), '') as prompt,
  coalesce(string_agg(shown, '' order by k) filter (where side = 0 and k > n_common), '') as chosen_text,
  coalesce(string_agg(shown, '' order by k) filter (where side = 1 and k > n_common), '') as rejected_text,
  coalesce(sum(length(shown)) filter (where side = 0 and k > n_common and role = '{TRAINED}'), 0)::bigint as chosen_train_chars,
  coalesce(sum(length(shown)) filter (where side = 1 and k > n_common and role = '{TRAINED}'), 0)::bigint as rejected_train_chars
from common c join step s using (pair_id) group by c.pair_id, chosen_id, rejected_id, n_common
"""

#: CRC-32 of an ASCII text, bit by bit.
_CRC32 = "xor(list_reduce(list_transform(string_split({0}, ''), lambda c: ord(c)::bigint), lambda crc, b: list_reduce([xor(crc, b)] || [k::bigint for k in range(8)], lambda x, _: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end), 4294967295::bigint), 4294967295)"
_REPAIR = rf"""
with recursive hit as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_CRC32.format("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as what from conversations),
damaged as (
  select conv_id, turn, case when what = 4 then 'user' else role end as role, case what when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when what = 3 then 2 else 1 end)) as copy
  from hit where what <> 0),
row as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as seen, rtrim(text, E' \t\n\x0b\x0c\r') as shown from damaged),
turn as (
  select *, left(role, 1) as initial, case when shown = '' then 'blank' when seen then 'duplicate' when right(shown, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
    lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) not in ('su', 'ua', 'au') as illegal
  from row),
conv as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
    count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where illegal) as illegal
  from turn group by 1),
follows(state, next, name) as (values (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
inserts as (
  select state, state as end_state, 0 as cost, '' as audit, []::varchar[] as lines from follows union all
  select state, next, 2, 'I', [name || ':'] from follows union all
  select a.state, b.next, 4, 'II', [a.name || ':', b.name || ':'] from follows a join follows b on b.state = a.next),
best as (
  select conv_id, 0::bigint as i, end_state as state, {{'cost': cost, 'audit': audit, 'lines': lines}} as way from conv, inserts where state = 0
  union all
  select s.conv_id, s.i, n.end_state, min({{'cost': s.cost + n.cost, 'audit': s.audit || n.audit, 'lines': s.lines || n.lines}})
  from (
    select b.conv_id, b.i + 1 as i, e.state, b.way.cost + e.cost as cost, b.way.audit || e.edit as audit, b.way.lines || e.lines as lines
    from best b join turn t on t.conv_id is not distinct from b.conv_id and t.i = b.i + 1 join follows f on f.state = b.state,
      lateral (
        select b.state as state, 3 as cost, 'D' as edit, []::varchar[] as lines union all
        select f.next, 2 + (t.fault = 'truncated')::int, 'R', [f.name || ':' || t.text] where t.fault not in ('blank', 'duplicate') union all
        select case when t.initial = 's' then 1 else f.next end, (t.fault = 'truncated')::int, 'K', [t.role || ':' || t.text]
        where t.fault not in ('blank', 'duplicate') and (t.initial = left(f.name, 1) or t.initial = 's' and b.state = 0)) e) s
  join inserts n on n.state = s.state group by 1, 2, 3),
cheapest as (select b.conv_id, min(b.way) as way from best b join conv c on c.conv_id is not distinct from b.conv_id and c.n = b.i where b.state in (0, 3) group by 1)
select o.conv_id, coalesce(c.gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  coalesce(way.cost, 0)::bigint as cost, coalesce(way.audit, '') as audit, sha256(coalesce(array_to_string(way.lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join conv c on c.conv_id is not distinct from o.conv_id left join cheapest w on w.conv_id is not distinct from o.conv_id
"""

def _licenses() -> str:
    """Every block against every template of its size, without any filter."""
    words = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
    templates = ", ".join(f"({k}, '{label}', string_split('{text}', ' '), {block_step(len(text.split()))})" for k, (label, text) in enumerate(TEMPLATES))
    phrases = ", ".join(f"('{label}', string_split('{phrase}', ' '))" for phrase, label in PHRASES.items())
    steps = ", ".join(f"({s})" for s in sorted({block_step(len(text.split())) for _, text in TEMPLATES}))
    return rf"""
with doc as (select row_number() over () as rid, doc_id, {words} as words from documents),
template(k, label, words, step) as (values {templates}),
phrase(label, words) as (values {phrases}),
place as (select rid, label, i - 1 as start from (select rid, p.label, p.words as pw, d.words as dw, unnest(range(1, len(d.words) + 1)) as i from doc d, phrase p) where dw[i:i + len(pw) - 1] = pw),
block as (select rid, step, start, list_distinct(words[start + 1:start + 2 * step]) as ws from (select rid, step, words, unnest(range(0, greatest(1, len(words) - step), step)) as start from doc, (values {steps}) s(step)) where len(words) > 0),
shared as (select rid, b.step, start, t.k, t.label, len(t.words) as n, len(list_intersect(b.ws, t.words)) / len(list_distinct(t.words)) as share from block b join template t on t.step = b.step),
best as (select * from shared where share >= {CONTAINED} - 1e-12 qualify row_number() over (partition by rid, step, start order by share desc, n desc, k) = 1),
said as (select rid, count(*) as n_base, min(start) as first_word, max(start) as last_word from place group by 1),
label as (select rid, string_agg(distinct label, ',' order by label) filter (where base) as base_labels, string_agg(distinct label, ',' order by label) as labels, max(share) as score from (select rid, label, true as base, 1.0::double as share from place union all select rid, label, false, share from best) group by 1)
select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
from doc left join said using (rid) left join label using (rid)
"""


ORACLE_SQL: dict[str, str] = {"op2_exact_dedup": _EXACT, "op3_source_mix": _mix(), "op5_quality_rules": _QUALITY, "op8_preference_pairs": _CHAT, "op11_conversation_repair": _REPAIR, "op13_license_scan": _licenses()}
