"""The same views and queries in SQL, for comparison."""

from __future__ import annotations

import math

from lodestrata.functions import text
from lodestrata.operators import lexical, linker
from lodestrata.operators.lexical import Request
from lodestrata.sources.views import ENTITIES

UNITS = r"""
lab as (select doc_id, min(quality) as quality, max(toxic) as toxic from labels group by doc_id),
dd as (select d.doc_id, lang, source, coalesce(quality = 0, false) as bad, coalesce(toxic = 1, false) as tox, string_split(coalesce(text, ''), chr(10)) as l from documents d left join lab using (doc_id)),
ln as (select doc_id, lang, source, bad, tox, unnest(l) as resolution, generate_subscripts(l, 1) as page from dd),
units as (
  select 'doc:' || doc_id || ':p' || page as id, 'fact' as type, source || '-' || doc_id || '.pdf - page ' || page as summary, resolution,
    case when doc_id % 7 = 0 then '[]' else '[{"id": "' || doc_id || '#page=' || page || '", "kind": "document-page"}]' end as evidence_json,
    '{"imported_from": "document"}' as context_json, ['document', 'pdf'] as tags,
    case when bad then 'draft' when tox then 'deprecated' else 'active' end as status, case when bad then 'candidate' else 'memory' end as memory_kind,
    ['document:' || source || '-' || doc_id || '.pdf#page=' || page] as source_refs, 's' || (doc_id % 5) as session_id,
    case when doc_id % 4 = 0 then '' else source end as workspace_id, lang as repo_id,
    strftime(make_timestamp((1767225600 + doc_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') as updated_at, doc_id, page
  from ln where regexp_matches(resolution, '[^ \t\n\r\f]'))"""
SEARCHABLE = "status = 'active' and memory_kind = 'memory' and evidence_json <> '[]'"


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def tok(x: str) -> str:
    return f"list_filter(regexp_split_to_array(strip_accents(lower({x})), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def tf(array: str, phrase: list[str]) -> str:
    here = " and ".join(f"{array}[i + {k}] = {lit(w)}" for k, w in enumerate(phrase))
    return f"len(list_filter(range(1, len({array}) + 1), lambda i: {here}))"


def scored(phrases: list[list[str]], units: str = UNITS) -> str:
    """CTEs up to ``hits``: the units with occurrences f0.. and bm25."""
    fields = ["a", "b", "c", "d"]
    found = ", ".join(f"{' + '.join(tf(x, p) for x in fields)} as f{k}" for k, p in enumerate(phrases))
    n = ", ".join(f"count(*) filter (where f{k} > 0) as n{k}" for k in range(len(phrases)))
    idf = lambda k: f"greatest(ln((n - n{k} + 0.5::double) / (n{k} + 0.5::double)), 1e-6::double)"
    parts = " + ".join(f"{idf(k)} * f{k} * 2.2::double / (f{k} + 1.2::double * (0.25::double + 0.75::double * dl / mean))" for k in range(len(phrases)))
    return f"""{units},
tk as (select *, {tok('summary')} as a, {tok('resolution')} as b, {tok("array_to_string(tags, ' ')")} as c, {tok("array_to_string(source_refs, ' ')")} as d from units),
cn as (select *, len(a) + len(b) + len(c) + len(d) as dl, {found} from tk),
st as (select count(*) as n, avg(dl) as mean, {n} from cn),
hits as (select cn.*, -({parts}) as bm25 from cn, st where {' or '.join(f'f{k} > 0' for k in range(len(phrases)))})"""


def bm25(query: str, every: bool = False) -> str:
    phrases = [text.query_tokens(t) for t in text.terms(query)]
    cond = f"where {' and '.join(f'f{k} > 0' for k in range(len(phrases)))}" if every else ""
    return f"with {scored(phrases)} select id, round(bm25, 6) as bm25 from hits {cond} order by round(bm25, 9), updated_at desc, id limit 50"


def search(r: Request, units: str = UNITS) -> str:
    phrases = [text.query_tokens(t) for t in text.terms(r.query)]

    def scope(names: list[str]) -> str:
        rule = SEARCHABLE
        if names:
            rule += f" and (workspace_id in ({', '.join(map(lit, names))}) or workspace_id = '')"
        if r.repo_id:
            rule += f" and repo_id in ({lit(r.repo_id)}, '')"
        if r.session_scope == "strict":
            rule += f" and session_id = {lit(r.session_id)}"
        return rule

    both = " and ".join(f"f{k} > 0" for k in range(len(phrases)))
    order = "round(bm25, 9), updated_at desc, id"

    def fused(name: str, names: list[str]) -> str:
        page = lexical.PAGE_BOOST if r.page_boost is None else r.page_boost
        bonus = f"{page}::double / 61" if page else "0"
        if r.session_id and r.session_scope == "prefer":
            bonus += f" + case when session_id = {lit(r.session_id)} then {lexical.SESSION_BOOST}::double / 61 else 0 end"
        return f"""{name}_r as (
  select * from (select *, 1.0::double as w, row_number() over (order by {order}) as rk from hits where {scope(names)} and {both}) where rk <= {r.depth}
  union all select * from (select *, 0.45::double as w, row_number() over (order by {order}) as rk from hits where {scope(names)}) where rk <= {r.depth}),
{name} as (select id, first(summary) as summary, round(sum(w / (60 + rk)) + first({bonus}), 6) as score from {name}_r group by id)"""

    ctes = [scored(phrases, units), fused("own", r.aliases)]
    if r.aliases and r.scope_fallback == "global":
        ctes += [fused("wide", []), "al as (select id, summary, round(score + 0.5::double / 61, 6) as score, 'scoped' as scope from own union all select id, summary, score, 'wider' from wide where id not in (select id from own))"]
    else:
        ctes.append("al as (select *, 'scoped' as scope from own)")
    late = f"row_number() over (partition by regexp_extract(summary, '^(.+?\\.pdf)( - page ([0-9]+))?$', 1) order by score desc, id) > {r.per_document_limit}" if r.per_document_limit else "false"
    return f"with {', '.join(ctes)}, qt as (select *, {late} as late from al) select cast(row_number() over (order by late, score desc, id) as integer) as pos, id, score, scope from qt order by pos limit {r.limit}"


def _list(items: list[str]) -> str:
    return f"[{', '.join(map(lit, items))}]::varchar[]"


ENTITY_ROWS = ", ".join(f"({lit(i)}, {lit(n)}, {_list(a)}, {_list(t)})" for i, n, a, t in ENTITIES)
NORM = "trim(regexp_replace(replace(lower({}), 'ß', 'ss'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"
PATHLIKE = r"(?i)[/\\]|^\.[\w.-]+$|\.(md|markdown|json|jsonl|ts|tsx|js|mjs|py|sh|bash|cfg|conf|ini|ya?ml|toml|txt|log|csv|xml)\b"


ENTITIES_SQL = f"values {ENTITY_ROWS}"
#: A catalogue that grows with the tables: parts with ambiguous and path-like aliases, suppliers, and each document's first words.
CATALOGUE = """select 'part:' || p_partkey, p_name, [p_brand || ' ' || p_type, p_name || '.json']::varchar[], [p_type]::varchar[] from part
union all select 'supplier:' || s_suppkey, s_name, []::varchar[], []::varchar[] from supplier
union all select 'topic:' || doc_id, array_to_string(string_split(string_split(coalesce(text, ''), chr(10))[1], ' ')[1:3], ' '), []::varchar[], []::varchar[] from documents"""


def gazetteer(tags: bool = False, rows: str = ENTITIES_SQL) -> str:
    """CTEs up to ``gaz``."""
    lists = "[[{'s': label, 'o': 'label', 'w': 3}], list_transform(aliases, lambda x: {'s': x, 'o': 'alias', 'w': 2})"
    lists += ", list_transform(tags, lambda x: {'s': x, 'o': 'tag', 'w': 1})]" if tags else "]"
    cjk = f"regexp_matches(alias, '[{text.CJK}]')"
    usable = f"entity_id <> '' and alias <> '' and length(alias) <= 80 and alias not in ({', '.join(map(lit, linker.STOPWORDS))}) and case when {cjk} then length(alias) >= 2 else regexp_matches(alias, '[a-z0-9_]') and length(alias) >= 3 end and not regexp_matches(surface, {lit(PATHLIKE)})"
    return f"""en(id, label, aliases, tags) as ({rows}),
sf0 as (select trim(id) as entity_id, unnest(flatten({lists})) as x from en),
sf as (select entity_id, x.s as surface, x.o as source, x.w as weight, {NORM.format('x.s')} as alias from sf0),
us as (select *, {usable} as usable from sf),
gaz as (select alias, arg_min(entity_id, k) as entity_id, trim(arg_min(surface, k)) as display, arg_min(source, k) as source, max(weight) as weight, list_sort(list_distinct(list(entity_id))) as entities
  from (select *, (-weight, entity_id, source, surface) as k from us where usable) group by alias)"""


CHUNKS = f"""ch as (select 'doc:' || doc_id as document_id, id, page as seq, {NORM.format('resolution')} as h from units where status = 'active')"""


def mentions(cap: int = linker.MOST_MENTIONS, rows: str = ENTITIES_SQL) -> str:
    """CTEs up to ``ac`` (accepted spans) and ``mn`` (mentions)."""
    return f"""{UNITS}, {gazetteer(rows=rows)}, {CHUNKS},
oc as (select ch.id, h, alias, entity_id, display, source, weight, string_split(h, alias) as p from ch join gaz on contains(h, alias)),
sp as (select *, unnest(list_transform(range(1, len(p)), lambda i: list_sum(list_transform(p[1:i], lambda y: length(y))) + (i - 1) * length(alias)))::int as st from oc),
ok as (select id, st, st + length(alias) as en, alias, entity_id, display, source, weight from sp
  where not (regexp_matches(left(alias, 1), '[a-z0-9_]') and st > 0 and regexp_matches(substr(h, st, 1), '[a-z0-9_]'))
    and not (regexp_matches(right(alias, 1), '[a-z0-9_]') and st + length(alias) < length(h) and regexp_matches(substr(h, st + length(alias) + 1, 1), '[a-z0-9_]'))),
gr as (select id, list([{{'s': st, 'e': en, 'alias': alias, 'entity_id': entity_id, 'display': display, 'source': source, 'weight': weight}}] order by en - st desc, st, entity_id) as l from ok group by id),
ac0 as (select id, unnest(list_reduce(l, lambda acc, x: case when len(list_filter(acc, lambda o: x[1].s < o.e and o.s < x[1].e)) > 0 then acc else list_concat(acc, x) end)) as z from gr),
ac as (select id, z.s as st, z.e as en, z.alias as alias, z.entity_id as entity_id, z.display as display, z.source as source, z.weight as weight from ac0),
mn0 as (select id, entity_id, count(*) as occurrences, min(st) as position, arg_min(alias, k) as alias, arg_min(display, k) as display, arg_min(source, k) as source
  from (select *, (-weight, -length(alias), alias) as k from ac) group by id, entity_id),
mn as (select *, ['low', 'medium', 'high'][greatest(1, case when source = 'tag' then 2 else 3 end - (occurrences < 2)::int - (source = 'tag' and length(alias) <= 4)::int)] as confidence
  from (select *, row_number() over (partition by id order by position, entity_id, alias) as rn from mn0) where rn <= {cap}),
ru0 as (select document_id, seq, mn.*, list_position(['low', 'medium', 'high'], confidence) as lv from mn join ch using (id)),
ru as (select document_id, entity_id, case when max(lv) = 1 then arg_min(alias, seq) else arg_max(alias, (lv, -seq)) end as alias, sum(occurrences)::bigint as occurrences, count(*) as chunks,
  ['low', 'medium', 'high'][max(lv)] as confidence, list_sort(list(id))[1:20] as evidence from ru0 group by document_id, entity_id)"""


NODES = r"""
sn as (select *, 'pw-' || s_name as hint from supplier),
nodes as (
  select 'supplier:' || s_suppkey as id, 'supplier' as kind, ['kind', 'name', 'balance', 'password_hint', 'API_KEY'] as ks, ['supplier', s_name, cast(s_acctbal as varchar), hint, hint] as vs, case when s_acctbal < 0 then 'draft' else 'active' end as status from sn
  union all select 'nation:' || n_nationkey, 'nation', ['kind', 'name'], ['nation', n_name], 'active' from nation
  union all select 'region:' || r_regionkey, 'region', ['kind', 'name'], ['region', r_name], 'active' from region),
edges as (
  select 'supplier:' || s_suppkey || '->nation:' || s_nationkey as id, 'supplier:' || s_suppkey as src, 'nation:' || s_nationkey as dst, 'BASED_IN' as type from supplier
  union all select 'nation:' || n_nationkey || '->region:' || n_regionkey, 'nation:' || n_nationkey, 'region:' || n_regionkey, 'PART_OF' from nation
  union all select 'supplier:' || s_suppkey || '->nation:' || (s_nationkey + 1000), 'supplier:' || s_suppkey, 'nation:' || (s_nationkey + 1000), 'BASED_IN' from supplier where s_suppkey % 10 = 0)"""
SHOWN = "list_filter(range(1, len(ks) + 1), lambda i: not regexp_matches(lower(ks[i]), 'password|secret|token|credential|api_key'))"


def graph_search(terms: list[str], limit: int) -> str:
    hit = " or ".join(f"contains(lower(vs[i]), {lit(t)})" for t in terms)
    return f"""with {NODES},
sh as (select *, {SHOWN} as s from nodes where status = 'active'),
mt as (select *, list_sort(list_transform(list_filter(s, lambda i: {hit}), lambda i: ks[i])) as matched from sh),
best as (select *, len(matched) as score from mt where len(matched) > 0 order by score desc, id limit {limit}),
nb as (select b.id as node, e.id as edge_id, e.type, 'outgoing' as direction, e.dst as other from best b join edges e on e.src = b.id
  union all select b.id, e.id, e.type, 'incoming', e.src from best b join edges e on e.dst = b.id and e.src <> e.dst),
ln as (select node, list_sort(list(edge_id || '|' || nb.type || '|' || direction || '|' || other || '|' || n.vs[2]))[1:3] as c from nb join nodes n on n.id = nb.other group by node)
select best.id, 'graph:KnowledgeEntity' as type, vs[2] as summary, cast(score as integer) as score, array_to_string(matched, ',') as matched, coalesce(array_to_string(c, ';'), '') as connections from best left join ln on ln.node = best.id"""


def cosine_floor(x: float) -> float:
    return math.floor(x * 1e9) / 1e9
