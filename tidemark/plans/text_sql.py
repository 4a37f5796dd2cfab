"""SQL pieces that several checks share: runs, tokens with their normal form, conditions of articles."""

from __future__ import annotations

from tidemark.functions.text import CJK, RUN, STOPWORDS, WORD, kana_forms, kana_singles
from tidemark.operators.conditions import LANGUAGES, SOURCE_TYPES


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


RUN_SQL, WORD_SQL, CJK_SQL = lit(RUN), lit(WORD), lit(f"[{CJK}]+")
_rare = "゙゚" + "".join(kana_singles())


def norm(c: str) -> str:
    slow = c
    for a, b in kana_singles().items():
        slow = f"replace({slow}, {lit(a)}, {lit(b)})"
    pairs = " ".join(f"when {lit(a)} then {lit(b)}" for a, b in kana_forms().items())
    plain = f"case when regexp_matches({c}, '[{_rare}]') then case {c} {pairs} else {slow} end else lower({c}) end"
    edge = r"[^\p{L}\p{N}_\s]+"
    return f"nullif(trim(regexp_replace(regexp_replace({plain}, '^{edge}', ''), '{edge}$', '')), '')"


def bigrams(r: str) -> str:
    return f"case when length({r}) > 1 then [substr({r}, i::bigint, 2) for i in range(1, length({r}))] else [{r}] end"


def raw_tokens(source: str, keep: str) -> str:
    """CTEs ending in ``raw`` (``keep`` columns, surface, pos) over ``source`` (``keep`` columns, text)."""
    return f"""
rn as (select {keep}, unnest(x) r, unnest(range(len(x))) n from (select {keep}, regexp_extract_all(text, {RUN_SQL}) x from {source})),
rb as (select {keep}, n, unnest(b) surface, unnest(range(len(b))) m from
  (select {keep}, n, case when ord(r) > 127 then {bigrams('r')} else [r] end b from rn)),
raw as (select {keep}, surface, row_number() over (partition by {keep.split(',')[0]} order by n, m) - 1 pos from rb)"""


def tokens(source: str, keep: str, valid: bool = True) -> str:
    """CTEs ending in ``tok`` (``keep`` columns, surface, pos, token)."""
    ok = r"regexp_matches(token, '[\p{L}\p{N}]')" if valid else "token is not null"
    return f"""{raw_tokens(source, keep)},
tok as (select * from (select {keep}, surface, pos, {norm('surface')} token from raw) where {ok})"""


def _known(field: str, allowed: tuple[str, ...]) -> str:
    return f"case when {field} in ({', '.join(map(lit, allowed))}) then {field} else 'unknown' end"


CURRENT = """
cur as (select * from (select *, row_number() over (partition by article_id order by ingestion_time desc nulls last,
  coalesce(source_url, '') desc, coalesce(substrate_ref, '') desc) k from articles) where k = 1 and article_id is not null)"""

LEGACY = f"""{CURRENT},
fac as (select *, {_known("source_meta['source_type']", SOURCE_TYPES)} source_type, {_known("source_meta['language_profile']", LANGUAGES)} language_profile,
  strftime(ingestion_time at time zone 'UTC', '%Y-%m') time_bucket from cur),
leg as (select *, sha256(concat('{{"language_profile":', to_json(language_profile)::varchar, ',"source_type":', to_json(source_type)::varchar,
  ',"time_bucket":', coalesce(to_json(time_bucket)::varchar, 'null'), '}}')) cond from fac)"""

#: Traces as sorted (key, value) lists: keys in lower case, nulls out, of equal keys the last, the url as one more.
TRACES = """
ent as (select article_id, source_url, substrate_ref, unnest(map_entries(source_meta)) e from cur),
ent2 as (select article_id, 'legacy:' || lower(e.key) tkey, arg_max(e.value, e.key) tval from ent where e.value is not null group by 1, 2
  union all select article_id, 'meta:retrieval_url', source_url from cur where source_url is not null)"""


def _signature(policy: str, keys: tuple[str, ...]) -> str:
    ks = sorted(keys)
    factors = " || ".join(f"case when list_contains(tk, {lit(k)}) then {lit(',' + chr(34) + k + chr(34) + ':')} || to_json(tv[list_position(tk, {lit(k)})])::varchar else '' end" for k in ks)
    missing = f"to_json(list_filter([{', '.join(map(lit, ks))}], lambda k: not list_contains(tk, k)))::varchar"
    return f"""sha256(concat('{{"factors":{{', ltrim({factors}, ','), '}},"missing":', {missing}, ',"policy_id":"{policy}","version":"v1.0"}}'))"""


POLICY = f"""{LEGACY}, {TRACES},
tl as (select article_id, list(tkey order by tkey) tk, list(tval order by tkey) tv from ent2 group by 1),
pt0 as (select c.article_id, c.doc_id, c.cond, c.substrate_ref, coalesce(tk, []) tk, coalesce(tv, []) tv from leg c left join tl using (article_id)),
pol as (select article_id, doc_id, tk, case when substrate_ref is not null then {_signature('standard', ('legacy:source_type', 'legacy:language_profile'))} else cond end cond from pt0)"""
#: The same with every article signed by the policy.
SIGNED = POLICY.replace("case when substrate_ref is not null then ", "").replace(" else cond end cond from pt0", " cond from pt0")
STOP_SQL = ", ".join(map(lit, STOPWORDS))
