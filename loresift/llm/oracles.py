"""DuckDB SQL that gives the same rows as the queries of this subpackage, where SQL can."""

from __future__ import annotations

from loresift.llm import mixing

OP10 = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws
  from documents),
s as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) = 1 then [ws[1]]
                 else list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || chr(10) || ws[i + 1])) end sh
  from w),
e as (select doc_id, unnest(sh) x from s),
p as (select a.doc_id a, b.doc_id b, count(*) k from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by all),
l as (select a, b from p join s sa on sa.doc_id = a join s sb on sb.doc_id = b where 100 * k >= 80 * (len(sa.sh) + len(sb.sh) - k)),
both_ways as (select a, b from l union select b, a from l),
r(node, other) as (select doc_id, doc_id from s union select r.node, t.b from r join both_ways t on t.a = r.other)
select s.doc_id, len(s.sh)::bigint n_shingles, min(other) component_id, s.doc_id = min(other) kept
from s join r on r.node = s.doc_id group by s.doc_id, len(s.sh)
"""


def _unit(column: str) -> str:
    return f"(('0x' || substr(md5(coalesce({column}::varchar, '')), 1, 12))::bigint::double / {float(1 << 48)})"


def mixing_cells(documents: str) -> str:
    """CTEs ``mix_docs`` (documents with topic and tokens) and ``mix_prob`` (probability of each cell)."""
    topics = " ".join(f"when regexp_matches(coalesce(text, ''), '{rule}') then '{name}'" for name, rule in mixing.TOPICS)
    out = [
        f"mix_docs as materialized (select doc_id, coalesce(source, '') source, coalesce(lang, '') lang, case {topics} else 'prose' end topic, "
        f"len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint n_tokens from {documents})",
        "mix_cells as materialized (select source, lang, topic, sum(n_tokens)::double tokens from mix_docs group by all)",
    ]
    for a in mixing.AXES:
        out.append(f"mix_{a} as materialized (select {a}, pow(sum(tokens), {mixing.TEMPER}::double) / sum(pow(sum(tokens), {mixing.TEMPER}::double)) over () share from mix_cells where tokens > 0 group by {a})")
    out.append("mix_w0 as (select *, tokens / sum(tokens) over () w from mix_cells where tokens > 0)")
    k = 0
    for _ in range(mixing.ROUNDS):
        for a in mixing.AXES:
            out.append(f"mix_w{k + 1} as (select p.source, p.lang, p.topic, tokens, w * share / sum(w) over (partition by p.{a}) w from mix_w{k} p join mix_{a} t on p.{a} = t.{a})")
            k += 1
    out.append(f"mix_rate as (select source, lang, topic, (w / tokens) / max(w / tokens) over () rate from mix_w{k})")
    out.append("mix_prob as materialized (select c.source, c.lang, c.topic, round(coalesce(rate, 1), 6) prob from mix_cells c left join mix_rate r on c.source = r.source and c.lang = r.lang and c.topic = r.topic)")
    return ",\n".join(out)


OP4 = r"""
with t as (select distinct conv_id, coalesce(turn, -1) turn, coalesce(role, '') role, coalesce(text, '') text from conversations where conv_id is not null),
l as (select conv_id, list({'role': role, 'text': text} order by turn, role, text) ts from t group by conv_id),
reps as (select min(conv_id) conv_id, ts from l group by ts),
pre as (select distinct ts[1:k] p from (select ts, unnest(range(1, len(ts))) k from reps))
select conv_id, len(ts)::bigint n_turns,
  list_aggregate(list_transform(ts, lambda x: '<|im_start|>' || x.role || chr(10) || replace(x.text, '<|', '< |') || '<|im_end|>' || chr(10)), 'string_agg', '') as text
from reps where ts not in (select p from pre)
"""

OP8 = f"""
with {mixing_cells("documents")}
select d.doc_id, d.source, d.lang, d.topic, d.n_tokens, p.prob, {_unit("d.doc_id")} < p.prob as kept
from mix_docs d join mix_prob p on d.source = p.source and d.lang = p.lang and d.topic = p.topic
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_collapse": OP4, "op8_mixing": OP8, "op10_minhash_near_dedup": OP10}
