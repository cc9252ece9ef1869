"""DuckDB text of the fixture views (FIXTURES.md part 2), used as leading CTEs of the oracle SQL.

The driver registers the base tables only; ``with_views`` prepends the views a query needs.
"""
from __future__ import annotations

from .fixtures import ANSWERS

# Python's str.isspace() set, written as one regex class valid in Java and RE2 (fixed values).
WS_CLASS = (r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def _n_tokens(x: str) -> str:
    return f"greatest(len(list_filter(regexp_split_to_array({x}, '{WS_CLASS}+'), lambda t: t <> '')), 1)"



VIEWS: dict[str, str] = {
    "v_pairs": """
select a.conv_id * 4294967296 + a.turn as row_id, 'm' || (a.conv_id % 4) as model, 'd' || (a.conv_id % 5) as dataset,
       a.text as gloss, coalesce(b.text, '') as answer
from conversations a left join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 1
where a.turn % 2 = 0
union all
select conv_id * 4294967296 + turn + 1, 'm' || (conv_id % 4), 'd' || (conv_id % 5), text, upper(text)
from conversations where turn % 2 = 0 and conv_id % 10 = 0""",
    "v_lines": """
select doc_id as line_no, source as dataset,
       case when doc_id % 10 = 0 then 'test' when doc_id % 10 = 1 then 'valid' else 'train' end as split,
       lang || '%' || doc_id as sense,
       case when doc_id % 50 = 0 then '12345678' when doc_id % 50 = 1 then 'abc' else text end as gloss,
       replace(text, ' the ', ' <TRG> ') as context
from documents""",
    "v_uses": """
select doc_id // 2 as identifier, 1 + doc_id // 2 % 2 as grouping,
       coalesce(lang, 'und') || case when doc_id % 2 = 0 then '_nn' else '_vb' end as target, x as example,
       case when doc_id % 7 = 0 then cast(strpos(x, ' ') as varchar)
            else strpos(x, ' ') || ':' || (strpos(x, ' ') + length(split_part(x, ' ', 2))) end as indexes_target_token
from (select *, coalesce(text, '') as x from documents) d""",
    "v_clusters": """
select coalesce(lang, 'und') || case when doc_id % 2 = 0 then '_nn' else '_vb' end as target, doc_id // 2 as identifier,
       case when toxic = 1 then -1 else quality end as cluster from labels join documents using (doc_id)""",
    "v_wic_lines": f"""
select a.conv_id * 4294967296 + a.turn as line_no, a.role as target, 'N' as pos,
       (a.turn % {_n_tokens('a.text')}) || '-' || ((a.turn + 1) % {_n_tokens('b.text')}) as indexes,
       a.text as example1, b.text as example2
from conversations a join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 1""",
    "v_judgments": """
select 't' || (event_id % 3) as target, user_id as identifier1, event_type as identifier2, value as judgment from events""",
    "v_usages": """
select 3 * vec_id + k as line_no, 't' || (vec_id // 512 * 8 + vec_id % 8) as target, 1 + (vec_id // 8 + k) % 2 as grouping,
       'u' || (3 * vec_id + k) as identifier, case when (3 * vec_id + k) % 37 = 0 then -1 else label end as cluster,
       'g' || vec_id as gloss, embedding
from embeddings, range(3) r(k)""",
    "v_gold": """
select 't' || s_suppkey as lemma, cast((s_suppkey * 37 % 11) as double) / 10 as change_graded from supplier""",
    "v_answers": "\nunion all ".join(
        f"""select '{x}' as suffix, '{f}' as model_folder, '{m}' as ft_model_name, 't' || (doc_id // 64) as target, doc_id as line_no,
       1 + doc_id % 2 as grouping, case when doc_id % 37 = 0 then -1 else n_chars % 4 end as cluster,
       array_to_string(string_split(coalesce(text, ''), ' ')[{k + 1}:{k + n}], ' ') as answer
from documents""" for x, f, m, k, n in ANSWERS),
    "v_wic_answers": "\nunion all ".join(
        f"""select '{m}' as model, case when doc_id // 2 % 2 = 0 then 'dev' else 'test' end as part, doc_id as line_no,
       array_to_string(string_split(coalesce(text, ''), ' ')[{k + 1}:{k + 2}], ' ') || ' . ,; ' as answer
from documents""" for m, k in (("gen-A", 0), ("gen-B", 3))),
    "v_wic_gold": """
select doc_id // 2 as pair_id, case when n_chars % 2 = 0 then ' T' else 'F ' end as gold from documents where doc_id % 2 = 0""",
    "v_wic": """
select a.vec_id // 2 as pair_id, 'm' || ((a.vec_id // 2) % 4) as model,
       case when (a.vec_id // 8) % 2 = 0 then 'dev' else 'test' end as part,
       cast((a.label < 5) = (b.label < 5) as int) as label, a.embedding as e1, b.embedding as e2
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 where a.vec_id % 2 = 0""",
    "v_runs": """
select 'fam' || (l_suppkey % 2) || '-' || (4 * l_linenumber) || '-' || (8 * l_linenumber) || '-0.1-0.001-1e-4' as run_id,
       case l_returnflag when 'A' then 'oxford_test' when 'N' then 'wordnet_test' else 'en-codwoe_test' end as dataset,
       l_discount as nltk_bleu, l_tax as "rougeL", l_quantity / 50 as bertscore
from lineitem""",
    "v_results": """
select case when p_partkey % 5 = 0 then '' else cast(25 * (p_partkey % 5) as varchar) end as suffix,
       1 + p_partkey % 4 as filter_, p_brand as ft_model_name, p_type as model,
       cast(p_size as double) / 50 as "ARI", p_retailprice / 2000 as "PUR",
       cast(p_partkey % 101 as double) / 100 as "RI",
       cast(p_partkey % 89 as double) / 88 as "APD", cast(p_partkey % 97 as double) / 96 as "APDP", p_partkey as row_key
from part""",
}

# string.punctuation as a regex class (fixed values: the 32 ASCII punctuation characters).
PUNCT_CLASS = r"[!-/:-@\[-`{-~]"


def sql_normalise(col: str) -> str:
    """DuckDB text of the metric normalisation."""
    return (f"trim(regexp_replace(regexp_replace(lower({col}), '{PUNCT_CLASS}', '', 'g'), "
            f"'{WS_CLASS}+', ' ', 'g'))")


def sql_tokens(col: str) -> str:
    """DuckDB list of whitespace tokens of an already normalised column ('' -> [])."""
    return f"(case when {col} = '' then []::varchar[] else string_split({col}, ' ') end)"


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the named fixture views (and extra CTEs, in order) as a WITH clause."""
    parts = [f"{n} as ({VIEWS[n]}\n)" for n in names]
    for k, v in (extra or {}).items():
        parts.append(f"{k} as ({v}\n)")
    if not parts:
        return body
    return "with " + ",\n".join(parts) + "\n" + body


def sql_rouge_tokens(col: str) -> str:
    s = f"trim(regexp_replace(lower({col}), '[^a-z0-9]+', ' ', 'g'))"
    return sql_tokens(s)


def r6(expr: str) -> str:
    """Round a double to 6 places (after the same 1e-12 nudge as the Spark side) and fold -0.0
    into 0.0 (same in the Spark queries)."""
    return f"(round(({expr})::double + 1e-12, 6) + 0.0)"


# ------------------------------------------------------------------ definition scoring (M1-M7, A2)

DG_CTES: dict[str, str] = {
    "prep": f"""select row_id, model, dataset, {sql_normalise('gloss')} as g, {sql_normalise('answer')} as p
from v_pairs""",
    "tk": f"""select row_id, model, dataset, g, p, {sql_tokens('g')} as gt, {sql_tokens('p')} as pt,
       len({sql_tokens('g')}) as lg, len({sql_tokens('p')}) as lp from prep""",
    "sides": """select row_id, 'g' as side, gt as t from tk union all select row_id, 'p' as side, pt as t from tk""",
    "grams": """select row_id, side, n, array_to_string(t[i:i+n-1], ' ') as gram,
       case when n > 1 then array_to_string(t[i:i+n-2], ' ') end as prefix
from sides, range(1, 6) r(n), unnest(generate_series(1, len(t) - n + 1)) as u(i)""",
    "cnt": """select row_id, n, gram, prefix, count(*) filter (where side = 'g') as cg,
       count(*) filter (where side = 'p') as cp from grams group by row_id, n, gram, prefix""",
    "info": """select c.row_id, c.n, least(c.cg, c.cp) * (log2(coalesce(pg.cg, 1)) - log2(c.cg)) as w
from cnt c left join cnt pg on pg.row_id = c.row_id and pg.n = c.n - 1 and pg.gram = c.prefix and pg.cg > 0
where c.cg > 0 and c.cp > 0""",
    "st": "select row_id, " + ", ".join(
        [f"coalesce(sum(least(cg, cp)) filter (where n = {k}), 0) as m{k}" for k in range(1, 6)]
        + [f"coalesce(sum(cp) filter (where n = {k}), 0) as tp{k}" for k in range(1, 6)]) + " from cnt group by row_id",
    "si": "select row_id, " + ", ".join(
        [f"coalesce(sum(w) filter (where n = {k}), 0) as s{k}" for k in range(1, 6)]) + " from info group by row_id",
    "ng": "select tk.row_id, lg, lp, " + ", ".join(
        [f"coalesce(m{k}, 0) as m{k}" for k in range(1, 6)] + [f"coalesce(tp{k}, 0) as tp{k}" for k in range(1, 6)]
        + [f"coalesce(s{k}, 0) as s{k}" for k in range(1, 6)])
        + " from tk left join st on st.row_id = tk.row_id left join si on si.row_id = tk.row_id",
    "ngs": """select row_id,
  case when lp = 0 or m1 = 0 then 0.0 else
    (case when lp > lg then 1.0 else exp(1 - lg / lp) end) *
    exp((ln(m1 / lp)
         + case when lp >= 2 then ln((m2 + 1) / (tp2 + 1)) else 0 end
         + case when lp >= 3 then ln((m3 + 1) / (tp3 + 1)) else 0 end
         + case when lp >= 4 then ln((m4 + 1) / (tp4 + 1)) else 0 end) / least(4, lp)) end as nltk_bleu,
  case when lp = 0 or lg = 0 then 0.0 else
    ((s1 + m1 * log2(lg)) / lp
     + case when lp >= 2 then s2 / (lp - 1) else 0 end
     + case when lp >= 3 then s3 / (lp - 2) else 0 end
     + case when lp >= 4 then s4 / (lp - 3) else 0 end
     + case when lp >= 5 then s5 / (lp - 4) else 0 end)
    * (case when lp / lg < 1 then exp((ln(0.5) / pow(ln(1.5), 2)) * pow(ln(lp / lg), 2)) else 1.0 end) end as nist,
  case when lp < 4 or m1 + m2 + m3 + m4 = 0 then 0.0 else
    (case when lp < lg then exp(1 - lg / lp) else 1.0 end) *
    exp((ln(case when m1 > 0 then 100.0 * m1 / tp1 else 100.0 / (pow(2, (m1 = 0)::int) * tp1) end)
       + ln(case when m2 > 0 then 100.0 * m2 / tp2 else 100.0 / (pow(2, (m1 = 0)::int + (m2 = 0)::int) * tp2) end)
       + ln(case when m3 > 0 then 100.0 * m3 / tp3
                 else 100.0 / (pow(2, (m1 = 0)::int + (m2 = 0)::int + (m3 = 0)::int) * tp3) end)
       + ln(case when m4 > 0 then 100.0 * m4 / tp4
                 else 100.0 / (pow(2, (m1 = 0)::int + (m2 = 0)::int + (m3 = 0)::int + (m4 = 0)::int) * tp4) end)
      ) / 4) end as sacrebleu
from ng""",
    "tp": """select row_id, side, pos, t[pos] as word from sides, unnest(generate_series(1, len(t))) as u(pos)""",
    "rk": """select *, row_number() over (partition by row_id, side, word order by pos desc) as rk from tp""",
    "mt": """select p.row_id, p.pos as pp, g.pos as gp from rk p join rk g
  on p.row_id = g.row_id and p.word = g.word and p.rk = g.rk where p.side = 'p' and g.side = 'g'""",
    "mt2": """select row_id, pp, gp,
  case when lag(pp) over (partition by row_id order by pp) = pp - 1
        and lag(gp) over (partition by row_id order by pp) = gp - 1 then 0 else 1 end as st from mt""",
    "me": """select tk.row_id, case when coalesce(mm, 0) = 0 or lp = 0 or lg = 0 then 0.0 else
  (1 - 0.5 * pow(chunks / mm, 3)) * ((mm / lp) * (mm / lg)) / (0.9 * (mm / lp) + 0.1 * (mm / lg)) end as meteor
from tk left join (select row_id, count(*) as mm, sum(st) as chunks from mt2 group by row_id) x on x.row_id = tk.row_id""",
    "rt": f"""select row_id, {sql_rouge_tokens('g')} as a, {sql_rouge_tokens('p')} as b from tk""",
    "rl": """select row_id, case when len(a) = 0 or len(b) = 0 then 0 else
  list_reduce(b, lambda dp, t: list_reduce(list_transform(range(1, len(a) + 1),
      lambda j: case when a[j] = t then dp[j] + 1 else dp[j + 1] end),
      lambda acc, x: list_append(acc, greatest(acc[-1], x)), [0]),
    list_transform(range(0, len(a) + 1), lambda x: 0))[-1] end as lcs, len(a) as la, len(b) as lb from rt""",
    "rouge": """select row_id, case when lcs = 0 then 0.0 else
  2 * (lcs / lb) * (lcs / la) / ((lcs / lb) + (lcs / la)) end as "rougeL" from rl""",
    "tv": """select distinct word as token from tp where length(word) > 0
  and ('0x' || substr(md5(word), 1, 8))::bigint % 11 <> 0""",
    "vec": """select tv.token, cast(e.embedding as double[]) as v from tv
  join embeddings e on e.vec_id = ('0x' || substr(md5(tv.token), 1, 8))::bigint % (select count(*) from embeddings)""",
    "best": """select p.row_id, p.side, p.pos, max(coalesce(list_cosine_similarity(vp.v, vg.v), 0)) as best
from tp p left join vec vp on vp.token = p.word
join tp g on g.row_id = p.row_id and g.side <> p.side
left join vec vg on vg.token = g.word
group by p.row_id, p.side, p.pos""",
    "soft": """select tk.row_id, case when pr is null or rc is null or pr + rc = 0 then 0.0
  else 2 * pr * rc / (pr + rc) end as bertscore
from tk left join (select row_id, avg(best) filter (where side = 'p') as pr,
                          avg(best) filter (where side = 'g') as rc from best group by row_id) b on b.row_id = tk.row_id""",
}

DG_METRIC_CTES = {
    "nltk_bleu": ("ngs", ["sides", "grams", "cnt", "info", "st", "si", "ng", "ngs"]),
    "nist": ("ngs", ["sides", "grams", "cnt", "info", "st", "si", "ng", "ngs"]),
    "sacrebleu": ("ngs", ["sides", "grams", "cnt", "info", "st", "si", "ng", "ngs"]),
    "meteor": ("me", ["sides", "tp", "rk", "mt", "mt2", "me"]),
    "rougeL": ("rouge", ["rt", "rl", "rouge"]),
    "bertscore": ("soft", ["sides", "tp", "tv", "vec", "best", "soft"]),
    "exact_match": (None, []),
}


def dg_sql(metrics, keep=("model", "dataset"), summary: bool = False) -> str:
    """Oracle for scoring (E8 / single metrics) or, with ``summary``, the A2 means per (model, dataset)."""
    need: list[str] = ["prep", "tk"]
    joins, cols = [], []
    for m in metrics:
        src, ctes = DG_METRIC_CTES[m]
        for c in ctes:
            if c not in need:
                need.append(c)
        if m == "exact_match":
            cols.append("(tk.g = tk.p)::double as exact_match")
        else:
            if src not in [j for j, _ in joins]:
                joins.append((src, f"left join {src} on {src}.row_id = tk.row_id"))
            cols.append(f'{src}."{m}" as "{m}"')
    body = ("select tk.row_id, " + "".join(f"tk.{k}, " for k in keep) + "tk.g as gloss, tk.p as answer, "
            + ", ".join(cols) + " from tk " + " ".join(j for _, j in joins))
    extra = {c: DG_CTES[c] for c in need}
    extra["scored"] = body
    if summary:
        final = ("select model, dataset, count(*) as n_rows, "
                 + ", ".join(f'{r6(f"avg(\"{m}\")")} as "{m}"' for m in metrics)
                 + " from scored group by model, dataset")
    else:
        final = ("select row_id, " + "".join(f"{k}, " for k in keep) + "gloss, answer, "
                 + ", ".join(f'{r6(f"\"{m}\"")} as "{m}"' for m in metrics) + " from scored")
    return with_views(final, "v_pairs", extra=extra)
