"""Queries of the preparation jobs (E1-E7) and their column / filter / join steps."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import spans as S
from ..functions import text as X
from ..operators import records as R
from ..oracle import WS_CLASS, r6 as sql_r6, sql_normalise, sql_tokens, with_views
from ..session import table
from .registry import query, r6

# ---------------------------------------------------------------- SQL spellings of the text steps


def q_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS_CLASS}+|{WS_CLASS}+$', '', 'g')"


def q_split(x: str) -> str:
    return sql_tokens(f"trim(regexp_replace({x}, '{WS_CLASS}+', ' ', 'g'))")


def q_cap(x: str) -> str:
    # Python and Java upper-case a leading sharp s to "SS" (full case mapping); DuckDB does not.
    first = f"substring({x}, 1, 1)"
    return f"(case when {first} = 'ß' then 'SS' else upper({first}) end || substring({x}, 2))"


def q_numeric(x: str) -> str:
    return f"regexp_matches({x}, '^\\p{{N}}+$')"


def q_quote(t: str, s: str, e: str) -> str:
    sc = f"least(greatest({s}, 0), length({t}))"
    ec = f"least(greatest({e}, 0), length({t}))"
    return (f"(substring({t}, 1, {sc}) || '\"' || case when {ec} > {sc} then substring({t}, {sc} + 1, {ec} - {sc}) "
            f"else '' end || '\"' || substring({t}, {ec} + 1))")


EXCLUDE = ("src3", "src7")   # stand-ins for the two datasets kept out of training
HEAD = "split_part(sense, '%', 1)"
FILL = f"replace(context, '<TRG>', {HEAD})"


# ---------------------------------------------------------------- P1-P4, F1, J2, E1 (v_lines)


@query("p1_capitalise", with_views(
    f"select line_no, {q_cap('gloss')} as gloss, {q_cap('context')} as context from v_lines", "v_lines"))
def p1_capitalise(spark: SparkSession, sf: str) -> DataFrame:
    v = fx.lines(spark, sf)
    return v.select("line_no", X.capitalise_first("gloss").alias("gloss"), X.capitalise_first("context").alias("context"))


@query("p2_normalise", with_views(
    f"select row_id, {sql_normalise('gloss')} as g, {sql_normalise('answer')} as p from v_pairs", "v_pairs"))
def p2_normalise(spark: SparkSession, sf: str) -> DataFrame:
    v = fx.pairs(spark, sf)
    return v.select("row_id", X.normalise("gloss").alias("g"), X.normalise("answer").alias("p"))


@query("p3_headword", with_views("select line_no, sense, split_part(sense, '%', 1) as target from v_lines", "v_lines"))
def p3_headword(spark: SparkSession, sf: str) -> DataFrame:
    return fx.lines(spark, sf).select("line_no", "sense", X.headword("sense").alias("target"))


@query("p4_fill_placeholder", with_views(
    f"select line_no, {HEAD} as target, {q_strip(FILL)} as example from v_lines",
    "v_lines"))
def p4_fill_placeholder(spark: SparkSession, sf: str) -> DataFrame:
    v = fx.lines(spark, sf).select("line_no", X.headword("sense").alias("target"), "context")
    return v.select("line_no", "target", X.fill_placeholder("context", "target").alias("example"))


@query("f1_record_filter", with_views(
    f"select line_no, split_part(sense, '%', 1) as target, {q_strip('gloss')} as gloss from v_lines "
    f"where not {q_numeric(q_strip('gloss'))} and length({q_strip('gloss')}) >= 5 "
    f"and {HEAD} <> '' and not {q_numeric(HEAD)}",
    "v_lines"))
def f1_record_filter(spark: SparkSession, sf: str) -> DataFrame:
    v = fx.lines(spark, sf).select("line_no", X.headword("sense").alias("target"), "gloss")
    return v.where(X.keep_record("target", "gloss")).select("line_no", "target", X.py_strip("gloss").alias("gloss"))


def _cut_lines(spark: SparkSession, sf: str):
    v = fx.lines(spark, sf)
    senses = v.where(F.col("line_no") % 13 != 0).select("dataset", "split", "line_no", "sense", "gloss")
    examples = v.select("dataset", "split", "line_no", "sense", "context")  # some lines have no gloss
    return senses, examples


_SQL_CUT = {
    "senses": "select dataset, split, line_no, sense, gloss from v_lines where line_no % 13 <> 0",
    "examples": "select dataset, split, line_no, sense, context from v_lines",
}


@query("j2_zip_lines", with_views(
    "select e.dataset, e.split, e.line_no, e.context, s.gloss from examples e "
    "left join senses s on s.dataset = e.dataset and s.split = e.split and s.line_no = e.line_no",
    "v_lines", extra=_SQL_CUT))
def j2_zip_lines(spark: SparkSession, sf: str) -> DataFrame:
    senses, examples = _cut_lines(spark, sf)
    return examples.join(senses.select("dataset", "split", "line_no", "gloss"),
                         ["dataset", "split", "line_no"], "left").select(
        "dataset", "split", "line_no", "context", "gloss")


_E1_BODY = f"""
select distinct dataset, split, target, {q_cap('gloss')} as gloss, {q_cap('example')} as example from (
  select e.dataset, e.split, split_part(e.sense, '%', 1) as target,
         {q_strip("replace(e.context, '<TRG>', split_part(e.sense, '%', 1))")} as example,
         {q_strip('s.gloss')} as gloss
  from examples e left join senses s on s.dataset = e.dataset and s.split = e.split and s.line_no = e.line_no
) r
where not {q_numeric('gloss')} and length(gloss) >= 5 and target <> '' and not {q_numeric('target')}"""
_E1_SQL = with_views(_E1_BODY, "v_lines", extra=_SQL_CUT)


@query("e1_build_definitions", _E1_SQL)
def e1_build_definitions(spark: SparkSession, sf: str) -> DataFrame:
    senses, examples = _cut_lines(spark, sf)
    return R.build_definitions(senses, examples)


# ---------------------------------------------------------------- J1, D1, E2 (documents as a dictionary)


def _dictionary(spark: SparkSession, sf: str):
    d = table(spark, sf, "documents")
    dictionary = d.select(F.col("doc_id").alias("line_no"), F.concat(F.lit("w"), F.col("doc_id").cast("string")).alias("word"),
                          F.col("text").alias("gloss"), F.col("source").alias("example"))
    members = d.where("text is not null").select(
        F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "valid").otherwise("train").alias("split"),
        F.col("text").alias("gloss")).distinct()
    return dictionary, members


_E2_CTES = {
    "dict": "select doc_id as line_no, 'w' || doc_id as word, text as gloss, source as example from documents",
    "members": "select distinct case when doc_id % 10 = 0 then 'test' when doc_id % 10 = 1 then 'valid' else 'train' end "
               "as split, text as gloss from documents where text is not null",
    "look": "select gloss, arg_max(word, line_no) as target, arg_max(example, line_no) as example from dict group by gloss",
}


@query("j1_last_wins_lookup", with_views(
    "select m.split, m.gloss, l.target, l.example from members m join look l on l.gloss = m.gloss", extra=_E2_CTES))
def j1_last_wins_lookup(spark: SparkSession, sf: str) -> DataFrame:
    dictionary, members = _dictionary(spark, sf)
    return R.look_up_members(dictionary, members)


@query("e2_build_definitions_lookup", with_views(
    f"select split, target, {q_cap('gloss')} as gloss, {q_cap('example')} as example from ("
    "select distinct m.split, l.target, m.gloss, l.example from members m join look l on l.gloss = m.gloss) r",
    extra=_E2_CTES))
def e2_build_definitions_lookup(spark: SparkSession, sf: str) -> DataFrame:
    dictionary, members = _dictionary(spark, sf)
    return R.build_definitions_lookup(dictionary, members)


# ---------------------------------------------------------------- P8, R1, E3 (WiC lines)


def _wic_lines(spark: SparkSession, sf: str) -> DataFrame:
    return fx.wic_lines(spark, sf)


_E3_CTES = {
    "w": f"select line_no, target, example1, example2, string_split(indexes, '-') as ix, "
         f"{q_split('example1')} as t1, {q_split('example2')} as t2 from v_wic_lines",
    "s": "select line_no * 2 as usage_no, target, example1 as text, t1 as t, cast(ix[1] as int) as i from w "
         "union all select line_no * 2 + 1, target, example2, t2, cast(ix[2] as int) from w",
    "sp": "select usage_no, target, text, length(array_to_string(t[1:i], ' ')) + case when i > 0 then 1 else 0 end as s, "
          "coalesce(t[i + 1], '') as tok from s",
}


@query("p8_token_span", with_views(
    'select usage_no, s as "start", s + length(tok) as "end" from sp', "v_wic_lines", extra=_E3_CTES))
def p8_token_span(spark: SparkSession, sf: str) -> DataFrame:
    return R.build_wic_usages(_wic_lines(spark, sf)).select("usage_no", "start", "end")


@query("e3_build_wic_usages", with_views(
    f'select usage_no, target, {q_quote("text", "s", "s + length(tok)")} as example, s as "start", '
    f's + length(tok) as "end" from sp', "v_wic_lines", extra=_E3_CTES))
def e3_build_wic_usages(spark: SparkSession, sf: str) -> DataFrame:
    return R.build_wic_usages(_wic_lines(spark, sf))


# ---------------------------------------------------------------- P5-P7, P9, J4, J5, E4 (usages)

_E4_CTES = {
    "j": 'select u.*, c.cluster from v_uses u join v_clusters c on c.target = u.target and c.identifier = u.identifier '
         'where not exists (select 1 from v_clusters n where n.cluster = -1 and n.target = u.target '
         'and n.identifier = u.identifier)',
    "p": "select *, string_split(indexes_target_token, ':') as parts from j",
    "q": "select *, (len(parts) = 2 and try_cast(parts[1] as int) is not null and try_cast(parts[2] as int) is not null) as ok "
         "from p",
    "sp": "select *, cast(parts[1] as bigint) as s, case when ok then cast(parts[2] as bigint) else length(example) end as e "
          "from q",
    "qt": f"select *, {q_quote('example', 's', 'e')} as quoted from sp",
    "wd": "select * from qt, (values (null::int), (25), (50), (75), (100)) v(width)",
}


@query("p5_parse_span", with_views('select identifier, s as "start", e as "end" from sp', "v_uses", "v_clusters",
                                   extra={k: _E4_CTES[k] for k in ("j", "p", "q", "sp")}))
def p5_parse_span(spark: SparkSession, sf: str) -> DataFrame:
    u = fx.uses(spark, sf)
    c = fx.clusters(spark, sf)
    on = ["target", "identifier"]
    u = u.join(c.where(F.col("cluster") == -1), on, "left_anti").join(c, on)
    s, e = S.parse_span("indexes_target_token", "example")
    return u.select("identifier", s.alias("start"), e.alias("end"))


@query("p6_quote_span", with_views("select identifier, quoted as example from qt", "v_uses", "v_clusters",
                                   extra={k: _E4_CTES[k] for k in ("j", "p", "q", "sp", "qt")}))
def p6_quote_span(spark: SparkSession, sf: str) -> DataFrame:
    u = R.build_usages(fx.uses(spark, sf), fx.clusters(spark, sf), widths=(None,))
    return u.select("identifier", "example")


_E4_BODY = """select coalesce(cast(width as varchar), '') as suffix,
  replace(replace(target, '_nn', ''), '_vb', '') as target, "grouping", identifier, cluster, indexes_target_token,
  case when width is null then quoted
       when e + width > greatest(s - width, 0) then substring(quoted, greatest(s - width, 0) + 1, e + width - greatest(s - width, 0))
       else '' end as example
from wd"""


@query("p7_context_window", with_views(
    "select suffix, identifier, example from (" + _E4_BODY + ") x", "v_uses", "v_clusters", extra=_E4_CTES))
def p7_context_window(spark: SparkSession, sf: str) -> DataFrame:
    return R.build_usages(fx.uses(spark, sf), fx.clusters(spark, sf)).select("suffix", "identifier", "example")


@query("p9_strip_pos", with_views(
    "select identifier, target as raw_target, replace(replace(target, '_nn', ''), '_vb', '') as target from v_uses",
    "v_uses"))
def p9_strip_pos(spark: SparkSession, sf: str) -> DataFrame:
    u = fx.uses(spark, sf)
    return u.select("identifier", F.col("target").alias("raw_target"), X.strip_pos("target").alias("target"))


@query("j4_j5_usage_clusters", with_views('select identifier, "grouping", cluster from j', "v_uses", "v_clusters",
                                          extra={"j": _E4_CTES["j"]}))
def j4_j5_usage_clusters(spark: SparkSession, sf: str) -> DataFrame:
    u, c = fx.uses(spark, sf), fx.clusters(spark, sf)
    on = ["target", "identifier"]
    noise = c.where(F.col("cluster") == -1).select(*on)
    return u.join(noise, on, "left_anti").join(c, on).select("identifier", "grouping", "cluster")


@query("e4_build_usages", with_views(_E4_BODY, "v_uses", "v_clusters", extra=_E4_CTES))
def e4_build_usages(spark: SparkSession, sf: str) -> DataFrame:
    return R.build_usages(fx.uses(spark, sf), fx.clusters(spark, sf))


# ---------------------------------------------------------------- A1, J6, E5 (judgments)

_E5_CTES = {
    "kept": "select 't' || (event_id % 3) as target, cast(user_id as varchar) as identifier from events "
            "where (user_id + event_id % 3) % 2 = 0 "
            "union select 't' || (event_id % 3), event_type from events where event_id % 3 < 2",
    "a": "select target, cast(identifier1 as varchar) as identifier1, cast(identifier2 as varchar) as identifier2, "
         "avg(judgment) as judgment from v_judgments group by 1, 2, 3",
}


def _kept_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Kept usages by (target, identifier): an id may be kept for one target and not for another."""
    e = table(spark, sf, "events")
    part = F.col("event_id") % 3
    target = F.concat(F.lit("t"), part.cast("string")).alias("target")
    return e.where((F.col("user_id") + part) % 2 == 0).select(
        target, F.col("user_id").cast("string").alias("identifier")).unionByName(
        e.where(part < 2).select(target, F.col("event_type").alias("identifier")))


@query("a1_mean_judgment", with_views(f"select target, identifier1, identifier2, {sql_r6('judgment')} as judgment from a",
                                      "v_judgments", extra=_E5_CTES))
def a1_mean_judgment(spark: SparkSession, sf: str) -> DataFrame:
    j = fx.judgments(spark, sf)
    a = R.mean_judgments(j)
    return a.select("target", "identifier1", "identifier2", r6("judgment").alias("judgment"))


@query("e5_build_judgments", with_views(
    f"select target, identifier1, identifier2, {sql_r6('judgment')} as judgment from a "
    "where (target, identifier1) in (select (target, identifier) from kept) "
    "and (target, identifier2) in (select (target, identifier) from kept)",
    "v_judgments", extra=_E5_CTES))
def e5_build_judgments(spark: SparkSession, sf: str) -> DataFrame:
    out = R.build_judgments(fx.judgments(spark, sf), _kept_ids(spark, sf))
    return out.select("target", "identifier1", "identifier2", r6("judgment").alias("judgment"))


# ---------------------------------------------------------------- P12-P14, S6, W6, W7, E6

SYS_Q = S.SYSTEM_MESSAGE.replace("'", "''")
USER_PRE, USER_MID = (p.replace("'", "''") for p in S.USER_TEMPLATE.split("{}")[:2])


def q_dialog_text(target: str, example: str, gloss: str | None) -> str:
    nl = "chr(10)"
    s = (f"'<|system|>' || {nl} || '{SYS_Q}' || {nl} || '<|user|>' || {nl} || '{USER_PRE}' || {target} || "
         f"'{USER_MID}' || {example}")
    if gloss:
        s += f" || {nl} || '<|assistant|>' || {nl} || {gloss}"
    return s


@query("e6_training_mix", with_views(
    f"select dataset, target, gloss, example, {q_dialog_text('target', 'example', 'gloss')} as text "
    f"from e1 where split = 'train' and dataset not in {EXCLUDE}",
    "v_lines", extra={**_SQL_CUT, "e1": _E1_BODY}))
def e6_training_mix(spark: SparkSession, sf: str) -> DataFrame:
    senses, examples = _cut_lines(spark, sf)
    defs = R.build_definitions(senses, examples)
    return R.build_training_mix(defs, exclude=EXCLUDE).drop("shuffle_key")


@query("w7_seeded_shuffle", with_views(
    "select row_number() over (order by shuffle_key, dataset, target, gloss, example) - 1 as position, * from k",
    "v_lines", extra={**_SQL_CUT, "e1": _E1_BODY, "k":
        f"select dataset, target, gloss, example, {q_dialog_text('target', 'example', 'gloss')} as text, "
        "('0x' || substr(md5(concat_ws(chr(31), '42', dataset, target, gloss, example)), 1, 15))::bigint as shuffle_key "
        f"from e1 where split = 'train' and dataset not in {EXCLUDE}"}))
def w7_seeded_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    senses, examples = _cut_lines(spark, sf)
    mix = R.build_training_mix(R.build_definitions(senses, examples), exclude=EXCLUDE)
    return R.shuffled_positions(mix)


@query("s6_path_filter_scan", with_views(
    f"select doc_id, source from documents where source not in {EXCLUDE}"))
def s6_path_filter_scan(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.where(~F.col("source").isin(*EXCLUDE)).select("doc_id", "source")


@query("p12_dialog", with_views(
    f"select line_no, {q_dialog_text('target', 'example', 'gloss')} as text from "
    f"(select line_no, split_part(sense, '%', 1) as target, context as example, gloss from v_lines) v", "v_lines"))
def p12_dialog(spark: SparkSession, sf: str) -> DataFrame:
    v = fx.lines(spark, sf).select("line_no", X.headword("sense").alias("target"), F.col("context").alias("example"),
                                    "gloss")
    return v.select("line_no", S.render_turns(S.dialog("target", "example", "gloss")).alias("text"))


@query("p13_question", with_views(
    "select line_no, context || ' What is the definition of ' || split_part(sense, '%', 1) || '?' as question "
    "from v_lines", "v_lines"))
def p13_question(spark: SparkSession, sf: str) -> DataFrame:
    v = fx.lines(spark, sf)
    return v.select("line_no", S.question(X.headword("sense"), F.col("context")).alias("question"))


@query("p14_render_conversations", with_views(
    "select conv_id, string_agg('<|' || role || '|>' || chr(10) || text, chr(10) order by turn) as text "
    "from conversations group by conv_id"))
def p14_render_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return R.render_conversations(table(spark, sf, "conversations"))


@query("w6_pack", with_views(
    "select cast(gpos // 512 as bigint) as block, count(*) as n_tokens, min(doc_id) as first_doc, max(doc_id) as last_doc, "
    "string_agg(tok, ' ' order by gpos) as text from x group by 1",
    extra={
        "d": f"select doc_id, list_append({q_split('text')}, '</s>') as toks from documents",
        "o": "select doc_id, toks, sum(len(toks)) over (order by doc_id rows between unbounded preceding and current row) "
             "- len(toks) as off, sum(len(toks)) over () as total from d",
        "x": "select doc_id, off + i - 1 as gpos, toks[i] as tok, total from o, unnest(generate_series(1, len(toks))) u(i)",
    }))
def w6_pack(spark: SparkSession, sf: str) -> DataFrame:
    return R.pack(table(spark, sf, "documents"), n=512)


@query("e6_pack_training_mix", with_views(
    "select cast(gpos // 512 as bigint) as block, count(*) as n_tokens, min(position) as first_doc, max(position) as last_doc, "
    "string_agg(tok, ' ' order by gpos) as text from x group by 1",
    "v_lines", extra={
        **_SQL_CUT, "e1": _E1_BODY,
        "k": f"select {q_dialog_text('target', 'example', 'gloss')} as text, row_number() over (order by "
             "('0x' || substr(md5(concat_ws(chr(31), '42', dataset, target, gloss, example)), 1, 15))::bigint) - 1 as position "
             f"from e1 where split = 'train' and dataset not in {EXCLUDE}",
        "d": f"select position, list_append({q_split('text')}, '</s>') as toks from k",
        "o": "select position, toks, sum(len(toks)) over (order by position rows between unbounded preceding and current row) "
             "- len(toks) as off from d",
        "x": "select position, off + i - 1 as gpos, toks[i] as tok from o, unnest(generate_series(1, len(toks))) u(i)",
    }))
def e6_pack_training_mix(spark: SparkSession, sf: str) -> DataFrame:
    senses, examples = _cut_lines(spark, sf)
    return R.pack_training_mix(R.build_definitions(senses, examples), exclude=EXCLUDE)


# ---------------------------------------------------------------- P15-P17, P21, W5, F2, P10, P11, E7

# WiC gold lines from the labels table: "T" for quality 1 (padded with a space when toxic, so the
# strip matters), "F" otherwise.
_GOLD_LINE_SQL = "case when quality = 1 then case when toxic = 1 then ' T ' else 'T' end else 'F' end"


def _gold_line():
    t = F.when(F.col("toxic") == 1, F.lit(" T ")).otherwise(F.lit("T"))
    return F.when(F.col("quality") == 1, t).otherwise(F.lit("F"))


_E7_CTES = {
    "v": f"select line_no, {HEAD} as target, {q_strip(FILL)} as example from v_lines",
    "ids": f"select *, list_transform({q_split('example')}, lambda w: (ascii(w) + 7 * length(w)) % 500) as ids from v",
    "cuts": "select * exclude ids, ids[100 * \"window\" + 1:100 * \"window\" + 100] as cut from "
            "(select *, unnest(range(greatest(1, (len(ids) + 99) // 100))) as \"window\" from ids) x",
}


@query("e7_build_generation_input", with_views(
    f"select line_no, \"window\", target, example, {q_dialog_text('target', 'example', None)} as prompt, "
    "example || ' What is the definition of ' || target || '?' as question, "
    "list_concat(list_transform(range(100 - len(cut)), lambda x: 0::bigint), cut) as input_ids, "
    "list_concat(list_transform(range(100 - len(cut)), lambda x: 0::bigint), list_transform(range(len(cut)), lambda x: 1::bigint)) as attention_mask, "
    "line_no // 32 as batch from cuts", "v_lines", extra=_E7_CTES))
def e7_build_generation_input(spark: SparkSession, sf: str) -> DataFrame:
    v = fx.lines(spark, sf).select("line_no", X.headword("sense").alias("target"), "context")
    v = v.select("line_no", "target", X.fill_placeholder("context", "target").alias("example"))
    return R.build_generation_input(v, fx.toy_token_ids, batch=32, max_len=100)


@query("p15_clean_last_line", with_views(
    "select conv_id, turn, replace(trim((string_split(text, chr(10)))[-1], ' .,;:'), chr(10), ' ') as answer "
    "from conversations"))
def p15_clean_last_line(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("answer"))
    return R.clean_answers(c, "last_line")


# one turn in five repeats the marker, one in five still holds the system prompt
@query("p16_clean_after_inst", with_views(
    "select conv_id, turn, replace(case when contains(t, 'SYS>>') then '' else t end, chr(10), ' ') as answer from "
    "(select conv_id, turn, trim((string_split('[/INST]' || case (conv_id + turn) % 5 when 0 then 'a[/INST]' || text "
    "when 1 then '<<SYS>> ' || text else text end, '[/INST]'))[-1], ' .,;:') as t from conversations) c"))
def p16_clean_after_inst(spark: SparkSession, sf: str) -> DataFrame:
    k = (F.col("conv_id") + F.col("turn")) % 5
    text = F.when(k == 0, F.concat(F.lit("a[/INST]"), "text")).when(k == 1, F.concat(F.lit("<<SYS>> "), "text")).otherwise(F.col("text"))
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("[/INST]"), text).alias("answer"))
    return R.clean_answers(c, "after_inst")


@query("p17_label_decode", with_views(
    f"select doc_id, ({q_strip(_GOLD_LINE_SQL)} = 'T')::int as label from labels"))
def p17_label_decode(spark: SparkSession, sf: str) -> DataFrame:
    lab = table(spark, sf, "labels")
    return lab.select("doc_id", X.label_true(_gold_line()).alias("label"))


@query("f2_unanswered_filter", with_views(
    "select conv_id, turn, gloss from (select conv_id, turn, case when conv_id % 9 = 0 then 'Please provide ' || text "
    "else text end as gloss from conversations) c where gloss <> '' and not starts_with(gloss, 'Please provide')"))
def f2_unanswered_filter(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    g = F.when(F.col("conv_id") % 9 == 0, F.concat(F.lit("Please provide "), "text")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", g.alias("gloss")).where(X.answered("gloss"))


@query("p10_drop_short_tokens", with_views(
    f"select conv_id, turn, k, array_to_string(list_filter({q_split('text')}, lambda t: length(t) > k), ' ') as gloss "
    "from conversations, range(1, 5) r(k)"))
def p10_drop_short_tokens(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text",
                                                  F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 2, 3, 4)])).alias("k"))
    return c.select("conv_id", "turn", "k", X.drop_short_tokens("text", F.col("k")).alias("gloss"))


@query("p11_drop_punct_tokens", with_views(
    f"select conv_id, turn, array_to_string(list_filter({q_split('text')}, lambda t: strpos(';.,()', t) = 0), ' ') as gloss "
    "from conversations"))
def p11_drop_punct_tokens(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", X.drop_punct_tokens("text").alias("gloss"))
