"""One query per operator over its whole table, and its SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bytebpe, collocations, dedup, dialogues, fingerprints, jaccard, packing, pii, quality, sharding, tokenfiles, topk, warc
from .common import read


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_groups(read(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.round_trip(read(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_digest(spark, read(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.build_derivatives(read(spark, sf_dir, "pages"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_classes(read(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read(spark, sf_dir, "embeddings"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digest(read(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op12_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return dialogues.repair(dialogues.damage(turns), ids=turns)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbours(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_exact_dedup, op2_byte_bpe, op3_token_files, op4_sharding, op5_warc_derivatives, op6_ngram_jaccard, op7_quality, op8_topk_search, op9_pii, op10_packing, op11_collocations, op12_dialogue_repair, op13_fingerprints)
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _repair_sql() -> str:
    """The same dynamic programme as a recursive query: a row a conversation and step, a struct (cost, audit, text) a state."""

    def line(node: str, role: str, text: str = "''") -> str:
        return f"case when {node}.t is null then {role} || ':' || {text} else {node}.t || chr(10) || {role} || ':' || {text} end"

    def edit(node: str, letter: str, price: str, text: str | None = None) -> str:
        return f"{{'c': {node}.c + {price}, 'a': {node}.a || '{letter}', 't': {text or f'{node}.t'}}}"

    def insert(node: str, role: str) -> str:
        return edit(node, "I", "3", line(node, f"'{role}'"))

    def least(*nodes: str) -> str:
        return f"list_sort([{', '.join(nodes)}])[1]"

    def on_row(node: str, keep: str, role: str) -> str:
        """Rerole, and Keep where the initial fits; neither for rows that must go."""
        rerole = edit(node, "R", "3 + r.cut + r.gone", line(node, f"'{role}'", "r.text"))
        kept = edit(node, "K", f"r.cut + r.gone + if(left(r.role, 1) = '{keep}', 0, 1000000000)", line(node, "r.role", "r.text"))
        return f"{rerole}, {kept}"

    never = "{'c': 1000000000::bigint, 'a': '', 't': null::varchar}"
    full = f"""select *, {least('u', insert('z', 'user'), insert('s', 'user'), insert('a', 'user'))} as fu from walk"""
    full = f"""select *, {least('a', insert('fu', 'assistant'))} as fa from ({full})"""
    return f"""
        with recursive crc as (
            select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as t
        ), coded as (
            select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                   xor(list_reduce(list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint),
                       lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 as code
            from conversations, crc
        ), damaged as (
            select conv_id, turn, if(code = 4, 'user', role) as role,
                   case code when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
                   unnest(range(case code when 0 then 0 when 3 then 2 else 1 end)) as copy
            from coded
        ), placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as p from damaged
        ), numbered as (
            select *, row_number() over (partition by conv_id, role, text order by p) as time,
                   lag(left(role, 1)) over (partition by conv_id order by p) || left(role, 1) as pair,
                   trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body
            from placed
        ), faults as (
            select *, case when body = '' then 'b' when time > 1 then 'd' when right(body, 1) not in ('.', '!', '?') then 't' else '' end as fault from numbered
        ), r as (
            select conv_id, p, role, text, if(fault = 't', 3, 0)::bigint as cut, if(fault in ('b', 'd'), 1000000000, 0)::bigint as gone from faults
        ), walk as (
            select conv_id, 0::bigint as p, {{'c': 0::bigint, 'a': '', 't': null::varchar}} as z, {never} as s, {never} as u, {never} as a
            from (select distinct conv_id from conversations)
            union all
            select f.conv_id, r.p, {edit('z', 'D', '4')} as z,
                   {least(edit('s', 'D', '4'), edit('z', 'K', "r.cut + r.gone + if(left(r.role, 1) = 's', 0, 1000000000)", line('z', 'r.role', 'r.text')))} as s,
                   {least(edit('fu', 'D', '4'), on_row('z', 'u', 'user'), on_row('s', 'u', 'user'), on_row('fa', 'u', 'user'))} as u,
                   {least(edit('fa', 'D', '4'), on_row('fu', 'a', 'assistant'))} as a
            from ({full}) f join r on r.conv_id is not distinct from f.conv_id and r.p = f.p + 1
        ), ends as (
            select conv_id, {least('z', 'fa')} as e from ({full.replace("from walk", "from (select * from walk qualify p = max(p) over (partition by conv_id))")})
        ), counts as (
            select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank,
                   count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal
            from faults group by conv_id
        )
        select e.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
               coalesce(illegal, 0) as illegal, e.e.c::bigint as cost, e.e.a as audit, sha256(coalesce(e.e.t, '')) as repaired_sha256
        from ends e left join counts c on c.conv_id is not distinct from e.conv_id"""


ORACLES: dict[str, str] = {
    "op12_dialogue_repair": _repair_sql(),
    "op1_exact_dedup": f"""
        with t as (select doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as norm from documents)
        select doc_id, max(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
               doc_id = max(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
        from t""",
    "op8_topk_search": """
        with v as (
            select vec_id, [floor(64 * x::double) for x in embedding] as v from embeddings
            where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
        ), s as (
            select q.vec_id as query_id, c.vec_id as vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
            from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0 and len(q.v) = len(c.v)
        ), r as (
            select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s
        )
        select query_id, rank, vec_id, score from r where rank <= 20""",
    "op11_collocations": f"""
        with pieces as (
            select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) as piece
            from documents
        ), words as (
            select lang, copies, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') as w
            from (select lang, piece, count(*) as copies from pieces group by all)
        ), grams as (
            select lang, k, list_aggregate(list_slice(w, i, i + k - 1), 'string_agg', ' ') as gram, sum(copies)::hugeint as f
            from (select lang, copies, w, k, unnest(range(1, len(w) - k + 2)) as i from words, (values (1), (2), (3)) as s(k)) group by all
        ), total as (select lang, sum(f)::bigint as n from grams where k = 1 group by lang
        ), phrases as (select *, string_split(gram, ' ') as w from grams where k > 1 and f >= 10
        ), cuts as (
            select p.lang, p.gram, p.k, p.f as a, c, l.f as l, r.f as r, 1000000 * p.f * p.f // (l.f * r.f) as score
            from (select *, unnest(range(1, k)) as c from phrases) p
            join grams l on l.lang = p.lang and l.gram = array_to_string(p.w[1:c], ' ')
            join grams r on r.lang = p.lang and r.gram = array_to_string(p.w[c + 1:], ' ')
        ), low as (select *, row_number() over (partition by lang, gram order by score, c) as place from cuts
        ), kept as (
            select * from low where place = 1 and not exists (
                select 1 from phrases b where b.lang = low.lang and b.k = 3 and low.k = 2 and 100 * b.f >= 50 * low.a
                and (array_to_string(b.w[1:2], ' ') = low.gram or array_to_string(b.w[2:3], ' ') = low.gram))
        ), ranked as (select *, row_number() over (partition by lang order by score desc, a desc, gram) as rank from kept)
        select lang, rank, gram as phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from ranked join total using (lang)
        where rank <= 2000""",
}
