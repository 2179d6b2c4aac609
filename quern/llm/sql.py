"""SQL that gives the rows of the found-queries by brute force."""

_OK = "len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding) and len(list_filter(embedding, lambda x: x <> 0)) > 0"
_TOKENS = r"coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+')), 0)"
_STRIP = r"regexp_replace(u, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
_SOURCE = r"lower(regexp_replace(source, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'))"


def _fits(units: str) -> str:
    return f"len(list_filter({units}, lambda u: length({_STRIP}) > 1600)) = 0"


SQL = {
    "p1_found": r"""with recursive c as (select id, max(text) as text from chunks where id is not null and text is not null group by id),
      w as (select id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from c),
      s as (select distinct id, unnest(list_transform(range(1, len(w)-1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) as g from w where len(w) >= 3),
      n as (select id, count(*) as n from s group by id),
      o as (select a.id as x, b.id as y, count(*) as o from s a join s b on a.g = b.g and a.id < b.id group by all),
      e as (select x, y from o join n p on p.id = x join n q on q.id = y where 2*o >= p.n + q.n - o),
      both_ways as (select x, y from e union select y, x from e),
      reach(a, b) as (select x, y from both_ways union select reach.a, both_ways.y from reach join both_ways on reach.b = both_ways.x)
      select distinct a as id_a, b as id_b from reach where a < b""",
    "p2_found": rf"""with c as (select id, max(text) as text from chunks where id is not null group by id having max(length(text)) > 1600)
      select id, case when {_fits(r"regexp_split_to_array(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n(?:[ \t\x{a0}\f\v]*\n)+')")} then 'paragraph' when {_fits(r"regexp_split_to_array(text, '\r\n|\n|\r')")} then 'line'
        when {_fits(r"regexp_split_to_array(regexp_replace(text, '([.!?])[\s\p{Z}]+', '\1' || chr(10), 'g'), '[\r\n]+')")} then 'sentence' when {_fits(r"regexp_split_to_array(text, '[\s\p{Z}]+')")} then 'word' else 'none' end as boundary from c""",
    "p3_found": f"""with v as (select distinct vec_id, model, embedding::double[] as e from embedding_responses where embedding is not null and len(embedding) = case model when 'lark-embed-m' then 64 when 'lark-embed-s' then 48 end and {_OK}),
      p as (select a.vec_id as a, b.vec_id as b, list_cosine_similarity(a.e, b.e) as cos from v a join v b on a.model = b.model and a.vec_id <> b.vec_id),
      r as (select *, row_number() over (partition by a order by cos desc, b) as r from p where cos >= 0.9)
      select distinct least(a, b) as vec_a, greatest(a, b) as vec_b from r where r <= 5""",
    "p4_found": r"""with c as (select id, max(text) as text, max(url) as url from chunks where id is not null group by id),
      s as (select id, text, regexp_extract(lower(url), '^\s*(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(?:www\.)?([^/?#:\s]+)', 1) as site from c),
      d as (select site, count(*) as n from s where site <> '' group by site),
      l as (select id, site, unnest(str_split(text, chr(10))) as line, generate_subscripts(str_split(text, chr(10)), 1) as line_no from s where site <> '' and text is not null),
      k as (select id, site, line_no, trim(regexp_replace(lower(line), '[\s\p{Z}]+', ' ', 'g')) as k from l),
      f as (select site, k from k where k <> '' group by site, k having count(distinct id) >= 5 and count(distinct id) >= 0.05 * (select n from d where d.site = k.site))
      select id, line_no from k join f using (site, k)""",
    "p6_found": f"select doc_id from documents where {_TOKENS} > 2048",
    "p7_found": f"""with t as (select {_SOURCE} as s, sum({_TOKENS}) as own from documents group by 1), m as (select source, {_SOURCE} as s, weight, max_repeats from mix_targets),
      j as (select m.*, coalesce(own, 0) as own from m left join t using (s)), x as (select sum(own) as total from (select distinct s, own from j))
      select distinct source from j, x where weight * total > max_repeats * own""",
}
