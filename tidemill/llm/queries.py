"""Registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import decontaminate, embedding_dedup, hard_negatives, language_id, ngram_join, packing, pseudonyms, quotation, sharding, substring_dedup, toxicity, url_filter, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quotation_linking": quotation.op1,
        "op2_feistel_pseudonyms": pseudonyms.op2,
        "op3_greedy_string_tiling": decontaminate.op3,
        "op4_virtual_slots": sharding.op4,
        "op5_language_spans": language_id.op5,
        "op6_super_kmer_dedup": substring_dedup.op6,
        "op7_ngram_jaccard_join": ngram_join.op7,
        "op8_compression_toxicity": toxicity.op8,
        "op9_subspace_pigeonhole": embedding_dedup.op9,
        "op10_nnls_packing": packing.op10,
        "op11_path_template_tree": url_filter.op11,
        "op12_bond_hard_negatives": hard_negatives.op12,
        "op13_lanczos_whitening": whitening.op13,
    }


#: Words of a text, of op6 and op7: runs of characters other than the six white space ones of ASCII.
_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

_OP6 = f"""with d as (select doc_id, row_number() over () as r, {_WORDS} as w from documents),
    starts as (select r, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35),
    windows as (select r, i, md5(array_to_string(w[i : i + 34], ' ')) as h from starts),
    repeated as (select r, i from windows join (select h from windows group by h having count(*) > 1) x using (h)),
    gone as (select distinct r, i + j as p from repeated, range(0, 35) t(j)),
    words as (select r, unnest(w) as word, generate_subscripts(w, 1) as p from d),
    kept as (select r, string_agg(word, ' ' order by p) as t from words anti join gone using (r, p) group by r)
    select doc_id, cast(len(w) as bigint) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
    from d left join kept using (r) left join (select r, count(*) as n from gone group by r) g using (r)"""

#: Pairs in `links` (a < b) and names in `nodes`: reach is which names reach which.
_REACH = """both_ways as (select a, b from links union all select b as a, a as b from links),
    reach as (select id as a, id as b from nodes union select reach.a, both_ways.b from reach join both_ways on reach.b = both_ways.a)"""

_OP7 = f"""with recursive d as (select doc_id, coalesce(text, '') as t, {_WORDS} as w from documents), nodes as (select doc_id as id from d),
    starts as (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0),
    shingles as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') as g from starts),
    sizes as (select doc_id, count(*) as n from shingles group by doc_id),
    shared as (select x.doc_id as a, y.doc_id as b, count(*) as m from shingles x join shingles y on x.g = y.g and x.doc_id < y.doc_id group by x.doc_id, y.doc_id),
    links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 5 * m >= 4 * (x.n + y.n - m)
      union select x.doc_id as a, y.doc_id as b from d x join d y on x.t = y.t and x.doc_id < y.doc_id),
    {_REACH}
    select doc_id, class_id, coalesce(n, 0) as n_links, doc_id = class_id as kept
    from d join (select a, min(b) as class_id from reach group by a) c on c.a = doc_id left join (select a, count(*) as n from both_ways group by a) l on l.a = doc_id"""

_OP9 = f"""with recursive v as (select vec_id, cast(embedding as double[]) as x from embeddings), nodes as (select vec_id as id from v),
    good as (select vec_id, x from v where x is not null and len([y for y in x if y is null or not isfinite(y)]) = 0 and len([y for y in x if y <> 0]) > 0),
    links as (select p.vec_id as a, q.vec_id as b from good p join good q on p.vec_id < q.vec_id and len(p.x) = len(q.x) where list_cosine_similarity(p.x, q.x) >= 0.9),
    {_REACH}
    select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
    from v join (select a, min(b) as component_id from reach group by a) c on c.a = vec_id left join (select a, count(*) as n from both_ways group by a) l on l.a = vec_id"""

_OP12 = """with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * cast(y as double)) for y in embedding] as x
      from embeddings where label is not null and embedding is not null and len([y for y in embedding if y is null or not isfinite(y)]) = 0),
    scored as (select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, cast(list_dot_product(a.x, b.x) as bigint) as score from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
    positive as (select anchor_id, other_id as positive_id, score as positive_score from scored where same qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5),
    negative as (select p.anchor_id, positive_id, cast(row_number() over (partition by p.anchor_id, positive_id order by score desc, other_id) as int) as rank, other_id as negative_id, positive_score, score as negative_score
      from positive p join scored s on s.anchor_id = p.anchor_id and not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
    select * from negative where rank <= 3"""


def oracle_sql() -> dict[str, str]:
    return {"op6_super_kmer_dedup": _OP6, "op7_ngram_jaccard_join": _OP7, "op9_subspace_pigeonhole": _OP9, "op12_bond_hard_negatives": _OP12}
