"""Registered queries of the corpus operators, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import castore, codes, collocations, decontaminate, html, jaccard, lmscore, pieces, pii, substrings, suffixes, toxicity, vectors
from .common import table


def op1_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op5_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.report(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return castore.store_and_verify(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op9_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


def op10_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op12_suffix_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_host_suffix_array,
        op2_toxicity_chain,
        op3_benchmark_decontamination,
        op4_ngram_jaccard_join,
        op5_cross_entropy_difference,
        op6_sentencepiece,
        op7_token_store,
        op8_personal_data,
        op9_repeated_substrings,
        op10_embedding_near_duplicates,
        op11_vector_codes,
        op12_suffix_runs,
        op13_collocations,
    )
}


def _nearest_sql(k: int) -> str:
    """Every distinct part with the least of distance * 64 + entry."""
    return (
        f" a{k} as (select d.j, d.v, d.w, min(list_sum(list_transform(list_zip(d.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + c.e) m"
        f" from d join c{k} c on c.j = d.j group by d.j, d.v, d.w),"
    )


def _moved_sql(k: int) -> str:
    """The entries after a round: floors of sums by counts."""
    return (
        f" s{k} as (select j, m % 64 e, pos, sum(w * x) s, sum(w) n from (select j, m, w, unnest(v) x, generate_subscripts(v, 1) pos from a{k}) group by j, e, pos),"
        f" c{k + 1} as (select c.j, c.e, list(coalesce(cast((s - ((s % n) + n) % n) // n as bigint), x) order by c.pos) v"
        f" from (select j, e, unnest(v) x, generate_subscripts(v, 1) pos from c{k}) c left join s{k} using (j, e, pos) group by c.j, c.e),"
    )


_CODES = (
    "with k as (select vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) q from embeddings"
    " where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),"
    " p as (select vec_id, label, j, q[j * (len(q) // 16) + 1 : (j + 1) * (len(q) // 16)] v from k, (select unnest(range(16)) j)),"
    " d as (select j, v, count(*) w from p group by j, v),"
    " c0 as (select j, row_number() over (partition by j order by vec_id) - 1 e, v from p qualify e < 64),"
    + _nearest_sql(0) + _moved_sql(0) + _nearest_sql(1) + _moved_sql(1) + _nearest_sql(2)
    + " h as (select sha256(string_agg(array_to_string(v, ','), ',' order by j, e)) codebooks_sha256 from c2),"
    " t as (select vec_id, any_value(label) as label, string_agg(lpad(lower(to_hex(cast(m % 64 as bigint))), 2, '0'), '' order by p.j) code, cast(sum(m // 64) as bigint) error"
    " from p join a2 on a2.j = p.j and a2.v = p.v group by vec_id)"
    " select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) label_error, codebooks_sha256 from t, h"
)

_COLLOCATIONS = (
    "with t as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),"
    " w as (select lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') as ws from t),"
    " g as (select lang, len(ws) as size, unnest(ws) as w1, unnest(ws[2:]) as w2, unnest(ws[3:]) as w3, unnest(ws[4:]) as w4 from w),"
    " p as (select lang, w1 as p, 1 as m from g union all select lang, w1 || ' ' || w2, 2 from g where w2 is not null union all select lang, w1 || ' ' || w2 || ' ' || w3, 3 from g where w3 is not null union all select lang, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, 4 from g where w4 is not null),"
    " n as (select lang, count(*) as n from g group by lang),"
    " f as (select lang, string_split(p, ' ') as ws, p, m, count(*) as c from p group by lang, p, m having count(*) >= 30),"
    " cuts as (select lang, p, c as a, k, array_to_string(ws[1:k], ' ') as lp, array_to_string(ws[k+1:], ' ') as rp from f, (select unnest([1, 2, 3]) as k) where k < m),"
    " k as (select cuts.*, x.c as l, y.c as r, 2000000 * cast(a as hugeint) // (x.c + y.c) as score from cuts join f x on x.lang = cuts.lang and x.p = lp join f y on y.lang = cuts.lang and y.p = rp),"
    " b as (select * from k qualify row_number() over (partition by lang, p order by score, k) = 1),"
    " o as (select lang, array_to_string(ws[i:i + j - 1], ' ') as p, max(c) as longer from f, (select unnest([2, 3]) as j), (select unnest([1, 2, 3]) as i) where j < m and i + j - 1 <= m group by 1, 2),"
    " e as (select b.*, row_number() over (partition by b.lang order by score desc, a desc, b.p) as rank from b left join o on o.lang = b.lang and o.p = b.p where o.longer is null or 100 * o.longer < 80 * b.a)"
    " select e.lang, rank, p as phrase, a, l, r, n.n as n, cast(score as bigint) as score from e join n on n.lang = e.lang where rank <= 2000"
)

_SUFFIXES = (
    "with t as (select row_number() over () as row_no, doc_id, hex(encode(coalesce(text, ''))) as h from documents),"
    " w as (select row_no, i, md5_number(substr(h, 2 * i + 1, 800)) as m from (select row_no, h, unnest(range(0, len(h) // 2 - 399)) as i from t where len(h) >= 800)),"
    " d as (select row_no, i from (select row_no, i, count(*) over (partition by m) as c from w) where c > 1),"
    " b as (select row_no, i, sum(fresh) over (partition by row_no order by i) as run from (select row_no, i, case when i - lag(i) over (partition by row_no order by i) <= 400 then 0 else 1 end as fresh from d)),"
    " s as (select row_no, run, min(i) as lo, max(i) + 400 as hi from b group by row_no, run),"
    " k as (select row_no, lag(hi, 1, 0) over (partition by row_no order by lo) as lo, lo as hi from s union all select t.row_no, coalesce(max(s.hi), 0), len(any_value(t.h)) // 2 from t left join s on s.row_no = t.row_no group by t.row_no),"
    " r as (select k.row_no, string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' order by lo) as kept from k join t on t.row_no = k.row_no group by k.row_no),"
    " n as (select row_no, cast(sum(hi - lo) as bigint) as removed, count(*) as spans from s group by row_no)"
    " select doc_id, len(h) // 2 as n_bytes, coalesce(removed, 0) as n_removed, coalesce(spans, 0) as n_spans, sha256(unhex(kept)) as kept_sha256 from t join r on r.row_no = t.row_no left join n on n.row_no = t.row_no"
)

SQL: dict[str, str] = {"op11_vector_codes": _CODES, "op12_suffix_runs": _SUFFIXES, "op13_collocations": _COLLOCATIONS}
