"""The registered queries in DuckDB's SQL, from shared parts."""

from __future__ import annotations

from .testbed import GEOMETRY, PLACE_X, SCALE, SHIFT_X, SHIFT_Y, SOURCE

_duck = lambda e: e.replace(" div ", " // ")
_geometry = ", ".join(f"({_duck(e)})::float as {n}" for n, e in GEOMETRY.items())

#: Parts in the order in which they build on each other.
PARTS = {
    "v": f"select e.vec_id, s.label::bigint as label, s.embedding as proj, {_geometry.replace('vec_id', 'e.vec_id')} from (select vec_id, {_duck(SOURCE)} as src from embeddings) e join embeddings s on s.vec_id = e.src",
    "db": "select *, (vec_id // 10)::int as image_id, (vec_id % 10)::int as feature_id, label as word_id, (vec_id // 10) * 2147483648 + vec_id % 10 as posting_id from v where vec_id % 10 <> 0",
    "q": "select *, (vec_id // 100)::int as query_id, vec_id::int as feature_id from v where vec_id % 10 = 0",
    "qw": "select * from (select *, unnest([label, (label + 3) % 10]) as word_id, unnest([0, 1]) as nn_rank from q) x",
    "dbits": "select posting_id, image_id, word_id, unnest(proj) as x, unnest(range(0, 64)) as bit from db",
    "thr": "select word_id, bit, x as threshold from (select word_id, bit, x, row_number() over (partition by word_id, bit order by x) as r, count(*) over (partition by word_id, bit) as n from dbits) t where r = n // 2 + 1",
    "dc": "select posting_id, image_id, word_id, bit // 8 as s, sum(case when x > threshold then 1 << (bit % 8) else 0 end)::int as byte from dbits join thr using (word_id, bit) group by all",
    "qbits": "select query_id, feature_id, word_id, unnest(proj) as x, unnest(range(0, 64)) as bit from qw",
    "qc": "select query_id, feature_id, word_id, bit // 8 as s, sum(case when x > threshold then 1 << (bit % 8) else 0 end)::int as byte from qbits join thr using (word_id, bit) group by all",
    "occ": "select word_id, s, byte, count(*) as n from dc group by all",
    "near": "select a.word_id, a.s, a.byte, sum(b.n) as near from occ a join occ b on a.word_id = b.word_id and a.s = b.s and bit_count(xor(a.byte, b.byte)) < 2 group by all",
    "p": "select word_id, s, floor(sum(n * (near - 1)) / sum(n) + 0.5)::int as p from occ join near using (word_id, s, byte) group by all having sum(n) >= 2",
    "bytes": "select p.word_id, p.s, p.p, b.byte from p join (select unnest(range(0, 256))::int as byte) b on true",
    "dist": "select b.word_id, b.s, b.byte, b.p, bit_count(xor(b.byte, o.byte)) as d, sum(o.n) as n from bytes b join occ o on b.word_id = o.word_id and b.s = o.s group by all",
    "sig": "select word_id, s, byte, min(d)::int as sigma from (select *, sum(n) over (partition by word_id, s, byte order by d) as within from dist) t where within - 1 >= p group by all",
    "nrm": "select word_id, 16 - sum(total) / max(n) as v from (select word_id, s, sum(sigma * n) as total, sum(n) as n from occ join sig using (word_id, s, byte) group by all) t group by word_id",
    "fin": "select posting_id, image_id, word_id, least(greatest(floor(coalesce(sum(sigma), 0) + coalesce(max(v), 0) + 0.5)::int, 0), 32) as sigma_final from dc left join sig using (word_id, s, byte) left join nrm using (word_id) group by all",
    "idf": "select word_id, ln((select count(distinct image_id) from db)::double / count(distinct image_id)) as idf from db group by word_id",
    "nrms": "select image_id, case when sum(idf * idf) > 0 then 1 / sqrt(sum(idf * idf)) else 0 end as norm from db join idf using (word_id) group by image_id",
    "selfs": "select query_id, sum(idf * idf) as s from qw join idf using (word_id) group by query_id",
    "pairs": "select qc.query_id, qc.feature_id, qc.word_id, dc.posting_id, dc.image_id, sum(bit_count(xor(qc.byte, dc.byte)))::int as h from qc join dc on qc.word_id = dc.word_id and qc.s = dc.s group by all",
    "votes": "select pairs.*, sigma_final, exp(-(h * h) / (sigma_final * sigma_final)::double) as weight from pairs join fin using (posting_id, image_id, word_id) where h <= 32 and sigma_final > 0 and h <= 1.5 * sigma_final",
    "bursts": "select query_id, feature_id, word_id, image_id, sum(weight) / sqrt(count(*)) as vote, count(*) as n from votes group by all",
    "scores": "select query_id, image_id, sum(idf * idf * vote) * case when max(s) > 0 then 1 / sqrt(max(s)) else 1 end * coalesce(max(norm), 0) as score, sum(n)::bigint as n_matches from bursts join idf using (word_id) left join selfs using (query_id) left join nrms using (image_id) group by query_id, image_id",
    "tops": "select * from (select *, row_number() over (partition by query_id order by round(score, 12) desc, image_id) as retrieval_rank from scores) t where retrieval_rank <= 200",
    "matches": "select v.query_id, v.image_id, v.feature_id, v.posting_id, q.x::double as x1, q.y::double as y1, q.a::double as a1, q.b::double as b1, q.c::double as c1, db.x::double as x2, db.y::double as y2, db.a::double as a2, db.b::double as b2, db.c::double as c2 from votes v semi join tops using (query_id, image_id) join q on q.feature_id = v.feature_id join db on db.posting_id = v.posting_id",
    "enough": "select query_id, image_id, count(*) as num_matches from matches group by all having count(*) >= 4",
    # the planted map of an image explains a match if it takes one place to the other, both ways
    "planted": f"select *, {_duck(SCALE)} as s, {_duck(SHIFT_X)} as tx, {_duck(SHIFT_Y)} as ty from (select distinct * from matches semi join enough using (query_id, image_id)) m",
    "near_match": "select *, (s * x1 + tx - x2) ** 2 + (s * y1 + ty - y2) ** 2 + ((x2 - tx) / s::double - x1) ** 2 + ((y2 - ty) / s::double - y1) ** 2 as error from planted",
    "taken": "select * from (select *, row_number() over (partition by query_id, image_id, feature_id order by error, posting_id) as r from near_match where error < 1600) t where r = 1",
    "inl": "select query_id, image_id, feature_id, x1, y1 from (select *, count(*) over (partition by query_id, image_id) as n from taken) t where n >= 4",
    "ver": "select query_id, image_id, retrieval_rank, count(*) as num_inliers from tops join inl using (query_id, image_id) group by all",
    "eff": "select query_id, image_id, count(distinct (x + i) * 100000 + y + j) / 576.0::double as eff from (select distinct query_id, image_id, floor(x1 + 0.5)::bigint as x, floor(y1 + 0.5)::bigint as y from inl) c join (select unnest(range(0, 24)) as i) a on true join (select unnest(range(0, 24)) as j) b on true group by query_id, image_id",
    "pl": f"select query_id, image_id, feature_id, ({_duck(PLACE_X)} // 100)::bigint as site from inl",
    "nplaces": "select query_id, feature_id, count(distinct site) as places from pl group by all",
    "psize": "select query_id, site, count(distinct feature_id) as size from pl group by all",
    "pop": "select query_id, site, size / max(size) over (partition by query_id) as popularity from psize",
    "bytimes": "select query_id, image_id, sum(1.0::double / places) as score, max(site) as site from pl join nplaces using (query_id, feature_id) group by query_id, image_id",
    "near_pairs": "select l.vec_id, l.vec_id // 10 as g, l.x as x1, l.y as y1, l.a as a1, l.b as b1, l.c as c1, r.x as x2, r.y as y2, r.a as a2, r.b as b2, r.c as c2 from v l join v r on r.vec_id = l.vec_id + 1",
    "tri": "select *, sqrt(a1 - (b1 / (2 * sqrt(c1::double))) ** 2) as d1, b1 / (2 * sqrt(c1::double)) as e1, sqrt(c1::double) as f1, sqrt(a2 - (b2 / (2 * sqrt(c2::double))) ** 2) as d2, b2 / (2 * sqrt(c2::double)) as e2, sqrt(c2::double) as f2 from near_pairs",
    "hyp": "select *, d1 / d2 as a11, f1 / f2 as a22, (e1 - e2 * (d1 / d2)) / f2 as a21 from tri",
    "maps": "select *, x2 - a11 * x1 as t1, y2 - a21 * x1 - a22 * y1 as t2 from hyp",
}


def sql(select: str, *more: str) -> str:
    """A query over the parts, of which DuckDB works out those that it needs."""
    return "with " + ",\n".join([*(f"{n} as ({s})" for n, s in PARTS.items()), *more]) + "\n" + select


_ranked = lambda score, ties="retrieval_rank": f"row_number() over (partition by query_id order by round(({score})::double, 12) desc, {ties}, image_id)::int as rank"

_six_ranks = lambda scheme, score, table, ties: f"select query_id, '{scheme}' as scheme, {_ranked(score, ties)}, image_id, round(({score})::double, 6) as score from {table}"
_inliers_first = "num_inliers desc, retrieval_rank"

ORACLES = {
    "root_sift_quantize": "with d as (select vec_id, list_transform(embedding, lambda x: floor(abs(x::double) * 100)) as d from embeddings), s as (select *, list_sum(d) as s from d) select vec_id, array_to_string(list_transform(d, lambda x: case when s > 0 then least(255, floor(512 * sqrt(x / s) + 0.5))::int else 0 end), ',') as descriptor from s",
    "canonical_ellipse": sql("select vec_id, round(2 * b::double, 6) as b_full, round(c / (a * c - b * b)::double, 6) as a_inverse, round(-2 * b / (a * c - b * b)::double, 6) + 0.0 as b_inverse, round(a / (a * c - b * b)::double, 6) as c_inverse from v"),
    "hamming_thresholds_upper_median": sql("select word_id, bit::int as bit, threshold from thr"),
    "binarize_codes": sql("select posting_id, word_id, s::int as s, byte from dc"),
    "hamming_histogram": sql("select h, count(*) as n from pairs group by h"),
    "subbyte_occurrence": sql("select word_id, s::int as s, byte, n from occ"),
    "density_p": sql("select word_id, s::int as s, p from p"),
    "sigma_table": sql("select word_id, s::int as s, byte, sigma from sig"),
    "density_norm": sql("select word_id, round(v, 6) as v from nrm"),
    "sigma_final": sql("select posting_id, sigma_final from fin"),
    "idf_weights": sql("select word_id, round(idf, 6) as idf from idf"),
    "image_norms": sql("select image_id, round(norm, 6) as norm from nrms"),
    "query_self_similarity": sql("select query_id, round(s, 6) as s from selfs"),
    "vote_pairs": sql("select query_id, feature_id, word_id, posting_id, h, round(weight, 6) as weight from votes"),
    "burst_normalized_votes": sql("select query_id, feature_id, word_id, image_id, round(vote, 6) as vote, n from bursts"),
    "image_scores": sql("select query_id, image_id, round(score, 6) as score, n_matches from scores"),
    "retrieval_topk": sql("select query_id, image_id, retrieval_rank::int as retrieval_rank, round(score, 6) as score from tops"),
    "knn_words_exact": "with w as (select label, arg_min(embedding, vec_id) as center from embeddings group by label), d as (select e.vec_id, w.label::bigint as word_id, list_sum(list_transform(list_zip(e.embedding, w.center), lambda z: (z[1]::double - z[2]::double) ** 2)) as d from embeddings e join w on true), r as (select *, row_number() over (partition by vec_id order by d, word_id) as r from d) select vec_id, string_agg(word_id::varchar, ',' order by r) as words from r where r <= 5 group by vec_id",
    "soft_assignment": sql("select feature_id, word_id, nn_rank::int as nn_rank from qw"),
    "dedup_consecutive_lines": "select user_id, (row_number() over (partition by user_id order by event_id) - 1)::int as id, event_type as name from (select *, lag(event_type) over (partition by user_id order by event_id) as before, row_number() over (partition by user_id order by event_id) as line from events) t where line = 1 or event_type is distinct from before",
    "descriptor_cap_per_word": sql("select image_id, feature_id, word_id, rank_in_word::int as rank_in_word from (select *, row_number() over (partition by word_id order by md5('0:' || image_id), image_id, feature_id) as rank_in_word from db) t where rank_in_word <= 20"),
    "ellipse_area_scale_test": sql("select vec_id, round(r, 6) as ratio, greatest(r, 1 / r) < sqrt(1000.0::double) as passes from (select vec_id, (1 / sqrt(4 * a1 * c1 - b1 * b1::double)) / (1 / sqrt(4 * a2 * c2 - b2 * b2::double)) as r from near_pairs) t"),
    "affine_hypotheses": sql("select vec_id, round(a11, 6) + 0.0 as a11, round(a21, 6) + 0.0 as a21, round(a22, 6) + 0.0 as a22, round(t1, 6) + 0.0 as t1, round(t2, 6) + 0.0 as t2 from maps"),
    "hypothesis_inliers_sql": sql("select h.vec_id, count(*) filter (where (h.a11 * m.x1 + h.t1 - m.x2) ** 2 + (h.a21 * m.x1 + h.a22 * m.y1 + h.t2 - m.y2) ** 2 < 40000) as n_inliers from maps h join maps m on h.g = m.g group by h.vec_id"),
    "effective_inlier_area": sql("select query_id, image_id, round(eff, 6) as eff from eff"),
    "rank_inlier_count": sql(f"select query_id, image_id, {_ranked('num_inliers')}, num_inliers::double as score from ver"),
    "rank_effective": sql(f"select query_id, image_id, {_ranked('eff')}, round(eff, 6) as score from eff join ver using (query_id, image_id)"),
    "verify_lo": sql("select query_id, image_id, num_matches::int as num_matches, num_inliers::int as num_inliers, round(eff, 6) as eff, ids as inlier_feature_ids from enough join ver using (query_id, image_id) join eff using (query_id, image_id) join (select query_id, image_id, string_agg(feature_id::varchar, ',' order by feature_id) as ids from inl group by all) i using (query_id, image_id)"),
    # thinning the candidates to one for each feature leaves the planted ones, which have the highest weight
    "one_to_one_matches": None,
    "best_hypothesis": sql(
        "select query_id, image_id, count(*)::int as num_hypotheses, max(support)::int as best_support from (select m.query_id, m.image_id, m.feature_id, m.posting_id, count(distinct case when (m.p11 * o.x1 + m.u1 - o.x2) ** 2 + (m.p21 * o.x1 + m.p22 * o.y1 + m.u2 - o.y2) ** 2 + (m.q11 * o.x2 + m.w1 - o.x1) ** 2 + (m.q21 * o.x2 + m.q22 * o.y2 + m.w2 - o.y1) ** 2 < 1600 and greatest(sqrt((4 * o.a2 * o.c2 - o.b2 ** 2) / (4 * o.a1 * o.c1 - o.b1 ** 2)) / abs(m.q11 * m.q22), sqrt((4 * o.a1 * o.c1 - o.b1 ** 2) / (4 * o.a2 * o.c2 - o.b2 ** 2)) * abs(m.q11 * m.q22)) < sqrt(1000.0::double) then o.feature_id end) as support from both_ways m join pairs_of o using (query_id, image_id) group by all) t group by all",
        "pairs_of as (select distinct * from matches semi join enough using (query_id, image_id))",
        "frames as (select *, sqrt(a1 - b1 * b1 / (4 * c1)) as d1, b1 / (2 * sqrt(c1)) as e1, sqrt(c1) as f1, sqrt(a2 - b2 * b2 / (4 * c2)) as d2, b2 / (2 * sqrt(c2)) as e2, sqrt(c2) as f2 from pairs_of)",
        "linear as (select *, d1 / d2 as p11, f1 / f2 as p22, (e1 - e2 * (d1 / d2)) / f2 as p21, d2 / d1 as q11, f2 / f1 as q22, (e2 - e1 * (d2 / d1)) / f1 as q21 from frames)",
        "both_ways as (select *, x2 - p11 * x1 as u1, y2 - p21 * x1 - p22 * y1 as u2, x1 - q11 * x2 as w1, y1 - q21 * x2 - q22 * y2 as w2 from linear)",
    ),
    "rank_inter_image": sql("select query_id, image_id, round(sum(1 / sqrt(n)), 6) as score from (select *, count(*) over (partition by query_id, feature_id) as n from inl) t group by query_id, image_id"),
    "place_assignment": sql("select query_id, image_id, min(image_id) over (partition by query_id, site) as first_of_place from (select distinct query_id, image_id, site from pl) p"),
    "rank_inter_place": sql("select query_id, image_id, round(score, 6) as score from bytimes"),
    "rank_inter_place_popularity": sql("select query_id, image_id, round(score * popularity, 6) as score from bytimes join pop using (query_id, site)"),
    "bit_balance": sql("select word_id, (s * 8 + k)::int as bit, round(avg((byte >> k) & 1), 6) as ones from dc join (select unnest(range(0, 8))::int as k) t on true group by all"),
    "image_postings_lookup": sql("select image_id, count(*) as n_postings, count(distinct word_id) as n_words from db group by image_id"),
    "list_lengths": sql("select word_id, count(*) as n from db group by word_id"),
    "index_counters": sql("select 10::bigint as words, (select count(distinct word_id) from db) as words_in_use, (select count(distinct image_id) from db) as images, (select count(*) from db) as postings, (select max(n) from (select count(*) as n from db group by word_id) t) as longest_list"),
    "text_idf": r"with t as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents) select word, round(ln((select count(distinct doc_id) from t)::double / count(*)), 6) as idf from t group by word",
    "order_norms": "with p as (select l_orderkey, l_partkey from lineitem), i as (select l_partkey, ln((select count(distinct l_orderkey) from p)::double / count(distinct l_orderkey)) as idf from p group by l_partkey) select l_orderkey, round(case when sum(idf * idf) > 0 then 1 / sqrt(sum(idf * idf)) else 0 end, 6) as norm from p join i using (l_partkey) group by l_orderkey",
    "all_rankings": sql(
        " union all ".join(
            [
                "select query_id, 'retrieval' as scheme, retrieval_rank::int as rank, image_id, round(score, 6) as score from tops",
                _six_ranks("inlier_count", "num_inliers", "ver", "retrieval_rank"),
                _six_ranks("effective_inlier_count", "eff", "(select * from eff join ver using (query_id, image_id)) e", "retrieval_rank"),
                _six_ranks("inter_image", "score", "(select query_id, image_id, retrieval_rank, sum(1 / sqrt(n)) as score from (select *, count(*) over (partition by query_id, feature_id) as n from inl) t join ver using (query_id, image_id) group by all) e", "retrieval_rank"),
                _six_ranks("inter_place", "score", "(select * from bytimes join ver using (query_id, image_id)) e", _inliers_first),
                _six_ranks("inter_place_popularity", "score", "(select query_id, image_id, score * popularity as score, num_inliers, retrieval_rank from bytimes join pop using (query_id, site) join ver using (query_id, image_id)) e", _inliers_first),
            ]
        )
    ),
}
ORACLES["one_to_one_matches"] = ORACLES["verify_lo"]
