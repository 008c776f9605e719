"""DuckDB SQL of the queries, over the same tables.

Shared steps are common table expressions, put in front of a query in the order of `_STEPS`
where its text names them.
"""

from __future__ import annotations

import re

# Fixed values of the token space, written out for SQL and not taken from the code under test.
_JUNK = r"""^[\s\-–—<>#*~^|/\\.,;:!+=_''"()\[\]{}]+|[\s\-–—<>#*~^|/\\;:!+=_''"]+$"""
_NOISE = "private limited ltd pvt inc incorporated corporation corp company co llc llp lp plc opc sarl sasu eurl sas sa sci snc the and of"
_SPELLED = (
    "n north s south e east w west ne northeast nw northwest se southeast sw southwest "
    "rd road st street str street ave avenue av avenue dr drive blvd boulevard bd boulevard ln lane ct court cir circle pl place sq square ter terrace "
    "hwy highway pkwy parkway trl trail apt apartment ste suite bldg building flr floor fl floor rm room dept department pob po "
    "no number nos number hno number dno number khno number plotno number doorno number sn survey opp opposite nr near bldng building mkt market"
)
_CAP = 0.02
_TOKENS = "regexp_extract_all({}, '[\\p{{L}}\\p{{N}}]+')"
_DBA = "(?i)\\b(?:d\\s*/?\\s*b\\s*/?\\s*a|doing\\s+business\\s+as|trading\\s+as|t\\s*/\\s*a|formerly|aka|a\\s*/\\s*k\\s*/\\s*a)\\b"
_LATIN = "replace(replace(replace(replace(strip_accents({}), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'ø', 'o')"


def _junk(x: str) -> str:
    return f"regexp_replace({x}, '{_JUNK}', '', 'g')"


def _trade(x: str) -> str:
    tail = f"trim(regexp_split_to_array({x}, '{_DBA}')[-1])"
    return f"CASE WHEN regexp_matches({x}, '{_DBA}') AND {tail} <> '' THEN {tail} ELSE {x} END"


def _ordinals(x: str) -> str:
    return f"regexp_replace({x}, '(?i)\\b(\\d+)(?:st|nd|rd|th)\\b', '\\1', 'g')"


def _clean_name(x: str) -> str:
    return _trade(f"regexp_replace({_junk(x)}, '(?i)^\\s*m\\s*/\\s*s\\.?\\s+', '')")


def _name_tokens(folded: str) -> str:
    domain = "(?i)^([a-z0-9][a-z0-9\\-]*)\\.(?:com|net|org|co|in|io|biz|info|fr|us|co\\.in|co\\.uk)$"
    label = f"regexp_extract(trim({folded}), '{domain}', 1)"
    return _TOKENS.format(_ordinals(f"(CASE WHEN {label} <> '' THEN {label} ELSE {folded} END)"))


def _core(tokens: str) -> str:
    return f"list_filter({tokens}, lambda t: NOT list_contains(string_split('{_NOISE}', ' '), t))"


def _canon(x: str) -> str:
    return f"regexp_replace({x}, '(^|[^0-9])0+([0-9])', '\\1\\2', 'g')"


def _addr_tokens(folded: str) -> str:
    words = _SPELLED.split()
    spelled = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in zip(words[::2], words[1::2])) + "}"
    return f"list_transform(list_transform({_TOKENS.format(_ordinals(folded))}, lambda t: {_canon('t')}), lambda t: coalesce({spelled}[t], t))"


def _grams(x: str, sizes=(3, 4)) -> str:
    each = [f"list_transform(range(1, len(c) - {n - 2}), lambda i: {' || '.join(f'c[i + {j}]' for j in range(n))})" for n in sizes]
    return f"list_transform([string_split(regexp_replace({x}, '\\s+', '', 'g'), '')], lambda c: list_distinct(list_concat({', '.join(each)})))[1]"


def _jaccard(a: str, b: str) -> str:
    both = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {both} > 0 THEN len(list_intersect({a}, {b})) / {both} ELSE 0.0 END"


def _jaccard_or_null(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) > 0 THEN {_jaccard(a, b)} END"


def _f(p: str, t: str, h: str) -> str:
    return f"CASE WHEN {p} = 0 AND {t} = 0 THEN 1.0 WHEN {p} = 0 OR {t} = 0 OR {h} = 0 THEN 0.0 ELSE 1.25 * ({h} / {p}) * ({h} / {t}) / (0.25 * ({h} / {p}) + {h} / {t}) END"


def _vocab(postings: str, cap: float | None) -> str:
    kept = "" if cap is None else f" WHERE df <= greatest(1.0, {cap} * n)"
    return f"""SELECT country, view, token, df, ln(1 + n / df) AS idf FROM (SELECT country, view, token, count(*) AS df FROM {postings} GROUP BY ALL)
  JOIN (SELECT country, view, count(DISTINCT id) AS n FROM {postings} GROUP BY ALL) USING (country, view){kept}"""


def _weights(postings: str, vocab: str) -> str:
    return f"SELECT country, view, id, token, idf / sqrt(sum(idf * idf) OVER (PARTITION BY country, view, id)) AS w FROM {postings} JOIN {vocab} USING (country, view, token)"


def _scores(q: str, e: str) -> str:
    return f"SELECT a.country, a.view, a.id AS record_id, b.id AS entity_id, round(sum(a.w * b.w), 6) AS score FROM {q} a JOIN {e} b USING (country, view, token) GROUP BY ALL"


def _top(scores: str, k: int) -> str:
    return f"SELECT country, view, record_id, entity_id, score, CAST(rn - 1 AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY country, view, record_id ORDER BY score DESC, entity_id) AS rn FROM {scores}) WHERE rn <= {k}"


_STEPS = {
    "recs": "SELECT 'S' || (doc_id % 3 + 1) || '-' || doc_id AS id, CAST(doc_id % 3 + 1 AS INT) AS source, lang AS country, split_part(text, chr(10), 1) AS name, substr(text, length(split_part(text, chr(10), 1)) + 2) AS address, text FROM documents",
    "ents": "SELECT id AS entity_id, country FROM recs WHERE source = 1",
    "firsts": "SELECT country, lower(text) AS key, min(id) AS entity_id FROM recs WHERE source = 1 GROUP BY ALL",
    "truth": "SELECT r.id AS record_id, f.entity_id FROM recs r JOIN firsts f ON r.country = f.country AND lower(r.text) = f.key WHERE r.source > 1",
    "posts": f"SELECT country, 'words' AS view, id, source, unnest(list_distinct({_TOKENS.format('lower(text)')})) AS token FROM recs",
    "posts_e": "SELECT * FROM posts WHERE source = 1",
    "posts_q": "SELECT * FROM posts WHERE source > 1",
    "voc": _vocab("posts_e", _CAP),
    "w_e": _weights("posts_e", "voc"),
    "w_q": _weights("posts_q", "voc"),
    "scored": _scores("w_q", "w_e"),
    "cands": _top("scored", 5),
    "cands10": _top("scored", 10),
    "cands2": "SELECT * FROM cands WHERE rank < 2",
    "places": "SELECT *, row_number() OVER (PARTITION BY country, record_id ORDER BY score DESC, entity_id) AS place FROM cands",
    "decs": "SELECT country, record_id, max(entity_id) FILTER (place = 1) AS entity_id, max(score) FILTER (place = 1) AS probability, round(max(score) FILTER (place = 1) - coalesce(max(score) FILTER (place = 2), 0), 6) AS margin FROM places GROUP BY country, record_id",
    "acc": "SELECT * FROM decs WHERE probability >= 0.5",
    "own": "SELECT entity_id, count(DISTINCT record_id) AS n FROM truth GROUP BY 1",
    "cnts": "SELECT e.entity_id, CAST(coalesce(p.predicted, 0) AS BIGINT) AS predicted, CAST(coalesce(p.hits, 0) AS BIGINT) AS hits, CAST(coalesce(o.n, 0) AS BIGINT) AS \"true\" FROM ents e LEFT JOIN own o USING (entity_id) LEFT JOIN (SELECT a.entity_id, count(*) AS predicted, count(t.record_id) AS hits FROM acc a LEFT JOIN truth t USING (record_id, entity_id) GROUP BY 1) p USING (entity_id)",
    "fates": "SELECT t.record_id, t.entity_id, CASE WHEN d.entity_id IS NULL THEN 'a_not_retrieved' WHEN d.entity_id <> t.entity_id THEN 'b_wrong_top1' WHEN d.probability < 0.5 THEN 'c_below_threshold' ELSE 'ok' END AS fate FROM truth t LEFT JOIN decs d USING (record_id)",
    "folded": f"SELECT *, lower({_LATIN.format(_clean_name('name'))}) AS fn, lower({_LATIN.format(_junk('address'))}) AS fa, lower(strip_accents({_clean_name('name')})) AS pn, lower(strip_accents({_junk('address')})) AS pa FROM recs",
    "tok": f"SELECT id, source, country, name, address, fa, {_core(_name_tokens('pn'))} AS pcore, {_addr_tokens('pa')} AS paddr, {_core(_name_tokens('fn'))} AS core, {_addr_tokens('fa')} AS addr, list_filter(string_split(fa, ','), lambda p: trim(p) <> '') AS parts FROM folded",
    "prs": f"SELECT *, list_distinct(list_filter(addr, lambda t: regexp_matches(t, '\\d'))) AS numbers, list_distinct(flatten(list_transform(parts[greatest(len(parts) - 2, 1):], lambda p: {_addr_tokens('p')}))) AS spots, array_to_string(core, ' ') AS nj, array_to_string(addr, ' ') AS aj FROM tok",
    "gram": f"SELECT id, source, country, name, address, core, addr, pcore, paddr, numbers, nj, aj, {_grams('nj')} AS ng, {_grams('aj')} AS ag FROM prs",
    "sided": "SELECT c.country, c.record_id, c.entity_id, {'name': l.name, 'address': l.address, 'core': l.core, 'pcore': l.pcore, 'paddr': l.paddr, 'addr': l.addr, 'numbers': l.numbers, 'nj': l.nj, 'aj': l.aj, 'ng': l.ng, 'ag': l.ag} AS l, {'name': r.name, 'address': r.address, 'core': r.core, 'pcore': r.pcore, 'paddr': r.paddr, 'addr': r.addr, 'numbers': r.numbers, 'nj': r.nj, 'aj': r.aj, 'ng': r.ng, 'ag': r.ag} AS r FROM cands2 c JOIN gram l ON l.id = c.record_id JOIN gram r ON r.id = c.entity_id",
    "vposts": "SELECT country, 'name' AS view, id, source, unnest(list_distinct(list_transform(core, lambda t: 'n:' || t))) AS token FROM prs UNION ALL SELECT country, 'address', id, source, unnest(list_distinct(list_concat(list_transform(addr, lambda t: 'a:' || t), list_transform(numbers, lambda t: 'd:' || t)))) FROM prs",
    "vposts_e": "SELECT * FROM vposts WHERE source = 1",
    "vposts_q": "SELECT * FROM vposts WHERE source > 1",
    "vvoc": _vocab("vposts_e", _CAP),
    "vw_e": _weights("vposts_e", "vvoc"),
    "vw_q": _weights("vposts_q", "vvoc"),
    "vscored": _scores("vw_q", "vw_e"),
    "vtop": _top("vscored", 5),
    "vuni": "SELECT country, record_id, entity_id, CAST(coalesce(min(rank) FILTER (view = 'name'), 99) AS INT) AS rank_name, coalesce(max(score) FILTER (view = 'name'), 0.0) AS score_name, CAST(coalesce(min(rank) FILTER (view = 'address'), 99) AS INT) AS rank_address, coalesce(max(score) FILTER (view = 'address'), 0.0) AS score_address, min(rank) AS rank_best, max(score) AS score_best FROM vtop GROUP BY ALL",
    "numbered": "SELECT *, (TRY_CAST(regexp_extract(id, '(\\d{1,9})$', 1) AS BIGINT) * 2654435761) % 4294967296 AS hash FROM recs",
    "held": "SELECT id, country, CASE WHEN row_number() OVER (PARTITION BY country ORDER BY hash, id) <= round_even(count(*) OVER (PARTITION BY country) * 0.18, 0) THEN 'valid' ELSE 'train' END AS split FROM numbered WHERE source = 1",
    "keys": "SELECT id, country, unnest([{'key': 'addr_set', 'value': nullif(array_to_string(list_sort(addr), ' '), '')}, {'key': 'addr_words', 'value': nullif(array_to_string(list_sort(list_filter(addr, lambda t: NOT regexp_matches(t, '\\d'))), ' '), '')}, {'key': 'numbers', 'value': nullif(array_to_string(list_sort(numbers), ' '), '')}, {'key': 'name_core', 'value': nullif(array_to_string(list_sort(core), ' '), '')}, {'key': 'name_numbers', 'value': CASE WHEN len(core) > 0 AND len(numbers) > 0 THEN array_to_string(list_sort(core), ' ') || '|' || array_to_string(list_sort(numbers), ' ') END}, {'key': 'numbers_locality', 'value': CASE WHEN len(numbers) > 0 THEN array_to_string(list_sort(numbers), ' ') || '|' || coalesce(list_sort(addr)[-1], '') END}], recursive := true) FROM prs",
}

_SWEEP = "SELECT CAST(t AS DOUBLE) AS threshold, CAST(m AS DOUBLE) AS margin FROM (SELECT unnest([0.2, 0.4, 0.5, 0.6, 0.8, 1.0]) AS t), (SELECT unnest([0.0, 0.05]) AS m)"
_FEATURES = {
    "name_jaccard": _jaccard("l.core", "r.core"),
    "name_trigram_jaccard": _jaccard("l.ng", "r.ng"),
    "name_acronym_match": "CASE WHEN len(l.core) > 0 AND array_to_string(list_transform(l.core, lambda t: substr(t, 1, 1)), '') = array_to_string(list_transform(r.core, lambda t: substr(t, 1, 1)), '') THEN 1.0 ELSE 0.0 END",
    "name_len_ratio": "CASE WHEN length(l.nj) > 0 AND length(r.nj) > 0 THEN least(length(l.nj), length(r.nj)) / greatest(length(l.nj), length(r.nj)) ELSE 0.0 END",
    "name_either_empty": "CASE WHEN trim(l.name) = '' OR trim(r.name) = '' THEN 1.0 ELSE 0.0 END",
    "addr_jaccard": _jaccard("l.addr", "r.addr"),
    "addr_trigram_jaccard": _jaccard("l.ag", "r.ag"),
    "addr_len_ratio": "CASE WHEN length(l.aj) > 0 AND length(r.aj) > 0 THEN least(length(l.aj), length(r.aj)) / greatest(length(l.aj), length(r.aj)) ELSE 0.0 END",
    "num_jaccard": _jaccard("l.numbers", "r.numbers"),
    "num_shared": "CAST(len(list_intersect(l.numbers, r.numbers)) AS DOUBLE)",
    "num_conflict": "CASE WHEN len(l.numbers) > 0 AND len(r.numbers) > 0 AND len(list_intersect(l.numbers, r.numbers)) = 0 THEN 1.0 ELSE 0.0 END",
    "num_either_missing": "CASE WHEN len(l.numbers) > 0 AND len(r.numbers) > 0 THEN 0.0 ELSE 1.0 END",
    "addr_either_empty": "CASE WHEN trim(l.address) = '' OR trim(r.address) = '' THEN 1.0 ELSE 0.0 END",
    "addr_both_empty": "CASE WHEN trim(l.address) = '' AND trim(r.address) = '' THEN 1.0 ELSE 0.0 END",
}

_SIGNALS = {
    "name_jaccard": _jaccard_or_null("l.pcore", "r.pcore"),
    "name_jaccard_romanized": _jaccard_or_null("l.core", "r.core"),
    "addr_jaccard": _jaccard_or_null("l.paddr", "r.paddr"),
    "addr_jaccard_romanized": _jaccard_or_null("l.addr", "r.addr"),
    "addr_numeric_jaccard": _jaccard_or_null("l.numbers", "r.numbers"),
    "addr_empty_either": "CASE WHEN trim(l.address) = '' OR trim(r.address) = '' THEN 1.0 ELSE 0.0 END",
}
_REPORT = "SELECT round(avg(f), 6) AS macro_f, round(avg(f) FILTER (\"true\" = 0), 6) AS macro_f_singletons, round(avg(f) FILTER (\"true\" > 0), 6) AS macro_f_matched, count(*) FILTER (\"true\" = 0) AS n_singletons, count(*) FILTER (\"true\" > 0) AS n_matched, coalesce(round(sum(hits) / nullif(sum(predicted), 0), 6), 0.0) AS micro_precision, coalesce(round(sum(hits) / nullif(sum(\"true\"), 0), 6), 0.0) AS micro_recall FROM (SELECT *, CAST(" + _f("predicted", '"true"', "hits") + " AS DOUBLE) AS f FROM {})"

_QUERIES = {
    "flagship_cosine_topk": f"WITH v1 AS ({_vocab('posts_e', None)}), q1 AS ({_weights('posts_q', 'v1')}), e1 AS ({_weights('posts_e', 'v1')}), s1 AS ({_scores('q1', 'e1')}) SELECT country, record_id, entity_id, score, rank FROM ({_top('s1', 5)})",
    "tokenize_names": f"SELECT id, array_to_string(t, ' ') AS tokens, array_to_string({_core('t')}, ' ') AS core FROM (SELECT id, {_name_tokens('lower(n)')} AS t FROM (SELECT id, {_clean_name('text')} AS n FROM recs))",
    "canon_numbers": f"SELECT c_custkey, {_canon('lower(c_name)')} AS canon FROM customer",
    "abbrev_address": f"SELECT id, array_to_string({_addr_tokens('lower(a)')}, ' ') AS tokens FROM (SELECT id, {_junk('text')} AS a FROM recs)",
    "dba_tail": f"SELECT p_partkey, {_trade('x')} AS name FROM (SELECT p_partkey, p_name || [' d/b/a ', ' doing business as ', ' T/A ', ' aka ', ' and '][p_partkey % 5 + 1] || p_brand AS x FROM part)",
    "ordinal_strip": f"SELECT p_partkey, {_ordinals('x')} AS text FROM (SELECT p_partkey, p_brand || ' ' || p_size || ['st', 'ND', 'Rd', 'th', 'xx'][p_size % 5 + 1] || ' floor' AS x FROM part)",
    "non_latin_flag": "SELECT id, regexp_matches(text, '[^\\x00-\\x7F]') AS non_latin FROM recs",
    "numeric_keys": f"SELECT c_custkey, array_to_string(list_sort(list_distinct(list_filter({_TOKENS.format('x')}, lambda t: regexp_matches(t, '[0-9]')))), ' ') AS numbers FROM (SELECT c_custkey, lower(c_name || ' ' || c_mktsegment || ' ' || c_nationkey) AS x FROM customer)",
    "fold_accents": "SELECT id, lower(strip_accents(text)) AS folded FROM recs",
    "romanised_names": f"SELECT id, lower({_LATIN.format('text')}) AS latin FROM recs",
    "char_ngram_df": f"SELECT country, gram, count(*) AS df FROM (SELECT country, unnest({_grams('lower(text)')}) AS gram FROM recs WHERE source = 1) GROUP BY ALL HAVING count(*) >= 3",
    "token_df_idf": f"SELECT country, token, df, round(idf, 6) AS idf FROM ({_vocab('posts_e', 1.0)})",
    "df_cap_sweep": "SELECT cap, country, count(*) AS tokens, max(df) AS longest, CAST(sum(df) AS BIGINT) AS postings FROM (SELECT country, token, count(*) AS df FROM posts_e GROUP BY ALL) JOIN (SELECT country, count(DISTINCT id) AS n FROM posts_e GROUP BY 1) USING (country), (SELECT unnest([0.002, 0.02, 0.1, 0.5, 1.0])::DOUBLE AS cap) WHERE df <= greatest(1.0, cap * n) GROUP BY ALL",
    "composite_keys": "SELECT id, array_to_string(list_sort(list_distinct(list_concat(list_transform(addr, lambda t: 'a:' || t), list_transform(numbers, lambda t: 'd:' || t), list_transform(core, lambda t: 'n:' || t), flatten(list_transform(list_sort(numbers)[1:4], lambda d: list_transform(list_sort(spots)[1:6], lambda p: 'c:' || d || '|' || p)))))), ' ') AS keys FROM prs",
    "exact_key_coverage": "SELECT a.key, count(*) AS links, count(*) FILTER (a.value = b.value) AS equal, round(count(*) FILTER (a.value = b.value) / count(*), 6) AS coverage FROM truth t JOIN keys a ON a.id = t.record_id JOIN keys b ON b.id = t.entity_id AND a.key = b.key GROUP BY 1",
    "exact_key_selectivity": "SELECT key, CAST(sum(v) AS BIGINT) AS records, count(*) AS buckets, round(count(*) FILTER (v = 1) / count(*), 6) AS unique_share, round(sum(v * v) / sum(v), 6) AS expected_size FROM (SELECT key, value, count(*) AS v FROM keys WHERE value IS NOT NULL GROUP BY ALL) GROUP BY 1",
    "view_union_topk": "SELECT * FROM vuni",
    "shortlist_context": "SELECT record_id, entity_id, score_best, round(score_best - CASE WHEN p = 1 THEN coalesce(max(score_best) FILTER (p = 2) OVER w, 0.0) ELSE max(score_best) OVER w END, 6) AS score_margin_to_next, count(*) OVER w AS n_candidates_for_record FROM (SELECT *, row_number() OVER (PARTITION BY country, record_id ORDER BY score_best DESC, entity_id) AS p FROM vuni) WINDOW w AS (PARTITION BY country, record_id)",
    "s1_side_topk": f"WITH v2 AS ({_vocab('posts_q', _CAP)}), q2 AS ({_weights('posts_e', 'v2')}), e2 AS ({_weights('posts_q', 'v2')}), s2 AS ({_scores('q2', 'e2')}) SELECT country, record_id AS query_entity, entity_id AS found_record, score, rank FROM ({_top('s2', 3)})",
    "floored_topk": f"SELECT record_id, entity_id, score, rank FROM ({_top('(SELECT * FROM scored WHERE score > 0.3)', 5)})",
    "invert_shortlists": "SELECT country, entity_id, CAST(count(*) AS INT) AS n, arg_min(record_id, {'s': -score, 'r': record_id}) AS best_record FROM cands GROUP BY ALL",
    "recall_at_k": "SELECT CAST(k AS INT) AS k, CAST(sum(n) AS BIGINT) AS links, CAST(sum(f) AS BIGINT) AS found, round(sum(f) / sum(n), 6) AS recall, count(*) FILTER (f = n) AS entities_full FROM (SELECT k, t.entity_id, count(*) AS n, count(*) FILTER (c.rank < k) AS f FROM truth t LEFT JOIN cands10 c USING (record_id, entity_id), (SELECT unnest([1, 2, 3, 5, 10]) AS k) GROUP BY ALL) GROUP BY 1",
    "miss_reasons": f"WITH v5 AS ({_vocab('posts_e', _CAP)}), q5 AS ({_weights('posts_q', 'v5')}), e5 AS ({_weights('posts_e', 'v5')}), s5 AS ({_scores('q5', 'e5')}), c5 AS ({_top('s5', 1)}) SELECT CASE WHEN trim(r.address) = '' THEN 'empty_address' WHEN regexp_matches(r.name, '[^\\x{{0000}}-\\x{{024F}}]') <> regexp_matches(e.name, '[^\\x{{0000}}-\\x{{024F}}]') THEN 'cross_script' ELSE 'other' END AS reason, count(*) AS n FROM truth t ANTI JOIN c5 USING (record_id, entity_id) JOIN recs r ON r.id = t.record_id JOIN recs e ON e.id = t.entity_id GROUP BY 1",
    "budget_sweep": "SELECT k, floor, cap, count(*) AS pairs, round(count(*) / (SELECT count(*) FROM ents), 6) AS per_entity, count(t.record_id) AS found FROM (SELECT c.*, g.*, row_number() OVER (PARTITION BY k, floor, cap, entity_id ORDER BY score DESC, record_id) AS rn FROM cands c, (VALUES (5::INT, 0.0::DOUBLE, 1000::INT), (3, 0.2, 50), (2, 0.3, 10), (5, 0.3, 3)) g(k, floor, cap) WHERE rank < k AND score >= floor) x LEFT JOIN truth t USING (record_id, entity_id) WHERE rn <= cap GROUP BY ALL",
    "candidate_cost_curve": "SELECT CAST(k AS INT) AS k, count(*) FILTER (rank < k) AS pairs, round(count(*) FILTER (rank < k) / count(DISTINCT record_id), 6) AS per_query, CAST(round(count(*) FILTER (rank < k) / count(DISTINCT record_id) * 1000000) AS BIGINT) AS projected FROM cands, (SELECT unnest([1, 2, 3, 5]) AS k) GROUP BY k",
    "candidate_score_percentiles": "SELECT p, round(quantile_cont(score, p), 6) AS value FROM (SELECT unnest([0.1]) AS p, score FROM cands) GROUP BY 1",
    "hard_negatives": "SELECT record_id, entity_id, shared FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY shared DESC, entity_id) AS rn FROM (SELECT q.id AS record_id, e.id AS entity_id, count(*) AS shared FROM posts_q q JOIN posts_e e USING (country, token) JOIN (SELECT country, token FROM posts_e GROUP BY ALL HAVING count(*) <= 3000) USING (country, token) GROUP BY ALL) ANTI JOIN truth USING (record_id, entity_id)) WHERE rn <= 2",
    "pair_set_features": "SELECT record_id, entity_id, " + ", ".join(f"CAST(round({v}, 6) AS DOUBLE) AS {k}" for k, v in _FEATURES.items()) + " FROM sided",
    "pair_idf_overlap": f"WITH nposts AS (SELECT * FROM vposts WHERE view = 'name'), nposts_e AS (SELECT * FROM nposts WHERE source = 1), nv AS ({_vocab('nposts_e', _CAP)}), o AS (SELECT id, token, idf FROM nposts JOIN nv USING (country, token)), tot AS (SELECT id, sum(idf) AS t FROM o GROUP BY 1), sh AS (SELECT record_id, entity_id, sum(a.idf) AS s, max(a.idf) AS m FROM cands2 c JOIN o a ON a.id = c.record_id JOIN o b ON b.id = c.entity_id AND a.token = b.token GROUP BY ALL) SELECT c.record_id, c.entity_id, CASE WHEN coalesce(ta.t, 0) + coalesce(tb.t, 0) - coalesce(s, 0) > 0 THEN round(coalesce(s, 0) / (coalesce(ta.t, 0) + coalesce(tb.t, 0) - coalesce(s, 0)), 6) ELSE 0.0 END AS overlap, round(coalesce(m, 0.0), 6) AS rare FROM cands2 c LEFT JOIN sh USING (record_id, entity_id) LEFT JOIN tot ta ON ta.id = c.record_id LEFT JOIN tot tb ON tb.id = c.entity_id",
    "pair_jaro_winkler": "SELECT record_id, entity_id, CASE WHEN l.nj = '' AND r.nj = '' THEN 1.0 ELSE round(jaro_winkler_similarity(l.nj, r.nj), 6) END AS similarity FROM sided",
    "assign_argmax_margin": "SELECT * FROM decs",
    "assign_threshold": "SELECT record_id, entity_id FROM acc WHERE margin >= 0.01",
    "top3_candidates": "SELECT record_id, entity_id, score AS probability, CAST(place AS INT) AS place FROM places WHERE place <= 3",
    "first_vs_extra": "SELECT record_id, entity_id, CAST(p AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY country, entity_id ORDER BY probability DESC, record_id) AS p FROM decs) WHERE probability >= CASE WHEN p = 1 THEN 0.4 ELSE 0.6 END",
    "singleton_gate": "SELECT record_id, entity_id FROM (SELECT *, max(probability) OVER (PARTITION BY country, entity_id) AS b FROM decs) WHERE b >= 0.6",
    "expected_f_prefix": "WITH a AS (SELECT *, row_number() OVER o AS m, sum(probability) OVER o AS s, sum(probability) OVER g AS t, CASE WHEN max(probability) OVER g >= 1 THEN 0.0 ELSE product(1 - probability) OVER g END AS none FROM decs WHERE probability >= 0.1 WINDOW g AS (PARTITION BY country, entity_id), o AS (PARTITION BY country, entity_id ORDER BY probability DESC, record_id ROWS UNBOUNDED PRECEDING)), b AS (SELECT *, round(1.25 * (s / m) * (s / (t * 1.1)) / (0.25 * (s / m) + s / (t * 1.1)), 6) AS f FROM a), c AS (SELECT *, max(f) OVER (PARTITION BY country, entity_id) AS top FROM b), d AS (SELECT *, min(m) FILTER (f = top) OVER (PARTITION BY country, entity_id) AS cut FROM c) SELECT record_id, entity_id, probability FROM d WHERE m <= cut AND round(none, 6) < top",
    "stage_scope": "SELECT country, record_id, entity_id FROM decs WHERE CASE WHEN country IN ('en', 'fr') THEN round(probability * 0.9, 6) >= 0.45 ELSE probability >= 0.5 END",
    "entity_fbeta": f"SELECT entity_id, predicted, hits, \"true\", CAST(round({_f('predicted', '\"true\"', 'hits')}, 6) AS DOUBLE) AS f FROM cnts",
    "macro_fbeta_report": _REPORT.format("cnts"),
    "threshold_margin_sweep": f"WITH g AS ({_SWEEP}), p AS (SELECT threshold, margin, d.entity_id, count(*) AS p, count(t.record_id) AS h FROM decs d LEFT JOIN truth t USING (record_id, entity_id), g WHERE d.probability >= g.threshold AND d.margin >= g.margin GROUP BY ALL), x AS (SELECT g.threshold, g.margin, e.entity_id, coalesce(p.p, 0) AS p, coalesce(p.h, 0) AS h, coalesce(o.n, 0) AS t FROM g, ents e LEFT JOIN own o USING (entity_id) LEFT JOIN p ON p.threshold = g.threshold AND p.margin = g.margin AND p.entity_id = e.entity_id) SELECT threshold, margin, CAST(sum(p) AS BIGINT) AS predicted, CAST(sum(h) AS BIGINT) AS hits, round(avg(CAST({_f('p', 't', 'h')} AS DOUBLE)), 6) AS macro_f FROM x GROUP BY ALL".replace("d.margin >= g.margin", "d.margin >= g.margin").replace("SELECT threshold, margin, d.entity_id", "SELECT g.threshold, g.margin, d.entity_id"),
    "loss_buckets": "SELECT fate, count(*) AS n FROM fates GROUP BY 1",
    "wrong_accepts": "SELECT CASE WHEN t.entity_id IS NULL THEN 'distractor' ELSE 'wrong_entity' END AS kind, count(*) AS n FROM acc a LEFT JOIN truth t USING (record_id) WHERE t.entity_id IS NULL OR t.entity_id <> a.entity_id GROUP BY 1",
    "oracle_pricing": "WITH g AS (SELECT entity_id, count(*) FILTER (fate[1] = 'a') AS a, count(*) FILTER (fate[1] = 'b') AS b, count(*) FILTER (fate[1] = 'c') AS c FROM fates GROUP BY 1), z AS (SELECT d.entity_id, count(*) AS p0, count(t.record_id) AS h0 FROM decs d LEFT JOIN truth t USING (record_id, entity_id) WHERE probability > 0 GROUP BY 1), x AS (SELECT c.entity_id, predicted AS p, hits AS h, \"true\" AS t, coalesce(g.a, 0) AS a, coalesce(g.b, 0) AS b, coalesce(g.c, 0) AS c, coalesce(z.p0, 0) AS p0, coalesce(z.h0, 0) AS h0, CASE WHEN \"true\" = 0 THEN 0 ELSE 1 END AS k FROM cnts c LEFT JOIN g USING (entity_id) LEFT JOIN z USING (entity_id)), s AS (SELECT entity_id, t, unnest([{'s': 'base', 'p': p, 'h': h}, {'s': 'a_recovered', 'p': p + a, 'h': h + a}, {'s': 'b_corrected', 'p': p + b, 'h': h + b}, {'s': 'c_accepted', 'p': p + c, 'h': h + c}, {'s': 'd_removed', 'p': h, 'h': h}, {'s': 'e_singletons_fixed', 'p': p * k, 'h': h * k}, {'s': 'all', 'p': (h + a + b + c) * k, 'h': (h + a + b + c) * k}, {'s': 'threshold_0', 'p': p0, 'h': h0}], recursive := true) FROM x) SELECT s AS scenario, round(avg(CAST(" + _f("p", "t", "h") + " AS DOUBLE)), 6) AS macro_f FROM s GROUP BY 1",
    "record_precision_recall": "SELECT CAST(k AS DOUBLE) AS threshold, count(*) AS accepted, count(*) FILTER (t.entity_id = d.entity_id) AS correct, round(count(*) FILTER (t.entity_id = d.entity_id) / count(*), 6) AS precision, round(count(*) FILTER (t.entity_id = d.entity_id) / (SELECT count(*) FROM truth), 6) AS recall FROM decs d LEFT JOIN truth t USING (record_id), (SELECT unnest([0.2, 0.5, 0.8]) AS k) WHERE d.probability >= k GROUP BY k",
    "blocking_recall_sampled": "SELECT count(*) AS links, count(c.record_id) AS found FROM truth t JOIN numbered n ON n.id = t.record_id LEFT JOIN cands c USING (record_id, entity_id) WHERE n.hash < 2147483648",
    "group_shape_features": "SELECT record_id, entity_id, CAST(row_number() OVER (PARTITION BY d.country, entity_id ORDER BY probability DESC, record_id) - 1 AS INT) AS prob_rank_in_group, round(probability - max(probability) OVER g, 6) AS prob_minus_group_max, CASE WHEN max(probability) OVER g > 0 THEN round(probability / max(probability) OVER g, 6) ELSE 0.0 END AS prob_over_group_max, count(*) OVER g AS group_size, CAST(count(*) FILTER (probability >= 0.5) OVER g AS BIGINT) AS group_size_above_50, CAST(count(*) FILTER (probability >= 0.7) OVER g AS BIGINT) AS group_size_above_70, round(sum(probability) OVER g, 6) AS group_prob_sum, max(probability) OVER g AS group_prob_max, round(avg(probability) OVER g, 12) AS group_prob_mean, CAST(max(CASE WHEN source <> 3 THEN 1 ELSE 0 END) OVER g AS INT) AS group_has_s2, CAST(max(CASE WHEN source = 3 THEN 1 ELSE 0 END) OVER g AS INT) AS group_has_s3, CAST(CASE WHEN count(*) OVER (PARTITION BY d.country, entity_id, source) = 1 THEN 1 ELSE 0 END AS INT) AS is_only_record_from_its_source, CAST(CASE WHEN source = 3 THEN 1 ELSE 0 END AS INT) AS source_is_s3, count(*) OVER g - 1 AS n_siblings FROM decs d JOIN recs r ON r.id = d.record_id WINDOW g AS (PARTITION BY d.country, entity_id)",
    "sibling_agreement": f"WITH k AS (SELECT * FROM decs WHERE probability >= 0.3), s AS (SELECT a.record_id, max(ns) AS nx, avg(ns) AS na, max(sa) AS ax, avg(sa) AS aa, max((ns + sa) / 2) AS cx FROM (SELECT x.record_id, CAST({_jaccard('l.ng', 'r.ng')} AS DOUBLE) AS ns, CAST({_jaccard('l.ag', 'r.ag')} AS DOUBLE) AS sa FROM k x JOIN k y ON x.country = y.country AND x.entity_id = y.entity_id AND x.record_id <> y.record_id JOIN gram l ON l.id = x.record_id JOIN gram r ON r.id = y.record_id) a GROUP BY 1), f AS (SELECT k.record_id, CAST({_jaccard('l.ng', 'r.ng')} AS DOUBLE) AS ns, CAST({_jaccard('l.ag', 'r.ag')} AS DOUBLE) AS sa FROM k JOIN gram l ON l.id = k.record_id JOIN gram r ON r.id = k.entity_id) SELECT f.record_id, coalesce(round(nx, 6), 0.0) AS sib_name_max, coalesce(round(na, 6), 0.0) AS sib_name_mean, coalesce(round(ax, 6), 0.0) AS sib_addr_max, coalesce(round(aa, 6), 0.0) AS sib_addr_mean, coalesce(round(cx, 6), 0.0) AS sib_combined_max, round(ns, 6) AS self_name_sim, round(sa, 6) AS self_addr_sim, round((ns + sa) / 2, 6) AS self_combined_sim FROM f LEFT JOIN s USING (record_id)",
    "group_duplicate_agreement": f"WITH p AS (SELECT t.entity_id, max(CAST({_jaccard('a.ng', 'b.ng')} AS DOUBLE)) AS best, max(CASE WHEN a.nj = b.nj THEN 1 ELSE 0 END) AS equal FROM truth t JOIN gram a ON a.id = t.record_id AND a.source = 2 JOIN truth u USING (entity_id) JOIN gram b ON b.id = u.record_id AND b.source = 3 GROUP BY 1) SELECT count(*) AS groups, round(avg(best), 6) AS mean_best, round(avg(CASE WHEN best >= 0.9 THEN 1 ELSE 0 END), 6) AS near_share, CAST(sum(equal) AS BIGINT) AS exact FROM p",
    "entity_complete_lists": "SELECT e.entity_id, coalesce(string_agg(a.record_id, ',' ORDER BY a.record_id), '') AS matched_entity_ids FROM ents e LEFT JOIN acc a USING (entity_id) GROUP BY 1",
    "empty_baseline_lists": "SELECT entity_id, '' AS matched_entity_ids FROM ents",
    "candidate_lists": "SELECT e.entity_id, coalesce(string_agg(c.record_id, ',' ORDER BY c.record_id), '') AS candidate_entity_ids FROM ents e LEFT JOIN cands c USING (entity_id) GROUP BY 1",
    "matches_subset_candidates": "SELECT count(*) AS outside FROM acc ANTI JOIN cands USING (record_id, entity_id)",
    "list_summary": "WITH x AS (SELECT e.country, e.entity_id, coalesce(o.n, 0) AS k FROM ents e LEFT JOIN own o USING (entity_id)), y AS (SELECT country, count(*) AS entities, count(*) FILTER (k = 0) AS singletons, CAST(sum(k) AS BIGINT) AS ids FROM x GROUP BY ROLLUP (country)) SELECT country, entities, singletons, round(singletons / entities, 6) AS singleton_share, ids, round(ids / entities, 6) AS mean_ids, round(singletons / entities, 6) BETWEEN 0.04 AND 0.12 AND round(ids / entities, 6) BETWEEN 2.6 AND 4.2 AS in_band FROM y",
    "discover_partitions": "SELECT country, count(*) AS n FROM recs WHERE source = 1 GROUP BY 1",
    "source_profile": "SELECT CAST(source AS VARCHAR) AS source, country, count(*) AS n, count(*) FILTER (trim(name) = '') AS blank_names, count(*) FILTER (trim(address) = '') AS blank_addresses FROM recs GROUP BY ROLLUP (recs.source, country)",
    "distractors": "SELECT r.source, r.country, count(*) AS n, count(*) FILTER (t.record_id IS NULL) AS unowned FROM recs r LEFT JOIN truth t ON t.record_id = r.id WHERE r.source > 1 GROUP BY ALL",
    "exclusivity_check": "SELECT count(*) AS shared FROM (SELECT record_id FROM truth GROUP BY 1 HAVING count(DISTINCT entity_id) > 1)",
    "country_mix": "SELECT count(*) AS links, count(*) FILTER (a.country <> b.country) AS across FROM truth t JOIN recs a ON a.id = t.record_id JOIN recs b ON b.id = t.entity_id",
    "match_histogram": "SELECT coalesce(o.n, 0) AS size, count(*) AS entities FROM ents e LEFT JOIN own o USING (entity_id) GROUP BY 1",
    "nearest_rank_percentiles": "SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 4) AS mean, " + ", ".join(f"list_sort(list(l_quantity))[CAST(round_even({p} / 100 * (count(*) - 1), 0) AS BIGINT) + 1] AS p{p}" for p in (5, 25, 50, 75, 95)) + " FROM lineitem GROUP BY 1",
    "separability": "WITH x AS (SELECT CASE WHEN t.record_id IS NULL THEN 0 ELSE 1 END AS own, unnest([" + ", ".join(f"{{'feature': '{k}', 'x': CAST({v} AS DOUBLE)}}" for k, v in _SIGNALS.items()) + "], recursive := true) FROM sided s LEFT JOIN truth t USING (record_id, entity_id)), m AS (SELECT feature, round(quantile_cont(x, 0.5) FILTER (own = 1), 6) AS true_median, round(quantile_cont(x, 0.5) FILTER (own = 0), 6) AS negative_median FROM x GROUP BY 1) SELECT *, round(true_median - negative_median, 6) AS gap FROM m",
    "text_variants": "SELECT id, unnest([{'variant': 'name only', 'text': nj}, {'variant': 'address only', 'text': aj}, {'variant': 'name+address', 'text': nj || ' ' || aj}], recursive := true) FROM prs",
    "delivery_problems": "SELECT 'matches: entity missing' AS problem, count(*) AS n FROM ents WHERE country = 'es' HAVING count(*) > 0",
    "list_sizes": "SELECT country, count(*) AS entities, CAST(sum(n) AS BIGINT) AS ids FROM (SELECT e.country, e.entity_id, count(c.record_id) AS n FROM ents e LEFT JOIN cands c USING (entity_id) GROUP BY ALL) GROUP BY 1",
    "within_source_agreement": f"WITH p AS (SELECT a.source, round(CAST({_jaccard('a.ag', 'b.ag')} AS DOUBLE), 6) AS x FROM truth t JOIN gram a ON a.id = t.record_id JOIN truth u USING (entity_id) JOIN gram b ON b.id = u.record_id AND a.source = b.source AND a.id < b.id) SELECT source, count(*) AS pairs, round(avg(x), 4) AS mean, " + ", ".join(f"list_sort(list(x))[CAST(round_even({p} / 100 * (count(*) - 1), 0) AS BIGINT) + 1] AS p{p}" for p in (5, 25, 50, 75, 95)) + " FROM p GROUP BY 1",
    "holdout_report": "SELECT * FROM (" + _REPORT.format("cnts WHERE entity_id IN (SELECT id FROM held WHERE split = 'valid')") + ")",
    "halves_improve": "WITH g AS (SELECT entity_id, count(*) FILTER (probability >= 0.9) AS p9, count(t.record_id) FILTER (probability >= 0.9) AS h9, count(*) FILTER (probability >= 0.4) AS p4, count(t.record_id) FILTER (probability >= 0.4) AS h4 FROM decs d LEFT JOIN truth t USING (record_id, entity_id) GROUP BY 1), x AS (SELECT n.hash, coalesce(p9, 0) AS p9, coalesce(h9, 0) AS h9, coalesce(p4, 0) AS p4, coalesce(h4, 0) AS h4, coalesce(o.n, 0) AS t FROM ents e JOIN numbered n ON n.id = e.entity_id LEFT JOIN g USING (entity_id) LEFT JOIN own o USING (entity_id)), y AS (SELECT (hash >> 16) % 2 AS half, round(avg(round(CAST(" + _f("p9", "t", "h9") + " AS DOUBLE), 6)), 6) AS b, round(avg(round(CAST(" + _f("p4", "t", "h4") + " AS DOUBLE), 6)), 6) AS a FROM x GROUP BY 1) SELECT bool_and(a > b) AS accepted FROM y",
    "stream_shards": "SELECT count(*) AS n, count(DISTINCT id) AS ids FROM recs",
    "grouped_holdout": "SELECT * FROM held",
    "holdout_mix": "SELECT split, country, count(*) AS n FROM held GROUP BY ALL",
    "loco_folds": "SELECT fold, CASE WHEN country = fold THEN 'valid' ELSE 'train' END AS split, count(*) AS n FROM ents, (SELECT DISTINCT country AS fold FROM ents) GROUP BY ALL",
    "hash_sample": "SELECT id FROM numbered WHERE hash < 429496729",
    "fixed_sample": "SELECT id FROM numbered ORDER BY hash, id LIMIT 100",
    "half_split": "SELECT id AS entity_id, CASE WHEN (hash >> 16) % 2 = 0 THEN 'A' ELSE 'B' END AS half FROM numbered WHERE source = 1",
    "dev_pool": "WITH e AS (SELECT id, source FROM numbered WHERE source = 1 ORDER BY hash, id LIMIT 50), o AS (SELECT r.id, r.source FROM recs r JOIN truth t ON t.record_id = r.id JOIN e ON e.id = t.entity_id), f AS (SELECT n.id, n.source, row_number() OVER (ORDER BY n.hash, n.id) AS rn FROM numbered n LEFT JOIN truth t ON t.record_id = n.id WHERE n.source > 1 AND t.record_id IS NULL) SELECT id, source FROM e UNION ALL SELECT id, source FROM o UNION ALL SELECT id, source FROM f WHERE rn <= floor((SELECT count(*) FROM o) * 0.26::DOUBLE / (1 - 0.26::DOUBLE))",
    "fast_eval_queries": "SELECT n.id FROM numbered n LEFT JOIN truth t ON t.record_id = n.id WHERE n.source > 1 AND (t.record_id IS NOT NULL OR n.hash < 214748364)",
    "labelled_pairs": "SELECT CAST(CASE WHEN t.record_id IS NULL THEN 0 ELSE 1 END AS TINYINT) AS label, count(*) AS n FROM cands c LEFT JOIN truth t USING (record_id, entity_id) GROUP BY 1",
    "events_top_value": "SELECT event_id, user_id, event_type, value, CAST(rn AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 3",
    "average_precision": "WITH s AS (SELECT probability, count(*) AS n, count(t.record_id) AS h FROM decs d LEFT JOIN truth t USING (record_id, entity_id) GROUP BY 1), r AS (SELECT *, sum(n) OVER (ORDER BY probability DESC) AS seen, sum(h) OVER (ORDER BY probability DESC) AS got FROM s) SELECT round(round(sum(got / seen * h), 6) / sum(h), 6) AS average_precision FROM r",
}
_QUERIES["sweep_leaderboard"] = _QUERIES["threshold_margin_sweep"] + " ORDER BY macro_f DESC, threshold DESC, margin DESC LIMIT 5"
_QUERIES["pruned_topk"] = _QUERIES["floored_topk"]
_QUERIES["candidate_score_percentiles"] = "SELECT p, CASE p " + " ".join(f"WHEN {p} THEN round(quantile_cont(score, {p}), 6)" for p in (0.1, 0.25, 0.5, 0.65, 0.75, 0.9, 0.99)) + " END AS value FROM cands, (SELECT unnest([0.1, 0.25, 0.5, 0.65, 0.75, 0.9, 0.99])::DOUBLE AS p) GROUP BY p"


def _assembled(sql: str) -> str:
    """The query with the steps that it needs, and those that they need, in front."""
    found, todo = set(), [sql]
    while todo:
        text = todo.pop()
        for name in _STEPS:
            if name not in found and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text):
                found.add(name)
                todo.append(_STEPS[name])
    steps = ",\n".join(f"{n} AS ({_STEPS[n]})" for n in _STEPS if n in found)
    if not steps:
        return sql
    return f"WITH {steps}{', ' + sql[5:] if sql.startswith('WITH ') else chr(10) + sql}"


ORACLE_SQL = {name: _assembled(sql) for name, sql in _QUERIES.items()}
