"""DuckDB SQL that says the same as the queries. Built from shared parts; decimals are cast to double."""

from __future__ import annotations

D = "list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"
COS = "round(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 6)"
L2 = "list_sum(list_transform(list_zip({a}::DOUBLE[], {b}::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
Q = "q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0)"
CENT = """pos AS (SELECT label AS cluster_id, unnest(range(64)) AS i, embedding FROM embeddings),
mean AS (SELECT cluster_id, i, avg(embedding[i + 1]::DOUBLE) AS m FROM pos GROUP BY ALL),
cent AS (SELECT cluster_id, list(m ORDER BY i) AS centroid FROM mean GROUP BY 1)"""
DIST = f"dist AS (SELECT vec_id, cluster_id, round({L2.format(a='embedding', b='centroid')}, 6) AS dist FROM embeddings, cent)"
NEAR = "near AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, cluster_id) AS r FROM dist)"
RANKED = f"""sc AS (SELECT query_id, cluster_id, round({D.format(a='q', b='centroid')}, 6) AS s FROM q, cent),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, cluster_id) AS r FROM sc)"""
KTH = "kt AS (SELECT *, max(CASE WHEN r = 3 THEN s END) OVER (PARTITION BY query_id) AS k FROM rk)"
PROBE = "pr AS (SELECT query_id, cluster_id FROM kt WHERE r <= 3 OR (r <= 6 AND s >= CASE WHEN k >= 0 THEN k * 0.95::DOUBLE ELSE k / 0.95::DOUBLE END))"
IVF = "WITH " + ", ".join((Q, CENT, DIST, NEAR, RANKED))


def top(source: str, k: int = 10, by: str = "score DESC") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {by}, vec_id) AS rank FROM ({source})) WHERE rank <= {k}"


def scored(pairs: str) -> str:
    return f"SELECT p.query_id, p.vec_id, {COS.format(a='q', b='embedding')} AS score FROM ({pairs}) p JOIN q USING (query_id) JOIN embeddings USING (vec_id)"


def probed(rows: str = "r = 1") -> str:
    return scored(f"SELECT DISTINCT query_id, vec_id FROM pr JOIN near USING (cluster_id) WHERE near.{rows}")


BRUTE = f"SELECT query_id, vec_id, {COS.format(a='q', b='embedding')} AS score FROM q, embeddings"
THRESHOLD = f"{IVF}, {KTH}, {PROBE}"
TRUTH = f"truth AS ({top(BRUTE)}), found AS ({top(probed())})"
GAP = """st AS (SELECT *, CASE WHEN r > 3 THEN lag(s) OVER (PARTITION BY query_id ORDER BY r) - s END AS gap FROM rk WHERE r <= 8),
md AS (SELECT query_id, quantile_cont(gap, 0.5) AS mid FROM st GROUP BY 1),
sp AS (SELECT st.*, min(CASE WHEN mid > 1e-12 AND gap > mid * 2.0::DOUBLE THEN r END) OVER (PARTITION BY query_id) AS stop FROM st JOIN md USING (query_id)),
pr AS (SELECT query_id, cluster_id FROM sp WHERE r <= 3 OR r < coalesce(stop, 9))"""
PLANE = "list_transform(range(64), lambda p: CASE WHEN (i * 31 + p * 17 + i * p * 7) % 11 < 5 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)"
SIG = f"""bits AS (SELECT vec_id, unnest(range(16)) AS i, embedding FROM embeddings),
sig AS (SELECT vec_id, sum(CASE WHEN round({D.format(a='embedding', b=PLANE)}, 9) > 0 THEN 1::BIGINT << i ELSE 0 END)::BIGINT AS sig FROM bits GROUP BY 1),
qs AS (SELECT vec_id AS query_id, sig AS qsig FROM sig WHERE vec_id % 50 = 0)"""
BOOK = "book AS (SELECT m, vec_id::INT AS code, embedding[m * 8 + 1 : m * 8 + 8]::DOUBLE[] AS c FROM (SELECT *, unnest(range(8)) AS m FROM embeddings WHERE vec_id < 16))"
CODES = f"""parts AS (SELECT vec_id, m, embedding[m * 8 + 1 : m * 8 + 8]::DOUBLE[] AS x FROM (SELECT *, unnest(range(8)) AS m FROM embeddings)),
pd AS (SELECT vec_id, m, code, round({L2.format(a='x', b='c')}, 9) AS d FROM parts JOIN book USING (m)),
codes AS (SELECT vec_id, m, arg_min(code, struct_pack(d := d, code := code)) AS code FROM pd GROUP BY 1, 2)"""
ADC = f"""adc AS (SELECT vec_id AS query_id, m, code, d FROM pd WHERE vec_id % 50 = 0),
near AS (SELECT query_id, codes.vec_id, round(sum(d), 6) AS dist FROM codes JOIN adc USING (m, code) GROUP BY 1, 2)"""
SIZES = "sizes AS (SELECT cluster_id, count(near.vec_id) AS n FROM cent LEFT JOIN (SELECT * FROM near WHERE r = 1) near USING (cluster_id) GROUP BY 1)"
TEXT_IDS = "vec_id, label, round(embedding[1]::DOUBLE, 6) AS first"

HAMMING = f"WITH {SIG} " + top("SELECT query_id, vec_id, bit_count(xor(qsig, sig))::INT AS hamming FROM qs, sig", by="hamming")


def ids(source: str, k: int = 10) -> str:
    """The best k by score, without scores."""
    return f"SELECT query_id, vec_id, rank FROM ({top(source, k)})"


def bits(begin: int, n: int) -> str:
    """vec_id, sig: n bits from plane `begin` on."""
    return f"""SELECT vec_id, sum(CASE WHEN round({D.format(a='embedding', b=PLANE)}, 9) > 0 THEN 1::BIGINT << (i - {begin}) ELSE 0 END)::BIGINT AS sig
    FROM (SELECT vec_id, unnest(range({begin}, {begin + n})) AS i, embedding FROM embeddings) GROUP BY 1"""


#: Every id whose left neighbour's id is divisible by three has that neighbour's vector.
SWAPPED = "moved AS (SELECT b.vec_id, coalesce(a.embedding, b.embedding) AS embedding, a.vec_id AS other FROM embeddings b LEFT JOIN embeddings a ON a.vec_id + 1 = b.vec_id AND a.vec_id % 3 = 0)"
SIX = f"six AS ({bits(0, 6)}), place AS (SELECT vec_id, sig::INT AS bucket FROM six)"
FLIPPED = "SELECT q.vec_id AS query_id, p.vec_id FROM place q JOIN place p ON p.bucket = q.bucket OR xor(p.bucket, q.bucket) IN (1, 2, 4, 8) WHERE q.vec_id % 50 = 0"
TWO = f"""sup AS ({bits(0, 6)}), low AS ({bits(16, 6)}),
place AS (SELECT sup.vec_id, (sup.sig % 8)::INT AS super, (low.sig % 4)::INT AS sub FROM sup JOIN low USING (vec_id))"""
SUPER = f"""el AS (SELECT super, i, avg(embedding[i + 1]::DOUBLE) AS m FROM (SELECT super, embedding, unnest(range(64)) AS i FROM place JOIN embeddings USING (vec_id)) GROUP BY 1, 2),
raw AS (SELECT super, list(m ORDER BY i) AS c FROM el GROUP BY 1),
cs AS (SELECT super, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) AS c FROM raw),
best AS (SELECT query_id, super FROM (SELECT query_id, super, row_number() OVER (PARTITION BY query_id ORDER BY round({D.format(a='q', b='c')}, 6) DESC, super) AS r FROM q, cs) WHERE r <= 3)"""

ORACLE_SQL = {
    "brute_cosine_topk": f"WITH {Q} {top(BRUTE)}",
    "brute_l2_topk": f"WITH {Q} " + top(f"SELECT query_id, vec_id, round({L2.format(a='q', b='embedding')}, 6) AS score FROM q, embeddings", by="score"),
    "brute_dot_topk": f"WITH {Q} " + top(f"SELECT query_id, vec_id, round({D.format(a='q', b='embedding')}, 6) AS score FROM q, embeddings"),
    "normalize_norm_check": f"SELECT vec_id, round(sqrt({D.format(a='embedding', b='embedding')}), 6) AS norm, 1.0::DOUBLE AS unit FROM embeddings",
    "label_centroids": f"WITH {CENT} SELECT cluster_id, i AS pos, round(m, 6) AS m FROM mean",
    "nearest_centroid_assign": f"WITH {CENT}, {DIST}, {NEAR} SELECT vec_id, cluster_id, dist, (r - 1)::INT AS replica FROM near WHERE r = 1",
    "nearest_2_centroid_assign": f"WITH {CENT}, {DIST}, {NEAR} SELECT vec_id, cluster_id, dist, (r - 1)::INT AS replica FROM near WHERE r <= 2",
    "cluster_sizes": f"WITH {CENT}, {DIST}, {NEAR}, {SIZES} SELECT cluster_id, n FROM sizes",
    "cluster_sizes_stats": f"WITH {CENT}, {DIST}, {NEAR}, {SIZES} SELECT count(*) AS clusters, count(*) FILTER (n = 0) AS empty, min(n) FILTER (n > 0) AS least, max(n) AS most, avg(n) AS mean FROM sizes",
    "inertia": f"WITH {CENT}, {DIST}, {NEAR} SELECT round(sum(dist), 4) AS inertia FROM near WHERE r = 1",
    "kmeans_one_lloyd_step": f"""WITH {CENT}, {DIST}, {NEAR},
        p2 AS (SELECT cluster_id, unnest(range(64)) AS i, embedding FROM near JOIN embeddings USING (vec_id) WHERE r = 1)
        SELECT cluster_id, i AS pos, count(*) AS n, round(avg(embedding[i + 1]::DOUBLE), 6) AS m FROM p2 GROUP BY 1, 2""",
    "running_mean_centroid_update": f"""WITH {CENT}, old AS (SELECT label AS cluster_id, count(*) AS n FROM embeddings GROUP BY 1),
        p2 AS (SELECT 0 AS cluster_id, unnest(range(64)) AS i, embedding FROM embeddings WHERE vec_id % 2 = 0),
        s AS (SELECT cluster_id, i, sum(embedding[i + 1]::DOUBLE) AS s, count(*) AS k FROM p2 GROUP BY 1, 2)
        SELECT mean.cluster_id, mean.i AS pos, n + coalesce(k, 0) AS n, round((n * m + coalesce(s, 0)) / (n + coalesce(k, 0)), 6) AS m
        FROM mean JOIN old USING (cluster_id) LEFT JOIN s USING (cluster_id, i)""",
    "ivf_threshold_topk": f"{THRESHOLD} {top(probed())}",
    "ivf_strict_topk": f"{IVF}, pr AS (SELECT query_id, cluster_id FROM rk WHERE r <= 3) {top(probed())}",
    "ivf_gap_topk": f"{IVF}, {GAP} {top(probed())}",
    "ivf_redundant_topk": f"{THRESHOLD} {top(probed('r <= 2'))}",
    "probe_threshold": f"{THRESHOLD} SELECT query_id, cluster_id FROM pr",
    "probe_gap": f"{IVF}, {GAP} SELECT query_id, cluster_id FROM pr",
    "filtered_search_post": f"WITH {Q}, wide AS ({top(BRUTE, 50)}) " + top("SELECT query_id, vec_id, score FROM wide JOIN embeddings USING (vec_id) WHERE label = 3"),
    "filtered_search_pre": f"WITH {Q} " + top(BRUTE + " WHERE label = 3"),
    "tombstone_search": f"WITH {Q} " + top(BRUTE + " WHERE vec_id % 3 <> 0"),
    "latest_version_dedup": """WITH v AS (SELECT vec_id, 1 AS version, label FROM embeddings UNION ALL SELECT vec_id, 2, label + 100 FROM embeddings WHERE vec_id % 4 = 0
        UNION ALL SELECT vec_id, 3, label + 200 FROM embeddings WHERE vec_id % 8 = 0)
        SELECT vec_id, max(version)::BIGINT AS version, arg_max(label, version)::INT AS label FROM v GROUP BY 1""",
    "list_ids_paged": "SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 50 OFFSET 100",
    "recall_at_k": f"{THRESHOLD}, {TRUTH} SELECT query_id, count(found.vec_id) AS hits, round(count(found.vec_id) / 10.0::DOUBLE, 6) AS recall FROM truth LEFT JOIN found USING (query_id, vec_id) GROUP BY 1",
    "ndcg_at_k": f"""{THRESHOLD}, {TRUTH}, ideal AS (SELECT query_id, sum((11 - rank) / log2(rank + 1.0::DOUBLE)) AS ideal FROM truth GROUP BY 1),
        got AS (SELECT query_id, sum((11 - t.rank) / log2(f.rank + 1.0::DOUBLE)) AS got FROM truth t JOIN found f USING (query_id, vec_id) GROUP BY 1)
        SELECT query_id, round(coalesce(got, 0) / ideal, 6) AS ndcg FROM ideal LEFT JOIN got USING (query_id)""",
    "cluster_coverage": f"""{THRESHOLD}, {TRUTH} SELECT query_id, round(avg(CASE WHEN pr.cluster_id IS NULL THEN 0 ELSE 1 END), 6) AS covered
        FROM truth JOIN near USING (vec_id) LEFT JOIN pr USING (query_id, cluster_id) WHERE near.r = 1 GROUP BY 1""",
    "padding_targets_pow2": "SELECT label AS bucket, count(*) AS n, pow(2, ceil(log2(count(*)) - 1e-12))::BIGINT AS target FROM embeddings GROUP BY 1",
    "padding_targets_max": "SELECT label AS bucket, count(*) AS n, max(count(*)) OVER () AS target FROM embeddings GROUP BY 1",
    "epsilon_decoy_count": "SELECT n AS clusters, k AS probed, e::DOUBLE AS epsilon, (CASE WHEN e <= 0 OR n - k <= 0 THEN 0 ELSE least(n - k, greatest(1, ceil((n - k) * exp(-e::DOUBLE)))) END)::INT AS decoys FROM (VALUES (128, 8, 1), (128, 8, 2), (128, 8, 3), (8, 8, 1), (128, 8, 100), (128, 8, 0)) t(n, k, e)",
    "permutation_identity_results": f"{THRESHOLD} {top(probed())}",
    "decoy_invariance": f"{THRESHOLD} {top(probed())}",
    "lsh_signature": f"WITH {SIG} SELECT vec_id, sig FROM sig",
    "lsh_hamming_topk": f"WITH {SIG} " + top("SELECT query_id, vec_id, bit_count(xor(qsig, sig))::INT AS hamming FROM qs, sig", by="hamming"),
    "lsh_multiprobe": f"WITH {SIG} SELECT DISTINCT query_id, vec_id FROM qs, sig WHERE sig = qsig OR xor(sig, qsig) IN (1, 2, 4, 8)",
    "lsh_two_stage": f"WITH {Q}, {SIG} , c AS (" + top("SELECT query_id, vec_id, bit_count(xor(qsig, sig))::INT AS hamming FROM qs, sig", 200, "hamming") + ") " + top(scored("SELECT query_id, vec_id FROM c")),
    "lsh_masked_distance": HAMMING,
    "lsh_key_rotation": HAMMING,
    "pq_encode": f"WITH {BOOK}, {CODES} SELECT vec_id, m, code FROM codes",
    "pq_adc_topk": f"WITH {BOOK}, {CODES}, {ADC} " + top("SELECT query_id, vec_id, dist FROM near", by="dist"),
    "pq_rerank_topk": f"WITH {Q}, {BOOK}, {CODES}, {ADC}, c AS (" + top("SELECT query_id, vec_id, dist FROM near", 200, "dist") + ") " + top(scored("SELECT query_id, vec_id FROM c")),
    "metadata_json_filter": "SELECT event_id, (props->>'$.k')::INT AS k FROM events WHERE (props->>'$.k')::DOUBLE = 7",
    "metadata_left_join": "SELECT vec_id, event_type FROM embeddings LEFT JOIN events ON vec_id = event_id",
    "aes_roundtrip": "SELECT vec_id, 284 AS bytes, true AS same, true AS wrong_id_is_null FROM embeddings",
    "latency_percentiles": "SELECT avg(value) AS avg, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, min(value) AS least, max(value) AS most FROM events",
    "dataset_stats": "SELECT count(*) AS vectors, max(len(embedding))::INT AS dimension FROM embeddings",
    "score_precision": f"WITH {Q}, {CENT} SELECT query_id, cluster_id, round({D.format(a='q', b='centroid')} * 1024) / 1024 AS score FROM q, cent",
    "database_search": f"WITH {Q} " + ids(BRUTE + " WHERE vec_id % 7 <> 1"),
    "update_then_search": f"WITH {Q}, {SWAPPED} " + ids(f"SELECT query_id, vec_id, {COS.format(a='q', b='embedding')} AS score FROM q, moved"),
    "reopen_then_delete": "SELECT vec_id FROM embeddings WHERE (vec_id % 5 <> 1 OR vec_id % 10 = 1) AND vec_id % 5 <> 2",
    "sealed_roundtrip": "SELECT vec_id, 284 AS bytes, true AS same, '{\"label\":' || label || '}' AS metadata, true AS sealed FROM embeddings",
    "decoy_reads": f"WITH {Q} SELECT query_id, 16::BIGINT AS buckets, 4::BIGINT AS probed, (SELECT count(*) FROM embeddings) AS blobs FROM q",
    "rebuild_compacts": "SELECT vec_id, (CASE WHEN vec_id % 4 = 1 THEN 3 ELSE 1 END)::BIGINT AS version, label FROM embeddings WHERE vec_id % 4 <> 0",
    "database_where_pre": f"WITH {Q} " + ids(BRUTE + " WHERE label = 3"),
    "database_where_post": f"WITH {Q}, wide AS ({top(BRUTE, 50)}) " + ids("SELECT query_id, vec_id, score FROM wide JOIN embeddings USING (vec_id) WHERE label = 3"),
    "database_hidden_after": f"WITH {Q} SELECT * FROM ({ids(BRUTE)}) WHERE vec_id % 3 <> 0",
    "database_stats": """SELECT 'ready' AS state, n - (SELECT count(*) FROM embeddings WHERE vec_id % 5 = 0) AS vectors, 64 AS dimension, 2::BIGINT AS version, 1::BIGINT AS changes,
        2 * (n - (SELECT count(*) FROM embeddings WHERE vec_id % 5 = 0)) AS blobs, 16 AS clusters, true AS has_1, false AS has_5, false AS has_nobody, 64 AS width, true AS labelled
        FROM (SELECT count(*) AS n FROM embeddings)""",
    "save_load_consistency": f"WITH {Q} SELECT query_id, 10::BIGINT AS results, 10::BIGINT AS same FROM q",
    "stream_ingest": "SELECT vec_id AS query_id, vec_id FROM embeddings WHERE vec_id % 2 = 1",
    "stream_again": f"WITH {SWAPPED} SELECT m.vec_id, (CASE WHEN m.vec_id % 6 = 5 THEN 2 ELSE 1 END)::BIGINT AS version, round((CASE WHEN m.vec_id % 6 = 5 THEN e.embedding[1] ELSE m.embedding[1] END)::DOUBLE, 6) AS first FROM moved m JOIN embeddings e USING (vec_id)",
    "two_level_search": f"WITH {Q}, {TWO}, {SUPER} " + top(scored("SELECT DISTINCT query_id, p.vec_id FROM best JOIN place o ON o.vec_id = best.query_id JOIN place p ON p.super = best.super AND (p.sub = o.sub OR p.sub = (o.sub + 1) % 4)")),
    "super_bucket_scan": f"WITH {TWO} SELECT vec_id, super, sub FROM place WHERE super IN (1, 5)",
    "bucket_search": f"WITH {Q}, {SIX} " + top(scored(FLIPPED)),
    "hybrid_search": f"WITH {Q}, {SIX}, coarse AS (" + top(scored(FLIPPED), 20) + ") " + top("SELECT query_id, vec_id, round(score * 1024) / 1024 AS score FROM coarse", by="score DESC, vec_id::VARCHAR"),
    "bucket_dml": f"WITH {SIX} SELECT bucket, count(*) AS n, (284 * count(*))::BIGINT AS bytes FROM place WHERE vec_id % 7 <> 0 GROUP BY 1",
    "blob_table": """SELECT vec_id, 'bucket' AS kind, label AS bucket FROM embeddings WHERE vec_id % 4 <> 0 AND (label IN (1, 2, 3) OR label > 6)
        UNION ALL SELECT vec_id, 'point', CASE WHEN vec_id % 4 <> 0 THEN label END FROM embeddings WHERE vec_id % 50 = 0""",
    "lsh_index_crud": f"WITH {SIG}, {SWAPPED} SELECT m.vec_id, s.sig FROM moved m JOIN sig s ON s.vec_id = coalesce(m.other, m.vec_id) WHERE m.vec_id % 9 <> 0",
    "lsh_wide_topk":
        "WITH " + ", ".join(f"w{j} AS ({bits(32 * j, 32)})" for j in range(4)) + ", w AS (SELECT vec_id, w0.sig AS a, w1.sig AS b, w2.sig AS c, w3.sig AS d FROM w0 JOIN w1 USING (vec_id) JOIN w2 USING (vec_id) JOIN w3 USING (vec_id)) "
        + top("SELECT q.vec_id AS query_id, w.vec_id, (" + " + ".join(f"bit_count(xor(q.{x}, w.{x}))::INT" for x in "abcd") + ")::INT AS hamming FROM w q, w WHERE q.vec_id % 50 = 0", by="hamming"),
    "lsh_bucket": f"WITH {SIG} SELECT vec_id, (sig % 10)::INT AS bucket FROM sig",
    "lsh_neighbour_buckets": f"WITH {SIG} SELECT vec_id, ((sig + unnest(range(3))) % 10)::INT AS bucket FROM sig",
    "lsh_bucket_centroids": f"""WITH {SIX}, dealt AS (SELECT vec_id, (bucket % 8)::INT AS bucket FROM place), n AS (SELECT bucket, count(*) AS n FROM dealt GROUP BY 1),
        el AS (SELECT bucket, i, avg(embedding[i + 1]::DOUBLE) AS m FROM (SELECT bucket, embedding, unnest(range(64)) AS i FROM dealt JOIN embeddings USING (vec_id)) GROUP BY 1, 2),
        len AS (SELECT bucket, sqrt(sum(m * m)) AS len FROM el GROUP BY 1)
        SELECT bucket, n, i AS pos, round(m / len, 6) AS m FROM el JOIN len USING (bucket) JOIN n USING (bucket)""",
    "fvecs_roundtrip": f"SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, 64 AS dimension, round(sqrt({D.format(a='embedding', b='embedding')}), 6) AS norm, embedding[6]::DOUBLE AS sixth FROM embeddings",
    "ivecs_ground_truth": f"WITH {Q} " + ids(BRUTE),
    "bvecs_roundtrip": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, list_sum(list_transform(embedding, lambda x: floor((x::DOUBLE + 1) * 100))) AS total FROM embeddings",
    "glove_text": "SELECT 'w' || vec_id AS word, 64 AS dimension, round(embedding[1]::DOUBLE, 4) AS first FROM embeddings",
    "dataset_subset": "SELECT 100::BIGINT AS vectors, 64 AS dimension",
    "json_bootstrap": "SELECT vec_id, label, 64 AS dimension FROM embeddings",
    "generated_vectors": "SELECT range AS idx, 'vec_' || range AS vec_id, 16 AS dimension, 1.0::DOUBLE AS norm FROM range(1000)",
    "sql_functions": f"""SELECT a.vec_id, round({D.format(a='a.embedding', b='b.embedding')}, 6) AS dot, round({L2.format(a='a.embedding', b='b.embedding')}, 6) AS l2,
        {COS.format(a='a.embedding', b='b.embedding')} AS cos, bit_count(xor(a.vec_id, b.vec_id))::INT AS ham FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "privacy_log": """SELECT count(*) FILTER (event_id % 3 > 0) AS real, count(*) FILTER (event_id % 3 = 0) AS dummies, (4 * count(*))::BIGINT AS probed, sum(event_id % 5)::BIGINT AS decoys,
        round(sum(event_id % 5) / sum(4 + event_id % 5), 6) AS decoy_share, round(avg(value), 6) AS mean_ms FROM events""",
    "decoy_counts": f"WITH {Q} SELECT query_id, 2::BIGINT AS decoys, 0::BIGINT AS probed_too FROM q",
    "bernoulli_decoys_outside": f"{THRESHOLD} SELECT query_id, (SELECT count(*) FROM cent) - count(*) AS decoys FROM pr GROUP BY 1",
    "weighted_pick": f"""WITH {CENT}, {DIST}, d AS (SELECT vec_id, min(dist) AS d FROM dist WHERE cluster_id < 2 GROUP BY 1),
        r AS (SELECT vec_id, sum(d) OVER (ORDER BY vec_id) AS run, sum(d) OVER () AS total FROM d) SELECT min(vec_id) AS vec_id FROM r WHERE run >= 0.4::DOUBLE * total - 1e-9""",
    "shuffled_ids": "SELECT vec_id FROM embeddings",
    "tenant_settings": "SELECT * FROM (VALUES ('acme', 64, 16, '2', true), ('acme', 64, 32, '2', true)) t(name, dimension, clusters, tier, same_key)",
}
