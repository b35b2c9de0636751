"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobloom.llm.chat import op10_chat_formatting
from jobloom.llm.decontamination import op11_benchmark_decontamination
from jobloom.llm.fingerprints import op7_document_fingerprints
from jobloom.llm.importance import op12_importance_resampling
from jobloom.llm.licenses import op4_license_scans
from jobloom.llm.mixing import op9_source_mixing
from jobloom.llm.near_dedup import op2_near_dedup
from jobloom.llm.negatives import op13_hard_negatives
from jobloom.llm.neighbours import op5_nearest_neighbours
from jobloom.llm.packing import op3_best_fit_packing
from jobloom.llm.pii import op1_pii_surrogates
from jobloom.llm.quality import op8_quality_classifier
from jobloom.llm.token_ids import op6_token_ids


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii_surrogates": op1_pii_surrogates,
        "op2_near_dedup": op2_near_dedup,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_license_scans": op4_license_scans,
        "op5_nearest_neighbours": op5_nearest_neighbours,
        "op6_token_ids": op6_token_ids,
        "op7_document_fingerprints": op7_document_fingerprints,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_source_mixing": op9_source_mixing,
        "op10_chat_formatting": op10_chat_formatting,
        "op11_benchmark_decontamination": op11_benchmark_decontamination,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_hard_negatives": op13_hard_negatives,
    }


#: Shingles of four words, every two documents that share one, and all that can be reached over links.
_NEAR_DEDUP = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
 '[^\x20\x09-\x0D]+') ws FROM documents),
 s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 4 THEN list_slice(ws, i, i + 3) ELSE ws END g
 FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 3, 1))) i FROM w WHERE len(ws) > 0)),
 n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
 r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
 c AS (SELECT a, min(b) b FROM r GROUP BY 1)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.b, d.doc_id)) AS component_id, coalesce(c.b, d.doc_id) >= d.doc_id AS kept
 FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id"""

_ADDED = r"(length({0}) + len(regexp_extract_all({0}, '\\')) + len(regexp_extract_all({0}, '<\||\[/?INST\]|<</?SYS>>|</?s>')))"
#: A turn has three marks, roles and texts a backslash for each control string and each backslash.
_CHAT = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
 c AS (SELECT conv_id, count(*) n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) said,
 coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') loss,
 sum(len('<|turn|><|text|><|end|>') + {_ADDED.format("role")} + {_ADDED.format("text")}) formatted FROM t GROUP BY 1)
 SELECT conv_id, n AS n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
 CAST(formatted AS BIGINT) AS formatted_chars FROM c"""

_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
#: Every window of a document, of each length that items' windows have, against those of the items.
_DECONTAMINATION = f"""WITH w AS (SELECT row_number() OVER () r, doc_id, {_WORDS} ws FROM documents),
 b AS (SELECT item_id, {_WORDS} ws FROM benchmark WHERE item_id IS NOT NULL),
 p AS (SELECT DISTINCT item_id, least(len(ws), 10) size, list_slice(ws, i, i + 9) g FROM (SELECT *, unnest(generate_series(1, greatest(len(ws) - 9, 1))) i FROM b WHERE len(ws) > 0)),
 d AS (SELECT r, i, size, list_slice(ws, i, i + size - 1) g FROM (SELECT r, ws, size, unnest(generate_series(1, len(ws) - size + 1)) i FROM w, (SELECT DISTINCT size FROM p) WHERE len(ws) >= size)),
 h AS (SELECT r, i, d.size, item_id FROM d JOIN p USING (g)),
 n AS (SELECT r, count(DISTINCT k) n FROM (SELECT r, unnest(generate_series(i, i + size - 1)) k FROM h) GROUP BY 1),
 m AS (SELECT r, count(*) n, string_agg(x, ',' ORDER BY x) ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) x FROM h) GROUP BY 1)
 SELECT doc_id, coalesce(len(ws), 0) AS n_words, coalesce(n.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n.n IS NOT NULL AS contaminated
 FROM w LEFT JOIN n USING (r) LEFT JOIN m USING (r)"""

#: All pairs of an anchor and another row.
_NEGATIVES = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
 list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
 p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
 SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id,
 positive_score, score AS negative_score FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""


def oracle_sql() -> dict[str, str]:
    return {"op2_near_dedup": _NEAR_DEDUP, "op10_chat_formatting": _CHAT, "op11_benchmark_decontamination": _DECONTAMINATION, "op13_hard_negatives": _NEGATIVES}
