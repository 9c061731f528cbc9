"""The contract queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideline.llm.annsearch import op9_nearest
from tideline.llm.bpe import op5_bpe
from tideline.llm.htmlmain import op7_html_extraction
from tideline.llm.langid import op8_language_id
from tideline.llm.minhash import op2_minhash
from tideline.llm.packing import op4_packing
from tideline.llm.quality import op6_quality
from tideline.llm.secrets import op1_secrets
from tideline.llm.tokencount import op3_token_counts
from tideline.llm.toxicity import op10_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_minhash": op2_minhash,
    "op3_token_counts": op3_token_counts,
    "op4_packing": op4_packing,
    "op5_bpe": op5_bpe,
    "op6_quality": op6_quality,
    "op7_html_extraction": op7_html_extraction,
    "op8_language_id": op8_language_id,
    "op9_nearest": op9_nearest,
    "op10_toxicity": op10_toxicity,
}

#: DuckDB SQL of those that SQL can express.
SQL: dict[str, str] = {
    "op2_minhash": r"""WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS words FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')] ELSE [array_to_string(words[i:i + 3], ' ') FOR i IN range(1, len(words) - 2)] END) AS shingle FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
 e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id),
 c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
 SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = d.doc_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)""",
    # Every cell that may hold one of a query's nearest is searched, so the index is exact.
    "op9_nearest": """WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
 s AS (SELECT * FROM a WHERE len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
 v AS (SELECT * FROM s WHERE len(e) = (SELECT len(e) FROM s GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)),
 p AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
 r AS (SELECT query_id, (ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM p)
 SELECT * FROM r WHERE rank <= 20""",
}
