"""Query op13: codes of all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.llm import codes as C


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every valid vector's code and error, the error of its label, and the digest of the codebooks."""
    vectors = C.integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding"))
    codebooks = C.train(vectors)
    coded = C.with_label_errors(C.encode(vectors, codebooks))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(C.digest(codebooks)).alias("codebooks_sha256"))


def _assigned(n: int) -> str:
    """Parts with the nearest entry of codebook n; inner products of integers are exact as doubles."""
    d = "list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, c.x) + list_inner_product(c.x, c.x)"
    return f"a{n} AS (SELECT p.r, p.part, min({{'d': ({d})::BIGINT, 'e': c.e}}) AS b FROM p JOIN c{n} AS c USING (part) GROUP BY ALL)"


def _updated(n: int) -> str:
    return f"""s{n} AS (SELECT part, e, list(v ORDER BY i) AS x FROM (SELECT part, a.b.e AS e, i, floor(sum(p.x[i]) / count(*)) AS v
  FROM p JOIN a{n - 1} AS a USING (r, part), (SELECT unnest(range(1, w + 1)) AS i FROM n) GROUP BY ALL) GROUP BY ALL),
c{n} AS (SELECT part, e, coalesce(s.x, c.x) AS x FROM c{n - 1} AS c LEFT JOIN s{n} AS s USING (part, e))"""


OP13_SQL = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(greatest(-{C.FARTHEST}, least({C.FARTHEST}, {C.SCALE} * x::DOUBLE)))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
n AS (SELECT ((max(len(x)) + {C.PARTS - 1}) // {C.PARTS})::BIGINT AS w FROM k),
v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS r, vec_id, label, list_resize(x, {C.PARTS} * w, 0) AS x FROM k, n),
p AS (SELECT r, part, x[part * w + 1 : part * w + w] AS x FROM v, n, (SELECT unnest(range({C.PARTS})) AS part)),
c0 AS (SELECT part, r - 1 AS e, x FROM p WHERE r <= {C.ENTRIES}),
{_assigned(0)},
{", ".join(_updated(n) + ", " + _assigned(n) for n in range(1, C.ROUNDS + 1))},
o AS (SELECT r, string_agg(lpad(lower(to_hex(b.e)), 2, '0'), '' ORDER BY part) AS code, sum(b.d)::BIGINT AS error FROM a{C.ROUNDS} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: y::BIGINT), ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c{C.ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN o USING (r), h
"""
QUERIES = {"op13_vector_codes": op13_vector_codes}
ORACLES = {"op13_vector_codes": OP13_SQL}
