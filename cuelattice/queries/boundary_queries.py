"""Queries of boundaries: turns cut into cues of seven words, which cut phrases wherever they fall."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelattice.functions import text as tx
from cuelattice.operators import boundaries as bd
from cuelattice.session import table


def sevens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues of seven words, 200 ms a word, with a pause of two seconds between turns."""
    words = tx.pieces(F.col("text"))
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), "turn", "role", words.alias("ws"))
    cut = t.where(F.size("ws") > 0).select("doc_id", "turn", "role", "ws", F.explode(F.sequence(F.lit(0), F.ceil(F.size("ws") / 7).cast("int") - 1)).alias("k"))
    part = cut.withColumns({"part": F.slice("ws", F.col("k") * 7 + 1, 7), "idx": F.row_number().over(Window.partitionBy("doc_id").orderBy("turn", "k")).cast("long") - 1})
    start = F.col("turn").cast("long") * 1_000_000 + F.col("k") * 1400
    return part.select("doc_id", "idx", start.alias("start_ms"), (start + F.size("part") * 200).alias("end_ms"), F.array_join("part", " ").alias("text"), "role")


def boundary_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bd.assessed(sevens(spark, sf_dir), ["doc_id"], label="role").withColumn("reasons", F.array_join("reasons", ","))


def normalized_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bd.normalized(sevens(spark, sf_dir), "role")


QUERIES = {f.__name__: f for f in (boundary_risks, normalized_boundaries)}


def _in(column: str, values: frozenset[str] | None) -> list[str]:
    return [] if values is None else [f"{column} IN ({', '.join(repr(v) if chr(39) not in v else chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39) for v in sorted(values))})"]


def _rule(r: bd.Rule) -> str:
    tests = [
        *_in("tail", r.tail), *_in("head", r.head), *_in("tail || ' ' || head", r.seam), *_in("before || ' ' || tail", r.phrase),
        *([f"regexp_matches(a, '{r.tail_like}')"] if r.tail_like else []), *([f"regexp_matches(b, '{r.head_like}')"] if r.head_like else []), *(["NOT closed"] if r.open else []),
    ]
    return f"SELECT doc_id, idx, '{r.name}' AS rule, {n_of[r.name]} AS n, {r.weight} AS weight FROM o WHERE {' AND '.join(tests)}"


n_of = {r.name: i for i, r in enumerate(bd.RULES)}
_BARE = "regexp_replace(lower({}), '^[^A-Za-z0-9]+|[^A-Za-z0-9''’]+$', '', 'g')"
ORACLES = {
    "boundary_risks": f"""
WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, turn, role, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS ws FROM conversations),
k AS (SELECT doc_id, turn, role, ws[k * 7 + 1 : k * 7 + 7] AS p, k FROM t, unnest(range(0, (len(ws) + 6) // 7)) u(k) WHERE len(ws) > 0),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn, k) - 1 AS idx, turn * 1000000 + k * 1400 AS s FROM k),
l AS (SELECT *, lead(p) OVER w AS np, lead(s) OVER w AS ns, lead(role) OVER w AS nr FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
m AS (SELECT doc_id, idx, p[-1] AS a, np[1] AS b, {_BARE.format('p[-1]')} AS tail, {_BARE.format('np[1]')} AS head, coalesce({_BARE.format('p[-2]')}, '') AS before,
        ns - (s + len(p) * 200) > 1800 OR coalesce(role <> nr, false) AS hard FROM l WHERE np IS NOT NULL),
o AS (SELECT *, regexp_matches(a, '[,;:]["'')\\]]*$') AS closed FROM m WHERE NOT regexp_matches(a, '[.!?]["'')\\]]*$')),
r AS ({' UNION ALL '.join(_rule(r) for r in bd.RULES)}),
g AS (SELECT doc_id, idx, string_agg(rule, ',' ORDER BY n) AS reasons, sum(weight) AS w FROM r GROUP BY doc_id, idx)
SELECT m.doc_id, m.idx, coalesce(reasons, '') AS reasons, CAST(coalesce(w + CASE WHEN regexp_matches(b, '^\\p{{Ll}}') THEN 4 ELSE 0 END, 0) AS INT) AS risk,
  coalesce(w + CASE WHEN regexp_matches(b, '^\\p{{Ll}}') THEN 4 ELSE 0 END, 0) >= 20 AS unstable, hard FROM m LEFT JOIN g USING (doc_id, idx)""",
}
