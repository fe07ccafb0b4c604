"""Queries of edit scripts: turns against the versions of them that a clean-up or a careless edit would leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelattice.functions import text as tx
from cuelattice.operators import edits as ed
from cuelattice.queries.fold_queries import cues
from cuelattice.session import table


def reworded(text: Column) -> Column:
    """A text whose words change by their place: some are left out, doubled, respelt or exchanged for others."""
    by_place = lambda w, i: F.when(i % 11 == 4, F.array(w, w)).when(i % 13 == 6, F.array().cast("array<string>")).when(i % 17 == 8, F.array(F.concat(w, F.lit("s")))).when(i % 19 == 10, F.array(F.lit("other"))).otherwise(F.array(w))
    return F.array_join(F.flatten(F.transform(tx.pieces(text), by_place)), " ")


def edited_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", reworded(F.col("text")).alias("edited"))


def edit_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs between each turn's words and the next turn's."""
    t = table(spark, sf_dir, "conversations").withColumns({"a": ed.tokens(F.col("text")), "b": ed.tokens(F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))})
    return ed.edit_runs(t, ["conv_id", "turn"], "a", "b")


def aligned_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turns against those of a version that lacks some, has others twice, and changes a few."""
    c = cues(spark, sf_dir)
    kept = c.where("idx % 5 <> 2").withColumn("text", F.when(F.col("idx") % 7 == 3, F.concat("text", F.lit(" more"))).otherwise(F.col("text")))
    target = kept.union(c.where("idx % 9 = 4").withColumn("idx", F.col("idx") + 1)).dropDuplicates(["doc_id", "idx"])
    return ed.aligned(c, target.where("idx % 5 <> 2"), ["doc_id"])


def lexical_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ed.lexical_violations(edited_turns(spark, sf_dir), ["conv_id", "turn"], "text", "edited").withColumn("violations", F.array_join("violations", "\n"))


def copied_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of which every third takes the next one's first four tokens along, and every fifth the last four of the one before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lead("text").over(w).alias("n"), F.lag("text").over(w).alias("b"))
    few = lambda c, at: F.array_join(F.slice(ed.tokens(F.col(c)), at, 4), " ")
    last = F.greatest(F.lit(1), F.size(ed.tokens(F.col("b"))) - 3)
    edited = F.when(F.col("turn") % 3 == 0, F.concat_ws(" ", "text", few("n", 1))).when(F.col("turn") % 5 == 1, F.concat_ws(" ", few("b", last), "text")).otherwise(F.col("text"))
    return ed.copied_neighbours(t.withColumn("edited", edited), ["conv_id"], "turn", "text", "edited")


QUERIES = {f.__name__: f for f in (edit_runs, aligned_turns, lexical_violations, copied_neighbours)}

_T = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+(?:[''’][a-z0-9]+)?|[\\x{{3040}}-\\x{{30ff}}\\x{{31f0}}-\\x{{31ff}}\\x{{3400}}-\\x{{9fff}}\\x{{ac00}}-\\x{{d7af}}]')"
ORACLES = {
    "copied_neighbours": f"""
WITH t AS (SELECT conv_id, turn, text, lead(text) OVER w AS n, lag(text) OVER w AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
u AS (SELECT conv_id, turn, {_T.format('text')} AS a, {_T.format('n')} AS ns, n IS NULL AS no_n, {_T.format('b')} AS bs, b IS NULL AS no_b, text FROM t),
e AS (SELECT *, CASE WHEN turn % 3 = 0 THEN list_concat(a, ns[1:4]) WHEN turn % 5 = 1 THEN list_concat(bs[-4:], a) ELSE a END AS ed FROM u),
k AS (SELECT *, unnest(range(3, 13)) AS k FROM e WHERE ed <> a),
c AS (SELECT conv_id, turn, k, 'next' AS side, ns[1:k] AS p, ed[len(ed) - k + 1:] AS mine, a FROM k WHERE k <= len(ns) AND k <= len(ed)
  UNION ALL SELECT conv_id, turn, k, 'before', bs[len(bs) - k + 1:], ed[1:k], a FROM k WHERE k <= len(bs) AND k <= len(ed)),
f AS (SELECT * FROM c WHERE p = mine AND len(list_filter(range(1, len(a) - k + 2), lambda i: a[i : i + k - 1] = p)) = 0)
SELECT conv_id, turn, side, array_to_string(p, ' ') AS copied FROM f QUALIFY row_number() OVER (PARTITION BY conv_id, turn, side ORDER BY k DESC) = 1""",
}
