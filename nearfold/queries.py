"""The library's own queries over the driver's tables, and the same results as SQL for DuckDB.

`vt` is the vector table that they share. Distances are rounded to six digits before ranking, so that both engines
rank alike; `+ 0.0` makes a negative zero positive.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.distance import distance, distance_to, expanded_l2, norm
from .functions.ranking import global_rank
from .functions.values import colour_index, crc32, literal_column, metadata_json
from .operators import analytics as A
from .operators import lifecycle as C
from .operators import scratch
from .operators import search as S
from .operators.index import VectorIndex, assign, kmeans, label_centres, prepared, sample_matrix
from .plans import ladder as L
from .plans import predicates as P
from .sources import datagen
from .streaming.mutations import last_of_each, visible_state
from .types import ColumnType, MetadataSchema, Metric

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DIM = 64
SCHEMA = MetadataSchema((("label", ColumnType.I64), ("active", ColumnType.BOOL), ("rank", ColumnType.I64), ("score", ColumnType.F64), ("name", ColumnType.STRING)))
VT = (
    "SELECT vec_id AS id, embedding AS vector, CAST(label AS BIGINT) AS label, (vec_id % 2 = 0) AS active, vec_id AS rank, "
    "(vec_id % 97) / CAST(97.0 AS DOUBLE) AS score, concat('v', CAST(vec_id AS STRING)) AS name FROM embeddings"
)
#: Rows with a missing and a not-a-number value beside a few ordinary ones.
ODD = (
    "SELECT vec_id AS id, embedding AS vector, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE CAST(label AS BIGINT) END AS label, (vec_id % 2 = 0) AS active, vec_id AS rank, "
    "CASE WHEN vec_id % 7 = 0 THEN CAST('NaN' AS DOUBLE) WHEN vec_id % 11 = 0 THEN NULL ELSE (vec_id % 97) / CAST(97.0 AS DOUBLE) END AS score, concat('v', CAST(vec_id AS STRING)) AS name FROM embeddings"
)


def register(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vt(spark: SparkSession, sf_dir: str, sql: str = VT) -> DataFrame:
    return spark.sql(sql.replace("FROM embeddings", "FROM {embeddings}"), embeddings=table(spark, sf_dir, "embeddings"))


def query_vector(rows: DataFrame, id_: int = 0) -> list[float]:
    return list(rows.where(F.col("id") == id_).select("vector").first()["vector"])


# -- one query ---------------------------------------------------------------------------------------------------

_Q = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"
_DOUBLE = "CAST(vector AS DOUBLE[])"
DISTANCE_SQL = {
    Metric.COSINE: f"1.0 - list_inner_product({_DOUBLE}, {_Q}) / (sqrt(list_inner_product({_DOUBLE}, {_DOUBLE})) * sqrt(list_inner_product({_Q}, {_Q})))",
    Metric.L2: f"list_inner_product({_DOUBLE}, {_DOUBLE}) + list_inner_product({_Q}, {_Q}) - 2 * list_inner_product({_DOUBLE}, {_Q})",
    Metric.DOT: f"-list_inner_product({_DOUBLE}, {_Q})",
}


def knn_sql(metric: Metric = Metric.COSINE, where: str = "true", k: int = 10, base: str = VT, columns: str = "id, distance, label, name") -> str:
    return f"WITH vt AS ({base}), d AS (SELECT *, round({DISTANCE_SQL[metric]}, 6) + 0.0 AS distance FROM vt WHERE {where}) SELECT {columns} FROM d ORDER BY distance, id LIMIT {k}"


def knn(name: str, metric: Metric = Metric.COSINE, predicate: P.Predicate | None = None, where: str = "true", k: int = 10, base: str = VT) -> None:
    @register(name, knn_sql(metric, where, k, base))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = vt(spark, sf_dir, base)
        q = query_vector(rows)
        if predicate is not None:
            P.validate(predicate, SCHEMA)
            rows = rows.where(P.compile_predicate(predicate, SCHEMA))
        return S.nearest(rows, q, metric, k, digits=6).select("id", "distance", "label", "name")


knn("knn_cosine")
knn("knn_l2", Metric.L2)
knn("knn_dot", Metric.DOT)
knn("knn_top1", k=1)
knn("knn_top1000", k=1000)
knn("knn_filter_eq", predicate=P.eq("label", 3), where="label = 3")
knn("knn_filter_ne", predicate=P.ne("label", 3), where="label <> 3")
knn("knn_filter_lt", predicate=P.lt("rank", 100), where="rank < 100")
knn("knn_filter_lte", predicate=P.lte("rank", 100), where="rank <= 100")
knn("knn_filter_gt", predicate=P.gt("score", 0.5), where="score > 0.5")
knn("knn_filter_gte", predicate=P.gte("score", 0.5), where="score >= 0.5")
knn("knn_filter_in", predicate=P.is_in("label", [1, 2, 7]), where="label IN (1, 2, 7)")
knn("knn_filter_and", predicate=P.eq("active", True) & P.gte("rank", 50), where="active AND rank >= 50")
knn("knn_filter_or", predicate=P.eq("label", 1) | P.lt("rank", 40), where="label = 1 OR rank < 40")
knn("knn_filter_not", predicate=~P.eq("label", 3), where="NOT (label = 3)")
knn("knn_filter_bool", Metric.L2, P.ne("active", True), "active <> true")
knn("knn_filter_nested", predicate=P.gte("rank", 2) & (P.eq("active", True) | P.is_in("rank", [3, 5])) & ~P.eq("rank", 4), where="rank >= 2 AND (active OR rank IN (3, 5)) AND NOT rank = 4")
knn("knn_in_empty", predicate=P.is_in("label", []), where="false")
knn("knn_and_empty", predicate=P.all_of(), where="true")
knn("knn_or_empty", predicate=P.any_of(), where="false")
knn("knn_not_nullable", predicate=~P.eq("label", 3), where="label IS NULL OR label <> 3", base=ODD)
knn("knn_nan_eq", predicate=P.eq("score", 0.0), where="score = 0.0 AND NOT isnan(score)", base=ODD)
knn("knn_nan_ne", predicate=P.ne("score", 0.0), where="score IS NOT NULL AND (isnan(score) OR score <> 0.0)", base=ODD)
knn("knn_nan_gt", predicate=P.gt("score", 0.5), where="score > 0.5 AND NOT isnan(score)", base=ODD)
knn("knn_nan_not_gt", predicate=~P.gt("score", 0.5), where="score IS NULL OR isnan(score) OR NOT score > 0.5", base=ODD)
knn("knn_nan_not_ne", predicate=~P.ne("score", 0.0), where="score IS NULL OR (score = 0.0 AND NOT isnan(score))", base=ODD)
knn("knn_nan_literal", predicate=P.ne("score", float("nan")), where="score IS NOT NULL", base=ODD)


@register("knn_filter_json", knn_sql(where="rank >= 2 AND (active OR rank IN (3, 5)) AND NOT rank = 4"))
def knn_filter_json(spark, sf_dir):
    rows = vt(spark, sf_dir)
    text = '{"op":"and","children":[{"op":"gte","column":"rank","value":2},{"op":"or","children":[{"op":"eq","column":"active","value":true},{"op":"in","column":"rank","values":[3,5]}]},{"op":"not","child":{"op":"eq","column":"rank","value":4}}]}'
    return S.nearest(rows.where(P.compile_predicate(P.from_json(text, SCHEMA), SCHEMA)), query_vector(rows), Metric.COSINE, 10, digits=6).select("id", "distance", "label", "name")


@register("knn_filter_rules", knn_sql(where="NOT (label IN (1, 2) OR score > 0.5)"))
def knn_filter_rules(spark, sf_dir):
    rows = vt(spark, sf_dir)
    tree = P.from_json(P.from_rules([("label", "in", "1, 2"), ("score", "gt", "0.5")], "or", negate=True), SCHEMA)
    return S.nearest(rows.where(P.compile_predicate(tree, SCHEMA)), query_vector(rows), Metric.COSINE, 10, digits=6).select("id", "distance", "label", "name")


@register("knn_ties", f"WITH vt AS ({VT}) SELECT id, round(abs(CAST(vector[1] AS DOUBLE)), 1) + 0.0 AS distance FROM vt ORDER BY distance, id LIMIT 25")
def knn_ties(spark, sf_dir):
    rows = vt(spark, sf_dir).select("id", F.array(F.round(F.abs(F.col("vector")[0].cast("double")), 1)).alias("vector"))
    found = rows.withColumn("distance", F.round(F.sqrt(distance_to(Metric.L2, F.col("vector"), [0.0])), 6) + F.lit(0.0))
    return found.orderBy("distance", "id").limit(25).select("id", "distance")


@register("knn_hits_json", f"WITH vt AS ({VT}), d AS (SELECT *, round({DISTANCE_SQL[Metric.COSINE]}, 6) + 0.0 AS distance FROM vt) SELECT id, distance, concat('{{\"active\":', CAST(active AS VARCHAR), ',\"label\":', CAST(label AS VARCHAR), ',\"name\":\"', name, '\",\"rank\":', CAST(rank AS VARCHAR), '}}') AS metadata_json FROM d ORDER BY distance, id LIMIT 10")
def knn_hits_json(spark, sf_dir):
    rows = vt(spark, sf_dir)
    schema = MetadataSchema(tuple(c for c in SCHEMA.columns if c[0] != "score"))
    return S.hits(S.nearest(rows, query_vector(rows), Metric.COSINE, 10, digits=6), schema)


@register("exact_oracle_zero_norm", "SELECT vec_id AS id, CASE WHEN label = 0 THEN CAST('inf' AS DOUBLE) ELSE 0.0 END AS oracle, CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END AS engine FROM embeddings")
def exact_oracle_zero_norm(spark, sf_dir):
    rows = vt(spark, sf_dir).select("id", F.array(F.col("label").cast("float"), F.lit(0.0).cast("float")).alias("vector"))
    of = lambda zero: F.round(distance_to(Metric.COSINE, F.col("vector"), [1.0, 0.0], zero), 6) + F.lit(0.0)
    return rows.select("id", of(float("inf")).alias("oracle"), of(1.0).alias("engine"))


@register("vector_norms", f"WITH vt AS ({VT}) SELECT id, round(sqrt(list_inner_product({_DOUBLE}, {_DOUBLE})), 6) AS norm FROM vt")
def vector_norms(spark, sf_dir):
    return vt(spark, sf_dir).select("id", F.round(norm(F.col("vector")), 6).alias("norm"))


@register("l2_expanded", f"WITH vt AS ({VT}) SELECT id, round({DISTANCE_SQL[Metric.L2]}, 6) + 0.0 AS expanded, round({DISTANCE_SQL[Metric.L2]}, 6) + 0.0 AS direct FROM vt")
def l2_expanded(spark, sf_dir):
    rows = vt(spark, sf_dir)
    q = F.array(*[F.lit(float(x)) for x in query_vector(rows)])
    return rows.select("id", (F.round(expanded_l2(F.col("vector"), q), 6) + F.lit(0.0)).alias("expanded"), (F.round(distance(Metric.L2, F.col("vector"), q), 6) + F.lit(0.0)).alias("direct"))


@register("profile_search", f"WITH vt AS ({VT}) SELECT count(*) AS total_rows, count(*) FILTER (active AND label <> 3) AS matched_rows, least(count(*) FILTER (active AND label <> 3), 10) AS returned_rows FROM vt")
def profile_search(spark, sf_dir):
    rows = vt(spark, sf_dir).withColumn("generation", F.col("id"))
    tombs = rows.where("label = 3").select("id", "generation")
    return S.profile_counts(rows, tombs, P.compile_predicate(P.eq("active", True), SCHEMA), 10)


# -- many queries ------------------------------------------------------------------------------------------------

_PAIRS = "SELECT q.vec_id AS query_id, e.vec_id AS id, e.label, round(1.0 - list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))), 6) + 0.0 AS distance FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0"


def batch_sql(where: str = "true", k: int = 10) -> str:
    return f"WITH p AS ({_PAIRS}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM p WHERE {where}) SELECT query_id, rank, id, distance FROM r WHERE rank <= {k}"


def batch_queries(rows: DataFrame) -> S.Queries:
    """The stated set of queries: every row whose id is divisible by 20, against all rows."""
    return S.Queries.collect(rows.where("id % 20 = 0"))


@register("batch_knn", batch_sql())
def batch_knn(spark, sf_dir):
    rows = vt(spark, sf_dir)
    return S.batch_knn(rows, batch_queries(rows), Metric.COSINE, 10, digits=6)


@register("batch_knn_filtered", batch_sql("label IN (0, 1, 2)"))
def batch_knn_filtered(spark, sf_dir):
    rows = vt(spark, sf_dir)
    return S.batch_knn(rows.where(P.compile_predicate(P.is_in("label", [0, 1, 2]), SCHEMA)), batch_queries(rows), Metric.COSINE, 10, digits=6)


def _tier(share: float, name: str) -> None:
    keep = P.selectivity_categories(share, 10)

    @register(name, batch_sql("true" if keep is None else f"label IN ({', '.join(map(str, keep))})"))
    def run(spark, sf_dir):
        rows = vt(spark, sf_dir)
        return S.filtered_knn(rows, batch_queries(rows), Metric.COSINE, 10, share, 10, "label", digits=6)


_tier(1.0, "selectivity_tier_1")
_tier(0.5, "selectivity_tier_0_5")
_tier(0.1, "selectivity_tier_0_1")


@register("ground_truth_arrays", f"WITH r AS ({batch_sql()}) SELECT query_id, list(id ORDER BY rank) AS ids, list(distance ORDER BY rank) AS distances FROM r GROUP BY query_id")
def ground_truth_arrays(spark, sf_dir):
    rows = vt(spark, sf_dir)
    return S.ground_truth(rows, batch_queries(rows), Metric.COSINE, 10, digits=6)


_RECALL = f"WITH t AS ({batch_sql()}), f AS ({batch_sql('label <= 4')}) SELECT t.query_id, count(f.id) / CAST(count(*) AS DOUBLE) AS recall FROM t LEFT JOIN f ON f.query_id = t.query_id AND f.id = t.id GROUP BY t.query_id"


@register("recall_at_k", _RECALL)
def recall_at_k(spark, sf_dir):
    rows = vt(spark, sf_dir)
    q = batch_queries(rows)
    return A.recall(S.batch_knn(rows.where("label <= 4"), q, Metric.COSINE, 10, digits=6), S.batch_knn(rows, q, Metric.COSINE, 10, digits=6))


@register("mean_recall", f"SELECT round(avg(recall), 9) AS recall FROM ({_RECALL})")
def mean_recall(spark, sf_dir):
    return recall_at_k(spark, sf_dir).agg(F.round(F.avg("recall"), 9).alias("recall"))


# -- write path and compaction, with the events as a log of mutations ----------------------------------------------

EVENTS = "SELECT user_id AS id, event_id AS generation, event_type, value FROM events"


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("user_id AS id", "event_id AS generation", "event_type", "value")


_GONE = f"e AS ({EVENTS}), g AS (SELECT id, max(generation) AS gone_at FROM e WHERE event_type = 'error' GROUP BY id)"


@register("visible_rows", f"WITH {_GONE} SELECT e.id, e.generation, e.value FROM e LEFT JOIN g USING (id) WHERE e.event_type <> 'error' AND (gone_at IS NULL OR e.generation > gone_at)")
def visible_rows(spark, sf_dir):
    return visible_state(events(spark, sf_dir), F.col("event_type") == "error").select("id", "generation", "value")


def log_and_tombs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The inserted rows, and the (id, generation) that the log's deletes hide."""
    log = events(spark, sf_dir)
    gone = log.where("event_type = 'error'").groupBy("id").agg(F.max("generation").alias("gone_at"))
    rows = log.where("event_type <> 'error'")
    return rows, rows.join(gone, "id").where("generation < gone_at").select("id", "generation")


_LOG = f"{_GONE}, l AS (SELECT * FROM e WHERE event_type <> 'error'), t AS (SELECT l.id, l.generation FROM l JOIN g USING (id) WHERE l.generation < gone_at)"


@register("tombstone_visibility", f"WITH {_LOG} SELECT id, generation, value FROM l WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.id = l.id AND t.generation = l.generation)")
def tombstone_visibility(spark, sf_dir):
    log, tombs = log_and_tombs(spark, sf_dir)
    return S.visible(log, tombs).select("id", "generation", "value")


@register("tombstoned_ids", f"WITH {_LOG} SELECT DISTINCT id FROM t")
def tombstoned_ids(spark, sf_dir):
    return log_and_tombs(spark, sf_dir)[1].select("id").distinct()


@register("id_level_hidden", f"WITH {_LOG} SELECT id, generation FROM l WHERE id IN (SELECT id FROM t)")
def id_level_hidden(spark, sf_dir):
    return S.hidden_by_id(*log_and_tombs(spark, sf_dir)).select("id", "generation")


@register("update_visible", f"WITH e AS ({EVENTS}) SELECT id, max(generation) AS generation, arg_max(value, generation) AS value FROM e GROUP BY id")
def update_visible(spark, sf_dir):
    return last_of_each(events(spark, sf_dir).withColumnRenamed("generation", "seq")).select("id", F.col("seq").alias("generation"), "value")


_KEPT = f"{_LOG}, v AS (SELECT * FROM l WHERE (id, generation) NOT IN (SELECT (id, generation) FROM t)), k AS (SELECT id, max(generation) AS generation, arg_max(value, generation) AS value FROM v GROUP BY id)"


@register("compact_merge", f"WITH {_KEPT} SELECT * FROM k")
def compact_merge(spark, sf_dir):
    return C.merged(*log_and_tombs(spark, sf_dir), purge_ratio=0.2)[0].select("id", "generation", "value")


@register("compact_retained", f"WITH {_KEPT}, h AS (SELECT * FROM l WHERE (id, generation) IN (SELECT (id, generation) FROM t)) SELECT id, max(generation) AS generation, arg_max(value, generation) AS value FROM h WHERE id NOT IN (SELECT id FROM k) GROUP BY id")
def compact_retained(spark, sf_dir):
    return C.merged(*log_and_tombs(spark, sf_dir), purge_ratio=1.0)[1].select("id", "generation", "value")


@register("purge_gate", f"WITH {_LOG} SELECT (SELECT count(*) FROM l) AS rows, (SELECT count(*) FROM t) AS hidden, round((SELECT count(*) FROM t) / CAST((SELECT count(*) FROM l) AS DOUBLE), 9) AS ratio, (SELECT count(*) FROM t) / CAST((SELECT count(*) FROM l) AS DOUBLE) > 0.2 AS purge")
def purge_gate(spark, sf_dir):
    found = C.dead_ratio(*log_and_tombs(spark, sf_dir))
    return found.select("rows", "hidden", F.round("ratio", 9).alias("ratio"), (F.col("ratio") > 0.2).alias("purge"))


_CASES = [(100, 0, 0, 9), (100, 0, 0, 100_000), (20_000_000, 98_304, 1, 100_000), (20_000_000, 98_304, 1, 101_696), (393_216, 393_216, 4, 0), (50_000, 0, 4, 0), (50_000, 0, 3, 0)]


@register("trigger_eval", f"SELECT *, CASE WHEN sealed_rows + tombstoned >= greatest(CAST(floor(rows * 0.01) AS BIGINT), 100000) THEN 'change_threshold' WHEN sealed >= 4 THEN 'delta_count' END AS trigger FROM (VALUES {', '.join(f'({a}::BIGINT, {b}::BIGINT, {c}::BIGINT, {d}::BIGINT)' for a, b, c, d in _CASES)}) AS c(rows, sealed_rows, sealed, tombstoned)")
def trigger_eval(spark, sf_dir):
    config = C.CompactionConfig()
    return spark.createDataFrame([(*c, C.trigger(config, *c)) for c in _CASES], "rows long, sealed_rows long, sealed long, tombstoned long, trigger string")


_SEGMENTS = "SELECT id, CASE WHEN place < (n // 1000) * 1000 THEN place // 1000 END AS segment_no FROM (SELECT event_id AS id, row_number() OVER (ORDER BY event_id) - 1 AS place, count(*) OVER () AS n FROM events)"


def segments(spark, sf_dir, rows_each: int = 1000) -> DataFrame:
    ranked = global_rank(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id"), ["id"], "place")
    sealed = (ranked.count() // rows_each) * rows_each
    return ranked.withColumn("segment_no", F.when(F.col("place") < sealed, F.floor(F.col("place") / rows_each).cast("long")))


@register("segment_layout", f"SELECT segment_no, count(*) AS rows, min(id) AS first_id, max(id) AS last_id FROM ({_SEGMENTS}) GROUP BY segment_no")
def segment_layout(spark, sf_dir):
    return segments(spark, sf_dir).groupBy("segment_no").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@register("lifecycle_export", f"WITH {_LOG}, s AS ({_SEGMENTS}) SELECT segment_no, count(*) AS rows, count(x.id) AS dead FROM s JOIN events ON events.event_id = s.id LEFT JOIN (SELECT DISTINCT id FROM t) x ON x.id = events.user_id GROUP BY segment_no")
def lifecycle_export(spark, sf_dir):
    gone = log_and_tombs(spark, sf_dir)[1].select(F.col("id").alias("user_id")).distinct().withColumn("gone", F.lit(1))
    return C.segment_summary(segments(spark, sf_dir).join(gone, "user_id", "left"))


@register("table_status", "SELECT 'embeddings' AS name, count(*) AS vectors FROM embeddings UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def table_status(spark, sf_dir):
    parts = [table(spark, sf_dir, n).agg(F.count(F.lit(1)).alias("vectors")).select(F.lit(n).alias("name"), "vectors") for n in ("embeddings", "events", "lineitem")]
    return parts[0].union(parts[1]).union(parts[2])


# -- indexes -----------------------------------------------------------------------------------------------------

_COUNTS = [0, 1, 9_998, 9_999, 10_000, 10_001, 49_999, 50_000, 999_998, 999_999, 1_000_000]


@register("ladder_choice", f"SELECT n, CASE WHEN n < 10000 THEN 'exhaustive' WHEN n < 1000000 THEN 'hnsw' ELSE 'ivf_pq' END AS kind, CASE WHEN n < 10000 THEN 'not_needed' WHEN n >= 50000 THEN 'background' ELSE 'inline' END AS disposition FROM (VALUES {', '.join(f'({n}::BIGINT)' for n in _COUNTS)}) AS c(n)")
def ladder_choice(spark, sf_dir):
    rows = spark.createDataFrame([(n,) for n in _COUNTS], "n long")
    return rows.select("n", L.ladder_column(F.col("n")).alias("kind"), L.disposition_column(F.col("n")).alias("disposition"))


@register("calibration_grid", "SELECT * FROM (VALUES (0, 4, 64), (1, 1, 16), (2, 1, 32), (3, 1, 64), (4, 2, 16), (5, 2, 32), (6, 2, 64), (7, 4, 40)) AS g(place, probes, ef)")
def calibration_grid(spark, sf_dir):
    return spark.createDataFrame([(i, k.probes, k.ef_search) for i, k in enumerate(L.calibration_grid(10))], "place int, probes int, ef int")


_CENTRES = "c AS (SELECT centre_id, list(m ORDER BY i) AS centre FROM (SELECT CAST(label AS BIGINT) AS centre_id, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) AS r(i) GROUP BY ALL) GROUP BY centre_id)"
_NEAR = "round(list_inner_product(a, a) + list_inner_product(centre, centre) - 2 * list_inner_product(a, centre), 9)"
_ASSIGN = f"{_CENTRES}, a AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings), n AS (SELECT id, arg_min(centre_id, ({_NEAR}, centre_id)) AS centre_id FROM a, c GROUP BY id)"


def _assigned(rows: DataFrame, dim: int = DIM) -> tuple[DataFrame, list]:
    """id, vector and the nearest label's centre of every row, and the centres (one a label)."""
    centres = label_centres(rows, "label", dim).orderBy("centre_id").collect()
    names = F.array(*[F.lit(c["centre_id"]) for c in centres])
    placed = assign(rows, np.array([c["centre"] for c in centres]), Metric.L2)
    return placed.select("id", "vector", names[F.col("partition_id")].alias("centre_id")), centres


@register("ivf_assign", f"WITH {_ASSIGN} SELECT id, centre_id FROM n")
def ivf_assign(spark, sf_dir):
    return _assigned(vt(spark, sf_dir))[0].select("id", "centre_id")


def ivf_sql(probes: int) -> str:
    order = f"row_number() OVER (ORDER BY {_NEAR.replace('a, a', 'q, q').replace('(a,', '(q,')}, centre_id)"
    return (
        f"WITH {_ASSIGN}, qq AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), p AS (SELECT centre_id, {order} AS place FROM c, qq), "
        f"vt AS ({VT}), d AS (SELECT vt.id, round({DISTANCE_SQL[Metric.COSINE]}, 6) + 0.0 AS distance FROM vt JOIN n USING (id) JOIN p USING (centre_id) WHERE place <= {probes}) SELECT id, distance FROM d ORDER BY distance, id LIMIT 10"
    )


def _ivf(probes: int) -> None:
    @register(f"ivf_search_p{probes}", ivf_sql(probes))
    def run(spark, sf_dir):
        rows = vt(spark, sf_dir)
        placed, centres = _assigned(rows)
        q = query_vector(rows)
        apart = lambda c: round(sum(x * x for x in q) + sum(x * x for x in c) - 2 * sum(x * y for x, y in zip(q, c)), 9)
        order = sorted((apart(c["centre"]), c["centre_id"]) for c in centres)
        probed = placed.where(F.col("centre_id").isin([c for _, c in order[:probes]]))
        return S.nearest(probed, q, Metric.COSINE, 10, digits=6).select("id", "distance")


for _p in (1, 2, 4, 10):
    _ivf(_p)


@register("ivf_kmeans")
def ivf_kmeans(spark, sf_dir):
    """Cells of a seeded k-means and their sizes."""
    rows = vt(spark, sf_dir)
    centres = kmeans(prepared(Metric.COSINE, sample_matrix(rows)), 8)
    return assign(rows, centres, Metric.COSINE).groupBy("partition_id").agg(F.count(F.lit(1)).alias("rows"))


_INDEXES: dict[tuple[str, str, str], VectorIndex] = {}


def index_of(spark: SparkSession, sf_dir: str, kind: str) -> VectorIndex:
    """An index of that kind with the ladder's own parameters over all vectors, built once in a session."""
    name = (spark.sparkContext.applicationId, sf_dir, kind)
    if name not in _INDEXES:
        index = VectorIndex(spark, scratch.folder(spark, kind), DIM, Metric.COSINE)
        index.write(vt(spark, sf_dir).select("id", "vector"))
        index.build(L.default_params(kind, DIM, index.row_count()))
        _INDEXES[name] = index
    return _INDEXES[name]


def recall_of(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = vt(spark, sf_dir)
    q = batch_queries(rows)
    return A.recall(index_of(spark, sf_dir, kind).query_batch(q), S.batch_knn(rows, q, Metric.COSINE, 10))


@register("ivf_recall")
def ivf_recall(spark, sf_dir):
    """Recall of ten neighbours that the graph kind of index finds with its default parameters and knobs, query by query."""
    return recall_of(spark, sf_dir, L.HNSW)


@register("pq_recall")
def pq_recall(spark, sf_dir):
    """The same of the product-quantised kind."""
    return recall_of(spark, sf_dir, L.IVF_PQ)


@register("pq_search")
def pq_search(spark, sf_dir):
    """Ten nearest to one vector by a product-quantised index."""
    return index_of(spark, sf_dir, L.IVF_PQ).query_batch([(0, query_vector(vt(spark, sf_dir)))])


# -- statistics --------------------------------------------------------------------------------------------------


@register("latency_percentiles", "WITH r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS place, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT CAST(p AS INTEGER) AS percent, value FROM r, (VALUES (0), (50), (90), (99), (100)) AS w(p) WHERE place = (n - 1) * p // 100")
def latency_percentiles(spark, sf_dir):
    return A.percentiles(table(spark, sf_dir, "events"), "value", [0, 50, 90, 99, 100])


@register("latency_nearest_rank", "WITH r AS (SELECT value, row_number() OVER (ORDER BY value) AS place, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT CAST(q AS DOUBLE) AS quantile, value FROM r, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) AS w(q) WHERE place = greatest(1, CAST(ceil(q * n - 1e-12) AS BIGINT))")
def latency_nearest_rank(spark, sf_dir):
    return A.nearest_rank(table(spark, sf_dir, "events"), "value", [0.25, 0.5, 0.95, 0.99])


@register("latency_summary", "SELECT count(value) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events")
def latency_summary(spark, sf_dir):
    return A.summary(table(spark, sf_dir, "events"), "value").withColumn("mean", F.round("mean", 6))


_BINS = "WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events), v AS (SELECT least(23, CAST(floor((value - lo) / ((hi - lo) / 24)) AS BIGINT)) AS bin FROM events, e WHERE value IS NOT NULL) SELECT b.bin, count(v.bin) AS n FROM range(24) AS b(bin) LEFT JOIN v ON v.bin = b.bin GROUP BY b.bin"


@register("histogram_equal_width", _BINS)
def histogram_equal_width(spark, sf_dir):
    return A.histogram(table(spark, sf_dir, "events"), "value", 24).select("bin", "n")


_POINTS = "SELECT event_type AS name, round(avg(value), 6) AS latency, round(count(*) FILTER (value > 50) / CAST(count(*) AS DOUBLE), 6) AS recall FROM events GROUP BY event_type"


@register("pareto", f"WITH p AS ({_POINTS}) SELECT *, NOT EXISTS (SELECT 1 FROM p o WHERE (o.latency < p.latency AND o.recall >= p.recall) OR (o.latency = p.latency AND o.recall > p.recall) OR (o.latency = p.latency AND o.recall = p.recall AND o.name < p.name)) AS optimal FROM p")
def pareto(spark, sf_dir):
    points = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.round(F.avg("value"), 6).alias("latency"), F.round(F.count_if(F.col("value") > 50) / F.count(F.lit(1)), 6).alias("recall"))
    return A.pareto(points)


@register("pareto_verdict", f"WITH p AS ({_POINTS}) SELECT a.name, b.name AS other, a.recall >= b.recall AND a.latency <= b.latency AS better FROM p a JOIN p b ON a.name < b.name")
def pareto_verdict(spark, sf_dir):
    p = pareto(spark, sf_dir).drop("optimal")
    other = p.toDF("other", "other_latency", "other_recall")
    same = A.better(F.col("recall"), F.col("latency"), F.col("latency"), F.col("other_recall"), F.col("other_latency"), F.col("other_latency"))
    return p.join(other, F.col("name") < F.col("other")).select("name", "other", same.alias("better"))


@register("selectivity_tiers", "SELECT * FROM (VALUES (1, 0.001::DOUBLE), (10, 0.01::DOUBLE), (100, 0.1::DOUBLE), (1000, 1.0::DOUBLE)) AS t(divisor, share)")
def selectivity_tiers(spark, sf_dir):
    return spark.createDataFrame(list(zip((1, 10, 100, 1000), P.selectivity_tiers(1000))), "divisor int, share double")


@register("pca_mean", "SELECT CAST(i - 1 AS INTEGER) AS component, round(avg(CAST(embedding[i] AS DOUBLE)), 9) + 0.0 AS mean FROM embeddings, range(1, 65) AS r(i) GROUP BY i")
def pca_mean(spark, sf_dir):
    _, mean, _ = A.moments(vt(spark, sf_dir))
    return spark.createDataFrame([(i, float(m)) for i, m in enumerate(mean)], "component int, mean double").withColumn("mean", F.round("mean", 9) + F.lit(0.0))


@register("pca_covariance", "SELECT CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, round(covar_pop(CAST(embedding[i] AS DOUBLE), CAST(embedding[j] AS DOUBLE)), 7) + 0.0 AS covariance FROM embeddings, range(1, 65) AS a(i), range(1, 65) AS b(j) WHERE i <= j GROUP BY i, j")
def pca_covariance(spark, sf_dir):
    _, _, c = A.moments(vt(spark, sf_dir))
    rows = [(i, j, float(c[i, j])) for i in range(len(c)) for j in range(i, len(c))]
    return spark.createDataFrame(rows, "i int, j int, covariance double").withColumn("covariance", F.round("covariance", 7) + F.lit(0.0))


@register("pca_projection")
def pca_projection(spark, sf_dir):
    """Every vector on the first three principal components."""
    rows = vt(spark, sf_dir)
    return A.principal_components(rows, 3).apply(rows)


# -- values and generated rows -------------------------------------------------------------------------------------


@register("metadata_json", f"WITH vt AS ({VT}) SELECT id, concat('{{\"active\":', CAST(active AS VARCHAR), ',\"label\":', CAST(label AS VARCHAR), ',\"name\":\"', name, '\",\"rank\":', CAST(rank AS VARCHAR), '}}') AS metadata_json FROM vt")
def metadata_as_json(spark, sf_dir):
    return vt(spark, sf_dir).select("id", metadata_json(MetadataSchema(tuple(c for c in SCHEMA.columns if c[0] != "score"))).alias("metadata_json"))


@register("metadata_literals", "SELECT vec_id AS id, vec_id AS as_i64, CAST(vec_id AS DOUBLE) / 2 AS as_f64, vec_id % 2 = 0 AS as_bool, concat('v', CAST(vec_id AS VARCHAR)) AS as_string FROM embeddings")
def metadata_literals(spark, sf_dir):
    rows = vt(spark, sf_dir).select("id", F.concat(F.lit(" "), F.col("id").cast("string")).alias("a"), (F.col("id") / 2).cast("string").alias("b"), F.when(F.col("active"), " TRUE ").otherwise("False").alias("c"), F.concat(F.col("name"), F.lit(" ")).alias("d"))
    kinds = (("as_i64", "a", ColumnType.I64), ("as_f64", "b", ColumnType.F64), ("as_bool", "c", ColumnType.BOOL), ("as_string", "d", ColumnType.STRING))
    return rows.select("id", *[literal_column(k, F.col(c)).alias(n) for n, c, k in kinds])


@register("checksums", "SELECT 3421780262::BIGINT AS crc, 0::BIGINT AS colour")
def checksums(spark, sf_dir):
    one = spark.range(1)
    return one.select(crc32(F.lit("123456789").cast("binary")).alias("crc"), colour_index(F.lit("a")).cast("long").alias("colour"))


def _splitmix_sql(name: str, seed: int, count: int) -> str:
    """CTEs that end in `name`: draw number i and its 64 bits z."""
    return (
        f"{name}0 AS (SELECT i, (({seed}::UHUGEINT + (i + 1)::UHUGEINT * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM range({count}) AS r(i)), "
        f"{name}1 AS (SELECT i, (xor(z, z >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM {name}0), "
        f"{name}2 AS (SELECT i, (xor(z, z >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM {name}1), "
        f"{name} AS (SELECT i, xor(z, z >> 31) AS z FROM {name}2)"
    )


_UNIFORM = (
    f"WITH {_splitmix_sql('x', datagen.stream_seed(42, datagen.CORPUS), 16_000)}, {_splitmix_sql('y', datagen.stream_seed(42, datagen.CATEGORY), 1000)}, "
    "v AS (SELECT i // 16 AS id, list(((z >> 40)::DOUBLE / 16777216)::FLOAT ORDER BY i) AS vector FROM x GROUP BY i // 16) "
    "SELECT id, vector, CAST(z % 10 AS INTEGER) AS category FROM v JOIN y ON y.i = id"
)


@register("datagen_uniform", _UNIFORM)
def datagen_uniform(spark, sf_dir):
    return datagen.uniform_rows(spark, 1000, 16, 10, 42)


@register("datagen_clustered")
def datagen_clustered(spark, sf_dir):
    return datagen.clustered_rows(spark, 1000, 16, 10, 10, 42)


@register("knn_lineitem", "SELECT l_orderkey AS id, l_linenumber AS line, round((l_quantity - 17) * (l_quantity - 17) + (l_discount - 0.05) * (l_discount - 0.05) + (l_tax - 0.02) * (l_tax - 0.02), 6) AS distance FROM lineitem WHERE l_returnflag = 'R' ORDER BY distance, id, line LIMIT 20")
def knn_lineitem(spark, sf_dir):
    """A filtered search over the widest table: squared L2 on three measures, ties by order and line."""
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.array("l_quantity", "l_discount", "l_tax").alias("vector"))
    return S.nearest(rows, [17.0, 0.05, 0.02], Metric.L2, 20, digits=6, tie=["id", "line"]).select("id", "line", "distance")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["knn_filter_nested"](spark, sf_dir)

