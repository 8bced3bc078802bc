"""Deterministic views over the tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: In order: later views may use earlier ones.
VIEWS = {
    "v_box_base": "SELECT l_orderkey AS uid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS idx, l_partkey AS pk, l_suppkey AS sk FROM lineitem",
    "v_boxes_gt": "SELECT uid, idx, pk % 22 AS cls, CAST((pk*7)%400 AS DOUBLE) AS x1, CAST((sk*13)%300 AS DOUBLE) AS y1, CAST((pk*7)%400 + 12 + pk%30 AS DOUBLE) AS x2, CAST((sk*13)%300 + 16 + sk%20 AS DOUBLE) AS y2 FROM v_box_base",
    "v_boxes_pred": "SELECT uid, idx, pk % 22 AS cls, CAST((pk*7)%400 + pk%5 AS DOUBLE) AS x1, CAST((sk*13)%300 + sk%3 AS DOUBLE) AS y1, CAST((pk*7)%400 + 12 + pk%30 + pk%4 AS DOUBLE) AS x2, CAST((sk*13)%300 + 16 + sk%20 AS DOUBLE) AS y2, CAST((uid*31 + idx*17 + pk) % 1000 AS DOUBLE)/1000.0 AS score FROM v_box_base WHERE pk % 11 <> 0",
    "v_pairs": "SELECT p_partkey AS uid, p_size AS grp, p_name AS ref_text, CASE WHEN p_partkey%7=0 THEN '' WHEN p_partkey%5=0 THEN p_name ELSE replace(replace(p_name,'a','e'),'o','') END AS pred_text FROM part",
    "v_manifest": "SELECT doc_id AS uid, doc_id % 211 AS row_id, CASE WHEN doc_id % 10 < 7 THEN 'train' ELSE 'validation' END AS split, source, lang, text, 320 + n_chars % 640 AS width, 240 + n_chars % 480 AS height FROM documents",
    "v_epochs": "SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS epoch, event_type AS regime, value AS metric FROM events",
    "v_shard_rows": "SELECT user_id AS uid, event_id % 4 AS shard_id, event_id AS line_no, event_type, value FROM events",
}
NEEDS = {"v_boxes_gt": ["v_box_base"], "v_boxes_pred": ["v_box_base"]}
SOURCES = {"v_box_base": "lineitem", "v_pairs": "part", "v_manifest": "documents", "v_epochs": "events", "v_shard_rows": "events"}


def with_views(*names: str, rest: str) -> str:
    """SQL text: the named views as common table expressions, then the rest, which may go on with a comma."""
    wanted = [v for v in VIEWS if v in {*names, *(n for name in names for n in NEEDS.get(name, []))}]
    ctes = ", ".join(f"{v} AS ({VIEWS[v]})" for v in wanted)
    return f"WITH {ctes}{',' if rest.lstrip().startswith(',') else ''} {rest.lstrip().lstrip(',')}"


def _box_base(lineitem: DataFrame) -> DataFrame:
    """v_box_base. Its window is dealt by uid itself: dealt by l_orderkey, both names are shuffled, and what goes by uid
    afterwards is shuffled once more."""
    rows = lineitem.select(F.col("l_orderkey").alias("uid"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"), "l_linenumber", "l_extendedprice", "l_quantity")
    order = Window.partitionBy("uid").orderBy("l_linenumber", "pk", "sk", "l_extendedprice", "l_quantity")
    return rows.select("uid", (F.row_number().over(order) - 1).alias("idx"), "pk", "sk")


class Inputs:
    """Tables and views of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        base = NEEDS.get(name, [None])[0]
        below = SOURCES.get(base or name)
        if name == "v_box_base":
            return _box_base(self.table(below))
        body = VIEWS[name] if not base else VIEWS[name].replace(base, "{base}")
        if base:
            return self.spark.sql(body, base=self.view(base))
        return self.spark.sql(body.replace(f"FROM {below}", "FROM {below}"), below=self.table(below))
