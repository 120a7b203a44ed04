"""Ensembles, measurements and scores as views of general tables.

Each view is a deterministic DataFrame; ``SQL`` has the same views as text
for another engine to check against.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WIDTH = 8
BACKGROUND = 10.6
BUDGETS = (32, 64, 128, 256)


class Views:
    """The views of one data folder, made when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def rows(self, values: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(values, schema)

    @cached_property
    def fields_long(self) -> DataFrame:
        """sample_id, row, col, value: each embedding is an 8 by 8 field."""
        flat = self.table("embeddings").select(F.col("vec_id").alias("sample_id"), F.posexplode("embedding").alias("pos", "v"))
        return flat.select(
            "sample_id",
            F.expr(f"int(pos div {WIDTH})").alias("row"),
            (F.col("pos") % WIDTH).cast("int").alias("col"),
            F.col("v").cast("double").alias("value"),
        )

    @cached_property
    def temperature(self) -> DataFrame:
        return self.fields_long.withColumn("value", BACKGROUND + 4 * F.col("value"))

    @cached_property
    def permeability(self) -> DataFrame:
        return self.fields_long.withColumn("value", F.pow(F.lit(10.0), -9.3 + F.col("value")))

    @cached_property
    def log_k(self) -> DataFrame:
        """The permeability's logarithm, as it was drawn."""
        return self.fields_long.withColumn("value", -9.3 + F.col("value"))

    @cached_property
    def reference_field(self) -> DataFrame:
        return self.fields_long.where("sample_id = 0").drop("sample_id")

    @cached_property
    def points(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.alias("id"),
            ((key * 7919) % 12800).cast("double").alias("x_m"),
            ((key * 104729) % 12800).cast("double").alias("y_m"),
            (F.col("c_acctbal") / 1e4).alias("k"),
            F.col("c_mktsegment").alias("stratum"),
            F.col("c_nationkey").alias("state"),
        )

    @cached_property
    def good_points(self) -> DataFrame:
        return self.points.where("k > 0").withColumn("log10_k", F.log10("k"))

    @cached_property
    def xyz(self) -> DataFrame:
        keys = [(F.col("l_suppkey") % 20).alias("x"), (F.col("l_partkey") % 20).alias("y"), F.col("l_linenumber").alias("z")]
        return self.table("lineitem").groupBy(*keys).agg(
            F.avg("l_quantity").alias("k10"), F.avg(F.col("l_discount") + 0.01).alias("k50"), F.avg(F.col("l_tax") + 0.01).alias("k90")
        )

    @cached_property
    def trial_errors(self) -> DataFrame:
        method = F.when(F.col("l_returnflag") == "A", "MC").when(F.col("l_returnflag") == "R", "RQMC")
        return self.table("lineitem").select(
            F.pow(F.lit(2.0), 4 + F.col("l_linenumber") % 4).cast("int").alias("budget"),
            F.col("l_linestatus").alias("target"),
            method.alias("method"),
            (F.col("l_discount") - 0.05).alias("error"),
        )

    @cached_property
    def draws(self) -> DataFrame:
        """trial, truth, draw: of each label the least id's first component is the truth, the others' are draws."""
        cell = self.table("embeddings").select(F.col("label").alias("trial"), "vec_id", F.element_at("embedding", 1).cast("double").alias("x"))
        truth = cell.groupBy("trial").agg(F.min_by("x", "vec_id").alias("truth"), F.min("vec_id").alias("first"))
        return cell.join(truth, "trial").where("vec_id <> first").select("trial", "truth", F.col("vec_id").alias("draw"), F.col("x").alias("value"))

    @cached_property
    def pred_truth(self) -> DataFrame:
        key = F.col("o_custkey")
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"),
            (key % 16).alias("block"),
            (F.col("o_totalprice") / 1e5).alias("truth"),
            (1.5 + (key % 7) / 10).alias("mean"),
            (0.5 + (key % 5) / 10).alias("std"),
        )

    @cached_property
    def budgets(self) -> DataFrame:
        return self.rows([(b,) for b in BUDGETS], "budget int")


SQL = {
    "fields_long": f"""select vec_id as sample_id, cast((pos - 1) // {WIDTH} as int) as row, cast((pos - 1) % {WIDTH} as int) as col, v::double as value
      from (select vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) as pos from embeddings)""",
    "temperature": f"select sample_id, row, col, {BACKGROUND}::double + 4 * value as value from fields_long",
    "permeability": "select sample_id, row, col, pow(10.0::double, -9.3::double + value) as value from fields_long",
    "log_k": "select sample_id, row, col, -9.3::double + value as value from fields_long",
    "reference_field": "select row, col, value from fields_long where sample_id = 0",
    "points": """select c_custkey as id, ((c_custkey * 7919) % 12800)::double as x_m, ((c_custkey * 104729) % 12800)::double as y_m,
      c_acctbal / 1e4 as k, c_mktsegment as stratum, c_nationkey as state from customer""",
    "good_points": "select *, log10(k) as log10_k from points where k > 0",
    "xyz": """select l_suppkey % 20 as x, l_partkey % 20 as y, l_linenumber as z, avg(l_quantity) as k10,
      avg(l_discount + 0.01::double) as k50, avg(l_tax + 0.01::double) as k90 from lineitem group by all""",
    "trial_errors": """select pow(2.0, 4 + l_linenumber % 4)::int as budget, l_linestatus as target,
      case l_returnflag when 'A' then 'MC' when 'R' then 'RQMC' end as method, l_discount - 0.05::double as error from lineitem""",
    "draws": """select label as trial, first_value(embedding[1]::double) over w as truth, vec_id as draw, embedding[1]::double as value
      from embeddings window w as (partition by label order by vec_id) qualify row_number() over w > 1""",
    "pred_truth": """select o_orderkey as id, o_custkey % 16 as block, o_totalprice / 1e5 as truth,
      1.5::double + (o_custkey % 7) / 10 as mean, 0.5::double + (o_custkey % 5) / 10 as std from orders""",
    "budgets": "select unnest([32, 64, 128, 256])::int as budget",
}
_NEEDS = {
    "temperature": ["fields_long"], "permeability": ["fields_long"], "log_k": ["fields_long"],
    "reference_field": ["fields_long"], "good_points": ["points"],
}


def with_views(names: list[str], sql: str) -> str:
    """sql after the definitions of the named views and of those that they use."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in _NEEDS.get(name, []):
            add(other)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    body = sql.strip()
    head = ", ".join(f"{n} as ({SQL[n]})" for n in order)
    if not order:
        return body
    if body[:15].lower() == "with recursive ":
        return f"with recursive {head}, {body[15:]}"
    return f"with {head}, {body[5:]}" if body[:5].lower() == "with " else f"with {head} {body}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many decimals; minus zero becomes zero."""
    one: dict[str, Column] = {c: F.round(F.col(f"`{c}`").cast("double"), digits) + F.lit(0.0) for c, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(one) if one else df
