"""Save and reload a graph as tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from loomgraph.operators.graph import Graph


def save_graph(graph: Graph, path: str, fmt: str = "parquet") -> None:
    """One folder per table, partitioned by repository."""
    for name, table in graph._asdict().items():
        table.write.format(fmt).mode("overwrite").partitionBy("repo_id").save(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str, schemas: dict | None = None, fmt: str = "parquet") -> Graph:
    """Reload a saved graph; nodes and links must be there."""
    def read(name: str):
        reader = spark.read.format(fmt)
        if schemas and name in schemas:
            reader = reader.schema(schemas[name])
        return reader.load(f"{path}/{name}")

    tables = {name: read(name) for name in Graph._fields}
    for name, needed in (("nodes", {"id", "path", "kind"}), ("links", {"type", "from", "to"})):
        absent = needed - set(tables[name].columns)
        if absent:
            raise ValueError(f"{path}/{name} is no graph table: {sorted(absent)} missing")
    return Graph(**tables)
