"""Record linkage as records arrive: entities of all records so far, for the work of the batch.

Four keyed tables hold what is known. `keys` has for every linking key the entity that it was first seen in, `records` the
same for every record; both rows stay as they are. An entity is named by its least record. When a batch shows two
entities to be one, `merged` tells for the greater name which entity it belongs to now, and `parts` has the same by
entity, so that names that had been merged into it before can be told on.

A batch looks up its own keys and records, and works on a graph whose nodes are entities and new records. Its connected
components are the new entities, so the rest of the tables is neither read nor moved. Whatever the batches and their
order, entities are those of one run over all records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.operators.components import components, remove_path, shuffled, stored
from tamis.sources.change_table import ChangeTable


class Linkage:
    """The stored state at `path`; `id_type` is the records' id type, which must be orderable."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "long", *, ranges: int = 64, fan: int = 8):
        table = lambda name, schema, keys, **more: ChangeTable(spark, f"{path}/{name}", schema, keys, ranges=ranges, fan=fan, **more)
        self.spark = spark
        self.keys = table("keys", f"k string, label {id_type}", ["k"])
        self.records = table("records", f"id {id_type}, label {id_type}", ["id"])
        self.merged = table("merged", f"label {id_type}, entity {id_type}", ["label"])
        self.parts = table("parts", f"entity {id_type}, label {id_type}", ["entity", "label"])

    def _now(self, labelled: DataFrame) -> DataFrame:
        """Rows with `label` -> the same with `entity`, the name of today."""
        known = self.merged.lookup(labelled.select("label"))
        return labelled.join(shuffled(known), "label", "left").withColumn("entity", F.coalesce("entity", "label")).drop("label")

    def add(self, batch: DataFrame, number: int, id_: str = "id", keys: str = "keys") -> None:
        """Links a batch: records with an array of keys. Null and empty keys link nothing, a null id is left out; an id that
        comes again adds its new keys to its record. Batches have growing numbers; a repeated one changes nothing, and one
        that broke off can be given again."""
        if number <= self.records.upto():
            return
        paths: list[str] = []
        rows = batch.filter(F.col(id_).isNotNull()).select(F.col(id_).alias("id"), F.explode_outer(keys).alias("k"))
        rows = stored(rows.withColumn("k", F.when(F.col("k") != "", F.col("k"))).distinct(), "batch-keys", paths)
        ids = rows.select("id").distinct()
        of_id = self._now(self.records.lookup(ids)).withColumnRenamed("entity", "was")
        of_id = stored(ids.join(shuffled(of_id), "id", "left").select("id", F.coalesce("was", "id").alias("node"), F.col("was").isNull().alias("new")), "batch-records", paths)
        of_key = stored(self._now(self.keys.lookup(rows.select("k"))), "batch-known-keys", paths)
        # Every key ties the nodes of its records to the least of them, or to the entity that has it: rows, not pairs.
        nodes = rows.filter("k is not null").join(shuffled(of_id), "id").select("k", "node")
        heads = stored(nodes.groupBy("k").agg(F.min("node").alias("least")).join(shuffled(of_key), "k", "left"), "batch-heads", paths)
        head = F.coalesce("entity", "least")
        found = components(nodes.join(shuffled(heads), "k").select(head.alias("a"), F.col("node").alias("b")), tables=paths)
        found = stored(found.withColumnRenamed("component", "entity"), "batch-entities", paths)
        today = lambda df, c: df.join(shuffled(found), F.col(c) == F.col("node"), "left").withColumn("_e", F.coalesce("entity", c)).drop("node", "entity").withColumnRenamed("_e", "entity")
        # Entities that were and now belong to another, with the names merged into them before.
        gone = found.filter("node != entity")
        old = gone.join(of_id.filter("not new").select("node").union(heads.filter("entity is not null").select("entity")).distinct(), "node", "left_semi")
        before = self.parts.lookup(old.select(F.col("node").alias("entity"))).withColumnRenamed("entity", "node")
        moved = old.select(F.col("node").alias("label"), "entity").unionByName(before.join(old, "node").select("label", "entity"))
        moved = stored(moved, "batch-moves", paths)
        self.parts.append(moved, number)
        self.merged.append(moved, number)
        fresh = heads.filter("entity is null").select("k", F.col("least").alias("h"))
        self.keys.append(today(fresh, "h").select("k", F.col("entity").alias("label")), number)
        self.records.append(today(of_id.filter("new").select("id", F.col("node").alias("h")), "h").select("id", F.col("entity").alias("label")), number)
        for p in paths:
            remove_path(self.spark, p)

    def entities(self) -> DataFrame:
        """(id, entity) of all records."""
        now = self.records.read().join(shuffled(self.merged.read()), "label", "left")
        return now.select("id", F.coalesce("entity", "label").alias("entity"))
