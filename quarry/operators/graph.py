"""The knowledge graph: one-hop subgraphs, line protocol, diagrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matched_versions(chunks: DataFrame, hit: Column) -> DataFrame:
    """Chunks of the versions of the chunks that were hit."""
    return chunks.join(chunks.filter(hit).select("version_id").distinct(), "version_id", "left_semi").select("chunk_id")


def seeds(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    return mentions.join(chunks, "chunk_id", "left_semi").select("entity_id").distinct()


def one_hop(seed: DataFrame, relations: DataFrame) -> DataFrame:
    """Seeds, and what relations lead to from them or from which they lead to them."""
    out = relations.join(seed.select(F.col("entity_id").alias("source_id")), "source_id").select(F.col("target_id").alias("entity_id"))
    back = relations.join(seed.select(F.col("entity_id").alias("target_id")), "target_id").select(F.col("source_id").alias("entity_id"))
    return seed.unionByName(out).unionByName(back).distinct()


def subgraph(chunks: DataFrame, hit: Column, entities: DataFrame, relations: DataFrame, mentions: DataFrame, most_entities: int = 30, most_relations: int = 50) -> tuple[DataFrame, DataFrame]:
    """Entities (seeds first, then by name) and the relations between those, each limited."""
    near = matched_versions(chunks, hit)
    seed = seeds(mentions, near)
    known = relations.join(near, "chunk_id", "left_semi")
    found = one_hop(seed, known).join(entities, "entity_id").join(seed.withColumn("is_seed", F.lit(True)), "entity_id", "left").withColumn("is_seed", F.coalesce("is_seed", F.lit(False)))
    top = found.orderBy(F.col("is_seed").desc(), "canonical_name", "entity_id").limit(most_entities)
    inside = known.join(top.select(F.col("entity_id").alias("source_id")), "source_id", "left_semi").join(top.select(F.col("entity_id").alias("target_id")), "target_id", "left_semi")
    edges = inside.groupBy("source_id", "target_id", "relation_type").agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    return top.select("entity_id", "entity_type", "canonical_name", "is_seed"), edges.orderBy(F.col("confidence").desc(), "source_id", "target_id", "relation_type").limit(most_relations)


def parse_line(line: Column) -> dict[str, Column]:
    """Fields of a line ``E|key|name|type|group|numbers|description`` or ``R|from|to|type|numbers|description``."""
    parts = F.split(F.regexp_replace(F.regexp_replace(line, "`", ""), r"^\s*- ", ""), r"\|")
    kind = F.upper(F.trim(F.get(parts, F.lit(0))))
    at = F.when(kind == "E", 5).when(kind == "R", 4)
    numbers = F.transform(F.regexp_extract_all(F.get(parts, at), F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("long"))
    good = ((kind == "E") & (F.size(parts) >= 7)) | ((kind == "R") & (F.size(parts) >= 6))
    return {
        "kind": F.when(good, kind), "key": F.when(good, F.trim(F.get(parts, F.lit(1)))), "name": F.when(good, F.trim(F.get(parts, F.lit(2)))), "type": F.when(good, F.trim(F.get(parts, F.lit(3)))),
        "chunk_seqs": F.when(good, F.slice(F.array_distinct(numbers), 1, 20)),
        "description": F.when(good, F.trim(F.array_join(F.slice(parts, at + 2, F.size(parts)), "|"))),
    }


def safe_id(value: Column) -> Column:
    return F.substring(F.regexp_replace(value, "[^A-Za-z0-9_-]", "-"), 1, 80)


def edge_label(description: Column, kind: Column) -> Column:
    """A short description, else the type."""
    return F.substring(F.when(F.length(F.trim(description)).between(1, 24), F.trim(description)).otherwise(kind), 1, 30)


def nodes(entities: DataFrame) -> DataFrame:
    """(id, label, group) of a diagram's entities (a bounded number); groups are numbered as they are met."""
    order = Window.orderBy(F.col("is_seed").desc(), "canonical_name", "entity_id")
    placed = entities.withColumn("p", F.row_number().over(order)).withColumn("f", F.min("p").over(Window.partitionBy("entity_type")))
    number = F.dense_rank().over(Window.orderBy("f"))
    return placed.select(safe_id(F.col("entity_id")).alias("id"), F.substring("canonical_name", 1, 80).alias("label"), F.concat(F.lit("group-"), number.cast("string")).alias("group"))


def diagram_type(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: ``flow`` if all relations are ``precedes``, else ``architecture``; null for under two entities or without an edge."""
    n = entities.agg(F.count(F.lit(1)).alias("n")).scalar()
    edges = relations.agg(F.count_if(F.col("source_id") != F.col("target_id")).alias("edges"), F.bool_and(F.col("relation_type") == "precedes").alias("flow"))
    return edges.select(F.when((n < 2) | (F.col("edges") == 0), None).when(F.col("flow"), "flow").otherwise("architecture").alias("type"))
