"""The genre tree: nodes in XML, an edge table, and walks by a recursive query."""

from __future__ import annotations

import os
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "name string, parent string, assigned array<string>"


def read_tree(xml: str) -> list[tuple[str, str | None, list[str]]]:
    """(name, parent, assigned genres) of every node, parents first."""
    out: list[tuple[str, str | None, list[str]]] = []

    def walk(elements, parent) -> None:
        seen = set()
        for e in elements:
            if e.attrib["name"] in seen and parent is not None:
                continue  # a parent has a child of a name once
            seen.add(e.attrib["name"])
            out.append((e.attrib["name"], parent, sorted({g.text.strip() for g in e.findall("assigned/genre") if g.text})))
            walk(e.findall("genre"), e.attrib["name"])

    walk(ET.fromstring(xml).findall("genre"), None)
    return out


def write_tree(nodes: list[tuple[str, str | None, list[str]]], path: str) -> None:
    """Replaces the file at once."""
    root = ET.Element("genres")
    made: dict[str | None, ET.Element] = {None: root}
    for name, parent, assigned in nodes:
        made[name] = ET.SubElement(made[parent], "genre", {"name": name})
        if assigned:
            inner = ET.SubElement(made[name], "assigned")
            for g in sorted(assigned):
                ET.SubElement(inner, "genre").text = g
    ET.ElementTree(root).write(path + ".tmp", encoding="utf-8", xml_declaration=True)
    os.replace(path + ".tmp", path)


def tree_table(spark: SparkSession, nodes) -> DataFrame:
    return spark.createDataFrame(list(nodes), NODE)


def associate(tree: DataFrame, genre: str, node: str) -> DataFrame:
    """The tree with a genre assigned to a node, once."""
    return tree.withColumn("assigned", F.when(F.col("name") == node, F.array_union("assigned", F.array(F.lit(genre)))).otherwise(F.col("assigned")))


def dissociate(tree: DataFrame, genre: str, node: str) -> DataFrame:
    return tree.withColumn("assigned", F.when(F.col("name") == node, F.array_remove("assigned", genre)).otherwise(F.col("assigned")))


def walk(tree: DataFrame) -> DataFrame:
    """name, depth (0 at the top), path, top of every node of ``tree`` (name, parent)."""
    return tree.sparkSession.sql(
        """WITH RECURSIVE t(name, depth, path, top) AS (
             SELECT name, 0, name, name FROM {tree} WHERE parent IS NULL
             UNION ALL SELECT c.name, t.depth + 1, concat(t.path, '/', c.name), t.top FROM {tree} c JOIN t ON c.parent = t.name)
           SELECT * FROM t""",
        tree=tree.select("name", "parent"),
    )


def main_genres(books: DataFrame, key: str, genre: str, tree: DataFrame) -> DataFrame:
    """key, name, top: the node, and its topmost, that a book's whole genre
    text is assigned to; books that have none aren't in it."""
    given = tree.select("name", F.explode("assigned").alias("__g"))
    return books.join(given, F.col(genre) == F.col("__g")).join(walk(tree).select("name", "top"), "name").select(key, "name", "top")
