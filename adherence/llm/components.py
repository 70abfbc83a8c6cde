"""Connected components of a link table, as Spark jobs.

Alternating large-star and small-star steps (Kiveris et al., 2014): every step
relinks a node's neighbours to the smallest of them, and the links shrink to one
star per component in a logarithmic number of rounds. Minima are reduced on the
map side; a hub's links are joined to its minimum row by row, never gathered.
"""

from pyspark.sql import DataFrame, functions as F

from adherence.llm.common import written


def _signature(links: DataFrame):
    return links.agg(
        F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))
    ).first()


def _links(pairs: DataFrame) -> DataFrame:
    return pairs.where("lo < hi").distinct()


def stars(pairs: DataFrame) -> DataFrame:
    """pairs: two columns a, b of one type. Returns (node, root) for every node that
    is not the smallest of its component. Null ends and loops are no links."""
    links = written(
        _links(pairs.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
               .where(pairs.a.isNotNull() & pairs.b.isNotNull())),
        "links",
    )
    before = _signature(links)
    while before[0]:
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")), "least")
        links = written(
            _links(both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))), "large")
        least = written(links.groupBy("hi").agg(F.min("lo").alias("m")), "least")
        links = written(
            _links(links.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                   .unionByName(least.select("hi", F.col("m").alias("lo")))), "small")
        after = _signature(links)
        if after == before:
            break
        before = after
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
