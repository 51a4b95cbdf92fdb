"""Connected components of a graph of links, in rounds of joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import delete_path, fresh_path

#: Rounds fall with the logarithm of the longest chain; a graph that needs more than this is an error, not a cut.
MOST_ROUNDS = 100


def connected_components(links: DataFrame) -> DataFrame:
    """Gives node and component (its smallest node) for every end of a link.

    links has the integer columns a and b. Rows with a null end, loops and repeated rows are ignored; an empty table
    gives an empty result. Each round joins every node's neighbours to their minimum, first the larger neighbours,
    then the smaller ones, until nothing changes; each round is a table in the shared folder. No node's neighbours are
    ever gathered into one row, so a node with very many links is joined in as many tasks as Spark deals it to.
    """
    spark = links.sparkSession
    now = links.where("a is not null and b is not null and a <> b").selectExpr(
        "cast(greatest(a, b) as long) a", "cast(least(a, b) as long) b"
    )
    now = now.distinct()
    held, mark, schema = None, None, "a long, b long"
    for _ in range(MOST_ROUNDS):
        path = fresh_path(spark, "links")
        now.write.parquet(path)
        now = spark.read.schema(schema).parquet(path)
        if held:
            delete_path(spark, held)
        held = path
        was, mark = mark, now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == was or mark[0] == 0:
            return now.selectExpr("a node", "b component").union(now.selectExpr("b", "b").distinct())
        both = now.union(now.selectExpr("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").selectExpr("b a", "m b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").selectExpr("b a", "m b")
        now = small.union(least.selectExpr("a", "m b")).where("a <> b").distinct()
    raise RuntimeError(f"components were not settled after {MOST_ROUNDS} rounds")
