"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.staging import forget, staged


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id in links (a long, b long): root is the smallest id of its component.

    Each round every id takes the least label among itself and its neighbours, and
    then its label's label, so that the rounds follow the logarithm of the longest
    chain.  Rounds are written tables; labels and links never reach the driver.  An
    empty link table gives an empty result; repeated links and loops change nothing.
    """
    both = staged(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("id", "b").withColumnRenamed("root", "r"), "b")
        low = seen.groupBy(F.col("a").alias("id")).agg(F.min("r").alias("near"))
        stepped = labels.join(low, "id").select("id", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("id").alias("root"), F.col("root").alias("up"))
        nxt = staged(stepped.join(up, "root").select("id", "was", F.least("root", "up").alias("root")), "labels")
        done = nxt.where("was <> root").isEmpty()
        forget(labels)
        labels = nxt.select("id", "root")
        if done:
            forget(both)
            return labels
