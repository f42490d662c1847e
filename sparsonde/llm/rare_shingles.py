"""Candidates of a similarity join of sets by their rarest members: exact, whatever the sets share beyond them.

Members are ordered by how many sets hold them, rarest first. If the first common member of two sets is at places i and j (from 0) of them, they have at
most min(n - i, m - j) members in common, and sets as similar as ``percent`` have percent / (100 + percent) * (n + m). So of each set only the first members
matter, and of the smaller one fewer still: texts of one template meet by what is their own, not by the template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

#: Members with over a 1 / SHARE part of all rows, so fewer than SHARE of them, get their counts by broadcast.
SHARE = 1 << 17
#: Rows of a member on either side of a task's block.
BLOCK = 1024


def rare_first(members: DataFrame, percent: int) -> DataFrame:
    """(node, size, at, key): of the rows ``members`` (node, size, key), those at places that a common first member can have."""
    counts = store.written(members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "rare-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = F.broadcast(counts.filter(F.col("n") * SHARE > total))
    rest = counts.filter(F.col("n") * SHARE <= total)
    known = members.join(often, "key").unionByName(members.join(often.select("key"), "key", "left_anti").join(rest, "key", "left"))
    order = Window.partitionBy("node").orderBy(F.coalesce("n", F.lit(1)), "key")
    placed = known.withColumn("at", F.row_number().over(order).cast("long") - 1)
    return placed.filter(100 * (F.col("size") - F.col("at")) >= percent * F.col("size")).select("node", "size", "at", "key")


def _mixed(rows: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """The rows of members that several components hold and that can be the first common one of a pair, with what their member's rows are like."""
    early = (100 + percent) * (F.col("size") - F.col("at")) >= 2 * percent * F.col("size")
    labelled = rows.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")).withColumn("early", early)
    per = labelled.groupBy("key", "comp").agg(F.count("*").alias("n"), F.max("early").alias("any"), *[f(F.struct("node", "comp", "size", "at")).alias(a) for f, a in ((F.min, "low"), (F.max, "high"))])
    split = per.groupBy("key").agg(
        F.count("*").alias("comps"),
        F.max("any").alias("any"),
        F.max("n").alias("mains"),
        (F.sum("n") - F.max("n")).alias("others"),
        F.max_by("comp", F.struct("n", "comp")).alias("most"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )
    return labelled.join(split.filter("comps > 1 and any").drop("comps", "any"), "key").withColumn("main", F.col("comp") == F.col("most"))


def _possible(a: dict[str, Column], b: dict[str, Column], percent: int) -> Column:
    common = F.least(a["size"] - a["at"], b["size"] - b["at"])
    return (a["comp"] != b["comp"]) & ((100 + percent) * common >= percent * (a["size"] + b["size"])) & (100 * F.least(a["size"], b["size"]) >= percent * F.greatest(a["size"], b["size"]))


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def star_pairs(rows: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """(a, b): each row of ``rare_first`` with the smallest and the largest node of its member, as many pairs as rows at most twice."""
    met = _mixed(rows, comp, percent).withColumn("hub", F.explode(F.array("low", "high")))
    mine, hub = ({c: F.col(p + c) for c in ("node", "comp", "size", "at")} for p in ("", "hub."))
    return met.filter(_possible(mine, hub, percent)).select(*_ordered(F.col("node"), F.col("hub.node"))).distinct()


def all_pairs(rows: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of nodes of different components that can have their first common member there.

    One side of a pair is early in its set. Rows of a member's largest component meet those outside it only. A member's rows are dealt to blocks, each of
    which joins at most about BLOCK rows a side.
    """
    met = _mixed(rows, comp, percent)
    columns = ["node", "comp", "size", "at"]

    def blocks(n: Column) -> Column:
        return F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")

    def dealt(df: DataFrame, own: str, all_of: str) -> DataFrame:
        """Own block by the node, and a copy for each block of the other side."""
        df = df.withColumn(own, F.pmod(F.xxhash64("node"), F.col(f"{own}s")).cast("int"))
        return df.withColumn(all_of, F.explode(F.sequence(F.lit(0), F.col(f"{all_of}s") - 1)))

    def sized(df: DataFrame) -> DataFrame:
        """Blocks of both sides in a lane: 0 holds pairs with the largest component, 1 those with rows outside it."""
        lefts = blocks(F.when(F.col("lane") == 0, F.col("others")).otherwise(F.col("mains") + F.col("others")))
        return df.withColumn("is", lefts).withColumn("js", blocks(F.when(F.col("lane") == 0, F.col("mains")).otherwise(F.col("others"))))

    lanes = F.when(F.col("main"), F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    left = dealt(sized(met.filter("early").withColumn("lane", F.explode(lanes))), "i", "j")
    right = dealt(sized(met.withColumn("lane", F.when(F.col("main"), 0).otherwise(1))), "j", "i")
    left = left.select("key", "lane", "i", "j", *[F.col(c).alias(f"l_{c}") for c in columns])
    right = right.select("key", "lane", "i", "j", *[F.col(c).alias(f"r_{c}") for c in columns])
    x, y = ({c: F.col(p + c) for c in columns} for p in ("l_", "r_"))
    return left.join(right, ["key", "lane", "i", "j"]).filter(_possible(x, y, percent)).select(*_ordered(F.col("l_node"), F.col("r_node"))).distinct()
