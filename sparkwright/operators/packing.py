"""Batches of prompts by token budget, whatever the size of a folder.

A folder's prompts fall into kinds by size, and each kind fills batches by rules that need running sums only:

* `alone`: over half of the budget (and `over`: over all of it), a batch each;
* `pair`: over a quarter and up to half, by twos;
* `small`: up to a quarter. With W three quarters of the budget, all whose running sum begins in the same stretch
  of W tokens are one batch: they end less than a quarter after it.

So no batch but one of kind `over` exceeds the budget, and all but the last ones of the kinds `pair` and `small` in a
folder are at least half full: a folder of T tokens has at most 2 T / budget + 2 batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.functions.ordering import running_sums

KINDS = ("over", "alone", "pair", "small")


def pack(prompts: DataFrame, budget: int, folder: str = "folder", order: str = "item_id", tokens: str = "tokens") -> DataFrame:
    """prompts(folder, item_id, tokens) -> the same with kind and batch, from 0 within folder and kind; numbers of kind `small` may have gaps.

    Prompts are taken in the order of item_id. Null tokens count as 0, a null folder is one; an empty table gives no row.
    """
    if budget < 4:
        raise ValueError("budget must be at least 4 tokens")
    size = F.coalesce(F.col(tokens), F.lit(0))
    kind = F.when(size > budget, "over").when(2 * size > budget, "alone").when(4 * size > budget, "pair").otherwise("small")
    own = prompts.withColumn("kind", kind).withColumn("_weight", F.when(F.col("kind") == "small", size).otherwise(1).cast("bigint"))
    placed = running_sums(own, [folder, "kind"], [order], "_weight", "_before")
    stretch = F.when(F.col("kind") == "small", F.lit(budget - budget // 4)).when(F.col("kind") == "pair", F.lit(2)).otherwise(F.lit(1))
    return placed.withColumn("batch", F.floor(F.col("_before") / stretch).cast("bigint")).drop("_weight", "_before")
