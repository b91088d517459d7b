"""Blocks as nested JSON, one a line: a block holds transactions, a transaction the hashes of its items.

``parse`` and ``items`` work on tables and on streams of lines alike; all that they need stands in the line of a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRANSACTION = "struct<hash: string, sender: string, nonce: bigint, tip: bigint, max_fee: bigint, item_hashes: array<string>>"
BLOCK = f"number bigint, time bigint, hash string, parent string, fee bigint, base_fee bigint, transactions array<{TRANSACTION}>"


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines as blocks. A line that is no block (no JSON, or without a number) has no number; ``rejected`` gives them."""
    return lines.select(F.from_json(column, BLOCK).alias("b"), F.col(column).alias("line")).select("b.*", "line")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where("number IS NULL").select("line")


def items(parsed: DataFrame) -> DataFrame:
    """One row an item. ``ordinal`` counts the items of a transaction, ``item_index`` those of the block: its place when the
    transactions' items are laid end to end. Transactions without items keep their place in ``tx_index``. An item carries what it
    needs of its transaction, so no row holds a list of the block's."""
    of = lambda x, i: F.transform(F.coalesce(x["item_hashes"], F.array().cast("array<string>")), lambda h, j: F.struct(i.alias("tx_index"), j.alias("ordinal"), x["hash"].alias("tx_hash"), x["sender"].alias("actor"), x["nonce"].alias("nonce"), x["tip"].alias("tip"), h.alias("content_hash")))
    blocks = parsed.where("number IS NOT NULL").select("number", "time", "fee", F.flatten(F.transform("transactions", of)).alias("held"))
    rows = blocks.select("number", "time", "fee", F.posexplode("held").alias("item_index", "item"))
    return rows.select(
        F.col("number").alias("block_number"), *(F.col(c).cast("long").alias(c.split(".")[-1]) for c in ("item_index", "item.tx_index", "item.ordinal")),
        "item.tx_hash", "item.actor", "item.nonce", "item.tip", "item.content_hash", F.col("time").alias("t"), "fee",
    )


def counts(parsed: DataFrame) -> DataFrame:
    """One row a block, empty ones included: number, time, transactions and items."""
    n = F.aggregate("transactions", F.lit(0), lambda a, x: a + F.greatest(F.coalesce(F.size(x["item_hashes"]), F.lit(0)), F.lit(0)))
    return parsed.where("number IS NOT NULL").select(F.col("number").alias("block_number"), F.col("time").alias("t"), F.greatest(F.size("transactions"), F.lit(0)).cast("long").alias("transactions"), F.coalesce(n, F.lit(0)).cast("long").alias("items"))
