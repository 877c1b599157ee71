"""The most specific block of a table of CIDR blocks for each address: longest-prefix match.

A block is the string of its fixed leading bits, so an address lies in a block if the two agree
on that many digits: an equi-join for each prefix length in use, at most 129 of them. Only
distinct addresses are spread over the lengths, after a map-side combine, so a client with a
third of the rows is one of them. Either side of the join may be of any size. A short prefix that
many addresses share meets one block, and its side is split by adaptive execution, as are the
rows of a hot client when the answer is joined back.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions.ip import address_bits, block_bits


def most_specific(
    df: DataFrame, blocks: DataFrame, ip: str = "clientIp", block: str = "cidr",
    out: str = "network",
) -> DataFrame:
    """Adds ``out``: the longest block of ``blocks`` that holds the address, null if none does.

    Of blocks with the same addresses the smallest text is shown. Text that is no block holds
    nothing, text that is no address lies in none; IPv4 addresses equal their mapped form.
    """
    known = blocks.select(block_bits(F.col(block)).alias("_prefix"), F.col(block).alias("_block"))
    known = known.where("_prefix IS NOT NULL").groupBy("_prefix").agg(
        F.min("_block").alias("_block"))
    # At most one row for each prefix length there is.
    lengths = sorted(r[0] for r in known.select(F.length("_prefix")).distinct().collect())
    addresses = df.select(F.col(ip).alias("_ip")).where("_ip IS NOT NULL").distinct().select(
        "_ip", address_bits(F.col("_ip")).alias("_bits")).where("_bits IS NOT NULL")
    asked = addresses.select("_ip", F.explode(F.transform(
        F.array(*(F.lit(n) for n in lengths)).cast("array<int>"),
        lambda n: F.col("_bits").substr(F.lit(1), n))).alias("_prefix"))
    found = asked.join(known, "_prefix").groupBy("_ip").agg(
        F.max_by("_block", F.length("_prefix")).alias(out))
    return df.drop(out).join(found, F.col(ip) == F.col("_ip"), "left").drop("_ip")
