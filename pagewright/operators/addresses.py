"""Numbers for addresses, so that crawls move longs and not strings.

The number of an address is a 64-bit hash without its last bit.  Addresses that share one are
found exactly, once, and get odd numbers of their own from a table; among a thousand million
addresses that is expected for no pair.  So a number is an expression over the address, whichever row it is in, and only
the names of a result are looked up again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.core import Sql, quote
from pagewright.operators.ordering import number_rows
from pagewright.session import written

#: Bound of the addresses that share a hash; beyond it the hash is at fault
MOST_CLASHES = 2_000


class Addresses:
    """`spelled` has the column address, with repetitions; of other columns the largest value is kept.

    `hashed` is SQL over {0}.
    """

    def __init__(self, spelled: DataFrame, hashed: Sql = "xxhash64({0})"):
        self.hashed = f"({hashed} & -2L)"
        known = spelled.where("address IS NOT NULL")
        rest = [c for c in known.columns if c != "address"]
        known = known.groupBy("address").agg(*[F.max(c).alias(c) for c in rest]) if rest else known.distinct()
        hashes = written(known.selectExpr("*", f"{self._hash('address')} AS number"), "addresses")
        shared = hashes.groupBy("number").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("number")
        self.clashes = {}
        if not shared.isEmpty():
            clashes = hashes.join(shared, "number", "left_semi").select("address").limit(MOST_CLASHES + 1)
            self.clashes = {r["address"]: 2 * r["number"] + 1 for r in number_rows(clashes, ["address"], costly=True).collect()}
        if len(self.clashes) > MOST_CLASHES:
            raise ValueError("too many addresses share a hash")
        #: number, address and the other columns
        self.table = hashes if not self.clashes else hashes.selectExpr("address", *rest, f"{self.number('address')} AS number")

    def _hash(self, address: Sql) -> Sql:
        return self.hashed.format(address)

    def number(self, address: Sql) -> Sql:
        """The number of an address, NULL for NULL."""
        plain = f"if({address} IS NULL, NULL, {self._hash(address)})"
        if not self.clashes:
            return plain
        own = ", ".join(f"{quote(a)}, {n}L" for a, n in sorted(self.clashes.items()))
        return f"coalesce(map({own})[{address}], {plain})"
