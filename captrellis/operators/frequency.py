"""Document frequencies of a corpus that changes.

A store is a folder of named changes. A change adds or withdraws items: its grams are counted once, from its own
references, and kept as differences, so a change costs as much as the items in it and not as the corpus. The
sum over all changes equals a full count of the items that are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captrellis.operators.cider import Frequency, document_frequency, reference_words
from captrellis.session import finished
from captrellis.sources.tables import require_columns


def add_items(store: str, change: str, items: DataFrame, refs: DataFrame, n: int = 4, tokenizer: str = "words") -> bool:
    """Add ``items(item_id)`` with their ``refs(item_id, ref_no, ref)``; ``False`` if the change is in the store already.

    Items without references count as items. References of other items take no part. A name is used once: a job
    that is started again repeats its calls, and changes that were finished are left as they are.
    """
    return _change(store, change, items, refs, 1, n, tokenizer)


def withdraw_items(store: str, change: str, items: DataFrame, refs: DataFrame, n: int = 4, tokenizer: str = "words") -> bool:
    """Withdraw ``items(item_id)``; ``refs`` are the references they were added with."""
    return _change(store, change, items, refs, -1, n, tokenizer)


def _change(store: str, change: str, items: DataFrame, refs: DataFrame, sign: int, n: int, tokenizer: str) -> bool:
    require_columns(items, ["item_id"])
    require_columns(refs, ["item_id", "ref_no", "ref"])
    if not change or set(change) & set("/=%"):
        raise ValueError("a change needs a name without the signs / = %")
    if change in _changes(store):
        return False
    ids = items.select("item_id").distinct()
    mine = refs.select("item_id", F.col("ref_no").cast("int").alias("ref_no"), "ref").join(ids, "item_id", "left_semi")
    counted = document_frequency(reference_words(mine, tokenizer, n), n)
    grams = counted.select("gram", (sign * F.col("df")).alias("df"), (sign * F.col("uses")).alias("uses"))
    grams.write.mode("overwrite").parquet(f"{store}/grams/change={change}")
    # The items come last: a change without them was cut off, does not count and is written anew.
    ids.select("item_id", F.lit(sign).alias("sign")).write.mode("overwrite").parquet(f"{store}/items/change={change}")
    return True


def read_frequency(spark: SparkSession, store: str) -> Frequency:
    """The sum over all finished changes, in the form that :func:`captrellis.operators.cider.score_items` takes."""
    grams = _finished(spark, store, "grams").groupBy("gram").agg(F.sum("df").alias("df"), F.sum("uses").alias("uses"))
    return Frequency(grams.where(F.col("df") > 0), _left(spark, store).agg(F.count("*")).scalar())


def compact(spark: SparkSession, store: str, target: str, change: str = "all") -> None:
    """Write the sum of all changes to ``target``, a new store, as a single one."""
    read_frequency(spark, store).grams.write.parquet(f"{target}/grams/change={change}")
    _left(spark, store).select("item_id", F.lit(1).alias("sign")).write.parquet(f"{target}/items/change={change}")


def _left(spark: SparkSession, store: str) -> DataFrame:
    """Items that were added and not withdrawn; an item added or withdrawn twice is an error."""
    left = _finished(spark, store, "items").groupBy("item_id").agg(F.sum("sign").alias("times"))
    problem = F.concat(F.lit("item added or withdrawn more than once: "), F.col("item_id").cast("string"))
    checked = F.when(F.col("times").isin(0, 1), F.col("times")).otherwise(F.raise_error(problem).cast("bigint"))
    return left.where(checked == 1)


def _finished(spark: SparkSession, store: str, table: str) -> DataFrame:
    names = _changes(store)
    if not names:
        raise ValueError(f"no finished change in {store}")
    return spark.read.parquet(*[f"{store}/{table}/change={c}" for c in names])


def _changes(store: str) -> list[str]:
    """Names of the finished changes: those whose items were committed."""
    return [name.removeprefix("change=") for name in finished(f"{store}/items") if name.startswith("change=")]
