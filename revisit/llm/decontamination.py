"""Short test items found inside long documents: MinHash containment, verified exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revisit.llm.bounded import small
from revisit.plans.durable import durable

WIDTH = 5
SHARE = 0.8


def text_words(text: str) -> Column:
    """Runs of letters and digits in lower case; null has none."""
    found = F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_remove(found, "")


def _shingles(words: str, width: int) -> Column:
    """All runs of ``width`` words, as structs; none if there are fewer words."""
    n = F.greatest(F.size(words) - (width - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(words, F.lit(k + 1), n).alias(f"w{k}") for k in range(width)])


def _exploded(df: DataFrame, keep: list[str], width: int) -> DataFrame:
    """``keep`` and, by shingle of the column ``words``, its words w0, w1, ..."""
    rows = df.select(*keep, F.explode(_shingles("words", width)).alias("s"))
    return rows.select(*keep, *[F.col("s")[f"w{k}"].alias(f"w{k}") for k in range(width)])


def _key(width: int) -> Column:
    return F.xxhash64(*[F.col(f"w{k}") for k in range(width)])


def _string(width: int) -> Column:
    return F.concat_ws(" ", *[F.col(f"w{k}") for k in range(width)])


def contained_items(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", width: int = WIDTH, share: float = SHARE,
) -> DataFrame:
    """(key, item key, n_shared, n_item, containment): documents that hold an item.

    A document holds an item if at least ``share`` of the item's distinct shingles of ``width``
    words occur in it. An item with q shingles is asked for by its MinHash sketch, the
    q - ceil(share * q) + 1 shingles with the smallest hashes: a document that holds the item holds
    one of them, so nothing is missed. Documents are partitioned by size (powers of two of their
    shingles), and an item is asked for only where documents are large enough to hold it. What is
    found is verified by counting the item's shingles in the document, as strings.

    An item with fewer words than ``width`` is one shingle of all its words; items without words
    are in no document. Rows of equal keys, null ones too, count as one document or item; null and
    empty texts hold nothing; other columns are not read.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    asked = items.select(F.col(item_key).alias("item"), text_words(item_text).alias("words"))
    asked = durable(asked.where("size(words) > 0"), "items")
    sizes = F.least(F.size("words"), F.lit(width))
    widths = sorted(r[0] for r in asked.select(sizes.alias("n")).distinct().collect())  # at most ``width``
    texts = docs.select(F.col(key).alias("doc"), text_words(text).alias("words"))
    found = [
        _contained(texts, asked.where(sizes == n), n, share).withColumnsRenamed({"doc": key, "item": item_key})
        for n in widths
    ]
    if not found:
        nothing = docs.select(key).limit(0).crossJoin(items.select(item_key).limit(0))
        return nothing.selectExpr("*", "0L AS n_shared", "0L AS n_item", "0D AS containment")
    whole = found[0]
    for more in found[1:]:
        whole = whole.union(more)
    return whole


def _contained(texts: DataFrame, asked: DataFrame, width: int, share: float) -> DataFrame:
    shingles = _exploded(asked, ["item"], width).select("item", _key(width).alias("h"), _string(width).alias("s"))
    shingles = shingles.distinct()
    of_item = Window.partitionBy("item")
    # In whole numbers: share * q is rounded before the ceiling, so that 0.8 * 5 is 4.
    needed = F.ceil(F.round(F.col("n_item") * share, 9))
    ranked = shingles.select(
        "item", "h", "s",
        F.count("*").over(of_item).alias("n_item"),
        F.row_number().over(of_item.orderBy(F.xxhash64(F.lit(width), "h"), "s")).alias("rank"),
    ).withColumn("needed", needed)
    ranked = durable(ranked, "item-shingles")

    level = lambda n: F.floor(F.log2(F.greatest(n, F.lit(1))))
    sketch = ranked.where("rank <= n_item - needed + 1").select("item", "h", level(F.col("needed")).alias("least"))
    n = F.size("words") - (width - 1)
    sized = texts.where(n > 0).select("doc", "words", level(n).alias("level"))
    hashed = _exploded(sized, ["doc", "level"], width).select("doc", "level", _key(width).alias("h"))
    near = hashed.join(small(durable(sketch, "sketches")), "h").where("level >= least")
    near = durable(near.select("doc", "item").distinct(), "near-items")

    held = texts.join(small(near.withColumnRenamed("doc", "d")), F.col("doc").eqNullSafe(F.col("d")))
    there = _exploded(held, ["doc", "item"], width).select("doc", "item", _string(width).alias("s"))
    own = ranked.select(F.col("item").alias("i"), F.col("s").alias("t"), "n_item", "needed")
    same = F.col("item").eqNullSafe(F.col("i")) & (F.col("s") == F.col("t"))
    counted = there.join(small(own), same).groupBy("doc", "item", "n_item", "needed", "s").count()
    counted = counted.groupBy("doc", "item", "n_item", "needed").agg(F.count("*").alias("n_shared"))
    return counted.where("n_shared >= needed").select(
        "doc", "item", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment")
    )


def clean_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    hits = contained_items(docs.select(key, text), items.select("item_id", "text"), key, text)
    hits = durable(hits.select(F.col(key).alias("leaking key")).distinct(), "leaks")
    return docs.join(small(hits), docs[key].eqNullSafe(hits["leaking key"]), "left_anti")
