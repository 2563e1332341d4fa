"""Category counts per key.

With up to ``WIDE`` categories in all, counts are plain aggregate columns: one shuffle, reduced
before it. Above that every row would carry mostly empty columns through each step, so counts
stay in one small map per key and become columns in a final projection (``spread``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revisit.functions.columns import literal, named, quoted, quoted_all, ref

MAX_CATEGORIES = 10_000
WIDE = 64


def category_counts(
    tables: Mapping[str, tuple[DataFrame, str]], max_categories: int = MAX_CATEGORIES
) -> dict[str, dict]:
    """Distinct non-null items of each ``name: (table, item column)`` with their row counts.

    One job per item type. Fails above ``max_categories`` in total, as Spark's own pivot does:
    every category becomes a column.
    """
    parts = _named_items(tables)
    found: dict[str, dict] = {name: {} for name in tables}
    for group in _same_type(parts):
        counted = group.where(F.col("item").isNotNull()).groupBy("name", "item").count()
        rows = counted.limit(max_categories + 1).collect()  # bounded by the limit
        if len(rows) > max_categories:
            raise ValueError(
                f"more than {max_categories} categories; raise max_categories or drop a column"
            )
        for row in rows:
            found[row["name"]][row["item"]] = row["count"]
    return {name: dict(sorted(items.items())) for name, items in found.items()}


def vocabulary(
    tables: Mapping[str, tuple[DataFrame, str]], max_categories: int = MAX_CATEGORIES
) -> dict[str, list]:
    """Sorted distinct items per name."""
    return {name: list(items) for name, items in category_counts(tables, max_categories).items()}


def _named_items(tables: Mapping[str, tuple[DataFrame, str]]) -> list[DataFrame]:
    """(name, item) rows; columns of one table and type come from a single scan of it."""
    together: dict[tuple, list] = {}
    for name, (df, item) in tables.items():
        kind = df.schema[item].dataType.simpleString()
        together.setdefault((id(df), kind), []).append((df, name, item))
    parts = []
    for group in together.values():
        cells = ", ".join(
            f"named_struct('name', {literal(name)}, 'item', {quoted(item)})"
            for _, name, item in group
        )
        parts.append(group[0][0].selectExpr(f"inline(array({cells}))"))
    return parts


def _same_type(parts: Sequence[DataFrame]) -> list[DataFrame]:
    """Union the (name, item) frames that share an item type."""
    groups: dict[str, DataFrame] = {}
    for part in parts:
        kind = part.schema["item"].dataType.simpleString()
        groups[kind] = groups[kind].unionByName(part) if kind in groups else part
    return list(groups.values())


def item_counts(tables: Mapping[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """One row per key; for each ``name: (table, key, item)`` a map from item to row count.

    All tables share one key meaning and one item type and are counted together: a partial
    count per (key, table, item) before the first shuffle, then one small map per key.
    """
    names = list(tables)
    counts = _long_items(tables).groupBy("key", "place", "item").agg(F.count(F.lit(1)).alias("n"))
    pair = F.struct("item", "n")
    return counts.groupBy("key").agg(
        *[
            F.map_from_entries(F.collect_list(F.when(F.col("place") == place, pair))).alias(name)
            for place, name in enumerate(names)
        ]
    )


def _long_items(tables: Mapping[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(key, place, item) rows of all tables; rows without key or item count nowhere."""
    rows = None
    for place, (df, key, item) in enumerate(tables.values()):
        part = df.where(ref(key).isNotNull() & ref(item).isNotNull()).selectExpr(
            named(quoted(key), "key"), f"{place} AS place", named(quoted(item), "item")
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows


def counted_items(
    tables: Mapping[str, tuple[DataFrame, str, str]], items: Mapping[str, Sequence]
) -> DataFrame:
    """One row per key with its item counts, as columns if they are few, else as maps.

    ``spread`` turns either into columns ``<name>_<item>``.
    """
    if sum(len(v) for v in items.values()) > WIDE:
        return item_counts(tables)
    rows = _long_items(tables)
    kind = rows.schema["item"].dataType.simpleString()
    cells = [
        F.expr(
            f"nullif(count_if(place = {place} AND item = CAST({literal(v)} AS {kind})), 0)"
        ).alias(f"{name}_{v}")
        for place, name in enumerate(tables)
        for v in items[name]
    ]
    if not cells:
        return rows.select("key").distinct()
    return rows.groupBy("key").agg(*cells)


def spread(counts: DataFrame, maps: Mapping[str, Sequence]) -> DataFrame:
    """Turn each map column into one column per listed item, named ``<map>_<item>``."""
    maps = {name: items for name, items in maps.items() if name in counts.columns}
    if not maps:
        return counts
    keys = {name: counts.schema[name].dataType.keyType.simpleString() for name in maps}
    wide = [
        named(
            f"try_element_at({quoted(name)}, CAST({literal(item)} AS {keys[name]}))",
            f"{name}_{item}",
        )
        for name, items in maps.items()
        for item in items
    ]
    others = quoted_all(c for c in counts.columns if c not in maps)
    return counts.selectExpr(*others, *wide)


def count_pivot(
    df: DataFrame, key: str, item: str, prefix: str, items: Sequence | None = None
) -> DataFrame:
    """Rows per (key, item) as columns ``<prefix>_<item>``; absent pairs are null.

    Without ``items`` the vocabulary is looked up first.
    """
    if items is None:
        items = vocabulary({prefix: (df, item)})[prefix]
    counts = counted_items({prefix: (df, key, item)}, {prefix: items})
    return spread(counts.withColumnRenamed("key", key), {prefix: items})

