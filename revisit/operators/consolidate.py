"""Nine tables to one row per event, with the state learned from training tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from revisit.functions.columns import quoted_all, ref, with_prefix
from revisit.operators.client import client_features, one_row_per_key
from revisit.operators.encode import count_encode
from revisit.operators.hot import DEFAULT_POLICY, HotPolicy, join_per_key
from revisit.operators.pivot import MAX_CATEGORIES, category_counts, counted_items, spread
from revisit.schema import (
    CHILD_TABLES,
    CLIENT_CATEGORIES,
    CLIENT_ISSUE,
    CLIENT_KEY,
    MASTER,
    TABLE_SCHEMAS,
    payload_schema,
)
from revisit.sources.tables import check_tables, conform


@dataclass
class Consolidation:
    """Fitted vocabularies (item -> rows at fit) and the moment that ages refer to.

    ``undeclared`` has, by table, the (name, type) of columns beyond the declared ones: they are
    features of their own, so payloads to be scored are read with them.
    """

    as_of: str
    encode_counts: bool = False
    children: dict[str, dict] = field(default_factory=dict)
    client_issues: dict = field(default_factory=dict)
    client: dict[str, dict] = field(default_factory=dict)
    undeclared: dict[str, list] = field(default_factory=dict)

    # ------------------------------------------------------------------ fit

    @classmethod
    def fit(
        cls,
        tables: Mapping[str, DataFrame],
        as_of: str | datetime,
        encode_counts: bool = False,
        max_categories: int = MAX_CATEGORIES,
    ) -> Consolidation:
        """Learn the vocabularies in one pass over the category columns."""
        check_tables(tables, need_rows=True)
        tables = conform(tables)
        wanted = {name: (tables[name], item) for name, (_, item) in CHILD_TABLES.items()}
        wanted["clientissue"] = (tables["clientissue"], CLIENT_ISSUE[1])
        present = [c for c in CLIENT_CATEGORIES if c in tables["client"].columns]
        if present:
            client = one_row_per_key(tables["client"], "clientid")
            wanted.update({"client " + c: (client, c) for c in present})
        counts = category_counts(wanted, max_categories)
        return cls(
            as_of=str(as_of),
            encode_counts=encode_counts,
            children={name: counts[name] for name in CHILD_TABLES},
            client_issues=counts["clientissue"],
            client={c: counts["client " + c] for c in present},
            undeclared=undeclared_columns(tables),
        )

    def payload_schema(self) -> StructType:
        """What payloads to be scored are read with."""
        return payload_schema(self.undeclared)

    # ------------------------------------------------------------ transform

    def master(
        self, tables: Mapping[str, DataFrame], policy: HotPolicy = DEFAULT_POLICY
    ) -> DataFrame:
        """One wide row per event."""
        joined = self.with_clients(self.events(tables), tables, policy)
        return self.spread(joined)

    def bare_events(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        """Only id, entity and time of the events."""
        named = with_prefix(conform(tables)["referral"], "referral_")
        return named.select(MASTER.event_id, MASTER.entity, MASTER.ts)

    def events(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        """Events with their child item counts (see ``counted_items``)."""
        check_tables(tables)
        tables = conform(tables)
        events = with_prefix(tables["referral"], "referral_")
        items = self._child_items()
        for name, (key, item) in CHILD_TABLES.items():
            if not items[name]:
                continue
            rows = tables[name]
            if self.encode_counts:
                rows = count_encode(rows, item, self.children[name])
            counts = counted_items({name: (rows, key, item)}, {name: items[name]})
            # Every side is partitioned by event id, so events move once for all six joins.
            events = events.join(
                counts.withColumnRenamed("key", MASTER.event_id), MASTER.event_id, "left"
            )
        return events

    def with_clients(
        self,
        events: DataFrame,
        tables: Mapping[str, DataFrame],
        policy: HotPolicy = DEFAULT_POLICY,
    ) -> DataFrame:
        """Add the client columns; events without a client row keep nulls, none is duplicated."""
        clients = self.clients(tables)
        per_key = clients.withColumn(MASTER.entity, ref(CLIENT_KEY))
        joined = join_per_key(events, per_key, MASTER.entity, policy, len(clients.columns))
        return joined.selectExpr(*quoted_all([*events.columns, *clients.columns]))

    def clients(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        check_tables(tables)
        tables = conform(tables)
        client = one_row_per_key(tables["client"], "clientid")
        categories = {c: list(v) for c, v in self.client.items()}
        if self.encode_counts:
            for c, fitted in self.client.items():
                client = count_encode(client, c, fitted)
            categories = {c: sorted(set(v.values())) for c, v in self.client.items()}
        for c in categories:
            if c not in client.columns:
                client = client.withColumn(c, F.lit(None).cast("bigint"))
        features = client_features(client, self._moment(), categories)
        key, item = CLIENT_ISSUE
        items = {"clientissue": list(self.client_issues)}
        issues = counted_items({"clientissue": (tables["clientissue"], key, item)}, items)
        issues = issues.withColumnRenamed("key", CLIENT_KEY)
        joined = with_prefix(features, "client_").join(issues, CLIENT_KEY, "left")
        return spread(joined, items)

    def spread(self, events: DataFrame) -> DataFrame:
        """Count maps in ``events``, if any, as one column per fitted item."""
        return spread(events, self._child_items())

    def _child_items(self) -> dict[str, list]:
        if self.encode_counts:
            return {name: sorted(set(v.values())) for name, v in self.children.items()}
        return {name: list(fitted) for name, fitted in self.children.items()}

    def _moment(self) -> Column:
        return F.lit(self.as_of).cast("timestamp_ntz")

    # -------------------------------------------------------------- storage

    def to_state(self) -> dict:
        state = asdict(self)
        state["children"] = {k: list(v.items()) for k, v in self.children.items()}
        state["client"] = {k: list(v.items()) for k, v in self.client.items()}
        state["client_issues"] = list(self.client_issues.items())
        return state

    @classmethod
    def from_state(cls, state: dict) -> Consolidation:
        return cls(
            as_of=state["as_of"],
            encode_counts=state["encode_counts"],
            children={k: dict(map(tuple, v)) for k, v in state["children"].items()},
            client_issues=dict(map(tuple, state["client_issues"])),
            undeclared={k: list(map(tuple, v)) for k, v in state.get("undeclared", {}).items()},
            client={k: dict(map(tuple, v)) for k, v in state["client"].items()},
        )


def undeclared_columns(tables: Mapping[str, DataFrame]) -> dict[str, list[tuple[str, str]]]:
    found = {}
    for name, schema in TABLE_SCHEMAS.items():
        fields = [f for f in tables[name].schema if f.name not in schema.names]
        if fields:
            found[name] = [(f.name, f.dataType.simpleString()) for f in fields]
    return found
