"""The historical questions as methods: request checks on the driver, then one DataFrame plan each.

Results are DataFrames; a miss is an empty one where the answer may be absent. Nothing is read but the
tip's height, which every check needs once.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heightline.functions import address, binary
from heightline.operators import commit, energy, events, ledger, series, temporal, validation
from heightline.operators.validation import RequestError
from heightline.schema import STATES


class BalanceService:
    """Questions about balances.

    rows: account, height, delta, balance; utxo: txid, vout and others; registry: script_hash,
    script_pubkey; commits: height and others. The last three only where their methods are used.
    """

    def __init__(self, rows: DataFrame, utxo: DataFrame | None = None, registry: DataFrame | None = None, commits: DataFrame | None = None, stable_height: int | None = None, facts: dict | None = None):
        self.rows, self.utxo, self.registry, self.commits, self.facts = rows, utxo, registry, commits, facts or {}
        if stable_height is not None:
            self.stable_height = stable_height

    @cached_property
    def stable_height(self) -> int:
        return self.rows.agg(F.max("height")).first()[0] or 0

    def _keys(self, accounts: list) -> DataFrame:
        kind = self.rows.schema["account"].dataType.simpleString()
        return self.rows.sparkSession.createDataFrame(list(enumerate(validation.batch(accounts))), f"pos int, account {kind}")

    def balance(self, account, height: int | None = None, span: tuple[int, int] | None = None) -> DataFrame:  # B1
        """At a height: one row, zeros for a miss. Over [start, end): the rows. Neither: the latest row."""
        if span is not None:
            return temporal.in_range(self.rows, account, *span).orderBy("height")
        at = self.stable_height if height is None else validation.height_at_most(height, self.stable_height)
        return self.balances([account], at).drop("pos")

    def balances(self, accounts: list, height: int | None = None) -> DataFrame:  # B2
        """In the order of the request (pos), repeats included."""
        at = self.stable_height if height is None else validation.height_at_most(height, self.stable_height)
        return temporal.as_of_keys(self.rows, self._keys(accounts), at).orderBy("pos")

    def delta(self, account, height: int | None = None, span: tuple[int, int] | None = None) -> DataFrame:  # B3
        """The row of exactly this height, if any, or the rows of a range; heights aren't checked here."""
        if height is None and span is None:
            raise RequestError("INVALID_PARAMS", "a height or a range is needed")
        return temporal.exact(self.rows, account, height) if span is None else temporal.in_range(self.rows, account, *span).orderBy("height")

    def deltas(self, accounts: list, height: int | None = None, span: tuple[int, int] | None = None) -> DataFrame:  # B4
        if height is None and span is None:
            raise RequestError("INVALID_PARAMS", "a height or a range is needed")
        first, end = span if span is not None else (height, height + 1)
        found = self.rows.where((F.col("height") >= first) & (F.col("height") < end))
        return self._keys(accounts).join(found, "account", "left").orderBy("pos", "height")

    def summary(self, account, start: int, end: int) -> DataFrame:  # B5
        validation.height_at_most(end - 1, self.stable_height)
        validation.filled_range(start, end)
        return series.summary(self.rows.where(F.col("account") == account), start, end)

    def _bucketed(self, form, account, start: int, end: int, size: int) -> DataFrame:
        validation.bucket_size(start, end, size)
        validation.height_at_most(end - 1, self.stable_height)
        own = self.rows.where(F.col("account") == account)
        return form(own, self._keys([account]).select("account"), start, end, size)

    def timeseries(self, account, start: int, end: int, size: int) -> DataFrame:  # B6
        return self._bucketed(series.timeseries, account, start, end, size)

    def flow_buckets(self, account, start: int, end: int, size: int) -> DataFrame:  # B7
        return self._bucketed(series.flows, account, start, end, size)

    def live_output(self, txid: str, vout: int) -> DataFrame:  # B8
        return self.utxo.where((F.col("txid") == txid) & (F.col("vout") == vout))

    def resolve(self, hashes: list[str]) -> DataFrame:  # B9
        """Script, its class and its address for each hash, in order; nulls for unknown ones, and where a script has no address."""
        rows = self.registry.withColumn("kind", binary.script_kind(F.col("script_pubkey")))
        found = temporal.ordered_lookup(validation.batch(hashes), rows, "script_hash")
        return found.withColumn("address", address.script_address(F.col("script_pubkey"))).orderBy("pos")

    def block_commit(self, height: int) -> DataFrame:  # B10
        return self.commits.where(F.col("height") == height)

    def state_ref(self, height: int, expected: dict | None = None) -> DataFrame:  # B11
        """The commit at a height, held against what the caller expects of it."""
        validation.height_at_most(height, self.stable_height)
        found = self.block_commit(height)
        if expected:
            row = found.first()
            validation.expected_state(expected, row.asDict() if row else {})
        return found

    def info(self) -> dict:  # B12, B14-B17
        return self.facts | {"stable_height": self.stable_height}

    def readiness(self) -> dict:  # B13
        return validation.readiness({"synced": self.stable_height, "target": self.stable_height, "snapshot_height": self.stable_height} | self.facts)

    def verify(self, other: DataFrame) -> DataFrame:  # Z18, Z19
        """Rows on which an independent ledger disagrees."""
        return ledger.ledger_difference(self.rows, other, ["account", "height"], ["delta", "balance"])


class PassService:
    """Questions about passes.

    history: id, inscription_id, block_height, event_type, new_state, new_owner; passes: attributes by
    inscription_id; records: energy records (key, height, balance, delta, active_height, energy);
    snapshots: block_height, total_balance, active_address_count; commits: height and others.
    """

    def __init__(self, history: DataFrame, passes: DataFrame, records: DataFrame | None = None, snapshots: DataFrame | None = None, commits: DataFrame | None = None, genesis: int = 0, synced: int | None = None):
        self.history, self.passes, self.records, self.snapshots, self.commits, self.genesis = history, passes, records, snapshots, commits, genesis
        if synced is not None:
            self.synced = synced

    @cached_property
    def synced(self) -> int:
        return self.history.agg(F.max("block_height")).first()[0] or 0

    def _height(self, height: int | None) -> int:
        return self.synced if height is None else validation.retained(validation.height_at_most(height, self.synced), self.genesis)

    def _snapshot(self, height: int | None) -> DataFrame:
        return events.snapshot(self.history, self._height(height))

    def _page(self, rows: DataFrame, order: list, page: int, size: int) -> DataFrame:
        return temporal.offset_page(rows, order, *validation.page(page, size))

    def active(self, height: int | None = None, page: int = 0, size: int = 100) -> DataFrame:  # P1
        return self._page(events.in_states(self._snapshot(height), ["active"]), events.by_latest_event(), page, size)

    def active_total(self, height: int | None = None) -> DataFrame:
        return events.total(events.in_states(self._snapshot(height), ["active"]))

    def one(self, inscription: str, height: int | None = None) -> DataFrame:  # P2
        own = self.history.where(F.col("inscription_id") == inscription)
        return events.with_attributes(events.snapshot(own, self._height(height)), self.passes)

    def stats(self, height: int | None = None) -> DataFrame:  # P3
        return events.state_counts(self.history, self._height(height))

    def of_owner(self, owner: str, height: int | None = None, states: list[str] | None = None, order: str | None = None, page: int = 0, size: int = 100) -> DataFrame:  # P4
        found = events.with_attributes(self._owned(owner, height, states), self.passes)
        return self._page(found, events.by_latest_event(validation.descending(order, True)), page, size)

    def _owned(self, owner: str, height: int | None, states: list[str] | None) -> DataFrame:
        found = self._snapshot(height).where(F.col("new_owner") == owner)
        return events.in_states(found, validation.states(states, STATES), empty_is_all=True)

    def of_owner_total(self, owner: str, height: int | None = None, states: list[str] | None = None) -> DataFrame:
        return events.total(self._owned(owner, height, states))

    def recent(self, height: int | None = None, states: list[str] | None = None, order: str | None = None, page: int = 0, size: int = 100) -> DataFrame:  # P5
        found = events.in_states(self._snapshot(height), validation.states(states, STATES), empty_is_all=True)
        return self._page(events.with_attributes(found, self.passes), events.by_mint(validation.descending(order, True)), page, size)

    def recent_total(self, height: int | None = None, states: list[str] | None = None) -> DataFrame:
        return events.total(events.in_states(self._snapshot(height), validation.states(states, STATES), empty_is_all=True))

    def active_of_owner(self, owner: str, height: int | None = None) -> DataFrame:  # P6
        found = self._snapshot(height).where((F.col("new_owner") == owner) & (F.col("new_state") == "active"))
        if len(found.limit(2).collect()) > 1:
            raise RequestError("DUPLICATE_ACTIVE_PASS", owner)
        return events.with_attributes(found, self.passes)

    def events_of(self, inscription: str, first: int, last: int, order: str | None = None, page: int = 0, size: int = 100) -> DataFrame:  # P7
        validation.inclusive_range(first, last)
        down = validation.descending(order, False)
        return self._page(events.history_range(self.history, inscription, first, self._height(last)), events.by_latest_event(down), page, size)

    def events_total(self, inscription: str, first: int, last: int) -> DataFrame:
        validation.inclusive_range(first, last)
        return events.total(events.history_range(self.history, inscription, first, self._height(last)))

    def energy(self, inscription: str, height: int | None = None, mode: str = "at_or_before") -> DataFrame:  # P8
        own, at = self.records.where(F.col("key") == inscription), self._height(height)
        if mode == "exact":
            return own.where(F.col("height") == at)
        if mode != "at_or_before":
            raise RequestError("INVALID_MODE", mode)
        return energy.projected(own, at)

    def leaderboard(self, height: int | None = None, top: int = 1000, page: int = 0, size: int = 100, states: tuple[str, ...] = ("active",)) -> DataFrame:  # P9
        """Projected energies of passes in these states; passes without a record don't appear."""
        at = self._height(height)
        offset, limit = validation.page(page, size)
        named = events.in_states(events.snapshot(self.history, at), list(states)).select(F.col("inscription_id").alias("key"), F.col("new_owner").alias("owner"))
        rows = energy.projected(self.records, at).join(named, "key").select("key", "owner", F.col("projected").alias("energy"), F.col("height").alias("record_height"))
        return energy.leaderboard(rows, top, offset, limit)

    def energy_range(self, inscription: str, first: int, last: int, order: str | None = None, page: int = 0, size: int = 100) -> DataFrame:  # P10
        """Stored energies, not projected ones; inclusive on both sides."""
        validation.inclusive_range(first, last)
        down = validation.descending(order, False)
        return self._page(self._records(inscription, first, last), [(F.desc if down else F.asc)("height")], page, size)

    def _records(self, inscription: str, first: int, last: int) -> DataFrame:
        return self.records.where((F.col("key") == inscription) & F.col("height").between(first, self._height(last)))

    def energy_range_total(self, inscription: str, first: int, last: int) -> DataFrame:
        validation.inclusive_range(first, last)
        return events.total(self._records(inscription, first, last))

    def invalid(self, first: int, last: int, page: int = 0, size: int = 100) -> DataFrame:  # P11
        """Invalid mints of the current table by mint height; no as-of view."""
        return self._page(self._invalid(first, last), [F.desc("mint_block_height"), F.desc("inscription_number"), F.asc("inscription_id")], page, size)

    def _invalid(self, first: int, last: int) -> DataFrame:
        validation.inclusive_range(first, last)
        current = events.with_attributes(events.snapshot(self.history, self.synced), self.passes)
        return current.where((F.col("new_state") == "invalid") & F.col("mint_block_height").between(first, last))

    def invalid_total(self, first: int, last: int) -> DataFrame:
        return events.total(self._invalid(first, last))

    def owners(self, height: int | None = None) -> DataFrame:
        """Owners of active passes, each once, in order."""
        return events.owners(self._snapshot(height))

    def active_balance(self, height: int) -> DataFrame:  # P12
        found = self.snapshots.where(F.col("block_height") == height)
        if found.isEmpty():
            raise RequestError("NO_RECORD", str(height))
        return found

    def latest_active_balance(self) -> DataFrame:  # P13
        return self.snapshots.orderBy(F.desc("block_height")).limit(1)

    def synced_active_balance(self) -> DataFrame:  # Z12
        """The latest snapshot, which must be that of the synced height."""
        row = self.latest_active_balance().first()
        if row is None or row["block_height"] != self.synced:
            raise RequestError("SNAPSHOT_NOT_SYNCED", f"{row and row['block_height']}, synced {self.synced}")
        return self.latest_active_balance()

    def commit_at(self, height: int) -> DataFrame:  # Z9
        return commit.commit_at(self.commits, height)
