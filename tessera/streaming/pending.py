"""Life of pending items in a stream: seen, seen again, replaced, confirmed, expired; and forks of a chain.

State is kept per sender and nonce, which is all that any of these steps looks at, so a busy sender is many
small states. A state holds the transaction under way, its first and last sight and its fee cap, and the
hashes that it replaced, which may not come back. Event time drives expiry: a state that nobody has seen for
``ttl`` seconds goes, and says so if it was still open.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.sources import views
from tessera.streaming import rollups

OBSERVED = "kind string, tx_hash string, actor string, nonce long, max_fee long, tip long, at timestamp, block_number long, items long"
EVENTS = "event string, tx_hash string, actor string, slot string, max_fee long, tip long, replacement string, replacement_fee long, replacement_tip long, first_seen timestamp, last_seen timestamp, block_number long, items long"
STATE = "tx_hash string, max_fee long, tip long, first_seen timestamp, last_seen timestamp, closed boolean, replaced string"


class Open(NamedTuple):
    """What is known of a sender's nonce: the transaction under way, or the confirmed one."""

    tx_hash: str | None = None
    max_fee: int | None = None
    tip: int | None = None
    first_seen: datetime | None = None
    last_seen: datetime | None = None
    closed: bool = False
    replaced: str = "[]"


def _whole(value) -> int | None:
    return None if pd.isna(value) else int(value)


def step(state: Open | None, row) -> tuple[Open, list[dict]]:
    """The state after an observation, and the events that it gives. A transaction that another one of the same
    nonce displaces is ``replaced``, whether the other one is seen pending or at once confirmed."""
    s = state or Open()
    max_fee, tip, at = _whole(row.max_fee), _whole(row.tip), row.at.to_pydatetime()
    if s.closed:
        return s._replace(last_seen=max(s.last_seen, at)), []
    gone = {"event": "replaced", "tx_hash": s.tx_hash, "max_fee": s.max_fee, "tip": s.tip, "replacement": row.tx_hash, "replacement_fee": max_fee, "replacement_tip": tip, "first_seen": s.first_seen, "last_seen": at}
    displaced = [gone] if s.tx_hash not in (None, row.tx_hash) else []
    tombs = json.dumps([*json.loads(s.replaced), s.tx_hash]) if displaced else s.replaced
    if row.kind == "confirmed":
        since = s.first_seen if s.tx_hash == row.tx_hash else None
        done = {"event": "confirmed", "tx_hash": row.tx_hash, "max_fee": max_fee, "tip": tip, "first_seen": since, "last_seen": at, "block_number": _whole(row.block_number), "items": _whole(row.items)}
        return Open(row.tx_hash, max_fee, tip, since or at, at, True, tombs), [*displaced, done]
    if row.tx_hash in json.loads(s.replaced):
        return s, []
    if s.tx_hash == row.tx_hash:
        return s._replace(first_seen=min(s.first_seen, at), last_seen=max(s.last_seen, at)), []
    added = {"event": "added", "tx_hash": row.tx_hash, "max_fee": max_fee, "tip": tip, "first_seen": at, "last_seen": at}
    return Open(row.tx_hash, max_fee, tip, at, at, False, tombs), [*displaced, added]


def lifecycle(observed: DataFrame, ttl: int = 3600, late: str = "10 minutes") -> DataFrame:
    """Events of a stream (or table) of observations ``OBSERVED``; without a nonce a transaction stands alone."""
    names = [c.split()[0] for c in EVENTS.split(", ")]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = Open(*state.get) if state.exists else None
        out: list[dict] = []
        if state.hasTimedOut:
            if held and not held.closed:
                out.append({"event": "expired", "tx_hash": held.tx_hash, "max_fee": held.max_fee, "tip": held.tip, "first_seen": held.first_seen, "last_seen": held.last_seen})
            state.remove()
        else:
            for row in pd.concat(list(parts)).sort_values(["at", "kind", "tx_hash"], kind="stable").itertuples(index=False):
                held, events = step(held, row)
                out += events
            state.update(tuple(held))
            ends = int(pd.Timestamp(held.last_seen).timestamp() * 1000) + ttl * 1000
            state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        frame = pd.DataFrame([e | {"actor": key[0], "slot": key[1]} for e in out], columns=names)
        whole = {c: "Int64" for c in ("max_fee", "tip", "replacement_fee", "replacement_tip", "block_number", "items")}
        yield frame.astype(whole | {"first_seen": "datetime64[us]", "last_seen": "datetime64[us]"})

    keyed = observed.withWatermark("at", late).withColumn("slot", F.coalesce(F.col("nonce").cast("string"), "tx_hash"))
    return keyed.groupBy("actor", "slot").applyInPandasWithState(run, EVENTS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def promotion_sink(base: str, chunk: int = 1000):
    """A foreachBatch function for ``lifecycle`` events: confirmed transactions become rows of ``facts``, one an item, with
    their first sight, and displaced ones rows of ``replacements`` with the fees of both sides. Batches may repeat."""
    facts = rollups.upsert_sink(f"{base}/facts", ["block_number", "tx_hash", "ordinal"], F.floor(F.col("block_number") / chunk))
    log = rollups.upsert_sink(f"{base}/replacements", ["replaced", "replaced_at"], F.floor(F.unix_seconds("replaced_at") / 86400))

    def write(batch: DataFrame, batch_id: int) -> None:
        items = batch.where("event = 'confirmed'").withColumn("ordinal", F.explode(F.expr("sequence(0L, greatest(coalesce(items, 1L), 1L) - 1)")))
        facts(items.select("block_number", "tx_hash", "ordinal", "actor", "slot", "max_fee", "tip", F.col("last_seen").alias("confirmed_at"), "first_seen"), batch_id)
        gone = batch.where("event = 'replaced'")
        log(gone.select(F.col("tx_hash").alias("replaced"), F.col("last_seen").alias("replaced_at"), "replacement", "actor", "slot", "max_fee", "tip", "replacement_fee", "replacement_tip", "first_seen"), batch_id)

    return write


def reconcile_sink(path: str):
    """A foreachBatch function for full snapshots of what is pending (tx_hash, at, and other columns; one moment a
    batch). What a snapshot lacks has gone, though no message said so: it is trimmed and listed. What it repeats keeps its first
    sight and moves its last one. ``pending/batch=n`` and ``trimmed/batch=n`` hold the outcome; the state before is read from batch n - 1."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in ("tx_hash", "at")]
        now = batch.groupBy("tx_hash").agg(F.max("at").alias("at"), F.max_by(F.struct("tx_hash", *rest), "at").alias("r"))
        now = now.select("tx_hash", *(F.col("r")[c].alias(c) for c in rest), F.col("at").alias("first_seen"), F.col("at").alias("last_seen"))
        before = rollups.stored(spark, f"{path}/pending/batch={batch_id - 1}", now.schema)
        known = before.select("tx_hash", F.col("first_seen").alias("since"))
        kept = now.join(known, "tx_hash", "left").withColumn("first_seen", F.least("first_seen", "since")).select(now.columns)
        kept.write.mode("overwrite").parquet(f"{path}/pending/batch={batch_id}")
        before.join(now.select("tx_hash"), "tx_hash", "left_anti").write.mode("overwrite").parquet(f"{path}/trimmed/batch={batch_id}")

    return write


def snapshot_sink(pending, path: str, lag: int = 60, chunk: int = 1000):
    """A foreachBatch function for batches of new blocks (as the view ``blocks``, with ``arrived``): writes what each
    live block left out, judged against ``pending(spark)`` as it is then. Blocks that came more than ``lag`` seconds
    late get none, and a block that has a snapshot keeps it, also when its batch comes again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        live = batch.where(F.abs(F.col("arrived") - F.col("t")) <= lag)
        rows = views.missed(pending(spark), live).withColumn("part", F.floor(F.col("block_number") / chunk))
        old = rollups.stored(spark, path, rows.schema)
        near = rollups.touched(old, live.select(F.floor(F.col("block_number") / chunk).alias("part"))).select(rows.columns)
        fresh = rows.join(near.select("block_number").distinct(), "block_number", "left_anti").select(rows.columns)
        rollups.replace_partitions(near.unionByName(fresh), path, "part", batch_id)

    return write


HEADS = "chain long, seq long, number long, hash string, parent string"
FORKS = "chain long, number long, hash string, outcome string, fork long, dropped long"


class Chain:
    """The recent blocks of a chain as a tree: hash -> (number, parent), of all branches, and its tip.

    A head whose branch meets the chain below its tip is a fork: all above the common ancestor is void. A head whose
    ancestors haven't been seen waits for them, since heads may come out of order. A branch whose way back would be longer than
    ``depth`` is ``exhausted``: there is no proof of a common ancestor, so none is given, and the chain starts anew
    from that head. Where the chain is known from its first block on, a branch from below it is a fork at the
    number before the branch (``start``)."""

    def __init__(self, depth: int, tip: str | None = None, cut: bool = False, tree: dict | None = None):
        self.depth, self.tip, self.cut, self.tree = depth, tip, cut, tree or {}

    def line(self, head: str) -> tuple[list[str], str]:
        """``head`` and its known ancestors, and the first ancestor that isn't known."""
        out = []
        while head in self.tree:
            out.append(head)
            head = self.tree[head][1]
        return out, head

    def settle(self, head: str) -> tuple | None:
        """Makes ``head`` the tip if its branch meets the chain; (outcome, fork, dropped) if blocks became void."""
        top = self.tree[self.tip][0]
        own = self.line(self.tip)[0]
        chain = {self.tree[h][0]: h for h in own}
        branch, _ = self.line(head)
        meets = next((h for h in branch if chain.get(self.tree[h][0]) == h), None)
        if meets is not None:
            fork = self.tree[meets][0]
            if head == meets and head != self.tip:
                return None  # a block of the chain that is told again
            self.tip = head
            return ("fork", fork, top - fork) if fork < top else None
        first = self.tree[branch[-1]][0]
        if first - 1 <= top - self.depth and self.cut or len(branch) >= self.depth:
            self.tip = head
            self.tree = {h: self.tree[h] for h in branch}
            return ("exhausted", None, None)
        if first <= min(chain) and not self.cut:
            self.tip = head
            return ("start", first - 1, top - first + 1)
        return None

    def add(self, number: int, hash_: str, parent: str) -> list[tuple]:
        """(number, hash, outcome, fork, dropped) of what a head makes void."""
        head, new = hash_, hash_ not in self.tree
        self.tree[hash_] = (number, parent)
        if self.tip is None:
            self.tip = hash_
            return []
        if new and any(p == hash_ for _, p in self.tree.values()):
            # Blocks that waited for this one follow it; the highest of them is the head of its branch.
            head = max((h for h in self.tree if hash_ in self.line(h)[0]), key=lambda h: (self.tree[h][0], h))
        found = self.settle(head)
        top = self.tree[self.tip][0]
        low = [h for h, (n, _) in self.tree.items() if n <= top - self.depth]
        self.cut = self.cut or any(h in self.line(self.tip)[0] for h in low)
        for h in low:
            del self.tree[h]
        return [(self.tree[self.tip][0], self.tip, *found)] if found else []


def forks(heads: DataFrame, depth: int = 64) -> DataFrame:
    """Of a stream of heads, in the order of ``seq`` inside a batch: where a chain left the blocks that were known. All above
    ``fork`` is void. A chain's state is the tree of its last ``depth`` numbers."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chain = Chain(depth, *json.loads(state.get[0])) if state.exists else Chain(depth)
        out = []
        for row in pd.concat(list(parts)).sort_values("seq", kind="stable").itertuples(index=False):
            out += [(key[0], *x) for x in chain.add(int(row.number), row.hash, row.parent)]
        state.update((json.dumps([chain.tip, chain.cut, chain.tree]),))
        frame = pd.DataFrame(out, columns=["chain", "number", "hash", "outcome", "fork", "dropped"])
        yield frame.astype({"chain": "int64", "number": "int64", "fork": "Int64", "dropped": "Int64"})

    return heads.groupBy("chain").applyInPandasWithState(run, FORKS, "known string", "append", GroupStateTimeout.NoTimeout)
