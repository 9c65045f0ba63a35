"""Point lots, the ledger fold, balances."""

from __future__ import annotations

import datetime as dt
from bisect import insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import expiry_date, merge_wait_over

LOT_KEY = ("group_id", "period", "origin")


def build_lots(accruals: DataFrame, years: int = 2, month: int = 2, day: int = 5) -> DataFrame:
    """One lot per group, month and origin; its id is a hash of these, so no global order is needed."""
    sums = accruals.groupBy("group_id", F.trunc("credited_on", "MM").alias("period"), "origin").agg(F.sum("points").alias("points"))
    lot_id = F.sha2(F.concat_ws("#", F.col("group_id").cast("string"), F.col("period").cast("string"), "origin"), 256)
    return sums.withColumn("lot_id", lot_id).withColumn("available_from", F.last_day("period")).withColumn("expires_on", expiry_date(F.col("period"), years, month, day))


def in_transit(lots: DataFrame, cut: Column) -> DataFrame:
    """Points of lots that become available only after the cut."""
    return lots.where(F.col("available_from") > cut).groupBy("origin").agg(F.sum("points").alias("points"), F.count(F.lit(1)).alias("lots"))


#: One row of the fold: movements (acumulacion, expiracion, canje), results of requests (solicitud), what lots still hold (saldo).
_FOLDED = "lot_id string, group_id string, type string, date date, points long, request_id string, result string, expires_on date, arrived int"
BOOKS = "group_id string, lot_id string, expires_on date, arrived int, remaining long"


class LotBook:
    """The lots of one group that can still be used, in the order in which redemptions take them."""

    def __init__(self, newest_first: bool = False) -> None:
        self.sign = -1 if newest_first else 1
        self.places: list[tuple[int, int, str]] = []  # expiry as a day number (negated: newest first), arrival, lot
        self.left: dict[str, int] = {}
        self.arrivals = 0
        self.balance = 0

    def add(self, lot_id: str, expires_on: dt.date, points: int, arrived: int | None = None) -> None:
        """A new lot, or one carried over from an earlier book with its arrival."""
        arrived = self.arrivals if arrived is None else arrived
        self.arrivals = max(self.arrivals, arrived) + 1
        insort(self.places, (self.sign * expires_on.toordinal(), arrived, lot_id))
        self.left[lot_id] = points
        self.balance += points

    def _take(self, lot_id: str, points: int) -> tuple[str, int]:
        self.left[lot_id] -= points
        self.balance -= points
        return lot_id, points

    def expire(self, day: dt.date) -> list[tuple[str, int]]:
        """Drops the lots whose time is over; what each of them lost."""
        today = day.toordinal()
        over = [lot for key, _, lot in self.places if self.sign * key <= today]
        if over:
            self.places = [place for place in self.places if self.sign * place[0] > today]
        return [self._take(lot, self.left[lot]) for lot in over if self.left[lot]]

    def redeem(self, points: int) -> list[tuple[str, int]]:
        """Takes the points lot by lot; the book must hold them."""
        taken, used = [], 0
        for _, _, lot in self.places:
            if not points:
                break
            part = min(points, self.left[lot])
            if part:
                taken.append(self._take(lot, part))
                points -= part
            used += not self.left[lot]
        # Emptied lots are the first ones.
        del self.places[:used]
        return taken

    def rest(self) -> list[tuple[str, dt.date, int, int]]:
        """What is left: lot, expiry, arrival, points."""
        return [(lot, dt.date.fromordinal(self.sign * key), arrived, self.left[lot]) for key, arrived, lot in self.places if self.left[lot]]


def year_after(day: dt.date) -> dt.date:
    return dt.date(day.year + 1, day.month, 28 if (day.month, day.day) == (2, 29) else day.day)


def refusal(client_id: str | None, day: dt.date, points: int, holder: str | None, free_from: dt.date | None, balance: int) -> str | None:
    """Why a request is turned down; the first reason that holds."""
    if holder is None or client_id != holder:
        return "no_es_titular"
    if free_from is not None and day < free_from:
        return "unificacion_menor_a_12_meses"
    return "saldo_insuficiente" if balance < points else None


ARRIVES, CUT, ASKED = 0, 1, 2


def fold_group(lots: list[tuple], requests: list[tuple], holder: str | None, merged: dt.date | None, cuts: list[dt.date], order: str = "fifo", carried: list[tuple] = ()) -> list[tuple]:
    """One group's events in order of day; on each day its lots arrive, then the cut is made, then requests are judged.

    lots: (lot_id, available_from, expires_on, points); requests: (request_id, date, client_id, points); carried: rows of an
    earlier book (lot_id, expires_on, arrived, points).  Rows as in _FOLDED without the group.
    """
    book, out, free_from = LotBook(order == "lifo"), [], year_after(merged) if merged else None
    for lot_id, expires_on, arrived, points in carried:
        book.add(lot_id, expires_on, points, arrived)
    events = [(day, ARRIVES, lot_id, expires, points) for lot_id, day, expires, points in lots]
    events += [(day, CUT, "", None, 0) for day in cuts]
    events += [(day, ASKED, request_id, client_id, points) for request_id, day, client_id, points in requests]
    events.sort(key=lambda e: e[:3])
    for day, kind, ident, other, points in events:
        if kind == ARRIVES:
            book.add(ident, other, points)
            out.append((ident, "acumulacion", day, points, None, None, None, None))
        elif kind == CUT:
            out += [(lot, "expiracion", day, -n, None, None, None, None) for lot, n in book.expire(day)]
        else:
            reason = refusal(other, day, points, holder, free_from, book.balance)
            if reason is None:
                out += [(lot, "canje", day, -n, ident, None, None, None) for lot, n in book.redeem(points)]
            out.append((None, "solicitud", day, points, ident, reason or "aprobado", None, None))
    out += [(lot, "saldo", None, left, None, None, expires, arrived) for lot, expires, arrived, left in book.rest()]
    return out


def advance_ledger(
    books: DataFrame | None, lots: DataFrame, requests: DataFrame, groups: DataFrame, cuts: list, order: str = "fifo", per_task: int = 1000
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(movements, requests with result, books): folds new lots, cuts and requests onto the books of an earlier run, or onto none.

    Only what came after the earlier run is read, all of it later than what that run has folded; books hold one row per
    lot that can still be used (BOOKS).  The only sequential step: it folds lots (months x origins per group) and requests, never
    transactions, so a group is a small table; about `per_task` groups are one task, and there are at least as many tasks as shuffle
    partitions.  groups: group_id, holder_id, merged_since; requests: request_id, group_id, client_id, date, points.
    Rows whose group is null are one group without a holder, so its requests are refused.
    """
    if order not in ("fifo", "lifo"):
        raise ValueError(f"unknown order {order}")
    days = [dt.date.fromisoformat(str(c)[:10]) for c in cuts]
    names = [c.split()[0] for c in _FOLDED.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.date32(), pa.int64(), pa.string(), pa.string(), pa.date32(), pa.int32()]

    def fold(key: tuple, held: pa.Table, asked: pa.Table) -> pa.Table:
        lot_rows = list(zip(*(held[c].to_pylist() for c in ("lot_id", "available_from", "expires_on", "points", "arrived")), strict=True))
        ask_rows = list(zip(*(asked[c].to_pylist() for c in ("request_id", "date", "client_id", "points", "holder_id", "merged_since")), strict=True))
        group = key[0].as_py()
        # Group attributes ride on the second table, one row without a request id.
        holder, merged = next(((r[4], r[5]) for r in ask_rows if r[0] is None), (None, None))
        rows = fold_group(
            [r[:4] for r in lot_rows if r[4] is None], [r[:4] for r in ask_rows if r[0] is not None], holder if group is not None else None, merged, days, order,
            [(r[0], r[2], r[4], r[3]) for r in lot_rows if r[4] is not None],
        )
        columns = list(zip(*rows, strict=True)) or [()] * 8
        columns.insert(1, [group] * len(rows))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    text = lambda c: F.col(c).cast("string").alias(c)
    lot_rows = lots.select(text("group_id"), "lot_id", "available_from", "expires_on", F.col("points").cast("long"), F.lit(None).cast("int").alias("arrived"))
    if books is not None:
        lot_rows = lot_rows.unionByName(books.select(text("group_id"), "lot_id", "expires_on", "arrived", F.col("remaining").alias("points")), allowMissingColumns=True)
    asked = requests.select(text("group_id"), "request_id", text("client_id"), "date", F.col("points").cast("long"))
    known = groups.select(text("group_id"), text("holder_id"), "merged_since").dropDuplicates(["group_id"])
    side = asked.unionByName(known, allowMissingColumns=True)
    # A number of partitions of its own: adaptive execution would merge these few bytes into one or two tasks.
    tasks = max(int(lots.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups.count() // per_task)
    deal = lambda df: df.repartition(tasks, "group_id").groupBy("group_id")
    done = deal(lot_rows).cogroup(deal(side)).applyInArrow(fold, _FOLDED)
    movements = done.where(F.col("type").isin("acumulacion", "expiracion", "canje")).select("lot_id", "group_id", "type", "date", "points", "request_id")
    results = done.where("type = 'solicitud'").select("request_id", "group_id", "date", "points", "result")
    return movements, results, done.where("type = 'saldo'").select("group_id", "lot_id", "expires_on", "arrived", F.col("points").alias("remaining"))


def run_ledger(lots: DataFrame, requests: DataFrame, groups: DataFrame, cuts: list, order: str = "fifo") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(movements, requests with result, lots with what remains) from the beginning."""
    movements, results, books = advance_ledger(None, lots, requests, groups, cuts, order)
    return movements, results, remaining(lots, books)


def remaining(lots: DataFrame, books: DataFrame) -> DataFrame:
    """Lots with what the books hold of them; nothing of lots that are not there."""
    return lots.join(books.select("lot_id", "remaining"), "lot_id", "left").withColumn("remaining", F.coalesce("remaining", F.lit(0)))


def balances(lots: DataFrame, groups: DataFrame, next_cut: Column, on: Column) -> DataFrame:
    """Balance per group, what expires at the next cut, and whether the group may redeem."""
    soon = F.sum(F.when(F.col("expires_on") <= next_cut, F.col("remaining")).otherwise(0))
    sums = lots.groupBy("group_id").agg(F.sum("remaining").alias("balance"), soon.alias("expires_next_cut"))
    return sums.join(groups, "group_id").withColumn("may_redeem", merge_wait_over(F.col("merged_since"), on))


def check_ledger(lots: DataFrame, movements: DataFrame) -> DataFrame:
    """Groups whose lots do not add up to their movements; empty when the ledger holds."""
    a = lots.groupBy(F.col("group_id").cast("string").alias("group_id")).agg(F.sum("remaining").alias("held"))
    b = movements.groupBy("group_id").agg(F.sum("points").alias("moved"))
    both = a.join(b, "group_id", "full_outer")
    return both.where(F.coalesce("held", F.lit(0)) != F.coalesce("moved", F.lit(0)))


def lot_state(lots: DataFrame, groups: DataFrame, as_of: Column) -> DataFrame:
    """acreditado, retenido, disponible, canjeado, vencido."""
    free = merge_wait_over(F.col("merged_since"), as_of)
    state = (
        F.when(F.col("available_from") > as_of, "acreditado").when(F.col("expires_on") <= as_of, "vencido").when(F.col("remaining") <= 0, "canjeado")
        .when(~free, "retenido").otherwise("disponible")
    )
    return lots.join(groups.select("group_id", "merged_since"), "group_id").withColumn("state", state)


def effective_life(lots: DataFrame) -> DataFrame:
    """Months that a lot can be used, by month of accrual."""
    months = F.round(F.datediff("expires_on", "available_from") / 30.44, 2)
    return lots.select("period", months.alias("life_months")).distinct()
