"""The fail-closed replay as a stateful stream, keyed by session and asset.

State is a session's: a row of kind end (the session's end, sent for each of its assets) removes it. Rows of a
micro-batch are put in order of their sequence before they apply. A row that comes in a later batch than one of a
higher sequence can't be put in its place any more: it is told as late_row, and the book it would have changed is
invalid until the next one. The fold is also the plain version that tests hold the batch plan against.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame

OUTPUT = "session_id string, asset_id string, seq long, event_index int, change_index int, status string, reason string, comparison string, derived_bid string, derived_ask string, version long"
STATE = "book string"


class Book:
    """One asset's book: sizes by exact price, and the prices that have size, in order."""

    def __init__(self, text: str | None = None):
        held = json.loads(text) if text else {"valid": False, "version": 0, "last": None, "sides": {}}
        self.valid, self.version = held["valid"], held["version"]
        self.last = tuple(held["last"]) if held["last"] else None
        self._set({s: {Decimal(p): Decimal(n) for p, n in held["sides"].get(s, ())} for s in ("BUY", "SELL")})

    def _set(self, sides: dict[str, dict[Decimal, Decimal]]) -> None:
        self.sides = sides
        self.filled = {s: sorted(p for p, n in x.items() if n > 0) for s, x in sides.items()}

    def dump(self) -> str:
        return json.dumps({"valid": self.valid, "version": self.version, "last": self.last, "sides": {s: [[str(p), str(n)] for p, n in x.items()] for s, x in self.sides.items()}})

    def late(self, row: dict) -> bool:
        """Whether a row of this place or a later one was there before; else this one is the last now."""
        at = (int(row["seq"]), int(row["event_index"]), int(row["change_index"]))
        if self.last is not None and at <= self.last:
            self.valid = False
            return True
        self.last = at
        return False

    def replace(self, levels: list[tuple[str, str, str]]) -> None:
        sides: dict[str, dict[Decimal, Decimal]] = {"BUY": {}, "SELL": {}}
        for side, price, size in levels:
            sides[side][Decimal(price)] = Decimal(size)
        self._set(sides)
        self.valid = True
        self.version += 1

    def put(self, side: str, price: Decimal, size: Decimal) -> None:
        """A size at a price; zero takes the level off."""
        had = self.sides[side].get(price, Decimal(0)) > 0
        if size == 0:
            self.sides[side].pop(price, None)
        else:
            self.sides[side][price] = size
        filled = self.filled[side]
        if had and size == 0:
            del filled[bisect_left(filled, price)]
        elif size > 0 and not had:
            insort(filled, price)

    def best(self) -> tuple[Decimal | None, Decimal | None]:
        bids, asks = self.filled["BUY"], self.filled["SELL"]
        return bids[-1] if bids else None, asks[0] if asks else None

    def apply(self, e: dict) -> tuple[str, str | None, str | None, Decimal | None, Decimal | None]:
        """status, reason, comparison and derived best prices of one entry."""
        if e["code"]:
            return "excluded", e["code"], None, None, None
        if not self.valid:
            return "excluded", "price_change_without_valid_book", None, None, None
        if e["parse_code"]:
            self.valid = False
            return "excluded", e["parse_code"], None, None, None
        self.put(e["side"], Decimal(e["price"]), Decimal(e["size"]))
        self.version += 1
        found, derived = [], self.best()
        for name, own, empty in (("bid", derived[0], 0), ("ask", derived[1], 1)):
            if not e[f"has_{name}"]:
                continue
            if e[f"best_{name}_code"]:
                found.append("unparseable")
                break
            seen = None if e[f"best_{name}"] is None else Decimal(e[f"best_{name}"])
            found.append("match" if seen == own else "candidate" if own is None and seen == empty else "mismatch")
        comparison = next((k for k in ("unparseable", "mismatch", "candidate", "match") if k in found), None)
        if comparison in ("unparseable", "mismatch"):
            self.valid = False
        return "applied", None, comparison, *derived


def fold(book: Book, rows: list[dict]) -> Iterator[tuple]:
    """rows in order: kind (book, entry); levels of books as side, price, size."""
    text = lambda v: None if v is None else format(v.normalize(), "f")
    for r in rows:
        late = book.late(r)
        if r["kind"] == "book":
            if not late:
                book.replace(r["levels"])
        else:
            status, reason, comparison, bid, ask = ("excluded", "late_row", None, None, None) if late else book.apply(r)
            yield r["seq"], r["event_index"], r["change_index"], status, reason, comparison, text(bid), text(ask), book.version


def _clean(row: dict) -> dict:
    out = {k: None if not isinstance(v, (list, tuple)) and not hasattr(v, "__len__") and pd.isna(v) else v for k, v in row.items()}
    if out["kind"] == "book":
        out["levels"] = [(x["side"], x["price"], x["size"]) for x in out["levels"]]
    return out


def replay_stream(rows: DataFrame) -> DataFrame:
    """rows: session_id, asset_id, seq, event_index, change_index, kind (book, entry, end), levels (array of side, price,
    size texts of accepted books), code, parse_code, side, price, size, has_bid, best_bid, best_bid_code and the same of ask; numbers as text."""

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        book = Book(state.get[0] if state.exists else None)
        frame = pd.concat(list(batches)).sort_values(["seq", "event_index", "change_index"])
        ended = bool((frame["kind"] == "end").any())
        out = [(*key, *x) for x in fold(book, [_clean(r) for r in frame[frame["kind"] != "end"].to_dict("records")])]
        if not ended:
            state.update((book.dump(),))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return rows.groupBy("session_id", "asset_id").applyInPandasWithState(run, OUTPUT, STATE, "append", "NoTimeout")
