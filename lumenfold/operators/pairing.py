"""O-35: chat links form on arrival, in order. One rule for batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lumenfold.operators import scan

LINKS = "house bigint, seq bigint, id string, partner string, event string"


def step(partners: dict, row) -> list[tuple[str, str, str]]:
    """What one row (kind, id, other, other_using) makes of the house's partners: (id, partner, event)
    for both. A link forms on arrival only with a partner who is free and not in use of
    something; an arrival by one who has a link, or a repeated one, comes to nothing."""
    if row.kind == "leave":
        other = partners.pop(row.id, None)
        if not other:
            return []
        partners.pop(other, None)
        return [(row.id, other, "parted"), (other, row.id, "parted")]
    if row.id == row.other or row.other_using or row.other in partners or row.id in partners:
        return []
    partners[row.id], partners[row.other] = row.other, row.id
    return [(row.id, row.other, "linked"), (row.other, row.id, "linked")]


def chat_links(arrivals: DataFrame) -> DataFrame:
    """arrivals(house, seq, kind, id, other, other_using) -> LINKS of all houses, each in the order of seq.

    The state of a house is one small map. A null house is left out."""
    return scan.fold(arrivals.where("house is not null"), ["house"], ["seq"], dict, lambda state, row: [(row.house, row.seq, *x) for x in step(state, row)], LINKS)
