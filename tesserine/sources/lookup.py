"""Look-ups in batches at a service that refuses a whole batch for one bad id."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence


class Refused(Exception):
    """The service won't answer a batch. ``unknown``: because it knows none of the ids."""

    def __init__(self, unknown: bool = False) -> None:
        super().__init__("unknown ids" if unknown else "a bad id")
        self.unknown = unknown


def look_up(fetch: Callable[[list[str]], list], ids: Sequence[str], well_formed: Callable[[str], bool]) -> tuple[list, Counter]:
    """What ``fetch`` gives for each id, None where there is nothing, and counts of ids skipped, unknown and rejected.

    Ids that aren't well formed are never sent. A refused batch is cut in halves until the bad id stands alone; one of which
    nothing is known is answered with nothing. Other errors go through.
    """
    out, counts = [None] * len(ids), Counter()
    good = [k for k, x in enumerate(ids) if well_formed(x)]
    counts["skipped"] = len(ids) - len(good)
    waiting = [good] if good else []
    while waiting:
        places = waiting.pop()
        try:
            found = fetch([ids[k] for k in places])
        except Refused as e:
            if e.unknown or len(places) == 1:
                counts["unknown" if e.unknown else "rejected"] += len(places)
                continue
            half = len(places) // 2
            waiting += [places[half:], places[:half]]
            continue
        for k, x in zip(places, found, strict=True):
            out[k] = x
    return out, counts
