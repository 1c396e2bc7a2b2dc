"""What a provider learns about its own endpoints, and which cooled source a starved fan-out asks again."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .state import ordered_fold

#: Answers of the second endpoint that are remembered, and how often it is asked in spite of them.
MEMORY, PROBE_EVERY = 3, 8
PROBE_AFTER_S = 10.0


def endpoint_log(searches: DataFrame, key: str, order: list[str], outcomes: str) -> DataFrame:
    """searches with the endpoints ``asked`` (their numbers, in order, as text), the one that ``answered`` (null for none) and the ``lead`` after each.

    outcomes: for each endpoint what it would say, as words apart by blanks: ok, empty, degraded or blocked.
    The endpoint that answered last leads the next search; the first one winning puts the old order back. A
    block ends a search, as the others of that provider would meet it too. A first endpoint that
    brushes off (degraded) ends it as well once the endpoints after it failed ``MEMORY`` times in a row after
    such an answer, but for every ``PROBE_EVERY``-th search of that kind, which looks whether they work again.
    """

    def step(state, said):
        lead, memory, skips = state
        says = (said or "").split()
        turn = list(range(len(says)))
        if lead is not None and 0 < lead < len(says):
            turn.remove(lead)
            turn.insert(0, lead)
        asked, answered = [], None
        for i in turn:
            asked.append(i)
            if says[i] == "ok":
                answered = i
                break
            if says[i] == "blocked":
                break
            if says[i] == "degraded" and i == 0 and len(memory) == MEMORY and not any(memory):
                skips += 1
                if skips % PROBE_EVERY:
                    break
        if answered is not None:
            lead = answered or None
        if asked[:1] == [0] and says[0] == "degraded" and len(asked) > 1:
            memory = (*memory, answered is not None)[-MEMORY:]
        return (lead, memory, skips), " ".join(map(str, asked)), answered, lead

    return ordered_fold(searches, key, order, [outcomes], lambda: (None, (), 0), step, "asked string, answered int, lead int")


def starved_probes(events: DataFrame, key: str, order: list[str], seconds: str, kind: str, source: str, every_s: float = PROBE_AFTER_S) -> DataFrame:
    """events with ``probe``: the source that a starved fan-out asks again, of those that are cooling the one whose breaker has been open longest.

    kinds: open and close (of a source's breaker) and starved (a fan-out all of whose generalists are cooling).
    A source is asked again at the earliest ``every_s`` after its breaker opened and after its last probe.
    """

    def step(state, now, what, name):
        opened, probed = state
        chosen = None
        if what == "open":
            opened = {**opened, name: now}
        elif what == "close":
            opened = {n: t for n, t in opened.items() if n != name}
        elif what == "starved":
            ready = [(t, n) for n, t in opened.items() if now - t >= every_s and now - probed.get(n, float("-inf")) >= every_s]
            if ready:
                chosen = min(ready)[1]
                probed = {**probed, chosen: now}
        return (opened, probed), chosen

    return ordered_fold(events, key, order, [seconds, kind, source], lambda: ({}, {}), step, "probe string")
