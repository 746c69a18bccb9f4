"""Fights of two teams while they run: blows span them, kills are attached to them when the watermark has passed.

State per match and pair of teams: blows and kills that may still change something, the spans that a later kill can be attached to and each
victim's last knock. A timer stands at the first moment at which one of them is settled, and when it fires all that is settled by then is
given out. So state holds some minutes of a fight, whatever the match's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BLOW = "t_us bigint, idx bigint, kind string, damage double, victim_id bigint"
KILL = "t_us bigint, idx bigint, victim_id bigint"
SPAN = "segment bigint, began bigint, ended bigint"
KNOCK = "victim_id bigint, t_us bigint, segment bigint"
OUT = "match_id string, team_a int, team_b int, event string, segment bigint, idx bigint, rule int, began bigint, ended bigint, hits bigint, knocks bigint, damage double"


class Held(NamedTuple):
    """What is known of a pair of teams; number is the segment that comes next."""

    blows: list[tuple]
    kills: list[tuple]
    spans: list[tuple]
    knocks: list[tuple]
    number: int


def settle(held: Held, now: int, gap: int, slack: int) -> tuple[list[dict[str, Any]], Held, int | None]:
    """What is settled at the watermark now, what remains, and when to look again; times in microseconds.

    A segment is closed when no blow can come that is gap or less after its last. By then every kill up to gap before now can be judged:
    inside a span; else the segment of the victim's last knock; else the last span that ended at most gap before.
    """
    segments: list[list[tuple]] = []
    for blow in sorted(held.blows):
        if segments and blow[0] - segments[-1][-1][0] <= gap:
            segments[-1].append(blow)
        else:
            segments.append([blow])
    out, spans, knocks, blows, number = [], list(held.spans), list(held.knocks), [], held.number
    open_spans, open_knocks = [], []
    for i, rows in enumerate(segments):
        n, span = held.number + i, (held.number + i, rows[0][0], rows[-1][0])
        fell = [(victim, t, n) for t, _, kind, _, victim in rows if kind == "knock"]
        if span[2] + gap < now:
            hits = [damage or 0.0 for _, _, kind, damage, _ in rows if kind == "hit"]
            out.append({"event": "fight", "segment": n, "began": span[1], "ended": span[2], "hits": len(hits), "knocks": len(fell), "damage": sum(hits)})
            spans.append(span)
            knocks += fell
            number = n + 1
        else:
            open_spans.append(span)
            open_knocks += fell
            blows += rows
    kills = []
    for kill in sorted(held.kills):
        t, idx, victim = kill
        if t + gap + slack >= now:
            kills.append(kill)
            continue
        known = spans + open_spans
        around = [(e, n) for n, b, e in known if b - slack <= t <= e + slack]
        last = max(((k, n) for v, k, n in knocks + open_knocks if v == victim and k <= t + slack), default=None)
        before = [(e, n) for n, _, e in known if e <= t <= e + gap]
        rule, found = (1, max(around)[1]) if around else (2, last[1]) if last else (3, max(before)[1]) if before else (None, None)
        out.append({"event": "kill", "segment": found, "idx": idx, "rule": rule})
    # kills that wait or come later are after this moment
    since = now - gap - 2 * slack
    spans = [s for s in spans if s[2] >= since - gap]
    newest: dict[int, tuple] = {}
    for k in knocks:
        if k[1] < since:
            newest[k[0]] = max(k, newest.get(k[0], k), key=lambda x: x[1])
    knocks = [k for k in knocks if k[1] >= since] + list(newest.values())
    waits = [e + gap for _, _, e in open_spans[:1]] + [t + gap + slack for t, _, _ in kills[:1]]
    return out, Held(blows, kills, spans, knocks, number), min(waits) if waits else None


class Fights(StatefulProcessor):
    def __init__(self, gap_us: int, slack_us: int):
        self.gap, self.slack = gap_us, slack_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lists = [handle.getListState(n, s) for n, s in (("blows", BLOW), ("kills", KILL), ("spans", SPAN), ("knocks", KNOCK))]
        self.number = handle.getValueState("number", "number bigint")

    def _look_at(self, t_us: int, now_ms: int) -> None:
        self.handle.registerTimer(max(now_ms, t_us // 1000) + 1)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        blows, kills = [], []
        for r in rows:
            if r.kind == "kill":
                kills.append((r.t_us, r.idx, r.victim_id))
            else:
                blows.append((r.t_us, r.idx, r.kind, r.damage, r.victim_id))
        for state, new in zip(self.lists, (blows, kills)):
            if new:
                state.appendList(new)
        self._look_at(min(x[0] for x in blows + kills) + self.gap + self.slack, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        lists = [[tuple(x) for x in s.get()] if s.exists() else [] for s in self.lists]
        number = self.number.get()[0] if self.number.exists() else 0
        out, held, again = settle(Held(*lists, number), now * 1000, self.gap, self.slack)
        for state, new in zip(self.lists, held):
            state.put(new) if new else state.clear()
        self.number.update((held.number,))
        if again is not None:
            self._look_at(again, now)
        names = ("event", "segment", "idx", "rule", "began", "ended", "hits", "knocks", "damage")
        for x in out:
            yield Row(match_id=key[0], team_a=key[1], team_b=key[2], **{n: x.get(n) for n in names})


def live_fights(rows: DataFrame, ts: str, gap_s: float, late: str, slack_s: float = 0.002) -> DataFrame:
    """Closed fights (event fight: segment, began, ended, hits, knocks, damage) and kills (event kill: idx, rule and segment, null if no rule fits) as a stream.

    rows: match_id, team_a, team_b, kind (hit, knock or kill), idx, victim_id, damage and the event time ts. Only hits and knocks span a fight. Over the same
    events that have passed the watermark the result is that of combat.segments and combat.attach_kills. The session needs the RocksDB state store.
    """
    known = rows.withWatermark(ts, late).select("match_id", F.col("team_a").cast("int"), F.col("team_b").cast("int"), "kind", F.col("idx").cast("bigint"), F.col("victim_id").cast("bigint"), F.col("damage").cast("double"), ts, F.unix_micros(ts).alias("t_us"))
    return known.groupBy("match_id", "team_a", "team_b").transformWithState(Fights(round(gap_s * 1e6), round(slack_s * 1e6)), OUT, "Append", "EventTime")


def with_kills(found: DataFrame) -> DataFrame:
    """A row for each closed fight with the kills attached to it so far."""
    keys = ["match_id", "team_a", "team_b", "segment"]
    kills = found.where("event = 'kill' and rule is not null").groupBy(*keys).agg(F.count("*").alias("kills"))
    fights = found.where("event = 'fight'").select(*keys, "began", "ended", "hits", "knocks", "damage")
    return fights.join(kills, keys, "left").withColumn("kills", F.coalesce("kills", F.lit(0)))
