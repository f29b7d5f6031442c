"""Conversations as state: what each turn asks for, given the turns before it. One fold serves a table and a stream.

A turn is a command on the last answer (more, source, related), a reset, a follow-up that takes over the topic and the scope, or
a question of its own, which takes over neither. A stream keeps one row of state for each conversation, in the store
that Spark checkpoints; a conversation that stays idle is closed by a timer and forgotten. A turn that is not after the last one
seen is a repeat and gives nothing, so files that are read again do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What commands and follow-ups begin with.
COMMANDS = {"reset": "reset|start over|forget", "more": "more|tell me more|go on|continue", "source": "source|cite|where is that", "related": "related|see also"}
FOLLOWS = "and|what about|how about|it|that|this"
SCOPE = r"\b(src[0-9]+)\b"
#: A turn with fewer words can't stand alone.
LEAST_WORDS = 3
OUT = "conv_id long, turn long, kind string, query string, scope string"
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

_COMMAND = {kind: re.compile(rf"^(?:{words})\b", re.I) for kind, words in COMMANDS.items()}
_FOLLOWS = re.compile(rf"^(?:{FOLLOWS})\b", re.I)


@dataclass
class Talk:
    """What is remembered of a conversation."""

    last: int = -(1 << 62)
    focus: str = ""
    scope: str = ""
    answered: bool = False

    def hear(self, turn: int, text: str | None) -> tuple[str, str, str] | None:
        """(kind, query, scope) of the user's next turn; None for a repeat."""
        if turn <= self.last:
            return None
        self.last, text = turn, (text or "").strip()
        for kind, pattern in _COMMAND.items():
            if pattern.search(text):
                if kind == "reset":
                    self.focus, self.scope, self.answered = "", "", False
                    return kind, "", ""
                return (kind, self.focus, self.scope) if self.answered else ("no_context", "", "")
        named = re.search(SCOPE, text)
        if self.focus and (_FOLLOWS.search(text) or len(text.split()) < LEAST_WORDS):
            self.scope, self.answered = named[1] if named else self.scope, True
            return "follow_up", f"{self.focus} {text}", self.scope
        self.focus, self.scope, self.answered = text, named[1] if named else "", True
        return "answer", text, self.scope


def heard(conv: int, talk: Talk, turns: Iterable[tuple[int, str | None]]) -> Iterator[tuple]:
    for turn, text in sorted(turns, key=lambda t: (t[0], t[1] or "")):
        if (said := talk.hear(turn, text)) is not None:
            yield (conv, turn, *said)


def replies(turns: DataFrame) -> DataFrame:
    """OUT of the user's turns of a table (conv_id, turn, role, text); turns without a number are left out. A conversation is one
    group, read in order."""

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(heard(key[0], Talk(), zip(f["turn"].tolist(), f["text"].tolist(), strict=True)), columns=["conv_id", "turn", "kind", "query", "scope"])

    return turns.where("role = 'user' AND turn IS NOT NULL").select("conv_id", "turn", "text").groupBy("conv_id").applyInPandas(run, OUT)


class Processor(StatefulProcessor):
    """A conversation's state, from micro-batch to micro-batch; idle_ms after its last event it is closed."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("talk", "last long, focus string, scope string, answered boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = list(rows)
        talk = Talk(*self.state.get()) if self.state.exists() else Talk()
        out = list(heard(key[0], talk, [(r.turn, r.text) for r in rows]))
        self.state.update(astuple(talk))
        latest = max(int(r.at.timestamp() * 1000) for r in rows) + self.idle_ms
        for timer in list(self.handle.listTimers()):
            latest = max(latest, timer)
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(latest)
        yield from (Row(conv_id=c, turn=t, kind=k, query=q, scope=s) for c, t, k, q, s in out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last = self.state.get()[0] if self.state.exists() else None
        self.state.clear()
        yield Row(conv_id=key[0], turn=last, kind="closed", query="", scope="")

    def close(self) -> None:
        pass


def stream(turns: DataFrame, idle: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """OUT of a stream of turns (conv_id, turn, role, text, at), and a row ``closed`` for each conversation that is idle."""
    turns.sparkSession.conf.set(*STORE)
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    own = turns.where("role = 'user' AND turn IS NOT NULL").select("conv_id", "turn", "text", "at").withWatermark("at", late)
    return own.groupBy("conv_id").transformWithState(statefulProcessor=Processor(ms), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
