"""Entries of live recordings: the transcript parser, line by line, with Structured Streaming state.

State per recording: what the next line needs of the lines before, the open
entry, and the open merged entry. An entry is given out when it can't change any
more: when the next one begins that isn't merged with it, or when the recording
ends (a row whose text is null).
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import TIME, WS
from ..operators.transcript import MERGE_SECONDS

ENTRIES = "video_id string, entry_no int, speaker string, timestamp string, timestamp_seconds int, text string"
_SPACE = re.sub(r"\\x\{([0-9A-F]{4})\}", r"\\u\1", WS)
_ENDS, _SPLIT, _TIME = re.compile(rf"^[{_SPACE}]+|[{_SPACE}]+\Z"), re.compile(f"[{_SPACE}]+"), re.compile(TIME)
_POINTS, _MARK = re.compile(r"^[.,;:-]+|[.,;:-]+$"), re.compile(rf"^\[.*?\][{_SPACE}]*")


def _strip(text: str) -> str:
    return _ENDS.sub("", text)


def _initials(line: str) -> bool:
    kinds = [unicodedata.category(c) for c in line]
    return 2 <= len(line) <= 3 and set(kinds) <= {"Lu", "Lo", "Lm"} and "Lu" in kinds


def _speaker(line: str) -> bool:
    words = len(_SPLIT.split(line)) if line else 0
    sentence = line[-1:] in (".", "?", "!") and words > 1 and line != ""
    named = unicodedata.category(line[0]) == "Lu" or "@" in line if line else False
    return 2 <= len(line) <= 60 and not _TIME.search(line) and words <= 6 and not sentence and not _initials(line) and named


def _clean(name: str) -> str:
    return _strip(_MARK.sub("", _POINTS.sub("", _strip(name))))


def _seconds(time: str) -> int:
    h, m, s = map(int, time.split(":"))
    return h * 3600 + m * 60 + s


class EntryParser:
    """Takes lines; gives (speaker, timestamp, seconds, text) of entries, merged or not, as they close."""

    def __init__(self, merge: bool = True, seconds: int = MERGE_SECONDS, kept: dict | None = None):
        self.merge, self.seconds = merge, seconds
        self.kept = kept or {"last": [], "speaker": "", "time": None, "pieces": [], "open": None, "count": 0}

    def _close(self) -> list[tuple]:
        """The current entry ends: it joins the open merged one, or takes its place."""
        k = self.kept
        pieces, k["pieces"] = k["pieces"], []
        if not pieces:
            return []
        new = [k["speaker"], k["time"], _seconds(k["time"]), _strip(" ".join(pieces))]
        old = k["open"]
        if self.merge and old and old[0] == new[0] and abs(new[2] - old[2]) < self.seconds:
            old[3] = f"{old[3]} {new[3]}"
            return []
        k["open"] = new
        return [tuple(old)] if old else []

    def take(self, line: str) -> list[tuple]:
        k, line = self.kept, _strip(line)
        mark, name, at = _initials(line), _speaker(line), _TIME.search(line)
        out = []
        if line and at and not mark:
            out = self._close()
            head, tail = _strip(line[: at.start()]), _strip(line[at.end() :])
            said = (head if _speaker(head) else None) if head else self._above()
            k["time"] = at[0]
            k["speaker"] = k["speaker"] if said is None else _clean(said)
            k["pieces"] = [tail] if tail else []
        elif line and not mark and k["time"] is not None:
            if name and len(line) < 60:
                out = self._close()
                k["speaker"] = _clean(line)
            else:
                k["pieces"].append(line)
        k["last"] = [*k["last"], [line, mark, name]][-2:]
        return out

    def _above(self) -> str | None:
        """The name on the line above, or above a blank line or initials."""
        before = self.kept["last"][::-1]
        if before and (before[0][0] == "" or before[0][1]):
            before = before[1:]
        return before[0][0] if before and before[0][2] else None

    def end(self) -> list[tuple]:
        out = self._close()
        last, self.kept["open"] = self.kept["open"], None
        return [*out, *([tuple(last)] if last else [])]


def _step(merge: bool, seconds: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parser = EntryParser(merge, seconds, json.loads(state.get[0]) if state.exists else None)
        out: list[tuple] = []
        for r in pd.concat(list(batches)).sort_values("seq", kind="stable").itertuples():
            found = parser.end() if r.text is None else [e for line in r.text.split("\n") for e in parser.take(line)]
            for entry in found:
                parser.kept["count"] += 1
                out.append((key[0], parser.kept["count"], *entry))
        state.update((json.dumps(parser.kept),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ENTRIES.split(", ")])

    return step


def entries_stream(texts: DataFrame, merge: bool = True, seconds: int = MERGE_SECONDS) -> DataFrame:
    """ENTRIES of a stream of texts (video_id, seq, text), appended as they close; seq orders a recording's texts, a null text ends it."""
    rows = texts.select(F.col("video_id").cast("string").alias("video_id"), F.col("seq").cast("long").alias("seq"), F.col("text").cast("string").alias("text"))
    return rows.groupBy("video_id").applyInPandasWithState(_step(merge, seconds), ENTRIES, "kept string", "append", GroupStateTimeout.NoTimeout)
