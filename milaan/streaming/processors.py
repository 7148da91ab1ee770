"""Stateful processors: what a key remembers between batches."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import batched, chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Rows of one frame given back.
FRAME_ROWS = 10_000
# Uploads, and their bytes, among which a task looks for those of one page; and how many of them one row takes.
PACK_ROWS, PACK_BYTES, PACKED = 1 << 18, 64 << 20, 16


def goes(micros: int) -> int:
    """The timer, in milliseconds, for this time: it rings once the watermark has come that far."""
    return int(micros) // 1000 + 1


def wake_when_passed(handle: StatefulProcessorHandle, micros: int) -> None:
    """One timer per key: it rings when the watermark has passed this time."""
    for timer in handle.listTimers():
        handle.deleteTimer(timer)
    handle.registerTimer(goes(micros))


class FilledFields(StatefulProcessor):
    """Per conversation the number of filled fields; adds ``before``, the number when each turn starts.

    The turns of a conversation in one batch are put in order here, so they must fit a worker; a trigger bounds a batch.
    """

    def __init__(self, timed: bool):
        self.timed = timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "filled int, newest bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turns = pd.concat(list(rows)).sort_values("turn", kind="stable")
        filled, newest = self.state.get() if self.state.exists() else (0, None)
        before = []
        for moves in turns["moves"]:
            before.append(filled)
            filled = int(moves[filled])
        now = int(turns["at"].max())
        later = newest is None or now > newest
        self.state.update((filled, now if later else newest))
        if self.timed and later:
            wake_when_passed(self.handle, now)
        yield turns.assign(before=before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def packed_uploads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page, upload, at) as rows of up to ``PACKED`` uploads of one page: texts line by line, times end to end."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held, rows, size = [*held, batch], rows + batch.num_rows, size + batch.nbytes
        if rows >= PACK_ROWS or size >= PACK_BYTES:
            yield packed(held)
            held, rows, size = [], 0, 0
    if rows:
        yield packed(held)


def packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches).sort_by("page")
    page, at = table["page"].to_numpy(), table["at"].to_numpy()
    place = np.arange(len(page))
    begin = np.maximum.accumulate(np.where(np.append(True, page[1:] != page[:-1]), place, 0))
    starts = np.flatnonzero((place - begin) % PACKED == 0)
    ends = np.append(starts, len(page)).astype(np.int32)
    uploads = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(table["upload"].chunks)), "\n")
    times = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends * np.int32(at.itemsize)), pa.py_buffer(at.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(page[starts]), uploads, times], ["page", "uploads", "times"])


def unpacked(uploads: str, times: bytes) -> Iterator[tuple[str, int]]:
    return zip(uploads.split("\n"), array("q", bytes(times)), strict=True)


class FirstUpload(StatefulProcessor):
    """Per page of upload keys the time of each key's newest upload, until the watermark has passed it.

    A key costs far less than a call to the state store, so the keys of a page are one value there, packed as in the rows that come
    in: their texts, which hold no line breaks, line by line, and their times.  ``wake`` is the page's timer, never later than the
    first of its keys goes.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.page = handle.getValueState("newest", "uploads string, times binary, wake bigint")

    def held(self) -> tuple[dict[str, int], int | None]:
        if not self.page.exists():
            return {}, None
        uploads, times, wake = self.page.get()
        return dict(unpacked(uploads, times)), wake

    def hold(self, newest: dict[str, int], wake: int | None) -> None:
        least = goes(min(newest.values()))
        if wake is None or least < wake:
            if wake is not None:
                self.handle.deleteTimer(wake)
            self.handle.registerTimer(least)
            wake = least
        self.page.update(("\n".join(newest), array("q", newest.values()).tobytes(), wake))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        newest, wake = self.held()
        first, late, moved = {}, {}, False
        came = (unpacked(*some) for part in rows for some in zip(part["uploads"], part["times"], strict=True))
        for upload, at in chain.from_iterable(came):
            known = newest.get(upload)
            if at < watermark:
                if known is None:
                    late.setdefault(upload, array("q")).append(at)
                continue
            if known is None or at < first.get(upload, at):
                first[upload] = at
            if known is None or at > known:
                newest[upload], moved = at, True
        if moved:
            self.hold(newest, wake)
        kept = ((upload, at, "kept") for upload, at in first.items())
        # What is still not known has no upload on time in this batch either.
        behind = ((upload, at, "late") for upload, times in late.items() if upload not in newest for at in times)
        for some in batched(chain(kept, behind), FRAME_ROWS):
            yield pd.DataFrame(some, columns=["upload", "at", "outcome"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        newest = {upload: at for upload, at in self.held()[0].items() if goes(at) > watermark}
        if newest:
            self.hold(newest, None)
        else:
            self.page.clear()
        yield from ()

    def close(self) -> None:
        pass
