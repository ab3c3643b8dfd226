"""Standard MIDI files: decoding to notes, tempos and meters, and writing.

Decoding runs on the bytes of a binary-file scan, a batch of files at a time. A file that cannot be read gives
one row with an error instead of failing the job. Null and empty contents are errors as well.
"""

from __future__ import annotations

import struct
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

EVENTS = "md5 string, kind string, tpb int, idx int, start int, dur int, chan int, pitch int, vel int, bpm double, num int, den int, error string"
_DATA_BYTES = {0x8: 2, 0x9: 2, 0xA: 2, 0xB: 2, 0xC: 1, 0xD: 1, 0xE: 2}


class _Bytes:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("file ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self) -> int:
        """A variable-length quantity: seven bits a byte, the last byte below 128."""
        n = 0
        for _ in range(4):
            b = self.byte()
            n = n << 7 | b & 0x7F
            if b < 0x80:
                return n
        raise ValueError("quantity too long")


def decode(data: bytes) -> tuple[int, list[tuple], list[tuple], list[tuple]]:
    """Ticks a beat; notes (start, dur, chan, pitch, vel) by start; tempos (tick, bpm); meters (tick, num, den).

    A note-on of velocity 0 ends a note; of equal notes that sound at once the first begun ends first; notes
    without an end last until their track ends."""
    f = _Bytes(data)
    if f.take(4) != b"MThd":
        raise ValueError("no MIDI header")
    size = struct.unpack(">I", f.take(4))[0]
    _, tracks, division = struct.unpack(">HHH", f.take(6))
    f.take(size - 6)
    if division & 0x8000 or not division:
        raise ValueError("no ticks a beat")
    notes, tempos, meters = [], [], []
    for _ in range(tracks):
        kind, size = f.take(4), struct.unpack(">I", f.take(4))[0]
        body = _Bytes(f.take(min(size, len(data) - f.at)))
        if kind != b"MTrk":
            continue
        tick, status, live = 0, 0, defaultdict(list)
        while body.at < len(body.data):
            tick += body.number()
            first = body.byte()
            if first == 0xFF:
                what, payload = body.byte(), body.take(body.number())
                if what == 0x51 and len(payload) == 3 and any(payload):
                    tempos.append((tick, 6e7 / int.from_bytes(payload, "big")))
                elif what == 0x58 and len(payload) >= 2:
                    meters.append((tick, payload[0], 1 << payload[1]))
                elif what == 0x2F:
                    break
                continue
            if first in (0xF0, 0xF7):
                body.take(body.number())
                continue
            if first >= 0x80:
                status = first
                values = body.take(_DATA_BYTES[status >> 4])
            elif status:
                values = bytes([first]) + body.take(_DATA_BYTES[status >> 4] - 1)
            else:
                raise ValueError("data before status")
            chan, key = status & 15, (status & 15, values[0])
            if status >> 4 == 9 and values[1]:
                live[key].append((tick, values[1]))
            elif status >> 4 in (8, 9) and live[key]:
                start, vel = live[key].pop(0)
                notes.append((start, tick - start, chan, values[0], vel))
        for (chan, pitch), begun in live.items():
            notes += [(start, tick - start, chan, pitch, vel) for start, vel in begun]
    return division, sorted(notes), sorted(tempos), sorted(meters)


def _quantity(n: int) -> bytes:
    out = [n & 0x7F]
    while n := n >> 7:
        out.append(n & 0x7F | 0x80)
    return bytes(reversed(out))


def encode(tpb: int, notes: list[tuple], tempos: list[tuple] = (), meters: list[tuple] = ()) -> bytes:
    """One-track file; at equal ticks settings come first, then note ends, then note starts."""
    events = [(t, 0, b"\xff\x51\x03" + round(6e7 / bpm).to_bytes(3, "big")) for t, bpm in tempos]
    events += [(t, 0, bytes([0xFF, 0x58, 4, num, den.bit_length() - 1, 24, 8])) for t, num, den in meters]
    for start, dur, chan, pitch, vel in notes:
        events += [(start, 2, bytes([0x90 | chan, pitch, vel])), (start + max(dur, 1), 1, bytes([0x80 | chan, pitch, 0]))]
    body, last = b"", 0
    for t, _, data in sorted(events):
        body += _quantity(t - last) + data
        last = t
    body += b"\x00\xff\x2f\x00"
    return b"MThd" + struct.pack(">IHHH", 6, 0, 1, tpb) + b"MTrk" + struct.pack(">I", len(body)) + body


def _rows(md5: str, content: bytes | None) -> list[tuple]:
    blank = (None,) * 13
    try:
        tpb, notes, tempos, meters = decode(content or b"")
    except (ValueError, KeyError, struct.error) as x:
        return [(md5, "error", *blank[2:12], str(x))]
    out = [(md5, "note", tpb, i, *n, None, None, None, None) for i, n in enumerate(notes)]
    out += [(md5, "tempo", tpb, i, t, *blank[5:9], bpm, None, None, None) for i, (t, bpm) in enumerate(tempos)]
    return out + [(md5, "meter", tpb, i, t, *blank[5:9], None, num, den, None) for i, (t, num, den) in enumerate(meters)]


def events_of(files: DataFrame) -> DataFrame:
    """Rows of kind note, tempo, meter or error for each (md5, content)."""
    names = [c.split()[0] for c in EVENTS.split(", ")]

    def run(batches):
        for b in batches:
            rows = [r for md5, content in zip(b["md5"], b["content"]) for r in _rows(md5, content)]
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return files.select("md5", "content").mapInPandas(run, EVENTS)


def scan(spark: SparkSession, folder: str, pattern: str = "*.mid") -> DataFrame:
    """md5, path, size, content of every file below a folder; files without bytes are left out by Spark's scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.md5("content").alias("md5"), "path", F.col("length").alias("size"), "content")
