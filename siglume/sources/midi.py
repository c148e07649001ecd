"""Standard MIDI files (formats 0 and 1) as note, tempo and track tables, and back.

Files come through ``binaryFile``; each file's tracks are folded event by event in one task.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession

NOTES = "path string, track string, preset string, at long, dur long, pitch int, vel int"


class MidiError(ValueError):
    pass


def percussion(key: int) -> tuple[str, int]:
    """Preset and pitch of a General MIDI drum key."""
    if key in (35, 36):
        return "kick", 33
    if key in (42, 44, 46):
        return "noise_hat", 69
    if key == 49 or 51 <= key <= 59:
        return "noise_hat", 81
    return "snare", 50


def preset_of(program: int) -> str:
    """Nearest preset of a General MIDI program."""
    if program in (12, 16):
        return {12: "marimba", 16: "organ"}[program]
    for low, high, preset in ((32, 39, "square_bass"), (17, 23, "chord_pad"), (40, 55, "chord_pad"), (88, 103, "chord_pad"), (56, 87, "saw_lead"), (0, 31, "pluck"), (104, 119, "pluck")):
        if low <= program <= high:
            return preset
    return "sine"


#: Channel, program and drum key of each preset (fixed values); anything else is channel 0, program 120.
VOICES = {
    "square_bass": (0, 33, None), "chord_pad": (0, 48, None), "saw_lead": (0, 81, None), "pluck": (0, 24, None), "marimba": (0, 12, None),
    "organ": (0, 16, None), "kick": (9, 0, 36), "snare": (9, 0, 38), "noise_hat": (9, 0, 42),
}


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise MidiError("the file ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        value = 0
        for _ in range(4):
            b = self.take(1)[0]
            value = value << 7 | b & 0x7F
            if b < 0x80:
                return value
        raise MidiError("a length of more than four bytes")


def parse(raw: bytes) -> dict:
    """``ppq, tempos [(tick, microseconds)], signature, tracks [{name, channel, program, notes [(at, dur, key, vel)]}]``.

    A note-on of velocity 0 ends a note, a note-on over a sounding key ends that first, notes open at the end of
    the track end there, and no note is shorter than one tick.
    """
    f = _Reader(raw)
    if f.take(4) != b"MThd" or struct.unpack(">I", f.take(4))[0] < 6:
        raise MidiError("not a MIDI file")
    kind, count, division = struct.unpack(">HHH", f.take(6))
    if kind > 1:
        raise MidiError(f"format {kind} isn't supported")
    if not division or division & 0x8000:
        raise MidiError("the time base isn't ticks per quarter")
    tempos, signature, tracks = [], None, []
    for _ in range(count):
        if f.take(4) != b"MTrk":
            raise MidiError("no track where one is due")
        t = _Reader(f.take(struct.unpack(">I", f.take(4))[0]))
        now, status, name, programs = 0, 0, "", {}
        open_notes: dict[tuple[int, int], tuple[int, int]] = {}
        done: list[tuple[int, int, int, int, int]] = []

        def close(channel, key, now=None, open_notes=open_notes, done=done):
            if (held := open_notes.pop((channel, key), None)) is not None:
                done.append((held[0], channel, key, max(1, now - held[0]), held[1]))

        while t.at < len(t.data):
            now += t.number()
            b = t.take(1)[0]
            if b < 0x80:
                if not status:
                    raise MidiError("running status without a status")
                t.at -= 1
            else:
                status = b if b < 0xF0 else 0
            if b == 0xFF:
                meta, body = t.take(1)[0], t.take(t.number())
                if meta == 0x51 and len(body) == 3:
                    tempos.append((now, int.from_bytes(body, "big")))
                elif meta == 0x58 and len(body) >= 2 and signature is None:
                    signature = (body[0], 1 << body[1])
                elif meta == 0x03 and not name:
                    name = body.decode("utf-8", "replace")
                elif meta == 0x2F:
                    break
                continue
            if b in (0xF0, 0xF7):
                t.take(t.number())
                continue
            if b >= 0xF0:
                raise MidiError(f"status {b:#x} inside a track")
            kind_, channel = status >> 4, status & 15
            first = t.take(1)[0]
            second = t.take(1)[0] if kind_ not in (0xC, 0xD) else 0
            if kind_ == 0x9 and second:
                close(channel, first, now)
                open_notes[channel, first] = (now, second)
            elif kind_ in (0x8, 0x9):
                close(channel, first, now)
            elif kind_ == 0xC:
                programs.setdefault(channel, first)
        for channel, key in sorted(open_notes):
            close(channel, key, now)
        done.sort(key=lambda n: (n[0], n[1], n[2], n[3]))
        tracks += [
            {"name": name, "channel": c, "program": programs.get(c, 0), "notes": [(a, d, k, v) for a, ch, k, d, v in done if ch == c]}
            for c in sorted({n[1] for n in done})
        ]
    last = dict(tempos)  # of equal ticks the last wins
    return {"ppq": division, "tempos": sorted(last.items()), "signature": signature, "tracks": tracks}


def _length(n: int) -> bytes:
    out = [n & 0x7F]
    while n := n >> 7:
        out.append(n & 0x7F | 0x80)
    return bytes(reversed(out))


def write(ppq: int, tempos: list[tuple[int, float]], signature: tuple[int, int], tracks: list[dict]) -> bytes:
    """A format 1 file; at one tick note ends come before note starts. Tempos are beats per minute."""

    def chunk(events: list[tuple[int, int, bytes]]) -> bytes:
        body, now = b"", 0
        for tick, _, data in sorted(events, key=lambda e: e[:2]):
            body += _length(tick - now) + data
            now = tick
        body += b"\0\xff\x2f\0"
        return b"MTrk" + struct.pack(">I", len(body)) + body

    meta = [(0, 0, b"\xff\x58\x04" + bytes([signature[0], signature[1].bit_length() - 1, 24, 8]))]
    meta += [(tick, 1, b"\xff\x51\x03" + min(max(int(6e7 / bpm + 0.5), 1), 0xFFFFFF).to_bytes(3, "big")) for tick, bpm in tempos]
    chunks = [chunk(meta)]
    for t in tracks:
        channel, program, drum = VOICES.get(t["preset"], (0, 120, None))
        name = t["name"].encode()
        events = [(0, 0, b"\xff\x03" + _length(len(name)) + name), (0, 1, bytes([0xC0 | channel, program]))]
        for at, dur, pitch, vel in t["notes"]:
            key = pitch if drum is None else drum
            events += [(at, 3, bytes([0x90 | channel, key, vel])), (at + dur, 2, bytes([0x80 | channel, key, 0]))]
        chunks.append(chunk(events))
    return b"MThd" + struct.pack(">IHHH", 6, 1, len(chunks), ppq) + b"".join(chunks)


def note_rows(path: str, raw: bytes) -> list[tuple]:
    out, used = [], set()
    for t in parse(raw)["tracks"]:
        voices = {}
        for at, dur, key, vel in t["notes"]:
            preset, pitch = percussion(key) if t["channel"] == 9 else (preset_of(t["program"]), key)
            voices.setdefault(preset, []).append((at, dur, pitch, vel))
        for preset, notes in sorted(voices.items()):
            base = name = (t["name"] or preset) if len(voices) == 1 else preset
            k = 2
            while name in used:
                name, k = f"{base}_{k}", k + 1
            used.add(name)
            out += [(path, name, preset, *n) for n in notes]
    return out


def read_midi(spark: SparkSession, path: str) -> DataFrame:
    """Notes of every ``.mid`` file under ``path``."""

    def kernel(frames):
        import pandas as pd

        for f in frames:
            for name, raw in zip(f["path"], f["content"]):
                yield pd.DataFrame(note_rows(name, bytes(raw)), columns=["path", "track", "preset", "at", "dur", "pitch", "vel"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.mid").load(path).select("path", "content").mapInPandas(kernel, NOTES)
