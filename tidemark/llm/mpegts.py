"""Media columns as MPEG transport streams (ISO/IEC 13818-1).

write_streams() stores a payload as one elementary stream: PAT and PMT sections with CRC-32/MPEG-2, PES packets
with presentation times, a program clock and random-access flags in adaptation fields, all in 188-byte packets with
continuity counters. read_streams() reads any such bytes back: it parses the program tables, checks the counters
of every PID, reassembles the elementary packets and returns the payload with a table of timestamps and
random-access points. Header fields of all packets of a stream are parsed at once with numpy.

Defined results: a null text counts as empty; an empty text is stored as 192 spaces; equal texts give equal bytes
and features; bytes that aren't whole packets, lost sync bytes, wrong section checksums, counter jumps and
truncated elementary packets are counted in the features and never raise. An empty table gives no rows. Extra input columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, keyed_text

# Fixed values of the transport-stream format.
PACKET, SYNC, PAT_PID, STUFFING = 188, 0x47, 0x0000, 0xFF
CLOCK_HZ = 90_000

#: Fixed choices of this writer.
PMT_PID, DATA_PID, PROGRAM, STREAM_TYPE, STREAM_ID = 0x1000, 0x0100, 1, 0x06, 0xBD
UNIT, PES_BYTES, SECOND_UNITS, RANDOM_ACCESS_EVERY = 192, 64 * 192, 64, 4


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        c = byte << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        table.append(c & 0xFFFFFFFF)
    return table


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8) & 0xFFFFFFFF ^ _CRC[c >> 24 ^ b]
    return c


def payload_of(text: str) -> tuple[bytes, int]:
    """UTF-8 padded with spaces to a positive multiple of 192, and its length before."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b" " * ((-len(raw)) % UNIT if raw else UNIT), len(raw)


def _section(table_id: int, number: int, body: bytes) -> bytes:
    size = len(body) + 9
    head = bytes([table_id, 0xB0 | size >> 8, size & 0xFF, number >> 8, number & 0xFF, 0xC1, 0, 0]) + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return (head + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(PAT_PID, _section(0x00, 1, bytes([0, PROGRAM, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF]))) + _table_packet(
    PMT_PID, _section(0x02, PROGRAM, bytes([0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0, STREAM_TYPE, 0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0]))
)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE])


def mux(payload: bytes) -> bytes:
    """The payload as a transport stream: one PES packet for each 12,288 bytes, every fourth a random-access point."""
    out, counter = [_TABLES], 0
    for n, at in enumerate(range(0, len(payload), PES_BYTES)):
        chunk = payload[at : at + PES_BYTES]
        pts = (at // UNIT * CLOCK_HZ // SECOND_UNITS) & 0x1FFFFFFFF
        size = len(chunk) + 8
        pes = b"\0\0\1" + bytes([STREAM_ID, size >> 8, size & 0xFF, 0x84, 0x80, 5]) + _stamp(pts) + chunk
        # The first packet has an adaptation field with the clock; of the rest only the last is stuffed.
        access = n % RANDOM_ACCESS_EVERY == 0
        field = bytes([0x50 if access else 0x10]) + (pts << 15 | 0x7E00).to_bytes(6, "big")
        room = PACKET - 5 - len(field)
        field = bytes([len(field) + max(0, room - len(pes))]) + field + b"\xff" * max(0, room - len(pes))
        out.append(bytes([SYNC, 0x40 | DATA_PID >> 8, DATA_PID & 0xFF, 0x30 | counter]) + field + pes[:room])
        rest = pes[room:]
        counter = (counter + 1) & 15
        whole, left = divmod(len(rest), PACKET - 4)
        if whole:
            body = np.empty((whole, PACKET), np.uint8)
            body[:, 0], body[:, 1], body[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
            body[:, 3] = 0x10 | (np.arange(counter, counter + whole) & 15)
            body[:, 4:] = np.frombuffer(rest, np.uint8, whole * (PACKET - 4)).reshape(whole, PACKET - 4)
            out.append(body.tobytes())
            counter = (counter + whole) & 15
        if left:
            stuffing = PACKET - 5 - left
            field = bytes([stuffing]) + (b"\0" + b"\xff" * (stuffing - 1) if stuffing else b"")
            out.append(bytes([SYNC, DATA_PID >> 8, DATA_PID & 0xFF, 0x30 | counter]) + field + rest[-left:])
            counter = (counter + 1) & 15
    return b"".join(out)


def _tables(packets: np.ndarray, rows: np.ndarray, start: np.ndarray, offset: np.ndarray, table_id: int) -> tuple[list[bytes], int]:
    """The bodies of sections of a table in the packets of a PID, and how many had a wrong checksum; a section may go over any number of packets, a packet may hold several."""
    bodies, bad = [], 0
    held: bytearray | None = None  # what is there of the sections since the last pointer

    def whole(final: bool) -> int:
        """Takes complete sections from held; gives how many were wrong."""
        nonlocal held
        wrong = 0
        while held and held[0] != 0xFF and len(held) >= 3:
            size = 3 + ((held[1] & 0x0F) << 8 | held[2])
            if len(held) < size:
                wrong += final
                break
            section = bytes(held[:size])
            del held[:size]
            if section[0] == table_id:
                if size < 12 or crc32_mpeg(section):
                    wrong += 1
                else:
                    bodies.append(section[8 : size - 4])
        if held and held[0] == 0xFF:
            held = None
        return wrong

    for i in rows:
        data = packets[i, offset[i] :].tobytes()
        if start[i]:
            before, data = data[1 : 1 + data[0]], data[1 + data[0] :]
            if held is not None:
                held += before
                bad += whole(True)
            held = bytearray(data)
        elif held is not None:
            held += data
        bad += whole(False)
    return bodies, bad + (whole(True) if held else 0)


def _repeated(packets: np.ndarray, rows: np.ndarray, counter: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Which of a PID's packets equal the one before, which the format allows once: same counter and bytes, but for the program clock."""
    again = np.zeros(rows.size, bool)
    for k in np.flatnonzero(np.diff(counter[rows]) == 0) + 1:
        one, two = packets[rows[k - 1]].copy(), packets[rows[k]].copy()
        if flags[rows[k - 1]] & flags[rows[k]] & 0x10:
            one[6:12] = two[6:12] = 0
        again[k] = not again[k - 1] and bool((one == two).all())
    return again


def demux(media: bytes) -> dict:
    """Program tables, counter checks, elementary packets, timestamps and random-access points of a transport stream."""
    count = len(media) // PACKET
    packets = np.frombuffer(media, np.uint8, count * PACKET).reshape(count, PACKET)
    synced = packets[:, 0] == SYNC
    lost = int(count - synced.sum()) + (len(media) % PACKET > 0)
    packets = packets if synced.all() else packets[synced]
    head = packets[:, 1:6].astype(np.int32)
    pid = (head[:, 0] & 0x1F) << 8 | head[:, 1]
    start, counter = (head[:, 0] & 0x40) > 0, head[:, 2] & 15
    has_field, has_payload = (head[:, 2] & 0x20) > 0, (head[:, 2] & 0x10) > 0
    field = np.where(has_field, head[:, 3], -1)
    flags = np.where(field > 0, head[:, 4], 0)
    offset = np.where(has_payload, np.where(has_field, 5 + field, 4), PACKET)

    def packets_of(want: int) -> np.ndarray:
        rows = np.flatnonzero((pid == want) & has_payload & (offset < PACKET))
        return rows[~_repeated(packets, rows, counter, flags)]

    programs, bad_pat = _tables(packets, packets_of(PAT_PID), start, offset, 0x00)
    maps = {b[i + 2] << 8 & 0x1F00 | b[i + 3]: b[i] << 8 | b[i + 1] for b in programs for i in range(0, len(b) - 3, 4) if b[i] or b[i + 1]}
    streams: dict[int, int] = {}
    bad_pmt, clocks = 0, set()
    for map_pid in maps:
        bodies, bad = _tables(packets, packets_of(map_pid), start, offset, 0x02)
        bad_pmt += bad
        for b in bodies:
            clocks.add((b[0] & 0x1F) << 8 | b[1])
            at = 4 + ((b[2] & 0x0F) << 8 | b[3])
            while at + 5 <= len(b):
                streams[(b[at + 1] & 0x1F) << 8 | b[at + 2]] = b[at]
                at += 5 + ((b[at + 3] & 0x0F) << 8 | b[at + 4])

    # The program clock: 33 bits of 90 kHz and 9 bits of 27 MHz, as ticks of 27 MHz.
    timed = packets[np.isin(pid, sorted(clocks)) & (field >= 7) & ((flags & 0x10) > 0), 6:12].astype(np.int64)
    ticks = ((timed[:, 0] << 25 | timed[:, 1] << 17 | timed[:, 2] << 9 | timed[:, 3] << 1 | timed[:, 4] >> 7) * 300 + ((timed[:, 4] & 1) << 8 | timed[:, 5])).tolist()

    gaps, repeats, truncated, payload, points = 0, 0, 0, [], []
    for stream in sorted(streams):
        rows = np.flatnonzero((pid == stream) & has_payload & (offset <= PACKET))
        again = _repeated(packets, rows, counter, flags)
        repeats, rows = repeats + int(again.sum()), rows[~again]
        if not rows.size:
            continue
        steps = (np.diff(counter[rows]) & 15) != 1
        gaps += int((steps & ((flags[rows[1:]] & 0x80) == 0)).sum())
        begins = np.flatnonzero(start[rows])
        for n, b in enumerate(begins):
            own = rows[b : begins[n + 1] if n + 1 < begins.size else rows.size]
            plain = offset[own] == 4
            if own.size > 2 and plain[1:-1].all():
                ends = (packets[own[-1], offset[own[-1]] :].tobytes(),)
                unit = b"".join((packets[own[0], offset[own[0]] :].tobytes(), packets[own[1:-1], 4:].tobytes(), *ends))
            else:
                unit = b"".join(packets[i, offset[i] :].tobytes() for i in own)
            if len(unit) < 9 or unit[:3] != b"\0\0\1":
                truncated += 1
                continue
            size, skip = unit[4] << 8 | unit[5], 9 + unit[8]
            if size and len(unit) < 6 + size:
                truncated += 1
            pts = None
            if unit[7] & 0x80 and len(unit) >= 14:
                pts = (unit[9] >> 1 & 7) << 30 | unit[10] << 22 | unit[11] >> 1 << 15 | unit[12] << 7 | unit[13] >> 1
            points.append({"pid": int(stream), "packet": int(own[0]), "offset": sum(map(len, payload)) if not points else points[-1]["offset"] + points[-1]["size"], "size": len(unit[skip : 6 + size if size else None]), "pts": pts, "random_access": bool(flags[own[0]] & 0x40)})
            payload.append(unit[skip : 6 + size if size else None])
    stamps = [p["pts"] for p in points if p["pts"] is not None]
    return {
        "payload": b"".join(payload), "packets": count, "lost_sync": lost, "bad_sections": bad_pat + bad_pmt, "programs": len(maps), "streams": [{"pid": p, "type": t} for p, t in sorted(streams.items())],
        "continuity_errors": gaps, "truncated": truncated, "units": points, "first_pts": min(stamps, default=None), "last_pts": max(stamps, default=None), "backward_pts": sum(b < a for a, b in zip(stamps, stamps[1:])),
        "repeated_packets": repeats, "first_clock": ticks[0] if ticks else None, "last_clock": ticks[-1] if ticks else None, "backward_clock": sum(b < a for a, b in zip(ticks, ticks[1:])),
    }


READ_SCHEMA = (
    "doc_id long, n_bytes long, payload binary, packets long, lost_sync long, bad_sections long, programs long, streams array<struct<pid: int, type: int>>, continuity_errors long, truncated long, "
    "units array<struct<pid: int, packet: long, offset: long, size: long, pts: long, random_access: boolean>>, first_pts long, last_pts long, backward_pts long, repeated_packets long, first_clock long, last_clock long, backward_clock long, media binary"
)


def write_streams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every text stored as a transport stream; one pass, no shuffle."""

    def work(c: dict[str, list]) -> dict[str, list]:
        made = [payload_of(t) for t in c["text"]]
        return {"doc_id": c["doc_id"], "n_bytes": [n for _, n in made], "media": [mux(p) for p, _ in made]}

    return arrow_rows(keyed_text(docs, id_col, text_col), work, "doc_id long, n_bytes long, media binary")


def read_streams(media: DataFrame) -> DataFrame:
    """READ_SCHEMA of every row of (doc_id, n_bytes, media): the payload, checks and the table of timestamps."""

    def work(c: dict[str, list]) -> dict[str, list]:
        made = [demux(m or b"") for m in c["media"]]
        out = {k: [m[k] for m in made] for k in ("payload", "packets", "lost_sync", "bad_sections", "programs", "streams", "continuity_errors", "truncated", "units", "first_pts", "last_pts", "backward_pts", "repeated_packets", "first_clock", "last_clock", "backward_clock")}
        return out | {k: c[k] for k in ("doc_id", "n_bytes", "media")}

    return arrow_rows(media.select("doc_id", "n_bytes", "media"), work, READ_SCHEMA, text="media")


def stream_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: digests of what was read back and of the stored form, and the features as text."""
    r = read_streams(write_streams(docs))
    access = F.transform(F.filter("units", lambda u: u["random_access"]), lambda u: F.concat_ws("@", u["pts"].cast("string"), u["packet"].cast("string")))
    feature = F.concat_ws(
        ";",
        *(F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in ("packets", "lost_sync", "bad_sections", "programs", "continuity_errors", "truncated", "backward_pts", "repeated_packets", "backward_clock")),
        F.concat(F.lit("streams="), F.array_join(F.transform("streams", lambda s: F.concat_ws(":", s["pid"].cast("string"), s["type"].cast("string"))), ",")),
        F.concat(F.lit("units="), F.size("units").cast("string")),
        F.concat(F.lit("pts="), F.concat_ws("-", F.col("first_pts").cast("string"), F.col("last_pts").cast("string"))),
        F.concat(F.lit("clock="), F.concat_ws("-", F.col("first_clock").cast("string"), F.col("last_clock").cast("string"))),
        F.concat(F.lit("random_access="), F.array_join(access, ",")),
    )
    return r.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, greatest(octet_length(payload) - 15, 1), 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
