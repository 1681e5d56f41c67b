"""MPEG transport streams as a column: writing payloads into one, and reading streams back.

Reading does not depend on how a stream was written: the program association table names the
programs, their maps name the elementary streams, packets of those are put together to PES
packets, and continuity counters, adaptation fields and timestamps are read per packet.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import arrow_schema, text_bytes

# Fixed values of ISO/IEC 13818-1.
PACKET, SYNC, NULL_PID, PAT_PID = 188, 0x47, 0x1FFF, 0
PAT_TABLE, PMT_TABLE, PRIVATE_STREAM_1, PRIVATE_DATA = 0x00, 0x02, 0xBD, 0x06
#: Stream ids whose packets have no header after the length: program map, padding, private 2, ECM, EMM, DSM-CC, H.222.1 type E, directory.
BARE_STREAMS = (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF)
#: Bytes of a table section before and after its entries: 8 and the CRC; a program map has 4 more.
PAT_LEAST, PMT_LEAST = 12, 16
CLOCK = 90_000

PMT_PID, ES_PID, PROGRAM = 0x1000, 0x100, 1
#: Payload bytes of one access unit, its duration in 90 kHz ticks (1/25 s), and units from one random-access point to the next.
UNIT, UNIT_TICKS, GROUP = 1920, 3600, 12
BLOCK = 192


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """The CRC-32 of program tables: not reflected, no final inversion; 0 over a whole section with its CRC."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255]) + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + section_crc(head).to_bytes(4, "big")


_PAT = _section(PAT_TABLE, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_PMT = _section(PMT_TABLE, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10 | counter & 15, 0]) + section).ljust(PACKET, b"\xff")


def _stamp(marker: int, t: int) -> bytes:
    t &= (1 << 33) - 1
    return bytes([marker << 4 | t >> 29 & 0x0E | 1, t >> 22 & 255, t >> 14 & 0xFE | 1, t >> 7 & 255, t << 1 & 0xFE | 1])


def write_stream(payload: bytes, first_pts: int = CLOCK) -> bytes:
    """A transport stream with one program and one private elementary stream that holds payload.

    Access units of 1,920 bytes are one PES packet each, with a PTS; every twelfth is a
    random-access point, led by the program tables and carrying the clock reference.
    """
    out, counter, tables = [], 0, 0
    for n, at in enumerate(range(0, len(payload), UNIT)):
        pts, access = first_pts + n * UNIT_TICKS, n % GROUP == 0
        if access:
            out += [_table_packet(PAT_PID, _PAT, tables), _table_packet(PMT_PID, _PMT, tables)]
            tables += 1
        unit = payload[at : at + UNIT]
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, pts) + unit
        place = 0
        while place < len(pes):
            field = b""
            if not place and access:
                base = pts - UNIT_TICKS & (1 << 33) - 1
                field = b"\x50" + (base << 15 | 0x3F << 9).to_bytes(6, "big")
            room = PACKET - 4 - (len(field) + 1 if field else 0)
            part = pes[place : place + room]
            if len(part) < room:  # stuffing goes to the adaptation field
                need = PACKET - 4 - len(part)
                field = ((field or (b"\x00" if need > 1 else b"")).ljust(need - 1, b"\xff")) if need else b""
                head = bytes([len(field)]) + field
            else:
                head = bytes([len(field)]) + field if field else b""
            out.append(bytes([SYNC, (0x40 if not place else 0) | ES_PID >> 8, ES_PID & 255, (0x30 if head else 0x10) | counter]) + head + part)
            counter = counter + 1 & 15
            place += len(part)
    return b"".join(out)


def _packets(stream: bytes) -> tuple[np.ndarray, int]:
    """The packets as rows, and how many bytes lay between them; finds sync anew where it is lost."""
    whole = np.frombuffer(stream, np.uint8)
    n = len(whole) // PACKET
    rows = whole[: n * PACKET].reshape(n, PACKET)
    if len(whole) == n * PACKET and (rows[:, 0] == SYNC).all():
        return rows, 0
    starts, at = [], 0
    while (at := stream.find(b"G", at)) >= 0 and at + PACKET <= len(stream):
        if at + PACKET == len(stream) or stream[at + PACKET] == SYNC:
            starts.append(at)
            at += PACKET
        else:
            at += 1
    index = np.array(starts, np.int64)[:, None] + np.arange(PACKET)
    return whole[index], len(stream) - len(starts) * PACKET


def _sections(rows: np.ndarray, begin: np.ndarray, unit: np.ndarray) -> list[bytes]:
    """Whole sections with a right CRC from the packets of one pid."""
    found, held = [], b""
    for row, b, u in zip(rows, begin.tolist(), unit.tolist(), strict=True):
        data = row[b:].tobytes()
        if u and data:
            pointer = data[0]
            held = data[1 + pointer :] if not held else held + data[1 : 1 + pointer] + data[1 + pointer :]
        elif held:
            held += data
        while len(held) >= 3 and held[0] != 0xFF:
            size = 3 + ((held[1] & 15) << 8 | held[2])
            if len(held) < size:
                break
            if section_crc(held[:size]) == 0:
                found.append(held[:size])
            held = held[size:]
        if held[:1] == b"\xff":
            held = b""
    return found


def _time(b: bytes) -> int:
    return (b[0] & 0x0E) << 29 | b[1] << 22 | (b[2] & 0xFE) << 14 | b[3] << 7 | b[4] >> 1


def read_stream(stream: bytes) -> dict:
    """What a transport stream holds; a stream without packets or tables gives empty lists.

    programs: (program, map pid); streams: (pid, stream type); units: (pid, pts, dts, random access,
    discontinuity, place in the elementary payload, length) by pid and order of arrival; payloads:
    elementary bytes by pid. Counter errors leave the data in place and are counted; packets of an elementary
    stream without a right header are malformed, counted, and have no part in the payload. Any bytes can be read.
    """
    rows, skipped = _packets(stream)
    rows = rows[(rows[:, 1] & 0x80) == 0] if len(rows) else rows
    pids = (rows[:, 1].astype(np.int64) & 0x1F) << 8 | rows[:, 2]
    control, counter, unit = rows[:, 3] >> 4 & 3, rows[:, 3] & 15, (rows[:, 1] & 0x40) > 0
    has_field, has_data = (control & 2) > 0, (control & 1) > 0
    length = np.where(has_field, rows[:, 4].astype(np.int64), -1)
    flags = np.where(length > 0, rows[:, 5], 0)
    begin = np.where(has_data, np.minimum(4 + length + 1, PACKET), PACKET)
    out = {"packets": len(rows), "skipped": skipped, "programs": [], "streams": [], "units": [], "payloads": {}, "malformed": 0, "errors": 0, "repeats": 0, "pcr": []}

    errors = repeats = 0
    repeated = np.zeros(len(rows), bool)
    for pid in np.unique(pids[pids != NULL_PID]).tolist():
        at = np.flatnonzero((pids == pid) & has_data)
        if len(at) < 2:
            continue
        step = (counter[at[1:]].astype(np.int64) - counter[at[:-1]]) & 15
        jump = (flags[at[1:]] & 0x80) > 0
        same = (step == 0) & ~jump & (rows[at[1:], 6:] == rows[at[:-1], 6:]).all(axis=1)
        repeated[at[1:][same]] = True
        repeats += int(same.sum())
        errors += int(((step != 1) & ~jump & ~same).sum())
    out["errors"], out["repeats"] = errors, repeats

    keep = has_data & ~repeated
    for sec in _sections(rows[keep & (pids == PAT_PID)], begin[keep & (pids == PAT_PID)], unit[keep & (pids == PAT_PID)]):
        if len(sec) >= PAT_LEAST and sec[0] == PAT_TABLE and sec[5] & 1:
            for k in range(8, len(sec) - 7, 4):
                number, pid = int.from_bytes(sec[k : k + 2], "big"), int.from_bytes(sec[k + 2 : k + 4], "big") & 0x1FFF
                if number and (number, pid) not in out["programs"]:
                    out["programs"].append((number, pid))
    for _, map_pid in out["programs"]:
        own = keep & (pids == map_pid)
        for sec in _sections(rows[own], begin[own], unit[own]):
            if len(sec) >= PMT_LEAST and sec[0] == PMT_TABLE and sec[5] & 1:
                k = 12 + ((sec[10] & 15) << 8 | sec[11])
                while k + 5 <= len(sec) - 4:
                    entry = (int.from_bytes(sec[k + 1 : k + 3], "big") & 0x1FFF, sec[k])
                    if entry not in out["streams"]:
                        out["streams"].append(entry)
                    k += 5 + ((sec[k + 3] & 15) << 8 | sec[k + 4])

    for i in np.flatnonzero(((flags & 0x10) > 0) & (length >= 7)).tolist():
        out["pcr"].append(int.from_bytes(rows[i, 6:12].tobytes(), "big") >> 15)
    for pid, _ in out["streams"]:
        own = np.flatnonzero(keep & (pids == pid))
        marks = np.flatnonzero(unit[own])
        payload, place = [], 0
        for a, b in zip(marks, np.append(marks[1:], len(own))[: len(marks)], strict=True):
            part, start = own[a:b], begin[own[a:b]]
            inside = np.arange(PACKET)[None, :] >= start[:, None]
            pes = rows[part][inside].tobytes()
            size = int.from_bytes(pes[4:6], "big")
            pes = pes[: 6 + size] if size else pes
            bare = len(pes) >= 6 and pes[3] in BARE_STREAMS
            if pes[:3] != b"\x00\x00\x01" or not bare and (len(pes) < 9 or pes[6] >> 6 != 2):
                out["malformed"] += 1
                continue
            stamps, extra = (0, 0) if bare else (pes[7] >> 6, pes[8])
            # a stamp that is flagged but doesn't fit its header isn't one
            pts = _time(pes[9:14]) if stamps & 2 and extra >= 5 and len(pes) >= 14 else None
            dts = _time(pes[14:19]) if stamps == 3 and extra >= 10 and len(pes) >= 19 else pts
            data = pes[6:] if bare else pes[9 + extra :]
            out["units"].append((pid, pts, dts, bool(flags[part[0]] & 0x40), bool(flags[part[0]] & 0x80), place, len(data)))
            payload.append(data)
            place += len(data)
        out["payloads"][pid] = b"".join(payload)
    return out


def padded(data: bytes) -> bytes:
    return data.ljust(max(1, -(-len(data) // BLOCK)) * BLOCK, b" ")


def to_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, media: each text's payload as a transport stream. Null text is an empty text: 192 spaces."""
    schema, arrow = arrow_schema(f"{key} {docs.schema[key].dataType.simpleString()}, n_bytes long, media binary")

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for lo in range(0, len(texts), 500):
                part = texts[lo : lo + 500]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(part)).cast(arrow.field(0).type), pa.array([len(t) for t in part], pa.int64()), pa.array([write_stream(padded(t)) for t in part], pa.binary())], schema=arrow)

    return docs.select(key, text).mapInArrow(run, schema)


UNITS = "array<struct<pid:int,pts:long,dts:long,random_access:boolean,discontinuity:boolean,place:long,length:int>>"


def parse_media(media: DataFrame, key: str = "doc_id", column: str = "media", payload: bool = False) -> DataFrame:
    """One row for each stream: tables, counters, timed access units, and digests of the payload.

    programs, streams, units (pts and dts in 90 kHz ticks, random-access points, places in the
    payload), n_packets, n_counter_errors, n_repeated, n_skipped bytes, payload digests and, if
    asked for, the payload of the first elementary stream. Null or malformed media: no programs,
    no units, an empty payload.
    """
    ddl = f"{key} {media.schema[key].dataType.simpleString()}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long, n_counter_errors long, n_repeated long, n_skipped long, programs array<struct<program:int,pid:int>>, streams array<struct<pid:int,type:int>>, units {UNITS}"
    schema, arrow = arrow_schema(ddl + ", payload binary" * payload)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                rows = []
                for m in batch.column(1).slice(lo, 500).to_pylist():
                    m = m or b""
                    got = read_stream(m)
                    data = got["payloads"].get(got["streams"][0][0], b"") if got["streams"] else b""
                    units, access = got["units"], [u for u in got["units"] if u[3]]
                    stamps = [u[1] for u in units if u[1] is not None]
                    feature = f"programs={len(got['programs'])};streams={','.join(f'{p}:{t}' for p, t in got['streams'])};packets={got['packets']};units={len(units)};access={len(access)};pts={min(stamps, default='')}-{max(stamps, default='')};errors={got['errors']}"
                    row = [len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature, got["packets"], got["errors"], got["repeats"], got["skipped"], got["programs"], got["streams"], units]
                    rows.append(row + [data] * payload)
                names = [[x.name for x in arrow.field(i).type.value_type] if pa.types.is_list(arrow.field(i).type) else None for i in range(1, len(arrow))]
                cols = [pa.array([[dict(zip(n, e, strict=True)) for e in r[i]] if n else r[i] for r in rows], arrow.field(i + 1).type) for i, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 500).cast(arrow.field(0).type), *cols], schema=arrow)

    return media.select(key, column).mapInArrow(run, schema)


def media_features(docs: DataFrame) -> DataFrame:
    """Writes every text as a stream, reads it back, and returns sizes, digests, features and timed units."""
    media = to_media(docs.select("doc_id", "text"))
    # the unpadded length travels with the stream: as part of a struct key, through the parser
    keyed = media.select(F.struct("doc_id", "n_bytes").alias("k"), "media")
    return parse_media(keyed, key="k").select("k.doc_id", "k.n_bytes", *[c for c in _DIGESTS])


_DIGESTS = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_packets", "n_counter_errors", "programs", "streams", "units"]
