"""MPEG audio columns: frame headers with resynchronisation, tags, variable-bitrate tables, checksums, durations, seeks.

parse() walks a stream frame by frame. After bytes that are no frame it looks for the next header that is followed by
another header of the same stream or by the end, and counts what it skipped. Durations are exact: samples over the rate.
store() puts any bytes losslessly into a valid layer III stream: each frame's side information names no coded audio, so
its whole body is ancillary data, and carries UNIT bytes of the payload; a tag has the payload's length, a leading
frame the table of 100 seek points. load() gives the payload back from the parsed frames.

A null value is an empty one; empty media has no frames and duration 0. Any length works; rows are independent.
Repeated rows repeat; other columns aren't read.
"""

from __future__ import annotations

import struct
import zlib
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

UNIT = 576
#: Fixed values of the format: kbit/s by (version 1?, layer) and index; Hz by version bits and index.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        r = i << 8
        for _ in range(8):
            r = (r << 1 ^ 0x8005) & 0xFFFF if r & 0x8000 else r << 1
        out.append(r)
    return out


_CRC, _crcs, _headers = _crc_table(), {}, {}


def checksum(data: bytes) -> int:
    """CRC-16 of the header's last two bytes and the side information."""
    got = _crcs.get(data)
    if got is None:
        got = 0xFFFF
        for b in data:
            got = (got << 8 & 0xFFFF) ^ _CRC[got >> 8 ^ b]
        if len(_crcs) < 10_000:
            _crcs[data] = got
    return got


def header(four: bytes) -> tuple[int, int, int, int, bool, int] | None:
    """(frame length, samples, Hz, kbit/s, has a checksum, side information bytes; 0 but for layer III), None for no header."""
    if four in _headers:
        return _headers[four]
    got = None
    if len(four) == 4 and four[0] == 0xFF and four[1] >> 5 == 7:
        version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
        rate_at, bits_at = four[2] >> 2 & 3, four[2] >> 4
        if version != 1 and layer != 4 and rate_at != 3 and bits_at not in (0, 15):
            kbit, hz = BITRATES[version == 3, layer][bits_at], RATES[version][rate_at]
            pad, mono = four[2] >> 1 & 1, four[3] >> 6 == 3
            if layer == 1:
                length, samples = (12_000 * kbit // hz + pad) * 4, 384
            else:
                samples = 1152 if layer == 2 or version == 3 else 576
                length = samples // 8 * 1000 * kbit // hz + pad
            side = 0 if layer != 3 else (17 if mono else 32) if version == 3 else (9 if mono else 17)
            got = length, samples, hz, kbit, not four[1] & 1, side
    if len(_headers) < 10_000:
        _headers[four] = got
    return got


def _same_stream(a: bytes, b: bytes) -> bool:
    """Version, layer and rate agree."""
    return a[1] & 0xFE == b[1] & 0xFE and a[2] & 0x0C == b[2] & 0x0C


def _tag(data: bytes) -> tuple[int, dict[str, str]]:
    """Length of the leading tag, its text frames."""
    if data[:3] != b"ID3" or len(data) < 10 or data[3] > 4:
        return 0, {}
    safe = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    end, at, out = 10 + safe(data[6:10]), 10, {}
    while at + 11 <= min(end, len(data)) and data[at]:
        name, size = data[at : at + 4].decode("latin-1"), safe(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        if name[0] == "T" and size:
            body = data[at + 11 : at + 10 + size]
            text = body.decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(data[at + 10], "utf-8"), "replace")
            text = text.rstrip("\0")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            out[key] = value
        at += 10 + size
    return min(end, len(data)), out


def _table(frame: bytes, side: int) -> dict | None:
    """A frame's variable-bitrate table: kind, frames, bytes, seek points in 1/256 of the bytes or absolute; None for none.

    A table that the frame cuts short has what of it is whole.
    """
    at = 4 + side
    if frame[at : at + 4] in (b"Xing", b"Info"):
        out = {"kind": frame[at : at + 4].decode(), "seeks": []}
        flags = int.from_bytes(frame[at + 4 : at + 8], "big") if len(frame) >= at + 8 else 0
        at += 8
        for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "seeks", 100)):
            if flags & bit:
                if len(frame) < at + size:
                    break
                out[name] = list(frame[at : at + 100]) if bit == 4 else int.from_bytes(frame[at : at + 4], "big")
                at += size
        return out
    if frame[36:40] == b"VBRI":
        if len(frame) < 62:
            return {"kind": "VBRI", "seeks": []}
        size, frames, entries, scale, width, _ = struct.unpack_from(">IIHHHH", frame, 46)
        seeks, total = [], 0
        for k in range(min(entries, (len(frame) - 62) // width) if width else 0):
            seeks.append(total)
            total += scale * int.from_bytes(frame[62 + k * width : 62 + (k + 1) * width], "big")
        return {"kind": "VBRI", "frames": frames, "bytes": size, "seeks": seeks}
    return None


def parse(data: bytes) -> dict:
    """Frames, exact duration, tags, table, checksums and skipped bytes of a stream."""
    at, tags = _tag(data)
    end = len(data)
    if data[-128:-125] == b"TAG" and end - at >= 128:
        end -= 128
        tags.setdefault("TIT2", data[end + 3 : end + 33].split(b"\0")[0].decode("latin-1").strip())
    out = {"tags": tags, "table": None, "rate": 0, "samples": 0, "good": 0, "bad": 0, "skipped": 0, "kbits": set()}
    offsets, last, sides, follows = [], None, [], -1
    while at < end:
        four = data[at : at + 4]
        info = header(four)
        sure = False
        if info and at + info[0] <= end and (last is None or _same_stream(last, four)):
            after = at + info[0]
            sure = after == end or bool(header(data[after : after + 4]) and _same_stream(four, data[after : after + 4]))
            if not sure and follows == at:  # where the last frame said, before garbage
                sure = not info[4] or checksum(data[at + 2 : at + 4] + data[at + 6 : at + 6 + info[5]]) == int.from_bytes(data[at + 4 : at + 6], "big")
        if not sure:
            found = data.find(b"\xff", at + 1, end)
            out["skipped"] += (end if found < 0 else found) - at
            at = end if found < 0 else found
            continue
        length, samples, hz, kbit, checked, side = info
        if last is None and not checked and (table := _table(data[at : at + length], side)):
            out["table"] = table
        else:
            if checked and side:
                good = checksum(data[at + 2 : at + 4] + data[at + 6 : at + 6 + side]) == int.from_bytes(data[at + 4 : at + 6], "big")
                out["good" if good else "bad"] += 1
            offsets.append(at)
            sides.append(4 + 2 * checked + side)
            out["samples"] += samples
            out["kbits"].add(kbit)
        out["rate"] = hz
        last, at = four, at + length
        follows = at
    return out | {"offsets": offsets, "bodies": sides}


def seek(parsed: dict, second: float) -> int | None:
    """Byte offset of the frame that plays at a time."""
    if not parsed["offsets"]:
        return None
    k = int(second * parsed["rate"] * len(parsed["offsets"]) / parsed["samples"])
    return parsed["offsets"][min(max(k, 0), len(parsed["offsets"]) - 1)]


# MPEG 1 layer III, 192 kbit/s, 44.1 kHz, mono: 626 bytes, 17 of them side information
_PLAIN, _CHECKED = bytes([0xFF, 0xFB, 0xB0, 0xC0]), bytes([0xFF, 0xFA, 0xB0, 0xC0])
_LENGTH = header(_PLAIN)[0]
_HEAD = _CHECKED + checksum(_CHECKED[2:] + bytes(17)).to_bytes(2, "big") + bytes(17)
_FILL = bytes(_LENGTH - len(_HEAD) - UNIT)


def padded(data: bytes) -> bytes:
    """data with bytes 255 up to a positive multiple of UNIT."""
    return data + b"\xff" * (UNIT - len(data) % UNIT if len(data) % UNIT or not data else 0)


def store(payload: bytes) -> bytes:
    """A stream whose frames carry payload, a positive multiple of UNIT bytes long."""
    n = len(payload) // UNIT
    text = b"\0payload\0" + str(len(payload)).encode()
    frame = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
    size = len(frame)
    tag = b"ID3\x03\0\0" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + frame
    seeks = bytes(min(255, (1 + k * n // 100) * 256 // (n + 1)) for k in range(100))
    info = _PLAIN + bytes(17) + b"Info" + struct.pack(">III", 7, n, (n + 1) * _LENGTH) + seeks
    parts = [tag, info.ljust(_LENGTH, b"\0")]
    for k in range(0, len(payload), UNIT):
        parts += (_HEAD, payload[k : k + UNIT], _FILL)
    return b"".join(parts)


def load(media: bytes, parsed: dict | None = None) -> bytes:
    """The payload of a stream that store() made."""
    parsed = parsed or parse(media)
    return b"".join([media[o + b : o + b + UNIT] for o, b in zip(parsed["offsets"], parsed["bodies"], strict=True)])[: int(parsed["tags"]["payload"])]


def feature(parsed: dict) -> str:
    frames, quarters = len(parsed["offsets"]), [parsed["offsets"][len(parsed["offsets"]) * q // 4] for q in range(4)] if parsed["offsets"] else []
    return f"frames={frames};samples={parsed['samples']}/{parsed['rate']};kbit={'/'.join(map(str, sorted(parsed['kbits'])))};crc={parsed['good']}:{parsed['bad']};skipped={parsed['skipped']};seek={':'.join(map(str, quarters))}"


def stored_texts(docs: DataFrame) -> DataFrame:
    """One row for each of docs: its text stored as audio, read back, and described. A narrow pass."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                raw = (text.as_py() or "").encode()
                media = store(padded(raw))
                parsed = parse(media)
                back = load(media, parsed)
                rows.append((len(raw), len(back), sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), sha256(media).hexdigest(), feature(parsed)))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)


def described(media: DataFrame, column: str = "audio") -> DataFrame:
    """media (any columns) with `about`: what parse() finds in its binary column."""
    kind = pa.struct([("frames", pa.int64()), ("samples", pa.int64()), ("rate", pa.int32()), ("seconds", pa.float64()), ("table", pa.string()), ("good_checksums", pa.int64()), ("bad_checksums", pa.int64()), ("skipped", pa.int64()), ("tags", pa.map_(pa.string(), pa.string())), ("offsets", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # a row at a time: media may be long
                one = batch.slice(k, 1)
                p = parse(one.column(batch.schema.get_field_index(column))[0].as_py() or b"")
                about = {"frames": len(p["offsets"]), "samples": p["samples"], "rate": p["rate"], "seconds": p["samples"] / p["rate"] if p["rate"] else 0.0, "table": p["table"] and p["table"]["kind"], "good_checksums": p["good"], "bad_checksums": p["bad"], "skipped": p["skipped"], "tags": list(p["tags"].items()), "offsets": p["offsets"]}
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([about], kind)], [*one.schema.names, "about"])

    about = "struct<frames:long,samples:long,rate:int,seconds:double,table:string,good_checksums:long,bad_checksums:long,skipped:long,tags:map<string,string>,offsets:array<long>>"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema)
    return media.mapInArrow(run, f"{fields}, about {about}")
