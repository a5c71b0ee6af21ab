import random

from gridloom.llm import mpeg_audio as m


def test_round_trip_and_garbage():
    random.seed(5)
    for n in (0, 1, 575, 576, 577, 6000):
        raw = bytes(random.choice([255, 0, 65, 250, 251]) for _ in range(n))
        media = m.store(m.padded(raw))
        p = m.parse(media)
        assert m.load(media, p) == m.padded(raw)
        assert len(p["offsets"]) == len(m.padded(raw)) // 576 == p["good"] and not p["bad"] and not p["skipped"]
        assert p["table"]["kind"] == "Info" and p["table"]["frames"] == len(p["offsets"])
        assert p["samples"] == 1152 * len(p["offsets"])


def test_resync_and_checksums():
    frames = m.store(bytes(576 * 5))
    body = frames[len(frames) - 5 * 626 :]
    broken = bytearray(body[:626] + b"\xff\xfa junk" + body[626:])
    broken[2 * 626 + 7 + 10] ^= 1  # side information of the second frame after the junk
    p = m.parse(bytes(broken) + b"TAG" + b"title".ljust(125, b"\0"))
    assert len(p["offsets"]) == 5 and p["skipped"] == 7 and (p["good"], p["bad"]) == (4, 1)
    assert p["tags"]["TIT2"] == "title"
    assert m.seek(p, 0) == 0 and m.seek(p, 10) == p["offsets"][-1]
    assert m.parse(b"") ["offsets"] == [] and m.parse(b"\xff" * 50)["offsets"] == []


def test_variable_bitrate():
    out = b""
    sizes = []
    for bits in (5, 9, 14, 7):
        four = bytes([0xFF, 0xFB, bits << 4, 0xC0])
        sizes.append(m.header(four)[0])
        out += four.ljust(sizes[-1], b"\0")
    p = m.parse(out)
    assert p["offsets"] == [sum(sizes[:k]) for k in range(4)] and len(p["kbits"]) == 4
