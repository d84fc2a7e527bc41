"""The directory reader on archives that other writers made, ZIP64 ones among them."""

import io
import struct
import zipfile

import pytest

from encore.llm.archives import central_directory, parsed, record


def members(data):
    return {m["name"]: m for m in central_directory(io.BytesIO(data), len(data))}


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("comment", [b"", b"x" * 65_535, b"PK\5\6 in a comment of its own"])
def test_members_are_found(wide, comment):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name in ("a", "dir/é", "empty"):
            with archive.open(zipfile.ZipInfo(name), "w", force_zip64=wide) as member:
                member.write(b"" if name == "empty" else name.encode() * 100)
        archive.comment = comment if not comment.startswith(b"PK") else b""
    data = out.getvalue()
    for name, m in members(data).items():
        assert m["method"] == 0
        assert data[m["start"]:m["start"] + m["size"]] == (b"" if name == "empty" else name.encode() * 100)


def test_wide_directory():
    """An archive whose sizes, offset, and directory are all given in their 64-bit places only."""
    body = b"hello"
    local = struct.pack("<4s5H3L2H", b"PK\3\4", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 20) + b"n" + struct.pack(
        "<2H2Q", 1, 16, 5, 5)
    entry = struct.pack("<4s6H3L5H2L", b"PK\1\2", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 28, 0, 0, 0, 0,
                        0xFFFFFFFF) + b"n" + struct.pack("<2H3Q", 1, 24, 5, 5, 0)
    at = len(local) + len(body)
    end = struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, 1, 1, len(entry), at)
    locator = struct.pack("<4sLQL", b"PK\6\7", 0, at + len(entry), 1)
    last = struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    data = local + body + entry + end + locator + last
    assert members(data)["n"] == {"name": "n", "method": 0, "size": 5, "start": len(local)}


@pytest.mark.parametrize("data", [b"", b"no archive at all" * 10])
def test_no_archive(data):
    with pytest.raises(ValueError):
        members(data)


def test_record_round_trip():
    payload = b"<p>\r\n\r\n\0\xff"
    got = parsed(record("urn:page:7", "http://x/ä", payload, "ab", None))
    assert got == ("response", "urn:page:7", None, "http://x/ä", "sha256:ab", payload)
    assert parsed(record("urn:page:8", None, payload, "ab", "urn:page:7"))[:4] == (
        "revisit", "urn:page:8", "urn:page:7", None)
