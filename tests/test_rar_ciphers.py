"""Encrypted RAR headers and contents, versions 3 and 5, put together by hand."""

import struct
import zlib

import pytest

from vaultframe.functions import crypto
from vaultframe.sources import detect
from vaultframe.sources.model import ArchiveError, Options

BODY = b"a secret of some length, " * 5


def padded(x):
    return x + bytes(-len(x) % 16)


def rar5(headers):
    vint = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + vint(n >> 7)

    def block(head):
        x = vint(len(head)) + head
        return struct.pack("<I", zlib.crc32(x)) + x

    salt, iv, key_salt = bytes(range(16)), bytes(range(16, 32)), bytes(range(32, 48))
    key = crypto.rar5_key("test", key_salt, 4)
    seal = (lambda x: iv + crypto.aes_cbc_encrypt(key, iv, padded(x))) if headers else (lambda x: x)
    packed = crypto.aes_cbc_encrypt(crypto.rar5_key("test", salt, 4), iv, padded(BODY))
    extra = bytes([1, 0, 1, 4]) + salt + iv + crypto.rar5_check("test", salt, 4) + bytes(4)
    extra = bytes([len(extra)]) + extra
    entry = bytes([2, 3]) + vint(len(extra)) + vint(len(packed)) + b"\x04" + vint(len(BODY)) + b"\0" + struct.pack("<I", zlib.crc32(BODY)) + vint(0) + b"\0" + vint(5) + b"f.txt" + extra
    out = b"Rar!\x1a\x07\x01\0"
    if headers:
        out += block(bytes([4, 0, 0, 1, 4]) + key_salt + crypto.rar5_check("test", key_salt, 4) + bytes(4))
    return out + seal(block(b"\x01\0\0")) + seal(block(entry)) + packed + seal(block(b"\x05\0\0"))


def rar3(headers):
    salt, head_salt = b"saltsalt", b"headsalt"
    packed = crypto.aes_cbc_encrypt(*crypto.rar3_key("test", salt), padded(BODY))

    def block(x):
        return struct.pack("<H", zlib.crc32(x) & 0xFFFF) + x

    main = block(struct.pack("<BHH6x", 0x73, 0x80 if headers else 0, 13))
    entry = block(struct.pack("<BHHIIBIIBBHI", 0x74, 0x8404, 32 + 5 + 8, len(packed), len(BODY), 2, zlib.crc32(BODY), 0x50210000, 29, 0x30, 5, 32) + b"f.txt" + salt)
    if headers:
        entry = head_salt + crypto.aes_cbc_encrypt(*crypto.rar3_key("test", head_salt), padded(entry))
    return b"Rar!\x1a\x07\0" + main + entry + packed


@pytest.mark.parametrize("make", [rar5, rar3])
@pytest.mark.parametrize("headers", [False, True])
def test_rar(make, headers):
    data = make(headers)
    (e,) = detect.entries(data, Options(password="test"))
    assert (e.key, e.is_encrypted, e.size, e.content()) == ("f.txt", True, len(BODY), BODY)
    for password in (None, "wrong"):
        with pytest.raises(ValueError):
            [x.content() for x in detect.entries(data, Options(password=password))]
    if headers:
        with pytest.raises(ArchiveError):
            list(detect.entries(data))
