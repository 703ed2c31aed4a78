"""Checksums, filters, ciphers and codecs against published values and round trips."""

import bz2
import lzma
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vaultframe.functions import checksums, codecs, crypto, filters, legacy, times
from vaultframe.functions.codecs import DEFAULT, Codec, Context
from vaultframe.functions.legacy import FormatError

CHECK = b"123456789"
TEXT = b"the quick brown fox jumps over the lazy dog, then the quick brown fox sleeps. " * 60


@pytest.mark.parametrize(("name", "value"), [("crc32", 0xCBF43926), ("crc32_raw", 0x340BC6D9), ("crc16_arc", 0xBB3D), ("crc64_xz", 0x995DC9BBDF1939FA), ("adler32", 0x091E01DE), ("bzip2_crc", 0xFC891918)])
def test_check_values(name, value):
    assert checksums.ALGORITHMS[name](CHECK) == value


def test_blake2sp_of_one_byte():
    assert checksums.blake2sp(b"\0").hex() == "a6b9eecc25227ad788c99d3f236debc8da408849e9a5178978727a81457f7239"


def test_ppmd():
    from vaultframe.functions import ppmd

    text = open(__file__, "rb").read()
    for data in (b"", b"a", b"abracadabra" * 30, text, np.random.default_rng(1).integers(0, 256, 3000).astype(np.uint8).tobytes(), bytes(range(256)) * 8, bytes(30_000)):
        for order in (2, 6, 16):
            packed = ppmd.encode(data, order)
            assert ppmd.decode(packed, len(data), order) == data
    assert len(ppmd.encode(text)) < len(zlib.compress(text, 9))
    with pytest.raises(FormatError):
        ppmd.encode(text * 3, 6, 1 << 15)  # a model that outgrows its memory is refused
    with pytest.raises(ValueError):
        ppmd.decode(ppmd.encode(text)[:200], len(text))


def test_blake2sp_of_nothing():
    assert checksums.blake2sp(b"").hex() == "dd0e891776933f43c7d032b08a917e25741f8aa9a12c12e1cac8801500f2ca4f"


def test_checksum_columns(spark):
    df = spark.createDataFrame([(CHECK,), (None,), (b"",)], "b binary")
    for name, f in checksums.ALGORITHMS.items():
        assert [r[0] if r[0] is None else int(r[0]) for r in df.select(checksums.checksum(df.b, name)).collect()] == [f(CHECK), None, f(b"")]


@pytest.mark.parametrize("name", [*filters._LIB, "delta", "arm64"])
@given(data=st.binary(max_size=400))
@settings(max_examples=25, deadline=None)
def test_filters_round_trip(name, data):
    data += b"\xe8\x01\x02\x00\x00\x94\x00\x00\x01" * 20
    assert filters.apply(name, filters.apply(name, data, True, distance=3), distance=3) == data


def test_aes_vectors():
    block = np.frombuffer(bytes.fromhex("00112233445566778899aabbccddeeff"), np.uint8)[None, :]
    for size, out in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (24, "dda97ca4864cdfe06eaf70a0ec0d7191"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        key = bytes(range(size))
        done = crypto.aes_encrypt_blocks(key, block)
        assert done.tobytes().hex() == out
        assert (crypto.aes_decrypt_blocks(key, done) == block).all()


def test_zip_ciphers():
    assert crypto.winzip_decrypt(crypto.winzip_encrypt(TEXT, b"test", 3, bytes(16)), b"test", 3) == TEXT
    with pytest.raises(crypto.BadPassword):
        crypto.winzip_decrypt(crypto.winzip_encrypt(TEXT, b"test", 1, bytes(8)), b"no", 1)
    assert crypto.zipcrypto(crypto.zipcrypto(bytes(11) + b"\x07" + TEXT, b"test", encrypt=True), b"test", 7) == TEXT


@pytest.mark.parametrize("name", ["none", "deflate", "zlib", "gzip", "bzip2", "lzma", "lzma2", "lzip", "zstd"])
@given(data=st.binary(max_size=300))
@settings(max_examples=10, deadline=None)
def test_codecs_round_trip(name, data):
    codec = DEFAULT.get(name)
    assert codec.decompress(codec.compress(data + TEXT)) == data + TEXT
    assert codec.decompress(codec.compress(data)) == data


def test_damaged_input_is_a_typed_error():
    for name in ("deflate", "zlib", "gzip", "bzip2", "lzma", "lzip", "zstd", "lzw", "deflate64", "crunched"):
        with pytest.raises(FormatError):
            DEFAULT.get(name).decompress(b"\xff\x00garbage that is no stream", Context(size=100))


def test_levels_and_registry():
    with pytest.raises(ValueError):
        DEFAULT.get("bzip2").compress(b"x", Context(level=5))
    with pytest.raises(ValueError):
        DEFAULT.get("zstd").compress(b"x", Context(level=23))
    with pytest.raises(codecs.UnsupportedCodec):
        codecs.EMPTY.get("zlib")
    with pytest.raises(codecs.UnsupportedCodec):
        DEFAULT.get("xz").compress(b"x")
    own = DEFAULT.with_codec(Codec("turned", lambda d, c: d[::-1], lambda d, c: d[::-1]))
    assert own.get("turned").compress(b"abc") == b"cba"
    with pytest.raises(codecs.UnsupportedCodec):
        DEFAULT.get("turned")


def test_xz_and_deflate64_over_library_streams():
    assert DEFAULT.get("xz").decompress(lzma.compress(TEXT)) == TEXT
    z = zlib.compressobj(9, zlib.DEFLATED, -15)
    plain = np.random.default_rng(2).integers(0, 12, 20000, np.uint8).tobytes()  # no long matches: the formats agree
    assert legacy.inflate64(z.compress(plain) + z.flush()) == plain


def lzw_packed(data: bytes, most: int = 16) -> bytes:
    """A .Z writer for the tests."""
    table, width, following, now, out, group = {bytes([i]): i for i in range(256)}, 9, 257, b"", bytearray(b"\x1f\x9d" + bytes([most | 128])), []

    def flush(whole: bool):
        if group:
            v = sum(c << i * width for i, c in enumerate(group))
            out.extend(v.to_bytes(width if whole or len(group) == 8 else (len(group) * width + 7) // 8, "little"))
            group.clear()

    for i in range(len(data)):
        x = now + data[i : i + 1]
        if x in table:
            now = x
            continue
        group.append(table[now])
        if len(group) == 8:
            flush(True)
        if following < 1 << most:
            table[x] = following
            following += 1
            if following > 1 << width and width < most:
                flush(True)
                width += 1
        now = data[i : i + 1]
    if now:
        group.append(table[now])
    flush(False)
    return bytes(out)


def test_lzw_self_tested():
    noise = np.random.default_rng(1).integers(0, 40, 60000, np.uint8).tobytes()
    for most in (12, 14, 16):
        assert legacy.unlzw(lzw_packed(noise + TEXT, most)) == noise + TEXT


def test_small_legacy_codecs():
    assert legacy.rle90(b"ab\x90\x04c\x90\x00") == b"abbbbc\x90"
    assert legacy.adc(b"\x83abcd\x00\x03\x40\x00\x01") == b"abcdabc" + _copied(b"abcdabc", 2, 4)
    with pytest.raises(FormatError):
        legacy.adc(b"\x00\x05")
    # Squeezed: a node with the leaves "a" and the end.
    assert legacy.unsqueeze(struct.pack("<Hhh", 1, -(ord("a") + 1), -257) + bytes([0b00001000])) == b"aaa"


def _copied(done: bytes, distance: int, n: int) -> bytes:
    out = bytearray(done)
    for _ in range(n):
        out.append(out[-distance])
    return bytes(out[len(done) :])


def test_shrink_and_reduce_literals():
    codes = sum(c << 9 * i for i, c in enumerate(b"hello"))
    assert legacy.unshrink(codes.to_bytes(8, "little"), 5) == b"hello"
    bits, at = 0, 6 * 256
    for c in b"hello":
        bits |= c << at
        at += 8
    assert legacy.expand_reduced(bits.to_bytes(at // 8 + 1, "little"), 5, 1) == b"hello"


def test_times(spark):
    assert str(times.dos_time(0)) == "1980-01-01 00:00:00"
    assert times.dos_time(0x21 << 16 | 31 << 11) is None
    when = times.dos_time(times.to_dos(times.unix_time(1_600_000_000)))
    assert abs((when - times.unix_time(1_600_000_000)).total_seconds()) < 2
    assert times.octal(b"0000644\0") == 0o644 and times.octal(b"\x80" + bytes(6) + b"\x05") == 5
    assert not any(map(times.is_safe, ("../x", "/x", "a/../../b", "C:\\x", "\\x", "", "a\0b"))) and times.is_safe("a/..b/c")
    packed = [0, times.to_dos(times.unix_time(1_600_000_000)), 0x21 << 16 | 31 << 11]
    df = spark.createDataFrame([(p,) for p in packed], "p long")
    assert [r[0] for r in df.select(times.dos_time_col(df.p)).collect()] == [times.dos_time(p) for p in packed]


def test_column_errors(spark):
    df = spark.createDataFrame([(bz2.compress(b"fine"),), (b"broken",), (None,)], "b binary")
    assert [r[0] for r in df.select(codecs.decompress(df.b, "bzip2", on_error="null")).collect()] == [b"fine", None, None]
