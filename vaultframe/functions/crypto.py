"""AES in numpy (blocks of a chain side by side), PKWARE's stream cipher, and the key
derivations of the archive formats."""

from __future__ import annotations

import hashlib
import hmac
from functools import lru_cache

import numpy as np

from vaultframe.functions.checksums import _table


def _gf(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = (a << 1) ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


def _boxes() -> tuple[np.ndarray, np.ndarray]:
    """The substitution box from inverses in GF(256) and the affine map."""
    box = np.zeros(256, np.uint8)
    for x in range(256):
        y = next((c for c in range(256) if _gf(x, c) == 1), 0)
        v = 0x63
        for k in range(5):
            v ^= ((y << k) | (y >> (8 - k))) & 255
        box[x] = v
    back = np.zeros(256, np.uint8)
    back[box] = np.arange(256, dtype=np.uint8)
    return box, back


_SBOX, _BACK = _boxes()
_MUL = {k: np.array([_gf(x, k) for x in range(256)], np.uint8) for k in (2, 3, 9, 11, 13, 14)}
_SHIFT = np.array([(4 * ((i // 4 + i % 4) % 4)) + i % 4 for i in range(16)])
_UNSHIFT = np.argsort(_SHIFT)


def _keys(key: bytes) -> np.ndarray:
    n = len(key) // 4
    words = [list(key[4 * i : 4 * i + 4]) for i in range(n)]
    rcon = 1
    for i in range(n, 4 * (n + 7)):
        w = words[-1]
        if i % n == 0:
            w = [int(_SBOX[x]) for x in w[1:] + w[:1]]
            w[0] ^= rcon
            rcon = _gf(rcon, 2)
        elif n > 6 and i % n == 4:
            w = [int(_SBOX[x]) for x in w]
        words.append([a ^ b for a, b in zip(words[i - n], w, strict=True)])
    return np.array(words, np.uint8).reshape(-1, 16)


def _mix(x: np.ndarray, factors: tuple[int, int, int, int]) -> np.ndarray:
    c = x.reshape(-1, 4, 4)
    m = lambda k, v: v if k == 1 else _MUL[k][v]
    rows = [m(factors[0], c[..., i]) ^ m(factors[1], c[..., (i + 1) % 4]) ^ m(factors[2], c[..., (i + 2) % 4]) ^ m(factors[3], c[..., (i + 3) % 4]) for i in range(4)]
    return np.stack(rows, axis=-1).reshape(-1, 16)


def aes_encrypt_blocks(key: bytes, blocks: np.ndarray) -> np.ndarray:
    k = _keys(key)
    x = blocks ^ k[0]
    for r in range(1, len(k)):
        x = _SBOX[x][:, _SHIFT]
        x = (_mix(x, (2, 3, 1, 1)) if r < len(k) - 1 else x) ^ k[r]
    return x


def aes_decrypt_blocks(key: bytes, blocks: np.ndarray) -> np.ndarray:
    k = _keys(key)
    x = blocks ^ k[-1]
    for r in range(len(k) - 2, -1, -1):
        x = _BACK[x[:, _UNSHIFT]] ^ k[r]
        if r:
            x = _mix(x, (14, 11, 13, 9))
    return x


def aes_cbc_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """Without padding; bytes beyond the last whole block are dropped."""
    blocks = np.frombuffer(data[: len(data) // 16 * 16], np.uint8).reshape(-1, 16)
    if not len(blocks):
        return b""
    before = np.concatenate([np.frombuffer(iv, np.uint8)[None, :], blocks[:-1]])
    return (aes_decrypt_blocks(key, blocks) ^ before).tobytes()


def aes_cbc_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    out, last = bytearray(), np.frombuffer(iv, np.uint8)
    for i in range(0, len(data), 16):
        last = aes_encrypt_blocks(key, (np.frombuffer(data[i : i + 16], np.uint8) ^ last)[None, :])[0]
        out += last.tobytes()
    return bytes(out)


def aes_ctr(key: bytes, data: bytes) -> bytes:
    """WinZip's counter: little endian, from 1."""
    n = -(-len(data) // 16)
    counters = np.zeros((n, 16), np.uint8)
    counters[:, :8] = np.arange(1, n + 1, dtype="<u8").view(np.uint8).reshape(-1, 8)
    stream = aes_encrypt_blocks(key, counters).reshape(-1)[: len(data)] if n else np.zeros(0, np.uint8)
    return (np.frombuffer(data, np.uint8) ^ stream).tobytes()


class BadPassword(ValueError):
    pass


def winzip_decrypt(data: bytes, password: bytes, strength: int) -> bytes:
    """strength 1, 2, 3: AES-128, -192, -256. data: salt, verifier, content, MAC."""
    size = 8 + 8 * strength
    salt, check, body, mac = data[: size // 2], data[size // 2 : size // 2 + 2], data[size // 2 + 2 : -10], data[-10:]
    keys = hashlib.pbkdf2_hmac("sha1", password, salt, 1000, 2 * size + 2)
    if keys[-2:] != check:
        raise BadPassword("bad password")
    if hmac.new(keys[size : 2 * size], body, "sha1").digest()[:10] != mac:
        raise ValueError("authentication code does not match")
    return aes_ctr(keys[:size], body)


def winzip_encrypt(data: bytes, password: bytes, strength: int, salt: bytes) -> bytes:
    """The inverse, for tests: writers never encrypt."""
    size = 8 + 8 * strength
    keys = hashlib.pbkdf2_hmac("sha1", password, salt, 1000, 2 * size + 2)
    body = aes_ctr(keys[:size], data)
    return salt + keys[-2:] + body + hmac.new(keys[size : 2 * size], body, "sha1").digest()[:10]


def zipcrypto(data: bytes, password: bytes, check: int | None = None, encrypt: bool = False) -> bytes:
    """PKWARE's traditional cipher over the twelve-byte header and the content; on
    decryption the header is checked against the byte given and dropped."""
    table = _table(0xEDB88320, 0xFFFFFFFF)
    k0, k1, k2 = 0x12345678, 0x23456789, 0x34567890

    def turn(c: int) -> None:
        nonlocal k0, k1, k2
        k0 = table[(k0 ^ c) & 255] ^ (k0 >> 8)
        k1 = ((k1 + (k0 & 255)) * 134775813 + 1) & 0xFFFFFFFF
        k2 = table[(k2 ^ (k1 >> 24)) & 255] ^ (k2 >> 8)

    for c in password:
        turn(c)
    out = bytearray()
    for c in data:
        t = (k2 | 2) & 0xFFFF
        p = c ^ ((t * (t ^ 1) >> 8) & 255)
        turn(c if encrypt else p)
        out.append(p)
    if encrypt:
        return bytes(out)
    if check is not None and (len(out) < 12 or out[11] != check):
        raise BadPassword("bad password")
    return bytes(out[12:])


@lru_cache(64)
def sevenzip_key(password: str, cycles: int, salt: bytes) -> bytes:
    """SHA-256 over 2 ** cycles repetitions of salt, password (UTF-16) and counter."""
    text = password.encode("utf-16-le")
    if cycles == 0x3F:
        return (salt + text + bytes(32))[:32]
    digest, part = hashlib.sha256(), salt + text
    for i in range(1 << cycles):
        digest.update(part + i.to_bytes(8, "little"))
    return digest.digest()


@lru_cache(64)
def rar5_key(password: str, salt: bytes, log_rounds: int) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, 1 << log_rounds, 32)


def rar5_check(password: str, salt: bytes, log_rounds: int) -> bytes:
    """Eight bytes that tell a wrong password: the derivation carried on by 32 rounds,
    folded."""
    value = hashlib.pbkdf2_hmac("sha256", password.encode(), salt, (1 << log_rounds) + 32, 32)
    return bytes(value[i] ^ value[i + 8] ^ value[i + 16] ^ value[i + 24] for i in range(8))


@lru_cache(64)
def rar3_key(password: str, salt: bytes) -> tuple[bytes, bytes]:
    """Key and initial vector: SHA-1 over 2 ** 18 repetitions, the vector's bytes taken
    on the way."""
    part, digest, iv = password.encode("utf-16-le") + salt, hashlib.sha1(), bytearray()
    for i in range(1 << 18):
        digest.update(part + i.to_bytes(3, "little"))
        if i % (1 << 14) == 0:
            iv.append(digest.copy().digest()[19])
    d = digest.digest()
    return b"".join(d[i : i + 4][::-1] for i in range(0, 16, 4)), bytes(iv)


