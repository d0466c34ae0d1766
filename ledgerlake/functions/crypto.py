"""Sealed columns and the batch splitter.

AES-GCM stands in for the cipher that Spark lacks, a keyed hash for key derivation. No claim of deniability or constant
time is made: paths, sizes and plans show what there is."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame, functions as F

BATCH_BYTES, BATCH_RECORDS = 4040, 1024


def subkey(master: bytes, label: str) -> bytes:
    return hmac.new(master, label.encode(), hashlib.sha256).digest()


def derive_master(password: str, salt: bytes, m_kib: int = 8192, t: int = 2, p: int = 1) -> bytes:
    """32 bytes from a password, on the driver: t rounds, each with m_kib of memory (rounded down to a power of two)."""
    n = 1 << max(m_kib, 1).bit_length() - 1  # 128 * n * r bytes with r = 8 are n KiB
    out = password.encode()
    for _ in range(max(t, 1)):
        out = hashlib.scrypt(out, salt=salt, n=n, r=8, p=p, maxmem=128 * 8 * (n + p + 2) + (1 << 20), dklen=32)
    return out


class Redacted:
    """Bytes that printing doesn't show."""

    def __init__(self, value: bytes):
        self.value = bytes(value)

    def __repr__(self) -> str:
        return f"Redacted({len(self.value)} bytes)"

    def __eq__(self, other) -> bool:
        return isinstance(other, Redacted) and hmac.compare_digest(self.value, other.value)

    __hash__ = None


def decode_space_keys(raw: bytes) -> tuple[bytes, bytes]:
    """Container id and master key of 64 exported bytes."""
    from ..errors import Malformed

    if len(raw) != 64:
        raise Malformed(f"space keys of {len(raw)} bytes")
    return bytes(raw[:32]), bytes(raw[32:])


def random_bytes(n: int) -> bytes:
    import os

    return os.urandom(n)


def maintenance_delay_ms(least: int, most: int) -> int:
    """A delay for deferred maintenance, uniform in [least, most] milliseconds."""
    import secrets

    if not 0 <= least <= most or most - least >= 1 << 32:
        raise ValueError(f"no window: {least} to {most} ms")
    return least + secrets.randbelow(most - least + 1)


def sealed(value: Column, key: bytes, aad: Column) -> Column:
    """A value encrypted under a space's key, bound to the associated bytes. The key is a literal of the plan: set
    spark.sql.redaction.string.regex where plans are shown to others."""
    return F.aes_encrypt(value, F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), aad)


def unsealed(value: Column, key: bytes, aad: Column) -> Column:
    """The value again; the query fails if it, or what it is bound to, was changed."""
    return F.aes_decrypt(value, F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"), aad)


def _key(owner: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(F.lit("column-key:"), owner).cast("binary"), 256), 1, 64))


def seal(rows: DataFrame, column: str, owner: Column, aad: Column) -> DataFrame:
    """The column encrypted under a key of its owner, bound to the associated text."""
    return rows.withColumn(column, F.aes_encrypt(F.col(column), _key(owner), F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), aad.cast("binary")))


def opened(rows: DataFrame, column: str, owner: str, aad: Column) -> DataFrame:
    """The rows that the owner's key opens, decrypted; all others vanish, as if they weren't there."""
    plain = F.try_aes_decrypt(F.col(column), _key(F.lit(owner)), F.lit("GCM"), F.lit("DEFAULT"), aad.cast("binary"))
    return rows.withColumn(column, plain).where(F.col(column).isNotNull())


def split(records: list[tuple[int, bytes]]) -> list[list[tuple[int, bytes]]]:
    """Batches whose compressed form fits a chunk: all records at once, else each half by itself."""
    import zstandard

    packer = zstandard.ZstdCompressor(level=3)
    out: list[list[tuple[int, bytes]]] = []
    todo = [records]
    while todo:
        own = todo.pop()
        if not own:
            continue
        raw = b"".join(i.to_bytes(8, "little") + len(p).to_bytes(4, "little") + p for i, p in own)
        if len(packer.compress(raw)) <= BATCH_BYTES:
            out.append(own)
        elif len(own) == 1:
            raise ValueError(f"record {own[0][0]} doesn't fit a batch")
        else:
            mid = len(own) // 2
            todo += [own[mid:], own[:mid]]
    return out


def split_batches(log: DataFrame) -> DataFrame:
    """namespace, log_id, batch: stretches of 1024 records by rank, each split until its batches fit. A stretch is one group."""
    import pandas as pd

    from ..operators.ranks import global_rank

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("log_id")
        rows = [(int(pdf.namespace.iloc[0]), i, f"{pdf.stretch.iloc[0]}-{k}") for k, own in enumerate(split(list(zip(pdf.log_id.tolist(), map(bytes, pdf.payload))))) for i, _ in own]
        return pd.DataFrame(rows, columns=["namespace", "log_id", "batch"])

    staged = global_rank(log, "namespace", "log_id").withColumn("stretch", F.floor(F.col("rk") / BATCH_RECORDS))
    return staged.groupBy("namespace", "stretch").applyInPandas(run, "namespace smallint, log_id long, batch string")
