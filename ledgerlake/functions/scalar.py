"""Scalar rules of the format as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed values of the format.
PAYLOAD_CAP, HAZARD, FANOUT, HORIZON, CHECKPOINT_ENTRIES = 4040, 6, 4, 1024, 501
PARAMS_VERSION = 3
NAMES = {1: "SETTINGS", 2: "CONTACTS", 3: "MESSAGE_LOG", 4: "MEDIA"}
PADDING_BUCKETS = {0: 0, 1: 64, 2: 256, 3: 4096}
PRESETS = {"min": (8192, 2, 1), "light": (16384, 3, 1), "default": (65536, 3, 1), "heavy": (262144, 4, 4)}


def big_endian(x: Column) -> Column:
    """An id as 8 bytes whose order is the ids' order."""
    return F.unhex(F.lpad(F.hex(x), 16, "0"))


def from_big_endian(b: Column) -> Column:
    return F.conv(F.hex(b), 16, 10).cast("long")


def little_endian(x: Column) -> Column:
    h = F.lpad(F.hex(x), 16, "0")
    return F.unhex(F.concat(*(F.substring(h, i, 2) for i in range(15, 0, -2))))


def child_index(key: Column, first_keys: Column) -> Column:
    """The child that may hold a key: the last whose first key isn't above it, or the first."""
    return F.greatest(F.size(F.filter(first_keys, lambda f: f <= key)) - 1, F.lit(0))


def leaf_cost(key: Column, value: Column) -> Column:
    return F.lit(2) + F.octet_length(key) + 4 + F.octet_length(value)


def child_cost(first_key: Column) -> Column:
    return F.lit(2) + F.octet_length(first_key) + 8 + 32


def boundary_hash(level: Column, key: Column) -> Column:
    """An unsigned 64-bit number from level and key, as a decimal; SHA-256 stands in for the hash that Spark lacks."""
    h = F.sha2(F.concat(F.lit("boundary:").cast("binary"), F.unhex(F.lpad(F.hex(level), 2, "0")), key), 256)
    return F.conv(F.substring(h, 1, 16), 16, 10).cast("decimal(20,0)")


def is_boundary(h: Column, cost: Column, fill: Column) -> Column:
    """Whether an item ends its node: hash / 2**64 < cost / (6 * room left)."""
    room = F.greatest(F.lit(PAYLOAD_CAP) - fill, F.lit(0)).cast("decimal(5,0)")
    return (h.cast("decimal(20,0)") * (room * HAZARD).cast("decimal(6,0)")).cast("decimal(38,0)") < (cost.cast("decimal(5,0)") * F.lit("18446744073709551616").cast("decimal(20,0)")).cast("decimal(38,0)")


def max_depth(budget: Column) -> Column:
    """Levels below the root that so many chunks can hold. The chunks that depth d needs: 1, 3, 8, 25, 90, ..."""
    needs, level, total = [], 1, 1
    for _ in range(28):
        total += level + 1
        needs.append(total)
        level *= FANOUT
    return F.size(F.filter(F.array(*map(F.lit, needs)), lambda n: n <= budget))


def padding(policy: Column, setting: Column, slots: Column, added: Column) -> Column:
    """Chunks to append after a commit: none, up to the next multiple of a bucket, or a share of what was added (percent)."""
    b = F.nullif(setting, F.lit(0))
    return F.when(policy == "bucket", F.coalesce(F.ceil(slots / b).cast("long") * b - slots, F.lit(0))).when(policy == "ratio", F.expr("0") + F.floor(added * setting / 100)).otherwise(F.lit(0)).cast("long")


def bucket_of_index(index: Column) -> Column:
    """Chunks in a bucket by the policy's number; 0 (no padding) for unknown ones."""
    out = F.lit(0)
    for i, n in PADDING_BUCKETS.items():
        out = F.when(index == i, n).otherwise(out)
    return out


def index_of_bucket(chunks: Column) -> Column:
    """The number of a preset bucket; null for others."""
    out = F.lit(None).cast("int")
    for i, n in PADDING_BUCKETS.items():
        out = F.when(chunks == n, i).otherwise(out)
    return out


def format_version(word: Column) -> Column:
    return word.cast("long").bitwiseAND(F.lit(0xFFFF).cast("long"))


def padding_index(word: Column) -> Column:
    return F.shiftright(word.cast("long"), 16).bitwiseAND(F.lit(0xFF).cast("long"))


def with_padding_index(word: Column, index: Column) -> Column:
    return format_version(word).bitwiseOR(F.shiftleft(index.cast("long"), 16))


def params_fault(m: Column, t: Column, p: Column, word: Column) -> Column:
    """Why key-derivation parameters are refused; null if they aren't."""
    return (
        F.when(format_version(word) != PARAMS_VERSION, "version")
        .when(F.shiftright(word.cast("long"), 24) != 0, "reserved")
        .when((t < 2) | (m < 8192) | (p < 1), "floor")
        .when((m > 524288) | (t > 8) | (p > 16), "ceiling")
    )


def encode_params(*words: Column) -> Column:
    """Four u32 as 16 little-endian bytes."""
    out = []
    for w in words:
        h = F.lpad(F.hex(w.cast("long")), 8, "0")
        out += [F.substring(h, i, 2) for i in (7, 5, 3, 1)]
    return F.unhex(F.concat(*out))


def decode_params(b: Column) -> Column:
    """The four u32 of 16 little-endian bytes; null if there are fewer."""
    h = F.hex(b)
    word = lambda i: F.conv(F.concat(*(F.substring(h, 8 * i + j, 2) for j in (7, 5, 3, 1))), 16, 10).cast("long")
    return F.when(F.octet_length(b) >= 16, F.array(*(word(i) for i in range(4))))


def reuse_floor(pool: Column) -> Column:
    """Slots of a pool that a write episode must leave."""
    return pool - F.floor(pool / 2)


def draws(pool: Column, placed: Column) -> Column:
    return 2 * F.least(F.floor(pool / 2), placed)


def checkpoint_chunks(entries: Column) -> Column:
    return F.greatest(F.ceil(entries / CHECKPOINT_ENTRIES), F.lit(1))


def checkpoint_due(total: Column, covered: Column, owned: Column, drift: Column) -> Column:
    """Whether a fresh checkpoint pays: covered is null if there is none."""
    return (total >= 4096) & (covered.isNull() | (total - covered > F.greatest(owned, F.lit(2048))) | (drift >= 256))


def namespace_name(ns: Column) -> Column:
    out = F.lit("(custom)")
    for n, name in NAMES.items():
        out = F.when(ns == n, name).otherwise(out)
    return out


def compact_due(utilization: Column, slots: Column, idle_days: Column) -> Column:
    return ((utilization < 0.5) & (slots > 1024)) | (slots > 262144) | (idle_days > 14)


def overhead_band(percent: Column) -> Column:
    return F.when(percent <= 30, "steady").when(percent <= 70, "vacuum").otherwise("investigate")


def text_or_hex(value: Column) -> Column:
    return F.coalesce(F.try_validate_utf8(value.cast("string")), F.lower(F.hex(value)))


def settled(state: Column) -> Column:
    return ~state.isin("queued", "running")


def may_have_mutated(state: Column) -> Column:
    return state != "never_started"


def preset_memory(name: Column) -> Column:
    """KiB of memory that a named cost takes; null for names that aren't any."""
    out = F.lit(None).cast("int")
    for preset, (m, _, _) in PRESETS.items():
        out = F.when(name == preset, m).otherwise(out)
    return out
