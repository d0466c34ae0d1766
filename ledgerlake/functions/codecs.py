"""Byte layouts of chunks and what stands in them, as column expressions that encode and, strictly, decode.

Integers are little-endian. A decoder gives null for bytes that break a rule: wrong length, unknown kind, reserved flags,
entries out of order. The checks are those of the format; the magic is this engine's own."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed values of the format: bytes of a frame and of its header, payload at most, namespaces in a commit at most.
FRAME, HEADER, PAYLOAD, NAMESPACES = 4056, 16, 4040, 95
MAGIC = b"LLC1"
FRAME_KINDS = 6
NO_RECORD = (1 << 63) - 1

#: Numbers that the count of a node can say; of larger counts it has the low bytes.
COUNTS = 1 << 16
#: Items that are gathered at a time.
BLOCK = 64

ENTRY = "struct<key:binary,value:binary>"
CHILD = "struct<first_key:binary,slot:bigint,hash:binary>"


def let(x: Column, use) -> Column:
    """use(x), where x is computed once for a row, however often `use` names it and wherever the optimizer moves the whole."""
    return F.transform(F.array(x), use)[0]


def le(x: Column, width: int) -> Column:
    """An integer as hex of `width` little-endian bytes."""
    return let(F.lpad(F.hex(x.cast("long")), 16, "0"), lambda h: F.concat(*(F.substring(h, 15 - 2 * i, 2) for i in range(width))))


def _bytes(b: Column, at: Column, n: Column) -> Column:
    """n bytes from a byte offset on, fewer where they end."""
    return b.substr((at + 1).cast("int"), F.least(n, F.octet_length(b)).cast("int"))


def _int(b: Column, at: Column, width: int) -> Column:
    return let(F.hex(_bytes(b, at, F.lit(width))), lambda h: F.conv(F.concat(*(F.substring(h, 2 * i + 1, 2) for i in reversed(range(width)))), 16, 10).cast("long"))


# --- frames


def encode_frame(kind: Column, seq: Column, payload: Column) -> Column:
    """A frame of 4056 bytes; null if the payload is too long or the kind unknown. What follows the payload is zero: frames are sealed as a whole."""
    head = F.concat(F.lit(MAGIC.hex().upper()), le(kind, 1), F.lit("00"), le(seq, 8), le(F.octet_length(payload), 2))
    ok = (F.octet_length(payload) <= PAYLOAD) & kind.between(0, FRAME_KINDS - 1)
    return F.when(ok, F.unhex(F.rpad(F.concat(head, F.hex(payload)), 2 * FRAME, "0")))


def decode_frame(frame: Column) -> Column:
    """kind, seq, payload of a frame."""

    def told(b: Column) -> Column:
        kind, n = _int(b, F.lit(4), 1), _int(b, F.lit(14), 2)
        ok = (F.octet_length(b) == FRAME) & (F.substring(b, 1, 4) == F.lit(MAGIC)) & (kind < FRAME_KINDS) & (F.substring(b, 6, 1) == F.lit(b"\0")) & (n <= PAYLOAD)
        return F.when(ok, F.struct(kind.alias("kind"), _int(b, F.lit(6), 8).alias("seq"), _bytes(b, F.lit(HEADER), n).alias("payload")))

    return let(frame, told)


# --- index nodes


def encode_leaf(namespace: Column, entries: Column) -> Column:
    """A leaf of sorted entries (key, value)."""
    one = lambda e: F.concat(le(F.octet_length(e.key), 2), F.hex(e.key), le(F.octet_length(e.value), 4), F.hex(e.value))
    return let(entries, lambda all_: F.unhex(F.concat(F.lit("00"), le(namespace, 1), le(F.size(all_), 2), F.array_join(F.transform(all_, one), ""))))


def encode_internal(namespace: Column, children: Column) -> Column:
    """An inner node of sorted children (first_key, slot, hash)."""
    one = lambda c: F.concat(le(F.octet_length(c.first_key), 2), F.hex(c.first_key), le(c.slot, 8), F.hex(c.hash))
    return let(children, lambda all_: F.unhex(F.concat(F.lit("01"), le(namespace, 1), le(F.size(all_), 2), F.array_join(F.transform(all_, one), ""))))


def _parsed(b: Column, start: int, least: int, kind: str, step) -> Column:
    """The items that stand one after the other from a byte offset to the end, of `least` bytes or more each; step: (b, at, put) to
    put(item, where the next one starts). Null unless they end with the bytes.

    Items are gathered in blocks, then the blocks: adding to an array copies it."""
    size = F.octet_length(b)
    none = lambda t: F.expr(f"cast(array() as array<{t}>)")

    def more(state: Column, _: Column) -> Column:
        put = lambda item, to: F.struct(F.when(to <= size, to).cast("long").alias("at"), F.concat(state["items"], F.array(item.cast(kind))).alias("items"))
        return F.when(state["at"] < size, step(b, state["at"], put)).otherwise(state)

    def block(state: Column, _: Column) -> Column:
        first = F.struct(state["at"].alias("at"), none(kind).alias("items"))
        add = lambda own: F.struct(own["at"].alias("at"), F.concat(state["blocks"], F.array(own["items"])).alias("blocks"))
        return F.when(state["at"] < size, F.aggregate(F.sequence(F.lit(1), F.lit(BLOCK)), first, more, add)).otherwise(state)

    most = F.ceil((size - start) / (least * BLOCK)).cast("int")
    rounds = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(none("int"))
    first = F.struct(F.lit(start).cast("long").alias("at"), none(f"array<{kind}>").alias("blocks"))
    return F.aggregate(rounds, first, block, lambda done: F.when(done["at"] == size, F.flatten(done["blocks"])))


def _rising(items: Column, key: str) -> Column:
    """items if their keys rise strictly, else null."""

    def told(every: Column) -> Column:
        n = F.greatest(F.size(every) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(every, F.lit(1), n), F.slice(every, F.lit(2), n), lambda a, b: a[key] < b[key])
        return F.when(F.forall(pairs, lambda x: x), every)

    return let(items, told)


def _node(node: Column, kind: bytes, least: int, shape: str, step, key: str) -> Column:
    def told(b: Column) -> Column:
        items = _rising(_parsed(b, 4, least, shape, step), key)
        counted = lambda every: F.when(F.size(every) % COUNTS == _int(b, F.lit(2), 2), F.struct(_int(b, F.lit(1), 1).alias("namespace"), every.alias("items")))
        return F.when((F.octet_length(b) >= 4) & (F.substring(b, 1, 1) == F.lit(kind)), let(items, counted))

    return let(node, told)


def decode_leaf(node: Column) -> Column:
    """namespace and items (key, value) of a leaf."""

    def step(b: Column, at: Column, put) -> Column:
        entry = lambda klen, vlen: put(F.struct(_bytes(b, at + 2, klen).alias("key"), _bytes(b, at + 6 + klen, vlen).alias("value")), at + 6 + klen + vlen)
        return let(_int(b, at, 2), lambda klen: let(_int(b, at + 2 + klen, 4), lambda vlen: entry(klen, vlen)))

    return _node(node, b"\0", 6, ENTRY, step, "key")


def decode_internal(node: Column) -> Column:
    """namespace and items (first_key, slot, hash) of an inner node."""

    def step(b: Column, at: Column, put) -> Column:
        child = lambda klen: F.struct(_bytes(b, at + 2, klen).alias("first_key"), _int(b, at + 2 + klen, 8).alias("slot"), _bytes(b, at + 10 + klen, F.lit(32)).alias("hash"))
        return let(_int(b, at, 2), lambda klen: put(child(klen), at + 42 + klen))

    return _node(node, b"\1", 42, CHILD, step, "first_key")


# --- commits, checkpoints


def _total(roots: Column) -> Column:
    """The hash over the hashes of roots."""
    return F.unhex(F.sha2(F.unhex(F.array_join(F.transform(roots, lambda r: F.hex(r.hash)), "")), 256))


def encode_commit(roots: Column) -> Column:
    """Roots (namespace, kind, slot, hash) sorted by namespace, then the hash over their hashes."""
    one = lambda r: F.concat(le(r.namespace, 1), le(r.kind, 1), le(r.slot, 8), F.hex(r.hash))
    return let(roots, lambda all_: F.unhex(F.concat(le(F.size(all_), 2), F.array_join(F.transform(all_, one), ""), F.hex(_total(all_)))))


def decode_commit(commit: Column) -> Column:
    """roots and tx_root_hash of a commit whose own hash agrees."""

    def one(b: Column, at: Column) -> Column:
        return F.struct(_int(b, at, 1).alias("namespace"), _int(b, at + 1, 1).alias("kind"), _int(b, at + 2, 8).alias("slot"), _bytes(b, at + 10, F.lit(32)).alias("hash"))

    def checked(b: Column, roots: Column) -> Column:
        told = _bytes(b, F.octet_length(b) - 32, F.lit(32))
        return F.when(F.forall(roots, lambda r: r.kind <= 1) & (_total(roots) == told), F.struct(roots.alias("roots"), told.alias("tx_root_hash")))

    def sized(b: Column, n: Column) -> Column:
        number = F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
        roots = _rising(F.transform(number, lambda i: one(b, 2 + i * 42)), "namespace")
        return F.when((n <= NAMESPACES) & (F.octet_length(b) == 34 + 42 * n), let(roots, lambda r: checked(b, r)))

    return let(commit, lambda b: let(_int(b, F.lit(0), 2), lambda n: sized(b, n)))


def encode_checkpoint(seq: Column, high_water: Column, next_slot: Column, owned: Column, pool: Column) -> Column:
    """A chunk of a checkpoint chain: what it covers, where the next chunk is, owned slots and pool slots."""
    every = F.array_join(F.transform(F.concat(owned, pool), lambda s: le(s, 8)), "")
    return F.unhex(F.concat(le(seq, 8), le(high_water, 8), le(next_slot, 8), le(F.size(owned), 4), le(F.size(pool), 4), every))


def decode_checkpoint(chunk: Column) -> Column:
    """seq, high_water, next_slot, owned, pool of a checkpoint chunk; slots are below the high-water mark."""

    def told(b: Column, n: Column, m: Column) -> Column:
        every = F.when(n + m > 0, F.transform(F.sequence(F.lit(0), (n + m - 1).cast("int")), lambda i: _int(b, 32 + 8 * i, 8))).otherwise(F.expr("cast(array() as array<bigint>)"))
        return F.when(F.octet_length(b) == 32 + 8 * (n + m), let(every, lambda slots: let(_int(b, F.lit(8), 8), lambda high: sane(b, n, m, slots, high))))

    def sane(b: Column, n: Column, m: Column, slots: Column, high: Column) -> Column:
        own = F.struct(_int(b, F.lit(0), 8).alias("seq"), high.alias("high_water"), _int(b, F.lit(16), 8).alias("next_slot"), F.slice(slots, F.lit(1), n.cast("int")).alias("owned"), F.slice(slots, (n + 1).cast("int"), m.cast("int")).alias("pool"))
        return F.when(F.forall(slots, lambda s: s < high), own)

    return let(chunk, lambda b: let(_int(b, F.lit(24), 4), lambda n: let(_int(b, F.lit(28), 4), lambda m: told(b, n, m))))


# --- keys


def split_space_keys(raw: Column) -> Column:
    """container_id and aead_root of 64 bytes; null for other lengths."""
    return F.when(F.octet_length(raw) == 64, F.struct(F.substring(raw, 1, 32).alias("container_id"), F.substring(raw, 33, 32).alias("aead_root")))


def frame_keys(keys: Column) -> Column:
    """A list of keys as count and, for each, length and bytes."""
    return F.unhex(F.concat(le(F.size(keys), 4), F.array_join(F.transform(keys, lambda k: F.concat(le(F.octet_length(k), 4), F.hex(k))), "")))


def unframe_keys(raw: Column) -> Column:
    """The keys again."""

    def step(b: Column, at: Column, put) -> Column:
        return let(_int(b, at, 4), lambda n: put(_bytes(b, at + 4, n), at + 4 + n))

    def told(b: Column) -> Column:
        return F.when(F.octet_length(b) >= 4, let(_parsed(b, 4, 4, "binary", step), lambda keys: F.when(F.size(keys) == _int(b, F.lit(0), 4), keys)))

    return let(raw, told)
