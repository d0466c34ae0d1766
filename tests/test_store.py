"""The store against a dictionary, and its rules one by one."""

import io
import random
import threading

import pytest

from ledgerlake import cli, runtime
from ledgerlake.errors import AuthFailed, Busy, Cancelled, EngineError, Malformed, PayloadTooLarge, ReadOnly, WrongNamespaceKind
from ledgerlake.sources.store import CancelToken, Container, MultiSpace
from ledgerlake.streaming import pages


@pytest.fixture()
def container(spark, tmp_path):
    return Container.create(spark, str(tmp_path / "c"))


@pytest.fixture()
def space(container):
    return container.create_space("pw")


def kv_of(space, n):
    return [(bytes(r.key), bytes(r.value)) for r in space.list(n).collect()]


def log_of(space, n):
    return [(r.log_id, bytes(r.payload)) for r in space.iter_log(n).collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_a_dictionary(spark, container, seed):
    r = random.Random(seed)
    space = container.create_space(f"model{seed}")
    kv, log, seq = {}, {}, 1
    for _ in range(6):
        tx, kv2, log2 = space.begin_tx(), dict(kv), dict(log)
        removing = r.random() < 0.4
        for _ in range(r.randint(1, 12)):
            key, what = bytes([r.randint(97, 105)]) * r.randint(1, 3), r.random()
            if what < 0.5:
                value = bytes([r.randint(0, 255)]) * r.randint(0, 9)
                tx.put(1, key, value)
                kv2[key] = value
            elif what < 0.7:
                tx.delete(1, key)
                kv2.pop(key, None)
            elif removing:
                i = r.randint(0, 9)
                tx.delete_log(6, i)
                log2.pop(i, None)
            else:
                i = r.randint(0, 9)
                tx.append_log(6, i, bytes(str(r.random()), "ascii"))
                log2[i] = bytes(tx.pending[6].ops[-1][2])
        if r.random() < 0.8:
            if not tx.is_empty():
                seq += 1
            assert tx.commit() == seq
            kv, log = kv2, log2
        space = container.open_space(f"model{seed}", verify=True)
        assert kv_of(space, 1) == sorted(kv.items()) and log_of(space, 6) == sorted(log.items())
        assert space.count(1) == len(kv) and space.commit_history() == list(range(1, seq + 1))
        assert space.list_namespaces() == [n for n, x in ((1, kv), (6, log)) if x]


def test_limits_and_kinds(space):
    tx = space.begin_tx()
    for bad in (lambda: tx.put(0, b"k", b""), lambda: tx.put(1, b"", b""), lambda: tx.put(1, b"k" * 257, b""), lambda: tx.delete(1, b"")):
        with pytest.raises(Malformed):
            bad()
    for bad in (lambda: tx.put(1, b"k", b"v" * 2049), lambda: tx.append_log(3, 1, b"x" * 8193), lambda: tx.append_log(3, 1, random.Random(1).randbytes(8000))):
        with pytest.raises(PayloadTooLarge):
            bad()
    tx.put(1, b"k", b"v")
    tx.append_log(3, 5, b"x" * 8192)
    for bad in (lambda: tx.append_log(1, 1, b""), lambda: tx.put(3, b"k", b""), lambda: tx.delete_log(3, 5), lambda: tx.erase(1)):
        with pytest.raises(WrongNamespaceKind):
            bad()
    assert tx.touched_namespaces() == [1, 3] and tx.commit() == 2
    assert space.list_namespaces_with_kind() == [(1, "Kv"), (3, "Log")]
    wrong = space.begin_tx()
    wrong.append_log(1, 1, b"")
    with pytest.raises(WrongNamespaceKind):
        wrong.commit()
    with pytest.raises(WrongNamespaceKind):
        space.iter_log_after(1, None, 5)
    assert space.iter_log_after(1, None, 0).collect() == [] and space.iter_log_range(1, 5, 5, 9).collect() == []
    assert kv_of(space, 3) == [((5).to_bytes(8, "big"), b"x" * 8192)]  # key/value reads have no check of the kind
    assert space.get(1, b"zz") is None and space.get(9, b"k") is None and space.count(9) == 0 and space.read_log(3, 5) == b"x" * 8192
    many = space.begin_tx()
    for i in range(1024):
        many.append_log(3, i, b"")
    with pytest.raises(Malformed):
        many.append_log(3, 2000, b"")


def test_erase_frees_the_kind_and_empty_commits_do_nothing(space):
    assert space.begin_tx().commit() == 1 and space.erase_namespace(2) == 0
    tx = space.begin_tx()
    tx.delete(2, b"absent")
    assert tx.commit() == 2
    tx.put(2, b"a", b"1")
    tx.commit()
    assert space.erase_namespace(2) == 1 and space.list_namespaces() == []
    tx.append_log(2, 1, b"now a log")
    tx.commit()
    assert space.list_namespaces_with_kind() == [(2, "Log")]


def test_two_writers_and_readonly(spark, container, space):
    other = Container.open(spark, container.root).open_space("pw")
    a, b = space.begin_tx(), other.begin_tx()
    a.put(1, b"k", b"a")
    b.put(1, b"k", b"b")
    real = other.manifests.latest
    other.manifests.latest = lambda: 1
    a.commit()
    with pytest.raises(Busy):
        b.commit()
    other.manifests.latest = real
    reader = Container.open(spark, container.root, readonly=True).open_space("pw")
    tx = reader.begin_tx()
    tx.put(1, b"k", b"c")
    with pytest.raises(ReadOnly):
        tx.commit()
    assert reader.get(1, b"k") == b"a" and reader.vacuum() == 0
    assert space.triage(9) == "rollback" and space.triage(2) == "clean" and space.triage(0) == "fork"


def test_passwords_repack_and_hosting(spark, container, space, tmp_path):
    with pytest.raises(AuthFailed):
        container.open_space("nope")
    with pytest.raises(EngineError):
        container.create_space("pw")
    container.create_space("other")
    for i in range(3):
        tx = space.begin_tx()
        tx.put(1, b"k%d" % i, b"v")
        tx.append_log(3, i, b"m")
        tx.commit()
    out = container.change_passwords(str(tmp_path / "d"), {"pw": "new"})
    moved = out.open_space("new", verify=True)
    assert kv_of(moved, 1) == kv_of(space, 1) and log_of(moved, 3) == log_of(space, 3)
    for gone in ("pw", "other"):
        with pytest.raises(AuthFailed):
            out.open_space(gone)
    host = MultiSpace(container)
    assert host.open_space("pw") == 0 and host.with_space(0, lambda s: s.count(1)) == 3 and len(host) == 1
    with pytest.raises(EngineError):
        host.open_space("pw")
    token = CancelToken()
    token.cancel()
    with pytest.raises(Cancelled):
        container.open_space("pw", cancel=token)
    assert space.vacuum() == 0 and space.stats()["entries"] == 6


def test_pages_reassemble(spark, space):
    tx = space.begin_tx()
    for i in range(1, 24):
        tx.append_log(3, i * 3, bytes([i]))
    tx.commit()
    every = [r.log_id for r in space.iter_log(3).collect()]
    for size in (1, 5, 23, 100):
        assert [r.log_id for p in pages.pages_after(space.log(3), 3, None, size) for r in p] == every
        assert [r.log_id for p in pages.pages_before(lambda: space.log(3), 3, None, size) for r in p] == every[::-1]
        assert [r.log_id for p in pages.range_pages(space.log(3), 3, 6, 30, size) for r in p] == [i for i in every if 6 <= i < 30]
        for back in (False, True):
            told = {r.log_id: r.page for r in pages.page_table(space.log(3), 3, size, after=5, before=60, backward=back).collect()}
            inside = [i for i in (every[::-1] if back else every) if 5 < i < 60]
            assert told == {i: k // size for k, i in enumerate(inside)}
    assert list(pages.pages_after(space.log(3), 3, None, 0)) == [] == list(pages.range_pages(space.log(3), 3, 9, 9, 5))


def big_log(spark, container, space, n=4000, rows=100):
    from pyspark.sql import functions as F

    container.file_rows = rows
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n // rows))
    try:
        frame = spark.range(n).select(F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("key"), F.col("id").alias("log_id"), F.concat(F.lit("secret-payload-"), "id").cast("binary").alias("value"))
        return space.write_frame(3, "Log", frame)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_values_are_sealed_at_rest(spark, container, space):
    import glob

    import pyarrow.parquet as pq

    big_log(spark, container, space, 400)
    tx = space.begin_tx()
    tx.put(1, b"key", b"a value that nobody may read")
    tx.commit()
    files = glob.glob(f"{container.root}/spaces/*/data/*/part-*")
    stored = [v for f in files for v in pq.read_table(f).column("value").to_pylist()]
    assert len(stored) == 401 and not any(b"secret-payload" in v or b"nobody may read" in v for v in stored)
    assert all(b"secret-payload" not in open(f, "rb").read() for f in files)
    assert space.get(1, b"key") == b"a value that nobody may read" and space.read_log(3, 77) == b"secret-payload-77"
    # a value put under another key doesn't open there
    import shutil

    root = space._manifest()["namespaces"]
    shutil.copy(f"{space.root}/{root['1']['files'][0]['path']}", f"{space.root}/{root['3']['files'][0]['path']}")
    for f in glob.glob(f"{space.root}/data/*/.*.crc"):
        __import__("os").remove(f)
    with pytest.raises(Malformed):
        space.verify()


def test_pages_open_few_files(spark, container, space):
    big_log(spark, container, space)
    every = space._root(3)["files"]
    assert len(every) >= 20
    opened = lambda df: len(df.inputFiles())
    for df, most in ((space.iter_log_after(3, 1999, 50), 2), (space.iter_log_before(3, 2000, 50), 2), (space.iter_log_range(3, 500, 9000, 20), 2), (space.iter_log_after(3, None, 5), 1), (space.list_after(3, (700).to_bytes(8, "big"), 10), 2), (space.list_keys_after(3, None, 10), 1)):
        assert opened(df) <= most
    assert [r.log_id for r in space.iter_log_after(3, 1999, 50).collect()] == list(range(2000, 2050))
    assert [r.log_id for r in space.iter_log_before(3, 2000, 250).collect()] == list(range(1999, 1749, -1))
    assert [r.log_id for r in space.iter_log_range(3, 500, 9000, 320).collect()] == list(range(500, 820))
    assert [r.log_id for r in space.iter_log_after(3, 3990, 50).collect()] == list(range(3991, 4000)) and space.iter_log_after(3, (1 << 63) - 1, 5).collect() == []
    assert [r.log_id for r in space.iter_log_before(3, 1 << 63, 2).collect()] == [3999, 3998] and space.iter_log_before(3, 0, 5).collect() == []
    assert [r.log_id for r in space.iter_log_range(3, -5, 1 << 63, 2).collect()] == [0, 1]
    assert space.read_log(3, 1234) == b"secret-payload-1234" and space.read_log(3, 4000) is None
    for bad in (lambda: space.read_log(3, -1), lambda: space.begin_tx().delete_log(3, -1), lambda: space.begin_tx().delete_log(3, 1 << 63)):
        with pytest.raises(Malformed):
            bad()


def test_a_frame_that_races_loses_no_commit(spark, container, space):
    other = Container.open(spark, container.root).open_space("pw")
    write = space._write

    def interleaved(namespace, rows, parts):
        out = write(namespace, rows, parts)
        other.commit([("put", 2, b"k", b"v")])
        return out

    space._write = interleaved
    big_log(spark, container, space, 100)
    assert space.get(2, b"k") == b"v" and space.count(3) == 100 and space.commit_history() == [1, 2, 3]

    def overtaken(namespace, rows, parts):
        out = write(namespace, rows, parts)
        other.commit([("append_log", 3, 5000, b"x")])
        return out

    space._write = overtaken
    with pytest.raises(Busy):
        big_log(spark, container, space, 100)
    assert other.read_log(3, 5000) == b"x"
    # files that no version names stay while a transaction may still publish them
    assert space.vacuum() == 0 and space.vacuum(0) > 0 and other.count(3) == 101 and other.verify()["entries"] == 102


def test_keys_compaction_lease_and_budget(spark, container, space):
    from ledgerlake.functions import crypto

    assert space.commit([("put", 1, b"k", b"v"), ("append_log", 3, 7, b"m")]) == 2 and space.commit([]) == 2
    with pytest.raises(Malformed):
        space.commit([("grow", 1)])
    keys = container.derive_space_keys("pw")
    assert keys == space.space_keys() and "Redacted" in repr(keys) and container.open_space_with_keys(keys).get(1, b"k") == b"v"
    with pytest.raises(AuthFailed):
        container.open_space_with_keys(crypto.Redacted(b"x" * 64))
    with pytest.raises(Malformed):
        crypto.decode_space_keys(b"x" * 63)
    container.create_space("other")
    for i in range(3):
        space.commit([("put", 1, b"k", b"%d" % i)])
    small = container.compact(["pw"])
    now = small.open_space("pw", verify=True)
    assert now.get(1, b"k") == b"2" and now.read_log(3, 7) == b"m" and now.space_keys() == keys
    with pytest.raises(AuthFailed):
        small.open_space("other")
    held = Container.open(spark, container.root, readonly=True, exclusive=True)
    with pytest.raises(Busy):
        Container.open(spark, container.root, exclusive=True)
    held.close()
    Container.open(spark, container.root, exclusive=True).close()
    small.write_budget = 10
    with pytest.raises(PayloadTooLarge):
        now.commit([("put", 1, b"z", b"1")])
    assert now.acknowledge_hardening_error() is None is now.last_publish_error()
    # cost parameters count: each changes the key, and none is cut off
    made = {crypto.derive_master("p", b"s" * 32, m, t, p) for m, t, p in ((8192, 2, 1), (16384, 2, 1), (8192, 3, 1), (8192, 2, 2))}
    assert len(made) == 4
    assert all(5 <= crypto.maintenance_delay_ms(5, 9) <= 9 for _ in range(50)) and len(crypto.random_bytes(9)) == 9
    with pytest.raises(ValueError):
        crypto.maintenance_delay_ms(0, 1 << 32)


def test_point_reads_share_a_bounded_cache(spark, container, space):
    from ledgerlake.sources.store import BatchCache

    big_log(spark, container, space, 300)
    jobs = []
    after = space.iter_log_after
    space.iter_log_after = lambda *a: jobs.append(a) or after(*a)
    assert [space.read_log(3, i) for i in (10, 11, 70, 73, 10, 299, 500)] == [b"secret-payload-%d" % i for i in (10, 11, 70, 73, 10, 299)] + [None]
    assert len(jobs) == 2 and space.read_log(9, 5) is None
    space.commit([("append_log", 3, 11, b"new")])
    assert space.read_log(3, 11) == b"new"
    cache = BatchCache(entries=3, size=1000)
    for i in range(6):
        cache.put(1, 3, i * 10, i * 10 + 9, {i * 10: b"x" * 100})
    assert [cache.get(1, 3, i * 10)[0] for i in range(6)] == [False] * 3 + [True] * 3 and cache.get(1, 3, 55) == (True, None)
    cache.put(1, 3, 90, 99, {90: b"y" * 700})
    assert cache.held <= 1000 and cache.get(1, 3, 90) == (True, b"y" * 700) and cache.get(2, 3, 90) == (False, None)
    cache.put(2, 3, 0, 9, {0: b"z" * 2000})
    assert cache.get(2, 3, 0) == (False, None)


def test_handles_for_other_callers(spark, container, space):
    import asyncio

    from ledgerlake.mirrors import AsyncSpaceHandle, MultiSpaceHandle, SpaceHandle

    h = SpaceHandle(space)
    assert h.commit([("put", 1, b"a", b"1"), ("put", 1, b"b", b"2"), *(("append_log", 3, i, b"%d" % i) for i in range(1, 8))]) == 2
    assert h.get(1, b"a") == b"1" and h.list_keys(1) == [b"a", b"b"] and h.list_keys_after(1, b"a", 9) == [b"b"] and h.list_after(1, None, 1) == [(b"a", b"1")]
    assert h.log_after(3, 5, 9) == [(6, b"6"), (7, b"7")] and h.log_before(3, 3, 1) == [(2, b"2")] and h.log_range(3, 2, 4, 9) == [(2, b"2"), (3, b"3")]
    assert h.stats()["entries"] == 9 and h.stats()["hardening_error"] is None and h.commit_seq() == 2 and h.verify()["entries"] == 9
    for bad in (lambda: h.get(0, b"a"), lambda: h.list_keys(0), lambda: h.read_log(0, 1), lambda: h.commit([("put", 0, b"a", b"")]), lambda: h.count(256)):
        with pytest.raises(Malformed):
            bad()
    with pytest.raises(AttributeError):
        h.root_of

    async def main():
        a = AsyncSpaceHandle(h)
        assert await a.get(1, b"b") == b"2" and await a.count(3) == 7 and await a.commit([("erase", 1)]) == 3
        assert [[r.log_id for r in p] async for p in a.pages_after(3, 2, 3)] == [[3, 4, 5], [6, 7]]
        assert [[r.log_id for r in p] async for p in a.pages_before(3, None, 4)] == [[7, 6, 5, 4], [3, 2, 1]]
        assert [[r.log_id for r in p] async for p in a.range_pages(3, 2, 5, 2)] == [[2, 3], [4]]
        gate = threading.Event()
        h.wait = gate.wait
        task = asyncio.ensure_future(a.call("wait"))
        await asyncio.sleep(0.1)
        task.cancel()
        with pytest.raises(asyncio.CancelledError):
            await task
        gate.set()
        await a.commit_seq()
        assert [s for _, s in a.ledger.abandoned_operations()] == ["succeeded"]

    asyncio.run(main())
    several = MultiSpaceHandle(container)
    one, two = several.open_space("pw"), several.create_space("second")
    several.commit(two, [("put", 1, b"k", b"v")])
    assert several.get(two, 1, b"k") == b"v" and several.get(one, 1, b"k") is None and several.count(one, 3) == 7 and len(several) == 2


def test_command_line(spark, tmp_path):
    path, said = str(tmp_path / "c"), []
    call = lambda *a, lines=("pw",): cli.main(list(a), spark, io.StringIO("\n".join(lines)), said.append)
    assert call("create", path, "--params", "min") == 0 and call("create-space", path) == 0
    assert call("put", path, "1", "k", "v") == 0 and call("put", path, "1", "l", lines=("pw", "w")) == 0
    assert call("get", path, "1", "k") == 0 and said[-1] == "v" and call("get", path, "1", "x") == 2
    assert call("verify", path) == 0 and call("dump-stats", path) == 0 and call("info", path) == 0 and call("repack", path, str(tmp_path / "d")) == 0
    assert call("get", path, "1", "k", lines=("bad",)) == 1 and "AuthFailed" in said[-1]


def test_ledger():
    ledger, gate = runtime.Ledger(2), threading.Event()
    one, first = ledger.run(gate.wait)
    two, second = ledger.run(lambda: 1)
    ledger.abandon(one, first)
    ledger.abandon(two, second)
    gate.set()
    first.result()
    assert dict(ledger.abandoned_operations()) == {one: "succeeded", two: "never_started"}
    assert ledger.clear_settled_operations() == 2 and not runtime.may_have_mutated("never_started")
