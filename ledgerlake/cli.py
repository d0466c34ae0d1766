"""Command line: info, create, create-space, inspect, get, put, verify, dump-stats, repack. Passwords come from standard input, a line each."""

from __future__ import annotations

import argparse
import json
import sys

from .errors import EngineError
from .sources.store import Container


def read_lines(stream, most: int = 64, longest: int = 4096) -> list[str]:
    out = []
    for line in stream:
        line = line.rstrip("\r\n")
        if len(line) > longest or len(out) >= most:
            raise EngineError("too much on standard input")
        out.append(line)
    return out


def shown(value: bytes) -> str:
    try:
        return value.decode()
    except UnicodeDecodeError:
        return value.hex()


def main(argv: list[str] | None = None, spark=None, stdin=None, out=print) -> int:
    parser = argparse.ArgumentParser(prog="ledgerlake")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, *more in (("info",), ("create",), ("create-space",), ("inspect",), ("get", "namespace", "key"), ("put", "namespace", "key", "value"), ("verify",), ("dump-stats",), ("repack", "to")):
        p = sub.add_parser(name)
        p.add_argument("path")
        for x in more:
            p.add_argument(x, nargs="?" if x == "value" else None)
        if name == "create":
            p.add_argument("--params", choices=("min", "light", "default", "heavy"), default="default")
    a = parser.parse_args(argv)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
    try:
        if a.command == "create":
            Container.create(spark, a.path, a.params)
            return 0
        container = Container.open(spark, a.path, a.command not in ("put", "create-space"))
        if a.command == "info":
            out(json.dumps({k: v for k, v in container.header().items() if k != "salt"}))
            return 0
        lines = read_lines(stdin or sys.stdin)
        if not lines:
            raise EngineError("no password")
        if a.command == "create-space":
            container.create_space(lines[0])
        elif a.command == "repack":
            container.repack(a.to, lines)
        else:
            space = container.open_space(lines[0])
            if a.command == "get":
                value = space.get(int(a.namespace), a.key.encode())
                if value is None:
                    return 2
                out(shown(value))
            elif a.command == "put":
                tx = space.begin_tx()
                tx.put(int(a.namespace), a.key.encode(), (a.value if a.value is not None else lines[1]).encode())
                tx.commit()
            elif a.command == "verify":
                out(json.dumps(space.verify()))
            else:
                out(json.dumps(space.stats()))
        return 0
    except EngineError as e:
        out(f"error: {type(e).__name__}: {e}")
        return 1


if __name__ == "__main__":
    sys.exit(main())
