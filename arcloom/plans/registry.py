"""Named queries, each next to the SQL that must give the same rows."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SHARED: dict[str, tuple[tuple[str, ...], str]] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir)``; ``uses`` names shared table expressions the SQL needs."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_shared(uses, sql)
        return fn

    return add


def shared(name: str, sql: str, uses: tuple[str, ...] = ()) -> None:
    SHARED[name] = (uses, sql)


def with_shared(uses, sql: str) -> str:
    wanted: list[str] = []

    def need(name):
        for dep in SHARED[name][0]:
            need(dep)
        if name not in wanted:
            wanted.append(name)

    for name in uses:
        need(name)
    head = ", ".join(f"{n} AS ({SHARED[n][1].strip()})" for n in wanted)
    return f"WITH {head} {sql.strip()}" if head else sql.strip()


def u01(text: str) -> str:
    """SQL for the uniform in [0, 1) of a text expression."""
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT / 4503599627370496.0)"
