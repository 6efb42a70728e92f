"""URL filters: all glob rules are matched at once by bit-parallel Shift-And.

A glob over ``host + path + ?query``: ``*`` stands for any characters but
``/ ? #``, ``**`` for any at all, a backslash makes the next character literal.
Every rule is a chain of states, one bit each; the bits of all rules lie one
after the other in 64-bit words. Reading a byte c moves all chains of all
URLs of a batch at once: ``state = (state << 1) & accepts[c] | state & loops[c]``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATORS = b"/?#"


class HostRule(NamedTuple):
    """Fits a host and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def globs(self) -> tuple[str, str]:
        literal = "".join(f"\\{c}" if c in "*\\" else c for c in self.text)
        return f"{literal}**", f"*.{literal}**"


class GlobRule(NamedTuple):
    glob: str
    verdict: str


HOST_RULES = (
    HostRule("net", "/", "block"),
    HostRule("example.net", "/en/", "allow"),
    HostRule("example.com", "/de/", "block"),
    HostRule("org", "/fr/", "allow"),
)

#: For URLs that no host rule fits: pages that repeat others or hold no prose.
GLOB_RULES = (
    GlobRule("**?**utm_source=**", "block"),
    GlobRule("**?**utm_medium=**", "block"),
    GlobRule("**?**sessionid=**", "block"),
    GlobRule("**?**sort=**", "block"),
    GlobRule("**/login**", "block"),
    GlobRule("**/signup**", "block"),
    GlobRule("**/cart/**", "block"),
    GlobRule("**/wp-admin/**", "block"),
    GlobRule("**/tag/*/page/**", "block"),
    GlobRule("ads.*/**", "block"),
    GlobRule("*.ads.*/**", "block"),
    GlobRule("**.jpg", "block"),
    GlobRule("**.png", "block"),
    GlobRule("**.zip", "block"),
    GlobRule("**.exe", "block"),
    GlobRule("**/login-help/**", "allow"),
)


class Automaton:
    """The masks of a list of globs."""

    def __init__(self, globs: list[str]):
        chains = [self._tokens(glob) for glob in globs]
        states = sum(len(tokens) for tokens in chains)
        self.words = max(1, -(-states // 64))
        accepts, loops = np.zeros((256, self.words * 64), bool), np.zeros((256, self.words * 64), bool)
        first = np.zeros(self.words * 64, bool)
        self.final: list[int] = []
        at = 0
        for tokens in chains:
            first[at] = True
            for place, (byte, loop) in enumerate(tokens):
                if place:
                    accepts[byte, at + place] = True
                if loop:
                    loops[:, at + place] = True
                if loop == 1:
                    loops[list(SEPARATORS), at + place] = False
            at += len(tokens)
            self.final.append(at - 1)
        self.accepts, self.loops, self.first = map(self._pack, (accepts, loops, first[None]))

    @staticmethod
    def _tokens(glob: str) -> list[tuple[int | None, int]]:
        """States as (byte that leads there, loop): loop 1 stays on all but separators, 2 on any byte."""
        tokens: list[tuple[int | None, int]] = [(None, 0)]
        chars, i = glob.encode(), 0
        while i < len(chars):
            if chars[i : i + 1] == b"*":
                wide = 2 if chars[i : i + 2] == b"**" else 1
                tokens[-1] = (tokens[-1][0], max(wide, tokens[-1][1]))
                i += wide
                continue
            i += chars[i : i + 1] == b"\\"
            tokens.append((chars[i], 0))
            i += 1
        return tokens

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=1, bitorder="little").view("<u8")

    def matches(self, urls: list[bytes]) -> np.ndarray:
        """Boolean matrix: URL by rule."""
        lengths = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(urls) + b"\0", np.uint8)
        begins = (np.cumsum(lengths) - lengths)[order]
        state = np.repeat(self.first, len(urls), axis=0)
        active = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
        for step, live in enumerate(active.tolist()):  # the longest URLs come first
            byte = data[begins[:live] + step]
            now = state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.accepts[byte]) | (now & self.loops[byte])
        out = np.empty((len(urls), len(self.final)), bool)
        for k, bit in enumerate(self.final):
            out[order, k] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) != 0
        return out


def url_verdicts(
    pages: DataFrame, host_rules: tuple[HostRule, ...] = HOST_RULES, glob_rules: tuple[GlobRule, ...] = GLOB_RULES
) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, glob``.

    ``rule``: the longest host rule that fits (null: none); ``glob``: else the
    longest glob that fits; ``verdict``: its verdict, ``allow`` if nothing fits. Among
    equally long ones the first in the list wins. A null URL, or one without
    ``://``, has an empty host and path and is allowed. Rows that repeat a page_id
    are judged each; only ``page_id`` and ``url`` are read.
    """
    parts = r"://([^/?#]*)([^?#]*)(\?[^#]*)?"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    url = F.coalesce("url", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("string"),  # as text, which pandas leaves as it is
        F.translate(F.regexp_extract(url, parts, 1), upper, upper.lower()).alias("host"),
        F.regexp_extract(url, parts, 2).alias("path"),
        F.regexp_extract(url, parts, 3).alias("query"),
    )

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host_globs = [g for rule in host_rules for g in rule.globs()]
        automaton = Automaton(host_globs + [rule.glob for rule in glob_rules])
        by_host = sorted(range(len(host_rules)), key=lambda i: -len(host_rules[i].text))
        by_glob = sorted(range(len(glob_rules)), key=lambda i: -len(glob_rules[i].glob))
        for frame in frames:
            canonical = [u.encode() for u in frame["host"] + frame["path"] + frame["query"]]
            hits = automaton.matches(canonical)
            rule, glob = np.full(len(frame), None, object), np.full(len(frame), None, object)
            verdict = np.full(len(frame), "allow", object)
            open_ = np.ones(len(frame), bool)
            for i in by_host:
                fits = open_ & (hits[:, 2 * i] | hits[:, 2 * i + 1])
                rule[fits], verdict[fits] = host_rules[i].text, host_rules[i].verdict
                open_ &= ~fits
            for i in by_glob:
                fits = open_ & hits[:, len(host_globs) + i]
                glob[fits], verdict[fits] = glob_rules[i].glob, glob_rules[i].verdict
                open_ &= ~fits
            yield frame.assign(rule=rule, verdict=verdict, glob=glob)[
                ["page_id", "host", "path", "rule", "verdict", "glob"]
            ]

    kind = pages.schema["page_id"].dataType.simpleString()
    judged = rows.mapInPandas(judge, "page_id string, host string, path string, rule string, verdict string, glob string")
    return judged.withColumn("page_id", F.col("page_id").cast(kind))
