"""Operator 3, URL rules by a bit-parallel wildcard automaton.

All globs are packed into one bit vector of as many 64-bit words as they need. For each
byte of a canonical URL the vector is shifted and masked once (Shift-And), so every rule
is followed at the same time; wildcards are states that may stay. A batch of URLs goes
through together, one numpy step a byte position.

Glob signs: "?" one byte, "*" any bytes but "/", "**" any bytes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLASH = ord("/")


@dataclass(frozen=True)
class Rule:
    """A host with a path prefix; it fits the host and all its subdomains."""

    name: str
    allow: bool

    @property
    def glob(self) -> str:
        host, slash, path = self.name.partition("/")
        return f"*.{host}{slash}{path}**"


@dataclass
class Automaton:
    """Masks of all globs: step[c] says which states byte c enters, stay[c] in which it may rest."""

    globs: list[str]
    step: np.ndarray = field(init=False)
    stay: np.ndarray = field(init=False)
    first: np.ndarray = field(init=False)
    final: list[tuple[int, int]] = field(init=False)

    def __post_init__(self) -> None:
        plans = []
        for g in self.globs:
            raw, signs, i = g.encode(), [], 0
            while i < len(raw):
                if raw[i : i + 2] == b"**":
                    signs.append(None)
                    i += 2
                    continue
                signs.append(raw[i : i + 1])
                i += 1
            plans.append(signs)
        states = sum(1 + sum(s not in (None, b"*") for s in p) for p in plans)
        words = max(1, -(-states // 64))
        self.step, self.stay = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
        self.first, self.final, at = np.zeros(words, np.uint64), [], 0
        every = np.arange(256)
        for p in plans:
            self.first[at // 64] |= np.uint64(1 << (at % 64))
            for s in p:
                if s in (None, b"*"):
                    self.stay[every if s is None else every != SLASH, at // 64] |= np.uint64(1 << (at % 64))
                    continue
                at += 1
                self.step[every if s == b"?" else s[0], at // 64] |= np.uint64(1 << (at % 64))
            self.final.append((at // 64, at % 64))
            at += 1

    def match(self, urls: list[bytes]) -> np.ndarray:
        """A row per URL, a column per glob: whether it fits the whole URL."""
        size = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(-size, kind="stable")
        data, start = np.frombuffer(b"".join(urls), np.uint8), np.concatenate([[0], np.cumsum(size)[:-1]]) if len(urls) else np.zeros(0, np.int64)
        size, start = size[order], start[order]
        now = np.tile(self.first, (len(urls), 1))
        for i in range(int(size[0]) if len(urls) else 0):
            live = int(np.searchsorted(-size, -i, "left"))  # those longer than i; the rest has ended
            c, d = data[start[:live] + i], now[:live]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            now[:live] = (moved & self.step[c]) | (d & self.stay[c])
        out = np.zeros((len(urls), len(self.globs)), bool)
        for k, (word, bit) in enumerate(self.final):
            out[order, k] = (now[:, word] >> np.uint64(bit)) & np.uint64(1)
        return out


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; else empty."""
    from lumenfold.llm.common import fold_ascii

    return fold_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: list[Rule], default_allow: bool = True, key: str = "page_id") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    The canonical URL is "." + host + path. Of the rules that fit, the longest name
    wins, a block before an allow of the same name; with none, rule is null and the
    verdict is the default. A null URL or one without "://" has empty host and path.
    Very long URLs are followed whole. Repeated rows and null ids are judged each; other
    columns are ignored, whatever their names. Empty in, empty out.
    """
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.allow, r.name))
    machine = Automaton([r.glob for r in ranked])

    @F.pandas_udf("int")
    def first_rule(urls: pd.Series) -> pd.Series:
        hits = machine.match([u.encode() for u in urls])
        return pd.Series(np.where(hits.any(axis=1), hits.argmax(axis=1), -1).astype(np.int32))

    rows = pages.select(key, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    at = first_rule(F.concat(F.lit("."), "host", "path"))
    rows = rows.withColumn("at", at)
    names = F.array(*[F.lit(r.name) for r in ranked])
    verdicts = F.array(*[F.lit("allow" if r.allow else "block") for r in ranked])
    pick = lambda values, other: F.when(F.col("at") < 0, other).otherwise(F.element_at(values, F.greatest(F.col("at"), F.lit(0)) + 1))
    return rows.select(key, "host", "path", pick(names, F.lit(None).cast("string")).alias("rule"), pick(verdicts, F.lit("allow" if default_allow else "block")).alias("verdict"))
