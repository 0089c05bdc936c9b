"""URL rules by a bit-parallel wildcard automaton.

All rules are globs whose states are packed into the bits of a few 64-bit words. One step reads one byte of
every URL of a batch: states that accept the byte move on by a shift, states of a wildcard stay. Globs know
``*`` (a run without a slash) and ``**`` (any run). A rule for a host and a path becomes ``*.host/path**`` over
the canonical URL ``.host/path``; since hosts hold no slash, it fits the host, its subdomains, and any path
that begins with the rule's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import schema_of, table
from tessera.llm.token_ids import slices

_SLASH = ord("/")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}{self.path}**"


#: The rules that pages are judged by.
PAGE_RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


#: Pages whose canonical URL fits one of these are blocked where no rule fits: mobile copies, forms, listings, feeds and files that aren't text.
PAGE_GLOBS = (
    ".m.**", "**/login**", "**/signup**", "**/cart/**", "**/search/**", "**/tag/**", "**/feed/**", "**/wp-admin/**", "**/cgi-bin/**", "**.php",
    "**.exe", "**.zip", "**.pdf", "**.jpg", "**.png", "**.mp4",
)


class GlobAutomaton:
    """All globs at once; their states fill as many words as they need."""

    def __init__(self, globs: list[str]):
        parts = [self._elements(g) for g in globs]
        bits = sum(len(chars) + 1 for chars, _ in parts)
        words = -(-bits // 64)
        self.move, self.stay = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
        self.start, self.accept = np.zeros(words, np.uint64), []
        at = 0
        for chars, loops in parts:
            self._set(self.start, at)
            for k, c in enumerate(chars):
                self._set(self.move[c], at + k)
            for k, kind in loops.items():
                for b in range(256):
                    if kind == "**" or b != _SLASH:
                        self._set(self.stay[b], at + k)
            at += len(chars) + 1
            self.accept.append(((at - 1) // 64, np.uint64((at - 1) % 64)))

    @staticmethod
    def _set(words: np.ndarray, bit: int) -> None:
        words[bit // 64] |= np.uint64(1) << np.uint64(bit % 64)

    @staticmethod
    def _elements(glob: str) -> tuple[bytes, dict[int, str]]:
        """The literal bytes, and which wildcard stands before each (or at the end)."""
        chars, loops = bytearray(), {}
        for piece in re.findall(r"\*\*|\*|[^*]+", glob):
            if piece[0] == "*":
                loops[len(chars)] = piece
            else:
                chars += piece.encode()
        return bytes(chars), loops

    def matches(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """For each string (bytes of data from begins[k] to begins[k + 1]) and glob, whether the whole string fits."""
        sizes = np.diff(begins)
        order = np.argsort(-sizes, kind="stable")
        first, sizes = begins[:-1][order], sizes[order]
        state = np.tile(self.start, (len(sizes), 1))
        for k in range(int(sizes[0]) if len(sizes) else 0):
            n = int(np.searchsorted(-sizes, -k, "left"))  # strings longer than k
            byte = data[first[:n] + k]
            go = state[:n] & self.move[byte]
            carry = go >> np.uint64(63)
            go <<= np.uint64(1)
            go[:, 1:] |= carry[:, :-1]
            state[:n] = go | (state[:n] & self.stay[byte])
        out = np.empty((len(sizes), len(self.accept)), bool)
        for j, (word, bit) in enumerate(self.accept):
            out[order, j] = state[:, word] >> bit & np.uint64(1)
        return out


@dataclass(frozen=True)
class RuleSet:
    """Rules, and globs for the URLs that fit none."""

    rules: tuple[Rule, ...]
    globs: tuple[str, ...] = ()

    @cached_property
    def ordered(self) -> list[Rule]:
        """The longest first; of equally long ones the first given."""
        return sorted(self.rules, key=lambda r: -len(r.name))

    @cached_property
    def automaton(self) -> GlobAutomaton:
        return GlobAutomaton([*(r.glob for r in self.ordered), *self.globs])

    def fitting(self, urls: pa.Array) -> np.ndarray:
        """Number in ordered of the longest rule for each canonical URL; len(rules) if none but a glob fits, one more if nothing does."""
        urls = urls.cast(pa.binary())
        data = np.frombuffer(b"".join(urls.to_pylist()), np.uint8)
        begins = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(urls), np.int64))])
        hits, n = self.automaton.matches(data, begins), len(self.ordered)
        return np.column_stack([hits[:, :n], hits[:, n:].any(axis=1), np.ones(len(urls), bool)]).argmax(axis=1)


def filter_urls(df: DataFrame, url: str, rules: tuple[Rule, ...], keep: tuple[str, ...], globs: tuple[str, ...] = (), otherwise: str = "allow") -> DataFrame:
    """keep, host, path, rule and verdict for each row of df.

    Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; path: from there
    up to ``?``, ``#`` or the end. Both are empty where the URL is null or has no ``://``. The longest fitting
    rule decides, of equally long ones the first; where none fits, rule is null and the verdict is block if one of the
    globs fits the whole of ``.host/path``, else ``otherwise``. Repeated rows give a row each and an empty table none. No shuffle. Kept columns must
    not be named like the results; other columns of df may have any name.
    """
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(F.col(url), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    parts = df.select(*keep, F.translate(F.regexp_extract(text, pattern, 1), upper, upper.lower()).alias("host"), F.regexp_extract(text, pattern, 2).alias("path"))
    known = RuleSet(tuple(rules), tuple(globs))
    schema = schema_of(df, keep, "host string, path string, rule string, verdict string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*(r.name for r in known.ordered), None, None], pa.string())
        verdicts = pa.array([*(r.verdict for r in known.ordered), "block", otherwise], pa.string())
        for batch in batches:
            for first, urls in slices(batch.column(0)):
                own = batch.slice(first, len(urls))
                which = pa.array(known.fitting(urls))
                yield pa.RecordBatch.from_arrays([*own.columns[1:], names.take(which), verdicts.take(which)], [*own.schema.names[1:], "rule", "verdict"])

    canonical = F.concat(F.lit("."), "host", "path").alias("_url")
    return parts.select(canonical, *keep, "host", "path").mapInArrow(run, schema)


def op5_url_verdicts(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return filter_urls(table(spark, sf_dir, "pages"), "url", PAGE_RULES, ("page_id",), PAGE_GLOBS)


def _as_sql(glob: str) -> str:
    """A glob of PAGE_GLOBS, as SQL over u."""
    word = glob.strip("*")
    return f"starts_with(u, '{word}')" if not glob.startswith("**") else f"contains(u, '{word}')" if glob.endswith("**") else f"ends_with(u, '{word}')"


OP5_SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, regexp_extract(r, '^[^/?#]*') AS h, regexp_extract(substring(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest
), hosts AS (
  SELECT page_id, lowered AS host, path, '.' || coalesce(lowered, '') || coalesce(path, '') AS u
  FROM (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered, path FROM parts)
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), best AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM hosts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, CASE WHEN {' OR '.join(map(_as_sql, PAGE_GLOBS))} THEN 'block' ELSE 'allow' END) AS verdict FROM hosts LEFT JOIN best USING (page_id)
"""
