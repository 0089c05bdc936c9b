"""Secret scanning: fixed patterns, and novelty by dictionary-primed Zstandard.

The novelty scan takes long strings that follow a sensitive word and measures their marginal size: the bytes
that the compressed surroundings grow by when the string is put into them, with a dictionary of code
identifiers primed. Names and repeated values cost a few bytes; generated secrets cost nearly their length.
"""

from __future__ import annotations

import hashlib
import importlib
import inspect
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import schema_of, table
from tessera.llm.token_ids import slices

KINDS = ("assign", "access", "hex", "novel")

#: The base patterns, and how many characters (of group 2, or of the match) a match must have.
_BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),  # runs are maximal, so shorter ones need not be matched to be dropped
)

#: Candidates of the novelty scan: a sensitive word, a little in between or the end of its line, and a string of 16 characters or more. Dots join parts and '=' pads at the end.
_SENSITIVE = re.compile(
    r"(?:passw|pwd|secret|token|key|auth|bearer|credential|private|signature|session)[^\n]{0,24}?(?:\n[\x20\t]*(?:-\x20+)?[\"'`]?)?"
    r"(?<![A-Za-z0-9+/_.-])([A-Za-z0-9+/_-][A-Za-z0-9+/_.-]{14,}[A-Za-z0-9+/_-]={0,2})",
    re.ASCII | re.IGNORECASE,
)

#: What stands before a value that is given to a name; there strings of letters alone are candidates too. Elsewhere they are long words.
_GIVEN = re.compile(r"(?:[:=]\s*[\"'`]?|[\"'`])\Z")

#: Generated strings have a long part between separators, with a digit in it or of letters that are given to a name, or are groups of hexadecimal digits; paths and file names have short parts.
_PARTS, _DIGITS_IN, _LETTERS_IN, _HEX_GROUPS = re.compile(r"[/._-]+"), 10, 16, re.compile(r"[0-9A-Fa-f]{4,}(?:-[0-9A-Fa-f]{4,}){3,}")

#: Characters of surroundings on either side, and the least share of a candidate's length that must be new. Generated strings cost 0.85 to 1.05 of it.
_AROUND, _NOVEL = 256, 0.85

#: The identifier dictionary's own part, as plain text: words of settings and requests, places of files, dates.
_IDENTIFIERS = """
access_token refresh_token client_id client_secret secret_key private_key public_key api_key api_token auth_token
session_id session_token user_name username password passwd authorization bearer signature credential credentials
environment variable config configuration settings default parameter argument function return class import from
getenv os.environ process.env application development production staging localhost example test sample placeholder
change_me your_api_key_here insert_token_here xxxxxxxxxxxxxxxx 0000000000000000 1234567890 abcdefghijklmnopqrstuvwxyz
ABCDEFGHIJKLMNOPQRSTUVWXYZ request response header content_type application/json string integer boolean null true
false index value values items length count number name description message error exception result data object
/usr/share/locale/en_US.UTF-8/LC_MESSAGES/ /usr/local/lib/ /usr/bin/ /etc/ssl/private/ /etc/ssl/certs/ /var/lib/ /var/log/ /home/user/
src/main/java/com/example/ src/test/resources/ org.springframework.security. node_modules/ webpack package.json dist/index.js docs/ assets/images/ v1/projects/locations/
2023-12-31T23:59:59Z 2024-01-01T00:00:00Z 2025-06-15 12:30:00 1970-01-01 Abstract Singleton Proxy Factory Bean Handler Controller Repository Service Impl
"""

#: Modules of the standard library whose names and documentation fill the dictionary up.
_DOCUMENTED = (
    "argparse asyncio collections configparser csv datetime email ftplib gettext http.client http.server imaplib json locale logging mailbox optparse os pathlib platform queue random re "
    "shutil smtplib socket sqlite3 ssl string subprocess sysconfig tarfile tempfile threading typing unittest urllib.parse urllib.request uuid wsgiref.handlers xml.dom.minidom zipfile"
).split()


@lru_cache(maxsize=1)
def identifier_dictionary() -> bytes:
    """Words of four letters or more in names and documentation of the standard library, the commonest last, then _IDENTIFIERS."""
    seen = Counter()
    for name in _DOCUMENTED:
        members = sorted(vars(importlib.import_module(name)).items())
        texts = [inspect.getdoc(importlib.import_module(name)) or ""]
        for member, value in members:
            texts.append(member)
            if inspect.isclass(value) or inspect.isfunction(value):
                texts.append(inspect.getdoc(value) or "")
            if inspect.isclass(value):
                texts += sorted(vars(value))
        seen.update(w for x in texts for w in re.findall("[A-Za-z]{4,}", x))
    return (" ".join(sorted(seen, key=lambda w: (seen[w], w))) + _IDENTIFIERS).encode()


@lru_cache(maxsize=2)
def _compressor(dictionary: bytes):
    import zstandard

    primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed.precompute_compress(level=3)
    return zstandard.ZstdCompressor(level=3, dict_data=primed, write_checksum=False, write_content_size=False)


def marginal_bytes(before: str, candidate: str, after: str, dictionary: bytes) -> int:
    """How much larger the compressed surroundings are with the candidate in them."""
    with_it = (before + candidate + after).encode("utf-8", "replace")
    without = (before + after).encode("utf-8", "replace")
    return len(_compressor(dictionary).compress(with_it)) - len(_compressor(dictionary).compress(without))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) in code points, in order."""
    out = []
    for kind, (_, pattern, group, least) in enumerate(_BASE):
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out)


def novel_spans(text: str, dictionary: bytes | None = None) -> list[tuple[int, int, int]]:
    """Candidates with a long part that holds a digit, or of letters given to a name, that are new to their surroundings and the dictionary; a base span may lie there too.

    Bounds: a candidate has 16 characters of A-Z, a-z, 0-9 and +/_.- at least, and follows a sensitive word on its line within
    24 characters, or on the next line. Shorter strings, those farther off, and letters in running prose are not looked at.
    """
    dictionary, out = dictionary or identifier_dictionary(), []
    for m in _SENSITIVE.finditer(text):
        start, end = m.span(1)
        candidate = m[1]
        parts = _PARTS.split(candidate)
        given = _GIVEN.search(text[max(0, start - 4) : start])
        if not (any(len(x) >= _DIGITS_IN and re.search("[0-9]", x) or given and len(x) >= _LETTERS_IN for x in parts) or _HEX_GROUPS.fullmatch(candidate)):
            continue
        if marginal_bytes(text[max(0, start - _AROUND) : start], candidate, text[end : end + _AROUND], dictionary) >= _NOVEL * len(candidate):
            out.append((start, KINDS.index("novel"), end))
    return out


def _digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _mapped(df: DataFrame, fields: str, one) -> DataFrame:
    """df's columns after the first, and what one(text) gives for the first, as columns of fields."""
    rest = df.schema.fields[1:]
    names = [x.split()[0] for x in fields.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(0)):
                own = batch.slice(first, len(texts))
                found = list(zip(*(one(x or "") for x in texts.to_pylist())))
                yield pa.RecordBatch.from_arrays([*own.columns[1:], *(pa.array(x, t) for x, t in zip(found, types))], [*(f.name for f in rest), *names])

    return df.mapInArrow(run, schema_of(df, [f.name for f in rest], fields))


def find_secrets(docs: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """keep, the number of spans of each base kind, base_sha256 of the base spans, and spans, all spans as kind:start:end.

    Spans are in code points with the end exclusive, by start and then kind. A null text is empty and has none.
    Repeated rows give a row each, and an empty table none. Whole texts are scanned where they are read; nothing is shuffled. Kept columns must not be named like the
    results; other columns of docs may have any name.
    """
    dictionary = identifier_dictionary()  # the driver's, so that all workers use the same

    def one(x: str) -> tuple:
        base = base_spans(x)
        counts = [sum(kind == k for _, kind, _ in base) for k in range(3)]
        return *counts, hashlib.sha256(_digest(base).encode()).hexdigest(), _digest(sorted(base + novel_spans(x, dictionary)))

    return _mapped(docs.select(F.col(text).alias("_text"), *keep), "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", one)


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[secret]", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, and text with every span replaced by the mark; spans that meet or overlap are replaced as one. Null stays null, repeated rows are changed alike, and an empty table stays empty."""
    dictionary = identifier_dictionary()

    def one(x: str) -> tuple[str]:
        base, out, at = base_spans(x), [], 0
        for start, _, end in sorted(base + novel_spans(x, dictionary)):
            if end > at:
                out += [x[at:start], mark] if start >= at and (start > at or not out) else []
                at = end
        return ("".join(out) + x[at:],)

    done = _mapped(docs.select(F.col(text).alias("_text"), F.col(text).isNull().alias("_null"), *keep), "_clean string", one)
    return done.select(*keep, F.when(~F.col("_null"), F.col("_clean")).alias(text))


def op2_secret_spans(spark, sf_dir: str) -> DataFrame:
    """The secrets in every document."""
    return find_secrets(table(spark, sf_dir, "documents"), ("doc_id",))
