"""Qualified identifiers (namespace/name) in questions: their parts and spellings, and the plan of a question."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# What a qualified identifier looks like. With a slash; with a hyphen, an underscore or blanks; written as one word; and
# what tells that a text has an explicit boundary.
SLASHED = r"(?i)(?<![a-z0-9_])([a-z][a-z0-9.]*)(/)([a-z][a-z0-9_-]*(?:/[a-z][a-z0-9_-]*)*)(?![a-z0-9_/])"
SPACED = r"(?i)(?<![a-z0-9_])([a-z][a-z0-9.]*)([-_]|[ \t]+)([a-z][a-z0-9_-]*)(?![a-z0-9_/])"
COMPACT = r"[A-Z][a-z][a-z0-9_]*"
SAFE_COMPACT = r"[A-Za-z][a-z][a-z0-9_]*"
EXPLICIT = r"[A-Za-z0-9]/[A-Za-z0-9]|[A-Za-z0-9][-_][A-Za-z0-9]"
BRACKETS, STOPS = "`*_[](){}<>", ".,:;!?。？！"
JOINTS = ("/", " ", "", "-", "_")


@dataclass(frozen=True)
class Identifier:
    """A namespace and a name as written, in parts. raw: the whole as written."""

    namespace: tuple[str, ...]
    name: tuple[str, ...]
    raw: str

    @classmethod
    def of(cls, namespace: str, name: str, raw: str) -> Identifier:
        parts = tuple(filter(None, namespace.split("."))), tuple(filter(None, name.split("/")))
        if not all(parts):
            raise ValueError(f"no namespace or no name: {raw!r}")
        return cls(*parts, raw.strip())

    @property
    def segments(self) -> list[str]:
        return [x.casefold() for x in (*self.namespace, *self.name)]

    @property
    def canonical(self) -> str:
        return self._joined("/").casefold()

    @property
    def aliases(self) -> list[str]:
        """Spellings, once each: as written, joined in each way, the same in small letters."""
        shown = [self._joined(j) for j in JOINTS]
        return list(dict.fromkeys(x for x in (self.raw, *shown, *map(str.casefold, shown), self.canonical) if x))

    def _joined(self, joint: str) -> str:
        return ".".join(self.namespace) + joint + "/".join(self.name)


def parse(value: str) -> Identifier:
    """One identifier. A compact form is cut where a capital follows, else behind its first letter."""
    raw = value.strip().strip(BRACKETS).rstrip(STOPS)
    for pattern in (SLASHED, SPACED):
        if m := re.fullmatch(pattern, raw):
            return Identifier.of(m[1], m[3], raw)
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_]*", raw):
        raise ValueError(f"not a qualified identifier: {value!r}")
    camel = re.search(r"(?<=[a-z0-9])(?=[A-Z])", raw)
    if camel is None and len(raw) < 3:
        raise ValueError(f"too short for a qualified identifier: {value!r}")
    cut = camel.start() if camel else 1
    return Identifier.of(raw[:cut], raw[cut:], raw)


def extract(text: str) -> list[Identifier]:
    """Identifiers of a text in order, once each. A blank joins only to a one-letter namespace; a compact form must be the whole text."""
    spans = sorted((m.span(), m[1], m[2], m[3], m[0]) for p in (SLASHED, SPACED) for m in re.finditer(p, text))
    found = [Identifier.of(a, b, raw) for _, a, joint, b, raw in spans if len(a) == 1 or not joint.isspace() if a.strip(".") and b.strip("/")]
    whole = text.strip()
    if re.fullmatch(COMPACT, whole) and len(whole) > 2 and not re.search(EXPLICIT, text):
        found.append(parse(whole))
    once: dict[str, Identifier] = {}
    for x in found:
        once.setdefault(x.canonical, x)
    return list(once.values())


def asked(text: str) -> list[Identifier]:
    """What a search for qualified code looks for: the identifiers of a question, or the one that it is as a whole word."""
    found = extract(text)
    whole = text.strip()
    if not found and len(whole) > 2 and re.fullmatch(SAFE_COMPACT, whole):
        found = [parse(whole)]
    return found


IDENTIFIERS = "array<struct<canonical:string,segments:array<string>,compact:string,aliases:array<string>>>"


def _column(text: Column, find) -> Column:
    """IDENTIFIERS that find makes of a text. Questions are short, so their parsing is Python's."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"canonical": x.canonical, "segments": x.segments, "compact": "".join(x.segments), "aliases": x.aliases} for x in find(t or "")])

    return F.pandas_udf(run, IDENTIFIERS)(text)


def identifiers(question: Column | str) -> Column:
    """IDENTIFIERS that a search for a question looks for."""
    return _column(T.text_of(question), asked)


def query_plan(question: Column | str) -> Column:
    """latin_terms, cjk_terms, qualified_identifiers, namespace_wildcards and discovery_intent of a question."""
    folded = T.casefold(question)
    latin = F.filter(F.regexp_extract_all(folded, F.lit(T.LATIN), F.lit(0)), lambda w: ~w.isin(*T.STOPWORDS))
    cjk = F.flatten(F.transform(F.regexp_extract_all(folded, F.lit(T.CJK_RUN), F.lit(0)), T.pairs_of))
    wildcards = T.namespace_wildcards(question)
    return F.struct(latin.alias("latin_terms"), cjk.alias("cjk_terms"), _column(T.text_of(question), extract).alias("qualified_identifiers"), wildcards.alias("namespace_wildcards"), (F.size(wildcards) > 0).alias("discovery_intent"))
