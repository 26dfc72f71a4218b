"""Opaque references and cursors, public projections, canonical JSON."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIXES = {"content": "cr1_", "catalog": "cc1_", "body": "bc1_"}
# Which fields a public result may show.
INTERNAL = ("mtime_ns", "size_bytes", "normalized_terms", "frontmatter", "vault_root")
INTEGRITY = ("content_hash", "original_hash", "redacted_hash", "source_hash", "sha256")
LOCATOR = ("path", "page_path", "src", "dst", "source_path", "url")


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def encode(kind: str, payload: Mapping) -> str:
    return PREFIXES[kind] + base64.urlsafe_b64encode(canonical(payload).encode()).decode().rstrip("=")


def decode(kind: str, value: str) -> dict:
    prefix = PREFIXES[kind]
    if not value.startswith(prefix):
        raise ValueError(f"not a {kind} reference")
    raw = value[len(prefix) :]
    try:
        got = json.loads(base64.b64decode(raw + "=" * (-len(raw) % 4), b"-_", validate=True))
    except ValueError as e:
        raise ValueError(f"not a {kind} reference") from e
    if not isinstance(got, dict):
        raise ValueError(f"not a {kind} reference")
    return got


def content_ref(vault: str, scope: Column, kind: Column, identity: Column) -> Column:
    """Content references as a Column; the same strings as encode()."""
    payload = F.to_json(F.struct(identity.alias("identity"), kind.alias("kind"), scope.alias("scope"), F.lit(vault).alias("vault")))
    return F.concat(F.lit(PREFIXES["content"]), F.rtrim(F.translate(F.regexp_replace(F.base64(F.encode(payload, "utf-8")), "[\r\n]", ""), "+/=", "-_ ")))


def field_class(name: str) -> str:
    return "internal" if name in INTERNAL else "integrity" if name in INTEGRITY else "locator" if name in LOCATOR else "display"


def public(df: DataFrame, policy: str = "display") -> DataFrame:
    """Fields a policy shows: display leaves out internal and integrity fields, audit internal ones only. Locators outside the vault become null."""
    hidden = {"internal", "integrity"} if policy == "display" else {"internal"}
    out = []
    for name, kind in df.dtypes:
        if (cls := field_class(name)) in hidden:
            continue
        c = F.col(name)
        if cls == "locator" and kind == "string":
            c = F.when(c.rlike(r"^(/|[A-Za-z]:|\\\\)") | c.rlike(r"(^|/)\.\.(/|$)"), None).otherwise(c)
        out.append(c.alias(name))
    return df.select(*out)


def batch_token(question: str, scope: str, offset: int) -> str:
    return f"{hashlib.sha256(canonical([question, scope]).encode()).hexdigest()[:32]}:{offset}"


def read_batch_token(token: str, question: str, scope: str) -> int:
    head, _, offset = token.partition(":")
    if head != batch_token(question, scope, 0).partition(":")[0] or not offset.isdigit():
        raise ValueError("the token belongs to another question")
    return int(offset)
