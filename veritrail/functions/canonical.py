"""Canonical JSON (RFC 8785) and the digests over it."""

from __future__ import annotations

import hashlib
import json
import math
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError

UNDEFINED = object()


def _number(value: float) -> str:
    """A double the way ECMAScript prints it."""
    if not math.isfinite(value):
        raise EngineError("non_finite_number")
    if value == 0:
        return "0"
    sign, digits, exponent = ("-" if value < 0 else ""), *_shortest(abs(value))
    point = exponent + len(digits)  # digits before the decimal point
    if 0 < point <= 21:
        body = digits + "0" * (point - len(digits)) if point >= len(digits) else f"{digits[:point]}.{digits[point:]}"
    elif -6 < point <= 0:
        body = "0." + "0" * -point + digits
    else:
        body = f"{digits[0]}{'.' + digits[1:] if digits[1:] else ''}e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return sign + body


def _shortest(value: float) -> tuple[str, int]:
    mantissa, _, power = f"{value!r}".partition("e")
    whole, _, fraction = mantissa.partition(".")
    fraction = "" if fraction == "0" else fraction
    digits, exponent = whole + fraction, int(power or 0) - len(fraction)
    stripped = digits.rstrip("0")
    return stripped.lstrip("0"), exponent + len(digits) - len(stripped)


def canonical_json(value: Any) -> str:
    """Sorted by UTF-16 code unit, no white space; refuses what JSON cannot hold."""
    if value is UNDEFINED:
        raise EngineError("undefined_root")
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int | float):
        return _number(float(value))
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False).replace("\x7f", "\x7f")
    if isinstance(value, list | tuple):
        if any(item is UNDEFINED for item in value):
            raise EngineError("unsupported_type", "undefined in an array")
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, dict):
        keys = sorted((k for k in value if value[k] is not UNDEFINED), key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{canonical_json(k)}:{canonical_json(value[k])}" for k in keys) + "}"
    raise EngineError("unsupported_type", type(value).__name__)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def utf16_length(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def content_digest(salt: str, content: Any) -> str:
    return sha256(f"{utf16_length(salt)}:{salt}{canonical_json(content)}")


def record_digest(kind: str, id_: str, seq: int, prev: str | None, digest: str, meta: Any) -> str:
    return sha256(canonical_json({"contentDigest": digest, "id": id_, "kind": kind, "meta": meta, "prev": prev, "seq": seq}))


@F.pandas_udf(T.StringType())
def canonicalise(texts: pd.Series) -> pd.Series:
    """Any JSON text in its canonical form; null where it is not JSON."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else canonical_json(json.loads(text, parse_constant=_refuse))
        except (ValueError, EngineError):
            return None

    return texts.map(one)


def _refuse(name: str) -> None:
    raise EngineError("non_finite_number", name)


def content_digest_column(salt: Column, canonical: Column) -> Column:
    """Digest of content that is canonical already (ASCII salts)."""
    return F.sha2(F.concat(F.length(salt).cast("string"), F.lit(":"), salt, canonical).cast("binary"), 256)


def quoted(value: Column) -> Column:
    """A string as a JSON string: what ``to_json`` escapes is what JSON asks for."""
    return F.when(value.isNotNull(), F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1))


def record_digest_column(kind: Column, id_: Column, seq: Column, prev: Column, digest: Column, meta: Column) -> Column:
    """Digest over the canonical form of the six attested fields; ``meta`` is canonical JSON."""
    text = F.concat(
        F.lit('{"contentDigest":"'), digest, F.lit('","id":'), quoted(id_), F.lit(',"kind":'), quoted(kind), F.lit(',"meta":'), F.coalesce(meta, F.lit("{}")),
        F.lit(',"prev":'), F.coalesce(quoted(prev), F.lit("null")), F.lit(',"seq":'), seq.cast("string"), F.lit("}"),
    )
    return F.sha2(text.cast("binary"), 256)
