"""Personal data by anchor expansion (operator 8).

One Aho-Corasick automaton runs over the whole text and yields anchors: at-signs, plus signs, digits,
scheme separators and identifier cues. A local parser for the kind of each anchor expands it to the left
and right, and a check (octet range, Luhn, digit count, mod 97) accepts or drops the span. The parsers
of email, ip, card and phone find exactly the leftmost non-overlapping matches of

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)              each part at most 255
    card   [0-9]([ -]?[0-9])+                                  14 to 19 digits that pass Luhn
    phone  \\+[0-9][ ().0-9-]+[0-9]                             10 to 15 digits

and a failing match is dropped without a second try. The method adds url, secret and account spans.

Offsets are code points, ends exclusive. A null or empty text has no spans; repeated rows are each
reported; a null doc_id is kept; other columns are ignored by ``find_spans`` and kept by ``redact``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, held

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "secret", "account")
# Cues in the spellings that texts use; a cue counts as an anchor wherever it stands.
SECRET_CUES = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "api-key", "access_key")
ACCOUNT_CUES = ("iban", "ssn", "account")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
URL_REST = re.compile(r"://[^\s<>\"']+")
SECRET_VALUE = re.compile(r"[ \t]*[=:][ \t]*[\"']?([A-Za-z0-9_./+-]{8,})")
ACCOUNT_VALUE = re.compile(r"[ \t]*(?:number|no\.?)?[ \t]*[=:#]?[ \t]*((?:[A-Za-z]{2}[0-9]{2}[A-Za-z0-9]{10,30})|(?:[0-9]{3}-[0-9]{2}-[0-9]{4}))(?![A-Za-z0-9])")


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    for c, kind in (("@", "email"), ("+", "phone"), ("://", "url")):
        found.add_word(c, (kind, len(c)))
    for kind, cues in (("secret", SECRET_CUES), ("account", ACCOUNT_CUES)):
        for cue in cues:
            for spelling in (cue, cue.capitalize(), cue.upper()):
                found.add_word(spelling, (kind, len(spelling)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def mod97(account: str) -> bool:
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then by kind as in ``KINDS``."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    done = dict.fromkeys(KINDS, 0)  # where the last match of each kind ended
    last_digit = -2
    for end, (kind, size) in automaton().iter(text):
        at = end - size + 1
        if kind == "digit":
            inside, last_digit = at == last_digit + 1, at
            if inside:  # both patterns take a whole run of digits or nothing of it
                continue
            if at >= done["card"] and (m := CARD.match(text, at)):
                done["card"] = m.end()
                if 14 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                    found.append(("card", at, m.end()))
            if at >= done["ip"] and (m := IP.match(text, at)):
                done["ip"] = m.end()
                if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m.group().split(".")):
                    found.append(("ip", at, m.end()))
        elif kind == "email":
            start, floor = at, done["email"]
            while start > floor and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at)):
                done["email"] = m.end()
                found.append(("email", start, m.end()))
        elif kind == "phone":
            if at >= done["phone"] and (m := PHONE.match(text, at)):
                done["phone"] = m.end()
                if 10 <= len(DIGIT.findall(m.group())) <= 15:
                    found.append(("phone", at, m.end()))
        elif kind == "url":
            start, floor = at, done["url"]
            while start > floor and text[start - 1] in SCHEME:
                start -= 1
            while start < at and not text[start].isalpha():
                start += 1
            if start < at and (m := URL_REST.match(text, at)):
                done["url"] = m.end()
                found.append(("url", start, m.end()))
        elif kind == "secret":
            if at >= done["secret"] and (m := SECRET_VALUE.match(text, end + 1)):
                done["secret"] = m.end(1)
                found.append(("secret", m.start(1), m.end(1)))
        elif at >= done["account"] and (m := ACCOUNT_VALUE.match(text, end + 1)):
            if "-" in m.group(1) or mod97(m.group(1).upper()):
                done["account"] = m.end(1)
                found.append(("account", m.start(1), m.end(1)))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held("pii")
    for pdf in batches:
        got = [[{"kind": k, "start": s, "end": e} for k, s, e in spans(x)] for x in pdf["text"]]
        yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "spans": got})


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, spans (array of kind, start, end) for every row."""
    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInPandas(_find, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _is(kind: str):
    return lambda s: s["kind"] == kind


def report(docs: DataFrame) -> DataFrame:
    """Counts of each base kind, the digest of the base spans and the list of all spans."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return find_spans(docs).select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redacted(text: str | None) -> str | None:
    """The text with each span, overlapping ones joined, replaced by its first kind in brackets."""
    if text is None:
        return None
    out, at = [], 0
    for kind, start, end in spans(text):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:] if at else text


@F.pandas_udf(T.StringType())
def redact_column(text: pd.Series) -> pd.Series:
    held("pii")
    return pd.Series([redacted(x) for x in text], dtype=object)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in text, and n_chars counted anew where it is a column."""
    out = bounded(docs).withColumn("text", redact_column("text"))
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
