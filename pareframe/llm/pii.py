"""Personal data: Aho-Corasick anchors, and local parsers that expand and validate what lies around them.

One automaton finds at-signs, ``://``, plus signs, digits and identifier cues. Each anchor is handed to the parser
of its kind, which expands to both sides only as far as its own alphabet goes, so a text is never scanned twice.
Base kinds, with the spans that leftmost non-overlapping matching of the given patterns has:

* ``email``: local part, ``@``, labels joined by dots; parsed from the at-sign
* ``ip``: four decimal parts of at most 255; parsed from the run of digits and dots around a digit
* ``card``: 12 to 19 digits, single spaces or hyphens between, passing Luhn; parsed from the chain around a digit
* ``phone``: plus sign, 9 to 15 digits; parsed from the plus sign

Added kinds: ``url`` (an address with user name or password before the host) and ``account`` (after a cue: an
IBAN that passes mod 97, or a social security number of plausible groups, up to three words between; after
"account" or "acct" also 6 to 17 plain digits). Offsets count code points, the end
excluded.
"""

from __future__ import annotations

import re
import string

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pareframe.llm.rows import add_columns, column, named, numbered

#: Order of kinds that start at the same place.
KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]
CUES = ("iban", "account", "acct", "ssn", "social security")
PLAIN_CUES = ("account", "acct")

DIGITS = frozenset(string.digits)
ALNUM = frozenset(string.digits + string.ascii_letters)
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
DOTTED = re.compile(r"[0-9.]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
USERINFO = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=:-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*(:[0-9]+)?")
BETWEEN = r"[\x20:=#.\x09-]"
IDENTIFIER = re.compile(BETWEEN + r"{0,8}(?:(?<=" + BETWEEN + r")[A-Za-z]{1,15}" + BETWEEN + r"{1,8}){0,3}?(?:(?P<iban>[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})|(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4}))(?![A-Za-z0-9])")
#: Nothing validates plain digits, so only words of this kind may stand before them.
PLAIN = re.compile(r"(?i)" + BETWEEN + r"{0,8}(?:(?<=" + BETWEEN + r")(?:number|num|no|nr|id|is|was)" + BETWEEN + r"{1,8}){0,3}?(?P<plain>[0-9]{6,17})(?![A-Za-z0-9]|[.-][0-9])")


def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in [("@", "email"), ("+", "phone"), ("://", "url"), *((d, "digit") for d in string.digits)]:
        found.add_word(word, (kind, len(word)))
    for cue in CUES:
        for form in (cue, cue.upper(), cue.capitalize(), cue.title()):
            found.add_word(form, ("account", len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _email(text: str, at: int, after: int) -> tuple[int, int] | None:
    """The address around the at-sign ``at`` that begins at ``after`` or later."""
    start = at
    while start > after and text[start - 1] in LOCAL:
        start -= 1
    domain = DOMAIN.match(text, at + 1) if start < at else None
    return (start, domain.end()) if domain else None


def _ips(text: str, start: int, end: int):
    """Addresses in a run of digits and dots."""
    parts, at = [], start
    for part in text[start:end].split("."):
        if part:
            parts.append((at, part))
        if not part:
            parts = []
        elif len(parts) == 4:
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for _, p in parts):
                yield parts[0][0], at + len(part)
            parts = []
        at += len(part) + 1


def _iban(text: str) -> bool:
    text = text.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _account(text: str, at: int, plain: bool = False) -> tuple[int, int] | None:
    """The identifier after a cue that ends before ``at``; ``plain`` digits count after some cues only."""
    if found := IDENTIFIER.match(text, at):
        if found["iban"] is not None:
            if _iban(found["iban"]):
                return found.span("iban")
        else:
            area, group, serial = found["ssn"].split("-")
            if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
                return found.span("ssn")
    return found.span("plain") if plain and (found := PLAIN.match(text, at)) else None


def spans_of(text: str, automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as in KINDS."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email_end = dotted_end = card_end = phone_end = url_end = 0
    for last, (kind, size) in automaton.iter(text):
        if kind == "digit":
            if last >= dotted_end:
                start = last
                while start > dotted_end and text[start - 1] == ".":
                    start -= 1
                dotted_end = DOTTED.match(text, start).end()
                found["ip"] += _ips(text, start, dotted_end)
            if last >= card_end:
                if match := CARD.match(text, last):
                    card_end = match.end()
                    digits = match[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(match.span())
        elif kind == "email":
            if last >= email_end and (span := _email(text, last, email_end)):
                email_end = span[1]
                found["email"].append(span)
        elif kind == "phone":
            if last >= phone_end and (match := PHONE.match(text, last)):
                phone_end = match.end()
                if 9 <= sum(c in DIGITS for c in match[0]) <= 15:
                    found["phone"].append(match.span())
        elif kind == "url":
            start = last - size + 1
            while start > url_end and text[start - 1] in ALNUM:
                start -= 1
            if start < last - size + 1 and (match := USERINFO.match(text, last + 1)):
                url_end = match.end()
                found["url"].append((start, match.end()))
        elif span := _account(text, last + 1, text[last + 1 - size : last + 1].lower() in PLAIN_CUES):
            if span not in found["account"][-3:]:
                found["account"].append(span)
    return sorted(((k, s, e) for k, spans in found.items() for s, e in spans), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def find_pii(documents: DataFrame) -> DataFrame:
    """``documents`` with ``pii``, an array of (kind, start, end); a column of that name is replaced.

    Null and empty texts have none. Rows are handled one by one, so repeated rows and null ids just stay; other
    columns may have any names.
    """

    def make():
        automaton = anchors()

        def run(batch) -> list:
            return [[[{"kind": k, "start": s, "end": e} for k, s, e in spans_of(t, automaton)] if t else [] for t in batch["text"].to_pylist()]]

        return run

    found = add_columns(numbered(documents), {"text": column(documents, "text")}, make, "pii array<struct<kind:string,start:long,end:long>>")
    return named(found, documents.columns, ["pii"])


def _written(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def pii_report(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Null and empty texts have no spans; repeated rows and null ids stay, row by row; other columns are not used, and
    an empty table gives no rows.
    """
    found = find_pii(documents.select("doc_id", "text")).drop("text")
    base = F.filter("pii", lambda x: x["kind"].isin(*BASE))
    number = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [number(kind) for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("pii")).alias("spans"))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by its kind in brackets; a span inside an earlier one goes with it."""
    out, done = [], 0
    for kind, start, end in spans:
        if start >= done:
            out += [text[done:start], f"[{kind}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])
