"""Personal data by anchor expansion.

Method: an Aho-Corasick automaton runs once over a text and reports at-signs, digits, schemes and identifier cues. From
each anchor a local parser expands to the run of characters that a value of its kind may have, finds the value's bounds
in that run alone, and validates it: an address is expanded to both sides of its at-sign, numbers are parsed within a run of number characters. A value of a base kind lies within one
such run, so the runs give what the kind's rule gives over the whole text. No parser reads a run more than a fixed number of times, so long texts of any shape take time in proportion.

Base kinds: email, ip, card (Luhn), phone. Added kinds: address (a scheme's URL with a valid host) and account (an
identifier after a cue word, or an IBAN whose check digits hold).

Cases: null text counts as empty (no spans); repeated rows stay; empty tables give empty results; a column of
``df`` with the name of a result column is replaced. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame

from quillmatch.llm.rows import map_blocks, texts

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "address", "account")
MASKED = (*BASE_KINDS, "account")

# The rules of the base kinds after their anchors, and the characters that their values consist of: fixed values.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # begins where a run of digits does: later in it the rule holds no better
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NUMBER_CHARACTERS = frozenset(" ().0123456789+-")
LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
CUES = ("iban", "account", "acct", "passport", "konto", "kontonummer", "compte", "cuenta", "ssn", "social security", "tax id", "steuernummer", "member id", "customer id", "policy number", "driver license", "routing", "dni", "nif")

HOST = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")
AFTER_SCHEME = re.compile(r"[^\s<>\"'`|{}\\^\[\]]*")
AUTHORITY = re.compile(r"[^/?#]*")
TRAILING = frozenset(".,;:!?)&*%$#")
AFTER_CUE = re.compile(r"(?:\s?(?i:no|nr|number|num)\b)?[.:#=\s]{0,4}([A-Z]{0,4}[0-9](?:[ -]?[A-Z0-9]){4,33})", re.ASCII)
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def digits_of(value: str) -> str:
    return re.sub("[^0-9]", "", value)


def is_ip(value: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in value.split("."))


def is_card(value: str) -> bool:
    d = digits_of(value)
    return 14 <= len(d) <= 19 and luhn(d)


def is_phone(value: str) -> bool:
    return 10 <= len(digits_of(value)) <= 15


def iban_holds(value: str) -> bool:
    if not IBAN.fullmatch(value):
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, "number")
    a.add_word("@", "email")
    a.add_word("://", "address")
    for cue in CUES:  # the text's letters are lower-cased for the automaton
        a.add_word(cue, "account")
    a.make_automaton()
    return a


def run_end(text: str, i: int, allowed: frozenset) -> int:
    n = len(text)
    while i < n and text[i] in allowed:
        i += 1
    return i


def run_start(text: str, i: int, least: int, allowed: frozenset) -> int:
    while i > least and text[i - 1] in allowed:
        i -= 1
    return i


def numbers(text: str, start: int, end: int, spans: list) -> None:
    """Parses one run of number characters."""
    run = text[start:end]
    for kind, rule, holds in (("ip", IP, is_ip), ("card", CARD, is_card), ("phone", PHONE, is_phone)):
        for m in rule.finditer(run):
            if holds(m[0]):
                spans.append((start + m.start(), kind, start + m.end()))


def email(text: str, at: int, least: int, spans: list) -> int:
    """Expands around the at-sign at ``at``, to the left as far as ``least``; returns where the value ends, or ``least``."""
    start = run_start(text, at, least, LOCAL_CHARACTERS)
    found = DOMAIN.match(text, at + 1) if start < at else None
    if not found:
        return least
    spans.append((start, "email", found.end()))
    return found.end()


def url_end(text: str, at: int) -> int:
    """Where a URL that has begun before ``at`` ends."""
    end = AFTER_SCHEME.match(text, at).end()
    while end > at and text[end - 1] in TRAILING:
        end -= 1
    return end


def address(text: str, scheme_end: int, end: int, spans: list, least: int) -> int:
    """Expands around ``://``, which ends before ``scheme_end``; returns where the URL ends, or ``scheme_end``."""
    start = scheme_end - 3
    while start > least and (c := text[start - 1]).isascii() and (c.isalnum() or c in "+.-"):
        start -= 1
    while start < scheme_end - 3 and not text[start].isalpha():
        start += 1
    authority = AUTHORITY.match(text, scheme_end, max(scheme_end, end))[0].rpartition("@")[2]
    host = re.sub(r":[0-9]*\Z", "", authority[-260:])
    if start < scheme_end - 3 and len(host) <= 253 and HOST.fullmatch(host) and not (IP.fullmatch(host) and not is_ip(host)):
        spans.append((start, "address", end))
        return end
    return scheme_end


def account(text: str, cue_end: int, spans: list) -> int:
    """An identifier right after a cue; returns where it ends."""
    m = AFTER_CUE.match(text, cue_end)
    if not m:
        return cue_end
    value, start = m[1], m.start(1)
    bare = re.sub("[ -]", "", value)
    if re.match("[A-Z]{2}[0-9]{2}", bare):
        while bare and not iban_holds(bare):  # a following word in capitals may have come along
            cut = max(value.rfind(" "), value.rfind("-"), 0)
            value, bare = value[:cut], re.sub("[ -]", "", value[:cut])
    elif len(digits_of(bare)) < 6:
        return cue_end
    if not bare:
        return cue_end
    spans.append((start, "account", start + len(value)))
    return start + len(value)


def find(text: str, anchors) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every value, by start and then by kind as listed."""
    spans: list[tuple[int, str, int]] = []
    number_end = email_end = address_end = account_end = run = 0
    lower = text.lower()
    for last, kind in anchors.iter(lower if len(lower) == len(text) else text):
        if kind == "number":
            if last >= number_end:
                start = run_start(text, last, number_end, NUMBER_CHARACTERS)
                number_end = run_end(text, last, NUMBER_CHARACTERS)
                if number_end - start > 6:  # the shortest ip has seven characters
                    numbers(text, start, number_end, spans)
        elif kind == "email":
            if last >= email_end:
                email_end = max(email(text, last, email_end, spans), last)
        elif kind == "address":
            if last >= address_end:
                if last >= run:  # schemes in one run of characters end together
                    run = url_end(text, last + 1)
                address_end = address(text, last + 1, run, spans, address_end)
        elif last >= account_end:
            account_end = account(text, last + 1, spans)
    spans.sort(key=lambda s: (s[0], KINDS.index(s[1])))
    return spans


def shown(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def masked_text(text: str, spans) -> str:
    """``text`` with each value of a masked kind replaced by its kind in square brackets; of overlapping values the first counts."""
    parts, at = [], 0
    for start, kind, end in spans:
        if kind in MASKED:
            if start >= at:
                parts += [text[at:start], f"[{kind.upper()}]"]
            at = max(at, end)
    return "".join([*parts, text[at:]]) if parts else text


def find_pii(df: DataFrame, text: str = "text", spans: str | None = "spans", masked: str | None = "masked") -> DataFrame:
    """Adds spans (array of kind, start, end) and masked, the text with the values of the base kinds and accounts replaced, under these names; None leaves one out."""
    def make():
        anchors = automaton()

        def run(block):
            found = [(t, find(t, anchors)) for t in texts(block, text)]
            out = []
            if spans:
                out.append([[{"kind": k, "start": s, "end": e} for s, k, e in own] for _, own in found])
            if masked:
                out.append([masked_text(t, own) for t, own in found])
            return out

        return run

    added = [f"`{spans}` array<struct<kind: string, start: long, `end`: long>>"] * bool(spans) + [f"`{masked}` string"] * bool(masked)
    return map_blocks(df, make, ", ".join(added))


def pii_digests(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds counts of the base kinds, the digest of their spans, and all spans as text, in place of ``text``."""

    def make():
        anchors = automaton()

        def run(block):
            found = [find(t, anchors) for t in texts(block, text)]
            counts = [[sum(k == kind for _, k, _ in spans) for spans in found] for kind in BASE_KINDS]
            base = [hashlib.sha256(shown(s for s in spans if s[1] in BASE_KINDS).encode()).hexdigest() for spans in found]
            return [*counts, base, list(map(shown, found))]

        return run

    return map_blocks(df, make, ", ".join(f"n_{k} long" for k in BASE_KINDS) + ", base_sha256 string, spans string", drop=[text])


def op3(spark, sf_dir: str) -> DataFrame:
    return pii_digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
