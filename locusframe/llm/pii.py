"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in a text: at-signs, dots between digits, digits side by
side, plus signs before digits, schemes and words that introduce identifiers. From an anchor a
deterministic parser expands to the bounds of an email address, an IP address, a card or phone
number, a login in a URL or an account number, and checks them. Beside the base kinds it adds logins,
IBANs (of their country's length, whose check digits fit), social security numbers and account
numbers, each after its cue, a word of its own in any case.

Cases: a null or empty text has no spans; spans of one kind never overlap and run left to right, of
different kinds they may; texts of any length are read whole, in time linear in their length; repeated
rows each get a row; an empty table gives no rows; other columns may have any names.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import annotate, table, texts

BASE_KINDS = ("email", "ip", "card", "phone")
#: What the method adds to the base kinds.
MORE_KINDS = ("login", "iban", "ssn", "account")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = frozenset("0123456789")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
USERINFO = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=-]+:[A-Za-z0-9._~%!$&'()*+,;=-]+(?=@[A-Za-z0-9])")
#: What may stand between a cue and its number.
LINK = r"(?:[^A-Za-z0-9]{1,4}(?i:number|numbers|no|nr|num|code|is|was)(?![A-Za-z0-9])){0,3}[^A-Za-z0-9]{0,8}"
IBAN = re.compile(LINK + r"([A-Za-z]{2})([0-9]{2})(?=[ ]?[A-Za-z0-9])")
SSN = re.compile(LINK + r"((?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4})(?![0-9-])")
ACCOUNT = re.compile(LINK + r"([0-9](?:[ -]?[0-9]){5,16})(?![ -]?[0-9]|[A-Za-z])")

SCHEMES = ("http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://", "mongodb://", "redis://", "amqp://")
CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "account", "acct": "account", "a/c": "account", "konto": "account", "kontonummer": "account", "cuenta": "account", "compte": "account"}
#: Lengths of account numbers by country.
IBAN_SIZES = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, CH=21, CR=22, CY=28, CZ=24, DE=22, DK=18, DO=28, EE=20, ES=24, FI=18, FO=18, FR=27, GB=22, GE=22, GI=23, GL=18, GR=27, GT=28, HR=21, HU=28, IE=22, IL=23, IS=26, IT=27,
    JO=30, KW=30, KZ=20, LB=28, LI=21, LT=20, LU=20, LV=21, MC=27, MD=24, ME=22, MK=19, MR=27, MT=31, MU=30, NL=18, NO=15, PK=24, PL=28, PS=29, PT=25, QA=29, RO=24, RS=22, SA=24, SE=24, SI=19, SK=24, SM=27, TN=24, TR=26, UA=29, VG=24,
)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban_end(text: str, at: int) -> int:
    """The end of the account number that begins there, 0 if none does: of its country's length, in groups or not."""
    size, code = IBAN_SIZES.get(text[at : at + 2].upper(), 0), ""
    while len(code) < size and at < len(text):
        c = text[at]
        if c.isascii() and c.isalnum():
            code += c.upper()
        elif c != " " or text[at - 1] == " ":
            return 0
        at += 1
    if not size or len(code) < size or at < len(text) and text[at].isascii() and text[at].isalnum():
        return 0
    return at if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1 else 0


def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    digits = "0123456789"
    for a in digits:
        found.add_word(f"+{a}", ("phone", 2))
        for b in digits:
            found.add_word(f"{a}.{b}", ("ip", 3))
            for gap in ("", " ", "-"):
                found.add_word(f"{a}{gap}{b}", ("card", 2 + len(gap)))
    found.add_word("@", ("email", 1))
    for scheme in SCHEMES:
        found.add_word(scheme, ("login", len(scheme)))
    for cue, kind in CUES.items():
        for word in {cue, cue.upper(), cue.title(), cue.capitalize()}:
            found.add_word(word, (kind, len(cue)))
    found.make_automaton()
    return found


def spans(text: str, automaton: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """By kind, the spans in code points, end exclusive."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in (*BASE_KINDS, *MORE_KINDS)}
    past = dict.fromkeys(out, 0)  # where the last match of a kind ended, dropped or not
    for last, (kind, size) in automaton.iter(text):
        at = last + 1 - size
        if at < past[kind] and kind != "ip":
            continue
        if kind == "card":
            end = CARD.match(text, at).end()
            past[kind] = end
            digits = text[at:end].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out[kind].append((at, end))
        elif kind == "email":
            start = at
            while start > past[kind] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at)):
                past[kind] = m.end()
                out[kind].append((start, m.end()))
        elif kind == "ip":
            dot = at + 1
            if dot <= past[kind]:
                continue
            start = dot
            while start > past[kind] and text[start - 1] in DIGIT:
                start -= 1
            if start < dot and (m := IP.match(text, start)):
                past[kind] = m.end()
                if all(len(x) < 9 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in m[0].split("."))):
                    out[kind].append((start, m.end()))
        elif kind == "phone":
            if m := PHONE.match(text, at):
                past[kind] = m.end()
                if 9 <= sum(c in DIGIT for c in m[0]) <= 15:
                    out[kind].append((at, m.end()))
        elif kind == "login":
            if m := USERINFO.match(text, last + 1):
                past[kind] = m.end()
                out[kind].append(m.span())
        elif not (at and text[at - 1].isalnum() or text[last + 1 : last + 2].isalpha()):  # cues are words
            m = {"iban": IBAN, "ssn": SSN, "account": ACCOUNT}[kind].match(text, last + 1)
            start, end = m.span(1) if m else (0, 0)
            if m and kind == "iban":
                end = iban_end(text, start)
            if end:
                past[kind] = end
                out[kind].append((start, end))
    return out


FIELDS = T.StructType([T.StructField("spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])), False)])


def find_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (row, out): out.spans has kind, start and end, by kind in their fixed order and then by start."""

    def make():
        automaton = anchors()

        def work(column):
            return ([[{"kind": k, "start": a, "end": b} for k, own in spans(text, automaton).items() for a, b in own] for text in texts(column)],)

        return work

    return annotate(docs, [text_col], make, FIELDS)


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents. Every row has a row; see the module for odd texts."""
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    of = lambda k: lambda s: s["kind"] == k
    base = F.filter("out.spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *[F.size(F.filter("out.spans", of(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.concat_ws(",", F.transform(base, line)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("out.spans", line)).alias("spans"),
    )
