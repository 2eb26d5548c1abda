"""Personal data by anchor expansion: Aho-Corasick finds at-signs, schemes, digits and identifier cues, and local parsers expand each
anchor to the boundaries of an e-mail address, a network address or an account and validate it.

Base kinds are email, ip, card and phone, leftmost and without overlaps within a kind; a match that fails its test is dropped and
not tried again. Further kinds: url (a scheme with user data in it), iban, account and secret (a value after a cue, a key of a known form, or a private key).
Offsets are code points, the end exclusive. Anchors within what their parser has already passed over are not expanded again, so every parser is linear in the text,
and very long texts and runs are scanned whole.
Nulls: a null text is empty and gives no span; a null doc_id stays null. Repeated rows each give their row. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import once, replaced, row_map

KINDS = ("email", "ip", "card", "phone", "url", "iban", "account", "secret")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://", "mongodb://", "redis://", "amqp://")
ACCOUNT_CUES = ("account number", "account no", "account #", "account:", "acct", "konto", "kontonummer", "compte", "cuenta")
SECRET_CUES = ("token", "password", "passwd", "pwd", "api_key", "api-key", "apikey", "secret", "secret_key", "access_key", "private_key", "bearer")
#: Keys that are known by their first characters: those, and the pattern of the rest.
KEY_FORMS = {
    "AKIA": r"[A-Z0-9]{16}", "ASIA": r"[A-Z0-9]{16}", "ghp_": r"[A-Za-z0-9]{36}", "gho_": r"[A-Za-z0-9]{36}", "github_pat_": r"[A-Za-z0-9_]{22,90}", "glpat-": r"[A-Za-z0-9_-]{20}", "xoxb-": r"[A-Za-z0-9-]{20,90}",
    "xoxp-": r"[A-Za-z0-9-]{20,90}", "AIza": r"[A-Za-z0-9_-]{35}", "sk-": r"[A-Za-z0-9_-]{32,200}",
}
KEY_BEGIN, KEY_END = "-----BEGIN ", "-----END "

LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
RUN = re.compile(r"[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE_REST = re.compile(r"[0-9][\x20().0-9-]+[0-9]")
URL_REST = re.compile(r"[^\s<>\"'\x00-\x20]++")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
ACCOUNT_REST = re.compile(r"[\s:.#=]{0,4}([0-9](?:[ -]?[0-9]){5,19})(?![0-9])")
SECRET_SIGN = re.compile(r"[\"']?(?:\s{0,3}(?:[:=]|=>)\s{0,3}|(?<=earer|EARER)\s)[\"']?")
SECRET_REST = re.compile(r"[A-Za-z0-9_./+=-]++")
KEY_NAME = re.compile(r"[A-Z0-9 ]{0,40}PRIVATE KEY-----")

SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_secret long"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if k % 2:
            x = x * 2 - 9 if x > 4 else x * 2
        total += x
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def secret_ok(value: str) -> bool:
    """Long enough for a key, or shorter with letters and digits as a password has them."""
    return len(value) >= 16 or len(value) >= 8 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def build() -> ahocorasick.Automaton:
    kinds: dict[str, set[str]] = {"@": {"email"}, "+": {"phone"}, **{d: {"digit"} for d in "0123456789"}, KEY_BEGIN: {"pem"}}
    for kind, cues in (("url", SCHEMES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES), ("iban", ("iban",))):
        for cue in cues:
            for form in (cue, cue.upper(), cue.capitalize()):
                kinds.setdefault(form, set()).add(kind)
    for start in KEY_FORMS:
        kinds.setdefault(start, set()).add("key")
    found = ahocorasick.Automaton()
    for anchor, own in kinds.items():
        found.add_word(anchor, (anchor, sorted(own)))
    found.make_automaton()
    return found


def key_forms() -> dict[str, re.Pattern]:
    return {start: re.compile(rest + r"(?![A-Za-z0-9])") for start, rest in KEY_FORMS.items()}


def is_word(text: str, at: int) -> bool:
    return at >= 0 and (text[at].isalnum() or text[at] == "_")


class Scan:
    """The spans of one text. One method a kind expands an anchor that ends at `at`; passed[kind] is how far that kind's parser has come, valid or not."""

    def __init__(self, text: str):
        self.text, self.found, self.passed, self.no_end = text, [], {}, len(text)
        for at, (anchor, kinds) in once("pii", build).iter(text):
            for kind in kinds:
                getattr(self, kind)(at, anchor)

    def add(self, kind: str, a: int, b: int) -> None:
        self.found.append((a, KINDS.index(kind), b, kind))

    def email(self, at: int, _: str) -> None:
        a, least = at, self.passed.get("email", 0)
        while a > least and self.text[a - 1] in LOCAL_CHARS:
            a -= 1
        if a < at and (m := DOMAIN.match(self.text, at + 1)):
            self.passed["email"] = m.end()
            self.add("email", a, m.end())

    def phone(self, at: int, _: str) -> None:
        if m := PHONE_REST.match(self.text, at + 1):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                self.add("phone", at, m.end())

    def digit(self, at: int, _: str) -> None:
        """The first digit of what may be a card or an ip. From within a run of digits neither gets further than from its start."""
        if at >= self.passed.get("card", 0) and (m := CARD.match(self.text, at)):
            self.passed["card"] = m.end()
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                self.add("card", at, m.end())
        if at >= self.passed.get("ip", 0):
            if m := IP.match(self.text, at):
                self.passed["ip"] = m.end()
                if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                    self.add("ip", at, m.end())
            else:
                self.passed["ip"] = RUN.match(self.text, at).end()

    def url(self, at: int, _: str) -> None:
        if at >= self.passed.get("url run", 0):  # else it stands in a run whose end is known
            m = URL_REST.match(self.text, at + 1)
            self.passed["url run"] = m.end() if m else at + 1
        end = self.passed["url run"]
        slash = self.text.find("/", at + 1, end)
        if self.text.find("@", at + 1, end if slash < 0 else slash) >= 0:
            a = at - 2
            while a and self.text[a - 1].isalpha() and self.text[a - 1].isascii():
                a -= 1
            if a >= self.passed.get("url", 0):
                self.passed["url"] = end
                self.add("url", a, end)

    def iban(self, at: int, _: str) -> None:
        skip = at + 1
        while skip < min(len(self.text), at + 8) and not ("A" <= self.text[skip] <= "Z"):
            skip += 1
        if skip >= self.passed.get("iban", 0) and (m := IBAN.match(self.text, skip)):
            tight = m[0].replace(" ", "")
            for n in range(len(tight), 14, -1):
                if iban_ok(tight[:n]):
                    k = count = 0
                    while count < n:
                        count += m[0][k] != " "
                        k += 1
                    self.passed["iban"] = skip + k
                    self.add("iban", skip, skip + k)
                    break

    def account(self, at: int, _: str) -> None:
        if (m := ACCOUNT_REST.match(self.text, at + 1)) and m.start(1) >= self.passed.get("account", 0):
            self.passed["account"] = m.end(1)
            self.add("account", m.start(1), m.end(1))

    def secret(self, at: int, _: str) -> None:
        if (m := SECRET_SIGN.match(self.text, at + 1)) and m.end() >= self.passed.get("secret", 0) and (value := SECRET_REST.match(self.text, m.end())):
            self.passed["secret"] = value.end()
            if secret_ok(value[0]):
                self.add("secret", value.start(), value.end())

    def key(self, at: int, anchor: str) -> None:
        a = at + 1 - len(anchor)
        if a >= self.passed.get("secret", 0) and not is_word(self.text, a - 1) and (m := once("pii-keys", key_forms)[anchor].match(self.text, at + 1)):
            self.passed["secret"] = m.end()
            self.add("secret", a, m.end())

    def pem(self, at: int, anchor: str) -> None:
        a = at + 1 - len(anchor)
        if a >= self.passed.get("secret", 0) and a < self.no_end and (m := KEY_NAME.match(self.text, at + 1)):
            end = self.text.find(KEY_END, m.end())
            if end < 0:
                self.no_end = a  # nor has any later one
            else:
                end = self.text.find("-----", end + len(KEY_END))
                self.passed["secret"] = len(self.text) if end < 0 else end + 5
                self.add("secret", a, self.passed["secret"])


def spans_of(text: str) -> list[tuple[int, int, str]]:
    """(start, rank of kind, end, kind) of all spans, sorted."""
    return sorted(Scan(text).found)


def redact(text: str) -> str:
    """text with every span replaced by <kind>; of overlapping spans the first wins."""
    out, at = [], 0
    for a, _, b, kind in spans_of(text):
        if a >= at:
            out += text[at:a], f"<{kind}>"
            at = b
    return "".join(out) + text[at:]


def summary(text: str | None) -> tuple:
    found = spans_of(text or "")
    shown = [f"{kind}:{a}:{b}" for a, _, b, kind in found]
    base = [s for s, (_, rank, _, _) in zip(shown, found, strict=True) if rank < 4]
    counts = [sum(rank == k for _, rank, _, _ in found) for k in range(4)]
    return *counts, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(shown), len(found), sum(kind == "secret" for *_, kind in found)


def find_pii(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text), in one narrow pass. n_spans counts the spans of all kinds."""

    def rows(given: Iterator[tuple]) -> Iterable[tuple]:
        for doc_id, text in given:
            yield doc_id, *summary(text)

    return row_map(docs.select("doc_id", "text"), rows, SCHEMA)


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with text redacted; null texts and other columns stay, in their order."""
    columns = docs.columns

    def hide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            yield replaced(batch, columns, text=pa.array([redact(t.as_py()) if t.is_valid else None for t in texts], texts.type))

    return docs.mapInArrow(hide, docs.schema)


#: DuckDB SQL for the numbers of base spans and the digest, for a table documents.
SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), found AS (
  SELECT doc_id, t, 1 AS rank, 'email' AS kind, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS m, regexp_split_to_array(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS gaps FROM texts
  UNION ALL SELECT doc_id, t, 2, 'ip', regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), regexp_split_to_array(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') FROM texts
  UNION ALL SELECT doc_id, t, 3, 'card', regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), regexp_split_to_array(t, '[0-9]([\x20-]?[0-9])+') FROM texts
  UNION ALL SELECT doc_id, t, 4, 'phone', regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), regexp_split_to_array(t, '\+[0-9][\x20().0-9-]+[0-9]') FROM texts
), placed AS (
  SELECT doc_id, rank, kind, unnest(m) AS x, unnest(list_transform(range(1, len(m) + 1), lambda k: list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda g: length(g))), 0))) AS a FROM found
), digits AS (
  SELECT *, regexp_replace(x, '[^0-9]', '', 'g') AS d FROM placed
), good AS (
  SELECT doc_id, rank, kind, CAST(a AS BIGINT) AS a, CAST(a AS BIGINT) + length(x) AS b FROM digits WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN list_max(list_transform(string_split(x, '.'), lambda p: CASE WHEN length(ltrim(p, '0')) > 3 THEN 999 ELSE CAST('0' || ltrim(p, '0') AS INT) END)) <= 255
    WHEN 'card' THEN length(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(0, length(d)), lambda k: CASE WHEN k % 2 = 0 THEN CAST(d[length(d) - k] AS INT)
      ELSE CAST(d[length(d) - k] AS INT) * 2 - CASE WHEN CAST(d[length(d) - k] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0
    ELSE length(d) BETWEEN 9 AND 15 END
), counted AS (
  SELECT doc_id, count(*) FILTER (WHERE rank = 1) AS n_email, count(*) FILTER (WHERE rank = 2) AS n_ip, count(*) FILTER (WHERE rank = 3) AS n_card, count(*) FILTER (WHERE rank = 4) AS n_phone,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) AS shown FROM good GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n_email, 0) AS BIGINT) AS n_email, CAST(coalesce(n_ip, 0) AS BIGINT) AS n_ip, CAST(coalesce(n_card, 0) AS BIGINT) AS n_card, CAST(coalesce(n_phone, 0) AS BIGINT) AS n_phone,
  sha256(coalesce(shown, '')) AS base_sha256 FROM texts LEFT JOIN counted USING (doc_id)
"""
