"""Personal data: patterns propose spans, checksums and ranges confirm them, nearby words adjust the score.

Base kinds (email, ip, card, phone) follow fixed patterns; confirmed base spans are always reported. The method adds
account numbers (kind ``iban``), confirmed by the mod-97 check. All scans are linear in the text: runs are entered at
their first character only and quantifiers are possessive, so very long digit or word runs do no harm.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import map_rows

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban")
SPAN_TYPE = "array<struct<kind:string,start:bigint,stop:bigint,score:double,base:boolean>>"

EMAIL_REST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
DIGIT = re.compile(r"[0-9]")
DIGIT_RUN = re.compile(r"[0-9][0-9]*+")
IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
NOT_DIGIT = re.compile(r"[^0-9]+")

#: Words within CONTEXT characters before or after a span that raise its score.
CONTEXT = 40
CONTEXT_WORDS = {
    "email": ("mail", "contact", "write", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "addr"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "llame", "appel"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
}
#: Score of a confirmed span without and with a context word.
BASE_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8}
CONTEXT_BONUS = 0.2


def luhn(digits: str) -> bool:
    """Every second digit from the right is doubled; the digit sum must end in 0."""
    total = sum(map(int, digits[-1::-2]))
    for d in digits[-2::-2]:
        total += sum(divmod(2 * int(d), 10))
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Letters count 10 to 35; the first four characters go to the end; the remainder must be 1."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Entered at each @: the local part is the run of its characters before it, down to the previous match."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        rest = EMAIL_REST.match(text, at)
        start = at
        if rest:
            while start > done and (c := text[start - 1]).isascii() and (c.isalnum() or c in "._%+-"):
                start -= 1
        if start < at:
            done = rest.end()
            out.append((start, done))
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    out, done = [], 0
    for run in DIGIT_RUN.finditer(text):
        if run.start() >= done and (m := IP.match(text, run.start())):
            done = m.end()
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
                out.append(m.span())
    return out


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37 and 12 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]


def ibans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in IBAN.finditer(text) if 15 <= len(x := m[0].replace(" ", "")) <= 34 and mod97(x)]


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones, "iban": ibans}


def find_spans(text: str) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, stop, score, base) by start, then kind in the order of KINDS; code points, stop exclusive."""
    found = []
    digits = DIGIT.search(text) is not None
    for rank, kind in enumerate(KINDS):
        if digits if kind != "email" else "@" in text:
            found += [(a, rank, b) for a, b in FINDERS[kind](text)]
    found.sort()
    out = []
    for a, rank, b in found:
        kind = KINDS[rank]
        near = (text[max(0, a - CONTEXT) : a] + " " + text[b : b + CONTEXT]).lower()
        out.append((kind, a, b, BASE_SCORE[kind] + CONTEXT_BONUS * any(w in near for w in CONTEXT_WORDS[kind]), kind in BASE_KINDS))
    return out


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (doc_id, spans), each span with kind, start, stop, score and base.

    Null text counts as empty and has no spans. Ids may repeat or be null; each row is searched for itself. Texts are read
    whole, however long. Other columns are ignored, whatever their names; an empty table gives an empty result."""

    def run(cols: list) -> list:
        ids, texts = cols
        return [ids, [[dict(zip(("kind", "start", "stop", "score", "base"), s, strict=True)) for s in find_spans(t or "")] for t in texts]]

    return map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), f"doc_id {dict(docs.dtypes)[id_col]}, spans {SPAN_TYPE}", run)


def redact_text(text: str) -> str:
    """Every span becomes <KIND>; of overlapping spans the earliest, then longest, wins and the rest is merged into it."""
    parts, done = [], 0
    for kind, a, b, _, _ in sorted(find_spans(text), key=lambda s: (s[1], -s[2])):
        if a >= done:
            parts += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join(parts) + text[done:]


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data replaced in ``text_col``; null stays null, repeated rows stay.

    A column ``n_chars``, where there is one, is the length of the text as it is then."""

    @F.pandas_udf("string")
    def masked(texts):
        return texts.map(lambda t: None if t is None else redact_text(t))

    clean = docs.withColumn(text_col, masked(F.col(text_col)))
    return clean.withColumn("n_chars", F.char_length(text_col).cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else clean


def joined(spans: Column) -> Column:
    """kind:start:stop, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _is_kind(kind: str):
    return lambda s: s["kind"] == kind


def digest_columns(found: DataFrame, kinds: tuple[str, ...], *more: Column) -> DataFrame:
    """doc_id, a count per base kind, the digest of the base spans, all spans, ``more``."""
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id", *[F.size(F.filter(base, _is_kind(k))).cast("long").alias(f"n_{k}") for k in kinds], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), *more
    )


def op4_query(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, all spans, and the score of each; nulls, repeats and empty tables as in ``find_pii``."""
    found = find_pii(docs)
    scores = F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 1)), ",")
    return digest_columns(found, BASE_KINDS, scores.alias("scores"))
