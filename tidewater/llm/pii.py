"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

The four base kinds are taken whenever their form and check hold. The further kinds (account numbers, local phone
numbers, credentials and assigned secrets) are too often something else, such as order numbers or part codes, so
they need a score: where they start from depends on the checksum or on how random they look, and words nearby
raise or lower it.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import put, quoted

RESULT = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"
_KIND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))


def digits(text: str) -> str:
    return re.sub("[^0-9]+", "", text)


def luhn(number: str) -> bool:
    """Whether the digits pass the Luhn check: every second digit from the right doubled, cross-summed, all divisible by 10."""
    total = sum(int(c) for c in number[::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in number[-2::-2])
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether an IBAN passes ISO 7064 mod 97: the first four characters go last, letters count from A = 10, remainder 1."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def entropy(text: str) -> float:
    """Bits a character, from the text's own character counts."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def looks_random(value: str) -> bool:
    """Whether an assigned value is more likely a secret than a word or a name: letters with digits, and varied."""
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= 2.5


LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: Four numbers or more with dots between them, from the first digit on.
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
FOUR = re.compile(r"[0-9]++(?:\.[0-9]++){3}")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @, two labels or more. Each @ is looked at once, and the run before it once: a
    search from every start would read a long run without @ once for each of its characters."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        done = domain.end() if domain else at + 1
        if domain:
            yield start, done
        at = text.find("@", done)


def quads(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of four numbers with dots between them: chains of numbers are found whole and cut into fours."""
    for chain in DOTTED.finditer(text):
        for m in FOUR.finditer(text, *chain.span()):
            yield m.span()


def octets(text: str) -> bool:
    return all(len(x) <= 3 and int(x or 0) <= 255 for x in (x.lstrip("0") for x in text.split(".")))


def matches(pattern: str) -> Callable[[str], Iterator[tuple[int, int]]]:
    """Proposals by a regular expression; it must be linear, so runs are possessive or bounded."""
    compiled = re.compile(pattern)
    return lambda text: (m.span() for m in compiled.finditer(text))


@dataclass(frozen=True)
class Kind:
    """propose: spans of a text; check confirms (no retry on failure). score: what a confirmed span starts with. near:
    words that raise it by 0.3; hints: a text must contain one of them, as a quick test ("0": any digit)."""

    name: str
    propose: Callable[[str], Iterator[tuple[int, int]]]
    check: Callable[[str], bool]
    score: float
    near: frozenset[str]
    hints: tuple[str, ...]
    base: bool = True


def _kind(name: str, propose, check: Callable[[str], bool], score: float, near: str, hints: str, base: bool = True) -> Kind:
    return Kind(name, propose, check, score, frozenset(near.split()), tuple(hints.split()), base)


IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
AMEX = r"(?<![0-9A-Za-z.+-])3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![0-9A-Za-z])"
SSN = r"(?<![0-9A-Za-z.-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])"
LOCAL_PHONE = r"(?<![0-9A-Za-z+.(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])"
#: Published forms of credentials that name themselves by a prefix.
CREDENTIAL = (
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,72}|AIza[A-Za-z0-9_-]{35}"
    r"|sk_live_[A-Za-z0-9]{24}|eyJ[A-Za-z0-9_-]{10,512}\.eyJ[A-Za-z0-9_-]{10,2048}\.[A-Za-z0-9_-]{10,512})(?![A-Za-z0-9])"
)
#: Names that promise a secret behind an equals sign or colon.
NAMES = tuple(
    name + end
    for name in "password passwd passphrase pwd secret token credential api_key api-key apikey access_key access-key accesskey private_key private-key privatekey".split()
    for end in ("", "s")
)
SIGN = re.compile("[:=]")
#: The value, 8 to 128 characters.
VALUE = re.compile(r"[\x20\t]{0,4}[\"']?([A-Za-z0-9_./+=!@$%^&*~-]{8,128}+)(?![A-Za-z0-9_./+=!@$%^&*~-])")


def assigned(text: str) -> Iterator[tuple[int, int]]:
    """Values behind one of NAMES and a sign. Signs are looked for first: they are rare, and names are compared only there."""
    for sign in SIGN.finditer(text):
        at = sign.start()
        if text[max(0, at - 24) : at].rstrip(" \t\"'").lower().endswith(NAMES) and (value := VALUE.match(text, at + 1)):
            yield value.span(1)


#: Base kinds first, in the order in which they are listed in results.
KINDS = (
    _kind("email", emails, lambda s: True, 0.9, "mail email e-mail contact write", "@"),
    _kind("ip", quads, octets, 0.7, "ip address host server client", "0"),
    _kind("card", matches(r"[0-9]++(?:[\x20-][0-9]++)*+"), lambda s: 16 <= len(d := digits(s)) <= 19 and luhn(d), 0.8, "card credit visa mastercard payment debit", "0"),
    _kind("phone", matches(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 8 <= len(digits(s)) <= 15, 0.7, "phone tel telephone call mobile fax", "+"),
    _kind("iban", matches(IBAN), lambda s: mod97(s.replace(" ", "")), 0.8, "iban account bank transfer bic konto compte cuenta", "0", False),
    _kind("amex", matches(AMEX), lambda s: luhn(digits(s)), 0.5, "card credit amex american express payment", "0", False),
    _kind("ssn", matches(SSN), lambda s: True, 0.4, "ssn social security", "0", False),
    _kind("local_phone", matches(LOCAL_PHONE), lambda s: True, 0.3, "phone tel telephone call mobile fax", "0", False),
    _kind("credential", matches(CREDENTIAL), lambda s: entropy(s) >= 2.5, 0.7, "key access token aws secret credential", "AKIA ASIA ghp_ gho_ ghu_ ghs_ ghr_ xox AIza sk_live_ eyJ", False),
    _kind("secret", assigned, looks_random, 0.7, "", ": =", False),
)
#: Words that speak against: numbers of things, not of people.
AGAINST = frozenset("order part version serial invoice build model sku isbn".split())
DIGIT, WORD = re.compile("[0-9]"), re.compile(r"[A-Za-z-]+")


class Covered:
    """Spans by start, with the farthest end so far: whether one overlaps a given stretch takes a binary search."""

    def __init__(self, spans: list[dict]) -> None:
        places = sorted((s["start"], s["end"]) for s in spans)
        self.starts = [p for p, _ in places]
        self.ends = list(accumulate((q for _, q in places), max))

    def meets(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before > 0 and self.ends[before - 1] > start


def find(text: str | None, reach: int = 40, least: float = 0.6) -> list[dict]:
    """All spans of a text: of base kinds every confirmed match; of the others those that score ``least`` and overlap none
    found before. Words within ``reach`` characters before a match and after it are its context. Offsets are code points.
    Time is in proportion to the text, whatever it holds."""
    if not text:
        return []
    found: list[dict] = []
    numbers = DIGIT.search(text) is not None
    for k in KINDS:
        if not (numbers if k.hints == ("0",) else any(h in text for h in k.hints)):
            continue
        known = None if k.base else Covered(found)
        for p, q in k.propose(text):
            if not k.check(text[p:q]) or (known and known.meets(p, q)):
                continue
            around = {w.lower() for w in WORD.findall(text[max(0, p - reach) : p]) + WORD.findall(text[q : q + reach])}
            score = min(1.0, max(0.0, k.score + 0.3 * bool(around & k.near) - 0.3 * bool(around & AGAINST)))
            if k.base or score >= least:
                found.append({"kind": k.name, "start": p, "end": q, "score": round(score, 2), "base": k.base})
    return found


def pii(df: DataFrame, text: str = "text", out: str = "pii", reach: int = 40, least: float = 0.6) -> DataFrame:
    """df with an array column ``out`` of RESULT: the spans of personal data in ``text`` with kind, place, score, and whether
    the kind is a base one. By kind in the order of KINDS, then by start.

    One pass over whole texts, no shuffle. Null or empty text has no spans (an empty array). Repeated rows are searched
    alike, and an empty table gives an empty one. A column of df called ``out`` is replaced. Time grows in proportion to a
    text's length; a worker holds one Arrow batch and the spans of its texts.
    """
    search = F.arrow_udf(lambda x: pa.array([find(t, reach, least) for t in x.to_pylist()], _KIND), RESULT)
    return put(df, out, search(quoted(text)))


def redact(df: DataFrame, text: str = "text", mark: str = "[{}]") -> DataFrame:
    """df with each span of personal data in ``text`` replaced by its kind; overlapping spans are replaced as one, by the first's.

    Null and empty texts and those without spans stay as they are, repeated rows are treated alike, an empty table gives
    an empty one; all other columns come back unchanged.
    """

    def replaced(texts: pa.Array) -> pa.Array:
        done = []
        for t in texts.to_pylist():
            at, parts = 0, []
            for s in sorted(find(t), key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= at:
                    parts += [t[at : s["start"]], mark.format(s["kind"])]
                at = max(at, s["end"])
            done.append(t if t is None or not parts else "".join([*parts, t[at:]]))
        return pa.array(done, pa.string())

    return df.select(*[F.arrow_udf(replaced, "string")(quoted(c)).alias(c) if c == text else quoted(c) for c in df.columns])


def op10_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = F.col("pii")
    listed = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    all_ = F.size(found).cast("long").alias("n_spans")
    return pii(docs).select("doc_id", *[count(k.name) for k in KINDS if k.base], all_, F.sha2(listed(F.filter(found, lambda s: s["base"])), 256).alias("base_sha256"), listed(found).alias("spans"))
