"""Licence scan by canonical digests.

Texts are brought to one form (case, punctuation, copyright lines, equivalent spellings), whole texts are
hashed, and the hashes are joined to those of known licences, which passed through the same steps. Lines
that only name a licence are looked up likewise, each as a text of its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import fresh, of, quoted
from .licence_texts import DIGESTS, NOTICES, TEXTS

#: Spellings that count as the second, after case and punctuation are gone; whole words.
SPELLINGS = (
    ("licen[cs](e|es|ed|ing|ee|ees|or|ors)", "licens$1"),
    ("sub licens", "sublicens"),
    ("non infring", "noninfring"),
    ("merchantibility", "merchantability"),
    ("copyright holders?", "copyright holder"),
    ("copyright owners?", "copyright holder"),
    ("favour", "favor"),
    ("behaviour", "behavior"),
    ("acknowledgement", "acknowledgment"),
    ("per cent", "percent"),
    ("e mail", "email"),
    ("https?", "http"),
)
#: Lines that say whose the text is, not what it allows.
OWNER = r"(^|\n)[^\p{L}\p{N}\n]*(?:copyright[^\p{L}\p{N}\n][^\n]*(?:[0-9]{4}|\(c\)|©|<|\[)|\(c\)|©|all rights reserved)[^\n]*"


#: What must occur in a text that one of the spellings changes.
ANY = r"\b(?:(?:sub)?licen[cs]|sub licens|non infring|merchantibility|copyright (?:holder|owner)|favour|behaviour|acknowledgement|per cent|e mail|http)"


def _plain(text: Column) -> Column:
    """Case, owners and punctuation gone."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(text, "\r\n?", "\n")), OWNER, "$1")
    return F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " ")


def _spelled(plain: Column) -> Column:
    for a, b in SPELLINGS:
        plain = F.regexp_replace(plain, r"\b" + a, b) if a != SPELLINGS[0][0] else F.regexp_replace(plain, r"\b(sub)?" + a + r"\b", "$1licens$2")
    return plain


def canonical(text: Column) -> Column:
    """The form in which two copies of one licence are equal. Null stays null."""
    return F.trim(_spelled(_plain(text)))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def registry(spark, texts: Mapping[str, str] = TEXTS, digests: Mapping[str, str] = DIGESTS) -> DataFrame:
    """(licence, digest): one row for each known text, from literals; its size is that of the lists given."""
    rows = F.array(*[F.struct(F.lit(k).alias("licence"), F.lit(v).alias("text")) for k, v in texts.items()])
    made = spark.range(1).select(F.inline(rows)).select("licence", digest(F.col("text")).alias("digest"))
    if digests:
        given = F.array(*[F.struct(F.lit(k).alias("licence"), F.lit(v).alias("digest")) for k, v in digests.items()])
        made = made.unionByName(spark.range(1).select(F.inline(given)))
    return made.groupBy("digest").agg(F.min("licence").alias("licence"))


def _lines_known(spark, notices: Mapping[str, Sequence[str]]) -> list[tuple[str, str]]:
    """(digest, licence) of the given lines: a list as long as that given."""
    rows = [(k, v) for k, lines in notices.items() for v in lines]
    if not rows:
        return []
    table = F.arrays_zip(F.lit([k for k, _ in rows]).alias("licence"), F.lit([v for _, v in rows]).alias("line"))
    made = spark.range(1).select(F.inline(table)).select(digest(F.col("line")).alias("digest"), "licence")
    return sorted({(r["digest"], r["licence"]) for r in made.collect()})


def licences(
    df: DataFrame,
    text: str = "text",
    out: str = "licence",
    texts: Mapping[str, str] = TEXTS,
    notices: Mapping[str, Sequence[str]] = NOTICES,
    digests: Mapping[str, str] = DIGESTS,
) -> DataFrame:
    """df with a struct column ``out``: digest of the canonical text, licence (of the known text that it equals whole,
    else null), notices (licences that lines of the text name, distinct, sorted).

    Whole texts, no shuffle of df: the registry is a list in the code and is broadcast. Short licences
    are known by text, long ones by digest. Two equal lines of ``notices`` with different licences count as the last. Null text: digest and licence null, no notices. Empty text has the digest of "". Repeated rows get the same. Two known texts with one canonical
    form count as the first by name. A column of df called ``out`` is replaced; an empty table gives an empty one.
    """
    mark, noted, bare = fresh(df, "_digest"), fresh(df, "_named"), fresh(df, "_plain")
    had = [c for c in df.columns if c.lower() != out.lower()]
    body = quoted(text)
    lines = F.filter(F.split(F.coalesce(body, F.lit("")), "\n"), lambda x: x.rlike("(?i)licen[cs]e"))
    known = _lines_known(df.sparkSession, notices)
    # Each line is hashed once and then looked up.
    at = lambda h: F.array_position(F.lit([d for d, _ in known]), h).cast("int")
    places = F.filter(F.transform(F.transform(lines, digest), at), lambda n: n > 0)
    named = F.transform(places, lambda n: F.element_at(F.lit([k for _, k in known]), n)) if known else F.array().cast("array<string>")
    plain = df.select(*[quoted(c) for c in had], _plain(body).alias(bare), F.array_sort(F.array_distinct(named)).alias(noted))
    # Most texts hold none of the spellings: one search spares them a dozen.
    spelled = F.when(quoted(bare).rlike(ANY), _spelled(quoted(bare))).otherwise(quoted(bare))
    hashed = plain.select(*[quoted(c) for c in had], noted, F.sha2(F.trim(spelled), 256).alias(mark))
    table = F.broadcast(registry(df.sparkSession, texts, digests)).alias("l")
    found = hashed.alias("d").join(table, of("d", mark) == F.col("l.digest"), "left")
    return found.select(*[of("d", c).alias(c) for c in had], F.struct(of("d", mark).alias("digest"), F.col("l.licence").alias("licence"), of("d", noted).alias("notices")).alias(out))


def op7_licences(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    x = F.col("licence")
    return licences(docs).select("doc_id", x["digest"].alias("digest"), x["licence"].alias("licence"), x["licence"].isNotNull().alias("is_licence"), F.array_join(x["notices"], ",").alias("notices"))
