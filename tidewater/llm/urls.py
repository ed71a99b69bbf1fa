"""URL filter: rules first, then the ratio of two character language models.

Two variable-order Markov models, of accepted and of rejected URLs, give each character of a URL a
log-likelihood difference; its mean over the URL is compared with a limit that is calibrated on labelled
URLs the models haven't seen. A character is looked up behind its longest known context; each order is
smoothed by the one below it. Every gram that occurs is kept, so the table grows with the corpus of URLs: it is
shuffled, and only the values of grams that fill many positions are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .columns import fresh, of, quoted
from .hot import with_rows
from .store import stored

ORDER = 3
#: A gram that fills this share of all positions or more gets its value by broadcast, the others by shuffle; at most 1 / HOT are broadcast.
HOT = 1 / 50_000
#: Weight of the next lower order, and the uniform base of the lowest.
WEIGHT, BASE = 4.0, 1 / 128
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START, END = "\x02", "\x03"
PARTS = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains, where the path starts with ``path``."""

    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


def rules(text: str) -> tuple[Rule, ...]:
    """Rules from lines such as ``allow org/`` and ``block example.org/es/``."""
    made = []
    for line in filter(None, map(str.strip, text.splitlines())):
        verb, where = line.split(None, 1)
        if verb not in ("allow", "block"):
            raise ValueError(f"neither allow nor block: {line}")
        host, slash, path = where.partition("/")
        made.append(Rule(host.translate(str.maketrans(UPPER, LOWER)), slash + path, verb == "allow"))
    return tuple(made)


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def ruled(host_: Column, path_: Column, known: Sequence[Rule]) -> Column:
    """struct<rule, allow> of the longest rule that fits, else null. Of rules as long the one with the longer host wins, then block."""
    found = F.lit(None).cast("struct<rule:string,allow:boolean>")
    for r in sorted(known, key=lambda r: (len(r.name), len(r.host), not r.allow, r.name)):
        fits = ((host_ == r.host) | host_.endswith("." + r.host)) & path_.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.allow).alias("allow"))).otherwise(found)
    return found


def _seen(url: Column) -> Column:
    """What the models read: the URL behind its scheme, A-Z lower-cased; null is empty."""
    return F.translate(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)\A.*?://", ""), UPPER, LOWER)


#: Characters of URLs that a task takes: it makes a row of each.
CHARACTERS = 1 << 20


def _spread(df: DataFrame) -> DataFrame:
    """df, rows with ``u``, over as many tasks as its characters need: bytes, by which Spark would choose, say little of the rows that they become."""
    total = df.agg(F.coalesce(F.sum(F.length("u") + 1), F.lit(0)).alias("n")).first()["n"]
    return df.repartition(max(1, -(-int(total) // CHARACTERS)), "u")


def _positions(df: DataFrame) -> DataFrame:
    """A row for each character of ``u`` and its end mark, with grams g0, g1, ...: it with so many characters before it."""
    padded = F.concat(F.lit(START * ORDER), F.col("u"), F.lit(END))
    each = df.select("*", padded.alias("p")).select("*", F.explode(F.sequence(F.lit(1 + ORDER), F.length("p"))).alias("i"))
    return each.select(*df.columns, *[F.substring(F.col("p"), F.col("i") - k, F.lit(k + 1)).alias(f"g{k}") for k in range(ORDER + 1)])


def fit(labelled: DataFrame) -> DataFrame:
    """Rows (kind, gram, llr) of the two models from rows (u, n, accepted): n copies of text u.

    kind g: log-likelihood difference of a gram's last character behind the rest; kind c: what a context adds when the
    next character isn't known behind it and the lower order is asked. All grams of all rows count and stay.
    """
    grams = _positions(_spread(labelled)).select("n", "accepted", F.explode(F.array(*[F.col(f"g{k}") for k in range(ORDER + 1)])).alias("gram"))
    counts = stored(grams.groupBy("gram").agg(F.sum(F.when(F.col("accepted"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("accepted"), 0).otherwise(F.col("n"))).alias("r")), "url-grams")
    order = F.length("gram") - 1
    behind = counts.groupBy(F.expr("substring(gram, 1, length(gram) - 1)").alias("context"), order.alias("k")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
    kept = counts.withColumn("k", order).withColumn("context", F.expr("substring(gram, 1, length(gram) - 1)"))
    known = stored(kept.join(behind, ["context", "k"]), "url-known")
    smooth = lambda n, of_, below: (F.col(n) + F.lit(WEIGHT) * below) / (F.col(of_) + F.lit(WEIGHT))
    level = known.where("k = 0").select("gram", smooth("a", "ca", F.lit(BASE)).alias("pa"), smooth("r", "cr", F.lit(BASE)).alias("pr"))
    parts = [level]
    for k in range(1, ORDER + 1):
        below = level.select(F.col("gram").alias("end"), F.col("pa").alias("ba"), F.col("pr").alias("br"))
        level = known.where(F.col("k") == k).withColumn("end", F.expr("substring(gram, 2)")).join(below, "end").select("gram", smooth("a", "ca", F.col("ba")).alias("pa"), smooth("r", "cr", F.col("br")).alias("pr"))
        level = stored(level, "url-level")
        parts.append(level)
    table = parts[0]
    for p in parts[1:]:
        table = table.unionByName(p)
    ends = known.where("k > 0").select("context", "ca", "cr").distinct()
    return table.select(F.lit("g").alias("kind"), "gram", F.ln(F.col("pa") / F.col("pr")).alias("llr")).unionByName(ends.select(F.lit("c").alias("kind"), F.col("context").alias("gram"), F.ln((F.col("cr") + WEIGHT) / (F.col("ca") + WEIGHT)).alias("llr")))


def _values(grams: DataFrame, model: DataFrame) -> DataFrame:
    """(gram, value) of longest grams, each once: what a position with it adds. Of grams that share an end or a context there are as many as characters."""
    below = None
    for k in range(ORDER + 1):
        known = model.where((F.col("kind") == "g") & (F.length("gram") == k + 1)).select("gram", F.col("llr").alias("s"))
        at = grams.select(F.expr(f"substring(gram, {-k - 1}, {k + 1})").alias("gram")).distinct().join(known, "gram", "left")
        value = F.lit(0.0)
        if k:
            ends = model.where((F.col("kind") == "c") & (F.length("gram") == k)).select(F.col("gram").alias("context"), F.col("llr").alias("e"))
            at = at.withColumn("context", F.expr(f"substring(gram, 1, {k})")).withColumn("end", F.expr("substring(gram, 2)")).join(ends, "context", "left").join(below, "end")
            value = F.coalesce(F.col("e"), F.lit(0.0)) + F.col("v")
        at = at.select("gram", F.coalesce(F.col("s"), value).alias("value"))
        below = at.select(F.col("gram").alias("end"), F.col("value").alias("v"))
    return at


def score(urls: DataFrame, model: DataFrame) -> DataFrame:
    """urls, rows with distinct ``u``, with the mean ``score`` of their characters.

    The value of a position is its longest gram's, so values are made once for each gram. Those of grams above HOT are broadcast,
    the other positions are shuffled to theirs: none of these grams has many. Sums are exact to 12 places, in whatever order.
    """
    keys = (F.xxhash64("u", F.lit(1)).alias("k1"), F.xxhash64(F.lit(2), "u").alias("k2"))
    at = _positions(_spread(urls.select("u"))).select(*keys, F.col(f"g{ORDER}").alias("gram"))
    grams = stored(at.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "url-asked")
    total = grams.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    values = stored(_values(grams, model).join(grams, "gram").select("gram", F.round("value", 12).cast("decimal(18,12)").alias("value"), (F.col("n") >= HOT * total).alias("hot")), "url-values")
    first = at.join(F.broadcast(values.where("hot").select("gram", "value")), "gram", "left")
    summed = lambda x: x.groupBy("k1", "k2").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"))
    cold = first.where("value is null").drop("value").join(values.where("not hot").select("gram", "value"), "gram")
    both = summed(first.where("value is not null")).unionByName(summed(cold)).groupBy("k1", "k2").agg((F.sum("value").cast("double") / F.sum("n")).alias("score"))
    return urls.select("u", *keys).join(both, ["k1", "k2"]).select("u", "score")


def calibrated(scored: DataFrame) -> float:
    """The limit with the best mean of the two classes' accuracies, from rows (score, n, accepted); 0 without both classes.

    Scores are counted in bins of 0.01 from -20 to 20, so what is ordered and brought here has a bounded size.
    """
    bins = scored.groupBy(F.greatest(F.lit(-2000), F.least(F.lit(2000), F.floor(F.col("score") * 100))).cast("int").alias("bin")).agg(F.sum(F.when(F.col("accepted"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("accepted"), 0).otherwise(F.col("n"))).alias("r"))
    below, everything = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    under = lambda c: F.coalesce(F.sum(c).over(below), F.lit(0)) / F.sum(c).over(everything)
    both = (F.sum("a").over(everything) > 0) & (F.sum("r").over(everything) > 0)
    lower = F.coalesce(F.lag("bin").over(W.orderBy("bin")) + 1, F.col("bin"))  # no score lies from there to the bin
    gains = bins.select(((F.col("bin") + lower) / 200).alias("limit"), F.when(both, under("r") - under("a")).alias("gain")).where("gain is not null")
    best = gains.orderBy(F.desc("gain"), F.abs("limit"), "limit").limit(1).collect()
    return best[0]["limit"] if best else 0.0


def _labelled(df: DataFrame, known: Sequence[Rule], url: str) -> DataFrame:
    """(u, accepted, n): the distinct texts that the models read, what rules say of them (null: nothing), and how often they come."""
    u = quoted(url)
    texts = df.select(_seen(u).alias("u"), ruled(host(u), path(u), known)["allow"].alias("accepted"))
    return stored(texts.groupBy("u", "accepted").agg(F.count(F.lit(1)).alias("n")), "urls")


def _fold(part: int, of_: int) -> Column:
    return F.pmod(F.xxhash64("u"), F.lit(of_)) == part


def held_out(df: DataFrame, known: Sequence[Rule], url: str = "url", folds: int = 10) -> dict[str, float]:
    """How well the models tell labelled URLs that took no part in fit or limit: share of accepted ones allowed, of rejected ones
    blocked, and the mean of both (``balanced``). One fold of ``folds`` (by hash) sets the limit, another is judged."""
    labelled = _labelled(df, known, url).where("accepted is not null")
    model = stored(fit(labelled.where(~_fold(0, folds) & ~_fold(1, folds))), "url-model")
    limit = calibrated(score((test := labelled.where(_fold(0, folds))).select("u").distinct(), model).join(test, "u"))
    judged = score((rest := labelled.where(_fold(1, folds))).select("u").distinct(), model).join(rest, "u")
    right = (F.col("score") >= limit) == F.col("accepted")
    share = lambda accepted: F.sum(F.when(right & (F.col("accepted") == accepted), F.col("n"))) / F.sum(F.when(F.col("accepted") == accepted, F.col("n")))
    got = judged.agg(share(True).alias("accepted"), share(False).alias("rejected")).first()
    a, r = (float(x) if x is not None else float("nan") for x in got)
    return {"accepted": a, "rejected": r, "balanced": (a + r) / 2}


def url_filter(df: DataFrame, known: Sequence[Rule], url: str = "url", out: str = "url_filter", held_out: int = 10) -> DataFrame:
    """df with a struct column ``out``: host, path, rule (null if none fits), allow (the rule's, else the models'), score.

    The URLs that rules decide are the labelled ones: every one of them counts for the models, but for one in
    ``held_out`` (by hash), which set the limit. All others are scored: allowed at the limit or above. A null URL counts
    as an empty one. With no labelled URL of one class the limit is 0 and the models know only the other class.
    Repeated URLs are scored once and share the result; a URL that very many rows share is joined in several tasks. A very long
    URL becomes a row for each of its characters, one after the other. A column of df called ``out`` is replaced; an
    empty table gives an empty one.
    """
    key, had = fresh(df, "_u"), [c for c in df.columns if c.lower() != out.lower()]
    u = quoted(url)
    distinct = _labelled(df, known, url)
    rows = int(distinct.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"])
    labelled = distinct.where("accepted is not null")
    model = stored(fit(labelled.where(~_fold(0, held_out))), "url-model")
    test = labelled.where(_fold(0, held_out))
    limit = calibrated(score(test.select("u").distinct(), model).join(test, "u"))
    keys = (F.xxhash64(F.col("u"), F.lit(1)).alias("k1"), F.xxhash64(F.lit(2), F.col("u")).alias("k2"))
    scores = score(distinct.where("accepted is null").select("u"), model).select(*keys, "score")
    names = [fresh(df, x) for x in ("_host", "_path", "_rule")]
    h, p, r = names
    read = df.select(*[quoted(c) for c in had], _seen(u).alias(key), host(u).alias(h), path(u).alias(p), ruled(host(u), path(u), known).alias(r))
    joined = with_rows(read, key, out, scores, rows, "left")
    verdict = F.coalesce(of("d", r)["allow"], F.col("j.score") >= limit)
    result = F.struct(of("d", h).alias("host"), of("d", p).alias("path"), of("d", r)["rule"].alias("rule"), verdict.alias("allow"), F.when(of("d", r).isNull(), F.col("j.score")).alias("score"))
    return joined.select(*[of("d", c).alias(c) for c in had], result.alias(out))


RULES = rules("""
allow org/
block example.org/es/
block example.org/en/1
allow com/fr/
block com/de/
""")


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    x = F.col("url_filter")
    return url_filter(pages, RULES).select("page_id", x["host"].alias("host"), x["path"].alias("path"), x["rule"].alias("rule"), F.when(x["allow"], "allow").otherwise("block").alias("verdict"), x["score"].alias("score"))
