"""Secrets in texts: fixed patterns, and character Markov models (DataFrame functions only)."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import written

# Patterns of the kinds that need no model, in the order in which kinds are listed.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")

#: Stands for every character of a span found by pattern, where tokens are sought.
MARK = "\x01"
#: Tokens that the models judge: whole runs of these characters beside no mark.
TOKEN = r"(?<![A-Za-z0-9+/_=\x01-])[A-Za-z0-9+/_=-]{20,}+(?!\x01)"
#: Characters of the least stretch of a token that is judged by itself.
LEAST = 20
#: Spans that are gathered at once.
PART = 256
#: Nats by which a stretch must look more like a random string than like an identifier.
MARGIN = 12.0

# Parts of ordinary identifiers, paths and addresses.
PARTS = """get set is has to from user name file path data list item index count size total page time date start end begin first last next
previous value key type kind node edge graph tree table row column field record string number array object class method function module
package import export request response server client session token cache queue stack buffer stream reader writer parser lexer builder
factory handler manager service controller model view template config option setting default value error warning message log level debug
info test spec mock check validate convert format encode decode compress hash sort search filter map reduce group join merge split trim
load save open close read write create delete update insert remove add append clear reset init main run execute process thread task job
worker schedule event listener callback result output input source target local remote global public private static final abstract http
https www com org net html json xml csv text image video audio color width height left right top bottom center align margin padding
border background style theme icon button label panel window dialog menu toolbar status progress account address email phone country city""".split()


def labelled_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """``n`` random strings (label 1: digests in hexadecimal and base64, in upper and lower case)
    and ``n`` ordinary identifiers (label 0: two to six parts of names in the usual styles)."""
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(digest))
    randoms = spark.range(n).select(
        F.when(F.col("id") % 4 == 0, F.substring(digest, 1, 40)).when(F.col("id") % 4 == 1, F.upper(F.substring(digest, 1, 32))).otherwise(F.substring(b64, 1, 40)).alias("text"),
        F.lit(1).alias("label"),
    )
    parts = F.array(*map(F.lit, PARTS))
    pick = lambda j: F.get(parts, F.pmod(F.xxhash64("id", F.lit(j)), F.lit(len(PARTS))).cast("int"))
    chosen = F.slice(F.array(*[pick(j) for j in range(6)]), 1, F.pmod(F.xxhash64("id"), F.lit(5)).cast("int") + 2)
    style = F.pmod(F.xxhash64("id", F.lit("style")), F.lit(5))
    number = F.when(F.pmod(F.xxhash64("id", F.lit("number")), F.lit(4)) == 0, F.pmod(F.xxhash64("id", F.lit("n")), F.lit(2000)).cast("string")).otherwise("")
    plain = F.array_join(chosen, "")
    text = F.when(style == 0, F.array_join(chosen, "_")).when(style == 1, F.array_join(chosen, "-")).when(style == 2, F.array_join(chosen, "/")).when(style == 3, F.array_join(F.transform(chosen, F.initcap), "")).otherwise(plain)
    ordinary = spark.range(n).select(F.when(F.pmod(F.xxhash64("id", F.lit("case")), F.lit(6)) == 0, F.upper(text)).otherwise(F.concat(text, number)).alias("text"), F.lit(0).alias("label"))
    return randoms.unionByName(ordinary)


def fit_markov(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios of character transitions, random against ordinary.

    Counts the pairs of characters of both classes and returns 128 * 128 numbers: at
    128 * a + b, the log of P(b after a) in random strings over that in ordinary ones, both
    smoothed over the 68 characters a token may have.  Null and empty samples count for
    nothing.  The result has a fixed size, however many samples there are.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    samples = written(samples.select("text", "label"))  # an expression in a lambda would be computed anew for every character
    pairs = samples.select("label", F.explode(F.when(F.length(text) > 1, F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.ascii(F.substring(text, i, F.lit(1))) * 128 + F.ascii(F.substring(text, i + 1, F.lit(1))))).otherwise(F.array().cast("array<int>"))).alias("pair"))
    counts = {(r["label"], r["pair"]): r["n"] for r in pairs.where("pair < 16384").groupBy("label", "pair").agg(F.count("*").alias("n")).collect()}
    ratios = []
    totals = {(y, a): sum(counts.get((y, a * 128 + b), 0) for b in range(128)) for y in (0, 1) for a in range(128)}
    for a in range(128):
        for b in range(128):
            p, q = ((counts.get((y, a * 128 + b), 0) + smoothing) / (totals[y, a] + smoothing * 68) for y in (1, 0))
            ratios.append(round(math.log(p / q), 4))
    return ratios


def spans(kind: str, text: Column, pattern: str, group: int, least: int) -> Column:
    """Matches of the pattern, leftmost and not overlapping, whose group has ``least`` characters
    or more: (kind, start, end, text), in code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    between = F.split(text, pattern, -1)
    span = "struct<kind:string,start:int,end:int,text:string>"
    none, no_parts = F.array().cast(f"array<{span}>"), F.array().cast(f"array<array<{span}>>")
    empty = F.struct(F.lit(0).alias("at"), none.alias("part"), no_parts.alias("parts"))

    def step(acc: Column, x: Column) -> Column:
        """Spans are gathered in parts of PART, since appending copies: n matches cost n * PART, not n * n."""
        start = acc["at"] + F.length(x["between"])
        end = start + F.length(x["found"])
        one = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["found"].alias("text"))
        full = F.size(acc["part"]) >= PART
        part = F.when(full, none).otherwise(acc["part"])
        return F.struct(end.alias("at"), F.when(F.length(x["judged"]) >= least, F.array_append(part, one)).otherwise(part).alias("part"), F.when(full, F.array_append(acc["parts"], acc["part"])).otherwise(acc["parts"]).alias("parts"))

    rows = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("between"), found.alias("found"), judged.alias("judged"))
    return F.aggregate(rows, empty, step, lambda acc: F.flatten(F.array_append(acc["parts"], acc["part"])))


def marked(text: Column, pattern: str, group: int, least: int) -> Column:
    """The text with a mark for each character of the spans that ``spans`` would find: as long as before."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("between"), found.alias("found"), judged.alias("judged"))  # nothing is found after the last piece
    hidden = lambda x: F.when(F.length(x["judged"]) >= least, F.repeat(F.lit(MARK), F.length(x["found"]))).otherwise(x["found"])
    return F.array_join(F.transform(rows, lambda x: F.concat(x["between"], F.coalesce(hidden(x), F.lit("")))), "")


def find_secrets(docs: DataFrame, ratios: list[float], key: str = "doc_id", text: str = "text", margin: float = MARGIN) -> DataFrame:
    """Secrets in every whole text.

    Three kinds by pattern: assign (a value given to a name such as password), access (key ids)
    and hex (long runs of hexadecimal digits).  The fourth, markov, by model: every token that
    overlaps none of those and has letters and digits is a secret if the transitions in some
    stretch of it, of LEAST characters or more, are by ``margin`` nats in all likelier in random
    strings than in identifiers; so a name, path or prefix glued to a secret doesn't hide it.  The
    span is the whole token.  Base spans are hidden before tokens are sought, so that many of both in one
    text are never compared with each other.

    Returns key and ``spans``: structs (kind, start, end, text) by start, then kind in that order;
    positions count code points, ends are exclusive.  Row-wise: no shuffle, no join.  Null and
    empty texts have no span; repeated rows have a row each; extra columns are left out.
    """
    none = F.array().cast("array<struct<kind:string,start:int,end:int,text:string>>")
    body = F.coalesce(F.col(text), F.lit(""))
    model = F.from_json(F.lit(json.dumps(ratios)), "array<double>")

    let = lambda x, f: F.get(F.transform(F.array(x), f), 0)  # noqa: E731 - computes x once, however often f refers to it

    def best(steps: Column) -> Column:
        """Greatest sum over LEAST - 1 or more steps in a row: each sum so far less the least one that lies that many steps back."""
        zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("back"), F.lit(0.0).alias("low"), F.lit(float("-inf")).alias("best"))

        def step(acc: Column, i: Column) -> Column:
            total = acc["sum"] + F.get(steps, i)
            back = F.when(i >= LEAST - 1, acc["back"] + F.get(steps, i - (LEAST - 1))).otherwise(F.lit(0.0))
            low = F.least(acc["low"], back)
            return F.struct(total.alias("sum"), back.alias("back"), low.alias("low"), F.when(i >= LEAST - 2, F.greatest(acc["best"], total - low)).otherwise(acc["best"]).alias("best"))

        return F.aggregate(F.sequence(F.lit(0), F.size(steps) - 1), zero, step, lambda acc: acc["best"])

    def score(token: Column) -> Column:
        codes = F.transform(F.split(token, "", -1), F.ascii)
        return let(codes, lambda c: let(F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: F.get(model, F.get(c, i - 1) * 128 + F.get(c, i))), best))

    kinds = (("assign", ASSIGN, 1, 12, lambda t: t.rlike(ASSIGN)), ("access", ACCESS, 0, 18, lambda t: t.contains("AKIA")), ("hex", "[0-9a-f]{16,}", 0, 16, lambda t: t.rlike("[0-9a-f]{16}")))
    base = docs.select(F.col(key), body.alias("_body")).select(
        key, "_body", F.concat(*[F.when(there(F.col("_body")), spans(k, F.col("_body"), pattern, group, least)).otherwise(none) for k, pattern, group, least, there in kinds]).alias("_base")
    )
    # One pass after another hides the base spans.  A span found by pattern that an earlier one cuts still touches its marks, so the token around both is left out, as it overlaps them.
    seen = base.withColumn("_seen", F.translate("_body", MARK, " "))
    for _, pattern, group, least, there in kinds:
        seen = seen.withColumn("_seen", F.when((F.size("_base") > 0) & there(F.col("_seen")), marked(F.col("_seen"), pattern, group, least)).otherwise(F.col("_seen")))
    tokens = F.when(F.col("_seen").rlike(TOKEN), spans("markov", F.col("_seen"), TOKEN, 0, 20)).otherwise(none)
    mixed = lambda t: t["text"].rlike("[0-9]") & t["text"].rlike("[A-Za-z]")
    judged = seen.withColumn("_tokens", tokens).withColumn("_more", F.filter("_tokens", lambda t: mixed(t) & (score(t["text"]) > margin)))
    place = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    ordered = F.array_sort(F.transform(F.concat("_base", "_more"), lambda s: F.struct(s["start"].alias("start"), place(s).alias("place"), s["end"].alias("end"), s["kind"].alias("kind"), s["text"].alias("text"))))
    return judged.select(key, F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"))).alias("spans"))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digests of the spans that ``find_secrets`` returns."""
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    said = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        key,
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(said(of(*KINDS[:3])), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
    )
