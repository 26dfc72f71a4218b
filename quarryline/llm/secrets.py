"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers. DataFrame functions only.

Patterns give spans of kinds assign, access and hex. Candidates of the method are runs of CANDIDATE_CHARS or more
characters of ``[A-Za-z0-9+/_.=-]`` with a letter and a digit; the sum of their log-likelihood ratios (random string
over identifier, character by character) is compared with a length-proportional threshold; runs above are spans of kind
markov. Both models are first-order chains over 68 symbols with add-ALPHA smoothing, trained from labelled samples: random strings made
from SHA-256 (base 64, hexadecimal, upper-case base 32-like, mixed), and the identifiers of a sample of documents, from
which the spans of the patterns have been cut. A document is in the sample if the hash of its id and text is low enough: all
of up to SAMPLE_DOCS documents, of more about SAMPLE_DOCS (expected; its deviation is that of a binomial count).

Spans are in code points, end exclusive. Defined results: null text is empty text: no spans, the SHA-256 of the empty
string; an empty table trains on random strings alone and returns no rows; repeated rows give repeated results and are in the
sample together; spans that start together are in the order of kinds. Texts are scanned whole, whatever their length. scan()
passes other columns through, but for one named spans, which it replaces; report() reads doc_id and text only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns: kind, pattern as given, and the pattern that a failing match does not pass.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
CANDIDATE_CHARS = 16
RUN = r"[A-Za-z0-9+/_.=-]{16,}"
#: The least mean log-likelihood ratio (nats a character) of a random string.
THRESHOLD = 0.9
SAMPLE_DOCS, SAMPLE_RANDOM, ALPHA = 1000, 4000, 0.5
#: Matches of a text that are placed one after the other.
CHUNK = 256
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"


def found(text: Column, pattern: str) -> Column:
    """start, end, value of each leftmost non-overlapping match: the pieces between matches give the places."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(between, 1, F.size(values)), values, lambda gap, value: F.struct(F.length(gap).alias("gap"), value.alias("value")))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["value"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value"))).alias("out"))

    def placed(some: Column, at: Column) -> Column:
        return F.aggregate(some, F.struct(at.alias("at"), empty.alias("out")), add, lambda acc: acc["out"])

    def pieces(every: Column) -> Column:
        # an array that grows by one is copied each time, so matches are placed in pieces of CHUNK, each from its own start
        parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(every) / CHUNK).cast("int") - 1), lambda k: F.slice(every, k * CHUNK + 1, CHUNK))
        none = F.array().cast("array<struct<at:int,part:array<struct<gap:int,value:string>>>>")

        def move(acc: Column, part: Column) -> Column:
            size = F.aggregate(part, F.lit(0), lambda n, x: n + x["gap"] + F.length(x["value"]))
            return F.struct((acc["at"] + size).alias("at"), F.array_append(acc["out"], F.struct(acc["at"].alias("at"), part.alias("part"))).alias("out"))

        begun = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), move, lambda acc: acc["out"])
        return F.flatten(F.transform(begun, lambda p: placed(p["part"], p["at"])))

    few = F.get(F.transform(F.array(steps), lambda every: F.when(F.size(every) > CHUNK, pieces(every)).otherwise(placed(every, F.lit(0)))), F.lit(0))
    return F.when(F.size(values) > 0, few).otherwise(empty)


def _spans(text: Column, kind: str) -> Column:
    pattern = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "markov": RUN}[kind]
    # the prefilter of assign finds what any passing match holds
    some = text.rlike(pattern)
    spans = found(text, pattern)
    if kind == "assign":
        spans = F.filter(spans, lambda s: F.length(F.regexp_extract(s["value"], ASSIGN_VALUE, 1)) >= 6)
    return F.when(some, spans).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _pairs(strings: DataFrame) -> DataFrame:
    """a, b, n: how often symbol b follows a; a is ^ at a string's start."""
    chars = strings.select(F.split(F.concat(F.lit("^"), "value"), "").alias("c"))
    pairs = chars.select(F.explode(F.sequence(F.lit(1), F.size("c") - 1)).alias("i"), "c").select(F.element_at("c", F.col("i")).alias("a"), F.element_at("c", F.col("i") + 1).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def random_strings(spark) -> DataFrame:
    """Labelled random: value."""
    i = F.col("id").cast("string")
    digest = F.sha2(F.concat(F.lit("random"), i), 256)
    b64 = F.base64(F.unhex(digest))
    kinds = [b64, digest, F.concat(F.lit("AKIA"), F.upper(F.substring(F.regexp_replace(b64, "[^A-Za-z0-9]", ""), 1, 16))), F.regexp_replace(b64, "[+/=]", ""), F.translate(F.substring(b64, 1, 40), "+/=", "-__")]
    return spark.range(SAMPLE_RANDOM).select(F.element_at(F.array(*kinds), (F.col("id") % len(kinds) + 1).cast("int")).alias("value"))


def identifiers(docs: DataFrame) -> DataFrame:
    """Labelled ordinary: value. A bounded sample, see SAMPLE_DOCS."""
    rows, places = docs.count(), 1 << 40
    chosen = F.lit(True) if rows <= SAMPLE_DOCS else F.pmod(F.xxhash64("doc_id", "text"), F.lit(places)) < places * SAMPLE_DOCS // rows
    sample = docs.where(chosen).select(F.coalesce("text", F.lit("")).alias("text"))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    runs = sample.select(F.explode(F.regexp_extract_all(clean, F.lit("[A-Za-z0-9+/_.=-]{2,}"), F.lit(0))).alias("value"))
    return runs.where(~(F.col("value").rlike("[0-9]") & (F.length("value") >= CANDIDATE_CHARS)))


def train(docs: DataFrame) -> dict[str, float]:
    """Log-likelihood ratio of each pair of symbols; at most 69 x 68 numbers come to the driver."""
    both = _pairs(random_strings(docs.sparkSession)).withColumn("label", F.lit(1)).unionByName(_pairs(identifiers(docs)).withColumn("label", F.lit(0)))
    counts: tuple[dict, dict] = ({}, {})
    for r in both.collect():
        counts[r["label"]][r["a"] + r["b"]] = r["n"]
    totals = [{a: sum(c.get(a + b, 0) for b in SYMBOLS) + ALPHA * len(SYMBOLS) for a in "^" + SYMBOLS} for c in counts]
    return {a + b: math.log((counts[1].get(a + b, 0) + ALPHA) / totals[1][a]) - math.log((counts[0].get(a + b, 0) + ALPHA) / totals[0][a]) for a in "^" + SYMBOLS for b in SYMBOLS}


def ratio(value: Column, model: dict[str, float]) -> Column:
    """Mean log-likelihood ratio of a string's characters, looked up in one array by the two symbols."""
    order = "^" + SYMBOLS
    table = F.array(*[F.lit(model.get(a + b, 0.0)) for a in order for b in order])
    place = F.transform(F.split(F.concat(F.lit("^"), value), ""), lambda c: F.instr(F.lit(order), c))
    steps = F.zip_with(F.slice(place, 1, F.length(value)), F.slice(place, 2, F.length(value)), lambda a, b: F.element_at(table, (a - 1) * len(order) + b))
    return F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x) / F.length(value)


def _tagged(text: Column, rank: int, kind: str, model: dict[str, float]) -> Column:
    spans = _spans(text, kind)
    if kind == "markov":
        spans = F.filter(spans, lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]") & (ratio(s["value"], model) >= THRESHOLD))
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))


def scan(docs: DataFrame, model: dict[str, float] | None = None) -> DataFrame:
    """docs (with any columns) and spans: array of kind, start, end, value, ordered by start, then kind as listed."""
    model = train(docs) if model is None else model
    text = F.coalesce(F.col("text"), F.lit(""))
    by_kind = [_tagged(text, n, kind, model) for n, kind in enumerate(KINDS)]
    return docs.withColumn("spans", F.array_sort(F.concat(*by_kind)))


def joined(spans: Column, keep=None) -> Column:
    spans = F.filter(spans, keep) if keep else spans
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, model: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    got = scan(docs.select("doc_id", "text"), model)
    counts = [F.size(F.array_remove(F.col("spans.kind"), other)).cast("long") for other in KINDS]  # all but that kind
    counts = [(F.size("spans") - n).alias(f"n_{k}") for n, k in zip(counts, KINDS[:3], strict=False)]
    return got.select("doc_id", *counts, F.sha2(joined(F.col("spans"), lambda s: s["kind"] != "markov"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
