"""Scalar text functions as Column expressions. All are JVM-side and lose no rows: null text is empty text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that decide what a token is.
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "of", "on", "or", "the", "to", "with"]
JUDGE_STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "of", "on", "or", "the", "to", "what", "when", "where",
    "which", "who", "why", "with", "吗", "呢", "的", "了", "是", "什么", "怎么", "如何",
]
HOP_STOPWORDS = [*JUDGE_STOPWORDS, "does", "do", "did"]
GENERIC_TITLE_TOKENS = ["record", "type", "object", "field", "fields", "module", "guide", "overview", "helper", "helpers", "api", "doc", "docs"]
LATIN, CJK_RUN = "[a-z0-9_]+", "[\\u4e00-\\u9fff]+"
WILDCARD = r"(?i)(?<![a-z0-9_])[a-z][a-z0-9.]*\s*/\s*\*(?![a-z0-9_])"
INTENTS = [
    ("history", r"(?i)(?:之前|上次|讨论|会话|当时|历史|previous|last\s+(?:time|session)|history)"),
    ("exact_evidence", r"(?i)(?:原文|逐字|代码|字段|field\s+id|api|record|script|exact|verbatim)"),
    ("comparison", r"(?i)(?:比较|区别|差异|对比|compare|versus|vs\.?|difference)"),
    ("research", r"(?i)(?:研究|深入|调研|research|deep\s+dive)"),
    ("concept", r"(?i)(?:步骤|怎么|如何|怎样|流程|做法|配置|安装|介绍|指南|guide|how\s+to|steps?|setup|configure|install)"),
]
#: A Latin name of three or more characters.
ENTITY = r"(?U)\b[A-Za-z][\w.:-]{2,}\b"
REDACTIONS = [
    (r"(?U)\b1[3-9]\d{9}\b", "[REDACTED_PHONE]"),
    (r"(?U)\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b", "[REDACTED_EMAIL]"),
    (r"(?U)\b\d{17}[0-9Xx]\b", "[REDACTED_ID_CARD]"),
    (r"(?U)\b(?:\d[ -]*?){13,19}\b", "[REDACTED_BANK_CARD]"),
    (r"(?im)^(\s*Authorization\s*:\s*)[^\r\n]+", "$1[REDACTED_SECRET]"),
    (r"(?im)^(\s*(?:Set-Cookie|Cookie)\s*:\s*).+$", "$1[REDACTED_SECRET]"),
    (r"(?iU)\b(session_?id)\s*=\s*[^\s,;]+", "$1=[REDACTED_SECRET]"),
    (r"(?iU)\b(?:sk|pk|api|token|secret)[-_][A-Za-z0-9_-]{10,}\b", "[REDACTED_SECRET]"),
    (r"(?iU)(password|passwd|secret|token|api_key|apikey)\s*[:=]\s*[^\s,;]+", "$1=[REDACTED_SECRET]"),
]
REDACTION_LABELS = {"phone": "[REDACTED_PHONE]", "email": "[REDACTED_EMAIL]", "id_card": "[REDACTED_ID_CARD]", "bank_card": "[REDACTED_BANK_CARD]", "secret": "[REDACTED_SECRET]"}
FRESHNESS_MAX, FRESHNESS_DAYS = 12.0, 90
STEP_MAX, STEP_FULL = 4.0, 5
STEP_ITEM = r"(?m)(?:^\s*\d{1,3}\s*[\.\)、]|^\s*第[一二三四五六七八九十百\d]+步)"


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, also where use calls it in a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def casefold(c: Column | str) -> Column:
    """Lower case with the two foldings that matter to tokens: sharp s and long s."""
    return F.replace(F.replace(F.lower(text_of(c)), F.lit("ß"), F.lit("ss")), F.lit("ſ"), F.lit("s"))


def _without(values: Column, stop: Sequence[str]) -> Column:
    return F.filter(values, lambda w: ~w.isin(*stop))


def _plain(c: Column | str) -> Column:
    """Folded text without namespace wildcards, which only a text with a star can have."""
    return bind(casefold(c), lambda t: F.when(F.contains(t, F.lit("*")), F.regexp_replace(t, WILDCARD, " ")).otherwise(t))


def _latin(plain: Column) -> Column:
    return _without(F.regexp_extract_all(plain, F.lit(LATIN), F.lit(0)), STOPWORDS)


def _cjk(plain: Column) -> Column:
    return F.when(F.rlike(plain, F.lit(CJK_RUN)), F.flatten(F.transform(F.regexp_extract_all(plain, F.lit(CJK_RUN), F.lit(0)), pairs_of))).otherwise(F.array().cast("array<string>"))


def latin_tokens(c: Column | str) -> Column:
    return _latin(_plain(c))


def pairs_of(run: Column) -> Column:
    return F.when(F.length(run) == 1, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2))))


def cjk_tokens(c: Column | str) -> Column:
    return bind(_plain(c), _cjk)


def tokens(c: Column | str) -> Column:
    """Latin tokens without stopwords, then bigrams of CJK runs. A namespace wildcard (ns/*) is no token."""
    return bind(_plain(c), lambda t: F.concat(_latin(t), _cjk(t)))


def normalised(c: Column | str) -> Column:
    return F.array_join(tokens(c), " ")


def passage_units(c: Column | str) -> Column:
    return F.regexp_extract_all(text_of(c), F.lit("[A-Za-z0-9_]+|[\\u4e00-\\u9fff]|[^\\s]"), F.lit(0))


def response_units(c: Column | str) -> Column:
    return F.regexp_count(text_of(c), F.lit(r"(?U)\S+")).cast("long")


def title_tokens(c: Column | str) -> Column:
    """Words of two or more letters, digits or underscores, distinct."""
    return F.array_distinct(F.filter(F.regexp_extract_all(casefold(c), F.lit(r"(?U)[\w一-鿿]+"), F.lit(0)), lambda w: F.length(w) > 1))


def judge_tokens(c: Column | str, stop: Sequence[str] = JUDGE_STOPWORDS) -> Column:
    """Distinct tokens of the evidence judge: Latin words and whole CJK runs of two or more characters."""
    return F.array_distinct(judge_sequence(c, stop))


def judge_sequence(c: Column | str, stop: Sequence[str] = JUDGE_STOPWORDS) -> Column:
    return F.filter(F.regexp_extract_all(casefold(c), F.lit("[a-z0-9_]+|[\\u4e00-\\u9fff]+"), F.lit(0)), lambda w: ~w.isin(*stop) & (F.length(w) > 1))


def multiword_runs(c: Column | str) -> Column:
    return F.regexp_extract_all(text_of(c), F.lit(r"(?i)[a-z0-9_]+(?:\s+[a-z0-9_]+)+"), F.lit(0))


def phrase_tokens(c: Column | str) -> Column:
    """Tokens of two or more characters of the runs of several Latin words."""
    return F.filter(F.flatten(F.transform(multiword_runs(c), latin_tokens)), lambda w: F.length(w) > 1)


def namespace_wildcards(c: Column | str) -> Column:
    """Prefixes of ns/* expressions, in order, once each."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text_of(c), F.lit(WILDCARD), F.lit(0)), lambda w: F.trim(F.regexp_replace(casefold(w), r"\s*/\s*\*$", ""))))


def intent(c: Column | str) -> Column:
    """The first of INTENTS that occurs; else exact_entity if there is a Latin name, else concept."""
    text = text_of(c)
    chain = None
    for name, pattern in INTENTS:
        chain = F.when(text.rlike(pattern), name) if chain is None else chain.when(text.rlike(pattern), name)
    return chain.when(text.rlike(ENTITY), "exact_entity").otherwise("concept")


def language_bucket(c: Column | str) -> Column:
    cjk, latin = text_of(c).rlike("[\\u4e00-\\u9fff]"), text_of(c).rlike("[A-Za-z]")
    return F.when(cjk & latin, "mixed").when(cjk, "cjk").when(latin, "latin").otherwise("unknown")


def alias_key(c: Column | str) -> Column:
    """Letters and digits only, folded: the key under which titles and aliases meet."""
    return F.regexp_replace(casefold(c), r"(?U)[\W_]+", "")


def bigrams(key: Column) -> Column:
    """Distinct character pairs of a key; a one-letter key is its own."""
    return F.when(F.length(key) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.when(F.length(key) < 2, F.array(key)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - 1, F.lit(1))), lambda i: F.substring(key, i, F.lit(2))))))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def slug(c: Column | str, fallback: str = "page", limit: int = 80) -> Column:
    """Lower-case words joined by hyphens, cut at limit characters."""
    made = F.regexp_replace(F.regexp_replace(casefold(c), r"(?U)[^\w一-鿿]+", "-"), "^-+|-+$", "")
    made = F.regexp_replace(F.substring(made, 1, limit), "-+$", "")
    return F.when(made == "", fallback).otherwise(made)


def sha256(*parts: Column | str) -> Column:
    """SHA-256 of parts joined by NUL."""
    return F.sha2(F.concat_ws("\0", *[F.col(p) if isinstance(p, str) else p for p in parts]), 256)


def redact(c: Column | str) -> Column:
    """Nine rules in order, each on the result of those before it."""
    out = text_of(c)
    for pattern, replacement in REDACTIONS:
        out = F.regexp_replace(out, pattern, replacement)
    return out


#: For each rule of REDACTIONS a cheap pattern without which it cannot match.
_HINTS = [r"1[3-9]\d{9}", "@", r"\d{17}[0-9Xx]", r"(?:\d[ -]*?){13}", r"(?i)authorization", r"(?i)cookie", r"(?i)session", r"(?i)(?:sk|pk|api|token|secret)[-_]", r"(?i)(?:password|passwd|secret|token|api_key|apikey)\s*[:=]"]


def redacted(c: Column | str) -> Column:
    """text after redaction, counts by label and their total, all from one evaluation; a text without digits, @ and key words is not gone over."""
    some = "|".join(f"(?:{h})" for h in (r"\d(?:[ -]*\d){10}", "@", "(?i:authorization|cookie|session|password|passwd|secret|token|api_key|apikey|(?:sk|pk|api)[-_])"))

    def count(before: Column) -> Column:
        return bind(_rules(before), lambda after: F.struct(after.alias("text"), F.struct(*[n.alias(k) for k, n in redaction_counts(before, after).items()]).alias("counts"), sum(redaction_counts(before, after).values(), F.lit(0)).alias("total")))

    none = F.struct(*[F.lit(0).cast("long").alias(k) for k in REDACTION_LABELS])
    return bind(text_of(c), lambda t: F.when(F.rlike(t, F.lit(some)), count(t)).otherwise(F.struct(t.alias("text"), none.alias("counts"), F.lit(0).cast("long").alias("total"))))


def _rules(text: Column) -> Column:
    """The rules one after the other, each evaluated once and only where its hint is."""
    steps = list(zip(_HINTS, REDACTIONS, strict=True))

    def after(value: Column, k: int) -> Column:
        if k == len(steps):
            return value
        hint, (pattern, replacement) = steps[k]
        return bind(F.when(F.rlike(value, F.lit(hint)), F.regexp_replace(value, F.lit(pattern), F.lit(replacement))).otherwise(value), lambda v: after(v, k + 1))

    return after(text, 0)


def redaction_counts(before: Column, after: Column) -> dict[str, Column]:
    """Placeholders added, by label."""
    def count(text: Column, mark: str) -> Column:
        return (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)
    return {label: F.greatest(count(after, mark) - count(before, mark), F.lit(0)).cast("long") for label, mark in REDACTION_LABELS.items()}


def freshness_bonus(updated: Column | str, as_of: Column | str) -> Column:
    """12 (1 - days / 90) for ages of 0 to 90 days, to three places."""
    day = F.try_to_date(F.substring(text_of(updated), 1, 10), "yyyy-MM-dd")
    age = F.datediff(F.col(as_of) if isinstance(as_of, str) else as_of, day)
    return F.when(age.between(0, FRESHNESS_DAYS), F.bround(FRESHNESS_MAX * (1 - age / FRESHNESS_DAYS), 3)).otherwise(0.0)


def step_count(c: Column | str) -> Column:
    return F.regexp_count(text_of(c), F.lit(STEP_ITEM)).cast("long")


def step_bonus(n: Column) -> Column:
    return STEP_MAX * F.least(n, F.lit(STEP_FULL)) / STEP_FULL


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, to 12 places."""
    return F.bround(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x), 12)


def unit(a: Column) -> Column:
    """a at length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(a, lambda x: x.cast("double") / norm)).otherwise(F.transform(a, lambda x: x.cast("double")))


def embedding_text(title: Column, heading_path: Column, body: Column) -> Column:
    """Title, heading path and body on lines; a first heading equal to the title is dropped."""
    rest = F.when((F.size(heading_path) > 0) & (F.trim(F.element_at(heading_path, 1)) == F.trim(title)), F.slice(heading_path, 2, F.size(heading_path))).otherwise(heading_path)
    path = F.array_join(F.filter(rest, lambda h: F.trim(h) != ""), " > ")
    return F.concat_ws("\n", F.when(F.trim(title) != "", title), F.when(path != "", path), body)


def rrf(rank: Column, k: int = 60, weight: float = 1.0) -> Column:
    return F.when(rank.isNotNull(), weight / (k + rank)).otherwise(0.0)


def authority_bonus(path: Column, corpus: Column, source_kind: Column, question_intent: Column, scope: Column, freshness: Column) -> Column:
    history = corpus == "history"
    base = (
        F.when(history | (source_kind == "raw_chat"), -0.15).when(path.contains("/entities/"), 0.35).when(path.contains("/projects/"), 0.23)
        .when(path.contains("/concepts/"), 0.35).when(source_kind.startswith("raw"), 0.0).otherwise(0.35)
    )
    return base + F.when(history & (question_intent == "history"), 0.25).otherwise(0.0) + F.when(history & (scope == "history"), 0.15).otherwise(0.0) - F.when(F.coalesce(freshness, F.lit("fresh")).isin("stale", "review_required"), 0.20).otherwise(0.0)


def title_overlap_bonus(question: Column | str, title: Column | str) -> Column:
    """0.15 of the share of question words in the title; 2 more if two neighbouring words, joined, are in the joined title."""
    q, t = title_tokens(question), title_tokens(title)
    share = F.when((F.size(q) > 0) & (F.size(t) > 0), 0.15 * F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(0.0)
    words = F.regexp_extract_all(casefold(question), F.lit(LATIN), F.lit(0))
    compact = F.regexp_replace(casefold(title), "[^a-z0-9_]+", "")
    joined = bind(words, lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, b)))
    return share + F.when(bind(compact, lambda name: F.exists(joined, lambda x: (F.length(x) >= 5) & F.contains(name, x))), 2.0).otherwise(0.0)


def relative_graph_score(evidence: Column, cap: Column) -> Column:
    return F.bround(cap * evidence / (evidence + 3.0), 12)


def path_matches_prefix(path: Column, prefix: str) -> Column:
    """On a directory boundary."""
    prefix = prefix.rstrip("/")
    return (path == prefix) | path.startswith(prefix + "/")
