"""Personal data by weak supervision, in DataFrame operations only.

Candidates are the matches of strict patterns (the base: email, ip, card, phone) and of loose ones (phones without a country
code, spelled-out emails, card-like and address-like numbers that fail the base's tests, titled names, secret tokens). Four
labelers vote on each loose candidate, for, against or not at all: pattern, gazetteer, context, shape. Expectation-maximisation
over the counts of vote patterns estimates, without any label, how reliable each labeler is for each kind; its posteriors train
a logistic classifier over kinds and votes, which accepts or rejects each loose candidate. Base spans always stay, and take no
part in the fit: the base pattern would vote for itself.

What leaves the executors for the fit is one count for each (kind, vote pattern): at most len(KINDS) * 3 ** 4 rows at any
input size. Texts are scanned whole. The patterns are written so that Java's matcher neither recurses per character nor
rescans a long run from each of its characters: runs start where no run character stands before them, and are possessive.

Defined results: null text is empty; repeated rows are handled each; overlapping spans of different kinds are all listed
and redacted as one, which takes the kind that begins first (of several the longest); an empty table gives an empty result and an untrained classifier
that adds nothing; `redact` keeps columns of any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import let, read, staged

_EMAIL_CHAR = "[A-Za-z0-9._%+-]"
_START = r"(?:\G|(?<!{0}))"
#: Equal in their matches to the contract's patterns.
BASE = {
    "email": _START.format(_EMAIL_CHAR) + _EMAIL_CHAR + r"++@[A-Za-z0-9-]++\.[A-Za-z0-9-](?:[A-Za-z0-9.-](?<!\.\.))*(?<!\.)",
    "ip": _START.format("[0-9]") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[0-9\x20-](?<![\x20-][\x20-]))+(?<=[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: kind: (pattern, cheap test that must hold before the pattern is tried)
LOOSE = {
    "phone": r"(?<![0-9A-Za-z+])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++\x20?(?:[(\[]dot[)\]]|\.)\x20?[A-Za-z0-9-]++",
    "ip": r"(?<![0-9.])[0-9]{1,4}+(?:\.[0-9]{1,4}+){3}(?![0-9.])",
    "card": r"(?<![0-9A-Za-z+.-])(?:[0-9]{12,19}+|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9A-Za-z.-])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.\x20[A-Z][a-z]++(?:\x20[A-Z][a-z]++)?",
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}+",
}
KINDS = ("email", "ip", "card", "phone", "name", "secret")
#: Gazetteers: endings of mail domains, first digits of card issuers, area codes that no subscriber has, given names,
#: openings of issued keys, first parts of reserved networks.
DOMAIN_ENDS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at", "be", "pl", "se", "ca", "au", "jp", "br", "in", "us", "co")
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "60", "62", "65")
NO_AREA = ("0", "1")
GIVEN = (
    "anna", "ana", "andrea", "anne", "antonio", "bernard", "carlos", "carmen", "charles", "christine", "claire", "claudia", "daniel", "david", "elena", "elizabeth", "emma", "eva", "francisco", "george", "hans", "heinrich", "helen",
    "henri", "isabel", "jacques", "james", "jan", "jane", "jean", "jennifer", "john", "jorge", "jose", "joseph", "juan", "julia", "karl", "klaus", "laura", "linda", "louis", "lucia", "luis", "maria", "marie", "mark", "martin", "mary",
    "michael", "monique", "nicole", "patricia", "paul", "pedro", "peter", "philippe", "pierre", "robert", "sarah", "sofia", "stefan", "susan", "thomas", "ursula", "werner", "william", "wolfgang",
)
ISSUED = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "sk-", "sk_", "pk_", "xox", "eyJ", "AIza", "ya29", "SG.", "npm_")
RESERVED = ("0", "127", "255")
#: Words before a span that speak for or against it.
CUES = {
    "email": "mail|contact|write|reply|address",
    "ip": "ip|host|server|address|from|login",
    "card": "card|visa|master|amex|credit|debit|payment",
    "phone": "phone|call|tel|mobile|cell|fax|contact",
    "name": "from|by|signed|contact|dear|author",
    "secret": "token|key|secret|password|passwd|pwd|auth|bearer|credential|api",
}
AGAINST = "version|release|isbn|issn|doi|order|invoice|page|section|figure|chapter|sha|commit|md5|checksum|hash"
REACH = 40
LABELERS = ("pattern", "gazetteer", "context", "shape")
ROUNDS, STEPS = 50, 600
#: Matches that one step of the position sums handles.
_BLOCK = 64
_SPAN = "struct<start:int,stop:int,value:string>"


def matches(text: Column, pattern: str) -> Column:
    """array<struct(start, stop, value)> of all matches, in code points.

    Positions are sums over the gaps and matches before, taken in blocks: adding to one long array copies it each time.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(found.alias("value"), F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(found), F.lit(0))).alias("gap"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.length(x["value"])
        one = F.struct(start.alias("start"), stop.alias("stop"), x["value"].alias("value"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def joined(rows: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(rows)), lambda i: (i % _BLOCK == 0) & (i < F.size(rows)))
        return let(F.transform(starts, lambda i: F.aggregate(F.slice(rows, i + 1, _BLOCK), zero, step)), placed)

    def placed(blocks: Column) -> Column:
        before = F.aggregate(
            blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"]
        )
        shift = lambda one, at: F.transform(one["out"], lambda y: F.struct((y["start"] + at).alias("start"), (y["stop"] + at).alias("stop"), y["value"].alias("value")))
        return F.flatten(F.zip_with(blocks, before, shift))

    return let(zipped, joined)


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substr(F.ltrim(p, F.lit("0")), F.lit(1), F.lit(3)).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _checked(kind: str):
    return lambda x: valid(kind, x["value"])


def _base_spans(spans: Column, kind: str) -> Column:
    """Base spans; labelers have no vote on them."""
    none = [F.lit(0).alias(k) for k in LABELERS]
    return F.transform(spans, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("order"), F.lit(kind).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), F.lit(True).alias("base"), *none))


def _starts(value: Column, *openings: str) -> Column:
    return F.array_contains(F.array(*(F.startswith(value, F.lit(c)) for c in openings)), True)


def _labelled(text: Column, spans: Column, kind: str) -> Column:
    """Loose spans with their votes: 1 for, -1 against, 0 none."""

    def votes(x: Column) -> Column:
        value, low = x["value"], F.lower(x["value"])
        before = F.lower(F.substr(text, F.greatest(x["start"] - REACH, F.lit(0)) + 1, F.least(x["start"], F.lit(REACH))))
        around = F.concat(F.substr(text, F.greatest(x["start"], F.lit(1)), F.when(x["start"] > 0, 1).otherwise(0)), F.substr(text, x["stop"] + 1, F.lit(1)))
        digits = F.regexp_replace(value, "[^0-9]", "")
        is_ = lambda pattern: F.rlike(value, F.lit(pattern))
        for_ = lambda test, other=-1: F.when(test, 1).otherwise(other)
        pattern = {
            "email": for_(is_(r"[(\[]at[)\]].*[(\[]dot[)\]]"), 0),
            "ip": for_(F.forall(F.split(value, r"\."), lambda p: p.cast("int") <= 255)),
            "card": for_(luhn(digits)),
            "phone": for_(is_(r"^\(|^[0-9]{3}([.-])[0-9]{3}\1")),
            "name": for_(is_(r"\x20[A-Z][a-z]+\x20[A-Z]"), 0),
            "secret": for_(is_("[0-9]") & is_("[A-Za-z]")),
        }[kind]
        gazetteer = {
            "email": for_(F.regexp_extract(low, r"([a-z0-9-]+)$", 1).isin(*DOMAIN_ENDS)),
            "ip": for_(~F.regexp_extract(value, "^([0-9]+)", 1).isin(*RESERVED)),
            "card": for_(_starts(digits, *ISSUERS)),
            "phone": for_(~_starts(digits, *NO_AREA)),
            "name": for_(F.regexp_extract(low, r"\.\x20([a-z]+)", 1).isin(*GIVEN), 0),
            "secret": for_(_starts(value, *ISSUED), 0),
        }[kind]
        context = F.when(F.rlike(before, F.lit(rf"\b(?:{AGAINST})\W*$")), -1).when(F.rlike(before, F.lit(rf"\b(?:{CUES[kind]})\w*\W*\w*\W*$")), 1).otherwise(0)
        shape = {
            "card": F.when(F.length(digits) == 16, 0).otherwise(-1),
            "secret": F.when(is_("[0-9].*[A-Za-z].*[0-9].*[A-Za-z].*[0-9]"), 1).otherwise(-1),
        }.get(kind, F.when(F.rlike(around, F.lit(r"[A-Za-z0-9]")), -1).otherwise(1))
        named = [v.cast("int").alias(k) for k, v in zip(LABELERS, (pattern, gazetteer, context, shape))]
        return F.struct(F.lit(KINDS.index(kind)).alias("order"), F.lit(kind).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), F.lit(False).alias("base"), *named)

    return F.transform(spans, votes)


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs (no column of which begins with two underscores) with `__found`: all candidates of each text, with votes, by kind and start."""
    none = F.array().cast(f"array<{_SPAN}>")
    out = docs.withColumn("__body", F.coalesce(F.col(text), F.lit("")))
    body = F.col("__body")
    has = {"email": F.contains(body, F.lit("@")), "ip": F.rlike(body, F.lit(r"[0-9]\.[0-9]")), "card": F.rlike(body, F.lit(r"[0-9][0-9\x20-]{10}")), "phone": F.contains(body, F.lit("+"))}
    # a layer of columns at a time: each call analyses the whole plan again
    out = out.withColumns({f"__{kind}": F.when(has[kind], F.filter(matches(body, pattern), _checked(kind))).otherwise(none) for kind, pattern in BASE.items()})
    taken = F.concat(*(F.col(f"__{k}") for k in BASE))
    hints = has | {
        "phone": F.rlike(body, F.lit(r"[0-9]{3}[\x20.-][0-9]{4}")),
        "email": F.contains(body, F.lit("at)")) | F.contains(body, F.lit("at]")),
        "name": F.rlike(body, F.lit(r"(?:Mr|Mrs|Ms|Dr|Prof)\.\x20[A-Z]")),
        "secret": F.rlike(body, F.lit("[0-9][A-Za-z_+/=-]|[A-Za-z_+/=-][0-9]")),
    }
    apart = lambda taken, x: ~F.exists(taken, lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"]))
    # taken is bound outside the lambda: inside, the optimiser would put the patterns of all base spans into each test
    # one parameter only: a second one would be given the element's index
    free = lambda pattern: lambda t: F.filter(matches(body, pattern), lambda x: apart(t, x))
    loose = {kind: let(taken, free(pattern)) for kind, pattern in LOOSE.items()}
    out = out.withColumns({f"__loose_{kind}": F.when(hints[kind], spans).otherwise(none) for kind, spans in loose.items()})
    parts = [_base_spans(F.col(f"__{k}"), k) for k in BASE] + [_labelled(body, F.col(f"__loose_{k}"), k) for k in LOOSE]
    out = out.withColumn("__found", F.concat(*parts))
    return out.drop("__body", *(f"__{k}" for k in BASE), *(f"__loose_{k}" for k in LOOSE))


def vote_counts(candidates: DataFrame) -> DataFrame:
    """One row for each (kind, vote pattern) of a loose candidate that occurs, with its count."""
    # the filter is on the exploded rows, behind an outer explode: it can't be pushed below the arrays
    rows = candidates.select(F.explode_outer("__found").alias("f")).select("f.kind", "f.base", *(f"f.{k}" for k in LABELERS))
    return rows.groupBy("kind", "base", *LABELERS).agg(F.count(F.lit(1)).alias("n")).where("kind IS NOT NULL AND NOT base").drop("base")


def reliabilities(counts: list[tuple]) -> tuple[dict, dict]:
    """Expectation-maximisation over (kind, votes..., n): P(vote | truth) of each labeler and kind, posterior of each pattern.

    Starts from the majority vote, with one pseudo-count for each vote value, so that a kind with few rows stays near it.
    """
    post = {r[:-1]: 1 / (1 + math.exp(-1.5 * sum(r[1:-1]))) for r in counts}
    tables: dict = {}
    for _ in range(ROUNDS if counts else 0):
        for kind in {r[0] for r in counts}:
            mine = [r for r in counts if r[0] == kind]
            mass = [sum(r[-1] * (post[r[:-1]] if y else 1 - post[r[:-1]]) for r in mine) for y in (0, 1)]
            tables[kind, "prior"] = [(mass[y] + 1) / (sum(mass) + 2) for y in (0, 1)]
            for j, name in enumerate(LABELERS):
                for y in (0, 1):
                    seen = {v: 1 + (1.0 if (v > 0) == (y > 0) and v else 0.0) for v in (-1, 0, 1)}
                    for r in mine:
                        seen[r[1 + j]] += r[-1] * (post[r[:-1]] if y else 1 - post[r[:-1]])
                    total = sum(seen.values())
                    tables[kind, name, y] = {v: n / total for v, n in seen.items()}
            for r in mine:
                ll = [math.log(tables[kind, "prior"][y]) + sum(math.log(tables[kind, name, y][r[1 + j]]) for j, name in enumerate(LABELERS)) for y in (0, 1)]
                post[r[:-1]] = 1 / (1 + math.exp(max(-60.0, min(60.0, ll[0] - ll[1]))))
    return tables, post


def _features(kind: str, votes: tuple) -> list[float]:
    return [1.0, *(float(kind == k) for k in KINDS), *(float(v == side) for v in votes for side in (1, -1))]


def train(counts: list[tuple]) -> list[float]:
    """Weights of the span classifier: a bias, one for each kind, then for and against of each labeler; fitted to the posteriors."""
    _, post = reliabilities(counts)
    rows = [(_features(r[0], r[1:-1]), post[r[:-1]], math.sqrt(r[-1])) for r in counts]
    w, total = [0.0] * (1 + len(KINDS) + 2 * len(LABELERS)), sum(r[2] for r in rows) or 1.0
    for _ in range(STEPS if rows else 0):
        grad = [0.005 * x for x in w]
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-max(-60.0, min(60.0, sum(a * b for a, b in zip(w, x))))))
            for j, v in enumerate(x):
                grad[j] += n / total * (p - y) * v
        w = [a - 1.5 * g for a, g in zip(w, grad)]
    return w


def fit(candidates: DataFrame) -> list[float]:
    return train(sorted(tuple(r) for r in vote_counts(candidates).collect()))


def accepted(found: Column, w: list[float]) -> Column:
    """The base spans, and the loose candidates that the classifier takes."""

    def keep(f: Column) -> Column:
        score = F.lit(w[0]) + F.element_at(F.array(*(F.lit(x) for x in w[1 : 1 + len(KINDS)])), f["order"] + 1)
        for j, name in enumerate(LABELERS):
            at = 1 + len(KINDS) + 2 * j
            score = score + F.when(f[name] == 1, w[at]).when(f[name] == -1, w[at + 1]).otherwise(0.0)
        return f["base"] | (score > 0)

    return F.filter(found, keep)


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    ordered = F.sort_array(F.transform(spans, lambda f: F.struct(f["start"].alias("start"), f["order"].alias("order"), f["stop"].alias("stop"), f["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["stop"].cast("string"))), ",")


def _greatest_before(ends: Column) -> Column:
    """For each block of _BLOCK ends the greatest of all blocks before it, 0 for the first."""
    starts = F.filter(F.sequence(F.lit(0), F.size(ends)), lambda i: i % _BLOCK == 0)
    return let(F.transform(starts, lambda i: F.coalesce(F.array_max(F.slice(ends, i + 1, _BLOCK)), F.lit(0))), lambda most: F.transform(most, lambda x, j: F.coalesce(F.array_max(F.slice(most, 1, j)), F.lit(0))))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of personal data replaced by its kind in angle brackets; the other columns as they were.

    Each row travels as one struct, so no column's name can clash; candidates are found once and staged beside it.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    found = staged(with_candidates(rows).drop("text"), "pii-candidates")
    weights = fit(found)
    spans = F.sort_array(F.transform(accepted(F.col("__found"), weights), lambda f: F.struct(f["start"].alias("start"), (-f["stop"]).alias("back"), f["stop"].alias("stop"), f["kind"].alias("kind"))))
    body = F.col(f"row.`{text}`")

    def parts(spans: Column) -> Column:
        return let(F.transform(spans, lambda s: s["stop"]), lambda ends: let(_greatest_before(ends), lambda before: marked(spans, ends, before)))

    def marked(spans: Column, ends: Column, before: Column) -> Column:
        """What stands between the spans, with a mark for each; one that begins inside an earlier one has none."""

        def mark(s: Column, i: Column) -> Column:
            rest = i % _BLOCK
            past = F.greatest(F.get(before, F.floor(i / _BLOCK).cast("int")), F.coalesce(F.array_max(F.slice(ends, i - rest + 1, rest)), F.lit(0)))
            return F.when(s["start"] >= past, F.concat(F.substr(body, past + 1, s["start"] - past), F.lit("<"), s["kind"], F.lit(">"))).otherwise("")

        return F.concat(F.array_join(F.transform(spans, mark), ""), F.substr(body, F.array_max(ends) + 1, F.length(body)))

    cleaned = found.withColumn("spans", spans).withColumn("clean", F.when(F.size("spans") > 0, let(F.col("spans"), parts)).otherwise(body))
    return cleaned.select(*(F.col("clean").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = staged(with_candidates(docs).select("doc_id", "__found"), "pii-candidates")
    spans = accepted(F.col("__found"), fit(found))
    base = F.filter("__found", lambda f: f["base"])
    count = lambda k: F.size(F.filter("__found", lambda f: f["base"] & (f["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"))
