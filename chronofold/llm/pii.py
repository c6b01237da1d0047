"""Personal data by weak supervision, in DataFrame functions only.

Candidate spans come from a strict and a loose pattern for each kind. Five labelers vote on each: the strict pattern with
its check, a checksum, a gazetteer (top-level domains, card prefixes, calling codes, address ranges), words before the
span, and whether it stands alone. Votes are counted by pattern over the corpus; expectation-maximisation on these
counts estimates how reliable each labeler is, and a logistic span classifier is trained on the resulting probabilities.
The count table has a bounded number of rows (kinds x vote patterns x length classes), and the fits are a few sums over it
on the driver. Strict spans always stay; the classifier adds further ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import private, written

KINDS = ("email", "ip", "card", "phone")
#: A character that no pattern matches marks the ends of matches; where texts hold it, another stands in for it.
_MARK, _STAND_IN = chr(0xE000), chr(0xE001)
_SPANS = "array<struct<kind:int,s:int,e:int,m:string,strict:boolean,before:string,after:string>>"

#: Leftmost matches of the contract's patterns: none can start within a run whose beginning could not start one, so starts
#: are only tried at the beginning of a run (or where the last match ended), and no quantifier needs to give back.
STRICT = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){15,}+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: What a text must hold for the strict pattern to match at all.
NEEDED = ("@", ".", None, "+")
LOOSE = (
    r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9][A-Z0-9._%+-]{0,63}+\x20?(?:\(at\)|\[at\])\x20?[A-Z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Z0-9-]{1,63}+){1,8}+",
    r"(?i)(?<![0-9A-F:])(?:[0-9A-F]{1,4}:){7}[0-9A-F]{1,4}(?![0-9A-F:])",
    r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,14}+(?![\x20-]?[0-9])",
    r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
)
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_DOMAINS = "com|org|net|edu|gov|io|info|biz|co|de|fr|es|uk|it|nl|eu|ch|at|us|ca|au|jp|cn|in|br|mx|ru|test|example|local"
_CODES = "1|7|20|27|3[0-469]|4[0134-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
CONTEXT = (
    "mail|contact|write|kontakt|correo|courriel",
    r"\bip\b|server|host|address|adresse|dirección",
    "card|visa|master|credit|payment|karte|tarjeta|carte",
    "phone|call|tel|mobile|fax|telefon|llama|appel|number",
)
LABELERS = ("strict", "checksum", "gazetteer", "context", "alone")
CONTEXT_CHARS = 32


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), the value computed once for a row, also where ``then`` uses it within functions of an array's elements."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _running(values: Column, zero: Column, join: Callable[[Column, Column], Column], levels: int = 2, block: int = 64) -> Column:
    """What joins all elements before each element (a variable or column): block by block, so the work hardly exceeds their number."""
    fold = lambda part: F.aggregate(part, zero, join)
    if not levels:
        return F.transform(values, lambda _, i: fold(F.slice(values, F.lit(1), i)))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(values) / block).cast("int") - 1)), lambda b: fold(F.slice(values, b * block + 1, F.lit(block))))
    return _let(blocks, lambda sums: _let(_running(sums, zero, join, levels - 1, block), lambda starts: F.transform(values, lambda _, i: join(F.get(starts, F.floor(i / block).cast("int")), fold(F.slice(values, i - i % block + 1, i % block))))))


def _pieces(text: Column, kind: int, pattern: str, strict: bool, needed: Column | None = None) -> Column:
    """struct<kind, strict, p>: the text cut at a pattern's leftmost matches, which are every second piece; no pieces where the text
    lacks what a match needs."""
    cut = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK)
    return F.struct(F.lit(kind).alias("kind"), F.lit(strict).alias("strict"), (cut if needed is None else F.when(needed, cut).otherwise(F.array().cast("array<string>"))).alias("p"))


def _located(parts: Column) -> Column:
    """array<struct<kind, s, e, m, strict, before, after>> of the matches of _pieces: s and e in code points, e exclusive; the
    CONTEXT_CHARS characters before and the one after. What a match needs is read from the pieces around it, so the work is
    linear in the text and in its matches."""
    # every second piece is a match of at least one character, so twice as many pieces hold the context
    most = 2 * CONTEXT_CHARS

    def located(p: Column, sizes: Column, at: Column, tails: Column) -> Column:
        def found(k: Column) -> Column:
            i = 2 * k + 1
            first = F.greatest(F.lit(0), i - most)
            before = F.concat_ws("", F.slice(tails, first + 1, i - first))
            after = F.concat(F.substring(F.get(p, i + 1), 1, 1), F.substring(F.coalesce(F.get(p, i + 2), F.lit("")), 1, 1))
            return F.struct(
                parts["kind"].alias("kind"), F.get(at, i).alias("s"), (F.get(at, i) + F.get(sizes, i)).alias("e"), F.get(p, i).alias("m"), parts["strict"].alias("strict"),
                F.substring(before, -CONTEXT_CHARS, CONTEXT_CHARS).alias("before"), F.substring(after, 1, 1).alias("after"),
            )

        return F.transform(F.sequence(F.lit(0), F.floor(F.size(p) / 2).cast("int") - 1), found)

    def cut(p: Column) -> Column:
        sizes, tails = F.transform(p, F.length), F.transform(p, lambda x: F.substring(x, -CONTEXT_CHARS, CONTEXT_CHARS))
        return _let(sizes, lambda n: _let(_running(n, F.lit(0), lambda x, y: x + y), lambda at: _let(tails, lambda t: located(p, n, at, t))))

    return F.when(F.size(parts["p"]) > 2, cut(parts["p"])).otherwise(F.array().cast(_SPANS))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid(kind: Column, match: Column) -> Column:
    """The contract's check of a strict match."""
    digits = _digits(match)
    return (
        F.when(kind == 0, F.lit(True))
        .when(kind == 1, match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
        .when(kind == 2, F.length(digits).between(16, 19) & F.call_function("luhn_check", digits))
        .otherwise(F.length(digits).between(8, 15))
    )


def _votes(c: Column) -> Column:
    """The candidate with its labelers' votes (1 yes, -1 no, 0 nothing) and its class of lengths."""
    kind, m = c["kind"], c["m"]
    digits = _digits(m)
    vote = lambda yes: F.when(yes, 1).otherwise(-1)
    before = F.lower(c["before"])
    checksum = F.when(kind == 0, vote(m.rlike(r"(?i)[a-z]{2,24}$"))).when(kind == 1, vote(~c["strict"] | c["ok"])).when(kind == 2, vote(F.call_function("luhn_check", digits))).otherwise(vote(F.length(digits).between(8, 15)))
    gazetteer = (
        F.when(kind == 0, F.when(m.rlike(rf"(?i)(?:{_DOMAINS})$"), 1).otherwise(0))
        .when(kind == 1, F.when(c["strict"], vote(m.rlike(r"^0*(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\."))).otherwise(0))
        .when(kind == 2, vote(digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)")))
        .otherwise(F.when(c["strict"], F.when(digits.rlike(f"^(?:{_CODES})"), 1).otherwise(0)).otherwise(F.when(digits.rlike("^[2-9]"), 1).otherwise(-1)))
    )
    context = F.lit(0)
    for k, words in enumerate(CONTEXT):
        context = F.when((kind == k) & before.rlike(words), 1).otherwise(context)
    alone = vote(~before.rlike(r"[A-Za-z0-9_#=.\-]$") & ~c["after"].rlike("[A-Za-z0-9_]"))
    return F.struct(
        kind.alias("kind"), c["s"].alias("s"), c["e"].alias("e"), (c["strict"] & c["ok"]).alias("base"),
        F.when(c["strict"] & c["ok"], 1).otherwise(0).alias("strict"), checksum.alias("checksum"), gazetteer.alias("gazetteer"), context.alias("context"), alone.alias("alone"),
        F.least(F.lit(3), F.floor((c["e"] - c["s"]) / 8)).cast("int").alias("size"),
    )


def candidates(text: Column) -> Column:
    """All candidate spans of a text with their votes; a null text has none."""

    def found(plain: Column) -> Column:
        out = [_pieces(plain, kind, STRICT[kind], True, F.contains(plain, F.lit(NEEDED[kind])) if NEEDED[kind] else None) for kind in range(4)]
        needed = {0: F.lower(plain).rlike(r"[(\[]at[)\]]"), 1: F.contains(plain, F.lit(":"))}
        out += [_pieces(plain, kind, LOOSE[kind], False, needed.get(kind)) for kind in range(4)]
        # one function over the patterns, not one for each: the plan stays small
        return F.flatten(F.transform(F.array(*out), _located))

    spans = _let(F.translate(F.coalesce(text, F.lit("")), _MARK, _STAND_IN), found)
    checked = F.transform(spans, lambda c: c.withField("ok", _valid(c["kind"], c["m"])))
    return F.transform(checked, _votes)


def _reliabilities(rows: list[dict], steps: int = 100) -> list[float]:
    """Expectation-maximisation over counted vote patterns: the probability of personal data for each row.

    Within a kind the labelers are taken as independent given the truth; their probabilities of each vote, under either
    truth, start from 0.7 for the right one and are smoothed by one count.
    """
    p = [0.0] * len(rows)
    for kind in range(len(KINDS)):
        own = [i for i, r in enumerate(rows) if r["kind"] == kind]
        if not own:
            continue
        share = 0.5
        table = {(name, truth, vote): {(1, 1): 0.7, (1, -1): 0.1, (0, 1): 0.1, (0, -1): 0.7}.get((truth, vote), 0.2) for name in LABELERS for truth in (0, 1) for vote in (-1, 0, 1)}
        for _ in range(steps):
            moved = 0.0
            for i in own:
                odds = math.log(share / (1 - share)) + sum(math.log(table[n, 1, rows[i][n]] / table[n, 0, rows[i][n]]) for n in LABELERS)
                new = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
                moved, p[i] = max(moved, abs(new - p[i])), new
            total = sum(rows[i]["n"] for i in own)
            yes = sum(rows[i]["n"] * p[i] for i in own)
            share = (yes + 1) / (total + 2)
            for name in LABELERS:
                for vote in (-1, 0, 1):
                    here = [i for i in own if rows[i][name] == vote]
                    table[name, 1, vote] = (sum(rows[i]["n"] * p[i] for i in here) + 1) / (yes + 3)
                    table[name, 0, vote] = (sum(rows[i]["n"] * (1 - p[i]) for i in here) + 1) / (total - yes + 3)
            if moved < 1e-6:
                break
        # a labeler's yes must not speak against personal data: else the two truths have changed places; one that never says
        # yes here has only its smoothing to speak with, and no say
        lean = sum(math.log(table[n, 1, 1] / table[n, 0, 1]) for n in LABELERS if any(rows[i][n] == 1 for i in own))
        if lean < 0:
            for i in own:
                p[i] = 1 - p[i]
    return p


def _features(r: dict) -> list[tuple[str, float]]:
    return [(f"kind{r['kind']}", 1.0), (f"kind{r['kind']} size{r['size']}", 1.0), *((f"{n} {r[n]}", 1.0) for n in LABELERS)]


def train(counted: list[dict], steps: int = 300) -> dict[str, float]:
    """Weights of the span classifier: logistic regression on the probabilities of the counted patterns, by weighted descent."""
    p = _reliabilities(counted)
    total = sum(r["n"] for r in counted) or 1
    weights: dict[str, float] = {}
    # every strict span is personal data by definition, whatever the estimate
    wanted = [1.0 if r["strict"] == 1 else x for r, x in zip(counted, p, strict=True)]
    for _ in range(steps):
        slope = {}
        for r, y in zip(counted, wanted, strict=True):
            z = sum(weights.get(f, 0.0) for f, _ in _features(r))
            e = r["n"] / total * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y)
            for f, _ in _features(r):
                slope[f] = slope.get(f, 0.0) + e
        for f, g in slope.items():
            weights[f] = weights.get(f, 0.0) * 0.9995 - 2.0 * g
    return weights


def _chosen(found: Column, weights: dict[str, float]) -> Column:
    """Strict spans, and others that the classifier accepts where they meet no strict span of their kind."""

    def accepted(c: Column) -> Column:
        terms = [F.lit(0.0)]
        for name, w in sorted(weights.items()):
            if " " not in name:
                terms.append(F.when(c["kind"] == int(name[4:]), w).otherwise(0.0))
            elif name.startswith("kind"):
                k, size = name[4:].split(" size")
                terms.append(F.when((c["kind"] == int(k)) & (c["size"] == int(size)), w).otherwise(0.0))
            else:
                label, vote = name.split(" ")
                terms.append(F.when(c[label] == int(vote), w).otherwise(0.0))
        return reduce(lambda a, b: a + b, terms) >= 0

    # kinds lie far apart on one line; in its order a span meets a strict one if an earlier one ends behind its start, or a
    # later one starts before its end
    far = F.lit(1 << 32)
    line = lambda c: F.struct((c["kind"] * far + c["s"]).alias("from"), (c["kind"] * far + c["e"]).alias("to"), (c["base"] | accepted(c)).alias("good"), c["base"].alias("base"))

    def judged(spans: Column, ends: Column, starts: Column) -> Column:
        n = F.size(spans)
        alone = lambda c, i: (F.get(ends, i) <= c["from"]) & (F.get(starts, n - 1 - i) >= c["to"])
        kept = F.filter(spans, lambda c, i: c["good"] & (c["base"] | alone(c, i)))
        kind = lambda x: F.floor(x / far).cast("int")
        return F.transform(kept, lambda c: F.struct(kind(c["from"]).alias("kind"), (c["from"] % far).cast("int").alias("s"), (c["to"] - kind(c["from"]) * far).cast("int").alias("e"), c["base"].alias("base")))

    def told(spans: Column) -> Column:
        ends = F.transform(spans, lambda c: F.when(c["base"], c["to"]).otherwise(F.lit(-1).cast("long")))
        starts = F.reverse(F.transform(spans, lambda c: F.when(c["base"], c["from"]).otherwise(F.lit(1 << 62))))
        latest = lambda x: _running(x, F.lit(-1).cast("long"), _larger)
        first = lambda x: _running(x, F.lit(1 << 62), lambda a, b: F.least(a, b))
        return _let(ends, lambda e: _let(latest(e), lambda before: _let(starts, lambda x: _let(first(x), lambda behind: judged(spans, before, behind)))))

    return _let(F.sort_array(F.transform(found, line)), told)


def learned(found: DataFrame) -> dict[str, float]:
    """Counts the votes of a table with a column ``found`` of candidates, and trains on the counts (at most some thousand rows)."""
    names = ["kind", *LABELERS, "size"]
    counted = found.select(F.explode("found").alias("c")).select(*(F.col(f"c.{n}").alias(n) for n in names)).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    return train([r.asDict() for r in counted.orderBy(*names).collect()])


def _told(spans: Column) -> Column:
    name = lambda c: F.element_at(F.array(*map(F.lit, KINDS)), c["kind"] + 1)
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", name(c), c["s"].cast("string"), c["e"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> strict spans' counts and hash, and all spans, a row for each row.

    Null texts count as empty: no spans, the hash of an empty string. The texts are read once; the candidates are written
    to the shared folder, counted there, and judged. Without any candidate (so in an empty table) nothing is learned and
    nothing added. Null ids stay null, repeated rows give repeated results, other columns are not read; the work is linear in
    a text and in its matches.
    """
    found = written(docs.select(docs["doc_id"].cast("long").alias("doc_id"), candidates(docs["text"]).alias("found")), "candidates")
    weights = learned(found)
    judged = found.select("doc_id", _chosen(F.col("found"), weights).alias("spans"))
    base = F.filter("spans", lambda c: c["base"])
    of = lambda kind: lambda c: c["kind"] == kind
    counts = [F.size(F.filter(base, of(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return judged.select("doc_id", *counts, F.sha2(_told(base).cast("binary"), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"))


def _pieces_of(text: Column, sizes: tuple[int, ...] = (1 << 16, 1 << 10)) -> Column:
    """The text in pieces of sizes[-1] code points: cut into large ones first, as a place is found by counting from the start."""
    of = lambda whole, size: F.transform(F.sequence(F.lit(0), F.floor(F.length(whole) / size).cast("int")), lambda i: F.substring(whole, i * size + 1, F.lit(size)))
    return F.flatten(F.transform(of(text, sizes[0]), lambda part: F.filter(of(part, sizes[1]), lambda x: F.length(x) > 0)))


def _masked_text(text: Column, spans: Column, piece: int = 1 << 10) -> Column:
    """spans(s, e, kind), sorted: each replaced by its kind in angle brackets; where spans meet, the first one counts for all."""
    marks = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))

    def joined(c: Column, reach: Column, parts: Column) -> Column:
        def between(start: Column, end: Column) -> Column:
            first = F.floor(start / piece).cast("int")
            held = F.concat_ws("", F.slice(parts, first + 1, F.floor(end / piece).cast("int") - first + 1))
            return F.substring(held, start - first * piece + 1, end - start)

        kept = F.transform(c, lambda x, i: F.when(x["s"] >= F.get(reach, i), F.concat(between(F.get(reach, i), x["s"]), F.element_at(marks, x["kind"] + 1))).otherwise(F.lit("")))
        last = F.greatest(F.get(reach, F.size(c) - 1), F.get(c, F.size(c) - 1)["e"])
        return F.concat(F.concat_ws("", kept), between(last, F.length(text)))

    ends = lambda c: F.transform(c, lambda x: x["e"])
    reached = lambda c, then: _let(ends(c), lambda e: _let(_running(e, F.lit(0), _larger), then))
    return _let(spans, lambda c: reached(c, lambda reach: _let(_pieces_of(text), lambda parts: joined(c, reach, parts))))


def masked(docs: DataFrame) -> DataFrame:
    """The same rows and columns, every span replaced by its kind in angle brackets; where spans meet, the first one counts.

    Texts without spans stay as they are: null stays null, empty stays empty. Repeated rows and ties are treated alike, an
    empty table gives an empty one, other columns are carried along, whatever their names. Rows and candidates are written
    to the shared folder first, so the texts are searched once; the work is linear in a text and in its matches.
    """
    name, chosen = private(docs, "found", "chosen")
    found = written(docs.withColumn(name, candidates(docs["text"])), "candidates")
    weights = learned(found.select(F.col(name).alias("found")))
    spans = F.sort_array(F.transform(_chosen(F.col(name), weights), lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"))))
    found = found.withColumn(chosen, F.when(F.size(name) > 0, spans))  # a step of its own, or the nested functions are too deep to resolve
    return found.withColumn("text", F.when(F.size(chosen) > 0, _masked_text(F.col("text"), F.col(chosen))).otherwise(F.col("text"))).select(*(F.col(f"`{c}`") for c in docs.columns))
