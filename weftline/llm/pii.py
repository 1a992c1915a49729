"""Personal data: base patterns, high-recall candidates, gradient-boosted trees.

Base kinds (email, ip, card, phone) are patterns with a check of each match and
always stay. Beyond them generators propose overlapping candidate spans with
few demands. Each candidate is described by small categorical features of its
format (length, digits, separators, letter case, shape of its parts) and of its
context (the nearest announcing word before it and how near it is, what follows, the line), so that every candidate falls in one of a bounded
number of cells. Cells are counted over all documents; boosted trees
(``pyspark.ml``) are fitted to the cells, weighted by count, against the strict
check of a candidate's kind (domain, octets, Luhn, digit count, mixed secret),
which is not itself a feature. A threshold per kind is the lowest score above
which held-out candidates pass the check with at least ``precision``; cells
above it are accepted, and their candidates join the spans.

Only DataFrame and ML functions of the JVM. A document's spans are found within
its row; what is shuffled are cell counts. The cells are at most the product of
the features' levels (``CELLS``), so their scores fit a literal.

Defined cases: a null text is an empty one, without spans; rows that repeat a
doc_id are separate; a text of any length and any number of matches is searched
whole; spans that start alike go by their end; other columns are ignored, whatever
their names; a corpus without candidates, or
whose candidates all pass or all fail, keeps the base spans alone; no rows give
no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written
from .spans import bound, distinct_sorted, find_all, fold

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Base patterns. A match begins where the one before ended or after a character that can't begin one further left,
#: and loops are possessive, so that long runs cost linear time; the matches are those of the plain patterns.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*BASE, "secret")
#: Candidate generators: kind and pattern, each wider than what its kind needs.
GENERATORS = {
    "email": (r"(?:\G|(?<=[\s<(\[\"',;:]|^))[^\s@<>()\[\]\"',;:]++@[^\s@<>()\[\]\"',;:]++", r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++\s?(?:\[at\]|\(at\))\s?[A-Za-z0-9-]++(?:\s?(?:\.|\[dot\]|\(dot\))\s?[A-Za-z0-9-]++)++"),
    "ip": (r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])",),
    "card": (r"(?<![0-9A-Za-z])[0-9](?:[\x20.-]?[0-9]){11,20}(?![0-9A-Za-z])",),
    "phone": (r"(?<![0-9A-Za-z])\+?\(?[0-9]{1,4}\)?(?:[\x20.-]?\(?[0-9]{2,5}\)?){2,5}(?![0-9A-Za-z])",),
    "secret": (r"(?<![0-9A-Za-z])[0-9A-Za-z]{16,}+", r"(?i)(?<![a-z])(?:password|passwd|secret|token|api[_-]?key)\s?[=:]\s?\"?[^\s\"]{6,}+\"?"),
}
#: Only texts with one of these can hold a match or a candidate.
GATE = r"[0-9@=]|\[at\]|\(at\)|(?i:password|passwd|secret|token|api[_-]?key)"
#: Levels of the features; a cell is their mixed-radix number.
LEVELS = {"generator": 8, "length": 5, "digits": 5, "separators": 4, "letters": 4, "context": 4, "distance": 3, "after": 3, "line": 2}
CELLS = reduce(lambda a, b: a * b, LEVELS.values())
#: Words that announce a value: of persons, and of machines and secrets.
_ANNOUNCED = ("mail|call|phone|tel|fax|mobile|contact|card|visa|account|write to|reach", "ip|host|server|address|login|password|key|token|secret")
SPAN = "struct<kind:int,start:int,end:int>"
_PIECE = "array<struct<from:int,n:int,kind:int>>"


def digits_of(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(t: Column) -> Column:
    """Whether the digits of t pass the Luhn check."""
    d = F.transform(F.split(F.reverse(digits_of(t)), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    value = lambda x, i: F.when(i % 2 == 0, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.aggregate(F.transform(d, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def octets(t: Column) -> Column:
    """Whether every dotted part is at most 255."""
    small = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "").rlike(r"^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")
    return F.forall(F.split(t, r"\."), small)


def passes(kind: str, t: Column) -> Column:
    """The check of a base match."""
    n = F.length(digits_of(t))
    if kind == "ip":
        return octets(t)
    if kind == "card":
        return n.between(13, 19) & luhn(t)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def strict(kind: str, t: Column) -> Column:
    """What a candidate is fitted against."""
    if kind == "email":
        whole = t.rlike(r"^[A-Za-z0-9._%+-]++(?:@|\s?[\[(]at[\])]\s?)[A-Za-z0-9.\[\]() -]++$")
        return whole & t.rlike(r"(?:\.|[\[(]dot[\])])\s?[A-Za-z]{2,63}[.]?$")
    if kind == "secret":
        return t.rlike("[0-9]") & t.rlike("[A-Za-z]")
    return passes(kind, t) & (t.startswith("+") if kind == "phone" else F.lit(True))


def _level(value: Column, *steps: int) -> Column:
    return reduce(lambda acc, k: acc + F.when(value >= k, 1).otherwise(0), steps, F.lit(0))


def _cell(generator: int, s: Column) -> Column:
    t = s["text"]
    features = {
        "generator": F.lit(generator),
        "length": _level(F.length(t), 8, 12, 17, 24),
        "digits": _level(F.length(digits_of(t)), 1, 6, 9, 13),
        "separators": _level(F.regexp_count(t, F.lit(r"[\x20().@=:-]")), 1, 3, 5),
        "letters": F.when(t.rlike("[A-Z]"), 2).otherwise(0) + F.when(t.rlike("[a-z]"), 1).otherwise(0),
        # the nearest announcing word before it, else a digit; how near such a word is; what follows; whether it begins a line
        "context": F.coalesce(*(F.when(s["left"].rlike(rf"(?i)\b(?:{words})(?:\w*\W+\w+){{0,2}}\w*\W*$"), F.lit(k + 1)) for k, words in enumerate(_ANNOUNCED)), F.when(s["left"].rlike(r"[0-9]\W*$"), 3), F.lit(0)),
        "distance": F.when(s["left"].rlike(rf"(?i)\b(?:{'|'.join(_ANNOUNCED)})\w*\W*$"), 2).when(s["left"].rlike(rf"(?i)\b(?:{'|'.join(_ANNOUNCED)})\w*\W+\w+\W*$"), 1).otherwise(0),
        "after": F.when(s["right"].rlike(r"^\w"), 2).when(s["right"].rlike(r"^[^\s\w]"), 1).otherwise(0),
        "line": F.when((s["left"] == "") | s["left"].rlike(r"\n\s*$"), 1).otherwise(0),
    }
    return reduce(lambda acc, name: acc * LEVELS[name] + features[name], LEVELS, F.lit(0)).cast("int")


def _valid(matches: Column, number: int, kind: str) -> Column:
    """The places of the matches that pass their kind's check."""
    good = F.filter(matches, lambda s: passes(kind, s["text"]))
    return F.transform(good, lambda s: F.struct(F.lit(number).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _described(matches: Column, generator: int, kind: str) -> Column:
    """The candidates of a generator with their cell and strict check."""
    number = KINDS.index(kind)
    return F.transform(
        matches,
        lambda s: F.struct(F.lit(number).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _cell(generator, s).alias("cell"), strict(kind, s["text"]).cast("int").alias("y")),
    )


def _found(text: Column) -> tuple[Column, Column]:
    """(base, candidates) of a text: arrays of kind, start, end, and of kind, start, end, cell, y."""
    base = [_valid(find_all(text, pattern), k, kind) for k, (kind, pattern) in enumerate(BASE.items())]
    every = [(kind, pattern) for kind, patterns in GENERATORS.items() for pattern in patterns]
    proposed = [_described(find_all(text, pattern), g, kind) for g, (kind, pattern) in enumerate(every)]
    gate = text.rlike(GATE)
    candidates = F.when(gate, F.concat(*proposed)).otherwise(F.array().cast("array<struct<kind:int,start:int,end:int,cell:int,y:int>>"))
    return F.when(gate, F.concat(*base)).otherwise(F.array().cast(f"array<{SPAN}>")).alias("base"), candidates.alias("candidates")


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (array of kind, start, end) and candidates (array of kind, start, end, cell, y)."""
    src = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return src.select("doc_id", *_found(F.col("text")))


def accepted_cells(extracted: DataFrame, precision: float = 0.9, trees: int = 8, depth: int = 4, seed: int = 7) -> list[int]:
    """The cells whose candidates are selected; at most CELLS numbers reach the driver."""
    rows = extracted.select(F.pmod(F.xxhash64("doc_id"), F.lit(4)).alias("fold"), F.explode("candidates").alias("c"))
    counts = rows.groupBy((F.col("fold") == 0).alias("held_out"), F.col("c.kind").alias("kind"), F.col("c.cell").alias("cell"), F.col("c.y").alias("y")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    radix, cell = [], F.col("cell")
    for name in reversed(LEVELS):
        radix.append(F.pmod(cell, F.lit(LEVELS[name])).cast("double").alias(name))
        cell = F.floor(cell / LEVELS[name])
    cells = written(counts.select("held_out", "kind", "cell", F.col("y").cast("double").alias("label"), "n", *radix).coalesce(1), "pii-cells").cache()
    fit = cells.filter(~F.col("held_out"))
    if fit.select(F.count_distinct("label")).first()[0] < 2:
        cells.unpersist()
        return []
    assemble = VectorAssembler(inputCols=list(LEVELS), outputCol="x")
    model = GBTClassifier(featuresCol="x", labelCol="label", weightCol="n", maxIter=trees, maxDepth=depth, maxBins=16, stepSize=0.3, seed=seed).fit(assemble.transform(fit))
    every = cells.groupBy("kind", "cell", *LEVELS).agg(
        F.sum(F.when(F.col("held_out"), F.col("n")).otherwise(0.0)).alias("held"), F.sum(F.when(F.col("held_out"), F.col("n") * F.col("label")).otherwise(0.0)).alias("held_good")
    )
    scored = model.transform(assemble.transform(every)).select("kind", "cell", "held", "held_good", vector_to_array("probability")[1].alias("score")).collect()
    cells.unpersist()
    out = []
    for kind in {r.kind for r in scored}:  # the lowest score above which held-out candidates pass often enough
        good = all_ = 0.0
        best, threshold = sorted((r for r in scored if r.kind == kind), key=lambda r: -r.score), None
        for i, r in enumerate(best):
            good, all_ = good + r.held_good, all_ + r.held
            if all_ and good / all_ >= precision and (i + 1 == len(best) or best[i + 1].score < r.score):
                threshold = r.score
        out += [r.cell for r in best if threshold is not None and r.score >= threshold]
    return sorted(out)


def selected(accepted: list[int]) -> Column:
    """Base spans and accepted candidates that no base span of their kind covers: array of (kind, start, end), by kind, then start."""
    words = [0] * (CELLS // 64 + 1)
    for cell in accepted:
        words[cell // 64] |= 1 << cell % 64
    bits = F.from_json(F.lit(str([w - (1 << 64) if w >> 63 else w for w in words])), "array<bigint>")  # a constant
    taken = F.filter("candidates", lambda c: F.getbit(F.get(bits, F.floor(c["cell"] / 64).cast("int")), c["cell"] % 64) == 1)
    entry = lambda s, own: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"))
    every = F.array_sort(F.concat(F.transform("base", lambda s: entry(s, 0)), F.transform(taken, lambda s: entry(s, 1))))

    def step(held: Column, s: Column) -> tuple[Column, Column]:
        upto = F.when(held["kind"] == s["kind"], held["upto"]).otherwise(-1)  # where the last base span of the kind ends
        new = F.struct(s["kind"].alias("kind"), F.when(s["own"] == 0, s["end"]).otherwise(upto).alias("upto"))
        one = F.array(F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        return new, F.when((s["own"] == 1) & (s["end"] <= upto), F.array().cast(f"array<{SPAN}>")).otherwise(one)

    return distinct_sorted(bound(every, lambda a: fold(a, F.struct(F.lit(-1).alias("kind"), F.lit(-1).alias("upto")), step, SPAN)))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find(docs: DataFrame, precision: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of kind number, start, end) of every document."""
    extracted = written(extract(docs, id_col, text_col), "pii")
    accepted = accepted_cells(extracted, precision)
    return extracted.select("doc_id", F.array_sort("base").alias("base"), selected(accepted).alias("spans"))


def redact(docs: DataFrame, precision: float = 0.9, text_col: str = "text") -> DataFrame:
    """docs with each span replaced by its kind in brackets; spans that overlap become one. A null text stays null."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    text = F.col("row").getField(text_col)
    extracted = written(rows.select("row", F.xxhash64(text).alias("doc_id"), *_found(text_or_empty(text))), "pii-texts")
    accepted = accepted_cells(extracted, precision)
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    order = F.array_sort(F.transform(selected(accepted), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        new = F.array(F.struct(at.alias("from"), (s["start"] - at).alias("n"), s["kind"].alias("kind")))
        return F.greatest(at, s["end"]), F.when(s["start"] >= at, new).otherwise(F.array().cast(_PIECE))

    def redacted(spans: Column) -> Column:
        piece = lambda x: F.concat(F.substring(text, x["from"] + 1, x["n"]), F.get(names, x["kind"]))
        return fold(spans, F.lit(0), step, _PIECE[6:-1], lambda at, out: F.concat(F.array_join(F.transform(out, piece), ""), F.substring(text, at + 1, F.length(text))))

    done = bound(order, lambda spans: F.when(F.size(spans) > 0, redacted(spans)).otherwise(text))
    return extracted.select(F.col("row").withField(text_col, done).alias("row")).select("row.*")
