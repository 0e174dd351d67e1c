"""Personal data by candidate gradient boosting, in DataFrame operations only.

Validated patterns give the base spans. Generators of high recall propose more spans, which may overlap; boosted trees
score each from its format and its context; a threshold for each kind, calibrated on rows the trees have not seen, selects
the redactions. Trees become plain column expressions, so a text is read once, in place, and nothing is shuffled.
"""

import re
from dataclasses import dataclass, field
from random import Random

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Patterns of the base kinds. Possessive where that cannot change a match; a run of characters that cannot
#: start a match is not tried again at each of its characters.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Patterns of the generators. A group that may repeat without end is possessive: Java matches it in a loop,
#: while it matches other groups by recursion, whose stack a long run would exhaust.
GENERATORS = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
    "local_phone": r"\(?[0-9]{2,4}\)?[\x20.-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,4}",
    "secret": r"(?:AKIA|ASIA)[0-9A-Z]{12,20}|(?i:passw(?:or)?d|token|secret|api[_-]?key)\x20?[=:]\x20?[\x22']?[A-Za-z0-9+/_-]{6,}",
    "spelled_email": r"[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,64}(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z]{2,24})++",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
_HINT = {"email": "@", "phone": r"\+[0-9]", "spelled_email": r"[(\[]at[)\]]", "secret": r"A[KS]IA|[=:]"}
_NAMES = [*BASE, *GENERATORS]
#: Spans are put together in runs of this many, since every append copies its array.
_RUN = 256
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    at = lambda i: F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * (2 - i % 2)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + F.when(at(i) > 9, at(i) - 9).otherwise(at(i))) % 10 == 0


_VALID = {
    "ip": lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": lambda m: F.length(_digits(m)).between(13, 19) & _luhn(_digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}


def _with_spans(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Adds for each kind a column of its matches: start and end (code points), the match, what stands around it.

    The text is cut at the matches, so places follow from the lengths of what lies between: patterns count in UTF-16.
    """
    names = list(kinds)
    gate = {k: F.when(F.col("_text").rlike(_HINT.get(k, "[0-9]")), F.col("_text")) for k in names}
    df = df.withColumns({f"_m_{k}": F.regexp_extract_all(gate[k], F.lit(kinds[k]), F.lit(0)) for k in names})
    df = df.withColumns({f"_g_{k}": F.when(F.size(f"_m_{k}") > 0, F.split("_text", kinds[k], -1)) for k in names})

    span = "struct<start:int,end:int,m:string,l:string,r:string>"

    def located(k: str) -> str:
        """SQL, which is planned faster than the same in many calls."""
        m, g = f"_m_{k}", f"_g_{k}"
        start, size = f"a.at + length(get({g}, i))", f"length(get({m}, i))"
        own = f"named_struct('start', {start}, 'end', {start} + {size}, 'm', get({m}, i), 'l', right(get({g}, i), 24), 'r', left(get({g}, i + 1), 8))"
        run = f"""aggregate(sequence(b * {_RUN}, least((b + 1) * {_RUN}, size({m})) - 1), named_struct('at', coalesce(get(runs, size(runs) - 1).at, 0), 'out', cast(array() AS array<{span}>)),
            (a, i) -> named_struct('at', {start} + {size}, 'out', array_append(a.out, {own})))"""
        found = f"""aggregate(sequence(0, cast((size({m}) - 1) div {_RUN} AS int)), cast(array() AS array<struct<at:int,out:array<{span}>>>), (runs, b) -> array_append(runs, {run}),
            runs -> flatten(transform(runs, x -> x.out)))"""
        return f"CASE WHEN size({m}) > 0 THEN {found} ELSE cast(array() AS array<{span}>) END"

    return df.withColumns({f"_s_{k}": F.expr(located(k)) for k in names}).drop(*(f"_{x}_{k}" for x in "mg" for k in names))


def features(m: str, left: str, right: str, kind: str) -> list[str]:
    """SQL of what the trees see of a candidate: its format, its kind, and the characters and words around it."""
    has = lambda x, p: f"cast({x} RLIKE r'{p}' AS double)"
    without = lambda p: f"cast(length(regexp_replace({m}, r'{p}', '')) AS double)"
    return [
        without("[^0-9]"), without("[^A-Za-z]"), f"cast(length({m}) AS double)", without(r"[^\x20().-]"), has(m, "[A-Z]"), has(m, "[a-z]"),
        *(f"cast({kind} = '{k}' AS double)" for k in GENERATORS),
        has(left, r"(?i)(tel|phone|call|fax|mobile|cell|contact)[^A-Za-z]*$"), has(left, r"(?i)(iban|account|bank|pay(able)?)[^A-Za-z]*$"),
        has(left, r"(?i)(ssn|social security|security no)[^A-Za-z]*$"), has(left, r"(?i)(order|invoice|ref|isbn|issn|version|no|id|page|figure|table|part|serial)[^A-Za-z]*$"),
        has(left, r"[A-Za-z0-9_/-]$"), has(right, r"^[A-Za-z0-9_/-]"), has(m, r"^\(?(?:000|666|9[0-9]{2})-"), has(m, r"[0-9].*[A-Za-z]|[A-Za-z=:].*[0-9]"),
    ]


#: Forms of the examples' matches for each kind and label, and their left and right contexts. {d4} is four
#: digits, {h4} hex digits, {u4} capitals and digits, {l4} small letters. The last form and the last context of each list are never
#: trained on; only the calibration sees them.
_EXAMPLES = {
    ("iban", 1): (
        ["DE{d2} {d4} {d4} {d4} {d4} {d2}", "GB{d2}{u4}{d14}", "FR{d2}{d10}{u11}{d2}", "ES{d2} {d4} {d4} {d4} {d4}", "NL{d2}{u4}{d10}"],
        [("IBAN: ", "."), ("pay to account ", " by"), ("as said ", ","), ("our bank: ", " until"), ("payable to ", "")],
    ),
    ("iban", 0): (["AB{d2}{u8}", "SN{d2} {u4} {u4}", "TX{d2}{u8}", "PO{d2} {d4} {d4}"], [("part no. ", " in"), ("serial ", " of"), ("order ", " from"), ("the page ", "-A"), ("version ", ".")]),
    ("local_phone", 1): (["({d3}) {d3}-{d4}", "{d3}-{d3}-{d4}", "{d3} {d3} {d4}", "{d4} {d3} {d3}", "{d3}.{d3}.{d4}"], [("call ", " now"), ("tel. ", "."), ("phone ", " or"), ("fax ", ","), ("contact us at mobile: ", "")]),
    ("local_phone", 0): (
        ["{d3}-{d3}-{d4}", "{d2}-{d4}-{d3}", "{d2} {d3} {d3}", "{d3} {d4} {d4}", "{d2}.{d3}.{d3}", "{d4} {d4} {d4}"],
        [("order ", "-1"), ("isbn 978-", "-2"), ("table ", " 17"), ("of 20", " units"), ("with the ", " 1234"), ("version ", ".1"), ("figure ", " 5")],
    ),
    ("secret", 1): (["AKIA{u16}", "password={h18}", "token = \"{h40}", "secret: {h32}", "api_key: {h24}"], [("the key ", " is"), ("the ", " of"), ("set ", "\""), ("with ", "."), ("env ", "")]),
    ("secret", 0): (["password: required", "token: whatever", "secret: nothing", "passwd: optional", "password = unknown"], [("the ", " for"), ("a ", " is"), ("my", " to"), ("their ", "."), ("any ", "")]),
    ("spelled_email", 1): (["{l6} [at] example [dot] com", "{l5}(at)mail.org", "jane.doe (at) site (dot) net", "{l7}[at]post[dot]net", "{l4}.b (at) firm.com"], [("write to ", " soon"), ("mail ", "."), ("", ""), ("contact ", ","), ("reach me: ", " or")]),
    ("spelled_email", 0): (["it (at) the . end", "x[at] a . be", "on (at) a . it"], [("see ", " of"), ("look", "low"), ("go ", " as"), ("was ", "")]),
    ("ssn", 1): (["1{d2}-{d2}-{d4}", "4{d2}-{d2}-{d4}", "2{d2}-{d2}-{d4}", "5{d2}-{d2}-{d4}"], [("SSN ", ""), ("social security number is ", " and"), ("ssn: ", ","), ("my security no ", "."), ("whose SSN: ", " of")]),
    ("ssn", 0): (["3{d2}-{d2}-{d4}", "1{d2}-{d2}-{d4}", "000-{d2}-{d4}", "6{d2}-{d2}-{d4}"], [("ISBN 978-", "-1"), ("order no ", " x"), ("with 55", "7"), ("invoice ", " for"), ("page ", "-2")]),
}


def examples(spark: SparkSession, each: int = 6) -> DataFrame:
    """Labelled candidates made from the fixed forms above, always the same: kind, label, m, l, r, held.

    Every form meets every context, `each` times. held: whether the form or the context is one that training must not see.
    """
    random, rows = Random(5), []
    signs = {"d": "0123456789", "h": "0123456789abcdef", "u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "l": "abcdefghijklmnopqrstuvwxyz"}
    for (kind, label), (forms, contexts) in _EXAMPLES.items():
        for i, form in enumerate(forms):
            for j, (left, right) in enumerate(contexts):
                for _ in range(each):
                    match = re.sub(r"\{([dhul])(\d+)\}", lambda m: "".join(random.choice(signs[m[1]]) for _ in range(int(m[2]))), form)
                    rows.append((kind, float(label), match, left, right, i == len(forms) - 1 or j == len(contexts) - 1))
    return spark.createDataFrame(rows, "kind string, label double, m string, l string, r string, held boolean")


@dataclass
class Model:
    """Boosted trees as (weight, tree), a tree being a leaf's value or (feature, threshold, low, high); thresholds by kind.

    recall: by kind, the share of right candidates among the unseen ones that the threshold lets through.
    """

    trees: list[tuple]
    thresholds: dict[str, float]
    recall: dict[str, float] = field(default_factory=dict)

    def score(self, seen: list[str]) -> str:
        """SQL of twice the weighted sum of the trees as a likelihood."""

        def value(node) -> str:
            return f"{node!r}D" if isinstance(node, float) else f"CASE WHEN {seen[node[0]]} <= {node[1]!r}D THEN {value(node[2])} ELSE {value(node[3])} END"

        return f"1 / (1 + exp(-2 * ({' + '.join(f'{w!r}D * {value(t)}' for w, t in self.trees)})))"


def _read_trees(fitted) -> list[tuple]:
    """The trees of a fitted model from its nodes."""

    def node(n):
        if n.numDescendants() == 0:
            return float(n.prediction())
        return int(n.split().featureIndex()), float(n.split().threshold()), node(n.leftChild()), node(n.rightChild())

    return [(w, node(t._call_java("rootNode"))) for t, w in zip(fitted.trees, fitted.treeWeights, strict=True)]


def train(spark: SparkSession, precision: float = 0.98) -> Model:
    """Fits the trees on the examples, and calibrates on those of forms and contexts that the trees have not seen.

    A kind's threshold is the lowest score, at least one half, from which `precision` of the kind's unseen candidates are
    right. Only the scores of those, a bounded number, come to the driver.
    """
    rows = examples(spark)
    seen = features("m", "l", "r", "kind")
    rows = rows.coalesce(1).select("kind", "label", "held", *(F.expr(x).alias(f"f{i}") for i, x in enumerate(seen)))
    rows = VectorAssembler(inputCols=[f"f{i}" for i in range(len(seen))], outputCol="features").transform(rows).select("kind", "label", "held", "features")
    rows = rows.cache()
    fitted = GBTClassifier(maxIter=8, maxDepth=3, stepSize=0.3, seed=11).fit(rows.where("not held"))
    model = Model(_read_trees(fitted), {})
    scored = fitted.transform(rows.where("held")).select("kind", "label", "probability").collect()
    rows.unpersist()
    for kind in GENERATORS:
        own = sorted(((float(r["probability"][1]), r["label"]) for r in scored if r["kind"] == kind), reverse=True)
        model.thresholds[kind], right = 1.01, 0
        for i, (p, y) in enumerate(own):
            right += y == 1
            if p >= 0.5 and right / (i + 1) >= precision and (i + 1 == len(own) or own[i + 1][0] < p):
                model.thresholds[kind] = p
        model.recall[kind] = sum(y == 1 and p >= model.thresholds[kind] for p, y in own) / max(1, sum(y == 1 for _, y in own))
    return model


def find_pii(docs: DataFrame, model: Model) -> DataFrame:
    """docs with base (spans of the validated patterns) and added (spans that the model selects): arrays of kind, start,
    end (code points, end exclusive) and score, by kind in the order of BASE and GENERATORS, then by start.

    Added spans overlap no base span; of added spans that overlap, the one with the highest score stays, then the first
    kind. All columns of docs are kept, except that those named base or added are replaced. Null and empty texts have no
    spans. Rows are judged alone, so repeated rows and ties need no rule.
    """
    rest = [c for c in docs.columns if c not in ("base", "added")]
    df = _with_spans(docs.select(*rest, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")), BASE | GENERATORS)
    sure = lambda k: lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit(1.0).alias("score"))
    valid = lambda k: F.filter(f"_s_{k}", lambda x: _VALID[k](x["m"])) if k in _VALID else F.col(f"_s_{k}")
    df = df.withColumns({f"_b_{k}": F.transform(valid(k), sure(k)) for k in BASE})

    def proposed(k: str) -> str:
        free = f"filter(_s_{k}, x -> NOT ({' OR '.join(f'size({_overlapping(f"_b_{b}", "x")}) > 0' for b in BASE)}))"
        scored = f"transform({free}, x -> named_struct('kind', '{k}', 'start', x.start, 'end', x.`end`, 'score', {model.score(features('x.m', 'x.l', 'x.r', f"'{k}'"))}))"
        return f"filter({scored}, x -> x.score >= {model.thresholds[k]!r}D)"

    def added(i: int, k: str) -> str:
        # a span goes if one of another kind that overlaps it is better: of a higher score, or of the same and an earlier kind
        better = (f"exists({_overlapping(f'_p_{o}', 'x')}, y -> y.score {'>=' if j < i else '>'} x.score)" for j, o in enumerate(GENERATORS) if j != i)
        return f"filter(_p_{k}, x -> NOT ({' OR '.join(better)}))"

    df = df.withColumns({f"_p_{k}": F.expr(proposed(k)) for k in GENERATORS})
    more = F.expr(f"concat({', '.join(added(i, k) for i, k in enumerate(GENERATORS))})")
    return df.select(*rest, F.concat(*(F.col(f"_b_{k}") for k in BASE)).alias("base"), more.alias("added"))


def _overlapping(spans: str, x: str) -> str:
    """SQL of those of spans, which are in order and apart, that overlap x; found by halving, so that long texts stay cheap."""

    def count(goes: str) -> str:
        """How many spans z at the front fulfil a condition that holds for all of a front and for none behind."""
        middle = "shiftright(a.lo + a.hi, 1)"
        step = f"if({goes.replace('z', f'get({spans}, {middle})')}, named_struct('lo', {middle} + 1, 'hi', a.hi), named_struct('lo', a.lo, 'hi', {middle}))"
        return f"aggregate(sequence(0, cast(log2(size({spans})) AS int)), named_struct('lo', 0, 'hi', size({spans})), (a, i) -> if(a.lo < a.hi, {step}, a), a -> a.lo)"

    before, until = count(f"z.`end` <= {x}.start"), count(f"z.start < {x}.`end`")
    return f"if(size({spans}) > 0, slice({spans}, {before} + 1, greatest({until} - {before}, 0)), {spans})"


def redact(found: DataFrame) -> DataFrame:
    """found with redacted: the text with every base or added span replaced by its kind in brackets, overlaps as one."""
    spans = F.array_sort(F.concat("base", "added"), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    text = F.col("text").cast("string")
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        between = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        fresh = F.struct(x["end"].alias("at"), F.concat(acc["out"], F.array(between, F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))).alias("out"))
        return F.when(x["start"] >= acc["at"], fresh).otherwise(F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out")))

    whole = F.aggregate(spans, first, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return found.withColumn("redacted", F.when(F.size(spans) > 0, whole).otherwise(text))
