"""Personal data by weak supervision: base patterns, and further spans that a classifier adds.

Candidates are the matches of base patterns and of looser ones. Labelers vote on each: the base rule, a gazetteer of
what real values begin or end with, words before the span, its neighbours, and how its digits look. Expectation-
maximisation estimates the labelers' reliabilities; a logistic span classifier is fitted to the posteriors. Base spans
stay whatever it says; others are added where it is sure and no base span overlaps them.

Regular expressions in SQL return texts, not places. A pattern's matches and the pieces between them alternate, so
running sums of their lengths are the places, in code points. All is linear in a text: patterns begin where a run of
their characters does, or where the last match ended, and repeat possessively; what stands beside a match is read from
the pieces, not sought in the text.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm import weak
from newsloom.llm.arrays import let, scan
from newsloom.llm.text import whole
from newsloom.storage import materialize

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("rule", "gazetteer", "context", "edges", "digits")
#: A span outside the base patterns is added from this probability on.
SURE = 0.9
#: Stops inside host names are marked first, so that the pattern repeats no group: Java matches those by recursion,
#: which a long text would exhaust. U+0001 itself becomes U+0002; places do not move.
MARK, SPARE = "\u0001", "\u0002"
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9.\x01_%+-])|\G)[A-Za-z0-9.\x01_%+-]++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]*+",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Whole runs of digits with joins, of the right length.
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}(?: ?[(\[]dot[)\]] ?|\.)[A-Za-z]{2,24}",
    "phone": r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9])",
}
#: A cheap test that a text can hold a match at all.
MAYBE = {"email": r"@[A-Za-z0-9-]++\.[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"(?:[0-9][ -]?){11}[0-9]", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}
#: Fixed lists: top-level domains, words that announce personal data, words that announce other numbers.
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu")
ANNOUNCE = r"(?i)\b(?:call|phone|tel|fax|mobile|contact|email|e-mail|mail|write|reach|host|server|address|addr|ip|card|visa|pay|account)\b"
OTHER = r"(?i)\b(?:version|isbn|order|sku|part|model|page|chapter|figure|no|nr|id|section)\b"


EMPTY = "CAST(array() AS array<struct<kind:int,s:int,e:int,m:string,base:boolean,left:string,right:string>>)"


def _marked(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, MARK, SPARE), r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", MARK)


def _matches(kind: str, base: bool, text: Column, pattern: str) -> Column:
    """The leftmost matches in order as candidates: places in code points, end exclusive, with what stands beside them."""
    marked = kind == "email" and base
    text = _marked(text) if marked else text
    plain = (lambda x: F.translate(x, MARK, ".")) if marked else (lambda x: x)

    def placed(gaps: Column, own: Column) -> Column:
        lengths = F.transform(own, lambda m, i: F.char_length(F.get(gaps, i)) + F.char_length(m))

        def one(ends: Column, m: Column, i: Column) -> Column:
            e, text_of = F.get(ends, i), plain(m)
            return F.struct(
                F.lit(KINDS.index(kind)).alias("kind"), (e - F.char_length(m)).alias("s"), e.alias("e"), text_of.alias("m"),
                (_valid(kind, text_of) if base else F.lit(False)).alias("base"),
                plain(F.substring(F.get(gaps, i), -24, 24)).alias("left"), plain(F.substring(F.get(gaps, i + 1), 1, 1)).alias("right"),
            )

        found = let(scan(lengths, lambda a, b: a + b, F.lit(0)), lambda ends: F.transform(own, lambda m, i: one(ends, m, i)))
        return F.when(F.size(own) > 0, found).otherwise(F.expr(EMPTY))

    gaps, own = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(gaps, lambda g: let(own, lambda o: placed(g, o)))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""
    at = F.transform(F.split(F.reverse(digits), ""), lambda d, i: d.cast("int") * (F.lit(1) + i % 2))
    return F.aggregate(at, F.lit(0), lambda acc, d: acc + d - F.when(d > 9, 9).otherwise(0)) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    n = F.char_length(_digits(m))
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.char_length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(_digits(m))).otherwise(F.lit(False))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _apart(base: Column, more: Column) -> Column:
    """Those of ``more`` that overlap none of ``base``: a running maximum of ends before, and minimum of starts after."""
    far = F.lit(1 << 30)
    ours = F.transform(base, lambda c: F.struct(c["s"].alias("s"), F.lit(0).alias("other"), c["e"].alias("e"), F.lit(-1).alias("at")))
    theirs = F.transform(more, lambda c, i: F.struct(c["s"].alias("s"), F.lit(1).alias("other"), c["e"].alias("e"), i.alias("at")))

    def free(both: Column) -> Column:
        ended = scan(F.transform(both, lambda x: F.when(x["other"] == 0, x["e"]).otherwise(-1)), F.greatest, F.lit(-1))
        begun = F.reverse(scan(F.reverse(F.transform(both, lambda x: F.when(x["other"] == 0, x["s"]).otherwise(far))), F.least, far))
        kept = let(ended, lambda a: let(begun, lambda b: F.filter(both, lambda x, i: (x["other"] == 1) & (F.get(a, i) <= x["s"]) & (F.get(b, i) >= x["e"]))))
        return F.transform(kept, lambda x: F.get(more, x["at"]))

    return F.when((F.size(base) == 0) | (F.size(more) == 0), more).otherwise(let(F.sort_array(F.concat(ours, theirs)), free))


def _votes(c: Column) -> list[Column]:
    digits, m = _digits(c["m"]), c["m"]
    tail = F.lower(F.element_at(F.split(m, r"[.\])]+ ?"), -1))
    real = (
        F.when(c["kind"] == 0, tail.isin(*DOMAINS)).when(c["kind"] == 1, F.coalesce(F.element_at(F.split(m, r"\."), 1).try_cast("int"), F.lit(0)).between(1, 223))
        .when(c["kind"] == 2, F.substring(digits, 1, 1).isin("3", "4", "5", "6")).otherwise(F.substring(digits, 1, 1).between("1", "9"))
    )
    touching = F.substring(c["left"], -1, 1).rlike(r"[A-Za-z0-9_.-]") | c["right"].rlike(r"[A-Za-z0-9_]")
    flat = (c["kind"] != 0) & (digits.rlike(r"^([0-9])\1+$") | digits.isin("123456789", "1234567890"))
    return [
        F.when(c["base"], 1).otherwise(0),
        F.when(real, 1).otherwise(-1),
        F.when(c["left"].rlike(ANNOUNCE), 1).when(c["left"].rlike(OTHER), -1).otherwise(0),
        F.when(touching, -1).otherwise(1),
        F.when(flat, -1).otherwise(0),
    ]


def _classifier(rows: DataFrame, model: weak.Votes) -> list[float]:
    """Weights of a logistic classifier (kinds, then votes) fitted to the posteriors of the patterns, in SQL.

    There are at most 4 * 3^5 patterns. Gradient steps run as one expression over them.
    """
    votes = [F.col(f"v.{name}") for name in LABELERS]
    kinds = [(F.col("kind") == k).cast("double") for k in range(len(KINDS))]
    patterns = rows.groupBy("kind", "v").agg(F.count("*").cast("double").alias("n"))
    packed = patterns.select(F.struct(F.array(*kinds, *[v.cast("double") for v in votes]).alias("x"), model.posterior(votes).alias("y"), "n").alias("p"))
    one = packed.agg(F.sort_array(F.collect_list("p")).alias("pats"), F.greatest(F.coalesce(F.sum("p.n"), F.lit(0.0)), F.lit(1.0)).alias("total"))
    size, plus = len(KINDS) + len(LABELERS), "0D, (a, b) -> a + b"
    miss = f"transform(pats, p -> p.n * (1 / (1 + exp(-aggregate(zip_with(p.x, w, (a, b) -> a * b), {plus}))) - p.y))"
    step = f"transform(w, (o, k) -> o - 1.0D * aggregate(zip_with(pats, r, (p, e) -> p.x[k] * e), {plus}) / total)"
    fit = f"aggregate(sequence(1, 200), transform(sequence(1, {size}), i -> 0D), (w, i) -> aggregate(array({miss}), w, (z, r) -> {step.replace('transform(w,', 'transform(z,')}))"
    return [float(w) for w in one.select(F.expr(fit).alias("w")).first().w]


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(F.transform(spans, lambda c: F.struct(c["s"].alias("s"), c["kind"].alias("kind"), c["e"].alias("e")))), lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["s"], c["e"])), ",")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, found)``: every row with its candidates and the labelers' votes on them."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).cast("string").alias("text"))
    text = F.col("text")
    found = {f"b_{k}": F.when(text.rlike(MAYBE[k]), _matches(k, True, text, p)).otherwise(F.expr(EMPTY)) for k, p in PATTERNS.items()}
    found |= {f"l_{k}": F.when(text.rlike(p), _matches(k, False, text, p)).otherwise(F.expr(EMPTY)) for k, p in LOOSE.items()}
    rows = rows.withColumns(found)
    # A card that fails its test may be one with a slip; other base patterns are candidates only where they hold.
    worth = {"b_card": lambda c: c["base"] | F.char_length(_digits(c["m"])).between(15, 16)}
    parts = [F.filter(name, worth.get(name, lambda c: c["base"])) if name.startswith("b_") else F.col(name) for name in found]
    rows = rows.select("doc_id", F.concat(*parts).alias("found"))
    voted = F.transform("found", lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"), c["base"].alias("base"), F.struct(*[v.cast("int").alias(n) for n, v in zip(LABELERS, _votes(c), strict=True)]).alias("v")))
    return rows.select("doc_id", voted.alias("found"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` of every row, from whole texts.

    The counts and the digest are of base spans; ``spans`` lists these and the added ones. A null text counts as empty
    and has none: its lists are empty strings. Spans of different kinds may overlap; an added span overlaps no base
    span. Rows that repeat are each returned and each vote. No rows: an empty result.
    """
    rows = materialize(candidates(docs, id_col, text_col), "pii")
    each = rows.select(F.explode("found").alias("c")).select("c.kind", "c.v")
    model = weak.fit(each.select(*[F.col(f"v.{n}").alias(n) for n in LABELERS]), list(LABELERS))
    weights = _classifier(each, model)

    def sure(c: Column) -> Column:
        odds = F.get(F.array(*map(F.lit, weights[: len(KINDS)])), c["kind"])
        for name, w in zip(LABELERS, weights[len(KINDS) :], strict=True):
            odds = odds + c["v"][name] * F.lit(w)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds)) >= SURE

    base = F.filter("found", lambda c: c["base"])
    rows = rows.withColumn("base", base)
    rows = rows.withColumn("more", F.filter("found", lambda c: ~c["base"] & sure(c)))
    rows = rows.withColumn("more", _apart(F.col("base"), F.col("more")))
    kinds = F.transform("base", lambda c: c["kind"])
    counts = [F.size(kinds).cast("long") - F.size(F.array_remove(kinds, F.lit(k))).cast("long") for k in range(len(KINDS))]
    counts = [n.alias(f"n_{name}") for n, name in zip(counts, KINDS, strict=True)]
    return rows.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "more")).alias("spans"))
