"""Personal data by weak supervision, in DataFrame operations only.

Base spans come from four fixed patterns with their checks.  Besides, a wider pattern finds candidates: masked e-mail addresses, numbers in groups,
IPv6 addresses, names after titles or known given names.  Five labelers vote yes, no or nothing on each: shape (regular expression), checksum, gazetteer
(top-level domains, calling codes, given names), context before, and context after.  Vote patterns and span features are counted over the whole corpus into a table
whose size is bounded by their combinations.  Expectation-maximisation on that table estimates how reliable each labeler is, without labels, and its
posteriors train the final span classifier, a logistic regression on votes, kind and form.  Candidates that it gives ``ACCEPT`` or more are
added, unless they overlap a base span.  All rounds are aggregations of the counted table; only their sums reach the driver.

All else is local to a row: no shuffle but the counts.  Positions are code points, ends exclusive.

Defined results: null and empty texts have no spans; every row gives one row; repeated rows get equal spans; ids, null ones too, are carried
along; columns besides doc_id and text are ignored, and ``mask`` keeps all of them; with no candidates nothing is added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import store

KINDS = ("email", "ip", "card", "phone", "name")
ACCEPT, EM_ROUNDS, STEPS = 0.9, 10, 16
_LOCAL = "A-Za-z0-9._%+-"
# The base patterns, possessive and anchored at the first character a match can begin with (or where the last one ended), so that
# long runs cost one pass; they match what the plain patterns match.
BASE = {
    "email": f"(?:(?<![{_LOCAL}])|\\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:(?<![0-9])|\\G)[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
# What a text must hold for the pattern to be tried.
_NEEDS = {"email": "@", "ip": "\\.[0-9]++\\.[0-9]++\\.", "card": "[0-9](?:[\\x20-]?[0-9]){15}", "phone": "\\+[0-9]"}
# Words and names that the labelers know.
_TLDS = "com org net edu gov mil int info biz io co uk de fr es it nl ch at be eu us ca au jp cn in br ru".split()
_CODES = "1 7 20 27 30 31 32 33 34 39 41 43 44 45 46 47 48 49 52 55 61 81 82 86 90 91".split()
_GIVEN = "Anna Anne Antonio Carlos Carmen Claire David Elena Emma Hans James Jean John Jose Julia Karl Klaus Laura Lena Louis Lucas Maria Marie Mary Michael Paul Peter Pierre Robert Sarah Sophie Thomas".split()
_TITLES = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Señor Señora".split()
_CUES = "mail e-mail email contact write reach phone tel telephone call fax mobile cell whatsapp card visa mastercard ip host server address name".split()
_COUNTER_CUES = "order invoice isbn issn version id sha hash page chapter section figure table part model serial".split()
_UNITS = "usd eur km kg cm mm mb gb kb % items pages years euros dollars".split()
CANDIDATE = "|".join((
    f"(?<![{_LOCAL}])[{_LOCAL}]++ ?(?:@|\\(at\\)|\\[at\\]) ?[A-Za-z0-9-]++(?: ?(?:\\.|\\(dot\\)|\\[dot\\]) ?[A-Za-z0-9-]++)++",
    "(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){5,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "(?<![0-9A-Za-z.,/-])[+(]?[0-9](?:[\\x20().-]{0,2}[0-9]){6,18}(?![0-9A-Za-z]|[.,/-][0-9])",
    f"(?<![\\p{{L}}])(?:(?:{'|'.join(_TITLES)})\\.? |(?:{'|'.join(_GIVEN)}) )\\p{{Lu}}\\p{{Ll}}++(?: \\p{{Lu}}\\p{{Ll}}++)?",
))
# What a text must hold for the candidate pattern to be tried: cheap to test, and true wherever it matches.
_DIGITS = "[0-9][\\x20().-]{0,2}[0-9][\\x20().-]{0,2}[0-9][\\x20().-]{0,2}[0-9]"
_NAMES = "[A-Z]\\p{Ll}++ \\p{Lu}\\p{Ll}"
_DOTTED = [f"{t}. " for t in _TITLES]
LABELERS = ("shape", "checksum", "gazetteer", "before", "after")
FORMS = ("spaced", "grouped", "long")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def _with_prefix_sums(rows: DataFrame, numbers: str, to: str, step: int = 256) -> DataFrame:
    """Adds the sum of the numbers before each place: whole blocks first, then the rest, so that long arrays don't cost the square of
    their length.  Blocks are a column of their own, since what a lambda names is computed again for each element."""
    keep = rows.columns
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(numbers) / step).cast("int")), lambda k: _sum(F.slice(numbers, k * step + 1, step)))
    rows = rows.select(*keep, F.when(F.size(numbers) > 0, blocks).alias("_blocks"))

    def before(_: Column, i: Column) -> Column:
        block = F.floor(i / step).cast("int")
        return _sum(F.slice("_blocks", 1, block)) + _sum(F.slice(numbers, block * step + 1, i % step))

    return rows.select(*keep, F.transform(numbers, before).alias(to))


def _found(rows: DataFrame, text: str, pattern: str, need: Column, to: str) -> DataFrame:
    """Adds the matches of a pattern: value, start, stop, before (text since the last match), after."""
    keep = rows.columns
    rows = rows.select(*keep, need.alias("_need"))  # tested once, used twice
    rows = rows.select(*keep, F.when(F.col("_need"), F.split(text, pattern, -1)).alias("_pieces"), F.when(F.col("_need"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("_hits"))
    lengths = F.transform("_hits", lambda h, i: F.length(F.get("_pieces", i)) + F.length(h))
    rows = rows.select(*keep, "_pieces", "_hits", F.when(F.size("_hits") > 0, lengths).alias("_lengths"))
    rows = _with_prefix_sums(rows, "_lengths", "_sums")

    def span(hit: Column, i: Column) -> Column:
        start = F.get("_sums", i) + F.length(F.get("_pieces", i))
        before, after = F.lower(F.right(F.get("_pieces", i), F.lit(24))), F.lower(F.left(F.get("_pieces", i + 1), F.lit(12)))
        return F.struct(hit.alias("value"), start.alias("start"), (start + F.length(hit)).alias("stop"), before.alias("before"), after.alias("after"))

    return rows.select(*keep, F.when(F.size("_hits") > 0, F.transform("_hits", span)).alias(to))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, n - i, F.lit(1)).cast("int")
        doubled = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(i % 2 == 1, doubled).otherwise(digit)

    return (n > 0) & (F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0), add) % 10 == 0)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)"
        return value.rlike(f"^{part}(?:\\.{part}){{3}}$")
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _with_base(rows: DataFrame, text: str) -> DataFrame:
    """Adds _email, _ip, _card, _phone: arrays of (start, stop), never null."""
    for kind, pattern in BASE.items():
        rows = _found(rows, text, pattern, F.col(text).contains("@") if kind == "email" else F.col(text).rlike(_NEEDS[kind]), f"_{kind}")
        valid = F.transform(F.filter(f"_{kind}", _valid_match(kind)), lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop")))
        rows = rows.withColumn(f"_{kind}", F.coalesce(valid, F.array().cast("array<struct<start:int,stop:int>>")))
    return rows


def _valid_match(kind: str):
    return lambda match: _valid(kind, match["value"])


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, F.lit(1))
    return (out.when(no, F.lit(-1)) if no is not None else out).otherwise(F.lit(0))


def _word(words: list[str]) -> str:
    return "(?:^|[^\\p{L}])(?:" + "|".join(words) + ")(?:[^\\p{L}]|$)"


def _judged(c: Column) -> Column:
    """Kind, votes and form of one candidate."""
    v, digits = c["value"], _digits(c["value"])
    n = F.length(digits)
    is_mail = v.rlike("@|\\(at\\)|\\[at\\]")
    is_name = v.rlike("^\\p{Lu}\\p{Ll}") & ~is_mail
    is_v6 = v.contains(":")
    kind = F.when(is_mail, "email").when(is_name, "name").when(is_v6 | v.rlike("^[0-9]{1,3}(?:\\.[0-9]{1,3}){3}$"), "ip").when(n >= 13, "card").otherwise("phone")
    grouped = v.rlike("^\\(?[0-9]{3}\\)?[ .-][0-9]{3}[ .-][0-9]{4}$|^\\+[0-9]|^[0-9]{4}(?:[ -][0-9]{4}){3}$")
    shape = F.when(is_mail, _vote(v.rlike("^[^ ]+@[^ ]+\\.[A-Za-z]{2,}$"))).when(is_name, _vote(v.rlike("^(?:" + "|".join(_TITLES) + ")"))).when(is_v6, F.lit(1)).otherwise(_vote(grouped, v.rlike("^[0-9]+$") & (n < 13)))
    checksum = F.when(is_mail | is_name | is_v6, F.lit(0)).when(n >= 13, _vote(_luhn(digits) & (n <= 19), F.lit(True))).otherwise(_vote(F.lit(False), digits.rlike("^0+$|^(.)\\1+$")))
    gazetteer = F.when(is_mail, _vote(F.lower(v).rlike("(?:\\.|\\(dot\\)|\\[dot\\]) ?(?:" + "|".join(_TLDS) + ")$"), F.lit(True))).when(is_name, _vote(v.rlike("(?:^| )(?:" + "|".join(_GIVEN) + ")(?: |$)"))).otherwise(
        _vote(v.rlike("^\\+(?:" + "|".join(_CODES) + ")"))
    )
    before = _vote(c["before"].rlike(_word(_CUES)), c["before"].rlike(_word(_COUNTER_CUES) + "|[#$€£]$"))
    after = _vote(F.lit(False), c["after"].rlike("^ ?(?:" + "|".join(_UNITS) + ")(?:[^\\p{L}]|$)"))
    votes = [x.cast("int").alias(name) for x, name in zip((shape, checksum, gazetteer, before, after), LABELERS, strict=True)]
    forms = [v.contains(" ").cast("int").alias("spaced"), v.rlike("[().-]").cast("int").alias("grouped"), (F.length(v) > 14).cast("int").alias("long")]
    return F.struct(c["start"].alias("start"), c["stop"].alias("stop"), kind.alias("kind"), *votes, *forms)


def _with_candidates(rows: DataFrame, text: str) -> DataFrame:
    """Adds _candidates (null where there are none)."""
    has = F.col(text).contains
    need = has("@") | has("(at)") | has("[at]") | F.col(text).rlike(_DIGITS) | (has(":") & F.col(text).rlike("[0-9A-Fa-f]:[0-9A-Fa-f]")) | F.col(text).rlike(_NAMES)
    for title in _DOTTED:
        need = need | has(title)
    rows = _found(rows, text, CANDIDATE, need, "_candidates")
    return rows.withColumn("_candidates", F.transform("_candidates", _judged))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0))))


def reliabilities(patterns: DataFrame, rounds: int = EM_ROUNDS) -> dict[tuple[str, int], tuple[float, float]]:
    """(labeler, vote) -> its probability given personal data and given none, from unlabelled votes.  patterns: votes, n.

    The class of each vote pattern starts from the sum of its votes; every round is one aggregation."""
    belief = _sigmoid(F.lit(2.0) * sum((F.col(x) for x in LABELERS), F.lit(0)) - 0.5)
    out: dict[tuple[str, int], tuple[float, float]] = {}
    for _ in range(rounds):
        weighed = patterns.select("*", belief.alias("p"))
        sums = [F.sum(F.when(F.col(x) == v, F.col("n") * w).otherwise(0.0)).alias(f"{x}{v}{c}") for x in LABELERS for v in (-1, 0, 1) for c, w in (("y", F.col("p")), ("n", 1 - F.col("p")))]
        row = weighed.agg(*sums, F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no")).first()
        if row["yes"] is None:
            return {}
        yes, no = row["yes"], row["no"]
        out = {(x, v): ((row[f"{x}{v}y"] + 1) / (yes + 3), (row[f"{x}{v}n"] + 1) / (no + 3)) for x in LABELERS for v in (-1, 0, 1)}
        belief = _sigmoid(_odds(out, (yes + 1) / (no + 1)))
    return {**out, ("prior", 0): ((yes + 1) / (yes + no + 2), (no + 1) / (yes + no + 2))}


def _odds(reliability: dict, prior: float) -> Column:
    total = F.lit(math.log(prior))
    for x in LABELERS:
        value = F.lit(0.0)
        for v in (-1, 0, 1):
            a, b = reliability[(x, v)]
            value = F.when(F.col(x) == v, F.lit(math.log(a / b))).otherwise(value)
        total = total + value
    return total


def _features(get) -> dict[str, Column]:
    out = {"one": F.lit(1.0)}
    out |= {f"{x}{v}": (get(x) == v).cast("double") for x in LABELERS for v in (-1, 1)}
    out |= {k: (get("kind") == k).cast("double") for k in KINDS}
    return out | {f: get(f).cast("double") for f in FORMS}


def train(docs: DataFrame, rounds: int = EM_ROUNDS, steps: int = STEPS) -> dict[str, float]:
    """Weights of the span classifier; empty where the corpus has no candidates."""
    found = _with_candidates(docs.select(F.coalesce("text", F.lit("")).alias("text")), "text")
    found = found.select(F.explode_outer("_candidates").alias("c")).filter(F.col("c").isNotNull())  # plain explode would test the array's size by computing it once more
    key = ["kind", *LABELERS, *FORMS]
    patterns = store(found.select(*[F.col(f"c.{k}").alias(k) for k in key]).groupBy(*key).count().withColumnRenamed("count", "n").coalesce(1), "pii-votes")
    known = reliabilities(patterns, rounds)
    if not known:
        return {}
    yes, no = known[("prior", 0)]
    columns = _features(F.col)
    soft = patterns.select("n", *[c.alias(name) for name, c in columns.items()], _sigmoid(_odds(known, yes / no)).alias("target"))
    weights = dict.fromkeys(columns, 0.0)
    for step in range(steps):
        error = F.col("n") * (F.col("target") - _sigmoid(sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0))))
        row = soft.agg(F.sum("n").alias("n"), *[F.sum(error * F.col(k)).alias(f"g_{k}") for k in columns]).first()
        weights = {k: w + 6.0 / (1 + step / 20) * (row[f"g_{k}"] / row["n"]) for k, w in weights.items()}
    return weights


def with_spans(docs: DataFrame, weights: dict[str, float], accept: float = ACCEPT) -> DataFrame:
    """docs with _base (array of kind, start, stop), and _added, each by kind in the listed order, then start."""
    keep = docs.columns
    rows = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    rows = _with_candidates(_with_base(rows, "_text"), "_text")
    tagged = [F.transform(f"_{k}", _tag(k)) for k in BASE]
    rows = rows.select(*keep, F.concat(*tagged).alias("_base"), *[F.size(f"_{k}").cast("long").alias(f"_n_{k}") for k in BASE], "_candidates")

    def accepted(c: Column) -> Column:
        score = sum((x * weights[k] for k, x in _features(lambda f: c[f]).items()), F.lit(0.0)) if weights else F.lit(-1.0)
        free = ~F.exists("_base", lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"]))
        return (score >= math.log(accept / (1 - accept))) & free

    added = F.transform(F.filter("_candidates", accepted), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop")))
    return rows.select(*keep, "_base", *[f"_n_{k}" for k in BASE], F.coalesce(added, F.array().cast("array<struct<kind:string,start:int,stop:int>>")).alias("_added"))


def _tag(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _in_order(spans: Column) -> Column:
    """By kind as listed, then start."""
    place = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(place(s).alias("k"), s["start"].alias("a"), s["stop"].alias("b"), s.alias("s"))))
    return F.transform(keyed, lambda x: x["s"])


def detect(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = with_spans(docs, train(docs) if weights is None else weights)
    return rows.select("doc_id", *[F.col(f"_n_{k}").alias(f"n_{k}") for k in BASE], F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"), _joined(_in_order(F.concat("_base", "_added"))).alias("spans"), F.size("_added").cast("long").alias("n_added"))


def mask(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """docs with every span (overlapping ones as one) replaced by its kind in angle brackets; null texts stay null."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), "text")  # so that no column of the documents clashes
    rows = with_spans(packed, train(docs) if weights is None else weights).withColumn("_all", F.array_sort(F.transform(F.concat("_base", "_added"), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))))
    empty = F.array().cast("array<struct<start:int,stop:int,kind:string>>")

    def merge(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"), last["kind"].alias("kind"))))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["stop"] > s["start"]), longer).otherwise(F.concat(done, F.array(s)))

    rows = rows.withColumn("_all", F.when(F.size("_all") > 0, F.aggregate("_all", empty, merge)))
    rows = rows.withColumn("_chars", F.when(F.size("_all") > 64, F.split("text", "")))  # then cutting costs one pass, not one for each span

    def cut(a: Column, b: Column | None) -> Column:
        n = (b if b is not None else F.length("text")) - a
        return F.when(F.col("_chars").isNull(), F.substring("text", a + 1, n)).otherwise(F.array_join(F.slice("_chars", a + 1, n), ""))

    pieces = F.transform("_all", lambda s, i: F.concat(cut(F.coalesce(F.get("_all", i - 1)["stop"], F.lit(0)), s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")))
    masked = F.when(F.col("_all").isNull(), F.col("text")).otherwise(F.concat(F.array_join(pieces, ""), cut(F.element_at("_all", -1)["stop"], None)))
    return rows.withColumn("text", masked).select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
