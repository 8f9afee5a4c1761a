"""Personal data: fixed base spans, and more spans proposed by generators and chosen by boosted trees.

DataFrame expressions only; one projection over every whole text, without a shuffle. The trees are fitted on the driver and
scored as SQL expressions. Labels don't come from the features: base spans found in the texts, and made ones, are rewritten
in forms that the base patterns miss (positives) and spoilt in ways that leave their look (hard negatives), and set into
the surroundings of real spans; the label is known from how an example was made. The trees are fitted on some
values, calibrated on others and measured on a third part.

Patterns are the contract's, with possessive repeats and starts only at the start of a run of characters: the same
matches, but in linear time and without recursion on very long runs.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import BoostedTrees, Isotonic
from .common import spread, table

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?+[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of candidates: (kind, a cheap test, pattern). High recall: formats in longer runs, without a plus, disguised. There is
#: none for addresses: four parts of at most 255 are a base span wherever they stand, and in a longer row they aren't one.
GENERATORS = (
    ("email", r"[\[({] ?at ?[\])}]| at ", rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+(?: ?[\[({{] ?at ?[\])}}] ?| at )[A-Za-z0-9-]{{1,63}}+(?:(?:\.| ?[\[({{] ?dot ?[\])}}] ?| dot )[A-Za-z0-9-]{{1,63}}+){{1,8}}+"),
    ("card", r"[0-9]{4}", r"(?<![0-9])[0-9]{4}([\x20.-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4,7}(?![0-9])"),
    ("phone", r"[0-9]{4}", r"(?<![0-9])(?:\+?[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
)
#: Bounds of what the model is fitted on: documents searched for base spans, base spans taken from them, values made for each kind.
FIT_DOCS, FIT_SPANS, MADE = 20_000, 1_000, 150
CONTEXT = 24
#: An added span needs this calibrated probability.
THRESHOLD = 0.9


def spans_of(text: Column, matches: Column, pattern: str) -> Column:
    """array<struct<start, end, text>> in code points; the texts between matches give the places."""
    pairs = F.zip_with(F.split(text, pattern, -1), matches, lambda a, b: F.struct(F.length(a).alias("gap"), b.alias("text")))
    empty = F.array().cast("array<struct<start:int,end:int,text:string>>")

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["text"])
        one = F.struct(start.alias("start"), end.alias("end"), x["text"].alias("text"))
        return F.when(x["text"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.array_append(acc["out"], one).alias("out")))

    found = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.size(matches) > 0, found).otherwise(empty)


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(acc, i):
        d = F.substring(digits, F.length(digits) - i + F.lit(1), F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def small_parts(s: Column) -> Column:
    return F.forall(F.split(s, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))


def valid(kind: str, s: Column) -> Column:
    n = F.length(digits_of(s))
    if kind == "ip":
        return small_parts(s)
    if kind == "card":
        return F.when((n >= 16) & (n <= 19), luhn(digits_of(s))).otherwise(False)
    if kind == "phone":
        return (n >= 8) & (n <= 15)
    return F.lit(True)


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds _text and base_<kind>, the contract's spans of each kind."""
    docs = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    docs = docs.withColumns({f"_m_{k}": F.regexp_extract_all("_text", F.lit(p), F.lit(0)) for k, p in BASE.items()})
    found = {f"base_{k}": F.filter(spans_of(F.col("_text"), F.col(f"_m_{k}"), p), lambda x: valid(k, x["text"])) for k, p in BASE.items()}
    return docs.withColumns(found).drop(*(f"_m_{k}" for k in KINDS))


#: Features of a candidate, all small integers, so that their combinations are few however many rows there are.
FEATURES = ("kind", "digits", "luhn", "plus", "bracket", "separators", "left", "right", "named", "other")


def _class(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"^[A-Za-z0-9_]$"), 2).when(c.rlike(r"^[\s.,;:!?()]$"), 0).otherwise(1)


def described(kind: str, text: Column, x: Column) -> Column:
    s = x["text"]
    digits = digits_of(s)
    left = F.when(x["start"] > 0, F.substring(text, x["start"], F.lit(1))).otherwise("")
    right = F.substring(text, x["end"] + F.lit(1), F.lit(1))
    before = F.lower(F.substring(text, F.greatest(x["start"] - CONTEXT, F.lit(0)) + F.lit(1), F.least(x["start"], F.lit(CONTEXT))))
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"),
        F.least(F.length(digits), F.lit(20)).alias("digits"),
        (luhn(digits) if kind == "card" else F.lit(False)).cast("int").alias("luhn"),
        s.startswith("+").cast("int").alias("plus"),
        s.rlike(r"[()\[\]{}]").cast("int").alias("bracket"),
        F.least(F.length(F.regexp_replace(s, r"[^\x20.-]", "")), F.lit(4)).alias("separators"),
        _class(left).alias("left"),
        _class(right).alias("right"),
        before.rlike(r"mail|phone|tel|call|fax|mobil|card|visa|credit|carte|host|addr|\bip\b").cast("int").alias("named"),
        before.rlike(r"order|invoice|version|build|serial|ticket|batch|item|ref|\bno\b|\bid\b").cast("int").alias("other"),
        x["start"].alias("start"),
        x["end"].alias("end"),
    )


def candidates(docs: DataFrame) -> DataFrame:
    """Adds cands, the proposals of all generators with their features; those of a kind that meet a base span of it are left out."""
    arrays = []
    for i, (kind, test, pattern) in enumerate(GENERATORS):
        docs = docs.withColumn(f"_g{i}", F.when(F.col("_text").rlike(test), F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
        arrays.append(f"_c{i}")
        new = F.filter(
            spans_of(F.col("_text"), F.col(f"_g{i}"), pattern),
            lambda x: ~F.exists(F.col(f"base_{kind}"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])),
        )
        docs = docs.withColumn(f"_c{i}", new).drop(f"_g{i}")
    described_ = [F.transform(F.col(f"_c{i}"), lambda x: described(kind, F.col("_text"), x)) for i, (kind, _, _) in enumerate(GENERATORS)]
    return docs.withColumn("cands", F.concat(*described_)).drop(*arrays)


def _grouped(digits: str, sep: str) -> str:
    return sep.join((digits[:4], digits[4:8], digits[8:12], digits[12:]))


def _luhn_digit(digits: str) -> str:
    """The last digit that makes ``digits`` pass."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def _forms(kind: str, value: str, rng: random.Random) -> list[tuple[str, str, str, int]]:
    """(words in front, surface, words behind, label) of a valid value rewritten, and spoilt."""
    named = rng.choice(("phone", "call", "tel.", "mobile", "fax"))
    other = rng.choice(("order", "invoice", "serial", "ticket", "ref", "item no"))
    if kind == "card":
        d = "".join(c for c in value if c.isdigit())
        wrong = d[:-1] + str((int(d[-1]) + rng.randrange(1, 10)) % 10)
        out = [("", _grouped(d, "."), "", 1), ("", d, " " + d, 1), ("", _grouped(d, "-"), " 12", 1), (rng.choice(("card ", "visa ")), _grouped(d, "."), "", 1)]
        return out + [("", _grouped(wrong, "."), "", 0), ("", wrong, "", 0), ("", wrong, " " + wrong, 0), (other + " ", wrong, "", 0), ("", _grouped(wrong, " "), "", 0), ("x", d, "y", 0)]
    if kind == "phone":
        d = "".join(c for c in value if c.isdigit())[-10:].rjust(10, "5")
        bare = rng.choice((f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}"))
        whole = f"+{rng.randrange(1, 99)} ({d[:3]}) {d[3:6]}-{d[6:]}"
        runs = [("", whole, " 190.137.223.204", 1), ("", whole, " " + "4716" * 4, 1), ("", whole, " (" + d[:3] + ") 12345678", 1)]
        return runs + [(f"{named} ", bare, "", 1), (f"{named}: ", bare, ".", 1), (f"{other} ", f"{d[:3]}-{d[3:6]}-{d[6:]}", "", 0), ("", f"{d[:3]}-{d[3:6]}-{d[6:]}", "", 0), ("", f"{d[:3]} {d[3:6]} {d[6:]}", "", 0), (f"{other} ", f"{d[:3]} {d[3:6]} {d[6:]}", "", 0)]
    local, _, host = value.partition("@")
    dotted = host.replace(".", rng.choice((" dot ", " [dot] ", ".")))
    out = [("", f"{local}{at}{host}", "", 1) for at in (" [at] ", "(at)", " {at} ")] + [("mail ", f"{local} at {host}", "", 1), ("e-mail: ", f"{local} at {dotted}", "", 1)]
    return out + [("", f"{local} at {host}", "", 0), ("look ", f"here at {host}", "", 0), ("", f"{rng.choice(('meet', 'shop', 'live'))} at {rng.choice(('noon', 'home', 'one'))} dot two", "", 0)]


def _made(kind: str, rng: random.Random) -> str:
    def digits(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    if kind == "card":
        d = rng.choice("3456") + digits(14)
        return d + _luhn_digit(d)
    if kind == "phone":
        return f"+{rng.randrange(1, 99)} {digits(3)} {digits(3)} {digits(4)}"
    name = "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    return f"{name}.{digits(2)}@{name[::-1]}.example.{rng.choice(('com', 'org', 'net'))}"


def examples(found: list[tuple[str, str, str, str]], made: int = MADE, seed: int = 7) -> list[tuple[str, str, int, int, int, int]]:
    """Labelled examples from base spans (kind, value, left, right): (text, kind, start, end, label, part); part 0 to 2 fits, 3 calibrates, 4 measures."""
    rng = random.Random(seed)
    sides = [(le, ri) for _, _, le, ri in found] or [("", "")]
    sides += [("", ""), ("and then ", " of it."), ("(", ")"), ("it was ", ", or so"), ("text ", "\nmore")]
    kinds = [k for k, _, _ in GENERATORS]
    values = [(k, v) for k, v, _, _ in found if k in kinds] + [(k, _made(k, rng)) for k in kinds for _ in range(made)]
    out = []
    for kind, value in values:
        part = zlib.crc32(value.encode()) % 5
        for front, surface, behind, label in _forms(kind, value, rng):
            left, right = rng.choice(sides)
            before = f"{left}{front}" if not front or not left or left[-1] in " (\n" else f"{left} {front}"
            out.append((f"{before}{surface}{behind}{right}", kind, len(before), len(before) + len(surface), label, part))
    return out


class SpanModel:
    """Trees over FEATURES as a SQL expression, and the raw score at which calibrated probability reaches the threshold.

    rows: dicts of FEATURES, label and part. ``report``: for each kind recall, precision and number of positives of the part
    that neither fits nor calibrates.
    """

    def __init__(self, rows: list[dict], threshold: float = THRESHOLD):
        x = np.array([[r[f] for f in FEATURES] for r in rows], float).reshape(len(rows), len(FEATURES))
        y = np.array([r["label"] for r in rows], float)
        part = np.array([r["part"] for r in rows])
        fit, held = part < 3, part == 3
        self.trees = BoostedTrees(rounds=30, depth=3, rate=0.3, least=0.5).fit(x[fit], y[fit])
        p = self.trees.predict(x)
        self.shape = Isotonic().fit(p[held], y[held])
        enough = np.sort(p[self.shape.predict(p) >= threshold])
        self.cut = float(enough[0]) if len(enough) else 2.0
        take, last = self.takes(x), part == 4
        self.report = {}
        for kind, _, _ in GENERATORS:
            own = last & (x[:, 0] == KINDS.index(kind))
            hit = float((take & own & (y == 1)).sum())
            self.report[kind] = (hit / max(int((own & (y == 1)).sum()), 1), hit / max(int((own & take).sum()), 1), int((own & (y == 1)).sum()))

    def takes(self, x: np.ndarray) -> np.ndarray:
        """The choice for rows of FEATURES, as ``chosen`` makes it."""
        return self.trees.predict(x) >= self.cut - 1e-9

    def chosen(self, c: Column) -> Column:
        score = F.lit(self.trees.base)
        for tree in self.trees.trees:
            score = score + self._node(tree, 0, c)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-score)) >= F.lit(self.cut - 1e-9)

    def _node(self, tree: list, i: int, c: Column) -> Column:
        feature, edge, value = tree[i]
        if 2 * i + 1 >= len(tree):
            return F.lit(value)
        if feature < 0:  # rows of a node without a split go left
            return self._node(tree, 2 * i + 1, c)
        return F.when(c[FEATURES[feature]] > edge, self._node(tree, 2 * i + 2, c)).otherwise(self._node(tree, 2 * i + 1, c))


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, fit_spans: int = FIT_SPANS) -> SpanModel:
    """The model, from at most ``fit_spans`` base spans of about ``fit_docs`` documents, and made ones; all bounded."""
    spark = docs.sparkSession
    total = docs.count()
    some = docs.select("text")
    if total > fit_docs:
        some = some.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1_000_000 * fit_docs / total))
    spans = F.concat(*[F.transform(F.col(f"base_{k}"), lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))) for k in KINDS])
    found = base_spans(some).where(F.greatest(*[F.size(f"base_{k}") for k in KINDS]) > 0).select("_text", F.explode(spans).alias("s"))
    start, end = F.col("s.start"), F.col("s.end")
    value = F.substring("_text", start + F.lit(1), end - start)
    left = F.substring("_text", F.greatest(start - CONTEXT, F.lit(0)) + F.lit(1), F.least(start, F.lit(CONTEXT)))
    found = found.select("s.kind", value.alias("value"), left.alias("left"), F.substring("_text", end + F.lit(1), F.lit(CONTEXT)).alias("right"))
    found = found.where(F.length("value") <= 80).distinct().orderBy(F.xxhash64("value", "left"), "kind", "value", "left", "right").limit(fit_spans)
    made = examples([tuple(r) for r in found.collect()])
    frame = spark.createDataFrame([(i, *e) for i, e in enumerate(made)], "n INT, text STRING, kind STRING, at INT, upto INT, label INT, part INT")
    met = candidates(base_spans(frame)).select("n", "kind", "at", "upto", "label", "part", F.explode("cands").alias("c")).where("c.start < upto AND at < c.end")
    own = F.get(F.array(*[F.lit(k) for k in KINDS]), F.col("c.kind")) == F.col("kind")
    rows = met.select("n", "c.*", F.when(own, F.col("label")).otherwise(0).alias("label"), "part").orderBy("n", "kind", "start")
    return SpanModel([r.asDict() for r in rows.collect()])


def find_personal_data(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """``docs`` with base_email, base_ip, base_card, base_phone and added: arrays of spans in code points, end exclusive.

    added: array<struct<kind, start, end>>, in order, chosen by the model. Null text is empty text: no spans. Any doc_id, null
    and repeated ones included: each row is judged alone. An empty table gives no rows. Other columns stay, whatever
    their names; same-named ones are replaced. Time is linear in the text's length.
    """
    made = ("added", *(f"base_{k}" for k in KINDS))
    docs = docs.drop(*made)
    model = fit(docs.select("text"), fit_docs)
    kinds = F.array(*[F.lit(k) for k in KINDS])
    # the caller's columns travel in one struct, so that none is taken for one of ours
    out = candidates(base_spans(docs.select(F.struct(*docs.columns).alias("row"), "text")))
    chosen = F.when(F.size("cands") > 0, F.filter("cands", model.chosen)).otherwise(F.col("cands"))
    added = F.transform(F.array_sort(F.transform(chosen, lambda c: F.struct(c["kind"].alias("k"), c["start"], c["end"]))), lambda c: F.struct(F.get(kinds, c["k"]).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return out.select("row.*", added.alias("added"), *made[1:])


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base part of ``op7_pii``, which SQL can express: doc_id, n_email, n_ip, n_card, n_phone, base_sha256."""
    out = base_spans(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", *_counts(), _base_digest())


def _told(k: str, x: Column) -> Column:
    return F.concat(F.lit(f"{k}:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))


def _counts() -> list[Column]:
    return [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS]


def _base_digest() -> Column:
    return F.sha2(F.array_join(F.concat(*[F.transform(F.col(f"base_{k}"), lambda x: _told(k, x)) for k in KINDS]), ","), 256).alias("base_sha256")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: the contract's columns, and n_spans, the number of all spans; edge cases as in ``find_personal_data``."""
    out = find_personal_data(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))

    every = []
    for k in KINDS:
        both = F.concat(F.transform(F.col(f"base_{k}"), lambda x: F.struct(x["start"], x["end"])), F.transform(F.filter("added", lambda x: x["kind"] == k), lambda x: F.struct(x["start"], x["end"])))
        every.append(F.transform(F.array_sort(F.array_distinct(both)), lambda x: _told(k, x)))
    spans = F.concat(*every)
    return out.select("doc_id", *_counts(), _base_digest(), F.array_join(spans, ",").alias("spans"), F.size(spans).cast("long").alias("n_spans"))


def _sql_spans(kind: str, pattern: str, keep: str) -> str:
    """CTE of (doc_id, kind spans as text); places are sums of the lengths of the gaps and matches before."""
    p = pattern.replace("'", "''")
    return f"""{kind} AS (SELECT doc_id, list_transform(list_filter(range(1, len(m) + 1), lambda i: {keep.format(x='m[i]')}),
  lambda i: '{kind}:' || (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda g: length(g))), 0))::BIGINT || ':' ||
  (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + list_sum(list_transform(m[1:i], lambda g: length(g))))::BIGINT) AS s
  FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS gaps FROM d))"""


_DIGITS = "regexp_replace({x}, '[^0-9]', '', 'g')"
_LUHN = f"""length({_DIGITS}) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda k: CASE WHEN k % 2 = 1 THEN substr({_DIGITS}, length({_DIGITS}) - k + 1, 1)::INT
  ELSE substr({_DIGITS}, length({_DIGITS}) - k + 1, 1)::INT * 2 - CASE WHEN substr({_DIGITS}, length({_DIGITS}) - k + 1, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""
SQL_BASE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_sql_spans('email', r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+', 'true')},
{_sql_spans('ip', '[0-9]+(?:[.][0-9]+)(?:[.][0-9]+)(?:[.][0-9]+)', "len(list_filter(string_split({x}, '.'), lambda p: coalesce(try_cast(p AS BIGINT), 256) > 255)) = 0")},
{_sql_spans('card', '[0-9](?:[ -]?[0-9])+', _LUHN)},
{_sql_spans('phone', '[+][0-9][ ().0-9-]+[0-9]', f'length({_DIGITS}) BETWEEN 8 AND 15')}
SELECT doc_id, len(email.s) AS n_email, len(ip.s) AS n_ip, len(card.s) AS n_card, len(phone.s) AS n_phone,
  sha256(array_to_string(list_concat(email.s, ip.s, card.s, phone.s), ',')) AS base_sha256
FROM email JOIN ip USING (doc_id) JOIN card USING (doc_id) JOIN phone USING (doc_id)"""
