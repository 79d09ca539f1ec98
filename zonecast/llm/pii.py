"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.llm.common import table

#: Fixed: the base kinds in the order of their digests. Possessive loops and the look-behinds change no match:
#: a run of the first class either starts a match at its first character or nowhere.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Only runs of 13 digits and more; shorter ones fail anyway.
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")

#: Kinds that this method adds.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
NUMBER = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
KINDS = (*BASE, "iban", "id")

#: Score of a confirmed span before its context is read.
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.7, "id": 0.3}
#: Words that make a kind likelier when they stand within ``CONTEXT`` characters before the span.
WORDS = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|address|host|server|client|login",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|anruf|appel",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "id": "ssn|social|security|tax|identity|number",
}
CONTEXT, BOOST, LEAST = 40, 0.2, 0.5
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def found(text: Column, kind: str, pattern: str, possible: Column) -> Column:
    """All matches with their code point positions: the pieces between matches and the matches themselves add up."""
    pat = F.lit(pattern)
    matches = F.regexp_extract_all(text, pat, F.lit(0))
    between = F.split(text, pattern, -1)
    step = lambda acc, pair: F.struct(
        (acc["at"] + F.length(pair["gap"]) + F.length(pair["value"])).alias("at"),
        F.concat(
            acc["out"],
            F.array(
                F.struct(
                    F.lit(kind).alias("kind"),
                    (acc["at"] + F.length(pair["gap"])).alias("start"),
                    (acc["at"] + F.length(pair["gap"]) + F.length(pair["value"])).alias("end"),
                    pair["value"].alias("value"),
                )
            ),
        ).alias("out"),
    )
    none = F.array().cast(SPAN)
    pairs = F.filter(F.arrays_zip(between.alias("gap"), matches.alias("value")), lambda p: p["value"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.when(possible, F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Every second digit from the right is doubled, nines cast out; the sum ends in 0."""
    number = F.reverse(digits(value))
    doubled = F.transform(
        F.split(number, ""),
        lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(d.try_cast("int") * 2 - F.when(d.try_cast("int") > 4, 9).otherwise(0)),
    )
    total = F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0)))
    return F.length(number).between(13, 19) & (total % 10 == 0)


def mod97(value: Column) -> Column:
    """The country code moves to the end, letters count from 10; the remainder by 97 is 1."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))
    rest = F.aggregate(
        F.filter(F.split(turned, ""), lambda c: c != ""),
        F.lit(0),
        lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )
    return F.length(plain).between(15, 34) & (rest == 1)


def confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^(?:0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        return luhn(value)
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return mod97(value) if kind == "iban" else F.lit(True)


def pii_spans(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Add ``out``: array of (kind, start, end, score), ends exclusive, in code points, by kind, then start.

    Kinds: ``email``, ``ip`` (parts up to 255), ``card`` (13 to 19 digits, Luhn), ``phone`` (9 to 15 digits), always
    kept; ``iban`` (mod 97) and ``id`` (number blocks, only with a context word), kept from a score of ``LEAST``.
    Within a kind matches are leftmost and do not overlap; different kinds may. Null and empty texts have no span;
    whole texts are read; all rows and columns stay, an input column named as ``out`` is replaced; an empty table
    stays empty. A map without shuffle.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    number = body.rlike("[0-9]")
    proposals = [
        ("email", EMAIL, F.contains(body, F.lit("@"))),
        ("ip", IP, number),
        ("card", CARD, number),
        ("phone", PHONE, F.contains(body, F.lit("+"))),
        ("iban", IBAN, number),
        ("id", NUMBER, number),
    ]

    def scored(kind: str, pattern: str, possible: Column) -> Column:
        right = F.filter(found(body, kind, pattern, possible), lambda s: confirmed(kind, s["value"]))
        near = lambda s: F.lower(F.substring(body, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT))))
        return F.transform(
            right,
            lambda s: F.struct(
                s["kind"].alias("kind"),
                s["start"].alias("start"),
                s["end"].alias("end"),
                (F.lit(PRIOR[kind]) + F.when(near(s).rlike(WORDS[kind]), F.lit(BOOST)).otherwise(F.lit(0.0))).alias("score"),
            ),
        )

    spans = F.concat(*(scored(*p) for p in proposals))
    return docs.withColumn(out, F.filter(spans, lambda s: s["kind"].isin(*BASE) | (s["score"] >= LEAST)))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace every span by its kind in brackets; where spans overlap, the first names the joint stretch.

    The columns stay; ``n_chars``, where present, follows the new text. Null texts stay null.
    """
    mark = "__pii"
    ordered = F.array_sort(F.transform(mark, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], -s["back"]).alias("at"),
        F.when(
            s["start"] >= acc["at"],
            F.concat(acc["out"], F.array(F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))),
        )
        .otherwise(acc["out"])
        .alias("out"),
    )
    joined = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        step,
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(F.col(text), acc["at"] + 1)),
    )
    done = pii_spans(docs, text, mark).withColumn(text, F.when(F.size(mark) > 0, joined).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.when(F.size(mark) > 0, F.length(text).cast(kind)).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    spans = pii_spans(docs.select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")
    return spans.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in BASE),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
        F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))
