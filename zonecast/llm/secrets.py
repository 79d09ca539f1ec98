"""Secrets: patterns for known forms, and the entropy of sliding windows over strings that look random."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.llm.common import table

#: Fixed: the base kinds in the order of their digests, their words and the characters of a value.
BASE = ("assign", "access", "hex")
NAMES = "password|passwd|secret|token|api_?key"
VALUE = "[A-Za-z0-9+/_.=-]+"
#: Possessive loops and look-behinds change no match: what follows a loop never starts with what the loop takes, and a
#: run of one class is matched from its first character or, where it is too short, nowhere.
ASSIGN = rf"""(?i:{NAMES})["']?+\x20*+[:=]\x20*+["']?+({VALUE}+)"""
ACCESS = "AKIA[A-Z0-9]{12,}+"
HEX = "(?<![0-9a-f])[0-9a-f]{32,}+"
ASSIGNED = 8

#: The kind that this method adds, and its candidates.
KINDS = (*BASE, "entropy")
LETTERS = "[A-Za-z0-9+/_=-]"
WINDOW = 20
CANDIDATE = f"(?<!{LETTERS}){LETTERS}{{{WINDOW},}}+"
#: Least entropy, in bits a character, that the best window of a candidate needs, by the class of all its characters;
#: the first class that fits counts. Random strings lie about 0.3 above, words and paths below.
CLASSES = (("^[0-9A-Fa-f]+$", 3.0), ("^[A-Za-z0-9]+$", 3.7), (f"^{LETTERS}+$", 3.9))
#: What is no secret however random it looks: made-up values, counted-up ones, unique ids, checksums of packages, words joined by
#: separators. Base forms are reported by the kinds above.
ALLOWED = (
    "(?i)example|sample|dummy|placeholder|changeme|redacted|your[_-]|xxxx|0000|1234567|abcdefg|qwerty",
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "(?i)^sha(1|256|384|512)[-_=]",
    "[A-Za-z]{3,}[/_=-]+[A-Za-z]{3,}[/_=-]+[A-Za-z]{3,}",
    "^AKIA[A-Z0-9]{12,}$|^[0-9a-f]{32,}$",
)
#: Millionths of n * log2(n): whole numbers, so that what is added and taken away leaves no error.
WEIGHTS = [round(1e6 * n * math.log2(n)) if n else 0 for n in range(WINDOW + 1)]
#: Pairs that one fold handles; its list is copied with each.
FOLD = 256


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and deep inside ``body`` it stands."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def located(text: Column, pattern: str, possible: Column, group: int = 0) -> Column:
    """Array of (start, end, value): all matches with their code points, ends exclusive, ``value`` being ``group``.

    Gaps between matches and matches add up to the positions. They are summed in blocks, which are then moved to where
    they stand, so that the work does not grow with the square of the matches.
    """
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    lit = F.lit(pattern)
    pairs = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, lit, F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, lit, F.lit(group)).alias("value"),
    )
    sizes = F.transform(
        F.filter(pairs, lambda p: p["whole"].isNotNull()),
        lambda p: F.struct(F.length(p["gap"]).alias("gap"), F.length(p["whole"]).alias("size"), p["value"].alias("value")),
    )

    def add(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        span = F.struct(start.alias("start"), (start + p["size"]).alias("end"), p["value"].alias("value"))
        return F.struct((start + p["size"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def move(acc: Column, block: Column) -> Column:
        moved = F.transform(
            block["out"],
            lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["value"].alias("value")),
        )
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["out"], moved).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    blocks = lambda p: F.transform(
        F.sequence(F.lit(0), F.floor(F.size(p) / FOLD).cast("int")),
        lambda k: F.aggregate(F.slice(p, k * FOLD + 1, F.lit(FOLD)), zero, add),
    )
    return F.when(possible, bound(sizes, lambda p: F.aggregate(blocks(p), zero, move, lambda acc: acc["out"]))).otherwise(empty)


def peak_entropy(value: Column) -> Column:
    """Greatest Shannon entropy, in bits a character, of ``WINDOW`` characters in a row; null for shorter values.

    The window moves by one: the counts of the character that leaves and of the one that enters change, and with them
    the sum of n log n.
    """
    weights = F.array(*map(F.lit, WEIGHTS))
    weight = lambda n: F.get(weights, n).cast("long")

    def slid(chars: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            first = F.greatest(i - WINDOW, F.lit(0))
            inner = F.slice(chars, F.greatest(i - WINDOW + 1, F.lit(0)) + 1, F.least(i, F.lit(WINDOW - 1)))
            count = lambda c: F.size(inner) - F.size(F.array_remove(inner, c))
            gone, came = count(F.get(chars, first)), count(F.get(chars, i))
            left = F.when(i >= WINDOW, weight(gone + 1) - weight(gone)).otherwise(0)
            total = acc["sum"] - left + weight(came + 1) - weight(came)
            return F.struct(total.alias("sum"), F.when(i >= WINDOW - 1, F.least(acc["least"], total)).otherwise(acc["least"]).alias("least"))

        start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(WEIGHTS[WINDOW]).cast("long").alias("least"))
        return F.aggregate(
            F.sequence(F.lit(0), F.size(chars) - 1), start, step, lambda acc: (F.lit(WEIGHTS[WINDOW]) - acc["least"]) / F.lit(1e6 * WINDOW)
        )

    return F.when(F.length(value) >= WINDOW, bound(F.filter(F.split(value, ""), lambda c: c != ""), slid))


def needed(value: Column) -> Column:
    """Entropy that a candidate of this class of characters has to reach; null where it has no digit or no letter."""
    out = F.lit(None).cast("double")
    for pattern, least in reversed(CLASSES):
        out = F.when(value.rlike(pattern), F.lit(least)).otherwise(out)
    return F.when(value.rlike("[0-9]") & value.rlike("[A-Za-z]"), out)


def secret_spans(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """Add ``out``: array of (start, rank, end, kind, entropy) by start, then kind; ends exclusive, in code points.

    Kinds: ``assign`` (a name, a sign and a value of 8 characters or more, the span holding all three), ``access`` (key
    ids), ``hex`` (32 digits or more), always kept; ``entropy``, strings of 20 characters or more with digits and letters whose
    best window reaches the least entropy of their class and that no allow-list pattern fits. ``entropy`` is that of the
    best window of the value, null below 20 characters. Matches of a kind are leftmost and do not overlap; different kinds may.
    Null and empty texts have no span; whole texts are read; all rows and columns stay, an input column named as
    ``out`` is replaced; an empty table stays empty. A map without shuffle or Python.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    proposals = [
        ("assign", ASSIGN, body.rlike(f"(?i:{NAMES})"), 1, lambda v: F.length(v) >= ASSIGNED),
        ("access", ACCESS, F.contains(body, F.lit("AKIA")), 0, lambda v: F.lit(True)),
        ("hex", HEX, body.rlike("[0-9a-f]{32}"), 0, lambda v: F.lit(True)),
        ("entropy", CANDIDATE, body.rlike(f"{LETTERS}{{{WINDOW}}}"), 0, lambda v: needed(v).isNotNull() & ~v.rlike("|".join(f"(?:{p})" for p in ALLOWED))),
    ]
    parts = []
    for rank, (kind, pattern, possible, group, fine) in enumerate(proposals):
        spans = F.transform(
            F.filter(located(body, pattern, possible, group), lambda s: fine(s["value"])),  # noqa: B023
            lambda s: F.struct(
                s["start"].alias("start"),
                F.lit(rank).alias("rank"),  # noqa: B023
                s["end"].alias("end"),
                F.lit(kind).alias("kind"),  # noqa: B023
                peak_entropy(s["value"]).alias("entropy"),
                needed(s["value"]).alias("needed"),
            ),
        )
        parts.append(F.filter(spans, lambda s: s["entropy"] >= s["needed"]) if kind == "entropy" else spans)
    plain = F.transform(F.array_sort(F.concat(*parts)), lambda s: s.dropFields("needed"))
    return docs.withColumn(out, plain)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secrets_digest(docs: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return secret_spans(docs.select("doc_id", "text")).select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in BASE),
        F.sha2(joined(F.filter("secrets", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
        count("entropy").alias("n_entropy"),
    )


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_digest(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same spans by plain counting: every window of every candidate has its own histogram."""
    names = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in n) for n in NAMES.split("|"))
    patterns = [
        (f"""({names})["'']?\\x20*[:=]\\x20*["'']?({VALUE})""", 2),
        ("AKIA[A-Z0-9]+", 0),
        ("[0-9a-f]{32,}", 0),
        (f"{LETTERS}{{{WINDOW},}}", 0),
    ]
    found = "\n  UNION ALL ".join(
        f"SELECT doc_id, {rank} AS rank, unnest(string_split_regex(t, '{p}')) AS gap, unnest(regexp_extract_all(t, '{p}')) AS whole,"
        f" unnest(regexp_extract_all(t, '{p}', {group})) AS value, unnest(range(1, len(regexp_extract_all(t, '{p}')) + 2)) AS i FROM docs"
        for rank, (p, group) in enumerate(patterns)
    )
    least = " ".join(f"WHEN regexp_matches(value, '{p}') THEN {v}" for p, v in CLASSES)
    allowed = " OR ".join(f"regexp_matches(value, '{p}')" for p in ALLOWED)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (
  {found}),
placed AS (
  SELECT doc_id, rank, value, length(whole) AS size,
    sum(length(gap) + length(whole)) OVER (PARTITION BY doc_id, rank ORDER BY i) - length(whole) AS start FROM found WHERE whole IS NOT NULL),
right_form AS (
  SELECT * FROM placed WHERE CASE rank WHEN 0 THEN length(value) >= {ASSIGNED} WHEN 1 THEN size >= 16 WHEN 2 THEN true
    ELSE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND NOT ({allowed}) END),
windows AS (
  SELECT doc_id, start, value, unnest(range(1, length(value) - {WINDOW} + 2)) AS place FROM right_form WHERE rank = 3),
sums AS (
  SELECT doc_id, start, value, place, sum(list_extract({WEIGHTS}, n + 1)) AS s FROM (
    SELECT doc_id, start, value, place, c, count(*) AS n FROM (
      SELECT *, unnest(string_split(value[place:place + {WINDOW - 1}], '')) AS c FROM windows) GROUP BY ALL) GROUP BY ALL),
random AS (
  SELECT doc_id, start FROM (SELECT doc_id, start, value, ({WEIGHTS[WINDOW]} - min(s)) / {1e6 * WINDOW} AS entropy FROM sums GROUP BY ALL)
  WHERE entropy >= CASE {least} END),
spans AS (
  SELECT doc_id, rank, start, list_extract({list(KINDS)}, rank + 1) || ':' || start || ':' || (start + size) AS span
  FROM right_form WHERE rank < 3 OR (doc_id, start) IN (SELECT (doc_id, start) FROM random)),
totals AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans,
    count(*) FILTER (rank = 3) AS n_entropy FROM spans GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
FROM documents LEFT JOIN totals USING (doc_id)
"""


OP12_SQL = _sql()
