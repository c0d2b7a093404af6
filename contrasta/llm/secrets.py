"""Secret scan by a trigram inverted index, with DataFrame functions only.

Every rule's regular expression yields a Boolean trigram query: all of its mandatory parts must be
there, each as one of several strings, and a string is there only if all its trigrams are. The
index holds a posting (trigram, row) for each trigram that some query asks for, on lower-cased
text. Postings are intersected by counting: a string's row must have all of its trigrams, a rule's
row all of its parts. Only candidate rules are run on a row; rules without mandatory trigrams are
run on all rows. Positions come from splitting the text at the rule's matches.

Spans are code points, end exclusive. The base rules are ``assign``, ``access`` and ``hex``.

Defined cases: a null text is empty and has no spans; repeated rows and repeated or null ids are
scanned row by row (rows are told apart by id and a hash of the text, equal rows share a result);
very long texts are scanned whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from re import _parser  # the standard library's own regular-expression parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import text_or_empty


@dataclass(frozen=True)
class Rule:
    """``group``'s match must have ``at_least`` code points, else the match is dropped."""

    kind: str
    regex: str
    group: int = 0
    at_least: int = 1
    base: bool = field(default=False)


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([any_case("password"), any_case("passwd"), any_case("secret"), any_case("token"), any_case("api") + "_?" + any_case("key")])

RULES = (
    Rule("assign", rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),  # a run of 24 or more: shorter runs fail anyway
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("pypi", r"pypi-[A-Za-z0-9_-]{50,}"),
    Rule("twilio", r"SK[0-9a-f]{32}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("url_password", r"[a-z]{3,10}://[A-Za-z0-9._-]{1,64}:[^\x20\x09-\x0D/@:]{3,128}@"),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}"),
    Rule("aws_secret", r"aws_secret_access_key[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9/+]{40}"),
    Rule("azure", r"AccountKey=[A-Za-z0-9+/]{60,}={0,2}"),
)

_MOST = 24  # strings kept for one part before it is cut off


def trigram_query(regex: str) -> list[set[str]]:
    """Parts that every match must contain; each part is a set of strings, one of which is there.

    Parts are lower-cased and at least three characters long. Whatever the walk does not know
    (classes of many characters, optional parts, back references) ends the part before it.
    """
    parts: list[set[str]] = []

    def close(strings: set[str]) -> None:
        if strings and min(map(len, strings)) >= 3:
            parts.append(strings)

    def strings_of(nodes) -> set[str] | None:
        """All strings that the nodes match, lower-cased; None if there are too many."""
        out = {""}
        for op, arg in nodes:
            name = str(op)
            if name == "LITERAL":
                step = {chr(arg).lower()}
            elif name == "IN":
                if any(str(o) not in ("LITERAL", "RANGE") for o, _ in arg):
                    return None
                codes = {c for o, a in arg for c in ([a] if str(o) == "LITERAL" else range(a[0], a[1] + 1) if a[1] - a[0] < 8 else [-1])}
                step = None if -1 in codes else {chr(c).lower() for c in codes}
            elif name == "SUBPATTERN":
                step = strings_of(arg[3])
            elif name == "BRANCH":
                branches = [strings_of(b) for b in arg[1]]
                step = None if None in branches else set().union(*branches)
            elif name == "MAX_REPEAT" and arg[1] <= 3:
                once = strings_of(arg[2])
                step = None if once is None else set()
                for k in range(arg[0], arg[1] + 1):
                    some = {""}
                    for _ in range(k):
                        some = {a + b for a in some for b in once or ()}
                    step = None if step is None else step | some
            else:
                step = None
            if step is None or len(out) * len(step) > _MOST:
                return None
            out = {a + b for a in out for b in step}
        return out

    def walk(nodes) -> None:
        now = {""}
        for node in nodes:
            step = strings_of([node])
            if step is not None and len(now) * len(step) <= _MOST and min(map(len, step)) > 0:
                now = {a + b for a in now for b in step}
                continue
            close(now)
            now = {""}
            name, arg = str(node[0]), node[1]
            if step is not None and min(map(len, step)) > 0:
                now = step
            elif step is None and name == "SUBPATTERN":
                walk(arg[3])
            elif step is None and name == "MAX_REPEAT" and arg[0] >= 1:
                walk(arg[2])
        close(now)

    walk(_parser.parse(regex))
    return parts


def index_queries(rules: tuple[Rule, ...]) -> list[tuple[int, int, int, int, str]]:
    """Rows (rule, part, string, position, trigram) of all queries; a rule without any scans fully."""
    out = []
    for r, rule in enumerate(rules):
        for p, strings in enumerate(trigram_query(rule.regex)):
            for s, text in enumerate(sorted(strings)):
                for k, t in enumerate(sorted({text[i:i + 3] for i in range(len(text) - 2)})):
                    out.append((r, p, s, k, t))
    return out


def candidates(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``id, h, rules`` (positions in ``rules``) for rows (id, h, text) that pass a rule's trigram query."""
    spark = rows.sparkSession
    asked = index_queries(rules)
    grams = sorted({x[4] for x in asked})
    low = rows.select("id", "h", F.lower("text").alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    postings = low.select("id", "h", F.explode(found).alias("gram"))
    needs: dict[tuple[int, int, int], int] = {}
    parts: dict[int, set[int]] = {}
    for r, p, s, _, _ in asked:
        needs[r, p, s] = needs.get((r, p, s), 0) + 1
        parts.setdefault(r, set()).add(p)
    query = spark.createDataFrame([(g, r, p, s, 1 << k, (1 << needs[r, p, s]) - 1, (1 << len(parts[r])) - 1) for r, p, s, k, g in asked],
                                  "gram string, rule int, part int, string int, bit long, all_grams long, all_parts long")
    # one row per trigram of the rules above, whatever the corpus
    hits = postings.join(F.broadcast(query), "gram")
    strings = (hits.groupBy("id", "h", "rule", "part", "string", "all_grams", "all_parts").agg(F.bit_or("bit").alias("got"))
               .where("got = all_grams"))
    whole = (strings.groupBy("id", "h", "rule", "all_parts").agg(F.bit_or(F.expr("shiftleft(1L, part)")).alias("got"))
             .where("got = all_parts"))
    return whole.groupBy("id", "h").agg(F.collect_set("rule").alias("rules"))


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of the rule's matches that are long enough, in order."""
    parts = F.split(text, rule.regex, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    checked = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group))
    found = F.arrays_zip(F.slice(parts, 1, F.size(whole)).alias("before"), whole.alias("match"), checked.alias("checked"))
    span = "array<struct<start:long,end:long>>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(span).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["before"])
        b = a + F.length(x["match"])
        kept = F.concat(acc["out"], F.array(F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))))
        return F.struct(b.cast("long").alias("at"), F.when(F.length(x["checked"]) >= rule.at_least, kept).otherwise(acc["out"]).alias("out"))

    return F.aggregate(found, start, step, lambda acc: acc["out"])


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES,
         carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, text, spans`` and the columns ``carry`` for every row; spans: array<struct<start, rule, end, kind>> by start, then rule."""
    text = text_or_empty(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"),
                       F.struct(*[F.col(c) for c in carry] or [F.lit(0)]).alias("carried"))
    found = candidates(rows, rules).toDF("c_id", "c_h", "rules")
    # null ids have candidates too: joined as their own value
    both = rows.join(found, F.col("id").eqNullSafe(F.col("c_id")) & (F.col("h") == F.col("c_h")), "left")
    both = both.select(F.col("id").alias("doc_id"), "text", "carried", "rules")
    free = {r for r, rule in enumerate(rules) if not trigram_query(rule.regex)}
    nothing = F.array().cast("array<struct<start:long,end:long>>")
    for r, rule in enumerate(rules):
        spans = spans_of(F.col("text"), rule)
        both = both.withColumn(f"__{r}", spans if r in free else F.when(F.array_contains("rules", r), spans).otherwise(nothing))

    def named(r: int) -> Column:
        return F.transform(f"__{r}", lambda s: F.struct(s["start"].alias("start"), F.lit(r).alias("rule"), s["end"].alias("end"),
                                                        F.lit(rules[r].kind).alias("kind")))

    return both.select("doc_id", "text", F.array_sort(F.concat(*map(named, range(len(rules))))).alias("spans"),
                       *[F.col(f"carried.{c}").alias(c) for c in carry])


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch of overlapping spans replaced by ``mark``."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), gap.alias("out"))).otherwise(
            F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    return F.when(F.size(spans) == 0, text).otherwise(
        F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int")))))


def python_spans(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int, str]]:
    """The same spans of one text by the standard library; the tests hold ``scan`` against it."""
    out = []
    for r, rule in enumerate(rules):
        for m in re.finditer(rule.regex, text or ""):
            if len(m[rule.group]) >= rule.at_least:
                out.append((m.start(), r, m.end(), rule.kind))
    return sorted(out)

