"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule is a regular expression over ASCII classes. From its syntax tree a
Boolean trigram query is derived: a conjunction of clauses, each a set of
alternatives, each a set of trigrams that all have to occur. The index holds a
posting (trigram, document) for every document and every trigram that any rule
can ask for; a rule's candidates are the documents that the postings of its
query intersect to. Only candidates are verified with the regular expression.
A rule without mandatory trigrams (runs of hex digits) scans every document.

Trigrams of rules that ignore case are matched on the text with A-Z lowered.

Verification cuts the text at the matches, so positions follow from the lengths
of the pieces: leftmost, non-overlapping, in code points, end exclusive.

Edge cases: null and empty texts have no spans; rows that repeat an id are told
apart by their text (rows equal in both count as one for the index and are all
reported); null ids are reported; an empty table gives an empty result; other
columns are not read; of a very long text with many matches every one is
reported, in time about in proportion to its length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _parser as syntax

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import materialise, table


@dataclass(frozen=True)
class Rule:
    """``pattern``: Java and Python syntax alike. A match counts when group
    ``group`` has at least ``least`` characters."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: str = ""      # the part of the pattern (a prefix) in which case is ignored

    @property
    def regex(self) -> str:
        return f"(?i:{self.any_case})" + self.pattern[len(self.any_case):] if self.any_case else self.pattern


#: The three base rules.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6,
         "(password|passwd|secret|token|api_?key)"),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Added rules: well-known public token formats.
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)


# ---- Boolean trigram queries from a regular expression ----

def _sequences(tree, limit=64):
    """Alternatives of a syntax tree as lists of pieces; a piece is a literal or
    None (anything). Every match of the tree contains the pieces of at least one
    alternative, in order and without overlap."""
    out = [[""]]

    def append(options):
        nonlocal out
        if len(out) * len(options) > limit:
            options = [[None]]
        joined = []
        for head in out:
            for tail in options:
                if head[-1] is not None and tail[0] is not None:
                    joined.append(head[:-1] + [head[-1] + tail[0]] + tail[1:])
                else:
                    joined.append(head + tail)
        out = joined

    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            append([[chr(arg)]])
        elif name == "SUBPATTERN":
            append(_sequences(arg[-1], limit))
        elif name == "BRANCH":
            append([s for b in arg[1] for s in _sequences(b, limit)])
        elif name == "MAX_REPEAT" and arg[:2] == (0, 1):
            append([[""], *_sequences(arg[2], limit)])
        elif name == "MAX_REPEAT" and arg[0] > 0:
            once = _sequences(arg[2], limit)
            append([s + [None] if arg[1] != 1 else s for s in once])
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 8:
            append([[chr(c)] for _, c in arg])
        else:
            append([[None]])
    return out


def trigram_query(rule: Rule) -> list[frozenset] | None:
    """Alternatives, each a set of trigrams that must all occur; None: some
    alternative has no mandatory trigram, so every document has to be scanned."""
    alternatives = set()
    for pieces in _sequences(syntax.parse(rule.any_case or rule.pattern)):
        grams = {p[i:i + 3] for p in pieces if p for i in range(len(p) - 2)}
        if not grams:
            return None
        alternatives.add(frozenset(g.lower() if rule.any_case else g for g in grams))
    # an alternative that asks for more than another adds nothing
    return sorted((a for a in alternatives if not any(b < a for b in alternatives)), key=sorted)


def _terms(rules) -> list[tuple[str, bool]]:
    """(trigram, case ignored) that the rules can ask for."""
    out = set()
    for r in rules:
        for alt in trigram_query(r) or []:
            out |= {(g, bool(r.any_case)) for g in alt}
    return sorted(out)


BLOCK = 512     # matches whose positions are summed up together

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _key(id_col: str, text_col: str) -> list[Column]:
    return [F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th")]


def postings(docs: DataFrame, rules=BASE + ADDED, id_col="doc_id", text_col="text") -> DataFrame:
    """The inverted index: (term, id, text hash) for every document and every
    trigram the rules can ask for, case-ignoring trigrams marked by ``i:``."""
    terms = _terms(rules)
    lowered = F.translate(F.col(text_col), _UPPER, _LOWER)
    flags = [F.when(F.contains(F.col("low") if i else F.col(text_col), F.lit(g)), F.lit(("i:" if i else "") + g))
             for g, i in terms]
    d = docs.select(id_col, text_col, lowered.alias("low"))
    return d.select(*_key(id_col, text_col), F.explode(F.array_compact(F.array(*flags))).alias("term"))


def candidates(index: DataFrame, rules=BASE + ADDED) -> DataFrame:
    """(id, text hash, kinds): documents whose postings satisfy a rule's query."""
    spark = index.sparkSession
    asked = [(r.kind, f"{r.kind}/{n}", ("i:" if r.any_case else "") + g, len(alt))
             for r in rules for n, alt in enumerate(trigram_query(r) or []) for g in sorted(alt)]
    q = spark.createDataFrame(asked, "kind string, alt string, term string, need int")  # a few rows a rule
    met = (index.distinct().join(F.broadcast(q), "term").groupBy("id", "th", "kind", "alt")
           .agg(F.count("*").alias("have"), F.first("need").alias("need")).filter("have = need"))
    return met.groupBy("id", "th").agg(F.collect_set("kind").alias("kinds"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once: what a lambda names from outside
    is worked out again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end, kind) of a rule's matches that are long enough.

    Starts are running sums of the lengths of matches and gaps, taken in blocks of
    ``BLOCK`` matches that are then moved on: a list that grew by one match a step
    would be copied as often as there are matches."""
    rx = F.lit(rule.regex)
    found = F.regexp_extract_all(text, rx, F.lit(0))
    sized = F.regexp_extract_all(text, rx, F.lit(rule.group)) if rule.group else found
    between = F.transform(F.split(text, rule.regex, -1), F.char_length)
    # there is one gap more than matches: the text behind the last one
    zipped = F.arrays_zip(found, sized, between).cast("array<struct<m:string,s:string,gap:int>>")
    both = F.transform(F.filter(zipped, lambda z: z["m"].isNotNull()), lambda z: F.struct(
        z["gap"].alias("gap"), F.char_length(z["m"]).alias("n"), F.char_length(z["s"]).alias("v")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,v:int>>").alias("out"))

    def step(acc, m):
        at = acc["at"] + m["gap"]
        return F.struct((at + m["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct(
            at.alias("start"), (at + m["n"]).alias("stop"), m["v"].alias("v")))).alias("out"))

    def moved(acc, block):
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["out"], F.transform(block["out"], lambda m: F.struct(
            (acc["at"] + m["start"]).alias("start"), (acc["at"] + m["stop"]).alias("stop"), m["v"].alias("v")))).alias("out"))

    last = lambda z: F.greatest(F.floor((F.size(z) - 1) / BLOCK), F.lit(0)).cast("int")
    blocks = _let(both, lambda z: F.transform(F.sequence(F.lit(0), last(z)),
                                              lambda i: F.aggregate(F.slice(z, i * BLOCK + 1, F.lit(BLOCK)), start, step)))
    walked = F.aggregate(blocks, start, moved)
    return F.transform(F.filter(walked["out"], lambda m: m["v"] >= rule.least),
                       lambda m: F.struct(m["start"], m["stop"], F.lit(rule.kind).alias("kind")))


def _scan_rule(rule: Rule) -> Rule:
    """A class run of at least ``least`` characters is matched as such: its short
    runs are no matches anyway."""
    m = re.fullmatch(r"(\[[^\]]*\])\+", rule.pattern)
    return Rule(rule.kind, f"{m[1]}{{{rule.least},}}", rule.group, rule.least) if m and not rule.group else rule


_EMPTY = "array<struct<start:int,stop:int,kind:string>>"


def scan(docs: DataFrame, rules=BASE + ADDED, id_col="doc_id", text_col="text") -> DataFrame:
    """Per document: id and its spans, array of (start, stop, kind), by start,
    then in the order of the rules."""
    index = materialise(postings(docs, rules, id_col, text_col), "trigram-postings")
    c = candidates(index, rules).alias("c")
    d = docs.select(id_col, text_col).alias("d")
    text = F.coalesce(F.col(f"d.{text_col}"), F.lit(""))
    j = d.join(c, F.col(f"d.{id_col}").eqNullSafe(F.col("c.id")) & (F.xxhash64(F.col(f"d.{text_col}")) == F.col("c.th")), "left")
    none = F.array().cast(_EMPTY)
    parts = []
    for r in rules:
        v = _scan_rule(r)
        if trigram_query(r) is None:
            hit = text.rlike(v.regex)
        else:
            hit = F.coalesce(F.array_contains("c.kinds", r.kind), F.lit(False))
        parts.append(F.when(hit, _spans(text, v)).otherwise(none))
    order = F.create_map(*[x for n, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(n))])
    every = F.transform(F.flatten(F.array(*parts)), lambda s: F.struct(s["start"], order[s["kind"]].alias("o"), s["stop"], s["kind"]))
    spans = F.transform(F.array_sort(every), lambda s: F.struct(s["start"], s["stop"], s["kind"]))
    return j.select(F.col(f"d.{id_col}").alias(id_col), spans.alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def op6_secret_scan(spark, sf_dir):
    r = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin([b.kind for b in BASE]))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return r.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
                    count("hex").alias("n_hex"), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
