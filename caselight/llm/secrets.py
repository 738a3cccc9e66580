"""Secrets in texts by a trigram inverted index, with DataFrame functions only.

From each rule's regular expression follows a Boolean query over trigrams that every match must contain. The index lists,
for each trigram that some query uses, the texts that hold it; a rule's postings are intersected into candidates, and
only there does its expression run. A rule whose expression forces no trigram runs on all texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import free

#: Numbers that are summed up by appending; more are summed up in steps.
STEP = 256
#: Characters of the pieces that a long text is cut into before parts of it are taken.
PIECE = 1024
#: Alternatives that a stretch of an expression may have before it counts as free text.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` whose group `group` has `least` characters; `pattern` must mean the same to Java."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    ignore_case: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.pattern


#: The kinds, expressions and lengths that the reports name.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)


def _strings(nodes) -> list[set[str] | None]:
    """The sequence as stretches: a set of all strings a stretch can be, or None for free text."""
    out: list[set[str] | None] = [{""}]

    def follow(options: set[str] | None) -> None:
        if options is None:
            out.extend((None, {""}))
        elif out[-1] is not None and len(out[-1]) * len(options) <= MOST_STRINGS:
            out[-1] = {a + b for a in out[-1] for b in options}
        else:
            out.extend((None, options))

    for op, value in nodes:
        if op is sre.LITERAL:
            follow({chr(value)})
        elif op is sre.IN and all(x[0] is sre.LITERAL for x in value):
            follow({chr(x[1]) for x in value})
        elif op is sre.SUBPATTERN:
            for part in _strings(value[3]):
                follow(part)
        elif op is sre.BRANCH:
            options = [_strings(x) for x in value[1]]
            follow(set().union(*(x[0] for x in options)) if all(len(x) == 1 for x in options) else None)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, item = value
            inner = _strings(item)
            if len(inner) == 1 and most == 1:
                follow(inner[0] | {""} if least == 0 else inner[0])
                continue
            for _ in range(min(least, 8)):
                for part in inner:
                    follow(part)
            if least != most or least > 8:
                follow(None)
        elif op is not sre.AT:
            follow(None)
    return out


def trigram_query(rule: Rule) -> list[list[frozenset[str]]]:
    """All of these must hold; each holds if a text has all trigrams of one of its sets. Trigrams are in lower case. Empty: nothing is forced."""
    query = []
    for options in _strings(sre_parse.parse(rule.pattern)):
        if options is None:
            continue
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in (x.lower() for x in options)}
        sets = {s for s in sets if not any(other < s for other in sets)}
        if sets and frozenset() not in sets:
            query.append(sorted(sets, key=sorted))
    return query


def candidates(docs: DataFrame, key: Column, text: Column, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rules): by the inverted index, the rules whose trigram query a text fulfils, for texts that fulfil any."""
    spark = docs.sparkSession
    parts, clause = [], 0
    for r, rule in enumerate(rules):
        for p, options in enumerate(trigram_query(rule)):
            for option in options:
                parts += [(trigram, clause, len(option), r, p) for trigram in sorted(option)]
                clause += 1
    needs = {r: len(q) for r, rule in enumerate(rules) if (q := trigram_query(rule))}
    wanted = spark.createDataFrame(parts, "trigram string, clause int, size int, rule int, part int")  # as large as the rules, not the data
    trigrams = F.array(*[F.lit(t) for t in sorted({p[0] for p in parts})])
    low = F.lower(text)
    index = docs.select(key.alias("key"), F.explode(F.filter(trigrams, lambda t: F.contains(low, t))).alias("trigram"))
    met = index.join(F.broadcast(wanted), "trigram").groupBy("key", "clause", "size", "rule", "part").agg(F.count_distinct("trigram").alias("n")).where("n = size")
    need = F.create_map(*[F.lit(x) for pair in needs.items() for x in pair])
    met = met.groupBy("key", "rule").agg(F.count_distinct("part").alias("parts")).where(F.col("parts") == need[F.col("rule")])
    return met.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def _once(value: Column, then) -> Column:
    """then(value), where value is an array that the functions of `then` ask for again and again: it is made once for each row."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running(values: Column, add) -> Column:
    """For each number of an array what `add` makes of 0 and all before it; in time that grows with the array, as only STEP of them are ever appended to."""

    def appended(numbers: Column) -> Column:
        start = F.struct(F.lit(0).alias("total"), F.expr("cast(array() as array<int>)").alias("before"))
        return F.aggregate(numbers, start, lambda acc, x: F.struct(add(acc["total"], x).alias("total"), F.concat(acc["before"], F.array(acc["total"])).alias("before")))

    def whole(numbers: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), ((F.size(numbers) - 1) / STEP).cast("int")), lambda b: appended(F.slice(numbers, b * STEP + 1, F.lit(STEP))))
        ahead = lambda done: appended(F.transform(done, lambda p: p["total"]))["before"]
        return _once(pieces, lambda done: F.flatten(F.zip_with(done, ahead(done), lambda p, t: F.transform(p["before"], lambda v: add(t, v)))))

    return F.when(F.size(values) > 0, _once(values, whole)).otherwise(F.expr("cast(array() as array<int>)"))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Places of a rule's matches: the pieces between matches and the matches themselves give them, in code points."""
    pattern = F.lit(rule.java)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    groups = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    long = F.zip_with(matches, groups, lambda m, g: F.struct(F.length(m).alias("size"), (F.length(g) >= rule.least).alias("fits")))
    each = F.zip_with(F.split(text, rule.java, -1), long, lambda gap, m: F.struct(F.length(gap).alias("gap"), m["size"].alias("size"), m["fits"].alias("fits")))

    def placed(found: Column) -> Column:
        before = running(F.transform(found, lambda x: x["gap"] + x["size"]), lambda a, b: a + b)
        spans = F.zip_with(found, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end"), F.lit(order).alias("kind_order"), F.lit(rule.kind).alias("kind"), x["fits"].alias("fits")))
        return F.transform(F.filter(spans, lambda x: x["fits"]), lambda x: x.dropFields("fits"))

    return _once(F.filter(each, lambda x: x["size"].isNotNull()), placed)  # the piece behind the last match has none


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE_RULES, out_col: str = "secrets") -> DataFrame:
    """All columns of docs and out_col, an array of (start, end, kind_order, kind) by start, then order of the rules.

    Matches of one rule are leftmost and don't overlap; those of different rules may. Places are code points, the end
    exclusive. A null text has no secrets; each row keeps a row, repeated or not, with a null id or not. out_col must be
    a new name; other columns stay as they are.
    """
    if out_col in docs.columns:
        raise ValueError(f"there is a column {out_col} already")
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.xxhash64(F.col(id_col), F.col(text_col))  # texts that clash share their candidates, which are verified anyway
    own, matching = free(docs, "key", "rules")
    found = candidates(docs, key, text, rules).select(F.col("key").alias(own), F.col("rules").alias(matching))
    joined = docs.withColumn(own, key).join(found.hint("shuffle_hash"), own, "left")
    spans = []
    for r, rule in enumerate(rules):
        here = _spans(text, rule, r)
        spans.append(F.when(F.array_contains(matching, r), here).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,kind_order:int,kind:string>>)")) if trigram_query(rule) else here)
    return joined.withColumn(out_col, F.array_sort(F.concat(*spans))).drop(own, matching)


def redact(docs: DataFrame, text_col: str = "text", secrets_col: str = "secrets", mark: str = "[secret]") -> DataFrame:
    """docs with each secret in text_col (overlapping ones as one) replaced by the mark; a null text stays null. Secrets are in the order of their starts."""
    text = F.col(text_col)

    def part(pieces: Column, start: Column, end: Column) -> Column:
        a, b = (start / PIECE).cast("int"), (end / PIECE).cast("int")
        piece = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
        within = F.substring(piece(a), start - a * PIECE + 1, end - start)
        across = F.concat(F.substring(piece(a), start - a * PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, a + 2, b - a - 1), ""), F.substring(piece(b), F.lit(1), end - b * PIECE))
        return F.when(a == b, within).otherwise(across)

    def masked(pieces: Column) -> Column:
        ends = F.transform(secrets_col, lambda x: x["end"])
        # A secret that begins behind all before it begins a stretch; the text from where those end to here is kept.
        opens = F.filter(F.zip_with(F.col(secrets_col), running(ends, F.greatest), lambda x, to: F.struct(to.alias("from"), x["start"].alias("to"))), lambda g: g["to"] >= g["from"])
        kept = F.transform(opens, lambda g: part(pieces, g["from"], g["to"]))
        return F.concat(F.array_join(F.transform(kept, lambda k: F.concat(k, F.lit(mark))), ""), part(pieces, F.array_max(ends), F.length(text)))

    changed = _once(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), masked)
    return docs.withColumn(text_col, F.when(F.size(secrets_col) > 0, changed).otherwise(text))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


