"""Text expressions: white space as web pages have it, rule cascades, tokens, slugs, money."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that pages hold: the ASCII kind, no-break and other Unicode spaces. Java's \s has the ASCII kind only.
SPACE = "[\\s" + "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))) + "]"


def pattern(rule: str, ignore_case: bool = True) -> str:
    r"""A rule's expression for Spark: \s as SPACE (within a class it joins the class), case ignored for all scripts."""
    return ("(?iu)" if ignore_case else "") + rule.replace(r"\s", SPACE)


def present(col: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(col != "", F.lit(False))


def blank_to_null(col: Column) -> Column:
    return F.when(col != "", col)


def collapse(col: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(col, SPACE + "+", " "))


def clean(col: Column) -> Column:
    """Text of a page's cell: six character references decoded, white space collapsed; null gives an empty text."""
    out = F.coalesce(col, F.lit(""))
    # The character references that cells hold.
    for name, char in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.regexp_replace(out, f"(?i){name}", char)
    return collapse(out)


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    confidence: float = 1.0


def first_rule(text: Column, rules: tuple[Rule, ...], source: str) -> Column:
    """(label, confidence, evidence, source) of the first rule that matches, or null. The evidence is the match's first 120 characters."""
    found = collapse(F.coalesce(text, F.lit("")))
    out = F.lit(None).cast("struct<label:string,confidence:double,evidence:string,source:string>")
    for rule in reversed(rules):
        p = pattern(rule.pattern)
        out = F.when(
            found.rlike(p),
            F.struct(F.lit(rule.label).alias("label"), F.lit(rule.confidence).alias("confidence"), F.substring(F.regexp_extract(found, p, 0), 1, 120).alias("evidence"), F.lit(source).alias("source")),
        ).otherwise(out)
    return out


def label_of(text: Column, rules: tuple[Rule, ...], default: str | None) -> Column:
    """The label of the first rule that matches."""
    out = F.lit(default)
    for rule in reversed(rules):
        out = F.when(text.rlike(pattern(rule.pattern)), F.lit(rule.label)).otherwise(out)
    return out


def slug(name: Column, yo: str = "е") -> Column:
    """Lower case, yo as ye (or as another letter), other than letters and digits as one dash, no dash at either end, 80 characters."""
    out = F.translate(F.lower(name), "ё", yo)
    out = F.regexp_replace(F.regexp_replace(out, "[^a-zа-я0-9]+", "-"), "^-|-$", "")
    return F.substring(out, 1, 80)


#: Words without weight in the search.
STOP_WORDS = (
    "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня о из "
    "ему теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя ничего "
    "ей может они тут где есть над для тебя их чем была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот "
    "того потому этого какой совсем ним здесь этом один почти мой тем чтобы нее сейчас были куда зачем всех никогда можно "
    "при наконец два об другой хоть после над больше тот через эти нас про всего них какая много разве три эту моя впрочем "
    "хорошо свою этой перед иногда лучше чуть том нельзя такой им более конечно всю среди её ею года год г ст п пп ппц рк "
    "суд суда суду дела дело дел которые который которая которое данного данной данного указанные"
).split()

#: Endings that a stem loses, in the order in which they are tried.
ENDINGS = "иями овами ями ами ого ему его ому ему их ых ию ия ия ем ам ом ах ях ую юю ий ый ой ая яя ое ее и ы е й а я о у ю ь ъ".split()


def stem(word: Column) -> Column:
    """The word without the first ending that leaves four letters; words of up to four letters stay.

    No ending comes before a longer one that ends in it, so the first that fits is the longest: one expression finds it.
    """
    return F.when(word.rlike("[а-яё]$"), F.regexp_replace(word, f"^(.{{4,}}?)(?:{'|'.join(dict.fromkeys(ENDINGS))})$", "$1")).otherwise(word)


def split_words(text: Column) -> Column:
    """A text's words for the index and for its queries, before stop words and stems: lower case, letters, digits and dashes."""
    return F.split(F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), "ё", "е"), "[^a-zа-я0-9\\-]+", " ")), " ")


def stops_of(stop_words: list[str] | None) -> list[str]:
    return list(dict.fromkeys(STOP_WORDS if stop_words is None else stop_words))


#: Letters, digits and dashes of a word, in lower case.
WORD = "[a-zа-я0-9\\-]+"
_ENDING = re.compile(f"(.{{4,}}?)(?:{'|'.join(dict.fromkeys(ENDINGS))})")


def words_of(text: str, word: str = WORD) -> list[str]:
    """What `split_words` gives for a text in a task; of an empty text no word instead of an empty one."""
    return re.findall(word, text.lower().replace("ё", "е"))


def stem_of(word: str) -> str:
    """What `stem` gives for a word in a task."""
    found = _ENDING.fullmatch(word)
    return found[1] if found else word


def tokenize(text: Column, stop_words: list[str] | None = None) -> Column:
    """Stems of a text's words for the index and for its queries: two characters or more, no stop words before or after stemming."""
    stops = F.array(*[F.lit(w) for w in stops_of(stop_words)])
    kept = F.filter(split_words(text), lambda w: (F.length(w) >= 2) & ~F.array_contains(stops, w))
    return F.filter(F.transform(kept, stem), lambda w: (w != "") & ~F.array_contains(stops, w))


def money(raw: Column) -> Column:
    """12 345,67, 12345.67 or 12.345,67 as a double over 0, up to 1e12; else null."""
    s = F.regexp_replace(F.regexp_replace(raw, SPACE + "+", ""), "(?i)&nbsp;", "")
    no_dots = F.regexp_replace(F.regexp_replace(s, "\\.", ""), ",", ".")
    s = F.when(s.rlike(r"^\d{1,3}(\.\d{3})+(,\d{1,2})?$"), no_dots).when(s.contains(",") & s.contains("."), no_dots).otherwise(F.regexp_replace(s, ",", "."))
    n = F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), s.cast("double"))
    return F.when((n > 0) & (n <= 1e12), n)


_SUM = r"(\d[\d\s.]{0,18}\d(?:[,.]\d{1,2})?)"
#: What stands before a sum that is claimed, and before one that is awarded.
CLAIMED = r"(?:исков\w*\s+требован\w*|сумм\w*\s+иск\w*|о\s+взыскании)\D{0,80}" + _SUM + r"\s*(?:руб|₽)"
AWARDED = r"(?:взыскать|взыскан\w*|присудить)\D{0,60}" + _SUM + r"\s*(?:руб|₽)"


def amounts(text: Column) -> Column:
    """(claim, award): the largest claimed and awarded sums of 100 or more in a text's first 8000 and last 6000 characters; texts under 40 characters have none."""
    parts = F.concat(F.left(text, F.lit(8000)), F.lit("\n"), F.right(text, F.lit(6000)))

    def largest(rule: str) -> Column:
        found = F.regexp_extract_all(parts, F.lit(pattern(rule)), F.lit(1))
        return F.when(F.length(text) >= 40, F.array_max(F.filter(F.transform(found, money), lambda v: v >= 100)))

    return F.struct(largest(CLAIMED).alias("claim"), largest(AWARDED).alias("award"))


def rounded(x: Column) -> Column:
    """Half up for either sign, as a long."""
    return F.floor(x + 0.5)


def percent(part: Column, whole: Column) -> Column:
    """Per cent with one decimal; 0 of nothing."""
    return F.when(whole > 0, F.floor(part * 1000 / whole + 0.5) / 10).otherwise(F.lit(0.0))
