"""Names of people and organisations, roles and outcomes: the fixed rules of the domain, as cascades of expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, Rule, collapse, first_rule, label_of, pattern

_TAIL = "[а-яёa-z]*"

#: Outcomes by a case's status or events, in order.
STATUS_RULES = (
    Rule("granted_partial", rf"частичн{_TAIL}\s+удовлетвор|удовлетвор{_TAIL}\s+частичн", 0.9),
    Rule("granted", rf"иск{_TAIL}\s+удовлетвор|удовлетвор{_TAIL}\s+полностью|требования\s+удовлетвор", 0.85),
    Rule("denied", r"в\s+иске\s+отказан|отказано\s+в\s+удовлетвор|отказать\s+в\s+иске", 0.9),
    Rule("settled", r"мировое\s+соглашен|отказ\s+от\s+иска|признан[а-яё]*\s+иск", 0.85),
    Rule("terminated", rf"производств{_TAIL}.{{0,40}}прекращ|оставлен{_TAIL}\s+без\s+рассмотрен", 0.85),
    Rule("returned", rf"возвращ{_TAIL}\s+(?:иск{_TAIL}\s+)?заявлен|заявлен{_TAIL}\s+возвращ|оставлен{_TAIL}\s+без\s+движен", 0.8),
    Rule("appealed_changed", rf"отменен|изменен{_TAIL}\s+решен", 0.75),
    Rule("appealed_upheld", rf"оста(?:вить|влен{_TAIL})\s+без\s+изменен", 0.8),
)
#: Outcomes by the last part of an act, in order.
ACT_RULES = (
    Rule("granted_partial", r"удовлетворить\s+частично|требования\s+удовлетворить\s+частично", 0.8),
    Rule("granted", r"решил(?:а)?[:\s].{0,120}удовлетворить|исковые\s+требования\s+удовлетворить", 0.75),
    Rule("denied", r"в\s+удовлетворении\s+исков[а-яё]*\s+требований\s+отказать|отказать\s+в\s+удовлетворении", 0.85),
    Rule("settled", r"утвердить\s+мировое\s+соглашение|принять\s+отказ\s+от\s+иска", 0.85),
    Rule("terminated", r"прекратить\s+производств", 0.8),
    Rule("appealed_upheld", r"решение.+оставить\s+без\s+изменения|определение.+оставить\s+без\s+изменения", 0.8),
    Rule("appealed_changed", r"решение.+отменить|отменить\s+решение", 0.75),
)
OUTCOMES = ("granted", "granted_partial", "denied", "settled", "terminated", "returned", "appealed_upheld", "appealed_changed", "unknown")

#: Kinds of plaintiffs, buckets of seasonality, families of roles, kinds of representatives.
BANK = r"банк|сбер|втб|газпромбанк|альфа|тинькофф|тиньков|росбанк|открытие|совком|почта\s*банк|райффайзен|юникредит|россельхоз|мтс\s*банк|киви|qiwi"
PARTY_KINDS = (
    Rule("bank", BANK),
    Rule("uk", r'управл\w*\s+компан|тсж|жск|жкх|ук\s+[«"]|ооо\s+ук(?=[A-Za-z0-9_])'),
    Rule("insurance", r"страх\w*|ингосстрах|росгосстрах|ресо|согаз|альфастрах|вск(?=[A-Za-z0-9_])|мак[сc]"),
)
SEASON_BUCKETS = (
    Rule("communal", r"коммунал|жкх|электроэнерг|теплоснаб|водоснаб|газоснаб|коллективн\w*\s+услуг|задолженност\w*\s+по\s+оплате"),
    Rule("divorce", r"расторжен\w*\s+брак|алимент|раздел\w*\s+имуществ|брачн"),
    Rule("dtp", r"дтп|дорожно.?транспорт|осаго|каско|возмещен\w*\s+вред\w*\s+в\s+результат"),
    Rule("credit", r"кредитн|заем|займ|микрофинанс|мфо|неустойк\w*\s+по\s+договор"),
)
ROLE_FAMILIES = (
    Rule("judge", r"судья|председ"),
    Rule("representative", r"представ|адвокат|защитник|юрист"),
    Rule("plaintiff", r"истец|заявител|взыскател|кредитор"),
    Rule("defendant", r"ответчик|должник|обвиняем|подсудим"),
    Rule("third", r"треть"),
)
REPRESENTATIVE = r"адвокат|представ|защитник|юрисконсульт|пов\.?\s*защит"
REPRESENTATIVE_KINDS = (Rule("advocate", r"адвокат|защитник"), Rule("jurist", r"юрист"), Rule("representative", r"представ"))

#: Placeholders of names, and words that organisations' names have.
_STOPS = ("информация скрыта", "данные изъяты", "<данные изъяты>", "<адрес>", "<дата>", "не указано", "не указан", "не указана", "неизвестно", "нет данных", "фио", "ф.и.о.", "ф.и.о", "—", "-", "–", "…", "...")
_ORGANISATION = r"ооо|ао|пао|зао|ип(?=[A-Za-z0-9_])|гуп|муп|фгуп|нко|банк|страх|фонд|министер|управлен|комитет|администрац|прокурат|следственн|мвд|фссп|гибдд|суд(?=[A-Za-z0-9_])"

#: Legal forms by their long names (specific ones first), and by their abbreviations (longest first).
LONG_FORMS = (
    ("ФГУП", r"федеральное\s+государственное\s+унитарное\s+предприятие"),
    ("ГУП", r"государственное\s+унитарное\s+предприятие"),
    ("МУП", r"муниципальное\s+унитарное\s+предприятие"),
    ("ООО", r"общество\s+с\s+ограниченной\s+ответственностью"),
    ("ПАО", r"публичное\s+акционерное\s+общество"),
    ("ЗАО", r"закрытое\s+акционерное\s+общество"),
    ("ОАО", r"открытое\s+акционерное\s+общество"),
    ("НАО", r"непубличное\s+акционерное\s+общество"),
    ("АО", r"акционерное\s+общество"),
    ("ИП", r"индивидуальный\s+предприниматель"),
    ("АНО", r"автономная\s+некоммерческая\s+организация"),
    ("ТСЖ", r"товарищество\s+собственников\s+жилья"),
)
SHORT_FORMS = "фгуп|фгбу|оао|пао|зао|нао|ано|ооо|гуп|муп|нко|гбу|мбу|тсж|снт|ао|ип"


def outcome(status: Column, events_text: Column, act_text: Column) -> Column:
    """(label, confidence, evidence, source): by the status, else the events, else the act's last 2500 characters, else unknown."""
    nothing = F.struct(F.lit("unknown").alias("label"), F.lit(0.0).alias("confidence"), F.lit("").alias("evidence"), F.lit("none").alias("source"))
    tail = F.right(act_text, F.lit(2500))
    return F.coalesce(first_rule(status, STATUS_RULES, "status"), first_rule(events_text, STATUS_RULES, "events"), first_rule(tail, ACT_RULES, "document"), nothing)


def events_text(events: Column) -> Column:
    """'name result' of each event, joined by a bar."""
    return F.array_join(F.transform(events, lambda e: F.concat_ws(" ", F.nullif(e["name"], F.lit("")), F.nullif(e["result"], F.lit("")))), " | ")


def party_kind(name: Column) -> Column:
    return label_of(name, PARTY_KINDS, "other")


def season_bucket(category: Column, status: Column, plaintiff: Column) -> Column:
    text = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in (category, status, plaintiff)))
    found = label_of(text, SEASON_BUCKETS, None)
    return F.coalesce(found, F.when(plaintiff.rlike(pattern(BANK)), F.lit("credit")), F.lit("other"))


def role_family(role: Column) -> Column:
    return label_of(F.coalesce(role, F.lit("")), ROLE_FAMILIES, "other")


def representative_kind(role: Column) -> Column:
    return label_of(F.coalesce(role, F.lit("")), REPRESENTATIVE_KINDS, None)


def is_representative(role: Column) -> Column:
    return F.coalesce(role, F.lit("")).rlike(pattern(REPRESENTATIVE))


def is_masked(raw: Column, collapsed: bool = False) -> Column:
    """Whether a name field holds a placeholder: null, blank, a stop phrase, FIO with a number, bare initials, a case number or <...>.

    collapsed: raw is a column that is collapsed already, which would else be done again for each rule.
    """
    n = raw if collapsed else collapse(raw)
    packed = F.regexp_replace(n, SPACE, "")
    fio = pattern(r"^(?:фио|ф\.?\s*и\.?\s*о\.?)[\s№#.\-]*\d*$")
    number = pattern(r"^(?:\d{1,2}[аa]?[-/|]\d+(?:[/|]\d{2,4})?|\d{1,2}[аa]?-\d+[/|]\d{4})$")
    hidden = F.lower(n).isin(*_STOPS) | packed.rlike(fio) | n.rlike(fio) | n.rlike(pattern(r"фио\s*\d+"))
    hidden = hidden | n.rlike(pattern(r"^[А-ЯЁ]\.\s*[А-ЯЁ]\.\s*[А-ЯЁ]\.?$")) | n.rlike(number) | n.rlike(r"^<[^>]{1,40}>$")
    return F.coalesce((n == "") | hidden, F.lit(True))


def person_name(raw: Column) -> Column:
    """(name, status): the collapsed name if it is identified; status is identified, depersonalized or empty."""
    n = collapse(raw)
    status = F.when(n.isNull() | (n == ""), "empty").when(is_masked(n), "depersonalized").otherwise("identified")
    return F.struct(F.when(status == "identified", n).alias("name"), status.alias("status"))


def name_kind(raw: Column) -> Column:
    """empty, depersonalized, org or identifiable."""
    n = collapse(F.coalesce(raw, F.lit("")))
    first, rest, cap = "[А-ЯЁA-Z]", r"[а-яёa-z\-]+", r"[А-ЯЁA-Z]\."
    person = pattern(rf"^{first}{rest}(?:\s+{first}{rest}){{1,2}}$|^{first}{rest}\s+{cap}\s*{cap}?$|^{first}{rest}\s+{cap}\s*[А-ЯЁA-Z]\.?$|^{cap}\s*{cap}\s+{first}{rest}$", False)
    soft = n.rlike(pattern(r"^[А-ЯЁ][а-яё\-]+(?:\s+[А-ЯЁа-яё.\-]+){1,3}$", False)) & (F.length(n) >= 6)
    return F.when(n == "", "empty").when(is_masked(n), "depersonalized").when(n.rlike(pattern(_ORGANISATION)), "org").when(n.rlike(person) | soft, "identifiable").otherwise("empty")


#: What a role filter accepts besides an element's own text, by the names that users give the filter.
ROLE_FILTERS = (
    (("representative", "представитель", "представ", "rep"), r"представ|адвокат|защитник|юрисконсульт"),
    (("plaintiff", "истец"), r"истец|заявител|взыскател|кредитор"),
    (("defendant", "ответчик"), r"ответчик|должник|обвиняем|подсудим"),
    (("third", "третье"), r"треть"),
    (("judge", "судья"), r"судья|председ"),
)
#: Labels of role families.
FAMILY_LABELS = {"representative": "Представитель", "plaintiff": "Истец", "defendant": "Ответчик", "third": "Третье лицо", "judge": "Судья", "other": "Прочие"}
#: Aliases that a family filter takes besides a family's name and label.
FAMILY_ALIASES = {"representative": ("представитель", "представ", "rep"), "plaintiff": ("истец", "plaintiff"), "defendant": ("ответчик", "defendant")}
#: Fixed value: what stands for a participant without a name.
SKIP = r"^(?:не указ|неизвест|нет данных|информация скрыта|фио#?|—|-|\.{2,})$"


def role_rule(wanted: str) -> str | None:
    """The pattern that a role filter stands for, or None if it is a plain part of a role."""
    return next((p for known, p in ROLE_FILTERS if wanted.lower() in known), None)


def role_accepted(role: Column, wanted: str | None) -> Column:
    """Whether a role fulfils a role filter; no filter, or `all`, accepts each."""
    if not wanted or wanted == "all":
        return F.lit(True)
    text, rule = F.lower(F.coalesce(role, F.lit(""))), role_rule(wanted)
    return text.rlike(pattern(rule)) if rule else F.contains(text, F.lit(wanted.lower()))


def role_matches(role: Column, wanted: str | None) -> Column:
    """Whether a role belongs to the family that a filter names by id, label or alias, or contains the filter's text."""
    f = (wanted or "").strip().lower()
    if f in ("", "all", "*"):
        return F.lit(True)
    named = [k for k in FAMILY_LABELS if f in (k, FAMILY_LABELS[k].lower(), *FAMILY_ALIASES.get(k, ()))]
    return role_family(role).isin(named) | F.contains(F.lower(F.coalesce(role, F.lit(""))), F.lit(f)) if named else F.contains(F.lower(F.coalesce(role, F.lit(""))), F.lit(f))


def family_matches(family: str, wanted: str | None) -> bool:
    """The same for a family that is given by its id. An id is no role that a family is known by, so the filter for other roles takes every family."""
    f = (wanted or "").strip().lower()
    return f in ("", "all", "*", "other", "прочие", family, *FAMILY_ALIASES.get(family, ())) or f in FAMILY_LABELS[family].lower() or f in family


def clean_name(raw: Column, collapsed: bool = False) -> Column:
    """A participant's collapsed name, or null: placeholders, names under two characters, bare numbers."""
    n = raw if collapsed else collapse(raw)
    return F.when(~is_masked(n, collapsed) & (F.length(n) >= 2) & ~n.rlike(pattern(SKIP)) & ~n.rlike(r"^\d+$"), n)


def professional_name(raw: Column, judge: Column) -> Column:
    """A lawyer's or judge's collapsed name, or null: placeholders, short names, numbers, organisations, remarks."""
    n = collapse(raw)
    no = n.rlike(pattern(r"^(?:не указ|неизвест|нет данных|—|-)$")) | n.rlike(r"^\d+$") | n.rlike(pattern(r"^(?:ооо|пао|ао|ип|г\.?\s)")) | n.rlike(pattern(r"^(?:не\s*назнач|не\s*определ|отложен|перенес)"))
    return F.when(~is_masked(n) & (F.length(n) >= F.when(judge, 3).otherwise(4)) & ~no, n)


def split_names(raw: Column) -> Column:
    """The names of a field with several: parts between commas, semicolons, slashes and `и`, without a leading `судья`."""
    parts = F.split(F.coalesce(raw, F.lit("")), pattern(r"[,;/]|\s+и\s+"))
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, pattern(r"^судья[:\s]*"), ""))), lambda p: p != "")


def lawyers_in_fields(text: Column) -> Column:
    """Names after a representative's role word in short fields: up to the next mark, four words at most, six characters at least."""
    rule = pattern(r"(?:адвокат|представител(?:ь|я)|защитник|юрисконсульт)[:\s—-]+([^.;,\n]+)")
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rule), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.trim(F.array_join(F.slice(F.split(x, SPACE + "+"), 1, 4), " "))), lambda x: F.length(x) >= 6)


def name_fields(case: dict[str, Column]) -> Column:
    """(kind, about, raw) of a case's fields that may name judges and lawyers, in order: judge, participants by their roles, events' results by the events' names, and the parties together."""
    row = lambda kind, about, raw: F.struct(F.lit(kind).alias("kind"), F.lower(F.coalesce(about, F.lit(""))).alias("about"), F.coalesce(raw, F.lit("")).alias("raw"))
    text = F.concat_ws(" ", *(F.when(case[c] != "", case[c]) for c in ("parties", "plaintiff", "defendant")))
    return F.concat(
        F.array(row("judge", F.lit(""), case["judge"])),
        F.transform(F.coalesce(case["participants"], F.array()), lambda p: row("participant", p["role"], p["name"])),
        F.transform(F.coalesce(case["events"], F.array()), lambda e: row("event", e["name"], e["result"])),
        F.array(row("parties", F.lit(""), text)),
    )


def _role_of_field(kind: Column, about: Column, raw: Column) -> Column:
    presides = about.rlike("(?iu)судья|председ")
    of_participant = F.when(presides, "judge").when(about.rlike("(?iu)адвокат|представ|юрискон"), "lawyer")
    return F.when(kind == "judge", F.lit("judge")).when(kind == "participant", of_participant).when(kind == "event", F.when(presides & (F.trim(raw) != ""), "judge")).otherwise("lawyer")


def may_hold_names(kind: Column, about: Column, raw: Column) -> Column:
    """Whether a field of `name_fields` has a role, and parties a word before which `lawyers_in_fields` finds nothing."""
    return _role_of_field(kind, about, raw).isNotNull() & ((kind != "parties") | raw.rlike("(?iu)адвокат|представител|защитник|юрисконсульт"))


def names_of_field(kind: Column, about: Column, raw: Column) -> Column:
    """(role, names): whose names a field of `name_fields` holds, and the names; a null role for those that hold none."""
    role = _role_of_field(kind, about, raw)
    return F.struct(role.alias("role"), F.when(kind == "parties", lawyers_in_fields(raw)).otherwise(split_names(raw)).alias("names"))


def representatives(participants: Column, texts: Column) -> Column:
    """Distinct identifiable representatives of a case, from its participants and the texts of its acts."""
    card = F.transform(F.filter(F.coalesce(participants, F.array()), lambda p: is_representative(p["role"])), lambda p: p["name"])
    return F.array_distinct(F.transform(F.filter(F.concat(card, lawyers_in_text(texts)), lambda n: name_kind(n) == "identifiable"), collapse))


def signals(participants: Column, documents: Column) -> Column:
    """(identifiable, only_masked, none) of a case's representatives: whether one can be told, all are masked or organisations, or there is none."""
    card = F.transform(F.filter(F.coalesce(participants, F.array()), lambda p: is_representative(p["role"])), lambda p: p["name"])
    text = F.flatten(F.transform(F.coalesce(documents, F.array()), lambda d: lawyers_in_text(d["text"])))
    kinds = F.transform(F.concat(card, text), name_kind)
    found = F.array_contains(kinds, "identifiable")
    return F.struct(found.alias("identifiable"), ((F.size(kinds) > 0) & ~found).alias("only_masked"), (F.size(kinds) == 0).alias("none"))


def looks_like_organisation(name: Column) -> Column:
    """Whether a name holds a part that organisations' names have, at any place."""
    return F.coalesce(name, F.lit("")).rlike("(?iu)ооо|ао|пао|зао|ип|гуп|муп|фгуп|нко|банк|страх|фонд|министер|управлен|комитет|администрац")


def short_court_name(name: Column, code: Column) -> Column:
    """A court's name without its republic, usual words shortened, 28 characters at most; its code if nothing is left."""
    n = name
    for long, short in (("Республики Мордовия", ""), ("районный суд", "райсуд"), ("городской суд", "горсуд")):  # fixed values
        n = F.regexp_replace(n, f"(?iu){long}", short)
    n = collapse(n)
    return F.when(n == "", code).when(F.length(n) <= 28, n).otherwise(F.concat(F.substring(n, 1, 26), F.lit("…")))


def region_label(region: Column, first_court: Column) -> Column:
    """A region's label by the name of its first court: the republic, the oblast or krai, one of two cities, else its number."""
    names = [F.nullif(F.regexp_extract(first_court, pattern(p), 1), F.lit("")) for p in (r"Республики?\s+([А-Яа-яё\-«»\s]+?)(?:\s|$|,)", r"([А-Яа-яё\-]+(?:ская|ский|ая))\s+област", r"([А-Яа-яё\-]+(?:ский|ская))\s+кра")]
    city = F.when(first_court.rlike("(?iu)москва"), F.lit("Москва")).when(first_court.rlike("(?iu)петербург"), F.lit("СПб"))
    return F.when(region == "13", F.lit("Мордовия")).otherwise(F.coalesce(collapse(F.coalesce(*names)), city, F.concat(F.lit("Рег. "), region)))


def in_region(region: Column, subdomain: Column, code: str, suffix: str) -> Column:
    """Whether a case belongs to a region: by its code, or by its court's suffix if the code is blank."""
    blank = F.coalesce(region, F.lit("")) == ""
    return F.when(blank, F.lower(subdomain).endswith(suffix.lower())).otherwise(region == code)


def category_head(category: Column, length: int = 80) -> Column:
    """A category's part before the first arrow; a dash for none."""
    return F.substring(F.trim(F.split(F.coalesce(F.nullif(category, F.lit("")), F.lit("—")), "→")[0]), 1, length)


def lawyers_in_text(text: Column) -> Column:
    """Names after a representative's role word, up to four words each."""
    rule = pattern(r"(?:адвокат|представител(?:ь|я|ем|ю)|защитник|юрисконсульт)\s*[:\s—-]+\s*([А-ЯЁA-Zа-яёa-z.\-\s]{5,80}?)(?=[,;.]|\n|$)")
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rule), F.lit(1))
    tidy = F.transform(found, lambda x: F.regexp_replace(collapse(x), pattern(r"^(?:г-н|г-жа|гражданин|гражданка)\s+"), ""))
    return F.filter(F.transform(tidy, lambda x: F.array_join(F.slice(F.split(x, " "), 1, 4), " ")), lambda x: x != "")


def entity(raw: Column) -> Column:
    """(canonical, key, form) of a party's name, or null under two characters: quotes dropped, the legal form folded onto its abbreviation."""
    named = collapse(F.regexp_replace(raw, "[«»\"'“”]", ""))
    form = F.nullif(F.upper(F.regexp_extract(named, f"(?iu)^({SHORT_FORMS})(?![а-яёa-z])", 1)), F.lit(""))
    core = named
    for short, long in reversed(LONG_FORMS):
        p = pattern("^" + long)
        form = F.when(named.rlike(p), F.lit(short)).otherwise(form)
    for short, long in reversed(LONG_FORMS):
        p = pattern("^" + long)
        core = F.when(named.rlike(p), F.trim(F.regexp_replace(named, p, " "))).otherwise(core)
    core = F.trim(F.regexp_replace(core, pattern(rf"^(?:{SHORT_FORMS})(?![а-яёa-z])[\s.,-]*"), " "))
    core = F.trim(F.regexp_replace(core, pattern(rf"[\s.,-]+(?:{SHORT_FORMS})$"), " "))
    core = collapse(F.regexp_replace(core, pattern(r"^[\s.,-]+"), ""))
    made = F.struct(F.when(form.isNull(), core).otherwise(F.concat_ws(" ", form, core)).alias("canonical"), F.lower(core).alias("key"), form.alias("form"))
    return F.when((F.length(F.trim(raw)) >= 2) & (F.length(core) >= 2), made)


def parties(raw: Column) -> Column:
    """Parts of a compound party field: split at ; / | , ' - ' and ' и '; two characters or more, no bare numbers."""
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), pattern(r"[;/|,]|\s+-\s+|\s+и\s+")), lambda p: F.trim(p))
    return F.filter(parts, lambda p: (F.length(p) >= 2) & ~p.rlike(r"^\d+$"))


def split_parties(raw: Column) -> Column:
    """(plaintiff, defendant): the first two parts between ; / and |, or the whole as plaintiff."""
    parts = F.filter(F.transform(F.split(raw, r"[;/|]"), lambda p: F.trim(p)), lambda p: p != "")
    return F.struct(F.when(F.size(parts) >= 2, parts[0]).otherwise(F.trim(raw)).alias("plaintiff"), F.when(F.size(parts) >= 2, parts[1]).alias("defendant"))


def case_prefix(number: Column) -> Column:
    found = F.lower(F.regexp_extract(F.trim(number), r"^(\d+[аaАA]?)", 1))
    return F.when(found == "", "?").otherwise(found)


def is_first_instance(number: Column) -> Column:
    return F.trim(number).startswith("2")


def is_appeal(number: Column) -> Column:
    return F.trim(number).startswith("11-")
